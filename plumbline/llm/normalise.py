"""Problem 1: one consistent form for texts that look the same.

Canonical form of a text:

* compatibility characters (full width, ligatures, squared units, radicals, compatibility ideographs) become their plain
  equivalents, composed by NFC; superscripts and subscripts stay, since they look different;
* characters that are not seen (all format characters but a few Arabic ones, selectors of variants, tags, fillers) are dropped;
* every kind of blank becomes a space, every kind of line end a line feed; both are dropped at the ends of the text;
* signs that look like ASCII ones (dashes, quotes, ratio sign) become these, radicals without decomposition their ideographs;
* letters of other scripts that look like Latin ones, with or without marks, become Latin, unless their word holds letters of
  these scripts without such a twin and no Latin letter, as real Cyrillic or Greek words do.

Case, accents, numbers of inner blanks and line breaks are visible and stay.

Method: the quick-check property of normalisation (with the sets above) is compiled into one character class. Text that
holds no such character is returned as it is; otherwise only the unstable segments are normalised, with the preceding
starter as context where marks may compose with it, and spliced into the unchanged rest.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialise

# Letters of other scripts that look like Latin ones: Cyrillic, Greek, Armenian, Coptic, Lisu, Cherokee, phonetic letters.
LOOKALIKE_FROM = "АВЕКМНОРСТХУЅІЈаеорсухѕіјԁԛԝһѴѵҮԌԚԜӀӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαικονρυϲϳϹօսհոՕՏⲞⲟⲢⲣⲤⲥⲔⲘⲎⲬꓐꓑꓓꓔꓖꓗꓙꓚꓝꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴꓜᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏚᏙᏞᏟᏢᏦᏴɡᴄᴏᴠᴡᴢꜱᴜ"
LOOKALIKE_TO = "ABEKMHOPCTXYSIJaeopcyxsijdqwhVvYGQWIlABEZHIKMNOPTYXaikovpucjCouhnOSOoPpCcKMHXBPDTGKJCFNLSRVHWXYAEIOUZDRTAJEWMHGZSVLCPKBgcovwzsu"
# Signs that look like ASCII ones or the middle dot, and radicals that look like ideographs but have no decomposition.
SIGNS_FROM = "‐‑‒–⁃−’‘‛′ʼ“”‟″∶꞉˸⁄∕∗∼〜‚∙⋅‧ꞏ"
SIGNS_TO = "------'''''\"\"\"\":::" + "//*~~," + "····"
RADICALS_FROM = "⺠⻄⻅⻆⻉⻋⻓⻔⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻨⻩⻬⻮⻰"
RADICALS_TO = "民西见角贝车长门青韦页风飞食马骨鬼鱼鸟麦黄齐齿龙"
# Characters without a visible form besides those of format and the selectors of variants; format characters that are seen; blanks.
INVISIBLE = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180f\u3164\uffa0"
SEEN_FORMAT = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u0890\u0891\u08e2\U000110bd\U000110cd"
BLANKS = "\t \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u2800"
LINE_ENDS = "\r\u000b\u000c\u0085\u2028\u2029"

_TWIN = dict(zip(LOOKALIKE_FROM, LOOKALIKE_TO, strict=True))
_SIGN = dict(zip(SIGNS_FROM + RADICALS_FROM, SIGNS_TO + RADICALS_TO, strict=True))


def _marked() -> dict[str, str]:
    """Single characters that are a letter with a Latin twin and marks, such as an iotified E with a diaeresis, by the twin with the same marks."""
    out = {}
    for code in (*range(0x370, 0x590), *range(0x1F00, 0x2000)):
        base, *marks = unicodedata.normalize("NFD", chr(code))
        if marks and base in _TWIN:
            out[chr(code)] = unicodedata.normalize("NFC", _TWIN[base] + "".join(marks))
    return out


_TWIN |= _marked()


def _unseen(ch: str) -> bool:
    """Format characters, selectors of variants and fillers."""
    return ch in INVISIBLE or "\ufe00" <= ch <= "\ufe0f" or "\U000e0100" <= ch <= "\U000e01ef" or unicodedata.category(ch) == "Cf" and ch not in SEEN_FORMAT and not "\U00013430" <= ch <= "\U0001345f"


def _keeps(ch: str) -> bool:
    """Superscripts and subscripts differ to the eye from plain characters."""
    return unicodedata.decomposition(ch).startswith(("<super>", "<sub>"))


def _single(ch: str) -> str:
    """The canonical form of a character, without regard to its neighbours."""
    if ch in _SIGN:
        return _SIGN[ch]
    if _unseen(ch):
        return ""
    if ch in BLANKS:
        return " "
    if ch in LINE_ENDS:
        return "\n"
    if _keeps(ch):
        return ch
    kind = unicodedata.decomposition(ch)
    if kind.startswith("<"):  # by one step, so that the superscript in a squared unit stays
        return "".join(_single(chr(int(x, 16))) for x in kind.split()[1:])
    if kind and not unicodedata.is_normalized("NFC", ch):  # composition exclusions, singletons such as compatibility ideographs
        return "".join(_single(x) for x in unicodedata.normalize("NFC", ch)) if unicodedata.normalize("NFC", ch) != ch else ch
    return ch


def _tables() -> tuple[dict[str, str], str, str]:
    """Single replacements; the class of characters that change alone; that of those which may compose with what precedes."""
    alone, compose = {}, []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE0200)]:
        ch = chr(code)
        if unicodedata.combining(ch) or 0x1161 <= code <= 0x1175 or 0x11A8 <= code <= 0x11C2:
            compose.append(ch)
        elif (to := _single(ch)) != ch:
            alone[ch] = to
    alone |= {x: _single(x) for x in "\t\r\x0b\x0c"}

    def ranges(chars: list[str]) -> str:
        out, codes = "", sorted(ord(c) for c in chars if c < "\U00010000")
        start = last = codes[0]
        for c in [*codes[1:], sys.maxsize]:
            if c != last + 1:
                out += re.escape(chr(start)) + ("-" + re.escape(chr(last)) if last > start else "")
                start = c
            last = c
        return out

    # beyond the basic plane a few whole blocks, as each more range costs time for every character
    return alone, ranges([*alone, *_TWIN]) + "\U00010000-\U0001f2ff\U0001fbf0-\U0001fbf9\U0002f800-\U0002fa1f\U000e0000-\U000e01ff", ranges(compose)


_ALONE, _U, _C = _tables()
_UNSTABLE = re.compile(f"[{_U}]+")
_COMPOSING = re.compile(f"[{_C}]")
_WITH_CONTEXT = re.compile(f"[^{_U}{_C}][{_U}]*[{_C}][{_U}{_C}]*|[{_U}{_C}]+")
_TWINS = re.compile(f"[{re.escape(''.join(_TWIN))}]")
_WORD = re.compile(r"[^\W\d_]+")
_LATIN = re.compile("[A-Za-z]")
_OWN_SCRIPT = re.compile(r"[Ͱ-ϿЀ-ԯ԰-֏Ꭰ-Ᏽἀ-῾Ⲁ-⳿ꓐ-ꓽꭰ-ꮿ]")
_cache: dict[str, str] = {}


def _segment(m: re.Match) -> str:
    s = m.group()
    got = _cache.get(s)
    if got is None:
        got = "".join(_ALONE.get(ch, ch) for ch in s)
        if not got.isascii():
            got = unicodedata.normalize("NFC", got)
        if len(_cache) > 50_000:
            _cache.clear()
        _cache[s] = got
    return got


def _latin(m: re.Match) -> str:
    word = m.group()
    if any(ch not in _TWIN for ch in _OWN_SCRIPT.findall(word)) and not _LATIN.search(word):
        return word
    return "".join(_TWIN.get(ch, ch) for ch in word)


def canonical(text: str | None) -> str | None:
    """The canonical form of ``text``; None stays None, an empty text empty."""
    if not text:
        return text
    if _COMPOSING.search(text):
        text = _WITH_CONTEXT.sub(_segment, text.replace("\r\n", "\n"))
    elif _UNSTABLE.search(text):
        text = _UNSTABLE.sub(_segment, text.replace("\r\n", "\n") if "\r" in text else text)
    if _TWINS.search(text):
        text = _WORD.sub(_latin, text)
        if _COMPOSING.search(text):  # a mark on a letter that is Latin only now
            text = unicodedata.normalize("NFC", text)
    return text.strip(" \n")


_READABLE = re.compile(r"[\W_]+")


def letters_and_digits(text: str) -> str:
    """Lower-cased letters and digits of a canonical text."""
    return _READABLE.sub("", text.lower())


def key128(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def cuts(columns: list[pa.Array], rows: int, size: int = 6_000_000) -> Iterator[tuple[int, int]]:
    """``start, number`` of runs of at most ``rows`` rows and about ``size`` bytes of text, so that a batch of long texts needs no more memory."""
    n = sum(pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(int) for c in columns)
    start = held = 0
    for k, x in enumerate(n.tolist()):
        if k > start and (k - start >= rows or held + x > size):
            yield start, k - start
            start, held = k, 0
        held += x
    if start < len(n):
        yield start, len(n) - start


def canonical_column(c: Column) -> Column:
    """The canonical form of a string column, by Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(s):
        return s.map(canonical, na_action="ignore")

    return run(c)


def normalise_fields(df: DataFrame, fields: list[str]) -> DataFrame:
    """``df`` with each named string column in canonical form; all other columns and rows unchanged. Null stays null."""
    for f in fields:
        if f not in df.columns:
            raise ValueError(f"no column {f}")
    return df.withColumns({f: canonical_column(F.col(f"`{f}`")) for f in fields})


def forms(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("question", "answer"), least: int = 10) -> DataFrame:
    """One row for each text of a field: ``field, id, form`` (128 bits of the canonical form), ``raw`` (128 bits of the text).

    Null ids, null texts and texts with fewer than ``least`` letters and digits have no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = b.column(0).to_pylist(), ([], [], [], [])
            for k, name in enumerate(fields):
                for i, t in zip(ids, b.column(k + 1).to_pylist(), strict=True):
                    if i is None or t is None or len(t) < least:
                        continue
                    c = canonical(t)
                    if len(_READABLE.sub("", c)) < least:
                        continue
                    for to, v in zip(out, (name, i, key128(c), key128(t)), strict=True):
                        to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.string()), pa.array(out[2], pa.binary()), pa.array(out[3], pa.binary())], names=["field", "id", "form", "raw"])

    cols = [F.col(f"`{id_col}`").cast("string").alias("id"), *(F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(fields))]
    return df.select(*cols).mapInArrow(run, "field string, id string, form binary, raw binary")


def same_looking(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("question", "answer"), least: int = 10, full_class: int = 512) -> DataFrame:
    """Pairs ``field, id_a, id_b`` of different ids whose texts look the same but are stored as different characters.

    Rows repeated whole count once. Classes in which all texts are equal strings yield nothing. Every class (one
    canonical form) yields all its pairs. In a class of more than ``full_class`` ids, different strings are paired first, so that
    ids of equal strings never meet, and its ids are spread over salts of about ``full_class`` ids each.
    """
    rows = materialise(forms(df, id_col, fields, least).distinct(), "forms")
    several = rows.groupBy("field", "form").agg(F.min("raw").alias("r0"), F.max("raw").alias("r1"), F.count(F.lit(1)).alias("n"))
    several = several.where("r0 <> r1").select("field", "form", "n")
    members = rows.join(several, ["field", "form"])
    small = members.where(F.col("n") <= full_class).select("field", "form", "id", "raw")
    a, b = small.alias("a"), small.alias("b")
    same = (F.col("a.field") == F.col("b.field")) & (F.col("a.form") == F.col("b.form"))
    pairs = a.join(b, same & (F.col("a.id") < F.col("b.id")) & (F.col("a.raw") != F.col("b.raw"))).select("a.field", F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    large = members.where(F.col("n") > full_class).withColumn("salts", F.ceil(F.col("n") / full_class).cast("int")).drop("n")
    strings = large.select("field", "form", "raw", "salts").distinct()
    met = strings.join(strings.select("field", "form", F.col("raw").alias("raw_b")), ["field", "form"]).where("raw < raw_b")
    left = met.join(large.drop("salts"), ["field", "form", "raw"]).select("field", "form", F.col("raw_b").alias("raw"), "id", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = large.select("field", "form", "raw", F.col("id").alias("to"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    rest = left.join(right, ["field", "form", "raw", "salt"]).where("id <> to").select("field", F.least("id", "to").alias("id_a"), F.greatest("id", "to").alias("id_b"))
    return pairs.unionByName(rest).distinct()
