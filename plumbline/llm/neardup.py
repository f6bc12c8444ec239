"""Problem 2: near-duplicate records, by an inverted join of signature coordinates.

Similarity of two records: the Jaccard index of the sets of character trigrams of their fields, joined, in canonical
form (see normalise), in lower case, letters and digits only.

1. Records with equal keys form one class; what follows handles one text for each class.
2. A text's signature has ``coordinates`` values. Each is made of ``rows`` independent min-hashes (one-permutation
   hashing: one pass for each row gives that row's value of every coordinate; empty bins borrow from others by a fixed
   probe), so two texts of similarity s agree in a coordinate with probability s**rows.
3. Prefix: every text is posted under each coordinate-value pair, and the texts of a posting list meet. With the defaults
   (64, 5; in eight rounds), a pair of similarity 0.6 is found with probability 0.994, one of 0.7 with 0.99999, whereas one of 0.2 is with 0.02.
4. Skip: the 320 single min-hashes, of one bit each, aren't posted, but go with each posting; pairs that meet below the match
   threshold are dropped where they meet (at similarity 0.6: one in 100,000). The pairs that meet grow with the square of the
   texts, since a list of unlike texts grows with them; so they are neither written nor shuffled, and cost some 50 ns each.
5. The pairs left are compared exactly.

Postings are shuffled as packed arrays, not as rows. Nothing is capped, and no list of candidates is held in one place.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.normalise import canonical, cuts, key128, letters_and_digits
from plumbline.operators.graph import connected_components
from plumbline.session import drop, materialise


#: Texts that a task remembers to pass each on but once.
SEEN = 1 << 20
#: Texts whose signatures are made at once.
AT_ONCE = 1000
#: Postings of one coordinate that meet in one task, and pairs that are compared at once.
LIST, PAIRS = 1 << 20, 1 << 18
#: Tasks of a coordinate at least.
LEAST_PARTS = 2
#: Characters of the texts whose pieces a task keeps for the pairs that follow; a piece takes a hundred bytes.
KEPT = 400_000


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all trigrams of the texts, and the index of the text that each is from. A text of one or two characters is its own piece."""
    texts = [t if len(t) > 2 or not t else t + "\0" * (3 - len(t)) for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = np.array([len(t) for t in texts], np.int64)
    doc = np.repeat(np.arange(len(texts)), n)
    if len(codes) < 3:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tri = (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]
    inside = doc[:-2] == doc[2:]
    return tri[inside], doc[:-2][inside]


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """The finaliser of splitmix64."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _one_permutation(tri: np.ndarray, doc: np.ndarray, docs: int, bins: int, seed: int) -> np.ndarray:
    """Min-hashes (docs, bins) by one pass; empty bins take the value of the first full bin of their own fixed probe sequence."""
    h = _mix(tri, seed)
    at = (h >> np.uint64(40)) % np.uint64(bins) + doc.astype(np.uint64) * np.uint64(bins)
    none = np.iinfo(np.int64).max
    out = np.full(docs * bins, none, np.int64)
    np.minimum.at(out, at.view(np.int64), ((h & np.uint64(0xFFFFFFFF)) + np.uint64(1)).view(np.int64))
    out = out.reshape(docs, bins)
    full = out != none
    rows, cols = np.nonzero(~full & full.any(axis=1)[:, None])
    attempt = 0
    while len(rows):
        attempt += 1
        probe = (_mix(np.arange(bins, dtype=np.uint64), seed * 1009 + attempt) % np.uint64(bins)).astype(np.int64)[cols]
        ok = full[rows, probe]
        out[rows[ok], cols[ok]] = out[rows[ok], probe[ok]]
        rows, cols = rows[~ok], cols[~ok]
    return out


def signatures(texts: list[str], coordinates: int = 64, rows: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Posted coordinates (texts, coordinates) as 32-bit values, and one bit of each single min-hash (texts, rows words)."""
    tri, doc = _trigrams(texts)
    n = len(texts)
    posted = np.zeros((n, coordinates), np.uint64)
    words = np.empty((n, rows), np.int64)
    for r in range(rows):
        value = _mix(_one_permutation(tri, doc, n, coordinates, r + 1).view(np.uint64), 100 + r)
        posted = _mix(posted ^ value, 200 + r)
        bits = np.zeros((n, 64), np.uint8)
        bits[:, :coordinates] = (value >> np.uint64(63)).astype(np.uint8)
        words[:, r] = np.packbits(bits, axis=1, bitorder="little").view(np.int64)[:, 0]
    return (posted >> np.uint64(32)).astype(np.uint32).view(np.int32), words


def keyed(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("question", "answer")) -> DataFrame:
    """``id, key, text``: 128 bits of each record's key text, which itself stands only in the first row of that text in a task and is null elsewhere.

    Rows without id have none; null fields are empty; a record with an empty key text has no key.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            keys: list[bytes | None] = []
            texts: list[str | None] = []
            for row in zip(*(c.to_pylist() for c in b.columns[1:]), strict=True):
                t = letters_and_digits(canonical("".join(x or "" for x in row)))
                k = key128(t) if t else None
                keys.append(k)
                texts.append(None if k is None or k in seen else t)
                if len(seen) >= SEEN:  # a text that comes again then stands twice, which the shuffle mends
                    seen.clear()
                if k is not None:
                    seen.add(k)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(texts, pa.string())], names=["id", "key", "text"])

    cols = [F.col(f"`{id_col}`").cast("string").alias("id"), *(F.col(f"`{f}`").cast("string").alias(f"f{k}") for k, f in enumerate(fields))]
    return materialise(df.select(*cols).where("id is not null").mapInArrow(run, "id string, key binary, text string"), "keyed")


def _packed(x: np.ndarray) -> pa.Array:
    """The rows of an array, each as its bytes."""
    x = np.ascontiguousarray(x)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(x.shape[1] * x.itemsize), len(x), [None, pa.py_buffer(x)]).cast(pa.binary())


def _unpacked(c: pa.Array, kind: type) -> np.ndarray:
    c = c.cast(pa.binary())
    ends = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]
    return np.frombuffer(c.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(len(c), -1)


def signed(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("question", "answer"), coordinates: int = 64, rows: int = 5, rounds: int = 8) -> tuple[DataFrame, DataFrame]:
    """Membership ``id, h`` and the different texts ``h, text, words, posted0...``, once each, with their signatures; ``posted0...`` have the coordinates of each round.

    Texts are told apart by 128 bits of their hash; ``h`` is a number given to each of them, null for an empty key text.
    """
    if coordinates > 64 or coordinates % rounds:
        raise ValueError("64 coordinates at most, the same number in each round")
    names = ["key", "text", "words", *(f"posted{r}" for r in range(rounds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at, size in cuts([whole.column(1)], AT_ONCE):
                b = whole.slice(at, size)
                posted, words = signatures(b.column(1).to_pylist(), coordinates, rows)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _packed(words), *map(_packed, np.split(posted, rounds, axis=1))], names=names)

    found = keyed(df, id_col, fields)
    schema = "key binary, text string, " + ", ".join(f"{n} binary" for n in names[2:])
    once = found.where("text is not null").groupBy("key").agg(F.first("text").alias("text"))
    texts = materialise(once.mapInArrow(run, schema).withColumn("h", F.monotonically_increasing_id()), "signed")
    members = materialise(found.select("id", "key").distinct().join(texts.select("key", "h"), "key", "left").select("id", "h"), "members")
    drop(found)
    return members, texts.drop("key")


def jaccard(a: str, b: str) -> float:
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} or ({t} if t else set()) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 0.0


def _exact(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[str, set[str]] = {}
        held = 0
        for b in batches:
            s = []
            for ta, tb in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                if held > KEPT:
                    sets.clear()
                    held = 0
                for t in (ta, tb):
                    if t not in sets:
                        sets[t] = {t[i : i + 3] for i in range(len(t) - 2)} or {t}
                        held += len(t)
                x, y = sets[ta], sets[tb]
                both = len(x & y)
                s.append(both / (len(x) + len(y) - both))
            keep = pa.array([v >= threshold for v in s], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(s, pa.float64())], names=["a", "b", "similarity"]).filter(keep)

    return run


def _post(per: int):
    """``part, values, h, words``: the postings of one round by coordinate and part of its values, packed. A batch: ``h, words, posted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            h, words, posted = b.column(0).to_numpy(), _unpacked(b.column(1), np.uint64), _unpacked(b.column(2), np.uint32)
            within = (posted.astype(np.uint64) * np.uint64(per) >> np.uint64(32)).astype(np.uint16 if per <= 1 << 16 else np.uint32)
            out: list[list] = [[], [], [], []]
            for c, (part, values) in enumerate(zip(within.T, posted.T, strict=True)):
                at = np.argsort(part, kind="stable")
                ends = np.cumsum(np.bincount(part, minlength=per)).tolist()
                cols = [x.take(at, axis=0) for x in (values, h, words)]
                for k, (i, j) in enumerate(zip([0, *ends], ends)):
                    if j > i:
                        for x, y in zip(out, (c * per + k, *(x[i:j].tobytes() for x in cols)), strict=True):
                            x.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["part", "values", "h", "words"])

    return run


def _met(values: np.ndarray, h: np.ndarray, words: np.ndarray, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of texts under an equal value of which ``least`` bits agree; (a, b) with a < b. ``words`` are unsigned, as NumPy counts the bits of an absolute value."""
    order = np.sort(values.astype(np.uint64) << np.uint64(32) | np.arange(len(values), dtype=np.uint64))  # faster than argsort
    values = order >> np.uint64(32)
    same = values[1:] == values[:-1]
    several = np.r_[same, False] | np.r_[False, same]
    order = (order[several] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    values, h, bits = values[several], h[order], np.ascontiguousarray(words[order].T)
    if not len(values):
        return
    ends = np.flatnonzero(np.r_[values[1:] != values[:-1], True]) + 1
    later = np.repeat(ends, np.diff(ends, prepend=0)) - np.arange(len(values)) - 1
    before = np.cumsum(later) - later
    at = 0
    while at < len(values):
        to = max(at + 1, int(np.searchsorted(before, before[at] + PAIRS)))
        n = later[at:to]
        if n.any():
            i = np.repeat(np.arange(at, to), n)
            j = np.arange(len(i)) - np.repeat(before[at:to] - before[at], n) + i + 1
            differ = np.zeros(len(i), np.uint16)
            for w in bits:
                differ += np.bitwise_count(w[i] ^ w[j])
            keep = np.flatnonzero(differ <= 64 * len(bits) - least)
            x, y = h[i[keep]], h[j[keep]]
            yield np.minimum(x, y), np.maximum(x, y)
        at = to


def _meet(rows: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[list[bytes]]] = {}
        for b in batches:
            for part, *x in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for held, c in zip(parts.setdefault(part, [[], [], []]), x, strict=True):
                    held.append(c)
        while parts:
            values, h, words = (np.frombuffer(b"".join(x), kind) for x, kind in zip(parts.popitem()[1], (np.uint32, np.int64, np.uint64), strict=True))
            for x, y in _met(values, h, words.reshape(-1, rows), least):
                yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return run


def class_links(texts: DataFrame, threshold: float = 0.6, coordinates: int = 64, rows: int = 5, matches: int = 224, rounds: int = 8) -> DataFrame:
    """``a, b, similarity``: every pair of different texts (by their numbers, a < b) of ``signed`` at or above ``threshold``.

    ``matches`` of the 320 unposted bits (64 coordinates of 5 rows) must agree; by default 224, four and a half deviations under
    the 256 expected at 0.6. The coordinates meet in ``rounds``, so that the postings of one round only are on disk at a time.
    """
    per = max(LEAST_PARTS, -(-texts.count() // LIST))
    least = matches + rows * (64 - coordinates)  # bits without a coordinate are 0 in every text
    found = []
    for r in range(rounds):
        post = texts.select("h", "words", f"posted{r}").mapInArrow(_post(per), "part int, values binary, h binary, words binary")
        met = post.repartitionById(coordinates // rounds * per, "part").mapInArrow(_meet(rows, least), "a bigint, b bigint")
        found.append(materialise(met, f"round{r}"))
    kept = materialise(functools.reduce(DataFrame.unionByName, found).distinct(), "candidates")
    for x in found:
        drop(x)
    wanted = kept.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    asked = texts.select("h", "text").join(wanted, "h", "left_semi")
    sides = [asked.select(F.col("h").alias(s), F.col("text").alias(f"t{s}")) for s in "ab"]
    return kept.join(sides[0], "a").join(sides[1], "b").mapInArrow(_exact(threshold), "a bigint, b bigint, similarity double")


def links(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("question", "answer"), threshold: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Membership ``id, h`` of every id (null for an empty key), and the links ``a, b, similarity`` between classes of equal texts.

    Null fields are empty texts; records whose key is empty are linked to none. Repeated rows count once; an id with several
    contents is in several classes. An empty table gives empty results.
    """
    members, texts = signed(df, id_col, fields)
    return members, materialise(class_links(texts, threshold), "links")


def pairs(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("question", "answer"), threshold: float = 0.6, full_class: int = 512) -> DataFrame:
    """``id_a, id_b``: all pairs of different ids at or above ``threshold``, the smaller id first.

    Every class of equal texts gives all its pairs and all those with linked classes; the ids of one with more than
    ``full_class`` are joined over salts of about ``full_class`` ids each.
    """
    members, found = links(df, id_col, fields, threshold)
    members = members.where("h is not null")
    sizes = members.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / full_class).cast("int").alias("salts"), F.count(F.lit(1)).alias("n"))
    both = found.join(members.select(F.col("h").alias("a"), F.col("id").alias("i")), "a").join(members.select(F.col("h").alias("b"), F.col("id").alias("j")), "b").select("i", "j")
    several = members.join(sizes.where("n > 1"), "h")
    left = several.select("h", F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    right = several.select("h", F.col("id").alias("j"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    within = left.join(right, ["h", "salt"]).where("i < j").select("i", "j")
    return both.unionByName(within).where("i <> j").select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b")).distinct()


def groups(df: DataFrame, id_col: str = "id", fields: tuple[str, ...] = ("question", "answer"), threshold: float = 0.6) -> DataFrame:
    """One row for each id: ``id, group_id, n_links``: its group (connected texts; the group's least id) and the number of other texts it is linked to.

    An id whose key is empty is a group by itself. An id with several contents has the least of their groups and the most of their links.
    """
    members, found = links(df, id_col, fields, threshold)
    comp = connected_components(found)
    degree = found.select(F.explode(F.array("a", "b")).alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
    named = members.where("h is not null").join(comp.withColumnRenamed("node", "h"), "h", "left").join(degree, "h", "left").withColumn("component", F.coalesce("component", "h"))
    first = named.groupBy("component").agg(F.min("id").alias("group_id"))
    alone = members.where("h is null").select("id", F.col("id").alias("group_id"), F.lit(None).cast("bigint").alias("n_links"))
    return named.join(first, "component").select("id", "group_id", "n_links").unionByName(alone).groupBy("id").agg(F.min("group_id").alias("group_id"), F.max(F.coalesce("n_links", F.lit(0))).alias("n_links"))
