"""Problem 4: limits in a common unit.

An automaton over all aliases (Aho-Corasick) runs over the unit, label and note of each check; the longest match at a place
counts, if a number, a blank or a phrase such as "unit:" stands beside it. The topic's quantity, by the majority of its
checks' units over the whole table, settles which reading holds; where a topic has no majority, a check with one reading
has that one. Conversion factors are joined by broadcast (their number
is fixed by the table below).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from fractions import Fraction

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import materialise

# Quantity; factor to the first unit of the quantity and offset added before; spellings (NFKC, lower case, no blanks).
UNITS: list[tuple[str, str, str, str]] = [
    ("length", "1", "0", "mm 毫米 公厘 millimetre millimetres millimeter millimeters"),
    ("length", "10", "0", "cm 厘米 公分 centimetre centimetres centimeter centimeters"),
    ("length", "100", "0", "dm 分米 decimetre decimetres decimeter decimeters"),
    ("length", "1000", "0", "m 米 公尺 metre metres meter meters"),
    ("length", "1000000", "0", "km 公里 千米 kilometre kilometres kilometer kilometers"),
    ("length", "1/1000", "0", "μm um 微米 micron microns micrometre micrometres micrometer micrometers"),
    ("length", "1/1000000", "0", "nm 纳米 nanometre nanometres"),
    ("length", "25.4", "0", 'in in. inch inches 英寸 吋 " ″ \'\''),
    ("length", "304.8", "0", "ft ft. foot feet 英尺 呎 ' ′"),
    ("length", "914.4", "0", "yd yard yards"),
    ("concentration", "1", "0", "mg/m3 mg·m-3 mgm-3 mg/m^3 毫克每立方米 毫克/立方米 毫克/m3 mg/立方米"),
    ("concentration", "1/1000", "0", "μg/m3 ug/m3 μg·m-3 ug·m-3 微克每立方米 微克/立方米 微克/m3"),
    ("concentration", "1000", "0", "g/m3 g·m-3 克每立方米 克/立方米 mg/l mg·l-1 毫克每升 毫克/升"),
    ("concentration", "1/1000000", "0", "ng/m3 纳克每立方米 纳克/立方米"),
    ("concentration", "1", "0", "μg/l ug/l 微克每升 微克/升"),
    ("concentration", "1000000", "0", "g/l 克每升 克/升 kg/m3"),
    ("activity", "1", "0", "bq/m3 bq·m-3 贝可/立方米 贝克/立方米 贝可每立方米 贝克每立方米 贝克勒尔每立方米 贝克勒尔/立方米 mbq/l"),
    ("activity", "1000", "0", "bq/l bq·l-1 贝可每升 贝克每升 贝可/升 贝克/升 kbq/m3 千贝可每立方米 千贝可/立方米"),
    ("activity", "37", "0", "pci/l 皮居里每升 皮居里/升"),
    ("pressure", "1", "0", "mpa 兆帕 兆帕斯卡 n/mm2"),
    ("pressure", "1/1000", "0", "kpa 千帕 千帕斯卡"),
    ("pressure", "1/10000", "0", "hpa 百帕 mbar 毫巴"),
    ("pressure", "1/1000000", "0", "pa 帕 帕斯卡"),
    ("pressure", "1/10", "0", "bar bars 巴"),
    ("pressure", "8896443230521/1290320000000000", "0", "psi lbf/in2 磅/平方英寸 磅力/平方英寸 磅每平方英寸"),
    ("pressure", "0.0980665", "0", "kgf/cm2 kg/cm2 公斤力/平方厘米 公斤/平方厘米 千克力/平方厘米 公斤力每平方厘米 工程大气压 at"),
    ("pressure", "0.101325", "0", "atm 标准大气压"),
    ("duration", "1", "0", "h hr hrs hour hours 小时 个小时 钟头 个钟头 时"),
    ("duration", "1/60", "0", "min mins minute minutes 分钟 分"),
    ("duration", "1/3600", "0", "s sec secs second seconds 秒 秒钟"),
    ("duration", "24", "0", "d day days 天 日 昼夜"),
    ("duration", "168", "0", "周 星期 个星期 礼拜 week weeks wk"),
    ("temperature", "1", "0", "°c c 摄氏度 度(摄氏) 摄氏 degc celsius 度c"),
    ("temperature", "5/9", "-32", "°f f 华氏度 度(华氏) 华氏 degf fahrenheit"),
    ("temperature", "1", "-273.15", "k 开尔文 kelvin 开氏度 开"),
    ("ratio", "1", "0", "% 百分比 百分之 百分点 百分数 pct percent percentage"),
    ("ratio", "1/10", "0", "‰ 千分之 千分比 千分数 permille"),
    ("ratio", "100", "0", "小数 比值(0-1) 比值 (0-1) 0-1 decimal fraction"),
    ("area", "1", "0", "m2 平方米 平米 平方公尺 平方 sqm sq.m squaremetre squaremetres squaremeter squaremeters"),
    ("area", "1/100", "0", "dm2 平方分米"),
    ("area", "1/10000", "0", "cm2 平方厘米 平方公分 sqcm"),
    ("area", "1/1000000", "0", "mm2 平方毫米 sqmm"),
    ("area", "0.09290304", "0", "ft2 sqft sq.ft 平方英尺 平方呎 squarefoot squarefeet"),
    ("area", "0.00064516", "0", "in2 sqin 平方英寸"),
]
# Words of a clause that tells how to test, not the limit.
TEST_WORDS = re.compile("复测|抽检|抽查|抽样|检测|每层|每户|每间|试验|测试|静置|等待|之后|天后|小时后|分钟后|保持|养护后|retest|sample|wait|after")
# What stands before a unit, and after it.
_BEFORE = re.compile(r"(?:单位为|单位是|单位|unit|按|以|用|采用|为|in)[:=]?$")
_NUMBER = r"[-+]?\d+(?:,\d{3})+(?:\.\d+)?|[-+]?\d*\.?\d+(?:e[-+]?\d+)?"
_NUMBER_END = re.compile(rf"(?:{_NUMBER})$")
_NUMBER_START = re.compile(rf"(?:{_NUMBER})")
_LIMIT = re.compile(rf"(?:[≤≥<>=]+|不小于|不大于|不低于|不高于|不少于|不多于|不超过|不得超过|取|应为|为|limit|max|min)[:=]?({_NUMBER})|({_NUMBER})(?:以内|以下|以上|之内)")


def plain(text: str | None) -> str:
    """NFKC, lower case, without blanks and invisible characters; minus signs and dots in one form."""
    if not text:
        return ""
    t = unicodedata.normalize("NFKC", text).casefold().translate(_SIGNS)
    return "".join(ch for ch in t if not ch.isspace() and unicodedata.category(ch) != "Cf")


_SIGNS = {ord(a): b for a, b in zip("−–‐⋅∙•⁄∕ºμ", "---···//°μ", strict=True)}


def _automaton() -> tuple[ahocorasick.Automaton, dict[str, list[int]]]:
    by: dict[str, list[int]] = {}
    for n, (_, _, _, names) in enumerate(UNITS):
        for name in names.split():
            by.setdefault(plain(name), []).append(n)
    a = ahocorasick.Automaton()
    for name in by:
        a.add_word(name, name)
    a.make_automaton()
    return a, by


_AUTOMATON, _BY_NAME = _automaton()


def _word(ch: str) -> bool:
    return ch.isalnum() and not ch.isdigit()


def mentions(text: str) -> list[tuple[int, str, float | None]]:
    """Units in a plain text, as (unit, spelling, number beside it or None), where their surroundings show that they are units."""
    out, upto = [], -1
    hits = sorted(((e - len(w) + 1, -len(w), w) for e, w in _AUTOMATON.iter(text)))
    for start, _, w in hits:
        if start <= upto:
            continue
        end = start + len(w)
        before, after = text[:start], text[end:]
        number = None
        if w in ("百分之", "千分之") and (m := _NUMBER_START.match(after)):
            number, ok = m.group(), True
        elif m := _NUMBER_END.search(before):
            number = m.group()
            ok = not (w[-1].isascii() and w[-1].isalpha() and after[:1].isascii() and after[:1].isalpha()) and not after[:1].isdigit()
            ok = ok and not re.search(r"(?<!limit)(?<!max)(?<!min)(?<=[a-z])$", before[: m.start()])
        elif cue := _BEFORE.search(before):
            ok = not after or not _word(after[0]) or after.startswith(("计", "填", "表", "为"))
            ok = ok and not (cue.group() == "in" and w[0].isascii())
        else:
            ok = (not before or not (_word(before[-1]) or before[-1].isdigit())) and (not after or not (_word(after[0]) or after[0].isdigit()))
        if ok:
            upto = end - 1
            out += [(n, w, float(number.replace(",", "")) if number else None) for n in _BY_NAME[w]]
    return out


def _clauses(text: str) -> list[str]:
    return [c for c in re.split(r"[;。!?\n]|,(?!\d{3}(?!\d))", text) if c and not TEST_WORDS.search(c)]


def readings(value: float | None, unit: str | None, label: str | None, note: str | None) -> list[tuple[int, float, bool]]:
    """(unit, number, from the unit field) that a check may state, the best of each quantity."""
    u = plain(unit)
    own = [(n, w) for w in [u] if w in _BY_NAME for n in _BY_NAME[w]] or [(n, w) for n, w, x in mentions(u) if x is None]
    in_note = [m for c in _clauses(plain(note)) for m in mentions(c)]
    lab = plain(label)
    in_label = [m for m in mentions(lab) if m[2] is None]
    found: list[tuple[int, float, bool]] = []
    if value is not None:
        named = [(n, False) for n, _, x in in_note if x is None] + [(n, False) for n, _, x in reversed(in_label)]
        beside = [(n, False) for n, _, x in in_note if x is not None and abs(x - value) <= 1e-9 * max(1, abs(value))]
        found = [(n, value, o) for n, o in [(n, True) for n, _ in own] + named + beside]
    else:
        found = [(n, x, False) for n, _, x in in_note if x is not None]
        found += [(n, x, False) for n, _, x in mentions(lab) if x is not None and re.search(r"[≤≥<>=]|不(?:小|大|低|高|少|多|超)|取|limit", lab)]
        bare = [float((a or b).replace(",", "")) for c in _clauses(plain(note)) for a, b in _LIMIT.findall(c)]
        if bare:
            found += [(n, bare[0], True) for n, _ in own] + [(n, bare[0], False) for n, _, x in in_label]
        elif own and not found and (m := re.fullmatch(rf"({_NUMBER})", plain(note))):
            found += [(n, float(m.group(1)), True) for n, _ in own]
    best: dict[str, tuple[int, float, bool]] = {}
    for n, x, o in found:
        best.setdefault(UNITS[n][0], (n, x, o))
    return list(best.values())


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("quantity", pa.string()), ("unit_no", pa.int32()), ("number", pa.float64())]))
    for b in batches:
        vs, us, ls, ns = (b.column(c).to_pylist() for c in ("value", "unit", "label", "note"))
        each = [readings(*x) for x in zip(vs, us, ls, ns, strict=True)]
        # a check votes by its unit field or, where that is blank, by the only reading of its texts
        named = [next((UNITS[n][0] for n in _BY_NAME.get(plain(u), [])), UNITS[e[0][0]][0] if len(e) == 1 and plain(u) in ("", "-") else None) for u, e in zip(us, each, strict=True)]
        arrays = [b.column(0), b.column(1), b.column(2), b.column(3), b.column(4), pa.array(named, pa.string()), pa.array([[{"quantity": UNITS[n][0], "unit_no": n, "number": x} for n, x, _ in e] for e in each], kind)]
        yield pa.RecordBatch.from_arrays(arrays, names=["id", "check_no", "topic", "value", "unit", "named", "readings"])


def factors(spark: SparkSession, families: DataFrame) -> DataFrame:
    """``unit_no, quantity, common_unit, factor, shift``: common value = number * factor + shift. ``families`` names the common units; its size doesn't grow with data."""

    def to_common(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows:
            out: list[list] = [[], [], [], [], []]
            for q, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                common = next((UNITS[n] for n in _BY_NAME.get(plain(c), []) if UNITS[n][0] == q), None)
                for n, (quantity, f, off, _) in enumerate(UNITS):
                    if common and quantity == q:
                        scale = Fraction(f) / Fraction(common[1])
                        for to, v in zip(out, (n, q, c, float(scale), float(Fraction(off) * scale - Fraction(common[2]))), strict=True):
                            to.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string()), pa.array(out[3], pa.float64()), pa.array(out[4], pa.float64())], names=["unit_no", "quantity", "common_unit", "factor", "shift"])

    return families.select("quantity", "common_unit").where("quantity is not null and common_unit is not null").distinct().coalesce(1).mapInArrow(to_common, "unit_no int, quantity string, common_unit string, factor double, shift double")


def common_limits(rules: DataFrame, families: DataFrame) -> DataFrame:
    """``id, check_no, quantity, common_unit, value_milli, as_common`` of each check that states its number and its unit somewhere.

    ``as_common``: the check has its value, and its unit is already spelled as the common one. Rules without checks, checks
    whose number or unit is lost, and quantities that ``families`` doesn't have, give no row; repeated rows count once. A check
    with readings of several quantities, in a topic of which no quantity has half the units stated, gives no row either.
    ``value_milli`` is rounded half away from zero.
    """
    checks = rules.select("id", "topic", F.posexplode("checks").alias("check_no", "c")).select("id", "check_no", "topic", "c.value", "c.unit", "c.label", "c.note").distinct()
    read = materialise(checks.mapInArrow(_read, "id string, check_no int, topic string, value double, unit string, named string, readings array<struct<quantity:string,unit_no:int,number:double>>"), "readings")
    stated = F.count_if((F.col("unit").isNotNull()) & (F.trim("unit") != "") & (F.col("unit") != "-"))
    votes = read.groupBy("topic", "named").agg(F.count("named").alias("n"), stated.alias("stated"))
    topics = votes.groupBy("topic").agg(F.max_by("named", F.struct("n", "named")).alias("expected"), F.max("n").alias("n"), F.sum("stated").alias("stated"))
    sure = topics.where((F.col("n") > 0) & (F.col("n") * 2 >= F.col("stated"))).select("topic", "expected")
    each = read.select("id", "check_no", "topic", "value", "unit", F.size("readings").alias("several"), F.explode("readings").alias("r")).join(sure, "topic", "left")
    out = each.where(F.when(F.col("expected").isNull(), F.col("several") == 1).otherwise(F.col("r.quantity") == F.col("expected"))).select("id", "check_no", "value", "unit", "r.unit_no", "r.number")
    out = out.join(F.broadcast(factors(rules.sparkSession, families)), "unit_no")
    milli = F.round((F.col("number") * F.col("factor") + F.col("shift")) * 1000).cast("bigint")
    return out.select("id", "check_no", "quantity", "common_unit", milli.alias("value_milli"), (F.col("value").isNotNull() & (F.col("unit").eqNullSafe(F.col("common_unit")))).alias("as_common")).distinct()
