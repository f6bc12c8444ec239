"""Splitting, validation, merging, numbering and near-duplicate detection of records."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.functions.tokens import every
from plumbline.session import materialise


def split_segments(df: DataFrame, id_col: str, text_col: str, separator: str = r"(?m)^[ \t]*---[ \t]*$", least: int = 20) -> DataFrame:
    """``id, seg_no, segment, skipped``: the parts between separators, trimmed; empty ones are dropped, those shorter than ``least`` marked as skipped. A null text has no part."""
    parts = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), separator)).alias("seg_no", "raw"))
    cut = F.regexp_replace("raw", r"^\s+|\s+$", "")
    return parts.select("id", "seg_no", cut.alias("segment")).where("segment <> ''").withColumn("skipped", F.length("segment") < least)


def errors(*conditions: tuple[Column, str]) -> Column:
    """List of the names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(name)) for c, name in conditions)))


def blank(c: Column) -> Column:
    """Null, empty or white space."""
    return F.coalesce(F.trim(c), F.lit("")) == ""


def coerce(c: Column, codes: list[str]) -> Column:
    """The code itself, else the longest code that the value begins with, else null."""
    longest = sorted(codes, key=lambda k: (-len(k), k))
    return F.coalesce(*(F.when(c == k, F.lit(k)) for k in longest), *(F.when(F.startswith(c, F.lit(k)), F.lit(k)) for k in longest))


def upsert(base: DataFrame, new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """Both tables merged by key, the new rows winning; null and blank keys are dropped. Within a table the row that comes last by ``order`` counts."""
    both = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1))).where(~blank(F.col(key)))
    w = Window.partitionBy(key).orderBy(F.desc("_new"), *([order.desc()] if order is not None else []))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def append_new(base: DataFrame, new: DataFrame, key: str, order: Column) -> DataFrame:
    """The rows of ``new`` whose key ``base`` doesn't hold; of several with a key the first by ``order``."""
    fresh = new.join(base.select(key).distinct(), key, "left_anti").where(F.col(key).isNotNull())
    return fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where("_n = 1").drop("_n")


def numbered(candidates: DataFrame, existing: DataFrame, key: str, order: Column, prefix: str = "GZ-SY-", width: int = 5) -> DataFrame:
    """``candidates`` with the next free ids in ``order``; ids of another form are left out of account.

    Numbers are given without gathering rows in one task: rows are sorted by range, counted by partition, and each partition
    starts where those before it end.
    """
    top = existing.agg(F.coalesce(F.max(F.expr(f"try_cast(nullif(regexp_extract({key}, '^{prefix}([0-9]+)$', 1), '') as bigint)")), F.lit(0)).alias("top"))
    # written, since two branches read the places, which must not be given twice
    placed = materialise(candidates.withColumn("_o", order).orderBy("_o").withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()), "placed")
    w = Window.partitionBy("_p").orderBy("_k")
    within = placed.withColumn("_n", F.row_number().over(w))
    sizes = within.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    starts = sizes.withColumn("_s", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_p", "_s")  # one row a partition
    n = within.join(F.broadcast(starts), "_p").join(F.broadcast(top)).withColumn("_no", F.col("top") + F.col("_s") + F.col("_n"))
    return n.withColumn("new_id", F.concat(F.lit(prefix), F.lpad(F.col("_no").cast("string"), width, "0"))).drop("_p", "_k", "_n", "_s", "_no", "_o", "top")


def ratio(a: str, b: str) -> float:
    """Ratcliff and Obershelp's similarity; 0 if either is empty."""
    return difflib.SequenceMatcher(None, a, b).ratio() if a and b else 0.0


def _bounded_ratio(a: str, b: str, least: float) -> float:
    """The ratio, or 0 where an upper bound (lengths, then common characters) is below ``least`` already."""
    if not a or not b or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return 0.0
    if 2 * sum((Counter(a) & Counter(b)).values()) < least * (len(a) + len(b)):
        return 0.0
    return ratio(a, b)


def _counts(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """``(text, column)`` of each character; the k-th occurrence of a character is an item of its own, so that sets of items count repeats.

    The ``width`` most frequent items have a column each, the others share as many; items of a single text have none. So the
    product of two texts' rows is the number of common characters with repeats, or more.
    """
    c = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    order = np.lexsort((c, doc))
    c, doc = c[order], doc[order]
    first = np.flatnonzero(np.r_[True, (c[1:] != c[:-1]) | (doc[1:] != doc[:-1])])
    nth = np.arange(len(c)) - np.repeat(first, np.diff(np.r_[first, len(c)]))
    _, item, df = np.unique(c << 32 | nth, return_inverse=True, return_counts=True)
    rank = np.empty(len(df), np.int64)
    rank[np.argsort(-df, kind="stable")] = np.arange(len(df))
    column = np.where(rank < width, rank, width + rank % width)
    several = df[item] > 1
    return doc[several], column[item[several]]


def _near(texts: list[str], left: np.ndarray, right: np.ndarray, least: float, width: int = 2048, rows: int = 1024) -> list[tuple[int, int]]:
    """Pairs of a place in ``left`` and one in ``right`` whose lengths and common characters allow a ratio of ``least``; of places in both, each pair once."""
    doc, column = _counts(texts, width)
    used = int(column.max()) + 1 if len(column) else 1
    starts = np.searchsorted(doc, np.arange(len(texts) + 1))
    n = np.array([len(t) for t in texts])

    def chunks(side: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        side = side[np.argsort(n[side], kind="stable")]
        out = []
        for part in np.split(side, range(rows, len(side), rows)):
            at = np.concatenate([column[starts[i] : starts[i + 1]] + k * used for k, i in enumerate(part)])
            out.append((part, np.bincount(at, minlength=len(part) * used).astype(np.float32).reshape(len(part), used)))
        return out

    same = left is right
    a = chunks(left)
    b = a if same else chunks(right)
    out = []
    for x, (i, u) in enumerate(a):
        for y, (j, v) in enumerate(b):
            low, high = sorted(((n[i[0]], n[i[-1]]), (n[j[0]], n[j[-1]])))
            if same and y < x or 2 * low[1] < least * (low[1] + high[0]) - 1e-9 and low[1] < high[0]:
                continue
            total = n[i][:, None] + n[j][None, :]
            r, c = np.nonzero((2 * np.minimum(u @ v.T, np.minimum(n[i][:, None], n[j][None, :])) >= least * total - 1e-9))
            out += [(p, q) for p, q in zip(i[r].tolist(), j[c].tolist(), strict=True) if not same or y > x or p < q]
    return out


def similar_texts(texts: DataFrame, least: float, block: int = 8192) -> DataFrame:
    """``k_a, k_b`` of different texts ``k, x`` (neither null nor empty, ``k`` unique) that may have a ratio of ``least``: all that have, and few others.

    At a threshold of 0.7 nearly half of a text's characters would have to be posted, and an inverted join of them meets
    each pair several times. So all pairs are counted instead, block by block, as matrix products over characters.
    """
    n = texts.agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.lit(1)).cast("int").alias("n"))
    placed = texts.join(F.broadcast(n)).withColumn("block", F.pmod(F.xxhash64("k"), F.col("n")).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    met = met.select("k", "x", "block", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"))

    def run(t: pa.Table) -> pa.Table:
        b, lo, hi = (t.column(c).to_numpy() for c in ("block", "lo", "hi"))
        left = np.flatnonzero(b == lo)
        right = left if lo[0] == hi[0] else np.flatnonzero(b == hi)
        found = _near(t.column("x").to_pylist(), left, right, least) if len(left) and len(right) else []
        k = t.column("k")
        return pa.table({f"k_{s}": k.take(pa.array([f[m] for f in found], pa.int64())) for m, s in enumerate("ab")})

    kind = texts.schema["k"].dataType.simpleString()
    return met.groupBy("lo", "hi").applyInArrow(run, f"k_a {kind}, k_b {kind}")


def similar_titles(df: DataFrame, id_col: str, title: str, text: str, title_least: float = 0.8, text_least: float = 0.7, later_first: bool = False) -> DataFrame:
    """``id_a, id_b, title_ratio, text_ratio`` of all pairs of records (by id, a < b) with a similar title or a similar text.

    Titles and texts, equal ones once, are each paired by ``similar_texts`` and bring all their records. The ratio depends on the
    order of the two; ``later_first`` takes that of b before a.
    """
    r = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(title), F.lit("")).alias("t"), F.coalesce(F.col(text), F.lit("")).alias("x")).distinct()

    def arm(c: str, least: float) -> DataFrame:
        each = r.where(F.col(c) != "").groupBy(F.col(c).alias("x")).agg(F.min("id").alias("first"), F.countDistinct("id").alias("m")).withColumn("k", F.xxhash64("x", F.length("x"), "first"))
        holders = r.join(each.select(F.col("x").alias(c), "k"), c).select("k", "id").distinct()
        near = similar_texts(each.select("k", "x"), least).unionByName(each.where("m > 1").select(F.col("k").alias("k_a"), F.col("k").alias("k_b")))
        sides = [holders.select(F.col("k").alias(f"k_{s}"), F.col("id").alias(s)) for s in "ij"]
        near = near.join(sides[0].withColumnRenamed("k_i", "k_a"), "k_a").join(sides[1].withColumnRenamed("k_j", "k_b"), "k_b").where("i <> j")
        return near.select(F.least("i", "j").alias("id_a"), F.greatest("i", "j").alias("id_b"))

    pairs = arm("t", title_least).unionByName(arm("x", text_least)).distinct()
    sides = [r.select(F.col("id").alias(f"id_{s}"), F.col("t").alias(f"t{s}"), F.col("x").alias(f"x{s}")) for s in "ab"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p in batches:
            ta, tb, xa, xb = (p.column(c).to_pylist() for c in (("tb", "ta", "xb", "xa") if later_first else ("ta", "tb", "xa", "xb")))
            t = [_bounded_ratio(x, y, title_least) for x, y in zip(ta, tb, strict=True)]
            x = [_bounded_ratio(u, v, text_least) for u, v in zip(xa, xb, strict=True)]
            keep = pa.array([u >= title_least or v >= text_least for u, v in zip(t, x, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([p.column("id_a"), p.column("id_b"), pa.array([round(v, 3) for v in t]), pa.array([round(v, 3) for v in x])], names=["id_a", "id_b", "title_ratio", "text_ratio"]).filter(keep)

    kind = df.schema[id_col].dataType.simpleString()
    return pairs.join(sides[0], "id_a").join(sides[1], "id_b").mapInArrow(run, f"id_a {kind}, id_b {kind}, title_ratio double, text_ratio double")


def first_similar(existing: DataFrame, batch: DataFrame, id_col: str, title: str, text: str, order: str, title_least: float = 0.8, text_least: float = 0.7) -> DataFrame:
    """``id, similar_to, ratio``: for each record of a batch the most similar one among those that exist and those before it in the batch; none for records without any.

    ``order``: place in the batch, from 0; ids are unique over both tables. The ratio is the greater of both fields'; of equal ones
    the earlier record counts, existing ones (by id) first.
    """
    old = existing.select(F.col(id_col).alias("id"), title, text, F.lit(-1).cast("bigint").alias("_o"))
    new = batch.select(F.col(id_col).alias("id"), title, text, F.col(order).cast("bigint").alias("_o"))
    place = F.struct("_o", F.col("id").cast("string").alias("id"))
    both = old.unionByName(new).withColumn("_place", place)
    pairs = similar_titles(both.select("_place", title, text), "_place", title, text, title_least, text_least, later_first=True)
    found = materialise(pairs.where(F.col("id_b")["_o"] >= 0).withColumn("ratio", F.greatest("title_ratio", "text_ratio")), "similar")
    best = found.groupBy("id_b").agg(F.max("ratio").alias("ratio"))
    first = found.join(best, ["id_b", "ratio"]).groupBy("id_b", "ratio").agg(F.min("id_a").alias("id_a"))
    return first.select(F.col("id_b")["id"].alias("id"), F.col("id_a")["id"].alias("similar_to"), "ratio")


# What after a number makes it a condition, not a limit.
CONDITIONAL = ["时", "以下", "以上", "之间", "面积", "1/3", "允许", "靠尺", "套尺", "处"]


def numbers(df: DataFrame, id_col: str, text: str, units: dict[str, list[str]]) -> DataFrame:
    """``id, unit_name, number, followed`` of each number before a spelling of a unit, with the four characters that follow."""

    def of(unit: str, spellings: list[str]) -> Column:
        pattern = F.lit(r"([0-9]+(?:\.[0-9]+)?)[\s\p{Z}]*(?:" + "|".join(re.escape(x) for x in sorted(spellings, key=lambda x: (-len(x), x))) + r")(?=([\s\S]{0,4}))")
        both = F.arrays_zip(F.regexp_extract_all(F.col(text), pattern, 1).alias("v"), F.regexp_extract_all(F.col(text), pattern, 2).alias("f"))
        return F.transform(both, lambda x: F.struct(F.lit(unit).alias("unit_name"), x["v"].cast("double").alias("number"), x["f"].alias("followed")))

    found = F.concat(*(of(u, x) for u, x in units.items()))
    return df.where(F.col(text).isNotNull()).select(F.col(id_col).alias("id"), F.explode(found).alias("x")).select("id", "x.*")


def checked_rules(df: DataFrame, id_col: str, text: str, rules: DataFrame, units: dict[str, list[str]], near: float = 0.005, salts: int = 8) -> DataFrame:
    """``id, rule_id, check_no, status, unit_name, number``: the rules that a text's numbers meet, and numbers that contradict them.

    ``rules``: ``id, keywords, checks`` (``value``, ``unit``, ``operator``). A rule is looked at if the text holds one of its
    keywords; one without checks passes. Numbers before a conditional hint don't count. A check passes (``paired``) if a number
    in its unit is within ``near`` of its value, else (``stricter``) if all numbers in its unit are strictly on the safe side.
    A rule with a paired check and without a stricter one warns (``unpaired``) of each number in a unit of its checks that
    is near no value of its own checks and, in its unit, of no check of any rule. ``salts``: parts that the texts of a keyword are put in.
    """
    spelled = F.create_map(*(F.lit(x) for u, ss in units.items() for s in dict.fromkeys([u, *ss]) for x in (s, u)))
    r = rules.select(F.col("id").alias("rule_id"), F.coalesce("keywords", F.array().cast("array<string>")).alias("keywords"), "checks").distinct()
    checks = r.select("rule_id", F.posexplode("checks").alias("check_no", "c")).select("rule_id", "check_no", F.element_at(spelled, F.coalesce("c.unit", F.lit(""))).alias("unit_name"), F.col("c.value").alias("target"), F.col("c.operator").alias("op"))
    checks = checks.where("unit_name is not null and target is not null").distinct()
    told = materialise(numbers(df, id_col, text, units).where(~F.col("followed").rlike("|".join(map(re.escape, CONDITIONAL)))).select("id", "unit_name", "number").distinct(), "told")

    # a text's substrings are equi-joined with the keywords, so no nested loop is needed
    words = r.select("rule_id", F.explode("keywords").alias("word")).where("word <> ''").distinct()
    lengths = words.select(F.length("word").alias("n")).distinct()  # as many rows as there are lengths
    t = df.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(lengths)).where(F.length("text") >= F.col("n"))
    parts = t.select("id", F.explode(F.array_distinct(every(F.col("text"), F.col("n")))).alias("word"))
    named = materialise(parts.join(words.select("word").distinct(), "word", "left_semi").distinct().groupBy("id").agg(F.collect_list("word").alias("words")), "named")
    each = named.select("id", "words", F.explode("words").alias("word"), F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"))
    salted = lambda some: some.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    all_ = words.groupBy("rule_id").agg(F.collect_list("word").alias("keywords"))
    # text and rule meet under each common keyword and count under the least, so that their pairs needn't be shuffled to be made distinct
    once = F.col("word") == F.array_min(F.array_intersect("words", "keywords"))
    none = lambda kind: F.lit(None).cast(kind)

    bare = words.join(r.where(F.coalesce(F.size("checks"), F.lit(0)) <= 0).select("rule_id").distinct(), "rule_id", "left_semi").join(all_, "rule_id")
    passed = each.join(salted(bare), ["word", "salt"]).where(once).select("id", "rule_id", none("int").alias("check_no"), F.lit("no checks").alias("status"), none("string").alias("unit_name"), none("double").alias("number"))
    same = materialise(told.groupBy("id", "unit_name").agg(F.collect_list("number").alias("numbers"), F.min("number").alias("lo"), F.max("number").alias("hi")), "same")
    # of the numbers on the safe side, the nearest to the value is the least or the greatest
    stricter = F.col("op").isin(">=", ">") & (F.col("lo") > F.col("target")) & (F.col("lo") - F.col("target") > near) | F.col("op").isin("<=", "<") & (F.col("hi") < F.col("target")) & (F.col("target") - F.col("hi") > near)
    asked = words.join(all_, "rule_id").join(checks.where("op in ('>=', '>', '<=', '<')"), "rule_id")
    bounds = each.join(same.select("id", "unit_name", "lo", "hi"), "id")
    strict = bounds.join(salted(asked), ["word", "salt", "unit_name"]).where(stricter).where(once).select("id", "rule_id", "check_no", F.lit("stricter").alias("status"), "unit_name", F.col("target").alias("number"))

    # paired checks are few: they are found by the numbers' cells, and only their rules are looked through for stricter ones
    cell = lambda c: F.floor(F.col(c) / (2 * near)).cast("bigint")
    near_by = F.explode(F.array(*(cell("target") + k for k in (-1, 0, 1))))
    close = words.join(checks, "rule_id").withColumn("cell", near_by)
    numbered = named.select("id", F.explode("words").alias("word")).join(same.select("id", "unit_name", F.explode("numbers").alias("number")), "id").withColumn("cell", cell("number"))
    met = numbered.join(close, ["word", "unit_name", "cell"]).where(F.abs(F.col("number") - F.col("target")) <= near)
    pairs = materialise(met.select("id", "rule_id", "check_no", "unit_name", "target", "op").distinct(), "paired")
    held = strict.unionByName(pairs.select("id", "rule_id", "check_no", F.lit("paired").alias("status"), "unit_name", F.col("target").alias("number")))
    has = pairs.select("id", "rule_id").distinct()
    active = has.join(has.join(checks, "rule_id").join(same, ["id", "unit_name"]).where(stricter).select("id", "rule_id").distinct(), ["id", "rule_id"], "left_anti")
    scope = checks.groupBy("rule_id").agg(F.collect_set("target").alias("targets"), F.collect_set("unit_name").alias("names"))
    stated = checks.select("unit_name", "target").distinct().withColumn("cell", near_by)
    seen = told.select("unit_name", "number").distinct().withColumn("cell", cell("number"))
    globally = seen.join(stated, ["unit_name", "cell"]).where(F.abs(F.col("number") - F.col("target")) <= near).select("unit_name", "number").distinct()
    open_ = told.join(globally, ["unit_name", "number"], "left_anti")
    warned = active.join(scope, "rule_id").join(open_, "id").where(F.array_contains("names", F.col("unit_name")) & ~F.exists("targets", lambda v: F.abs(v - F.col("number")) <= near))
    return passed.unionByName(held).unionByName(warned.select("id", "rule_id", none("int").alias("check_no"), F.lit("unpaired").alias("status"), "unit_name", "number"))
