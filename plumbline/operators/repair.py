"""Anchored text patches: positions, uniqueness, replacement in order, clusters, ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


#: Hits up to which places are added up along the pieces of a text; beyond it, its characters are gone through one by one.
FEW = 1000


def find_all(text: Column, needle: Column) -> Column:
    """Places (from 1) of all occurrences, overlapping ones too; none for a null or empty needle."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    pieces = F.split(text, quoted)
    none = F.array().cast("array<int>")
    begins = F.aggregate(pieces, F.struct(F.lit(1).alias("at"), none.alias("all")), lambda x, p: F.struct((x["at"] + F.length(p)).alias("at"), F.array_append(x["all"], x["at"]).alias("all")))["all"]
    few = F.when(F.startswith(text, needle), begins).otherwise(F.slice(begins, 2, F.greatest(F.size(begins) - 1, F.lit(0))))
    # both as lists of characters, split once, so that the work is linear in the text
    split = F.array(F.struct(F.split(text, "").alias("t"), F.split(needle, "").alias("n")))
    at = lambda x: F.filter(F.sequence(F.lit(1), F.greatest(F.size(x["t"]) - F.size(x["n"]) + 1, F.lit(1))), lambda i: F.slice(x["t"], i, F.size(x["n"])) == x["n"])
    ok = text.isNotNull() & (F.length(needle) > 0)
    return F.when(ok & ~F.contains(text, needle), none).when(ok, F.when(F.size(pieces) <= FEW, few).otherwise(F.transform(split, at)[0])).otherwise(none)


def count_of(text: Column, needle: Column) -> Column:
    """Number of occurrences that don't overlap; 0 for a null or empty needle."""
    n = F.length(needle)
    return F.when(text.isNotNull() & (n > 0), ((F.length(text) - F.length(F.replace(text, needle, F.lit("")))) / n).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def check_anchors(texts: DataFrame, ops: DataFrame, id_col: str) -> DataFrame:
    """``id, op_no, hits, valid`` of each op ``id, op_no, old``: valid if its anchor stands in its text exactly once. An op on an unknown id has no hits."""
    j = ops.join(texts.select(id_col, F.col("text").alias("_t")), id_col, "left").withColumn("hits", count_of(F.col("_t"), F.col("old")))
    return j.select(id_col, "op_no", "hits", (F.col("hits") == 1).alias("valid"))


def apply_ops(texts: DataFrame, ops: DataFrame, id_col: str) -> DataFrame:
    """Texts after their ops ``id, op_no, old, new`` in order; texts without ops unchanged. The ops of one text are folded over it."""
    each = ops.where("old is not null and old <> ''").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("op_no", "old", F.coalesce("new", F.lit("")).alias("new")))).alias("_ops"))
    fold = F.aggregate("_ops", F.col("text"), lambda acc, o: F.replace(acc, o["old"], o["new"]))
    return texts.join(each, id_col, "left").withColumn("text", F.when(F.col("_ops").isNull(), F.col("text")).otherwise(fold)).drop("_ops")


def clusters(points: DataFrame, by: str, at: str, gap: int) -> DataFrame:
    """``by, cluster_no, first, last, n``: runs of points in which no two neighbours are more than ``gap`` apart."""
    w = Window.partitionBy(by).orderBy(at)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return points.withColumn("_new", new).withColumn("cluster_no", F.sum("_new").over(w).cast("bigint")).groupBy(by, "cluster_no").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))


def overlapping(spans: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """Spans that begin before one that begins earlier has ended (ends are inside)."""
    w = Window.partitionBy(by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("_upto", F.max(end).over(w)).where(F.col("_upto") >= F.col(start)).drop("_upto")


def merged(spans: DataFrame, by: str, start: str, end: str) -> DataFrame:
    """``by, start, end, n``: overlapping and adjacent spans (ends inside) as one."""
    w = Window.partitionBy(by).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(before.isNull() | (F.col(start) > before + 1), 1).otherwise(0)
    g = spans.withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    return g.groupBy(by, "_g").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_g")


def unique_window(text: Column, at: Column, first: int = 14, step: int = 8, most: int = 90) -> Column:
    """The narrowest window around a place (``first`` characters to each side, then ``step`` more at a time, ``most`` at most) that stands in the text once; null if none does."""
    found = F.lit(None).cast("string")
    for side in reversed(range(first, most + 1, step)):
        start = F.greatest(at - side, F.lit(1))
        cut = F.substring(text, start, at + side - start + 1)
        found = F.when(count_of(text, cut) == 1, cut).otherwise(found)
    return found


def substitutions(pairs: DataFrame, before: str, after: str) -> DataFrame:
    """``old_char, new_char, n`` over pairs of texts of equal length; pairs of unequal length have no row."""
    same = pairs.where(F.length(before) == F.length(after))
    z = same.select(F.explode(F.arrays_zip(F.split(before, "").alias("a"), F.split(after, "").alias("b"))).alias("x"))
    return z.where("x.a <> x.b").groupBy(F.col("x.a").alias("old_char"), F.col("x.b").alias("new_char")).agg(F.count(F.lit(1)).alias("n"))


def apply_at(texts: DataFrame, edits: DataFrame, id_col: str) -> DataFrame:
    """Texts after edits ``id, pos, old, new`` at places (from 1) that don't overlap, from the last to the first; an edit whose ``old`` doesn't stand at its place does nothing."""
    each = edits.where("pos is not null and old is not null").groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct((-F.col("pos")).alias("back"), "old", F.coalesce("new", F.lit("")).alias("new")))).alias("_edits"))
    at = lambda t, e: F.substring(t, (-e["back"]).cast("int"), F.length(e["old"])) == e["old"]
    put = lambda t, e: F.when(at(t, e), F.overlay(t, e["new"], (-e["back"]).cast("int"), F.length(e["old"]))).otherwise(t)
    j = texts.join(each, id_col, "left")
    return j.withColumn("text", F.when(F.col("_edits").isNull(), F.col("text")).otherwise(F.aggregate("_edits", F.col("text"), put))).drop("_edits")


def balance(ledger: DataFrame) -> DataFrame:
    """``char, gained, lost, net`` of a ledger ``old_char, new_char, n``; the net of all characters adds up to nothing."""
    both = ledger.select(F.col("new_char").alias("char"), F.col("n").alias("gained"), F.lit(0).cast("bigint").alias("lost")).unionByName(ledger.select(F.col("old_char").alias("char"), F.lit(0).cast("bigint").alias("gained"), F.col("n").alias("lost")))
    out = both.groupBy("char").agg(F.sum("gained").alias("gained"), F.sum("lost").alias("lost"))
    return out.withColumn("net", F.col("gained") - F.col("lost"))


def census_gate(before: DataFrame, after: DataFrame, expected: dict[str, int]) -> DataFrame:
    """``needle, n_before, n_after, kept``: whether each word occurs as often as before and the expected number more (or, negative, fewer)."""
    def count(df: DataFrame, name: str) -> DataFrame:
        each = F.array(*(F.struct(F.lit(w).alias("needle"), count_of(F.col("text"), F.lit(w)).alias("n")) for w in expected))
        return df.select(F.explode(each).alias("x")).groupBy("x.needle").agg(F.sum("x.n").alias(name))

    more = F.create_map(*(x for w, n in expected.items() for x in (F.lit(w), F.lit(n))))
    return count(before, "n_before").join(count(after, "n_after"), "needle", "full_outer").withColumn("kept", F.coalesce(F.col("n_after") == F.col("n_before") + F.element_at(more, F.col("needle")), F.lit(False)))
