"""Measures of results against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.tokens import every


def close(a: Column, b: Column, share: float) -> Column:
    """Whether ``a`` is within ``share`` of the truth ``b``; of a truth of zero, only zero is. Null if either is."""
    return F.when(b == 0, a == 0).otherwise(F.abs(a - b) <= share * F.abs(b))


def confusion(df: DataFrame, truth: Column, said: Column, *by: str) -> DataFrame:
    """``tp, fp, fn, recall, false_share`` (false ones among those said), by the given columns."""
    n = lambda c: F.count_if(c)
    out = df.groupBy(*by).agg(n(truth & said).alias("tp"), n(~truth & said).alias("fp"), n(truth & ~said).alias("fn"))
    share = lambda a, b: F.when(b > 0, F.round(a / b, 6))
    return out.withColumns({"recall": share(F.col("tp"), F.col("tp") + F.col("fn")), "false_share": share(F.col("fp"), F.col("tp") + F.col("fp"))})


def hit_rates(ranked: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 3)) -> DataFrame:
    """One row: number of queries of ``truth`` (``qid, id``: all acceptable ids) and the share of those with a hit among the first k of ``ranked`` (``qid, id, rank``)."""
    best = truth.join(ranked, ["qid", "id"], "left").groupBy("qid").agg(F.min("rank").alias("best"))
    return best.agg(F.count(F.lit(1)).alias("n_queries"), *(F.round(F.avg(F.coalesce((F.col("best") <= k).cast("double"), F.lit(0.0))), 6).alias(f"top{k}") for k in ks))


def greedy_match(pairs: DataFrame, by: str, left: str, right: str, cost: str) -> DataFrame:
    """One-to-one assignment within each ``by``: pairs in order of ``cost``, then ids, each kept if both ends are free.

    A pair that is first for both of its ends is certain, so rounds of such pairs give the same as going through the sorted list;
    there are no Python groups, and a large group is spread over tasks. The rounds end when none is left.
    """
    from plumbline.session import materialise

    rest, done = materialise(pairs.select(by, left, right, cost).distinct(), "pairs"), []
    while not rest.isEmpty():
        rank = F.struct(cost, left, right)
        for_left = rest.groupBy(by, left).agg(F.min(rank).alias("bl"))
        for_right = rest.groupBy(by, right).agg(F.min(rank).alias("br"))
        won = rest.join(for_left, [by, left]).join(for_right, [by, right]).where((rank == F.col("bl")) & (rank == F.col("br"))).select(by, left, right, cost)
        won = materialise(won, "won")
        done.append(won)
        rest = materialise(rest.join(won.select(by, left), [by, left], "left_anti").join(won.select(by, right), [by, right], "left_anti"), "rest")
    out = done[0] if done else rest
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def resolve_ids(wanted: DataFrame, known: DataFrame, col: str = "sample") -> DataFrame:
    """``wanted`` with ``resolved``: the id itself if known, else its base before ``#rN``, else the id with ``#r1``, else null."""
    w = wanted.withColumn("_base", F.regexp_replace(col, "#r[0-9]+$", "")).withColumn("_first", F.concat(col, F.lit("#r1")))
    for n, c in enumerate((col, "_base", "_first")):
        w = w.join(known.select(F.col("id").alias(c), F.col("id").alias(f"_k{n}")).distinct(), c, "left")
    return w.withColumn("resolved", F.coalesce("_k0", "_k1", "_k2")).drop("_base", "_first", "_k0", "_k1", "_k2")


def either_contains(left: DataFrame, right: DataFrame, by: str, a: str, b: str) -> DataFrame:
    """``left`` joined with ``right`` of the same ``by`` where ``a`` is part of ``b`` or ``b`` part of ``a``; an empty text is part of all. Nulls match nothing.

    The substrings of the longer text that have the length of some shorter one are equi-joined with it, so no nested loop is
    needed; ``left`` and ``right`` share no column but ``by``.
    """
    l, r = (x.select(F.col(by).alias("_by"), F.col(c).alias("_t")).where("_by is not null and _t is not null").distinct() for x, c in ((left, a), (right, b)))

    def held(small: DataFrame, large: DataFrame) -> DataFrame:
        lengths = small.select(F.length("_t").alias("_n")).distinct()  # as many rows as there are lengths
        parts = large.join(F.broadcast(lengths)).where(F.length("_t") >= F.col("_n")).select("_by", F.col("_t").alias("_whole"), F.explode(F.when(F.col("_n") == 0, F.array(F.lit(""))).otherwise(F.array_distinct(every(F.col("_t"), F.col("_n"))))).alias("_t"))
        return parts.join(small, ["_by", "_t"]).select("_by", "_t", "_whole")

    met = held(l, r).select("_by", F.col("_t").alias("_a"), F.col("_whole").alias("_b")).unionByName(held(r, l).select("_by", F.col("_whole").alias("_a"), F.col("_t").alias("_b"))).distinct()
    x = left.join(met, (F.col(by) == F.col("_by")) & (F.col(a) == F.col("_a"))).drop("_by", "_a")
    return x.join(right.withColumnRenamed(by, "_by"), (F.col(by) == F.col("_by")) & (F.col(b) == F.col("_b"))).drop("_by", "_b")


def prefix_join(df: DataFrame, col: str, known: DataFrame, key: str, sign: str = "_") -> DataFrame:
    """``df`` joined with ``known`` where ``col`` is the ``key`` or begins with it and ``sign``. The beginnings of ``col`` before each sign are equi-joined."""
    parts = F.split(F.col(col), sign)
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sign))
    return df.where(F.col(col).isNotNull()).withColumn("_begin", F.explode(begins)).join(known, F.col("_begin") == F.col(key)).drop("_begin")


def from_range(value: Column, lo: Column, hi: Column) -> tuple[Column, Column]:
    """How far, in per cent of the nearest edge, a value lies outside of a range, and on which side: ``low``, ``high`` or null. Null if a bound is; an edge of zero gives no share."""
    share = lambda x, edge: F.when(edge != 0, x / edge * 100)
    return F.when(value < lo, share(lo - value, lo)).when(value > hi, share(value - hi, hi)).when(value.isNotNull() & lo.isNotNull() & hi.isNotNull(), F.lit(0.0)), F.when(value < lo, "low").when(value > hi, "high")


def in_window(value: Column, windows: list[tuple[str, float, float]], default: str) -> Column:
    """The first of some windows (name, from, before) that a value lies in, else ``default``; null for null."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for name, lo, hi in windows:
        out = out.when((value >= lo) & (value < hi), name)
    return out.otherwise(default)


def accuracy(df: DataFrame, fields: dict[str, tuple[Column, Column, str]], share: float = 0.05) -> DataFrame:
    """``field, n, n_right, accuracy`` of each field (said, truth, ``number`` or ``code``), in one pass: numbers within ``share``, codes alike.

    Blank truths don't count; what was said to a given truth and is null or no number is wrong.
    """
    def right(said: Column, truth: Column, kind: str) -> tuple[Column, Column]:
        given = F.coalesce(F.trim(truth.cast("string")), F.lit("")) != ""
        if kind == "number":
            return given, F.coalesce(close(said.try_cast("double"), truth.try_cast("double"), share), F.lit(False))
        return given, F.coalesce(F.trim(said) == F.trim(truth), F.lit(False))

    each = F.array(*(F.struct(F.lit(k).alias("field"), right(*x)[0].alias("given"), right(*x)[1].alias("right")) for k, x in fields.items()))
    some = df.select(F.explode(each).alias("x")).where("x.given").groupBy("x.field")
    return some.agg(F.count(F.lit(1)).alias("n"), F.count_if("x.right").alias("n_right")).withColumn("accuracy", F.round(F.col("n_right") / F.col("n"), 6))


def recall_by_provider(truth: DataFrame, items: DataFrame) -> DataFrame:
    """``provider, sample, matched, n_truth``: entries of the truth (``sample, entry``) of which a name of the provider's items (``provider, sample, name``) is part, or the other way round.

    An item's sample belongs to a truth's that it is or begins with (before ``_``). Blank entries are never matched, blank names match
    nothing; entries given twice count twice. A provider's sample without any truth, and a truth without items of the provider, have no row.
    """
    t = truth.select(F.col("sample").alias("truth_sample"), "entry").where("truth_sample is not null").groupBy("truth_sample", "entry").agg(F.count(F.lit(1)).alias("times"))
    cells = prefix_join(items.select("provider", "sample").distinct(), "sample", t.select("truth_sample").distinct(), "truth_sample")
    asked = cells.join(t, "truth_sample").withColumn("cell", F.struct("provider", "sample"))
    names = items.where("trim(name) <> ''").select(F.struct("provider", "sample").alias("cell"), "name").distinct()
    entries = asked.where("trim(entry) <> ''").select("cell", "truth_sample", "entry", "times")
    hit = either_contains(entries, names, "cell", "entry", "name").select("cell", "truth_sample", "entry", "times").distinct()
    n = asked.groupBy("provider", "sample").agg(F.sum("times").alias("n_truth"))
    m = hit.groupBy("cell").agg(F.sum("times").alias("matched")).select("cell.provider", "cell.sample", "matched")
    return n.join(m, ["provider", "sample"], "left").select("provider", "sample", F.coalesce("matched", F.lit(0)).cast("bigint").alias("matched"), "n_truth")


def micro_recall(cells: DataFrame) -> DataFrame:
    """``provider, matched, n_truth, recall, best`` over all samples of each provider; ``best``: the highest recall of all."""
    out = cells.groupBy("provider").agg(F.sum("matched").alias("matched"), F.sum("n_truth").alias("n_truth")).withColumn("recall", F.round(F.col("matched") / F.col("n_truth"), 4))
    return out.join(F.broadcast(out.agg(F.max("recall").alias("best"))))  # one row


def provider_averages(rows: DataFrame, providers: DataFrame, ok: Column, values: list[str], digits: int = 1) -> DataFrame:
    """``provider, n_ok`` and the mean of each value over the rows that are ``ok``; providers without such rows have none (null)."""
    got = rows.where(F.coalesce(ok, F.lit(False))).groupBy("provider").agg(F.count(F.lit(1)).alias("n_ok"), *(F.round(F.avg(v), digits).alias(f"avg_{v}") for v in values))
    return providers.select("provider").distinct().join(got, "provider", "left").withColumn("n_ok", F.coalesce("n_ok", F.lit(0)))


def quote_measures(truth: DataFrame, items: DataFrame, missing: DataFrame) -> DataFrame:
    """One row: ``n_truth, recalled, n_price, price_right, pits, pits_hit, false_alarms``.

    ``truth``: ``sample, row_no, entry, price, is_pit, pit_type``; ``items``: ``sample, item_no, item, unit_price, status``; ``missing``: ``sample,
    name``. An entry is recalled if an item's name is part of it or it of the name. Its price is compared (within a hundredth)
    with that of the item assigned to it one to one, nearest price first, else with its first item's. A pit is hit if its first
    item warns, or, where something is missing, if the missing list names it. A warning in whose item no pit's entry occurs is a
    false alarm. A blank price isn't compared; an unreadable one said is as far as can be.
    """
    t = truth.select("sample", "row_no", F.trim("entry").alias("entry"), F.nullif(F.trim("price"), F.lit("")).alias("price"), F.coalesce(F.trim("is_pit") == "1", F.lit(False)).alias("pit"), F.coalesce("pit_type", F.lit("")).alias("pit_type"))
    i = items.select("sample", "item_no", F.coalesce("item", F.lit("")).alias("item"), F.col("unit_price").try_cast("double").alias("said"), F.coalesce(F.startswith("status", F.lit("warning")), F.lit(False)).alias("warns"))
    pairs = either_contains(t, i, "sample", "entry", "item")
    real = F.col("price").try_cast("double")
    far = F.when(F.col("price").isNull(), 100.0).otherwise(F.coalesce(F.abs(F.col("said") - real) / F.greatest(F.abs(real), F.lit(1e-9)), F.lit(9.9)))
    given = greedy_match(pairs.withColumn("far", far), "sample", "row_no", "item_no", "far").select("sample", "row_no", "item_no")
    first = pairs.groupBy("sample", "row_no").agg(F.min_by(F.struct("said", "warns"), "item_no").alias("first"))
    mine = given.join(i.select("sample", "item_no", F.struct("said").alias("mine")), ["sample", "item_no"]).drop("item_no")
    named = either_contains(t.where("pit and pit_type = 'missing'"), missing.select("sample", "name").distinct(), "sample", "entry", "name").select("sample", "row_no").distinct().withColumn("listed", F.lit(True))
    each = t.join(first, ["sample", "row_no"], "left").join(mine, ["sample", "row_no"], "left").join(named, ["sample", "row_no"], "left")
    said = F.when(F.col("mine").isNotNull(), F.col("mine.said")).otherwise(F.col("first.said"))
    found, priced = F.col("first").isNotNull(), F.col("first").isNotNull() & F.col("price").isNotNull()
    hit = F.col("pit") & (F.coalesce(F.col("first.warns"), F.lit(False)) | F.coalesce("listed", F.lit(False)))
    right = priced & F.coalesce(close(said, real, 0.01), F.lit(False))
    out = each.agg(F.count(F.lit(1)).alias("n_truth"), F.count_if(found).alias("recalled"), F.count_if(priced).alias("n_price"), F.count_if(right).alias("price_right"), F.count_if("pit").alias("pits"), F.count_if(hit).alias("pits_hit"))
    warned = i.where("warns").select("sample", "item_no", "item")
    meant = either_contains(t.where("pit").select("sample", "entry").distinct(), warned, "sample", "entry", "item").where(F.contains("item", F.col("entry"))).select("sample", "item_no").distinct()
    false = warned.join(meant, ["sample", "item_no"], "left_anti").agg(F.count(F.lit(1)).alias("false_alarms"))
    return out.join(F.broadcast(false))  # one row each
