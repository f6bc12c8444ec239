"""Checks of records before they enter a library: schemas by type, truth tables, batches, proofs of coverage, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from plumbline.operators.curation import blank, errors, numbers

# Types of knowledge, and the one that stands where none is given.
TYPES, DEFAULT_TYPE = ("gotcha", "standard", "process", "material", "design"), "gotcha"
# Words that make a rule too broad, in the order in which they are reported.
BROAD = ("注意", "小心", "安全", "应该", "必须", "重要", "关键", "一定", "千万", "务必")
_EDGES = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def schema_errors(df: DataFrame, id_col: str, title: str, type_col: str, required: dict[str, list[str]]) -> Column:
    """List of errors of a record by its type: no id, unknown type, no title, and for each type in ``required`` its fields that are null or empty. A null or empty type is the default one."""
    kind = F.coalesce(F.nullif(F.col(type_col), F.lit("")), F.lit(DEFAULT_TYPE))
    missing = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    each = [(missing(id_col), "missing:id"), (~kind.isin(*TYPES), "type"), (missing(title), "missing:title")]
    each += [((kind == t) & missing(c), f"{t}:{c}") for t, cols in required.items() for c in cols]
    return errors(*each)


def enum_errors(c: Column, name: str, codes: list[str]) -> Column:
    """``enum:<name>=<item>`` of each item of a list that isn't one of the codes; a null list has none, a null item counts as empty text."""
    return F.transform(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: ~F.coalesce(x, F.lit("")).isin(codes)), lambda x: F.concat(F.lit(f"enum:{name}="), F.coalesce(x, F.lit(""))))


def as_lists(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` with each named column as a list of strings: a text becomes a list of one, null and empty text an empty list; lists stay."""
    def one(c: str) -> Column:
        none = F.array().cast("array<string>")
        if isinstance(df.schema[c].dataType, ArrayType):
            return F.coalesce(F.col(f"`{c}`"), none)
        return F.when(F.coalesce(F.col(f"`{c}`").cast(StringType()), F.lit("")) == "", none).otherwise(F.array(F.col(f"`{c}`").cast(StringType())))

    return df.withColumns({c: one(c) for c in cols})


def enriched(df: DataFrame, today: str, source_file: str = "pipeline") -> DataFrame:
    """Accepted candidates with what a new record starts with: universal scope and no related records where none are given, and metadata of an unverified draft."""
    scope = F.coalesce("scope", F.lit("universal")) if "scope" in df.columns else F.lit("universal")
    related = F.coalesce("related_ku_ids", F.array().cast("array<string>")) if "related_ku_ids" in df.columns else F.array().cast("array<string>")
    meta = F.struct(
        F.lit(today).alias("created_at"), F.lit(today).alias("updated_at"), F.lit("ai").alias("created_by"), F.lit(False).alias("verified"), F.lit("not_verified").alias("verify_method"), F.lit("1.0").alias("version"),
        F.lit(source_file).alias("source_file"), F.lit("DRAFT").alias("quality_level"), F.lit(None).cast("string").alias("expires_at"), F.lit(None).cast("string").alias("last_reviewed_at"),
    )
    return df.withColumns({"scope": scope, "related_ku_ids": related, "metadata": meta})


def to_retry(df: DataFrame, segment: str, error_list: str) -> DataFrame:
    """``segment, n_candidates, n_too_long, retry``: a segment is taken again, once, if any of its candidates is too long."""
    long = F.exists(error_list, lambda x: F.startswith(x, F.lit("too_long")))
    return df.groupBy(segment).agg(F.count(F.lit(1)).alias("n_candidates"), F.count_if(long).alias("n_too_long"), F.bool_or(F.coalesce(long, F.lit(False))).alias("retry"))


def too_broad(question: Column, title: Column, least: int = 8) -> Column:
    """Why a rule's question, or its title where there is no question, is too broad: ``empty``, ``short:<length>``, ``broad:<first word>``; null if it isn't."""
    q = F.coalesce(F.nullif(question, F.lit("")), title, F.lit(""))
    n = F.length(F.regexp_replace(q, _EDGES, ""))
    out = F.when(q == "", "empty").when(n < least, F.concat(F.lit("short:"), n.cast("string")))
    for w in BROAD:
        out = out.when(F.contains(q, F.lit(w)), f"broad:{w}")
    return out


def obsolete(text: Column, standard: str, clauses: list[str], successor: str) -> Column:
    """The cited ``clauses`` (no digit before or after) of a text that names ``standard`` but not its ``successor``, joined by commas; null if there are none."""
    cited = F.array_compact(F.array(*(F.when(text.rlike(r"(?<![0-9])" + c.replace(".", r"\.") + r"(?![0-9])"), c) for c in clauses)))
    return F.when(F.contains(text, F.lit(standard)) & ~F.contains(text, F.lit(successor)) & (F.size(cited) > 0), F.array_join(cited, ","))


def self_verified(kind: Column, quality: Column, verified_by: Column, method: Column, marker: str) -> Column:
    """Whether a reliable standard was verified by nobody but the model that wrote it."""
    return F.coalesce((kind == "standard") & (quality == "RELIABLE") & blank(verified_by) & F.contains(method, F.lit(marker)), F.lit(False))


def uncovered(df: DataFrame, id_col: str, text: str, rules: DataFrame, units: dict[str, list[str]], near: float = 0.005) -> DataFrame:
    """``id`` of the records of which no number, in its unit, is within ``near`` of a value of any rule's checks.

    Values meet by equi-join on cells of twice the tolerance and their neighbours. A null text has no number.
    """
    told = numbers(df, id_col, text, units).select("id", "unit_name", "number").distinct()
    c = rules.select(F.explode("checks").alias("c")).select(F.col("c.unit").alias("unit_name"), F.col("c.value").alias("target")).where("unit_name is not null and target is not null").distinct()
    cell = lambda x: F.floor(F.col(x) / (2 * near)).cast("bigint")
    stated = c.withColumn("cell", F.explode(F.array(*(cell("target") + k for k in (-1, 0, 1)))))
    covered = told.withColumn("cell", cell("number")).join(stated, ["unit_name", "cell"]).where(F.abs(F.col("number") - F.col("target")) <= near).select("id").distinct()
    return df.select(F.col(id_col).alias("id")).where("id is not null").distinct().join(covered, "id", "left_anti")


def verdicts(df: DataFrame, decision: str, issues: str) -> DataFrame:
    """``decision, n, n_errors, n_improvements`` of reviewed records; ``issues``: list of structs whose ``type`` is ``error`` or something to improve. Null lists are empty."""
    n = lambda f: F.coalesce(F.sum(F.size(F.filter(F.col(issues), f))), F.lit(0))
    some = df.withColumn(issues, F.coalesce(F.col(issues), F.array().cast(df.schema[issues].dataType)))
    return some.groupBy(decision).agg(F.count(F.lit(1)).alias("n"), n(lambda x: x["type"] == "error").alias("n_errors"), n(lambda x: F.coalesce(x["type"], F.lit("")) != "error").alias("n_improvements"))


def contract_errors(required: list[Column], numeric: dict[str, Column], enums: dict[str, tuple[Column, list[str]]]) -> Column:
    """Errors of a row of contract truth: none of ``required`` given (then nothing else is looked at), a given number that isn't one (commas allowed), a given code that isn't allowed."""
    given = lambda c: ~blank(c)
    some = required[0].isNull() if not required else blank(required[0])
    for c in required[1:]:
        some = some & blank(c)
    bad = [(given(c) & F.replace(F.trim(c), F.lit(","), F.lit("")).try_cast("double").isNull(), f"number:{k}") for k, c in numeric.items()]
    bad += [(given(c) & ~F.trim(c).isin(codes), f"enum:{k}") for k, (c, codes) in enums.items()]
    return F.when(some, F.array(F.lit("missing:any"))).otherwise(errors(*bad))


def quote_error(price: Column, is_pit: Column) -> Column:
    """The first error of a row of quote truth that names an entry: no price, or a mark of a pit other than 0 and 1; null if there is none."""
    return F.when(blank(price), "missing:price").when(~blank(is_pit) & ~F.trim(is_pit).isin("0", "1"), "form:is_pit")


def whole_batches(df: DataFrame, batch: str, error: Column) -> DataFrame:
    """The rows of the batches in which no row has an ``error`` (null: none). A null batch is one batch."""
    bad = df.where(error.isNotNull()).select(F.col(batch).alias("_b")).distinct()
    return df.join(bad, F.col(batch).eqNullSafe(F.col("_b")), "left_anti")


def append_truth(base: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The rows of ``new`` whose keys ``base`` doesn't hold; rows that ``new`` has several times stay so. A row with a null key is new."""
    return new.join(base.select(*keys).distinct(), list(keys), "left_anti")


def coverage_proof(classified: DataFrame, universe: DataFrame, key: str, name: str, expected_rest: int | None = None) -> DataFrame:
    """One row: ``n_universe, n_classified, n_twice`` (keys of several classes), ``n_outside`` (keys that the universe lacks), ``n_rest``, ``proven``.

    Proven is a classification without keys twice or outside, whose rest is ``expected_rest`` if that is given. Null keys don't count.
    """
    u = universe.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_u", F.lit(1))
    c = classified.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct(name).alias("_c"))
    both = u.join(c, key, "full_outer")
    out = both.agg(
        F.count("_u").alias("n_universe"), F.count("_c").alias("n_classified"), F.count_if(F.col("_c") > 1).alias("n_twice"), F.count_if(F.col("_u").isNull()).alias("n_outside"), F.count_if(F.col("_c").isNull()).alias("n_rest"),
    )
    ok = (F.col("n_twice") == 0) & (F.col("n_outside") == 0)
    return out.withColumn("proven", ok if expected_rest is None else ok & (F.col("n_rest") == expected_rest))


def unchanged(before: DataFrame, after: DataFrame, touched: DataFrame, key: str) -> DataFrame:
    """One row: ``n_lost, n_new``, the rows that differ between two tables apart from those with a ``touched`` key; rows that occur several times count as often."""
    t = touched.select(key).distinct()
    a, b = (x.select(*before.columns).join(t, key, "left_anti") for x in (before, after))
    lost, new = (x.exceptAll(y).agg(F.count(F.lit(1)).alias(n)) for x, y, n in ((a, b, "n_lost"), (b, a, "n_new")))
    return lost.join(F.broadcast(new))  # one row each


def fresh(data: DataFrame, index: DataFrame, by: str, data_time: str, index_time: str) -> DataFrame:
    """``by, data_time, index_time, fresh``: whether the latest index of each part is at least as new as its latest data; a part without index isn't fresh."""
    d = data.groupBy(by).agg(F.max(data_time).alias("data_time"))
    i = index.groupBy(F.col(by).alias("_by")).agg(F.max(index_time).alias("index_time"))
    return d.join(i, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by").withColumn("fresh", F.coalesce(F.col("index_time") >= F.col("data_time"), F.lit(False)))


def picked(df: DataFrame, key: str, ids: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """The records of the given ids, or the first ``limit`` by key, or both; all if neither is given."""
    if ids is not None:
        df = df.where(F.col(key).isin(ids))
    return df.orderBy(key).limit(limit) if limit is not None else df


def remaining(work: DataFrame, done: DataFrame, *keys: str) -> DataFrame:
    """What a job that was broken off has still to do: the rows whose keys aren't in the table of finished ones."""
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")
