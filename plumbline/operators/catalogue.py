"""Filters, counts, coverage and neighbours of a catalogue of units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Order of severities, and the codes of each dimension.
SEVERITIES = ["SEV_LOW", "SEV_MEDIUM", "SEV_HIGH", "SEV_CRITICAL"]
STAGES = [f"STAGE_{n:02d}" for n in range(1, 9)]
ROLES = ["ROLE_OWNER", "ROLE_DESIGNER", "ROLE_CONTRACTOR", "ROLE_INDUSTRY"]
TRADES = ["TRADE_DESIGN", "TRADE_DEMOLISH", "TRADE_PLUMBING", "TRADE_ELECTRICAL", "TRADE_WATERPROOF", "TRADE_TILE", "TRADE_CARPENTRY", "TRADE_PAINT", "TRADE_DOOR", "TRADE_CABINET", "TRADE_FLOOR", "TRADE_BATHROOM"]
MATERIALS = ["MAT_PIPE", "MAT_WIRE", "MAT_CEMENT", "MAT_TILE", "MAT_BOARD", "MAT_PAINT", "MAT_GLUE", "MAT_HARDWARE", "MAT_APPLIANCE", "MAT_FURNITURE", "MAT_GLASS", "MAT_STONE", "MAT_NONE"]

PROBLEMS = ["TYPE_FRAUD", "TYPE_QUALITY", "TYPE_OMISSION", "TYPE_DELAY", "TYPE_COST", "TYPE_COMMUNICATION"]
SOURCES = ["official_report", "legal_case", "consumer_complaint", "industry_standard", "expert_opinion", "user_feedback", "media_report"]
FREQUENCIES = ["极高频(>60%)", "高频(30-60%)", "中频(10-30%)", "低频(<10%)"]
CONFIDENCES = ["高(多源验证)", "中(单源可靠)", "低(待验证)"]
RELIABLE = ["RELIABLE", "CERTIFIED"]


def ordinal(c: Column, codes: list[str], missing: int = 0) -> Column:
    """Place of a code in its order; ``missing`` for null and unknown ones."""
    out = F.lit(missing)
    for n, code in enumerate(codes):
        out = F.when(c == code, n).otherwise(out)
    return F.when(c.isNull(), missing).otherwise(out)


def filter_units(units: DataFrame, stage: str | None = None, severity: str | None = None, min_severity: str | None = None, role: str | None = None, trade: str | None = None, problem_type: str | None = None, scope: str | None = None, quality: str | None = None) -> DataFrame:
    """Units for which all given conditions hold. A missing severity ranks as the lowest; a null field meets no other condition."""
    for name, value in (("stage", stage), ("severity", severity), ("scope", scope)):
        if value is not None:
            units = units.where(F.col(name) == value)
    for name, value in (("role", role), ("trade", trade), ("problem_type", problem_type)):
        if value is not None:
            units = units.where(F.array_contains(name, value))
    if quality is not None:
        units = units.where(F.col("metadata.quality_level") == quality)
    if min_severity is not None:
        units = units.where(ordinal(F.col("severity"), SEVERITIES) >= SEVERITIES.index(min_severity))
    return units


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    """A page of rows in a total order. Spark keeps ``offset + limit`` rows of each task only."""
    return df.orderBy(*order).offset(offset).limit(limit)


def counts_by_dimension(units: DataFrame) -> DataFrame:
    """``dim, key, n`` of all dimensions in one pass; nulls and empty lists count nowhere."""
    one = lambda name, c: F.array(F.struct(F.lit(name).alias("dim"), c.alias("key")))
    many = lambda name, c: F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.struct(F.lit(name).alias("dim"), x.alias("key")))
    pairs = F.concat(
        one("stage", F.col("stage")), one("severity", F.col("severity")), one("scope", F.col("scope")), one("quality", F.col("metadata.quality_level")),
        many("role", F.col("role")), many("trade", F.col("trade")), many("material", F.col("material")), many("problem_type", F.col("problem_type")),
    )
    return units.select(F.explode(pairs).alias("x")).select("x.dim", "x.key").where("key is not null").groupBy("dim", "key").agg(F.count(F.lit(1)).alias("n"))


def universe(spark, dims: dict[str, list[str]]) -> DataFrame:
    """``dim, key`` of every code; as many rows as codes."""
    return spark.createDataFrame([(d, k) for d, ks in dims.items() for k in ks], "dim string, key string")


def coverage(counts: DataFrame, codes: DataFrame, weak: dict[str, int]) -> DataFrame:
    """``dim, key, n, gap`` of every code: ``empty`` without units, ``weak`` with fewer than the dimension's bound, else null."""
    bound = F.lit(0)
    for d, n in weak.items():
        bound = F.when(F.col("dim") == d, n).otherwise(bound)
    all_ = codes.join(counts, ["dim", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return all_.withColumn("gap", F.when(F.col("n") == 0, "empty").when(F.col("n") < bound, "weak"))


def recommendations(counts: DataFrame, codes: DataFrame, few: int = 10) -> DataFrame:
    """``dim, key, n, priority`` of the codes to be filled: ``P0`` without units, ``P1`` with fewer than ``few``."""
    all_ = codes.join(counts, ["dim", "key"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return all_.where(F.col("n") < few).withColumn("priority", F.when(F.col("n") == 0, "P0").otherwise("P1"))


def reliable_counts(units: DataFrame, by: str) -> DataFrame:
    """``by, n, n_reliable``: units, and those of a reliable quality or better."""
    return units.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("metadata.quality_level").isin(RELIABLE)).alias("n_reliable"))


def neighbours(edges: DataFrame, units: DataFrame) -> DataFrame:
    """``ku_id, other, relation_type, via``: the other ends of each unit's edges that exist, in both directions; then its own listed
    units that no edge leads to, as ``CO_OCCURS``. Repeated edges count once."""
    e = edges.select("source_ku_id", "target_ku_id", "relation_type").distinct()
    both = e.select(F.col("source_ku_id").alias("ku_id"), F.col("target_ku_id").alias("other"), "relation_type").unionByName(e.select(F.col("target_ku_id").alias("ku_id"), F.col("source_ku_id").alias("other"), "relation_type"))
    known = units.select(F.col("ku_id").alias("other"))
    by_edge = both.join(known, "other", "left_semi").join(units.select("ku_id"), "ku_id", "left_semi").distinct().withColumn("via", F.lit("edge"))
    listed = units.select("ku_id", F.explode(F.array_distinct("related_ku_ids")).alias("other")).join(known, "other", "left_semi")
    rest = listed.join(by_edge.select("ku_id", "other"), ["ku_id", "other"], "left_anti").select("ku_id", "other", F.lit("CO_OCCURS").alias("relation_type"), F.lit("list").alias("via"))
    return by_edge.select("ku_id", "other", "relation_type", "via").unionByName(rest)


def edges_where(edges: DataFrame, source: str | None = None, target: str | None = None, either: str | None = None, relation_type: str | None = None) -> DataFrame:
    """Edges from ``source``, to ``target``, at ``either`` end of a unit and of a type, as far as these are given."""
    for c, v in (("source_ku_id", source), ("target_ku_id", target), ("relation_type", relation_type)):
        if v is not None:
            edges = edges.where(F.col(c) == v)
    return edges if either is None else edges.where((F.col("source_ku_id") == either) | (F.col("target_ku_id") == either))


def dangling(units: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """``ku_id, missing_id``: listed units, and other ends of ``edges``, that don't exist. Nulls and blanks don't count."""
    listed = units.select("ku_id", F.explode(F.array_distinct("related_ku_ids")).alias("missing_id"))
    if edges is not None:
        ends = [edges.select(F.col(a).alias("ku_id"), F.col(b).alias("missing_id")) for a, b in (("source_ku_id", "target_ku_id"), ("target_ku_id", "source_ku_id"))]
        listed = listed.unionByName(ends[0]).unionByName(ends[1]).distinct()
    listed = listed.where("trim(missing_id) <> ''")
    return listed.join(units.select(F.col("ku_id").alias("missing_id")), "missing_id", "left_anti").select("ku_id", "missing_id")
