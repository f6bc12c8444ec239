"""Catalogue queries: filters, counts, coverage, neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import catalogue as K
from plumbline.plans import corpora as C
from plumbline.plans.registry import query
from plumbline.session import table

_ORD = "case severity when 'SEV_MEDIUM' then 1 when 'SEV_HIGH' then 2 when 'SEV_CRITICAL' then 3 else 0 end"


@query(sql=f"with {C.UNIT_SQL} select ku_id, title, severity from unit where stage = 'STAGE_04' and list_contains(trade, 'TRADE_PAINT') and list_contains(role, 'ROLE_OWNER') and {_ORD} >= 1")
def filter_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of a stage, trade and role with a least severity."""
    return K.filter_units(C.latest_units(spark, sf_dir), stage="STAGE_04", trade="TRADE_PAINT", role="ROLE_OWNER", min_severity="SEV_MEDIUM").select("ku_id", "title", "severity")


@query(sql=f"with {C.UNIT_SQL}, t as (select ku_id, title, count(*) over () as total from unit where scope = 'universal') select * from t order by ku_id limit 50 offset 50")
def filter_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second page of fifty units of a scope, with the number of all. (A page is the feature.)"""
    hits = K.filter_units(C.latest_units(spark, sf_dir), scope="universal").select("ku_id", "title")
    total = hits.agg(F.count(F.lit(1)).alias("total"))
    return K.page(hits, [F.asc("ku_id")], 50, 50).join(F.broadcast(total))


_STATS = f"""with {C.UNIT_SQL}, x as (
  select 'stage' as dim, stage as key from unit union all select 'severity', severity from unit union all select 'scope', scope from unit union all select 'quality', metadata.quality_level from unit
  union all select 'role', unnest(role) from unit union all select 'trade', unnest(trade) from unit union all select 'material', unnest(material) from unit union all select 'problem_type', unnest(problem_type) from unit),
stats as (select dim, key, count(*) as n from x where key is not null group by dim, key)"""


@query(sql=_STATS + " select * from stats")
def stats_by_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of units by each value of each dimension."""
    return K.counts_by_dimension(C.latest_units(spark, sf_dir))


_DIMS = {"stage": K.STAGES, "role": K.ROLES, "trade": K.TRADES, "material": K.MATERIALS}
_CODES = "codes(dim, key) as (values " + ", ".join(f"('{d}', '{k}')" for d, ks in _DIMS.items() for k in ks) + ")"


@query(
    sql=_STATS + f""", {_CODES} select dim, key, coalesce(n, 0) as n, case when n is null then 'empty' when dim = 'stage' and n < 60 then 'weak' when dim = 'trade' and n < 110 then 'weak' end as gap from codes left join stats using (dim, key)"""
)
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of units of each code, with empty and weak ones marked."""
    return K.coverage(K.counts_by_dimension(C.latest_units(spark, sf_dir)), K.universe(spark, _DIMS), {"stage": 60, "trade": 110})


@query(sql=_STATS + f", {_CODES} select dim, count(*) as universe, count(n) as covered, round(count(n)::double / count(*), 4) as share from codes left join stats using (dim, key) group by dim")
def coverage_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each dimension's codes that have a unit."""
    c = K.coverage(K.counts_by_dimension(C.latest_units(spark, sf_dir)), K.universe(spark, _DIMS), {})
    covered = F.count_if(F.col("n") > 0)
    return c.groupBy("dim").agg(F.count(F.lit(1)).alias("universe"), covered.alias("covered"), F.round(covered / F.count(F.lit(1)), 4).alias("share"))


@query(
    sql=f"""with {C.UNIT_SQL}, e as (select distinct source_ku_id as s, target_ku_id as t, relation_type from ku_relations_v1),
    b as (select distinct * from (select s as ku_id, t as other, relation_type from e union all select t, s, relation_type from e) where ku_id in (select ku_id from unit) and other in (select ku_id from unit)),
    l as (select distinct ku_id, unnest(related_ku_ids) as other from unit)
    select ku_id, other, relation_type, 'edge' as via from b
    union all select ku_id, other, 'CO_OCCURS', 'list' from l where other in (select ku_id from unit) and (ku_id, other) not in (select ku_id, other from b)"""
)
def related_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every unit by edges and lists."""
    return K.neighbours(table(spark, sf_dir, "ku_relations_v1"), C.latest_units(spark, sf_dir))


@query(sql="select distinct rel_id, source_ku_id, target_ku_id from ku_relations_v1 where relation_type = 'CAUSES' and (source_ku_id = 'GZ-SY-00001' or target_ku_id = 'GZ-SY-00001')")
def edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of a type at a unit."""
    return K.edges_where(table(spark, sf_dir, "ku_relations_v1"), either="GZ-SY-00001", relation_type="CAUSES").select("rel_id", "source_ku_id", "target_ku_id").distinct()


@query(
    sql=f"""with {C.UNIT_SQL}, l as (select ku_id, unnest(related_ku_ids) as missing_id from unit union all select source_ku_id, target_ku_id from ku_relations_v1 union all select target_ku_id, source_ku_id from ku_relations_v1)
    select distinct ku_id, missing_id from l where trim(missing_id) <> '' and missing_id not in (select ku_id from unit)"""
)
def dangling_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed units and ends of edges that don't exist."""
    return K.dangling(C.latest_units(spark, sf_dir), table(spark, sf_dir, "ku_relations_v1"))




@query(
    sql=f"with {C.UNIT_SQL}, s as (select ku_id, severity, coalesce((evidence.source_type = 'industry_standard')::int, 0) + coalesce((evidence.frequency like '高频%')::int, 0) + (metadata.verified is not true)::int as score from unit) select ku_id, severity, score from s where score >= 2 order by {_ORD} desc, score desc, ku_id limit 30"
)
def risk_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty units to be audited first. (A top list is the feature.)"""
    yes = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    score = yes(F.col("evidence.source_type") == "industry_standard") + yes(F.startswith("evidence.frequency", F.lit("高频"))) + yes(~F.coalesce("metadata.verified", F.lit(False)))
    s = C.latest_units(spark, sf_dir).select("ku_id", "severity", score.alias("score")).where("score >= 2")
    return s.orderBy(K.ordinal(F.col("severity"), K.SEVERITIES).desc(), F.desc("score"), F.asc("ku_id")).limit(30)


@query(sql=f"with {C.UNIT_SQL}, k as (select stage, count(*) as n from unit group by stage), t as (select sum(n) as total, avg(n) as mean from k) select stage, n, round(n::double / total, 6) as share, n > 2 * mean as overweight from k, t")
def stage_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of each stage, with those of more than twice the mean marked."""
    k = C.latest_units(spark, sf_dir).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))
    t = k.agg(F.sum("n").alias("total"), F.avg("n").alias("mean"))
    return k.join(F.broadcast(t)).select("stage", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), (F.col("n") > 2 * F.col("mean")).alias("overweight"))
