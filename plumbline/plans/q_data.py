"""Queries of the training-data problems that aren't about text: units (4) and orphan references (6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.operators import orphans, units
from plumbline.plans.registry import query
from plumbline.session import table


@query()
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits that aren't given in the common unit, converted to it."""
    every = units.common_limits(table(spark, sf_dir, "verification_rules"), table(spark, sf_dir, "unit_family"))
    return every.where("not as_common").select("id", "check_no", "common_unit", "value_milli")


@query()
def p4_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every limit in the common unit of its quantity."""
    return units.common_limits(table(spark, sf_dir, "verification_rules"), table(spark, sf_dir, "unit_family"))


_FULL = "'" + "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "　'"
_HALF = "'" + "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''") + " '"


def _key(c: str) -> str:
    return rf"nullif(upper(regexp_replace(translate({c}, {_FULL}, {_HALF}), '^[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+$', '', 'g')), '')"


_ORPHANS = f"""
with unit as (
  select {_key("ku_id")} as k, min(created_at) as born,
         max_by({{'g': removed_at}}, {{'u': coalesce(updated_at, created_at, timestamp '1970-01-01'), 'g': coalesce(removed_at, timestamp '0001-01-01')}}).g as removed
  from knowledge_unit where {_key("ku_id")} is not null group by 1),
edge as (
  select distinct rel_id, created_at, 'source' as side, {_key("source_ku_id")} as k from ku_relations_v1
  union all
  select distinct rel_id, created_at, 'target' as side, {_key("target_ku_id")} as k from ku_relations_v1),
found as (
  select distinct rel_id, side, created_at,
         case when unit.k is null then 'missing' when removed <= created_at then 'deleted' when born > created_at then 'late' end as reason
  from edge left join unit using (k) where edge.k is not null)
"""


@query(sql=_ORPHANS + "select rel_id, side, reason from found where reason is not null")
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ends of edges that lead nowhere, with the reason."""
    return orphans.orphan_ends(table(spark, sf_dir, "ku_relations_v1"), table(spark, sf_dir, "knowledge_unit")).select("rel_id", "side", "reason").distinct()


@query(sql=_ORPHANS + "select 'ku_relations_v1' as table_name, strftime(created_at, '%Y-%m') as month, side, reason, count(*) as n_orphans from found where reason is not null group by all")
def p6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of such ends by table, month, side and reason."""
    return orphans.orphan_counts(orphans.orphan_ends(table(spark, sf_dir, "ku_relations_v1"), table(spark, sf_dir, "knowledge_unit")))
