"""Curation queries: splitting, validation, merging, numbering, near-duplicates, verification of numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import catalogue as K
from plumbline.operators import curation as V
from plumbline.plans import corpora as C
from plumbline.plans.registry import query
from plumbline.session import table


@query(
    sql=r"""with p as (select doc_id as id, unnest(string_split_regex(text, '\r\n|\n|\r')) as raw, generate_subscripts(string_split_regex(text, '\r\n|\n|\r'), 1) - 1 as seg_no from documents),
    s as (select id, seg_no::int as seg_no, regexp_replace(raw, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') as segment from p)
    select id, seg_no, segment, length(segment) < 20 as skipped from s where segment <> ''"""
)
def segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each document, short ones marked."""
    return V.split_segments(table(spark, sf_dir, "documents"), "doc_id", "text", r"\r\n|\n|\r")


_ENUM = lambda name, codes: f"{name} not in ({', '.join(repr(c) for c in codes)})"


@query(
    sql=f"""with {C.UNIT_SQL} select ku_id, array_to_string(list_filter([
    case when coalesce(trim(title), '') = '' then 'missing:title' end, case when coalesce(trim(stage), '') = '' then 'missing:stage' end, case when coalesce(trim(description), '') = '' then 'missing:description' end,
    case when coalesce(len(role), 0) = 0 then 'missing:role' end, case when stage is not null and {_ENUM('stage', K.STAGES)} then 'enum:stage' end,
    case when severity is not null and {_ENUM('severity', K.SEVERITIES)} then 'enum:severity' end,
    case when coalesce(len(list_filter(trade, lambda x: {_ENUM('x', K.TRADES)})) > 0, false) then 'enum:trade' end,
    case when length(title) > 80 then 'too_long:title' end, case when length(description) < 50 then 'too_short:description' end, case when length(description) > 500 then 'too_long:description' end,
    case when length(how_to_avoid) < 50 then 'too_short:how_to_avoid' end, case when length(how_to_avoid) > 500 then 'too_long:how_to_avoid' end, case when length(typical_scenario) > 300 then 'too_long:typical_scenario' end
    ], lambda x: x is not null), ',') as errors from unit"""
)
def validate_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each unit against the schema, in a fixed order."""
    u = C.latest_units(spark, sf_dir)
    n = F.length
    bad = V.errors(
        (V.blank(F.col("title")), "missing:title"), (V.blank(F.col("stage")), "missing:stage"), (V.blank(F.col("description")), "missing:description"),
        (F.coalesce(F.size("role"), F.lit(0)) <= 0, "missing:role"), (~F.col("stage").isin(K.STAGES), "enum:stage"), (~F.col("severity").isin(K.SEVERITIES), "enum:severity"),
        (F.exists("trade", lambda x: ~x.isin(K.TRADES)), "enum:trade"), (n("title") > 80, "too_long:title"), (n("description") < 50, "too_short:description"), (n("description") > 500, "too_long:description"),
        (n("how_to_avoid") < 50, "too_short:how_to_avoid"), (n("how_to_avoid") > 500, "too_long:how_to_avoid"), (n("typical_scenario") > 300, "too_long:typical_scenario"),
    )
    return u.select("ku_id", F.array_join(bad, ",").alias("errors"))


@query(
    sql=f"""with {C.ENTRY_SQL} select id, case when coalesce(trim(category), '') = '' then 'missing:category' when tags is null or len(tags) = 0 then 'missing:tags' when coalesce(trim(question), '') = '' then 'missing:question'
    when coalesce(trim(answer), '') = '' then 'missing:answer' when not regexp_matches(id, '^k[0-9]{{3,}}$') then 'form:id' when length(question) < 5 then 'short:question' when length(answer) < 20 then 'short:answer' end as error from entry"""
)
def validate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each imported entry, null if there is none."""
    e = C.entries(spark, sf_dir)
    error = (
        F.when(V.blank(F.col("category")), "missing:category").when(F.coalesce(F.size("tags"), F.lit(0)) <= 0, "missing:tags").when(V.blank(F.col("question")), "missing:question")
        .when(V.blank(F.col("answer")), "missing:answer").when(~F.col("id").rlike("^k[0-9]{3,}$"), "form:id").when(F.length("question") < 5, "short:question").when(F.length("answer") < 20, "short:answer")
    )
    return e.select("id", error.alias("error"))


_LOOSE = "stage || case when length(title) % 3 = 0 then ' (checked)' when length(title) % 3 = 1 then '' else 'X' end"


@query(
    sql=f"""with {C.UNIT_SQL}, r as (select ku_id, {_LOOSE} as raw from unit) select ku_id, raw, coalesce({', '.join(f"case when starts_with(raw, '{s}') then '{s}' end" for s in K.STAGES)}) as stage_code from r"""
)
def coerce_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loosely written stages as codes."""
    m = F.length("title") % 3
    raw = F.concat("stage", F.when(m == 0, " (checked)").when(m == 1, "").otherwise("X"))
    r = C.latest_units(spark, sf_dir).select("ku_id", raw.alias("raw"))
    return r.withColumn("stage_code", V.coerce(F.col("raw"), K.STAGES))


_HALF = "date '2026-03-01'"


@query(
    sql=f"""with v as (select ku_id, title, updated_at, 0 as new from knowledge_unit where updated_at < {_HALF} union all select ku_id, title, updated_at, 1 from knowledge_unit where updated_at >= {_HALF})
    select ku_id, title, updated_at from v qualify row_number() over (partition by ku_id order by new desc, updated_at desc) = 1"""
)
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions before a date merged with those since, the new ones winning."""
    u = table(spark, sf_dir, "knowledge_unit").select("ku_id", "title", "updated_at")
    return V.upsert(u.where(f"updated_at < {_HALF}"), u.where(f"updated_at >= {_HALF}"), "ku_id", F.col("updated_at"))


@query(
    sql=f"""with n as (select ku_id, title, updated_at from knowledge_unit where updated_at >= {_HALF} and ku_id not in (select ku_id from knowledge_unit where updated_at < {_HALF}))
    select * from n qualify row_number() over (partition by ku_id order by updated_at) = 1"""
)
def append_skip_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions since a date of units that weren't there before, the first of each."""
    u = table(spark, sf_dir, "knowledge_unit").select("ku_id", "title", "updated_at")
    return V.append_new(u.where(f"updated_at < {_HALF}"), u.where(f"updated_at >= {_HALF}"), "ku_id", F.col("updated_at"))


@query(
    sql=f"""with {C.ENTRY_SQL}, top as (select coalesce(max(try_cast(nullif(regexp_extract(ku_id, '^GZ-SY-([0-9]+)$', 1), '') as bigint)), 0) as top from knowledge_unit)
    select id, 'GZ-SY-' || lpad((top + row_number() over (order by id))::varchar, 5, '0') as new_id from entry, top where category = '避坑指南'"""
)
def next_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of a category as new units, numbered after the library's last."""
    e = C.entries(spark, sf_dir).where("category = '避坑指南'").select("id")
    return V.numbered(e, table(spark, sf_dir, "knowledge_unit"), "ku_id", F.col("id")).select("id", "new_id")


@query(sql="select ku_id, count(*) as n_rows, count(distinct updated_at) as n_versions from knowledge_unit group by ku_id having count(*) > 1")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that occur in several rows."""
    return table(spark, sf_dir, "knowledge_unit").groupBy("ku_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("updated_at").alias("n_versions")).where("n_rows > 1")


@query(sql=f"with {C.UNIT_SQL}, a as (select severity, count(*) as n from unit group by severity), b as (select severity, count(distinct ku_id) as m from knowledge_unit group by severity) select coalesce(a.severity, b.severity) as severity, coalesce(n, 0) as n_master, coalesce(m, 0) as n_shard, coalesce(n, 0) = coalesce(m, 0) as in_sync from a full join b on a.severity is not distinct from b.severity")
def shard_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units by severity in the master and over all versions, and whether they agree."""
    a = C.latest_units(spark, sf_dir).groupBy("severity").agg(F.count(F.lit(1)).alias("n_master"))
    b = table(spark, sf_dir, "knowledge_unit").groupBy(F.col("severity").alias("s")).agg(F.countDistinct("ku_id").alias("n_shard"))
    j = a.join(b, F.col("severity").eqNullSafe(F.col("s")), "full_outer")
    n, m = (F.coalesce(c, F.lit(0)) for c in ("n_master", "n_shard"))
    return j.select(F.coalesce("severity", "s").alias("severity"), n.alias("n_master"), m.alias("n_shard"), (n == m).alias("in_sync"))


_VALUE = "([0-9]+(?:[.][0-9]+)?) ?(mm|MPa|小时|天|元)"


@query(
    sql=f"""with {C.UNIT_SQL}, x as (select ku_id, unnest(regexp_extract_all(coalesce(description, ''), '{_VALUE}', 1)) as v, unnest(regexp_extract_all(coalesce(description, ''), '{_VALUE}', 2)) as unit_name from unit)
    select ku_id, unit_name, v::double as number, count(*) as n from x group by all"""
)
def unit_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with their units in the descriptions."""
    d = F.coalesce("description", F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(d, F.lit(_VALUE), 1).alias("v"), F.regexp_extract_all(d, F.lit(_VALUE), 2).alias("u"))
    x = C.latest_units(spark, sf_dir).select("ku_id", F.explode(both).alias("x"))
    return x.groupBy("ku_id", F.col("x.u").alias("unit_name"), F.col("x.v").cast("double").alias("number")).agg(F.count(F.lit(1)).alias("n"))


@query(
    sql=f"""with {C.UNIT_SQL}, x as (select ku_id, unnest(regexp_extract_all(coalesce(description, ''), '{_VALUE}', 1))::double as v, unnest(regexp_extract_all(coalesce(description, ''), '{_VALUE}', 2)) as u from unit),
    r as (select distinct id as rule_id, c.value as v, c.operator as op, c.unit as u from (select id, unnest(checks) as c from verification_rules) where c.value is not null and c.unit in ('mm', 'MPa')),
    known as (select distinct u, round(v, 2) as v from r), seen as (select distinct ku_id, u, v from x where u in ('mm', 'MPa'))
    select s.ku_id, s.u as unit_name, s.v as number, k.v is not null as covered from seen s left join known k on s.u = k.u and round(s.v, 2) = k.v"""
)
def rule_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of the descriptions, and whether some rule states them in the same unit (to 0.01)."""
    d = F.coalesce("description", F.lit(""))
    both = F.arrays_zip(F.regexp_extract_all(d, F.lit(_VALUE), 1).alias("v"), F.regexp_extract_all(d, F.lit(_VALUE), 2).alias("u"))
    seen = C.latest_units(spark, sf_dir).select("ku_id", F.explode(both).alias("x")).select("ku_id", F.col("x.u").alias("unit_name"), F.col("x.v").cast("double").alias("number")).where("unit_name in ('mm', 'MPa')").distinct()
    c = table(spark, sf_dir, "verification_rules").select(F.explode("checks").alias("c")).where("c.value is not null and c.unit in ('mm', 'MPa')")
    known = c.select(F.col("c.unit").alias("unit_name"), F.round("c.value", 2).alias("r")).distinct().withColumn("hit", F.lit(True))
    return seen.withColumn("r", F.round("number", 2)).join(known, ["unit_name", "r"], "left").select("ku_id", "unit_name", "number", F.coalesce("hit", F.lit(False)).alias("covered"))


# Units of the rules, and their spellings in texts and rules.
RULE_UNITS = {
    "mm": ["mm", "毫米"], "cm": ["cm", "厘米"], "m²": ["m²", "㎡", "平方米"], "m": ["米"], "MPa": ["MPa", "兆帕"], "h": ["小时"], "d": ["天"], "min": ["min", "分钟"], "%": ["%", "％"],
    "mg/m³": ["mg/m³", "mg/m3"], "mg/L": ["mg/L"], "Bq/m³": ["Bq/m³", "Bq/m3"], "℃": ["℃", "°C"], "元": ["元"],
}


@query()
def rule_check_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the numbers of a description meet, and numbers that contradict a rule it meets."""
    return V.checked_rules(C.latest_units(spark, sf_dir), "ku_id", "description", table(spark, sf_dir, "verification_rules"), RULE_UNITS).withColumnRenamed("id", "ku_id")


@query()
def near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of units with similar titles or similar descriptions."""
    return V.similar_titles(C.latest_units(spark, sf_dir), "ku_id", "title", "description")


@query()
def batch_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all stages but the first as a batch: the most similar unit of the first stage or before it in the batch."""
    u = C.latest_units(spark, sf_dir)
    place = F.substring("ku_id", 7, 10).cast("bigint")
    return V.first_similar(u.where("stage = 'STAGE_01'"), u.where("stage <> 'STAGE_01'").withColumn("place", place), "ku_id", "title", "description", "place")
