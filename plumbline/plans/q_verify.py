"""Verification queries: schemas, truth rows, batches, proofs, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import catalogue as K
from plumbline.operators import curation as V
from plumbline.operators import repair
from plumbline.operators import verification as W
from plumbline.plans import corpora as C
from plumbline.plans.q_curation import RULE_UNITS
from plumbline.plans.registry import query
from plumbline.session import table

_STANDARD = ["description", "typical_scenario", "how_to_avoid", "severity"]


@query(
    sql=f"""with {C.UNIT_SQL}, k as (select *, coalesce(nullif(knowledge_type, ''), 'gotcha') as kind from unit) select ku_id, array_to_string(list_filter([
    case when coalesce(ku_id, '') = '' then 'missing:id' end, case when kind not in {W.TYPES} then 'type' end, case when coalesce(title, '') = '' then 'missing:title' end,
    {', '.join(f"case when kind = 'standard' and coalesce({c}, '') = '' then 'standard:{c}' end" for c in _STANDARD)}], lambda x: x is not null), ',') as errors from k"""
)
def schema_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of each unit by its type of knowledge; a standard has four fields more."""
    u = C.latest_units(spark, sf_dir)
    return u.select("ku_id", F.array_join(W.schema_errors(u, "ku_id", "title", "knowledge_type", {"standard": _STANDARD}), ",").alias("errors"))


_LISTS = {"role": K.ROLES[:3], "problem_type": K.PROBLEMS, "trade": K.TRADES[:10], "material": K.MATERIALS[:8]}
_EVIDENCE = {"source_type": K.SOURCES, "frequency": K.FREQUENCIES, "confidence": K.CONFIDENCES}


def _sql_list(codes: list[str]) -> str:
    return "(" + ", ".join(f"'{c}'" for c in codes) + ")"


@query(
    sql=f"""with {C.UNIT_SQL} select ku_id, array_to_string(flatten([{', '.join(f"list_transform(list_filter(coalesce({c}, []), lambda x: coalesce(x, '') not in {_sql_list(codes)}), lambda x: 'enum:{c}=' || coalesce(x, ''))" for c, codes in _LISTS.items())},
    {', '.join(f"case when evidence.{c} is not null and evidence.{c} <> '' and evidence.{c} not in {_sql_list(codes)} then ['enum:evidence.{c}=' || evidence.{c}] else [] end" for c, codes in _EVIDENCE.items())}]), ',') as errors from unit"""
)
def validate_enums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of each unit's lists and evidence that are no code. The last codes of the lists are held to be unknown, so that rows appear."""
    each = [W.enum_errors(F.col(c), c, codes) for c, codes in _LISTS.items()]
    each += [W.enum_errors(F.array_compact(F.array(F.nullif(F.col(f"evidence.{c}"), F.lit("")))), f"evidence.{c}", codes) for c, codes in _EVIDENCE.items()]
    return C.latest_units(spark, sf_dir).select("ku_id", F.array_join(F.concat(*each), ",").alias("errors"))


@query(sql=f"with {C.UNIT_SQL} select ku_id, case when coalesce(stage, '') = '' then [] else [stage] end as stage, case when coalesce(typical_scenario, '') = '' then [] else [typical_scenario] end as typical_scenario, coalesce(material, []) as material from unit")
def scalars_to_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single values and lists alike as lists."""
    return W.as_lists(C.latest_units(spark, sf_dir), "stage", "typical_scenario", "material").select("ku_id", "stage", "typical_scenario", "material")


@query(
    sql=f"""with {C.UNIT_SQL} select ku_id, coalesce(case when stage = 'STAGE_04' then null else scope end, 'universal') as scope, len(coalesce(related_ku_ids, [])) as n_related, '2026-06-01' as created_at, 'ai' as created_by, false as verified,
    'not_verified' as verify_method, '1.0' as version, 'pipeline' as source_file, 'DRAFT' as quality_level, null::varchar as expires_at from unit"""
)
def enrich_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as new records: missing scope (taken away in one stage) and metadata filled in."""
    u = C.latest_units(spark, sf_dir).withColumn("scope", F.when(F.coalesce(F.col("stage") == "STAGE_04", F.lit(False)), F.lit(None)).otherwise(F.col("scope")))
    m = ["created_at", "created_by", "verified", "verify_method", "version", "source_file", "quality_level", "expires_at"]
    return W.enriched(u, "2026-06-01").select("ku_id", "scope", F.size("related_ku_ids").cast("bigint").alias("n_related"), *(f"metadata.{c}" for c in m))


_LONG = "length(coalesce(description, '')) > 150"


@query(sql=f"with {C.UNIT_SQL} select evidence.source_ref[3:4] as segment, count(*) as n_candidates, count(*) filter ({_LONG}) as n_too_long, bool_or({_LONG}) as retry from unit group by 1")
def retry_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of candidates (by letters of their reference) of which one is too long."""
    u = C.latest_units(spark, sf_dir).select(F.substring("evidence.source_ref", 3, 2).alias("segment"), V.errors((F.expr(_LONG), "too_long:description")).alias("bad"))
    return W.to_retry(u, "segment", "bad")


@query(
    sql=f"""with {C.UNIT_SQL}, q as (select distinct log_id, coalesce(nullif(user_query, ''), title, '') as q from usage_log_entry left join unit using (ku_id)),
    n as (select *, length(regexp_replace(q, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) as n from q)
    select distinct log_id, case when q = '' then 'empty' when n < 8 then 'short:' || n {' '.join(f"when contains(q, '{w}') then 'broad:{w}'" for w in W.BROAD)} end as reason from n"""
)
def narrow_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why a query, or the title of its unit where there is no query, is too broad for a rule of its own; null if it isn't."""
    q = table(spark, sf_dir, "usage_log_entry").select("log_id", "ku_id", "user_query").join(C.latest_units(spark, sf_dir).select("ku_id", "title"), "ku_id", "left")
    return q.select("log_id", W.too_broad(F.col("user_query"), F.col("title")).alias("reason")).distinct()


_CLAUSES = ["3.1.4", "6.1.11", "6.1.12", "7.1.12", "11.1.12", "9.1.7", "6.3.1", "1.3.3", "7.3.2", "6.1.1", "1.4.1"]
_CITED = ", ".join(f"case when regexp_matches(t, '(^|[^0-9]){c.replace('.', '[.]')}([^0-9]|$)') then '{c}' end" for c in _CLAUSES)


@query(
    sql=f"""with r as (select distinct id, concat_ws(' ', standard, clause, topic) as t from verification_rules), c as (select id, t, list_filter([{_CITED}], lambda x: x is not null) as cited from r)
    select id, array_to_string(cited, ',') as cited from c where contains(t, 'QZ 10') and not contains(t, '-2024') and len(cited) > 0"""
)
def obsolete_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that cite withdrawn clauses of a family of standards without its successor."""
    r = table(spark, sf_dir, "verification_rules").select("id", F.concat_ws(" ", "standard", "clause", "topic").alias("t")).distinct()
    return r.select("id", W.obsolete(F.col("t"), "QZ 10", _CLAUSES, "-2024").alias("cited")).where("cited is not null")


@query(sql=f"with {C.UNIT_SQL} select ku_id, coalesce(knowledge_type = 'standard' and metadata.quality_level = 'RELIABLE' and coalesce(metadata.expires_at, '') = '' and contains(metadata.created_by, 'editor'), false) as self_verified from unit")
def self_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reliable standards without a reviewer (here: an expiry) whose method (here: author) bears a mark."""
    m = lambda c: F.col(f"metadata.{c}")
    return C.latest_units(spark, sf_dir).select("ku_id", W.self_verified(F.col("knowledge_type"), m("quality_level"), m("expires_at"), m("created_by"), "editor").alias("self_verified"))


def _numbers_sql(text: str) -> str:
    """``ku_id, u, v`` of each number before a spelling of a unit of the rules."""
    one = lambda u, ss: f"select ku_id, '{u}' as u, unnest(regexp_extract_all({text}, '([0-9]+(?:[.][0-9]+)?)[\\s\\p{{Z}}]*(?:{'|'.join(sorted(ss, key=lambda x: (-len(x), x)))})', 1))::double as v from unit where {text} is not null"
    return " union all ".join(one(u, ss) for u, ss in RULE_UNITS.items())


@query(sql=f"with {C.UNIT_SQL}, x as ({_numbers_sql('description')}) select ku_id, u as unit_name, v as number, count(*) as n from x group by all")
def unit_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with a unit of the rules in the descriptions; a unit is found within a longer one too."""
    return V.numbers(C.latest_units(spark, sf_dir), "ku_id", "description", RULE_UNITS).groupBy(F.col("id").alias("ku_id"), "unit_name", "number").agg(F.count(F.lit(1)).alias("n"))


@query(
    sql=f"""with {C.UNIT_SQL}, x as (select distinct * from ({_numbers_sql('description')})), c as (select distinct c.unit as u, c.value as target from (select unnest(checks) as c from verification_rules) where c.unit is not null and c.value is not null),
    hit as (select distinct ku_id from x join c using (u) where abs(v - target) <= 0.005) select ku_id from unit where knowledge_type = 'standard' and ku_id not in (select ku_id from hit)"""
)
def uncovered_standards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standards of whose numbers no rule states one."""
    u = C.latest_units(spark, sf_dir).where("knowledge_type = 'standard'")
    return W.uncovered(u, "ku_id", "description", table(spark, sf_dir, "verification_rules"), RULE_UNITS).withColumnRenamed("id", "ku_id")


_DECISION = "case when metadata.quality_level in ('CERTIFIED', 'RELIABLE') then 'pass' when metadata.verified then 'retry' else 'fail' end"
_ISSUES = {"severity = 'SEV_CRITICAL'": "error", "typical_scenario is null": "improvement", "how_to_avoid is null": "error", "len(trade) > 2": "wording"}


@query(
    sql=f"""with {C.UNIT_SQL}, d as (select {_DECISION} as decision, list_filter([{', '.join(f"case when {k} then '{v}' end" for k, v in _ISSUES.items())}], lambda x: x is not null) as i from unit)
    select decision, count(*) as n, sum(len(list_filter(i, lambda x: x = 'error')))::bigint as n_errors, sum(len(list_filter(i, lambda x: x <> 'error')))::bigint as n_improvements from d group by decision"""
)
def review_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with their issues, by decision."""
    issues = F.array_compact(F.array(*(F.when(F.expr(k.replace("len(", "size(")), F.struct(F.lit(v).alias("type"))) for k, v in _ISSUES.items())))
    return W.verdicts(C.latest_units(spark, sf_dir).select(F.expr(_DECISION).alias("decision"), issues.alias("issues")), "decision", "issues")


_TOTAL = "case when o_orderkey % 7 = 0 then null when o_orderkey % 5 = 0 then 'n/a' when o_orderkey % 3 = 0 then '12,' || (o_orderkey % 900 + 100)::varchar else o_totalprice::varchar end"
_RULES = "case when o_orderkey % 2 = 0 then '' else 'R1' end"


@query(
    sql=f"""with t as (select o_orderkey, {_TOTAL} as total, {_RULES} as rules, o_orderstatus as status from orders) select o_orderkey, case when coalesce(trim(total), '') = '' and coalesce(trim(rules), '') = '' then 'missing:any' else array_to_string(list_filter([
    case when coalesce(trim(total), '') <> '' and try_cast(replace(trim(total), ',', '') as double) is null then 'number:total' end, case when coalesce(trim(status), '') <> '' and trim(status) not in ('O', 'F') then 'enum:status' end], lambda x: x is not null), ',') end as errors from t"""
)
def contract_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of rows of contract truth, made of the orders."""
    t = table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_TOTAL.replace("::varchar", "::string")).alias("total"), F.expr(_RULES).alias("rules"), F.col("o_orderstatus").alias("status"))
    bad = W.contract_errors([F.col("total"), F.col("rules")], {"total": F.col("total")}, {"status": (F.col("status"), ["O", "F"])})
    return t.select("o_orderkey", F.array_join(bad, ",").alias("errors"))


_QUOTE = {"entry": "case when l_linenumber = 6 then '' else l_returnflag end", "price": "case when l_linenumber = 5 then ' ' else 'p' end", "is_pit": "case l_linenumber % 4 when 0 then '0' when 1 then '1 ' when 2 then '' else '2' end"}
_QUOTE_COLS = ", ".join(f"{v} as {k}" for k, v in _QUOTE.items())


@query(
    sql=f"""with t as (select l_orderkey, l_linenumber, {_QUOTE_COLS} from lineitem) select l_orderkey, l_linenumber, case when coalesce(trim(price), '') = '' then 'missing:price' when coalesce(trim(is_pit), '') <> '' and trim(is_pit) not in ('0', '1') then 'form:is_pit' end as error
    from t where coalesce(trim(entry), '') <> ''"""
)
def quote_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each row of quote truth, made of the lines of orders; rows without entry are passed over."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(F.expr(v).alias(k) for k, v in _QUOTE.items())).where(~V.blank(F.col("entry")))
    return t.select("l_orderkey", "l_linenumber", W.quote_error(F.col("price"), F.col("is_pit")).alias("error"))


_BATCH = "coalesce(category, '') || substr(id, length(id) - 1, 2)"
_BAD = "coalesce(trim(answer), '') = '' or length(answer) < 30"


@query(sql=f"with {C.ENTRY_SQL}, b as (select id, {_BATCH} as batch, {_BAD} as bad from entry) select id, batch from b where batch not in (select batch from b where bad)")
def all_or_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the batches without a defective entry."""
    b = C.entries(spark, sf_dir).select("id", F.expr(_BATCH).alias("batch"), F.when(F.expr(_BAD), "answer").alias("error"))
    return W.whole_batches(b, "batch", F.col("error")).select("id", "batch")


_SINCE = "timestamp '2026-03-01 00:00:00'"


@query(sql=f"select log_id, ku_id, count(*) as n from usage_log_entry n where received_at >= {_SINCE} and not exists (select 1 from usage_log_entry b where b.received_at < {_SINCE} and b.log_id = n.log_id and b.ku_id = n.ku_id) group by all")
def append_truth_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows since a date that weren't there before; those that came twice stay twice."""
    u = table(spark, sf_dir, "usage_log_entry")
    return W.append_truth(u.where(f"received_at < {_SINCE}"), u.where(f"received_at >= {_SINCE}"), "log_id", "ku_id").groupBy("log_id", "ku_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    sql="""with u as (select distinct doc_id from documents), c as (select doc_id, count(distinct label) as c from labels where doc_id is not null group by doc_id), j as (select u.doc_id as u, c.doc_id as k, c.c from u full join c on u.doc_id = c.doc_id)
    select count(u) as n_universe, count(k) as n_classified, count(*) filter (c > 1) as n_twice, count(*) filter (u is null) as n_outside, count(*) filter (k is null) as n_rest, count(*) filter (c > 1) = 0 and count(*) filter (u is null) = 0 as proven from j"""
)
def coverage_proof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the labels divide the labelled documents into classes without overlap."""
    return W.coverage_proof(table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents"), "doc_id", "label")


@query(
    sql="""with a as (select doc_id, text as t0, replace(text, '防水', '止水') as t1, text is not null and contains(text, '瓷砖') as touched from documents) select count(*) filter (not touched and t0 is distinct from t1) as n_lost, count(*) filter (not touched and t0 is distinct from t1) as n_new from a"""
)
def untouched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that a replacement changed although they aren't on its list."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    after = repair.apply_ops(d, d.select("doc_id", F.lit(1).alias("op_no"), F.lit("防水").alias("old"), F.lit("止水").alias("new")), "doc_id")
    return W.unchanged(d, after, d.where("contains(text, '瓷砖')"), "doc_id")


@query(sql="with d as (select source_ku_id as k, max(created_at) as data_time from ku_relations_v1 group by 1), i as (select ku_id as k, max(updated_at) as index_time from knowledge_unit group by 1) select d.k as ku_id, data_time, index_time, coalesce(index_time >= data_time, false) as fresh from d left join i on d.k is not distinct from i.k")
def index_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each unit was updated since its latest edge."""
    r = table(spark, sf_dir, "ku_relations_v1").withColumnRenamed("source_ku_id", "ku_id")
    return W.fresh(r, table(spark, sf_dir, "knowledge_unit"), "ku_id", "created_at", "updated_at")


@query(sql=f"with {C.UNIT_SQL} select ku_id, title from unit where ku_id in ('GZ-SY-00001', 'GZ-SY-00043', 'GZ-SY-00164', 'GZ-SY-00330') order by ku_id limit 3")
def pick_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first of some units by id."""
    return W.picked(C.latest_units(spark, sf_dir).select("ku_id", "title"), "ku_id", ["GZ-SY-00001", "GZ-SY-00043", "GZ-SY-00164", "GZ-SY-00330"], 3)


@query(sql=f"select distinct doc_id from documents where text is not null and doc_id not in (select doc_id from documents where crawled_at < {_SINCE} and doc_id is not null)")
def resume_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents left to work on after those crawled before a date."""
    d = table(spark, sf_dir, "documents")
    return W.remaining(d.where("text is not null").select("doc_id").distinct(), d.where(f"crawled_at < {_SINCE}"), "doc_id")


@query(sql=f"with {C.UNIT_SQL} select stage, count(*) as n, count(*) filter (metadata.quality_level in {tuple(K.RELIABLE)}) as n_reliable from unit group by stage")
def reliable_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each stage, and those that are reliable or better."""
    return K.reliable_counts(C.latest_units(spark, sf_dir), "stage")


_CODES = {"stage": K.STAGES, "trade": [*K.TRADES, "TRADE_GARDEN"], "material": K.MATERIALS}
_DIMS = " union all ".join(f"select '{d}' as dim, unnest({codes}) as key" for d, codes in _CODES.items())


@query(
    sql=f"""with {C.UNIT_SQL}, code as ({_DIMS}), one as (select 'stage' as dim, stage as key from unit union all select 'trade', unnest(trade) from unit union all select 'material', unnest(material) from unit),
    n as (select dim, key, count(*) as n from one where key is not null group by all), j as (select dim, key, coalesce(n, 0) as n from code left join n using (dim, key))
    select dim, key, n, case when n = 0 then 'P0' else 'P1' end as priority from j where n < 60"""
)
def gap_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes without units (P0) and with few (P1; here under sixty)."""
    return K.recommendations(K.counts_by_dimension(C.latest_units(spark, sf_dir)), K.universe(spark, _CODES), 60)
