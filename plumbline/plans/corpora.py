"""Views of the test tables that several queries share, each in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.tokens import tokens, tokens_sql
from plumbline.session import table


# Columns that decide between versions of one time.
_TIES = ("title", "description", "severity")


def latest_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of each unit with the latest ``updated_at``."""
    u = table(spark, sf_dir, "knowledge_unit")
    return u.groupBy("ku_id").agg(F.max_by(F.struct(*[c for c in u.columns if c != "ku_id"]), F.struct("updated_at", *(F.coalesce(c, F.lit("")) for c in _TIES)).alias("o")).alias("v")).select("ku_id", "v.*")


UNIT_SQL = "unit as (select * from knowledge_unit qualify row_number() over (partition by ku_id order by updated_at desc, coalesce(title, '') desc, coalesce(description, '') desc, coalesce(severity, '') desc) = 1)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The imported entries, the earliest import of each id."""
    e = table(spark, sf_dir, "knowledge_yuanqi_import")
    return e.groupBy("id").agg(F.min_by(F.struct("category", "tags", "question", "answer", "source_file", "imported_at"), F.struct("imported_at", F.coalesce("question", F.lit("")), F.coalesce("answer", F.lit("")))).alias("v")).select("id", "v.*")


ENTRY_SQL = "entry as (select * from knowledge_yuanqi_import qualify row_number() over (partition by id order by imported_at, coalesce(question, ''), coalesce(answer, '')) = 1)"


def unit_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as documents of an index: ``id, title, body, keywords, keyword_text, stage, trade, severity``."""
    u = latest_units(spark, sf_dir)
    body = F.concat_ws(" ", "title", F.substring("typical_scenario", 1, 200), F.substring("how_to_avoid", 1, 150))
    return u.select(F.col("ku_id").alias("id"), "title", body.alias("body"), F.col("trigger_keywords").alias("keywords"), F.coalesce(F.array_join("trigger_keywords", " "), F.lit("")).alias("keyword_text"), "stage", "trade", "severity")


def searches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose id is divisible by 100: ``qid, question``."""
    e = entries(spark, sf_dir)
    return e.where((F.substring("id", 2, 20).cast("bigint") % 100 == 0) & F.col("question").isNotNull()).select(F.col("id").alias("qid"), "question")


def unit_tokens() -> "F.Column":
    return tokens(F.col("body"), F.col("keywords"))


INDEX_SQL = f"""
with {UNIT_SQL}, {ENTRY_SQL},
doc as (select ku_id as id, title, stage, trade, severity, coalesce(array_to_string(trigger_keywords, ' '), '') as keyword_text, trigger_keywords as keywords,
        concat_ws(' ', title, substr(typical_scenario, 1, 200), substr(how_to_avoid, 1, 150)) as body from unit),
tok as (select id, unnest({tokens_sql("body", "keywords")}) as term from doc),
post as (select id, term, count(*) as tf from tok group by id, term),
len as (select doc.id, coalesce(sum(tf), 0)::double as dl from doc left join post using (id) group by doc.id),
corpus as (select count(*)::double as n, avg(dl) as avgdl from len),
terms as (select term, count(*)::double as df from post group by term),
search as (select id as qid, question from entry where cast(substr(id, 2) as bigint) % 100 = 0 and question is not null),
asked as (select qid, term, count(*)::double as qm from (select qid, unnest({tokens_sql("question")}) as term from search) group by qid, term)
"""
BM25_SQL = """
bm as (select qid, id, round(sum(qm * ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
       from post join asked using (term) join terms using (term) join len using (id), corpus group by qid, id having score > 0),
bm_top as (select *, row_number() over (partition by qid order by score desc, id) as rank from bm)
"""
TFIDF_SQL = """
idf as (select term, ln((n + 1.0) / (df + 1.0)) + 1.0 as idf from terms, corpus),
weight as (select id, term, (1.0 + ln(tf)) * idf as w from post join idf using (term)),
norm as (select id, sqrt(sum(w * w)) as norm from weight group by id),
qweight as (select qid, term, (1.0 + ln(qm)) * idf as qw from asked join idf using (term)),
qnorm as (select qid, sqrt(sum(qw * qw)) as qnorm from qweight group by qid),
ti as (select qid, id, round(sum(w * qw) / (any_value(norm) * any_value(qnorm)), 6) as score from weight join qweight using (term) join norm using (id) join qnorm using (qid) group by qid, id having sum(w * qw) > 0),
ti_top as (select *, row_number() over (partition by qid order by score desc, id) as rank from ti)
"""
FUSE_SQL = """
fused as (select *, row_number() over (partition by qid order by rrf desc, rank_a asc nulls last, rank_b asc nulls last, id) as fused_rank from (
  select coalesce(a.qid, b.qid) as qid, coalesce(a.id, b.id) as id, a.rank as rank_a, b.rank as rank_b,
         round(coalesce(1.0::double / (60 + a.rank), 0.0) + coalesce(1.0::double / (60 + b.rank), 0.0), 9) as rrf
  from (select * from bm_top where rank <= 15) a full join (select * from ti_top where rank <= 15) b on a.qid = b.qid and a.id = b.id))
"""
RERANK_SQL = f"""
own as (select qid, case when len(list_filter(t, lambda x: length(x) >= 2)) > 0 then list_filter(t, lambda x: length(x) >= 2) else t end as terms
        from (select qid, list_distinct({tokens_sql("question")}) as t from search)),
final as (select qid, id, rank_a, rank_b, fused_rank,
  round(0.40 * len(list_filter(terms, lambda t: contains(coalesce(title, ''), t)))::double / greatest(len(terms), 1)
      + 0.30 * len(list_filter(terms, lambda t: contains(keyword_text, t)))::double / greatest(len(terms), 1)
      + 0.10 * (case severity when 'SEV_CRITICAL' then 1.3::double when 'SEV_HIGH' then 1.15::double when 'SEV_MEDIUM' then 1.0::double when 'SEV_LOW' then 0.9::double else 1.0::double end - 0.9::double) / 0.4::double
      + 0.20 * case when rank_a is not null and rank_b is not null then 1.0::double / (1.0 + 0.2::double * ((rank_a + rank_b) / 2.0::double)) else 0.5::double / (1.0 + 0.2::double * coalesce(rank_a, rank_b)) end
      + 0.5 * rrf, 5) as final_score
  from fused join doc using (id) join own using (qid))
"""
