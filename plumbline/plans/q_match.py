"""Matching and measuring queries: substring, prefix and range joins, accuracy, recall by provider, quotes, replayed logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators import changelog
from plumbline.operators import evaluation as E
from plumbline.operators.textops import name_key
from plumbline.plans import corpora as C
from plumbline.plans.registry import query
from plumbline.session import table

_KEY_SQL = "regexp_replace(lower({}), '[^0-9a-z一-鿿]', '', 'g')"


@query(
    sql=f"""with {C.UNIT_SQL}, w as (select distinct stage, unnest(trigger_keywords) as word from unit), t as (select distinct stage, {_KEY_SQL.format("title")} as name from unit)
    select stage, word, name from w join t using (stage) where contains(word, name) or contains(name, word)"""
)
def names_in_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords and titles of a stage of which one is part of the other."""
    u = C.latest_units(spark, sf_dir)
    words = u.select("stage", F.explode("trigger_keywords").alias("word")).distinct()
    return E.either_contains(words, u.select("stage", name_key(F.col("title")).alias("name")).distinct(), "stage", "word", "name").select("stage", "word", "name")


_PARTS = ["GZ", "GZ-SY", "GZ-SY-00012", "GZ-S", "LOG", "QZ"]


@query(sql=f"with s as (select distinct ku_id from usage_log_entry where ku_id is not null), k as (select unnest({_PARTS}) as known) select ku_id, known from s join k on ku_id = known or starts_with(ku_id, known || '-')")
def prefix_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that are or begin with one of some ids."""
    known = spark.createDataFrame([(k,) for k in _PARTS], "known string")
    return E.prefix_join(table(spark, sf_dir, "usage_log_entry").select("ku_id").distinct(), "ku_id", known, "known", "-").select("ku_id", "known")


_PEAKS = [("morning", 9, 12), ("afternoon", 14, 18)]


@query(
    sql="""with h as (select distinct log_id, hour(logged_at + interval 8 hour) as h from usage_log_entry) select case when h is null then null when h >= 9 and h < 12 then 'morning' when h >= 14 and h < 18 then 'afternoon' else 'valley' end as part, count(*) as n from h group by 1"""
)
def peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries by window of the local hour (UTC+8)."""
    h = table(spark, sf_dir, "usage_log_entry").select("log_id", F.hour(F.col("logged_at").cast("timestamp") + F.expr("interval 8 hours")).alias("h")).distinct()
    return h.groupBy(E.in_window(F.col("h"), _PEAKS, "valley").alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query(
    sql="""with j as (select l_orderkey, l_linenumber, l_extendedprice / l_quantity as v, p_retailprice * 0.9e0 as lo, p_retailprice * 1.1e0 as hi from lineitem join part on l_partkey = p_partkey)
    select l_orderkey, l_linenumber, round(case when v < lo then (lo - v) / lo * 100 when v > hi then (v - hi) / hi * 100 else 0 end, 4) as off, case when v < lo then 'low' when v > hi then 'high' end as side from j"""
)
def range_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each line's unit price lies outside of the range of its part's."""
    j = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    off, side = E.from_range(F.col("l_extendedprice") / F.col("l_quantity"), F.col("p_retailprice") * 0.9, F.col("p_retailprice") * 1.1)
    return j.select("l_orderkey", "l_linenumber", F.round(off, 4).alias("off"), side.alias("side"))


_LANG = "case when contains(text, '。') then 'zh' when contains(text, 'The') then 'en' else '' end"


@query(
    sql=f"""with f as (select 'n_chars' as field, n_chars is not null as said, true as given, case when length(text) = 0 then n_chars = 0 else abs(n_chars - length(text)) <= 0.05 * length(text) end as ok from documents where text is not null
    union all select 'lang', true, {_LANG} <> '', lang = {_LANG} from documents where text is not null)
    select field, count(*) as n, count(*) filter (coalesce(ok, false)) as n_right, round(count(*) filter (coalesce(ok, false)) / count(*)::double, 6) as accuracy from f where given group by field"""
)
def accuracy_by_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often stated length and language are right, blank truths left out."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    return E.accuracy(d, {"n_chars": (F.col("n_chars").cast("string"), F.length("text").cast("string"), "number"), "lang": (F.col("lang"), F.expr(_LANG), "code")})


_CELLS_SQL = f"""{C.UNIT_SQL}, t as (select stage as s, {_KEY_SQL.format("w")} as entry from (select stage, unnest(trigger_keywords) as w from unit)),
    i as (select distinct coalesce(source_channel, '') as provider, stage || '_' || (length(log_id) % 2) as sample, {_KEY_SQL.format("coalesce(user_query, '')")} as name from usage_log_entry join unit using (ku_id)),
    c as (select distinct provider, sample, t.s from i join t on sample = t.s or starts_with(sample, t.s || '_')),
    m as (select provider, sample, count(*) as n_truth, count(*) filter (entry <> '' and exists (select 1 from i where i.provider = c.provider and i.sample = c.sample and i.name <> '' and (contains(i.name, t.entry) or contains(t.entry, i.name)))) as matched from c join t using (s) group by all)"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = C.latest_units(spark, sf_dir)
    truth = u.select(F.col("stage").alias("sample"), F.explode("trigger_keywords").alias("w")).select("sample", name_key(F.col("w")).alias("entry"))
    sample = F.concat("stage", F.lit("_"), (F.length("log_id") % 2).cast("string"))
    items = table(spark, sf_dir, "usage_log_entry").join(u.select("ku_id", "stage"), "ku_id").select(F.coalesce("source_channel", F.lit("")).alias("provider"), sample.alias("sample"), name_key(F.coalesce("user_query", F.lit(""))).alias("name"))
    return E.recall_by_provider(truth, items)


@query(sql=f"with {_CELLS_SQL} select provider, sample, matched, n_truth from m")
def recall_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of each stage that each channel's queries name."""
    return _cells(spark, sf_dir)


@query(sql=f"with {_CELLS_SQL}, p as (select provider, sum(matched)::bigint as matched, sum(n_truth)::bigint as n_truth, round(sum(matched) / sum(n_truth)::double, 4) as recall from m group by provider) select *, max(recall) over () as best from p")
def recall_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all stages, beside the best channel's."""
    return E.micro_recall(_cells(spark, sf_dir))


_CHANNELS = ["web", "miniapp", "api_direct", "qa_batch", "fax"]


@query(
    sql=f"""with u as (select distinct log_id, source_channel, user_helpful, length(response_snippet) as items, length(user_query) as warnings from usage_log_entry), p as (select unnest({_CHANNELS}) as provider)
    select provider, count(log_id) as n_ok, round(avg(items), 1) as avg_items, round(avg(warnings), 1) as avg_warnings from p left join u on source_channel = provider and user_helpful group by provider"""
)
def averages_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over the helpful entries of each channel, channels without any included."""
    u = table(spark, sf_dir, "usage_log_entry").select("log_id", F.col("source_channel").alias("provider"), "user_helpful", F.length("response_snippet").alias("items"), F.length("user_query").alias("warnings")).distinct()
    return E.provider_averages(u, spark.createDataFrame([(c,) for c in _CHANNELS], "provider string"), F.col("user_helpful"), ["items", "warnings"])


@query()
def quote_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of quotes: the odd lines of each order as truth, its even lines as what was read."""
    l = table(spark, sf_dir, "lineitem").withColumn("name", F.concat("l_returnflag", F.when(F.col("l_partkey") % 3 == 0, "").otherwise((F.col("l_partkey") % 3).cast("string"))))
    t = l.where("l_linenumber % 2 = 1").select(
        F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("row_no"), F.col("name").alias("entry"), F.when(F.col("l_linenumber") != 5, F.col("l_extendedprice").cast("string")).alias("price"),
        F.when(F.col("l_linestatus") == "O", "1").otherwise("0").alias("is_pit"), F.when(F.col("l_partkey") % 2 == 0, "missing").alias("pit_type"),
    )
    i = l.where("l_linenumber % 2 = 0").select(F.col("l_orderkey").alias("sample"), F.col("l_linenumber").alias("item_no"), F.col("name").alias("item"), F.col("l_extendedprice").cast("string").alias("unit_price"), F.when(F.col("l_suppkey") % 4 == 0, "warning: high").otherwise("ok").alias("status"))
    return E.quote_measures(t, i, l.where("l_linenumber = 7").select(F.col("l_orderkey").alias("sample"), "name"))


@query()
def effect_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of the events of each user, taken as effects in batches of twenty; errors roll back an effect, a batch or all."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    n = F.col("event_id")
    op = F.when(F.col("event_type") != "error", "apply").when(n % 7 == 0, "rollback_all").when(n % 3 == 0, "rollback_batch").otherwise("rollback")
    at = F.when(op == "apply", n).otherwise(n - 900)
    log = e.select(
        F.col("user_id").alias("registry"), n.alias("seq"), op.alias("op"), F.concat(F.lit("e"), F.floor(at / 20).cast("string")).alias("effect_id"), F.floor(at / 200).cast("string").alias("batch_id"), (n % 11 != 0).alias("guard"),
        (n % 5 != 0).alias("undo_guard"), (n % 13 == 0).alias("protected"), (n % 17 == 0).alias("forced"), (n % 2 == 0).alias("guarded"), (n % 19 == 0).alias("fails"),
    )
    return changelog.replay(log)


_PATCH_SQL = "p as (select user_id || '-' || (event_id % 7) as key, event_id as seq, case event_type when 'signup' then 'add' when 'error' then 'remove' else 'update' end as op, event_type as field, value::varchar as v, 'n' || (event_id % 3) as field2 from events where user_id is not null)"


@query(
    sql=f"""with {_PATCH_SQL}, b as (select key, max(seq) as position, arg_max(op, seq) as op from p where op in ('add', 'remove') group by key), w as (select key, seq, unnest([field, field2]) as field, event from (select *, seq as event from p where op <> 'remove'))
    select key, field, max(event)::varchar as value, position from w join (select key, position from b where op = 'add') using (key) where seq >= position group by key, field, position"""
)
def record_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of the records that a log of additions, patches and removals leaves."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    n = F.col("event_id")
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type") == "error", "remove").otherwise("update")
    patch = F.create_map(F.col("event_type"), n.cast("string"), F.concat(F.lit("n"), (n % 3).cast("string")), n.cast("string"))
    log = e.select(F.concat(F.col("user_id").cast("string"), F.lit("-"), (n % 7).cast("string")).alias("key"), n.alias("seq"), op.alias("op"), patch.alias("patch"))
    return changelog.patched(log)
