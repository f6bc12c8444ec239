"""Change log, folds over time, repair, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from plumbline.operators import anchors, changelog, evaluation, folds, repair
from plumbline.plans import corpora as C
from plumbline.plans import q_retrieval
from plumbline.plans.registry import query
from plumbline.session import table

# The stream of events as a change log: each user is a registry; an error undoes all of the user's effects of the 600 events before it.
_EFFECT_SQL = """effect as (select user_id as registry, event_id as seq, user_id || '-' || (event_id % 5) as key, lag(value) over (partition by user_id, event_id % 5 order by event_id) as before,
  case when event_type = 'signup' then null else value end as after from events where event_type <> 'error'),
undo as (select user_id as registry, event_id as undo_seq, event_id - 600 as target_seq from events where event_type = 'error'),
fate as (select registry, seq, min(undo_seq) as undo_seq from effect join undo using (registry) where undo_seq > seq and target_seq <= seq group by registry, seq)"""


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id", F.col("event_id") % 5).orderBy("event_id")
    effects = e.where("event_type <> 'error'").select(
        F.col("user_id").alias("registry"), F.col("event_id").alias("seq"), F.concat_ws("-", F.col("user_id").cast("string"), (F.col("event_id") % 5).cast("string")).alias("key"),
        F.lag("value").over(w).alias("before"), F.when(F.col("event_type") != "signup", F.col("value")).alias("after"),
    )
    undos = e.where("event_type = 'error'").select(F.col("user_id").alias("registry"), F.col("event_id").alias("undo_seq"), (F.col("event_id") - 600).alias("target_seq"))
    return effects, undos


@query(
    sql=f"""with {_EFFECT_SQL}, w as (select registry, key, seq as w_at, 0 as pos, after as value from effect union all select registry, key, undo_seq, -seq, before from effect join fate using (registry, seq))
    select registry, key, value from (select *, row_number() over (partition by registry, key order by w_at desc, pos desc) as n from w) where n = 1 and value is not null"""
)
def changelog_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values after all effects and undos."""
    return changelog.state(*_log(spark, sf_dir))


@query(sql=f"with {_EFFECT_SQL} select registry, count(*) as n_effects, count(undo_seq) as n_undone from effect left join fate using (registry, seq) group by registry")
def changelog_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Effects of each registry, and how many were taken back."""
    return changelog.undone(*_log(spark, sf_dir)).groupBy("registry").agg(F.count(F.lit(1)).alias("n_effects"), F.count("undo_seq").alias("n_undone"))


@query(sql="select user_id, event_id, rank from (select user_id, event_id, row_number() over (partition by user_id order by event_id desc) as rank from events) where rank <= 20")
def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last twenty events of each user."""
    return changelog.recent(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 20)


_NUMBERED = "e as (select user_id, event_id, epoch_us(ts) as t, event_type = 'error' as bad, row_number() over (partition by user_id order by ts, event_id) as n from events where user_id is not null and ts is not null)"
_SIX_HOURS = 6 * 3600


@query(
    sql=f"""with recursive {_NUMBERED}, r as (
      select user_id, n, [t] as seen, true as ok from e where n = 1
      union all
      select e.user_id, e.n, case when len(k) < 2 then list_append(k, e.t) else k end, len(k) < 2
      from (select r.user_id, r.n, e2.event_id, list_filter(r.seen, lambda x: e2.t - x <= {_SIX_HOURS}000000) as k from r join e e2 on e2.user_id = r.user_id and e2.n = r.n + 1) s join e on e.user_id = s.user_id and e.n = s.n + 1)
    select e.user_id, event_id, ok as accepted from r join e using (user_id, n)"""
)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events let through by a limit of two in six hours for each user."""
    return folds.rate_limit(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", 2, _SIX_HOURS)


@query(
    sql=f"""with recursive {_NUMBERED}, r as (
      select user_id, n, case when bad then 1 else 0 end as fails, null::bigint as until, case when bad then 'failed' else 'ok' end as outcome from e where n = 1
      union all
      select e.user_id, e.n,
        case when r.until is not null and e.t < r.until then r.fails when not e.bad then 0 when r.until is not null then 1 else r.fails + 1 end,
        case when r.until is not null and e.t < r.until then r.until when e.bad and (case when r.until is not null then 0 else r.fails end) + 1 >= 2 then e.t + 10800000000 end,
        case when r.until is not null and e.t < r.until then 'blocked' when e.bad then 'failed' else 'ok' end
      from r join e on e.user_id = r.user_id and e.n = r.n + 1)
    select e.user_id, event_id, outcome from r join e using (user_id, n)"""
)
def breaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a breaker that opens for three hours after two errors in a row."""
    e = table(spark, sf_dir, "events").withColumn("bad", F.col("event_type") == "error")
    return folds.breaker(e, "user_id", "ts", "event_id", "bad", 2, 3 * 3600)


@query(
    sql=f"""with recursive {_NUMBERED}, r as (
      select user_id, n, t as put, false as hit from e where n = 1
      union all
      select e.user_id, e.n, case when e.t - r.put < {_SIX_HOURS}000000 then r.put else e.t end, e.t - r.put < {_SIX_HOURS}000000 from r join e on e.user_id = r.user_id and e.n = r.n + 1)
    select e.user_id, event_id, hit from r join e using (user_id, n)"""
)
def ttl_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a cache whose values live six hours from when they are put in."""
    return folds.ttl_cache(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", _SIX_HOURS)


@query()
def lru_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a cache of twenty users for each kind of event, six hours long."""
    return folds.lru_cache(table(spark, sf_dir, "events"), "event_type", "user_id", "ts", "event_id", _SIX_HOURS, 20)


@query(
    sql="""with s as (select ku_id as user, logged_at, log_id, user_query from (select distinct on (log_id) * from usage_log_entry order by log_id, received_at, coalesce(ku_id, '')) where ku_id is not null and logged_at is not null),
    r as (select user, user_query, row_number() over (partition by user order by logged_at desc, log_id desc) as n, logged_at, log_id from s where user_query is not null)
    select s.user, min(logged_at) as first_seen, max(logged_at) as last_seen, count(*) as n_sessions, any_value(l.latest) as latest, any_value(coalesce(l.recent_values, [])) as recent_values from s
    left join (select user, arg_max(user_query, (logged_at, log_id)) as latest, list(user_query order by logged_at, log_id) as recent_values from r where n <= 3 group by user) l on l.user = s.user group by s.user"""
)
def session_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last use of each unit, the latest query and the last three."""
    u = table(spark, sf_dir, "usage_log_entry")
    first = u.groupBy("log_id").agg(F.min_by(F.struct("ku_id", "logged_at", "user_query"), F.struct("received_at", F.coalesce("ku_id", F.lit("")))).alias("v")).select("log_id", "v.*")
    return folds.sessions(first, "ku_id", "logged_at", "log_id", "user_query", 3)


_DAY8 = "strftime(logged_at + interval 8 hour, '%Y-%m-%d')"


@query(
    sql=f"""with u as (select distinct on (log_id) * from usage_log_entry order by log_id, received_at, coalesce(ku_id, '')) select {_DAY8} as day, source_channel, count(*) as n, count(*) filter (user_helpful) as helpful, count(distinct ku_id) as n_units,
    count(*) filter (received_at - logged_at > interval 1 day) as late from u group by all"""
)
def usage_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Use by local day (UTC+8) and channel, entries sent twice counted once."""
    u = table(spark, sf_dir, "usage_log_entry")
    u = u.groupBy("log_id").agg(F.min_by(F.struct("logged_at", "received_at", "source_channel", "user_helpful", "ku_id"), F.struct("received_at", F.coalesce("ku_id", F.lit("")))).alias("v")).select("log_id", "v.*")
    late = F.col("received_at").cast("timestamp") - F.col("logged_at").cast("timestamp") > F.expr("interval 1 day")
    day = F.date_format(F.col("logged_at").cast("timestamp") + F.expr("interval 8 hours"), "yyyy-MM-dd")
    return u.groupBy(day.alias("day"), "source_channel").agg(F.count(F.lit(1)).alias("n"), F.count_if("user_helpful").alias("helpful"), F.countDistinct("ku_id").alias("n_units"), F.count_if(late).alias("late"))


# ---- repair: each document's eleventh to sixteenth characters are the anchor of its first op, each "防水" of its second
_OPS_SQL = "op as (select doc_id, 1 as op_no, substr(text, 11, 6) as old, '〔改〕' as new from documents where length(text) > 20 union all select doc_id, 2, '防水', '止水' from documents where length(text) > 20)"


def _ops(docs: DataFrame) -> DataFrame:
    long = docs.where(F.length("text") > 20)
    first = long.select("doc_id", F.lit(1).alias("op_no"), F.substring("text", 11, 6).alias("old"), F.lit("〔改〕").alias("new"))
    return first.unionByName(long.select("doc_id", F.lit(2).alias("op_no"), F.lit("防水").alias("old"), F.lit("止水").alias("new")))


@query(sql=f"with {_OPS_SQL}, h as (select doc_id, op_no, ((length(text) - length(replace(text, old, ''))) / length(old))::bigint as hits from op join documents using (doc_id)) select doc_id, op_no, hits, hits = 1 as valid from h")
def patch_anchor_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each op's anchor stands in its document once."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repair.check_anchors(d, _ops(d), "doc_id")


@query(sql="select doc_id, md5(case when length(text) > 20 then replace(replace(text, substr(text, 11, 6), '〔改〕'), '防水', '止水') else text end) as text_md5 from documents")
def patch_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document after its ops."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return repair.apply_ops(d, _ops(d), "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


_CENSUS = ["防水", "瓷砖", "，", "。", "mm"]


@query(sql=" union all ".join(f"select '{w}' as needle, sum((length(text) - length(replace(text, '{w}', ''))) / {len(w)})::bigint as n from documents" for w in _CENSUS))
def char_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of occurrences of some signs and words in all documents, in one pass."""
    counts = F.array(*(F.struct(F.lit(w).alias("needle"), repair.count_of(F.col("text"), F.lit(w)).alias("n")) for w in _CENSUS))
    return table(spark, sf_dir, "documents").select(F.explode(counts).alias("x")).groupBy("x.needle").agg(F.sum("x.n").alias("n"))


@query(
    sql="""with p as (select doc_id, unnest(list_filter(range(1, length(text)), lambda i: substr(text, i, 2) = '，要')) as pos from documents where length(text) >= 2),
    g as (select *, case when pos - lag(pos) over (partition by doc_id order by pos) > 45 then 1 else 0 end as new from p), c as (select *, sum(new) over (partition by doc_id order by pos) as cluster_no from g)
    select doc_id, cluster_no::bigint as cluster_no, min(pos) as first, max(pos) as last, count(*) as n from c group by doc_id, cluster_no"""
)
def position_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of a phrase's places in each document, split at gaps of more than 45 characters."""
    p = table(spark, sf_dir, "documents").select("doc_id", F.explode(repair.find_all(F.col("text"), F.lit("，要"))).alias("pos"))
    return repair.clusters(p, "doc_id", "pos", 45)


_SPANS_SQL = "sp as (select l_orderkey as o, (l_partkey % 200)::bigint as s, (l_partkey % 200 + l_quantity)::bigint as e, l_linenumber from lineitem)"


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), (F.col("l_partkey") % 200).alias("s"), (F.col("l_partkey") % 200 + F.col("l_quantity")).cast("bigint").alias("e"), "l_linenumber")


@query(sql=f"with {_SPANS_SQL} select distinct o, s, e from (select *, max(e) over (partition by o order by s, e rows between unbounded preceding and 1 preceding) as upto from sp) where upto >= s")
def window_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans that overlap one that begins before."""
    return repair.overlapping(_spans(spark, sf_dir), "o", "s", "e").select("o", "s", "e").distinct()


@query(
    sql=f"""with {_SPANS_SQL}, b as (select *, max(e) over (partition by o order by s, e rows between unbounded preceding and 1 preceding) as upto from sp),
    g as (select *, sum(case when upto is null or s > upto + 1 then 1 else 0 end) over (partition by o order by s, e rows unbounded preceding) as g from b) select o, min(s) as s, max(e) as e, count(*) as n from g group by o, g"""
)
def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping and adjacent spans as one."""
    return repair.merged(_spans(spark, sf_dir), "o", "s", "e")


@query(
    sql="""with c as (select text as a, translate(text, '的了在不', '地啦再未') as b from documents where text is not null),
    z as (select unnest(string_split(a, '')) as x, unnest(string_split(b, '')) as y from c where length(a) = length(b)) select x as old_char, y as new_char, count(*) as n from z where x <> y group by x, y"""
)
def substitution_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters exchanged in all documents by a fixed substitution."""
    d = table(spark, sf_dir, "documents").select(F.col("text").alias("a"), F.translate("text", "的了在不", "地啦再未").alias("b"))
    return repair.substitutions(d, "a", "b")


_RECORDS = "case doc_id % 4 when 0 then substr(text, 101, 20) when 1 then substr(text, 101, 8) || '...' || substr(text, 125, 8) when 2 then substr(text, 101, 10) || '改' || substr(text, 112, 9) else '同字段第二处' end"


@query()
def anchor_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of one edit of each long document by its noted context, which is whole, shortened, misspelt or only a note."""
    d = table(spark, sf_dir, "documents").where(F.length("text") > 200).select("doc_id", "text")
    records = d.select(F.col("doc_id").alias("rec_id"), F.col("doc_id").alias("id"), F.lit("text").alias("field"), F.expr(_RECORDS).alias("context"), F.substring("text", 104, 3).alias("old"), F.lit("〔改〕").alias("new"))
    return anchors.resolve(records, d.select(F.col("doc_id").alias("id"), F.lit("text").alias("field"), F.col("text").alias("body")))


@query(
    sql=f"""with {_OPS_SQL}, h as (select op.*, text, (length(text) - length(replace(text, old, ''))) / length(old) as hits from op join documents using (doc_id))
    select 'anchors' as name, count(*) filter (hits <> 1) as n_failed, count(*) filter (hits <> 1) = 0 as passed from h union all select 'replay', 0, true union all select 'untouched', 0, true union all select 'rows', 0, true union all
    select 'balance', 0, true"""
)
def patch_assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of the edits of the documents: anchors that don't stand once; all else is as it should be."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return anchors.assertions(d, repair.apply_ops(d, _ops(d), "doc_id"), _ops(d), "doc_id")


@query(sql="select doc_id, case when length(text) > 20 then md5(substr(text, 1, 14) || '〔改〕' || substr(text, 17)) else md5(text) end as text_md5 from documents")
def patch_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document after an edit at a place."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    edits = d.where(F.length("text") > 20).select("doc_id", F.lit(15).alias("pos"), F.substring("text", 15, 2).alias("old"), F.lit("〔改〕").alias("new"))
    return repair.apply_at(d, edits, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(
    sql=f"""with w as (select doc_id, unnest(list_transform({list(range(14, 91, 8))}, lambda s: {{'s': s, 'cut': substr(text, greatest(120 - s, 1), 120 + s - greatest(120 - s, 1) + 1)}})) as w, text from documents where length(text) >= 120),
    h as (select doc_id, w.s as s, w.cut as cut, (length(text) - length(replace(text, w.cut, ''))) / length(w.cut) as hits from w)
    select doc_id, arg_min(cut, s) filter (hits = 1) as unique_window from h group by doc_id"""
)
def unique_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrowest window around the 120th character of each document that stands in it once."""
    d = table(spark, sf_dir, "documents").where(F.length("text") >= 120)
    return d.select("doc_id", repair.unique_window(F.col("text"), F.lit(120)).alias("unique_window"))


@query(
    sql="""with c as (select text as a, translate(text, '的了在不', '地啦再未') as b from documents where text is not null),
    z as (select unnest(string_split(a, '')) as x, unnest(string_split(b, '')) as y from c where length(a) = length(b)), l as (select x, y, count(*) as n from z where x <> y group by x, y),
    s as (select y as char, n as gained, 0 as lost from l union all select x, 0, n from l) select char, sum(gained)::bigint as gained, sum(lost)::bigint as lost, (sum(gained) - sum(lost))::bigint as net from s group by char"""
)
def ledger_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each character gains and loses by the substitution; in all, nothing."""
    return repair.balance(substitution_ledger(spark, sf_dir))


@query(
    sql="""with c as (select w, sum((length(text) - length(replace(text, w, ''))) / length(w))::bigint as n_before, sum((length(replace(text, '防水', '止水')) - length(replace(replace(text, '防水', '止水'), w, ''))) / length(w))::bigint as n_after
    from documents, (select unnest(['防水', '止水', '水', '，']) as w) group by w) select w as needle, n_before, n_after, n_after = n_before + 0 as kept from c"""
)
def census_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words counted before and after a replacement, and whether their numbers are unchanged."""
    d = table(spark, sf_dir, "documents").select("text")
    return repair.census_gate(d, d.select(F.replace("text", F.lit("防水"), F.lit("止水")).alias("text")), dict.fromkeys(["防水", "止水", "水", "，"], 0))


@query(
    sql="select strftime(ts + interval 8 hour, '%Y-%m-%d') as day, event_type, count(*) as n, sum(round(value * 100)::bigint)::bigint as total_cents, (sum(round(value * 100)::bigint) // count(*))::bigint as mean_cents from events where value >= 0 group by all"
)
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number, sum and mean (whole cents) of the events' values by local day (UTC+8) and kind."""
    day = F.date_format(F.col("ts").cast("timestamp") + F.expr("interval 8 hours"), "yyyy-MM-dd")
    cents = F.round(F.col("value") * 100).cast("bigint")
    sums = table(spark, sf_dir, "events").where("value >= 0").groupBy(day.alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(cents).alias("total_cents"))
    return sums.withColumn("mean_cents", F.expr("total_cents div n"))


# ---- evaluation


@query(sql="select source, count(*) as n, count(n_chars) as stated, round(avg(case when length(text) = 0 then (n_chars = 0)::int else (abs(n_chars - length(text)) <= 0.05 * length(text))::int end), 6) as within, round(avg((n_chars = length(text))::int), 6) as exact from documents where text is not null group by source")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the stated length is right, exactly and within five per cent, by source."""
    d = table(spark, sf_dir, "documents").where("text is not null")
    n, true = F.col("n_chars"), F.length("text")
    return d.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("n_chars").alias("stated"), F.round(F.avg(evaluation.close(n, true, 0.05).cast("double")), 6).alias("within"), F.round(F.avg((n == true).cast("double")), 6).alias("exact"))


_RULE = "废物|畜生|人渣|滚|去死|scumbag|bitch|moron"
_VOTE_SQL = "v as (select doc_id, sum(case when label = 'clean' then -1 else 1 end) > 0 as bad from (select distinct * from labels) group by doc_id)"
_CONF_SQL = f"{_VOTE_SQL}, j as (select source, bad, regexp_matches(text, '{_RULE}') as said from v join documents using (doc_id) where text is not null)"


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "labels").distinct().groupBy("doc_id").agg((F.sum(F.when(F.col("label") == "clean", -1).otherwise(1)) > 0).alias("bad"))
    return v.join(table(spark, sf_dir, "documents").where("text is not null"), "doc_id").select("source", "bad", F.col("text").rlike(_RULE).alias("said"))


_MEASURES = "count(*) filter (bad and said) as tp, count(*) filter (not bad and said) as fp, count(*) filter (bad and not said) as fn"
_RATES = "case when tp + fn > 0 then round(tp::double / (tp + fn), 6) end as recall, case when tp + fp > 0 then round(fp::double / (tp + fp), 6) end as false_share"


@query(sql=f"with {_CONF_SQL}, m as (select source, {_MEASURES} from j group by source) select source, tp, fp, fn, {_RATES} from m")
def rule_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word rule against the reviewers' labels, by source."""
    return evaluation.confusion(_judged(spark, sf_dir), F.col("bad"), F.col("said"), "source")


@query(sql=f"with {_CONF_SQL}, m as (select {_MEASURES} from j) select tp, fp, fn, {_RATES} from m")
def recall_micro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over all sources."""
    return evaluation.confusion(_judged(spark, sf_dir), F.col("bad"), F.col("said"))


@query(
    sql=f"""with {C.ENTRY_SQL},
    want as (select distinct qid, word from (select id as qid, unnest({q_retrieval._HELD_SQL}) as word from entry where cast(substr(id, 2) as bigint) % 100 = 0)),
    hit as (select qid, e.id, sum(3 * (contains(coalesce(question, ''), word))::int + 2 * (contains(array_to_string(coalesce(tags, []), ' '), word))::int + (contains(coalesce(answer, ''), word))::int)::bigint as score from want, entry e group by qid, e.id),
    ranked as (select qid, id, row_number() over (partition by qid order by score desc, id) as rank from hit where score > 0),
    best as (select t.id as qid, min(rank) as best from (select id from entry where cast(substr(id, 2) as bigint) % 100 = 0 and question is not null) t left join ranked on ranked.qid = t.id and ranked.id = t.id and rank <= 3 group by t.id)
    select count(*) as n_queries, round(avg(coalesce((best <= 1)::int, 0)), 6) as top1, round(avg(coalesce((best <= 3)::int, 0)), 6) as top3 from best"""
)
def topk_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a search finds its own entry first or among the first three."""
    truth = C.searches(spark, sf_dir).select("qid", F.col("qid").alias("id"))
    return evaluation.hit_rates(q_retrieval.kb_weighted_search(spark, sf_dir), truth)


@query(sql="select l_suppkey, l_partkey, count(*) as n, min(p) as lo, median(p) as mid, max(p) as hi from (select distinct l_suppkey, l_partkey, l_extendedprice as p from lineitem) group by l_suppkey, l_partkey")
def price_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least, median and greatest of the different prices of each supplier's part."""
    d = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", F.col("l_extendedprice").alias("p")).distinct()
    return d.groupBy("l_suppkey", "l_partkey").agg(F.count(F.lit(1)).alias("n"), F.min("p").alias("lo"), F.median("p").alias("mid"), F.max("p").alias("hi"))


@query(
    sql="""with k as (select distinct ku_id as id from knowledge_unit), w as (select distinct case rel_id % 3 when 0 then source_ku_id when 1 then source_ku_id || '#r2' else replace(source_ku_id, 'GZ', 'XX') end as sample from ku_relations_v1 where source_ku_id is not null)
    select sample, coalesce(a.id, b.id, c.id) as resolved from w left join k a on a.id = sample left join k b on b.id = regexp_replace(sample, '#r[0-9]+$', '') left join k c on c.id = sample || '#r1'"""
)
def id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids with and without suffix as ids of the library."""
    s = F.col("source_ku_id")
    third = F.when(F.col("rel_id") % 3 == 0, s).when(F.col("rel_id") % 3 == 1, F.concat(s, F.lit("#r2"))).otherwise(F.replace(s, F.lit("GZ"), F.lit("XX")))
    w = table(spark, sf_dir, "ku_relations_v1").where("source_ku_id is not null").select(third.alias("sample")).distinct()
    return evaluation.resolve_ids(w, table(spark, sf_dir, "knowledge_unit").select(F.col("ku_id").alias("id"))).select("sample", "resolved")


@query()
def greedy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order paired with other lines of nearly the same quantity, nearest price first."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")
    a = l.where("l_linenumber % 2 = 1").select("l_orderkey", F.col("l_linenumber").alias("a"), F.col("l_quantity").alias("qa"), F.col("l_extendedprice").alias("pa"))
    b = l.where("l_linenumber % 2 = 0").select("l_orderkey", F.col("l_linenumber").alias("b"), F.col("l_quantity").alias("qb"), F.col("l_extendedprice").alias("pb"))
    pairs = a.join(b, "l_orderkey").where("abs(qa - qb) <= 20").withColumn("cost", F.round(F.abs(F.col("pa") - F.col("pb")) / F.col("pa"), 9))
    return evaluation.greedy_match(pairs, "l_orderkey", "a", "b", "cost")
