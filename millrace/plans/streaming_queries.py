"""Registered queries of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import billing
from millrace.plans.billing_queries import SNAPSHOT
from millrace.plans.registry import register
from millrace.sources.tables import table
from millrace.streaming import folds, store


@register("st2_stream_snapshot", f"with {SNAPSHOT} select * from snap")
def snapshot(spark: SparkSession, d: str) -> DataFrame:
    events = folds.stream_of(spark, f"{d}/events.parquet")
    out = billing.monthly_snapshot(billing.usage_events(events))
    return folds.run_to_files(out, "snapshot")


@register("st3_stream_weekly", "select user_id, date_trunc('week', ts)::timestamp as week, count(*) n from events group by 1, 2")
def weekly(spark: SparkSession, d: str) -> DataFrame:
    events = folds.stream_of(spark, f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    out = folds.weekly(events)
    return folds.run_to_files(out, "weekly").withColumn("week", F.col("week").cast("timestamp_ntz"))


@register(
    "st5_rolling_quota",
    """with recursive e as (select user_id, ts, event_id % 100 c, row_number() over (partition by user_id order by ts, event_id % 100) i from events),
    f as (select user_id, i, ts anchor, c usage from e where i = 1
        union all select e.user_id, e.i, case when e.ts - f.anchor <= interval 5 hour then f.anchor else e.ts end, case when e.ts - f.anchor <= interval 5 hour then f.usage + e.c else e.c end
        from f join e on e.user_id = f.user_id and e.i = f.i + 1)
    select user_id, arg_max(anchor, i) anchor, arg_max(usage, i)::bigint as usage from f group by user_id""",
)
def rolling(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("c", F.col("event_id") % 100)
    return folds.rolling_quota(e, "user_id", "ts", "c", 5 * 3600).withColumn("anchor", F.col("anchor").cast("timestamp_ntz"))


@register(
    "st14_event_reducer",
    """with l as (select user_id, event_id seq, case event_type when 'error' then 'remove' when 'signup' then 'set' else 'append' end op, substr(event_type, 1, 1) v from events),
    m as (select user_id, max(seq) filter (where op <> 'append') last, arg_max(op, seq) filter (where op <> 'append') last_op from l group by 1)
    select l.user_id, string_agg(v, '' order by seq) as value from l join m using (user_id) where (last is null or seq >= last) and coalesce(last_op, 'set') <> 'remove' group by 1""",
)
def reducer(spark: SparkSession, d: str) -> DataFrame:
    op = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "set").otherwise("append")
    log = table(spark, d, "events").select("user_id", F.col("event_id").alias("seq"), op.alias("op"), F.substring("event_type", 1, 1).alias("value"))
    return folds.reduce_events(log, ["user_id"])


@register("st5_rolling_stream", "select 1::bigint batches, count(distinct user_id) keys, true as same from events")
def rolling_stream(spark: SparkSession, d: str) -> DataFrame:
    """The quota kept as the state of a stream, against the one folded from the whole table."""
    e = folds.stream_of(spark, f"{d}/events.parquet").withColumn("c", F.col("event_id") % 100)
    kept = folds.run_to_files(folds.rolling_quota_stream(e, "user_id", "ts", "c", 5 * 3600), "rolling", "update")
    last = kept.groupBy("user_id").agg(F.max_by(F.struct("anchor", "usage"), "batch").alias("s"))
    whole = folds.rolling_quota(table(spark, d, "events").withColumn("c", F.col("event_id") % 100), "user_id", "ts", "c", 5 * 3600)
    both = whole.join(last, "user_id", "full").select("user_id", ((F.col("anchor") == F.col("s.anchor")) & (F.col("usage") == F.col("s.usage"))).alias("ok"))
    batches = kept.agg(F.countDistinct("batch").alias("batches"))
    return both.agg(F.count("user_id").alias("keys"), F.min(F.coalesce("ok", F.lit(False))).alias("same")).join(batches).select("batches", "keys", "same")


@register("st1_rehydrated_stream", "select event_id, 'call ' || event_type || '@mail.example and [OTHER_9]' as said from events")
def rehydrated_stream(spark: SparkSession, d: str) -> DataFrame:
    """Records of a stream with their tokens replaced; a token that is not known stays."""
    tokens = {f"[CONTACT_{i}]": f"{t}@mail.example" for i, t in enumerate(("click", "error", "purchase", "signup", "view"), 1)}
    number = F.array_position(F.array(*map(F.lit, ("click", "error", "purchase", "signup", "view"))), F.col("event_type"))
    said = F.concat(F.lit("call [CONTACT_"), number.cast("string"), F.lit("] and [OTHER_9]"))
    e = folds.stream_of(spark, f"{d}/events.parquet").select("event_id", said.alias("said"))
    return folds.run_to_files(folds.rehydrated(e, "said", tokens), "rehydrated", "append").drop("batch")


_KINDS = ("message.updated", "message.part.updated", "message.part.delta", "message.part.removed", "message.removed", "permission.asked", "permission.replied", "todo.updated", "session.status", "session.created", "session.updated", "session.deleted", "question.asked", "question.rejected", "session.diff", "message.part.updated", "message.part.delta", "vcs.branch.updated", "lsp.updated", "server.instance.disposed")
_LOG = f"""l as (select user_id % 7 directory, event_id seq, ([{", ".join(f"'{k}'" for k in _KINDS)}])[event_id * 7 % 20 + 1] t, user_id as session, event_id // 20 % 3 id, event_id // 60 % 2 part,
    case when user_id % 3 = 0 then 1 end parent, event_id % 13 = 0 archived, substr(event_type, 1, 1) || (event_id % 10) v from events)"""


def store_log(spark: SparkSession, d: str) -> DataFrame:
    k, u = F.col("event_id"), F.col("user_id")
    kind = F.get(F.array(*map(F.lit, _KINDS)), (k * 7 % 20).cast("int"))
    value = F.concat(F.substring("event_type", 1, 1), (k % 10).cast("string"))
    return table(spark, d, "events").select(
        (u % 7).alias("directory"), k.alias("seq"), kind.alias("type"), u.alias("session"), F.floor(k / 20 % 3).alias("id"), F.floor(k / 60 % 2).alias("part"),
        F.when(u % 3 == 0, 1).alias("parent"), (k % 13 == 0).alias("archived"), value.alias("value"),
    )


def store_entries_sql() -> str:
    """The entries that the log leaves, in SQL."""
    return f"""with {_LOG}, c as (select *, coalesce(max(seq) filter (where t = 'session.deleted' or (t = 'session.updated' and archived)) over (partition by session), -1) cut from l), k as (select * from c where seq > cut),
    s as (select session, 'session' kind, null::bigint id, null::bigint part, arg_max(v, seq) v from k where t in ('session.created', 'session.updated') group by 1),
    w as (select session, case t when 'todo.updated' then 'todo' when 'session.status' then 'session_status' else 'session_diff' end kind, null::bigint, null::bigint, arg_max(v, seq) from k where t in ('todo.updated', 'session.status', 'session.diff') group by 1, 2),
    e as (select session, case when t like 'message.%' then 'message' when t like 'permission.%' then 'permission' else 'question' end kind, id, null::bigint p, arg_max(v, seq) v, arg_max(t, seq) t from k
        where t in ('message.updated', 'message.removed', 'permission.asked', 'permission.replied', 'question.asked', 'question.rejected') group by 1, 2, 3),
    m as (select session, id, seq from k where t = 'message.removed'),
    p as (select session, id, part, seq, t, v from k where t like 'message.part.%' union all select m.session, m.id, q.part, m.seq, 'message.removed', null from m join (select distinct session, id, part from k where t like 'message.part.%') q using (session, id)),
    r as (select *, max(seq) filter (where t <> 'message.part.delta') over (partition by session, id, part) last from p),
    o as (select session, id, part, arg_min(t, seq) t, string_agg(v, '' order by seq) v from r where seq >= last group by 1, 2, 3)
    select session, kind, id, part, v as value from s union all select * from w union all select session, kind, id, p, v from e where t in ('message.updated', 'permission.asked', 'question.asked')
    union all select session, 'part', id, part, v from o where t = 'message.part.updated'"""


@register("st14_store_entries", store_entries_sql())
def store_entries(spark: SparkSession, d: str) -> DataFrame:
    return store.entries(store_log(spark, d))


@register(
    "st14_store_directories",
    f"""with recursive {_LOG.replace("with ", "")}, e as (select *, row_number() over (partition by directory order by seq) i from l where t in ('session.created', 'session.updated', 'session.deleted')),
    f as (select directory, 0::bigint i, 0::bigint total, []::bigint[] known from l group by 1
        union all select e.directory, e.i, case when e.t = 'session.created' then f.total + (e.parent is null and not list_contains(f.known, e.session))::int
                when e.t = 'session.deleted' or e.archived then greatest(0, f.total - (e.parent is null)::int) else f.total end,
            case when e.t = 'session.deleted' or (e.t = 'session.updated' and e.archived) then list_filter(f.known, lambda x: x <> e.session) when list_contains(f.known, e.session) then f.known else list_append(f.known, e.session) end
        from f join e on e.directory = f.directory and e.i = f.i + 1)
    select directory, (select arg_max(total, i) from f where f.directory = l.directory) session_total, count_if(t = 'server.instance.disposed')::bigint refreshes, count_if(t = 'lsp.updated')::bigint lsp_loads,
        arg_max(v, seq) filter (where t = 'vcs.branch.updated') branch from l group by directory""",
)
def store_directories(spark: SparkSession, d: str) -> DataFrame:
    return store.directories(store_log(spark, d))
