"""Registered queries of sessions, messages and parts; conversations stand for sessions, their turns for messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import sessions as s
from millrace.plans.privacy_queries import EMAIL, EMAIL_SQL
from millrace.plans.registry import register
from millrace.sources.tables import table

RULES = [("*", "*", "allow"), ("pur*", "*", "ask"), ("purchase", "*1*", "deny"), ("e*", "?5", "deny"), ("error", "*", "ask")]


@register(
    "p16_last_match",
    """with x as (select event_id id, event_type permission, json_extract_string(props, '$.k') pattern from events)
    select id, permission, pattern, case when permission = 'error' then 'ask' when permission like 'e%' and pattern like '_5' then 'deny' when permission = 'purchase' and pattern like '%1%' then 'deny'
        when permission like 'pur%' then 'ask' else 'allow' end as action from x""",
)
def last_match(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("permission"), F.get_json_object("props", "$.k").alias("pattern"))
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "nr int, permission string, pattern string, action string")
    return s.decisions(e, rules)


@register(
    "p16_last_match_listed",
    """with x as (select event_id id, event_type permission, json_extract_string(props, '$.k') pattern from events)
    select id, case when permission = 'error' then 'ask' when permission like 'e%' and pattern like '_5' then 'deny' when permission = 'purchase' and pattern like '%1%' then 'deny'
        when permission like 'pur%' then 'ask' else 'ask' end as action from x""",
)
def last_match_listed(spark: SparkSession, d: str) -> DataFrame:
    """The same without the rule for everything, so the default decides the rest."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), s.decision(F.col("event_type"), F.get_json_object("props", "$.k"), RULES[1:]).alias("action"))


@register(
    "p14_session_record",
    """with x as (select o_orderkey id, case when o_orderkey % 3 = 0 then null else o_custkey end a, case when o_orderkey % 2 = 0 then null else 4 end d, null::int f, case o_orderkey % 5 when 0 then '' when 1 then null else o_orderpriority end u from orders)
    select id, case when a is not null or d is not null then coalesce(a, 0) end summary_additions, case when a is not null or d is not null then coalesce(d, 0) end summary_deletions,
        case when a is not null or d is not null then 0 end summary_files, nullif(u, '') share_url from x""",
)
def record(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    row = {
        "additions": F.when(k % 3 != 0, F.col("o_custkey")),
        "deletions": F.when(k % 2 != 0, F.lit(4)),
        "files": F.lit(None).cast("int"),
        "share_url": F.when(k % 5 == 0, "").when(k % 5 != 1, F.col("o_orderpriority")),
    }
    return table(spark, d, "orders").select(k.alias("id"), *s.session_record(row))


@register(
    "w5_since_compaction",
    """with m as (select conv_id as session, turn id, role, turn - 1 parent, length(text) % 3 = 0 summary, length(text) % 7 <> 0 finish, length(text) % 5 = 0 error, role = 'user' and length(text) % 2 = 0 compaction from conversations),
    b as (select u.session, max(u.id) f from m u join m a on a.session = u.session and a.parent = u.id where u.role = 'user' and u.compaction and a.role = 'assistant' and a.summary and a.finish and not a.error group by 1)
    select m.session, m.id from m left join b using (session) where f is null or m.id >= f""",
)
def compacted(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    m = table(spark, d, "conversations").select(
        F.col("conv_id").alias("session"), F.col("turn").alias("id"), "role", (F.col("turn") - 1).alias("parent"), (n % 3 == 0).alias("summary"),
        (n % 7 != 0).alias("finish"), (n % 5 == 0).alias("error"), ((F.col("role") == "user") & (n % 2 == 0)).alias("compaction"),
    )
    return s.since_compaction(m).select("session", "id")


@register(
    "w2_prune_marks",
    """with p as (select conv_id as session, turn id, length(text) * 20 tokens from conversations), r as (select *, sum(tokens) over (partition by session order by id desc) c from p)
    select session, id from r where c > 40000 and session in (select session from r where c > 40000 group by 1 having sum(tokens) > 20000)""",
)
def prune(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("id"), (F.length("text") * 20).alias("tokens"))
    return s.to_prune(p).select("session", "id")


@register(
    "w11_recent_sessions",
    """with x as (select o_orderkey id, case when o_orderkey % 3 = 0 then null else o_orderkey - o_orderkey % 3 end parent, o_orderstatus = 'P' archived, o_orderdate updated from orders),
    l as (select * from x where not archived), r as (select * from l where parent is null), b as (select * from r order by id limit 40),
    n as (select * from r where id not in (select id from b) and updated > timestamp '1998-01-01' order by updated desc, id limit 50), k as (select id from b union all select id from n)
    select id from k union all select id from l where parent is not null and (parent in (select id from k) or id % 50 = 7 or updated > timestamp '1998-01-01')""",
)
def recent(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = table(spark, d, "orders").select(k.alias("id"), F.when(k % 3 != 0, k - k % 3).alias("parent"), (F.col("o_orderstatus") == "P").alias("archived"), F.col("o_orderdate").alias("updated"))
    asking = table(spark, d, "orders").where("o_orderkey % 50 = 7").select(k.alias("id"))
    return s.trimmed(x, 40, F.lit("1998-01-01").cast("timestamp_ntz"), asking).select("id")


@register(
    "a14_context_scaled",
    """with c as (select conv_id, (max(turn) + 1) * 29 total, ceil(sum(case when role = 'system' then length(text) else 0 end) / 4) s, ceil(sum(case when role = 'user' then length(text) else 0 end) / 4) u,
        ceil(sum(case when role = 'assistant' then length(text) else 0 end) / 4) a from conversations group by 1),
    k as (select *, s + u + a <= total as fits, total / (s + u + a) r from c),
    t as (select conv_id, total, case when fits then s else floor(s * r) end s, case when fits then u else floor(u * r) end u, case when fits then a else floor(a * r) end a from k)
    select conv_id, s::bigint system, u::bigint as "user", a::bigint assistant, 0::bigint tool, greatest(0, total - s - u - a)::bigint other from t""",
)
def breakdown(spark: SparkSession, d: str) -> DataFrame:
    chars = [F.sum(F.when(F.col("role") == r, F.length("text")).otherwise(0)).alias(r) for r in ("system", "user", "assistant")]
    c = table(spark, d, "conversations").groupBy("conv_id").agg(*chars, ((F.max("turn") + 1) * 29).alias("total"))
    b = s.context_breakdown({"system": F.col("system"), "user": F.col("user"), "assistant": F.col("assistant"), "tool": F.lit(0)}, F.col("total"))
    return c.select("conv_id", b.alias("b")).select("conv_id", "b.*")


LINES = "l as (select conv_id as session, turn message, unnest(string_split(text, ' ')) t, generate_subscripts(string_split(text, ' '), 1) - 1 part from conversations)"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    words = F.posexplode(F.split("text", " ")).alias("part", "text")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("message"), words)


@register(
    "x6_revert",
    f"""with {LINES}, b as (select distinct conv_id as session, conv_id % 4 m, case when conv_id % 2 = 0 then 3 end p from conversations where conv_id % 5 <> 0)
    select l.session, message, part::int part from l left join b using (session) where m is null or message < m or (message = m and part < p)""",
)
def revert(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("conv_id")
    b = table(spark, d, "conversations").where("conv_id % 5 <> 0").select(k.alias("session"), (k % 4).alias("at_message"), F.when(k % 2 == 0, 3).alias("at_part")).distinct()
    return s.reverted(_lines(spark, d), b).select("session", "message", "part")


@register(
    "x8_for_model",
    f"""with {LINES}, p as (select *, (['text', 'file', 'compaction', 'subtask', 'reasoning'])[(part % 5 + 1)::int] k, (['image/png', 'text/plain', 'application/pdf', 'text/csv'])[(part % 4 + 1)::int] mime from l)
    select session, message, part::int part, case when k = 'file' and mime = 'text/csv' then 'file' else 'text' end kind,
        case k when 'text' then t when 'file' then case when mime = 'text/csv' then coalesce(nullif(t, ''), 'file') else '[Attached ' || mime || ': ' || coalesce(nullif(t, ''), 'file') || ']' end
            when 'compaction' then 'What did we do so far?' else 'The following tool was executed by the user' end content
    from p where (k = 'text' and part % 3 <> 0) or (k = 'file' and mime <> 'text/plain') or k in ('compaction', 'subtask')""",
)
def flattened(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("part")
    kind = F.get(F.array(*map(F.lit, ("text", "file", "compaction", "subtask", "reasoning"))), i % 5)
    mime = F.get(F.array(*map(F.lit, ("image/png", "text/plain", "application/pdf", "text/csv"))), i % 4)
    p = _lines(spark, d).select("session", "message", "part", kind.alias("type"), "text", (i % 3 == 0).alias("ignored"), mime.alias("mime"), F.when(F.col("text") != "", F.col("text")).alias("filename"))
    return s.for_model(p, strip_media=True)


SLOTS = """m as (select conv_id as session, turn message, text t, turn % 2 = 0 whole from conversations),
slots as (select session, message, null::int part, t from m where whole union all select session, message, 0, t from m where not whole union all select session, message, 2, 'see ' || t from m where not whole)"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as messages: every other one a string, the others parts of which the second is no text."""
    whole = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)
    parts = F.array(*[F.struct(F.lit(k).alias("type"), t.alias("text")) for k, t in (("text", F.col("text")), ("image", F.lit(None).cast("string")), ("text", F.concat(F.lit("see "), "text")))])
    content = F.when(F.col("turn") % 2 == 0, whole).otherwise(F.to_json(parts))
    return table(spark, d, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("message"), "role", content.alias("content"))


@register("f72_slots_of_parts", f"with {SLOTS} select session, message, part, t as text from slots")
def slots(spark: SparkSession, d: str) -> DataFrame:
    return s.text_slots(_messages(spark, d))


@register("f73_slots_written", f"with {SLOTS} select session, message, part, replace(t, 'e', 'EE') as text from slots")
def written(spark: SparkSession, d: str) -> DataFrame:
    """All slots changed, written back and read again."""
    m = _messages(spark, d)
    return s.text_slots(s.with_text_slots(m, s.text_slots(m).withColumn("text", F.replace(F.col("text"), F.lit("e"), F.lit("EE")))))


_MAILED = "case when session % 3 = 0 then t || ' write to a.b@mail' || (session % 7) || '.example.org or to x@y.org, a.b@mail' || (session % 7) || '.example.org.' else t end"
CLEAN = rf"""{SLOTS}, x as (select session, message, part, {_MAILED} t from slots), v as (select *, regexp_extract_all(t, '{EMAIL_SQL}') vs, regexp_split_to_array(t, '{EMAIL_SQL}') gaps from x),
n as (select *, [list_position([vs[i] for i in range(1, len(vs) + 1) if list_position(vs, vs[i]) = i], y) for y in vs] nr from v)"""


def _mailed(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    k = (F.col("session") % 7).cast("string")
    mail = F.concat(F.lit("a.b@mail"), k, F.lit(".example.org"))
    said = F.concat("text", F.lit(" write to "), mail, F.lit(" or to x@y.org, "), mail, F.lit("."))
    return s.with_text_slots(m, s.text_slots(m).withColumn("text", F.when(F.col("session") % 3 == 0, said).otherwise(F.col("text"))))


@register("d1_14_conversation", f"with {CLEAN} select session, message, part, array_to_string([gaps[i] || coalesce('[CONTACT_' || nr[i] || ']', '') for i in range(1, len(gaps) + 1)], '') as text from n")
def conversation(spark: SparkSession, d: str) -> DataFrame:
    return s.text_slots(s.anonymized(_mailed(spark, d), "max", (EMAIL,))[0])


@register("d1_14_conversation_tokens", f"with {CLEAN}, y as (select session, unnest(nr) k, unnest(vs) as value from n) select distinct session, '[CONTACT_' || k || ']' token, value from y")
def conversation_tokens(spark: SparkSession, d: str) -> DataFrame:
    return s.anonymized(_mailed(spark, d), "max", (EMAIL,))[1]
