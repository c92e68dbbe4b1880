"""Registered queries of accounts, limits, reports and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import dates
from millrace.operators import accounts as a
from millrace.operators import billing as b
from millrace.plans.billing_queries import LIMITS, SNAPSHOT, USAGE, limited, usage
from millrace.plans.registry import register
from millrace.sources import sinks
from millrace.sources.ledger import Ledger
from millrace.sources.shared import shared_path
from millrace.sources.tables import table
from millrace.streaming import scans

SOURCE_SQL = """x as (select c_custkey id, c_custkey % 11 = 0 anon, c_custkey % 7 = 0 byok, c_custkey % 13 = 0 free, c_mktsegment = 'BUILDING' sub, c_custkey % 2 = 0 sl, c_custkey % 3 = 0 sb,
    c_mktsegment = 'MACHINERY' lite, c_custkey % 5 < 2 ll, c_custkey % 4 = 0 lb, c_nationkey <> 3 pay, c_acctbal bal, c_custkey % 17 = 0 wl, c_custkey % 19 = 0 ul from customer),
src as (select id, bal, case when anon then 'anonymous' when byok then 'byok' when free then 'free' when sub and not sl then 'subscription' when sub and not sb then 'error:quota exceeded'
    when lite and not ll then 'lite' when lite and not lb then 'error:quota exceeded' when not pay then 'error:no payment method' when bal <= 0 then 'error:insufficient balance'
    when wl then 'error:workspace limit' when ul then 'error:user limit' else 'balance' end as source from x)"""


def _sources(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    row = {
        "anonymous": k % 11 == 0, "byok": k % 7 == 0, "free": k % 13 == 0,
        "subscription": F.col("c_mktsegment") == "BUILDING", "subscription_limited": k % 2 == 0, "subscription_use_balance": k % 3 == 0,
        "lite": F.col("c_mktsegment") == "MACHINERY", "lite_limited": k % 5 < 2, "lite_use_balance": k % 4 == 0,
        "payment_method": F.col("c_nationkey") != 3, "balance": F.col("c_acctbal"), "workspace_limited": k % 17 == 0, "user_limited": k % 19 == 0,
    }
    return table(spark, d, "customer").select(k.alias("id"), F.col("c_acctbal").alias("bal"), a.billing_source(row).alias("source"))


@register("d4_9_billing_source_full", f"with {SOURCE_SQL} select id, source from src")
def sources(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).select("id", "source")


@register(
    "d4_8_usage_rows",
    f"with {SOURCE_SQL} select o_orderkey id, id workspace, source, round(floor(o_totalprice)::double * 1000000)::bigint cost, case source when 'subscription' then 'sub' when 'byok' then 'byok' when 'lite' then 'lite' end plan from orders join src on o_custkey = id where source <> 'anonymous' and not starts_with(source, 'error')",
)
def usage_rows(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("id", "workspace", "source", "cost", "plan")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    src = _sources(spark, d).where(~F.col("source").startswith("error")).select(F.col("id").alias("o_custkey"), "source")
    o = table(spark, d, "orders").join(src, "o_custkey")
    return a.usage_rows(o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("workspace"), "source", F.floor("o_totalprice").alias("cents")))


@register(
    "d4_8_balances",
    f"""with {SOURCE_SQL}, p as (select o_custkey, sum(floor(o_totalprice)::bigint * 1000000)::bigint c from orders join src on o_custkey = id where source = 'balance' group by 1)
    select id workspace, floor(bal)::bigint * 1000000 - coalesce(c, 0) balance from src left join p on o_custkey = id""",
)
def balances(spark: SparkSession, d: str) -> DataFrame:
    return a.booked(_calls(spark, d), _balances(spark, d))


def _balances(spark: SparkSession, d: str) -> DataFrame:
    return _sources(spark, d).select(F.col("id").alias("workspace"), (F.floor("bal") * 1_000_000).alias("balance"))


@register("d4_10_reload", f"with {SOURCE_SQL} select id workspace from src where floor(bal)::bigint * 1000000 < 500000000 and id % 6 <> 0")
def reload(spark: SparkSession, d: str) -> DataFrame:
    return a.to_reload(_balances(spark, d), F.lit(500_000_000), F.col("workspace") % 6 == 0).select("workspace")


@register("d4_1_emitted", f"with {USAGE} select id, tenant_id, event_type from usage where event_type <> 'other'")
def emitted(spark: SparkSession, d: str) -> DataFrame:
    """Only records with a kind are emitted."""
    return usage(spark, d).where("event_type <> 'other'").select("id", "tenant_id", "event_type")


@register(
    "d4_6_usage_of_tenants",
    f"""with {SNAPSHOT}, t as (select 't' || unnest(range(0, 45)) tenant_id), s as (select * from snap where period_ym = (select max(period_ym) from snap))
    select tenant_id, coalesce(total_docs, 0) total_docs, coalesce(total_chars_in, 0) total_chars_in, coalesce(total_rag_queries, 0) total_rag_queries from t left join s using (tenant_id)""",
)
def usage_of_tenants(spark: SparkSession, d: str) -> DataFrame:
    """The last month of every tenant, zeros for those without any."""
    snap = b.monthly_snapshot(usage(spark, d))
    last = snap.agg(F.max("period_ym").alias("period_ym"))
    tenants = spark.range(45).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("tenant_id"))
    s = snap.join(last, "period_ym")
    return tenants.join(s, "tenant_id", "left").select("tenant_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_docs", "total_chars_in", "total_rag_queries")])


@register("d4_7_plans", "select 't' || (user_id % 40) tenant_id, max(case when user_id % 40 % 4 = 0 then 'business' else 'starter' end) plan from events group by 1")
def plans(spark: SparkSession, d: str) -> DataFrame:
    """A tenant without a plan is on the smallest one; limits come from the fixed plans."""
    tenants = table(spark, d, "events").select(F.concat(F.lit("t"), (F.col("user_id") % 40).cast("string")).alias("tenant_id"), (F.col("user_id") % 40).alias("n")).distinct()
    told = tenants.where("n % 4 = 0").select("tenant_id", F.lit("business").alias("plan"))
    return b.with_plan(tenants, b.plan_table(spark), told).select("tenant_id", "plan")


@register("f67_plan_limits", f"with {LIMITS} select tenant_id, period_ym, plan, case plan when 'starter' then 1000 when 'business' then 10000 end::bigint lim_docs, case plan when 'starter' then 60 when 'business' then 300 else 1000 end::int rpm from lim")
def plan_limits(spark: SparkSession, d: str) -> DataFrame:
    snaps = limited(spark, d).select("tenant_id", "period_ym", "plan")
    return b.with_plan(snaps.drop("plan"), b.plan_table(spark), snaps.select("tenant_id", "plan").distinct()).select("tenant_id", "period_ym", "plan", "lim_docs", "rpm")


@register(
    "st4_anchored_month",
    """with x as (select user_id, ts::date as day, date '2023-12-31' anchor, date_trunc('month', ts)::date f, event_id from events),
    p as (select *, f + (least(31, extract(day from last_day(f))) - 1)::int here, (f - interval 1 month)::date g from x)
    select user_id, (case when here <= day then here else g + (least(31, extract(day from last_day(g))) - 1)::int end)::date as period, count(*) n from p group by 1, 2""",
)
def anchored(spark: SparkSession, d: str) -> DataFrame:
    period = dates.month_anchor(F.to_date("ts"), F.lit("2023-12-31").cast("date")).alias("period")
    return table(spark, d, "events").groupBy("user_id", period).agg(F.count("*").alias("n"))


@register(
    "st6_month_counter",
    "select user_id, (sum(event_id) filter (where date_trunc('month', ts) = m))::bigint as usage from (select *, max(date_trunc('month', ts)) over (partition by user_id) m from events) group by 1",
)
def month_counter(spark: SparkSession, d: str) -> DataFrame:
    """What a counter holds that starts anew with each calendar month: the sum of a user's last month."""
    per = table(spark, d, "events").groupBy("user_id", F.date_trunc("month", "ts").alias("m")).agg(F.sum("event_id").alias("s"))
    return per.groupBy("user_id").agg(F.max_by("s", "m").alias("usage"))


@register(
    "st8_ip_limit",
    """with recursive e as (select user_id u, event_id id, ts::date as day, row_number() over (partition by user_id order by ts, event_id) i from events),
    f as (select u, 0::bigint i, null::bigint id, null::date as day, 0::bigint today, 0::bigint life, true ok from e group by u
        union all select u, i, id, day, t + ok::int, life + (ok and new)::int, ok from (
            select *, case when new then t < 4 else t < 2 end ok from (
                select e.u, e.i, e.id, e.day, case when e.day is not distinct from f.day then f.today else 0 end t, f.life, f.life < 14 new from f join e on e.u = f.u and e.i = f.i + 1)))
    select u user_id, id, ok from f where id is not null""",
)
def ip_limit(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "ts", F.col("event_id").alias("id"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    return scans.scan(e, ["user_id"], ["ts", "id"], "user_id long, id long, ok boolean", lambda: scans.IpLimit(2))


@register(
    "st9_trial_tokens",
    """with e as (select user_id, event_id, event_id % 10 + event_id % 7 + event_id % 3 + user_id % 5 + 2 n, row_number() over (partition by user_id order by ts, event_id) i from events),
    r as (select *, coalesce(sum(n) over (partition by user_id order by i rows between unbounded preceding and 1 preceding), 0) as before from e) select event_id from r where before < 300""",
)
def trial(spark: SparkSession, d: str) -> DataFrame:
    """Calls on trial: those before which a user's six kinds of tokens are below the limit. As sums only grow, a window does."""
    from pyspark.sql import Window

    k, u = F.col("event_id"), F.col("user_id")
    kinds = [k % 10, k % 7, k % 3, u % 5, F.lit(2), F.coalesce(F.lit(None).cast("long"), F.lit(0))]
    total = kinds[0]
    for x in kinds[1:]:
        total = total + x
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = table(spark, d, "events").withColumn("before", F.coalesce(F.sum(total).over(before), F.lit(0)))
    return e.where("before < 300").select("event_id")


@register(
    "st10_token_bucket",
    """with recursive e as (select user_id u, event_id id, epoch_us(ts) t, row_number() over (partition by user_id order by ts, event_id) i from events),
    f as (select u, 0::bigint i, null::bigint id, null::bigint t, 0::double tokens, true ok from e group by u
        union all select u, i, id, t, now - (now >= 1)::int, now >= 1 from (
            select e.u, e.i, e.id, e.t, case when f.t is null then 2.0 else least(2.0, f.tokens + (e.t - f.t) / 1e6 * (2 / 60.0 / 3600)) end now from f join e on e.u = f.u and e.i = f.i + 1))
    select u user_id, id, ok from f where id is not null""",
)
def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    """Two requests an hour... of sixty: time is slowed so that some of the table's rows are refused."""
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), F.expr("cast(unix_micros(cast(ts as timestamp)) as double) / 3600").alias("t"), F.lit(2).alias("per_minute"))
    return scans.scan(e, ["user_id"], ["t", "id"], "user_id long, id long, ok boolean", scans.Bucket)


@register(
    "st11_breaker",
    """with recursive e as (select user_id u, event_id id, epoch_us(ts) t, event_type <> 'error' ok, row_number() over (partition by user_id order by ts, event_id) i from events),
    f as (select u, 0::bigint i, null::bigint id, 0::bigint failures, null::bigint opened, null::varchar state from e group by u
        union all select u, i, id, case when rejected then failures when ok then 0 else failures + 1 end, case when rejected then opened when ok then null when opened is not null or failures + 1 >= 2 then t end,
            case when rejected then 'rejected' when opened is not null then 'tried' else 'closed' end from (
            select e.u, e.i, e.id, e.t, e.ok, f.failures, f.opened, f.opened is not null and e.t - f.opened < 86400 * 1000000::bigint rejected from f join e on e.u = f.u and e.i = f.i + 1))
    select u user_id, id, state from f where id is not null""",
)
def breaker(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", F.col("event_id").alias("id"), scans.micros("ts").alias("t"), (F.col("event_type") != "error").alias("ok"))
    return scans.scan(e, ["user_id"], ["t", "id"], "user_id long, id long, state string", lambda: scans.Breaker(2, 86_400))


@register("st13_subscribed", "select event_id, 'typed' channel from events where event_type = 'error' union all select event_id, 'all' from events")
def subscribed(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", "event_type")
    return e.where("event_type = 'error'").select("event_id", F.lit("typed").alias("channel")).unionByName(e.select("event_id", F.lit("all").alias("channel")))


@register("a19_download_totals", "select event_type, sum(k)::bigint total, sum(n)::bigint events from (select event_type, ts::date as day, sum(json_extract_string(props, '$.k')::bigint) k, count(*) n from events group by 1, 2) group by 1")
def download_totals(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    daily = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum(k).alias("k"), F.count("*").alias("n"))
    return daily.groupBy("event_type").agg(F.sum("k").alias("total"), F.sum("n").alias("events"))


@register("a22_incremented", f"with {SNAPSHOT} select tenant_id, period_ym, total_docs, total_rag_queries from snap")
def incremented(spark: SparkSession, d: str) -> DataFrame:
    """Snapshots of the first half of the events, incremented by those of the second half."""
    u, keys, counters = usage(spark, d), ["tenant_id", "period_ym"], ["total_docs", "total_rag_queries"]
    half = [b.monthly_snapshot(u.where(c)).select(*keys, *counters) for c in ("id % 2 = 0", "id % 2 = 1")]
    return sinks.increment(half[0], half[1], keys, counters)


@register("a24_daily_cost", "select user_id, ts::date as day, sum((value * 100)::bigint)::bigint cents, sum(json_extract_string(props, '$.k')::bigint)::bigint tokens, count(*) n from events group by 1, 2")
def daily_cost(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    cents = (F.col("value") * 100).cast("decimal(20,0)").cast("long")
    return table(spark, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.sum(cents).alias("cents"), F.sum(k).alias("tokens"), F.count("*").alias("n"))


@register(
    "a26_week_columns",
    "select user_id, " + ", ".join(f"count_if((isoyear(ts) * 100 + week(ts)) = {w}) w{w}" for w in (202401, 202402, 202403, 202404, 202405)) + " from events group by 1",
)
def week_columns(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", dates.iso_week(F.col("ts")).alias("week"), F.lit(1).alias("n"))
    return a.weekly_columns(e, "user_id", "week", "n", [202401, 202402, 202403, 202404, 202405])


RESULT = """'{"tasks": [{"id": "t' || (o_orderkey % 3) || '", "averageScore": ' || (o_orderkey % 100) || '}, {"id": "t' || (3 + o_orderkey % 2) || '", "averageScore": 0.5}, {"averageScore": 1}]}'"""


def _results(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("agent"), F.expr(RESULT).alias("result"))


@register("f77_task_scores", "select o_orderkey agent, 't' || (o_orderkey % 3) task, (o_orderkey % 100)::double score from orders union all select o_orderkey, 't' || (3 + o_orderkey % 2), 0.5 from orders")
def task_scores(spark: SparkSession, d: str) -> DataFrame:
    return a.task_scores(_results(spark, d))


@register(
    "a25_score_table",
    "select o_orderkey agent, " + ", ".join([f"case when o_orderkey % 3 = {i} then (o_orderkey % 100)::double end t{i}" for i in range(3)] + [f"case when o_orderkey % 2 = {i} then 0.5::double end t{3 + i}" for i in range(2)]) + " from orders",
)
def score_table(spark: SparkSession, d: str) -> DataFrame:
    return a.score_table(_results(spark, d))


@register("t4_task_names", "select distinct 't' || (o_orderkey % 3) task from orders union select distinct 't' || (3 + o_orderkey % 2) from orders")
def task_names(spark: SparkSession, d: str) -> DataFrame:
    return a.task_scores(_results(spark, d)).select("task").distinct()


@register("f79_blobs", "select vec_id, embedding from embeddings where vec_id % 2 = 0 union all select vec_id, null from embeddings where vec_id % 2 = 1")
def blobs(spark: SparkSession, d: str) -> DataFrame:
    """Vectors as bytes and back; a blob with a byte too many is none."""
    raw = a.blob(F.col("embedding"))
    kept = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 2 == 0, raw).otherwise(F.concat(raw, F.lit(b"\0"))).alias("b"))
    return kept.select("vec_id", a.floats(F.col("b")).alias("embedding"))


@register("f71_tag_lookup", "select event_id, json_extract_string(props, '$.k') tag from events")
def tags(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "map<string,string>")["k"].alias("tag"))


@register("a18_histogram", "select b.le::varchar le, count_if(e.value <= b.le) n from events e cross join (values (1), (5), (10), (25), (50), (100), (250), (500), (1000), (5000)) b(le) group by b.le union all select '+Inf', count(*) from events")
def histogram(spark: SparkSession, d: str) -> DataFrame:
    return a.histogram(table(spark, d, "events"), "value", [1, 5, 10, 25, 50, 100, 250, 500, 1000, 5000])


@register("k16_exposition", "select 'events_total{event_type=\"' || event_type || '\"} ' || count(*) line from events group by event_type")
def exposition(spark: SparkSession, d: str) -> DataFrame:
    return a.exposition(table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n")), "events_total", "event_type", "n")


@register("o5_page", "select o_orderkey from orders order by o_orderkey limit 100 offset 200")
def page(spark: SparkSession, d: str) -> DataFrame:
    """Page 3 of pages of 500, which are cut to 100."""
    limit, offset = a.page_bounds(3, 500)
    return table(spark, d, "orders").select("o_orderkey").orderBy("o_orderkey").offset(offset).limit(limit)


@register("o7_capped", "select event_id from events where event_type = 'error' order by ts desc, event_id desc limit 1000")
def capped(spark: SparkSession, d: str) -> DataFrame:
    kind = {"delete": "error"}[a.checked_action("delete")]
    return table(spark, d, "events").where(F.col("event_type") == kind).orderBy(F.desc("ts"), F.desc("event_id")).limit(min(5000, 1000)).select("event_id")


@register("o10_random_sample", "select 100::bigint n, 0::bigint strangers")
def random_sample(spark: SparkSession, d: str) -> DataFrame:
    """A seeded random hundred of all orders, told by its size and by how many of it are not orders."""
    o = table(spark, d, "orders")
    some = o.select("o_orderkey").orderBy(F.rand(11)).limit(100)
    strange = some.join(o.select("o_orderkey"), "o_orderkey", "left_anti").agg(F.count("*").alias("strangers"))
    return some.agg(F.countDistinct("o_orderkey").alias("n")).join(strange)


@register("o11_newest_files", "select doc_id from documents order by n_chars desc, doc_id limit 100")
def newest_files(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100).select("doc_id")


@register("x13_credit_grants", "select c_custkey account, (floor(c_acctbal)::bigint + case when c_custkey % 3 = 0 then 2000 else 0 end)::bigint balance from customer")
def grants(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    ledger = c.select(F.col("c_custkey").alias("account"), F.floor("c_acctbal").alias("amount"), F.lit("opening").alias("kind"))
    return a.granted(ledger, c.where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("account"), F.lit(2000).cast("long").alias("amount")))[1]


@register("x14_refunds", "select o_custkey account, -floor(o_totalprice)::bigint amount, 'refund' kind from orders where o_orderstatus = 'P'")
def refunds(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    payments = o.select(F.col("o_orderkey").alias("payment"), F.col("o_custkey").alias("account"), F.floor("o_totalprice").alias("amount"))
    r = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("payment"), F.col("o_orderdate").alias("at"))
    return a.refunded(payments, r.unionByName(r).unionByName(r.withColumn("payment", -F.col("payment"))))[1]


@register("x15_transfers", "select o_orderkey payment, case when o_custkey % 5 = 0 then o_custkey + 1000000 else o_custkey end account from orders")
def transfers(spark: SparkSession, d: str) -> DataFrame:
    payments = table(spark, d, "orders").select(F.col("o_orderkey").alias("payment"), F.col("o_custkey").alias("account"))
    moves = table(spark, d, "customer").where("c_custkey % 5 = 0").select(F.col("c_custkey").alias("old"), (F.col("c_custkey") + 1_000_000).alias("new"))
    return a.transferred({"payments": payments}, moves)["payments"].select("payment", "account")


@register("x16_restored", "select user_id, arg_max(event_type, event_id) event_type from events group by 1 having arg_max(event_type, event_id) <> 'error'")
def restored(spark: SparkSession, d: str) -> DataFrame:
    """An error deletes a user's row, any later event brings it back."""
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_type") == "error", F.col("ts")).alias("deleted"))
    return a.alive(e, ["user_id"], "event_id").select("user_id", "event_type")


@register("x17_probe", "select c_custkey, exists(select 1 from orders where o_custkey = c_custkey) there from customer")
def probe(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), F.lit(True).alias("hit")).distinct()
    return table(spark, d, "customer").join(o, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("there"))


@register("k4_absent_rows", "select n_nationkey k, n_name v from nation union all select c_custkey k, c_name v from customer c where not exists (select 1 from nation n where n.n_nationkey = c.c_custkey)")
def absent(spark: SparkSession, d: str) -> DataFrame:
    n, c = table(spark, d, "nation"), table(spark, d, "customer")
    return sinks.insert_if_absent(n.select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v")), c.select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v")), ["k"])


@register("k5_upserted", "select k, arg_max(v, seq) v from (select n_nationkey k, n_name v, 0 seq from nation union all select s_suppkey k, s_name v, 1 seq from supplier) group by k")
def upserted(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("v"), F.lit(0).alias("seq"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"), F.col("s_name").alias("v"), F.lit(1).alias("seq"))
    return sinks.upsert(n, s, ["k"], "seq").select("k", "v")


@register("k7_vectors", "select vec_id, case when vec_id % 4 = 0 then label + 100 else label end as label from embeddings")
def vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of which a part is written again with another payload."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.lit(0).alias("at"))
    return sinks.upsert(e, e.where("vec_id % 4 = 0").select("vec_id", (F.col("label") + 100).alias("label"), F.lit(1).alias("at")), ["vec_id"], "at").select("vec_id", "label")


@register("k9_cascade", "select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders join customer on o_custkey = c_custkey where c_mktsegment <> 'BUILDING')")
def cascaded(spark: SparkSession, d: str) -> DataFrame:
    """Customers go, then the orders without one, then the lines without an order."""
    left = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'")
    orders = sinks.cascade(left, "c_custkey", [(table(spark, d, "orders"), "o_custkey")])[0]
    return sinks.cascade(orders, "o_orderkey", [(table(spark, d, "lineitem"), "l_orderkey")])[0].select("l_orderkey", "l_linenumber")


@register(
    "k10_replaced_sets",
    """with old as (select conv_id as owner, turn as position, role as item from conversations) select * from old where owner % 2 = 1
    union all select owner, i, (['one', 'two', 'three'])[(i + 1)::int] from (select distinct owner from old where owner % 2 = 0), (select unnest(range(0, 3)) i)""",
)
def replaced_sets(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "conversations").select(F.col("conv_id").alias("owner"), F.col("turn").cast("int").alias("position"), F.col("role").alias("item"))
    new = old.where("owner % 2 = 0").select("owner").distinct().withColumn("items", F.array(*map(F.lit, ("one", "two", "three"))))
    return sinks.replace_set(old, new, "owner", "items").withColumn("position", F.col("position").cast("long"))


@register(
    "k14_nested_export",
    """select c.conv_id, count(*) messages, sum(length(text))::bigint chars, max(turn) last from conversations c group by 1""",
)
def nested_export(spark: SparkSession, d: str) -> DataFrame:
    """Every conversation as one JSON text, read back."""
    c = table(spark, d, "conversations")
    key = F.concat(F.lit("m"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    sessions = c.select(F.col("conv_id").cast("string").alias("id")).distinct().withColumn("title", F.lit("t"))
    messages = c.select(key.alias("id"), F.col("conv_id").cast("string").alias("session_id"), "role", F.col("turn").alias("position"))
    parts = c.select(key.alias("message_id"), F.concat(F.lit("p"), F.col("turn").cast("string")).alias("id"), F.lit(0).alias("position"), F.lit("text").alias("type"), "text")
    out = sinks.nested_sessions(sessions, messages, parts)
    shape = "struct<info: struct<id: string>, messages: array<struct<info: struct<id: string, role: string>, parts: array<struct<id: string, type: string, text: string>>>>>"
    read = out.select(F.from_json("body", shape).alias("b")).select(F.col("b.info.id").cast("long").alias("conv_id"), F.col("b.messages").alias("m"))
    chars = F.aggregate("m", F.lit(0).cast("long"), lambda s, x: s + F.length(x["parts"][0]["text"]))
    last = F.substring_index(F.element_at("m", -1)["info"]["id"], "-", -1).cast("long")
    return read.select("conv_id", F.size("m").cast("long").alias("messages"), chars.alias("chars"), last.alias("last"))


@register("w10_per_seat_value", "select o_orderkey, round(o_totalprice / count(*) over (partition by o_custkey), 6) share from orders")
def per_seat(spark: SparkSession, d: str) -> DataFrame:
    """Each order's value over the number of its customer's; counts are made before they meet the rows."""
    o = table(spark, d, "orders")
    n = o.groupBy("o_custkey").agg(F.count("*").alias("n"))
    return o.join(n, "o_custkey").select("o_orderkey", F.round(F.col("o_totalprice") / F.col("n"), 6).alias("share"))


@register(
    "k11_counters_written_back",
    """with recursive e as (select user_id, ts, event_id % 100 c, row_number() over (partition by user_id order by ts, event_id % 100) i from events),
    f as (select user_id, i, ts anchor, c usage from e where i = 1
        union all select e.user_id, e.i, case when e.ts - f.anchor <= interval 5 hour then f.anchor else e.ts end, case when e.ts - f.anchor <= interval 5 hour then f.usage + e.c else e.c end
        from f join e on e.user_id = f.user_id and e.i = f.i + 1),
    r as (select user_id, arg_max(anchor, i) anchor, arg_max(usage, i)::bigint as rolling from f group by user_id),
    m as (select *, max(ts) over (partition by user_id) last from e)
    select user_id, (sum(c) filter (where date_trunc('week', ts) = date_trunc('week', last)))::bigint weekly, (sum(c) filter (where date_trunc('month', ts) = date_trunc('month', last)))::bigint monthly, rolling, anchor
    from m join r using (user_id) group by user_id, rolling, anchor""",
)
def counters_written_back(spark: SparkSession, d: str) -> DataFrame:
    """Two batches of charges, the second one given twice, counted into a table that is rewritten where they touch it."""
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 100).alias("cost"))
    kept = Ledger(spark, shared_path(spark, "ledger"), 5 * 3600)
    middle = F.lit("2024-01-16").cast("timestamp")
    kept.apply("first", e.where(F.col("ts") < middle))
    for _ in range(2):
        kept.apply("second", e.where(F.col("ts") >= middle))
    return kept.rows().select(F.col("key").alias("user_id"), "weekly", "monthly", "rolling", F.col("anchor").cast("timestamp_ntz").alias("anchor"))
