"""Registered queries of metering and billing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import billing as b
from millrace.plans.registry import register

USAGE = """usage as (
    select event_id id, 't' || (user_id % 40) tenant_id,
        case event_type when 'purchase' then 'ingest' when 'view' then 'rag_query' when 'click' then 'ai_infer' else 'other' end event_type,
        (floor(value * 100) * 1000)::bigint chars_in, json_extract_string(props, '$.k')::bigint * 400 tin,
        json_extract_string(props, '$.k')::bigint * 150 tout, ts from events)"""
SNAPSHOT = f"""{USAGE}, snap as (
    select tenant_id, strftime(ts, '%Y%m')::int period_ym, count_if(event_type = 'ingest')::bigint total_docs,
        sum(case when event_type = 'ingest' then chars_in else 0 end)::bigint total_chars_in, count_if(event_type = 'rag_query')::bigint total_rag_queries,
        sum(case when event_type = 'ai_infer' then tin else 0 end)::bigint total_ai_tokens_in,
        sum(case when event_type = 'ai_infer' then tout else 0 end)::bigint total_ai_tokens_out
    from usage group by 1, 2)"""
LIMITS = f"""{SNAPSHOT}, lim as (
    select *, case when substr(tenant_id, 2)::int % 10 = 0 then 'enterprise' when substr(tenant_id, 2)::int % 3 = 0 then 'business' else 'starter' end plan from snap),
p(plan, ld, lc, lr, la) as (values ('starter', 10, 50000, 5, 5000), ('business', 20, 500000, 50, 50000), ('enterprise', null, null, null, null)),
j as (select lim.*, ld * f ld, lc * f lc, lr * f lr, la * f la from lim join p using (plan), (select 1::bigint f))"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.usage_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def _small_plans(spark: SparkSession) -> DataFrame:
    """Plans with limits small enough for the test tables to pass them."""
    rows = [("starter", 10, 50000, 5, 5000), ("business", 20, 500000, 50, 50000), ("enterprise", None, None, None, None)]
    return spark.createDataFrame(rows, "plan string, lim_docs long, lim_chars long, lim_rag long, lim_ai long")


def limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    snap = b.monthly_snapshot(usage(spark, sf_dir))
    n = F.substring("tenant_id", 2, 9).cast("int")
    plan = F.when(n % 10 == 0, "enterprise").when(n % 3 == 0, "business").otherwise("starter").alias("plan")
    tenants = snap.select("tenant_id", plan).distinct()
    return b.with_plan(snap, _small_plans(spark), tenants)


@register("d4_2_monthly_snapshot", f"with {SNAPSHOT} select * from snap")
def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.monthly_snapshot(usage(spark, sf_dir))


@register(
    "d4_3_cap_check",
    f"""with {LIMITS} select tenant_id, period_ym, plan, case
        when total_docs >= ld then 'monthly document cap of ' || ld || ' reached (' || total_docs || ' used)'
        when total_chars_in >= lc then 'monthly character cap of ' || lc || ' reached (' || total_chars_in || ' used)'
        when total_rag_queries >= lr then 'monthly RAG query cap of ' || lr || ' reached (' || total_rag_queries || ' used)'
        when total_ai_tokens_in + total_ai_tokens_out >= la then 'monthly AI token cap of ' || la || ' reached (' || (total_ai_tokens_in + total_ai_tokens_out) || ' used)'
        end message from j""",
)
def cap_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limited(spark, sf_dir).select("tenant_id", "period_ym", "plan", b.cap_message().alias("message"))


OVER = f"""{LIMITS}, o as (select *, coalesce(greatest(total_docs - ld, 0), 0) od, coalesce(greatest(total_chars_in - lc, 0), 0) oc,
    coalesce(greatest(total_rag_queries - lr, 0), 0) orq, coalesce(greatest(total_ai_tokens_in - la // 2, 0), 0) oi, coalesce(greatest(total_ai_tokens_out - la // 2, 0), 0) oo from j),
m as (select *, od * 8000 md, oc * 40000 // 1000000 mc, orq * 4000 mr, oi * 150000 // 1000000 mi, oo * 200000 // 1000000 mo from o)"""


@register("d4_4_overage", f"with {OVER} select tenant_id, period_ym, plan, (md + mc + mr + mi + mo)::bigint overage_millicents from m")
def overage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limited(spark, sf_dir).select("tenant_id", "period_ym", "plan", b.overage_millicents().alias("overage_millicents"))


@register(
    "d4_5_invoice_lines",
    f"""with {OVER}, l as (
        select tenant_id, period_ym, 0 pos, 'Document overage (' || od || ' docs)' description, od quantity, md mcost from m where od > 0
        union all select tenant_id, period_ym, 1, 'Character overage (' || oc || ' chars)', oc, mc from m where oc > 0
        union all select tenant_id, period_ym, 2, 'RAG search overage (' || orq || ' queries)', orq, mr from m where orq > 0
        union all select tenant_id, period_ym, 3, 'AI token (input) overage (' || oi || ' tokens)', oi, mi from m where oi > 0
        union all select tenant_id, period_ym, 4, 'AI token (output) overage (' || oo || ' tokens)', oo, mo from m where oo > 0)
    select tenant_id, period_ym, (row_number() over (partition by tenant_id, period_ym order by pos) - 1)::int line, description, quantity::bigint quantity, mcost / 100000.0 total_eur from l""",
)
def invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = b.invoices(limited(spark, sf_dir)).select("tenant_id", "period_ym", F.posexplode("lines").alias("line", "l"))
    return lines.select("tenant_id", "period_ym", "line", "l.description", "l.quantity", "l.total_eur")


@register(
    "a10_summing_merge",
    f"with {USAGE} select tenant_id, strftime(ts, '%Y-%m') as month, sum(tin)::bigint tokens_in, sum(tout)::bigint tokens_out, count(*)::bigint requests from usage group by 1, 2",
)
def summing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage(spark, sf_dir).groupBy("tenant_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.sum("ai_tokens_in").alias("tokens_in"), F.sum("ai_tokens_out").alias("tokens_out"), F.count("*").alias("requests")
    )
