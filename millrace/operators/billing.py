"""Metering to invoices: usage events -> monthly snapshots -> caps, overage and invoices. Money is in millicents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Monthly limits and rates of the plans; None is no limit. Rates are EUR millicents.
PLANS = {
    "starter": {"docs": 1_000, "chars": 5_000_000, "rag": 500, "ai": 500_000, "rpm": 60, "concurrent": 5},
    "business": {"docs": 10_000, "chars": 50_000_000, "rag": 5_000, "ai": 5_000_000, "rpm": 300, "concurrent": 20},
    "enterprise": {"docs": None, "chars": None, "rag": None, "ai": None, "rpm": 1_000, "concurrent": 100},
}
RATES = {"doc": 8_000, "char_million": 40_000, "rag": 4_000, "token_in_million": 150_000, "token_out_million": 200_000, "l2_doc": 2_000}
MILLICENTS = 100_000


def plan_table(spark: SparkSession) -> DataFrame:
    """One row per plan; three rows, so joins with it may always be broadcast."""
    rows = [(name, *p.values()) for name, p in PLANS.items()]
    schema = "plan string, lim_docs long, lim_chars long, lim_rag long, lim_ai long, rpm int, concurrent int"
    return spark.createDataFrame(rows, schema)


def usage_events(events: DataFrame) -> DataFrame:
    """The event stream as metering records; tenants are groups of users."""
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.create_map(*[F.lit(x) for p in (("purchase", "ingest"), ("view", "rag_query"), ("click", "ai_infer")) for x in p])
    return events.select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("t"), F.col("user_id") % 40).alias("tenant_id"),
        F.coalesce(kind[F.col("event_type")], F.lit("other")).alias("event_type"),
        F.lit(1).cast("long").alias("doc_count"),
        (F.floor(F.col("value") * 100) * 1000).cast("long").alias("chars_in"),
        (k * 400).alias("ai_tokens_in"),
        (k * 150).alias("ai_tokens_out"),
        F.col("ts"),
    )


def monthly_snapshot(usage: DataFrame) -> DataFrame:
    """Totals by tenant and month; sums are 64-bit and partial sums are combined before the shuffle."""
    ai = F.col("event_type") == "ai_infer"
    return usage.groupBy("tenant_id", F.date_format("ts", "yyyyMM").cast("int").alias("period_ym")).agg(
        F.count_if(F.col("event_type") == "ingest").alias("total_docs"),
        F.sum(F.when(F.col("event_type") == "ingest", F.col("chars_in")).otherwise(0)).alias("total_chars_in"),
        F.count_if(F.col("event_type") == "rag_query").alias("total_rag_queries"),
        F.sum(F.when(ai, F.col("ai_tokens_in")).otherwise(0)).alias("total_ai_tokens_in"),
        F.sum(F.when(ai, F.col("ai_tokens_out")).otherwise(0)).alias("total_ai_tokens_out"),
    )


def over(used: Column, limit: Column) -> Column:
    """What is used above a limit; nothing without one."""
    return F.when(limit.isNull(), F.lit(0)).otherwise(F.greatest(used - limit, F.lit(0))).cast("long")


def per_million(quantity: Column, rate: int) -> Column:
    """quantity * rate div 1 000 000 with a 128-bit product."""
    return F.floor(quantity.cast("decimal(28,0)") * F.lit(rate) / F.lit(1_000_000)).cast("long")


def with_plan(snapshots: DataFrame, plans: DataFrame, tenants: DataFrame) -> DataFrame:
    """Snapshots with their tenant's limits; a tenant without a plan is on ``starter``."""
    named = snapshots.join(tenants, "tenant_id", "left").withColumn("plan", F.coalesce("plan", F.lit("starter")))
    return named.join(F.broadcast(plans), "plan")


def cap_message() -> Column:
    """The first cap that a snapshot with limits has reached, as text, or null."""
    ai = F.col("total_ai_tokens_in") + F.col("total_ai_tokens_out")
    out = F.lit(None).cast("string")
    checks = (
        ("document", F.col("total_docs"), F.col("lim_docs")),
        ("character", F.col("total_chars_in"), F.col("lim_chars")),
        ("RAG query", F.col("total_rag_queries"), F.col("lim_rag")),
        ("AI token", ai, F.col("lim_ai")),
    )
    for name, used, limit in reversed(checks):
        said = F.format_string(f"monthly {name} cap of %d reached (%d used)", limit, used)
        out = F.when(used >= limit, said).otherwise(out)
    return out


def overages() -> list[tuple[str, Column, Column, float]]:
    """Of each charge: name and unit, quantity over the limit, cost in millicents, and the unit price in EUR."""
    half = F.floor(F.col("lim_ai") / 2)
    docs = over(F.col("total_docs"), F.col("lim_docs"))
    chars = over(F.col("total_chars_in"), F.col("lim_chars"))
    rag = over(F.col("total_rag_queries"), F.col("lim_rag"))
    t_in, t_out = over(F.col("total_ai_tokens_in"), half), over(F.col("total_ai_tokens_out"), half)
    return [
        ("Document overage (%d docs)", docs, docs * RATES["doc"], RATES["doc"] / MILLICENTS),
        ("Character overage (%d chars)", chars, per_million(chars, RATES["char_million"]), RATES["char_million"] / MILLICENTS / 1e6),
        ("RAG search overage (%d queries)", rag, rag * RATES["rag"], RATES["rag"] / MILLICENTS),
        ("AI token (input) overage (%d tokens)", t_in, per_million(t_in, RATES["token_in_million"]), RATES["token_in_million"] / MILLICENTS / 1e6),
        ("AI token (output) overage (%d tokens)", t_out, per_million(t_out, RATES["token_out_million"]), RATES["token_out_million"] / MILLICENTS / 1e6),
    ]


def overage_millicents() -> Column:
    total = F.lit(0).cast("long")
    for _, _, cost, _ in overages():
        total = total + cost
    return total


def invoice_lines() -> Column:
    """The charged lines in fixed order."""
    lines = [
        F.struct(
            F.format_string(text, n).alias("description"),
            n.alias("quantity"),
            F.lit(price).alias("unit_price_eur"),
            (cost / MILLICENTS).alias("total_eur"),
        )
        for text, n, cost, price in overages()
    ]
    return F.filter(F.array(*lines), lambda x: x["quantity"] > 0)


def invoices(snapshots: DataFrame) -> DataFrame:
    """One invoice per snapshot with limits."""
    return snapshots.select(
        "tenant_id", "period_ym", "plan", invoice_lines().alias("lines"), (overage_millicents() / MILLICENTS).alias("total_eur")
    )
