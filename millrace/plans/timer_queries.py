"""Registered queries of keyed state with timers, run as streams over the table's rows in the order of their times."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.plans.registry import register
from millrace.plans.streaming_queries import store_entries_sql, store_log
from millrace.sources.tables import table
from millrace.streaming import timers

HOUR_MS = 3_600_000
#: Micro-batches of a replayed table, at least, and the most rows of one.
LEAST_SLICES, SLICE_ROWS = 6, 2_000_000


def _replayed(rows: DataFrame, order: str, closing: str | None) -> DataFrame:
    """A table as a stream of many micro-batches that follow each other in a column's order."""
    slices = max(LEAST_SLICES, -(-rows.count() // SLICE_ROWS))
    return timers.stream_in_order(rows.sparkSession, timers.staged(rows, order, slices, closing), rows.schema)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return _replayed(table(spark, d, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "365 days")


# Rows in order with the start of the batch that they belong to; CLOSES is when a batch that opened at f.opened ends.
ANCHORED = """recursive r as (select user_id k, (epoch_us(ts) // 1000) t, event_id seq, event_type n, row_number() over (partition by user_id order by (epoch_us(ts) // 1000), event_id) i from events where user_id is not null and ts is not null),
    f as (select k, i, t opened, seq, n from r where i = 1
        union all select r.k, r.i, case when r.t >= CLOSES then r.t else f.opened end, r.seq, r.n from f join r on r.k = f.k and r.i = f.i + 1)"""
EVICTED = "((f.opened + 1800000 + 299999) // 300000 * 300000)"


@register(
    "x20_debounced_sync",
    f"with {ANCHORED.replace('CLOSES', f'f.opened + {HOUR_MS}')} select k as key, opened, opened + {HOUR_MS} sent, n as name, arg_max(seq, i)::varchar as value, arg_max(seq, i) seq from f group by k, opened, n",
)
def debounced(spark: SparkSession, d: str) -> DataFrame:
    """A user's events in batches that are sent an hour after their first one, with the last of each kind."""
    return timers.synced(_events(spark, d), "user_id", "ts", "event_id", "event_type", "event_id", HOUR_MS).drop("batch")


SESSIONS = f"with {ANCHORED.replace('CLOSES', EVICTED)}, s as (select k, opened created, {EVICTED} evicted, count(*) requests from f group by k, opened)"


@register("st7_evictions", f"{SESSIONS} select k as key, created, evicted, requests from s")
def evictions(spark: SparkSession, d: str) -> DataFrame:
    """Every session, from its first request to the first look at which it is thirty minutes old."""
    return timers.evictions(_events(spark, d), "user_id", "ts", "event_id").drop("batch")


@register("st7_live_sessions", f"{SESSIONS} select k as user_id, created from s where evicted > (select max(epoch_us(ts) // 1000) from events)")
def live_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that no look has found to be thirty minutes old when the last request comes."""
    now = table(spark, d, "events").agg(F.unix_millis(F.max(F.col("ts").cast("timestamp"))).alias("now"))  # one row
    made = timers.evictions(_events(spark, d), "user_id", "ts", "event_id")
    return made.join(F.broadcast(now)).where("evicted > now").select(F.col("key").alias("user_id"), "created")


@register("st14_store_stream", store_entries_sql())
def store_stream(spark: SparkSession, d: str) -> DataFrame:
    """The client's store, kept as state over micro-batches of its event log."""
    return timers.store_after(timers.store_changes(_replayed(store_log(spark, d), "seq", None)))
