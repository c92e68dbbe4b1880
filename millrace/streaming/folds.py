"""Streams of events: continuous snapshots, quota windows and the fold of an event log. Event time is our extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from millrace.streaming.scans import Register, Rolling, scan


def stream_of(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet folder, or one file, as a stream with the schema that it has now."""
    batch = spark.read.parquet(path)
    reader = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", files_per_trigger)
    folder, _, name = path.rstrip("/").rpartition("/")
    if all(f.rstrip("/").endswith(f"/{name}") for f in batch.inputFiles()):
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def run_to_files(stream: DataFrame, name: str, mode: str = "complete") -> DataFrame:
    """Process what is there now into files of the shared folder, and return the result as they hold it.

    A batch's rows are one folder, which a batch that runs again writes again; in ``complete`` mode the last one is
    the result, in the other modes all of them are, each row with the number of its ``batch``.
    """
    from millrace.sources.shared import shared_path

    spark = stream.sparkSession
    path = shared_path(spark, name)
    last: list[int] = []

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/data/batch={batch}")
        last.append(batch)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    query.start().awaitTermination()
    schema = stream.schema
    if not last:
        return spark.createDataFrame([], schema)
    if mode == "complete":
        return spark.read.schema(schema).parquet(f"{path}/data/batch={max(last)}")
    return spark.read.option("basePath", f"{path}/data").parquet(f"{path}/data")


def weekly(usage: DataFrame, ts: str = "ts", late: str = "1 day") -> DataFrame:
    """Counts by user in weeks from Monday on; rows later than the watermark are dropped, which batch input never has."""
    week = F.window(F.col(ts), "7 days", "7 days", "4 days")
    timed = usage.withWatermark(ts, late) if usage.isStreaming else usage
    return timed.groupBy("user_id", week.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("week"), "n")


def rolling_quota(events: DataFrame, key: str, ts: str, cost: str, seconds: int) -> DataFrame:
    """Usage in windows anchored at their first event: one ``seconds`` or less after the anchor adds, a later one starts anew."""
    rows = events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(cost).cast("long").alias("c"))
    kind = dict(events.dtypes)[key]
    done = scan(rows, [key], ["t", "c"], f"{key} {kind}, t long, usage long", lambda: Rolling(seconds * 1_000_000))
    return done.select(key, F.timestamp_micros("t").alias("anchor"), "usage")


def rolling_quota_stream(stream: DataFrame, key: str, ts: str, cost: str, seconds: int) -> DataFrame:
    """The same over a stream: the state of a key is its anchor and usage; each batch updates the keys that it holds.

    Rows of a batch count in the order of their times; a row that is older than its key's anchor counts as if now.
    """
    kind = dict(stream.dtypes)[key]

    def update(k, frames, state):
        import pandas as pd

        fold = Rolling(seconds * 1_000_000)
        if state.exists:
            fold.anchor, fold.usage = state.get
        rows = sorted((int(t), int(c)) for f in frames for t, c in zip(f["t"], f["c"], strict=True))
        for t, c in rows:
            fold.step({"t": max(t, fold.anchor or t), "c": c})
        state.update((fold.anchor, fold.usage))
        yield pd.DataFrame([(k[0], fold.anchor, fold.usage)], columns=[key, "t", "usage"])

    rows = stream.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("t"), F.col(cost).cast("long").alias("c"))
    out = rows.groupBy(key).applyInPandasWithState(update, f"{key} {kind}, t long, usage long", "t long, usage long", "update", GroupStateTimeout.NoTimeout)
    return out.select(key, F.timestamp_micros("t").alias("anchor"), "usage")


def reduce_events(log: DataFrame, key: list[str]) -> DataFrame:
    """The state after a log of (key, seq, op, value) with ops ``set``, ``append`` and ``remove``.

    Appended values follow the last ``set``; a key whose last ``set`` or ``remove`` is a ``remove`` is gone.
    """
    kinds = dict(log.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in key) + ", value string"
    return scan(log.select(*key, "seq", "op", "value"), key, ["seq"], schema, Register)


def rehydrated(stream: DataFrame, text: str, tokens: dict[str, str], pattern: str = r"\[[A-Z][A-Z0-9_]+_\d+\]") -> DataFrame:
    """Tokens of complete records replaced by their values, statelessly."""
    from millrace.operators.privacy import restore

    pairs = [F.lit(x) for kv in tokens.items() for x in kv]
    return stream.withColumn(text, restore(F.col(text), F.create_map(*pairs), pattern)) if pairs else stream
