"""Sinks. A table is replaced by its next version: what a change leaves, adds, updates or removes is computed as a frame."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The target with those new rows whose keys it lacks; of new rows with equal keys, one."""
    return target.unionByName(new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti"))


def upsert(target: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest row of each key by ``version``; at equal versions the new one."""
    both = target.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    newest = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("__new"))
    return both.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "__new")


def increment(target: DataFrame, delta: DataFrame, keys: list[str], counters: list[str]) -> DataFrame:
    """Counters of the target plus those of the change, by key."""
    return target.unionByName(delta).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in counters])


def erase(frames: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Every frame without the rows whose key column is among the ids (a frame of one column)."""
    key = ids.columns[0]
    return {n: f.join(ids.select(F.col(key).alias(c)).distinct(), c, "left_anti") for n, (f, c) in frames.items()}


def cascade(parents: DataFrame, key: str, children: list[tuple[DataFrame, str]]) -> list[DataFrame]:
    """Children whose parent is still there."""
    return [c.join(parents.select(F.col(key).alias(k)), k, "left_semi") for c, k in children]


def replace_set(target: DataFrame, new: DataFrame, owner: str, items: str) -> DataFrame:
    """Rows (owner, position, item): all rows of the owners in ``new`` replaced by its array ``items``, in order."""
    rows = new.select(owner, F.posexplode(items).alias("position", "item"))
    return target.join(new.select(owner).distinct(), owner, "left_anti").unionByName(rows)


def write_json_lines(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).json(path)


def write_csv(df: DataFrame, path: str, sep: str = ",", mode: str = "append") -> None:
    """Quotes only where a cell needs them; a quote in a cell is doubled."""
    df.write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"').option("sep", sep).csv(path)


LEVELS = {"y": "yyyy", "m": "MM", "d": "dd", "h": "HH", "min": "mm", "s": "ss"}


def write_by_time(df: DataFrame, path: str, ts: str, model: str = "model", finest: str = "h") -> None:
    """JSON below ``data``, partitioned by model and time down to a level of LEVELS; rows without a model are left out."""
    parts = {k: v for i, (k, v) in enumerate(LEVELS.items()) if i <= list(LEVELS).index(finest)}
    timed = reduce(lambda f, kv: f.withColumn(kv[0], F.date_format(ts, kv[1])), parts.items(), df.where(F.col(model).isNotNull()))
    timed.write.mode("append").partitionBy(model, *parts).json(f"{path}/data")


#: Parts of a model below ``meta``. Readers and later writers rely on it.
META_PARTS = 64


def meta_part(session: Column) -> Column:
    """The part that holds a session: its text decides, so that it is the same for every writer and reader."""
    return F.pmod(F.xxhash64(session.cast("string")), F.lit(META_PARTS)).cast("int")


def write_meta(df: DataFrame, path: str, session: str, model: str = "model") -> None:
    """JSON below ``meta``, partitioned by model and part of the sessions; rows without a model are left out.

    A session's rows lie in one part, ``meta_part``, with the session in each row: a folder for each session would make
    as many folders and files as there are sessions. Spark splits parts that are large and joins small ones.
    """
    kept = df.where(F.col(model).isNotNull()).withColumn("part", meta_part(F.col(session)))
    kept.hint("rebalance", model, "part").write.mode("append").partitionBy(model, "part").json(f"{path}/meta")


def send_batches(stream: DataFrame, post, checkpoint: str, rows: int = 500):
    """Hand a stream's rows to ``post`` as lists of dicts of up to ``rows``, from the tasks that hold them.

    A batch that fails is handed over again, so ``post`` may see a row twice and never misses one.
    """

    def deliver(df: DataFrame, _: int) -> None:
        def of_task(part) -> None:
            held = []
            for r in part:
                held.append(r.asDict(recursive=True))
                if len(held) == rows:
                    post(held)
                    held = []
            if held:
                post(held)

        df.foreachPartition(of_task)

    return stream.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def nested_sessions(sessions: DataFrame, messages: DataFrame, parts: DataFrame) -> DataFrame:
    """(id, body): each session as JSON ``{info, messages: [{info, parts}]}`` in position order."""
    p = parts.groupBy("message_id").agg(F.array_sort(F.collect_list(F.struct("position", "id", "type", "text"))).alias("parts"))
    m = messages.join(p, messages["id"] == p["message_id"], "left")
    info = F.struct(F.col("id"), F.col("role")).alias("info")
    listed = m.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("position", info, F.coalesce("parts", F.array()).alias("parts")))).alias("messages"))
    joined = sessions.join(listed, sessions["id"] == listed["session_id"], "left")
    bare = F.transform("messages", lambda x: F.struct(x["info"].alias("info"), F.transform(x["parts"], lambda y: F.struct(y["id"].alias("id"), y["type"].alias("type"), y["text"].alias("text"))).alias("parts")))
    body = F.to_json(F.struct(F.struct("id", "title").alias("info"), F.coalesce(bare, F.array()).alias("messages")))
    return joined.select("id", body.alias("body"))


def write_stream(stream: DataFrame, path: str, checkpoint: str):
    """Append a stream to JSON lines; batches that failed are replayed from the checkpoint and none is dropped."""
    return stream.writeStream.format("json").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)
