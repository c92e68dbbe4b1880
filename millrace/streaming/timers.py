"""Keyed state with event-time timers: batches that close a while after they open, sessions that end a while after they begin, and the client's store kept over micro-batches.

The state of a key lives in Spark's RocksDB state store. Timers fire when the watermark passes them, so results depend on
event times only, not on when or in how many micro-batches rows arrive.

Rows of a key count in the order of (time, seq) within a micro-batch. Rows that are older than the watermark are dropped by Spark; one
that comes in a later micro-batch than an open batch's start counts as part of that batch. Rows with a null key or time are left out. At the end of a
bounded stream a timer that lies behind the last row has not fired; ``closing`` gives a row that moves the watermark on.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANCHOR, LAST = "opened long, closes long, n long", "value string, at long, seq long"
#: How far apart the looks at old sessions are, and how old one gets.
LOOK_MS, AGE_MS = 300_000, 1_800_000


class _StateStore:
    """The state store that timers need, for the streams that start within; the session keeps its own afterwards."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.NAME)
        self.spark.conf.set(self.NAME, STATE_STORE)

    def __exit__(self, *_) -> None:
        self.spark.conf.set(self.NAME, self.before)


class Anchored(StatefulProcessor):
    """Rows of a key from the first one, the anchor, until ``closes`` of its time; at the end ``closed`` says what they gave.

    Of a micro-batch only what is open at its end goes to the state. Each look at the state is a call to Spark, so a
    processor whose batches have no items (``HOLDS``) keeps no map of them.
    """

    HOLDS = True

    def closes(self, opened: int) -> int:
        raise NotImplementedError

    def take(self, items: dict, row: Row) -> None:
        """A row of the open batch, whose items it may change."""

    def closed(self, key: tuple, opened: int, closes: int, n: int, items: dict) -> Iterator[Row]:
        raise NotImplementedError

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.anchor = handle.getValueState("anchor", ANCHOR)
        if self.HOLDS:
            self.items = handle.getMapState("items", "name string", LAST)

    def _held(self) -> dict:
        if not self.HOLDS:
            return {}
        return {name: tuple(last) for (name,), last in self.items.iterator()}

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        anchor = stored = _tuple(self.anchor.get())
        held = self._held() if stored else {}
        items = dict(held)
        for row in sorted(rows, key=lambda r: (r.t, r.seq)) if key[0] is not None else ():
            if anchor and row.t >= anchor[1]:
                yield from self.closed(key, *anchor, items)
                anchor, items = None, {}
            opened, closes, n = anchor or (row.t, self.closes(row.t), 0)
            anchor = (opened, closes, n + 1)
            self.take(items, row)
        if anchor and anchor != stored:
            if stored and stored[:2] != anchor[:2]:
                self.handle.deleteTimer(stored[1])
                if held:
                    self.items.clear()
                held = {}
            if not stored or stored[:2] != anchor[:2]:
                self.handle.registerTimer(anchor[1])
            self.anchor.update(anchor)
            for name, last in items.items():
                if held.get(name) != last:
                    self.items.updateValue((name,), last)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        anchor = _tuple(self.anchor.get())
        if anchor and anchor[1] <= expiredTimerInfo.getExpiryTimeInMs():
            held = self._held()
            yield from self.closed(key, *anchor, held)
            self.anchor.clear()
            if held:
                self.items.clear()

    def close(self) -> None:
        pass


def _tuple(row) -> tuple | None:
    """A value of the state, of which Spark gives none where there is none."""
    return tuple(row) if row is not None else None


class Debounced(Anchored):
    """Items by name; a batch is sent ``delay_ms`` after its first item, with the last value of each name."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def closes(self, opened: int) -> int:
        return opened + self.delay_ms

    def take(self, items: dict, row: Row) -> None:
        items[row.name or ""] = (row.value, row.t, row.seq)

    def closed(self, key: tuple, opened: int, closes: int, n: int, items: dict) -> Iterator[Row]:
        for name, (value, _, seq) in items.items():
            yield Row(key=key[0], opened=opened, sent=closes, name=name, value=value, seq=seq)


class Evicted(Anchored):
    """Sessions that go at the first look, one every ``look_ms``, at which they are ``age_ms`` old since they were made.

    Use does not keep a session alive; a request after it went makes a new one.
    """

    HOLDS = False

    def __init__(self, age_ms: int, look_ms: int):
        self.age_ms, self.look_ms = age_ms, look_ms

    def closes(self, opened: int) -> int:
        return -(-(opened + self.age_ms) // self.look_ms) * self.look_ms

    def closed(self, key: tuple, opened: int, closes: int, n: int, items: dict) -> Iterator[Row]:
        yield Row(key=key[0], created=opened, evicted=closes, requests=n)


def _timed(rows: DataFrame, key: str, ts: str, late: str, *others) -> DataFrame:
    """(key, time, t, seq, ...) with a watermark; ``t`` is the time in milliseconds."""
    time = F.col(ts).cast("timestamp")
    own = rows.select(F.col(key).alias("key"), time.alias("time"), F.unix_millis(time).alias("t"), *others)
    # One condition on both, which Spark does not move before the watermark: a row without a key still moves it on.
    return own.withWatermark("time", late).where(F.expr("if(time is null, false, key is not null)"))


def _run(grouped, processor, schema: str, name: str) -> DataFrame:
    """What a processor gave for all rows that are there now, as the files of the shared folder hold it."""
    from millrace.streaming.folds import run_to_files

    out = grouped.transformWithState(processor, schema, "append", "eventtime")
    with _StateStore(out.sparkSession):
        return run_to_files(out, name, "append")


def synced(stream: DataFrame, key: str, ts: str, seq: str, name: str, value: str, delay_ms: int = 1_000, late: str = "0 seconds") -> DataFrame:
    """(key, opened, sent, name, value, seq): batches of a session's items, each sent ``delay_ms`` after its first item.

    Of each name the last value goes. Times are milliseconds since the epoch.
    """
    kind = dict(stream.dtypes)[key]
    items = (F.col(name).cast("string").alias("name"), F.col(value).cast("string").alias("value"), F.col(seq).cast("long").alias("seq"))
    rows = _timed(stream, key, ts, late, *items)
    schema = f"key {kind}, opened long, sent long, name string, value string, seq long"
    return _run(rows.groupBy("key"), Debounced(delay_ms), schema, "synced")


def evictions(stream: DataFrame, key: str, ts: str, seq: str, age_ms: int = AGE_MS, look_ms: int = LOOK_MS, late: str = "0 seconds") -> DataFrame:
    """(key, created, evicted, requests): every session that was made, when it went, and the requests that it served."""
    kind = dict(stream.dtypes)[key]
    rows = _timed(stream, key, ts, late, F.col(seq).cast("long").alias("seq"))
    return _run(rows.groupBy("key"), Evicted(age_ms, look_ms), f"key {kind}, created long, evicted long, requests long", "evictions")


class KeptStore(StatefulProcessor):
    """The client's store of a session: its entries are a map in the state, and a micro-batch gives the entries that it changed.

    Events of a session count in the order of their numbers; one whose number is not above the last one taken came too
    late, or again, and changes nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "kind string, id long, part long", "value string")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        from millrace.streaming.store import SessionState

        last = _tuple(self.last.get())
        last = last and last[0]
        events = [e for e in sorted(rows, key=lambda e: e.seq) if last is None or e.seq > last]
        if not events:
            return
        held = {_entry(k): v[0] for k, v in self.entries.iterator()} if last is not None else {}
        session = SessionState()
        session.entries = dict(held)
        for e in events:
            if last is None or e.seq > last:
                session.step(e.asDict())
                last = e.seq
        self.last.update((last,))
        for entry in held.keys() - session.entries.keys():
            self.entries.removeKey(_stored(entry))
            yield Row(session=key[0], kind=entry[0], id=entry[1], part=entry[2], value=None, gone=True, seq=last)
        for entry, value in session.entries.items():
            if entry not in held or held[entry] != value:
                self.entries.updateValue(_stored(entry), (value,))
                yield Row(session=key[0], kind=entry[0], id=entry[1], part=entry[2], value=value, gone=False, seq=last)

    def close(self) -> None:
        pass


def _stored(entry: tuple) -> tuple:
    """The key of an entry in the state, which has no nulls."""
    return tuple(-(1 << 62) if x is None else x for x in entry)


def _entry(stored: tuple) -> tuple:
    return tuple(None if x == -(1 << 62) else x for x in stored)


CHANGES = "session long, kind string, id long, part long, value string, gone boolean, seq long"


def store_changes(events: DataFrame) -> DataFrame:
    """(session, kind, id, part, value, gone, seq): what each micro-batch of the event log changes in the store.

    The events are those of ``store.entries``.
    """
    from millrace.streaming.folds import run_to_files

    own = events.where("session is not null and seq is not null").select("session", "seq", "type", "id", "part", "archived", "value")
    out = own.groupBy("session").transformWithState(KeptStore(), CHANGES, "append", "none")
    with _StateStore(events.sparkSession):
        return run_to_files(out, "store", "append")


def store_after(changes: DataFrame) -> DataFrame:
    """(session, kind, id, part, value): the entries that are left after all changes."""
    last = changes.groupBy("session", "kind", "id", "part").agg(F.max_by(F.struct("value", "gone"), "seq").alias("c"))
    return last.where("not c.gone").select("session", "kind", "id", "part", "c.value")


def staged(rows: DataFrame, order: str, slices: int, closing: str | None = "365 days") -> str:
    """Write a table as a folder of at most ``slices`` files that follow each other in the order of a column; its path.

    Files are ranges of the column, written in one job, and get times of modification in the same order, in which a
    stream reads them; object stores do not keep such times. Rows without a value there are left out. For a time, the last
    file has one row more, with nothing but a time ``closing`` after all others, so that every timer fires.
    """
    from millrace.sources.shared import shared_path

    spark = rows.sparkSession
    path = shared_path(spark, "staged")
    kept = rows.where(F.col(order).isNotNull())
    kept.repartitionByRange(slices, order).write.parquet(path)
    if closing:
        after = (F.max(F.col(order).cast("timestamp")) + F.expr(f"interval {closing}")).alias("__end")
        end = spark.read.schema(kept.schema).parquet(path).agg(after).where("__end is not null")
        row = end.select(*[F.col("__end").cast(t).alias(c) if c == order else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes])
        row.write.mode("append").parquet(path)
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")]
    newest = max((s.getModificationTime() for s in found), default=0)
    # Files of the second job are younger; within a job names count the ranges.
    jobs = {}
    for s in found:
        job = s.getPath().getName().split("-", 2)[2][:36]
        jobs[job] = min(jobs.get(job, s.getModificationTime()), s.getModificationTime())
    ordered = sorted(found, key=lambda s: (jobs[s.getPath().getName().split("-", 2)[2][:36]], s.getPath().getName()))
    for i, s in enumerate(ordered):
        fs.setTimes(s.getPath(), newest + 1_000 * i, -1)
    return path


def stream_in_order(spark: SparkSession, path: str, schema) -> DataFrame:
    """The files of ``staged`` as a stream, one for each micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
