"""Sequential folds over the rows of a key in their order.

Rows are dealt by key and sorted, and each task walks its rows once in Arrow batches with the state of one key at a
time, so a key of any length needs no more memory than its state; nothing is gathered per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def scan(rows: DataFrame, keys: list[str], order: list[str | Column], schema: str, make: Callable[[], object]) -> DataFrame:
    """What a state machine gives for every key: ``make()`` begins a key, ``step(row)`` takes a row (a dict) and returns
    rows (tuples), ``end()`` returns the last ones. Keys stand in front of each returned row, in a frame of ``schema``.
    """
    out = StructType.fromDDL(schema)
    arrow = to_arrow_schema(out)

    def of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, made = None, None, []

        def flush() -> pa.RecordBatch:
            columns = zip(*made, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            for row in batch.to_pylist():
                now = tuple(row[k] for k in keys)
                if state is None or now != key:
                    if state is not None:
                        made += [(*key, *x) for x in state.end()]
                    key, state = now, make()
                made += [(*key, *x) for x in state.step(row)]
            if len(made) >= 10_000:
                yield flush()
                made = []
        if state is not None:
            made += [(*key, *x) for x in state.end()]
        if made:
            yield flush()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(of_task, out)


class Rolling:
    """Usage since an anchor: a row up to ``micros`` after the anchor adds, a later one is the next anchor."""

    def __init__(self, micros: int):
        self.micros, self.anchor, self.usage = micros, None, 0

    def step(self, row: dict) -> list:
        if self.anchor is not None and row["t"] - self.anchor <= self.micros:
            self.usage += row["c"]
        else:
            self.anchor, self.usage = row["t"], row["c"]
        return []

    def end(self) -> list:
        return [(self.anchor, self.usage)]


class Register:
    """A value that is set, appended to and removed."""

    def __init__(self):
        self.parts, self.gone = [], False

    def step(self, row: dict) -> list:
        if row["op"] == "append":
            self.parts += [] if self.gone else [row["value"] or ""]
        else:
            self.gone = row["op"] == "remove"
            self.parts = [] if self.gone else [row["value"] or ""]
        return []

    def end(self) -> list:
        return [] if self.gone or not self.parts else [("".join(self.parts),)]


class IpLimit:
    """Requests by day: twice the daily limit while the client's accepted requests are below seven times it, then the limit."""

    def __init__(self, daily: int):
        self.daily, self.lifetime, self.day, self.today = daily, 0, None, 0

    def step(self, row: dict) -> list:
        if row["day"] != self.day:
            self.day, self.today = row["day"], 0
        new = self.lifetime < 7 * self.daily
        ok = self.today < (2 * self.daily if new else self.daily)
        if ok:
            self.today += 1
            self.lifetime += new
        return [(row["id"], ok)]

    def end(self) -> list:
        return []


class Breaker:
    """A circuit breaker over outcomes: ``threshold`` failures in a row open it; after ``cooldown`` seconds one try decides."""

    def __init__(self, threshold: int, cooldown: float):
        self.threshold, self.cooldown, self.failures, self.opened = threshold, cooldown, 0, None

    def step(self, row: dict) -> list:
        if self.opened is not None and row["t"] - self.opened < self.cooldown * 1_000_000:
            return [(row["id"], "rejected")]
        half = self.opened is not None
        if row["ok"]:
            self.failures, self.opened = 0, None
        else:
            self.failures += 1
            if half or self.failures >= self.threshold:
                self.opened = row["t"]
        return [(row["id"], "tried" if half else "closed")]

    def end(self) -> list:
        return []


class Bucket:
    """A token bucket: ``rate`` tokens a second up to ``most``; a request without a whole token is refused."""

    def __init__(self):
        self.at, self.tokens = None, 0.0

    def step(self, row: dict) -> list:
        rate, most = row["per_minute"] / 60.0, float(row["per_minute"])
        self.tokens = most if self.at is None else min(most, self.tokens + (row["t"] - self.at) / 1e6 * rate)
        self.at = row["t"]
        ok = self.tokens >= 1
        self.tokens -= ok
        return [(row["id"], bool(ok))]

    def end(self) -> list:
        return []


def micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))
