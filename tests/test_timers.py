"""Timers against plain Python, over several micro-batches and on both sides of a batch's end."""

import datetime as dt

import numpy as np
import pytest

from millrace.streaming import timers

START = dt.datetime(2024, 1, 1)
SCHEMA = "user long, ts timestamp, id long, kind string"


def rows(n, seconds, seed):
    rng = np.random.default_rng(seed)
    at = np.sort(rng.integers(0, int(seconds * 1000), n))
    return [(int(rng.integers(6)), START + dt.timedelta(milliseconds=int(t)), i, "abc"[int(rng.integers(3))]) for i, t in enumerate(at)]


def replayed(spark, data, slices):
    frame = spark.createDataFrame(data, SCHEMA)
    return timers.stream_in_order(spark, timers.staged(frame, "ts", slices, "1 day"), frame.schema)


def millis(t):
    return round((t - dt.datetime(1970, 1, 1)).total_seconds() * 1000)


def anchored(data, closes):
    out = {}
    for user, ts, i, kind in sorted((r for r in data if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        own = out.setdefault(user, [])
        t = millis(ts)
        if not own or t >= closes(own[-1][0]):
            own.append((t, {}, []))
        own[-1][1][kind] = i
        own[-1][2].append(i)
    return out


EDGES = [(7, START + dt.timedelta(milliseconds=x), 1000 + x, "a") for x in (0, 1, 999, 1000, 1001, 1999, 2000, 9000)] + [(None, START, 5, "a"), (8, None, 6, "b")]


@pytest.mark.parametrize("slices", [1, 5])
def test_debounced(spark, slices):
    data = rows(150, 40, slices) + EDGES
    got = timers.synced(replayed(spark, data, slices), "user", "ts", "id", "kind", "id").collect()
    want = {(u, t, t + 1000, k, str(i), i) for u, own in anchored(data, lambda t: t + 1000).items() for t, items, _ in own for k, i in items.items()}
    assert {(r.key, r.opened, r.sent, r.name, r.value, r.seq) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("slices", [1, 4])
def test_evictions(spark, slices):
    data = rows(120, 6 * 3600, 9) + EDGES
    got = timers.evictions(replayed(spark, data, slices), "user", "ts", "id").collect()
    look = lambda t: -(-(t + timers.AGE_MS) // timers.LOOK_MS) * timers.LOOK_MS
    want = {(u, t, look(t), len(all_)) for u, own in anchored(data, look).items() for t, _, all_ in own}
    assert {(r.key, r.created, r.evicted, r.requests) for r in got} == want and len(got) == len(want)


def test_store_over_micro_batches(spark):
    kinds = ["message.updated", "message.part.updated", "message.part.delta", "message.removed", "session.deleted", "todo.updated", "session.created"]
    rng = np.random.default_rng(1)
    log = [(int(rng.integers(4)), i, kinds[int(rng.integers(7))], int(rng.integers(3)), int(rng.integers(2)), False, f"v{i}") for i in range(200)]
    events = spark.createDataFrame(log + log[50:60] + [(None, 9, "todo.updated", 1, 1, False, "x")], "session long, seq long, type string, id long, part long, archived boolean, value string")
    from millrace.streaming import store

    stream = timers.stream_in_order(spark, timers.staged(events, "seq", 6, None), events.schema)
    changes = timers.store_changes(stream)
    got = {tuple(r) for r in timers.store_after(changes).collect()}
    whole = store.entries(spark.createDataFrame(log, events.schema))
    assert got == {tuple(r) for r in whole.collect()} and got
    assert changes.groupBy("session", "kind", "id", "part", "seq").count().where("count > 1").count() == 0


def test_the_session_keeps_its_state_store(spark):
    name = timers._StateStore.NAME
    before = spark.conf.get(name)
    data = rows(5, 10, 3)
    timers.synced(replayed(spark, data, 1), "user", "ts", "id", "kind", "id").collect()
    assert spark.conf.get(name) == before
