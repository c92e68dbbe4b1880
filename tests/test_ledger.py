"""Counters that are written back, against a fold over all charges."""

import datetime as dt

import numpy as np
import pytest

from millrace.sources.commits import Conflict
from millrace.sources.ledger import Ledger

START = dt.datetime(2024, 1, 1)
HOUR = dt.timedelta(hours=1)


def fold(charges, window):
    out = {}
    for key, ts, cost in charges:
        if key is None or ts is None:
            continue
        w, m, r, last, anchor = out.get(key, (0, 0, 0, None, None))
        ts = max(ts, last) if last else ts
        monday = lambda t: t.date() - dt.timedelta(days=t.weekday())
        w = w + (cost or 0) if last and monday(last) == monday(ts) else cost or 0
        m = m + (cost or 0) if last and (last.year, last.month) == (ts.year, ts.month) else cost or 0
        r, anchor = (r + (cost or 0), anchor) if anchor and ts - anchor <= window else (cost or 0, ts)
        out[key] = w, m, r, ts, anchor
    return out


def rows(ledger):
    return {r.key: (r.weekly, r.monthly, r.rolling, r.last, r.anchor) for r in ledger.rows().collect()}


def frame(spark, charges):
    return spark.createDataFrame(charges, "key long, ts timestamp, cost long")


def test_batches_equal_a_fold(spark, tmp_path):
    rng = np.random.default_rng(6)
    charges = sorted((START + HOUR * float(h), int(k), int(c)) for h, k, c in zip(rng.uniform(0, 24 * 70, 400), rng.integers(0, 25, 400), rng.integers(0, 90, 400)))
    charges = [(k, t, c) for t, k, c in charges]
    ledger = Ledger(spark, str(tmp_path / "l"), 5 * 3600, buckets=8)
    for i in range(0, 400, 100):
        assert ledger.apply(f"b{i}", frame(spark, charges[i : i + 100]))
        assert not ledger.apply(f"b{i}", frame(spark, charges[i : i + 100]))
        assert not Ledger(spark, ledger.root, 5 * 3600, buckets=8).apply("b0", frame(spark, charges))
        assert rows(ledger) == fold(charges[: i + 100], 5 * HOUR)
    assert ledger.version() == 4


def test_only_touched_buckets_are_written(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), 3600, buckets=16)
    ledger.apply("a", frame(spark, [(i, START, 1) for i in range(100)]))
    before = ledger._folders(1)
    ledger.apply("b", frame(spark, [(3, START + HOUR / 2, 5)]))
    after = ledger._folders(2)
    assert len(before) == len(after) == 16 and sum(before[b] != after[b] for b in before) == 1
    assert len([p for p in (tmp_path / "l/rows").glob("*/bucket=*")]) == 17
    assert rows(ledger)[3][:3] == (6, 6, 6) and len(rows(ledger)) == 100
    assert {r.key for r in ledger.rows(version=1).collect() if r.weekly == 6} == set()


def test_late_null_and_no_charges(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), 3600)
    assert ledger.rows().count() == 0
    given = [(1, START + 30 * HOUR, 2), (None, START, 9), (2, None, 9), (3, START, None)]
    ledger.apply("x", frame(spark, given))
    ledger.apply("late", frame(spark, [(1, START, 4)]))
    ledger.apply("none", frame(spark, []))
    assert rows(ledger) == fold([given[0], given[3], (1, START, 4)], HOUR)
    assert not ledger.apply("none", frame(spark, [(1, START, 4)]))


def test_another_writer(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "l"), 3600)
    ledger.apply("x", frame(spark, [(1, START, 2)]))
    ledger.files.create("log/000000000002.json", '{"batch": "y", "buckets": {}}')
    ledger.version = lambda: 1
    with pytest.raises(Conflict):
        ledger.apply("z", frame(spark, [(1, START, 2)]))
    again = Ledger(spark, ledger.root, 3600)
    assert again.apply("z", frame(spark, [(1, START, 2)])) and not again.apply("z", frame(spark, [(1, START, 2)])) and again.version() == 3


def test_a_lost_writer_blocks_nobody_for_ever(spark, tmp_path, monkeypatch):
    from millrace.sources import commits

    ledger = Ledger(spark, str(tmp_path / "l"), 3600)
    (tmp_path / "l/log").mkdir(parents=True)
    (tmp_path / "l/log/000000000001.json.claim").touch()
    with pytest.raises(Conflict):
        ledger.apply("x", frame(spark, [(1, START, 2)]))
    assert ledger.version() == 0 and ledger.rows().count() == 0
    monkeypatch.setattr(commits, "ABANDONED_MS", -10_000)
    assert ledger.apply("x", frame(spark, [(1, START, 2)])) and rows(ledger)[1][:3] == (2, 2, 2)
