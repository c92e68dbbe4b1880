"""The filter audit against plain Python, copies over many ranges among the rows."""

import itertools
import re

import numpy as np
import pytest

from millrace.llm import audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def brute(rows, labels):
    smallest = {}
    for i, t, _ in rows:
        if i is not None:
            smallest[t or ""] = min(smallest.get(t or "", i), i)
    good, toxic = ({i for i, *v in labels if v[k] == 1 and i is not None} for k in (0, 1))
    masks = []
    for i, t, part in rows:
        t = t or ""
        words = WORD.findall(t)
        fails = set()
        fails |= {"A"} if len(words) < 200 else set()
        fails |= {"B"} if 100 * len(set(words)) < 50 * len(words) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 3 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and i > smallest[t] else set()
        masks.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {m[0] for m in masks}:
        own = [m for m in masks if m[0] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, itertools.permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [m for m in left if f in m[1]]
                left = [m for m in left if f not in m[1]]
                failing = sum(f in m[1] for m in own)
                out[part, order, step] = [len(left), len(gone), failing - len(gone), sum(m[1] == {f} for m in own), sum(m[2] for m in gone), sum(m[3] for m in gone)]
                shapley[f] += len(gone)
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(order, 1):
                out[part, order, step].append(shapley[f])
    return out


def texts():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(400)]
    for i in range(60):
        n = int(rng.integers(0, 320))
        t = " ".join(rng.choice(words[: int(rng.integers(3, 400))], n))
        yield t.upper() if i % 7 == 0 else t + " #" * (i % 5 == 0)
    yield from [None, "", "", " \n", "café É日", "x\x0by\x1cz", "long " * 40_000]


@pytest.mark.parametrize("partitions", [1, 13])
def test_audit(spark, partitions):
    rng = np.random.default_rng(partitions)
    pool = list(texts())
    hot = pool[3]
    rows = [(int(i), pool[int(rng.integers(len(pool)))] if i % 3 else hot, ["en", "de", None, ""][int(rng.integers(4))]) for i in rng.permutation(300)]
    rows += rows[:20] + [(None, hot, "en"), (None, None, None), (None, pool[5], "de")] + [(5000, hot, "fr")] * 30
    labels = [(int(i), int(rng.integers(2)), int(rng.integers(2))) for i in range(0, 400, 2)] + [(4, 1, None), (4, None, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*r, 9, "x") for r in rows], "doc_id long, text string, lang string, mask int, part string").repartition(5)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = audit.audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
        got = {(r.part, r.filter_order, r.step): [r[c] for c in (*COLUMNS, "shapley")] for r in made.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == brute(rows, labels)


def test_equal_fingerprints_of_other_texts():
    """Ranges that begin and end within a fingerprint that two texts share."""
    rows = [(9, t, i, "p") for t in (b"a", b"b") for i in (1, 2, 2, 3, 5)]
    parts = [[r for r in rows if r[2] <= 1], [r for r in rows if r[2] == 2], [r for r in rows if r[2] > 2]]
    seen = []
    for part in parts:
        s = audit.Sorted(audit.TextFilters())
        for r in part:
            s.add(*r)
        s.finish()
        seen += s.take()
    smallest = {}
    for i, _, _, _, edge in seen:
        if edge:
            smallest[edge] = min(smallest.get(edge, i), i)
    bit = audit.TextFilters().duplicate
    failed = sum(n for i, _, mask, n, edge in seen if mask & bit or (edge and i > smallest[edge]))
    assert (sum(r[3] for r in seen), failed) == (10, 8)


def test_no_rows_and_no_labels(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.audit(docs, labels).count() == 0
    made = audit.audit(spark.createDataFrame([(1, None, None)], docs.schema), labels).collect()
    assert len(made) == 600 and sum(r.removed for r in made) == 120 and {r.part for r in made} == {""}
