"""The stored collection of vectors against plain Python."""

import numpy as np
import pytest

from millrace.operators import neighbours
from millrace.sources.collection import Collection
from millrace.sources.commits import Conflict

SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in vectors], SCHEMA)


def unit(v, n):
    x = np.array([np.nan if y is None else y for y in v], float) if v is not None else np.zeros(0)
    if len(x) != n or not np.isfinite(x).all() or not x.any():
        return None
    x = x / np.abs(x).max()
    return x / np.linalg.norm(x)


def nearest(held, query, k):
    q = unit(query, len(query))
    score = {i: 0.0 if q is None or (u := unit(v, len(query))) is None else round(float(u @ q), 12) for i, v in held.items()}
    return sorted(score, key=lambda i: (-score[i], i))[:k]


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.query_id, -r.score, r.vec_id)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 8))
    return {i: (centres[i % 12] + 0.3 * rng.normal(size=8)).tolist() for i in range(600)}


@pytest.fixture
def made(spark, vectors, tmp_path):
    out = Collection.create(spark, str(tmp_path / "c"), frame(spark, vectors.items()))
    out.upsert(frame(spark, vectors.items()))
    return out


def test_changes_are_seen_after_a_reread(spark, made, vectors):
    held = dict(vectors)
    moved = {i: [-x for x in vectors[i]] for i in range(0, 600, 7)} | {9000: [1.0] * 8}
    assert made.upsert(frame(spark, moved.items())) == 2
    held |= moved
    gone = [*range(0, 600, 5), 12345, None]
    assert made.delete(spark.createDataFrame([(i,) for i in gone], "vec_id long")) == 3
    held = {i: v for i, v in held.items() if i not in gone}
    again = Collection(spark, made.root)
    assert {r.vec_id: list(r.embedding) for r in again.vectors().collect()} == held
    asked = [(k, vectors[i]) for k, i in enumerate((0, 1, 50, 77))] + [(100, [0.0] * 8)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    assert found(again.search(queries, 5, exact=True).collect()) == {k: nearest(held, q, 5) for k, q in asked}
    before = Collection(spark, made.root, version=1)
    assert found(before.search(queries, 5, exact=True).collect()) == {k: nearest(vectors, q, 5) for k, q in asked}
    with pytest.raises(ValueError):
        before.delete(spark.createDataFrame([(1,)], "vec_id long"))
    assert again.compact() == 4 and again.vacuum() == 3
    assert {r.vec_id: list(r.embedding) for r in Collection(spark, made.root).vectors().collect()} == held


def test_an_id_may_come_back(spark, made, vectors):
    made.delete(spark.createDataFrame([(3,)], "vec_id long"))
    made.upsert(frame(spark, [(3, [5.0] * 8)]))
    made.upsert(frame(spark, [(3, vectors[3])]))
    rows = [r for r in made.vectors().collect() if r.vec_id == 3]
    assert len(rows) == 1 and list(rows[0].embedding) == vectors[3]


def test_nearest_cells_find_most(spark, made, vectors):
    asked = [(i, vectors[i]) for i in range(0, 600, 10)]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    got = found(made.search(queries, 10).collect())
    want = {k: nearest(vectors, q, 10) for k, q in asked}
    hits = sum(len(set(got[k]) & set(w)) for k, w in want.items())
    assert made.probes < len(made.centroids) and hits >= 0.9 * sum(map(len, want.values()))


def test_few_cells_are_read(spark, made, vectors):
    query = spark.createDataFrame([(1, vectors[5])], "query_id long, embedding array<double>")
    plan = made.search(query, 3, probes=2)._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and len(made.search(query, 3, probes=1).collect()) == 3


def test_odd_vectors(spark, made, vectors):
    odd = [(1000, None), (1001, []), (1002, [0.0] * 8), (1003, [1.0, 2.0]), (1004, [None] + [1.0] * 7), (1005, [float("inf")] + [1.0] * 7), (1006, [1e300] * 8), (None, [1.0] * 8), (1007, [1.0] * 8), (1007, [2.0] + [1.0] * 7)]
    made.upsert(frame(spark, odd))
    held = vectors | {i: v for i, v in odd if i is not None}
    asked = [(1, [1e-300] * 8), (2, vectors[0])]
    queries = spark.createDataFrame(asked, "query_id long, embedding array<double>")
    got = made.search(queries, 700, exact=True).collect()
    assert found(got) == {k: nearest(held, q, 700) for k, q in [(1, [1.0] * 8), (2, vectors[0])]}


def test_empty_collection(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    made = Collection.create(spark, str(tmp_path / "e"), none)
    queries = spark.createDataFrame([(1, [1.0])], "query_id long, embedding array<double>")
    assert made.search(queries).count() == 0 and made.vectors().count() == 0
    made.upsert(frame(spark, [(1, [1.0]), (2, [-1.0])]))
    assert found(made.search(queries).collect()) == {1: [1, 2]}
    assert made.search(queries.where("false")).count() == 0


def test_a_taken_version_is_tried_again(spark, made, vectors, monkeypatch):
    other = Collection(spark, made.root)
    real, tries = made._commit, []

    def late(rows, state, whole=False):
        if not tries:
            other.delete(spark.createDataFrame([(8,)], "vec_id long"))
        tries.append(state.version)
        return real(rows, state, whole)

    monkeypatch.setattr(made, "_commit", late)
    assert made.upsert(frame(spark, [(7, [1.0] * 8)])) == 3 and tries == [1, 2]
    held = {r.vec_id for r in made.vectors().collect()}
    assert 7 in held and 8 not in held
    with pytest.raises(Conflict):
        made.files.create("log/000000000001.json", "{}")


def test_blocks_of_other_lengths_and_ties():
    import pyarrow as pa

    vectors = pa.table({"vec_id": [5, 4, 3, None, 2, 1], "embedding": [[1.0, 0.0], [2.0, 0.0], [1.0], [1.0, 0.0], [0.0, 0.0], None]})
    queries = pa.table({"query_id": [1, 2], "embedding": [[3.0, 0.0], [-1.0]]})
    got = neighbours.best(queries, vectors, 3).to_pylist()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got if r["query_id"] == 1 and r["score"]] == [(1, 4, 1.0), (1, 5, 1.0)]
    assert {r["vec_id"] for r in got if r["query_id"] == 2} == {1, 2, 4}
