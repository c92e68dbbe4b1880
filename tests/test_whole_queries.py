"""The queries over all query vectors, all consecutive documents and all rows, against brute force."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import numbers
from millrace.plans import function_queries, registry, registry_all  # noqa: F401

TEXTS = {0: "a\nb\nc", 1: "a\nx", 2: None, 3: "", 4: "a\nb\nc", 7: "q", 8: "q\n\nr"}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    rng = np.random.default_rng(1)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(250)] + [(300, [1.0] * 8)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(path + "/embeddings.parquet")
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(path + "/documents.parquet")
    suppliers = [(i, i * 7 % 25, f"S{i * 13 % 997}") for i in range(450)]
    spark.createDataFrame(suppliers, "s_suppkey long, s_nationkey int, s_name string").write.parquet(path + "/supplier.parquet")
    spark.createDataFrame([(1, 0.5), (2, 999.99), (3, 1000.0), (4, 12.0)], "o_orderkey long, o_totalprice double").write.parquet(path + "/orders.parquet")
    return path


def run(spark, folder, name):
    return registry.queries()[name](spark, folder).collect()


def similarities(spark, folder):
    rows = spark.read.parquet(folder + "/embeddings.parquet").collect()
    v = {r.vec_id: np.array(r.embedding) for r in rows}
    return {(q, i): float(v[q] @ v[i] / np.linalg.norm(v[q]) / np.linalg.norm(v[i])) for q in v if q % 100 == 0 for i in v}


def test_vector_search_all(spark, folder):
    near = similarities(spark, folder)
    want = {q: sorted((-c, i) for (k, i), c in near.items() if k == q)[:10] for q in (0, 100, 200, 300)}
    got = run(spark, folder, "d2_4_vector_search")
    assert Counter((r.query_id, r.vec_id) for r in got) == Counter((q, i) for q, best in want.items() for _, i in best)
    assert all(abs(r.score - near[r.query_id, r.vec_id]) < 1e-6 for r in got)


def test_cosine_of_neighbours(spark, folder):
    near = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(folder + "/embeddings.parquet").collect()}
    got = {r.vec_id: r.c for r in run(spark, folder, "f50_cosine")}
    want = {i: float(v @ near[i + 1] / np.linalg.norm(v) / np.linalg.norm(near[i + 1])) for i, v in near.items() if i + 1 in near}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_line_diff_all(spark, folder):
    want = Counter()
    for d in TEXTS:
        if d + 1 in TEXTS:
            x, y = ([] if t is None else t.split("\n") for t in (TEXTS[d], TEXTS[d + 1]))
            pairs = [(x[i] if i < len(x) else None, y[i] if i < len(y) else None) for i in range(max(len(x), len(y)))]
            want.update((d, i, a, b) for i, (a, b) in enumerate(pairs) if a != b)
    assert Counter(map(tuple, run(spark, folder, "x4_line_diff"))) == want


def test_multi_sort_all(spark, folder):
    got = [tuple(r) for r in run(spark, folder, "o13_multi_sort")]
    rows = spark.read.parquet(folder + "/supplier.parquet").collect()
    assert got == [(r.s_suppkey, r.s_nationkey) for r in sorted(rows, key=lambda r: (r.s_nationkey, r.s_name))]


def test_all_amounts_are_parsed(spark, folder, monkeypatch):
    assert {tuple(r) for r in run(spark, folder, "f51_parse_amount")} == {
        (1, 0.5, 0.0, 0.5), (2, 999.99, 999e6, 999.99), (3, 1000.0, 1e9, 1000.0), (4, 12.0, 12e6, 12.0),
    }
    monkeypatch.setattr(numbers, "parse_amount", lambda s: F.lit(-1.0))
    assert all(tuple(r)[1:] == (-1.0, -1.0, -1.0) for r in run(spark, folder, "f51_parse_amount"))
