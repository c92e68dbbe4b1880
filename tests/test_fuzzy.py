"""The fuzzy scorer against all alignments, and the order of a search."""

import itertools

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.plans.text_queries import fuzzy


def brute(name, query):
    """The best of all ways to pick the letters in order."""
    low, q = name.lower(), query.lower()
    best = -1
    for at in itertools.combinations(range(len(low)), len(q)):
        if all(low[i] == c for i, c in zip(at, q)):
            score = -text.LEADING * at[0] - text.TRAILING * (len(low) - 1 - at[-1]) + text.WHOLE * (low == q)
            for k, i in enumerate(at):
                start = i == 0 or name[i - 1] in text.WORD_SIGNS or (name[i].isupper() and name[i - 1].islower())
                score += text.LETTER + text.WORD_START * start
                if k:
                    score += text.RUN if at[k - 1] == i - 1 else -text.GAP * (i - at[k - 1] - 1)
            best = max(best, score, 0)
    return best


def test_every_alignment():
    rng = np.random.default_rng(2)
    names = ["".join(rng.choice(list("abAB/_.x"), int(rng.integers(0, 11)))) for _ in range(300)] + ["", "a", "ab", "é/ab"]
    for query in ("a", "ab", "aba", "bxa", "AB", "zz", "é"):
        got = text.best_alignment(names, query)
        assert got.tolist() == [brute(n, query) for n in names], query
    assert text.best_alignment([], "a").tolist() == [] and text.best_alignment(["x"], "").tolist() == [0]


def test_search_puts_hidden_paths_last(spark):
    rows = [(".config/read", 1), ("src/read.me", 2), ("src/ready", 3), ("r/e/a/d", 4), (None, 5), ("none", 6), ("a/.read", 7)]
    frame = spark.createDataFrame(rows, "path string, score0 int")
    found = [r.path for r in text.fuzzy_search(frame, "path", "read").collect()]
    assert set(found) == {".config/read", "src/read.me", "src/ready", "r/e/a/d", "a/.read"} and set(found[-2:]) == {".config/read", "a/.read"}
    assert text.fuzzy_search(frame, "path", ".read").first().path == "a/.read"
    assert text.fuzzy_search(frame, "path", "read", limit=2).count() == 2
    assert text.fuzzy_search(frame.where("false"), "path", "read").count() == 0


def test_registered_search(spark):
    d = "/root/testdata/sf0.001"
    parts = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_name").collect()
    names = [("." if r.p_partkey % 7 == 0 else "") + r.p_name.replace(" ", "/") + f"-{r.p_partkey}" for r in parts]
    scores = text.best_alignment(names, "Red").tolist()
    want = sorted((n.startswith("."), -s, n) for n, s in zip(names, scores) if s >= 0)[:20]
    got = fuzzy(spark, d).collect()
    assert [(r.path, r.score) for r in got] == [(n, -s) for _, s, n in want]
    assert spark.createDataFrame([(None,), ("x",)], "p string").select(text.fuzzy_score(F.col("p"), "x").alias("s")).collect()[0].s is None
