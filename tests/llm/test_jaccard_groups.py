"""Large groups of near copies on both sides of the threshold, against brute force."""

import numpy as np
import pytest

from millrace.llm import jaccard


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = int(rng.integers(len(words))), int(rng.integers(3))
        if kind == 0:
            words[at] = f"x{rng.integers(10**9)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"y{rng.integers(40)}")
    return words


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return out


def roots(sets, percent):
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize(("words", "percent", "length", "seed"), [(4, 85, 40, 1), (5, 80, 30, 2)])
def test_groups_around_the_threshold(spark, words, percent, length, seed):
    rng = np.random.default_rng(seed)
    base = [f"b{i}" for i in range(length)]
    other = [f"o{i}" for i in range(length)]
    texts = [" ".join(edited(rng, base, int(rng.integers(1, 6)))) for _ in range(420)]
    texts += [" ".join(edited(rng, base[: length // 2] + other[: length // 2], int(rng.integers(0, 4)))) for _ in range(60)]
    texts += [" ".join(edited(rng, other, 1)) for _ in range(30)] + [None, "", " ".join(base)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in jaccard.similar(frame, words, percent).collect()}
    want = roots(shingle_sets(texts, words), percent)
    assert [got[i] for i in range(len(texts))] == want
    assert len(set(want)) > 20


def test_all_balls_by_differences(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HEAVY_BALL", 0.0)
    test_groups_around_the_threshold(spark, 4, 85, 60, 4)


def test_repeated_and_null_ids(spark):
    one, two = " ".join(f"a{i}" for i in range(30)), " ".join(f"c{i}" for i in range(30))
    rows = [(5, one), (5, two), (7, one), (9, two), (None, one), (None, None), (3, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar(frame, 4, 85).collect()), key=str)
    # Rows with one id count as one document, which links the two texts here.
    want = [(5, 27, 5), (5, 27, 5), (7, 27, 5), (9, 27, 5), (None, 27, 5), (None, 0, None), (3, 0, 3)]
    assert got == sorted(want, key=str)
