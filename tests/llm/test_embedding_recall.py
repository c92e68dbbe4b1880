"""Links and components of a table with planted near copies, against brute force."""

import numpy as np
import pytest

from millrace.llm import embed


def planted(rng, n, dim):
    """Unrelated vectors, each followed by near copies at cosines around the threshold, in three labels."""
    rows = []
    for k in range(n):
        x = rng.standard_normal(dim)
        x /= np.linalg.norm(x)
        label = int(rng.integers(3)) if k % 50 else None
        rows.append((x, label))
        for _ in range(int(rng.integers(0, 4))):
            y = rng.standard_normal(dim)
            y -= (y @ x) * x
            y /= np.linalg.norm(y)
            c = rng.uniform(0.96, 1.0)
            rows.append((c * x + np.sqrt(1 - c * c) * y, label))
    return rows


@pytest.mark.parametrize("narrow", [False, True])
def test_recall(spark, monkeypatch, narrow):
    if narrow:  # as many tables as a large table would have, and buckets cut into tiles
        monkeypatch.setattr(embed, "BUCKET", 4)
        monkeypatch.setattr(embed, "CHUNK", 6)
    rng = np.random.default_rng(4)
    rows = planted(rng, 700, 24)
    x = np.array([v for v, _ in rows]).astype(np.float32)
    frame = spark.createDataFrame([(i, x[i].tolist(), rows[i][1]) for i in range(len(rows))], "vec_id long, embedding array<float>, label long")
    got = {r.vec_id: r for r in embed.near_duplicates(frame).collect()}
    wide = x.astype(np.float64)
    unit = wide / np.linalg.norm(wide, axis=1)[:, None]
    label = np.array([-1 - i if r[1] is None else r[1] for i, r in enumerate(rows)])
    linked = (unit @ unit.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(linked, False)
    assert linked.sum() > 800
    want = linked.sum(1)
    found = np.array([got[i].n_links for i in range(len(rows))])
    # A pair at the threshold is missed with a chance of 1e-4 at most; never is one too many.
    assert (found <= want).all() and found.sum() >= 0.999 * want.sum()
    near = np.arange(len(rows))
    while True:
        least = np.minimum(near, np.where(linked, near[None, :], len(rows)).min(1))
        if (least == near).all():
            break
        near = least
    assert np.mean([got[i].component_id == near[i] for i in range(len(rows))]) > 0.998


def test_double_vectors_are_not_rounded(spark):
    rows = [(1, [1e200, 0.0, 0.0]), (2, [2e200, 0.0, 0.0]), (3, [1e-200, 0.0, 0.0]), (4, [1.0, 1e-9, 0.0]), (5, [float("inf"), 0.0, 0.0]), (6, [0.0, 0.0, 0.0]), (7, [0.0, 5e-324, 0.0]), (8, [0.0, 1.0, 0.0])]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicates(frame).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (0, 5), 6: (0, 6), 7: (1, 7), 8: (1, 7)}


def test_a_group_of_near_copies(spark, monkeypatch):
    """All pairs of a large group are links; rows fetch their vectors where they meet first, mostly in one table."""
    monkeypatch.setattr(embed, "CHUNK", 64)
    rng = np.random.default_rng(1)
    x = rng.standard_normal(32) + 0.01 * rng.standard_normal((400, 32))
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)] + [(1000 + i, rng.standard_normal(32).tolist(), 0) for i in range(400)], "vec_id long, embedding array<float>, label long")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embed.near_duplicates(frame).collect()}
    assert all(got[i] == (399, 0) for i in range(400)) and all(got[1000 + i] == (0, 1000 + i) for i in range(400))


def test_four_bits_stay_within_their_bound():
    rng = np.random.default_rng(5)
    for dim in (3, 24, 65):
        x = rng.standard_normal((50, dim))
        levels, low, step, left = embed.four_bits(x)
        back = embed.from_four_bits(levels, low, step, dim)
        assert back.shape == x.shape and levels.shape[1] == (dim + 1) // 2
        signs = np.where(rng.standard_normal((50, dim)) > 0, 1, -1) / np.sqrt(dim)
        assert (np.abs(((back - x) * signs).sum(1)) <= left + 1e-5).all()
