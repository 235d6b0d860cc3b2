from __future__ import annotations

import numpy as np
import pytest

from looptrace.llm import embed_dups


def near_groups(seed, size=48):
    draw = np.random.default_rng(seed)
    rows = []
    for _ in range(25):
        center = draw.normal(size=size)
        for _ in range(draw.integers(1, 9)):
            v = center + draw.normal(size=size) * draw.choice([0.02, 0.1, 0.15, 0.25])
            rows += [v * draw.choice([1, 3])] * draw.integers(1, 3)
    return [(i, [float(np.float32(x)) for x in v], int(i % 7 == 0)) for i, v in enumerate(rows)]


def brute(rows):
    out = []
    for label in {r[2] for r in rows}:
        own = [r for r in rows if r[2] == label]
        x = np.array([r[1] for r in own], np.float64)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        near = x @ x.T >= 0.98
        np.fill_diagonal(near, False)
        low = np.arange(len(own))
        while True:
            new = np.minimum(low, np.where(near, low, len(own)).min(1))
            if (new == low).all():
                break
            low = new
        out += [(r[0], int(n), own[k][0]) for r, n, k in zip(own, near.sum(1), low)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["float", "double"])
@pytest.mark.parametrize("block", [1500, 3])
def test_against_all_pairs(spark, monkeypatch, kind, block):
    monkeypatch.setattr(embed_dups.class_links, "__defaults__", (0.98, block))
    rows = near_groups(block)
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")
    got = embed_dups.near_vectors(df).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_the_transform_keeps_lengths_and_is_its_own_inverse():
    x = np.random.default_rng(1).normal(size=(4, 16)).astype(np.float32)
    assert np.allclose(embed_dups.hadamard(embed_dups.hadamard(x)), x, atol=1e-5)


def test_recall_of_the_buckets():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = draw.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    a, b = embed_dups.codes(x), embed_dups.codes(0.98 * x + np.sqrt(1 - 0.98**2) * side)
    one, other = embed_dups.meets(a, b)
    assert (one | other).any(1).mean() >= 0.999


def test_rows_of_any_kind(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2),
            (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1),
            (9, [inf, 1.0], 1), (10, [None, 1.0], 1), (None, [1.0, 0.0], 1), (11, [1.0], 1),
            (12, [-0.0, 1.0], 1), (13, [0.0, 1.0], 1)]
    df = spark.createDataFrame(
        [(*r, "x", 5) for r in rows],
        "vec_id long, embedding array<float>, label int, key string, m long")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept)
                  for r in embed_dups.near_vectors(df).collect()), key=str)
    alone = [(i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 11)]
    assert got == sorted([(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False),
                          (12, 1, 12, True), (13, 1, 12, False), *alone], key=str)
    assert embed_dups.near_vectors(df.limit(0)).collect() == []
