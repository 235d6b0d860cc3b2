from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from looptrace.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int, slot string, rank int, TOPS string"


def brute(rows, every=3, k_pos=5, k=10):
    """All scores of every anchor, as whole numbers."""
    whole = []
    for i, (vec_id, vec, label, *_) in enumerate(rows):
        if label is not None and vec is not None and all(x is not None and math.isfinite(x) for x in vec):
            whole.append((i, vec_id, [math.floor(256 * x) for x in vec], label))
    most, out = 2**63 - 1, []
    for i, vec_id, a, label in whole:
        if vec_id is None or vec_id % every:
            continue
        scored = [
            (-max(-most, min(most, sum(x * y for x, y in zip(a, b)))), other is None, other or 0, j, own)
            for j, other, b, own in whole if j != i
        ]
        scored.sort()
        for s, absent, pos, *_ in [r for r in scored if r[4] == label][:k_pos]:
            fit = [r for r in scored if r[4] != label and 30 * -s <= 100 * -r[0] <= 90 * -s]
            for n, r in enumerate(fit[:k], 1):
                out.append((vec_id, None if absent else pos, n, None if r[1] else r[2], -s, -r[0]))
    return out


def asked(spark, rows, every=3):
    full = [(*r, "x", 1, "y") for r in rows]
    df = spark.createDataFrame(full, SCHEMA)
    found = negatives.hard_negatives(df, F.col("vec_id") % every == 0)
    assert found.columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]
    return [tuple(r) for r in found.collect()]


def key(row):
    return [(x is None, x or 0) for x in row]


def drawn(seed, n=160, size=6, labels=4):
    draw = np.random.default_rng(seed)
    return [
        (i, [float(x) for x in np.round(draw.normal(size=size), 2)], int(draw.integers(labels)))
        for i in range(n)
    ]


@pytest.mark.parametrize("block, few", [(4_000_000, 1_024), (150, 16)])
def test_against_all_scores(spark, monkeypatch, block, few):
    for name, value in (("BLOCK", block), ("ROWS_AT_ONCE", few), ("ANCHORS_AT_ONCE", 7)):
        monkeypatch.setattr(negatives, name, value)
    rows = drawn(1)
    assert sorted(asked(spark, rows)) == sorted(brute(rows))


def test_ties_repeated_rows_and_a_hot_label(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 100)
    draw = random.Random(2)
    rows = [
        (draw.choice([None, *range(30)]), [draw.choice([0.5, 1.0, -1.0]) for _ in range(3)],
         0 if draw.random() < 0.6 else draw.randrange(1, 9))
        for _ in range(140)
    ]
    assert sorted(asked(spark, rows), key=key) == sorted(brute(rows), key=key)


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = drawn(3, 60) + [
        (60, None, 1), (63, [], 1), (66, [1.0, None], 1), (69, [inf, 1.0], 1), (72, [nan], 2),
        (75, [1.0, 2.0], None), (78, [1.0], 1), (81, [0.0] * 6, 2), (84, [1.0] * 40, 3),
        (87, [1e12, 1e12], 1), (90, [9e11, 9e11], 2), (93, [9.5e11, 1e12], 1), (96, [8e11, 1e3], 3),
        (99, [-1e12, 1.0], 1), (102, [1.0] * 5_000, 2), (105, [1.0] * 4_000, 1), (108, [1.0] * 900, 1),
    ]
    assert sorted(asked(spark, rows)) == sorted(brute(rows))


def test_no_rows(spark):
    assert asked(spark, []) == []
    assert asked(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert asked(spark, [(None, [1.0], 1), (None, [1.0], 2)]) == []


def test_products_are_exact_at_every_size():
    draw = np.random.default_rng(5)
    for top in (200, 10**6, 2**62):
        a, b = (draw.integers(-top, top, size=(9, 40)) for _ in range(2))
        bound = 1.001 * max(float(np.linalg.norm(x.astype(float), axis=1).max()) for x in (a, b)) ** 2
        exact = a.astype(object) @ b.astype(object).T
        most = negatives.MOST
        assert (negatives.products(a, b, bound) == np.clip(exact, -most, most)).all()
