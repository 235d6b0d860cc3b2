from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from looptrace.llm import minhash


def words(draw, n):
    return [f"w{draw.randrange(5000)}" for _ in range(n)]


def copies(seed, groups=12, alone=40):
    draw, rows = random.Random(seed), []
    for _ in range(groups):
        base = words(draw, draw.randrange(30, 200))
        for _ in range(draw.randrange(2, 9)):
            new = list(base)
            for _ in range(draw.randrange(4)):
                new[draw.randrange(len(new))] = "changed"
            rows.append(" ".join(new))
    rows += [" ".join(words(draw, draw.randrange(1, 60))) for _ in range(alone)]
    draw.shuffle(rows)
    return list(enumerate(rows))


def brute(rows, link=85):
    def shingles(text):
        w = (text or "").split()
        w = ["".join(c.lower() if "A" <= c <= "Z" else c for c in x) for x in w]
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = [shingles(t) for _, t in rows]
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= link * len(a | sets[j]):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    low = {g: min(rows[k][0] for k in range(len(rows)) if group[k] == g) for g in group}
    return sorted((d, len(s), low[g]) for (d, _), s, g in zip(rows, sets, group))


@pytest.mark.parametrize("block", [1500, 2])
def test_against_all_pairs(docs, monkeypatch, block):
    monkeypatch.setattr(minhash.near_classes, "__defaults__", (85, block))
    rows = copies(block)
    got = minhash.near_duplicates(docs(*rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_sketches_agree_as_often_as_the_sets_are_alike():
    draw = np.random.default_rng(5)
    agreed = []
    for size in (2, 10, 400):
        both = draw.integers(0, 1 << 63, (200, size), np.uint64)
        rows = minhash.sketches([np.unique(x) for x in both])
        assert (rows != minhash.EMPTY).all()
        half = [np.unique(np.concatenate([x[: size // 2], y[: size // 2]]))
                for x, y in zip(both, both[::-1])]
        agreed.append((minhash.sketches([np.unique(x) for x in both]) == minhash.sketches(half)).mean())
        shared = size // 2 / (size + size // 2)
        assert agreed[-1] == pytest.approx(shared, abs=0.05)


def test_overlaps_by_products_and_by_pairs():
    draw = np.random.default_rng(1)
    for top in (30, 3000):
        sets = [np.unique(draw.integers(0, top, 60)).astype(np.uint64) for _ in range(25)]
        got = minhash.overlaps(sets)
        want = [[len(np.intersect1d(a, b)) * (i != j) for j, b in enumerate(sets)]
                for i, a in enumerate(sets)]
        assert got.tolist() == want


def test_rows_of_any_kind(docs):
    text = "One two three four five six SEVEN"
    rows = docs((5, text), (3, text.lower().replace(" ", "\t")), (3, text), (None, text), (1, None),
                (2, ""), (4, " \n"), (None, None), (6, "a b"), (7, "A  b"), (8, "x " * 100_000),
                (9, "É b c d e f"), (10, "é b c d e f"))
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept)
                  for r in minhash.near_duplicates(rows).collect()), key=str)
    assert got == sorted([
        (5, 3, 3, False), (3, 3, 3, True), (3, 3, 3, True), (None, 3, 3, False), (1, 0, 1, True),
        (2, 0, 2, True), (4, 0, 4, True), (None, 0, None, False), (6, 1, 6, True),
        (7, 1, 6, False), (8, 1, 8, True), (9, 2, 9, True), (10, 2, 10, True)], key=str)
    assert minhash.near_duplicates(docs()).collect() == []


def test_one_row_of_each_component_stays(docs):
    text = "One two three four five six SEVEN"
    rows = docs((5, text), (3, text.lower()), (3, text.lower()), (None, None), (None, None), (1, ""),
                (None, "only without an id here"), (None, "only without an id here"))
    kept = minhash.keep_one(rows)
    assert kept.columns == rows.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([
        (3, text.lower()), (None, None), (None, None), (1, ""), (None, "only without an id here")],
        key=str)


def test_a_task_sees_one_row_of_each_class(docs):
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words), " ".join([*words[:-1], "other"])
    rows = docs(*[(d, near[0]) for d in [None] * 1_500 + [7] * 1_500], *[(8, near[1])] * 40)
    base = rows.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    signed = minhash.stored(minhash.signed(base).drop("text"), "signatures")
    tasks = minhash.candidate_tasks(base, signed).collect()
    assert sorted(r.text for r in tasks) == sorted(near)
    got = minhash.near_duplicates(rows).collect()
    assert len(got) == 3_040 and {r.component_id for r in got} == {7}
    assert sorted(r.text for r in minhash.keep_one(rows).collect()) == [near[0]]
