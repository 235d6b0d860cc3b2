from __future__ import annotations

import pytest

from looptrace.llm import mixing


def filled(sizes, weights, most=3):
    """Targets by sharing the excess again and again."""
    targets = dict.fromkeys(sizes, 0.0)
    left, open_ = float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weights[s] for s in open_)
        rest = 0.0
        for s in list(open_):
            targets[s] += left * weights[s] / total
        for s in list(open_):
            if targets[s] >= most * sizes[s]:
                rest += targets[s] - most * sizes[s]
                targets[s] = most * sizes[s]
                open_.discard(s)
        left = rest
    return targets


def rows_of(sizes):
    out, n = [], 0
    for source, size in sizes.items():
        for _ in range(size // 5):
            out.append((n, "a b\tc\nd  e f", None, source))
            n += 1
    return out


@pytest.mark.parametrize("sizes", [
    {"a": 500, "b": 500, "c": 500}, {"a": 5, "b": 1000, "c": 1000, "d": 20},
    {"": 5, "x": 5, "y": 10, "z": 2000, None: 50}, {"only": 100}])
def test_targets_against_repeated_sharing(docs, sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    got = {r.source: r for r in mixing.source_targets(docs(*rows_of(sizes))).collect()}
    want = filled(sizes, weights)
    for s in sizes:
        assert got[s].source_size == sizes[s]
        assert got[s].target == pytest.approx(want[s], abs=1e-6)


def test_copies_come_near_the_targets_and_agree_again(docs):
    df = docs(*rows_of({"a": 6000, "b": 6000, "c": 6000}))
    counted = mixing.mix_counts(df)
    rows = counted.collect()
    assert sorted(rows) == sorted(mixing.mix_counts(df).collect())
    for source in "abc":
        own = [r for r in rows if r.source == source]
        assert sum(r.taken for r in own) == pytest.approx(own[0].target, rel=0.1)
        assert {r.copies for r in own} <= {int(own[0].rate), int(own[0].rate) + 1}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in rows)


def test_rows_of_any_kind(docs, spark, monkeypatch):
    df = docs((1, None, None, "a"), (2, "", None, "a"), (3, "x " * 200_000, None, None),
              (3, "x " * 200_000, None, None), (None, "y z", None, ""))
    rows = mixing.mix_counts(df).collect()
    assert len(rows) == 5 and sum(r.size for r in rows) == 400_002
    assert all(r.taken <= 3 * r.size for r in rows)
    assert mixing.mix_counts(docs()).collect() == [] and mixing.mix(docs()).collect() == []
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(mixing.mix_counts(df).collect(), key=str) == sorted(rows, key=str)


def test_no_python_in_the_plan(docs):
    text = mixing.mix(docs((1, "a b", None, "s")))._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
