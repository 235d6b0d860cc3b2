from __future__ import annotations

import hashlib
import random
from collections import Counter

import pytest

from looptrace.llm import suffixes


def brute(rows):
    data = [(d, (t or "").encode()) for d, t in rows]
    seen = Counter(b[i : i + 200] for _, b in data for i in range(len(b) - 199))
    out = []
    for doc, b in data:
        gone = [False] * len(b)
        for i in range(len(b) - 199):
            if seen[b[i : i + 200]] > 1:
                gone[i : i + 200] = [True] * 200
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def passages(seed):
    draw = random.Random(seed)
    text = lambda n: "".join(draw.choice("abcdeé \n") for _ in range(n))
    shared = [text(draw.randrange(150, 500)) for _ in range(6)]
    rows = []
    for i in range(60):
        body = ""
        for _ in range(draw.randrange(4)):
            passage = draw.choice(shared)
            start = draw.randrange(60)
            body += text(draw.randrange(120)) + passage[start : len(passage) - draw.randrange(60)]
        rows.append((i, body + text(draw.randrange(80))))
    return rows


def answers(df, **options):
    columns = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    return sorted((tuple(r[c] for c in columns)
                   for r in suffixes.remove_repeats(df, **options).collect()), key=str)


@pytest.mark.parametrize("options", [{}, {"part_bytes": 3000}, {"part_bytes": 3000, "hot": 1}])
def test_against_all_windows(docs, options):
    rows = passages(len(options))
    assert answers(docs(*rows), **options) == brute(rows)


def test_rows_of_any_kind(docs):
    long = "".join(random.Random(9).choices("abcdefgh ", k=1_200_000))
    rows = [(1, None), (2, ""), (3, "é" * 99), (3, "é" * 99), (4, "é" * 100), (4, "é" * 100),
            (5, "a" * 199), (6, "a" * 201), (7, "ab" * 300), (None, "x" * 150 + "y" * 149),
            (8, long[1000:]), (9, "q" + long[500_000:500_700]), (10, "z" * 40)]
    got = {r[0]: r for r in answers(docs(*rows)) if r[0] not in (3, 4)}
    small = [r for r in rows if r[0] not in (8, 9)]
    assert [r for r in answers(docs(*small))] == brute(small)
    assert got[8][2] == got[9][2] == 700 and got[8][3] == 1
    assert answers(docs()) == []


def test_merging_gives_the_sorted_order():
    draw = random.Random(2)
    runs = [sorted(("".join(draw.choice("ab") for _ in range(draw.randrange(101, 130))).encode(), b"")
                   for _ in range(draw.randrange(30))) for _ in range(7)]
    coded = [suffixes.coded([(r, [0]) for r in run]) for run in runs]
    found, last = [], b""
    for shared, run, place, suffix, left, count in suffixes.merged(
            [suffixes.decoded(c) for c in coded]):
        assert runs[run][place][0] == suffix and shared == suffixes.common(last, suffix)
        found.append(suffix)
        last = suffix
    assert found == sorted(s for run in runs for s, _ in run)


def test_text_left_over(docs):
    df = suffixes.remove_repeats(docs((1, "x" + "ab" * 150), (2, "short")), with_text=True)
    assert {r.doc_id: r.text for r in df.collect()} == {1: "x", 2: "short"}


def test_equal_rows_are_one_row_of_a_part(spark, docs):
    draw = random.Random(6)
    text = "".join(draw.choices("abcdefgh ", k=900))
    other = text[300:700] + "".join(draw.choices("xyz", k=300))
    rows = docs((None, text)).crossJoin(spark.range(20_000)).drop("id").unionByName(
        docs((1, other), (2, "short"), (2, "short"), (3, "q" * 150)))
    parts = suffixes.dealt(rows, 3).collect()
    assert sum(len(r.ids) for r in parts) < 100 and sum(sum(r.counts) for r in parts) == 20_004
    got = suffixes.remove_repeats(rows).groupBy("doc_id", "n_bytes", "n_removed", "n_spans").count()
    assert sorted(map(tuple, got.collect()), key=str) == sorted([
        (None, 900, 900, 1, 20_000), (1, 700, 400, 1, 1), (2, 5, 0, 0, 2), (3, 150, 0, 0, 1)], key=str)
