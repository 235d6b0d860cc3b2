from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from looptrace.llm import trie

SCHEMA = "conv_id long, turn int, role string, text string, depth string, x int, KEY string"
COLUMNS = [
    "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
    "ends_sha256",
]


def fingerprint(role, text):
    digest = hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).hexdigest()
    return int(digest[:15], 16), int(digest[15:30], 16)


def conversations_of(rows):
    out = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            out.setdefault(conv, []).append((turn, role or "", text or ""))
    return {
        c: [t[1:] for t in sorted(ts, key=lambda t: (t[0] is not None, t[0] or 0, fingerprint(*t[1:])))]
        for c, ts in out.items()
    }


def shared_starts(found):
    out = {}
    for c, own in found.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        out[c] = found.get(base, [])[:h] + own[h:]
    return out


def brute(found):
    members = {}
    for c, turns in found.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)

    def subtree(node):
        todo = [node]
        while todo:
            v = todo.pop()
            yield v
            todo += children.get(v, [])

    out = []
    for node, own in members.items():
        below = list(subtree(node))
        ends = ",".join(str(c) for c in sorted(c for c in own if len(found[c]) == len(node)))
        out.append((
            min(own), len(node), min(members[node[:-1]]) if node else None, len(own),
            len(children.get(node, [])), sum(v not in children for v in below),
            sum((len(members[v]) - 1) * len(v[-1][1].encode()) for v in below if v),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out)


def asked(spark, rows, build=trie.conversation_trie):
    df = spark.createDataFrame([(*r, "d", 1, "k") for r in rows], SCHEMA)
    found = build(df)
    assert found.columns[: len(COLUMNS)] == COLUMNS
    rows = [tuple(r) for r in found.collect()]
    places = sorted(p for r in rows for p in r[-2:])
    assert places == list(range(2 * len(rows)))  # the tour meets every arc once
    assert all(r[-2] < r[-1] for r in rows)
    return sorted(r[: len(COLUMNS)] for r in rows)


def drawn(seed, convs=80, words=3):
    draw, rows = random.Random(seed), []
    for c in range(convs):
        for t in range(draw.choice([1, 2, 4, 9, 14])):
            rows.append((c, t, draw.choice(["user", "é"]), draw.choice(["ü" * 3, "no", "", "x" * 40][:words])))
    return rows


@pytest.mark.parametrize("arcs", [250_000, 40])
def test_against_every_prefix(spark, monkeypatch, arcs):
    monkeypatch.setattr(trie, "ARCS", arcs)
    rows = drawn(1)
    assert asked(spark, rows) == brute(conversations_of(rows))


@pytest.mark.parametrize("seed", [2, 3])
def test_rebuilt_conversations(spark, seed):
    rows = [r for r in drawn(seed) if r[0] not in (5, 20)]
    rows += [(-c, t, "user", "a" * (t % 3)) for c in range(1, 12) for t in range(c)]
    assert asked(spark, rows, trie.rebuilt_trie) == brute(shared_starts(conversations_of(rows)))


def test_odd_rows(spark):
    rows = [
        (1, None, "user", "first"), (1, 3, None, None), (1, 3, "", ""), (1, 3, "user", "b"),
        (2, None, "user", "first"), (2, 3, None, None), (None, 1, "user", "nobody's"),
        (3, 1, "us", "er:x"), (4, 1, "user", "x"), (2**63 - 1, 1, "user", "x" * 300_000),
        (-(2**63), 1, "user", "x" * 300_000), (6, 1, "user", "same"), (6, 1, "user", "same"),
        (7, 1, "user", "same"), (7, 1, "user", "same"),
    ]
    assert asked(spark, rows) == brute(conversations_of(rows))
    assert asked(spark, rows, trie.rebuilt_trie) == brute(shared_starts(conversations_of(rows)))


def test_hot_conversation_and_hot_node(spark):
    rows = [(0, t, "user", str(t % 7)) for t in range(1_500)]
    rows += [(c, 0, "user", "0") for c in range(1, 1_500)]
    rows += [(c, t, "user", str(c)) for c in range(1_500, 1_600) for t in range(4)]
    found = conversations_of(rows)
    got = asked(spark, rows)
    assert len(got) == 1_901 and got[0][:7] == (0, 0, None, 1_600, 101, 101, 1_499)
    ends = hashlib.sha256(",".join(map(str, range(1, 1_500))).encode()).hexdigest()
    assert [r for r in got if r[:2] == (0, 1)][0][7] == ends
    assert {r[3] for r in got if r[1] > 1} == {1} and len(found) == 1_600


def test_no_rows(spark):
    for build in (trie.conversation_trie, trie.rebuilt_trie):
        assert asked(spark, [], build) == []
        assert asked(spark, [(None, 1, "user", "x")], build) == []


def test_a_list_without_neighbours_shrinks_all_the_same(spark, monkeypatch):
    monkeypatch.setattr(trie, "ARCS", 60)
    order = list(range(700))
    random.Random(4).shuffle(order)
    follows = dict(zip(order, order[1:]))
    rows = [
        (c, 0, follows.get(c), None if c not in follows else 0, 1, c % 3, c) for c in order
    ]
    arcs = spark.createDataFrame(
        rows, "conv long, code long, next_conv long, next_code long, n long, leaves long, saved long"
    )
    got = {r.conv: (r.n, r.leaves, r.saved) for r in trie.ranked(arcs).collect()}
    n = leaves = saved = 0
    for c in order:
        assert got[c] == (n, leaves, saved)
        n, leaves, saved = n + 1, leaves + c % 3, saved + c
