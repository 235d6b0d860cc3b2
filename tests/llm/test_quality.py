from __future__ import annotations

import random
from collections import Counter

from looptrace.llm import quality


def brute_repeats(words, size=8):
    seen = Counter(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    return len({j for i in range(len(words) - size + 1) if seen[tuple(words[i : i + size])] > 1
                for j in range(i, i + size)})


def test_repeated_words_against_all_windows():
    draw = random.Random(1)
    for _ in range(400):
        words = [draw.choice([b"a", b"b"]) for _ in range(draw.randrange(60))]
        assert quality.repeated_words(words) == brute_repeats(words)


def test_measures():
    text = "Éa b#\n \nx  y!\nÉa b#\n\x85z|\vX"
    got = dict(zip(quality.MEASURES, quality.measure(text.encode())))
    words = ["Éa", "b#", "x", "y!", "Éa", "b#", "\x85z|", "X"]
    assert got["n_words"] == 8 and got["word_chars"] == sum(map(len, words))
    assert got["n_symbols"] == 3 and got["n_dup_lines"] == 1 and got["n_lines"] == 4
    assert got["n_upper"] == 1 and got["n_exclaim"] == 1 and got["n_lettered"] == 8


def test_rows_of_any_kind(docs):
    good = "the report of the year says that " + " ".join(f"item{i} sold" for i in range(20))
    df = docs((1, good), (1, good), (2, None), (3, ""), (4, "word " * 300_000), (None, "### " * 40),
              (5, "short one"))
    out = quality.verdicts(quality.ledger(df)).collect()
    assert [(r.doc_id, r.kept, r.base_failed) for r in out if r.doc_id == 1] == [(1, True, False)] * 2
    rest = {r.doc_id: r for r in out if r.doc_id != 1}
    assert not any(r.kept for r in rest.values())
    assert rest[2].n_words == rest[3].n_words == 0 and rest[2].base_failed
    assert rest[4].n_repeat_words == 300_000 and rest[None].failed & quality.BIT["symbols"]
    assert quality.ledger(docs()).collect() == []


def test_policies_and_ablations(docs):
    rows = quality.ledger(docs((1, "a b"), (2, "## ## " * 30), (3, "%s " % " ".join(
        f"plain{i}" for i in range(30)))))
    for policy, mask in quality.POLICIES.items():
        failed = [r.failed & mask for r in rows.collect()]
        for r in quality.ablations(rows, policy).collect():
            bit = quality.BIT[r.rule]
            assert r.n_failed == sum(bool(f & bit) for f in failed)
            assert r.n_only == sum(f == bit for f in failed)
            assert r.n_kept == failed.count(0)
    kept = {r.doc_id for r in quality.verdicts(rows, "v1").where("kept").collect()}
    assert kept == {3}
