from __future__ import annotations

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from looptrace.llm import packing, tokens, token_counts

TEXTS = [
    "Plain words, and more of them.", " starts with a space", "two  spaces", "ends in spaces  ",
    "line\nbreaks \n and\ttabs", "\n\n x", "", "a" * 5000, "don't they're I'll 'tis", "x  y  z",
    "ünïcödé ß ñandú çré", "՘ ࢏ ꟎ mixed \U0001f600 signs", "\x1c\x1d a \x1e b", "1²³ ½ x٣",
    "the end <|endoftext|> and on", "<|endoftext|>", "中文 字 テスト", "a ́b ​ c", "''s 's", "\r\n a\r b",
]


@pytest.fixture(scope="module")
def whole():
    return Tokenizer.from_file(tokens.default_path())


def test_ids_are_those_of_the_library(whole):
    ids = tokens.ids(tokens.default_path())
    drawn = np.random.default_rng(2)
    alphabet = list("ab's. ,\n\t  é1²<|> ́中 \x1c")
    texts = TEXTS + ["".join(drawn.choice(alphabet, 40)) for _ in range(3000)]
    for text in texts:
        assert np.frombuffer(ids.of(text), "<u4").tolist() == whole.encode(
            text, add_special_tokens=False).ids, repr(text)


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 4096, 5000])
def test_cuts(n):
    found = list(packing.cuts(n))
    assert sum(length for _, length in found) == n
    assert [s for s, _ in found] == [sum(x for _, x in found[:i]) for i in range(len(found))]
    assert all(length & (length - 1) == 0 and length <= 2048 for _, length in found)


def test_pieces_give_the_documents_back(docs, whole):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (50, None), (None, "no id")]
    out = packing.pack(docs(*rows)).collect()
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 for r in out)
    for doc, text in {(50, None), (None, "no id"), *enumerate(TEXTS)}:
        own = sorted((r for r in out if r.doc_id == doc), key=lambda r: (r.start, r.sequence_id))
        want = whole.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        times = 2 if doc == 3 else 1
        assert sum(r.length for r in own) == times * len(want)
        first = {r.start: r for r in own}
        assert [i for s in sorted(first) for i in first[s].ids] == want
        for r in own:
            assert r.doc_tokens == len(want) and r.length == len(r.ids)
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert packing.pack(docs()).collect() == []


def test_buckets_by_length(spark, docs, tmp_path):
    rows = [(i, "some words here " * (i % 40)) for i in range(400)]
    pieces = packing.pack(docs(*rows).repartition(5)).collect()
    assert all(r.length == 1 << r.bucket for r in pieces)
    places = {(r.bucket, r.bucket_place) for r in pieces}
    assert len(places) == len(pieces)
    for bucket in {r.bucket for r in pieces}:
        own = sorted(p for b, p in places if b == bucket)
        tasks = [p >> packing.PLACE_BITS for p in own]
        for task in set(tasks):  # without gaps in each task
            inside = [p for p, t in zip(own, tasks) if t == task]
            first = task << packing.PLACE_BITS
            assert inside == list(range(first, first + len(inside)))
    packing.write_buckets(packing.pack(docs(*rows)), str(tmp_path / "buckets"))
    back = spark.read.parquet(str(tmp_path / "buckets"))
    assert all(len(r.ids) == r.length == 1 << r.bucket for r in back.collect())
    assert back.count() == len(pieces)


def test_counts_with_any_table_sent(docs, whole, monkeypatch):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(4, TEXTS[4]), (60, None)]
    want = sorted(
        (i, len((t or "").encode()), n := len(whole.encode(t or "", add_special_tokens=False).ids),
         n > 5) for i, t in rows)
    for frequent in (0, 3, 20_000):
        monkeypatch.setattr(token_counts, "FREQUENT", frequent)
        out = token_counts.token_counts(docs(*rows), limit=5)
        got = sorted((r.doc_id, r.n_bytes, int(r.n_tokens), r.over_limit) for r in out.collect())
        assert got == want
    assert token_counts.token_counts(docs()).collect() == []


def test_a_full_cache_starts_anew(monkeypatch, whole):
    monkeypatch.setattr(tokens, "CACHED", 4)
    ids = tokens.Ids(tokens.encoder(tokens.default_path()))
    text = " ".join(f"word{i}" for i in range(50))
    assert len(ids.of(text)) // 4 == len(whole.encode(text).ids) and len(ids) <= 4
