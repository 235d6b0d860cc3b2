from __future__ import annotations

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from looptrace.llm import common, langid, minhash, mixing, packing, pii, queries

NAMES = ["language", "near_copies", "personal_data", "mixing", "packing"]


def test_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    assert set(queries.queries()) < set(entry.queries()) and "pipeline" in entry.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 14))


def test_stages_one_by_one(spark, given):
    docs = spark.read.parquet(f"{given}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = common.stored(stage(spark, docs, given), "stage")
        assert out.dtypes == docs.dtypes
        before, after = docs.collect(), out.collect()
        if name == "language":
            model = langid.train(docs.select("text", "lang"))
            rejected = {r.doc_id for r in langid.predict(docs, model).where("rejected").collect()}
            assert {r.doc_id for r in after} == {r.doc_id for r in before} - rejected
        elif name == "near_copies":
            kept = {r.doc_id for r in minhash.near_duplicates(docs, 80).where("kept").collect()}
            assert sorted(r.doc_id for r in after) == sorted(kept)
            assert len(after) < len(before)
        elif name == "personal_data":
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert all(pii.pattern_spans(r.text) == [] for r in after)
            assert any("<EMAIL>" in r.text for r in after)
            assert all(r.n_chars == len(r.text) for r in after)
        else:
            copies = {r.doc_id: r.copies for r in mixing.mix_counts(docs).collect()}
            assert len(after) == sum(copies.values())
        docs = out
    pieces = corpus_pipeline.packed(spark, docs, given)
    whole = {(r.doc_id, r.doc_tokens) for r in pieces.collect()}
    assert {d for d, _ in whole} == {r.doc_id for r in docs.collect()}


def test_the_whole(spark, given):
    out = corpus_pipeline.run(spark, given)
    assert "sequence_id" in out.columns and out.count() > 0
    assert out.count() == out.select("sequence_id").distinct().count()


@pytest.mark.parametrize("rows", [[], [(1, None), (2, ""), (None, None), (1, "one two")]])
def test_odd_documents(spark, docs, rows):
    table = docs(*rows).select("doc_id", "text", "lang", "source", "n_chars")
    for _, stage in corpus_pipeline.STAGES:
        table = common.stored(stage(spark, table, ""), "odd")
    assert table.count() == 0


def test_texts_that_look_like_numbers_pass_all_stages(spark, docs):
    odd = ["area 10² call 555 555 0199", "0" * 5_000 + ".1.1.1", "①② ٣٤ 555 555 0142 ½ x³"]
    words = "the quick brown fox jumps over the lazy dog and runs away from there again"
    rows = [(i, f"{words} {i} " * 3 + odd[i % 3] * (i < 6), "en", "web") for i in range(40)]
    table = docs(*rows).select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        table = common.stored(stage(spark, table, ""), "odd")
        if name == "personal_data":
            texts = [r.text for r in table.collect()]
            assert any("10²" in t and "<PHONE>" in t for t in texts) or any("<IP>" in t for t in texts)
    assert table.count() > 0 and corpus_pipeline.packed(spark, table, "").count() > 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 199), (199, 200)]
    got = common.components(spark.createDataFrame(edges, "a long, b long")).collect()
    want = {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 199: 199, 200: 199}
    assert sorted((r.node, r.component) for r in got) == sorted(want.items())
    assert common.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_frequent_keys_are_sent(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 7 if i % 3 else 0, i) for i in range(300)], "k long, v long")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "k long, v long"))
    per_key = rows.groupBy("k").agg({"v": "min", "*": "count"}).toDF("k", "a", "b")
    least = "a" if per_key.where("k = 0").first().a < per_key.where("k = 0").first().b else "b"
    per_key = per_key.selectExpr("k", f"{least} AS least", f"{'ab'.replace(least, '')} AS rows_of")
    want = sorted((r.k, r.v, r.least) for r in rows.join(per_key, "k").collect())
    for often in (0, 60, 1000):
        monkeypatch.setattr(common, "FREQUENT_ROWS", often)
        got = common.join_counted(rows, per_key, "k")
        assert sorted((r.k, r.v, r.least) for r in got.collect()) == want


@pytest.fixture
def long_texts(spark):
    """12 MB of texts in one partition, in a session without a limit of its own."""
    kept = spark.conf.get(common.BATCH_BYTES, None)
    spark.conf.unset(common.BATCH_BYTES)
    yield spark.range(0, 3_000, 1, 1).selectExpr("id AS doc_id", "repeat('word', 1000) AS text", "'en' AS lang")
    spark.conf.unset(common.BATCH_BYTES)
    if kept is not None:
        spark.conf.set(common.BATCH_BYTES, kept)


def test_python_gets_batches_of_bounded_bytes(long_texts, monkeypatch):
    real = common.parts_of

    def checked(batch, columns):
        assert batch.nbytes < 1.1 * common.BYTES_AT_ONCE, batch.nbytes
        return real(batch, columns)

    for module in (common, packing):
        monkeypatch.setattr(module, "parts_of", checked)
    assert minhash.signed(long_texts).count() == 3_000
    assert packing.pack(long_texts).agg(F.countDistinct("doc_id")).first()[0] == 3_000


def test_a_limit_of_the_session_stays(long_texts):
    spark = long_texts.sparkSession
    spark.conf.set(common.BATCH_BYTES, "1m")
    packing.pack(long_texts)
    assert spark.conf.get(common.BATCH_BYTES) == "1m"


def test_judging_holds_few_logs_at_once():
    texts = [chr(0x4E00 + i) * 3 + chr(0x5000 + i * 7 % 5_000) * 2 for i in range(4_000)]
    counts = {x: np.unique(np.concatenate([langid.grams(langid.normal(t)) for t in texts[k::4]]),
                           return_counts=True) for k, x in enumerate("abcd")}
    model = langid.kneser_ney(counts)
    text = " ".join(texts * 60)
    tracemalloc.start()
    model.entropies([text])
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 70_000_000, most
