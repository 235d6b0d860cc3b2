"""Token counts of whole texts by two tiers of known lengths, without any shuffle.

The pieces between spaces that are frequent in a bounded sample of documents are encoded once and
sent to every worker as a compact table of lengths. Pieces that it lacks go through a cache in each
worker. The sample only decides what is looked up fast: every piece that is not in the table is
encoded itself, so no count depends on it.

A null or empty text has 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives
no rows; columns named like a result are replaced, others pass through.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.llm import tokens
from looptrace.llm.common import append

LIMIT = 512
SAMPLE_DOCS = 5_000  # documents, about, that decide which pieces are sent along
FREQUENT = 20_000  # pieces sent along at most
LONGEST = 32  # characters of such a piece at most, so the table stays below 3 MB
FIELDS = (
    T.StructField("n_bytes", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("over_limit", T.BooleanType()),
)


def frequent_lengths(docs: DataFrame, path: str) -> tuple[str, bytes]:
    """The frequent pieces, joined by spaces, and the token count of each as a byte."""
    rows = docs.count()
    if not rows:
        return "", b""
    sample = docs.select("text").where("text IS NOT NULL")
    if rows > SAMPLE_DOCS:
        sample = sample.sample(fraction=SAMPLE_DOCS / rows, seed=7)
    pieces = (
        sample.select(F.explode(F.slice(F.split("text", " "), 2, 1 << 30)).alias("piece"))
        .where(F.length("piece").between(1, LONGEST))
        .groupBy("piece")
        .count()
        .orderBy(F.desc("count"), "piece")
        .limit(FREQUENT)
    )
    found = [r.piece for r in pieces.collect() if tokens.cuttable(r.piece)]
    encoder = tokens.encoder(path)
    usable = encoder.piece_ids is not None
    found = [p for p in found if usable and not any(s in p for s in encoder.special)]
    return " ".join(found), bytes(len(encoder.encode_piece(" " + p)) for p in found)


class Lengths(dict):
    """Token counts of pieces: the table sent along, then a bounded cache of others."""

    def __init__(self, encoder: tokens.Encoder, known: tuple[str, bytes]):
        super().__init__(zip(known[0].split(" "), known[1]) if known[1] else ())
        self.encoder = encoder
        self.others: dict[str, int | None] = {}

    def __missing__(self, piece: str) -> int | None:
        others = self.others
        if piece in others:
            return others[piece]
        n = len(self.encoder.encode_piece(" " + piece)) if tokens.cuttable(piece) else None
        if len(piece) <= 64:
            if len(others) >= tokens.CACHED:
                others.clear()
            others[piece] = n
        return n

    def of(self, text: str) -> int:
        cut = self.encoder.pieces(text)
        if cut:
            try:
                first = len(self.encoder.encode_piece(cut[0])) if cut[0] else 0
                return first + sum(map(self.__getitem__, cut[1]))
            except TypeError:  # a piece that can't be counted alone
                pass
        return len(self.encoder.plain(text))


_lengths: dict[tuple[str, int], Lengths] = {}


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """`docs` with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit)."""
    path = path or tokens.default_path()
    sent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def build(text: pa.Array) -> list[pa.Array]:
        key = path, id(sent.value)
        if key not in _lengths:
            _lengths.clear()
            _lengths[key] = Lengths(tokens.encoder(path), sent.value)
        of = _lengths[key].of
        counts = [of(t) if t else 0 for t in text.to_pylist()]
        n_bytes = [len(b) if b else 0 for b in text.cast(pa.binary()).to_pylist()]
        return [
            pa.array(n_bytes, pa.int64()),
            pa.array(counts, pa.int64()),
            pa.array([n > limit for n in counts], pa.bool_()),
        ]

    return append(docs, FIELDS, build)
