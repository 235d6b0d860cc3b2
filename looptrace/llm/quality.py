"""Quality rules: every rule once per document, kept as a bitmask beside the measurements.

`ledger` measures each whole text once and sets one bit per failed rule. Policies are named masks of
the rules that count, so a new policy, and what each of its rules costs, need no second look at the
texts: `verdicts` ands the masks, `ablations` counts documents per mask and reads the rest off the
bits.

A null or empty text has no words and fails the rule on length. Repeated rows are judged each; ties
don't arise; empty tables give no rows; columns named like a measurement are replaced, others pass.
"""

from __future__ import annotations

from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.llm.common import append, utf8, words_of

WINDOW = 8  # words of a passage that may repeat
MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_letters", "n_upper", "n_exclaim", "n_lettered", "n_same_next",
)

# A rule's name and when it fails, on whole numbers so that every engine agrees. The order fixes the
# bits: append new rules, never insert.
RULES = (
    ("few_words", "n_words < 20"),
    ("repeated_passages", "100 * n_repeat_words > 30 * n_words"),
    ("symbols", "100 * n_symbols > 30 * n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("upper_case", "100 * n_upper > 60 * n_letters"),
    ("exclamations", "100 * n_exclaim > 50 * n_words"),
    ("no_letters", "100 * n_lettered < 50 * n_words"),
    ("stuttering", "100 * n_same_next > 30 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("short_words", "2 * word_chars < 4 * n_words"),
)
BIT = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_passages"]
POLICIES = {
    "v1": BASE | BIT["symbols"] | BIT["repeated_lines"],
    "v2": sum(BIT.values()),
}
CURRENT = "v2"

SPACE = bytes([*range(9, 14), 32])
SYMBOLS = b"#*$%&|<>"
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
CONTINUED = bytes(range(0x80, 0xC0))  # bytes of a code point after its first
BARE = bytes(b for b in range(128) if b not in SPACE + UPPER + LOWER)
FACTOR = np.uint64(0x9E3779B97F4A7C15)


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words in windows of `size` words that the text has twice or more."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    hashed = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = hashed ^ (hashed >> np.uint64(29))
    done = 1
    while done < size:  # `size` is a power of two
        mixed = mixed[:-done] * FACTOR + mixed[done:]
        mixed ^= mixed >> np.uint64(32)
        done *= 2
    order = np.argsort(mixed, kind="stable")
    ranked = mixed[order]
    same = ranked[1:] == ranked[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def measure(text: bytes | None) -> tuple[int, ...]:
    """The measures of a UTF-8 text, in the order of MEASURES. Letters are those of ASCII; a word
    is lettered if it has such a letter or any character beyond ASCII."""
    text = text or b""
    words = words_of(text)
    lines = [line for line in text.split(b"\n") if line.strip()]

    def count(chars: bytes) -> int:
        return len(text) - len(text.translate(None, chars))

    upper = count(UPPER)
    return (
        len(words),
        len(text.translate(None, SPACE + CONTINUED)),
        count(SYMBOLS),
        len(lines),
        len(lines) - len(set(lines)),
        repeated_words(words),
        upper + count(LOWER),
        upper,
        text.count(b"!"),
        len(text.translate(None, BARE).split()),
        sum(map(eq, words, words[1:])),
    )


def ledger(docs: DataFrame) -> DataFrame:
    """`docs` with all measures and `failed`, the mask of the rules that failed."""

    def build(text: pa.Array) -> list[pa.Array]:
        rows = [measure(t) for t in utf8(text)]
        return [pa.array(column, pa.int64()) for column in zip(*rows)]

    measured = append(docs, [T.StructField(m, T.LongType()) for m in MEASURES], build)
    failed = sum(
        (F.when(F.expr(rule), F.lit(BIT[name])).otherwise(0) for name, rule in RULES), F.lit(0)
    )
    return measured.withColumn("failed", failed.cast("long"))


def verdicts(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """A ledger with base_failed and kept under a policy."""
    return rows.withColumn("base_failed", F.col("failed").bitwiseAND(BASE) != 0).withColumn(
        "kept", F.col("failed").bitwiseAND(BASE | POLICIES[policy]) == 0
    )


def ablations(rows: DataFrame, policy: str = CURRENT) -> DataFrame:
    """Per rule of a policy: documents that fail it, that fail nothing else, and that the policy
    keeps in all. One row per mask is counted first, at most 2 ** rules of them."""
    masks = rows.groupBy(F.col("failed").bitwiseAND(POLICIES[policy]).alias("mask")).agg(
        F.count("*").alias("n")
    )
    rules = [(name, bit) for name, bit in BIT.items() if bit & POLICIES[policy]]
    table = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.lit(b).alias("bit"))
                                for n, b in rules)))
    fails = F.col("mask").bitwiseAND(F.col("r.bit")) != 0
    return (
        masks.select("mask", "n", table.alias("r"))
        .groupBy(F.col("r.rule").alias("rule"))
        .agg(
            F.sum(F.when(fails, F.col("n")).otherwise(0)).alias("n_failed"),
            F.sum(F.when(F.col("mask") == F.col("r.bit"), F.col("n")).otherwise(0)).alias("n_only"),
            F.sum(F.when(F.col("mask") == 0, F.col("n")).otherwise(0)).alias("n_kept"),
        )
    )
