"""Mixes sources to target weights: whole copies by rate, one more by a hash-seeded draw.

Sizes are words (runs of anything but ASCII white space); a null text has size 0. Sources are taken
in code-point order, null last (null is a source of its own, as is the empty string), and weigh
`weights` in turn. The targets share the size of all documents by weight; none may exceed
`most` times its source's size, and what is above goes to the others by weight. A document is
emitted floor(target / source size) times, and once more if its draw is below the rest. The draw
depends on the seed and doc_id alone, so reruns agree and rows that repeat a doc_id share it.
Empty tables give no rows; other columns pass through, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from looptrace.llm.common import stored

WEIGHTS = (5, 2, 1)
MOST = 3  # times its source's size that a target may reach
SEED = "mix"
BROADCAST_SOURCES = 50_000  # above so many sources the plan is joined by shuffle
RESULTS = ("size", "source_size", "target", "rate", "copies", "taken")


def words(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: source_size and target.

    With the sources by their limit per weight, those above their limit come first, so the level
    all others share is the greatest of (total - limits of the first k) / (weights of the rest).
    """
    sizes = docs.groupBy("source").agg(F.sum(words(F.col("text"))).alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighted = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1).cast("long")
    ).withColumn("limit", most * F.col("source_size"))
    before = Window.orderBy(
        F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    level = (
        F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0))
    ).cast("double") / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    )
    return (
        weighted.withColumn("level", level)
        .withColumn("level", F.max("level").over(every))
        .select(
            "source",
            "source_size",
            F.least(F.col("limit").cast("double"), F.col("level") * F.col("weight")).alias("target"),
        )
    )


def draw(doc_id, seed: str = SEED) -> F.Column:
    """0 <= draw < 1 from 52 bits of a hash of the seed and the id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix_counts(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """`docs` with size, source_size, target, rate, copies and taken (size times copies)."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    targets = stored(source_targets(docs, weights, most), "mix")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    targets = targets.withColumnRenamed("source", "_source")
    joined = docs.join(targets, docs["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = draw(F.col("doc_id"), seed) < F.col("rate") - F.floor("rate")
    return (
        joined.withColumn("size", words(F.col("text")))
        .withColumn("rate", rate)
        .withColumn("copies", F.floor("rate") + extra.cast("long"))
        .withColumn("taken", F.col("size") * F.col("copies"))
    )


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed documents, with the columns of `docs`: each as often as its copies say."""
    counted = mix_counts(docs, weights, most, seed).where("copies > 0")
    return counted.withColumn(
        "_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))
    ).select(*docs.columns) if not set(map(str.lower, docs.columns)) & set(RESULTS) else (
        _clashing(docs, weights, most, seed)
    )


def _clashing(docs: DataFrame, weights, most: int, seed: str) -> DataFrame:
    """Columns named like a result ride along in a struct."""
    names = docs.columns
    packed = docs.select(
        "doc_id", "text", "source", F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row")
    )
    return mix(packed, weights, most, seed).select("_row.*")
