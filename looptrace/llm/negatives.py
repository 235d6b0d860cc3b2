"""Hard negatives for anchor vectors: for each of an anchor's positives, the best rows of other
labels whose score lies between two shares of the positive's.

Slot-decomposed selection. The windows of an anchor's positives overlap, but their upper limits cut
the scores into disjoint slots. Every task keeps the best k rows per anchor and slot, so does the
merge over tasks, and as slots are disjoint and descending, the window of any positive is answered
by its slot and those below it, best first, down to its own lower limit.

Anchors, a stated share of all rows, meet all rows in blocks of a bounded number of components: a
cell is a block of rows beside a block of anchors, and only the best of a cell leave it. Positives are
searched among the rows of the anchor's label, so a label that holds a third of all rows has as
many more cells. No vector is broadcast.

Components are whole numbers and scores are exact: as floats where all partial sums of a cell are
sure to be exact, else as Python's integers. A shorter vector counts as if zeros followed. Scores
beyond +-(2^63 - 1), and components beyond a long, count as those ends. Rows with a null label or vector, or with a null
or non-finite component, take no part. Equal scores are ordered by id, null ids last. Each row is a
row of its own: equal rows are positives or negatives of each other, and an anchor that occurs
twice has its answers twice. An empty table gives no rows, only id, vector and label are read of
any others, and vectors may be of any length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from looptrace.llm.common import join_counted, partitions_for
from looptrace.session import stored

BLOCK = 4_000_000  # components of a block, about
ROWS_AT_ONCE = 1_024  # rows and anchors that are multiplied together
ANCHORS_AT_ONCE = 256
PENDING = 50_000  # candidates that wait until only the best of each slot stay
MOST = 2**63 - 1


def quantised(vectors: Column, scale: int) -> Column:
    """floor(scale * x) of every component, x as double; null if any is null or not finite."""

    def bad(x: Column) -> Column:
        x = x.cast("double")
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    whole = F.transform(vectors, lambda x: F.floor(scale * x.cast("double")).cast("long"))
    return F.when(~F.exists(vectors, bad), whole)


def by_length(lists: pa.ChunkedArray) -> list[tuple[int, np.ndarray, np.ndarray, float]]:
    """(length, row numbers, matrix, greatest norm) for every length of vector."""
    lists = lists.combine_chunks()
    lengths = np.asarray(lists.value_lengths())
    starts = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.asarray(lists.flatten(), np.int64)
    out = []
    for n in np.unique(lengths):
        own = np.flatnonzero(lengths == n)
        if len(own) == len(lengths):
            matrix = flat.reshape(-1, n)
        else:
            matrix = flat[starts[own][:, None] + np.arange(n)]
        norm = np.sqrt(np.square(matrix, dtype=np.float64).sum(1).max(initial=0))
        out.append((int(n), own, matrix, float(norm)))
    return out


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products of whole numbers; `bound` is above the size of every partial sum."""
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return (a.astype(kind) @ b.astype(kind).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -MOST, MOST).astype(np.int64)


class Best:
    """The best k rows of each slot of some anchors; a slot holds the scores from its floor to its
    top, and its floor rises with the k-th best, as no lower score can enter."""

    def __init__(self, k: int, floors: np.ndarray, tops: np.ndarray, rank: np.ndarray):
        self.k, self.floors, self.tops, self.rank = k, floors.copy(), tops, rank
        self.at = self.score = self.row = np.zeros(0, np.int64)
        self.parts, self.pending = [], 0

    def add(self, score: np.ndarray, allowed: np.ndarray, rows: np.ndarray) -> None:
        slots = self.tops.shape[1]
        for s in range(slots):
            hit = (score >= self.floors[:, s, None]) & (score <= self.tops[:, s, None]) & allowed
            x, y = np.nonzero(hit)
            if len(x):
                self.parts.append((x * slots + s, score[x, y], rows[y]))
                self.pending += len(x)
        if self.pending > PENDING:
            self.keep()

    def keep(self) -> None:
        at, score, row = (
            np.concatenate(x) for x in zip((self.at, self.score, self.row), *self.parts)
        )
        order = np.lexsort((self.rank[row], -score, at))
        at, score, row = at[order], score[order], row[order]
        n = np.arange(len(at))
        new = np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]
        place = n - np.maximum.accumulate(np.where(new, n, 0))
        full = place == self.k - 1
        self.floors.reshape(-1)[at[full]] = score[full]
        kept = place < self.k
        self.at, self.score, self.row = at[kept], score[kept], row[kept]
        self.parts, self.pending = [], 0


def limits(lists: pa.ChunkedArray, missing: int) -> np.ndarray:
    """One row per anchor; a slot that it lacks lets nothing through."""
    rows = lists.to_pylist()
    out = np.full((len(rows), max(map(len, rows), default=0)), missing, np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def best_of_cell(anchors: pa.Table, rows: pa.Table, same: bool, k: int) -> pa.Table:
    """The best k rows per anchor and slot, among rows with the anchor's label (`same`) or without;
    no row is compared with itself."""
    labels = pa.chunked_array(anchors["label"].chunks + rows["label"].chunks).combine_chunks()
    codes = np.asarray(labels.dictionary_encode().indices)
    own, other = codes[: len(anchors)], codes[len(anchors) :]
    me, them = np.asarray(anchors["row_no"]), np.asarray(rows["row_no"])
    by_id = [("vec_id", "ascending"), ("row_no", "ascending")]
    rank = np.empty(len(rows), np.int64)
    order = pc.sort_indices(rows.select(["vec_id", "row_no"]), by_id, null_placement="at_end")
    rank[np.asarray(order)] = np.arange(len(rows))
    tops, floors = limits(anchors["tops"], -MOST), limits(anchors["floors"], MOST)
    found, candidates = [], by_length(rows["vec"])
    for n, mine, a, longest in by_length(anchors["vec"]):
        for i in range(0, len(mine), ANCHORS_AT_ONCE):
            some = mine[i : i + ANCHORS_AT_ONCE]
            best = Best(k, floors[some], tops[some], rank)
            for m, theirs, b, norm in candidates:
                both = min(n, m)
                for j in range(0, len(theirs), ROWS_AT_ONCE):
                    few = theirs[j : j + ROWS_AT_ONCE]
                    score = products(
                        a[i : i + ANCHORS_AT_ONCE, :both],
                        b[j : j + ROWS_AT_ONCE, :both],
                        1.001 * longest * norm,
                    )
                    allowed = (own[some][:, None] == other[few]) == same
                    if same:
                        allowed &= me[some][:, None] != them[few]
                    best.add(score, allowed, few)
            best.keep()
            slots = max(1, tops.shape[1])
            found.append((me[some[best.at // slots]], best.at % slots, best.score, best.row))
    anchor, slot, score, row = (
        (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 4
    )
    return pa.table(
        {
            "anchor": anchor,
            "slot": pa.array(slot, pa.int32()),
            "score": score,
            "vec_id": rows["vec_id"].take(pa.array(row)),
            "row_no": them[row],
        }
    )


def _best(anchors: DataFrame, rows: DataFrame, cell: list[str], same: bool, k: int) -> DataFrame:
    """The best k rows per anchor and slot over all cells."""
    kind = rows.schema["vec_id"].dataType.simpleString()
    found = (
        anchors.groupBy(*cell)
        .cogroup(rows.groupBy(*cell))
        .applyInArrow(
            lambda a, b: best_of_cell(a, b, same, k),
            f"anchor long, slot int, score long, vec_id {kind}, row_no long",
        )
    )
    order = (F.desc("score"), F.asc_nulls_last("vec_id"), "row_no")
    place = F.row_number().over(Window.partitionBy("anchor", "slot").orderBy(*order))
    return found.withColumn("place", place).where(F.col("place") <= k)


def _block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("row_no"), blocks).cast("int")


def _components() -> Column:
    return F.sum(F.size("vec") + 1)


def _positives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The best k other rows of each anchor's label; blocks of rows and anchors by label."""

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = F.ceil(_components() / BLOCK).cast("int")
        return df.groupBy("label").agg(n.alias(name), F.count("*").alias(f"{name}_rows"))

    per_label = stored(
        blocks(rows, "row_blocks")
        .join(blocks(anchors, "anchor_blocks"), "label")
        .select("label", "row_blocks", "anchor_blocks", F.col("row_blocks_rows").alias("rows_of")),
        "labels",
    )

    def each(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    dealt_rows = join_counted(rows, per_label, "label").select(
        "*", _block(F.col("row_blocks")).alias("rb"), each("anchor_blocks").alias("ab")
    )
    everything = (F.array(F.lit(MOST)).alias("tops"), F.array(F.lit(-MOST)).alias("floors"))
    dealt_anchors = join_counted(anchors, per_label, "label").select(
        "*", *everything, _block(F.col("anchor_blocks")).alias("ab"), each("row_blocks").alias("rb")
    )
    return _best(dealt_anchors, dealt_rows, ["label", "rb", "ab"], True, k)


def _negatives(anchors: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The best k rows of other labels per anchor and slot; blocks of all rows and anchors."""
    total, count = rows.agg(_components(), F.count("*")).first()
    tasks = min(rows.sparkSession.sparkContext.defaultParallelism, max(1, count))
    row_blocks = max(partitions_for(total or 0, BLOCK), tasks)
    anchor_blocks = partitions_for(anchors.agg(_components()).first()[0] or 0, BLOCK)

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    dealt_rows = rows.select("*", _block(F.lit(row_blocks)).alias("rb"), each(anchor_blocks).alias("ab"))
    dealt_anchors = anchors.select(
        "*", _block(F.lit(anchor_blocks)).alias("ab"), each(row_blocks).alias("rb")
    )
    return _best(dealt_anchors, dealt_rows, ["rb", "ab"], False, k)


def _share(score: str, percent: int, up: bool) -> Column:
    """`percent` hundredths of a score that is not negative, cut or rounded up; cannot overflow."""
    whole, rest = F.expr(f"{score} div 100"), F.expr(f"{score} % 100") * percent
    return whole * percent + F.floor((rest + (99 if up else 0)) / 100).cast("long")


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    n_positives: int = 5,
    n_negatives: int = 10,
    low: int = 30,
    high: int = 90,
    scale: int = 256,
) -> DataFrame:
    """For the rows of `vectors` (vec_id, embedding, label) where `anchor` holds, and each of their
    first `n_positives` rows of the same label, the first `n_negatives` rows of other labels whose
    score is from `low` to `high` hundredths of the positive's (at most 100)."""
    rows = stored(
        vectors.select(
            "vec_id",
            "label",
            quantised(F.col("embedding"), scale).alias("vec"),
            F.coalesce(anchor, F.lit(False)).alias("is_anchor"),
        )
        .where("label IS NOT NULL AND vec IS NOT NULL")
        .withColumn("row_no", F.monotonically_increasing_id()),
        "vectors",
    )
    anchors = stored(rows.where("is_anchor").drop("is_anchor"), "anchors")
    rows = rows.drop("is_anchor")
    positives = stored(
        _positives(anchors, rows, n_positives)
        .where("score >= 0")
        .select(
            "anchor",
            F.col("vec_id").alias("positive_id"),
            F.col("score").alias("positive_score"),
            F.col("place").alias("positive"),
            _share("score", low, True).alias("least"),
            _share("score", high, False).alias("top"),
        )
        .where("least <= top"),
        "positives",
    )
    below = Window.partitionBy("anchor").orderBy(F.desc("top"))
    slots = (
        positives.groupBy("anchor", "top")
        .agg(F.min("least").alias("least"))
        .select(
            "anchor",
            "top",
            (F.row_number().over(below) - 1).alias("slot"),
            F.greatest("least", F.lead("top").over(below) + 1).alias("floor"),
        )
    )
    limited = slots.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("slot", "top", "floor"))).alias("slots")
    ).select(
        F.col("anchor").alias("row_no"),
        F.col("slots.top").alias("tops"),
        F.col("slots.floor").alias("floors"),
    )
    best = _negatives(stored(anchors.join(limited, "row_no"), "anchors"), rows, n_negatives)
    merged = best.groupBy("anchor").agg(
        F.sort_array(F.collect_list(F.struct("slot", "place", "score", "vec_id"))).alias("best")
    )
    window = F.filter(
        "best", lambda b: (b["slot"] >= F.col("slot")) & (b["score"] >= F.col("least"))
    )
    names = anchors.select(F.col("row_no").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    return (
        positives.join(slots.select("anchor", "top", "slot"), ["anchor", "top"])
        .join(merged, "anchor")
        .join(names, "anchor")
        .select(
            "anchor_id",
            "positive_id",
            "positive_score",
            F.posexplode(F.slice(window, 1, n_negatives)).alias("at", "negative"),
        )
        .select(
            "anchor_id",
            "positive_id",
            (F.col("at") + 1).cast("int").alias("rank"),
            F.col("negative.vec_id").alias("negative_id"),
            "positive_score",
            F.col("negative.score").alias("negative_score"),
        )
    )
