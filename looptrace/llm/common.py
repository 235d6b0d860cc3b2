"""Helpers that several operators share: appended columns, stored tables, words, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.session import stored

SENT_KEYS = 50_000  # frequent keys that are sent to every task, at most
FREQUENT_ROWS = 500  # rows of a key that is never sent
ROWS_AT_ONCE = 512  # texts that a Python function sees together, at most
BYTES_AT_ONCE = 4_000_000  # of them, at most; a longer text is alone
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends Python functions batches of about BYTES_AT_ONCE, unless it has a
    limit of its own. Without one a batch has 10,000 rows of any length, which the executor holds
    outside its heap and the Python worker a second time.

    The limit holds for a query when it runs, so it stays in the session.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, str(BYTES_AT_ONCE))


def parts_of(batch: pa.RecordBatch, columns: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """Slices of a batch that bound the memory of what is made of the columns' texts."""
    sizes = np.zeros(batch.num_rows, np.int64)
    for c in columns:
        kind = batch.schema.field(c).type
        if pa.types.is_string(kind) or pa.types.is_large_string(kind) or pa.types.is_binary(kind):
            sizes += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        fits = int(np.searchsorted(ends, before + BYTES_AT_ONCE, "right"))
        stop = max(start + 1, min(fits, start + ROWS_AT_ONCE))
        yield batch.slice(start, stop - start)
        start = stop


def append(
    docs: DataFrame,
    fields: Sequence[T.StructField],
    build: Callable[..., list[pa.Array]],
    inputs: Sequence[str] = ("text",),
) -> DataFrame:
    """`docs` with the columns that `build` makes of the input columns, slice by slice.

    A column of `docs` whose name clashes with a new one (in any case) is replaced.
    """
    new = {f.name.lower() for f in fields}
    kept = [f for f in docs.schema.fields if f.name.lower() not in new]
    read = list(dict.fromkeys([*(f.name for f in kept), *inputs]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, [read.index(c) for c in inputs]):
                made = build(*(part.column(read.index(c)) for c in inputs))
                columns = [part.column(read.index(f.name)) for f in kept] + made
                yield pa.RecordBatch.from_arrays(
                    columns, names=[f.name for f in kept] + [f.name for f in fields]
                )

    bounded_batches(docs.sparkSession)
    return docs.select(*(f"`{c}`" for c in read)).mapInArrow(
        run, T.StructType([*kept, *fields])
    )


def words_of(text: bytes | None) -> list[bytes]:
    """Runs of anything but the ASCII white space 09-0D and 20."""
    return text.split() if text else []


def utf8(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def partitions_for(total: int, each: int) -> int:
    return max(1, -(-int(total) // each))


def join_counted(rows: DataFrame, per_key: DataFrame, key: str) -> DataFrame:
    """`rows` with what `per_key` has for their key: one row per key, and in `rows_of` how many
    rows have it.

    The rows of a very frequent key would meet in one task. So keys with more than a share of
    1 / SENT_KEYS of all rows, which are fewer than SENT_KEYS whatever the data, are sent to every
    task instead, and only the rows of the others are shuffled.
    """
    per_key = stored(per_key, "per-key")
    total = per_key.agg(F.sum("rows_of")).first()[0] or 0
    often = per_key.where(F.col("rows_of") > max(FREQUENT_ROWS, total // SENT_KEYS))
    near = rows.join(F.broadcast(often), key)
    rest = rows.join(F.broadcast(often.select(key)), key, "left_anti").join(per_key, key)
    return near.unionByName(rest).drop("rows_of")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    twice = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    tops = edges.select(F.col("v").alias("u")).distinct()
    return twice.unionByName(edges.select("u").join(tops, "u", "left_semi")).isEmpty()


def components(edges: DataFrame, purpose: str = "components") -> DataFrame:
    """(node, component): the smallest node that the edges (a, b) reach, for every node on an edge.

    Large-star and small-star steps: every node hooks its neighbours to the smallest of them, until
    all point at their component's smallest node. Only edges move, and a hub's neighbours are
    neither gathered in a row nor in a task.
    """
    edges = stored(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        purpose,
    )
    while not _are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows_of"))
        least = least.select("u", F.least("u", "m").alias("m"), "rows_of")
        large = stored(
            join_counted(both, least, "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct(),
            purpose,
        )
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows_of"))
        small = join_counted(large, lowest, "u")
        edges = stored(
            small.where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(lowest.select("u", F.col("m").alias("v")))
            .distinct(),
            purpose,
        )
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
