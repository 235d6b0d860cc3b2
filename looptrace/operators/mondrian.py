"""Groups of at least k alike rows by recursive median cuts (Mondrian) over several columns.

All rows start as one part. A part is cut in two at the median of its widest column, measured against
the whole table's range, if both sides keep k rows: at the median, or just below it where it fills
the upper half. Else the next widest column is tried; a part that no column cuts is a group.

Large parts are cut all at once, a level at a time, by counts and approximate medians per part: only a
row's number, its columns and its part move, and parts leave the table as soon as they are small or
cannot be cut. What is broadcast is a row per part of more than LEAF rows, never the rows, whose files are
far smaller than the rows in memory. Parts of up to LEAF rows are cut to the end inside a task, with exact medians. So a
table takes about log2(rows / LEAF) passes, and no task holds more than LEAF rows, however many
of them are equal.

Columns are numbers, times, texts or flags. A null is a value of its own below all others; texts
are ordered by their first six bytes. Equal rows are never cut apart.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.session import stored

LEAF = 50_000  # rows that a task cuts to the end
ACCURACY = 1_000  # of approximate medians: their ranks are off by a part of this at most


def code(column: str, kind: T.DataType) -> Column:
    """A column's order as a double; NULL for NULL."""
    value = F.col(f"`{column}`")
    if isinstance(kind, T.StringType):
        start = F.rpad(F.hex(F.substring(value.cast("binary"), 1, 6)), 12, "0")
        return F.conv(start, 16, 10).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value.cast("timestamp")) / 1e6
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("double")
    if isinstance(kind, T.BooleanType):
        return value.cast("int").cast("double")
    number = value.cast("double")
    return F.when(~F.isnan(number), number)


def _ranges(coded: DataFrame, codes: list[str]) -> dict[str, tuple[float, float]]:
    """By code: what stands for NULL, a sixteenth below the least, and the width of all values."""
    asked = [f(c).alias(f"{name}_{c}") for c in codes for name, f in (("a", F.min), ("b", F.max))]
    asked += [F.max(F.col(c).isNull()).alias(f"n_{c}") for c in codes]
    found = coded.agg(*asked).first()
    out = {}
    for c in codes:
        low, high = found[f"a_{c}"] or 0.0, found[f"b_{c}"] or 0.0
        null = low - max((high - low) / 16, 1.0)
        out[c] = null, (high - (null if found[f"n_{c}"] else low)) or 1.0
    return out


def cut(x: np.ndarray, widths: np.ndarray, k: int) -> np.ndarray | None:
    """Which rows are on the upper side of a part's cut; None if it has none."""
    spread = (x.max(0) - x.min(0)) / widths
    for j in np.argsort(-spread, kind="stable"):
        if spread[j] <= 0:
            break
        column = x[:, j]
        middle = np.partition(column, (len(x) - 1) // 2)[(len(x) - 1) // 2]
        for upper in (column > middle, column >= middle):
            if k <= upper.sum() <= len(x) - k:
                return upper
    return None


def groups_of(x: np.ndarray, widths: np.ndarray, k: int) -> np.ndarray:
    """The group of each row of a small part."""
    out, waiting, groups = np.zeros(len(x), np.int64), [np.arange(len(x))], 0
    while waiting:
        rows = waiting.pop()
        upper = cut(x[rows], widths, k) if len(rows) >= 2 * k else None
        if upper is None:
            out[rows] = groups
            groups += 1
        else:
            waiting += [rows[upper], rows[~upper]]
    return out


def _level(open_rows: DataFrame, codes: list[str], widths: list[float], k: int, leaf: int) -> DataFrame:
    """Every part of many rows cut once; `state` says whether its sides are still open (many rows),
    leaves (at most LEAF) or whole (no cut)."""
    stats = stored(
        open_rows.groupBy("part").agg(
            F.count("*").alias("n"),
            *((F.max(c) - F.min(c)).alias(f"w_{c}") for c in codes),
            *(F.percentile_approx(c, 0.5, ACCURACY).alias(f"m_{c}") for c in codes),
        ),
        "medians",
    )
    medians = stats.select("part", *(f"m_{c}" for c in codes))
    beside = open_rows.join(F.broadcast(medians), "part")
    counts = beside.groupBy("part").agg(
        *(F.count_if(F.col(c) > F.col(f"m_{c}")).alias(f"above_{c}") for c in codes),
        *(F.count_if(F.col(c) >= F.col(f"m_{c}")).alias(f"from_{c}") for c in codes),
    )

    def option(at: int, c: str, upper: str, whole: bool) -> Column:
        size = F.col(f"{upper}_{c}")
        fits = (size >= k) & (F.col("n") - size >= k)
        return F.when(
            fits,
            F.struct(
                (-F.col(f"w_{c}") / widths[at]).alias("order"),
                F.lit(at).alias("at"),
                F.lit(whole).alias("whole"),
                F.col(f"m_{c}").alias("value"),
                size.alias("upper"),
            ),
        )

    options = [
        option(i, c, *side) for i, c in enumerate(codes) for side in (("above", False), ("from", True))
    ]
    best = F.array_min(F.array_compact(F.array(*options)))
    cuts = stats.join(counts, "part").select("part", "n", best.alias("cut"))
    rows = open_rows.join(F.broadcast(cuts), "part")
    value = reduce(lambda a, b: F.coalesce(a, b), (F.when(F.col("cut.at") == i, F.col(c)) for i, c in enumerate(codes)))
    upper = F.when(F.col("cut.whole"), value >= F.col("cut.value")).otherwise(value > F.col("cut.value"))
    size = F.when(upper, F.col("cut.upper")).otherwise(F.col("n") - F.col("cut.upper"))
    state = F.when(F.col("cut").isNull(), "whole").when(size > leaf, "open").otherwise("leaf")
    # a part's number is a hash of the way to it; parts that share one would only be one larger group
    part = F.when(F.col("cut").isNull(), F.col("part")).otherwise(F.xxhash64("part", upper))
    return stored(
        rows.withColumns({"state": state, "next": part}).drop("part", "n", "cut")
        .withColumnRenamed("next", "part"),
        "cuts",
    )


def grouped(df: DataFrame, row: str, columns: list[str], k: int, leaf: int | None = None) -> DataFrame:
    """(row, part, grp): the group of every row of `df`, named by two numbers.

    `row` numbers the rows. Every group has k rows or more; with fewer in all, there are none."""
    leaf = max(leaf or LEAF, 2 * k)
    codes = [f"x{i}" for i in range(len(columns))]
    kinds = df.schema
    coded = df.select(row, *(code(c, kinds[c].dataType).alias(x) for c, x in zip(columns, codes)))
    ranges = _ranges(coded, codes)
    widths = [ranges[x][1] for x in codes]
    filled = coded.select(
        row, *(F.coalesce(x, F.lit(ranges[x][0])).alias(x) for x in codes), F.lit(0).cast("long").alias("part")
    )
    rows = df.count()
    if rows < k:
        return filled.select(row, "part", F.lit(0).cast("long").alias("grp")).where("false")
    closed, open_rows = [], None
    if rows > leaf:
        open_rows = filled
    else:
        closed.append(filled.withColumn("state", F.lit("leaf")))
    while open_rows is not None:
        level = _level(open_rows, codes, widths, k, leaf)
        closed.append(level.where("state <> 'open'"))
        open_rows = level.where("state = 'open'").drop("state")
        open_rows = None if open_rows.isEmpty() else open_rows
    done = reduce(DataFrame.unionByName, closed)
    kind = df.schema[row].dataType.simpleString()

    def leaves(table: pa.Table) -> pa.Table:
        x = np.stack([np.asarray(table[c], np.float64) for c in codes], 1)
        found = groups_of(x, np.array(widths), k)
        return table.select([row, "part"]).append_column("grp", pa.array(found))

    cut_up = done.where("state = 'leaf'").groupBy("part").applyInArrow(
        leaves, f"`{row}` {kind}, part long, grp long"
    )
    whole = done.where("state = 'whole'").select(row, "part", F.lit(-1).cast("long").alias("grp"))
    return cut_up.unionByName(whole)
