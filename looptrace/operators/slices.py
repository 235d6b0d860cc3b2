"""Ordered computations inside groups, safe for groups of any size.

A window over a key sorts the whole group in one task.  So rows are dealt out by ranges of
(key, order) first, in which any group, and any single instant of one, may be cut; the
range a row falls into is its slice.  The window runs inside (key, slice), and what crosses
a slice border, a running total or the previous row, comes from one aggregated row per key
and slice.

The dealt rows are written to the shared folder before they are used, so every later step and
every repeated task sees the same slices.  A border lies inside one key at most, so there
are fewer rows to carry than slices; that is the proven bound of the only broadcast here.
The plan is the same for any data; a NULL key is a group like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from looptrace.session import stored


def sliced(df: DataFrame, key: str, order: list[str], slices: int | None = None) -> DataFrame:
    """``df`` + ``_slice``: ranges of (key, order), ascending, as many as shuffles have by default."""
    by = [key, *order]
    dealt = df.repartitionByRange(slices, *by) if slices else df.repartitionByRange(*by)
    return stored(dealt.withColumn("_slice", F.spark_partition_id()), "slices")


def with_carry(
    cut: DataFrame, out: DataFrame, key: str, per_slice, over_slices, after: bool = False
) -> DataFrame:
    """``out``, rows of ``cut``, + ``_carry``: what the slices before the row's slice (``after``: those
    behind it) hand on.

    ``per_slice`` aggregates a slice of a key; ``over_slices`` makes of those, over a window of the
    key's slices in order, what goes on to the next (NULL: nothing)."""
    along = F.desc("_slice") if after else F.asc("_slice")
    carry = (
        cut.groupBy(key, "_slice")
        .agg(per_slice)
        .select(
            F.col(key).alias("_key"),
            F.col("_slice").alias("_to"),
            over_slices(Window.partitionBy(key).orderBy(along)).alias("_carry"),
        )
        .filter("_carry IS NOT NULL")
    )
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_slice") == F.col("_to"))
    return out.join(F.broadcast(carry), same, "left").drop("_key", "_to")


RUNNING = {
    "sum": F.sum,
    "min": F.min,
    "max": F.max,
    "last": lambda value: F.last(value, ignorenulls=True),
}


def scanned(cut: DataFrame, key: str, order: list[str], after: bool = False, **values) -> DataFrame:
    """``cut`` + a column per name: what its value comes to over the rows before (``after``: behind),
    in ``order`` within ``key``; the row itself and its ``_slice`` stay, so scans can follow each other.

    A value is (kind, column): ``sum`` (0 before the first row), ``min``, ``max`` or ``last`` (the
    nearest that is not NULL).  Each is a map that a slice hands on and the next composes with its own, so cut and
    uncut groups agree.  Scans in a row make an automaton: ``last`` is a part of a state that events set
    or keep, and what they set may hang on the parts scanned before.
    """
    before = (Window.unboundedPreceding, -1)
    named = {name: f"_of_{name}" for name in values}
    cut = cut.withColumns({named[name]: column for name, (_, column) in values.items()})
    along = [F.desc(c) if after else F.asc(c) for c in order]
    within = Window.partitionBy(key, "_slice").orderBy(*along).rowsBetween(*before)
    nearest = F.min_by if after else F.max_by

    def of_slice(name: str):
        kind, column = values[name][0], F.col(named[name])
        if kind == "last":
            return nearest(column, F.when(column.isNotNull(), F.struct(*order)))
        return RUNNING[kind](column)

    def handed_on(slices):
        slices = slices.rowsBetween(*before)
        parts = (RUNNING[kind](f"_all.{n}").over(slices).alias(n) for n, (kind, _) in values.items())
        return F.when(F.count("*").over(slices) > 0, F.struct(*parts))

    found = with_carry(
        cut,
        cut.withColumns({n: RUNNING[kind](named[n]).over(within) for n, (kind, _) in values.items()}),
        key,
        F.struct(*(of_slice(n).alias(n) for n in values)).alias("_all"),
        handed_on,
        after,
    )
    joined = {
        "sum": lambda own, carry: F.coalesce(own, F.lit(0)) + F.coalesce(carry, F.lit(0)),
        "min": F.least,
        "max": F.greatest,
        "last": F.coalesce,
    }
    return found.withColumns(
        {n: joined[kind](F.col(n), F.col(f"_carry.{n}")) for n, (kind, _) in values.items()}
    ).drop("_carry", *named.values())


def running_sum(
    df: DataFrame, key: str, order: list[str], value: str, out: str, slices: int | None = None
) -> DataFrame:
    """``df`` + ``out``: sum of ``value`` up to and with the row, in ``order`` within ``key``."""
    cut = sliced(df, key, order, slices)
    within = Window.partitionBy(key, "_slice").orderBy(*order)
    summed = with_carry(
        cut,
        cut.withColumn(out, F.sum(value).over(within.rowsBetween(Window.unboundedPreceding, 0))),
        key,
        F.sum(value).alias("_sum"),
        lambda w: F.sum("_sum").over(w.rowsBetween(Window.unboundedPreceding, -1)),
    )
    total = F.when(F.col("_carry").isNull(), F.col(out)).otherwise(
        F.coalesce(F.col(out), F.lit(0)) + F.col("_carry")
    )
    return summed.withColumn(out, total).drop("_carry", "_slice")


def previous(
    df: DataFrame, key: str, order: list[str], keep: list[str], slices: int | None = None
) -> DataFrame:
    """``df`` + struct ``prev``: the ``keep`` columns of the row before, NULL for the first."""
    row = F.struct(*keep)
    cut = sliced(df, key, order, slices)
    within = Window.partitionBy(key, "_slice").orderBy(*order)
    found = with_carry(
        cut,
        cut.withColumn("prev", F.lag(row).over(within)),
        key,
        F.max_by(row, F.struct(*order)).alias("_row"),
        lambda w: F.lag("_row").over(w),
    )
    return found.withColumn("prev", F.coalesce("prev", "_carry")).drop("_carry", "_slice")
