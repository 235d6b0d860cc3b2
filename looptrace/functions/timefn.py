"""Time arithmetic: calendar-boundary differences and the explicit clock ``as_of``.

Differences count the boundaries crossed, not the time elapsed: 00:59 to 01:01 is one
hour.  They work on whole seconds since the epoch, so no time zone rule enters.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AsOf = str | datetime


def clock(df: DataFrame, column: str, as_of: AsOf) -> Column:
    """``as_of`` as a literal of the column's own type, so that filters still push down."""
    return F.lit(str(as_of)).cast(df.schema[column].dataType)


def since(df: DataFrame, column: str, as_of: AsOf, **ago: int) -> Column:
    """``column`` lies at or after ``as_of`` minus an interval (days=, hours=); no upper bound.

    Where ``df`` is a log by day, its days are bounded too, so that older ones are not read.
    """
    back = F.make_dt_interval(*(F.lit(ago.get(unit, 0)) for unit in ("days", "hours")))
    start = clock(df, column, as_of) - back
    recent = F.col(column) >= start
    return (F.col("event_date") >= F.to_date(start)) & recent if "event_date" in df.columns else recent


def seconds(at: Column) -> Column:
    return F.unix_seconds(at.cast("timestamp"))


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def _boundary(at: Column, width: int) -> Column:
    return F.floor(seconds(at) / F.lit(width))


def hours_between(start: Column, end: Column) -> Column:
    return (_boundary(end, 3600) - _boundary(start, 3600)).cast("bigint")


def minutes_between(start: Column, end: Column) -> Column:
    return (_boundary(end, 60) - _boundary(start, 60)).cast("bigint")


def days_between(start: Column, end: Column) -> Column:
    return F.datediff(F.to_date(end), F.to_date(start)).cast("bigint")


def plus_days(at: Column, days: Column) -> Column:
    """Keeps the time of day, unlike ``date_add``."""
    return at + F.make_dt_interval(days)
