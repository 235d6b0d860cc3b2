"""Aggregates and ratios with the result types the reports promise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def whole_mean(value: Column) -> Column:
    """Mean of whole numbers, cut toward zero; NULL over no values."""
    n = F.count(value)
    return F.when(n > 0, F.call_function("div", F.sum(value), n))


def mean(value: Column, digits: int = 6) -> Column:
    return F.round(F.avg(value.cast("double")), digits)


def ratio(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(part.cast("double") / whole.cast("double"), digits)
