"""Newest rows per group.

Ranking with a bound on the rank makes Spark keep only the best rows per group and task
before the shuffle, so a group that holds a third of all rows costs one row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def newest(df: DataFrame, keys: list[str], order: list[str], n: int = 1) -> DataFrame:
    """The ``n`` last rows per group by ``order`` (unique as a whole), ranked 1.. in ``rank``."""
    by = Window.partitionBy(*keys).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= n)


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return newest(df, keys, order).drop("rank")
