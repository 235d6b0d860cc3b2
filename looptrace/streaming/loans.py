"""Overdue loans as a join of the checkout and the return stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.plans.packaging import due_date


def st_overdue(
    checkouts: DataFrame,
    returns: DataFrame,
    delay: str = "90 minutes",
    longest_days: int | None = 366,
) -> DataFrame:
    """(checkout_id, instance_id, due_date): loans with no return by their own due date.

    A loan comes out once the watermark has passed its due date.  Loans wait until then;
    returns, two numbers each, wait for loans yet to come, until the watermark is ``longest_days``
    past them.  So no loan may run longer (its return could be forgotten); None keeps them for good.
    """
    loans = (
        checkouts.withColumn("checkout_time", F.col("checkout_time").cast("timestamp"))
        .select("checkout_id", "instance_id", due_date().alias("due_date"))
        .withWatermark("due_date", delay)
    )
    backs = (
        returns.filter("checkout_id IS NOT NULL")
        .select(
            F.col("checkout_id").alias("_loan"),
            F.col("return_time").cast("timestamp").alias("return_time"),
        )
        .withWatermark("return_time", delay)
    )
    in_time = "checkout_id = _loan AND return_time <= due_date"
    if longest_days is not None:
        in_time += f" AND return_time >= due_date - INTERVAL {longest_days} DAYS"
    return (
        loans.join(backs, F.expr(in_time), "left")
        .filter("return_time IS NULL")
        .select("checkout_id", "instance_id", "due_date")
    )
