"""Figures over any range of days from sketches kept per day, without the logs.

A log is read once per day, when the day closes; its rollup has one row per group and day, whose size is
bounded by a parameter.  Sketches of days merge into that of a range: percentiles by KLL, distinct
counts, and counts of what is in one set and not in another, by theta sketches.  Both are exact while
a range's group has fewer values than the parameter, and close to that beyond (see each report).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from looptrace.functions.timefn import AsOf
from looptrace.plans.cycles import linked, retailer_names

KLL_K = 4_096  # values that a level of a percentile sketch holds
THETA_LG = 12  # binary logarithm of the ids that a distinct sketch holds


def write_rollup(rollup: DataFrame, path: str, mode: str = "error") -> None:
    """A rollup in a folder per month, its days in order: a day's rows alone would make tiny files."""
    (
        rollup.withColumn("month", F.trunc("day", "month"))
        .repartition("month")
        .sortWithinPartitions("month", "day")
        .write.partitionBy("month")
        .mode(mode)
        .parquet(path)
    )


def read_rollup(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, month date").parquet(path)


def in_days(rollup: DataFrame, since: AsOf | None, until: AsOf | None) -> DataFrame:
    """The days from ``since`` to ``until``, both with; folders of other months are not read."""
    stored = "month" in rollup.columns
    if since is not None:
        day = F.to_date(F.lit(str(since)))
        rollup = rollup.filter(F.col("day") >= day)
        rollup = rollup.filter(F.col("month") >= F.trunc(day, "month")) if stored else rollup
    if until is not None:
        day = F.to_date(F.lit(str(until)))
        rollup = rollup.filter(F.col("day") <= day)
        rollup = rollup.filter(F.col("month") <= day) if stored else rollup
    return rollup


SENSOR_ROLLUP = "sensor_type string, readings bigint, sketch binary, day date"


def sensor_rollup(sensor_readings: DataFrame, k: int = KLL_K) -> DataFrame:
    """(sensor_type, readings, sketch, day): the distribution of each day's values."""
    return sensor_readings.groupBy("sensor_type", F.to_date("measured_at").alias("day")).agg(
        F.count("value").alias("readings"),
        F.kll_sketch_agg_double(F.col("value").cast("double"), k).alias("sketch"),
    ).select("sensor_type", "readings", "sketch", "day")


def sensor_percentiles(
    rollup: DataFrame,
    since: AsOf | None = None,
    until: AsOf | None = None,
    ps: tuple[float, ...] = (0.5, 0.9),
    k: int = KLL_K,
) -> DataFrame:
    """Percentiles of the readings per sensor type over a range of days.

    Each is a value that was read, the least that has the asked share of readings at or below it.  A
    type with up to ``k`` readings in the range has its exact percentiles; beyond, the share is off by
    about 2.3 / k ** 0.9 at most in 99 of 100 cases (0.0013 for the default).
    """
    found = in_days(rollup, since, until).filter("readings > 0").groupBy("sensor_type").agg(
        F.sum("readings").alias("readings"), F.kll_merge_agg_double("sketch", k).alias("sketch")
    )
    return found.select(
        "sensor_type",
        "readings",
        *(
            F.kll_sketch_get_quantile_double("sketch", F.lit(float(p))).alias(f"p{round(100 * p)}")
            for p in ps
        ),
    )


LOAN_ROLLUP = "retailer_id bigint, lent binary, back binary, day date"


def loan_rollup(checkouts: DataFrame, returns: DataFrame, lg: int = THETA_LG) -> DataFrame:
    """(retailer_id, lent, back, day): each day's checkouts of a retailer, and the checkouts of it that
    a return of that day links to."""
    lent = checkouts.select(
        "retailer_id", F.to_date("checkout_time").alias("day"), F.col("checkout_id").alias("lent"),
        F.lit(None).cast("bigint").alias("back"),
    )
    back = (
        linked(returns)
        .select("checkout_id", F.to_date("return_time").alias("day"))
        .join(checkouts.select("checkout_id", "retailer_id"), "checkout_id")
        .select("retailer_id", "day", F.lit(None).cast("bigint").alias("lent"),
                F.col("checkout_id").alias("back"))
    )
    return (
        lent.unionByName(back)
        .groupBy("retailer_id", "day")
        .agg(*(F.theta_sketch_agg(c, lg).alias(c) for c in ("lent", "back")))
        .select("retailer_id", "lent", "back", "day")
    )


def loans_in_days(
    rollup: DataFrame, since: AsOf | None = None, until: AsOf | None = None, lg: int = THETA_LG
) -> DataFrame:
    """(retailer_id, checkouts, returned, open_loans): distinct checkouts of the days from ``since`` to
    ``until``, those of them that came back by the end of ``until``, and those that did not.

    Exact while a retailer has fewer than 2 ** lg checkouts in the range and as many returns;
    beyond, off by about 1 / 2 ** (lg / 2) of its checkouts (0.016 for the default) in two of three cases.
    """
    days = in_days(rollup, None, until)
    asked = F.lit(True) if since is None else F.col("day") >= F.to_date(F.lit(str(since)))
    sets = days.groupBy("retailer_id").agg(
        F.theta_union_agg(F.when(asked, F.col("lent")), lg).alias("lent"),
        F.theta_union_agg("back", lg).alias("back"),
    )
    count = F.theta_sketch_estimate
    return sets.select(
        "retailer_id",
        count("lent").alias("checkouts"),
        count(F.theta_intersection("lent", "back")).alias("returned"),
        count(F.theta_difference("lent", "back")).alias("open_loans"),
    ).filter("checkouts > 0")


def dashboard_in_days(
    rollup: DataFrame,
    retailers: DataFrame,
    locations: DataFrame,
    since: AsOf | None = None,
    until: AsOf | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Checkouts, returned and open loans per retailer over a range of days, from sketches."""
    out = loans_in_days(rollup, since, until).join(retailer_names(retailers, locations), "retailer_id")
    out = out.select("retailer", "checkouts", "returned", "open_loans")
    return out.orderBy(F.desc("checkouts"), "retailer") if ordered else out
