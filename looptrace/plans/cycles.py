"""Reports on loan cycles: checkout to return.

Two shapes of work keep a checkout with very many returns harmless: counts are taken per
checkout before the join, and where a single return must be compared with its due date the
join is an inner one, whose oversized partitions adaptive execution splits; checkouts
without a return are found apart, by an anti-join on distinct ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.functions.numfn import ratio, whole_mean
from looptrace.functions.timefn import hours_between
from looptrace.plans.packaging import due_date


def linked(returns: DataFrame) -> DataFrame:
    return returns.filter("checkout_id IS NOT NULL")


def retailer_names(retailers: DataFrame, locations: DataFrame) -> DataFrame:
    return retailers.join(locations, "location_id").select(
        "retailer_id", F.col("name").alias("retailer")
    )


def loan_hours(checkouts: DataFrame, returns: DataFrame) -> DataFrame:
    """(retailer_id, instance_id, hours) per return that links to its checkout."""
    loans = checkouts.select("checkout_id", "retailer_id", "instance_id", "checkout_time")
    return (
        linked(returns)
        .select("checkout_id", "return_time")
        .join(loans, "checkout_id")
        .select(
            "retailer_id",
            "instance_id",
            hours_between(F.col("checkout_time"), F.col("return_time")).alias("hours"),
        )
    )


def return_counts(checkouts: DataFrame, returns: DataFrame) -> DataFrame:
    """Checkouts + ``n``, the number of returns that link to each, NULL for none."""
    per_checkout = linked(returns).groupBy("checkout_id").agg(F.count("*").alias("n"))
    return checkouts.join(per_checkout, "checkout_id", "left")


def status_counts(checkouts: DataFrame, returns: DataFrame) -> DataFrame:
    """(retailer_id, on_time, late, open): linked returns by their due date, and loans without any.

    One join labels the returns and shows which loans have one; open loans are the others, by
    count.
    """
    loans = checkouts.select("checkout_id", "retailer_id", "checkout_time", "due_back_days")
    timely = F.col("return_time") <= due_date()
    per_loan = (
        linked(returns)
        .select("checkout_id", "return_time")
        .join(loans, "checkout_id")
        .groupBy("retailer_id", "checkout_id")
        .agg(F.count_if(timely).alias("on_time"), F.count("*").alias("n"))
    )
    closed = per_loan.groupBy("retailer_id").agg(
        F.sum("on_time").alias("on_time"),
        F.sum(F.col("n") - F.col("on_time")).alias("late"),
        F.count("*").alias("closed"),
    )
    known = checkouts.groupBy("retailer_id").agg(F.count("*").alias("loans"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return known.join(closed, "retailer_id", "left").select(
        "retailer_id",
        zero("on_time").alias("on_time"),
        zero("late").alias("late"),
        (F.col("loans") - zero("closed")).alias("open"),
    )


def cyc_duration_stats(checkouts: DataFrame, returns: DataFrame) -> DataFrame:
    hours = F.col("hours")
    return loan_hours(checkouts, returns).agg(
        whole_mean(hours).alias("avg_hours"),
        F.min(hours).alias("min_hours"),
        F.max(hours).alias("max_hours"),
    )


def _item_kinds(packaging_instances: DataFrame, packaging_catalog: DataFrame) -> DataFrame:
    return packaging_instances.join(packaging_catalog, "catalog_id").select("instance_id", "kind")


def _percentiles(counted: DataFrame, groups: list[str], ps: tuple[float, ...]) -> DataFrame:
    """Exact, interpolated, from rows (groups, hours, n) that count each whole hour once; with n."""
    found = counted.groupBy(*groups).agg(
        F.percentile("hours", F.array(*map(F.lit, ps)), F.col("n")).alias("p"),
        F.sum("n").alias("n"),
    )
    named = (F.round(F.col("p")[i], 6).alias(f"p{round(p * 100)}_h") for i, p in enumerate(ps))
    return found.select(*groups, *named, "n")


def cyc_duration_percentiles(
    checkouts: DataFrame,
    returns: DataFrame,
    packaging_instances: DataFrame,
    packaging_catalog: DataFrame,
    ps: tuple[float, ...] = (0.5, 0.9),
    ordered: bool = True,
) -> DataFrame:
    counted = (
        loan_hours(checkouts, returns)
        .join(_item_kinds(packaging_instances, packaging_catalog), "instance_id")
        .groupBy("kind", "hours")
        .agg(F.count("*").alias("n"))
    )
    out = _percentiles(counted, ["kind"], ps).drop("n")
    return out.orderBy("kind") if ordered else out


def turnaround_by_retailer(
    checkouts: DataFrame,
    returns: DataFrame,
    packaging_instances: DataFrame,
    packaging_catalog: DataFrame,
    retailers: DataFrame,
    locations: DataFrame,
    ps: tuple[float, ...] = (0.5, 0.9),
    ordered: bool = True,
) -> DataFrame:
    """Hours from checkout to return by retailer and kind of item."""
    counted = (
        loan_hours(checkouts, returns)
        .join(_item_kinds(packaging_instances, packaging_catalog), "instance_id")
        .groupBy("retailer_id", "kind", "hours")
        .agg(F.count("*").alias("n"))
        .join(retailer_names(retailers, locations), "retailer_id")
    )
    out = _percentiles(counted, ["retailer", "kind"], ps)
    return out.orderBy("retailer", "kind") if ordered else out


def cyc_return_rate(
    checkouts: DataFrame,
    retailers: DataFrame,
    locations: DataFrame,
    returns: DataFrame,
    ordered: bool = True,
) -> DataFrame:
    """Returns by checkouts; a checkout with several returns counts once per return."""
    out = (
        return_counts(checkouts, returns)
        .groupBy("retailer_id")
        .agg(
            F.sum(F.coalesce("n", F.lit(0))).alias("back"),
            F.sum(F.coalesce("n", F.lit(1))).alias("loans"),
        )
        .join(retailer_names(retailers, locations), "retailer_id")
        .groupBy("retailer")
        .agg(ratio(F.sum("back"), F.sum("loans")).alias("return_rate"))
    )
    return out.orderBy(F.desc("return_rate"), "retailer") if ordered else out


def cyc_return_status(
    checkouts: DataFrame, returns: DataFrame, ordered: bool = True
) -> DataFrame:
    labels = ["on_time", "late", "open"]
    out = (
        status_counts(checkouts, returns)
        .unpivot("retailer_id", labels, "return_status", "n")
        .groupBy("return_status")
        .agg(F.sum("n").alias("totals"))
        .filter("totals > 0")
    )
    return out.orderBy(F.desc("totals"), "return_status") if ordered else out


def ontime_by_retailer(
    checkouts: DataFrame,
    returns: DataFrame,
    retailers: DataFrame,
    locations: DataFrame,
    ordered: bool = True,
) -> DataFrame:
    """On-time, late and open loans per retailer; the rate is on-time by returned."""
    labels = ["on_time", "late", "open"]
    out = (
        status_counts(checkouts, returns)
        .join(retailer_names(retailers, locations), "retailer_id")
        .groupBy("retailer")
        .agg(*(F.sum(s).alias(s) for s in labels))
        .withColumn(
            "on_time_rate",
            ratio(F.col("on_time"), F.nullif(F.col("on_time") + F.col("late"), F.lit(0))),
        )
    )
    return out.orderBy(F.desc("on_time_rate"), "retailer") if ordered else out


def kpi_daily(checkouts: DataFrame, returns: DataFrame, ordered: bool = True) -> DataFrame:
    """Joined rows and returns per checkout day; several returns repeat their checkout."""
    out = (
        return_counts(checkouts, returns)
        .groupBy(F.to_date("checkout_time").alias("date"))
        .agg(
            F.sum(F.coalesce("n", F.lit(1))).alias("total_checkouts"),
            F.sum(F.coalesce("n", F.lit(0))).alias("total_returns"),
        )
    )
    return out.orderBy(F.desc("date")) if ordered else out


def kpi_state_rollup(packaging_instances: DataFrame) -> DataFrame:
    """Items per state, and the grand total in a row whose state is NULL."""
    return packaging_instances.rollup("state").agg(F.count("*").alias("cnt"))


def kpi_retailer_dashboard(
    checkouts: DataFrame,
    retailers: DataFrame,
    locations: DataFrame,
    returns: DataFrame,
    ordered: bool = True,
) -> DataFrame:
    """Checkouts, returns and open loans per retailer; ids are keys, so counts are distinct."""
    out = (
        return_counts(checkouts, returns)
        .groupBy("retailer_id")
        .agg(
            F.count("*").alias("checkouts"),
            F.sum(F.coalesce("n", F.lit(0))).alias("returns"),
            F.count_if(F.col("n").isNull()).alias("open_loans"),
        )
        .join(retailer_names(retailers, locations), "retailer_id")
        .groupBy("retailer")
        .agg(*(F.sum(c).alias(c) for c in ("checkouts", "returns", "open_loans")))
    )
    return out.orderBy(F.desc("checkouts"), "retailer") if ordered else out
