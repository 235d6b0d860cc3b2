"""Reports on the catalog and on single items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.functions.numfn import mean
from looptrace.functions.timefn import AsOf, clock, days_between, plus_days
from looptrace.operators.latest import latest


def pkg_catalog_summary(packaging_catalog: DataFrame, ordered: bool = True) -> DataFrame:
    out = packaging_catalog.groupBy("kind", "material").agg(
        F.count("*").alias("items"), mean(F.col("capacity_ml")).alias("avg_capacity_ml")
    )
    return out.orderBy("kind", "material") if ordered else out


def pkg_instances_by_state(packaging_instances: DataFrame, ordered: bool = True) -> DataFrame:
    out = packaging_instances.groupBy("state").agg(F.count("*").alias("instances"))
    return out.orderBy(F.desc("instances"), "state") if ordered else out


def pkg_instances_per_catalog(
    packaging_catalog: DataFrame, packaging_instances: DataFrame, ordered: bool = True
) -> DataFrame:
    """Items per SKU, 0 for a SKU without any."""
    made = packaging_instances.groupBy("catalog_id").agg(F.count("instance_id").alias("n"))
    out = (
        packaging_catalog.join(made, "catalog_id", "left")
        .groupBy("sku", "kind")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("instances"))
    )
    return out.orderBy(F.desc("instances"), "sku", "kind") if ordered else out


def pkg_last_location(movements: DataFrame) -> DataFrame:
    """The newest movement of each item."""
    moves = movements.select("instance_id", "to_loc_id", "moved_at", "mv_id")
    return latest(moves, ["instance_id"], ["moved_at", "mv_id"]).drop("mv_id")


def pkg_last_location_names(
    packaging_instances: DataFrame,
    movements: DataFrame,
    locations: DataFrame,
    ordered: bool = True,
) -> DataFrame:
    """Every item with the name of its last place, NULL when it never moved."""
    names = locations.select(
        F.col("location_id").alias("to_loc_id"), F.col("name").alias("last_location")
    )
    out = (
        packaging_instances.join(pkg_last_location(movements), "instance_id", "left")
        .join(names, "to_loc_id", "left")
        .select("instance_id", "uid_code", "last_location")
    )
    return out.orderBy("instance_id") if ordered else out


def due_date():
    return plus_days(F.col("checkout_time"), F.col("due_back_days"))


def open_overdue(checkouts: DataFrame, returns: DataFrame, as_of: AsOf) -> DataFrame:
    """Checkouts past their due date that no return links to: + due_date, days_overdue."""
    now = clock(checkouts, "checkout_time", as_of)
    back = returns.filter("checkout_id IS NOT NULL").select("checkout_id").distinct()
    return (
        checkouts.withColumn("due_date", due_date())
        .filter(F.col("due_date") < now)
        .join(back, "checkout_id", "left_anti")
        .withColumn("days_overdue", days_between(F.col("due_date"), now))
    )


def pkg_overdue(
    checkouts: DataFrame,
    packaging_instances: DataFrame,
    returns: DataFrame,
    as_of: AsOf,
    ordered: bool = True,
) -> DataFrame:
    out = open_overdue(checkouts, returns, as_of).join(
        packaging_instances.select("instance_id", "uid_code"), "instance_id"
    )
    out = out.select("checkout_id", "uid_code", "due_date", "days_overdue")
    return out.orderBy(F.desc("days_overdue"), "checkout_id") if ordered else out


def vw_checkout_enriched(
    checkouts: DataFrame,
    customers: DataFrame,
    packaging_instances: DataFrame,
    packaging_catalog: DataFrame,
    retailers: DataFrame,
    locations: DataFrame,
) -> DataFrame:
    """One wide row per checkout."""
    items = packaging_instances.select("instance_id", "catalog_id", "uid_code", "state").join(
        packaging_catalog.select("catalog_id", "kind", "material", "capacity_ml"), "catalog_id"
    )
    shops = retailers.select("retailer_id", "location_id").join(
        locations.select("location_id", F.col("name").alias("retailer_name")), "location_id"
    )
    buyers = customers.select("customer_id", F.col("name").alias("customer_name"))
    return (
        checkouts.join(shops, "retailer_id")
        .join(items, "instance_id")
        .join(buyers, "customer_id")
        .select(
            "checkout_id", "checkout_time", "due_back_days",
            "customer_id", "customer_name",
            "instance_id", "uid_code", "state",
            "kind", "material", "capacity_ml",
            F.col("location_id").alias("retailer_location_id"), "retailer_name",
        )
    )
