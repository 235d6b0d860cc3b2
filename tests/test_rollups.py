"""Sketches per day against the exact figures, small ranges exactly and large ones within their bounds."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from looptrace.plans import rollups


@pytest.fixture(scope="module")
def readings(spark):
    """200,000 skewed readings of 30 days, two thirds of them of one type."""
    return spark.range(200_000).selectExpr(
        "id AS reading_id", "id AS instance_id", "id AS location_id",
        "IF(id % 3 < 2, 'temperature', IF(id % 2 = 0, 'humidity', 'shock')) AS sensor_type",
        "CAST(pow(pmod(hash(id), 100003) / 100003D, 4) * 1000 AS DECIMAL(10,3)) AS value",
        "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(id % 30 AS INT)) AS measured_at")


@pytest.mark.parametrize("since, until", [(None, None), ("2024-01-03", "2024-01-19"), ("2024-01-30", None)])
def test_ranks_of_percentiles_are_within_the_bound(readings, since, until):
    found = rollups.sensor_percentiles(rollups.sensor_rollup(readings), since, until, (0.01, 0.5, 0.9, 0.999))
    days = rollups.in_days(readings.withColumn("day", F.to_date("measured_at")), since, until)
    for r in found.collect():
        own = days.filter(F.col("sensor_type") == r.sensor_type)
        n = own.count()
        assert r.readings == n
        for p, value in ((0.01, r.p1), (0.5, r.p50), (0.9, r.p90), (0.999, r.p100)):
            low, high = own.agg(F.count_if(F.col("value").cast("double") < value) / n,
                                F.count_if(F.col("value").cast("double") <= value) / n).first()
            assert low - 0.0015 <= p <= high + 0.0015


def test_any_split_into_days_gives_the_same_small_range(readings):
    few = readings.filter("reading_id < 3000")
    whole = rollups.sensor_rollup(few.withColumn("measured_at", F.lit("2024-01-01").cast("timestamp")))
    ps = (0.1, 0.5, 0.9)
    assert sorted(rollups.sensor_percentiles(rollups.sensor_rollup(few), ps=ps).collect()) == sorted(
        rollups.sensor_percentiles(whole, ps=ps).collect())


def test_nulls_empty_ranges_and_empty_logs(readings, table):
    none = readings.withColumn("value", F.lit(None).cast("decimal(10,3)"))
    assert rollups.sensor_percentiles(rollups.sensor_rollup(none)).collect() == []
    assert rollups.sensor_percentiles(rollups.sensor_rollup(readings), "2030-01-01").collect() == []
    assert rollups.loans_in_days(rollups.loan_rollup(table("checkouts"), table("returns"))).collect() == []


def test_only_months_of_the_range_are_read(spark, readings, tmp_path):
    path = str(tmp_path / "rollup")
    later = readings.withColumn("measured_at", F.expr("measured_at + INTERVAL 45 DAYS"))
    rollups.write_rollup(rollups.sensor_rollup(readings.union(later)), path)
    stored = rollups.read_rollup(spark, path, rollups.SENSOR_ROLLUP)
    asked = rollups.sensor_percentiles(stored, "2024-01-05", "2024-01-06")
    assert len(asked.collect()) == 2  # the days have no other type
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(month" in plan and "PushedFilters: [IsNotNull(day)" in plan
    scanned = asked._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert len(stored.inputFiles()) == 3 and "month" in scanned.toString()
    assert max(len(bytes(r.sketch)) for r in stored.collect()) < 200_000


def test_loans_of_many_ids_are_within_the_bound(spark):
    loans = spark.range(120_000).selectExpr(
        "id AS checkout_id", "id AS instance_id", "IF(id % 3 = 0, id % 5, 7) AS retailer_id", "1L AS customer_id",
        "TIMESTAMP '2024-01-01 00:00:00' + make_dt_interval(CAST(id % 60 AS INT)) AS checkout_time",
        "7 AS due_back_days")
    backs = loans.filter("checkout_id % 10 < 6").selectExpr(
        "checkout_id AS return_id", "instance_id", "customer_id", "1L AS location_id",
        "checkout_time + make_dt_interval(20) AS return_time", "checkout_id")
    rollup = rollups.loan_rollup(loans, backs)
    got = {r.retailer_id: r for r in rollups.loans_in_days(rollup, "2024-01-11", "2024-02-09").collect()}
    exact = loans.filter("date(checkout_time) BETWEEN '2024-01-11' AND '2024-02-09'").withColumn(
        "back", F.expr("checkout_id % 10 < 6 AND date(checkout_time) + 20 <= date'2024-02-09'"))
    for r in exact.groupBy("retailer_id").agg(
            F.count("*").alias("n"), F.count_if("back").alias("back")).collect():
        own = got.pop(r.retailer_id)
        for value, true in ((own.checkouts, r.n), (own.returned, r.back), (own.open_loans, r.n - r.back)):
            assert abs(value - true) <= 4 * r.n / 64
    assert got == {}


def test_a_return_counts_once_and_later_ones_not_yet(table):
    loans = [(1, 1, 5, 1, "2024-01-01", 7), (2, 1, 5, 1, "2024-01-02", 7), (3, 1, 5, 1, "2024-02-01", 7)]
    backs = [(1, 1, 1, 1, "2024-01-03", 1), (2, 1, 1, 1, "2024-01-04", 1), (3, 1, 1, 1, "2024-03-01", 2),
             (4, 1, 1, 1, "2024-01-05", None)]
    rollup = rollups.loan_rollup(table("checkouts", *loans), table("returns", *backs))
    row = lambda *days: [tuple(r) for r in rollups.loans_in_days(rollup, *days).collect()]
    assert row(None, "2024-01-31") == [(5, 2, 1, 1)]
    assert row("2024-01-01", "2024-03-31") == [(5, 3, 2, 1)]
    assert row("2024-01-02", "2024-01-31") == [(5, 1, 0, 1)]
    assert row("2025-01-01", None) == []
