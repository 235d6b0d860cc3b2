"""What the plans must and must not contain, with joins planned as for large tables."""

from __future__ import annotations

import re

import pytest

from looptrace.registry import queries as registered
from looptrace.plans import customers, cycles, incidents, packaging, places, sensors, trace
from looptrace.sources.files import read_log, read_table, write_log, write_table

FOLDER = "/root/testdata/sf0.001"
QUERIES = registered.queries()
BATCH = [name for name in QUERIES if not name.startswith("st_")]


@pytest.fixture
def large(spark):
    """No table counts as small enough to broadcast by itself."""
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for key in keys:
        spark.conf.set(key, "-1")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield spark
    for key in keys:
        spark.conf.unset(key)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_cross_join_and_no_window_over_everything(large, name):
    text = plan(QUERIES[name](large, FOLDER))
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    for window in re.findall(r"Window \[.*", text):
        assert not window.rstrip().endswith("[]") and "specification(ORDER" not in window
        assert re.search(r"windowspecdefinition\(\w+#", window), window
    # an exchange to one partition is a global aggregate or a top k
    for line in re.findall(r"Exchange SinglePartition.*", text):
        assert name in {"cyc_duration_stats", "wsh_cycle_stats"}, line


def stored(spark, table, tmp_path, name, *rows):
    path = str(tmp_path / name)
    write_table(table(name, *rows), path)
    return read_table(spark, path, name)


def test_anti_joins(large, table):
    text = plan(customers.cus_without_checkouts(table("customers"), table("checkouts")))
    assert "LeftAnti" in text
    args = table("checkouts"), table("packaging_instances"), table("returns")
    assert "LeftAnti" in plan(packaging.pkg_overdue(*args, as_of="2025-01-01"))


def test_best_rows_are_kept_before_the_shuffle(large, table):
    text = plan(packaging.pkg_last_location(table("movements")))
    assert re.search(r"WindowGroupLimit.*Final.*Exchange hashpartitioning.*WindowGroupLimit.*Partial",
                     text, re.S)


def test_slices_are_read_from_the_shared_folder(large, table):
    text = plan(trace.match_returns(table("checkouts"), table("returns")))
    assert text.count("Exchange hashpartitioning(instance_id") <= 3
    assert set(re.findall(r"Scan (\w+)", text)) == {"parquet"}
    assert text.count("BroadcastExchange") == 1  # the rows carried over slice borders


def test_each_log_is_read_once_for_loans(large, table):
    text = plan(cycles.cyc_return_status(table("checkouts"), table("returns"), ordered=False))
    assert text.count("LeftAnti") == 0 and text.count("SortMergeJoin") == 2


def test_percentiles_aggregate_counts(large, table):
    text = plan(cycles.cyc_duration_percentiles(
        table("checkouts"), table("returns"), table("packaging_instances"),
        table("packaging_catalog"), ordered=False))
    assert re.search(r"percentile\(hours#\d+L?, \[0.5,0.9\], n#", text)


def test_foreign_keys_meet_the_rows_by_orphan_value(large):
    text = plan(QUERIES["dq_foreign_key"](large, FOLDER))
    assert text.count("LeftAnti") == 1


def test_top_k(large, table):
    df = places.loc_nearest_places(table("locations"), table("retailers"), 41.4, 2.1)
    assert "TakeOrderedAndProject" in plan(df)


def test_old_days_are_not_read(large, table, tmp_path):
    logs = {
        "sensor_readings": (1, 7, 1, "temperature", 36, "2025-01-01"),
        "contamination_incidents": (1, 7, "microbial", 4, None, "2025-01-01"),
    }
    read = {}
    for name, row in logs.items():
        write_log(table(name, row), str(tmp_path / name), name)
        read[name] = read_log(large, str(tmp_path / name), name)
    readings, found = read["sensor_readings"], read["contamination_incidents"]
    loans, inspections = (table("checkouts"), table("returns")), table("inspections")
    for df in (sensors.sen_temp_breaches(readings, "2025-01-02"),
               sensors.sen_daily_pivot(readings, "2025-01-02"),
               incidents.inc_recent_by_kind_severity(found, "2025-01-02"),
               trace.alerts(*loans, readings, inspections, found, "2025-01-02")):
        assert re.search(r"PartitionFilters: \[isnotnull\(event_date#\d+\), \(event_date#\d+ >= ",
                         plan(df))


def test_filters_and_columns_reach_the_files(large, table, tmp_path):
    log = stored(large, table, tmp_path, "sensor_readings",
                 (1, 7, 1, "temperature", 36, "2025-01-01"))
    text = plan(sensors.sen_temp_breaches(log, "2025-01-01"))
    pushed = re.search(r"PushedFilters: \[(.*?)\], ReadSchema", text).group(1)
    for part in ("EqualTo(sensor_type,temperature)", "GreaterThan(value,35",
                 "GreaterThanOrEqual(measured_at,2024-12-31"):
        assert part in pushed
    assert "reading_id" not in text and "location_id" not in text
    spots = stored(large, table, tmp_path, "locations", (1, "a", "hub", None, 41.4, 2.1))
    text = plan(places.loc_nearby_bbox(spots, 41.4, 2.1))
    assert "GreaterThanOrEqual(lat,41.35" in text and "LessThanOrEqual(lng,2.16" in text
