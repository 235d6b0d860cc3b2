"""One named query per report, check, operator and stream, over a folder of test files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from looptrace.operators import increments, quality
from looptrace.operators.anonymize import anonymize, generalize
from looptrace.operators.knn import knn_places
from looptrace.operators.refdelete import apply_delete, ref_delete
from looptrace.plans import audit, customers, cycles, exposure, incidents, movements, packaging
from looptrace.plans import places, rollups, sensors, trace, washing
from looptrace.schemas import TABLES
from looptrace.session import scratch_dir
from looptrace.sources.commits import append_batch, read_days
from looptrace.sources.fixtures import (
    JSON_PATH, LOANS_AS_OF, POINT, RAW_CHECKOUTS, RAW_LEDGER, RAW_PLACES, RAW_READINGS,
    TELEMETRY_AS_OF, Loop,
)
from looptrace.sources.ingest import read_raw, rejected_rows, typed_rows, with_defaults
from looptrace.streaming.feeds import run_to_files
from looptrace.streaming.loans import st_overdue
from looptrace.streaming.telemetry import (
    latest_of_feed, latest_running, st_latest_reading, st_temp_breaches,
)

Query = Callable[[SparkSession, str], DataFrame]

SALT = "pepper"  # fixed value: the checks hash with the same one
KNN_K, KNN_KM = 3, 2.0


# The ranges of days that the reports from sketches are asked for.
READ_DAYS = ("2024-01-05", "2024-01-20")
LOAN_DAYS = ("1994-01-01", "1996-12-31")


def _rolled_up(t: Loop, rollup: DataFrame, schema: str) -> DataFrame:
    """A rollup as it lies in its folders by day."""
    path = scratch_dir(t.spark, "rollup")
    rollups.write_rollup(rollup, path)
    return rollups.read_rollup(t.spark, path, schema)


def _by_batches(t: Loop) -> DataFrame:
    """Movements that came in three batches of all days, one of them twice."""
    path = scratch_dir(t.spark, "batches")
    for batch in (2, 0, 2, 1):
        rows = t.movements.filter(F.col("mv_id") % 3 == batch)
        append_batch(t.spark, path, "movements", rows, f"batch {batch}")
    return read_days(t.spark, path, "movements")


def _loops(t: Loop) -> DataFrame:
    return trace.loop_conformance(
        t.packaging_instances, t.checkouts, t.returns, t.inspections, t.wash_cycles)


def _reports() -> dict[str, Callable[[Loop], DataFrame]]:
    now, then = TELEMETRY_AS_OF, LOANS_AS_OF
    lat, lng = POINT
    return {
        # places
        "loc_counts_by_kind": lambda t: places.loc_counts_by_kind(t.locations),
        "loc_retailer_directory": lambda t: places.loc_retailer_directory(
            t.retailers, t.locations),
        "loc_hub_directory": lambda t: places.loc_hub_directory(t.hubs, t.locations),
        "loc_nearby_bbox": lambda t: places.loc_nearby_bbox(t.locations, lat, lng),
        "loc_nearest_places": lambda t: places.loc_nearest_places(
            t.locations, t.retailers, lat, lng),
        # customers
        "cus_recent": lambda t: customers.cus_recent(t.customers, now),
        "cus_without_checkouts": lambda t: customers.cus_without_checkouts(
            t.customers, t.checkouts),
        "cus_deposit_balances": lambda t: customers.cus_deposit_balances(
            t.customers, t.deposit_accounts),
        "cus_running_balance": lambda t: customers.cus_running_balance(
            t.deposit_accounts, t.customers, t.deposit_transactions),
        "cus_top_debits": lambda t: customers.cus_top_debits(
            t.customers, t.deposit_accounts, t.deposit_transactions),
        # packaging
        "pkg_catalog_summary": lambda t: packaging.pkg_catalog_summary(t.packaging_catalog),
        "pkg_instances_by_state": lambda t: packaging.pkg_instances_by_state(
            t.packaging_instances),
        "pkg_instances_per_catalog": lambda t: packaging.pkg_instances_per_catalog(
            t.packaging_catalog, t.packaging_instances),
        "pkg_last_location": lambda t: packaging.pkg_last_location(t.movements),
        "pkg_last_location_names": lambda t: packaging.pkg_last_location_names(
            t.packaging_instances, t.movements, t.locations),
        "pkg_overdue": lambda t: packaging.pkg_overdue(
            t.checkouts, t.packaging_instances, t.returns, then),
        # cycles
        "cyc_duration_stats": lambda t: cycles.cyc_duration_stats(t.checkouts, t.returns),
        "cyc_duration_percentiles": lambda t: cycles.cyc_duration_percentiles(
            t.checkouts, t.returns, t.packaging_instances, t.packaging_catalog),
        "cyc_return_rate": lambda t: cycles.cyc_return_rate(
            t.checkouts, t.retailers, t.locations, t.returns),
        "cyc_return_status": lambda t: cycles.cyc_return_status(t.checkouts, t.returns),
        # washing
        "wsh_cycle_stats": lambda t: washing.wsh_cycle_stats(t.wash_cycles),
        "wsh_pass_rate_by_hub": lambda t: washing.wsh_pass_rate_by_hub(
            t.inspections, t.wash_cycles, t.hubs, t.locations),
        "wsh_latest_failures": lambda t: washing.wsh_latest_failures(t.inspections),
        # incidents
        "inc_recent_by_kind_severity": lambda t: incidents.inc_recent_by_kind_severity(
            t.contamination_incidents, now),
        "inc_repeat_instances": lambda t: incidents.inc_repeat_instances(
            t.contamination_incidents),
        # sensors
        "sen_latest_reading": lambda t: sensors.sen_latest_reading(t.sensor_readings),
        "sen_temp_breaches": lambda t: sensors.sen_temp_breaches(t.sensor_readings, now),
        "sen_daily_pivot": lambda t: sensors.sen_daily_pivot(t.sensor_readings, now),
        "sen_percentiles_range": lambda t: rollups.sensor_percentiles(
            _rolled_up(t, rollups.sensor_rollup(t.sensor_readings), rollups.SENSOR_ROLLUP),
            *READ_DAYS),
        # movements
        "mov_scan": lambda t: movements.mov_scan(t.movements),
        "mov_flow_matrix": lambda t: movements.mov_flow_matrix(t.movements, t.locations),
        "mov_dwell": lambda t: movements.mov_dwell(t.movements, t.locations),
        # audit
        "aud_event_counts": lambda t: audit.aud_event_counts(t.audit_logs),
        "aud_latest": lambda t: audit.aud_latest(t.audit_logs, "instance"),
        "aud_notes_json": lambda t: audit.aud_notes_json(t.audit_logs, JSON_PATH),
        # key figures and views
        "kpi_daily": lambda t: cycles.kpi_daily(t.checkouts, t.returns),
        "kpi_state_rollup": lambda t: cycles.kpi_state_rollup(t.packaging_instances),
        "kpi_retailer_dashboard": lambda t: cycles.kpi_retailer_dashboard(
            t.checkouts, t.retailers, t.locations, t.returns),
        "kpi_dashboard_range": lambda t: rollups.dashboard_in_days(
            _rolled_up(t, rollups.loan_rollup(t.checkouts, t.returns), rollups.LOAN_ROLLUP),
            t.retailers, t.locations, *LOAN_DAYS),
        "vw_checkout_enriched": lambda t: packaging.vw_checkout_enriched(
            t.checkouts, t.customers, t.packaging_instances, t.packaging_catalog,
            t.retailers, t.locations),
        "vw_customer_balances": lambda t: customers.vw_customer_balances(
            t.customers, t.deposit_accounts, t.deposit_transactions),
        # tracing
        "instance_timeline": lambda t: trace.instance_timeline(
            t.packaging_instances, t.checkouts, t.retailers, t.returns, t.inspections,
            t.wash_cycles, t.hubs, t.contamination_incidents, t.movements),
        "turnaround_by_retailer": lambda t: cycles.turnaround_by_retailer(
            t.checkouts, t.returns, t.packaging_instances, t.packaging_catalog,
            t.retailers, t.locations),
        "ontime_by_retailer": lambda t: cycles.ontime_by_retailer(
            t.checkouts, t.returns, t.retailers, t.locations),
        "dwell_current": lambda t: movements.dwell_current(t.movements, t.locations, now),
        "loss_hotspots": lambda t: trace.loss_hotspots(
            t.packaging_instances, t.movements, t.checkouts, t.returns,
            t.contamination_incidents, t.locations, then),
        "match_returns": lambda t: trace.match_returns(t.checkouts, t.returns),
        "match_returns_nested": lambda t: trace.match_returns_nested(t.checkouts, t.returns),
        "loop_conformance": _loops,
        "loop_breaks": lambda t: trace.loop_breaks(_loops(t)),
        "alerts": lambda t: trace.alerts(
            t.checkouts, t.returns, t.sensor_readings, t.inspections,
            t.contamination_incidents, now),
        "exposed_items": lambda t: exposure.exposed_items(
            t.movements, t.contamination_incidents, now),
        "knn_places": lambda t: knn_places(
            t.locations.filter("kind <> 'retailer'").select(
                F.col("location_id").alias("point_id"), "lat", "lng"),
            t.retailers.join(t.locations, "location_id"),
            KNN_K, KNN_KM),
        "anonymized_export": lambda t: anonymize("checkouts", t.checkouts, SALT, unit="quarter"),
        "anonymized_export_customers": lambda t: anonymize("customers", t.customers, SALT),
        "anonymized_export_returns": lambda t: anonymize(
            "returns", t.returns, SALT, k=3, unit="year"),
        # deletes
        "ref_delete": lambda t: ref_delete(
            t, "customers",
            customers.cus_without_checkouts(t.customers, t.checkouts).select("customer_id")),
        "ref_delete_blocked": lambda t: ref_delete(
            t, "customers",
            t.deposit_accounts.filter("balance_cents < 0").select("customer_id")),
        "ref_delete_inspections": lambda t: apply_delete(
            t, "wash_cycles",
            t.wash_cycles.filter("end_time IS NULL").select("wash_id"))["inspections"],
        # loading
        "ing_typed_load": lambda t: typed_rows(t.query(RAW_READINGS), "sensor_readings"),
        "ing_typed_load_rejects": lambda t: rejected_rows(
            t.query(RAW_READINGS), "sensor_readings"),
        "ing_defaults": lambda t: with_defaults(
            t.packaging_instances.drop("state", "birthed_at"), "packaging_instances", now),
    }


def _increment(t: Loop) -> DataFrame:
    """What the newest seventh of the rows violates, by the index of the others."""
    path = scratch_dir(t.spark, "index")
    new = {name: F.coalesce(F.col(TABLES[name].key) % 7 == 0, F.lit(True)) for name in TABLES}
    old = {n: t[n].filter(~is_new) for n, is_new in new.items()}
    increments.create_index(t.spark, path, old, buckets=16)
    return increments.check_increment(
        t.spark, path, {n: t[n].filter(is_new) for n, is_new in new.items()})


def _checks() -> dict[str, Callable[[Loop], DataFrame]]:
    return {
        "dq_not_null": lambda t: quality.dq_not_null(t),
        "dq_primary_key": lambda t: quality.dq_primary_key(t),
        "dq_unique": lambda t: quality.dq_unique(t),
        "dq_check": lambda t: quality.dq_check(t),
        "dq_foreign_key": lambda t: quality.dq_foreign_key(t),
        "dq_increment": _increment,
        "dq_role_kind": lambda t: quality.dq_role_kind(t),
        "dq_temporal": lambda t: quality.dq_temporal(t),
    }


def _streams() -> dict[str, Callable[[Loop], DataFrame]]:
    def run(t: Loop, stream: DataFrame, name: str) -> DataFrame:
        return run_to_files(t.spark, stream, name)

    return {
        "st_temp_breaches": lambda t: run(
            t, st_temp_breaches(t.sensor_readings), "st_temp_breaches"),
        "st_latest_reading": lambda t: latest_of_feed(
            run(t, st_latest_reading(t.sensor_readings), "st_latest_reading")),
        "st_latest_running": lambda t: latest_running(
            run(t, st_latest_reading(t.sensor_readings), "st_latest_running"),
            Loop(t.spark, t.folder, prepared=t.prepared).sensor_readings),
        "st_overdue": lambda t: run(t, st_overdue(t.checkouts, t.returns), "st_overdue"),
    }


def _raw_file(t: Loop, table: str, lines: str, columns: str | None = None) -> DataFrame:
    """A raw file of given lines, written to the shared folder and read again as text: csv if
    ``columns`` names its header, else json."""
    path = scratch_dir(t.spark, "raw")
    rows = t.query(lines, table)
    if columns:
        # the header line stands at the top of every part; this separator is in no line
        rows = rows.withColumnRenamed("line", columns)
        rows.write.option("header", True).option("sep", "\x01").csv(path)
        return read_raw(t.spark, path, table, "csv")
    rows.write.text(path)
    return read_raw(t.spark, path, table, "json")


def _loads() -> dict[str, Callable[[Loop], DataFrame]]:
    def ledger(t: Loop) -> DataFrame:
        columns = "tx_id,account_id,delta_cents,reason,ref_table,ref_id,created_at"
        return _raw_file(t, "deposit_transactions", RAW_LEDGER, columns)

    def loans(t: Loop) -> DataFrame:
        return _raw_file(t, "checkouts", RAW_CHECKOUTS)

    return {
        "ing_csv_locations": lambda t: with_defaults(
            typed_rows(
                _raw_file(t, "locations", RAW_PLACES, "location_id,name,kind,lat"), "locations"),
            "locations", LOANS_AS_OF),
        "ing_csv_ledger": lambda t: typed_rows(ledger(t), "deposit_transactions"),
        "ing_csv_ledger_rejects": lambda t: rejected_rows(ledger(t), "deposit_transactions"),
        "sink_batches": _by_batches,
        "ing_json_checkouts": lambda t: typed_rows(loans(t), "checkouts"),
        "ing_json_checkouts_rejects": lambda t: rejected_rows(loans(t), "checkouts"),
    }


def _exports() -> dict[str, Callable[[Loop], DataFrame]]:
    """All tables by month in groups of five or more: without the rows of smaller groups, where no
    named export does that, and with all rows in ranges."""
    named = ("checkouts", "customers", "returns")
    coarse = {
        f"anonymized_export_{name}": lambda t, name=name: anonymize(
            name, t[name], SALT, unit="month")
        for name in TABLES
        if name not in named
    }
    return coarse | {
        f"generalized_export_{name}": lambda t, name=name: generalize(
            name, t[name], SALT, unit="month")
        for name in TABLES
    }


def _bind(build: Callable[[Loop], DataFrame], **options) -> Query:
    return lambda spark, folder: build(Loop(spark, folder, **options))


def queries(prepared: str | None = None) -> dict[str, Query]:
    """Every query over a folder of given files; with ``prepared``, over the tables there."""
    plain = _reports() | _loads() | _exports()
    named = {name: _bind(build, prepared=prepared) for name, build in plain.items()}
    named |= {
        name: _bind(build, dirty=True, prepared=prepared) for name, build in _checks().items()
    }
    named |= {
        name: _bind(build, streamed=("events", "orders"), prepared=prepared)
        for name, build in _streams().items()
    }
    return named
