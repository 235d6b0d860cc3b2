"""Rules of the single reports, on rows made for them."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from looptrace.functions import geofn, jsonfn, timefn
from looptrace.plans import audit, customers, cycles, incidents, movements, packaging, places
from looptrace.plans import sensors, trace, washing
from pyspark.sql import functions as F

from .conftest import at, tuples

AS_OF = "2025-03-31 12:00:00"


def test_differences_count_boundaries(spark):
    df = spark.createDataFrame(
        [(at("2025-01-01 00:59"), at("2025-01-01 01:01")),
         (at("2025-01-02 00:00"), at("2025-01-01 23:59:59")),
         (at("1969-12-31 22:30"), at("1970-01-01 00:30"))], "a timestamp, b timestamp")
    a, b = F.col("a"), F.col("b")
    got = tuples(df.select(timefn.hours_between(a, b), timefn.minutes_between(a, b),
                           timefn.days_between(a, b)))
    assert got == [(1, 2, 0), (-1, -1, -1), (2, 120, 1)]


def test_differences_ignore_the_session_zone(spark):
    spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
    try:
        row = spark.sql("SELECT TIMESTAMP '2025-01-01 00:40:00Z' a, TIMESTAMP '2025-01-01 01:10:00Z' b")
        assert tuples(row.select(timefn.hours_between(F.col("a"), F.col("b")))) == [(1,)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_since_is_inclusive_and_open_ended(table):
    people = table(
        "customers",
        (1, "a", None, None, "2025-03-01 12:00:00"),
        (2, "b", None, None, "2025-03-01 11:59:59"),
        (3, "c", None, None, "2026-01-01"),
    )
    assert tuples(customers.cus_recent(people, AS_OF), "customer_id") == [(3,), (1,)]


def test_strict_json(spark):
    texts = ['{"note":"x"}', "[1]", "7", '"s"', "null", '{"note":1} x', "{bad", "", None,
             ' {"note":{"a":1}}', '{"note":[1]}', '{"note":null}', '{"a":1},{"b":2}', '{"note":15}']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = tuples(df.orderBy("i").select(jsonfn.is_json_container(F.col("t")),
                                        jsonfn.json_scalar(F.col("t"), "$.note")))
    assert [g[0] for g in got] == [True, True, False, False, False, False, False, False, False,
                                   True, True, True, False, True]
    assert [g[1] for g in got] == ["x"] + [None] * 12 + ["15"]


def test_distance_of_equal_and_opposite_points(spark):
    df = spark.createDataFrame([(41.385, 2.17, 41.385, 2.17), (0.0, 0.0, 0.0, 180.0)],
                               "a double, b double, c double, d double")
    for formula in (geofn.arc_km, geofn.haversine_km):
        got = tuples(df.select(formula(*(F.col(c) for c in "abcd"))))
        assert abs(got[0][0]) < 1e-3 and abs(got[1][0] - 20015.0868) < 1e-3


def test_places(table):
    spots = table(
        "locations",
        (1, "B", "retailer", None, 41.385, 2.17),
        (2, "A", "retailer", None, 41.435, 2.23),
        (3, "C", "hub", None, 41.435001, 2.17),
        (4, "D", "retailer", None, None, None),
        (5, "E", "retailer", None, 41.386, 2.17),
    )
    shops = table("retailers", (10, 1, None), (20, 2, None), (40, 4, None), (50, 5, None))
    assert tuples(places.loc_counts_by_kind(spots)) == [("retailer", 4), ("hub", 1)]
    assert tuples(places.loc_nearby_bbox(spots, 41.385, 2.17), "location_id") == [(2,), (1,), (5,)]
    near = places.loc_nearest_places(spots, shops, 41.385, 2.17, k=2)
    assert tuples(near, "location_id") == [(1,), (5,)]
    assert tuples(places.loc_nearest_places(spots, shops, 41.385, 2.17, max_km=0.05),
                  "location_id") == [(1,)]
    assert tuples(places.loc_retailer_directory(shops, spots), "retailer_id") == [
        (10,), (20,), (40,), (50,)]


def test_ledger(table):
    people = table("customers", (1, "a", None, None, AS_OF), (2, "b", None, None, AS_OF),
                   (3, "c", None, None, AS_OF))
    accounts = table("deposit_accounts", (11, 1, 500), (12, 2, 700))
    ledger = table(
        "deposit_transactions",
        (3, 11, -50, "penalty", None, None, "2025-01-01"),
        (2, 11, 200, "penalty", None, None, "2025-01-01"),
        (1, 11, -70, "hold", None, None, "2025-01-02"),
        (4, 99, -900, "hold", None, None, "2025-01-02"),
    )
    assert tuples(customers.cus_running_balance(accounts, people, ledger),
                  "customer_id", "delta_cents", "running_balance_cents") == [
        (1, 200, 200), (1, -50, 150), (1, -70, 80)]
    assert tuples(customers.cus_top_debits(people, accounts, ledger)) == [(1, "a", 120)]
    assert sorted(tuples(customers.vw_customer_balances(people, accounts, ledger))) == [
        (1, "a", 500, 80), (2, "b", 700, 0), (3, "c", None, 0)]
    assert tuples(customers.cus_deposit_balances(people, accounts), "customer_id") == [
        (2,), (1,), (3,)]


def loans(table):
    """One retailer; loans on time, late, returned early, twice, unlinked and open."""
    return dict(
        checkouts=table(
            "checkouts",
            (1, 100, 10, 1, "2025-01-01 10:30:00", 7),
            (2, 101, 10, 1, "2025-01-01 10:00:00", 7),
            (3, 102, 10, 1, "2025-01-02 10:00:00", 7),
            (4, 103, 10, 1, "2025-01-02 10:00:00", 7),
            (5, 104, 10, 1, "2025-03-24 12:00:00", 7),
        ),
        returns=table(
            "returns",
            (1, 100, 1, 1, "2025-01-08 10:30:00", 1),
            (2, 101, 1, 1, "2025-01-08 10:00:01", 2),
            (3, 102, 1, 1, "2025-01-01 09:59:00", 3),
            (4, 102, 1, 1, "2025-01-20 10:00:00", 3),
            (5, 103, None, 1, "2025-01-03 10:00:00", None),
        ),
    )


def shops(table):
    return dict(
        retailers=table("retailers", (10, 1, None)),
        locations=table("locations", (1, "Shop", "retailer", None, None, None)),
    )


def test_loans(table):
    log = loans(table)
    named = dict(log, **shops(table))
    assert tuples(cycles.cyc_duration_stats(**log)) == [(185, -25, 432)]
    assert tuples(cycles.cyc_return_status(**log)) == [("late", 2), ("on_time", 2), ("open", 2)]
    assert tuples(cycles.cyc_return_rate(**named)) == [("Shop", round(4 / 6, 6))]
    assert tuples(cycles.ontime_by_retailer(**named)) == [("Shop", 2, 2, 2, 0.5)]
    assert tuples(cycles.kpi_daily(**log)) == [
        (date(2025, 3, 24), 1, 0), (date(2025, 1, 2), 3, 2), (date(2025, 1, 1), 2, 2)]
    assert tuples(cycles.kpi_retailer_dashboard(**named)) == [("Shop", 5, 4, 2)]


def test_no_loans(table):
    empty = dict(checkouts=table("checkouts"), returns=table("returns"))
    assert tuples(cycles.cyc_duration_stats(**empty)) == [(None, None, None)]
    assert tuples(cycles.cyc_return_status(**empty)) == []


def test_percentiles_interpolate(table):
    kinds = dict(
        packaging_instances=table(
            "packaging_instances", *((i, 7, f"u{i}", "lost", AS_OF, None) for i in range(100, 104))),
        packaging_catalog=table("packaging_catalog", (7, None, "cup", "pp", None, 100)),
    )
    got = tuples(cycles.cyc_duration_percentiles(**loans(table), **kinds))
    assert got == [("cup", 168.0, 352.8)]
    turn = tuples(cycles.turnaround_by_retailer(**loans(table), **kinds, **shops(table)))
    assert turn == [("Shop", "cup", 168.0, 352.8, 4)]


def test_overdue(table):
    items = table("packaging_instances", *((i, 7, f"u{i}", "lost", AS_OF, None)
                                           for i in range(100, 105)))
    got = packaging.pkg_overdue(packaging_instances=items, as_of=AS_OF, **loans(table))
    # the loan that falls due this very moment is not overdue; the unlinked return counts for none
    assert tuples(got) == [(4, "u103", datetime(2025, 1, 9, 10), 81)]


def test_items(table):
    catalog = table("packaging_catalog", (1, "s1", "cup", "pp", 100, 5), (2, "s2", "cup", "pp", None, 5),
                    (3, "s3", "jar", "glass", None, 5))
    items = table("packaging_instances", (1, 1, "u1", "lost", AS_OF, None),
                  (2, 1, "u2", "in_use", AS_OF, None), (3, 2, "u3", "lost", AS_OF, None))
    assert tuples(packaging.pkg_catalog_summary(catalog)) == [
        ("cup", "pp", 2, 100.0), ("jar", "glass", 1, None)]
    assert tuples(packaging.pkg_instances_per_catalog(catalog, items)) == [
        ("s1", "cup", 2), ("s2", "cup", 1), ("s3", "jar", 0)]
    rolled = dict(tuples(cycles.kpi_state_rollup(items)))
    assert rolled == {None: 3, "lost": 2, "in_use": 1}


def moves(table):
    return dict(
        movements=table(
            "movements",
            (1, 100, None, 1, "2025-03-01 10:50:00", None),
            (3, 100, 1, 9, "2025-03-02 00:10:00", None),
            (2, 100, 1, 2, "2025-03-02 00:10:00", None),
            (4, 101, 1, 1, "2025-03-05 00:00:00", None),
        ),
        locations=table("locations", (1, "A", "hub", None, None, None),
                        (2, "B", "retailer", None, None, None)),
    )


def test_movements(table):
    log = moves(table)
    items = table("packaging_instances", (100, 1, "u", "lost", AS_OF, None),
                  (101, 1, "v", "lost", AS_OF, None), (102, 1, "w", "lost", AS_OF, None))
    # equal times go by the higher id; place 9 is unknown
    assert sorted(tuples(packaging.pkg_last_location(log["movements"]))) == [
        (100, 9, at("2025-03-02 00:10")), (101, 1, at("2025-03-05"))]
    assert tuples(packaging.pkg_last_location_names(items, **log)) == [
        (100, "u", None), (101, "v", "A"), (102, "w", None)]
    assert tuples(movements.mov_dwell(**log)) == [(100, None, 0), (101, "A", None)]
    assert tuples(movements.dwell_current(as_of="2025-03-05 01:00:00", **log)) == [
        (100, None, 73), (101, "A", 1)]
    assert set(tuples(movements.mov_flow_matrix(**log))) == {
        (None, "hub", 1), ("hub", None, 1), ("hub", "retailer", 1), ("hub", "hub", 1)}


def test_washing(table):
    washes = table(
        "wash_cycles",
        (1, 5, "b", "2025-01-01 00:00:30", "2025-01-01 00:02:00", 60.5, None),
        (2, 5, "b", "2025-01-01 00:00:00", "2025-01-01 00:05:00", None, None),
        (3, 6, "b", "2025-01-01 00:00:00", None, 61.0, None),
    )
    assert tuples(washing.wsh_cycle_stats(washes)) == [(3, 3, 60.75)]
    checks = table(
        "inspections",
        (1, 100, 1, None, "fail", "x", "2025-01-02"),
        (2, 100, 2, None, "pass", None, "2025-01-02"),
        (3, 101, None, None, "pass", None, "2025-01-02"),
        (4, 101, 3, None, "fail", "y", "2025-01-03"),
        (5, 102, None, None, "fail", "z", "2025-01-01"),
    )
    hubs = table("hubs", (5, 1, None))
    named = table("locations", (1, "Hub", "hub", None, None, None))
    assert set(tuples(washing.wsh_pass_rate_by_hub(checks, washes, hubs, named))) == {
        ("Hub", 0.5), (None, round(1 / 3, 6))}
    assert tuples(washing.wsh_latest_failures(checks), "instance_id", "notes") == [
        (101, "y"), (102, "z")]


def test_incidents(table):
    log = table("contamination_incidents", (1, 100, "microbial", 5, None, "2025-03-30"),
                (2, 100, "microbial", 5, None, "2025-01-01"), (3, 101, "chemical", 1, None, AS_OF))
    assert tuples(incidents.inc_recent_by_kind_severity(log, AS_OF)) == [
        ("chemical", 1, 1), ("microbial", 5, 1)]
    assert tuples(incidents.inc_repeat_instances(log)) == [(100, 2)]


def readings(table):
    return table(
        "sensor_readings",
        (1, 100, None, "temperature", 39.85, "2025-03-30 12:00:00"),
        (2, 100, None, "temperature", 99, "2025-03-30 11:59:59"),
        (3, 101, None, "temperature", 35, "2025-03-31 00:00:00"),
        (4, None, 1, "humidity", 40, "2025-03-31 00:00:00"),
        (5, None, 2, "humidity", 41, "2025-03-31 00:00:00"),
    )


def test_sensors(table):
    log = readings(table)
    assert tuples(sensors.sen_temp_breaches(log, AS_OF)) == [(100, Decimal("39.850"))]
    assert tuples(sensors.sen_latest_reading(log), "instance_id", "value") == [
        (None, Decimal("41.000")), (100, Decimal("39.850")), (101, Decimal("35.000"))]
    assert tuples(sensors.sen_daily_pivot(log, AS_OF)) == [
        (date(2025, 3, 30), 69.425, None, None), (date(2025, 3, 31), 35.0, 40.5, None)]


def test_audit(table):
    log = table("audit_logs", *((i, "instance" if i % 2 else "wash", 1, "NOTE", '{"note":"n"}',
                                 "2025-01-01") for i in range(50)))
    assert tuples(audit.aud_event_counts(log)) == [("NOTE", 50)]
    assert tuples(audit.aud_latest(log, "instance", k=2), "log_id") == [(49,), (47,)]
    assert tuples(audit.aud_notes_json(log, k=1), "log_id", "note") == [(49, "n")]


def test_timeline(table):
    events = trace.instance_timeline(
        table("packaging_instances", (102, 1, "u", "lost", "2025-01-01 00:00:00", None)),
        retailers=table("retailers", (10, 1, None)),
        inspections=table("inspections", (1, 102, 1, None, "pass", None, "2025-01-03 09:00:00"),
                          (2, 102, 1, None, "pass", None, "2025-01-03 10:00:00")),
        wash_cycles=table("wash_cycles", (1, 5, "b", "2025-01-03 08:59:00", None, None, None)),
        hubs=table("hubs", (5, 3, None)),
        contamination_incidents=table("contamination_incidents"),
        movements=table("movements"),
        **loans(table),
    ).filter("instance_id = 102").orderBy("ts")
    assert tuples(events, "event", "ref_id", "location_id", "hours_since_prev") == [
        ("birth", 102, None, None), ("return", 3, 1, 9), ("checkout", 3, 1, 25),
        ("wash", 1, 3, 22), ("inspection", 1, None, 1), ("inspection", 2, None, 1),
        ("return", 4, 1, 408)]


def test_match_returns(table):
    out = table(
        "checkouts",
        (1, 100, 10, 1, "2025-01-01", 7),
        (2, 100, 10, 1, "2025-02-01", 7),
        (3, 101, 10, 1, "2025-01-01", 7),
        (4, 102, 10, 1, "2025-01-01", 7),
    )
    back = table(
        "returns",
        (1, 100, None, 1, "2024-12-01", None),  # before any checkout
        (2, 100, None, 1, "2025-01-01", None),  # at the time of checkout 1
        (3, 100, None, 1, "2025-01-02", None),  # a second one after it
        (4, 100, None, 1, "2025-02-02", None),  # after checkout 2
        (5, 101, 1, 1, "2025-01-05", 3),  # stored link
        (6, 101, None, 1, "2025-01-02", None),  # its checkout is taken
        (7, 102, 1, 1, "2024-11-01", 4),  # stored link, before its checkout
    )
    got = trace.match_returns(out, back).orderBy("return_id")
    assert tuples(got, "matched_checkout_id") == [
        (None,), (1,), (None,), (2,), (3,), (None,), (4,)]


def test_found_links_close_loans(table):
    log = loans(table)
    items = table("packaging_instances", *((i, 7, f"u{i}", "lost", AS_OF, None)
                                           for i in range(100, 105)))
    found = trace.with_matches(log["returns"], trace.match_returns(**log))
    assert found.columns == log["returns"].columns and found.count() == 5
    late = packaging.pkg_overdue(log["checkouts"], items, found, AS_OF)
    assert tuples(late) == []


def test_alerts(table):
    found = trace.alerts(
        sensor_readings=readings(table),
        inspections=table(
            "inspections",
            (1, 200, None, None, "fail", None, "2025-01-01"),
            (2, 201, None, None, "pass", None, "2025-01-02"),
            (3, 202, None, None, "pass", None, "2025-01-02"),
        ),
        contamination_incidents=table(
            "contamination_incidents",
            (1, 201, "chemical", 5, None, "2025-01-03"),
            (2, 202, "chemical", 5, None, "2025-01-01"),
            (3, 203, "chemical", 4, None, "2025-01-01"),
            (4, 204, "chemical", 3, None, "2025-01-01"),
        ),
        as_of=AS_OF,
        **loans(table),
    )
    assert sorted(tuples(found, "alert", "instance_id", "detail")) == [
        ("breach", 100, "peak 39.850"), ("overdue", 103, "checkout 4"),
        ("rewash", 200, "failed inspection"), ("rewash", 201, "incident"),
        ("rewash", 203, "incident")]


def test_loss_hotspots(table):
    items = table("packaging_instances", (100, 1, "a", "lost", AS_OF, None),
                  (101, 1, "b", "damaged", AS_OF, None), (103, 1, "c", "in_use", AS_OF, None),
                  (104, 1, "d", "in_use", AS_OF, None))
    trail = table("movements", (1, 100, None, 1, "2025-01-01", None),
                  (2, 101, None, 1, "2025-01-01", None), (3, 103, None, 2, "2025-01-01", None),
                  (4, 104, None, 3, "2025-01-01", None))
    spots = table("locations", *((i, f"P{i}", "hub", None, None, None) for i in (1, 2, 3)))
    reports = table("contamination_incidents", (1, 104, "chemical", 3, None, "2025-01-01"))
    got = trace.loss_hotspots(items, trail, loans(table)["checkouts"], loans(table)["returns"],
                              reports, spots, AS_OF).orderBy("rank")
    assert tuples(got) == [("P1", 2, 0, 0, round(2 / 3, 6), 1), ("P2", 0, 1, 0, round(1 / 3, 6), 2),
                           ("P3", 0, 0, 1, 0.0, 3)]


def test_final_running_balance_is_the_ledger_sum(spark):
    from looptrace.sources.fixtures import Loop

    loop = Loop(spark, "/root/testdata/sf0.001")
    run = customers.cus_running_balance(
        loop.deposit_accounts, loop.customers, loop.deposit_transactions, ordered=False)
    last = run.groupBy("customer_id").agg(
        F.max_by("running_balance_cents", "created_at").alias("last"))
    sums = customers.vw_customer_balances(
        loop.customers, loop.deposit_accounts, loop.deposit_transactions)
    both = sums.join(last, "customer_id")
    assert both.count() > 0
    assert both.filter("last <> ledger_sum_cents").count() == 0
