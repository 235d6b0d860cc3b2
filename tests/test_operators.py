"""Operators against brute force, and checks, deletes, loads and exports on made rows."""

from __future__ import annotations

import math
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from looptrace.operators import quality
from looptrace.operators.anonymize import anonymize, anonymized_export
from looptrace.operators.knn import _in_space, candidates, knn_places
from looptrace.operators.refdelete import DeleteBlocked, apply_delete, ref_delete
from looptrace.operators.slices import previous, running_sum, sliced
from looptrace.plans import customers, trace
from looptrace.plans.views import register_views
from looptrace.schemas import TABLES
from looptrace.sources.files import read_log, read_table, write_log, write_table
from looptrace.sources.fixtures import Loop
from looptrace.sources.ingest import load_file, read_raw, rejected_rows, typed_rows, with_defaults

from .conftest import at, tuples

FOLDER = "/root/testdata/sf0.001"


def skewed_log(spark, n=3000, seed=1):
    """A third of the rows in one group, many equal times, a gap in the middle."""
    rng = random.Random(seed)
    start = datetime(2025, 1, 1)

    def when():
        return start + timedelta(minutes=rng.randrange(400) + rng.choice((0, 0, 50_000)))

    rows = [(0 if i % 3 == 0 else rng.randrange(1, 60), when(), i, rng.randrange(-90, 90))
            for i in range(n)]
    return spark.createDataFrame(rows, "k long, ts timestamp, id long, v int")


def agree_with_plain_windows(log, slices):
    plain = Window.partitionBy("k").orderBy("ts", "id")
    want = log.select(
        "id",
        F.sum("v").over(plain.rowsBetween(Window.unboundedPreceding, 0)).alias("total"),
        F.lag("id").over(plain).alias("before"),
    )
    total = running_sum(log, "k", ["ts", "id"], "v", "total", slices)
    before = previous(log, "k", ["ts", "id"], ["id"], slices)
    assert total.columns == [*log.columns, "total"]
    assert sorted(tuples(total, "id", "total"), key=str) == sorted(
        tuples(want, "id", "total"), key=str)
    assert sorted(tuples(before.select("id", F.coalesce("prev.id", F.lit(-1))))) == sorted(
        tuples(want.select("id", F.coalesce("before", F.lit(-1)))))


@pytest.mark.parametrize("slices", [1, 7, 40, None])
def test_slices_change_no_result(spark, slices):
    agree_with_plain_windows(skewed_log(spark), slices)


@pytest.mark.parametrize("key", ["0L", "CAST(NULL AS BIGINT)", "id % 2000", "id % 3"])
def test_slices_of_one_instant_many_groups_and_no_key(spark, key):
    log = spark.range(8000).selectExpr(
        f"{key} AS k", "id", "timestamp_seconds(1e8) AS ts",
        "IF(id % 5 = 0, NULL, CAST(id % 7 - 3 AS INT)) AS v")
    agree_with_plain_windows(log, 16)
    sizes = [n for (n,) in tuples(sliced(log, "k", ["ts", "id"], 16).groupBy("_slice").count(),
                                  "count")]
    assert len(sizes) > 10 and max(sizes) < 1500


def test_slices_cut_a_hot_group_with_a_burst(spark):
    # nine of ten rows lie in one hour, the others are spread over years
    log = spark.range(10_000).selectExpr(
        "0L AS k", "id",
        "timestamp_seconds(CASE WHEN id % 10 = 0 THEN id * 20000 ELSE 1e8 + id * 0.3 END) AS ts")
    cut = sliced(log, "k", ["ts", "id"], 50)
    spans = cut.groupBy("_slice").agg(F.count("*").alias("n"), F.min("ts").alias("a"),
                                      F.max("ts").alias("b")).orderBy("_slice").collect()
    assert len(spans) > 40 and max(r.n for r in spans) <= 600
    assert all(x.b <= y.a for x, y in zip(spans, spans[1:]))


def test_reports_agree_when_groups_are_cut(spark):
    t = Loop(spark, FOLDER)
    for report in (
        lambda slices: trace.match_returns(t.checkouts, t.returns, slices),
        lambda slices: customers.cus_running_balance(
            t.deposit_accounts, t.customers, t.deposit_transactions, False, slices),
    ):
        assert sorted(map(str, tuples(report(50)))) == sorted(map(str, tuples(report(1))))


def test_match_returns_uses_a_checkout_once(spark):
    t = Loop(spark, FOLDER)
    used = trace.match_returns(t.checkouts, t.returns).join(
        t.returns.select("return_id", "checkout_id"), "return_id").filter(
        "checkout_id IS NULL AND matched_checkout_id IS NOT NULL")
    assert used.count() > 0
    assert used.groupBy("matched_checkout_id").count().filter("count > 1").isEmpty()


def haversine(a, b):
    (p, q), (r, s) = ([math.radians(float(x)) for x in c] for c in (a, b))
    h = math.sin((r - p) / 2) ** 2 + math.cos(p) * math.cos(r) * math.sin((s - q) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def nearest(points, places, k, max_km):
    out = []
    for pid, *p in points:
        ranked = sorted((round(haversine(p, q), 6), i) for i, *q in places)
        ranked = [r for r in ranked if r[0] <= max_km][:k]
        out += [(pid, i, d, n + 1) for n, (d, i) in enumerate(ranked)]
    return out


def clustered(rng, n, centre, spread):
    """Mostly in one small cluster, some copies of one position, the rest far apart."""
    out = []
    for i in range(n):
        reach = rng.choice((0.0, spread / 100, spread / 100, spread))
        out.append((i, round(centre[0] + rng.uniform(-reach, reach), 6),
                    round(centre[1] + rng.uniform(-reach, reach), 6)))
    return out


@pytest.mark.parametrize("centre, spread, k, max_km", [
    ((41.385, 2.17), 0.2, 3, 5.0),
    ((41.385, 2.17), 0.02, 10, 5.0),
    ((0.0, 180.0), 0.5, 4, 60.0),
    ((89.9, 10.0), 0.1, 2, 15.0),
    ((41.385, 2.17), 0.2, 300, 30.0),
    ((10.0, 10.0), 40.0, 5, 9000.0),
])
def test_knn_equals_brute_force(spark, centre, spread, k, max_km):
    rng = random.Random(7)

    def fold(rows):  # keep longitudes on the globe
        return [(i, min(90.0, la), (lo + 180) % 360 - 180) for i, la, lo in rows]

    points = fold(clustered(rng, 60, centre, spread))
    places = fold(clustered(rng, 150, centre, spread))
    got = knn_places(
        spark.createDataFrame(points + [(999, None, 1.0)], "point_id long, lat double, lng double"),
        spark.createDataFrame(places, "location_id long, lat double, lng double"),
        k, max_km,
    )
    assert sorted(tuples(got)) == sorted(nearest(points, places, k, max_km))


def test_knn_beside_a_cluster_opens_its_edge_only(spark):
    rng = random.Random(3)
    spots = spark.createDataFrame(
        [(41.0 + rng.uniform(0, 0.002), 2.0 + rng.uniform(0, 0.002)) for _ in range(2000)],
        "lat double, lng double")
    sites = spark.createDataFrame(
        [(i, 41.01 + rng.uniform(0, 0.002), 2.01 + rng.uniform(0, 0.002)) for i in range(2000)],
        "location_id long, lat double, lng double")
    pairs = candidates(_in_space(spots), _in_space(sites), 3, 5.0)
    assert 2000 * 3 <= pairs.count() <= 2000 * 3 * 4


def broken(table):
    return {
        "locations": table("locations", (1, "A", "retailer", None, None, None),
                           (2, "A", "depot", None, None, None), (3, "C", "hub", None, None, None)),
        "retailers": table("retailers", (10, 1, None), (10, 3, None), (11, None, None)),
        "customers": table("customers", (1, "a", None, None, "2025-01-01"),
                           (2, None, None, "9" * 41, "2025-01-01")),
        "packaging_instances": table(
            "packaging_instances", (100, 7, "u", "lost", "2025-01-02", "2025-01-01")),
        "checkouts": table("checkouts", (1, 100, 10, 5, "2025-01-02", 7)),
        "returns": table("returns", (1, 100, None, 3, "2025-01-01", 1),
                         (2, 100, 1, 1, "2025-01-03", 9)),
        "wash_cycles": table("wash_cycles", (1, 5, "b", "2025-01-02", "2025-01-01", None, None)),
    }


def test_quality(table):
    t = broken(table)

    def found(check):
        return sorted(tuples(check(t), "table", "key", "detail"), key=str)

    assert found(quality.dq_not_null) == [("customers", "2", "name"),
                                          ("retailers", "11", "location_id")]
    assert found(quality.dq_primary_key) == [("retailers", "10", "2 rows")]
    assert found(quality.dq_unique) == [("customers", None, "email: 2 rows"),
                                        ("locations", "A", "name: 2 rows")]
    assert found(quality.dq_check) == [("customers", "2", "phone_length"),
                                       ("locations", "2", "kind_allowed")]
    assert found(quality.dq_foreign_key) == [
        ("checkouts", "1", "customer_id -> customers: 5"),
        ("returns", "2", "checkout_id -> checkouts: 9")]
    assert found(quality.dq_role_kind) == [("retailers", "10", "at a hub"),
                                           ("returns", "1", "at a hub")]
    assert found(quality.dq_temporal) == [
        ("packaging_instances", "100", "retired before its birth"),
        ("returns", "1", "returned before its checkout"),
        ("wash_cycles", "1", "ended before its start")]


def test_model_size():
    tables = TABLES.values()
    assert (len(TABLES), sum(len(t.required) for t in tables), sum(len(t.unique) for t in tables),
            sum(len(t.checks) for t in tables), sum(len(t.refs) for t in tables)) == (16, 62, 7, 8, 21)


def deposits(table):
    return {
        "customers": table("customers", (1, "a", None, None, "2025-01-01"),
                           (2, "b", None, None, "2025-01-01")),
        "deposit_accounts": table("deposit_accounts", (11, 1, 0), (12, 2, 0)),
        "deposit_transactions": table(
            "deposit_transactions", (1, 11, 5, "x", None, None, "2025-01-01"),
            (2, 12, 5, "x", None, None, "2025-01-01")),
        "checkouts": table("checkouts", (1, 100, 10, 2, "2025-01-02", 7)),
        "returns": table("returns", (1, 100, 1, 1, "2025-01-03", 1),
                         (2, 100, None, 1, "2025-01-03", None)),
    }


def test_delete_cascades_and_sets_null(spark, table):
    t = deposits(table)
    keys = spark.createDataFrame([(1,), (1,), (77,)], "customer_id long")
    assert sorted(tuples(ref_delete(t, "customers", keys)), key=str) == sorted([
        ("delete", "customers", None, 1), ("delete", "deposit_accounts", None, 11),
        ("delete", "deposit_transactions", None, 1), ("null", "returns", "customer_id", 1)], key=str)
    after = apply_delete(t, "customers", keys)
    assert tuples(after["customers"], "customer_id") == [(2,)]
    assert tuples(after["deposit_accounts"], "account_id") == [(12,)]
    assert tuples(after["deposit_transactions"], "tx_id") == [(2,)]
    assert sorted(tuples(after["returns"], "return_id", "customer_id")) == [(1, None), (2, None)]
    assert after["returns"].columns == t["returns"].columns
    assert after["checkouts"].count() == 1


def test_delete_is_blocked(spark, table):
    t = deposits(table)
    keys = spark.createDataFrame([(1,), (2,)], "customer_id long")
    blocks = ref_delete(t, "customers", keys).filter("action = 'block'")
    assert tuples(blocks, "table", "column", "key") == [("checkouts", "customer_id", 1)]
    with pytest.raises(DeleteBlocked):
        apply_delete(t, "customers", keys)


def test_load_from_files(spark, tmp_path):
    (tmp_path / "r.csv").write_text(
        "reading_id,instance_id,location_id,sensor_type,value,measured_at\n"
        "1,7,,shock,1.5,2025-01-01 00:00:00\n"
        "x,7,,shock,much,2025-01-01 00:00:00\n"
        "3,,2,shock,2,2025-13-01\n")
    raw = read_raw(spark, str(tmp_path / "r.csv"), "sensor_readings")
    good = typed_rows(raw, "sensor_readings")
    assert good.dtypes == [(c.name, c.type.simpleString())
                           for c in TABLES["sensor_readings"].columns]
    assert tuples(good, "reading_id", "location_id") == [(1, None)]
    assert sorted(tuples(rejected_rows(raw, "sensor_readings"), "reading_id", "faults")) == [
        ("3", "measured_at"), ("x", "reading_id,value")]
    (tmp_path / "r.json").write_text('{"reading_id": 5, "value": 1.25}\n')
    raw = read_raw(spark, str(tmp_path / "r.json"), "sensor_readings", "json")
    assert tuples(typed_rows(raw, "sensor_readings")) == [(5, Decimal("1.250"))]


def test_records_that_are_no_rows(spark, tmp_path):
    lines = ["1,7,3,temperature,36.5,2025-01-01 00:00:00", "2,7", "3,7,3,shock,1,2025-01-01,8,9",
             "4,7,3,shock,much,2025-01-01", "", "5,,,shock,1,2025-01-01"]
    header = "reading_id,instance_id,location_id,sensor_type,value,measured_at"
    (tmp_path / "r.csv").write_text("\n".join([header, *lines, ""]))
    raw = read_raw(spark, str(tmp_path / "r.csv"), "sensor_readings")
    assert sorted(tuples(typed_rows(raw, "sensor_readings"), "reading_id")) == [(1,), (5,)]
    bad = sorted(tuples(rejected_rows(raw, "sensor_readings"), "reading_id", "record", "faults"),
                 key=str)
    assert bad == [("4", None, "value"), (None, "2,7", "record"),
                   (None, "3,7,3,shock,1,2025-01-01,8,9", "record")]
    lines = ['{"reading_id": 5, "value": 1.25}', '{"reading_id": 6, "value": ', "nothing", "{}"]
    (tmp_path / "r.json").write_text("\n".join(lines) + "\n")
    raw = read_raw(spark, str(tmp_path / "r.json"), "sensor_readings", "json")
    good, rest = typed_rows(raw, "sensor_readings"), rejected_rows(raw, "sensor_readings")
    assert sorted(tuples(rest, "reading_id", "record", "faults")) == [
        (None, lines[2], "record"), (None, lines[1], "record")]
    assert good.count() + rest.count() == len(lines)
    load_file(spark, str(tmp_path / "r.csv"), "sensor_readings", str(tmp_path / "out"),
              str(tmp_path / "bad"), as_of="2025-01-01 06:00:00")
    assert read_log(spark, str(tmp_path / "out"), "sensor_readings").count() == 2
    assert spark.read.json(str(tmp_path / "bad")).filter("record IS NOT NULL").count() == 2


def test_load_file(spark, tmp_path):
    raw, out, bad = (str(tmp_path / name) for name in ("m.csv", "out", "bad"))
    (tmp_path / "m.csv").write_text("mv_id,instance_id,to_loc_id\n1,7,3\n2,?,3\n")
    load_file(spark, raw, "movements", out, bad, as_of="2025-01-01 06:00:00")
    assert tuples(read_log(spark, out, "movements").drop("event_date")) == [
        (1, 7, None, 3, at("2025-01-01 06:00:00"), None)]
    assert tuples(spark.read.json(bad), "mv_id", "faults") == [("2", "instance_id")]


def test_views(spark):
    names = register_views(Loop(spark, FOLDER))
    assert len(names) == 19
    (total,), = tuples(spark.sql("SELECT count(*) FROM v_checkout_enriched JOIN"
                                 " v_customer_balances USING (customer_id)"))
    assert total > 0
    assert register_views({"movements": spark.table("movements")}) == [
        "movements", "v_instance_last_location"]


def test_defaults(spark):
    df = spark.createDataFrame([(1, 2, "u", None)],
                               "instance_id long, catalog_id long, uid_code string, state string")
    now = "2025-01-01 00:00:00"
    assert tuples(with_defaults(df, "packaging_instances", now)) == [
        (1, 2, "u", None, at(now), None)]
    assert tuples(with_defaults(df, "packaging_instances", now, replace_null=True), "state") == [
        ("available",)]
    with pytest.raises(ValueError):
        with_defaults(df.drop("uid_code"), "packaging_instances", now)


def test_files(spark, table, tmp_path):
    log = table("movements", (1, 7, None, 3, "2025-01-01 05:00:00", None),
                (2, 7, None, 3, "2025-01-02 05:00:00", None))
    path = str(tmp_path / "log")
    write_log(log, path, "movements")
    assert sorted(tuples(read_log(spark, path, "movements"), *log.columns)) == sorted(tuples(log))
    recent = read_log(spark, path, "movements", since="2025-01-02 00:00:00")
    assert tuples(recent, "mv_id") == [(2,)]
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan
    write_table(log, str(tmp_path / "table"))
    assert sorted(tuples(read_table(spark, str(tmp_path / "table"), "movements"))) == sorted(
        tuples(log))


def test_export(table):
    people = table("customers", *((i, f"n{i}", f"e{i}", "1", "2025-01-01 09:00:00")
                                  for i in range(4)), (9, "n", "e", "2", "2025-02-01"))
    loans = table("checkouts", *((i, 100, 10, i % 2, "2025-01-01 10:00:00", 7) for i in range(3)))
    spots = table("locations", *((i, f"l{i}", "hub", None, 41.38765, 2.1) for i in range(3)))
    out = anonymized_export({"customers": people, "checkouts": loans, "locations": spots}, "s", k=3)
    assert out["customers"].columns == ["customer_id", "created_at"]
    assert out["customers"].count() == 4  # the one alone on its day is left out
    assert tuples(out["locations"].select("lat", "lng").distinct()) == [(41.39, 2.1)]
    assert out["checkouts"].join(out["customers"], "customer_id").count() == 3
    other = anonymize("customers", people, "t", k=3)
    assert out["customers"].join(other, "customer_id").isEmpty()
