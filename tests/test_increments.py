"""Checks of new rows against the index give what the full checks say of them."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from looptrace.operators import increments as inc
from looptrace.operators import quality
from looptrace.schemas import TABLES
from looptrace.sources.fixtures import Loop

FOLDER = "/root/testdata/sf0.001"
SOME = ("customers", "packaging_catalog", "packaging_instances", "checkouts", "returns", "locations")


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.select("rule", "table", "key", "detail").collect()))


def parts(spark, n, part):
    """The rows of a part of the faulty tables, and of it and those before."""
    t = Loop(spark, FOLDER, dirty=True)
    number = {name: F.coalesce(F.col(TABLES[name].key) % n, F.lit(n - 1)) for name in SOME}
    new = {name: t[name].filter(number[name] == part) for name in SOME}
    upto = {name: t[name].filter(number[name] <= part) for name in SOME}
    return new, upto


def of_new(full, new):
    """Of the full checks' rows those that new rows have a part in."""
    out = []
    for name, df in new.items():
        spec = TABLES[name]
        for column, rule in ((spec.key, "primary_key"), *((c, "unique") for c in spec.unique)):
            own = df.select(F.col(column).cast("string").alias("key")).distinct()
            found = full.filter((F.col("table") == name) & (F.col("rule") == rule))
            if rule == "unique":
                found = found.filter(F.col("detail").startswith(f"{column}: "))
            out += rows(found.join(own, found["key"].eqNullSafe(own["key"]), "left_semi"))
        keys = df.select(F.col(spec.key).cast("string").alias("key"))
        found = full.filter((F.col("table") == name) & (F.col("rule") == "foreign_key"))
        out += rows(found.join(keys, found["key"].eqNullSafe(keys["key"]), "left_semi"))
    return sorted(out)


@pytest.mark.parametrize("bits", [1 << 20, 64])
def test_three_batches_equal_the_full_checks(spark, tmp_path, bits):
    path = str(tmp_path / "index")
    first, _ = parts(spark, 3, 0)
    inc.create_index(spark, path, first, buckets=16, bits=bits)
    seen = set()
    for part in (1, 2):
        new, upto = parts(spark, 3, part)
        full = quality.dq_primary_key(upto).union(quality.dq_unique(upto)).union(quality.dq_foreign_key(upto))
        got = rows(inc.check_increment(spark, path, new))
        assert got == of_new(full, new)
        seen |= {r[0] for r in got}
        inc.add_to_index(spark, path, new)
    assert seen >= {"unique", "foreign_key"}


def test_new_ids_meet_few_buckets(spark, table, tmp_path):
    path = str(tmp_path / "index")
    old = table("movements", *[(i, 1, None, None, "2025-01-01", None) for i in range(2_000)])
    inc.create_index(spark, path, {"movements": old}, buckets=64)
    later = table("movements", *[(i, 1, None, None, "2025-01-02", None) for i in range(5_000, 7_000)],
                  (7, 1, None, None, "2025-01-02", None))
    values = inc._values({"movements": later})
    maybe = inc.maybe_known(spark, path, values).collect()
    assert "=7" in {r.value for r in maybe} and len(maybe) <= 5
    buckets = sorted({r.bucket for r in maybe})
    held = inc.index_buckets(spark, path, buckets)
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    read = [df.select(F.input_file_name()).distinct().count()
            for df in (held, inc.index_buckets(spark, path, list(range(64))))]
    assert 0 < read[0] <= 5 < 64 == read[1]
    assert rows(inc.check_increment(spark, path, {"movements": later})) == [
        ("primary_key", "movements", "7", "2 rows")]


def test_nulls_and_rows_that_repeat_within_a_batch(spark, table, tmp_path):
    path = str(tmp_path / "index")
    inc.create_index(spark, path, {"customers": table("customers", (1, "a", None, None, "2025-01-01"))})
    batch = {
        "customers": table("customers", (2, "b", None, None, "2025-01-01"), (3, "c", "x", None, "2025-01-01"),
                           (3, "d", "y", None, "2025-01-01"), (None, "e", "z", None, "2025-01-01")),
        "deposit_accounts": table("deposit_accounts", (1, 1, 0), (2, 2, 0), (3, 9, 0), (4, None, 0)),
    }
    assert rows(inc.check_increment(spark, path, batch)) == sorted([
        ("primary_key", "customers", "3", "2 rows"), ("unique", "customers", "None", "email: 2 rows"),
        ("foreign_key", "deposit_accounts", "3", "customer_id -> customers: 9")])
    nothing = {"customers": batch["customers"].where("false")}
    assert rows(inc.check_increment(spark, path, nothing)) == []


def test_tables_are_read_once_and_values_never_broadcast(spark, table, tmp_path, monkeypatch):
    plans = []

    def recorded(df, purpose, kept=inc.stored):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, purpose)

    def given(name, *lines):
        table(name, *lines).write.parquet(str(tmp_path / name))
        return spark.read.schema(TABLES[name].struct).parquet(str(tmp_path / name))

    day, index = "2025-01-01", str(tmp_path / "index")
    old = {name: given(name) for name in ("packaging_instances", "locations", "checkouts")}
    old["customers"] = given("customers", *[(i, "a", f"{i}@x", None, day) for i in range(500)])
    new = {"returns": given("returns", *[(i, i, i, i, day, i) for i in range(600)])}
    monkeypatch.setattr(inc, "stored", recorded)
    inc.create_index(spark, index, old, buckets=16)
    out = inc.check_increment(spark, index, new)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    for column in ("email", "return_id"):
        scans = [x for plan in plans for x in plan.splitlines() if "FileScan" in x and f"{column}#" in x]
        assert len(scans) == 1, column
    broadcast = [plan for plan in plans if "BroadcastExchange" in plan]
    assert all("bits" in plan and "BuildLeft" not in plan for plan in broadcast)  # of filters alone
    assert out.count() == 600 * 3 + 100
