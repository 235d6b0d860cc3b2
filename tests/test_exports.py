"""Generalised exports: groups of k, cut level by level or in one task, and what they lose."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from looptrace.operators import anonymize as exports
from looptrace.operators import mondrian
from looptrace.operators.anonymize import (
    SINGLED_OUT_BY, anonymize, export_loss, generalize, generalized_export,
)
from looptrace.schemas import TABLES
from looptrace.sources.fixtures import Loop

FOLDER = "/root/testdata/sf0.01"


def brute(x, widths, k):
    """The groups by plain recursion, as sets of row numbers."""

    def split(rows):
        spread = sorted(
            ((-(max(x[r][j] for r in rows) - min(x[r][j] for r in rows)) / widths[j], j)
             for j in range(len(widths))))
        for s, j in spread:
            if s == 0:
                break
            values = sorted(x[r][j] for r in rows)
            middle = values[(len(values) - 1) // 2]
            for up in ([r for r in rows if x[r][j] > middle], [r for r in rows if x[r][j] >= middle]):
                if len(up) >= k and len(rows) - len(up) >= k:
                    return split(up) | split([r for r in rows if r not in set(up)])
        return {frozenset(rows)}

    return split(list(range(len(x))))


@pytest.mark.parametrize("seed, k", [(1, 2), (2, 5), (3, 7), (4, 60)])
def test_groups_equal_plain_recursion(seed, k):
    draw = np.random.default_rng(seed)
    x = np.stack([draw.integers(0, 9, 200), draw.normal(size=200), draw.integers(0, 2, 200)], 1).astype(float)
    widths = x.max(0) - x.min(0)
    found = defaultdict(set)
    for row, group in enumerate(mondrian.groups_of(x, widths, k)):
        found[group].add(row)
    assert set(map(frozenset, found.values())) == brute(x.tolist(), widths.tolist(), k)


def numbered(spark, n=3_000, seed=1, hot=0.4):
    draw = random.Random(seed)
    rows = [
        (i, *((7, 1.0, "same") if draw.random() < hot else
              (draw.choice([None, *range(40)]), draw.gauss(0, 5), draw.choice(["é", "box", None, "cup"]))))
        for i in range(n)
    ]
    return rows, spark.createDataFrame(rows, "r long, a int, b double, c string")


@pytest.mark.parametrize("leaf", [30, 200, 100_000])
def test_levels_keep_groups_of_k_and_equal_rows_together(spark, leaf):
    rows, df = numbered(spark)
    found = mondrian.grouped(df, "r", ["a", "b", "c"], 5, leaf).collect()
    group = {r.r: (r.part, r.grp) for r in found}
    assert len(found) == len(rows) == len(group)
    sizes = Counter(group.values())
    assert min(sizes.values()) >= 5 and len(sizes) > 120
    together = defaultdict(set)
    for r in rows:
        together[r[1:]].add(group[r[0]])
    assert all(len(g) == 1 for g in together.values())


def test_a_part_that_cannot_be_cut_never_gathers(spark, monkeypatch):
    seen = []
    df = spark.range(2_000).selectExpr("id AS r", "IF(id < 1990, 1, CAST(id AS INT)) AS a")
    grouped = mondrian.grouped(df, "r", ["a"], 5, 50)
    sizes = Counter((r.part, r.grp) for r in grouped.collect())
    seen = sorted(sizes.values())
    assert seen == [5, 5, 1990]
    whole = [r for r in grouped.where("grp = -1").collect()]
    assert len(whole) == 1990  # of no task that cuts leaves


def test_all_tables_are_exported_in_groups(spark):
    t = Loop(spark, FOLDER)
    tables = {name: t[name] for name in TABLES}
    for name, out in generalized_export(tables, "s", k=5).items():
        single = SINGLED_OUT_BY.get(name, ())
        rows = tables[name].count()
        assert out.count() == rows > 0, name
        shown = [c for c in out.columns for s in single if c in (s, f"{s}_from", f"{s}_to")]
        if shown:
            assert out.groupBy(*shown).count().where("count < 5").isEmpty(), name


@pytest.mark.parametrize("name", [
    "locations", "customers", "checkouts", "returns", "wash_cycles", "deposit_transactions", "movements",
    "sensor_readings", "contamination_incidents", "audit_logs", "packaging_instances"])
def test_less_is_lost_than_by_leaving_rows_out(spark, name):
    df = Loop(spark, FOLDER)[name]
    plain = export_loss(name, df, anonymize(name, df, "s", unit="day"), "day")
    ranges = export_loss(name, df, generalize(name, df, "s", unit="day"))
    assert ranges < plain, (ranges, plain)


def test_pseudonyms_nulls_and_small_tables(spark, table):
    places = [(i, f"n{i}", "hub" if i % 2 else "retailer", None, None if i == 3 else 41 + i / 100, 2.0)
              for i in range(12)]
    df = table("locations", *places)
    out = generalize("locations", df, "s", k=3)
    assert out.columns == ["location_id", "kind", "lat_from", "lat_to", "lng_from", "lng_to"]
    ids = {r.location_id for r in df.select(F.sha2(
        F.concat(F.lit("s|locations|"), F.col("location_id").cast("string")), 256
    ).alias("location_id")).collect()}
    assert {r.location_id for r in out.collect()} == ids
    assert generalize("locations", df.limit(2), "s", k=3).collect() == []
    assert generalize("locations", df.where("false"), "s").collect() == []
    copies = df.where("location_id = 1").crossJoin(spark.range(9)).drop("id")
    assert [r.kind for r in generalize("locations", copies, "s").collect()] == ["hub"] * 9


def under_broadcasts(df):
    """The lines of a plan's broadcast parts."""
    out, depth = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().splitlines():
        at = len(line) - len(line.lstrip(" :+-"))
        if depth is not None and at <= depth:
            depth = None
        if depth is not None:
            out.append(line)
        elif "BroadcastExchange" in line:
            depth = at
    return out


def test_rows_and_groups_are_never_broadcast(spark, monkeypatch):
    plans = []

    def recorded(df, purpose, kept=mondrian.stored):
        plans.append((purpose, under_broadcasts(df)))
        return kept(df, purpose)

    monkeypatch.setattr(mondrian, "stored", recorded)
    monkeypatch.setattr(exports, "stored", recorded)
    items = Loop(spark, FOLDER).packaging_instances
    out = generalize("packaging_instances", items, "s", unit="month", leaf=100)
    plans.append(("out", under_broadcasts(out)))
    assert {p for p, _ in plans} >= {"medians", "cuts", "groups", "out"}
    for purpose, lines in plans:
        assert not (lines if purpose in ("groups", "out") else [x for x in lines if "_row#" in x]), purpose
    assert out.count() == items.count()
