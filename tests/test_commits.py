"""Batches into a log by days: any order, repetitions and breakdowns leave what one load gives."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from looptrace.sources import commits
from looptrace.sources.commits import append_batch, manifest, read_days, replace_days
from looptrace.sources.fixtures import Loop

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / "log")


def moves(table, *rows):
    return table("movements", *[(i, 1, None, to, at, None) for i, to, at in rows])


def content(spark, path, **days):
    return sorted((r.mv_id, r.to_loc_id, str(r.event_date)) for r in read_days(spark, path, "movements", **days).collect())


def test_late_rows_and_repeated_batches_equal_one_load(spark, path, tmp_path):
    log = Loop(spark, FOLDER).movements
    order = [0, 3, 1, 0, 4, 2, 3]
    random.Random(1).shuffle(order)
    for n in order:
        append_batch(spark, path, "movements", log.filter(F.col("mv_id") % 5 == n), f"b{n}")
    once = str(tmp_path / "once")
    append_batch(spark, once, "movements", log, "all")
    got, want = (read_days(spark, p, "movements").drop("_x") for p in (path, once))
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert got.count() == log.count() and manifest(spark, path).version == 5


def test_only_touched_days_are_written_anew(spark, table, path):
    append_batch(spark, path, "movements", moves(table, (1, 5, "2025-01-01"), (2, 5, "2025-01-02")), "a")
    before = manifest(spark, path).days
    append_batch(spark, path, "movements", moves(table, (3, 6, "2025-01-02"), (2, 9, "2025-01-02")), "b")
    after = manifest(spark, path).days
    assert before["2025-01-01"] == after["2025-01-01"] and before["2025-01-02"] != after["2025-01-02"]
    assert content(spark, path) == [(1, 5, "2025-01-01"), (2, 9, "2025-01-02"), (3, 6, "2025-01-02")]
    assert content(spark, path, since="2025-01-02") == [(2, 9, "2025-01-02"), (3, 6, "2025-01-02")]
    assert content(spark, path, until="2025-01-01") == [(1, 5, "2025-01-01")]
    files = read_days(spark, path, "movements", since="2025-01-02").inputFiles()
    assert files and all("event_date=2025-01-02" in f for f in files)


def test_a_breakdown_before_the_manifest_changes_nothing(spark, table, path, monkeypatch):
    append_batch(spark, path, "movements", moves(table, (1, 5, "2025-01-01")), "a")

    def broken(*_):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr(commits, "_put", broken)
        with pytest.raises(OSError):
            append_batch(spark, path, "movements", moves(table, (2, 5, "2025-01-01")), "b")
    assert content(spark, path) == [(1, 5, "2025-01-01")]
    append_batch(spark, path, "movements", moves(table, (2, 5, "2025-01-01")), "b")
    assert content(spark, path) == [(1, 5, "2025-01-01"), (2, 5, "2025-01-01")]


def test_a_lost_race_starts_over(spark, table, path, monkeypatch):
    put, raced = commits._put, []

    def late(*args):
        if not raced:
            raced.append(1)
            append_batch(spark, path, "movements", moves(table, (7, 5, "2025-01-01")), "other")
        put(*args)

    monkeypatch.setattr(commits, "_put", late)
    append_batch(spark, path, "movements", moves(table, (8, 5, "2025-01-01")), "mine")
    assert content(spark, path) == [(7, 5, "2025-01-01"), (8, 5, "2025-01-01")]
    assert manifest(spark, path).batches == ["other", "mine"] and manifest(spark, path).version == 2


def test_days_are_replaced_as_a_whole(spark, table, path):
    append_batch(spark, path, "movements", moves(
        table, (1, 5, "2025-01-01"), (2, 5, "2025-01-02"), (3, 5, "2025-01-03")), "a")
    days = ["2025-01-02", "2025-01-03"]
    replace_days(spark, path, "movements", moves(table, (9, 1, "2025-01-02")), "fix", days)
    replace_days(spark, path, "movements", moves(table, (9, 2, "2025-01-02")), "fix", days)
    assert content(spark, path) == [(1, 5, "2025-01-01"), (9, 1, "2025-01-02")]
    with pytest.raises(ValueError, match="not to be replaced"):
        replace_days(spark, path, "movements", moves(table, (9, 1, "2025-01-09")), "no", days)
    assert manifest(spark, path).batches == ["a", "fix"]


def test_nulls_repeated_rows_and_nothing(spark, table, path):
    assert content(spark, path) == []
    append_batch(spark, path, "movements", moves(table), "nothing")
    rows = moves(table, (1, 5, "2025-01-01"), (1, 5, "2025-01-01"), (None, 5, "2025-01-01"), (None, 5, "2025-01-01"))
    append_batch(spark, path, "movements", rows, "odd")
    assert sorted(r.mv_id or 0 for r in read_days(spark, path, "movements").collect()) == [0, 0, 1]
    with pytest.raises(ValueError, match="have no day"):
        append_batch(spark, path, "movements", moves(table, (2, 5, None)), "timeless")
    assert manifest(spark, path).batches == ["nothing", "odd"]
