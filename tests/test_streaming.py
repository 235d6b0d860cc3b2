"""Streams: repeated and late rows, several batches, agreement with the batch reports."""

from __future__ import annotations

from types import SimpleNamespace

import pytest

from looptrace.plans import sensors
from looptrace.session import scratch_dir
from looptrace.sources.files import read_log, write_log
from looptrace.streaming.feeds import run_to_files, stream_log
from looptrace.streaming.loans import st_overdue
from looptrace.streaming.telemetry import (
    latest_of_feed, latest_running, st_latest_reading, st_temp_breaches,
)

from .conftest import at, tuples


def feed(spark, table, tmp_path, name, *batches):
    path = str(tmp_path / name)
    for rows in batches:
        table(name, *rows).coalesce(1).write.mode("append").parquet(path)
    return stream_log(spark, path, name, files_per_batch=1)


def reading(i, item, value, time, kind="temperature"):
    return (i, item, None, kind, value, time)


def test_breaches(spark, table, tmp_path):
    stream = feed(
        spark, table, tmp_path, "sensor_readings",
        [reading(1, 7, 36, "2025-01-01 10:30:00"), reading(1, 7, 36, "2025-01-01 10:30:00"),
         reading(2, 7, 20, "2025-01-01 10:40:00"), reading(3, 8, 99, "2025-01-01 10:40:00", "shock")],
        [reading(4, 7, 50, "2025-01-05 00:30:00")],
        [reading(5, 7, 50, "2025-01-05 00:40:00")],
        [reading(6, 7, 90, "2025-01-01 11:00:00")],  # far behind the watermark by now
    )
    found = run_to_files(spark, st_temp_breaches(stream, window="2 hours"), "breaches")
    assert sorted(tuples(found.select("window_start", "instance_id", "max_temp").selectExpr(
        "window_start", "instance_id", "CAST(max_temp AS INT)"))) == [
        (at("2025-01-01 09:00"), 7, 36), (at("2025-01-01 10:00"), 7, 36)]


def test_latest_reading_equals_batch(spark, table, tmp_path):
    rows = [reading(i, i % 3 or None, i % 40, f"2025-01-01 {i % 20:02d}:{i % 60:02d}:00",
                    "shock" if i % 2 else "humidity") for i in range(200)]
    last = [reading(999, 5, 1, "2025-01-03 00:00:00")]
    stream = feed(spark, table, tmp_path, "sensor_readings", rows, last)
    got = latest_of_feed(run_to_files(spark, st_latest_reading(stream), "latest"))
    want = sensors.sen_latest_reading(table("sensor_readings", *rows))
    assert sorted(map(str, tuples(got))) == sorted(map(str, tuples(want)))


def test_running_latest_reading_has_the_newest(spark, table, tmp_path):
    rows = [reading(i, i % 3 or None, i % 40, f"2025-01-01 {i % 20:02d}:{i % 60:02d}:00",
                    "shock" if i % 2 else "humidity") for i in range(200)]
    rows += [reading(999, 5, 1, "2025-01-03 00:00:00"), reading(998, 1, 1, "2025-01-02 23:30:00")]
    log = table("sensor_readings", *rows)
    write_log(log, str(tmp_path / "log"), "sensor_readings")
    log = read_log(spark, str(tmp_path / "log"), "sensor_readings")
    for stream in (feed(spark, table, tmp_path, "sensor_readings", rows[:150], rows[150:]),
                   feed(spark, table, tmp_path / "few", "sensor_readings", rows[-2:])):
        out = run_to_files(spark, st_latest_reading(stream), "running")
        source = log if out.count() else table("sensor_readings", *rows[-2:])
        want = sensors.sen_latest_reading(source)
        assert sorted(map(str, tuples(latest_running(out, source)))) == sorted(
            map(str, tuples(want)))


@pytest.mark.parametrize("longest", [None, 90])
def test_overdue(spark, table, tmp_path, longest):
    out = feed(
        spark, table, tmp_path, "checkouts",
        [(1, 100, 10, 1, "2025-01-01", 7), (2, 101, 10, 1, "2025-01-01", 7),
         (3, 102, 10, 1, "2025-01-01", 7), (5, 104, 10, 1, "2025-01-01", 21),
         (6, 105, 10, 1, "2025-01-01", 21), (7, 106, 10, 1, "2025-01-01", 90)],
        [(4, 103, 10, 1, "2025-02-01", 70)],
    )
    back = feed(
        spark, table, tmp_path, "returns",
        [(1, 100, 1, 1, "2025-01-03", 1), (2, 101, 1, 1, "2025-01-12", 2),
         (3, 102, None, 1, "2025-01-03", None), (5, 104, 1, 1, "2025-01-17", 5),
         (6, 105, 1, 1, "2025-01-23", 6)],
        [(4, 109, None, 1, "2025-02-01", 9)],
    )
    found = run_to_files(spark, st_overdue(out, back, longest_days=longest), "overdue")
    # 2 and 6 came back late, 3 never; 1 and 5 were on time, and 4 and 7 are still within reach
    assert sorted(tuples(found)) == [
        (2, 101, at("2025-01-08")), (3, 102, at("2025-01-08")), (6, 105, at("2025-01-22"))]


def test_a_log_by_day_is_streamed(spark, table, tmp_path):
    path = str(tmp_path / "log")
    log = table("movements", (1, 7, None, 3, "2025-01-01 05:00:00", None),
                (2, 7, None, 3, "2025-01-02 05:00:00", None))
    write_log(log, path, "movements")
    copied = run_to_files(spark, stream_log(spark, path, "movements"), "copy")
    assert sorted(tuples(copied)) == sorted(tuples(log))


def test_results_go_to_the_shared_folder(spark, table, tmp_path):
    stream = feed(spark, table, tmp_path, "sensor_readings", [reading(1, 7, 36, "2025-01-01")])
    found = run_to_files(spark, st_latest_reading(stream), "place")
    shared = spark.conf.get("spark.checkpoint.dir")
    assert all(shared in f for f in found.inputFiles())


def test_only_a_local_session_may_use_a_local_folder():
    def session_on(master):
        context = SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda key, default: default), sparkContext=context)

    assert "looptrace-" in scratch_dir(session_on("local[8]"), "x")
    with pytest.raises(RuntimeError):
        scratch_dir(session_on("yarn"), "x")
