"""Tables and logs as files.

Logs are laid out for the reports that read them: a folder per event day, rows sorted by
key and time inside, so that day filters prune folders and key filters skip row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from looptrace.functions.timefn import AsOf
from looptrace.schemas import TABLES

# Fixed values: (key, time) by which each log is looked up.
LOG_ORDER = {
    "deposit_transactions": ("account_id", "created_at"),
    "checkouts": ("instance_id", "checkout_time"),
    "returns": ("instance_id", "return_time"),
    "wash_cycles": ("hub_id", "start_time"),
    "inspections": ("instance_id", "inspected_at"),
    "contamination_incidents": ("instance_id", "detected_at"),
    "sensor_readings": ("instance_id", "measured_at"),
    "movements": ("instance_id", "moved_at"),
    "audit_logs": ("entity_id", "created_at"),
}


def read_table(spark: SparkSession, path: str, table: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(TABLES[table].struct).format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> None:
    df.write.format(fmt).mode(mode).save(path)


def write_log(df: DataFrame, path: str, table: str, mode: str = "error") -> None:
    """Range partitions over (day, key, time) also split a day or a key that is very large."""
    key, at = LOG_ORDER[table]
    dated = df.withColumn("event_date", F.to_date(at))
    order = ["event_date", key, at]
    (
        dated.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .write.partitionBy("event_date")
        .mode(mode)
        .parquet(path)
    )


def read_log(
    spark: SparkSession, path: str, table: str, since: AsOf | None = None
) -> DataFrame:
    """A log written by ``write_log`` + event_date, without the days before ``since``.

    Reports that look back from a point in time use event_date to leave older days unread.
    """
    stored = TABLES[table].struct.add("event_date", "date")
    log = spark.read.schema(stored).parquet(path)
    if since is not None:
        log = log.filter(F.col("event_date") >= F.to_date(F.lit(str(since))))
    return log
