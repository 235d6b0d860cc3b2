"""Reading logs as streams, and running a stream to files until its input is used up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from looptrace.schemas import TABLES
from looptrace.session import scratch_dir

# Large state belongs on disk, not on the heap, and only its changes are saved per batch.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def stream_log(
    spark: SparkSession, path: str, table: str, files_per_batch: int | None = None
) -> DataFrame:
    """A log folder, by day as ``write_log`` lays it out or flat, as a stream."""
    reader = spark.readStream.schema(TABLES[table].struct.add("event_date", "date"))
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path).drop("event_date")


def run_to_files(spark: SparkSession, stream: DataFrame, purpose: str) -> DataFrame:
    """Runs an append stream over all input present; result and progress go to shared files."""
    ours = [key for key in STATE_SETTINGS if spark.conf.get(key, None) is None]
    for key in ours:
        spark.conf.set(key, STATE_SETTINGS[key])
    folder = scratch_dir(spark, purpose)
    query = (
        stream.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{folder}/rows")
        .option("checkpointLocation", f"{folder}/progress")
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    finally:
        for key in ours:
            spark.conf.unset(key)
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")
