"""Logs that grow by batches: days are replaced as a whole, and a manifest says which files count.

A batch writes the days it touches anew, old rows and new ones, into folders of its own, and then puts
a manifest of all days in place under the next version's name.  That is the only step others see:
readers follow the newest manifest, so before it nothing has changed, and after it all has.  What a
broken batch wrote is in no manifest.  A manifest also names the batches that are in, so a batch that
is sent again is known and does nothing.  Of two writers that race for a version one finds the name
taken and starts over from the other's manifest.

Folders: days/event_date=<day>/batch_no=<version>/ and manifests/<version>.json.  A manifest has a line's
worth of text per day and per batch; rows never pass the driver.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from looptrace.functions.timefn import AsOf
from looptrace.operators.latest import newest
from looptrace.schemas import TABLES
from looptrace.session import stored
from looptrace.sources.files import LOG_ORDER

TRIES = 20  # times that a batch starts over because others were faster


class Taken(Exception):
    """Another writer has put a manifest of this version in place."""


@dataclass
class Manifest:
    version: int = 0
    days: dict[str, int] = field(default_factory=dict)  # day: version that wrote it
    batches: list[str] = field(default_factory=list)


class _Files:
    """The few small files of a log, in whatever store Spark reads."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.folder = self.path(f"{path.rstrip('/')}/manifests")
        self.store = self.folder.getFileSystem(self.conf)

    def path(self, text: str):
        return self.jvm.org.apache.hadoop.fs.Path(text)

    def names(self) -> list[str]:
        if not self.store.exists(self.folder):
            return []
        names = (s.getPath().getName() for s in self.store.listStatus(self.folder))
        return sorted(n for n in names if n.endswith(".json") and n[0] != ".")

    def read(self, name: str) -> str:
        stream = self.store.open(self.jvm.org.apache.hadoop.fs.Path(self.folder, name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def put(self, name: str, text: str, unique: str) -> None:
        """A whole file under a name that nobody has; `Taken` if somebody has it."""
        fs = self.jvm.org.apache.hadoop.fs
        aside = fs.Path(self.folder, f".{unique}")
        stream = self.store.create(aside, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        whole = self.store.makeQualified(self.folder)
        context = fs.FileContext.getFileContext(whole.toUri(), self.conf)
        never_over = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(aside, fs.Path(self.folder, name), never_over)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception.getClass().getName()):
                raise Taken(name) from None
            raise


def manifest(spark: SparkSession, path: str) -> Manifest:
    """The newest manifest of a log; an empty one if there is none."""
    files = _Files(spark, path)
    names = files.names()
    return Manifest(**json.loads(files.read(names[-1]))) if names else Manifest()


def _put(spark: SparkSession, path: str, new: Manifest, unique: str) -> None:
    text = json.dumps({"version": new.version, "days": new.days, "batches": new.batches})
    _Files(spark, path).put(f"{new.version:012d}.json", text, unique)


def read_days(
    spark: SparkSession,
    path: str,
    table: str,
    since: AsOf | None = None,
    until: AsOf | None = None,
    of: Manifest | None = None,
) -> DataFrame:
    """A log's rows + event_date, as its newest manifest says; only folders of the days from ``since``
    to ``until`` are read."""
    days = (of or manifest(spark, path)).days
    first, last = str(since or "")[:10], str(until or "9999")[:10]
    wanted = [
        f"{path.rstrip('/')}/days/event_date={day}/batch_no={n}"
        for day, n in sorted(days.items())
        if first <= day <= last
    ]
    struct = TABLES[table].struct.add("event_date", "date")
    if not wanted:
        return spark.createDataFrame([], struct)
    reader = spark.read.schema(struct).option("basePath", f"{path.rstrip('/')}/days")
    return reader.parquet(*wanted).drop("batch_no")


def _committed(
    spark: SparkSession, path: str, table: str, rows: DataFrame, batch: str, keep_old: bool, days=None
) -> Manifest:
    key, (group, at) = TABLES[table].key, LOG_ORDER[table]
    columns = [c.name for c in TABLES[table].columns]
    dated = stored(rows.select(*columns, F.to_date(at).alias("event_date")), "batch")
    if not dated.filter("event_date IS NULL").isEmpty():
        raise ValueError(f"rows of {table} without {at} have no day")
    touched = {str(r[0]) for r in dated.select("event_date").distinct().collect()}
    if days is not None:
        days = {str(d) for d in days}
        if touched - days:
            raise ValueError(f"rows of days that are not to be replaced: {sorted(touched - days)[:3]}")
    for _ in range(TRIES):
        old = manifest(spark, path)
        if batch in old.batches:
            return old
        version = old.version + 1
        new = Manifest(version, dict(old.days), [*old.batches, batch])
        for day in days or ():
            new.days.pop(day, None)
        if touched:
            together = dated.withColumn("_new", F.lit(1))
            if keep_old:
                before = Manifest(days={d: n for d, n in old.days.items() if d in touched})
                had = read_days(spark, path, table, of=before).withColumn("_new", F.lit(0))
                together = had.unionByName(together)
                # a row that is sent again, in this batch or an earlier one, takes the old one's place
                no_key = together.filter(F.col(key).isNull())
                together = together.filter(F.col(key).isNotNull())
                together = newest(together, ["event_date", key], ["_new", at, group]).drop("rank")
                together = together.unionByName(no_key)
            order = ["event_date", group, at]
            # two writers of one version never share a folder: the loser's is in no manifest
            number = version * 1_000_000 + _own_number(spark)
            (
                together.drop("_new")
                .withColumn("batch_no", F.lit(number))
                .repartitionByRange(*order)
                .sortWithinPartitions(*order)
                .write.partitionBy("event_date", "batch_no")
                .mode("append")
                .parquet(f"{path.rstrip('/')}/days")
            )
            new.days |= {day: number for day in touched}
        try:
            _put(spark, path, new, f"{version}-{_own_number(spark)}")
            return new
        except Taken:
            continue
    raise RuntimeError(f"{path}: no version was free in {TRIES} tries")


def _own_number(spark: SparkSession) -> int:
    return spark._jvm.java.util.concurrent.ThreadLocalRandom.current().nextInt(1_000_000)


def append_batch(spark: SparkSession, path: str, table: str, rows: DataFrame, batch: str) -> Manifest:
    """Adds a batch of rows of any days, late ones too.  A row with the key of another of its day
    replaces it.  A batch name that is in already changes nothing."""
    return _committed(spark, path, table, rows, batch, keep_old=True)


def replace_days(
    spark: SparkSession, path: str, table: str, rows: DataFrame, batch: str, days: list[str]
) -> Manifest:
    """Puts rows in place of all that the days had; a day without rows becomes empty."""
    return _committed(spark, path, table, rows, batch, keep_old=False, days=days)
