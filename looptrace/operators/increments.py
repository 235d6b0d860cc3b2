"""Checks of keys and references for new rows alone, against a stored index of all keys before them.

The index holds every value of primary keys and unique columns with its number of rows, in buckets by
hash, and beside them a Bloom filter per bucket: three bits of each value.  A batch's values are
looked for in the filters first, and only buckets that may hold one of them are read.  New ids
are in no filter but for a few by chance, so a day of a log meets hardly any of the index.

A filter of ten bits per value lets about 2 of 100 unknown values through; those cost a bucket that
is read in vain, never a wrong answer.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.schemas import TABLES
from looptrace.session import stored

Tables = Mapping[str, DataFrame]

BUCKETS = 256
BITS = 1 << 20  # of a bucket's filter
PROBES = 3
WORDS = 1 << 18  # of all filters together that are broadcast, some 25 MB
KEYS = "name string, value string, n bigint, bucket int"
FILTERS = "bucket int, word int, bits bigint"


def _text(*columns: str) -> Column:
    """A value, the first that is not NULL, as text; NULL, which counts as one value of a unique column, is
    the empty one."""
    each = (F.concat(F.lit("="), F.col(c).cast("string")) for c in columns)
    return F.coalesce(*each, F.lit(""))


def _entries(tables: Tables, parents: set[str]) -> DataFrame:
    """(name, value, table, key, column) of keys and unique columns, where the last three are NULL, and of
    references to ``parents``; each table is read once.  Missing keys are left to ``dq_not_null``."""

    def entry(name: str, column: str, *link: Column) -> Column:
        link = link or (F.lit(None).cast("string"),) * 3
        named = (c.alias(x) for c, x in zip(link, ("table", "key", "column")))
        return F.struct(F.lit(name).alias("name"), _text(column).alias("value"), *named)

    parts = []
    for name, df in tables.items():
        spec = TABLES[name]
        found = [F.when(F.col(spec.key).isNotNull(), entry(f"{name}.{spec.key}", spec.key))]
        found += [entry(f"{name}.{column}", column) for column in spec.unique]
        for ref in spec.refs:
            if ref.parent in parents:
                link = F.lit(name), F.col(spec.key).cast("string"), F.lit(ref.column)
                of = entry(f"{ref.parent}.{TABLES[ref.parent].key}", ref.column, *link)
                found.append(F.when(F.col(ref.column).isNotNull(), of))
        parts.append(df.select(F.inline(F.array_compact(F.array(*found)))))
    return reduce(DataFrame.unionByName, parts)


def _values(tables: Tables) -> DataFrame:
    """(name, value, n) of keys and unique columns; whole numbers are counted as such and not as texts."""
    names, parts = [], []
    for name, df in tables.items():
        spec, found = TABLES[name], []
        for column in (spec.key, *spec.unique):
            value = F.col(column)
            number = isinstance(df.schema[column].dataType, T.IntegralType)
            each = F.struct(
                F.lit(len(names)).alias("at"),
                (value.cast("bigint") if number else F.lit(None).cast("bigint")).alias("number"),
                (F.lit(None).cast("string") if number else value.cast("string")).alias("text"),
            )
            found.append(each if column != spec.key else F.when(value.isNotNull(), each))
            names.append(f"{name}.{column}")
        parts.append(df.select(F.inline(F.array_compact(F.array(*found)))))
    counted = reduce(DataFrame.unionByName, parts).groupBy("at", "number", "text").agg(F.count("*").alias("n"))
    name = F.array(*map(F.lit, names))[F.col("at")]
    return counted.select(name.alias("name"), _text("number", "text").alias("value"), "n")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("name", "value"), F.lit(buckets)).cast("int").alias("bucket")


def _bit(probe: int, bits: int) -> Column:
    """One of a value's bits in its bucket's filter."""
    return F.pmod(F.xxhash64(F.lit(probe), "value", "name"), F.lit(bits)).cast("int")


def _mask(bit: Column) -> Column:
    return F.expr("shiftleft(1L, bit & 63)")


def create_index(
    spark: SparkSession, path: str, tables: Tables, buckets: int = BUCKETS, bits: int = BITS
) -> None:
    """An index of the rows of ``tables``; its sizes stay, so choose them for all rows to come."""
    names = sorted(tables)
    about = spark.createDataFrame([(buckets, bits, names)], "buckets int, bits int, tables array<string>")
    about.coalesce(1).write.parquet(f"{path}/about")
    add_to_index(spark, path, tables)


def _about(spark: SparkSession, path: str):
    return spark.read.schema("buckets int, bits int, tables array<string>").parquet(f"{path}/about").first()


def add_to_index(spark: SparkSession, path: str, tables: Tables) -> None:
    """Adds the rows of a batch that was checked, once."""
    about = _about(spark, path)
    counted = stored(_values(tables).withColumn("bucket", _bucket(about.buckets)), "keys")
    # a bucket is in as many pieces as there are tasks to share it, and each piece in one file
    pieces = 1 + int(spark.conf.get("spark.sql.shuffle.partitions")) // about.buckets
    (
        counted.repartition("bucket", F.pmod(F.xxhash64("value"), F.lit(pieces)))
        .sortWithinPartitions("bucket")
        .write.partitionBy("bucket")
        .mode("append")
        .parquet(f"{path}/keys")
    )
    bits = (_bit(i, about.bits) for i in range(PROBES))
    bit = counted.select("bucket", F.explode(F.array(*bits)).alias("bit"))
    words = bit.select("bucket", F.shiftright("bit", 6).alias("word"), _mask("bit").alias("mask"))
    words = words.groupBy("bucket", "word").agg(F.bit_or("mask").alias("bits"))
    words.write.mode("append").parquet(f"{path}/filters")


def maybe_known(spark: SparkSession, path: str, values: DataFrame) -> DataFrame:
    """(name, value, bucket) of those values that the filters don't rule out."""
    about = _about(spark, path)
    filters = spark.read.schema(FILTERS).parquet(f"{path}/filters")
    filters = filters.groupBy("bucket", "word").agg(F.bit_or("bits").alias("bits"))
    # the filters' size is fixed; that of the values' files must not make them be broadcast
    filters = filters.hint("broadcast" if about.buckets * about.bits // 64 <= WORDS else "merge")
    asked = values.select("name", "value", _bucket(about.buckets))
    for i in range(PROBES):  # one after the other: what a bit rules out is not asked for the next
        probe = asked.withColumn("bit", _bit(i, about.bits))
        probe = probe.withColumns({"word": F.shiftright("bit", 6), "mask": _mask("bit")})
        asked = probe.join(filters, ["bucket", "word"]).filter("bits & mask <> 0")
        asked = asked.select("name", "value", "bucket")
    return asked


def index_buckets(spark: SparkSession, path: str, buckets: list[int]) -> DataFrame:
    """The index's rows in some buckets; folders of others are not read."""
    keys = spark.read.schema(KEYS).parquet(f"{path}/keys")
    return keys.filter(F.col("bucket").isin(buckets) if buckets else F.lit(False))


def known(spark: SparkSession, path: str, values: DataFrame) -> DataFrame:
    """(name, value, before): in how many indexed rows each of the values is; others are left out."""
    maybe = stored(maybe_known(spark, path, values), "maybe")
    buckets = sorted(r[0] for r in maybe.select("bucket").distinct().collect())  # BUCKETS at most
    # merged, whatever the files' sizes: values are many times larger in memory
    asked = maybe.select("value", "name").hint("merge")
    held = index_buckets(spark, path, buckets).join(asked, ["value", "name"], "left_semi")
    return held.groupBy("value", "name").agg(F.sum("n").alias("before"))


def check_increment(spark: SparkSession, path: str, tables: Tables) -> DataFrame:
    """(rule, table, key, detail): what the new rows of ``tables`` violate, as ``dq_primary_key``,
    ``dq_unique`` and ``dq_foreign_key`` over all rows would say of them.

    Repeated values are reported with the rows of old and new together.  References are looked for
    among old and new parents; those to tables that are neither in the index nor here are skipped.
    """
    parents = set(_about(spark, path).tables) | set(tables)
    entries = stored(_entries(tables, parents), "entries")
    is_link = F.col("column").isNotNull()
    counted = entries.groupBy("name", "value").agg(
        F.count_if(~is_link).alias("n"), F.count_if(is_link).alias("links"))
    counted = stored(counted, "values")
    before = known(spark, path, counted.select("name", "value")).hint("merge")
    total = F.col("n") + F.coalesce("before", F.lit(0))
    # a key or unique value that repeats, or a reference without a parent
    wrong = "n > 0 AND total > 1 OR links > 0 AND total = 0"
    judged = counted.join(before, ["value", "name"], "left").withColumn("total", total).filter(wrong)
    judged = stored(judged, "judged")
    table, column = F.substring_index("name", ".", 1), F.substring_index("name", ".", -1)
    is_key = F.col("name").isin([f"{name}.{TABLES[name].key}" for name in tables])
    rows = F.concat(F.col("total").cast("string"), F.lit(" rows"))
    repeated = judged.filter("total > 1").select(
        F.when(is_key, "primary_key").otherwise("unique").alias("rule"),
        table.alias("table"),
        F.when(F.col("value") != "", F.substring("value", 2, 1 << 30)).alias("key"),
        F.when(is_key, rows).otherwise(F.concat(column, F.lit(": "), rows)).alias("detail"),
    )
    orphans = judged.filter("total = 0").select("value", "name").hint("merge")
    missing = entries.filter(is_link).join(orphans, ["value", "name"], "left_semi")
    detail = F.concat("column", F.lit(" -> "), table, F.lit(": "), F.substring("value", 2, 1 << 30))
    return repeated.unionByName(
        missing.select(F.lit("foreign_key").alias("rule"), "table", "key", detail.alias("detail"))
    )
