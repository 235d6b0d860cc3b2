"""Typed loading of raw files: every raw column is text until it has been cast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.functions.timefn import AsOf
from looptrace.schemas import NOW, TABLES, Column
from looptrace.sources.files import LOG_ORDER, write_log, write_table


RECORD = "_record"  # the text of a record that is no row of its file


def read_raw(
    spark: SparkSession,
    path: str,
    table: str,
    fmt: str = "csv",
    columns: list[str] | None = None,
) -> DataFrame:
    """A csv (with header) or json file as text: those of the table's columns that it has, and
    ``_record``, the whole text of a record with too few or too many fields or without an end.

    The names come from the header of a csv file, which all its parts must share.  A json
    file is read once more to find them, unless ``columns`` names them.
    """
    wanted = [c.name for c in TABLES[table].columns]
    first = spark.read.option("primitivesAsString", True).option("header", True).format(fmt)
    if fmt == "csv":
        names = first.load(path).columns
    else:
        names = columns if columns is not None else first.load(path).columns
    text = T.StructType([T.StructField(c, T.StringType()) for c in [*names, RECORD]])
    rows = (
        spark.read.format(fmt)
        .schema(text)
        .options(header=True, enforceSchema=False, mode="PERMISSIVE", columnPruning=False)
        .option("columnNameOfCorruptRecord", RECORD)
        .load(path)
    )
    return rows.select(*(c for c in columns or wanted if c in names), RECORD)


def _value(c: Column):
    """The typed value, NULL where the text does not fit.

    A failed cast to a whole number costs Spark an exception, so a pattern goes first.
    """
    cast = F.col(c.name).try_cast(c.type)
    if isinstance(c.type, T.IntegralType):
        return F.when(F.col(c.name).rlike(r"^\s*[+-]?\d+\s*$"), cast)
    return cast


def _cast(raw: DataFrame, table: str) -> DataFrame:
    """Raw columns + ``typed`` struct + ``faults``, the columns whose text does not fit; of a
    record that is no row, ``record`` alone."""
    columns = [c for c in TABLES[table].columns if c.name in raw.columns]
    whole = F.col(RECORD).isNull() if RECORD in raw.columns else F.lit(True)
    typed = F.struct(*(_value(c).alias(c.name) for c in columns))
    unfit = [
        F.when(F.col(c.name).isNotNull() & _value(c).isNull(), F.lit(c.name)) for c in columns
    ]
    faults = F.when(whole, F.array_compact(F.array(*unfit))).otherwise(F.array(F.lit("record")))
    shown = [F.when(whole, F.col(c)).alias(c) for c in raw.columns if c != RECORD]
    shown += [F.col(RECORD).alias("record")] * (RECORD in raw.columns)
    return raw.select(*shown, typed.alias("typed"), faults.alias("faults"))


def typed_rows(raw: DataFrame, table: str) -> DataFrame:
    """Rows all of whose values fit their column's type."""
    return _cast(raw, table).filter("size(faults) = 0").select("typed.*")


def rejected_rows(raw: DataFrame, table: str) -> DataFrame:
    """The other rows, as they came, with ``faults`` naming the columns that do not fit; records
    that are no rows have their text in ``record`` and nothing else."""
    out = _cast(raw, table).filter("size(faults) > 0").drop("typed")
    return out.withColumn("faults", F.array_join("faults", ","))


def with_defaults(
    df: DataFrame, table: str, as_of: AsOf, replace_null: bool = False
) -> DataFrame:
    """Adds the columns the file lacks: the declared default, else NULL where allowed.

    A NULL that is present stays, unless ``replace_null`` asks for the default there too.
    """
    out = []
    for c in TABLES[table].columns:
        value = F.lit(str(as_of) if c.default is NOW else c.default).cast(c.type)
        if c.name in df.columns:
            fill = replace_null and c.default is not None
            out.append((F.coalesce(c.name, value) if fill else F.col(c.name)).alias(c.name))
        elif c.default is None and not c.null:
            raise ValueError(f"{table}.{c.name} is missing and has no default")
        else:
            out.append(value.alias(c.name))
    return df.select(*out)


def load_file(
    spark: SparkSession,
    raw_path: str,
    table: str,
    path: str,
    rejects_path: str,
    as_of: AsOf,
    fmt: str = "csv",
) -> None:
    """Raw file -> typed table with defaults at ``path``, and what does not fit, as text, apart.

    Logs are laid out by day.  A column that is absent from the whole file gets its default.
    """
    raw = read_raw(spark, raw_path, table, fmt)
    rejected_rows(raw, table).write.json(rejects_path)
    good = with_defaults(typed_rows(raw, table), table, as_of)
    if table in LOG_ORDER:
        write_log(good, path, table)
    else:
        write_table(good, path)
