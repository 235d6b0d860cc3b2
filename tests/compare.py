"""Runs registered queries on Spark and their SQL on DuckDB and compares all rows."""

from __future__ import annotations

import sys
import time
from datetime import date, datetime
from decimal import Decimal

import duckdb
from pyspark.sql import SparkSession

import __spark_entry__ as entry

SOURCES = ("region nation customer supplier part orders lineitem events documents embeddings"
           " pages benchmark labels conversations").split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in SOURCES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return ("number", str(value.normalize() + 0))
    if isinstance(value, datetime):
        return ("time", value.isoformat())
    if isinstance(value, date):
        return ("date", value.isoformat())
    return (type(value).__name__, repr(value))


def rows(columns: list[str], values) -> list:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(row[i]) for i in order) for row in values)


def difference(spark: SparkSession, con: duckdb.DuckDBPyConnection, name: str, folder: str) -> str:
    """Empty when the query and its SQL agree on columns and rows."""
    df = entry.queries()[name](spark, folder)
    got = df.collect()
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    want = found.fetchall()
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(columns)}"
    mine, theirs = rows(df.columns, got), rows(columns, want)
    if mine == theirs:
        return ""
    only_mine = sorted(set(mine) - set(theirs))[:2]
    only_theirs = sorted(set(theirs) - set(mine))[:2]
    return f"{len(mine)} rows against {len(theirs)}; {only_mine} against {only_theirs}"


if __name__ == "__main__":
    from looptrace.session import session

    folder, only = sys.argv[1], sys.argv[2:]
    spark = session(master="local[8]", **{"spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in only or list(entry.queries()):
        start = time.time()
        if name not in entry.oracle_sql():
            print(f"{name:30s} no SQL")
            continue
        try:
            diff = difference(spark, con, name, folder)
        except Exception as error:
            diff = f"{type(error).__name__}: {str(error)[:800]}"
        bad += bool(diff)
        print(f"{name:30s} {time.time() - start:6.2f}s {diff or 'ok'}", flush=True)
    print("different:", bad)
