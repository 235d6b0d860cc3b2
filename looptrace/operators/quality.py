"""Integrity rules as checks on data at rest: each returns the violations it finds.

All rules come from ``schemas.TABLES``; every check takes a mapping of DataFrames by table
name, skips tables that are not given, and returns (rule, table, key, detail).
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.schemas import TABLES, Table

Tables = Mapping[str, DataFrame]


def _report(df: DataFrame, rule: str, table: str, key: str, detail: str) -> DataFrame:
    """``rule``, ``key`` and ``detail`` are SQL expressions over ``df``."""
    return df.selectExpr(
        f"{rule} AS rule", f"'{table}' AS table", f"CAST({key} AS STRING) AS key",
        f"{detail} AS detail",
    )


def _given(tables: Tables) -> list[tuple[Table, DataFrame]]:
    return [(TABLES[name], df) for name, df in tables.items()]


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, parts)


def _broken(df: DataFrame, rule: str, conditions: dict[str, str], table: Table) -> DataFrame:
    """One pass over a table: a violation per row and named condition that holds."""
    tests = ", ".join(f"IF({bad}, '{name}', NULL)" for name, bad in conditions.items())
    found = df.selectExpr(
        f"{table.key} AS _key", f"explode(array_compact(array({tests}))) AS _name"
    )
    return _report(found, f"'{rule}'", table.name, "_key", "_name")


def dq_not_null(tables: Tables) -> DataFrame:
    return _all(
        [
            _broken(df, "not_null", {c: f"{c} IS NULL" for c in t.required}, t)
            for t, df in _given(tables)
        ]
    )


def _repeated(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).filter("n > 1")


def dq_primary_key(tables: Tables) -> DataFrame:
    """Keys on more than one row; missing keys are left to ``dq_not_null``."""
    return _all(
        [
            _report(
                _repeated(df.filter(f"{t.key} IS NOT NULL"), t.key),
                "'primary_key'", t.name, t.key, "concat(n, ' rows')",
            )
            for t, df in _given(tables)
        ]
    )


def dq_unique(tables: Tables) -> DataFrame:
    """Repeated values of unique columns; NULL counts as one value."""
    return _all(
        [
            _report(
                _repeated(df, column),
                "'unique'", t.name, column, f"concat('{column}: ', n, ' rows')",
            )
            for t, df in _given(tables)
            for column in t.unique
        ]
    )


def dq_check(tables: Tables) -> DataFrame:
    """Allowed values, ranges and text lengths; a rule with an unknown result passes."""
    parts = []
    for t, df in _given(tables):
        rules = {c.name: c.predicate for c in t.checks}
        rules |= {f"{c.name}_length": f"length({c.name}) <= {c.size}" for c in t.columns if c.size}
        if rules:
            broken = {name: f"NOT coalesce({rule}, true)" for name, rule in rules.items()}
            parts.append(_broken(df, "check", broken, t))
    return _all(parts)


def dq_foreign_key(tables: Tables) -> DataFrame:
    """Rows that point to a parent which does not exist."""
    links, parents = [], {}
    for t, df in _given(tables):
        refs = [ref for ref in t.refs if ref.parent in tables]
        if refs:
            each = ", ".join(
                f"named_struct('column', '{r.column}', 'parent', '{r.parent}',"
                f" 'value', CAST({r.column} AS BIGINT))"
                for r in refs
            )
            found = df.selectExpr(f"CAST({t.key} AS STRING) AS key", f"inline(array({each}))")
            links.append(found.withColumn("table", F.lit(t.name)).filter("value IS NOT NULL"))
        for ref in refs:
            parents[ref.parent] = tables[ref.parent].selectExpr(
                f"'{ref.parent}' AS parent", f"CAST({TABLES[ref.parent].key} AS BIGINT) AS value"
            )
    # the values that no parent has are few; only they meet the rows again
    named = reduce(DataFrame.unionByName, links)
    known = reduce(DataFrame.unionByName, parents.values())
    values = named.select("parent", "value").distinct()
    orphans = values.join(known, ["parent", "value"], "left_anti")
    detail = F.concat("column", F.lit(" -> "), "parent", F.lit(": "), F.col("value").cast("string"))
    return named.join(orphans, ["parent", "value"]).select(
        F.lit("foreign_key").alias("rule"), "table", "key", detail.alias("detail")
    )


# Kinds of place each role may use.
ROLE_KINDS = {
    "retailers": ("retailer",),
    "hubs": ("hub",),
    "returns": ("retailer", "dropbox"),
}


def dq_role_kind(tables: Tables) -> DataFrame:
    """Retailers, hubs and returns at a place of the wrong kind."""
    places = tables["locations"].selectExpr("location_id", "kind AS _kind")
    parts = []
    for name, kinds in ROLE_KINDS.items():
        if name in tables:
            wrong = F.col("_kind").isNotNull() & ~F.col("_kind").isin(*kinds)
            misplaced = tables[name].join(places.filter(wrong), "location_id")
            key = TABLES[name].key
            parts.append(_report(misplaced, "'role_kind'", name, key, "concat('at a ', _kind)"))
    return _all(parts)


def dq_temporal(tables: Tables) -> DataFrame:
    """Ends before starts: returns, washes and retirements."""
    loans = tables["checkouts"].select("checkout_id", "checkout_time")
    backs = tables["returns"].filter("checkout_id IS NOT NULL")
    backs = backs.select("return_id", "checkout_id", "return_time").join(loans, "checkout_id")
    washes, items = tables["wash_cycles"], tables["packaging_instances"]
    return _all(
        [
            _report(
                backs.filter("return_time < checkout_time"),
                "'temporal'", "returns", "return_id", "'returned before its checkout'",
            ),
            _report(
                washes.filter("end_time < start_time"),
                "'temporal'", "wash_cycles", "wash_id", "'ended before its start'",
            ),
            _report(
                items.filter("retired_at < birthed_at"),
                "'temporal'", "packaging_instances", "instance_id",
                "'retired before its birth'",
            ),
        ]
    )
