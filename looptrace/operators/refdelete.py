"""What a delete of parent rows does to the tables that refer to them.

The delete actions come from ``schemas.TABLES``.  Rows are never deleted in place: the
effects are a report, and ``apply_delete`` returns rewritten tables.
"""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.schemas import TABLES, Ref, Table

Tables = Mapping[str, DataFrame]


class DeleteBlocked(Exception):
    """Some rows still refer to the keys and forbid the delete."""


def _children(parent: str, tables: Tables) -> list[tuple[Table, Ref]]:
    return [
        (t, ref) for t in TABLES.values() if t.name in tables for ref in t.refs
        if ref.parent == parent
    ]


def _hit(tables: Tables, child: Table, ref: Ref, doomed: DataFrame) -> DataFrame:
    """Keys of the child's rows that refer to a doomed parent."""
    parents = doomed.withColumnRenamed("key", "_parent")
    return (
        tables[child.name]
        .select(F.col(child.key).alias("key"), F.col(ref.column).alias("_ref"))
        .filter("_ref IS NOT NULL")
        .join(parents, F.col("_ref") == F.col("_parent"), "left_semi")
        .select("key")
    )


def _walk(tables: Tables, root: str, keys: DataFrame):
    """Doomed keys per table, and the references to null or that block, parent to child."""
    doomed = {root: keys.select(F.col(keys.columns[0]).alias("key")).distinct()}
    nulled, blocked = [], []
    queue = [root]
    while queue:
        parent = queue.pop(0)
        for child, ref in _children(parent, tables):
            hit = _hit(tables, child, ref, doomed[parent])
            if ref.on_delete == "null":
                nulled.append((child, ref, hit))
            elif ref.on_delete == "block":
                blocked.append((child, ref, hit))
            else:
                before = doomed.get(child.name)
                doomed[child.name] = hit if before is None else before.union(hit).distinct()
                queue.append(child.name)
    # a row that goes away itself neither blocks nor needs a NULL
    gone = lambda child, hit: (
        hit.join(doomed[child.name], "key", "left_anti") if child.name in doomed else hit
    )
    return (
        doomed,
        [(c, r, gone(c, h)) for c, r, h in nulled],
        [(c, r, gone(c, h)) for c, r, h in blocked],
    )


def _effect(action: str, table: str, column: str | None, keys: DataFrame) -> DataFrame:
    return keys.select(
        F.lit(action).alias("action"),
        F.lit(table).alias("table"),
        F.lit(column).cast("string").alias("column"),
        "key",
    )


def ref_delete(tables: Tables, root: str, keys: DataFrame) -> DataFrame:
    """(action, table, column, key): rows to delete, references to null, rows that block.

    Any ``block`` row means that the whole delete must not happen.  ``keys`` has one column.
    """
    doomed, nulled, blocked = _walk(tables, root, keys)
    present = tables[root].select(F.col(TABLES[root].key).alias("key"))
    doomed[root] = present.join(doomed[root], "key", "left_semi")
    effects = [_effect("delete", name, None, rows) for name, rows in doomed.items()]
    effects += [_effect("null", c.name, r.column, rows) for c, r, rows in nulled]
    effects += [_effect("block", c.name, r.column, rows) for c, r, rows in blocked]
    return reduce(DataFrame.unionByName, effects)


def apply_delete(tables: Tables, root: str, keys: DataFrame) -> Tables:
    """The tables after the delete; raises ``DeleteBlocked`` and changes nothing if forbidden."""
    doomed, nulled, blocked = _walk(tables, root, keys)
    if blocked:
        named = [
            rows.select(F.lit(f"{c.name}.{r.column} still refers to {r.parent}").alias("why"))
            for c, r, rows in blocked
        ]
        found = reduce(DataFrame.union, named).first()
        if found:
            raise DeleteBlocked(found.why)
    after = ChainMap({}, tables)
    for child, ref, _ in nulled:
        parents = doomed[ref.parent].select(F.col("key").alias("_parent"), F.lit(True).alias("_gone"))
        df = after[child.name]
        pointing = (
            df.filter(F.col(ref.column).isNotNull())
            .join(parents, F.col(ref.column) == F.col("_parent"), "left")
            .withColumn(ref.column, F.when(F.col("_gone").isNull(), F.col(ref.column)))
            .select(df.columns)
        )
        after[child.name] = pointing.union(df.filter(F.col(ref.column).isNull()))
    for name, rows in doomed.items():
        key = TABLES[name].key
        gone = rows.withColumnRenamed("key", "_key")
        after[name] = after[name].join(gone, F.col(key) == F.col("_key"), "left_anti")
    return after
