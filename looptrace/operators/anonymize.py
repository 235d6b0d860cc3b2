"""Exports for research: pseudonymous ids, and no row that can be singled out.

``anonymize`` makes places and times coarse and leaves small groups out; ``generalize`` keeps all rows
and gives each group of k alike rows the ranges of its values instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from looptrace.operators.mondrian import code, grouped
from looptrace.schemas import TABLES
from looptrace.session import stored

# What may identify somebody is left out, and the coarse columns by which a
# row could still be singled out must be shared by at least k rows.
DROPPED = {
    "locations": ("name", "address"),
    "retailers": ("contact_email",),
    "customers": ("name", "email", "phone"),
    "packaging_catalog": ("sku",),
    "packaging_instances": ("uid_code",),
    "wash_cycles": ("batch_code",),
    "inspections": ("inspector", "notes"),
    "contamination_incidents": ("description",),
    "movements": ("note",),
    "audit_logs": ("detail",),
}
SINGLED_OUT_BY = {
    "locations": ("kind", "lat", "lng"),
    "hubs": ("washer_model",),
    "customers": ("created_at",),
    "packaging_catalog": ("kind", "material"),
    "packaging_instances": ("state", "birthed_at", "retired_at"),
    "deposit_accounts": ("balance_cents",),
    "deposit_transactions": ("reason", "delta_cents", "created_at"),
    "checkouts": ("retailer_id", "checkout_time"),
    "returns": ("location_id", "return_time"),
    "wash_cycles": ("hub_id", "start_time", "end_time"),
    "inspections": ("result", "inspected_at"),
    "contamination_incidents": ("kind", "severity", "detected_at"),
    "sensor_readings": ("sensor_type", "value", "measured_at"),
    "movements": ("to_loc_id", "moved_at"),
    "audit_logs": ("entity_type", "event_type", "created_at"),
}
# Amounts and readings that would single a row out are cut down to whole steps.
STEPS = {"balance_cents": 10_000, "delta_cents": 1_000, "value": 5, "temp_c": 5, "capacity_ml": 100}


def pseudonym(domain: str, salt: str, value: Column) -> Column:
    """Same id and domain, same pseudonym, so exported tables still join."""
    return F.sha2(F.concat(F.lit(f"{salt}|{domain}|"), value.cast("string")), 256)


def _id_domains(table: str) -> dict[str, str]:
    """Id column -> the domain its pseudonyms belong to, that of the table it points to."""
    spec = TABLES[table]
    domains = {spec.key: table, "entity_id": "entity_id", "ref_id": "ref_id"}
    return domains | {ref.column: ref.parent for ref in spec.refs}


def _coarse(column: str, kind: T.DataType, unit: str) -> Column:
    if column in ("lat", "lng"):
        return F.round(F.col(column).cast("double"), 2)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_trunc(unit, F.col(column))
    if column in STEPS:
        step = STEPS[column]
        return (F.floor(F.col(column) / step) * step).cast("bigint")
    return F.col(column)


def anonymize(table: str, df: DataFrame, salt: str, k: int = 5, unit: str = "day") -> DataFrame:
    """One table for export.  Rows of groups below ``k`` are left out."""
    dropped = (*DROPPED.get(table, ()), "event_date")
    fields = [f for f in df.schema.fields if f.name not in dropped]
    out = df.select(*(_coarse(f.name, f.dataType, unit).alias(f.name) for f in fields))
    group = [c for c in SINGLED_OUT_BY.get(table, ()) if c in out.columns]
    if group:
        # few rows are in small groups, so those are listed and not the large ones
        small = out.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") < k)
        small = small.select(*(F.col(c).alias(f"_{c}") for c in group))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in group]
        out = out.join(small, same, "left_anti")
    # pseudonyms come last: the join above moves short ids, not long digests
    return _pseudonymous(table, out, salt)


def _pseudonymous(table: str, out: DataFrame, salt: str) -> DataFrame:
    domains = _id_domains(table)
    return out.select(
        *(
            pseudonym(domains[c], salt, F.col(c)).alias(c) if c in domains else F.col(c)
            for c in out.columns
        )
    )


def _is_range(table: str, column: str, kind: T.DataType) -> bool:
    """Whether a group shows a column's range; of ids, texts and flags only a value all share."""
    return column not in _id_domains(table) and not isinstance(kind, (T.StringType, T.BooleanType))


def generalize(
    table: str,
    df: DataFrame,
    salt: str,
    k: int = 5,
    unit: str = "day",
    leaf: int | None = None,
) -> DataFrame:
    """One table for export, with every row.  The columns that might single a row out are the same
    in each group of ``k`` rows or more: numbers and times become ``<column>_from`` and ``_to``, ids and
    texts stay where the group shares one and are NULL elsewhere.  A table of fewer rows than
    ``k`` is empty."""
    dropped = (*DROPPED.get(table, ()), "event_date")
    fields = [f for f in df.schema.fields if f.name not in dropped]
    single = [c for c in SINGLED_OUT_BY.get(table, ()) if c in {f.name for f in fields}]
    if not single:
        return anonymize(table, df, salt, k, unit)
    rows = df.select(*(f.name for f in fields)).withColumn("_row", F.monotonically_increasing_id())
    rows = stored(rows, "export")  # numbers that stay
    groups = grouped(rows, "_row", single, k, leaf)
    # files of rows and groups are far smaller than they are in memory: their size must not make them
    # be broadcast
    member = stored(groups.join(rows.hint("merge"), "_row"), "groups")
    shown = []
    for c in single:
        if _is_range(table, c, rows.schema[c].dataType):
            shown += [F.min(c).alias(f"{c}_from"), F.max(c).alias(f"{c}_to")]
        else:
            same = (F.min(c) == F.max(c)) & (F.count(c) == F.count("*"))
            shown.append(F.when(same, F.min(c)).alias(c))
    ranges = member.groupBy("part", "grp").agg(*shown)
    others = [_coarse(f.name, f.dataType, unit).alias(f.name) for f in fields if f.name not in single]
    out = member.select("part", "grp", *others).join(ranges.hint("merge"), ["part", "grp"])
    out = out.drop("part", "grp")
    return _pseudonymous(table, out, salt)


def generalized_export(
    tables: dict[str, DataFrame], salt: str, k: int = 5, unit: str = "day"
) -> dict[str, DataFrame]:
    return {name: generalize(name, df, salt, k, unit) for name, df in tables.items()}


# Days of the units that times are cut down to.
UNIT_DAYS = {"day": 1, "week": 7, "month": 30, "quarter": 91, "year": 365}


def export_loss(table: str, df: DataFrame, export: DataFrame, unit: str = "day") -> float:
    """What an export of ``df`` loses, from 0 to 1: over all rows and columns that single rows out, the
    mean share of the column's range that the export leaves open; a row left out loses all."""
    single = [c for c in SINGLED_OUT_BY.get(table, ()) if c in df.columns]
    rows = df.count()
    if not single or not rows:
        return 0.0
    lost = []
    for c in single:
        kind = df.schema[c].dataType
        if not _is_range(table, c, kind):
            lost.append(F.col(c).isNull().cast("double"))
            continue
        width = df.select(code(c, kind).alias("x")).agg(F.max("x") - F.min("x")).first()[0] or 1.0
        if f"{c}_from" in export.columns:
            ends = [code(f"{c}_{end}", kind) for end in ("to", "from")]
            lost.append((ends[0] - ends[1]) / width)
        else:
            timed = isinstance(kind, (T.TimestampType, T.TimestampNTZType))
            open_range = 86_400 * UNIT_DAYS[unit] if timed else STEPS.get(c, 0.01)
            lost.append(F.lit(min(1.0, open_range / width)))
    of_row = sum((F.coalesce(x, F.lit(1.0)) for x in lost), F.lit(0.0)) / len(lost)
    kept = export.agg(F.sum(of_row), F.count("*")).first()
    return ((kept[0] or 0.0) + rows - kept[1]) / rows


def anonymized_export(
    tables: dict[str, DataFrame], salt: str, k: int = 5, unit: str = "day"
) -> dict[str, DataFrame]:
    return {name: anonymize(name, df, salt, k, unit) for name, df in tables.items()}
