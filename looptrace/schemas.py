"""The sixteen tables of a packaging loop: columns, keys and integrity rules.

Everything in ``TABLES`` is fixed values: names, types, lengths, defaults, keys,
allowed values and delete actions are the data model that the reports, the quality
checks and the loaders share.  Money is integer cents, times are UTC.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

LONG, INT, TINY = T.LongType(), T.IntegerType(), T.ByteType()
TEXT, TIME = T.StringType(), T.TimestampType()

NOW = object()  # default that stands for the load's ``as_of``


@dataclass(frozen=True)
class Column:
    name: str
    type: T.DataType
    null: bool = False
    size: int | None = None  # longest text allowed
    default: object = None


@dataclass(frozen=True)
class Ref:
    """Foreign key ``column`` -> key of ``parent``; ``on_delete`` is block, cascade or null."""

    column: str
    parent: str
    on_delete: str


@dataclass(frozen=True)
class Check:
    """A named rule over one row, written as a Spark SQL predicate; unknown passes."""

    name: str
    predicate: str


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    unique: tuple[str, ...] = ()
    checks: tuple[Check, ...] = ()
    refs: tuple[Ref, ...] = ()

    @property
    def key(self) -> str:
        return self.columns[0].name

    @property
    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.type, c.null) for c in self.columns])

    @property
    def required(self) -> list[str]:
        return [c.name for c in self.columns if not c.null]


def one_of(column: str, values: tuple[str, ...]) -> Check:
    listed = ", ".join(f"'{v}'" for v in values)
    return Check(f"{column}_allowed", f"{column} IN ({listed})")


# --- fixed values -----------------------------------------------------------------
PLACE_KINDS = ("retailer", "hub", "dropbox")
ITEM_KINDS = ("cup", "box", "jar")
ITEM_STATES = (
    "available", "in_use", "at_retailer", "at_hub",
    "washing", "damaged", "lost", "retired",
)
INSPECTION_RESULTS = ("pass", "fail")
INCIDENT_KINDS = ("microbial", "chemical", "foreign_matter")
SENSOR_TYPES = ("temperature", "humidity", "shock")

_C = Column

TABLES: dict[str, Table] = {
    t.name: t
    for t in (
        Table(
            "locations",
            (
                _C("location_id", LONG),
                _C("name", TEXT, size=120),
                _C("kind", TEXT, size=20),
                _C("address", TEXT, null=True, size=255),
                _C("lat", T.DecimalType(9, 6), null=True),
                _C("lng", T.DecimalType(9, 6), null=True),
            ),
            unique=("name",),
            checks=(one_of("kind", PLACE_KINDS),),
        ),
        Table(
            "retailers",
            (
                _C("retailer_id", LONG),
                _C("location_id", LONG),
                _C("contact_email", TEXT, null=True, size=190),
            ),
            unique=("location_id",),
            refs=(Ref("location_id", "locations", "block"),),
        ),
        Table(
            "hubs",
            (
                _C("hub_id", LONG),
                _C("location_id", LONG),
                _C("washer_model", TEXT, null=True, size=80),
            ),
            unique=("location_id",),
            refs=(Ref("location_id", "locations", "block"),),
        ),
        Table(
            "customers",
            (
                _C("customer_id", LONG),
                _C("name", TEXT, size=120),
                _C("email", TEXT, null=True, size=190),
                _C("phone", TEXT, null=True, size=40),
                _C("created_at", TIME, default=NOW),
            ),
            unique=("email",),
        ),
        Table(
            "packaging_catalog",
            (
                _C("catalog_id", LONG),
                _C("sku", TEXT, null=True, size=64),
                _C("kind", TEXT, size=20),
                _C("material", TEXT, size=30),
                _C("capacity_ml", INT, null=True),
                _C("deposit_amount_cents", INT),
            ),
            unique=("sku",),
            checks=(
                one_of("kind", ITEM_KINDS),
                Check("deposit_not_negative", "deposit_amount_cents >= 0"),
            ),
        ),
        Table(
            "packaging_instances",
            (
                _C("instance_id", LONG),
                _C("catalog_id", LONG),
                _C("uid_code", TEXT, size=64),
                _C("state", TEXT, size=20, default="available"),
                _C("birthed_at", TIME, default=NOW),
                _C("retired_at", TIME, null=True),
            ),
            unique=("uid_code",),
            checks=(one_of("state", ITEM_STATES),),
            refs=(Ref("catalog_id", "packaging_catalog", "block"),),
        ),
        Table(
            "deposit_accounts",
            (
                _C("account_id", LONG),
                _C("customer_id", LONG),
                _C("balance_cents", INT, default=0),
            ),
            unique=("customer_id",),
            refs=(Ref("customer_id", "customers", "cascade"),),
        ),
        Table(
            "deposit_transactions",
            (
                _C("tx_id", LONG),
                _C("account_id", LONG),
                _C("delta_cents", INT),
                _C("reason", TEXT, size=120),
                _C("ref_table", TEXT, null=True, size=40),
                _C("ref_id", LONG, null=True),
                _C("created_at", TIME, default=NOW),
            ),
            refs=(Ref("account_id", "deposit_accounts", "cascade"),),
        ),
        Table(
            "checkouts",
            (
                _C("checkout_id", LONG),
                _C("instance_id", LONG),
                _C("retailer_id", LONG),
                _C("customer_id", LONG),
                _C("checkout_time", TIME, default=NOW),
                _C("due_back_days", INT, default=7),
            ),
            refs=(
                Ref("instance_id", "packaging_instances", "block"),
                Ref("retailer_id", "retailers", "block"),
                Ref("customer_id", "customers", "block"),
            ),
        ),
        Table(
            "returns",
            (
                _C("return_id", LONG),
                _C("instance_id", LONG),
                _C("customer_id", LONG, null=True),
                _C("location_id", LONG),
                _C("return_time", TIME, default=NOW),
                _C("checkout_id", LONG, null=True),
            ),
            refs=(
                Ref("instance_id", "packaging_instances", "block"),
                Ref("customer_id", "customers", "null"),
                Ref("location_id", "locations", "block"),
                Ref("checkout_id", "checkouts", "null"),
            ),
        ),
        Table(
            "wash_cycles",
            (
                _C("wash_id", LONG),
                _C("hub_id", LONG),
                _C("batch_code", TEXT, size=40),
                _C("start_time", TIME, default=NOW),
                _C("end_time", TIME, null=True),
                _C("temp_c", T.DecimalType(5, 2), null=True),
                _C("detergent", TEXT, null=True, size=40),
            ),
            refs=(Ref("hub_id", "hubs", "block"),),
        ),
        Table(
            "inspections",
            (
                _C("inspection_id", LONG),
                _C("instance_id", LONG),
                _C("wash_id", LONG, null=True),
                _C("inspector", TEXT, null=True, size=80),
                _C("result", TEXT, size=12),
                _C("notes", TEXT, null=True, size=255),
                _C("inspected_at", TIME, default=NOW),
            ),
            checks=(one_of("result", INSPECTION_RESULTS),),
            refs=(
                Ref("instance_id", "packaging_instances", "block"),
                Ref("wash_id", "wash_cycles", "null"),
            ),
        ),
        Table(
            "contamination_incidents",
            (
                _C("incident_id", LONG),
                _C("instance_id", LONG),
                _C("kind", TEXT, size=30),
                _C("severity", TINY),
                _C("description", TEXT, null=True, size=255),
                _C("detected_at", TIME, default=NOW),
            ),
            checks=(
                one_of("kind", INCIDENT_KINDS),
                Check("severity_in_range", "severity BETWEEN 1 AND 5"),
            ),
            refs=(Ref("instance_id", "packaging_instances", "block"),),
        ),
        Table(
            "sensor_readings",
            (
                _C("reading_id", LONG),
                _C("instance_id", LONG, null=True),
                _C("location_id", LONG, null=True),
                _C("sensor_type", TEXT, size=20),
                _C("value", T.DecimalType(10, 3)),
                _C("measured_at", TIME, default=NOW),
            ),
            checks=(one_of("sensor_type", SENSOR_TYPES),),
            refs=(
                Ref("instance_id", "packaging_instances", "null"),
                Ref("location_id", "locations", "null"),
            ),
        ),
        Table(
            "movements",
            (
                _C("mv_id", LONG),
                _C("instance_id", LONG),
                _C("from_loc_id", LONG, null=True),
                _C("to_loc_id", LONG, null=True),
                _C("moved_at", TIME, default=NOW),
                _C("note", TEXT, null=True, size=120),
            ),
            refs=(
                Ref("instance_id", "packaging_instances", "block"),
                Ref("from_loc_id", "locations", "block"),
                Ref("to_loc_id", "locations", "null"),
            ),
        ),
        Table(
            "audit_logs",
            (
                _C("log_id", LONG),
                _C("entity_type", TEXT, size=30),
                _C("entity_id", LONG),
                _C("event_type", TEXT, size=40),
                _C("detail", TEXT, null=True),
                _C("created_at", TIME, default=NOW),
            ),
        ),
    )
}
# --- end of fixed values ------------------------------------------------------------
