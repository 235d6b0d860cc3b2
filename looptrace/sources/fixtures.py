"""The sixteen tables, derived from the star-schema test tables by plain projections.

The texts run unchanged in Spark SQL and in DuckDB: Spark gets them as views, the
check SQL as a list of common table expressions.  They are test data, not features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from looptrace.schemas import TABLES
from looptrace.sources.files import read_log, read_table, write_log, write_table
from looptrace.streaming.feeds import stream_log

# Schemas of the given files, stated so that no read has to infer them.
SOURCE_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
    "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
    "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
}

_ITEM_NUMBER = "CAST(regexp_extract(props, '([0-9]+)', 1) AS INT)"

# table -> (columns, source)
PROJECTIONS: dict[str, tuple[list[str], str]] = {
    "locations": (
        [
            "s_suppkey AS location_id",
            "s_name AS name",
            "CASE s_suppkey % 3 WHEN 0 THEN 'retailer' WHEN 1 THEN 'hub' ELSE 'dropbox' END AS kind",
            "concat(n_name, ', ', r_name) AS address",
            "CAST(CASE WHEN s_suppkey % 17 = 16 THEN NULL ELSE 41.35 + (s_suppkey * 37 % 800)"
            " / 10000.0 END AS DECIMAL(9,6)) AS lat",
            "CAST(CASE WHEN s_suppkey % 17 = 16 THEN NULL ELSE 2.10 + (s_suppkey * 53 % 1500)"
            " / 10000.0 END AS DECIMAL(9,6)) AS lng",
        ],
        "supplier JOIN nation ON s_nationkey = n_nationkey"
        " JOIN region ON n_regionkey = r_regionkey",
    ),
    "retailers": (
        [
            "s_suppkey AS retailer_id",
            "s_suppkey AS location_id",
            "concat('contact', s_suppkey, '@example.test') AS contact_email",
        ],
        "supplier WHERE s_suppkey % 3 = 0",
    ),
    "hubs": (
        [
            "s_suppkey AS hub_id",
            "s_suppkey AS location_id",
            "concat('Washer-', s_nationkey) AS washer_model",
        ],
        "supplier WHERE s_suppkey % 3 = 1",
    ),
    "customers": (
        [
            "c_custkey AS customer_id",
            "c_name AS name",
            "CASE WHEN c_custkey % 10 = 9 THEN NULL"
            " ELSE lower(concat(c_name, '@example.test')) END AS email",
            "concat('+00 ', c_custkey) AS phone",
            "TIMESTAMP '2023-12-02 00:00:00' + INTERVAL '1' DAY"
            " * CAST(c_custkey % 60 AS INT) AS created_at",
        ],
        "customer",
    ),
    "packaging_catalog": (
        [
            "p_partkey AS catalog_id",
            "concat('PKG-', p_partkey) AS sku",
            "p_type AS kind",
            "p_brand AS material",
            "CASE WHEN p_size % 10 = 0 THEN NULL ELSE p_size * 20 END AS capacity_ml",
            "CAST(floor(p_retailprice) AS INT) AS deposit_amount_cents",
        ],
        "part",
    ),
    "packaging_instances": (
        [
            "p_partkey AS instance_id",
            "p_partkey - p_partkey % 4 AS catalog_id",
            "concat('UID-', p_partkey) AS uid_code",
            "CASE p_size % 8 WHEN 0 THEN 'available' WHEN 1 THEN 'in_use'"
            " WHEN 2 THEN 'at_retailer' WHEN 3 THEN 'at_hub' WHEN 4 THEN 'washing'"
            " WHEN 5 THEN 'damaged' WHEN 6 THEN 'lost' ELSE 'retired' END AS state",
            "TIMESTAMP '1994-01-01 00:00:00' + INTERVAL '1' DAY"
            " * CAST(p_partkey % 300 AS INT) AS birthed_at",
            "CASE WHEN p_size % 8 = 7 THEN TIMESTAMP '2001-01-01 00:00:00' END AS retired_at",
        ],
        "part",
    ),
    "deposit_accounts": (
        [
            "c_custkey AS account_id",
            "c_custkey AS customer_id",
            "CAST(round(c_acctbal * 100) AS INT) AS balance_cents",
        ],
        "customer WHERE c_custkey % 20 <> 19",
    ),
    "deposit_transactions": (
        [
            "event_id AS tx_id",
            "user_id AS account_id",
            "CAST(round((value - 50) * 100) AS INT) AS delta_cents",
            "CASE event_id % 4 WHEN 0 THEN 'checkout_hold' WHEN 1 THEN 'return_release'"
            " WHEN 2 THEN 'penalty' ELSE 'adjustment' END AS reason",
            "CAST(NULL AS VARCHAR(40)) AS ref_table",
            "CAST(NULL AS BIGINT) AS ref_id",
            "ts AS created_at",
        ],
        "events WHERE event_type IN ('purchase', 'signup')",
    ),
    "checkouts": (
        [
            "o_orderkey AS checkout_id",
            "instance_id",
            "retailer_id",
            "o_custkey AS customer_id",
            "o_orderdate AS checkout_time",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 7 WHEN '2-HIGH' THEN 10"
            " WHEN '3-MEDIUM' THEN 14 WHEN '4-NOT SPECIFIED' THEN 21 ELSE 30 END"
            " AS due_back_days",
        ],
        "orders JOIN (SELECT l_orderkey, min(l_partkey) AS instance_id,"
        " max(l_suppkey - l_suppkey % 3) AS retailer_id FROM lineitem GROUP BY l_orderkey) i"
        " ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'",
    ),
    "returns": (
        [
            "l_orderkey * 10 + l_linenumber AS return_id",
            "instance_id",
            "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE customer_id END AS customer_id",
            "location_id",
            "checkout_time + INTERVAL '1' DAY * qty + INTERVAL '1' HOUR * l_linenumber"
            " AS return_time",
            "CASE WHEN l_orderkey % 3 = 0 THEN NULL ELSE l_orderkey END AS checkout_id",
        ],
        "(SELECT l_orderkey, l_linenumber, min(l_suppkey) AS location_id,"
        " CAST(min(l_quantity) AS INT) AS qty FROM lineitem"
        " WHERE l_returnflag = 'R' GROUP BY l_orderkey, l_linenumber) x"
        " JOIN checkouts ON checkout_id = l_orderkey",
    ),
    "wash_cycles": (
        [
            "o_orderkey AS wash_id",
            "1 + 3 * (o_custkey % 35) AS hub_id",
            "concat('W', o_orderkey) AS batch_code",
            "o_orderdate AS start_time",
            "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' MINUTE"
            " * CAST(o_custkey % 500 AS INT) END AS end_time",
            "CAST(55 + o_custkey % 2000 / 100.0 AS DECIMAL(5,2)) AS temp_c",
            "CASE o_custkey % 4 WHEN 0 THEN 'D1' WHEN 1 THEN 'D2' WHEN 2 THEN 'A' ELSE 'B' END"
            " AS detergent",
        ],
        "orders WHERE o_orderstatus = 'O'",
    ),
    "inspections": (
        [
            "o_orderkey AS inspection_id",
            "o_custkey AS instance_id",
            "CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey END AS wash_id",
            "o_orderpriority AS inspector",
            "CASE WHEN o_custkey % 7 = 0 OR o_orderkey % 6 = 0 THEN 'fail' ELSE 'pass' END"
            " AS result",
            "CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 'n/a' END AS notes",
            "o_orderdate + INTERVAL '1' DAY AS inspected_at",
        ],
        "orders WHERE o_orderstatus = 'O'",
    ),
    "contamination_incidents": (
        [
            "event_id AS incident_id",
            "user_id AS instance_id",
            "CASE event_id % 3 WHEN 0 THEN 'microbial' WHEN 1 THEN 'chemical'"
            " ELSE 'foreign_matter' END AS kind",
            f"CAST(1 + {_ITEM_NUMBER} % 5 AS TINYINT) AS severity",
            "CAST(NULL AS VARCHAR(255)) AS description",
            "ts AS detected_at",
        ],
        "events WHERE event_type = 'error'",
    ),
    "sensor_readings": (
        [
            "event_id AS reading_id",
            "CASE WHEN user_id = 0 THEN NULL ELSE user_id END AS instance_id",
            f"{_ITEM_NUMBER} AS location_id",
            "CASE event_type WHEN 'view' THEN 'temperature' WHEN 'click' THEN 'humidity'"
            " ELSE 'shock' END AS sensor_type",
            "CAST(value AS DECIMAL(10,3)) AS value",
            "ts AS measured_at",
        ],
        "events WHERE event_type IN ('view', 'click', 'error')",
    ),
    "movements": (
        [
            "event_id AS mv_id",
            "user_id AS instance_id",
            "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 100 END AS from_loc_id",
            f"{_ITEM_NUMBER} AS to_loc_id",
            "ts AS moved_at",
            "event_type AS note",
        ],
        "events WHERE event_type IN ('view', 'click')",
    ),
    "audit_logs": (
        [
            "event_id AS log_id",
            "CASE event_id % 3 WHEN 0 THEN 'instance' WHEN 1 THEN 'checkout' ELSE 'wash' END"
            " AS entity_type",
            "user_id AS entity_id",
            "CASE event_type WHEN 'error' THEN 'PENALTY' WHEN 'view' THEN 'NOTE'"
            " WHEN 'click' THEN 'STATE_CHANGE' ELSE 'ADJUST' END AS event_type",
            "CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN concat(props, ' x') WHEN 2 THEN '7'"
            " WHEN 3 THEN concat('{\"k\": ', props, '}') ELSE props END AS detail",
            "ts AS created_at",
        ],
        "events",
    ),
}

# The parameters that make every report's answer non-trivial on this data.
TELEMETRY_AS_OF = "2024-01-31 00:00:00"
LOANS_AS_OF = "1998-07-01 00:00:00"
POINT = (41.385, 2.17)
JSON_PATH = "$.k"


# Faults for the quality checks: table -> {column: expression that replaces it}.
FAULTS: dict[str, dict[str, str]] = {
    "customers": {
        "name": "CASE WHEN c_custkey % 50 = 1 THEN NULL ELSE c_name END",
        "phone": "concat('+00 ', c_custkey, CASE WHEN c_custkey % 40 = 3"
        " THEN ' 0000000000 0000000000 0000000000 0000000000' ELSE '' END)",
    },
    "packaging_instances": {
        "catalog_id": "CASE WHEN p_partkey % 90 = 7 THEN NULL ELSE p_partkey END",
        "uid_code": "concat('UID-', p_partkey - p_partkey % 60 % 2)",
        "state": "CASE WHEN p_size = 50 THEN 'broken' ELSE 'available' END",
        "retired_at": "CASE WHEN p_size % 8 = 7 THEN TIMESTAMP '1994-06-01 00:00:00' END",
    },
    "returns": {
        "return_time": "checkout_time + INTERVAL '1' DAY * (qty - 10)",
        "location_id": "CASE WHEN l_orderkey % 70 = 2 THEN NULL ELSE location_id END",
    },
    "wash_cycles": {
        "end_time": "CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderdate"
        " + INTERVAL '1' MINUTE * CAST(o_custkey % 500 - 100 AS INT) END",
        "wash_id": "o_orderkey - CASE WHEN o_custkey % 80 = 4 THEN o_orderkey % 4 ELSE 0 END",
    },
    "inspections": {
        "result": "CASE WHEN o_custkey % 30 = 9 THEN 'unclear' ELSE 'pass' END",
    },
    "contamination_incidents": {
        "severity": f"CAST({_ITEM_NUMBER} % 8 AS TINYINT)",
    },
    "movements": {
        "mv_id": "event_id - CASE WHEN user_id % 20 = 5 THEN event_id % 10 ELSE 0 END",
        "moved_at": "CASE WHEN user_id % 25 = 6 THEN NULL ELSE ts END",
    },
}


def projection(table: str, dirty: bool = False) -> str:
    columns, source = PROJECTIONS[table]
    faults = FAULTS.get(table, {}) if dirty else {}
    named = [column.rpartition(" AS ")[2] for column in columns]
    shown = [
        f"{faults[name]} AS {name}" if name in faults else column
        for name, column in zip(named, columns)
    ]
    return f"SELECT {', '.join(shown)} FROM {source}"


def cte(*tables: str, dirty: bool = False) -> str:
    """``WITH ...`` prefix that defines the named tables for a query text."""
    needed = [t for t in PROJECTIONS if t in tables or (t == "checkouts" and "returns" in tables)]
    if not needed:
        return ""
    return "WITH " + ",\n".join(f"{t} AS ({projection(t, dirty)})" for t in needed) + "\n"


# Raw readings as text, some of which fits no column: the input of the typed load.
RAW_READINGS = f"""
SELECT concat('', event_id) AS reading_id,
       concat('', user_id) AS instance_id,
       CASE WHEN event_type = 'error' THEN props ELSE regexp_extract(props, '([0-9]+)', 1) END
           AS location_id,
       event_type AS sensor_type,
       CASE WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'n/a'
            ELSE concat('', CAST(value AS DECIMAL(10,3))) END AS value,
       concat('', CAST(ts AS DATE), ' 12:00:00') AS measured_at
FROM events
"""

# Lines of raw files, some of which are no rows or hold text that fits no column.
RAW_LEDGER = """
SELECT CASE tx_id % 50 WHEN 1 THEN concat('', tx_id) WHEN 2 THEN concat(line, ',7') ELSE line END
           AS line
FROM (SELECT tx_id, concat(tx_id, ',', account_id, ',', CASE tx_id % 50 WHEN 3 THEN 'n/a'
             ELSE concat('', delta_cents) END, ',', reason, ',,,', CAST(created_at AS DATE),
             ' 12:00:00') AS line
      FROM deposit_transactions) lines
"""
RAW_PLACES = """
SELECT concat(location_id, ',', name, ',', kind, ',', coalesce(concat('', lat), '')) AS line
FROM locations
"""
RAW_CHECKOUTS = """
SELECT CASE checkout_id % 50 WHEN 1 THEN line WHEN 2 THEN 'no record' ELSE concat(line, '}') END
           AS line
FROM (SELECT checkout_id, concat('{"checkout_id": ', checkout_id, ', "instance_id": ', instance_id,
             ', "retailer_id": ', retailer_id, ', "customer_id": ', customer_id,
             ', "checkout_time": "', CAST(checkout_time AS DATE), ' 12:00:00", "due_back_days": ',
             CASE checkout_id % 50 WHEN 3 THEN '"soon"' ELSE concat('', due_back_days) END) AS line
      FROM checkouts) lines
"""


# The logs of these test files that span a month; the others span years and few rows a day.
BY_DAY = ("deposit_transactions", "contamination_incidents", "sensor_readings", "movements",
          "audit_logs")


def prepare(spark: SparkSession, folder: str, out: str) -> None:
    """The sixteen tables, with and without faults, as the library stores tables and logs."""
    for dirty in (False, True):
        tables = Loop(spark, folder, dirty=dirty)
        for name, df in tables.items():
            path = f"{out}/{'dirty' if dirty else 'clean'}/{name}"
            typed = df.select(
                *(F.col(c.name).cast(c.type).alias(c.name) for c in TABLES[name].columns)
            )
            if name in BY_DAY:
                write_log(typed, path, name)
            else:
                write_table(typed, path)


class Loop(Mapping):
    """The sixteen tables over one folder of test files, each built when first used.

    ``loop.movements`` and ``loop["movements"]`` are the same.

    ``streamed`` names source files to read as streams, ``dirty`` adds faults to the tables.
    ``prepared`` is a folder that ``prepare`` wrote, from which tables are read instead.
    """

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        streamed: tuple[str, ...] = (),
        dirty: bool = False,
        prepared: str | None = None,
    ):
        spark.conf.set("spark.sql.session.timeZone", "UTC")  # the given times have no zone
        self.spark = spark
        self.prepared = prepared
        self.folder = folder.rstrip("/")
        self.streamed = streamed
        self.dirty = dirty
        self.sources: dict[str, DataFrame] = {}

    def source(self, name: str) -> DataFrame:
        if name not in self.sources:
            self.sources[name] = self._read(name)
        return self.sources[name]

    def _read(self, name: str) -> DataFrame:
        reader = self.spark.readStream if name in self.streamed else self.spark.read
        # a stream takes a single file only by a pattern, here one that fits no other name
        file = f"{{{name}}}.parquet" if name in self.streamed else f"{name}.parquet"
        path = f"{self.folder}/{file}"
        return reader.schema(SOURCE_SCHEMAS[name]).parquet(path)

    def query(self, text: str, *tables: str) -> DataFrame:
        text = cte(*tables, dirty=self.dirty) + text
        for name in SOURCE_SCHEMAS:
            if re.search(rf"\b{name}\b", text):
                self.source(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    def __getattr__(self, table: str) -> DataFrame:
        if table not in PROJECTIONS:
            raise AttributeError(table)
        if self.prepared:
            frame = self._prepared(table)
        else:
            frame = self.query(f"SELECT * FROM {table}", table)
        self.__dict__[table] = frame
        return frame

    def _prepared(self, table: str) -> DataFrame:
        path = f"{self.prepared}/{'dirty' if self.dirty else 'clean'}/{table}"
        if self.streamed:
            return stream_log(self.spark, path, table)
        return (read_log if table in BY_DAY else read_table)(self.spark, path, table)

    def __getitem__(self, table: str) -> DataFrame:
        try:
            return getattr(self, table)
        except AttributeError:
            raise KeyError(table) from None

    def __contains__(self, table: object) -> bool:
        return table in PROJECTIONS

    def __iter__(self) -> Iterator[str]:
        return iter(PROJECTIONS)

    def __len__(self) -> int:
        return len(PROJECTIONS)
