from __future__ import annotations

import os
import sys
from datetime import datetime
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from looptrace.schemas import TABLES  # noqa: E402
from looptrace.session import session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    spark = session(
        "tests",
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


@pytest.fixture(scope="session")
def table(spark):
    """table("movements", (1, 7, None, 3, "2025-01-01", None), ...) as a typed DataFrame."""

    def convert(column, value):
        kind = column.type.typeName()
        if value is None:
            return None
        if kind == "timestamp":
            return at(value)
        return Decimal(str(value)) if kind == "decimal" else value

    def build(name, *rows):
        spec = TABLES[name]
        struct = spec.struct
        for field in struct.fields:
            field.nullable = True
        typed = [tuple(convert(c, v) for c, v in zip(spec.columns, row)) for row in rows]
        return spark.createDataFrame(typed, struct)

    return build


def tuples(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
