"""Strict JSON reading: only objects and arrays count, only scalars are returned."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_json_container(text: Column) -> Column:
    """True for a text that is exactly one JSON object or array; false for NULL.

    ``try_parse_json`` alone lets trailing text pass and accepts bare scalars; inside a
    bracket pair trailing text makes the whole invalid, or the array longer than one.
    """
    wrapped = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    one_item = F.size(wrapped.cast("array<variant>")) == 1
    return F.coalesce(text.rlike(r"^\s*[\{\[]") & one_item, F.lit(False))


def json_scalar(text: Column, path: str) -> Column:
    """The value at ``path`` as text; NULL for a missing one, an object or an array.

    Numbers come without the zeros that end a fraction, as Spark writes them.
    """
    found = F.try_variant_get(F.try_parse_json(text), path, "variant")
    kind = F.schema_of_variant(found)
    return F.when(
        is_json_container(text) & ~kind.startswith("OBJECT") & ~kind.startswith("ARRAY"),
        F.get_json_object(text, path),
    )
