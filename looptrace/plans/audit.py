"""Reports on the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from looptrace.functions.jsonfn import json_scalar


def aud_event_counts(audit_logs: DataFrame, ordered: bool = True) -> DataFrame:
    out = audit_logs.groupBy("event_type").agg(F.count("*").alias("cnt"))
    return out.orderBy(F.desc("cnt"), "event_type") if ordered else out


def _newest(audit_logs: DataFrame, k: int) -> DataFrame:
    return audit_logs.orderBy(F.desc("created_at"), F.desc("log_id")).limit(k)


def aud_latest(audit_logs: DataFrame, entity: str, k: int = 20) -> DataFrame:
    """The newest ``k`` entries on one type of entity."""
    rows = audit_logs.filter(F.col("entity_type") == entity)
    return _newest(rows.select("log_id", "entity_id", "event_type", "created_at"), k)


def aud_notes_json(audit_logs: DataFrame, path: str = "$.note", k: int = 20) -> DataFrame:
    """The newest ``k`` entries with the text at ``path`` where the detail is JSON."""
    rows = _newest(audit_logs.select("log_id", "detail", "created_at"), k)
    return rows.select("log_id", json_scalar(F.col("detail"), path).alias("note"), "created_at")
