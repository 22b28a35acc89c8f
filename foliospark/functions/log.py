"""Structured log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The fields after the message, in order.
FIELDS = ("document_id", "page_number", "stage", "duration_ms", "status", "error")


def log_line(ts: Column, level: Column, message: Column, fields: dict[str, Column], logger: str = "ocr_service") -> Column:
    """One line: time, [level], logger, message and the fields that are set, as key=value. Durations have two places."""
    said = [F.concat(F.lit(f" {k}="), (F.round(fields[k], 2) if k == "duration_ms" else fields[k]).cast("string")) for k in FIELDS if k in fields]
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), level, F.lit(f"] {logger}: "), message, F.concat_ws("", *said))


def stage_message(stage: Column, status: Column) -> Column:
    return F.concat(F.lit("Stage "), stage, F.when(status == "failed", " failed").otherwise(" completed"))
