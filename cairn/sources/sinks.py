"""Sinks: Parquet tables, small CSV reports, and JSON that is published whole or not at all."""

from __future__ import annotations

import datetime
import json
import math
import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame


def plain(value):
    """A value that JSON can hold: missing numbers become null, dates text, anything with ``item`` a Python number."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple, set, frozenset)):
        return [plain(v) for v in (sorted(value, key=str) if isinstance(value, (set, frozenset)) else value)]
    if hasattr(value, "item") and not isinstance(value, (str, bytes)):
        return plain(value.item())
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, (datetime.date, datetime.datetime)):
        return value.isoformat()
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def publish_json(value, path: str | Path) -> Path:
    """Write beside the target, then rename: readers see the old file or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    fd, part = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    with os.fdopen(fd, "w") as out:
        json.dump(plain(value), out, indent=2, sort_keys=True)
    os.replace(part, path)
    return path


def write_table(df: DataFrame, path: str, partitions: int | None = None) -> str:
    """A Parquet table, replaced whole by the committer."""
    (df if partitions is None else df.coalesce(partitions)).write.mode("overwrite").parquet(path)
    return path


def write_report(df: DataFrame, path: str, order: list | None = None) -> str:
    """A report of few rows as one CSV file in a folder."""
    (df.orderBy(*order) if order else df).coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return path
