"""Hashes, manifests and checkpoints. Whatever does not match exactly is rebuilt or refused, never trusted."""

from __future__ import annotations

import hashlib
import json
from pathlib import Path

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.temporal import POLICY
from cairn.sources.sinks import plain, publish_json
from cairn.sources.tables import ID

FORMAT = 1


def file_hash(path: str | Path) -> str:
    digest = hashlib.sha256()
    with Path(path).open("rb") as f:
        while piece := f.read(1 << 20):
            digest.update(piece)
    return digest.hexdigest()


def fingerprint(value) -> str:
    return hashlib.sha256(json.dumps(plain(value), sort_keys=True).encode()).hexdigest()


def raw_signature(files: list[str | Path]) -> dict:
    return {Path(f).name: {"bytes": Path(f).stat().st_size, "sha256": file_hash(f)} for f in sorted(files, key=str)}


def builder_signature(modules: list) -> dict:
    return {"format": FORMAT, "policy": POLICY, "spark": pyspark.__version__, "sources": {m.__name__: file_hash(m.__file__) for m in sorted(modules, key=lambda m: m.__name__)}}


def content_digest(df: DataFrame) -> dict:
    """Independent of order and partitioning: row count, and two combinations of row hashes."""
    row = F.xxhash64(*df.columns)
    n, total, mixed = df.agg(F.count("*"), F.sum(row.cast("decimal(38,0)")), F.bit_xor(row)).first()
    return {"rows": n, "sum": str(total), "xor": mixed}


def table_schema(df: DataFrame, key: str = ID) -> dict:
    """Rows, customers, columns and types; raises on null or repeated keys."""
    n, keys, missing = df.agg(F.count("*"), F.count_distinct(key), F.sum(F.col(key).isNull().cast("long"))).first()
    if missing or keys != n:
        raise ValueError(f"{key}: {missing} null, {n - keys} repeated")
    return {"rows": n, "customers": keys, "columns": df.columns, "types": dict(df.dtypes)}


def register(table: DataFrame, manifest: str | Path, raw: dict, builder: dict, rows: int | None = None) -> dict:
    entry = {"raw": raw, "builder": builder, "limit": rows, "schema": table_schema(table), "content": content_digest(table)}
    publish_json(entry, manifest)
    return entry


def validate(table: DataFrame, manifest: str | Path, raw: dict, builder: dict, rows: int | None = None) -> dict:
    """The manifest if all of it holds; raises on the first thing that does not."""
    path = Path(manifest)
    if not path.exists():
        raise ValueError(f"no manifest {path}")
    try:
        held = json.loads(path.read_text())
    except json.JSONDecodeError as e:
        raise ValueError(f"{path} is not JSON") from e
    now = plain({"raw": raw, "builder": builder, "limit": rows})
    for part, value in now.items():
        if held.get(part) != value:
            raise ValueError(f"{part} changed since {path} was written")
    for part, value in (("schema", plain(table_schema(table))), ("content", plain(content_digest(table)))):
        if held.get(part) != value:
            raise ValueError(f"the table's {part} is not what {path} says")
    return held


def is_cached(table: DataFrame | None, manifest: str | Path, raw: dict, builder: dict, rows: int | None = None) -> bool:
    if table is None:
        return False
    try:
        validate(table, manifest, raw, builder, rows)
    except ValueError:
        return False
    return True


def save_checkpoint(path: str | Path, context: dict, files: list[str | Path], state: dict) -> None:
    publish_json({"context": context, "files": raw_signature(files), "state": state}, path)


def load_checkpoint(path: str | Path, context: dict, files: list[str | Path]) -> dict | None:
    """The state, if context and files are exactly those of the save; None if there is no checkpoint; else raises."""
    if not Path(path).exists():
        return None
    held = json.loads(Path(path).read_text())
    if held.get("context") != plain(context) or held.get("files") != raw_signature(files):
        raise ValueError(f"{path} belongs to another run")
    return held["state"]
