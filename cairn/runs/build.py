"""Builds the customer tables of all sources, each once: a source is rebuilt only if its raw files, its code or its table changed.

    python -m cairn.runs.build RAW_DIR OUT_DIR [--sources bureau,pos] [--force] [--rows N]
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from cairn.operators import assemble, audit, features, provenance, temporal
from cairn.runs.config import Paths
from cairn.sources.sinks import publish_json, write_report, write_table
from cairn.sources.tables import TABLES, MissingTable, read_table

RAW = {"bureau": ("bureau", "bureau_balance"), "previous": ("previous",), "installments": ("installments",), "credit_card": ("credit_card",), "pos": ("pos",)}
AUDITS = {"previous": audit.audit_previous, "installments": audit.audit_installments, "credit_card": audit.audit_credit_card, "pos": audit.audit_pos}


def load_and_build(spark: SparkSession, source: str, raw_dir: str, rows: int | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """(customer table, audit tables) of a source from its raw tables."""
    tables = [read_table(spark, name, raw_dir, rows) for name in RAW[source]]
    found = {**audit.audit_bureau(tables[0]), **{f"balance_{k}": v for k, v in audit.audit_balance(tables[1], tables[0]).items()}} if source == "bureau" else AUDITS[source](tables[0])
    return assemble.BUILDERS[source].build(*tables), found


def signatures(source: str, raw_dir: str) -> tuple[dict, dict]:
    raw = provenance.raw_signature([Path(raw_dir) / TABLES[name].file for name in RAW[source]])
    return raw, provenance.builder_signature([assemble.BUILDERS[source], features, temporal])


def stored(spark: SparkSession, source: str, paths: Paths) -> DataFrame | None:
    try:
        return spark.read.parquet(paths.table(source))
    except AnalysisException:
        return None


def load_source_table(spark: SparkSession, source: str, raw_dir: str, paths: Paths, rows: int | None = None) -> DataFrame:
    """The stored table of a source; raises unless it is what its manifest says and made from these files by this code."""
    table = stored(spark, source, paths)
    if table is None:
        raise MissingTable(f"{source} is not built yet")
    provenance.validate(table, paths.manifest(source), *signatures(source, raw_dir), rows)
    return table


def build_source(spark: SparkSession, source: str, raw_dir: str, paths: Paths, force: bool = False, rows: int | None = None) -> dict:
    """The log entry of a source, built or found in the cache."""
    began, (raw, builder) = time.time(), signatures(source, raw_dir)
    log = json.loads(paths.build_log.read_text()) if paths.build_log.exists() else {}
    if not force and source in log and provenance.is_cached(stored(spark, source, paths), paths.manifest(source), raw, builder, rows):
        return log[source] | {"status": "cached"}
    table, audits = load_and_build(spark, source, raw_dir, rows)
    write_table(table, paths.table(source))
    manifest = provenance.register(spark.read.parquet(paths.table(source)), paths.manifest(source), raw, builder, rows)
    entry = {"status": "built", "customers": manifest["schema"]["customers"], "columns": len(manifest["schema"]["columns"]), "raw": raw, "seconds": round(time.time() - began, 1), "audit": {k: [r.asDict() for r in df.collect()] for k, df in audits.items()}}
    publish_json(log | {source: entry}, paths.build_log)
    return entry


def build_all(spark: SparkSession, raw_dir: str, paths: Paths, sources: tuple[str, ...] = assemble.SOURCES, force: bool = False, rows: int | None = None) -> dict[str, dict]:
    """One source after another; each is logged when done, so a run that stops goes on where it was. Writes the catalog too."""
    out = {s: build_source(spark, s, raw_dir, paths, force, rows) for s in sources}
    write_report(assemble.catalog(spark, sources), paths.report("catalog"), ["source", "position"])
    return out


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Build the customer tables.")
    parser.add_argument("raw_dir")
    parser.add_argument("out_dir")
    parser.add_argument("--sources", default=",".join(assemble.SOURCES))
    parser.add_argument("--force", action="store_true")
    parser.add_argument("--rows", type=int)
    given = parser.parse_args(args)
    spark = SparkSession.builder.appName("build").getOrCreate()
    try:
        for source, entry in build_all(spark, given.raw_dir, Paths(Path(given.out_dir)), tuple(given.sources.split(",")), given.force, given.rows).items():
            print(f"{source}: {entry['status']}, {entry['customers']} customers, {entry['seconds']} s")
    except FileNotFoundError as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
