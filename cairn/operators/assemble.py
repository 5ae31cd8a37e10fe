"""The feature matrix: applications left-joined one to one with every source, and the catalog of what is in it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import bureau, credit_card, installments, pos, previous
from cairn.operators.features import Feature, require_unique
from cairn.sources.tables import ID, TARGET

BUILDERS = {m.SOURCE: m for m in (bureau, previous, installments, credit_card, pos)}
SOURCES = tuple(BUILDERS)


def features_of(source: str) -> tuple[Feature, ...]:
    if source not in BUILDERS:
        raise ValueError(f"unknown source {source!r}; known: {', '.join(SOURCES)}")
    return BUILDERS[source].FEATURES


def count_like_columns(source: str) -> list[str]:
    return [f"{source}__{f.name}" for f in features_of(source) if f.count_like]


def history_flag(source: str) -> str:
    return f"{source}__has_history"


def _check_inputs(applications: DataFrame, tables: dict[str, DataFrame], key: str, unique: bool) -> None:
    if TARGET in applications.columns:
        raise ValueError(f"{TARGET} must not be among the features")
    if unique:
        require_unique(applications, key)
    seen = set(applications.columns)
    for source, table in tables.items():
        features_of(source)
        own = [c for c in table.columns if c != key]
        if TARGET in own:
            raise ValueError(f"{source} holds {TARGET}")
        if stray := [c for c in own if not c.startswith(f"{source}__")]:
            raise ValueError(f"columns of {source} without its prefix: {stray}")
        if twice := seen & {*own, history_flag(source)}:
            raise ValueError(f"repeated columns: {sorted(twice)}")
        seen |= {*own, history_flag(source)}
        if unique:
            require_unique(table, key)


def build_matrix(applications: DataFrame, tables: dict[str, DataFrame], key: str = ID, check: bool = True) -> DataFrame:
    """One row for each application. Count-like features are 0 only where a source has no row for the customer; what such a row leaves null stays null.

    check: verify that keys are unique (a job for each table; switch off where they are by construction).
    """
    _check_inputs(applications, tables, key, check)
    out = applications
    for source, table in tables.items():
        counts, flag = set(count_like_columns(source)), history_flag(source)
        joined = out.join(table.withColumn(flag, F.lit(1)), key, "left")
        has = F.coalesce(F.col(flag), F.lit(0))
        own = [F.when(has == 1, F.col(c)).otherwise(F.lit(0).cast("float")).alias(c) if c in counts else F.col(c) for c in table.columns if c != key]
        out = joined.select(*out.columns, *own, has.cast("int").alias(flag))
    return out


def source_of(column: str) -> str:
    """The source that a column's prefix names, else ``application``."""
    head = column.split("__", 1)[0]
    return head if "__" in column and head in BUILDERS else "application"


def columns_for(columns: list[str], sources: tuple[str, ...]) -> list[str]:
    """Application columns and those of the given sources, in frame order."""
    return [c for c in columns if source_of(c) == "application" or source_of(c) in sources]


def temporal_reading(source: str, feature: Feature) -> str:
    if source != "bureau":
        return "dated at or before the application"
    if feature.name.startswith("bb_"):
        return "monthly statuses up to the application"
    return "latest admissible snapshot" if feature.name in bureau.SNAPSHOT or feature.stat == "ratio" else "fact of origination"


def catalog(spark: SparkSession, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """source, position, column, family, about, count_like, temporal: a row for each feature and for each history flag."""
    rows = []
    for s in sources:
        own = features_of(s)
        rows += [(s, n, f"{s}__{f.name}", f.family, f.about(), f.count_like, temporal_reading(s, f)) for n, f in enumerate(own)]
        rows.append((s, len(own), history_flag(s), "history", "1 if the source has a row for the customer", False, "dated at or before the application"))
    return spark.createDataFrame(rows, "source string, position int, column string, family string, about string, count_like boolean, temporal string")
