"""Data quality: what a table holds, what is missing, constant, suspicious, or too close to the target.

Reports are long tables of (column, metric, ...). Each is one aggregation over the table: wide aggregates are stacked
to rows afterwards, and per-value counts go through one long form of all columns, not a job for each column.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import plain_flag
from cairn.operators.metrics import roc_auc
from cairn.operators.ranking import column_quantiles
from cairn.sources.tables import ID, TARGET

# Texts that stand for unknown levels, and name parts that hint at knowledge after the outcome.
UNKNOWN_TOKENS = ("XNA", "XAP", "Unknown", "unknown", "N/A", "NA", "")
LEAKAGE_PATTERNS = ("TARGET", "DEFAULT", "DPD", "OVERDUE", "LATE", "DELINQ", "WRITEOFF", "CHARGE_OFF", "COLLECT")
SENTINELS = {"DAYS_EMPLOYED": 365243}


def column_types(df: DataFrame, exclude: tuple[str, ...] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns in order; any other type raises."""
    numeric, categorical = [], []
    for f in df.schema:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, T.NumericType):
            numeric.append(f.name)
        elif isinstance(f.dataType, (T.StringType, T.BooleanType)):
            categorical.append(f.name)
        else:
            raise TypeError(f"{f.name}: {f.dataType.simpleString()} is neither numeric nor categorical")
    return numeric, categorical


def validate_target(df: DataFrame, target: str = TARGET) -> None:
    """Raises for missing labels, then for labels other than 0 and 1, then for a single class."""
    counts = {r[0]: r[1] for r in df.groupBy(target).count().limit(10).collect()}
    if counts.get(None):
        raise ValueError(f"{counts[None]} missing labels")
    if odd := sorted(str(v) for v in counts if v not in (0, 1)):
        raise ValueError(f"unexpected labels {odd}")
    if len(counts) < 2:
        raise ValueError("a single class")


def target_summary(df: DataFrame, target: str = TARGET) -> DataFrame:
    y = F.col(target)
    pos, neg = F.sum(plain_flag(y == 1)), F.sum(plain_flag(y == 0))
    row = df.agg(F.count("*").alias("n"), F.sum(y.isNull().cast("int")).alias("n_missing"), pos.alias("n_positive"), neg.alias("n_negative"))
    return row.select("*", F.when(F.col("n") > 0, F.col("n_positive") / F.col("n")).alias("prevalence"), F.when(F.col("n_positive") > 0, F.col("n_negative") / F.col("n_positive")).alias("imbalance"))


def duplicate_rows(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows repeat an earlier key. Null keys count as values."""
    groups = df.groupBy(*keys).count()
    return groups.agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).cast("long").alias("duplicates"))


def overview(df: DataFrame, id_column: str = ID) -> DataFrame:
    """One row: shape, repeated rows and ids, and columns by kind."""
    numeric, categorical = column_types(df)
    one = lambda frame: frame.withColumn("_one", F.lit(1))
    rows = one(df.agg(F.count("*").alias("n_rows")))
    whole = one(duplicate_rows(df, df.columns).withColumnRenamed("duplicates", "duplicate_rows"))
    ids = one(duplicate_rows(df, [id_column]).withColumnRenamed("duplicates", "duplicate_ids"))
    return rows.join(whole, "_one").join(ids, "_one").select(
        "n_rows", F.lit(len(df.columns)).alias("n_columns"), "duplicate_rows", "duplicate_ids", (F.col("duplicate_ids") == 0).alias("id_unique"), F.lit(len(numeric)).alias("n_numeric"), F.lit(len(categorical)).alias("n_categorical")
    )


def stacked(df: DataFrame, columns: list[str], metrics: dict) -> DataFrame:
    """One row for each column from a single aggregation. metrics: name to a function of the column's name."""
    wide = df.agg(*[make(c).alias(f"{c}\x00{m}") for c in columns for m, make in metrics.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("position"), F.lit(c).alias("column"), *[F.col(f"`{c}\x00{m}`").alias(m) for m in metrics]) for n, c in enumerate(columns)])
    return wide.select(F.inline(rows))


def missingness(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """position, column, n_missing, fraction."""
    found = stacked(df, columns or df.columns, {"n_missing": lambda c: F.sum(F.col(c).isNull().cast("long")), "_n": lambda c: F.count("*")})
    return found.select("position", "column", F.coalesce("n_missing", F.lit(0)).cast("long").alias("n_missing"), F.when(F.col("_n") > 0, F.col("n_missing") / F.col("_n")).alias("fraction"))


def missingness_summary(table: DataFrame) -> DataFrame:
    f = F.col("fraction")
    return table.agg(F.sum((f > 0).cast("long")).alias("columns_with_missing"), F.sum((f > 0.5).cast("long")).alias("columns_over_half"), F.sum((f > 0.2).cast("long")).alias("columns_over_fifth"), F.avg(f).alias("total_fraction"))


def long_values(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, value (text, null where missing), n: the counts of all values of all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])
    return df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count("*").alias("n"))


def value_counts(df: DataFrame, column: str, k: int = 12) -> DataFrame:
    """The k most frequent values, missing being one; ties by value."""
    return df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(k)


def top_missing(table: DataFrame, k: int = 10) -> DataFrame:
    """column, fraction: the k columns of ``missingness`` that miss most; ties in order of the table."""
    return table.where("n_missing > 0").orderBy(F.desc("fraction"), "position").limit(k).select("column", "fraction")


def constant_columns(df: DataFrame, share: float = 0.99) -> DataFrame:
    """column, n_unique, top_share of columns whose top value, missing ones counting in the whole, reaches ``share`` or that have one value at most."""
    values = long_values(df, df.columns)
    per = values.groupBy("column").agg(F.count("value").alias("n_unique"), F.coalesce(F.max(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("_top"), F.sum("n").alias("_n"))
    return per.select("column", "n_unique", (F.col("_top") / F.col("_n")).alias("top_share")).where((F.col("top_share") >= share) | (F.col("n_unique") <= 1))


def cardinality(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """column, n_unique, missing_fraction of categorical columns."""
    columns = columns if columns is not None else column_types(df)[1]
    values = long_values(df, columns)
    per = values.groupBy("column").agg(F.count("value").alias("n_unique"), F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("_m"), F.sum("n").alias("_n"))
    return per.select("column", "n_unique", (F.col("_m") / F.col("_n")).alias("missing_fraction"))


def high_cardinality(df: DataFrame, threshold: int = 20) -> DataFrame:
    return cardinality(df).where(F.col("n_unique") > threshold)


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, n_missing, n_negative, n_zero, min, median, q99, max of numeric columns; quantiles interpolate linearly."""
    found = stacked(df, columns, {
        "n": lambda c: F.count("*"), "n_missing": lambda c: F.sum(F.col(c).isNull().cast("long")), "n_negative": lambda c: F.sum(plain_flag(F.col(c) < 0)), "n_zero": lambda c: F.sum(plain_flag(F.col(c) == 0)),
        "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double"),
    })
    found = found.join(column_quantiles(df, columns, [0.5, 0.99]), "column", "left")
    return found.select("column", "n", "n_missing", "n_negative", "n_zero", "min", F.col("quantiles")[0].alias("median"), F.col("quantiles")[1].alias("q99"), "max")


def sample_skewness(c: str):
    """The bias-corrected skewness; null for fewer than three values."""
    n = F.count(c)
    return F.when(n > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def heavy_tails(df: DataFrame, columns: list[str], least_unique: int = 20, least_skew: float = 1.0) -> DataFrame:
    """column, n_unique, min, max, skew of columns that are never negative, exceed 1, vary and lean right."""
    found = stacked(df, columns, {"n_unique": lambda c: F.count_distinct(c), "min": lambda c: F.min(c).cast("double"), "max": lambda c: F.max(c).cast("double"), "skew": sample_skewness})
    return found.where((F.col("n_unique") >= least_unique) & (F.col("min") >= 0) & (F.col("max") > 1) & (F.col("skew") > least_skew)).drop("position")


def suspicious_values(df: DataFrame, sentinels: dict | None = None, ratio: float = 100.0) -> DataFrame:
    """finding, column, detail, n: unknown tokens, positive day offsets, sentinels, extreme maxima, negative amounts."""
    sentinels = SENTINELS if sentinels is None else sentinels
    numeric, categorical = column_types(df)
    parts = []
    if categorical:
        parts.append(long_values(df, categorical).where(F.col("value").isin(*UNKNOWN_TOKENS)).select(F.lit("unknown_token").alias("finding"), "column", F.col("value").alias("detail"), F.col("n")))
    if numeric:
        found = stacked(df, numeric, {
            "positive": lambda c: F.sum(plain_flag(F.col(c) > 0)), "negative": lambda c: F.sum(plain_flag(F.col(c) < 0)), "sentinel": lambda c: F.sum(plain_flag(F.col(c) == sentinels[c])) if c in sentinels else F.lit(None).cast("long"),
            "known": lambda c: F.count(c), "max": lambda c: F.max(c).cast("double"),
        })
        found = found.join(column_quantiles(df, numeric, [0.99]), "column", "left").withColumn("q99", F.col("quantiles")[0])
        pick = lambda name, rows, n, detail=None: rows.select(F.lit(name).alias("finding"), "column", (F.lit("") if detail is None else detail).alias("detail"), F.col(n).cast("long").alias("n"))
        parts += [
            pick("positive_days", found.where(F.col("column").startswith("DAYS_") & (F.col("positive") > 0)), "positive"),
            pick("sentinel", found.where("sentinel IS NOT NULL"), "sentinel"),
            pick("extreme", found.where((F.col("known") > 10) & (F.col("q99") > 0) & (F.col("max") > ratio * F.col("q99"))), "known", F.round(F.col("max") / F.col("q99"), 3).cast("string")),
            pick("negative_amount", found.where((F.col("column").startswith("AMT_") | F.col("column").startswith("CNT_")) & (F.col("negative") > 0)), "negative"),
        ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leaky_names(columns: list[str], target: str = TARGET, patterns: tuple[str, ...] = LEAKAGE_PATTERNS) -> list[str]:
    return [c for c in columns if c != target and any(re.search(p, c, re.IGNORECASE) for p in patterns)]


def univariate_auc(df: DataFrame, target: str, columns: list[str], least: int = 50) -> DataFrame:
    """column, auc: max(AUC, 1 - AUC) of each numeric column against the target where it is known; all columns in one job."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("p")) for c in columns])
    rows = df.select(F.col(target).alias("y"), F.inline(pairs)).where("p IS NOT NULL")
    enough = rows.groupBy("column").agg(F.count("*").alias("_n"), F.count_distinct("y").alias("_k")).where((F.col("_n") >= least) & (F.col("_k") == 2)).select("column")
    found = roc_auc(rows.join(F.broadcast(enough), "column", "left_semi"), ["column"])
    return found.select("column", F.when(F.col("roc_auc") < 0.5, 1 - F.col("roc_auc")).otherwise(F.col("roc_auc")).alias("auc"))


def leakage_screen(df: DataFrame, target: str = TARGET, id_column: str = ID, threshold: float = 0.8, top: int = 15) -> dict:
    numeric, _ = column_types(df, (id_column, target))
    ranked = [(r.column, r.auc) for r in univariate_auc(df, target, numeric).orderBy(F.desc("auc"), "column").collect()]
    return {"name_based_flags": leaky_names(df.columns, target), "auc_threshold": threshold, "high_separation_features": {c: v for c, v in ranked if v >= threshold}, "top_univariate_auc": dict(ranked[:top])}


def validate(df: DataFrame, target: str = TARGET, id_column: str = ID) -> dict:
    """All reports as one dict that JSON can hold."""
    validate_target(df, target)
    features = df.drop(target)
    numeric, _ = column_types(features, (id_column,))
    rows = lambda frame: [r.asDict() for r in frame.collect()]
    missing = missingness(features)
    return {
        "overview": rows(overview(df, id_column))[0], "target": rows(target_summary(df, target))[0], "missingness": rows(missing.orderBy(F.desc("fraction"), "position")), "missingness_summary": rows(missingness_summary(missing))[0] | {"top": rows(top_missing(missing))},
        "constant": rows(constant_columns(features)), "cardinality": rows(cardinality(features)), "high_cardinality": rows(high_cardinality(features)), "suspicious": rows(suspicious_values(features)), "profile": rows(profile(features, numeric)),
        "leakage": leakage_screen(df, target, id_column),
    }
