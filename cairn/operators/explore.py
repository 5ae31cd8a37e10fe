"""Small building blocks of exploration: bins, bands, crosstabs, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.operators.quality import stacked
from cairn.operators.ranking import column_quantiles


def band(x: Column, edges: list, closed: str = "left") -> Column:
    """The text of the interval that holds x. closed left: [a, b), null outside; closed right: (a, b], with an open first band."""
    out = F.lit(None).cast("string")
    if closed == "right":
        for a, b in zip(reversed([None, *edges[:-1]]), reversed(edges), strict=True):
            out = F.when(x <= b, f"({'-inf' if a is None else a}, {b}]").otherwise(out)
        return out
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        out = F.when((x >= a) & (x < b), f"[{a}, {b})").otherwise(out)
    return out


def quantile_bins(df: DataFrame, column: str, target: str, bins: int) -> DataFrame:
    """bin, n, rate by quantile edges of column; a bin holds its upper edge, the first holds both."""
    found = column_quantiles(df, [column], [i / bins for i in range(bins + 1)])
    edges = found.select(F.array_distinct("quantiles").alias("edges"), F.lit(1).alias("_one"))
    rows = df.withColumn("_one", F.lit(1)).join(F.broadcast(edges), "_one")
    at = F.size(F.filter("edges", lambda e: e < F.col(column))) - 1
    return rows.groupBy(F.when(at < 0, 0).otherwise(at).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(target).alias("rate"))


def rate_by(df: DataFrame, level: Column, target: str) -> DataFrame:
    return df.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.avg(target).alias("rate"))


def crosstab(df: DataFrame, rows: str, columns: str, levels: list[str], normalize: bool = False) -> DataFrame:
    """Counts of given levels by row value; normalised, shares of the row's total over these levels."""
    counts = df.groupBy(rows).pivot(columns, levels).count().na.fill(0)
    if not normalize:
        return counts
    total = sum((F.col(f"`{v}`") for v in levels[1:]), F.col(f"`{levels[0]}`"))
    return counts.select(rows, *[F.when(total > 0, F.col(f"`{v}`") / total).alias(v) for v in levels])


def top_rows(df: DataFrame, by: str, tie: str, k: int) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), tie).limit(k)


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n, density of values in [low, high)."""
    inside = df.where((F.col(column) >= low) & (F.col(column) < high))
    counts = inside.groupBy(F.floor((F.col(column) - low) / ((high - low) / bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all")).withColumn("_one", F.lit(1))
    return counts.withColumn("_one", F.lit(1)).join(F.broadcast(total), "_one").select("bin", "n", (F.col("n") / F.col("_all") / ((high - low) / bins)).alias("density"))


def coincide(df: DataFrame, a: Column, b: Column) -> DataFrame:
    return df.agg(F.bool_and(a.eqNullSafe(b)).alias("coincide"))


def largest_z(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, largest: the greatest absolute deviation from the mean in population standard deviations."""
    found = stacked(df, columns, {"mean": F.avg, "sd": F.stddev_pop, "lo": lambda c: F.min(c).cast("double"), "hi": lambda c: F.max(c).cast("double")})
    up, down = F.col("hi") - F.col("mean"), F.col("mean") - F.col("lo")
    return found.select("column", F.when(F.col("sd") > 0, F.when(up > down, up).otherwise(down) / F.col("sd")).alias("largest"))
