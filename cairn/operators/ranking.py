"""Orders over a whole table without one task that sorts it: row numbers and running sums in two levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CELLS = 1024


def number_rows(df: DataFrame, key: str, to: str = "row") -> DataFrame:
    """Numbers from 0 without gaps, by the first two hex digits of the key's MD5 and then by key. Keys must be unique and not null."""
    cell = F.substring(F.md5(F.col(key).cast("string")), 1, 2)
    rows = df.withColumn("_cell", cell)
    starts = rows.groupBy("_cell").count().withColumn("_start", F.sum("count").over(W.orderBy("_cell")) - F.col("count")).drop("count")
    inside = F.row_number().over(W.partitionBy("_cell").orderBy(key)) - 1
    return rows.withColumn("_in", inside).join(F.broadcast(starts), "_cell").withColumn(to, (F.col("_start") + F.col("_in")).cast("long")).drop("_cell", "_in", "_start")


def running_sums(df: DataFrame, by: list[str], x: str, sums: list[str], descending: bool = False) -> DataFrame:
    """``df``, one row for each (by, x), with ``before_<s>``: the sum of s over the rows of the group that come before.

    x is cut into equal cells between the group's finite extremes; cells are summed first, and rows are sorted within cells.
    """
    infinite = F.lit(float("inf"))
    finite = F.when(F.abs(x) < infinite, F.col(x))
    extremes = df.groupBy(*by).agg(F.min(finite).alias("_lo"), F.max(finite).alias("_hi"))
    inner = F.when(F.col("_hi") > F.col("_lo"), F.floor((F.col(x) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(CELLS))).otherwise(F.lit(0))
    cell = F.when(F.col(x) == infinite, CELLS + 1).when(F.col(x) == -infinite, -1).otherwise(inner).cast("int")
    rows = df.join(extremes, by).withColumn("_cell", cell).drop("_lo", "_hi")
    order = (lambda c: F.col(c).desc()) if descending else F.col
    earlier = W.partitionBy(*by).orderBy(order("_cell")).rowsBetween(W.unboundedPreceding, -1)
    cells = rows.groupBy(*by, "_cell").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    cells = cells.select(*by, "_cell", *[F.coalesce(F.sum(f"_t_{s}").over(earlier), F.lit(0)).alias(f"_b_{s}") for s in sums])
    inside = W.partitionBy(*by, "_cell").orderBy(order(x)).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumns({f"_i_{s}": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}).join(cells, [*by, "_cell"])
    return rows.withColumns({f"before_{s}": F.col(f"_b_{s}") + F.col(f"_i_{s}") for s in sums}).drop("_cell", *[f"{a}{s}" for s in sums for a in ("_b_", "_i_")])


def quantiles(rows: DataFrame, by: list[str], x: str, steps: list[float]) -> DataFrame:
    """by, quantiles: exact ones of x at ``steps``, interpolated linearly. Missing values and NaN are left out; groups without any others too.

    Equal values are counted first, and no task holds all values of a group.
    """
    known = rows.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_n"))
    totals = known.groupBy(*by).agg((F.sum("_n") - 1).alias("_last"))
    ranked = running_sums(known, by, "_x", ["_n"]).join(totals, by)
    at = lambda place: F.max(F.when((F.col("before__n") <= place) & (place < F.col("before__n") + F.col("_n")), F.col("_x")))
    place = {i: F.lit(s) * F.col("_last") for i, s in enumerate(steps)}
    sides = [f for i in place for f in (at(F.floor(place[i])).alias(f"_low{i}"), at(F.ceil(place[i])).alias(f"_high{i}"))]
    found = ranked.groupBy(*by, "_last").agg(*sides)

    def between(i: int):
        low, high = F.col(f"_low{i}"), F.col(f"_high{i}")
        return F.when(low == high, low).otherwise((F.ceil(place[i]) - place[i]) * low + (place[i] - F.floor(place[i])) * high)

    return found.select(*by, F.array(*[between(i) for i in place]).alias("quantiles"))


def column_quantiles(df: DataFrame, columns: list[str], steps: list[float]) -> DataFrame:
    """column, quantiles of numeric columns, all in one job."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_v")) for c in columns])
    return quantiles(df.select(F.inline(pairs)), ["column"], "_v", steps)
