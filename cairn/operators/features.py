"""Feature specifications and their one-pass aggregation to one row for each customer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import latest, safe_ratio, sum_or_zero
from cairn.sources.tables import ID


@dataclass(frozen=True)
class Feature:
    """``stat`` of ``column`` over a customer's rows.

    stat: size, sum (0 if nothing is known), mean, max, min, std (sample), nunique, latest (``column`` at the largest
    ``by``), or ratio (of two features, where the second is positive). count_like features are 0 for customers without
    any history row.
    """

    name: str
    family: str
    stat: str
    column: str = ""
    by: str = ""

    @property
    def count_like(self) -> bool:
        return self.stat in ("size", "sum", "nunique")

    def aggregate(self) -> Column:
        c = F.col(self.column) if self.column else F.lit(1)
        how = {
            "size": lambda: F.count("*"), "sum": lambda: sum_or_zero(c), "mean": lambda: F.avg(c), "max": lambda: F.max(c), "min": lambda: F.min(c), "std": lambda: F.stddev_samp(c),
            "nunique": lambda: F.count_distinct(c), "latest": lambda: latest(c, *[F.col(b) for b in self.by.split()]),
        }
        return how[self.stat]().cast("double").alias(self.name)

    def about(self) -> str:
        return {"size": "rows", "ratio": f"{self.column} / {self.by} where the latter is positive", "latest": f"{self.column} at the largest {self.by.split(' ')[0]}"}.get(self.stat, f"{self.stat} of {self.column}")


def family(name: str, *specs: tuple) -> tuple[Feature, ...]:
    return tuple(Feature(s[0], name, *s[1:]) for s in specs)


def aggregate(rows: DataFrame, features: tuple[Feature, ...], key: str = ID) -> DataFrame:
    """All features but ratios in a single hash aggregation; rows without a key vanish."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[f.aggregate() for f in features if f.stat != "ratio"])


def with_ratios(table: DataFrame, features: tuple[Feature, ...]) -> DataFrame:
    return table.withColumns({f.name: safe_ratio(F.col(f.column), F.col(f.by)) for f in features if f.stat == "ratio"})


def finish(table: DataFrame, source: str, features: tuple[Feature, ...], key: str = ID) -> DataFrame:
    """The customer table: the key, then every feature in order as ``source__name``, float."""
    if gone := {f.name for f in features} - set(table.columns):
        raise ValueError(f"{source} lacks {sorted(gone)}")
    if extra := set(table.columns) - {f.name for f in features} - {key}:
        raise ValueError(f"{source} has undeclared {sorted(extra)}")
    return table.select(key, *[F.col(f.name).cast("float").alias(f"{source}__{f.name}") for f in features])


def require_unique(table: DataFrame, *keys: str) -> None:
    """Raises on null or repeated keys."""
    n = table.groupBy(*keys).count()
    bad = n.where((F.col("count") > 1) | F.greatest(*[F.col(k).isNull() for k in keys], F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"{', '.join(keys)} is null or repeated: {bad[0].asDict()}")
