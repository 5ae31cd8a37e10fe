"""Preprocessing learned on training rows: medians, vocabularies, bounds, indicators. Each fit is a few aggregations, each transform one projection."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.linalg import VectorUDT  # noqa: F401  (vectors are the output type)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import clip_high, clip_low, without_sentinel
from cairn.operators.quality import SENTINELS, column_types, heavy_tails, missingness
from cairn.operators.ranking import column_quantiles
from cairn.sources.tables import ID, TARGET


def clean(df: DataFrame, sentinels: dict | None = None) -> DataFrame:
    """Sentinels become null; columns that are not there are ignored."""
    sentinels = SENTINELS if sentinels is None else sentinels
    found = {c: without_sentinel(F.col(c), v) for c, v in sentinels.items() if c in df.columns}
    return df.withColumns(found) if found else df


def missing_groups(df: DataFrame, columns: list[str]) -> list[list[str]]:
    """Columns grouped by where they are missing, in order of first column.

    Columns with equal counts and equal hash sums of their missing rows are candidates; candidates are confirmed by
    counting rows in which they differ.
    """
    if not columns:
        return []
    row = F.xxhash64(*df.columns)
    sums = [f for c in columns for f in (F.sum(F.col(c).isNull().cast("long")).alias(f"n_{c}"), F.bit_xor(F.when(F.col(c).isNull(), row)).alias(f"x_{c}"), F.sum(F.when(F.col(c).isNull(), row.cast("decimal(38,0)"))).alias(f"s_{c}"))]
    seen = df.agg(*sums).first()
    groups: dict[tuple, list[str]] = {}
    for c in columns:
        groups.setdefault((seen[f"n_{c}"], seen[f"x_{c}"], seen[f"s_{c}"]), []).append(c)
    pairs = [(g[0], c) for g in groups.values() for c in g[1:]]
    if not pairs:
        return list(groups.values())
    differ = df.agg(*[F.sum((F.col(a).isNull() != F.col(b).isNull()).cast("long")).alias(f"{a}|{b}") for a, b in pairs]).first()
    out = []
    for g in groups.values():
        same = [c for c in g if c == g[0] or not differ[f"{g[0]}|{c}"]]
        out += [same, *[[c] for c in g if c not in same]]
    return sorted(out, key=lambda g: columns.index(g[0]))


#: Levels of all columns together that a fit collects at most; a column of names or ids is no category.
MOST_LEVELS = 100_000


def collected_levels(levels: DataFrame) -> dict[str, list[str]]:
    """The sorted levels (column, v) by column; raises if there are more than ``MOST_LEVELS`` of them."""
    found = levels.select("column", "v").limit(MOST_LEVELS + 1).collect()
    if len(found) > MOST_LEVELS:
        raise ValueError(f"more than {MOST_LEVELS} levels of categorical columns")
    out: dict[str, list[str]] = {}
    for r in found:
        out.setdefault(r.column, []).append(r.v)
    return {c: sorted(v) for c, v in out.items()}


def vocabulary(df: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The sorted levels of each column, from one aggregation over all of them."""
    if not columns:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])
    return {c: [] for c in columns} | collected_levels(df.select(F.inline(pairs)).where("v IS NOT NULL").distinct())


@dataclass
class TreePreprocessor:
    """For boosted trees: float numbers, level codes (null for missing and unseen levels), optional treatment of heavy
    tails ("none", "log1p" or "winsorize") and missing indicators ("none", "all" or "deduplicated")."""

    heavy_tail: str = "none"
    heavy_tail_columns: list[str] | None = None
    winsor: tuple[float, float] = (0.001, 0.999)
    missing_indicators: str = "none"
    sentinels: dict = field(default_factory=lambda: dict(SENTINELS))
    id_column: str = ID

    def fit(self, df: DataFrame) -> TreePreprocessor:
        if self.heavy_tail not in ("none", "log1p", "winsorize") or self.missing_indicators not in ("none", "all", "deduplicated"):
            raise ValueError("unknown treatment")
        if TARGET in df.columns:
            raise ValueError(f"{TARGET} must not be among the features")
        rows = clean(df, self.sentinels)
        self.numeric, self.categorical = column_types(rows, (self.id_column,))
        if not self.numeric and not self.categorical:
            raise ValueError("no features")
        self.levels = vocabulary(rows, self.categorical)
        if self.heavy_tail == "none":
            self.tails = []
        elif self.heavy_tail_columns is None:
            found = {r.column for r in heavy_tails(rows, self.numeric).collect()} if self.numeric else set()
            self.tails = [c for c in self.numeric if c in found]
        else:
            if unknown := [c for c in self.heavy_tail_columns if c not in self.numeric]:
                raise ValueError(f"not numeric or not there: {unknown}")
            self.tails = list(self.heavy_tail_columns)
        self.bounds = {}
        if self.heavy_tail == "winsorize" and self.tails:
            found = {r.column: tuple(r.quantiles) for r in column_quantiles(rows, self.tails, list(self.winsor)).collect()}
            self.bounds = {c: found[c] for c in self.tails if c in found}
        self.groups = []
        if self.missing_indicators != "none" and self.numeric:
            gaps = {r.column for r in missingness(rows, self.numeric).where("n_missing > 0").collect()}
            gappy = [c for c in self.numeric if c in gaps]
            self.groups = missing_groups(rows, gappy) if self.missing_indicators == "deduplicated" else [[c] for c in gappy]
        self.indicators = [g[0] for g in self.groups]
        self.features = [*self.numeric, *self.categorical, *(f"missing_{c}" for c in self.indicators)]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """The id, if there, then every feature in order."""
        if gone := [c for c in (*self.numeric, *self.categorical) if c not in df.columns]:
            raise ValueError(f"missing columns {gone}")
        rows = clean(df, self.sentinels)
        out = [F.col(self.id_column)] if self.id_column in df.columns else []
        for c in self.numeric:
            x = F.col(c).cast("double")
            if c in self.bounds:
                x = clip_high(clip_low(x, self.bounds[c][0]), self.bounds[c][1])
            elif c in self.tails and self.heavy_tail == "log1p":
                x = F.log1p(clip_low(x))
            out.append(x.cast("float").alias(c))
        for c in self.categorical:
            at = F.array_position(F.array(*[F.lit(v) for v in self.levels[c]]).cast("array<string>"), F.col(c).cast("string"))
            out.append(F.when(at > 0, at - 1).cast("float").alias(c))
        out += [F.col(c).isNull().cast("float").alias(f"missing_{c}") for c in self.indicators]
        return rows.select(*out)

    def describe(self) -> dict:
        return {"heavy_tail": self.heavy_tail, "heavy_tail_columns": self.tails, "bounds": self.bounds, "levels": {c: len(v) for c, v in self.levels.items()}, "indicator_groups": self.groups, "features": self.features}


@dataclass
class LinearPreprocessor:
    """For logistic regression: medians with missing indicators, standardised by the population deviation, and one-hot levels.

    A missing level is the level ``missing``; an unseen one is all zeros, as is one rarer than ``min_frequency``.
    """

    min_frequency: int = 0
    sentinels: dict = field(default_factory=lambda: dict(SENTINELS))
    id_column: str = ID
    missing_level: str = "missing"

    def fit(self, df: DataFrame) -> LinearPreprocessor:
        if TARGET in df.columns:
            raise ValueError(f"{TARGET} must not be among the features")
        rows = clean(df, self.sentinels)
        self.numeric, self.categorical = column_types(rows, (self.id_column,))
        if not self.numeric and not self.categorical:
            raise ValueError("no features")
        self.medians, self.gappy, self.scale = {}, [], {}
        if self.numeric:
            found = rows.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in self.numeric]).first()
            self.gappy = [c for c in self.numeric if found[c]]
            middle = {r.column: r.quantiles[0] for r in column_quantiles(rows, self.numeric, [0.5]).collect()}
            self.medians = {c: middle.get(c, 0.0) for c in self.numeric}
            filled = self._filled(rows)
            names = [*self.numeric, *(f"missing_{c}" for c in self.gappy)]
            found = filled.agg(*[f for c in names for f in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
            self.scale = {c: (found[f"m_{c}"], found[f"s_{c}"] or 1.0) for c in names}
        self.levels = {}
        if self.categorical:
            pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(self.missing_level)).alias("v")) for c in self.categorical])
            counts = rows.select(F.inline(pairs)).groupBy("column", "v").count().where(F.col("count") >= self.min_frequency)
            self.levels = {c: [] for c in self.categorical} | collected_levels(counts)
        self.features = [*self.scale, *(f"{c}={v}" for c in self.categorical for v in self.levels[c])]
        return self

    def _filled(self, rows: DataFrame) -> DataFrame:
        out = [F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])).alias(c) for c in self.numeric]
        return rows.select(*[c for c in rows.columns if c not in self.numeric], *out, *[F.col(c).isNull().cast("double").alias(f"missing_{c}") for c in self.gappy])

    def transform(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The columns to keep and a dense vector ``features``."""
        from pyspark.ml.functions import array_to_vector

        if gone := [c for c in (*self.numeric, *self.categorical) if c not in df.columns]:
            raise ValueError(f"missing columns {gone}")
        filled = self._filled(clean(df, self.sentinels))
        numbers = [(F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.scale.items()]
        hot = [(F.coalesce(F.col(c).cast("string"), F.lit(self.missing_level)) == F.lit(v)).cast("double") for c in self.categorical for v in self.levels[c]]
        return filled.select(*keep, array_to_vector(F.array(*numbers, *hot).cast("array<double>")).alias("features"))
