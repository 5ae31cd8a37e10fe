"""Exploratory queries: deciles, bands, crosstabs, rates, histograms, correlations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import assemble, quality
from cairn.operators.explore import band, coincide, crosstab, histogram, largest_z, quantile_bins, rate_by, top_rows
from cairn.operators.ranking import column_quantiles
from cairn.plans.quality_queries import COLUMNS, NUMERIC, WIDE, _union
from cairn.plans.registry import query
from cairn.plans.views import view
from cairn.sources.tables import ID, TARGET


@query(WIDE + ", e AS (SELECT list_distinct(quantile_cont(SK_ID_CURR, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0])) AS edges FROM wide) SELECT CAST(greatest(len(list_filter(edges, lambda x: x < SK_ID_CURR)) - 1, 0) AS INT) AS bin, count(*) AS n, avg(TARGET) AS rate FROM wide, e GROUP BY 1")
def q_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantile_bins(view(spark, sf_dir, "wide"), ID, TARGET, 10)


@query(WIDE + ", u AS (" + _union(f"SELECT count(DISTINCT {c}) AS n FROM wide" for c in NUMERIC) + ") SELECT count(*) FILTER (n <= 2) AS up_to_2, count(*) FILTER (n > 2 AND n <= 50) AS up_to_50, count(*) FILTER (n > 50) AS more FROM u")
def q_distinct_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_unique")
    return quality.cardinality(view(spark, sf_dir, "wide"), list(NUMERIC)).agg(F.sum((n <= 2).cast("long")).alias("up_to_2"), F.sum(((n > 2) & (n <= 50)).cast("long")).alias("up_to_50"), F.sum((n > 50).cast("long")).alias("more"))


@query(WIDE + ", f AS (" + _union(f"SELECT count(*) FILTER ({c} IS NULL) / count(*) AS f FROM wide" for c in COLUMNS) + ") SELECT CASE WHEN f <= 0 THEN '(-inf, 0]' WHEN f <= 0.2 THEN '(0, 0.2]' WHEN f <= 0.5 THEN '(0.2, 0.5]' WHEN f <= 1 THEN '(0.5, 1]' END AS band, count(*) AS n FROM f GROUP BY 1")
def q_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missingness(view(spark, sf_dir, "wide")).groupBy(band(F.col("fraction"), [0, 0.2, 0.5, 1], closed="right").alias("band")).agg(F.count("*").alias("n"))


@query(WIDE + ", f AS (" + _union(f"SELECT '{c}' AS c, count(*) FILTER ({c} IS NULL) / count(*) AS f FROM wide" for c in COLUMNS) + ") SELECT count(*) AS columns, round(avg(f), 9) AS mean_fraction FROM f WHERE regexp_matches(c, '^(AMT|CNT)_')")
def q_family_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.missingness(view(spark, sf_dir, "wide")).where(F.col("column").rlike("^(AMT|CNT)_")).agg(F.count("*").alias("columns"), F.round(F.avg("fraction"), 9).alias("mean_fraction"))


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "XNA")


@query(WIDE + "SELECT TARGET, " + ", ".join(f"count(*) FILTER (NAME_PRIORITY = '{v}') AS \"{v}\"" for v in PRIORITIES) + " FROM wide GROUP BY TARGET")
def q_crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosstab(view(spark, sf_dir, "wide"), TARGET, "NAME_PRIORITY", list(PRIORITIES))


@query(WIDE + "SELECT TARGET, " + ", ".join(f"round(count(*) FILTER (NAME_PRIORITY = '{v}') / count(*) FILTER (NAME_PRIORITY IN {PRIORITIES}), 9) AS \"{v}\"" for v in PRIORITIES) + " FROM wide GROUP BY TARGET")
def q_crosstab_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    shares = crosstab(view(spark, sf_dir, "wide"), TARGET, "NAME_PRIORITY", list(PRIORITIES), normalize=True)
    return shares.select(TARGET, *[F.round(F.col(f"`{v}`"), 9).alias(v) for v in PRIORITIES])


@query(WIDE + "SELECT quantile_cont(AMT_TOTAL, 0.01) AS q01, quantile_cont(AMT_TOTAL, 0.5) AS q50, quantile_cont(AMT_TOTAL, 0.99) AS q99, count(AMT_TOTAL) AS n, min(AMT_TOTAL) AS min, max(AMT_TOTAL) AS max, avg(AMT_TOTAL) AS mean, round(stddev_samp(AMT_TOTAL), 3) AS std FROM wide")
def q_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = "AMT_TOTAL"
    rows = view(spark, sf_dir, "wide")
    spread = column_quantiles(rows, [c], [0.01, 0.5, 0.99]).withColumnRenamed("quantiles", "q")
    found = rows.agg(F.lit(c).alias("column"), F.count(c).alias("n"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("mean"), F.round(F.stddev_samp(c), 3).alias("std")).join(spread, "column")
    return found.select(F.col("q")[0].alias("q01"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q99"), "n", "min", "max", "mean", "std")


@query(WIDE + "SELECT bool_and((AMT_TOTAL IS NULL) = (CNT_ITEMS IS NULL)) AS coincide FROM wide")
def q_coincidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coincide(view(spark, sf_dir, "wide"), F.col("AMT_TOTAL").isNull(), F.col("CNT_ITEMS").isNull())


@query(WIDE + "SELECT NAME_PRIORITY AS level, count(*) AS n, avg(TARGET) AS rate FROM wide GROUP BY NAME_PRIORITY")
def q_rate_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_by(view(spark, sf_dir, "wide"), F.col("NAME_PRIORITY"), TARGET)


@query(WIDE + "SELECT SK_ID_CURR, AMT_TOTAL FROM wide ORDER BY AMT_TOTAL DESC NULLS LAST, SK_ID_CURR LIMIT 3")
def q_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_rows(view(spark, sf_dir, "wide"), "AMT_TOTAL", ID, 3).select(ID, "AMT_TOTAL")


@query(WIDE + "SELECT round(stddev_samp(AMT_TOTAL) FILTER (AMT_TOTAL > 0), 3) AS std_positive, quantile_cont(AMT_TOTAL, 0.25) AS q25, quantile_cont(AMT_TOTAL, 0.75) AS q75 FROM wide")
def q_filtered_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("AMT_TOTAL")
    return view(spark, sf_dir, "wide").agg(F.round(F.stddev_samp(F.when(c > 0, c)), 3).alias("std_positive"), F.percentile(c, F.lit(0.25)).alias("q25"), F.percentile(c, F.lit(0.75)).alias("q75"))


@query(WIDE + "SELECT CAST(floor(EXT_SCORE / 2) AS INT) AS bin, count(*) AS n, round(count(*) / (sum(count(*)) OVER ()) / 2, 9) AS density FROM wide WHERE EXT_SCORE >= 0 AND EXT_SCORE < 10 GROUP BY 1")
def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram(view(spark, sf_dir, "wide"), "EXT_SCORE", 0.0, 10.0, 5).withColumn("density", F.round("density", 9))


@query(WIDE + "SELECT CASE WHEN CNT_ITEMS >= -3 AND CNT_ITEMS < 10 THEN '[-3, 10)' WHEN CNT_ITEMS >= 10 AND CNT_ITEMS < 20 THEN '[10, 20)' WHEN CNT_ITEMS >= 20 AND CNT_ITEMS < 34 THEN '[20, 34)' END AS level, count(*) AS n, avg(TARGET) AS rate FROM wide GROUP BY 1")
def q_rate_by_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rate_by(view(spark, sf_dir, "wide"), band(F.col("CNT_ITEMS"), [-3, 10, 20, 34]), TARGET)


@query(WIDE + "SELECT round(corr(AMT_TOTAL, CNT_ITEMS), 9) AS r FROM wide")
def q_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "wide").where("AMT_TOTAL IS NOT NULL AND CNT_ITEMS IS NOT NULL").agg(F.round(F.corr("AMT_TOTAL", "CNT_ITEMS"), 9).alias("r"))


@query(WIDE + "SELECT NAME_PRIORITY AS level, round(1.96 * sqrt(avg(TARGET) * (1 - avg(TARGET)) / count(*)), 9) AS half_width, avg(CASE WHEN CNT_ITEMS > 10 THEN 1 ELSE 0 END) AS share_over FROM wide GROUP BY NAME_PRIORITY")
def q_half_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    rate = F.avg(TARGET)
    return view(spark, sf_dir, "wide").groupBy(F.col("NAME_PRIORITY").alias("level")).agg(F.round(1.96 * F.sqrt(rate * (1 - rate) / F.count("*")), 9).alias("half_width"), F.avg(F.coalesce(F.col("CNT_ITEMS") > 10, F.lit(False)).cast("int")).alias("share_over"))


@query(WIDE + _union(f"SELECT '{c}' AS column, round(greatest(max({c}) - avg({c}), avg({c}) - min({c})) / stddev_pop({c}), 6) AS largest FROM wide" for c in ("AMT_TOTAL", "CNT_ITEMS", "AMT_TAIL")))
def q_largest_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return largest_z(view(spark, sf_dir, "wide"), ["AMT_TOTAL", "CNT_ITEMS", "AMT_TAIL"]).withColumn("largest", F.round("largest", 6))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{s}', '{fam}', {n})" for s in assemble.SOURCES for fam, n in {f.family: sum(1 for g in assemble.features_of(s) if g.family == f.family) for f in assemble.features_of(s)}.items()) + ", " + ", ".join(f"('{s}', 'history', 1)" for s in assemble.SOURCES) + ") AS t(source, family, n)")
def q_catalog_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.catalog(spark).groupBy("source", "family").agg(F.count("*").cast("int").alias("n"))
