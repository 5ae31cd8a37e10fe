"""Evaluation queries: labels as outcomes, a coarse score of document length as the probability, so that many scores tie."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import metrics
from cairn.plans.registry import query
from cairn.plans.views import ctes, view
from cairn.runs.config import RunConfig

SCORES = f"WITH {ctes('scores')} "
BY = ["model"]


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, y, model, p of two models."""
    rows = view(spark, sf_dir, "scores")
    pairs = F.array(F.struct(F.lit("a").alias("model"), F.col("p").alias("p")), F.struct(F.lit("b").alias("model"), F.col("p2").alias("p")))
    return rows.select("doc_id", "y", F.inline(pairs))


MODELS = SCORES + ", m AS (SELECT doc_id, y, 'a' AS model, p FROM scores UNION ALL SELECT doc_id, y, 'b', p2 FROM scores) "
GROUPED = ", g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM m GROUP BY model, p)"
UP = ", u AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)"
DOWN = ", w AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY model) AS np, sum(neg) OVER (PARTITION BY model) AS nn FROM g WINDOW d AS (PARTITION BY model ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"
LOSS = "-CASE WHEN y = 1 THEN ln(p) ELSE ln(1.0::DOUBLE - p) END"


def _rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(MODELS + GROUPED + UP + " SELECT model, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 9) AS roc_auc FROM u GROUP BY model")
def q_roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_auc(models(spark, sf_dir), BY))


@query(MODELS + GROUPED + DOWN + " SELECT model, round(sum(pos * tp / (tp + fp)) / max(np), 9) AS average_precision FROM w GROUP BY model")
def q_avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.average_precision(models(spark, sf_dir), BY))


PROPER = (
    f"SELECT model, round(v, 9) AS prevalence, round(ll, 9) AS log_loss, round(-(v * ln(v) + (1 - v) * ln(1 - v)), 9) AS log_loss_prevalence_baseline, round(b, 9) AS brier_score, round(v * (1 - v), 9) AS brier_prevalence_baseline, round(1 - b / (v * (1 - v)), 9) AS brier_skill_score "
    f"FROM (SELECT model, avg(y) AS v, avg({LOSS}) AS ll, avg((p - y) * (p - y)) AS b FROM m GROUP BY model)"
)


@query(MODELS + PROPER)
def q_log_loss_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.proper_scores(models(spark, sf_dir), BY))


QUANTILE = ", e AS (SELECT model, list_sort(list_distinct(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM m GROUP BY model)"
UNIFORM = ", e AS (SELECT DISTINCT model, list_transform(range(11), lambda i: i / 10) AS edges FROM m)"
BINNED = ", bins AS (SELECT model, bin, count(*) AS n, avg(p) AS mean_predicted, avg(y) AS observed_rate, any_value(edges) AS edges FROM (SELECT m.*, edges, CAST(least(greatest(len(list_filter(edges, lambda x: x <= p)) - 1, 0), len(edges) - 2) AS INT) AS bin FROM m JOIN e USING (model)) GROUP BY model, bin)"
TABLE = " SELECT model, bin, round(edges[bin + 1], 9) AS lower, round(edges[bin + 2], 9) AS upper, n, round(mean_predicted, 9) AS mean_predicted, round(observed_rate, 9) AS observed_rate, round(observed_rate - mean_predicted, 9) AS gap FROM bins"


@query(MODELS + QUANTILE + BINNED + TABLE)
def q_calibration_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.calibration_table(models(spark, sf_dir), BY))


@query(MODELS + UNIFORM + BINNED + TABLE)
def q_calibration_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.calibration_table(models(spark, sf_dir), BY, strategy="uniform"))


@query(MODELS + QUANTILE + BINNED + " SELECT model, round(sum(n * abs(observed_rate - mean_predicted)) / sum(n), 9) AS expected_calibration_error FROM bins GROUP BY model")
def q_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.expected_calibration_error(metrics.calibration_table(models(spark, sf_dir), BY), BY))


@query(MODELS + GROUPED + DOWN + " SELECT model, round(p, 9) AS threshold, round(fp / nn, 9) AS fpr, round(tp / np, 9) AS tpr FROM w")
def q_roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.roc_points(models(spark, sf_dir), BY))


@query(MODELS + GROUPED + DOWN + ' SELECT model, round(p, 9) AS threshold, round(tp / (tp + fp), 9) AS "precision", round(tp / np, 9) AS recall FROM w')
def q_pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.pr_points(models(spark, sf_dir), BY))


@query(MODELS + ", t AS (SELECT m.*, max(p) OVER (PARTITION BY model) AS top, count(*) OVER (PARTITION BY model, y) AS total FROM m) SELECT model, y, CAST(least(floor(p / top * 50), 49) AS INT) AS bin, count(*) AS n, round(count(*) / max(total) / (max(top) / 50), 9) AS density FROM t GROUP BY model, y, 3")
def q_score_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.score_histogram(models(spark, sf_dir), BY))


ALL = (
    MODELS + GROUPED + UP + DOWN + QUANTILE + BINNED
    + ", x AS (SELECT model, count(*) AS n, CAST(sum(y) AS BIGINT) AS n_positive, avg(p) AS mean_predicted_probability, quantile_cont(p, 0.5) AS median_predicted_probability, max(p) AS max_predicted_probability, avg(y) AS prevalence, "
    + f"avg({LOSS}) AS log_loss, avg((p - y) * (p - y)) AS brier_score FROM m GROUP BY model), "
    "auc AS (SELECT model, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc FROM u GROUP BY model), ap AS (SELECT model, sum(pos * tp / (tp + fp)) / max(np) AS average_precision FROM w GROUP BY model), "
    "ece AS (SELECT model, sum(n * abs(observed_rate - mean_predicted)) / sum(n) AS expected_calibration_error FROM bins GROUP BY model), "
    "r AS (SELECT model, n, n_positive, mean_predicted_probability, median_predicted_probability, max_predicted_probability, prevalence, log_loss, -(prevalence * ln(prevalence) + (1 - prevalence) * ln(1 - prevalence)) AS log_loss_prevalence_baseline, brier_score, "
    "prevalence * (1 - prevalence) AS brier_prevalence_baseline, 1 - brier_score / (prevalence * (1 - prevalence)) AS brier_skill_score, roc_auc, average_precision, expected_calibration_error, prevalence AS average_precision_prevalence_baseline "
    "FROM x JOIN auc USING (model) JOIN ap USING (model) JOIN ece USING (model))"
)


@query(ALL + " SELECT model, n, n_positive, round(COLUMNS(* EXCLUDE (model, n, n_positive)), 9) FROM r")
def q_metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.metric_table(models(spark, sf_dir), BY))


@query(ALL + " SELECT r.model, " + ", ".join(f"round(r.{m}, 9) AS {m}, round(r.{m} - f.{m}, 9) AS delta_{m}, round(100 * (r.{m} - f.{m}) / f.{m}, 6) AS rel_{m}_pct" for m in metrics.BOOTSTRAP_METRICS) + " FROM r, (SELECT * FROM r WHERE model = 'a') f")
def q_model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = metrics.weighted_metrics(models(spark, sf_dir).withColumn("w", F.lit(1)), BY)
    found = metrics.compare_models(table, "a")
    return found.select("model", *[F.round(c, 6 if c.endswith("_pct") else 9).alias(c) for c in found.columns if c != "model"])


REPLICATES = 20
#: As in a run.
WHOLE = RunConfig().replicates


def _boot(replicates: int) -> str:
    return (
        MODELS + ", ids AS (SELECT doc_id, y, row_number() OVER (ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 1, 2), doc_id) - 1 AS row, count(*) OVER () AS total FROM (SELECT DISTINCT doc_id, y FROM m)), "
        f"draws AS (SELECT rep, CAST('0x' || substr(md5('42:' || rep || ':' || draw), 1, 12) AS BIGINT) % total AS row FROM (SELECT unnest(range({replicates})) AS rep), (SELECT total, unnest(range(total)) AS draw FROM (SELECT max(total) AS total FROM ids))), "
        "wt AS (SELECT rep, row, count(*) AS w FROM draws GROUP BY rep, row), s AS (SELECT rep, model, m.y, p, w FROM wt JOIN ids USING (row) JOIN m USING (doc_id)), "
        "g AS (SELECT rep, model, p, coalesce(sum(w) FILTER (y = 1), 0) AS pos, coalesce(sum(w) FILTER (y = 0), 0) AS neg FROM s GROUP BY rep, model, p), "
        "ranked AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY rep, model ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp FROM g WINDOW d AS (PARTITION BY rep, model ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), "
        "one AS (SELECT rep, model, sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * tp / (tp + fp)) / sum(pos) AS average_precision FROM ranked GROUP BY rep, model), "
        f"two AS (SELECT rep, model, sum(w * ({LOSS})) / sum(w) AS log_loss, sum(w * (p - y) * (p - y)) / sum(w) AS brier_score FROM s GROUP BY rep, model), reps AS (SELECT * FROM one JOIN two USING (rep, model))"
    )


BOOT = _boot(REPLICATES)


@query(BOOT + " SELECT rep, model, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision, round(log_loss, 9) AS log_loss, round(brier_score, 9) AS brier_score FROM reps")
def q_bootstrap_replicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.bootstrap_replicates(models(spark, sf_dir), "doc_id", REPLICATES, 42)
    return _rounded(found.withColumn("rep", F.col("rep").cast("long")))


def _poisson(replicates: int) -> str:
    """The same with independent counts: how many of the cumulated Poisson(1) probabilities a uniform draw reaches."""
    steps = [math.exp(-1) * sum(1 / math.factorial(j) for j in range(k)) for k in range(1, 20)]
    w = " + ".join(f"CAST(u >= {s!r}::DOUBLE AS INT)" for s in steps)
    head, tail = _boot(replicates).split("draws AS (", 1)[0], _boot(replicates).split("g AS (", 1)[1]
    return (
        head + f"draws AS (SELECT rep, doc_id, y, CAST('0x' || substr(md5('42:' || rep || ':' || doc_id), 1, 12) AS BIGINT)::DOUBLE / 281474976710656::DOUBLE AS u FROM (SELECT unnest(range({replicates})) AS rep), ids), "
        f"s AS (SELECT rep, model, m.y, p, {w} AS w FROM draws JOIN m USING (doc_id) WHERE u >= {steps[0]!r}::DOUBLE), g AS (" + tail
    )


@query(_poisson(REPLICATES) + " SELECT rep, model, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision, round(log_loss, 9) AS log_loss, round(brier_score, 9) AS brier_score FROM reps")
def q_bootstrap_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.bootstrap_replicates(models(spark, sf_dir), "doc_id", REPLICATES, 42, "poisson")
    return _rounded(found.withColumn("rep", F.col("rep").cast("long")))


LONG_REPS = ", l AS (" + " UNION ALL ".join(f"SELECT rep, model, '{m}' AS metric, {m} AS value FROM reps" for m in metrics.BOOTSTRAP_METRICS) + ")"


@query(BOOT + LONG_REPS + " SELECT model, metric, round(quantile_cont(value, 0.025), 7) AS ci_low, round(quantile_cont(value, 0.975), 7) AS ci_high, round(avg(value), 7) AS bootstrap_mean, round(stddev_samp(value), 7) AS bootstrap_sd FROM l GROUP BY model, metric")
def q_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = metrics.paired_bootstrap(models(spark, sf_dir), "doc_id", "a", REPLICATES)
    return _rounded(table.select("model", "metric", "ci_low", "ci_high", "bootstrap_mean", "bootstrap_sd"), 7)


@query(
    BOOT + LONG_REPS + ", d AS (SELECT metric, b.value - a.value AS value FROM l a JOIN l b USING (rep, metric) WHERE a.model = 'a' AND b.model = 'b'), s2 AS (SELECT metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, "
    "avg(CASE WHEN metric IN ('roc_auc', 'average_precision') THEN CAST(value > 0 AS INT) ELSE CAST(value < 0 AS INT) END) AS f FROM d GROUP BY metric) SELECT 'b' AS model, 'a' AS base, metric, round(lo, 7) AS ci_low, round(hi, 7) AS ci_high, round(f, 7) AS fraction_improving, lo > 0 OR hi < 0 AS ci_excludes_zero FROM s2"
)
def q_bootstrap_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, table = metrics.paired_bootstrap(models(spark, sf_dir), "doc_id", "a", REPLICATES)
    return _rounded(table.select("model", "base", "metric", "ci_low", "ci_high", "fraction_improving", "ci_excludes_zero"), 7)


@query(_boot(WHOLE) + " SELECT rep, model, round(roc_auc, 9) AS roc_auc, round(average_precision, 9) AS average_precision, round(log_loss, 9) AS log_loss, round(brier_score, 9) AS brier_score FROM reps")
def q_bootstrap_replicates_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.bootstrap_replicates(models(spark, sf_dir), "doc_id", WHOLE, 42)
    return _rounded(found.withColumn("rep", F.col("rep").cast("long")))


@query(_boot(WHOLE) + LONG_REPS + " SELECT model, metric, round(quantile_cont(value, 0.025), 7) AS ci_low, round(quantile_cont(value, 0.975), 7) AS ci_high, round(avg(value), 7) AS bootstrap_mean, round(stddev_samp(value), 7) AS bootstrap_sd FROM l GROUP BY model, metric")
def q_bootstrap_ci_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    table, _ = metrics.paired_bootstrap(models(spark, sf_dir), "doc_id", "a", WHOLE)
    return _rounded(table.select("model", "metric", "ci_low", "ci_high", "bootstrap_mean", "bootstrap_sd"), 7)


@query(
    _boot(WHOLE) + LONG_REPS + ", d AS (SELECT metric, b.value - a.value AS value FROM l a JOIN l b USING (rep, metric) WHERE a.model = 'a' AND b.model = 'b'), s2 AS (SELECT metric, quantile_cont(value, 0.025) AS lo, quantile_cont(value, 0.975) AS hi, "
    "avg(CASE WHEN metric IN ('roc_auc', 'average_precision') THEN CAST(value > 0 AS INT) ELSE CAST(value < 0 AS INT) END) AS f FROM d GROUP BY metric) SELECT 'b' AS model, 'a' AS base, metric, round(lo, 7) AS ci_low, round(hi, 7) AS ci_high, round(f, 7) AS fraction_improving, lo > 0 OR hi < 0 AS ci_excludes_zero FROM s2"
)
def q_bootstrap_differences_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, table = metrics.paired_bootstrap(models(spark, sf_dir), "doc_id", "a", WHOLE)
    return _rounded(table.select("model", "base", "metric", "ci_low", "ci_high", "fraction_improving", "ci_excludes_zero"), 7)


@query(SCORES + "SELECT count(*) AS n, count(*) FILTER (p IS NULL OR p < 0 OR p > 1) AS bad_p, count(*) FILTER (y NOT IN (0, 1)) AS bad_y FROM scores")
def q_prediction_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "scores")
    metrics.check_predictions(rows)
    return rows.agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("bad_p"), F.lit(0).cast("long").alias("bad_y"))


@query()
def q_calibration_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    slope, intercept = metrics.calibration_line(view(spark, sf_dir, "scores"))
    return spark.createDataFrame([(slope, intercept)], "slope double, intercept double")
