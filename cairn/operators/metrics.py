"""Evaluation of probabilities as DataFrame algebra: ranking, proper scores, calibration, curves and bootstrap.

All functions take rows of (y, p), optionally weighted by w, in groups ``by``; a table of one model is a group of one.
Scores are first reduced to one row for each distinct score of a group, so ties are exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions import clip_high, clip_low, clipped_logit
from cairn.operators.ranking import number_rows, quantiles, running_sums

EPS = 2.220446049250313e-16
BOOTSTRAP_METRICS = ("roc_auc", "average_precision", "log_loss", "brier_score")
HIGHER_IS_BETTER = {"roc_auc": True, "average_precision": True, "log_loss": False, "brier_score": False}


def as_model(df: DataFrame, name: str = "model") -> DataFrame:
    """One group of all rows."""
    return df.withColumn("model", F.lit(name))


def check_predictions(df: DataFrame, y: str = "y", p: str = "p") -> None:
    """Raises unless there are rows, every y is 0 or 1, and every p is a number in [0, 1]."""
    bad = F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1)
    n, bad_p, bad_y = df.agg(F.count("*"), F.sum(F.coalesce(bad, F.lit(True)).cast("int")), F.sum((~F.coalesce(F.col(y).isin(0, 1), F.lit(False))).cast("int"))).first()
    if not n or bad_p or bad_y:
        raise ValueError(f"{n} rows, {bad_p or 0} probabilities outside [0, 1], {bad_y or 0} labels other than 0 and 1")


def check_lengths(labels: DataFrame, scores: DataFrame, key: str) -> DataFrame:
    """labels joined with scores one to one; raises if either side has keys of its own."""
    n, m = labels.count(), scores.count()
    joined = labels.join(scores, key)
    if n != m or joined.count() != n:
        raise ValueError(f"{n} labels and {m} scores do not pair up by {key}")
    return joined


def by_score(df: DataFrame, by: list[str], w: str | None = None, y: str = "y", p: str = "p") -> DataFrame:
    """by, p, pos, neg: the weight of either class at each distinct score."""
    weight = F.col(w) if w else F.lit(1)
    return df.groupBy(*by, F.col(p).alias("p")).agg(F.sum(F.when(F.col(y) == 1, weight).otherwise(0)).alias("pos"), F.sum(F.when(F.col(y) == 0, weight).otherwise(0)).alias("neg"))


def roc_auc(df: DataFrame, by: list[str], w: str | None = None) -> DataFrame:
    """The probability that a positive outranks a negative, ties counting half; null with a single class."""
    ranked = running_sums(by_score(df, by, w), by, "p", ["neg"])
    sums = ranked.groupBy(*by).agg(F.sum(F.col("pos") * (F.col("before_neg") + F.col("neg") / 2)).alias("_u"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    return sums.select(*by, F.when((F.col("_p") > 0) & (F.col("_n") > 0), F.col("_u") / (F.col("_p") * F.col("_n"))).alias("roc_auc"))


def average_precision(df: DataFrame, by: list[str], w: str | None = None) -> DataFrame:
    """The step sum of precision over recall at distinct scores from the top, without interpolation."""
    ranked = running_sums(by_score(df, by, w), by, "p", ["pos", "neg"], descending=True)
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    sums = ranked.groupBy(*by).agg(F.sum(F.when(tp + fp > 0, F.col("pos") * tp / (tp + fp)).otherwise(0.0)).alias("_s"), F.sum("pos").alias("_p"))
    return sums.select(*by, F.when(F.col("_p") > 0, F.col("_s") / F.col("_p")).alias("average_precision"))


def row_log_loss(y: Column, p: Column) -> Column:
    q = clip_high(clip_low(p, EPS), 1 - EPS)
    return -F.when(y == 1, F.log(q)).otherwise(F.log(F.lit(1.0) - q))


def proper_scores(df: DataFrame, by: list[str], w: str | None = None) -> DataFrame:
    """Log loss and Brier score with those of constant prevalence, and the skill against it (null where that is 0)."""
    y, p, weight = F.col("y"), F.col("p"), F.col(w) if w else F.lit(1.0)
    total = df.groupBy(*by).agg(
        F.sum(weight).alias("_w"), F.sum(weight * y).alias("_pos"), F.sum(weight * row_log_loss(y, p)).alias("_ll"), F.sum(weight * (p - y) * (p - y)).alias("_b"),
    ).withColumn("prevalence", F.col("_pos") / F.col("_w"))
    v = F.col("prevalence")
    both = (v > 0) & (v < 1)
    return total.select(
        *by, "prevalence", (F.col("_ll") / F.col("_w")).alias("log_loss"), F.when(both, -(v * F.log(v) + (1 - v) * F.log(1 - v))).otherwise(0.0).alias("log_loss_prevalence_baseline"),
        (F.col("_b") / F.col("_w")).alias("brier_score"), (v * (1 - v)).alias("brier_prevalence_baseline"), F.when(both, 1 - F.col("_b") / F.col("_w") / (v * (1 - v))).alias("brier_skill_score"),
    )


def bin_edges(df: DataFrame, by: list[str], bins: int, strategy: str) -> DataFrame:
    steps = [i / bins for i in range(bins + 1)]
    found = df.groupBy(*by).agg(F.min("p").alias("_lo"), F.max("p").alias("_hi"))
    if strategy == "quantile":
        found = found.join(quantiles(df, by, "p", steps), by, "left").withColumn("edges", F.array_sort(F.array_distinct("quantiles")))
    elif strategy == "uniform":
        found = found.withColumn("edges", F.array(*[F.lit(s) for s in steps]))
    else:
        raise ValueError("strategy is quantile or uniform")
    return found.select(*by, F.when(F.size("edges") < 2, F.array("_lo", F.col("_hi") + 1e-12)).otherwise(F.col("edges")).alias("edges"))


def calibration_table(df: DataFrame, by: list[str], bins: int = 10, strategy: str = "quantile") -> DataFrame:
    """by, bin, lower, upper, n, mean_predicted, observed_rate, gap. A bin holds its lower edge; the last holds both; empty ones are left out."""
    binned = df.join(F.broadcast(bin_edges(df, by, bins, strategy)), by)
    at = F.size(F.filter("edges", lambda e: e <= F.col("p"))) - 1
    at = F.when(at < 0, 0).when(at > F.size("edges") - 2, F.size("edges") - 2).otherwise(at)
    rows = binned.withColumn("bin", at.cast("int")).groupBy(*by, "bin").agg(F.any_value("edges").alias("edges"), F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed_rate"))
    return rows.select(*by, "bin", F.get("edges", F.col("bin")).alias("lower"), F.get("edges", F.col("bin") + 1).alias("upper"), "n", "mean_predicted", "observed_rate", (F.col("observed_rate") - F.col("mean_predicted")).alias("gap"))


def expected_calibration_error(table: DataFrame, by: list[str]) -> DataFrame:
    return table.groupBy(*by).agg((F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("expected_calibration_error"))


def calibration_line(df: DataFrame, y: str = "y", p: str = "p", eps: float = 1e-12, c: float = 1e6, steps: int = 100) -> tuple[float | None, float | None]:
    """(slope, intercept) of a logistic fit of y on logit(p) for one model; (None, None) where there is none.

    Newton's method on two parameters: each step is one aggregation of five sums. The slope has the penalty 1 / c.
    """
    rows = df.select(F.col(y).cast("double").alias("y"), clipped_logit(F.col(p), eps).alias("x"))
    lo1, hi1, lo0, hi0 = rows.agg(*[f(F.when(F.col("y") == k, F.col("x"))) for k in (1, 0) for f in (F.min, F.max)]).first()
    if lo1 is None or lo0 is None or min(lo0, lo1) == max(hi0, hi1) or lo1 > hi0 or hi1 < lo0:
        return None, None
    a = b = 0.0
    for _ in range(steps):
        q = F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(a) + F.lit(b) * F.col("x"))))
        v, r = q * (1 - q), F.col("y") - q
        ga, gb, haa, hab, hbb = rows.agg(F.sum(r), F.sum(r * F.col("x")), F.sum(v), F.sum(v * F.col("x")), F.sum(v * F.col("x") * F.col("x"))).first()
        gb, hbb = gb - b / c, hbb + 1 / c
        det = haa * hbb - hab * hab
        if det <= 0:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < 1e-10 * max(1.0, abs(a), abs(b)):
            break
    return b, a


def metric_table(df: DataFrame, by: list[str], bins: int = 10) -> DataFrame:
    """One row for each group with counts, references, ranking, proper scores, calibration error and the spread of p."""
    spread = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum("y").cast("long").alias("n_positive"), F.avg("p").alias("mean_predicted_probability"), F.max("p").alias("max_predicted_probability"),
    )
    middle = quantiles(df, by, "p", [0.5]).select(*by, F.col("quantiles")[0].alias("median_predicted_probability"))
    out = spread.join(middle, by, "left").select(*by, "n", "n_positive", "mean_predicted_probability", "median_predicted_probability", "max_predicted_probability")
    for part in (proper_scores(df, by), roc_auc(df, by), average_precision(df, by), expected_calibration_error(calibration_table(df, by, bins), by)):
        out = out.join(part, by)
    return out.withColumn("average_precision_prevalence_baseline", F.col("prevalence"))


def metric_bundle(df: DataFrame, bins: int = 10) -> dict:
    """All metrics of one model as a dict, with the calibration line."""
    check_predictions(df)
    row = metric_table(as_model(df), ["model"], bins).drop("model").first().asDict()
    slope, intercept = calibration_line(df)
    return row | {"calibration_slope": slope, "calibration_intercept": intercept}


def compare_models(metrics: DataFrame, reference: str, names: tuple[str, ...] = BOOTSTRAP_METRICS) -> DataFrame:
    """``metrics`` with the absolute and the percentage difference to the reference model; raises if that is not there."""
    if metrics.where(F.col("model") == reference).isEmpty():
        raise KeyError(reference)
    ref = metrics.where(F.col("model") == reference).select(F.lit(1).alias("_one"), *[F.col(m).alias(f"_ref_{m}") for m in names])
    joined = metrics.withColumn("_one", F.lit(1)).join(F.broadcast(ref), "_one")
    deltas = {f"delta_{m}": F.col(m) - F.col(f"_ref_{m}") for m in names}
    percent = {f"rel_{m}_pct": F.when(F.col(f"_ref_{m}") != 0, 100 * (F.col(m) - F.col(f"_ref_{m}")) / F.col(f"_ref_{m}")) for m in names}
    return joined.withColumns(deltas | percent).drop("_one", *[f"_ref_{m}" for m in names])


def roc_points(df: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, fpr, tpr at each distinct score."""
    ranked = running_sums(by_score(df, by), by, "p", ["pos", "neg"], descending=True)
    totals = ranked.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    points = ranked.join(totals, by)
    return points.select(*by, F.col("p").alias("threshold"), F.when(F.col("_n") > 0, (F.col("before_neg") + F.col("neg")) / F.col("_n")).alias("fpr"), F.when(F.col("_p") > 0, (F.col("before_pos") + F.col("pos")) / F.col("_p")).alias("tpr"))


def pr_points(df: DataFrame, by: list[str]) -> DataFrame:
    """by, threshold, precision, recall at each distinct score."""
    ranked = running_sums(by_score(df, by), by, "p", ["pos", "neg"], descending=True)
    totals = ranked.groupBy(*by).agg(F.sum("pos").alias("_p"))
    tp, fp = F.col("before_pos") + F.col("pos"), F.col("before_neg") + F.col("neg")
    return ranked.join(totals, by).select(*by, F.col("p").alias("threshold"), (tp / (tp + fp)).alias("precision"), F.when(F.col("_p") > 0, tp / F.col("_p")).alias("recall"))


def score_histogram(df: DataFrame, by: list[str], bins: int = 50) -> DataFrame:
    """by, y, bin, n, density: scores of either class in equal bins from 0 to the largest score of the group."""
    top = df.groupBy(*by).agg(F.max("p").alias("_top"))
    at = F.floor(F.when(F.col("_top") > 0, F.col("p") / F.col("_top")).otherwise(0.0) * bins)
    rows = df.join(F.broadcast(top), by).withColumn("bin", F.when(at > bins - 1, bins - 1).otherwise(at).cast("int"))
    counts = rows.groupBy(*by, "y", "bin").agg(F.count("*").alias("n"), F.any_value("_top").alias("_top"))
    sizes = counts.groupBy(*by, "y").agg(F.sum("n").alias("_all"))
    return counts.join(sizes, [*by, "y"]).select(*by, "y", "bin", "n", F.when(F.col("_top") > 0, F.col("n") / F.col("_all") / (F.col("_top") / bins)).alias("density"))


def draw_weights(n: int, replicates: int, seed: int, spark) -> DataFrame:
    """rep, row, w: how often each of rows 0 to n - 1 is drawn in n draws with replacement. Draws are hashes of (seed, rep, draw)."""
    draw = spark.range(n * replicates).select(F.expr(f"cast(id div {n} as int)").alias("rep"), F.expr(f"id % {n}").alias("draw"))
    text = F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col("draw").cast("string"))
    row = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") % F.lit(n)
    return draw.select("rep", row.alias("row")).groupBy("rep", "row").agg(F.count("*").alias("w"))


def poisson_weights(rows: DataFrame, key: str, replicates: int, seed: int) -> DataFrame:
    """rep, key, w by independent Poisson(1) counts of each row: no numbering and no shuffle, for tables too large for exact draws."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("rep").cast("string"), F.col(key).cast("string"))), 1, 12), 16, 10).cast("double") / F.lit(float(16**12))
    below, total, term = F.lit(0), 0.0, math.exp(-1)
    for k in range(1, 20):
        total += term
        below = below + (u >= F.lit(total)).cast("int")
        term /= k
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).withColumn("w", below.cast("long"))


def weighted_metrics(df: DataFrame, by: list[str], w: str = "w") -> DataFrame:
    return roc_auc(df, by, w).join(average_precision(df, by, w), by).join(proper_scores(df, by, w).select(*by, "log_loss", "brier_score"), by)


def bootstrap_replicates(predictions: DataFrame, key: str, replicates: int, seed: int, draws: str = "exact") -> DataFrame:
    """rep, model and the four metrics. predictions: key, y, model, p. All models of a replicate share its draws.

    draws: ``exact`` ones with replacement, or ``poisson``: independent counts for each row, which need no numbering and
    no shuffle of draws. A replicate that draws one class alone is scored with weights of one.
    """
    spark = predictions.sparkSession
    rows = predictions.select(key, "y").distinct()
    if draws == "poisson":
        weights = poisson_weights(rows, key, replicates, seed).where("w > 0")
    elif draws == "exact":
        rows = number_rows(rows, key)
        weights = draw_weights(rows.count(), replicates, seed, spark).join(rows, "row")
    else:
        raise ValueError("draws are exact or poisson")
    single = weights.groupBy("rep").agg((F.min("y") == F.max("y")).alias("_single")).where("_single").select("rep")
    drawn = weights.join(single, "rep", "left_anti").select("rep", key, "w")
    unit = single.withColumn("_one", F.lit(1)).join(rows.withColumn("_one", F.lit(1)), "_one").select("rep", key, F.lit(1).cast("long").alias("w"))
    scored = drawn.unionByName(unit).join(predictions, key)
    return weighted_metrics(scored, ["rep", "model"])


def long_metrics(table: DataFrame, keys: list[str], names: tuple[str, ...] = BOOTSTRAP_METRICS) -> DataFrame:
    return table.select(*keys, F.explode(F.map_from_arrays(F.array(*[F.lit(m) for m in names]), F.array(*[F.col(m).cast("double") for m in names]))).alias("metric", "value"))


def paired_bootstrap(predictions: DataFrame, key: str, reference: str, replicates: int = 1000, seed: int = 42, confidence: float = 0.95, draws: str = "exact") -> tuple[DataFrame, DataFrame]:
    """(models, differences). models: model, metric, estimate, ci_low, ci_high, bootstrap_mean, bootstrap_sd. differences: the
    same of model minus base for each model against the reference and for each pair of the others, in order of name,
    with fraction_improving and ci_excludes_zero.
    """
    if predictions.where(F.col("model") == reference).isEmpty():
        raise KeyError(reference)
    tail = (1 - confidence) / 2
    reps = long_metrics(bootstrap_replicates(predictions, key, replicates, seed, draws), ["rep", "model"])
    point = long_metrics(weighted_metrics(predictions.withColumn("w", F.lit(1)), ["model"]), ["model"]).withColumnRenamed("value", "estimate")

    def summary(df: DataFrame, by: list[str], *more: Column) -> DataFrame:
        ci = F.percentile("value", F.array(F.lit(tail), F.lit(1 - tail)))
        return df.groupBy(*by).agg(ci.alias("_ci"), F.avg("value").alias("bootstrap_mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("bootstrap_sd"), *more).withColumns({"ci_low": F.col("_ci")[0], "ci_high": F.col("_ci")[1]}).drop("_ci")

    models = summary(reps, ["model", "metric"]).join(point, ["model", "metric"])
    base = reps.select("rep", "metric", F.col("model").alias("base"), F.col("value").alias("_base"))
    wanted = (F.col("model") != F.col("base")) & ((F.col("base") == reference) | ((F.col("model") != reference) & (F.col("model") > F.col("base"))))
    # Sums in another order differ in their last bits; what is below 12 decimals is no difference.
    diffs = reps.join(base, ["rep", "metric"]).where(wanted).withColumn("value", F.round(F.col("value") - F.col("_base"), 12))
    higher = F.col("metric").isin(*[m for m, up in HIGHER_IS_BETTER.items() if up])
    better = F.when(higher, F.col("value") > 0).otherwise(F.col("value") < 0)
    found = summary(diffs, ["model", "base", "metric"], F.avg(better.cast("int")).alias("fraction_improving"))
    base_point = point.select(F.col("model").alias("base"), "metric", F.col("estimate").alias("_base"))
    differences = found.join(point, ["model", "metric"]).join(base_point, ["base", "metric"]).withColumn("estimate", F.round(F.col("estimate") - F.col("_base"), 12)).drop("_base")
    return models, differences.withColumn("ci_excludes_zero", (F.col("ci_low") > 0) | (F.col("ci_high") < 0))
