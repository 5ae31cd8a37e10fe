"""Cleaning, preprocessing and split queries, and the last source once more with SQL written by hand rather than from the feature list."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import canonical_missing
from cairn.operators import assemble, metrics, pos, quality, selection, split
from cairn.operators.preprocessing import LinearPreprocessor, TreePreprocessor
from cairn.plans.feature_queries import shown
from cairn.plans.quality_queries import SPLIT, WIDE
from cairn.plans.registry import query
from cairn.plans.views import ctes, view
from cairn.sources.tables import ID, TARGET, split_target


@query(
    "SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN 'name' ELSE c_mktsegment END AS name, "
    "CASE WHEN c_custkey % 4 <> 0 THEN c_acctbal END AS amount FROM customer"
)
def q_canonical_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    turn = F.col("c_custkey") % 6
    name = F.when(turn == 0, "NA").when(turn == 1, " null ").when(turn == 2, "").when(turn == 3, "name").otherwise(F.col("c_mktsegment"))
    amount = F.when(F.col("c_custkey") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal").cast("double"))
    return canonical_missing(customer.select("c_custkey", name.alias("name"), amount.alias("amount")))


@query(WIDE + "SELECT SK_ID_CURR, round(ln(1 + CASE WHEN AMT_TAIL < 0 THEN 0 ELSE AMT_TAIL END), 4) AS amt_tail FROM wide")
def q_log1p(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "wide").select(ID, "AMT_TAIL")
    out = TreePreprocessor(heavy_tail="log1p", heavy_tail_columns=["AMT_TAIL"]).fit(rows).transform(rows)
    return out.select(ID, F.round(F.col("AMT_TAIL").cast("double"), 4).alias("amt_tail"))


@query(WIDE + """, m AS (SELECT quantile_cont(AMT_TOTAL, 0.5) AS med FROM wide),
filled AS (SELECT SK_ID_CURR, coalesce(AMT_TOTAL, med) AS x, CASE WHEN AMT_TOTAL IS NULL THEN 1.0 ELSE 0.0 END AS gap, coalesce(NAME_PRIORITY, 'missing') AS level FROM wide, m),
s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(gap) AS mg, stddev_pop(gap) AS sg FROM filled)
SELECT SK_ID_CURR, round((x - mx) / sx, 6) AS amt_total, round((gap - mg) / sg, 6) AS amt_total_missing, """ + ", ".join(
    f"CASE WHEN level = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS level_{n}" for n, v in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "XNA", "missing"))
) + " FROM filled, s")
def q_linear_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians, missing indicators, scaling and one-hot levels, routed by column type."""
    rows = view(spark, sf_dir, "wide").select(ID, "AMT_TOTAL", "NAME_PRIORITY")
    out = LinearPreprocessor().fit(rows).transform(rows, (ID,)).withColumn("x", vector_to_array("features"))
    number = lambda n: F.round(F.get("x", F.lit(n)), 6)
    return out.select(ID, number(0).alias("amt_total"), number(1).alias("amt_total_missing"), *[F.get("x", F.lit(2 + n)).alias(f"level_{n}") for n in range(5)])


@query(WIDE + """SELECT 'as it is' AS labels, 'valid' AS verdict UNION ALL SELECT 'gaps', CAST(count(*) FILTER (SK_ID_CURR % 10 = 0) AS VARCHAR) || ' missing labels' FROM wide
UNION ALL SELECT 'a third label', 'unexpected labels [''2'']' UNION ALL SELECT 'one label', 'a single class'""")
def q_validate_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels, y = view(spark, sf_dir, "wide").select(ID, TARGET), F.col(TARGET)
    cases = {
        "as it is": labels, "gaps": labels.withColumn(TARGET, F.when(F.col(ID) % 10 != 0, y)), "a third label": labels.withColumn(TARGET, F.when(F.col(ID) % 10 == 0, 2).otherwise(y)),
        "one label": labels.withColumn(TARGET, F.lit(1)),
    }
    out = []
    for name, df in cases.items():
        try:
            quality.validate_target(df)
            out.append((name, "valid"))
        except ValueError as e:
            out.append((name, str(e)))
    return spark.createDataFrame(out, "labels string, verdict string")


@query(f"WITH {ctes('application')} SELECT SK_ID_CURR, c_mktsegment, c_nationkey, TARGET AS label FROM application")
def q_features_and_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    features, labels = split_target(view(spark, sf_dir, "application"))
    return metrics.check_lengths(features, labels, ID).withColumnRenamed(TARGET, "label")


@query(f"WITH {ctes('scores')} SELECT doc_id, y, p FROM scores")
def q_aligned_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = view(spark, sf_dir, "scores")
    return metrics.check_lengths(scores.select("doc_id", "y"), scores.select("doc_id", "p"), "doc_id")


@query(SPLIT + "SELECT a.SK_ID_CURR, a.TARGET AS label, s.split AS part FROM application a JOIN s ON a.SK_ID_CURR = s.SK_ID_CURR")
def q_frozen_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "application").select(ID, TARGET)
    train, test = split.frozen_split(rows, split.stratified_split(rows))
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).withColumnRenamed(TARGET, "label")


#: The nineteen features of the source, each written out.
POS_BY_HAND = """, d AS (SELECT *, CASE WHEN SK_DPD > 0 THEN 1.0 ELSE 0.0 END AS late, CASE WHEN NAME_CONTRACT_STATUS = 'Completed' THEN 1.0 ELSE 0.0 END AS done FROM pos),
c AS (SELECT SK_ID_CURR, sum(done) AS n FROM (SELECT SK_ID_CURR, SK_ID_PREV, max(done) AS done FROM d WHERE SK_ID_PREV IS NOT NULL GROUP BY ALL) GROUP BY SK_ID_CURR),
f AS (SELECT SK_ID_CURR, count(*) AS n_months, count(DISTINCT SK_ID_PREV) AS n_contracts, min(MONTHS_BALANCE) AS months_min, max(MONTHS_BALANCE) AS months_max,
  avg(CNT_INSTALMENT) AS cnt_instalment_mean, max(CNT_INSTALMENT) AS cnt_instalment_max, avg(CNT_INSTALMENT_FUTURE) AS instalments_future_mean, max(CNT_INSTALMENT_FUTURE) AS instalments_future_max,
  avg(CASE WHEN CNT_INSTALMENT > 0 THEN CNT_INSTALMENT_FUTURE / CNT_INSTALMENT END) AS remaining_share_mean, avg(SK_DPD) AS dpd_mean, max(SK_DPD) AS dpd_max, avg(late) AS dpd_positive_rate,
  avg(CASE WHEN SK_DPD > 30 THEN 1.0 ELSE 0.0 END) AS severe_dpd_rate, max(SK_DPD_DEF) AS dpd_def_max, avg(CASE WHEN SK_DPD_DEF > 0 THEN 1.0 ELSE 0.0 END) AS dpd_def_positive_rate,
  avg(CASE WHEN MONTHS_BALANCE >= -12 THEN late END) AS recent_dpd_rate, avg(CASE WHEN NAME_CONTRACT_STATUS = 'Active' THEN 1.0 ELSE 0.0 END) AS active_month_share, avg(done) AS completed_month_share
  FROM d GROUP BY SK_ID_CURR)
SELECT f.* EXCLUDE (SK_ID_CURR), f.SK_ID_CURR, coalesce(c.n, 0) AS completed_contracts FROM f LEFT JOIN c ON f.SK_ID_CURR = c.SK_ID_CURR"""
POS_NAMES = (
    "n_months", "n_contracts", "months_min", "months_max", "cnt_instalment_mean", "cnt_instalment_max", "instalments_future_mean", "instalments_future_max", "remaining_share_mean", "dpd_mean", "dpd_max",
    "dpd_positive_rate", "severe_dpd_rate", "dpd_def_max", "dpd_def_positive_rate", "recent_dpd_rate", "active_month_share", "completed_month_share", "completed_contracts",
)


@query(f"WITH {ctes('pos')}{POS_BY_HAND}".replace("SELECT f.* EXCLUDE (SK_ID_CURR), f.SK_ID_CURR, coalesce(c.n, 0) AS completed_contracts", "SELECT f.SK_ID_CURR, " + ", ".join(
    f"CAST(CAST({'coalesce(c.n, 0)' if n == 'completed_contracts' else n} AS FLOAT) AS DOUBLE) AS {n}" for n in POS_NAMES)))
def q_pos_features_by_hand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shown(pos.build(view(spark, sf_dir, "pos"))).select(ID, *[F.col(f"pos__{n}").alias(n) for n in POS_NAMES])


@query("SELECT * FROM (VALUES " + ", ".join(f"({n}, '{c}')" for n, c in enumerate(POS_NAMES)) + ", (19, 'has_history')) AS t(position, name)")
def q_catalog_of_pos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assemble.catalog(spark, ("pos",)).select("position", F.regexp_replace("column", "^pos__", "").alias("name"))


@query("""SELECT * FROM (VALUES (0, 'SK_ID_CURR', 'application', true), (1, 'bureau__credit_count', 'bureau', true), (2, 'AMT_TOTAL', 'application', true), (3, 'pos__dpd_max', 'pos', false),
(4, 'bureau__has_history', 'bureau', true), (5, 'other__x', 'application', true)) AS t(position, name, source, kept)""")
def q_columns_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["SK_ID_CURR", "bureau__credit_count", "AMT_TOTAL", "pos__dpd_max", "bureau__has_history", "other__x"]
    kept = assemble.columns_for(names, ("bureau",))
    return spark.createDataFrame([(n, c, assemble.source_of(c), c in kept) for n, c in enumerate(names)], "position int, name string, source string, kept boolean")


@query(f"""WITH {ctes('scores')}, l AS (SELECT avg(-(y * ln(p) + (1 - y) * ln(1 - p))) AS a, avg(-(y * ln(p2) + (1 - y) * ln(1 - p2))) AS b FROM scores),
t(trial, label, loss) AS (SELECT 0, 'p', a FROM l UNION ALL SELECT 1, 'p2', b FROM l)
SELECT trial, label, round(loss, 9) AS loss, loss = min(loss) OVER () AS best FROM t""")
def q_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two logged trials, scored on the same rows; the least loss is marked."""
    scores, y = view(spark, sf_dir, "scores"), F.col("y")
    loss = lambda p: F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - F.col(p))))
    found = scores.agg(loss("p").alias("p"), loss("p2").alias("p2")).first().asDict()
    log = selection.TrialLog()
    for label in ("p", "p2"):
        log.run(selection.ChallengerSpec(seed=len(log.records)), lambda _, label=label: {"val_log_loss": found[label]}, "initial", label)
    return spark.createDataFrame([(r["trial"], r["about"], round(r["val_log_loss"], 9), r["best"]) for r in log.of_stage("initial")], "trial int, label string, loss double, best boolean")
