"""Model and selection queries on small settings over the driver's tables. Fits are iterative, so most have no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import assemble, metrics, previous, selection, split
from cairn.operators.models import Challenger, ChallengerSpec, LinearModel, log_loss_of
from cairn.operators.provenance import content_digest, table_schema
from cairn.plans.registry import query
from cairn.plans.views import view
from cairn.sources.tables import ID, TARGET

SMALL = ChallengerSpec(rounds=5, params=(("max_depth", 3), ("min_instances", 10), ("column_share", 0.5), ("row_share", 0.8), ("learning_rate", 0.1)))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with a label and their previous-application features."""
    apps = view(spark, sf_dir, "application").withColumn("c_nationkey", F.col("c_nationkey").cast("double"))
    features = previous.build(view(spark, sf_dir, "previous"))
    names = ["previous__count", "previous__approval_rate", "previous__amt_application_mean", "previous__days_decision_max", "previous__last_application_refused"]
    return assemble.build_matrix(apps.drop(TARGET), {"previous": features.select(ID, *names)}, check=False).join(apps.select(ID, TARGET), ID)


def parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = matrix(spark, sf_dir)
    membership = split.stratified_split(rows)
    joined = rows.join(membership, ID)
    return joined.where("split = 'train'").drop("split"), joined.where("split = 'test'").drop("split")


@query()
def q_logistic_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = parts(spark, sf_dir)
    return LinearModel().fit(train).predict(test)


@query()
def q_logistic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = parts(spark, sf_dir)
    scored = LinearModel().fit(train).predict(test).join(test.select(ID, F.col(TARGET).alias("y")), ID)
    return metrics.metric_table(metrics.as_model(scored, "logistic_regression"), ["model"])


@query()
def q_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = parts(spark, sf_dir)
    return Challenger(SMALL).fit(train).predict(test)


@query()
def q_importance_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, _ = parts(spark, sf_dir)
    rows = Challenger(SMALL).fit(train).importance(assemble.source_of)
    return spark.createDataFrame(rows, "source string, gain double, splits int, share double, used int, top array<string>").withColumn("top", F.array_join("top", ","))


@query()
def q_best_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = parts(spark, sf_dir)
    rounds, losses = Challenger(SMALL).fit(train).best_rounds(test)
    return spark.createDataFrame([(n + 1, float(v), n + 1 == rounds) for n, v in enumerate(losses)], "rounds int, loss double, best boolean")


@query()
def q_coordinate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = (df.cache() for df in parts(spark, sf_dir))
    log = selection.TrialLog()
    evaluate = lambda spec: {"val_log_loss": log_loss_of(Challenger(spec).fit(train).predict(test), test)}
    selection.coordinate_search(SMALL, (("max_depth", (2, 3)), ("learning_rate", (0.05, 0.1))), evaluate, log)
    return spark.createDataFrame([(r["trial"], r["stage"], r["about"], r["val_log_loss"]) for r in log.records], "trial int, stage string, about string, val_log_loss double")


GRID = ("bureau", "previous", "installments", "credit_card", "pos")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{g}', '{'+'.join(s)}')" for n, g, s in (
    ("M0_application", "sequential", ()), ("M1_+bureau", "sequential", GRID[:1]), ("M2_+previous", "sequential", GRID[:2]), ("M3_+installments", "sequential", GRID[:3]), ("M4_+credit_card", "sequential", GRID[:4]), ("M5_+pos", "sequential", GRID),
    ("S_previous", "single", ("previous",)), ("S_installments", "single", ("installments",)), ("S_credit_card", "single", ("credit_card",)), ("S_pos", "single", ("pos",)),
    ("L-bureau", "leave-one-out", GRID[1:]), ("L-previous", "leave-one-out", ("bureau", *GRID[2:])), ("L-installments", "leave-one-out", (*GRID[:2], *GRID[3:])), ("L-credit_card", "leave-one-out", (*GRID[:3], "pos")),
)) + ") AS t(name, kind, sources)")
def q_ablation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(n, g, "+".join(s)) for n, g, s in selection.ablation_configs(GRID)], "name string, kind string, sources string")


@query("SELECT count(*) AS rows, count(DISTINCT c_custkey) AS customers FROM customer")
def q_table_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = table_schema(view(spark, sf_dir, "application"))
    return spark.createDataFrame([(held["rows"], held["customers"])], "rows long, customers long")


@query()
def q_content_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = content_digest(view(spark, sf_dir, "application"))
    return spark.createDataFrame([(held["rows"], held["sum"], held["xor"])], "rows long, sum string, xor long")
