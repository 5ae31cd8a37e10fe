import hashlib
import random

import numpy as np
import pytest

from cairn.operators import metrics as M
from cairn.operators import preprocessing, quality, ranking, selection, split
from cairn.operators.models import Challenger, ChallengerSpec, LinearModel
from cairn.operators.preprocessing import LinearPreprocessor, TreePreprocessor, missing_groups
from cairn.plans import QUERIES

TIES = [(0, 0.1), (0, 0.3), (1, 0.3), (1, 0.8), (0, 0.2), (1, 0.9), (0, 0.3)]


def test_quantiles_are_those_of_numpy(spark):
    rng = np.random.default_rng(4)
    data = {"a": rng.standard_normal(501).tolist(), "b": [1.0] * 400 + [2.0] * 3, "c": rng.integers(0, 5, 300).astype(float).tolist() + [1e12, -1e12], "d": [7.0], "e": [None, float("nan")], "f": [float("inf"), 1.0, 2.0, 3.0, float("-inf")]}
    rows = spark.createDataFrame([(g, x) for g, xs in data.items() for x in [*xs, None]], "g string, x double").repartition(3)
    steps = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    found = {r.g: list(r.quantiles) for r in ranking.quantiles(rows, ["g"], "x", steps).collect()}
    assert set(found) == set("abcdf") and all(found[g] == pytest.approx(np.quantile(data[g], steps).tolist(), rel=1e-12) for g in "abcd")
    assert found["f"][0] == float("-inf") and found["f"][3] == 2.0 and found["f"][5] == float("inf")
    whole = {r.column: r.quantiles[0] for r in ranking.column_quantiles(rows.where("g = 'a'"), ["x"], [0.5]).collect()}
    assert whole == {"x": found["a"][3]}


def test_levels_have_a_limit(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"n{i}", "x") for i in range(30)], "SK_ID_CURR int, NAME string, KIND string")
    assert preprocessing.vocabulary(df, ["NAME", "KIND"])["KIND"] == ["x"]
    monkeypatch.setattr(preprocessing, "MOST_LEVELS", 30)
    with pytest.raises(ValueError, match="levels"):
        preprocessing.vocabulary(df, ["NAME", "KIND"])


def frame(spark, rows):
    return M.as_model(spark.createDataFrame([(i, int(y), float(p)) for i, (y, p) in enumerate(rows)], "id long, y int, p double"))


def test_ties(spark):
    df = frame(spark, TIES)
    assert M.roc_auc(df, ["model"]).first().roc_auc == pytest.approx(11 / 12)
    assert M.average_precision(df, ["model"]).first().average_precision == pytest.approx(13 / 15)


def test_perfect_and_constant(spark):
    best = M.metric_bundle(frame(spark, [(y, 0.98 * y + 0.01) for y in (0, 0, 1, 1, 0, 1)]).drop("model"))
    assert best["roc_auc"] == 1 and best["average_precision"] == pytest.approx(1) and best["brier_score"] < 0.001 and best["log_loss"] < 0.02 and best["calibration_slope"] is None
    rnd = random.Random(1)
    ys = [int(rnd.random() < 0.1) for _ in range(500)]
    v = sum(ys) / len(ys)
    flat = M.metric_bundle(frame(spark, [(y, v) for y in ys]).drop("model"))
    assert flat["brier_score"] == pytest.approx(v * (1 - v)) and flat["brier_skill_score"] == pytest.approx(0, abs=1e-9) and flat["roc_auc"] == 0.5 and flat["expected_calibration_error"] == pytest.approx(0, abs=1e-12)
    assert flat["log_loss"] == pytest.approx(flat["log_loss_prevalence_baseline"])


def test_calibration_line(spark):
    import math

    rnd = random.Random(2)
    ps = [rnd.uniform(0.02, 0.98) for _ in range(20000)]
    ys = [int(rnd.random() < p) for p in ps]
    slope, intercept = M.calibration_line(frame(spark, zip(ys, ps, strict=True)))
    assert slope == pytest.approx(1, abs=0.1) and intercept == pytest.approx(0, abs=0.15)
    sharp = [1 / (1 + math.exp(-2 * math.log(p / (1 - p)))) for p in ps]
    assert M.calibration_line(frame(spark, zip(ys, sharp, strict=True)))[0] == pytest.approx(0.5, abs=0.06)


@pytest.mark.parametrize("rows", [[(1, 1.5)], [(2, 0.5)], [(1, float("nan"))], []])
def test_bad_predictions(spark, rows):
    with pytest.raises(ValueError):
        M.check_predictions(frame(spark, rows))


def test_calibration_bins(spark):
    table = M.calibration_table(frame(spark, [(0, 0.1), (1, 0.9), (0, 0.2), (1, 0.8)]), ["model"], 4, "uniform").collect()
    assert sum(r.n for r in table) == 4
    one = M.calibration_table(frame(spark, [(0, 0.5), (1, 0.5)]), ["model"]).collect()
    assert len(one) == 1 and one[0].n == 2


def test_bootstrap_of_equal_models(spark):
    rnd = random.Random(3)
    base = [(i, int(rnd.random() < 0.3), rnd.random()) for i in range(80)]
    df = spark.createDataFrame([(i, y, m, p) for i, y, p in base for m in ("a", "b")], "id long, y int, model string, p double")
    models, diffs = M.paired_bootstrap(df, "id", "a", 10)
    assert all(r.estimate == 0 and r.ci_low == 0 and r.ci_high == 0 and not r.ci_excludes_zero for r in diffs.collect())
    assert all(r.ci_low <= r.bootstrap_mean <= r.ci_high for r in models.collect())
    weights = M.draw_weights(80, 3, 42, spark).groupBy("rep").sum("w").collect()
    assert all(r[1] == 80 for r in weights)
    with pytest.raises(KeyError):
        M.paired_bootstrap(df, "id", "c", 2)


def test_poisson_weights_have_mean_one(spark):
    rows = spark.range(2000).withColumnRenamed("id", "k")
    assert M.poisson_weights(rows, "k", 2, 1).agg({"w": "avg"}).first()[0] == pytest.approx(1, abs=0.06)


def test_comparison(spark):
    rows = [("ref", 0.75, 0.2, 0.25, 0.07), ("new", 0.77, 0.2, 0.24, 0.07)]
    got = {r.model: r for r in M.compare_models(spark.createDataFrame(rows, "model string, roc_auc double, average_precision double, log_loss double, brier_score double"), "ref").collect()}
    assert got["new"].delta_roc_auc == pytest.approx(0.02) and got["new"].delta_log_loss == pytest.approx(-0.01) and got["new"].rel_log_loss_pct == pytest.approx(-4.0)


def test_ablation_names():
    assert [n for n, _, _ in selection.ablation_configs(("a", "b", "c"))] == ["M0_application", "M1_+a", "M2_+b", "M3_+c", "S_b", "S_c", "L-a", "L-b"]
    abc = ("a", "b", "c")
    assert [selection.config_name(s, abc) for s in (("a",), ("b",), ("a", "b"), ("b", "c"))] == ["M1_+a", "S_b", "M2_+b", "L-a"]
    assert selection.config_name(("a", "d"), ("a", "b", "c", "d")) == "L-b-c"


def test_elimination():
    cost = lambda full, without: {"estimate": {"strong": 0.1, "weak": 0.02, "useless": 0.0}[next(iter(set(full) - set(without)))], "ci_low": {"strong": 0.05, "weak": 0.01, "useless": -0.01}[next(iter(set(full) - set(without)))]}
    assert selection.backward_elimination(("strong", "useless", "weak"), cost)["retained"] == ["strong", "weak"]


def test_search_and_log(tmp_path):
    log, best = selection.TrialLog(tmp_path / "log.csv"), {"max_depth": 3, "learning_rate": 0.1}
    loss = lambda spec: {"val_log_loss": abs(spec.get("max_depth") - best["max_depth"]) + abs(spec.get("learning_rate") - best["learning_rate"])}
    spec, record = selection.coordinate_search(ChallengerSpec(), (("max_depth", (3, 4, 6)), ("learning_rate", (0.02, 0.1))), loss, log)
    assert (spec.get("max_depth"), record["val_log_loss"]) == (3, 0) and len(log.records) == len({r["spec"] for r in log.records}) and (tmp_path / "log.csv").exists()
    assert ChallengerSpec.from_dict(spec.to_dict()).key() == spec.key() and spec.locked(7).rounds == 7
    kept, _, label = selection.adopt_variant(spec, record, {"log1p": ChallengerSpec(heavy_tail="log1p")}, loss, log, "tails")
    assert kept is spec and label is None


def applications(spark, n=400):
    rnd = random.Random(0)
    rows = []
    for i in range(n):
        ext, born = rnd.random(), -rnd.randrange(20 * 365, 65 * 365)
        rows.append((100000 + i, int(rnd.random() < 0.4 * (1 - ext)), rnd.choice(["Cash loans"] * 9 + ["Revolving loans"]), rnd.choice(["Laborers", "Sales staff", "Core staff", None]), rnd.lognormvariate(11.5, 0.9), born, 365243.0 if rnd.random() < 0.15 else -rnd.random() * 9000, None if rnd.random() < 0.2 else ext, 1))
    return spark.createDataFrame(rows, "SK_ID_CURR int, TARGET int, NAME_CONTRACT_TYPE string, OCCUPATION_TYPE string, AMT_INCOME_TOTAL double, DAYS_BIRTH int, DAYS_EMPLOYED double, EXT_SOURCE_1 double, FLAG_MOBIL int")


def test_quality(spark):
    df = applications(spark)
    report = quality.validate(df)
    assert report["overview"]["id_unique"] and report["overview"]["n_categorical"] == 2 and "FLAG_MOBIL" in {r["column"] for r in report["constant"]}
    gaps = {r["column"]: r["fraction"] for r in report["missingness"]}
    assert 0.15 < gaps["OCCUPATION_TYPE"] < 0.35 and any(r["finding"] == "sentinel" and r["n"] > 0 for r in report["suspicious"])
    with pytest.raises(TypeError):
        quality.column_types(df.selectExpr("SK_ID_CURR", "current_date() AS d"))
    with pytest.raises(ValueError, match="missing labels"):
        quality.validate_target(df.selectExpr("nullif(TARGET, 1) AS TARGET"))
    with pytest.raises(ValueError, match="single class"):
        quality.validate_target(df.where("TARGET = 1"))


def test_split(spark):
    df = applications(spark)
    parts = split.stratified_split(df)
    counts = {r.split: r["count"] for r in parts.groupBy("split").count().collect()}
    assert counts == {"test": 80, "train": 320}
    train, test = split.frozen_split(df, parts)
    assert train.join(test, "SK_ID_CURR").isEmpty() and train.count() == 320
    from pyspark.sql import functions as F

    with pytest.raises(ValueError):
        split.frozen_split(df, parts.where("split = 'test'"))
    with pytest.raises(ValueError):
        split.frozen_split(df, parts.withColumn("split", F.when(F.col("split") == "test", "train").otherwise("test")))


def test_tree_preprocessor(spark):
    df = applications(spark)
    rows = df.drop("TARGET")
    fitted = TreePreprocessor(heavy_tail="log1p", missing_indicators="deduplicated").fit(rows)
    assert fitted.tails == ["AMT_INCOME_TOTAL"] and fitted.levels["NAME_CONTRACT_TYPE"] == ["Cash loans", "Revolving loans"] and fitted.indicators == ["DAYS_EMPLOYED", "EXT_SOURCE_1"]
    from pyspark.sql import functions as F

    odd = fitted.transform(rows.withColumn("NAME_CONTRACT_TYPE", F.lit("unseen"))).select("NAME_CONTRACT_TYPE").distinct().collect()
    assert [r[0] for r in odd] == [None]
    with pytest.raises(ValueError):
        fitted.transform(rows.drop("AMT_INCOME_TOTAL"))
    with pytest.raises(ValueError):
        TreePreprocessor().fit(df)
    assert missing_groups(rows.selectExpr("*", "EXT_SOURCE_1 AS twin"), ["EXT_SOURCE_1", "OCCUPATION_TYPE", "twin"]) == [["EXT_SOURCE_1", "twin"], ["OCCUPATION_TYPE"]]


def test_linear_model_solves_its_equations(spark):
    import numpy as np

    df = applications(spark)
    fitted = LinearModel().fit(df)
    rows = LinearPreprocessor().fit(df.drop("TARGET")).transform(df, ("TARGET",)).collect()
    x, y = np.array([r.features.toArray() for r in rows]), np.array([r.TARGET for r in rows])
    w, b = fitted.model.coefficients.toArray(), fitted.model.intercept
    residual = y - 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ residual - w).max() < 1e-2 and abs(residual.sum()) < 1e-2 and fitted.converged
    assert fitted.predict(df).count() == 400


def test_boosted_trees(spark):
    df = applications(spark)
    model = Challenger(ChallengerSpec(rounds=4)).fit(df)
    assert model.n_trees == 4 and model.predict(df).where("p < 0 OR p > 1").isEmpty()
    rounds, losses = model.best_rounds(df)
    assert losses[rounds - 1] == min(losses)
    assert sum(r["share"] for r in model.importance(lambda c: "application")) == pytest.approx(1)


def test_audits_of_all_payments(spark, tmp_path):
    """Payments after the anchor count, however late."""
    spark.sql("SELECT 1 AS o_orderkey, 7 AS o_custkey, DATE '1998-12-01' AS o_orderdate UNION ALL SELECT 2, 8, DATE '1999-03-01'").write.parquet(f"{tmp_path}/orders.parquet")
    lines = "SELECT {0} AS l_orderkey, {1} AS l_partkey, 1 AS l_suppkey, {0} AS l_linenumber, DATE '{2}' AS l_shipdate, {3} AS l_extendedprice"
    spark.sql(" UNION ALL ".join(lines.format(*x) for x in ((1, 3, "1998-12-11", "100.0"), (1, 6, "1999-02-09", "100.0"), (2, 5, "1999-03-02", "50.0")))).write.parquet(f"{tmp_path}/lineitem.parquet")
    late = QUERIES["q_audit_lateness_all"](spark, str(tmp_path)).first()
    assert (late["mean"], late["median"], late["share_late"], late["share_severe"], late["max"]) == (27.0, 10.0, 1.0, pytest.approx(1 / 3), 70)
    ratio = QUERIES["q_audit_payment_ratio_all"](spark, str(tmp_path)).first()
    assert (ratio["median"], ratio["share_under"], ratio["share_over"], ratio["zero_scheduled"]) == (1.0, pytest.approx(1 / 3), 0.0, 0)


def test_whole_bootstrap_is_brute_force(spark, tmp_path):
    docs = [(i, 40 + 13 * i % 97) for i in range(12)]
    spark.createDataFrame(docs, "doc_id long, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2) for i, _ in docs], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    digest = lambda text: hashlib.md5(text.encode()).hexdigest()
    ids = sorted(range(12), key=lambda i: (digest(str(i))[:2], i))
    p = {i: (1 + n % 97) / 99 for i, n in docs}
    loss, want = [-np.log(p[i] if i % 2 else 1 - p[i]) for i in ids], []
    for rep in range(1000):
        drawn = [int(digest(f"42:{rep}:{k}")[:12], 16) % 12 for k in range(12)]
        one_class = len({ids[k] % 2 for k in drawn}) == 1
        want.append(np.mean([loss[k] for k in (range(12) if one_class else drawn)]))
    got = QUERIES["q_bootstrap_replicates_whole"](spark, str(tmp_path)).where("model = 'a'").orderBy("rep").collect()
    assert [r.rep for r in got] == list(range(1000)) and np.allclose([r.log_loss for r in got], want, atol=1e-8)
    ci = QUERIES["q_bootstrap_ci_whole"](spark, str(tmp_path)).where("model = 'a' AND metric = 'log_loss'").first()
    assert (ci.ci_low, ci.ci_high) == pytest.approx(tuple(np.percentile(want, [2.5, 97.5])), abs=1e-6)
