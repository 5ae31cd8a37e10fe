import json

import pytest
from pyspark.sql import functions as F
from test_features import APPLIED, BUREAU, CARD, CARDS, CREDITS, INSTALLMENTS, LOANS, MONTHS, PAYMENTS, POS, PREVIOUS
from test_metrics import applications

from cairn.operators import selection
from cairn.operators.models import Challenger, ChallengerSpec, early_stop, log_loss_of
from cairn.runs import build, config, experiments
from cairn.sources.tables import TABLES, MissingTable


def raw_files(spark, folder):
    for name, rows, schema in (
        ("bureau", CREDITS, BUREAU), ("bureau_balance", MONTHS, "SK_ID_BUREAU int, MONTHS_BALANCE int, STATUS string"), ("previous", APPLIED, PREVIOUS), ("installments", PAYMENTS, INSTALLMENTS), ("credit_card", CARDS, CARD), ("pos", LOANS, POS),
    ):
        df = spark.createDataFrame(rows, schema).toPandas()
        for c in TABLES[name].columns:
            if c not in df:
                df[c] = None
        df.to_csv(folder / TABLES[name].file, index=False)


def test_build_and_cache(spark, tmp_path):
    raw_files(spark, tmp_path)
    paths = config.Paths(tmp_path / "out")
    first = build.build_all(spark, str(tmp_path), paths, ("bureau", "pos"))
    assert {s: (e["status"], e["customers"]) for s, e in first.items()} == {"bureau": ("built", 2), "pos": ("built", 2)} and first["pos"]["audit"]["grain"][0]["rows"] == 5
    assert all(e["status"] == "cached" for e in build.build_all(spark, str(tmp_path), paths, ("bureau", "pos")).values())
    assert build.load_source_table(spark, "pos", str(tmp_path), paths).count() == 2
    file = tmp_path / TABLES["pos"].file
    file.write_text(file.read_text().replace("Completed", "Signed"))
    with pytest.raises(ValueError, match="raw"):
        build.load_source_table(spark, "pos", str(tmp_path), paths)
    again = build.build_all(spark, str(tmp_path), paths, ("bureau", "pos"))
    assert [again[s]["status"] for s in ("bureau", "pos")] == ["cached", "built"]
    with pytest.raises(MissingTable):
        build.load_source_table(spark, "previous", str(tmp_path), paths)
    assert build.main([str(tmp_path / "nowhere"), str(tmp_path / "out2")]) == 2


def test_baseline(spark, tmp_path):
    paths, df = config.Paths(tmp_path), applications(spark, 300).cache()
    base = experiments.run_baseline(df, config.QUICK, paths)
    assert base["converged"] and base["metrics_test"]["n"] == 60 and json.loads(paths.metrics("baseline").read_text())["metrics_train"]["n"] == 240
    experiments.verify_reference(base["metrics_test"], dict(base["metrics_test"]))
    with pytest.raises(ValueError):
        experiments.verify_reference(base["metrics_test"], base["metrics_test"] | {"roc_auc": 0.0})


def test_boosting_goes_on_until_patience_ends_it(spark):
    assert (config.RunConfig().rounds, config.RunConfig().patience, ChallengerSpec().rounds) == (5000, 100, 5000)
    assert early_stop([3.0, 2.0, 2.5, 2.0, 1.0], 2) == (2, True) and early_stop([3.0, 2.0, 2.5, 1.0], 2) == (4, False)
    df = applications(spark, 400).withColumn("TARGET", F.expr("cast((coalesce(EXT_SOURCE_1, 0.6) > 0.5) <> (SK_ID_CURR % 11 = 0) as int)")).cache()
    train, valid = (df.where(f"SK_ID_CURR % 4 {op} 0").cache() for op in ("<>", "="))
    spec = ChallengerSpec(rounds=400).with_params(learning_rate=0.1, max_depth=2)
    model = Challenger(spec).fit(train, valid, patience=4)
    whole = Challenger(spec.locked(model.n_trees + 4)).fit(train)
    best, losses = whole.best_rounds(valid)
    assert model.early_stopped and model.n_trees == best > 8 and early_stop(losses, 4) == (best, True)
    assert log_loss_of(model.predict(valid), valid) == pytest.approx(losses[best - 1] / 2, abs=1e-9)
    capped = Challenger(spec.locked(5)).fit(train, valid, patience=4)
    assert capped.n_trees == 5 and not capped.early_stopped


def test_relational_retunes_and_verifies_the_baseline(spark, tmp_path, monkeypatch):
    paths, df = config.Paths(tmp_path), applications(spark, 200).cache()
    base = experiments.run_baseline(df, config.QUICK, paths)
    history = df.select("SK_ID_CURR", (F.col("SK_ID_CURR") % 7).cast("float").alias("pos__count"))
    tried = []
    loss = {2: 0.5, 4: 0.4}
    monkeypatch.setattr(experiments, "evaluator", lambda fit, valid, config: lambda spec: tried.append((spec.rounds, spec.get("max_depth"), "pos__count" in fit.columns)) or {"val_log_loss": loss[spec.get("max_depth")], "n_trees": 2, "early_stopped": True})
    monkeypatch.setattr(experiments, "final_stage", lambda df, train, test, spec, *more: {"spec": spec.to_dict()})
    monkeypatch.setattr(experiments.selection, "ablation_configs", lambda sources: [("M0_application", "sequential", ())])
    out = experiments.run_relational(df, {"pos": history}, config.QUICK, paths)
    assert out["reference"]["reloaded"] and out["reference"]["metrics"]["log_loss"] == pytest.approx(base["metrics_test"]["log_loss"], abs=1e-9)
    assert tried == [(3, 4, True), (3, 2, True)] and out["spec"] == json.loads(paths.metrics("relational_selection").read_text())["retune"]["locked"] and out["spec"]["rounds"] == 2
    recorded = json.loads(paths.metrics("baseline").read_text())
    recorded["metrics_test"]["roc_auc"] += 1e-4
    paths.metrics("baseline").write_text(json.dumps(recorded))
    with pytest.raises(ValueError, match="differs"):
        experiments.run_relational(df, {"pos": history}, config.QUICK, paths)


def test_challengers_resume_and_reload(spark, tmp_path, monkeypatch):
    paths, df, fits = config.Paths(tmp_path), applications(spark, 200).cache(), []

    def evaluator(stop):
        def evaluate(spec):
            if len(fits) == stop:
                raise InterruptedError
            fits.append(spec.key())
            return {"val_log_loss": 0.5 + 0.01 * len(fits), "n_trees": 2, "early_stopped": True}

        return lambda *_: evaluate

    monkeypatch.setattr(experiments, "evaluator", evaluator(2))
    with pytest.raises(InterruptedError):
        experiments.run_challengers(df, config.QUICK, paths)
    assert not paths.lock.exists() and len(json.loads(paths.trials.with_suffix(".json").read_text())["state"]["records"]) == 2
    monkeypatch.setattr(experiments, "evaluator", evaluator(None))
    out = experiments.run_challengers(df, config.QUICK, paths, resume=True)
    assert len(fits) == len(set(fits)) == 6 and out["n_trees"] == 2 and out["spec"] == json.loads(paths.lock.read_text())["spec"]
    held = experiments.reload_final(paths)
    assert held["metrics"] == json.loads(json.dumps(out["metrics"])) and {m["model"] for m in held["metrics"]} == {"logistic_regression", "boosted_trees"}
    paths.metrics("boosted_trees").write_text(paths.metrics("boosted_trees").read_text().replace('"n_trees": 2', '"n_trees": 3'))
    with pytest.raises(ValueError, match="changed"):
        experiments.reload_final(paths)
    with pytest.raises(ValueError, match="another run"):
        selection.TrialLog.resumed(paths.trials, {"rows": "others"})


def test_relational_locks_before_test_rows_get_histories(spark, tmp_path, monkeypatch):
    paths, df = config.Paths(tmp_path), applications(spark, 100).cache()
    history = df.select("SK_ID_CURR", (F.col("SK_ID_CURR") % 7).cast("float").alias("pos__count"))
    build_matrix, locked = experiments.assemble.build_matrix, []
    monkeypatch.setattr(experiments.assemble, "build_matrix", lambda part, *more: locked.append((part.count(), paths.metrics("relational_lock").exists())) or build_matrix(part, *more))
    monkeypatch.setattr(experiments, "evaluator", lambda *_: lambda spec: {"val_log_loss": 0.5, "n_trees": 2, "early_stopped": True})
    monkeypatch.setattr(experiments, "final_stage", lambda df, train, test, spec, *more: {"rows": (train.count(), test.count())})
    monkeypatch.setattr(experiments.selection, "ablation_configs", lambda sources: [])
    assert experiments.run_relational(df, {"pos": history}, config.QUICK, paths)["rows"] == (80, 20) and locked == [(80, False), (20, True)]
    with pytest.raises(SystemExit):
        experiments.main(["relational", "a.csv", str(tmp_path)])
    assert experiments.main(["baseline", str(tmp_path / "none.csv"), str(tmp_path)]) == 2


def test_trials_of_a_stage():
    log = selection.TrialLog()
    for n, (stage, loss) in enumerate((("initial", 0.5), ("search:max_depth", 0.4), ("search:seed", 0.3), ("ablation:heavy_tail", 0.2))):
        log.run(ChallengerSpec(seed=n), lambda _, loss=loss: {"val_log_loss": loss}, stage)
    assert [(r["trial"], r["best"]) for r in log.of_stage("search")] == [(1, False), (2, True)] and [r["trial"] for r in log.of_stage() if r["best"]] == [3]
    assert log.of_stage("none") == [] and "best" not in log.records[0]


def test_missing_indicators_must_gain(spark, monkeypatch):
    for gain, want in ((4e-4, "none"), (6e-4, "all")):
        loss = {"none": 0.5, "all": 0.5 - gain, "deduplicated": 0.6}
        monkeypatch.setattr(experiments, "evaluator", lambda fit, valid, config, loss=loss: lambda spec: {"val_log_loss": loss[spec.missing_indicators], "n_trees": 2, "early_stopped": True})
        log = selection.TrialLog()
        spec, _ = experiments.select_challenger(applications(spark, 60), config.QUICK, log)
        assert spec.missing_indicators == want and [r["about"] for r in log.records if r["stage"] == "ablation:missing_indicators"] == ["all", "deduplicated"]
