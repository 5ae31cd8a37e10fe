"""The baseline, the challengers and the relational experiment, each as one function that leaves its artefacts in ``Paths``.

    python -m cairn.runs.experiments {baseline,challengers,relational} APPLICATION OUT_DIR [--raw RAW_DIR] [--quick] [--resume]
"""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys
import time
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import assemble, metrics, selection
from cairn.operators.models import Challenger, ChallengerSpec, LinearModel, log_loss_of
from cairn.operators.preprocessing import LinearPreprocessor
from cairn.operators.provenance import content_digest, fingerprint, load_checkpoint, save_checkpoint
from cairn.operators.quality import validate
from cairn.operators.split import frozen_split, stratified_split
from cairn.runs.build import load_source_table
from cairn.runs.config import QUICK, Paths, RunConfig, run_metadata
from cairn.sources.sinks import publish_json, write_report, write_table
from cairn.sources.tables import read_application


def scored(predictions: DataFrame, rows: DataFrame, config: RunConfig) -> DataFrame:
    """id, y, p."""
    return predictions.join(rows.select(config.id_column, F.col(config.target).cast("int").alias("y")), config.id_column)


def membership(df: DataFrame, config: RunConfig, paths: Paths) -> DataFrame:
    """The stored split, or a new one that is stored first."""
    spark = df.sparkSession
    try:
        return spark.read.parquet(paths.membership)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    write_table(stratified_split(df, config.test_size, config.seed, config.id_column, config.target), paths.membership)
    return spark.read.parquet(paths.membership)


#: What a fitted ``LinearPreprocessor`` has learned.
PREPROCESSOR = ("numeric", "categorical", "medians", "gappy", "scale", "levels", "features")


def run_baseline(df: DataFrame, config: RunConfig, paths: Paths) -> dict:
    """Validation report, frozen split, logistic regression, metrics of both parts, curves, model."""
    began = time.time()
    publish_json(validate(df, config.target, config.id_column), paths.metrics("data_validation"))
    train, test = (part.cache() for part in frozen_split(df, membership(df, config, paths), config.test_size, config.seed, config.id_column, config.target))
    model = LinearModel(id_column=config.id_column, target=config.target).fit(train)
    model.model.write().overwrite().save(paths.model("logistic_regression"))
    publish_json({name: getattr(model.preprocessor, name) for name in PREPROCESSOR}, paths.metrics("baseline_preprocessor"))
    parts = {name: scored(model.predict(rows), rows, config).cache() for name, rows in (("train", train), ("test", test))}
    out = {f"metrics_{name}": metrics.metric_bundle(p, config.bins) for name, p in parts.items()} | {"converged": model.converged, "iterations": model.iterations, "penalty": model.penalty, "fit_seconds": round(model.seconds, 1), "config": config.to_dict(), "run": run_metadata(began)}
    publish_json(out, paths.metrics("baseline"))
    write_table(parts["test"].select(config.id_column, "y", "p"), paths.report("baseline_predictions"))
    one = metrics.as_model(parts["test"])
    for name, table in (("roc", metrics.roc_points(one, ["model"])), ("pr", metrics.pr_points(one, ["model"])), ("calibration", metrics.calibration_table(one, ["model"], config.bins)), ("histogram", metrics.score_histogram(one, ["model"]))):
        write_report(table, paths.report(f"baseline_{name}"))
    return out


def verify_reference(recorded: dict, again: dict, tolerance: float = 1e-6) -> None:
    """Raises if any of the four metrics of a reloaded model is not what was recorded."""
    far = {m: (recorded[m], again[m]) for m in metrics.BOOTSTRAP_METRICS if abs(recorded[m] - again[m]) > tolerance}
    if far:
        raise ValueError(f"the reloaded reference differs: {far}")


def reload_baseline(config: RunConfig, paths: Paths) -> LinearModel:
    """The model that ``run_baseline`` left."""
    model, held = LinearModel(id_column=config.id_column, target=config.target), json.loads(paths.metrics("baseline_preprocessor").read_text())
    held["scale"] = {c: tuple(held["scale"][c]) for c in held["features"][: len(held["scale"])]}  # JSON has keys in another order
    model.preprocessor = LinearPreprocessor(id_column=config.id_column)
    for name, value in held.items():
        setattr(model.preprocessor, name, value)
    model.model = LogisticRegressionModel.load(paths.model("logistic_regression"))
    return model


def reference_verified(train: DataFrame, test: DataFrame, config: RunConfig, paths: Paths) -> dict:
    """Scores test with the recorded baseline, reloaded or else fitted again, and raises if that is not what was recorded. Nothing to verify if no baseline was recorded."""
    if not paths.metrics("baseline").exists():
        return {"recorded": False}
    recorded = json.loads(paths.metrics("baseline").read_text())["metrics_test"]
    reloaded = paths.metrics("baseline_preprocessor").exists()
    model = reload_baseline(config, paths) if reloaded else LinearModel(id_column=config.id_column, target=config.target).fit(train)
    again = metrics.metric_table(metrics.as_model(scored(model.predict(test), test, config)), ["model"], config.bins).first().asDict()
    if recorded["n"] != again["n"]:
        raise ValueError(f"the recorded reference was scored on {recorded['n']} rows, not {again['n']}")
    verify_reference(recorded, again, 1e-6 if reloaded else 1e-3)
    return {"recorded": True, "reloaded": reloaded, "metrics": {m: again[m] for m in metrics.BOOTSTRAP_METRICS}}


def evaluator(fit: DataFrame, valid: DataFrame, config: RunConfig):
    """spec -> the validation loss at its best round, that round, and whether patience ended the fit before the cap."""

    def evaluate(spec: ChallengerSpec) -> dict:
        model = Challenger(spec, config.id_column, config.target).fit(fit, valid, config.patience)
        return {"val_log_loss": log_loss_of(model.predict(valid), valid, config.id_column, config.target), "n_trees": model.n_trees, "early_stopped": model.early_stopped}

    return evaluate


#: Variants that must gain on the challengers' start, which has none.
MISSING_INDICATORS = ("all", "deduplicated")


def select_challenger(train: DataFrame, config: RunConfig, log: selection.TrialLog) -> tuple[ChallengerSpec, dict]:
    """Search and ablations on the training part alone, split once more; the number of rounds is locked last."""
    inner = stratified_split(train, config.validation_size, config.seed, config.id_column, config.target)
    fit, valid = (train.join(inner.where(F.col("split") == s), config.id_column).drop("split").cache() for s in ("train", "test"))
    evaluate = evaluator(fit, valid, config)
    best, record = selection.coordinate_search(ChallengerSpec(rounds=config.rounds, missing_indicators="none", seed=config.seed), config.axes, evaluate, log)
    tails = {t: ChallengerSpec(best.rounds, best.params, t, best.missing_indicators, best.seed) for t in ("log1p", "winsorize")}
    best, record, _ = selection.adopt_variant(best, record, tails, evaluate, log, "heavy_tail", config.min_gain)
    gaps = {m: ChallengerSpec(best.rounds, best.params, best.heavy_tail, m, best.seed) for m in MISSING_INDICATORS}
    best, record, _ = selection.adopt_variant(best, record, gaps, evaluate, log, "missing_indicators", config.min_gain)
    return best.locked(record["n_trees"]), record


def final_stage(df: DataFrame, train: DataFrame, test: DataFrame, spec: ChallengerSpec, config: RunConfig, paths: Paths, name: str) -> dict:
    """The locked challenger and the reference, refitted on all of train and scored on test once, with a paired bootstrap."""
    models = {"logistic_regression": LinearModel(id_column=config.id_column, target=config.target).fit(train), name: Challenger(spec, config.id_column, config.target).fit(train)}
    rows = None
    for label, model in models.items():
        part = scored(model.predict(test), test, config).withColumn("model", F.lit(label))
        rows = part if rows is None else rows.unionByName(part)
    rows = rows.cache()
    table = metrics.compare_models(metrics.metric_table(rows, ["model"], config.bins), "logistic_regression")
    write_report(table, paths.report(f"{name}_comparison"), ["model"])
    boot, differences = metrics.paired_bootstrap(rows, config.id_column, "logistic_regression", config.replicates, config.seed)
    importance = models[name].importance(assemble.source_of)
    out = {"spec": spec.to_dict(), "n_trees": models[name].n_trees, "metrics": [r.asDict() for r in table.collect()], "bootstrap": [r.asDict() for r in boot.collect()], "differences": [r.asDict() for r in differences.collect()], "importance": importance}
    publish_json(out | {"digest": fingerprint(out)}, paths.metrics(name))
    return out


def reload_final(paths: Paths, name: str = "boosted_trees") -> dict:
    """What ``final_stage`` recorded, without any fit; raises if it was not recorded whole or is no longer what was recorded."""
    try:
        held = json.loads(paths.metrics(name).read_text())
    except (FileNotFoundError, json.JSONDecodeError) as e:
        raise ValueError(f"{name} has no final record") from e
    if held.pop("digest", None) != fingerprint(held):
        raise ValueError(f"the final record of {name} was changed")
    return held


def run_challengers(df: DataFrame, config: RunConfig, paths: Paths, name: str = "boosted_trees", resume: bool = False) -> dict:
    """Selection on train, the lock, and the locked challenger on test. With ``resume``, trials that a stopped run has logged are not fitted again."""
    began = time.time()
    train, test = (part.cache() for part in frozen_split(df, membership(df, config, paths), config.test_size, config.seed, config.id_column, config.target))
    reference = reference_verified(train, test, config, paths)
    context = {"rows": content_digest(train), "config": fingerprint(config.to_dict())}
    log = selection.TrialLog.resumed(paths.trials, context) if resume else selection.TrialLog(paths.trials, context=context)
    spec, record = select_challenger(train, config, log)
    publish_json({"spec": spec.to_dict(), "validation": record, "config": config.to_dict()}, paths.lock)
    return final_stage(df, train, test, spec, config, paths, name) | {"reference": reference, "run": run_metadata(began)}


def retune(fit: DataFrame, valid: DataFrame, spec: ChallengerSpec, config: RunConfig, paths: Paths, context: dict, resume: bool = False) -> tuple[ChallengerSpec, dict]:
    """A small search from ``spec`` on the retained columns, with the rounds free again and locked last. Trials done by a run that stopped are not fitted again."""
    checkpoint = paths.root / "retune_checkpoint.json"
    found = (load_checkpoint(checkpoint, context, []) if resume else None) or {}
    fresh = evaluator(fit, valid, config)

    def evaluate(trial: ChallengerSpec) -> dict:
        if trial.key() not in found:
            found[trial.key()] = fresh(trial)
            save_checkpoint(checkpoint, context, [], found)
        return found[trial.key()]

    best, record = selection.coordinate_search(spec.locked(config.rounds), config.retune_axes, evaluate, selection.TrialLog(paths.retune_trials))
    return best.locked(record["n_trees"]), record


def run_relational(df: DataFrame, tables: dict[str, DataFrame], config: RunConfig, paths: Paths, resume: bool = False) -> dict:
    """Ablation grid on the inner split, backward elimination, retuning on the retained sources, then their final model. A run that stops goes on at the last configuration done.

    Test rows get their histories only after the final specification is locked in a file.
    """
    began, sources, key, target = time.time(), tuple(tables), config.id_column, config.target
    applied = [part.cache() for part in frozen_split(df, membership(df, config, paths), config.test_size, config.seed, key, target)]
    reference = reference_verified(*applied, config, paths)
    with_history = lambda part: assemble.build_matrix(part.drop(target), tables, key).join(part.select(key, target), key).cache()
    train = matrix = with_history(applied[0])
    inner = stratified_split(train, config.validation_size, config.seed, key, target)
    fit, valid = (train.join(inner.where(F.col("split") == s), key).drop("split").cache() for s in ("train", "test"))
    held = json.loads(paths.lock.read_text()) if paths.lock.exists() else None
    spec = ChallengerSpec.from_dict(held["spec"]) if held else ChallengerSpec(rounds=config.rounds, seed=config.seed)
    context = {"rows": content_digest(train.select(key, target)), "config": fingerprint(config.to_dict()), "spec": spec.to_dict(), "sources": sources}
    checkpoint = paths.root / "relational_checkpoint.json"
    records = (load_checkpoint(checkpoint, context, []) if resume else None) or {}
    predictions: dict[str, DataFrame] = {}

    def columns(subset: tuple[str, ...]) -> list[str]:
        return [c for c in assemble.columns_for(matrix.columns, subset)]

    def evaluate(subset: tuple[str, ...]) -> DataFrame:
        name = selection.config_name(subset, sources)
        if name not in predictions:
            model = Challenger(spec, key, target).fit(fit.select(*columns(subset)), None if held else valid, config.patience)
            predictions[name] = scored(model.predict(valid), valid, config).cache()
            if name not in records:
                row = metrics.metric_table(metrics.as_model(predictions[name], name), ["model"], config.bins).first().asDict()
                records[name] = row | {"n_features": len(model.preprocessor.features), "n_trees": model.n_trees}
                save_checkpoint(checkpoint, context, [], records)
        return predictions[name]

    def cost(full: tuple[str, ...], without: tuple[str, ...]) -> dict:
        both = evaluate(full).withColumn("model", F.lit("full")).unionByName(evaluate(without).withColumn("model", F.lit("without")))
        _, found = metrics.paired_bootstrap(both, key, "full", config.validation_replicates, config.seed)
        return found.where("metric = 'log_loss'").first().asDict()

    for name, _, subset in selection.ablation_configs(sources):
        if name not in records:
            evaluate(subset)
    write_report(df.sparkSession.createDataFrame([{"name": n, "log_loss": float(r["log_loss"]), "roc_auc": float(r["roc_auc"]), "n_features": int(r["n_features"])} for n, r in records.items()], "name string, log_loss double, roc_auc double, n_features int"), paths.report("ablation"), ["name"])
    kept = selection.backward_elimination(sources, cost)
    retained = columns(tuple(kept["retained"]))
    chosen = {"spec": spec.to_dict(), "retained": kept["retained"], "rounds": kept["rounds"]}
    publish_json(chosen, paths.metrics("relational_selection"))
    tuned, record = retune(fit.select(*retained), valid.select(*retained), spec, config, paths, context | {"retained": kept["retained"]}, resume)
    chosen["retune"] = {"locked": tuned.to_dict(), "validation": record, "axes": config.retune_axes}
    publish_json(chosen, paths.metrics("relational_selection"))
    publish_json({"spec": tuned.to_dict(), "retained": kept["retained"], "config": config.to_dict()}, paths.metrics("relational_lock"))
    final = final_stage(matrix, train.select(*retained), with_history(applied[1]).select(*retained), tuned, config, paths, "boosted_trees_relational")
    return final | {"retained": kept["retained"], "reference": reference, "retune": chosen["retune"], "records": records, "run": run_metadata(began)}


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(description="Run an experiment.")
    parser.add_argument("stage", choices=("baseline", "challengers", "relational"))
    parser.add_argument("application")
    parser.add_argument("out_dir")
    parser.add_argument("--raw")
    parser.add_argument("--sources", default=",".join(assemble.SOURCES))
    parser.add_argument("--quick", action="store_true")
    parser.add_argument("--resume", action="store_true")
    parser.add_argument("--rows", type=int)
    parser.add_argument("--bootstrap", type=int, help="replicates of the final intervals")
    given = parser.parse_args(args)
    if given.stage == "relational" and not given.raw:
        parser.error("relational needs --raw")
    spark = SparkSession.builder.appName(given.stage).getOrCreate()
    config, paths = QUICK if given.quick else RunConfig(), Paths(Path(given.out_dir))
    if given.bootstrap:
        config = dataclasses.replace(config, replicates=given.bootstrap)
    try:
        df = read_application(spark, given.application, rows=given.rows)
        if given.stage == "relational":
            tables = {s: load_source_table(spark, s, given.raw, paths, given.rows) for s in given.sources.split(",")}
            run_relational(df, tables, config, paths, given.resume)
        elif given.stage == "challengers":
            run_challengers(df, config, paths, resume=given.resume)
        else:
            run_baseline(df, config, paths)
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
