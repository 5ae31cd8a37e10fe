"""Models of pyspark.ml behind two small classes: penalised logistic regression and gradient-boosted trees.

No leaf-wise booster is at hand, so challengers are ``GBTClassifier`` models: level-wise trees without L1 or L2, nulls
filled out of range with an indicator. They stand in for boosters, and their scores are their own.
"""

from __future__ import annotations

import json
import math
import time
from dataclasses import dataclass, field, replace

from pyspark import SparkContext
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.metrics import as_model, proper_scores
from cairn.operators.preprocessing import LinearPreprocessor, TreePreprocessor
from cairn.sources.tables import ID, TARGET


@dataclass
class LinearModel:
    """L2 logistic regression with inverse penalty c; the intercept is free of it."""

    c: float = 1.0
    max_iter: int = 1000
    tol: float = 1e-8
    id_column: str = ID
    target: str = TARGET

    @property
    def penalty(self) -> str:
        """What the fit is penalised by, as a label that does not depend on the library's parameters."""
        return "none" if math.isinf(self.c) else "l2"

    def fit(self, df: DataFrame) -> LinearModel:
        began = time.time()
        self.preprocessor = LinearPreprocessor(id_column=self.id_column).fit(df.drop(self.target))
        rows = self.preprocessor.transform(df, (self.target,)).withColumn("label", F.col(self.target).cast("double")).cache()
        n = rows.count()
        self.model = LogisticRegression(regParam=1 / (self.c * n), elasticNetParam=0.0, standardization=False, maxIter=self.max_iter, tol=self.tol).fit(rows.select("features", "label"))
        rows.unpersist()
        self.iterations = self.model.summary.totalIterations
        self.converged, self.seconds = self.iterations < self.max_iter, time.time() - began
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """id, p."""
        scored = self.model.transform(self.preprocessor.transform(df, (self.id_column,)))
        return scored.select(self.id_column, vector_to_array("probability")[1].alias("p"))


# Axes of the search, in order.
AXES = (("max_depth", (3, 4, 6)), ("min_instances", (1, 10, 100)), ("column_share", (0.3, 0.5, 0.8)), ("row_share", (0.6, 0.8, 1.0)), ("learning_rate", (0.02, 0.05)))


#: Axes of the retuning on the retained sources; the share of rows stands in for the L2 penalty that the booster lacks.
RETUNE_AXES = (("max_depth", (4, 5)), ("min_instances", (100, 500)), ("column_share", (0.3, 0.5)), ("row_share", (0.6, 0.8)))

#: Rounds without a lower validation loss after which boosting stops.
PATIENCE = 100


def early_stop(losses: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """The number of trees with the least loss until ``patience`` rounds bring none lower, and whether that many did; ties to fewer trees."""
    best = 0
    for n, loss in enumerate(losses):
        if loss < losses[best]:
            best = n
        elif n - best >= patience:
            return best + 1, True
    return best + 1, False


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    java, jvm = model._java_obj, SparkContext._active_spark_context._jvm
    made = jvm.org.apache.spark.ml.classification.GBTClassificationModel(java.uid(), java.trees()[:n], java.treeWeights()[:n], java.numFeatures(), java.numClasses())
    return GBTClassificationModel(made)


@dataclass(frozen=True)
class ChallengerSpec:
    """An immutable choice of parameters and preprocessing. ``rounds`` is the cap of a fit that stops early, and the number of trees of any other."""

    rounds: int = 5000
    params: tuple = (("max_depth", 4), ("min_instances", 10), ("column_share", 0.5), ("row_share", 0.8), ("learning_rate", 0.1))
    heavy_tail: str = "none"
    missing_indicators: str = "deduplicated"
    seed: int = 42

    def get(self, name: str):
        return dict(self.params).get(name)

    def with_params(self, **values) -> ChallengerSpec:
        return replace(self, params=tuple((dict(self.params) | values).items()))

    def locked(self, rounds: int) -> ChallengerSpec:
        return replace(self, rounds=rounds)

    def to_dict(self) -> dict:
        return {"rounds": self.rounds, "params": dict(self.params), "heavy_tail": self.heavy_tail, "missing_indicators": self.missing_indicators, "seed": self.seed}

    @classmethod
    def from_dict(cls, d: dict) -> ChallengerSpec:
        return cls(d["rounds"], tuple(d["params"].items()), d["heavy_tail"], d["missing_indicators"], d["seed"])

    def key(self) -> str:
        return json.dumps(self.to_dict(), sort_keys=True)


@dataclass
class Challenger:
    spec: ChallengerSpec = field(default_factory=ChallengerSpec)
    id_column: str = ID
    target: str = TARGET

    def _vectors(self, df: DataFrame, keep: tuple[str, ...]) -> DataFrame:
        rows = self.preprocessor.transform(df)
        cells = [F.coalesce(F.col(c).cast("double"), F.lit(self.fill)) for c in self.preprocessor.features]
        vectors = rows.select(self.id_column, array_to_vector(F.array(*cells)).alias("features"))
        return vectors if not keep else vectors.join(df.select(self.id_column, *keep), self.id_column)

    def fit(self, df: DataFrame, validation: DataFrame | None = None, patience: int = PATIENCE) -> Challenger:
        """With validation rows, boosting goes on until their loss has not improved for ``patience`` rounds, and the trees of the least loss are kept.

        Spark's booster stops at the first round that gains too little and cannot go on from a model, so it is fitted anew
        with twice the trees until patience ends it or the cap is reached.
        """
        began, p = time.time(), dict(self.spec.params)
        self.preprocessor = TreePreprocessor(heavy_tail=self.spec.heavy_tail, missing_indicators=self.spec.missing_indicators, id_column=self.id_column).fit(df.drop(self.target))
        self.fill = -1e9
        rows = self._labelled(df).cache()
        levels = max([2, *(len(v) for v in self.preprocessor.levels.values())])
        booster = GBTClassifier(
            maxIter=self.spec.rounds, maxDepth=p["max_depth"], minInstancesPerNode=p["min_instances"], featureSubsetStrategy=str(p["column_share"]), subsamplingRate=p["row_share"], stepSize=p["learning_rate"], seed=self.spec.seed, maxBins=max(32, levels),
        )
        self.early_stopped = False
        if validation is None:
            self.model: GBTClassificationModel = booster.fit(rows)
        else:
            watched, n = self._labelled(validation).cache(), min(self.spec.rounds, 2 * patience)
            while True:
                self.model = booster.setMaxIter(n).fit(rows)
                best, self.early_stopped = early_stop(self.model.evaluateEachIteration(watched), patience)
                if self.early_stopped or n == self.spec.rounds:
                    break
                n = min(self.spec.rounds, 2 * n)
            watched.unpersist()
            self.model = first_trees(self.model, best)
        rows.unpersist()
        self.seconds = time.time() - began
        return self

    def _labelled(self, df: DataFrame) -> DataFrame:
        return self._vectors(df, (self.target,)).select("features", F.col(self.target).cast("double").alias("label"))

    @property
    def n_trees(self) -> int:
        return self.model.getNumTrees

    def predict(self, df: DataFrame) -> DataFrame:
        scored = self.model.transform(self._vectors(df, ()))
        return scored.select(self.id_column, vector_to_array("probability")[1].alias("p"))

    def best_rounds(self, validation: DataFrame) -> tuple[int, list[float]]:
        """The number of trees with the least validation loss, and the loss after each; ties to fewer trees.

        Every prefix of the fitted model is scored.
        """
        losses = self.model.evaluateEachIteration(self._labelled(validation))
        return min(range(len(losses)), key=losses.__getitem__) + 1, losses

    def importance(self, source_of) -> list[dict]:
        """Gain, split count, share, used features and the top three features of each source, by descending gain."""
        gains = self.model.featureImportances.toArray().tolist()
        splits = [0] * len(gains)
        for line in self.model.toDebugString.splitlines():
            if "If (feature " in line:
                splits[int(line.split("If (feature ")[1].split()[0])] += 1
        by: dict[str, list] = {}
        for name, gain, n in zip(self.preprocessor.features, gains, splits, strict=True):
            by.setdefault(source_of(name.removeprefix("missing_")), []).append((gain, n, name))
        total = sum(gains) or 1.0
        rows = [{"source": s, "gain": sum(g for g, _, _ in f), "splits": sum(n for _, n, _ in f), "share": sum(g for g, _, _ in f) / total, "used": sum(1 for _, n, _ in f if n), "top": [name for g, _, name in sorted(f, key=lambda x: (-x[0], x[2]))[:3] if g]} for s, f in by.items()]
        return sorted(rows, key=lambda r: (-r["gain"], r["source"]))


def log_loss_of(predictions: DataFrame, labels: DataFrame, id_column: str = ID, target: str = TARGET) -> float:
    rows = predictions.join(labels.select(id_column, F.col(target).alias("y")), id_column)
    return proper_scores(as_model(rows), ["model"]).first().log_loss
