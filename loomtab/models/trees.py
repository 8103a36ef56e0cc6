"""Trees and ensembles: single trees, forests, boosting and bagging, all on the shared histogram learner."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.models.base import TableEstimator
from loomtab.models.shared_trees import PENALTIES, Spec, TreesModel, tree_state, tree_states


class Trees(TableEstimator):
    """An estimator of one or several members of the shared learner."""

    model_class = TreesModel
    members = Param(Params._dummy(), "members", "settings of every member as JSON", TypeConverters.toString)
    classify = Param(Params._dummy(), "classify", "whether the label is a class", TypeConverters.toBoolean)
    combine = Param(Params._dummy(), "combine", "sum, vote or median of the members", TypeConverters.toString)
    keyCol = Param(Params._dummy(), "keyCol", "row key for bootstrap draws; empty: the row's content", TypeConverters.toString)

    def _defaults(self) -> None:
        self._setDefault(members="[{}]", classify=False, combine="sum", keyCol="")

    def learn(self, df: DataFrame) -> dict[str, Any]:
        specs = [Spec(**m) for m in json.loads(self._get("members"))]
        share = 1.0 if self._get("combine") != "sum" else 1.0 / len(specs)
        return tree_state(
            df, specs, self._get("featuresCol"), self._get("labelCol"), self._get("keyCol") or None, self._get("classify"), self._get("combine"),
            [share] * len(specs),
        )


def _trees(task: str, specs: Sequence[Spec], **columns: Any) -> Trees:
    classify = task == "classify"
    return Trees(members=json.dumps([asdict(s) for s in specs]), classify=classify, combine="vote" if classify else "sum", **columns)


def decision_tree(task: str, depth: int = 5, splitter: str = "best", seed: int = 0, **columns: Any) -> Trees:
    """A single tree. The random splitter draws one threshold a node and feature within the node's range and takes the best."""
    return _trees(task, [Spec(depth=depth, splitter=splitter, seed=seed)], **columns)


def random_forest(task: str, trees: int = 10, depth: int = 5, subset: str = "auto", seed: int = 0, **columns: Any) -> Trees:
    """Trees on bootstrap samples; each node tries ``subset`` features: a number, or 'auto' for all of them."""
    tried = 0 if subset == "auto" else int(subset)
    return _trees(task, [Spec(depth=depth, features=tried, bootstrap=i, seed=seed) for i in range(trees)], **columns)


def extra_trees(trees: int = 10, depth: int = 10, seed: int = 0, **columns: Any) -> Trees:
    """Extremely randomised regression trees: every row, random thresholds (Geurts, Ernst and Wehenkel, 2006)."""
    return _trees("regress", [Spec(depth=depth, splitter="random", seed=seed * 1009 + i) for i in range(trees)], **columns)


def gradient_boosting(loss: str = "squared", rounds: int = 20, depth: int = 3, rate: float = 0.1, seed: int = 0, **columns: Any) -> Trees:
    """Gradient boosting (Friedman, 2001); ``absolute`` is another name of lad."""
    return _trees("regress", [Spec("boost", depth, rounds, rate, {"absolute": "lad"}.get(loss, loss), seed=seed)], **columns)


def weighted_median(values: Sequence[Column], weights: Sequence[float]) -> Column:
    """Smallest value at which half of the total weight is reached."""
    pairs = F.array_sort(F.array(*[F.struct(v.cast("double").alias("v"), F.lit(float(w)).alias("w")) for v, w in zip(values, weights)]))
    half = 0.5 * sum(weights)
    start = F.struct(F.lit(0.0).alias("seen"), F.lit(None).cast("double").alias("found"))

    def step(state: Column, pair: Column) -> Column:
        seen = state["seen"] + pair["w"]
        found = F.coalesce(state["found"], F.when(seen >= F.lit(half * (1 - 1e-12)), pair["v"]))
        return F.struct(seen.alias("seen"), found.alias("found"))

    return F.aggregate(pairs, start, step)["found"]


def _ensemble(df: DataFrame, specs: Sequence[Spec], features: str, label: str, prediction: str, how: str, **more: Any) -> PipelineModel:
    state = tree_state(df, specs, features, label, how=how, **more)
    return PipelineModel([TreesModel(json.dumps(state))._set(featuresCol=features, labelCol=label, predictionCol=prediction)])


def adaboost_classifier(
    df: DataFrame, features: str = "features", label: str = "y", rounds: int = 50, rate: float = 1.0, depth: int = 1, prediction: str = "prediction"
) -> PipelineModel:
    """SAMME boosting of weighted trees (Zhu et al., 2009)."""
    return _ensemble(df, [Spec("samme", depth, rounds, rate)], features, label, prediction, "vote", classify=True)


def adaboost_rates(
    df: DataFrame, rates: Sequence[float], rounds: int, features: str = "features", label: str = "y", depth: int = 1, prediction: str = "prediction"
) -> list[PipelineModel]:
    """One boosted ensemble for each learning rate, all trained by the same reads."""
    specs = [Spec("samme", depth, rounds, rate) for rate in rates]
    states = tree_states(df, specs, features, label, classify=True, how="vote")
    return [PipelineModel([TreesModel(json.dumps(s))._set(featuresCol=features, labelCol=label, predictionCol=prediction)]) for s in states]


def first_rounds(model: PipelineModel, rounds: int) -> PipelineModel:
    """The ensemble after fewer rounds, so that one long fit serves every shorter candidate."""
    (whole,) = model.stages
    state = whole.fitted
    short = TreesModel(json.dumps(state | {c: state[c][:rounds] for c in ("trees", "weights", "worst")}))
    for param in ("featuresCol", "labelCol", "predictionCol"):
        short._set(**{param: whole.getOrDefault(param)})
    return PipelineModel([short])


def adaboost_regressor(
    df: DataFrame, features: str = "features", label: str = "y", loss: str = "linear", rounds: int = 50, rate: float = 1.0, depth: int = 3,
    prediction: str = "prediction",
) -> PipelineModel:
    """AdaBoost.R2 (Drucker, 1997) with row weights in place of resampling; prediction is the weighted median."""
    if loss not in PENALTIES:
        raise ValueError(f"loss={loss!r}: choose linear, square or exponential")
    return _ensemble(df, [Spec("r2", depth, rounds, rate, loss)], features, label, prediction, "median")


def bagging_regressor(
    df: DataFrame, key: str, features: str = "features", label: str = "y", members: int = 10, depth: int = 10, prediction: str = "prediction"
) -> PipelineModel:
    """Trees on Poisson bootstrap weights drawn from the row key; prediction is their mean."""
    specs = [Spec(depth=depth, bootstrap=i) for i in range(members)]
    return _ensemble(df, specs, features, label, prediction, "sum", key=key, weights=[1.0 / members] * members)


def boosted_quantiles(
    df: DataFrame, features: str = "features", label: str = "y", loss: str = "huber", quantile: float = 0.9, rounds: int = 20, depth: int = 3,
    rate: float = 0.1, prediction: str = "prediction",
) -> PipelineModel:
    """Boosting for lad, huber and quantile losses: trees on pseudo-residuals, leaf values refitted per leaf."""
    if loss not in ("lad", "huber", "quantile"):
        raise ValueError(f"loss={loss!r}: choose lad, huber or quantile")
    return _ensemble(df, [Spec("boost", depth, rounds, rate, loss, quantile)], features, label, prediction, "sum")


def probabilities(df: DataFrame, vector: str = "probability", output: str = "probability") -> DataFrame:
    """MLlib probability vector as an array column."""
    return df.withColumn(output, vector_to_array(vector))
