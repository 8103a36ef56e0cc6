"""Fit a list of named configurations and rank them; failures become rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product
from typing import Any

from pyspark.ml import Estimator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.models.linear import LinearScore, kernel_map, polynomial_features
from loomtab.models.neighbors import Neighbors, NeighborsModel, SharedJoins
from loomtab.models.simple import GaussianBayes, LinearDiscriminant, QuadraticDiscriminant
from loomtab.models.trees import (
    adaboost_classifier, adaboost_regressor, bagging_regressor, boosted_quantiles, decision_tree, extra_trees, gradient_boosting,
    random_forest,
)
from loomtab.models.shared_trees import Spec
from loomtab.operators import metrics
from loomtab.operators.ranking import best_model
from loomtab.plans.grids import regression_grids


@dataclass(frozen=True)
class Entry:
    """A configuration: its name and either an estimator or a function from train rows to a model.

    ``shared`` says how a search cross-validates it together with others of its kind: ("trees", Spec), ("neighbors", k) or
    ("rbf", (gamma, components)). Without it every fold is fitted by itself.
    """

    name: str
    fit: Estimator | Callable[[DataFrame], Any]
    shared: tuple[str, Any] | None = None

    def train(self, df: DataFrame) -> Any:
        return self.fit.fit(df) if isinstance(self.fit, Estimator) else self.fit(df)


BOARD = "candidate int, name string, train_score double, score double, error string"


def _score(predictions: DataFrame, label: str, regress: bool) -> float:
    if regress:
        return metrics.regression(predictions, label, "prediction").first()["r2"]
    return metrics.accuracy(predictions, label, "prediction").first()["accuracy"]


def leaderboard(
    spark: SparkSession, entries: Sequence[Entry], train: DataFrame, test: DataFrame, label: str, regress: bool = False, parallelism: int = 4
) -> DataFrame:
    """(candidate, name, train_score, score, error), accuracy or r2 on both sides.

    Neighbour models that ask for the same neighbours read one join a side.
    """
    joins = SharedJoins(e.fit for e in entries if isinstance(e.fit, Neighbors))

    def run(item: tuple[int, Entry]) -> tuple:
        number, entry = item
        try:
            model = entry.train(train)
            if isinstance(model, NeighborsModel):
                model.joins = joins
            return number, entry.name, _score(model.transform(train), label, regress), _score(model.transform(test), label, regress), None
        except Exception as error:  # a failed configuration is a result, not the end of the run
            return number, entry.name, None, None, f"{type(error).__name__}: {str(error)[:500]}"

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(run, enumerate(entries)))
    joins.release()
    return spark.createDataFrame(rows, BOARD)


def winner(board: DataFrame) -> DataFrame:
    return best_model(board, "score", "candidate").join(board.select("candidate", "name"), "candidate")


def mapped_fit(mapping: Callable[[DataFrame], DataFrame], estimator: Estimator) -> Callable[[DataFrame], Any]:
    """Fit on explicitly mapped features; the model maps the rows it scores the same way."""

    class Mapped:
        def __init__(self, model: Any):
            self.model = model

        def transform(self, df: DataFrame) -> DataFrame:
            return self.model.transform(mapping(df))

    return lambda df: Mapped(estimator.fit(mapping(df)))


def classifier_entries(key: str, label: str = "y", vector: str = "vector", boosting_rounds: int = 50) -> list[Entry]:
    """The nine compared classifiers with their settings; frames need 'features' and an ML vector column."""
    # Names and settings of the comparison.
    ml = {"featuresCol": vector, "labelCol": label}
    return [
        Entry("Nearest Neighbors", Neighbors(keyCol=key, labelCol=label, k=3)),
        Entry("Linear SVM", LinearScore(labelCol=label, loss="squared_hinge", C=0.025)),
        Entry("RBF SVM", mapped_fit(lambda df: kernel_map(df, "rbf", gamma=2.0, components=100), LinearScore(labelCol=label, loss="squared_hinge", C=1.0))),
        Entry("Decision Tree", decision_tree("classify", 5, **ml)),
        Entry("Random Forest", random_forest("classify", 10, 5, "1", **ml)),
        Entry("AdaBoost", lambda df: adaboost_classifier(df, label=label, rounds=boosting_rounds)),
        Entry("Naive Bayes", GaussianBayes(labelCol=label)),
        Entry("LDA", LinearDiscriminant(labelCol=label)),
        Entry("QDA", QuadraticDiscriminant(labelCol=label)),
    ]


def regressor_entries(key: str, label: str, vector: str = "vector", rounds: int = 50) -> list[Entry]:
    """The distinct regressor settings of the long comparison (tree indexes of neighbours give equal results)."""
    ml = {"featuresCol": vector, "labelCol": label}
    entries = [
        Entry("SVR linear", LinearScore(labelCol=label, loss="tube")),
        Entry("SVR poly", mapped_fit(lambda df: polynomial_features(df, 3), LinearScore(labelCol=label, loss="tube"))),
        Entry("SVR rbf", mapped_fit(lambda df: kernel_map(df, "rbf", components=100), LinearScore(labelCol=label, loss="tube"))),
    ]
    for weights in ("distance", "uniform"):
        entries += [Entry(f"neighbors k={k} {weights}", Neighbors(keyCol=key, labelCol=label, task="regress", k=k, weights=weights)) for k in (5, 8)]
        entries += [
            Entry(f"radius {radius} {weights}", Neighbors(keyCol=key, labelCol=label, task="regress", radius=radius, weights=weights))
            for radius in (1.0, 0.5)
        ]
    entries += [Entry(f"tree {how}", decision_tree("regress", 5, how, **ml)) for how in ("best", "random")]
    for loss in ("linear", "square", "exponential"):
        entries.append(Entry(f"AdaBoost {loss}", lambda df, loss=loss: adaboost_regressor(df, label=label, loss=loss, rounds=rounds)))
    entries.append(Entry("bagging", lambda df: bagging_regressor(df, key, label=label)))
    entries += [Entry(f"extra trees {n}", extra_trees(n, **ml)) for n in (5, 10, 15)]
    entries.append(Entry("boosting ls", gradient_boosting("squared", rounds, **ml)))
    for loss in ("lad", "huber", "quantile"):
        entries.append(Entry(f"boosting {loss}", lambda df, loss=loss: boosted_quantiles(df, label=label, loss=loss, rounds=rounds)))
    return entries


def forecast_entries(key: str, label: str, vector: str = "vector", rounds: int = 100, components: int = 256) -> list[Entry]:
    """Every candidate of the published forecast search (``regression_grids``); a kernel without a feature map fails when it is fitted."""
    ml = {"featuresCol": vector, "labelCol": label}

    # A tree without a depth of its own grows to 30 levels.
    def boosting(loss: str, max_depth: int) -> tuple:
        return lambda df: boosted_quantiles(df, label=label, loss=loss, rounds=rounds, depth=max_depth), ("trees", [Spec("boost", max_depth, rounds, 0.1, loss)])

    def forest() -> tuple:
        return random_forest("regress", 10, 30, **ml), ("trees", [Spec(depth=30, bootstrap=i) for i in range(10)])

    def tree() -> tuple:
        return decision_tree("regress", 30, **ml), ("trees", [Spec(depth=30)])

    def neighbors(n_neighbors: int) -> tuple:
        return Neighbors(keyCol=key, labelCol=label, task="regress", k=n_neighbors), ("neighbors", n_neighbors)

    def svr(kernel: str, gamma: float) -> tuple:
        fit = mapped_fit(lambda df: kernel_map(df, kernel, gamma=gamma, components=components), LinearScore(labelCol=label, loss="tube"))
        return fit, ("rbf", (gamma, components)) if kernel == "rbf" else None

    makers: dict[str, Callable[..., tuple]] = {"boosting": boosting, "forest": forest, "tree": tree, "neighbors": neighbors, "svr": svr}
    entries = []
    for model, grids in regression_grids().items():
        for grid in grids:
            for values in product(*grid.values()):
                params = dict(zip(grid, values))
                entries.append(Entry(" ".join([model, *(f"{k}={v}" for k, v in params.items())]), *makers[model](**params)))
    return entries


def with_vector(df: DataFrame, features: str = "features", output: str = "vector") -> DataFrame:
    return df.withColumn(output, array_to_vector(F.col(features).cast("array<double>")))

