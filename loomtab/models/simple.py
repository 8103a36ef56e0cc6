"""Baselines, nearest centroid, Gaussian naive Bayes and discriminants: closed-form models.

Fitting is one grouped aggregate (two passes for covariances); scoring is a projection.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions.distance import check_metric, distance
from loomtab.functions.hashing import uniform
from loomtab.functions.maths import arg_max, array_total, dot, doubles, softmax
from loomtab.models.arrays import block_columns, summed
from loomtab.models.base import MAX_CLASSES, TableEstimator, TableModel, class_at
from loomtab.operators.aggregates import class_counts

DIGITS = 9


def _counts(df: DataFrame, label: str) -> tuple[list[Any], list[int]]:
    rows = class_counts(df.filter(F.col(label).isNotNull()), label).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"{label!r} has more than {MAX_CLASSES} distinct values; is it a class label?")
    rows.sort(key=lambda r: r["class"])
    return [r["class"] for r in rows], [r["n"] for r in rows]


def class_moments(df: DataFrame, features: str, label: str) -> list[dict[str, Any]]:
    """Count, mean and population variance of the features per class, in one pass."""
    stats = Summarizer.metrics("count", "mean", "variance").summary(F.col("_vector"))
    rows = (
        df.filter(F.col(label).isNotNull())
        .select(F.col(label).alias("class"), array_to_vector(F.col(features).cast("array<double>")).alias("_vector"))
        .groupBy("class")
        .agg(stats.alias("s"))
        .select("class", "s.count", vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"))
        .collect()
    )
    out = []
    for r in sorted(rows, key=lambda r: r["class"]):
        n = r["count"]
        out.append({"class": r["class"], "n": n, "mean": list(r["mean"]), "var": [v * (n - 1) / n for v in r["var"]]})
    return out


class MajorityModel(TableModel):
    def predict(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        return df.withColumn(self._get("predictionCol"), F.lit(state["class"]))


class MajorityClass(TableEstimator):
    """Always the most frequent class; the smallest one on ties."""

    model_class = MajorityModel

    def learn(self, df: DataFrame) -> dict[str, Any]:
        label = self._get("labelCol")
        top = class_counts(df.filter(F.col(label).isNotNull()), label).agg(
            F.min_by("class", F.struct(-F.col("n"), F.col("class")))
        )
        return {"class": top.first()[0]}


class _Keyed(Params):
    keyCol = Param(Params._dummy(), "keyCol", "row key that decides each row's draw", TypeConverters.toString)
    seed = Param(Params._dummy(), "seed", "changes every draw", TypeConverters.toInt)


class PriorModel(TableModel, _Keyed):
    def predict(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        seed = self._get("seed") if self.isDefined("seed") else None
        u = uniform(self._get("keyCol"), 3, seed)
        total, below = sum(state["counts"]), 0
        choice = F.lit(state["classes"][-1])
        for c, n in reversed(list(zip(state["classes"], np.cumsum(state["counts"]).tolist()))):
            choice = F.when(u < F.lit(n / total), F.lit(c)).otherwise(choice)
        return df.withColumn(self._get("predictionCol"), choice)


class PriorProportional(TableEstimator, _Keyed):
    """Random class in proportion to its share of the train rows, fixed per row key."""

    model_class = PriorModel

    def learn(self, df: DataFrame) -> dict[str, Any]:
        classes, counts = _counts(df, self._get("labelCol"))
        return {"classes": classes, "counts": counts}


class _Metric(Params):
    metric = Param(Params._dummy(), "metric", "distance", TypeConverters.toString)


class CentroidModel(TableModel, _Metric):
    def predict(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        x = F.col(self._get("featuresCol")).cast("array<double>")
        options = [
            F.struct(
                F.round(distance(x, doubles(c["mean"]), self._get("metric")), DIGITS).alias("d"), F.lit(c["class"]).alias("c")
            )
            for c in state["centroids"]
        ]
        return df.withColumn(self._get("predictionCol"), F.array_min(F.array(*options))["c"])


class NearestCentroid(TableEstimator, _Metric):
    """Class whose mean is nearest; the smallest class on ties."""

    model_class = CentroidModel

    def _defaults(self) -> None:
        self._setDefault(metric="euclidean")

    def validate(self) -> None:
        check_metric(self._get("metric"))

    def learn(self, df: DataFrame) -> dict[str, Any]:
        rows = class_moments(df, self._get("featuresCol"), self._get("labelCol"))
        return {"centroids": [{"class": r["class"], "mean": r["mean"]} for r in rows]}


class ScoreModel(TableModel):
    """Adds per-class scores, softmax probabilities and the class with the largest score."""

    def score(self, x: Column, state: dict[str, Any]) -> Column:
        raise NotImplementedError

    def predict(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        scores = self.score(F.col(self._get("featuresCol")).cast("array<double>"), state)
        classes = [c["class"] for c in state["classes"]]
        rounded = F.transform("score", lambda s: F.round(s, DIGITS))
        return (
            df.withColumn("score", scores)
            .withColumn(self._get("probabilityCol"), softmax(F.col("score")))
            .withColumn(self._get("predictionCol"), class_at(arg_max(rounded), classes))
        )


class GaussianBayesModel(ScoreModel):
    """Scores are joint log-likelihoods."""

    def score(self, x: Column, state: dict[str, Any]) -> Column:
        parts = []
        for c in state["classes"]:
            constant = math.log(c["share"]) - 0.5 * sum(math.log(2 * math.pi * v) for v in c["var"])
            squares = F.zip_with(x, doubles(c["mean"]), lambda a, b: (a - b) * (a - b))
            scaled = F.zip_with(squares, doubles([0.5 / v for v in c["var"]]), lambda a, b: a * b)
            parts.append(F.lit(constant) - array_total(scaled))
        return F.array(*parts)


class GaussianBayes(TableEstimator):
    """Gaussian naive Bayes with a small constant added to every variance."""

    smoothing = Param(Params._dummy(), "smoothing", "added to every variance", TypeConverters.toFloat)
    model_class = GaussianBayesModel

    def _defaults(self) -> None:
        self._setDefault(smoothing=1e-9)

    def learn(self, df: DataFrame) -> dict[str, Any]:
        rows = class_moments(df, self._get("featuresCol"), self._get("labelCol"))
        total = sum(r["n"] for r in rows)
        extra = self._get("smoothing")
        return {
            "classes": [
                {"class": r["class"], "share": r["n"] / total, "mean": r["mean"], "var": [v + extra for v in r["var"]]}
                for r in rows
            ]
        }


def class_scatters(df: DataFrame, features: str, label: str, rows: list[dict[str, Any]]) -> list[np.ndarray]:
    """Sum of outer products around each class mean, in one pass with one small matrix per task and class."""
    order = {r["class"]: i for i, r in enumerate(rows)}
    means = np.array([r["mean"] for r in rows])
    width = means.shape[1]
    index = F.create_map(*[F.lit(v) for pair in order.items() for v in pair])[F.col(label)]
    table = df.filter(F.col(label).isNotNull()).select(
        F.col(features).cast("array<double>").alias("features"), index.alias("y")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        totals = np.zeros((len(means), width, width))
        for batch in batches:
            if not batch.num_rows:
                continue
            block = block_columns(batch)
            for i in np.unique(block["y"]):
                gap = block["features"][block["y"] == i] - means[i]
                totals[i] += gap.T @ gap
        return totals.ravel()

    flat = summed(table, work)
    return list(flat.reshape(len(rows), width, width))


class LinearDiscriminantModel(ScoreModel):
    def score(self, x: Column, state: dict[str, Any]) -> Column:
        return F.array(*[dot(x, doubles(c["weights"])) + F.lit(c["offset"]) for c in state["classes"]])


class LinearDiscriminant(TableEstimator):
    """Classes share one covariance, pooled with n - classes degrees of freedom."""

    model_class = LinearDiscriminantModel

    def learn(self, df: DataFrame) -> dict[str, Any]:
        rows = class_moments(df, self._get("featuresCol"), self._get("labelCol"))
        scatters = class_scatters(df, self._get("featuresCol"), self._get("labelCol"), rows)
        total = sum(r["n"] for r in rows)
        inverse = np.linalg.pinv(sum(scatters) / (total - len(rows)))
        classes = []
        for r in rows:
            mean = np.array(r["mean"])
            weights = inverse @ mean
            offset = -0.5 * float(mean @ weights) + math.log(r["n"] / total)
            classes.append({"class": r["class"], "weights": weights.tolist(), "offset": offset})
        return {"classes": classes}


class QuadraticDiscriminantModel(ScoreModel):
    def score(self, x: Column, state: dict[str, Any]) -> Column:
        parts = []
        for c in state["classes"]:
            gap = F.zip_with(x, doubles(c["mean"]), lambda a, b: a - b)
            squares = [F.pow(dot(gap, doubles(row)), F.lit(2.0)) for row in c["root"]]
            length = squares[0]
            for s in squares[1:]:
                length = length + s
            parts.append(F.lit(c["offset"]) - 0.5 * length)
        return F.array(*parts)


class QuadraticDiscriminant(TableEstimator):
    """Each class has its own unbiased covariance."""

    model_class = QuadraticDiscriminantModel

    def learn(self, df: DataFrame) -> dict[str, Any]:
        rows = class_moments(df, self._get("featuresCol"), self._get("labelCol"))
        scatters = class_scatters(df, self._get("featuresCol"), self._get("labelCol"), rows)
        total = sum(r["n"] for r in rows)
        classes = []
        for r, scatter in zip(rows, scatters):
            spread, axes = np.linalg.eigh(scatter / (r["n"] - 1))
            spread = np.maximum(spread, 1e-12)
            root = (axes / np.sqrt(spread)).T
            offset = math.log(r["n"] / total) - 0.5 * float(np.log(spread).sum())
            classes.append({"class": r["class"], "mean": r["mean"], "root": root.tolist(), "offset": offset})
        return {"classes": classes}
