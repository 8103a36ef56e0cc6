"""Linear, margin and kernel-like models: MLlib estimators plus shared-pass fits where MLlib has none."""

from __future__ import annotations

from collections.abc import Iterator
from math import comb
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import PCA, PolynomialExpansion
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions.maths import arg_max, dot, doubles, logistic, softmax
from loomtab.models.arrays import block_columns, matrix, rows_of, summed
from loomtab.models.base import TableEstimator, TableModel, class_at, class_index, sorted_classes
from loomtab.models.losses import Linear
from loomtab.models.shared_pass import Lift, Packed, Problem, fit_all, packed, shard_batches, sharded, training_table
from loomtab.operators.aggregates import class_counts


def logistic_regression(rows: int, C: float = 1.0, penalty: str = "l2", multi_class: str = "multinomial", **columns: Any):
    """MLlib logistic regression whose penalty equals strength 1/C on the summed loss over ``rows`` rows."""
    if penalty not in ("l1", "l2"):
        raise ValueError(f"penalty={penalty!r}: choose l1 or l2")
    if multi_class not in ("multinomial", "ovr"):
        raise ValueError(f"multi_class={multi_class!r}: choose multinomial or ovr")
    base = LogisticRegression(
        regParam=1.0 / (C * rows), elasticNetParam=1.0 if penalty == "l1" else 0.0, standardization=False,
        family="auto" if multi_class == "ovr" else "multinomial", tol=1e-4, **columns,
    )
    if multi_class == "ovr":
        return OneVsRest(classifier=base, **{k: v for k, v in columns.items() if k in ("featuresCol", "labelCol", "predictionCol", "weightCol")})
    return base


def linear_svc(rows: int, C: float = 1.0, classes: int = 2, max_iter: int = 30, **columns: Any):
    """MLlib linear support-vector classifier (hinge loss), one-versus-rest beyond two classes.

    Every iteration reads the data; ``LinearScore(loss="squared_hinge")`` needs far fewer reads.
    """
    base = LinearSVC(regParam=1.0 / (C * rows), standardization=False, tol=1e-3, maxIter=max_iter, **columns)
    if classes > 2:
        return OneVsRest(classifier=base, **{k: v for k, v in columns.items() if k in ("featuresCol", "labelCol", "predictionCol", "weightCol")})
    return base


def weighted(df: DataFrame, label: str, output: str = "weight") -> DataFrame:
    """Balanced class weight per row, as literals of the small class table."""
    counts = {r["class"]: r["n"] for r in class_counts(df, label).collect()}
    total = sum(counts.values())
    weights = {c: total / (len(counts) * n) for c, n in counts.items()}
    lookup = F.create_map(*[F.lit(v) for pair in weights.items() for v in pair])
    return df.withColumn(output, lookup[F.col(label)])


MAX_TERMS = 20000


def check_terms(width: int, degree: int) -> None:
    if comb(width + degree, degree) > MAX_TERMS:
        raise ValueError(f"degree {degree} over {width} features makes {comb(width + degree, degree)} terms; use fourier_features")


def polynomial_terms(x: np.ndarray, degree: int) -> np.ndarray:
    """The columns of ``polynomial_features``, in its order."""
    out: list[np.ndarray] = []

    def expand(column: int, left: int, product: np.ndarray) -> None:
        if column < 0 or not left:
            out.append(product)
            return
        for used in range(left + 1):
            expand(column - 1, left - used, product)
            if used < left:
                product = np.where(product == 0.0, 0.0, product * x[:, column])

    expand(x.shape[1] - 1, degree, np.ones(len(x)))
    return np.stack(out[1:], axis=1) if out[1:] else np.empty((len(x), 0))


def polynomial_features(df: DataFrame, degree: int, features: str = "features", output: str = "features") -> DataFrame:
    """All monomials up to ``degree``; refuses expansions wider than MAX_TERMS."""
    check_terms(df.select(F.size(features)).first()[0], degree)
    expanded = PolynomialExpansion(degree=degree, inputCol="_vector", outputCol="_expanded").transform(
        df.withColumn("_vector", array_to_vector(F.col(features).cast("array<double>")))
    )
    return expanded.withColumn(output, vector_to_array("_expanded")).drop("_vector", "_expanded")


def fourier_waves(width: int, gamma: float, components: int, seed: int = 0) -> Lift:
    """The columns of ``fourier_features`` from rows of ``width`` numbers."""
    rng = np.random.default_rng(seed)
    waves = rng.normal(0.0, np.sqrt(2.0 * gamma), (width, components))
    phases = rng.uniform(0.0, 2.0 * np.pi, components)
    height = np.sqrt(2.0 / components)

    def waved(x: np.ndarray) -> np.ndarray:
        out = x @ waves
        out += phases
        return np.multiply(np.cos(out, out=out), height, out=out)

    return waved


def kernel_lift(width: int, kernel: str, degree: int = 3, gamma: float = 1.0, components: int = 256, seed: int = 0) -> tuple[int, Lift]:
    """(columns, map) of ``kernel_map`` over rows of ``width`` numbers, for tasks that compute it where they need it."""
    if kernel == "linear":
        return width, lambda x: x
    if kernel == "poly":
        check_terms(width, degree)
        return comb(width + degree, degree) - 1, lambda x: polynomial_terms(x, degree)
    if kernel == "rbf":
        return components, fourier_waves(width, gamma, components, seed)
    raise ValueError(f"kernel={kernel!r}: choose linear, poly or rbf")


def fourier_features(
    df: DataFrame, gamma: float, components: int = 256, seed: int = 0, features: str = "features", output: str = "features"
) -> DataFrame:
    """Random Fourier features of the rbf kernel exp(-gamma |a-b|^2) (Rahimi and Recht, NIPS 2007)."""
    waved = fourier_waves(df.select(F.size(features)).first()[0], gamma, components, seed)

    @F.arrow_udf("array<double>")
    def project(batch: pa.Array) -> pa.Array:
        if not len(batch):
            return pa.array([], pa.list_(pa.float64()))
        return rows_of(waved(matrix(batch)))

    return df.withColumn(output, project(F.col(features).cast("array<double>")))


def kernel_map(df: DataFrame, kernel: str, degree: int = 3, gamma: float = 1.0, components: int = 256, seed: int = 0, features: str = "features") -> DataFrame:
    """Explicit features standing in for a kernel, so that a linear model can be trained at any row count."""
    if kernel == "linear":
        return df
    if kernel == "poly":
        return polynomial_features(df, degree, features, features)
    if kernel == "rbf":
        return fourier_features(df, gamma, components, seed, features, features)
    raise ValueError(f"kernel={kernel!r}: choose linear, poly or rbf")


def reduced_pipeline(k: int, final, features: str = "vector") -> Pipeline:
    """Unsupervised first stage (k principal components) followed by ``final``, which must read 'reduced'."""
    return Pipeline(stages=[PCA(k=k, inputCol=features, outputCol="reduced"), final])


class _LinearParams(Params):
    loss = Param(Params._dummy(), "loss", "logistic, softmax, squared_hinge, tube, huber or squared", TypeConverters.toString)
    C = Param(Params._dummy(), "C", "inverse penalty on the summed loss", TypeConverters.toFloat)
    penalty = Param(Params._dummy(), "penalty", "l2 or l1", TypeConverters.toString)
    epsilon = Param(Params._dummy(), "epsilon", "half-width of the tube or Huber turning point", TypeConverters.toFloat)
    balanced = Param(Params._dummy(), "balanced", "weight classes by inverse frequency", TypeConverters.toBoolean)
    calibrate = Param(Params._dummy(), "calibrate", "fit probabilities to the margins", TypeConverters.toBoolean)
    maxIter = Param(Params._dummy(), "maxIter", "iterations", TypeConverters.toInt)
    tol = Param(Params._dummy(), "tol", "gradient tolerance", TypeConverters.toFloat)


REGRESSION = ("tube", "huber", "squared")


class LinearScoreModel(TableModel):
    def predict(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        x = F.col(self._get("featuresCol")).cast("array<double>")
        scores = F.array(*[dot(x, doubles(row[:-1])) + F.lit(row[-1]) for row in state["rows"]])
        name = self._get("predictionCol")
        if not state["classes"]:
            return df.withColumn(name, scores[0])
        out = df.withColumn("score", scores)
        classes, single = state["classes"], len(state["rows"]) == 1
        best = (F.col("score")[0] > 0).cast("int") if single else arg_max(F.col("score"))
        out = out.withColumn(name, class_at(best, classes))
        odds = state.get("odds")
        if odds:
            p = [logistic(F.lit(a) * F.col("score")[i] + F.lit(b)) for i, (a, b) in enumerate(odds)]
            both = F.array(1.0 - p[0], p[0]) if single else _shares(F.array(*p))
            return out.withColumn(self._get("probabilityCol"), both)
        if state["loss"] == "softmax":
            return out.withColumn(self._get("probabilityCol"), softmax(F.col("score")))
        if state["loss"] == "logistic":
            p = F.transform("score", logistic)
            return out.withColumn(self._get("probabilityCol"), F.array(1.0 - p[0], p[0]) if single else _shares(p))
        return out


def _shares(values: Column) -> Column:
    total = F.aggregate(values, F.lit(0.0), lambda s, v: s + v)
    return F.transform(values, lambda v: v / total)


class LinearScore(TableEstimator, _LinearParams):
    """Linear classifier or regressor; all one-versus-rest parts are trained in the same passes."""

    model_class = LinearScoreModel

    def _defaults(self) -> None:
        self._setDefault(loss="logistic", C=1.0, penalty="l2", epsilon=0.1, balanced=False, calibrate=False, maxIter=100, tol=1e-6)

    def validate(self) -> None:
        if self._get("C") <= 0:
            raise ValueError(f"C={self._get('C')!r} must be > 0")
        if self._get("penalty") not in ("l1", "l2"):
            raise ValueError(f"penalty={self._get('penalty')!r}: choose l1 or l2")
        if self._get("loss") not in ("logistic", "softmax", "squared_hinge", "tube", "huber", "squared"):
            raise ValueError(f"loss={self._get('loss')!r} is not supported")

    def learn(self, df: DataFrame) -> dict[str, Any]:
        features, label, loss = self._get("featuresCol"), self._get("labelCol"), self._get("loss")
        regress = loss in REGRESSION
        if not regress and not self._get("calibrate"):
            held = packed(df, label, features)
            try:
                return self._learn_packed(held, None, held.width)
            finally:
                held.release()
        classes = [] if regress else sorted_classes(df, label)
        target = F.col(label) if regress else class_index(F.col(label), classes)
        table = training_table(df.withColumn("_target", target), features, "_target")
        try:
            width = feature_count(table)
            weights = _balance(table, len(classes)) if self._get("balanced") and classes else {}
            problems = self._problems(width, classes, weights)
            fit_all(table, problems)
            rows = np.vstack([p.theta.reshape(p.family.outputs, -1) for p in problems])
            odds = _odds(table, rows, weights) if self._get("calibrate") and loss == "squared_hinge" else None
        finally:
            table.unpersist()
        return {"loss": loss, "classes": classes, "rows": rows.tolist(), "odds": odds}

    def fit_packed(self, held: Packed, lift: Lift | None = None, width: int | None = None):
        """The classifier fitted to packed rows; ``lift`` computes the ``width`` features that are read from the stored ones."""
        self.validate()
        if self._get("loss") in REGRESSION or self._get("calibrate"):
            raise ValueError("packed rows train classifiers without calibration")
        return self._model(self._learn_packed(held, lift, width or held.width))

    def _learn_packed(self, held: Packed, lift: Lift | None, width: int) -> dict[str, Any]:
        problems = self._problems(width, held.classes, held.weights() if self._get("balanced") else {})
        fit_all(held.blocks, problems, lift)
        rows = np.vstack([p.theta.reshape(p.family.outputs, -1) for p in problems])
        return {"loss": self._get("loss"), "classes": held.classes, "rows": rows.tolist(), "odds": None}

    def _problems(self, width: int, classes: list[Any], weights: dict[int, float]) -> list[Problem]:
        strength = 1.0 / self._get("C")
        l1 = self._get("penalty") == "l1"
        loss = self._get("loss")
        if loss == "softmax" and len(classes) == 2:
            loss = "logistic"
        family = Linear(width, loss, len(classes) if loss == "softmax" else 1, self._get("epsilon"))

        def problem(positive: int | None) -> Problem:
            return Problem(
                family, l2=0.0 if l1 else strength, l1=strength if l1 else 0.0, class_weight=weights,
                positive=positive, max_iter=self._get("maxIter"), tol=self._get("tol"),
            )

        if classes and loss != "softmax" and len(classes) > 2:
            return [problem(i) for i in range(len(classes))]
        return [problem(None)]


def feature_count(table: DataFrame) -> int:
    return table.select(F.size("features")).first()[0]


def _balance(table: DataFrame, classes: int) -> dict[int, float]:
    counts = {int(r["class"]): r["n"] for r in class_counts(table, "y").collect()}
    total = sum(counts.values())
    return {c: total / (classes * n) for c, n in counts.items()}


def _odds(table: DataFrame, rows: np.ndarray, weights: dict[int, float]) -> list[tuple[float, float]]:
    """One-dimensional logistic fit of the truth on each margin."""
    margins = F.array(*[dot(F.col("features"), doubles(r[:-1])) + F.lit(float(r[-1])) for r in rows])
    out = []
    scored = table.withColumn("_m", margins)
    for i in range(len(rows)):
        line = scored.select(F.array(F.col("_m")[i]).alias("features"), "y", "fold").persist()
        part = Problem(Linear(1, "logistic"), class_weight=weights, positive=i if len(rows) > 1 else None, max_iter=50, tol=1e-8)
        fit_all(line, [part])
        line.unpersist()
        out.append((float(part.theta[0]), float(part.theta[1])))
    return out


class _PerceptronParams(Params):
    penalty = Param(Params._dummy(), "penalty", "none, l1, l2 or elasticnet", TypeConverters.toString)
    alpha = Param(Params._dummy(), "alpha", "penalty strength", TypeConverters.toFloat)
    eta0 = Param(Params._dummy(), "eta0", "step size", TypeConverters.toFloat)
    epochs = Param(Params._dummy(), "epochs", "passes", TypeConverters.toInt)
    balanced = Param(Params._dummy(), "balanced", "weight classes by inverse frequency", TypeConverters.toBoolean)
    l1Ratio = Param(Params._dummy(), "l1Ratio", "share of l1 in elasticnet", TypeConverters.toFloat)
    shards = Param(Params._dummy(), "shards", "parts of the rows that are walked apart and averaged; 0 grows with the rows", TypeConverters.toInt)


class Perceptron(TableEstimator, _PerceptronParams):
    """Averaged perceptron: each of ``shards`` parts is run in order, the weights are averaged every epoch.

    One job per epoch (McDonald, Hall and Mann, NAACL 2010). Mistakes inside a block of 64
    rows are corrected together, so tasks stay vectorised.
    """

    model_class = LinearScoreModel
    BLOCK = 64

    def _defaults(self) -> None:
        # Documented defaults of the perceptron.
        self._setDefault(penalty="none", alpha=0.0001, eta0=1.0, epochs=5, balanced=False, l1Ratio=0.15, shards=0)

    def validate(self) -> None:
        if self._get("penalty") not in ("none", "l1", "l2", "elasticnet"):
            raise ValueError(f"penalty={self._get('penalty')!r} is not supported")
        if self._get("eta0") <= 0:
            raise ValueError(f"eta0={self._get('eta0')!r} must be > 0")
        if self._get("shards") < 0:
            raise ValueError(f"shards={self._get('shards')!r} must be >= 0")

    def learn(self, df: DataFrame) -> dict[str, Any]:
        classes = sorted_classes(df, self._get("labelCol"))
        table = training_table(
            df.withColumn("_target", class_index(F.col(self._get("labelCol")), classes)), self._get("featuresCol"), "_target"
        )
        dealt = sharded(table, self._get("shards"))
        try:
            width = feature_count(table)
            weights = _balance(table, len(classes)) if self._get("balanced") else {}
            outputs = 1 if len(classes) == 2 else len(classes)
            rows = np.zeros((outputs, width + 1))
            for _ in range(self._get("epochs")):
                rows = self._epoch(dealt, rows, weights)
        finally:
            dealt.unpersist()
            table.unpersist()
        return {"loss": "perceptron", "classes": classes, "rows": rows.tolist()}

    def _shrink(self) -> tuple[float, float]:
        """L1 and L2 strength per step."""
        alpha, kind = self._get("alpha") * self._get("eta0"), self._get("penalty")
        share = {"none": None, "l1": 1.0, "l2": 0.0, "elasticnet": self._get("l1Ratio")}[kind]
        return (0.0, 0.0) if share is None else (alpha * share, alpha * (1.0 - share))

    def _epoch(self, table: DataFrame, start: np.ndarray, weights: dict[int, float]) -> np.ndarray:
        eta, size = self._get("eta0"), self.BLOCK
        l1, l2 = self._shrink()

        def work(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
            rows, total, seen, walked = start.copy(), np.zeros_like(start), 0, -1
            for shard, block in shard_batches(batches, size):
                if shard != walked:
                    rows, walked = start.copy(), shard
                x, y = block["features"], block["y"].astype(int)
                share = np.array([weights.get(int(c), 1.0) for c in y])
                side = (2.0 * y - 1.0)[:, None] if len(rows) == 1 else np.where(y[:, None] == np.arange(len(rows)), 1.0, -1.0)
                wrong = side * (x @ rows[:, :-1].T + rows[:, -1]) <= 0
                push = eta * (wrong * side * share[:, None]) / len(y)
                rows = rows + np.column_stack([push.T @ x, push.sum(0)])
                if l1 or l2:
                    kept = rows[:, :-1] * (1.0 - l2)
                    rows[:, :-1] = np.sign(kept) * np.maximum(0.0, np.abs(kept) - l1)
                total += rows * len(y)
                seen += len(y)
            return np.concatenate([[seen], total.ravel()])

        flat = summed(table, work, table.rdd.getNumPartitions())
        return (flat[1:] / max(flat[0], 1)).reshape(start.shape)
