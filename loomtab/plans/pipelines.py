"""Search over two steps: principal components, then a linear classifier on the first k of them.

One pass sums the scatter of every fold; the scatter without a fold is the whole minus that fold's, so each fold's
components come from its own training rows and one decomposition serves every number of components. All folds' components
are then columns of one wide row, of which each candidate reads a run, and all candidates and folds train in shared passes.
Rows are packed once, as they are; a task computes the wide row of each when it reads them, for search and refit alike.

Parameters are addressed by step: ``reduce__k`` and ``model__C``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.models.arrays import matrix, rows_of, summed
from loomtab.models.shared_pass import Lift, Packed, blocks, packed
from loomtab.plans.search import Candidate, packed_search

STEPS = ("reduce", "model")


def by_step(params: Mapping[str, Any]) -> dict[str, dict[str, Any]]:
    """{'reduce__k': 2, 'model__C': 1} as {'reduce': {'k': 2}, 'model': {'C': 1}}."""
    out: dict[str, dict[str, Any]] = {s: {} for s in STEPS}
    for name, value in params.items():
        step, _, rest = name.partition("__")
        if step not in out or not rest:
            raise ValueError(f"{name!r} names no parameter of the steps {', '.join(STEPS)}")
        out[step][rest] = value
    return out


def fold_moments(df: DataFrame, features: str, fold: str | None, folds: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """(n, sums, scatter) of every fold by one pass; products are taken around the first row, which keeps them small."""
    rows = df.select(F.col(features).cast("array<double>").alias("features"), F.lit(0.0).alias("y"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"))
    first = rows.select("features").first()
    if first is None:
        raise ValueError("no rows")
    return _moments(rows, np.array(first["features"]), folds)


def packed_moments(held: Packed, folds: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """The same of packed rows."""
    first = held.blocks.select("features").first()
    if first is None:
        raise ValueError("no rows")
    return _moments(held.blocks, np.frombuffer(first["features"], count=held.width), folds)


def _moments(rows: DataFrame, base: np.ndarray, folds: int) -> list[tuple[float, np.ndarray, np.ndarray]]:
    width = len(base)

    def work(batches: Iterable[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((folds, 1 + width + width * width))
        for block in blocks(batches):
            x = block["features"] - base
            for f in range(folds):
                mine = x[block["fold"] == f]
                total[f] += np.concatenate([[len(mine)], mine.sum(axis=0), (mine.T @ mine).ravel()])
        return total.ravel()

    sums = summed(rows, work, rows.rdd.getNumPartitions()).reshape(folds, -1)
    return [(s[0], s[1 : width + 1] + s[0] * base, _shifted(s, base, width)) for s in sums]


def _shifted(s: np.ndarray, base: np.ndarray, width: int) -> np.ndarray:
    """Scatter around the rows' own mean."""
    mean = s[1 : width + 1] / max(s[0], 1.0)
    return s[width + 1 :].reshape(width, width) - s[0] * np.outer(mean, mean)


def merged(parts: Sequence[tuple[float, np.ndarray, np.ndarray]]) -> tuple[float, np.ndarray, np.ndarray]:
    """Moments of several parts together."""
    n = sum(p[0] for p in parts)
    sums = sum(p[1] for p in parts)
    scatter = sum(p[2] for p in parts)
    for m, s, _ in parts:
        if m:
            off = s / m - sums / n
            scatter = scatter + m * np.outer(off, off)
    return n, sums, scatter


def components_of(moments: tuple[float, np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, k components by column, their variances): unit vectors whose largest entry is positive."""
    n, sums, scatter = moments
    values, vectors = np.linalg.eigh(scatter / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    lead = np.abs(vectors).argmax(axis=0)
    return sums / n, vectors * np.where(vectors[lead, np.arange(vectors.shape[1])] < 0, -1.0, 1.0), values


def lifted(axes: Sequence[tuple[np.ndarray, np.ndarray]]) -> Lift:
    """Rows to the scores of all (mean, components) side by side."""
    both = [(m, c) for m, c, *_ in axes]
    return lambda rows: np.hstack([(rows - mean) @ components for mean, components in both])


def projected(df: DataFrame, features: str, axes: Sequence[tuple[np.ndarray, np.ndarray]], output: str) -> DataFrame:
    """``df`` with the scores of all (mean, components) side by side."""
    lift = lifted(axes)

    @F.arrow_udf("array<double>")
    def project(x: pa.Array) -> pa.Array:
        return rows_of(lift(matrix(x))) if len(x) else pa.array([], pa.list_(pa.float64()))

    return df.withColumn(output, project(F.col(features).cast("array<double>")))


def pipeline_search(
    df: DataFrame | Packed, candidates: Sequence[Candidate], label: str, features: str = "features", fold: str = "fold", folds: int = 5, **search: Any
) -> DataFrame:
    """(candidate, fold, objective, score) of candidates whose parameters are named by step.

    A candidate's fold is scored under components that never saw it. Takes the options of ``packed_search``; rows that are
    packed already stay so.
    """
    if isinstance(df, DataFrame):
        held = packed(df, label, features, fold)
        try:
            return pipeline_search(held, candidates, label, features, fold, folds, **search)
        finally:
            held.release()
    steps = {c[0]: by_step(c[2]) for c in candidates}
    depth = {number: int(s["reduce"].get("k", 2)) for number, s in steps.items()}
    moments = packed_moments(df, folds)
    if max(depth.values()) > df.width or min(depth.values()) < 1:
        raise ValueError(f"reduce__k must lie between 1 and {df.width}")
    most = max(depth.values())
    axes = [components_of(merged([m for g, m in enumerate(moments) if g != f]), most) for f in range(folds)]
    spans = {number: lambda f, k=k: (f * most, f * most + k) for number, k in depth.items()}
    models: list[Candidate] = [(c[0], c[1], steps[c[0]]["model"]) for c in candidates]
    return packed_search(df, models, folds, spans=spans, lift=lifted(axes), width=folds * most, **search)


class TwoSteps:
    """The steps fitted to all rows: components, then the classifier; transforms rows that have the features."""

    def __init__(self, mean: np.ndarray, components: np.ndarray, model: Any, features: str):
        self.mean, self.components, self.model, self.features = mean, components, model, features

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(projected(df, self.features, [(self.mean, self.components)], "reduced")).drop("reduced")


def fit_steps(df: DataFrame | Packed, params: Mapping[str, Any], estimator: Any, features: str = "features", folds: int = 5) -> TwoSteps:
    """Refit a candidate: ``estimator`` must read the column 'reduced'. Packed rows, of ``folds`` folds, need a ``LinearScore`` classifier."""
    k = int(by_step(params)["reduce"].get("k", 2))
    moments = packed_moments(df, folds) if isinstance(df, Packed) else fold_moments(df, features, None, 1)
    mean, components, _ = components_of(merged(moments), k)
    axes = [(mean, components)]
    model = estimator.fit_packed(df, lifted(axes), k) if isinstance(df, Packed) else estimator.fit(projected(df, features, axes, "reduced"))
    return TwoSteps(mean, components, model, features)
