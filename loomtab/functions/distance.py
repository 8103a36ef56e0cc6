"""Distances between two array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomtab.functions.maths import array_total

METRICS = ("euclidean", "manhattan", "chebyshev", "minkowski")


def check_metric(metric: str, p: float = 2.0) -> None:
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}; choose one of {METRICS}")
    if metric == "minkowski" and p < 1:
        raise ValueError("minkowski needs p >= 1, otherwise it is not a metric")


def distance(a: Column, b: Column, metric: str = "euclidean", p: float = 2.0) -> Column:
    check_metric(metric, p)
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    if metric == "manhattan":
        return array_total(gaps)
    if metric == "chebyshev":
        return F.array_max(gaps)
    if metric == "euclidean":
        return F.sqrt(array_total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))
    return F.pow(array_total(F.transform(gaps, lambda g: F.pow(g, F.lit(p)))), F.lit(1.0 / p))
