"""Activation, array and loss expressions that stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def tanh(x: Column) -> Column:
    return F.tanh(x)


def tanh_slope(activated: Column) -> Column:
    """Derivative of tanh, from its output."""
    return 1.0 - activated * activated


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logistic_slope(activated: Column) -> Column:
    """Derivative of the logistic function, from its output."""
    return activated * (1.0 - activated)


def identity(x: Column) -> Column:
    return x


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def doubles(values: Sequence[float]) -> Column:
    """Literal array<double>."""
    return F.array(*[F.lit(float(v)) for v in values])


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def array_total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def softmax(scores: Column) -> Column:
    """Softmax of an array column, shifted by its maximum."""
    shifted = F.transform(scores, lambda v: F.exp(v - F.array_max(scores)))
    return F.transform(shifted, lambda v: v / array_total(shifted))


def log_probabilities(probabilities: Column) -> Column:
    return F.transform(probabilities, lambda v: F.log(v))


def arg_max(scores: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def dense(inputs: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """Affine layer: ``weights[i][j]`` links input i to unit j."""
    units = []
    for j, offset in enumerate(bias):
        units.append(dot(inputs, doubles([row[j] for row in weights])) + F.lit(float(offset)))
    return F.array(*units)


def step_size(eta0: float, step: Column, power: float) -> Column:
    """Inverse-scaling learning rate."""
    return F.lit(eta0) / F.pow(step, F.lit(power))


def binary_log_loss(truth: Column, probability: Column, edge: float = 1e-8) -> Column:
    """Per-row cross-entropy with the probability kept inside [edge, 1-edge]."""
    p = clip(probability, edge, 1.0 - edge)
    return -(truth * F.log(p) + (1.0 - truth) * F.log(1.0 - p))


def half_square_loss(truth: Column, output: Column) -> Column:
    return F.pow(truth - output, F.lit(2.0)) / 2.0
