"""Labelled data sets and parameter priors derived from the keys of any table.

Every value is a function of the row key, so the output has one row per input row,
keeps its values under retries, and grows with the table (or with ``spark.range``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions.hashing import key_hash, normal, uniform


def exponential(u: Column, scale: float) -> Column:
    return -F.lit(float(scale)) * F.log(1.0 - u)


def between(u: Column, low: float, width: float) -> Column:
    return F.lit(float(low)) + u * F.lit(float(width))


def whole(u: Column, low: int, high: int) -> Column:
    """Integer in [low, high)."""
    return F.floor(F.lit(low) + u * F.lit(high - low)).cast("int")


def power_beta(u: Column, a: float, loc: float = 0.0, scale: float = 1.0) -> Column:
    """Beta(a, 1) draw, shifted and stretched."""
    return F.lit(float(loc)) + F.lit(float(scale)) * F.pow(u, F.lit(1.0 / a))


def one_of(u: Column, choices: Sequence[object]) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in choices]), whole(u, 0, len(choices)) + 1)


def beta_quantile(u: Column, a: float, b: float, loc: float = 0.0, scale: float = 1.0, points: int = 20001) -> Column:
    """Beta(a, b >= 1) draw: the inverse distribution function, interpolated in Arrow batches.

    The substitution x = t**(1/a) keeps the density bounded at 0 for any a > 0.
    """
    if a <= 0 or b < 1:
        raise ValueError("needs a > 0 and b >= 1")
    t = np.linspace(0.0, 1.0, points)
    x = t ** (1.0 / a)
    density = (1.0 - x) ** (b - 1.0)
    mass = np.concatenate([[0.0], np.cumsum((density[1:] + density[:-1]) / 2.0)])
    mass /= mass[-1]

    @F.pandas_udf("double")
    def quantile(share: pd.Series) -> pd.Series:
        return pd.Series(loc + scale * np.interp(share.to_numpy(), mass, t) ** (1.0 / a))

    return quantile(u)


def moons(df: DataFrame, key: str, noise: float = 0.3, seed: int = 0) -> DataFrame:
    """Two interleaved half circles: (key, x1, x2, y)."""
    y = (key_hash(key, 3, seed) % 2).cast("int")
    angle = F.pi() * uniform(key, 2, seed)
    x1 = F.when(y == 0, F.cos(angle)).otherwise(1.0 - F.cos(angle))
    x2 = F.when(y == 0, F.sin(angle)).otherwise(0.5 - F.sin(angle))
    return _noisy(df, key, x1, x2, y, noise, seed)


def circles(df: DataFrame, key: str, factor: float = 0.5, noise: float = 0.2, seed: int = 1) -> DataFrame:
    """Two concentric circles: class 1 is the inner one."""
    y = (key_hash(key, 3, seed) % 2).cast("int")
    angle = 2.0 * F.pi() * uniform(key, 2, seed)
    radius = F.when(y == 1, F.lit(factor)).otherwise(F.lit(1.0))
    return _noisy(df, key, radius * F.cos(angle), radius * F.sin(angle), y, noise, seed)


def blobs(df: DataFrame, key: str, seed: int = 2) -> DataFrame:
    """Two linearly separable clouds, moved apart and jittered by a uniform draw of width 2."""
    y = (key_hash(key, 3, seed) % 2).cast("int")
    side = F.when(y == 1, F.lit(2.5)).otherwise(F.lit(-2.5))
    x1 = side + 0.6 * normal(key, (0, 1), seed) + 2.0 * uniform(key, 2, seed)
    x2 = side + 0.6 * normal(key, (0, 1), seed + 1000) + 2.0 * uniform(key, 2, seed + 1000)
    return df.select(key, x1.alias("x1"), x2.alias("x2"), y.alias("y"))


# Class means and variances of the three-class mixture.
MIXTURE_MEANS = [(-1.0, 0.0), (2.0, 4.0), (3.0, 1.0)]
MIXTURE_VARIANCES = [(1.0, 1.0), (0.5, 1.2), (1.5, 0.7)]


def mixture(df: DataFrame, key: str, seed: int = 3) -> DataFrame:
    """Three Gaussian classes in the plane: (key, x1, x2, y)."""
    y = (key_hash(key, 3, seed) % len(MIXTURE_MEANS)).cast("int")

    def pick(values: Sequence[float]) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), y + 1)

    columns = []
    for axis in (0, 1):
        mean = pick([m[axis] for m in MIXTURE_MEANS])
        spread = pick([v[axis] ** 0.5 for v in MIXTURE_VARIANCES])
        columns.append((mean + spread * normal(key, (0, 1), seed + 1000 * axis)).alias(f"x{axis + 1}"))
    return df.select(key, *columns, y.alias("y"))


def _noisy(df: DataFrame, key: str, x1: Column, x2: Column, y: Column, noise: float, seed: int) -> DataFrame:
    if noise:
        x1 = x1 + F.lit(noise) * normal(key, (0, 1), seed)
        x2 = x2 + F.lit(noise) * normal(key, (0, 1), seed + 1000)
    return df.select(key, x1.alias("x1"), x2.alias("x2"), y.alias("y"))


def with_features(df: DataFrame, columns: Sequence[str] = ("x1", "x2"), output: str = "features") -> DataFrame:
    return df.withColumn(output, F.array(*[F.col(c).cast("double") for c in columns]))
