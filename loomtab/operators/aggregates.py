"""Column profiles, modes, class counts, histograms and fold summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean, min, max and population deviation of each column, in one pass."""
    return df.agg(
        *[
            part
            for c in columns
            for part in (
                F.avg(c).alias(f"{c}_mean"),
                F.min(c).alias(f"{c}_min"),
                F.max(c).alias(f"{c}_max"),
                F.stddev_pop(c).alias(f"{c}_std"),
            )
        ]
    )


def value_counts(df: DataFrame, columns: Sequence[str], kind: str = "string", weight: Column | None = None) -> DataFrame:
    """(column, value, n[, weight]) for every distinct value of every column, in one shuffle.

    Counts are combined before the shuffle, so a value held by most rows costs one
    record per task. Memory does not grow with the number of distinct values.
    """
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast(kind).alias("value")) for c in columns])
    )
    extra = [] if weight is None else [weight.alias("weight")]
    totals = [] if weight is None else [F.sum("weight").alias("weight")]
    return (
        df.select(pairs.alias("pair"), *extra)
        .select("pair.*", *["weight"] * len(extra))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"), *totals)
    )


def modes(counts: DataFrame) -> DataFrame:
    """(column, mode): the most frequent value, the smallest one on ties."""
    return counts.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("class")).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight of each class: n / (classes * n_class)."""
    counts = class_counts(df, label)
    per_class = counts.agg((F.sum("n") / F.count(F.lit(1))).alias("share")).scalar()
    return counts.select("class", "n", (per_class / F.col("n")).alias("weight"))


def histogram(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """(bin, n, density) over equal-width bins; the last bin includes its right edge."""
    low, high, total = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not total:
        raise ValueError(f"{column!r} holds no values")
    width = (high - low) / bins
    if width == 0:
        spot = F.lit(0)
    else:
        spot = F.least(F.floor((F.col(column) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
    counts = (
        df.filter(F.col(column).isNotNull())
        .groupBy(spot.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    density = F.coalesce(F.col("n"), F.lit(0)) / F.lit(float(total)) / F.lit(width or 1.0)
    return every.join(counts, "bin", "left").select(
        "bin", F.coalesce("n", F.lit(0)).alias("n"), density.alias("density")
    )


def fold_summary(scores: DataFrame, score: str | Column = "score", by: Sequence[str] = ()) -> DataFrame:
    """Mean, standard error and population deviation of fold scores."""
    value = F.col(score) if isinstance(score, str) else score
    return scores.groupBy(*by).agg(
        F.avg(value).alias("mean"),
        (F.stddev_samp(value) / F.sqrt(F.count(value))).alias("sem"),
        F.stddev_pop(value).alias("std"),
    )
