"""Splits, folds, shuffles and bootstrap weights decided by the row key alone."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.functions.hashing import SPAN, key_hash, uniform
from loomtab.operators.ordering import ordinal, shifted


def split_column(key: str, test_share: float = 0.25, stream: int = 0, seed: int | None = None) -> Column:
    """'test' for about ``test_share`` of the keys, 'train' for the rest."""
    held_out = key_hash(key, stream, seed) % 100 < round(100 * test_share)
    return F.when(held_out, F.lit("test")).otherwise(F.lit("train"))


def split(df: DataFrame, key: str, test_share: float = 0.25, seed: int | None = None) -> DataFrame:
    return df.withColumn("split", split_column(key, test_share, seed=seed))


def split_exact(df: DataFrame, key: str, test_share: float = 0.25, seed: int | None = None) -> DataFrame:
    """Test side of exactly ceil(share * n) rows: the rows with the smallest hashes."""
    size = math.ceil(df.count() * test_share)
    placed = ordinal(
        df.withColumn("_hash", key_hash(key, 0, seed)), "_hash", ties=[key], span=SPAN, name="_place"
    )
    side = F.when(F.col("_place") <= size, F.lit("test")).otherwise(F.lit("train"))
    return placed.withColumn("split", side).drop("_hash", "_place")


def dev_split(df: DataFrame, key: str, share: float = 0.5, seed: int | None = None) -> DataFrame:
    """Cut the train rows again into 'fit' and 'dev' with an independent hash stream."""
    dev = key_hash(key, 1, seed) % 100 < round(100 * share)
    part = F.when(F.col("split") == "test", F.lit("test")).when(dev, F.lit("dev")).otherwise(F.lit("fit"))
    return df.withColumn("part", part)


def kfold(df: DataFrame, key: str, k: int = 5, stream: int = 2, seed: int | None = None) -> DataFrame:
    """Fold number by hash; sizes are equal in expectation."""
    return df.withColumn("fold", (key_hash(key, stream, seed) % k).cast("int"))


def kfold_even(df: DataFrame, key: str, k: int = 5, seed: int | None = None) -> DataFrame:
    """Folds whose sizes differ by at most one."""
    return _dealt(df, key, k, [], seed)


def stratified_kfold(df: DataFrame, key: str, label: str, k: int = 5, seed: int | None = None) -> DataFrame:
    """Folds in which every class is spread as evenly as its count allows."""
    return _dealt(df, key, k, [label], seed)


def _dealt(df: DataFrame, key: str, k: int, group: Sequence[str], seed: int | None) -> DataFrame:
    placed = ordinal(
        df.withColumn("_hash", key_hash(key, 0, seed)), "_hash", ties=[key], group=group, span=SPAN, name="_place"
    )
    return placed.withColumn("fold", ((F.col("_place") - 1) % k).cast("int")).drop("_hash", "_place")


def shuffled(df: DataFrame, key: str, seed: int | None = None) -> DataFrame:
    """Rows in a reproducible random order."""
    return df.withColumn("_hash", key_hash(key, 0, seed)).orderBy("_hash", key).drop("_hash")


def batches(df: DataFrame, key: str, count: int, seed: int | None = None) -> DataFrame:
    """Assign each row to one of ``count`` mini-batches."""
    return df.withColumn("batch", (key_hash(key, 3, seed) % count).cast("int"))


def bootstrap_weight(key: str, draw: int, terms: int = 12) -> Column:
    """Times a row occurs in bootstrap sample ``draw``: a Poisson(1) count from the key's hash."""
    steps, total, mass = [], 0.0, math.exp(-1.0)
    for n in range(terms):
        total += mass
        steps.append(total)
        mass /= n + 1

    def count(u: Column) -> Column:
        return reduce(add, [(u > F.lit(step)).cast("int") for step in steps])

    # Through a one-element array the draw is hashed once, not once per term.
    return F.transform(F.array(uniform(key, seed=draw)), count)[0]


def horizon_frame(
    df: DataFrame, order: str, value: str, horizon: int, lags: int = 5, group: Sequence[str] = ()
) -> DataFrame:
    """Row-ordered series with ``lags`` past values and the value ``horizon`` rows ahead."""
    placed = ordinal(df, order, group=group)
    shifts = {f"lag_{i}": (value, -i) for i in range(1, lags + 1)} | {"target": (value, horizon)}
    return shifted(placed, "position", shifts, group)


def horizon_split(df: DataFrame, n_train: int | Column, n_last: int | Column, window: int, position: str = "position") -> DataFrame:
    """Mark the first ``n_train`` positions 'train' and the trailing window 'forecast'.

    The window covers positions n_last-window .. n_last counted from 0, both ends
    included where the series is long enough, and may overlap the train rows' successors.
    """
    place = F.col(position) - 1
    last = n_last if isinstance(n_last, Column) else F.lit(n_last)
    first = n_train if isinstance(n_train, Column) else F.lit(n_train)
    return df.withColumn("is_train", place < first).withColumn(
        "is_forecast", place.between(last - F.lit(window), last)
    )
