"""Regular meshes over the range of two columns, and models scored on them."""

from __future__ import annotations

from pyspark.ml import Model
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.session import shuffle_width

MAX_SIDE = 10_000_000


def _ticks(low: float, high: float, step: float) -> int:
    """Number of ticks low, low+step, ... strictly below high."""
    count = 0 if high <= low else int((high - low) / step)
    while low + count * step < high:
        count += 1
    if count > MAX_SIDE:
        raise ValueError(f"{count} ticks on one side; use a larger step")
    return count


def mesh(spark: SparkSession, x_low: float, x_high: float, y_low: float, y_high: float, step: float) -> DataFrame:
    """(i, j, x, y) with x = x_low + i*step below x_high, and y alike: every cell from its number."""
    wide, tall = _ticks(x_low, x_high, step), _ticks(y_low, y_high, step)
    cells = spark.range(0, wide * tall, 1, shuffle_width(spark))
    i, j = F.floor(F.col("id") / F.lit(tall)), F.col("id") % F.lit(tall)
    return cells.select(
        i.alias("i"), j.alias("j"), (F.lit(x_low) + i * F.lit(step)).alias("x"), (F.lit(y_low) + j * F.lit(step)).alias("y")
    )


def mesh_over(df: DataFrame, x: str, y: str, margin: float = 0.5, step: float = 0.02) -> DataFrame:
    """Mesh over the data range of two columns widened by ``margin``."""
    x0, x1, y0, y1 = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    return mesh(df.sparkSession, x0 - margin, x1 + margin, y0 - margin, y1 + margin, step)


def score_mesh(model: Model, cells: DataFrame, features: str = "features") -> DataFrame:
    """Mesh cells with the model's prediction (and scores, where it has them)."""
    return model.transform(cells.withColumn(features, F.array("x", "y")))
