"""Score arriving rows with a fitted model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def score_stream(model: Model, stream: DataFrame, path: str, state: str, keep: Sequence[str], prediction: str = "prediction") -> StreamingQuery:
    """Append (keep..., prediction) to a parquet table; statistics stay those of the fitted model."""
    return (
        model.transform(stream)
        .select(*keep, prediction)
        .writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", state)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
