"""Learn from a stream: one gradient step per micro-batch, safe to replay."""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from loomtab.models.mlp import MlpModel, partial_fit

WEIGHTS = "batch bigint, rows bigint, state string"


def stored_weights(spark: SparkSession, folder: str) -> DataFrame:
    """(batch, rows, state): the model after each micro-batch."""
    return spark.read.schema(WEIGHTS).parquet(f"{folder}/step-*")


def model_before(spark: SparkSession, folder: str, batch: int) -> MlpModel | None:
    """Model left by the batch before ``batch``; every batch leaves one row, so only one step is read."""
    if batch == 0:
        return None
    row = spark.read.schema(WEIGHTS).parquet(f"{folder}/step-{batch - 1}").first()
    return MlpModel(state=row["state"]) if row["state"] else None


def learn_stream(stream: DataFrame, estimator: Any, folder: str, state: str, classes: Sequence[Any] | None = None) -> StreamingQuery:
    """Run ``partial_fit`` on every micro-batch.

    Batch n starts from the weights stored by the batch before it and overwrites its own
    folder, so a replay after a failure gives the same weights instead of a second step.
    """
    spark = stream.sparkSession

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            before = model_before(spark, folder, number)
            rows = batch.count()
            known = sorted(set(classes)) if classes is not None else None
            after = partial_fit(before, estimator, batch, known) if rows else before
            row = (number, rows, json.dumps(after.fitted) if after else None)
            spark.createDataFrame([row], WEIGHTS).coalesce(1).write.mode("overwrite").parquet(f"{folder}/step-{number}")
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(step).option("checkpointLocation", state).trigger(availableNow=True).start()
    )
