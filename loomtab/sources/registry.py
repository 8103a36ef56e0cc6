"""Saved models and the table that lists them."""

from __future__ import annotations

from pyspark.ml import Model, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.operators.columns import stack_frames

REGISTRY = "name string, model string, objective string, search string, path string"


def save_model(spark: SparkSession, model: Model, root: str, model_name: str, objective: str, search: str, prefix: str = "") -> str:
    """Save under ``root`` as [prefix-]model-objective-search and list it in the registry table."""
    name = "-".join(p for p in (prefix, model_name, objective, search) if p)
    path = f"{root}/models/{name}"
    stored = model if isinstance(model, PipelineModel) else PipelineModel([model])
    stored.write().overwrite().save(path)
    spark.createDataFrame([(name, model_name, objective, search, path)], REGISTRY).coalesce(1).write.mode("append").parquet(f"{root}/registry")
    return path


def registered(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """Registry rows whose name matches a glob, one per name."""
    like = pattern.replace("%", r"\%").replace("_", r"\_").replace("*", "%").replace("?", "_")
    return spark.read.schema(REGISTRY).parquet(f"{root}/registry").filter(F.col("name").like(like)).distinct()


def load_models(spark: SparkSession, root: str, pattern: str = "*") -> dict[str, PipelineModel]:
    rows = registered(spark, root, pattern).orderBy("name").collect()
    return {r["name"]: PipelineModel.load(r["path"]) for r in rows}


def score_all(models: dict[str, PipelineModel], df: DataFrame, keep: list[str], prediction: str = "prediction") -> DataFrame:
    """(model, keep..., prediction) of every loaded model over the same rows.

    The part of the name before the first dash tells cohorts of models apart.
    """
    parts = [
        m.transform(df).select(F.lit(name).alias("model"), F.split(F.lit(name), "-")[0].alias("family"), *keep, F.col(prediction).cast("string").alias("prediction"))
        for name, m in models.items()
    ]
    return stack_frames(parts)
