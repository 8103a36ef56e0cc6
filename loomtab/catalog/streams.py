"""Queries over streams: scoring and learning by micro-batch, with results equal to the batch form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.catalog.common import query, r
from loomtab.models.mlp import MlpClassifier
from loomtab.models.simple import NearestCentroid
from loomtab.session import load, scratch_path
from loomtab.streaming.learning import learn_stream, stored_weights
from loomtab.streaming.scoring import score_stream


def _features(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("double") / 100.0
    return events.select("event_id", F.array(F.col("value") / 100.0, k).alias("features"), F.col("event_type").alias("y"))


def _arriving(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream of three files, one per micro-batch."""
    events = load(spark, folder, "events")
    path = scratch_path(spark, "arriving")
    events.repartitionByRange(3, "event_id").write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    """with e as (select event_id, event_type as y, value / 100.0 as a, cast(json_extract_string(props, '$.k') as double) / 100.0 as b from events),
    c as (select y as class, avg(a) as ca, avg(b) as cb from e group by 1),
    d as (select event_id, class, round(sqrt((a - ca) * (a - ca) + (b - cb) * (b - cb)), 9) as d from e, c)
    select event_id, class as prediction from d qualify row_number() over (partition by event_id order by d, class) = 1"""
)
def stream_score(spark: SparkSession, folder: str) -> DataFrame:
    """A model fitted on the batch scores the same rows as they arrive."""
    model = NearestCentroid().fit(_features(load(spark, folder, "events")))
    path = scratch_path(spark, "scored")
    score_stream(model, _features(_arriving(spark, folder)), path, f"{path}-state", ["event_id"]).awaitTermination()
    return spark.read.parquet(path)


@query()
def stream_learn(spark: SparkSession, folder: str) -> DataFrame:
    """Weights after each micro-batch of incremental learning."""
    stream = _features(_arriving(spark, folder)).withColumn("y", (F.col("y") == "error").cast("int"))
    path = scratch_path(spark, "weights")
    estimator = MlpClassifier(nHidden=3, algorithm="sgd", learningRate="invscaling")
    learn_stream(stream, estimator, path, f"{path}-state", classes=[0, 1]).awaitTermination()
    theta = F.from_json("state", "theta array<double>, step double")
    rows = stored_weights(spark, path).select("batch", "rows", theta.alias("s"))
    return rows.select("batch", "rows", F.col("s.step").alias("step"), F.posexplode("s.theta").alias("weight", "value")).withColumn(
        "value", r("value", 9)
    )
