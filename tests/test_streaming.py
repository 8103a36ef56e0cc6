from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from loomtab.models.mlp import MlpClassifier, partial_fit
from loomtab.models.simple import GaussianBayes
from loomtab.operators.prepare import TablePrep
from loomtab.sources import generators
from loomtab.streaming.learning import learn_stream, model_before, stored_weights
from loomtab.streaming.scoring import score_stream


@pytest.fixture()
def arriving(spark, tmp_path):
    rows = generators.with_features(generators.moons(spark.range(300).withColumnRenamed("id", "key"), "key")).persist()
    path = str(tmp_path / "in")
    for part in range(3):
        rows.filter(F.col("key") % 3 == part).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    return rows, stream


def test_stream_scores_equal_batch_scores(spark, arriving, tmp_path):
    rows, stream = arriving
    model = GaussianBayes().fit(rows)
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    score_stream(model, stream, out, state, ["key"]).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == sorted(tuple(r) for r in model.transform(rows).select("key", "prediction").collect())
    score_stream(model, stream, out, state, ["key"]).awaitTermination()  # nothing new: nothing written twice
    assert spark.read.parquet(out).count() == 300


def test_stream_through_a_fitted_pipeline(spark, arriving, tmp_path):
    rows, stream = arriving
    prep = TablePrep(keyCols=["key", "y"], scale="standard")
    model = Pipeline(stages=[prep, GaussianBayes()]).fit(rows.select("key", "x1", "x2", "y"))
    out = str(tmp_path / "out")
    score_stream(model, stream.select("key", "x1", "x2", "y"), out, str(tmp_path / "state"), ["key"]).awaitTermination()
    got = sorted(tuple(r) for r in spark.read.parquet(out).collect())
    assert got == sorted(tuple(r) for r in model.transform(rows).select("key", "prediction").collect())


def test_stream_learning_equals_successive_steps(spark, arriving, tmp_path):
    rows, stream = arriving
    folder, state = str(tmp_path / "weights"), str(tmp_path / "state")
    estimator = MlpClassifier(nHidden=3, algorithm="sgd", learningRate="invscaling")
    learn_stream(stream, estimator, folder, state, classes=[0, 1]).awaitTermination()
    stored = {r["batch"]: r for r in stored_weights(spark, folder).collect()}
    assert sorted(stored) == [0, 1, 2] and sum(r["rows"] for r in stored.values()) == 300
    model = None
    for part in range(3):
        model = partial_fit(model, estimator, rows.filter(F.col("key") % 3 == part), [0, 1])
    assert np.array(json.loads(stored[2]["state"])["theta"]) == pytest.approx(np.array(model.fitted["theta"]))


def test_replayed_batch_gives_the_same_weights(spark, arriving, tmp_path):
    _, stream = arriving
    folder = str(tmp_path / "weights")
    estimator = MlpClassifier(nHidden=3, algorithm="sgd")
    learn_stream(stream, estimator, folder, str(tmp_path / "one"), classes=[0, 1]).awaitTermination()
    first = {r["batch"]: r["state"] for r in stored_weights(spark, folder).collect()}
    learn_stream(stream, estimator, folder, str(tmp_path / "two"), classes=[0, 1]).awaitTermination()  # every batch again
    again = {r["batch"]: r["state"] for r in stored_weights(spark, folder).collect()}
    assert {b: json.loads(s)["step"] for b, s in again.items()} == {b: json.loads(s)["step"] for b, s in first.items()}
    for b in first:
        assert json.loads(again[b])["theta"] == pytest.approx(json.loads(first[b])["theta"])
    assert model_before(spark, folder, 0) is None
