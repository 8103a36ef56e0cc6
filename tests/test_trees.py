from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from loomtab.models import trees
from loomtab.operators.metrics import accuracy, regression
from loomtab.operators.prepare import as_vector
from loomtab.operators.splits import split
from loomtab.sources import generators


@pytest.fixture(scope="module")
def moons(spark):
    keys = spark.range(700).withColumnRenamed("id", "key")
    rows = generators.with_features(generators.moons(keys, "key"))
    return split(rows, "key").withColumn("name", F.when(F.col("y") == 1, "up").otherwise("down")).persist()


@pytest.fixture(scope="module")
def curve(moons):
    return generators.with_features(moons, ("x1", "y")).persist()


def sides(rows):
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def test_adaboost_improves_on_its_first_stump_and_persists(moons, tmp_path):
    train, test = sides(moons)
    one = trees.adaboost_classifier(train, label="name", rounds=1)
    many = trees.adaboost_classifier(train, label="name", rounds=8)
    scores = [accuracy(m.transform(test), "name", "prediction").first()[0] for m in (one, many)]
    assert scores[1] >= scores[0] and scores[1] > 0.8
    many.write().overwrite().save(str(tmp_path / "ada"))
    again = PipelineModel.load(str(tmp_path / "ada")).transform(test).select("key", "prediction")
    assert sorted(again.collect()) == sorted(many.transform(test).select("key", "prediction").collect())


def test_adaboost_keeps_input_columns(moons):
    model = trees.adaboost_classifier(sides(moons)[0], label="name", rounds=2)
    assert model.transform(moons).columns == [*moons.columns, "prediction"]


def test_a_shorter_ensemble_is_a_prefix(moons):
    train, test = sides(moons)
    long = trees.adaboost_classifier(train, label="name", rounds=4)
    short = trees.adaboost_classifier(train, label="name", rounds=2)
    one, two = (m.transform(test).select("key", "prediction").collect() for m in (trees.first_rounds(long, 2), short))
    assert sorted(one) == sorted(two)


@pytest.mark.parametrize("loss", ["linear", "square", "exponential"])
def test_adaboost_regressor(curve, loss):
    train, test = sides(curve)
    model = trees.adaboost_regressor(train, label="x2", loss=loss, rounds=3)
    assert regression(model.transform(test), "x2", "prediction").first()["r2"] > 0.4


def test_bagging_and_extra_trees(curve):
    train, test = sides(curve)
    bag = trees.bagging_regressor(train, "key", label="x2", members=3, depth=4)
    assert regression(bag.transform(test), "x2", "prediction").first()["r2"] > 0.4
    rows = as_vector(curve)
    extra = trees.extra_trees(5, depth=5, featuresCol="vector", labelCol="x2").fit(sides(rows)[0])
    assert regression(extra.transform(sides(rows)[1]), "x2", "prediction").first()["r2"] > 0.3


@pytest.mark.parametrize("loss", ["lad", "huber"])
def test_robust_boosting(curve, loss):
    train, test = sides(curve)
    model = trees.boosted_quantiles(train, label="x2", loss=loss, rounds=6, rate=0.5)
    assert regression(model.transform(test), "x2", "prediction").first()["r2"] > 0.4


def test_quantile_boosting_covers_its_share(curve):
    train, _ = sides(curve)
    model = trees.boosted_quantiles(train, label="x2", loss="quantile", quantile=0.8, rounds=5, rate=0.5)
    below = model.transform(train).agg(F.avg((F.col("x2") <= F.col("prediction")).cast("double"))).first()[0]
    assert below == pytest.approx(0.8, abs=0.05)


def test_single_trees_and_forests(moons, curve):
    rows, other = as_vector(moons), as_vector(curve)
    for model in (trees.decision_tree("classify", featuresCol="vector", labelCol="y"), trees.random_forest("classify", featuresCol="vector", labelCol="y")):
        assert accuracy(model.fit(sides(rows)[0]).transform(sides(rows)[1]), "y", "prediction").first()[0] > 0.8
    for model in (
        trees.decision_tree("regress", splitter="random", featuresCol="vector", labelCol="x2"),
        trees.gradient_boosting("absolute", 4, featuresCol="vector", labelCol="x2"),
    ):
        assert regression(model.fit(sides(other)[0]).transform(sides(other)[1]), "x2", "prediction").first()["r2"] > 0.1
    with pytest.raises(ValueError, match="splitter"):
        trees.decision_tree("classify", splitter="worst")


def test_weighted_median(spark):
    rng = np.random.default_rng(3)
    weights = [0.5, 2.0, 1.0, 0.25, 3.0]
    values = rng.normal(size=(50, 5))
    rows = spark.createDataFrame([tuple(v.tolist()) for v in values], "a double, b double, c double, d double, e double")
    got = [r[0] for r in rows.select(trees.weighted_median([F.col(c) for c in "abcde"], weights)).collect()]
    for row, found in zip(values, got):
        order = np.argsort(row)
        reached = np.cumsum(np.array(weights)[order])
        assert found == row[order][np.searchsorted(reached, sum(weights) / 2)]
