"""The long table of held-out predictions and what is read from it; the two-step search."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.models.linear import LinearScore
from loomtab.models.simple import GaussianBayes, NearestCentroid
from loomtab.operators.splits import kfold, split
from loomtab.plans.families import FOLD_METRICS, Member, family_results, fold_metrics, member_predictions, member_scores
from loomtab.plans.pipelines import by_step, components_of, fit_steps, fold_moments, merged, pipeline_search
from loomtab.sources import generators


@pytest.fixture(scope="module")
def rows(spark):
    made = generators.with_features(generators.moons(spark.range(400).withColumnRenamed("id", "key"), "key", 0.3))
    return kfold(split(made, "key"), "key", 3).select("key", "features", "y", "split", "fold").persist()


MEMBERS = [
    Member("logistic", {"C": 1.0}, shared="logistic"), Member("margin", {"C": 10.0}, shared="margin"),
    Member("bayes", {}, GaussianBayes()), Member("centroid", {}, NearestCentroid()),
]


def test_every_member_predicts_every_row_once(rows):
    table = member_predictions(rows, MEMBERS, "y", folds=3)
    assert {(r["member"], r["count"]) for r in table.groupBy("member").count().collect()} == {(i, 400) for i in range(4)}
    alone = Member("logistic", {}, LinearScore(C=1.0, balanced=True))
    other = member_scores(member_predictions(rows, [alone], "y", folds=3)).filter("metric = 'accuracy'").first()["mean"]
    shared = member_scores(table).filter("metric = 'accuracy' and member = 0").first()["mean"]
    assert shared == pytest.approx(other, abs=0.01)


def test_fold_metrics_by_hand(spark):
    y, p, score = [1, 1, 0, 0, 1], [1, 0, 1, 0, 1], [0.9, 0.4, 0.6, 0.1, 0.8]
    frame = spark.createDataFrame([(0, 0, a, b, c) for a, b, c in zip(y, p, score)], "member int, fold int, y int, prediction int, score double")
    got = {r["metric"]: r["value"] for r in fold_metrics(frame).collect()}
    assert got == pytest.approx({"accuracy": 0.6, "recall": 2 / 3, "precision": 2 / 3, "f1": 2 / 3, "average_precision": (1 + 1 + 3 / 4) / 3, "roc_auc": 5 / 6})


def test_results_name_the_best_member(rows):
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    predictions = member_predictions(train, MEMBERS, "y", folds=3)
    out = {r["optimization score function"]: r.asDict() for r in family_results(train, test, MEMBERS, predictions, "y").collect()}
    assert set(out) == set(FOLD_METRICS)
    means = {(r["member"], r["metric"]): r["mean"] for r in member_scores(predictions).collect()}
    for objective, row in out.items():
        assert row["optimization score"] == pytest.approx(max(means[i, objective] for i in range(4))) and row["Accuracy"] > 0.6
        assert row[f"cv {objective}"] == row["optimization score"]


def test_more_than_two_classes_are_refused(rows):
    with pytest.raises(ValueError, match="3 classes"):
        member_predictions(rows.withColumn("y", F.col("key") % 3), MEMBERS, "y", folds=3)


def test_moments_of_the_rest_equal_numpy(rows):
    moments = fold_moments(rows, "features", "fold", 3)
    x = {f: np.array([r["features"] for r in rows.filter(F.col("fold") == f).collect()]) for f in range(3)}
    for f in range(3):
        rest = np.vstack([x[g] for g in range(3) if g != f])
        n, sums, scatter = merged([m for g, m in enumerate(moments) if g != f])
        assert n == len(rest) and np.allclose(sums, rest.sum(axis=0)) and np.allclose(scatter / n, np.cov(rest.T, bias=True))
        mean, axes, values = components_of((n, sums, scatter), 2)
        assert np.allclose(axes.T @ np.cov(rest.T, bias=True) @ axes, np.diag(values)) and np.allclose(mean, rest.mean(axis=0))


def test_two_step_search(rows):
    candidates = [(i, "logistic", {"reduce__k": str(k), "model__C": str(c)}) for i, (k, c) in enumerate([(1, 1.0), (2, 1.0), (2, 100.0)])]
    scores = {(r["candidate"], r["fold"]): r["score"] for r in pipeline_search(rows, candidates, "y", folds=3, objectives=["accuracy"]).collect()}
    assert len(scores) == 9 and np.mean([scores[2, f] for f in range(3)]) > np.mean([scores[0, f] for f in range(3)])
    model = fit_steps(rows, candidates[2][2], LinearScore(featuresCol="reduced", labelCol="y", C=100.0))
    assert model.transform(rows).filter("prediction = y").count() > 320
    assert by_step(candidates[0][2]) == {"reduce": {"k": "1"}, "model": {"C": "1.0"}}
    with pytest.raises(ValueError, match="no parameter"):
        by_step({"k": 1})
    with pytest.raises(ValueError, match="between 1 and 2"):
        pipeline_search(rows, [(0, "logistic", {"reduce__k": "3"})], "y", folds=3)
