from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.operators import metrics
from loomtab.plans.evaluators import TableEvaluator

# Confusion matrices (rows = truth) with accuracy, weighted precision and weighted F1.
GOLDENS = [
    ([[9, 1, 5], [3, 1, 1], [2, 0, 3]], 0.52, 0.552380952381, 0.515270935961),
    ([[15, 0, 0], [5, 0, 0], [5, 0, 0]], 0.6, 0.36, 0.45),
    ([[2401, 303], [549, 102]], 0.746050670641, 0.704839514905, 0.721995888592),
    ([[2155, 549], [489, 162]], 0.690611028316, 0.701112456313, 0.695690223145),
    ([[1897, 807], [367, 284]], 0.650074515648, 0.725823484278, 0.678771276497),
    ([[2598, 106], [576, 75]], 0.796721311475, 0.740102648848, 0.747431852566),
    ([[152, 2552], [17, 634]], 0.234277198212, 0.763501084757, 0.149404275786),
    ([[1941, 763], [427, 224]], 0.645305514158, 0.704666719229, 0.669935880258),
    ([[0, 2704], [0, 651]], 0.194038748137, 0.037651035779, 0.063065014996),
    ([[2376, 328], [541, 110]], 0.740983606557, 0.705215228939, 0.720560335757),
    ([[8, 217, 1872], [0, 93, 558], [1, 60, 546]], 0.192846497765, 0.637554291828, 0.095238166465),
    ([[34, 475, 1588], [6, 173, 472], [5, 131, 471]], 0.202086438152, 0.549011008018, 0.121103479902),
    ([[1166, 904, 27], [383, 255, 13], [378, 221, 8]], 0.425931445604, 0.444210045077, 0.415367547157),
    ([[1525, 554, 18], [365, 280, 6], [402, 193, 12]], 0.541579731744, 0.529083874087, 0.505860007759),
    ([[528, 378, 1191], [101, 162, 388], [122, 100, 385]], 0.320417287630, 0.524022628779, 0.334638667003),
    ([[46, 318, 1733], [6, 129, 516], [13, 90, 504]], 0.202384500745, 0.522069019948, 0.123014256463),
    ([[1861, 843], [441, 210]], 0.617287630402, 0.690258389417, 0.647064921729),
    ([[2097, 0, 0], [651, 0, 0], [607, 0, 0]], 0.625037257824, 0.390671573668, 0.480815528121),
    ([[2095, 2, 0], [651, 0, 0], [607, 0, 0]], 0.624441132638, 0.390531779046, 0.480533231245),
    ([[1056, 659, 382], [337, 184, 130], [319, 181, 107]], 0.401490312966, 0.451677759942, 0.420779445489),
]


def cells(spark, matrices):
    rows = [(g, i, j, n) for g, m in enumerate(matrices) for i, row in enumerate(m) for j, n in enumerate(row) if n]
    return spark.createDataFrame(rows, "golden int, y int, p int, n bigint")


def test_logged_matrices(spark):
    table = metrics.summary_from(cells(spark, [g[0] for g in GOLDENS]), ["golden"])
    found = {r["golden"]: r for r in table.collect()}
    for i, (_, accuracy, precision, f1) in enumerate(GOLDENS):
        assert found[i]["accuracy"] == pytest.approx(accuracy, abs=1e-11)
        assert found[i]["jaccard"] == found[i]["accuracy"]
        assert found[i]["hamming_loss"] == pytest.approx(1 - accuracy, abs=1e-11)
        assert found[i]["recall"] == pytest.approx(accuracy, abs=1e-11)
        assert found[i]["precision"] == pytest.approx(precision, abs=1e-11)
        assert found[i]["f1"] == pytest.approx(f1, abs=1e-11)


def test_class_never_predicted_scores_zero(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, p string")
    report = {r["class"]: r for r in metrics.classification_report(rows, "y", "p").collect()}
    assert report["b"]["precision"] == 0.0 and report["b"]["f1"] == 0.0
    assert report["avg / total"]["support"] == 2


def test_confusion_matrix_fills_zeros(spark):
    rows = spark.createDataFrame([("a", "a"), ("b", "a")], "y string, p string")
    wide = {r["y"]: (r["a"], r["b"], r["c"]) for r in metrics.confusion_matrix(rows, "y", "p", ["a", "b", "c"]).collect()}
    assert wide == {"a": (1, 0, 0), "b": (1, 0, 0), "c": (0, 0, 0)}


def brute_auc(y, s):
    pos, neg = s[y == 1], s[y == 0]
    return float(np.mean((pos[:, None] > neg[None, :]) + 0.5 * (pos[:, None] == neg[None, :])))


def brute_ap(y, s):
    total, out = y.sum(), 0.0
    for cut in np.unique(s)[::-1]:
        chosen = s >= cut
        out += y[s == cut].sum() / total * y[chosen].sum() / chosen.sum()
    return float(out)


@pytest.mark.parametrize("levels", [2, 7, 500])
def test_ranking_metrics_against_brute_force(spark, levels):
    rng = np.random.default_rng(levels)
    y = rng.integers(0, 2, 400)
    s = rng.integers(0, levels, 400) / levels
    s[: 400 // 3] = 0.5  # one score holds a third of the rows
    rows = spark.createDataFrame(list(zip(y.tolist(), s.tolist())), "y int, score double")
    assert metrics.roc_auc(rows, "y", "score").first()[0] == pytest.approx(brute_auc(y, s), abs=1e-12)
    assert metrics.average_precision(rows, "y", "score").first()[0] == pytest.approx(brute_ap(y, s), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    rows = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, score double")
    assert metrics.roc_auc(rows, "y", "score").first()[0] is None


def test_regression_metrics(spark):
    y, p = np.array([1.0, 2.0, 4.0, 7.0]), np.array([1.5, 1.5, 4.5, 6.0])
    row = metrics.regression(spark.createDataFrame(list(zip(y.tolist(), p.tolist())), "y double, p double"), "y", "p").first()
    assert row["mse"] == pytest.approx(np.mean((y - p) ** 2))
    assert row["mae"] == pytest.approx(np.mean(np.abs(y - p)))
    assert row["r2"] == pytest.approx(1 - np.mean((y - p) ** 2) / np.var(y))
    assert row["explained_variance"] == pytest.approx(1 - np.var(y - p) / np.var(y))


def test_log_loss_clips(spark):
    rows = spark.createDataFrame([(1.0,), (0.0,)], "q double")
    assert metrics.log_loss(rows, "q").first()[0] == pytest.approx(-math.log(1e-15) / 2)


def test_evaluator_names_and_direction(spark):
    rows = spark.createDataFrame([(1, 1.0, 0.9), (0, 1.0, 0.4), (0, 0.0, 0.2)], "y int, prediction double, score double")
    assert TableEvaluator(metric="accuracy").evaluate(rows) == pytest.approx(2 / 3)
    assert TableEvaluator(metric="roc_auc").evaluate(rows) == 1.0
    assert TableEvaluator(metric="mse").isLargerBetter() is False
    with pytest.raises(ValueError):
        TableEvaluator(metric="acuracy")


def test_order_of_rows_does_not_matter(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("y"), (F.col("id") % 2).alias("p"))
    one = metrics.summary(rows, "y", "p").first().asDict()
    other = metrics.summary(rows.repartition(7).orderBy(F.rand(1)), "y", "p").first().asDict()
    assert one == pytest.approx(other)


def test_missing_predictions_are_misses_and_no_part_of_regression(spark):
    frame = spark.createDataFrame([(1.0, 1.0), (2.0, 2.0), (100.0, None), (-100.0, None)], "y double, p double")
    assert metrics.accuracy(frame, "y", "p").first()["accuracy"] == 0.5
    assert metrics.percent_error(frame, "y", "p").first()["percent_error"] == 50.0
    row = metrics.regression(frame.union(spark.createDataFrame([(4.0, 3.0)], "y double, p double")), "y", "p").first()
    assert abs(row["mse"] - 1 / 3) < 1e-12 and abs(row["r2"] - (1 - (1 / 3) / (14 / 9))) < 1e-12


@pytest.mark.parametrize("odd", [("d", "a"), ("a", "d"), ("a", None)])
def test_confusion_matrix_leaves_no_row_uncounted(spark, odd):
    rows = spark.createDataFrame([("a", "a"), odd], "y string, p string")
    with pytest.raises(Exception, match="not in classes"):
        metrics.confusion_matrix(rows, "y", "p", ["a", "b"]).collect()
