"""Packed rows: models trained together, started from some of the blocks, and ranked by counts in bins."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.models import shared_pass
from loomtab.models.linear import LinearScore
from loomtab.models.losses import Linear
from loomtab.models.shared_pass import Problem, fit_all, packed, training_table
from loomtab.operators import metrics
from loomtab.plans import pipelines, search
from loomtab.plans.search import Fitted, held_out_predictions, roc_areas


def _rows(spark, n, tied=False):
    """Three numbers, a class that follows two of them with noise, five folds."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3))
    if tied:
        x = np.round(x * 2) / 2
    y = (x[:, 0] - x[:, 1] + rng.normal(size=n) > 0).astype(int)
    return spark.createDataFrame([(v.tolist(), int(c), i % 5) for i, (v, c) in enumerate(zip(x, y))], "features array<double>, y int, fold int")


def _problems(tol=1e-11):
    spans = [(0, k) for k in (1, 2, 3)] + [(1, 3)]
    made = [Problem(Linear(b - a, "logistic"), l2=s, holdout=f, span=(a, b), class_weight={0: 1.5, 1: 0.5}, tol=tol) for a, b in spans for s in (1.0, 50.0) for f in (None, 0, 4)]
    return made + [Problem(Linear(3, "squared_hinge"), l2=1.0, holdout=2, tol=tol), Problem(Linear(3, "logistic"), l1=20.0, holdout=1, tol=tol)]


def test_models_fitted_together_equal_models_fitted_apart(spark):
    rows = _rows(spark, 3000)
    held, table = packed(rows, "y", fold="fold"), training_table(rows, "features", "y", "fold")
    together, apart = _problems(), _problems()
    fit_all(held.blocks, together)
    fit_all(table, apart)
    for a, b in zip(together, apart):
        assert a.theta == pytest.approx(b.theta, abs=1e-7) and a.value == pytest.approx(b.value, abs=1e-10)
    held.release()
    table.unpersist()


def test_models_of_a_fold_share_one_evaluation(spark, monkeypatch):
    """A pass computed every model by itself, and each search read rows of as many columns as all folds' components."""
    sizes = []
    made = shared_pass._joined
    monkeypatch.setattr(shared_pass, "_joined", lambda problems, sizes_: sizes.append(found := made(problems, sizes_)) or found)
    candidates = [(i, "logistic", {"reduce__k": str(k), "model__C": c}) for i, (k, c) in enumerate((k, c) for k in (1, 2, 3) for c in ("0.1", "10.0"))]
    pipelines.pipeline_search(_rows(spark, 400), candidates, "y", objectives=["accuracy", "roc_auc"])
    assert [len(g) for g in sizes[0]] == [6] * 5


def test_a_start_from_some_blocks_ends_at_the_same_optimum(spark, monkeypatch):
    rows = _rows(spark, 6000).coalesce(1)
    monkeypatch.setattr(shared_pass, "PACKED_NUMBERS", 300)  # blocks of 100 rows
    held = packed(rows, "y", fold="fold")
    assert held.blocks.count() >= 60 and held.counts == {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    plain, warm = _problems(1e-8), _problems(1e-8)
    slow = fit_all(held.blocks, plain)
    monkeypatch.setattr(shared_pass, "WARM_BLOCKS", 10)
    fast = fit_all(held.blocks, warm)
    assert sum(p.passes for p in warm) < sum(p.passes for p in plain) and max(fast, slow) < 30
    for a, b in zip(warm, plain):
        assert a.theta == pytest.approx(b.theta, abs=1e-5)
    held.release()


@pytest.mark.parametrize("tied", [False, True])
def test_areas_by_bins_equal_areas_by_rank(spark, monkeypatch, tied):
    rows = _rows(spark, 4000, tied)
    held = packed(rows, "y", fold="fold")
    rng = np.random.default_rng(5)
    models = [Fitted(c, f, [Problem(Linear(2, "logistic"), span=(0, 2), theta=rng.normal(size=3) * 10.0**c)]) for c in range(3) for f in (0, 3, None)]
    want = {(r["candidate"], r["fold"]): r["roc_auc"] for r in metrics.roc_auc(held_out_predictions(held.blocks, models), "y", "score", ["candidate", "fold"]).collect()}
    for size in (16384, 20):
        monkeypatch.setattr(search, "BIN_ROWS", size)
        found = {(c, f): area for c, f, area in roc_areas(held.blocks, models)}
        assert found == pytest.approx(want, abs=1e-12)
    held.release()


def test_labels_that_are_no_places_are_numbered(spark):
    rows = _rows(spark, 500)
    for label in (F.col("y") * 5 - 2, F.when(F.col("y") == 1, "yes").otherwise("no")):
        named = rows.withColumn("y", label)
        held = packed(named, "y")
        assert held.classes == sorted(r[0] for r in named.select("y").distinct().collect())
        plain = LinearScore(C=2.0, tol=1e-11).fit(rows).fitted["rows"]
        found = LinearScore(C=2.0, tol=1e-11).fit(named).fitted
        assert found["rows"] == pytest.approx(np.array(plain), abs=1e-8) and found["classes"] == held.classes
        held.release()


def test_steps_refitted_on_packed_rows_equal_steps_fitted_on_rows(spark):
    rows = _rows(spark, 800)
    held = packed(rows, "y", fold="fold")
    final = LinearScore(featuresCol="reduced", labelCol="y", C=3.0, tol=1e-11)
    params = {"reduce__k": "2", "model__C": "3.0"}
    one, two = (pipelines.fit_steps(r, params, final) for r in (held, rows))
    assert one.components == pytest.approx(two.components, abs=1e-9)
    assert np.array(one.model.fitted["rows"]) == pytest.approx(np.array(two.model.fitted["rows"]), abs=1e-6)
    held.release()
