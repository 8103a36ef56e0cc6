"""Kernel searches keep the features alone: the maps are computed by the tasks that read them."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.models.linear import kernel_lift, kernel_map
from loomtab.plans import search


@pytest.mark.parametrize(("kernel", "degree", "width"), [("linear", 0, 2), ("poly", 1, 3), ("poly", 2, 1), ("poly", 3, 2), ("poly", 5, 3), ("rbf", 0, 4)])
def test_lift_equals_the_map_of_the_table(spark, kernel, degree, width):
    x = np.random.default_rng(1).normal(size=(20, width))
    x[3] = 0.0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key int, features array<double>")
    mapped = kernel_map(rows, kernel, degree, 0.5, 16).orderBy("key").collect()
    columns, lift = kernel_lift(width, kernel, degree, 0.5, 16)
    assert lift(x).shape == (20, columns)
    assert lift(x) == pytest.approx(np.array([r["features"] for r in mapped]), rel=1e-13, abs=1e-13)


def test_refusals():
    with pytest.raises(ValueError, match="choose linear, poly or rbf"):
        kernel_lift(2, "sigmoid")
    with pytest.raises(ValueError, match="terms"):
        kernel_lift(200, "poly", 8)


def test_blocks_keep_the_features_alone(spark, monkeypatch):
    """Rows were kept with the maps of all kernels, some hundred times the table."""
    kept, fitted = [], search.fit_all

    def counted(table, *args, **more):
        kept.append(table.agg(F.sum(F.octet_length("features"))).first()[0])
        return fitted(table, *args, **more)

    monkeypatch.setattr(search, "fit_all", counted)
    x = np.random.default_rng(2).normal(size=(300, 2))
    rows = spark.createDataFrame([(v.tolist(), int(v[0] * v[1] > 0), i % 2) for i, v in enumerate(x)], "features array<double>, y int, fold int")
    grid = [{"kernel": "poly", "degree": "2", "gamma": "1.0"}, {"kernel": "rbf", "gamma": "1.0"}, {"kernel": "linear"}, {"kernel": "sigmoid"}]
    found = search.kernel_search(rows, [(i, "margin", p) for i, p in enumerate(grid)], "y", folds=2).collect()
    assert kept == [300 * 2 * 8]
    score = {(r["candidate"], r["fold"]): r["score"] for r in found}
    assert min(score[0, f] for f in (0, 1)) > 0.9 and min(score[1, f] for f in (0, 1)) > 0.85 and score[2, 0] < 0.75
    assert [r["candidate"] for r in found if r["error"]] == [3]
