"""The histogram tree learner: splits against all cuts, both ways of answering, ensembles, random thresholds."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.models import shared_trees as st
from loomtab.models.trees import decision_tree, extra_trees, random_forest


def block(n=800, seed=0):
    draw = np.random.default_rng(seed)
    x = draw.random((n, 3))
    y = np.sin(5 * x[:, 0]) + x[:, 1] ** 2 + 0.1 * draw.standard_normal(n)
    edges = [np.unique(np.quantile(x[:, i], np.arange(1, st.BINS) / st.BINS, method="inverted_cdf")) for i in range(3)]
    return st.Block(st.binned(x, edges), y, np.arange(n) % 5, np.zeros(n, int), draw.integers(0, 1 << 62, n)), edges, x


@pytest.fixture(scope="module")
def table(spark):
    b, _, x = block()
    rows = [(i, [float(v) for v in x[i]], float(b.y[i]), int(b.y[i] > 0.9), int(b.fold[i]), i % 2) for i in range(len(x))]
    return spark.createDataFrame(rows, "key long, features array<double>, y double, c int, fold int, part int").repartition(3).persist()


def test_a_stump_is_the_best_of_all_cuts():
    b, edges, _ = block()
    (model,) = st.train_here(b, [st.Spec(depth=1)], edges)
    cost = {
        (f, cut): sum(((side - side.mean()) ** 2).sum() for side in (b.y[b.bins[:, f] <= cut], b.y[b.bins[:, f] > cut]))
        for f in range(3) for cut in range(st.BINS - 1) if 0 < (b.bins[:, f] <= cut).sum() < len(b.y)
    }
    (tree,) = model.trees
    assert (tree.feature[0], tree.cut[0]) == min(cost, key=cost.get)
    assert tree.value[1] == pytest.approx(b.y[b.bins[:, tree.feature[0]] <= tree.cut[0]].mean())


def test_one_boosting_round_by_hand():
    """SAMME: the second stump is the best one under the weights the first leaves, and its vote is the log odds."""
    b, edges, _ = block()
    b.y = (b.y > 0.9).astype(float)
    (model,) = st.train_here(b, [st.Spec("samme", 1, 2, classes=2)], edges)
    weight = np.ones(len(b.y))
    for tree, vote in zip(model.trees, model.weights):
        cost = {}
        for f in range(3):
            for cut in range(st.BINS - 1):
                left = b.bins[:, f] <= cut
                shares = [np.array([weight[side & (b.y == c)].sum() for c in (0, 1)]) for side in (left, ~left)]
                if all(s.sum() for s in shares):
                    cost[f, cut] = -sum((s**2).sum() / s.sum() for s in shares)
        assert (tree.feature[0], tree.cut[0]) == min(cost, key=cost.get)
        miss = tree.answer(b.bins) != b.y
        error = weight[miss].sum() / weight.sum()
        assert vote == pytest.approx(np.log((1 - error) / error))
        weight = weight * np.exp(vote * miss)


SPECS = [
    st.Spec(depth=4), st.Spec(depth=4, bootstrap=2, features=2), st.Spec(depth=5, splitter="random"), st.Spec("boost", 2, 6, 0.3),
    st.Spec("boost", 3, 5, 0.3, "lad"), st.Spec("boost", 2, 4, 0.3, "huber"), st.Spec("boost", 2, 4, 0.3, "quantile", 0.8),
    st.Spec("r2", 3, 5, 1.0, "square"), st.Spec(depth=3, holdout=1), st.Spec("boost", 2, 3, 0.5, part=1, holdout=2),
]


def test_passes_and_local_training_agree(table, monkeypatch):
    monkeypatch.setattr(st, "FORWARD", 2)
    rows = st.training_rows(table, "features", F.col("y"), F.col("key"), "part", "fold")
    near, edges = st.train(rows, SPECS)
    far, _ = st.train(rows, SPECS, edges, local_rows=0)
    other, _ = st.train(rows.repartition(7), SPECS[:4], edges, local_rows=0)
    for a, b in [*zip(near, far), *zip(near, other)]:
        assert [t.feature for t in a.trees] == [t.feature for t in b.trees] and [t.cut for t in a.trees] == [t.cut for t in b.trees]
        assert np.allclose([v for t in a.trees for v in t.value], [v for t in b.trees for v in t.value], atol=1e-6)
        assert np.allclose(a.weights, b.weights) and a.start == pytest.approx(b.start, abs=1e-6)


def test_held_out_sums_equal_scored_models(table, monkeypatch):
    rows = st.training_rows(table, "features", F.col("y"), F.col("key"), "part", "fold")
    groups = [[st.Spec("boost", 2, 4, 0.3, holdout=0)], [st.Spec(depth=4, bootstrap=i, holdout=1, part=1) for i in range(3)]]
    near = st.held_out_sums(rows, groups)
    monkeypatch.setattr(st, "LOCAL_ROWS", 0)
    far = st.held_out_sums(rows, groups)
    for a, b in zip(near, far):
        assert a == pytest.approx(b) and a["n"] > 0 and a["off_squares"] < a["squares"]


@pytest.mark.parametrize("loss", ["lad", "quantile"])
def test_leaf_values_are_quantiles(loss):
    b, edges, _ = block()
    (model,) = st.train_here(b, [st.Spec("boost", 2, 1, 1.0, loss, 0.7)], edges)
    (tree,) = model.trees
    leaf, share = tree.leaf_of(b.bins), 0.5 if loss == "lad" else 0.7
    gap = b.y - model.start
    for node in np.unique(leaf):
        ordered = np.sort(gap[leaf == node])
        assert tree.value[node] == pytest.approx(ordered[int(np.ceil(share * len(ordered))) - 1], abs=1e-6)


def test_random_thresholds_lie_in_the_node_and_repeat():
    b, edges, _ = block()
    one, two, other = (st.train_here(b, [st.Spec(depth=6, splitter="random", seed=s)], edges)[0].trees[0] for s in (1, 1, 2))
    assert one == two and one != other
    rows = {0: np.arange(len(b.y))}
    for node, feature in enumerate(one.feature):
        if feature >= 0:
            bins = b.bins[rows[node], feature]
            assert bins.min() <= one.cut[node] < bins.max()
            rows[one.left[node]], rows[one.left[node] + 1] = rows[node][bins <= one.cut[node]], rows[node][bins > one.cut[node]]
    cuts = {st.train_here(b, [st.Spec(depth=1, splitter="random", seed=s)], edges)[0].trees[0].cut[0] for s in range(20)}
    assert len(cuts) > 5


def test_bootstrap_weights_are_poisson():
    keys = np.arange(50000)
    draws = st.poisson(keys, 3)
    assert abs(draws.mean() - 1) < 0.03 and abs(draws.var() - 1) < 0.05 and (draws == st.poisson(keys, 3)).all()


def test_estimators_predict_and_reload(table, tmp_path):
    for made in (
        random_forest("classify", 5, 4, "2", labelCol="c", keyCol="key"), decision_tree("classify", 3, labelCol="c"), extra_trees(4, 6, labelCol="y"),
    ):
        model = made.fit(table)
        model.write().overwrite().save(str(tmp_path / "m"))
        first, again = (m.transform(table).select("key", "prediction").orderBy("key").collect() for m in (model, type(model).load(str(tmp_path / "m"))))
        assert first == again and first[0]["prediction"] is not None
    assert set(json.loads(model.getOrDefault("state"))) >= {"trees", "edges", "classes"}


def test_constant_and_missing_labels(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0], 3.0), (2, [1.0, 2.0], 3.0), (3, [4.0, 5.0], None)], "key long, features array<double>, y double")
    assert {r["prediction"] for r in decision_tree("regress").fit(rows).transform(rows).collect()} == {3.0}
    with pytest.raises(ValueError, match="no row"):
        decision_tree("regress").fit(rows.filter("y is null"))


def test_condensed_rows_do_not_grow_with_the_table(spark):
    """Ten copies of the rows, with keys of their own, leave the same cells; counts, class shares and means are those of the rows."""
    b, edges, x = block()
    at = [(k * len(x) + i, [float(v) for v in np.round(x[i][:2], 1)], float(b.y[i]), int(b.y[i] > 0.9)) for i in range(len(x)) for k in range(10)]
    table = spark.createDataFrame(at, "key long, features array<double>, y double, c int")
    for label, classes in (("y", 0), ("c", 2)):
        rows = st.training_rows(table, "features", F.col(label), F.col("key"))
        cells = st.condensed(rows, [st.Spec(classes=classes)], edges[:2])
        assert cells.count() == st.condensed(rows.filter(f"key < {len(x)}"), [st.Spec(classes=classes)], edges[:2]).count() <= 121 * max(classes, 1)
        n, total = cells.selectExpr("sum(n)", "sum(n * y)").first()
        assert n == len(at) and total == pytest.approx(sum(r[2 if label == "y" else 3] for r in at))


def test_boosted_states_by_cell_need_no_written_rows(spark, monkeypatch):
    """Where rows share bins, passes follow the trees by cell, write nothing forward and find the trees of local training."""
    b, _, x = block()
    at = [(i, [float(v) for v in np.round(x[i][:2], 1)], float(b.y[i])) for i in range(len(x))] * 4
    rows = st.training_rows(spark.createDataFrame(at, "key long, features array<double>, y double").repartition(2), "features", F.col("y"), F.col("key"))
    specs = [st.Spec("boost", 2, 6, 0.3, "lad"), st.Spec("boost", 2, 5, 0.3, "huber")]
    near, edges = st.train(rows, specs)
    monkeypatch.setattr(st, "FORWARD", 2)
    monkeypatch.setattr(st, "FEW_CELLS", 0.5)
    monkeypatch.setattr(st, "_forward", None)
    far, _ = st.train(rows, specs, edges, local_rows=0)
    for a, c in zip(near, far):
        assert [t.feature for t in a.trees] == [t.feature for t in c.trees] and [t.cut for t in a.trees] == [t.cut for t in c.trees]
        assert np.allclose([v for t in a.trees for v in t.value], [v for t in c.trees for v in t.value], atol=1e-6)
