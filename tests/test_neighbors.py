from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomtab.models.neighbors import Neighbors
from loomtab.operators import pairs
from loomtab.operators.neighbors import Side, knn_join, radius_join, radius_mean, vote, votes_at
from loomtab.operators.pairs import Points, Rule, Search, pair_distances
from loomtab.plans.search import knn_grid

BLOCKS = {"strategy": "blocks", "pivots": 6, "block_rows": 17, "chunk_rows": 23}
ROUTES = [{"strategy": "broadcast"}, BLOCKS]


def points(seed, n, d=3, copies=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    x[:copies] = x[0]  # a crowd of identical rows
    return x


def frame(spark, x, folds=4):
    rows = [(i, v.tolist(), float(i % 3), i % folds) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id bigint, v array<double>, y double, fold int").repartition(5)


def gaps(a, b, metric, p):
    d = np.abs(a[:, None, :] - b[None, :, :])
    return {
        "euclidean": lambda: np.sqrt((d**2).sum(2)), "manhattan": lambda: d.sum(2), "chebyshev": lambda: d.max(2),
        "minkowski": lambda: (d**p).sum(2) ** (1 / p),
    }[metric]()


def brute(x, k, metric="euclidean", p=2.0, fold=None):
    far = np.round(gaps(x, x, metric, p), 9)
    ids = np.arange(len(x))
    out = {}
    for q in ids:
        allowed = ids != q if fold is None else fold != fold[q]
        order = sorted(ids[allowed], key=lambda t: (far[q, t], t))
        out[int(q)] = [int(t) for t in order[:k]]
    return out


def answers(joined):
    return {r["id"]: [n["id"] for n in r["neighbors"]] for r in joined.collect()}


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize("metric", ["euclidean", "manhattan", "chebyshev", "minkowski"])
def test_leave_one_out_neighbours(spark, route, metric):
    x = points(1, 150, copies=50)  # a third of the rows share one place
    side = Side(frame(spark, x), "id", "v", "y", "id")
    assert answers(knn_join(side, side, 4, metric, 3.0, **route)) == brute(x, 4, metric, 3.0)


@pytest.mark.parametrize("route", ROUTES)
def test_neighbours_from_other_folds(spark, route):
    x = points(2, 130)
    side = Side(frame(spark, x), "id", "v", "y", "fold")
    assert answers(knn_join(side, side, 5, **route)) == brute(x, 5, fold=np.arange(130) % 4)


@pytest.mark.parametrize("route", ROUTES)
def test_fewer_rows_than_neighbours(spark, route):
    x = points(3, 6)
    side = Side(frame(spark, x), "id", "v", "y", "id")
    assert all(len(v) == 5 for v in answers(knn_join(side, side, 9, **route)).values())


@pytest.mark.parametrize("route", ROUTES)
@pytest.mark.parametrize("weights", ["uniform", "distance"])
def test_radius_sums(spark, route, weights):
    x = points(4, 120, copies=40)
    x[-1] = 50.0  # nobody is near
    side = Side(frame(spark, x), "id", "v", "y", "id")
    got = {r["id"]: r for r in radius_join(side, side, 0.9, **route).withColumn("m", radius_mean(weights)).collect()}
    far, y = np.round(gaps(x, x, "euclidean", 2), 9), np.arange(120) % 3
    for q in range(120):
        near = (far[q] <= 0.9) & (np.arange(120) != q)
        assert got[q]["n"] == near.sum()
        if not near.any():
            assert got[q]["m"] is None
            continue
        touching = near & (far[q] == 0)
        if weights == "uniform":
            want = y[near].mean()
        else:
            want = y[touching].mean() if touching.any() else np.average(y[near], weights=1 / far[q][near])
        assert got[q]["m"] == pytest.approx(want)


def test_votes_and_ties(spark):
    x = points(5, 90, copies=20)
    side = Side(frame(spark, x), "id", "v", "y", "id")
    found = knn_join(side, side, 9).persist()
    classes = [0.0, 1.0, 2.0]
    for weights in ("uniform", "distance"):
        many = {r[0]: r[1] for r in found.select("id", votes_at(F.col("neighbors"), [1, 4, 9], classes, weights)).collect()}
        for i, k in enumerate((1, 4, 9)):
            single = {r[0]: r[1] for r in found.select("id", vote(F.col("neighbors"), k, classes, weights)).collect()}
            assert {q: v[i] for q, v in many.items()} == single
    found.unpersist()


def test_tie_goes_to_the_smaller_class(spark):
    train = spark.createDataFrame([(1, [0.0], 2.0), (2, [2.0], 1.0)], "id bigint, v array<double>, y double")
    query = spark.createDataFrame([(9, [1.0])], "id bigint, v array<double>")
    found = knn_join(Side(query, "id", "v"), Side(train, "id", "v", "y"), 2)
    assert found.select(vote(F.col("neighbors"), 2, [1.0, 2.0])).first()[0] == 1.0


@pytest.mark.parametrize("task,want", [("classify", "b"), ("regress", 5.0)])
def test_zero_distance_decides_alone(spark, task, want):
    label = "name" if task == "classify" else "value"
    train = spark.createDataFrame(
        [(1, [0.0], "b", 5.0), (2, [0.1], "a", 1.0), (3, [0.1], "a", 1.0)], "id bigint, features array<double>, name string, value double"
    )
    query = spark.createDataFrame([(9, [0.0])], "id bigint, features array<double>")
    model = Neighbors(labelCol=label, k=3, weights="distance", task=task).fit(train)
    assert model.transform(query).first()["prediction"] == want


def test_grid_equals_single_candidates(spark):
    df = frame(spark, points(6, 100)).withColumn("y", F.col("y").cast("int"))
    grid = {(r["metric"], r["k"]): r["accuracy"] for r in knn_grid(df, "id", "y", [1, 3, 8], "v", exclude="fold").collect()}
    assert len(grid) == 6
    near = brute(points(6, 100), 8, fold=np.arange(100) % 4)
    for k in (1, 3, 8):
        hits = [int(np.argmax(np.bincount([t % 3 for t in near[q][:k]], minlength=3)) == q % 3) for q in range(100)]
        assert grid[("euclidean", k)] == pytest.approx(np.mean(hits))


def test_bad_inputs_are_named(spark):
    side = Side(frame(spark, points(7, 5)), "id", "v")
    with pytest.raises(ValueError, match="euclidian"):
        knn_join(side, side, 2, "euclidian")
    with pytest.raises(ValueError, match="minkowski"):
        knn_join(side, side, 2, "minkowski", 0.5)
    with pytest.raises(ValueError, match="strategy"):
        knn_join(side, side, 2, strategy="index")
    with pytest.raises(ValueError):
        knn_join(side, side, 0)
    with pytest.raises(ValueError, match="task"):
        Neighbors(task="rank").fit(side.df)


def test_many_exclusion_groups_give_the_same_rows_on_both_routes(spark):
    rng = np.random.default_rng(5)
    points = np.round(rng.normal(size=(400, 3)), 1)
    group = np.where(np.arange(400) % 3 == 0, 0, np.arange(400) % 100)  # a hot group and a hundred others
    rows = [(i, p.tolist(), float(i % 3), int(g)) for i, (p, g) in enumerate(zip(points, group))]
    side = Side(spark.createDataFrame(rows, "id long, vec array<double>, value double, part long"), "id", "vec", "value", "part")
    found = [
        {r["id"]: [(n["id"], round(n["distance"], 9)) for n in r["neighbors"]] for r in knn_join(side, side, 5, strategy=s, pivots=16, block_rows=40).collect()}
        for s in ("broadcast", "blocks")
    ]
    assert found[0] == found[1] and all(group[i] != group[j] for i, near in found[0].items() for j, _ in near)


def test_votes_without_neighbours_are_null(spark):
    empty = spark.createDataFrame([(1, [])], "id long, neighbors array<struct<distance:double,id:bigint,value:double>>")
    got = empty.select(votes_at(F.col("neighbors"), [1, 3], [0.0, 1.0]), vote(F.col("neighbors"), 3, [0.0, 1.0])).first()
    assert got[0] == [None, None] and got[1] is None


@pytest.mark.parametrize("strategy", ["cells", "all"])
@pytest.mark.parametrize("metric,k,exclude", [("euclidean", 4, "id"), ("euclidean", 40, "fold"), ("manhattan", 7, "fold"), ("chebyshev", 5, "id"), ("minkowski", 5, "id")])
def test_routes_agree_on_wide_and_shifted_vectors(spark, strategy, metric, k, exclude):
    x = np.random.default_rng(8).normal(size=(700, 24)).astype("float32").astype(float) + 1000.0  # far from the origin; bounds rule out little
    x[:60] = x[0]
    side = Side(frame(spark, x), "id", "v", "y", exclude)
    got = answers(knn_join(side, side, k, metric, 3.0, strategy=strategy, pivots=8, block_rows=50, chunk_rows=60))
    assert got == brute(x, k, metric, 3.0, fold=None if exclude == "id" else np.arange(700) % 4)


def test_screened_search_equals_plain_loop_in_many_steps():
    rng = np.random.default_rng(9)
    for metric, scale, p in [("euclidean", 1e6, 2.0), ("manhattan", 1e-9, 2.0), ("chebyshev", 1.0, 2.0), ("minkowski", 1e15, 3.0), ("minkowski", 1.0, 2.5)]:
        x = np.round(rng.normal(size=(900, 5)), 1) * scale
        x[3, 1] = np.nan  # a row with a hole is near nothing
        search = Search(x[:300], np.arange(300), Rule(metric, p, k=6, excluding=True))
        order = rng.permutation(900)
        for part in np.array_split(order, 7):
            search.see(Points(part, x[part], part.astype(float), part))
        far = np.round(pair_distances(x[:300], x, metric, p), 9)
        far[np.arange(300), np.arange(300)] = np.nan
        for q in range(300):
            want = sorted((d, t) for t, d in enumerate(far[q]) if np.isfinite(d))[:6]
            held = np.isfinite(search.far[q])
            assert list(zip(np.round(search.far[q][held], 9), search.ids[q][held])) == want


def test_unruly_bounds_send_no_query_to_many_blocks(spark):
    x = np.random.default_rng(10).normal(size=(1200, 32))
    side = Side(frame(spark, x), "id", "v", "y", "id")
    plan = knn_join(side, side, 30, strategy="blocks", pivots=16, block_rows=20)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" not in plan and "Window" not in plan  # every query would have gone to every one of 60 blocks
    low = Side(frame(spark, np.random.default_rng(11).normal(size=(20000, 2))), "id", "v", "y", "id")
    plan = knn_join(low, low, 3, strategy="blocks", pivots=256, block_rows=2000)._jdf.queryExecution().toString()
    assert "FlatMapCoGroups" in plan


def test_radius_sums_of_wide_vectors_on_every_route(spark):
    x = np.random.default_rng(12).normal(size=(500, 24))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:40] = x[0]
    side = Side(frame(spark, x), "id", "v", "y", "id")
    far, y = np.round(gaps(x, x, "euclidean", 2), 9), np.arange(500) % 3
    near = (far <= 1.3) & ~np.eye(500, dtype=bool)
    for strategy in ("broadcast", "cells", "all"):
        got = {r["id"]: r for r in radius_join(side, side, 1.3, strategy=strategy, pivots=6, block_rows=90).collect()}
        for q in range(500):
            apart = near[q] & (far[q] > 0)
            assert (got[q]["n"], got[q]["n_zero"]) == (near[q].sum(), (near[q] & ~apart).sum())
            assert got[q]["total"] == pytest.approx(y[near[q]].sum())
            assert got[q]["weighted_total"] == pytest.approx((y[apart] / far[q][apart]).sum(), rel=1e-9)


@pytest.mark.parametrize(("metric", "p"), [("chebyshev", 2.0), ("minkowski", 3.0), ("minkowski", 2.5), ("minkowski", 1.5), ("manhattan", 2.0)])
def test_few_tiles_are_screened_by_every_coordinate(monkeypatch, metric, p):
    """Once bounds are known, pairs are ruled out early, or by the euclidean norm; the answers are those of the plain loop."""
    draw = np.random.default_rng(5)
    spots = draw.normal(size=(12, 24)) * 4
    points = spots[draw.integers(0, 12, 9000)] + 0.3 * draw.normal(size=(9000, 24))
    queries, ids = points[:300], np.arange(9000)
    calls = []
    whole = pairs._Strip.screen
    monkeypatch.setattr(pairs._Strip, "screen", lambda self: calls.append(self.rule.metric) or whole(self))
    search = pairs.Search(queries, ids[:300], pairs.Rule(metric, p, k=4, excluding=True))
    search.see(pairs.Points(ids, points, ids.astype(float), ids))
    far = pairs.pair_distances(queries, points, metric, p)
    far[np.arange(300), np.arange(300)] = np.inf
    want = np.lexsort((np.broadcast_to(ids, far.shape), np.round(far, 9)), axis=1)[:, :4]
    assert (search.ids == want).all() and np.array_equal(search.far, np.take_along_axis(far, want, 1))
    assert calls.count(metric) == 2  # the first tile of both strips
