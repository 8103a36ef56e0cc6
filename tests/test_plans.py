from __future__ import annotations


import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import functions as F

from loomtab.models.linear import LinearScore
from loomtab.models.simple import GaussianBayes, LinearDiscriminant, MajorityClass, NearestCentroid
from loomtab.operators import metrics, ranking
from loomtab.operators.prepare import as_vector
from loomtab.operators.splits import split, stratified_kfold
from loomtab.plans import grids
from loomtab.plans.evaluators import TableEvaluator
from loomtab.plans.forecast import horizon_table, linear_forecasts, scaled_features, searched_forecasts
from loomtab.plans.leaderboard import Entry, classifier_entries, leaderboard, regressor_entries, winner
from loomtab.plans.search import cross_validate, fold_predictions, fold_scores, kernel_search, ranked, refit, results_table, shared_search
from loomtab.plans.surface import mesh, mesh_over, score_mesh
from loomtab.session import scratch_path, shared_folder
from loomtab.sources import generators, sinks, tables
from loomtab.sources.registry import load_models, registered, save_model, score_all


@pytest.fixture(scope="module")
def moons(spark):
    keys = spark.range(600).withColumnRenamed("id", "key")
    rows = generators.with_features(generators.moons(keys, "key"))
    return stratified_kfold(split(rows, "key"), "key", "y").persist()


def test_published_grid_sizes():
    def size(found):
        return sum(grids.grid_size(g) for g in found)

    assert size(grids.logistic_grid()) == 12
    assert size(grids.neighbor_grid()) == 46
    assert size(grids.margin_grid()) == 75
    assert size(grids.network_grid()) == 126
    assert size(grids.perceptron_grid()) == 2016
    assert size(grids.boosting_grid()) == 4
    assert {k: size(v) for k, v in grids.regression_grids().items()} == {"boosting": 18, "forest": 1, "tree": 1, "neighbors": 3, "svr": 8}


def test_grid_table_is_the_product_in_order(spark):
    found = grids.param_list(grids.grid_table(spark, "m", [{"a": [1, 2], "b": ["x", None, "z"]}, {"c": [5]}]))
    assert [f[0] for f in found] == list(range(7))
    assert [f[2] for f in found][:4] == [{"a": "1", "b": "x"}, {"a": "1", "b": None}, {"a": "1", "b": "z"}, {"a": "2", "b": "x"}]
    assert found[6] == (6, "m", {"c": "5"})


def test_random_candidates_are_reproducible_and_in_range(spark):
    priors = {"C": lambda u: generators.exponential(u, 300), "k": lambda u: generators.whole(u, 2, 100), "p": lambda u: generators.one_of(u, ["l1", "l2"])}
    one = grids.param_list(grids.random_table(spark, "m", priors, 200, seed=5))
    assert one == grids.param_list(grids.random_table(spark, "m", priors, 200, seed=5))
    assert len({f[2]["C"] for f in one}) == 200
    assert all(2 <= int(f[2]["k"]) < 100 and f[2]["p"] in ("l1", "l2") for f in one)
    assert np.mean([float(f[2]["C"]) for f in one]) == pytest.approx(300, rel=0.25)


def test_beta_draws(spark):
    draws = spark.range(20000).select(generators.beta_quantile(generators.uniform("id"), 1.1, 50, 0.0001, 30).alias("v")).toPandas().v
    assert draws.mean() == pytest.approx(0.0001 + 30 * 1.1 / 51.1, rel=0.03)
    assert draws.min() > 0.0001 and draws.max() < 30


def test_shared_search_equals_separate_fits(spark, moons):
    train = moons.filter("split = 'train'")
    candidates = [(0, "logistic", {"C": "1.0"}), (1, "logistic", {"C": "0.001"})]
    scores = shared_search(train, candidates, "y", folds=5, objectives=["accuracy", "log_loss", "recall", "roc_auc"], balanced=False)
    assert scores.count() == 2 * 5 * 4
    n = train.filter("fold <> 2").count()
    model = LogisticRegression(featuresCol="vector", labelCol="y", regParam=1.0 / n, standardization=False, tol=1e-10).fit(as_vector(train.filter("fold <> 2")))
    out = model.transform(as_vector(train.filter("fold = 2"))).withColumn("score", F.get(_array("probability"), 1))
    want = {
        "accuracy": metrics.accuracy(out, "y", "prediction").first()[0],
        "roc_auc": metrics.roc_auc(out, "y", "score").first()[0],
        "log_loss": metrics.log_loss(out, F.when(F.col("y") == 1, F.col("score")).otherwise(1 - F.col("score"))).first()[0],
    }
    got = {r["objective"]: r["score"] for r in scores.filter("candidate = 0 and fold = 2").collect()}
    for name, value in want.items():
        assert got[name] == pytest.approx(value, abs=1e-4)
    best = {r["objective"]: r["candidate"] for r in ranked(scores).collect()}
    assert best["log_loss"] == 0  # the smaller loss wins


def _array(name):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(name)


def test_kernel_search_groups_maps_and_reports_failures(spark, moons):
    grid = [{"kernel": ["linear", "poly"], "C": [1.0, 10.0], "degree": [2]}, {"kernel": ["sigmoid"], "C": [1.0]}]
    candidates = grids.param_list(grids.grid_table(spark, "margin", grid))
    rows = kernel_search(moons, candidates, "y", folds=5)
    assert rows.filter("error is null").groupBy("candidate").count().count() == 4
    bad = rows.filter("error is not null").collect()
    assert [r["candidate"] for r in bad] == [4] and "sigmoid" in bad[0]["error"]
    plain = shared_search(moons, [(9, "margin", {"C": "10.0"})], "y").agg(F.avg("score")).first()[0]
    assert rows.filter("candidate = 1").agg(F.avg("score")).first()[0] == pytest.approx(plain)


def test_results_table_counts_unknown_labels_as_misses(spark, moons):
    train, test = moons.filter("split = 'train'"), moons.filter("split = 'test'")
    strange = test.withColumn("y", F.lit(7))
    candidates = [(0, "logistic", {"C": "1.0", "penalty": "l2"})]
    scores = shared_search(train, candidates, "y")
    table = results_table(train, test.unionByName(strange), candidates, scores, "y", "GridSearch")
    single = results_table(train, test, candidates, scores, "y", "GridSearch")
    assert table.first()["Accuracy"] == pytest.approx(single.first()["Accuracy"] / 2)
    assert sinks.arrange_results(table).columns == sinks.RESULT_COLUMNS


def test_refit_uses_all_rows(moons):
    model, classes = refit(moons, (0, "network", {"n_hidden": "3", "alpha": "0.001"}), "y", max_iter=5)
    assert classes == [0, 1] and model.fold is None and model.parts[0].theta is not None


def test_cross_validator_with_fold_column(moons):
    rows = as_vector(moons)
    estimator = LogisticRegression(featuresCol="vector", labelCol="y")
    maps = ParamGridBuilder().addGrid(estimator.regParam, [0.001, 10.0]).build()
    model = cross_validate(estimator, maps, TableEvaluator(metric="accuracy"), rows, folds=5)
    assert len(model.avgMetrics) == 2 and model.avgMetrics[0] > model.avgMetrics[1] - 1e-9


def test_fold_predictions_cover_every_row_once(moons):
    out = fold_predictions(GaussianBayes(), moons)
    assert out.count() == 600 and out.select("key").distinct().count() == 600
    assert fold_scores(out, "y").count() == 5


def test_top_candidates_and_ties(spark):
    rows = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.9), (4, 0.1), (5, None)], "candidate int, score double")
    top = ranking.top_candidates(rows.na.drop(), 3, "score").orderBy("rank").collect()
    assert [r["candidate"] for r in top] == [2, 3, 1]
    assert ranking.best_model(rows).first()["candidate"] == 2


def test_leaderboard_records_failures(spark, moons):
    train, test = moons.filter("split = 'train'"), moons.filter("split = 'test'")
    board = leaderboard(spark, [Entry("majority", MajorityClass()), Entry("broken", NearestCentroid(metric="nope")), Entry("bayes", GaussianBayes())], train, test, "y")
    rows = {r["name"]: r for r in board.collect()}
    assert rows["broken"]["score"] is None and "nope" in rows["broken"]["error"]
    assert winner(board).first()["name"] == "bayes"


def test_registry_round_trip(spark, moons, tmp_path):
    root = str(tmp_path)
    for name, estimator in (("A", GaussianBayes()), ("B", LinearDiscriminant())):
        save_model(spark, estimator.fit(moons), root, name, "accuracy", "GridSearch", "multi_class")
    save_model(spark, MajorityClass().fit(moons), root, "C", "f1", "RandomSearch", "one_class")
    assert registered(spark, root).count() == 3
    models = load_models(spark, root, "multi_class-*")
    assert sorted(models) == ["multi_class-A-accuracy-GridSearch", "multi_class-B-accuracy-GridSearch"]
    out = score_all(models, moons, ["key"])
    assert out.count() == 1200 and {r[0] for r in out.select("family").distinct().collect()} == {"multi_class"}


def test_results_csv(spark, tmp_path):
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 0.5)], "k int, `Model Name` string, score double")
    sinks.write_results(rows, str(tmp_path / "out"), "k", ["k", "Model Name", "score"])
    back = tables.read_table(spark, str(tmp_path / "out"), "`index` bigint, k int, `Model Name` string, score double")
    assert [tuple(r) for r in back.orderBy("index").collect()] == [(0, 1, "a", 0.5), (1, 2, "b", None)]


def test_mesh_matches_numpy(spark):
    got = mesh(spark, -3.0, 6.0, -3.0, 6.0, 0.2).toPandas()
    ticks = np.arange(-3.0, 6.0, 0.2)
    assert len(got) == len(ticks) ** 2
    assert sorted(set(got.x.round(9))) == pytest.approx(ticks)


def test_mesh_scoring(moons):
    cells = mesh_over(moons, "x1", "x2", 0.5, 0.5)
    assert score_mesh(GaussianBayes().fit(moons), cells).filter("prediction is null").isEmpty()


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(9)
    value = [0.0]
    for e in rng.normal(size=499):
        value.append(0.9 * value[-1] + e)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(value)], "t int, v double"), np.array(value)


def test_forecast_equals_least_squares_on_lags(series):
    frame, value = series
    columns = [f"lag_{i}" for i in range(1, 4)]
    ready = scaled_features(horizon_table(frame, "t", "v", {"short": 1, "long": 20}, lags=3), columns).persist()
    assert ready.filter("horizon = 'short' and target is not null").count() == 500 - 3 - 1
    out = linear_forecasts(ready, "t", strength=0.0)
    scores = {r["horizon"]: r for r in out["metrics"].collect()}
    assert scores["short"]["r2"] > 0.5 > scores["long"]["r2"]
    rows = split(ready.filter("horizon = 'short' and target is not null"), "t").toPandas()
    train = rows[rows.split == "train"]
    design = np.column_stack([np.array(train.features.tolist()), np.ones(len(train))])
    weights = np.linalg.lstsq(design, train.target, rcond=None)[0]
    last = ready.filter("horizon = 'short'").orderBy(F.desc("t")).first()
    want = float(np.array(last["features"]) @ weights[:-1] + weights[-1])
    got = {r["horizon"]: r["last"] for r in out["forecast"].collect()}
    assert got["short"] == pytest.approx(want, abs=1e-5)
    folds = {r["horizon"]: r for r in out["folds"].collect()}
    assert folds["short"]["sem"] > 0
    ready.unpersist()


def test_searched_forecasts_pick_the_better_regressor(series):
    frame, _ = series
    columns = ["lag_1", "lag_2"]
    ready = scaled_features(horizon_table(frame, "t", "v", {"short": 1, "long": 9}, lags=2), columns).persist()
    entries = [Entry("line", LinearScore(labelCol="target", loss="squared", C=1e6)), Entry("stump", LinearScore(labelCol="target", loss="squared", C=1e-6))]
    out = searched_forecasts(ready, "t", entries)
    assert out["search"].count() == 4
    assert {r["candidate"] for r in out["metrics"].collect()} == {"line"}
    plain = {r["horizon"]: r["last"] for r in linear_forecasts(ready, "t", strength=1e-6)["forecast"].collect()}
    found = {r["horizon"]: r["last"] for r in out["forecast"].collect()}
    assert found == pytest.approx(plain, abs=1e-3)
    ready.unpersist()


def test_comparison_lists_have_every_setting():
    names = [e.name for e in classifier_entries("key")]
    assert len(names) == 9 and len(set(names)) == 9
    names = [e.name for e in regressor_entries("key", "y")]
    assert len(names) == len(set(names)) == 24


def test_scratch_follows_the_session_setting(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder.rstrip("/")
    assert scratch_path(spark, "x").startswith(folder) and scratch_path(spark, "x") != scratch_path(spark, "x")


def test_run_log_rows(spark):
    rows = spark.createDataFrame([("a", 0.5, 3)], "class string, recall double, n long")
    log = sinks.run_log(rows, "m", "test").orderBy("measure").collect()
    assert [(r["item"], r["measure"], r["value"]) for r in log] == [("a", "n", 3.0), ("a", "recall", 0.5)]


def test_family_of_files_is_one_scan(spark, tmp_path):
    for name, text in (("Gas Forecast 1Q.csv", "Day,V\n1,2\n"), ("Gas Forecast 1Y.csv", "Day,V\n3,4\n5,NA\n")):
        (tmp_path / name).write_text(text)
    paths = {h: str(tmp_path / f"Gas Forecast {h}.csv") for h in ("1Q", "1Y")}
    df = tables.read_many(spark, paths, "Day int, V double")
    assert sorted(tuple(r) for r in df.select("horizon", "day").collect()) == [("1Q", 1), ("1Y", 3), ("1Y", 5)]
    assert df.filter("v is null").count() == 1


def test_offsets_table(spark):
    row = tables.offsets_table(spark, {"1Q": (10, 12, 3)}).first()
    assert (row["horizon"], row["n_train"], row["n_last"], row["window"]) == ("1Q", 10, 12, 3)


def test_arranged_results_keep_columns_of_no_fixed_place(spark):
    table = spark.createDataFrame([("m", "balanced", 0.5)], "model string, weights string, Accuracy double")
    arranged = sinks.arrange_results(table)
    assert arranged.columns == [*sinks.RESULT_COLUMNS, "weights"] and arranged.first()["weights"] == "balanced"
