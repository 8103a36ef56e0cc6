"""Queries over trained models: searches, networks, margins, trees, ensembles, leaderboards, forecasts.

The data have known structure (generators over table keys), because the plain tables carry
no signal. Iterative trainers have no SQL form; unit tests check their properties.
"""

from __future__ import annotations

import json
from dataclasses import replace

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.tuning import ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.catalog.closed_form import mixture_rows, moons_rows
from loomtab.catalog.common import daily_revenue, hsql, query
from loomtab.models.linear import (
    LinearScore, Perceptron, kernel_map, linear_svc, logistic_regression, polynomial_features, reduced_pipeline, weighted,
)
from loomtab.models.mlp import MlpClassifier, MlpRegressor, small_network, softmax_network
from loomtab.models.neighbors import Neighbors
from loomtab.models.shared_pass import packed
from loomtab.models.shared_trees import Spec, squared_error, train, training_rows
from loomtab.models.simple import GaussianBayes, LinearDiscriminant, MajorityClass, NearestCentroid
from loomtab.models.trees import (
    adaboost_classifier, adaboost_rates, adaboost_regressor, bagging_regressor, boosted_quantiles, decision_tree, extra_trees, first_rounds,
    gradient_boosting, random_forest,
)
from loomtab.operators import metrics
from loomtab.operators.columns import stack_frames
from loomtab.operators.prepare import as_vector
from loomtab.operators.splits import kfold, split, stratified_kfold
from loomtab.plans.evaluators import TableEvaluator
from loomtab.plans.families import Member, family_results, member_predictions, member_scores
from loomtab.plans.forecast import horizon_table, linear_forecasts, scaled_features, searched_forecasts
from loomtab.plans.grids import boosting_grid, grid_table, logistic_grid, margin_grid, network_grid, param_list, random_table
from loomtab.plans.leaderboard import Entry, classifier_entries, forecast_entries, leaderboard, regressor_entries
from loomtab.plans.pipelines import by_step, components_of, fit_steps, fold_moments, merged, pipeline_search
from loomtab.plans.search import cross_validate, fold_predictions, fold_scores, kernel_search, ranked, results_table, shared_search
from loomtab.session import load, scratch_path
from loomtab.sources import generators
from loomtab.sources.registry import load_models, save_model, score_all
from loomtab.sources.sinks import arrange_results


def _moons(spark: SparkSession, folder: str) -> DataFrame:
    """Noisy moons with a split and stratified folds."""
    rows = generators.with_features(moons_rows(spark, folder))
    return stratified_kfold(split(rows, "key"), "key", "y").select("key", "features", "y", "split", "fold")


def _three(spark: SparkSession, folder: str) -> DataFrame:
    rows = generators.with_features(mixture_rows(spark, folder))
    return stratified_kfold(split(rows, "key"), "key", "y").select("key", "features", "y", "split", "fold")


def _curve(spark: SparkSession, folder: str) -> DataFrame:
    """Regression on the moons: the second coordinate from the first and the class."""
    rows = moons_rows(spark, folder)
    return split(generators.with_features(rows, ("x1", "y")), "key").select("key", "features", F.col("x2").alias("target"), "split")


def _items(spark: SparkSession, folder: str) -> DataFrame:
    """All line items: five numbers as features; the class says whether the discounted price is over 25,000; split and folds by key."""
    price, share = F.col("l_extendedprice"), F.col("l_discount")
    features = F.array(F.col("l_quantity"), price / 1000.0, share * 100.0, F.col("l_tax") * 100.0, F.col("l_linenumber").cast("double"))
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = load(spark, folder, "lineitem").select(key.alias("key"), features.alias("features"), (price * (1.0 - share) > 25000.0).cast("int").alias("y"))
    return kfold(split(rows, "key"), "key", 5)


def _train(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("split") == "train")


def _test(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("split") == "test")


def _scored(model, rows: DataFrame, label: str = "y") -> DataFrame:
    return model.transform(_test(rows)).select("key", label, "prediction")


def _summary(scores: DataFrame) -> DataFrame:
    return ranked(scores, 3).select("objective", "candidate", "mean", "std", "rank")


@query()
def logistic_search(spark: SparkSession, folder: str) -> DataFrame:
    """Twelve logistic candidates by five folds, trained in shared passes, scored for four objectives."""
    candidates = param_list(grid_table(spark, "logistic", logistic_grid()))
    scores = shared_search(_train(_moons(spark, folder)), candidates, "y", objectives=["accuracy", "log_loss", "recall", "roc_auc"])
    return _summary(scores)


@query()
def logistic_random_search(spark: SparkSession, folder: str) -> DataFrame:
    """Random candidates drawn from the priors instead of a grid."""
    priors = {
        "C": lambda u: generators.power_beta(u, 0.85, 1, 1000),
        "penalty": lambda u: generators.one_of(u, ["l1", "l2"]),
    }
    candidates = param_list(random_table(spark, "logistic", priors, 50))
    return _summary(shared_search(_train(_three(spark, folder)), candidates, "y", objectives=["accuracy"]))


@query()
def margin_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 75 published margins: linear, polynomial and rbf over C, degree and gamma; a kernel without a feature map is reported."""
    candidates = param_list(grid_table(spark, "margin", margin_grid()))
    scores = kernel_search(_train(_moons(spark, folder)), candidates, "y", objectives=["accuracy", "f1"])
    failed = scores.filter("error IS NOT NULL").select("candidate", "error")
    return ranked(scores, 5).select("objective", "candidate", "mean", "std", "rank").unionByName(failed, allowMissingColumns=True)


@query()
def network_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 42 distinct quasi-Newton candidates of the network grid, five folds each, trained together."""
    grid = [{name: values for name, values in g.items() if name in ("alpha", "n_hidden")} for g in network_grid()]
    candidates = param_list(grid_table(spark, "network", grid))
    scores = shared_search(_train(_moons(spark, folder)), candidates, "y", objectives=["accuracy", "log_loss"], max_iter=200)
    return _summary(scores)


@query()
def search_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results table: best candidate per objective, refitted and scored on the hold-out rows."""
    rows = _moons(spark, folder).persist()
    candidates = param_list(grid_table(spark, "logistic", [{"C": [1.0, 10.0], "penalty": ["l1", "l2"]}]))
    scores = shared_search(_train(rows), candidates, "y", objectives=["accuracy", "log_loss"])
    table = results_table(_train(rows), _test(rows), candidates, scores, "y", "GridSearch")
    rows.unpersist()
    return arrange_results(table)


@query()
def logistic_cv(spark: SparkSession, folder: str) -> DataFrame:
    """MLlib cross-validation over the stratified folds with our evaluator, best model on the hold-out rows."""
    rows = as_vector(_moons(spark, folder)).persist()
    estimator = LogisticRegression(featuresCol="vector", labelCol="y", probabilityCol="p", rawPredictionCol="raw")
    maps = ParamGridBuilder().addGrid(estimator.regParam, [0.001, 0.01, 0.1]).build()
    model = cross_validate(estimator, maps, TableEvaluator(metric="f1"), _train(rows), parallelism=4)
    return model.bestModel.transform(_test(rows)).select("key", "y", "prediction")


@query()
def logistic_one_vs_rest(spark: SparkSession, folder: str) -> DataFrame:
    """MLlib logistic regression, one class against the rest, balanced class weights."""
    rows = weighted(as_vector(_three(spark, folder)), "y")
    train = _train(rows)
    estimator = logistic_regression(train.count(), 10.0, "l2", "ovr", featuresCol="vector", labelCol="y", weightCol="weight")
    return _scored(estimator.fit(train), rows)


@query()
def fold_report(spark: SparkSession, folder: str) -> DataFrame:
    """Every row predicted without its own fold; one row of metrics per fold."""
    rows = _moons(spark, folder).persist()
    predicted = fold_predictions(GaussianBayes(), rows)
    scores = fold_scores(predicted, "y").select("fold", "accuracy", "precision", "recall", "f1")
    return scores


@query()
def mlp_fit(spark: SparkSession, folder: str) -> DataFrame:
    """One-hidden-layer perceptron, full-batch quasi-Newton."""
    rows = _moons(spark, folder)
    model = MlpClassifier(nHidden=8, maxIter=40).fit(_train(rows))
    return model.transform(_test(rows)).select("key", "y", "prediction", F.col("probability")[1].alias("p1"))


@query()
def mlp_warm_start(spark: SparkSession, folder: str) -> DataFrame:
    """Training continued from an earlier model's weights."""
    rows = _moons(spark, folder).persist()
    first = MlpClassifier(nHidden=6, maxIter=5).fit(_train(rows))
    return _scored(MlpClassifier(warm=first, nHidden=6, maxIter=15).fit(_train(rows)), rows)


@query()
def mlp_sgd(spark: SparkSession, folder: str) -> DataFrame:
    """Mini-batch descent of the softmax network on three classes."""
    rows = _three(spark, folder)
    return _scored(softmax_network(nHidden=20).fit(_train(rows)), rows)


@query()
def network_error_trace(spark: SparkSession, folder: str) -> DataFrame:
    """Five hidden units, twenty epochs: percent error on both sides after each epoch."""
    rows = _three(spark, folder).persist()
    trace: list[tuple[int, list[float]]] = []
    estimator = small_network(batchSize=20, eta0=0.3)
    estimator.watch = lambda epoch, theta, cost: trace.append((epoch, theta.tolist()))
    model = estimator.fit(_train(rows))
    state = model.fitted
    width, hidden, outputs = state["features"], state["hidden"], state["outputs"]
    cut = (width + 1) * hidden
    # The trace is a literal, one entry per epoch, so scoring every epoch needs no join.
    epochs = F.from_json(F.lit(json.dumps([{"epoch": e, "theta": t} for e, t in trace])), "array<struct<epoch:int,theta:array<double>>>")
    scored = rows.select("y", "split", "features", F.explode(epochs).alias("net")).select("*", "net.*")
    theta, x = F.col("theta"), F.col("features")

    def unit(at: int, inputs: int, size: int, j: int, values) -> F.Column:
        total = theta[at + inputs * size + j]
        for i in range(inputs):
            total = total + values[i] * theta[at + i * size + j]
        return total

    layer = scored.withColumn("h", F.array(*[1.0 / (1.0 + F.exp(-unit(0, width, hidden, j, x))) for j in range(hidden)]))
    final = layer.withColumn("z", F.array(*[unit(cut, hidden, outputs, j, F.col("h")) for j in range(outputs)]))
    wrong = final.withColumn("p", F.array_position("z", F.array_max("z")) - 1)
    return metrics.percent_error(wrong, "y", "p", ["epoch", "split"])


@query()
def mlp_regress(spark: SparkSession, folder: str) -> DataFrame:
    rows = _curve(spark, folder)
    return _scored(MlpRegressor(labelCol="target", nHidden=8, maxIter=40).fit(_train(rows)), rows, "target")


@query()
def perceptron(spark: SparkSession, folder: str) -> DataFrame:
    rows = _three(spark, folder)
    return _scored(Perceptron(penalty="l2").fit(_train(rows)), rows)


@query()
def linear_svm(spark: SparkSession, folder: str) -> DataFrame:
    """MLlib linear support-vector classifier."""
    rows = as_vector(_moons(spark, folder))
    train = _train(rows)
    return _scored(linear_svc(train.count(), 1.0, featuresCol="vector", labelCol="y").fit(train), rows)


@query()
def kernel_svm(spark: SparkSession, folder: str) -> DataFrame:
    """Margin on random Fourier features of the rbf kernel, with probabilities fitted to the margin."""
    rows = kernel_map(_moons(spark, folder), "rbf", gamma=2.0, components=64)
    model = LinearScore(loss="squared_hinge", calibrate=True, balanced=True).fit(_train(rows))
    return model.transform(_test(rows)).select("key", "y", "prediction", F.col("probability")[1].alias("p1"))


@query()
def svr(spark: SparkSession, folder: str) -> DataFrame:
    """Support-vector regression on polynomial features."""
    rows = polynomial_features(_curve(spark, folder), 3)
    return _scored(LinearScore(labelCol="target", loss="tube", C=10.0).fit(_train(rows)), rows, "target")


@query()
def tree_classify(spark: SparkSession, folder: str) -> DataFrame:
    rows = as_vector(_moons(spark, folder))
    return _scored(decision_tree("classify", 5, featuresCol="vector", labelCol="y").fit(_train(rows)), rows)


@query()
def tree_random_split(spark: SparkSession, folder: str) -> DataFrame:
    rows = as_vector(_curve(spark, folder))
    return _scored(decision_tree("regress", 5, "random", featuresCol="vector", labelCol="target").fit(_train(rows)), rows, "target")


@query()
def forest(spark: SparkSession, folder: str) -> DataFrame:
    rows = as_vector(_moons(spark, folder))
    return _scored(random_forest("classify", 10, 5, "1", featuresCol="vector", labelCol="y").fit(_train(rows)), rows)


@query()
def forest_regress(spark: SparkSession, folder: str) -> DataFrame:
    rows = as_vector(_curve(spark, folder))
    return _scored(random_forest("regress", 10, 5, featuresCol="vector", labelCol="target").fit(_train(rows)), rows, "target")


@query()
def extra_trees_regress(spark: SparkSession, folder: str) -> DataFrame:
    rows = as_vector(_curve(spark, folder))
    return _scored(extra_trees(10, featuresCol="vector", labelCol="target").fit(_train(rows)), rows, "target")


@query()
def gbt(spark: SparkSession, folder: str) -> DataFrame:
    rows = as_vector(_curve(spark, folder))
    return _scored(gradient_boosting("squared", 100, featuresCol="vector", labelCol="target").fit(_train(rows)), rows, "target")


@query()
def gbt_huber(spark: SparkSession, folder: str) -> DataFrame:
    rows = _curve(spark, folder)
    return _scored(boosted_quantiles(_train(rows), label="target", loss="huber", rounds=100), rows, "target")


@query()
def gbt_quantile(spark: SparkSession, folder: str) -> DataFrame:
    rows = _curve(spark, folder)
    return _scored(boosted_quantiles(_train(rows), label="target", loss="quantile", quantile=0.9, rounds=100), rows, "target")


@query()
def adaboost(spark: SparkSession, folder: str) -> DataFrame:
    rows = _moons(spark, folder)
    return _scored(adaboost_classifier(_train(rows), rounds=50), rows)


@query()
def adaboost_regress(spark: SparkSession, folder: str) -> DataFrame:
    rows = _curve(spark, folder)
    return _scored(adaboost_regressor(_train(rows), label="target", loss="square", rounds=50), rows, "target")


@query()
def bagging(spark: SparkSession, folder: str) -> DataFrame:
    rows = _curve(spark, folder)
    return _scored(bagging_regressor(_train(rows), "key", label="target", members=10, depth=10), rows, "target")


@query()
def reduced_pipeline_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Two named steps: principal components, then logistic regression."""
    rows = as_vector(polynomial_features(_three(spark, folder), 2))
    final = LogisticRegression(featuresCol="reduced", labelCol="y", regParam=0.001)
    return _scored(reduced_pipeline(3, final).fit(_train(rows)), rows)


# The cuts tried by the boosting rounds, every value of the three columns but the largest.
CUTS = [[float(q) for q in range(1, 50)], [float(d) for d in range(10)], [float(t) for t in range(8)]]
RATE = 0.5


def _rounds_sql(rounds: int = 3) -> str:
    """Boosting rounds of one cut each, by trying all cuts of all columns on the gaps the round before leaves."""
    parts = [
        """gaps0 as (
  select x0, x1, x2, y, y - avg(y) over () as gap
  from (select l_quantity as x0, round(l_discount * 100) as x1, round(l_tax * 100) as x2, l_quantity * (1 - l_discount) * (1 + l_tax) as y from lineitem))"""
    ]
    for i in range(1, rounds + 1):
        columns = " union all ".join(f"select {f} as feature, x{f} as x, count(*) as n, sum(gap) as s from gaps{i - 1} group by all" for f in range(3))
        parts += [
            f"sums{i} as ({columns})",
            f"""cuts{i} as (
  select feature, x as cut, sum(n) over w as n_left, sum(s) over w as s_left, sum(n) over a as n, sum(s) over a as s
  from sums{i} window w as (partition by feature order by x), a as (partition by feature))""",
            f"""best{i} as (
  select feature, cut, s_left / n_left as left_value, (s - s_left) / (n - n_left) as right_value from cuts{i} where n_left < n
  order by s_left * s_left / n_left + (s - s_left) * (s - s_left) / (n - n_left) desc, feature, cut limit 1)""",
            f"""gaps{i} as (
  select x0, x1, x2, y, gap - {RATE} * case when case feature when 0 then x0 when 1 then x1 else x2 end <= cut then left_value else right_value end as gap
  from gaps{i - 1}, best{i})""",
        ]
    out = " union all ".join(
        f"select {i} as round, feature, cut, round(left_value, 6) as left_value, round(right_value, 6) as right_value, "
        f"(select round(avg(gap * gap), 6) from gaps{i}) as mse from best{i}"
        for i in range(1, rounds + 1)
    )
    return f"with {', '.join(parts)} {out}"


@query(_rounds_sql())
def boosting_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """Three rounds of squared-loss boosting over all line items: the cut, leaf values and error of each."""
    features = F.array(F.col("l_quantity"), F.round(F.col("l_discount") * 100), F.round(F.col("l_tax") * 100))
    target = F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))
    rows = training_rows(load(spark, folder, "lineitem").select(features.alias("features"), target.alias("y")), "features", F.col("y")).persist()
    (model,), edges = train(rows, [Spec("boost", 1, 3, RATE)], [np.array(c) for c in CUTS])
    found = []
    for i in range(1, 4):
        first = replace(model, trees=model.trees[:i], weights=model.weights[:i])
        mse = squared_error(rows, first, Spec("boost", 1, i, RATE), edges)
        tree = model.trees[i - 1]
        left, right = (float(np.round(tree.value[tree.left[0] + side], 6)) for side in (0, 1))
        found.append((i, tree.feature[0], float(edges[tree.feature[0]][tree.cut[0]]), left, right, float(np.round(mse, 6))))
    rows.unpersist()
    return spark.createDataFrame(found, "round int, feature int, cut double, left_value double, right_value double, mse double")


@query(
    f"""with items as (
  select l_quantity as x, l_extendedprice / 1000 as z, cast({hsql('key', 2)} % 5 as int) as fold
  from (select *, l_orderkey * 8 + l_linenumber as key from lineitem)),
  parts as (
    select f as fold, count(*) as n, var_pop(x) as a, var_pop(z) as c, covar_pop(x, z) as b
    from items, (select unnest(range(5))::int as f) where fold <> f group by f),
  turned as (select *, 0.5 * atan2(2 * b, a - c) as t, sqrt((a - c) * (a - c) + 4 * b * b) as gap from parts)
  select fold, n, round((a + c + gap) / 2, 5) as first_variance, round((a + c - gap) / 2, 5) as second_variance,
         round(abs(cos(t)), 6) as first_x,
         round(case when abs(cos(t)) >= abs(sin(t)) then sign(cos(t)) * sin(t) else abs(sin(t)) end, 6) + 0.0 as first_z
  from turned"""
)
def principal_axes(spark: SparkSession, folder: str) -> DataFrame:
    """Principal axes of quantity and price of all line items without each of five folds, from one pass over the folds."""
    key = F.col("l_orderkey") * 8 + F.col("l_linenumber")
    rows = load(spark, folder, "lineitem").select(key.alias("key"), F.array(F.col("l_quantity"), F.col("l_extendedprice") / 1000).alias("features"))
    moments = fold_moments(kfold(rows, "key", 5), "features", "fold", 5)
    found = []
    for f in range(5):
        rest = merged([m for g, m in enumerate(moments) if g != f])
        _, axes, values = components_of(rest, 2)
        found.append((f, int(rest[0]), *(float(np.round(v, 5)) for v in values), float(np.round(abs(axes[0, 0]), 6)), float(np.round(axes[1, 0], 6)) + 0.0))
    return spark.createDataFrame(found, "fold int, n long, first_variance double, second_variance double, first_x double, first_z double")


@query()
def pipeline_steps_search(spark: SparkSession, folder: str) -> DataFrame:
    """Number of components by penalty, searched together over the features of all line items; the winner is refitted."""
    rows = _items(spark, folder)
    train_rows = packed(_train(rows), "y", fold="fold")
    grid = [{"reduce__k": [1, 2, 3, 4], "model__C": [0.01, 1.0, 100.0]}]
    candidates = param_list(grid_table(spark, "logistic", grid))
    scores = pipeline_search(train_rows, candidates, "y", objectives=["accuracy", "roc_auc"])
    best = ranked(scores, 1).filter("objective = 'roc_auc'").first()["candidate"]
    final = LinearScore(featuresCol="reduced", labelCol="y", C=float(by_step(candidates[best][2])["model"]["C"]))
    model = fit_steps(train_rows, candidates[best][2], final)
    train_rows.release()
    held_out = metrics.accuracy(model.transform(_test(rows)), "y", "prediction")
    chosen = held_out.select(F.lit("held_out").alias("objective"), F.lit(best).cast("bigint").alias("candidate"), F.col("accuracy").alias("mean"))
    return _summary(scores).unionByName(chosen, allowMissingColumns=True)


@query()
def family_search(spark: SparkSession, folder: str) -> DataFrame:
    """One search over six families: the winner of every metric with its six five-fold metrics and its hold-out accuracy."""
    rows = _moons(spark, folder).persist()
    members = [Member("LogisticRegression", {"C": c, "penalty": p}, shared="logistic") for c in (1.0, 10.0, 100.0) for p in ("l1", "l2")]
    members += [Member("LinearSVC", {"C": c}, shared="margin") for c in (1.0, 100.0)]
    members += [Member("KNeighborsClassifier", {"n_neighbors": k}, Neighbors(keyCol="key", k=k)) for k in (5, 15, 45)]
    members += [Member("RandomForestClassifier", {"n_estimators": 10}, random_forest("classify", 10, 5, "1", keyCol="key", labelCol="y"))]
    members += [Member("GaussianNB", {}, GaussianBayes()), Member("LinearDiscriminantAnalysis", {}, LinearDiscriminant())]
    table = family_results(_train(rows), _test(rows), members, member_predictions(_train(rows), members, "y"), "y")
    rows.unpersist()
    return arrange_results(table)


@query(
    f"""with items as (
  select l_quantity as x, l_extendedprice / 1000 as z, cast(l_extendedprice * (1 - l_discount) > 25000 as int) as y, cast({hsql('key', 2)} % 5 as int) as fold
  from (select *, l_orderkey * 8 + l_linenumber as key from lineitem)),
  learned as (
    select f as fold, avg(x) filter (where y = 0) as x0, avg(z) filter (where y = 0) as z0, avg(x) filter (where y = 1) as x1, avg(z) filter (where y = 1) as z1,
           count(*) filter (where y = 0) as n0, count(*) filter (where y = 1) as n1
    from items, (select unnest(range(5))::int as f) where fold <> f group by f),
  each as (
    select fold, y, cast(round(sqrt((x - x1) * (x - x1) + (z - z1) * (z - z1)), 9) < round(sqrt((x - x0) * (x - x0) + (z - z0) * (z - z0)), 9) as int) as near,
           cast(n1 > n0 as int) as most from items join learned using (fold)),
  told as (select 0 as member, fold, y, near as p from each union all select 1, fold, y, most from each),
  cells as (
    select member, fold, count(*) filter (where y = 1 and p = 1)::double as tp, count(*) filter (where y = 0 and p = 1)::double as fp,
           count(*) filter (where y = 1 and p = 0)::double as fn, count(*) filter (where y = 0 and p = 0)::double as tn from told group by 1, 2),
  rates as (
    select member, fold, (tp + tn) / (tp + fp + fn + tn) as accuracy, tp / (tp + fn) as recall, coalesce(tp / nullif(tp + fp, 0), 0) as precision,
           coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) as f1, (tp / (tp + fn) + tn / (tn + fp)) / 2 as roc_auc,
           tp / (tp + fn) * coalesce(tp / nullif(tp + fp, 0), 0) + fn / (tp + fn) * (tp + fn) / (tp + fp + fn + tn) as average_precision from cells)
  select member, metric, round(avg(value), 9) as mean from (
    unpivot rates on accuracy, recall, precision, f1, roc_auc, average_precision into name metric value value) group by 1, 2"""
)
def family_folds(spark: SparkSession, folder: str) -> DataFrame:
    """The six five-fold metrics of nearest centroid and majority class over all line items."""
    price = F.col("l_extendedprice")
    features = F.array(F.col("l_quantity"), price / 1000)
    items = load(spark, folder, "lineitem").select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("key"), features.alias("features"),
        (price * (1 - F.col("l_discount")) > 25000).cast("int").alias("y"),
    )
    members = [Member("NearestCentroid", estimator=NearestCentroid()), Member("DummyClassifier", estimator=MajorityClass())]
    scores = member_scores(member_predictions(kfold(items, "key", 5), members, "y"))
    return scores.select("member", "metric", F.round("mean", 9).alias("mean"))


@query()
def leaderboard_classifiers(spark: SparkSession, folder: str) -> DataFrame:
    """The nine compared classifiers on one data set; a broken entry is reported, not fatal."""
    rows = as_vector(_moons(spark, folder)).persist()
    entries = classifier_entries("key")
    entries.append(Entry("Misspelt metric", Neighbors(keyCol="key", metric="euclidian")))
    return leaderboard(spark, entries, _train(rows), _test(rows), "y")


@query()
def leaderboard_regressors(spark: SparkSession, folder: str) -> DataFrame:
    """Every distinct regressor setting of the long comparison."""
    rows = as_vector(_curve(spark, folder)).persist()
    return leaderboard(spark, regressor_entries("key", "target"), _train(rows), _test(rows), "target", regress=True)


@query()
def boosting_search(spark: SparkSession, folder: str) -> DataFrame:
    """Boosting candidates by rate and rounds; the shorter ensembles are prefixes of the longest fit."""
    rows = _moons(spark, folder).persist()
    parts = []
    (grid,) = boosting_grid()
    for rate, longest in zip(grid["learning_rate"], adaboost_rates(_train(rows), grid["learning_rate"], max(grid["n_estimators"]))):
        for rounds in grid["n_estimators"]:
            scored = first_rounds(longest, rounds).transform(_test(rows))
            found = metrics.accuracy(scored, "y", "prediction")
            parts.append(found.select(F.lit(rounds).alias("rounds"), F.lit(rate).alias("rate"), "accuracy"))
    return stack_frames(parts)


@query()
def model_registry(spark: SparkSession, folder: str) -> DataFrame:
    """Save two models, load every saved model by name, score the hold-out rows with each."""
    rows = _moons(spark, folder).persist()
    root = scratch_path(spark, "models")
    for name, estimator in (("GaussianBayes", GaussianBayes()), ("LinearDiscriminant", LinearDiscriminant())):
        save_model(spark, estimator.fit(_train(rows)), root, name, "accuracy", "GridSearch", "multi_class")
    return score_all(load_models(spark, root, "multi_class-*"), _test(rows), ["key", "y"])


# The published horizons in rows of a daily series, a quarter and one to five years.
HORIZONS = {"1Q": 63, "1Y": 252, "2Y": 504, "3Y": 756, "4Y": 1008, "5Y": 1260}


@query()
def forecast_horizons(spark: SparkSession, folder: str) -> DataFrame:
    """The six horizons trained together: hold-out metrics, fold scores and the forecast of each."""
    columns = [f"lag_{i}" for i in range(1, 6)]
    ready = scaled_features(horizon_table(daily_revenue(spark, folder), "day", "revenue", HORIZONS), columns).persist()
    reports = linear_forecasts(ready, "day")
    wide = [
        reports["metrics"].select("horizon", F.lit("metrics").alias("report"), "r2", "mae", "mse", "explained_variance"),
        reports["folds"].select("horizon", F.lit("folds").alias("report"), "mean", "sem"),
        reports["forecast"].select("horizon", F.lit("forecast").alias("report"), F.col("last").alias("value")),
    ]
    out = wide[0]
    for part in wide[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


@query()
def forecast_search(spark: SparkSession, folder: str) -> DataFrame:
    """The 31 published regressors searched at every horizon; the winner of each is refitted and forecasts."""
    columns = [f"lag_{i}" for i in range(1, 6)]
    series = horizon_table(daily_revenue(spark, folder), "day", "revenue", HORIZONS)
    ready = as_vector(scaled_features(series, columns)).withColumn("key", F.col("position")).persist()
    entries = forecast_entries("key", "target")
    reports = searched_forecasts(ready, "day", entries)
    return reports["search"].withColumn("report", F.lit("search")).unionByName(
        reports["metrics"].select("horizon", "candidate", "r2", "mae", F.lit("metrics").alias("report")), allowMissingColumns=True
    ).unionByName(
        reports["forecast"].select("horizon", "candidate", F.col("last").alias("value"), F.lit("forecast").alias("report")), allowMissingColumns=True
    )
