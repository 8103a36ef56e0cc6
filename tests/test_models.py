from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from loomtab.models import shared_pass
from loomtab.models.arrays import summed, summed_apart
from loomtab.models.linear import (
    LinearScore, Perceptron, fourier_features, kernel_map, linear_svc, logistic_regression, polynomial_features, reduced_pipeline, weighted,
)
from loomtab.models.losses import Linear, Network
from loomtab.models.mlp import MlpClassifier, MlpModel, MlpRegressor, partial_fit, small_network, softmax_network
from loomtab.models.shared_pass import Descent, Problem, descend, fit_all, training_table
from loomtab.models.simple import (
    GaussianBayes, LinearDiscriminant, MajorityClass, NearestCentroid, PriorProportional, QuadraticDiscriminant,
)
from loomtab.operators.metrics import accuracy, regression
from loomtab.operators.prepare import as_vector
from loomtab.operators.splits import split
from loomtab.sources import generators

NAMES = ["left", "middle", "right"]


def named(rows):
    return rows.withColumn("name", F.element_at(F.array(*[F.lit(n) for n in NAMES]), F.col("y") + 1))


@pytest.fixture(scope="module")
def sets(spark):
    keys = spark.range(900).withColumnRenamed("id", "key")
    made = {
        "moons": generators.moons(keys, "key"), "circles": generators.circles(keys, "key"),
        "blobs": generators.blobs(keys, "key"), "mixture": generators.mixture(keys, "key"),
    }
    return {n: named(split(generators.with_features(d), "key")).persist() for n, d in made.items()}


def sides(rows):
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def score(model, rows, label="name"):
    return accuracy(model.transform(sides(rows)[1]), label, "prediction").first()[0]


# Margin over the majority class that each model must reach on each set.
CASES = [
    (lambda: NearestCentroid(labelCol="name"), "moons", 0.2),
    (lambda: NearestCentroid(labelCol="name", metric="manhattan"), "mixture", 0.4),
    (lambda: GaussianBayes(labelCol="name"), "circles", 0.25),
    (lambda: LinearDiscriminant(labelCol="name"), "mixture", 0.45),
    (lambda: QuadraticDiscriminant(labelCol="name"), "circles", 0.25),
    (lambda: LinearScore(labelCol="name"), "blobs", 0.4),
    (lambda: LinearScore(labelCol="name", loss="softmax"), "mixture", 0.45),
    (lambda: LinearScore(labelCol="name", loss="squared_hinge", penalty="l1", balanced=True), "mixture", 0.4),
    (lambda: Perceptron(labelCol="name"), "blobs", 0.4),
    (lambda: Perceptron(labelCol="name", penalty="elasticnet"), "mixture", 0.35),
    (lambda: MlpClassifier(labelCol="name", nHidden=8, maxIter=40), "moons", 0.3),
    (lambda: MlpClassifier(labelCol="name", nHidden=6, maxIter=40, activation="logistic"), "circles", 0.25),
    (lambda: softmax_network(labelCol="name", nHidden=20), "mixture", 0.4),
    (lambda: small_network(labelCol="name", eta0=0.3, batchSize=20), "mixture", 0.35),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_classifier_beats_the_majority(sets, case):
    make, name, margin = CASES[case]
    train, _ = sides(sets[name])
    base = score(MajorityClass(labelCol="name").fit(train), sets[name])
    assert score(make().fit(train), sets[name]) >= base + margin


def test_mllib_linear_models(sets):
    rows = weighted(as_vector(sets["mixture"]), "y")
    train, _ = sides(rows)
    n = train.count()
    for estimator in (
        logistic_regression(n, 10.0, featuresCol="vector", labelCol="y"),
        logistic_regression(n, 10.0, "l1", "ovr", featuresCol="vector", labelCol="y", weightCol="weight"),
        linear_svc(n, 1.0, classes=3, featuresCol="vector", labelCol="y"),
    ):
        assert score(estimator.fit(train), rows, "y") > 0.75
    with pytest.raises(ValueError, match="penalty"):
        logistic_regression(n, penalty="l3")


def test_explicit_kernel_beats_the_line(sets):
    plain = score(LinearScore(labelCol="name", loss="squared_hinge").fit(sides(sets["circles"])[0]), sets["circles"])
    mapped = kernel_map(sets["circles"], "rbf", gamma=2.0, components=64)
    model = LinearScore(labelCol="name", loss="squared_hinge", calibrate=True).fit(sides(mapped)[0])
    assert score(model, mapped) > plain + 0.2
    p = model.transform(mapped).select("probability").toPandas().probability
    assert all(abs(sum(v) - 1) < 1e-9 and min(v) >= 0 for v in p)
    with pytest.raises(ValueError, match="sigmoid"):
        kernel_map(sets["circles"], "sigmoid")


def test_fourier_features_approach_the_kernel(spark):
    x = np.random.default_rng(0).normal(size=(30, 2))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "key int, features array<double>")
    z = np.array([r["features"] for r in fourier_features(rows, 0.5, 4000).orderBy("key").collect()])
    kernel = np.exp(-0.5 * ((x[:, None] - x[None]) ** 2).sum(2))
    assert np.abs(z @ z.T - kernel).max() < 0.1


def test_wide_expansion_is_refused(spark):
    rows = spark.createDataFrame([([0.0] * 60,)], "features array<double>")
    with pytest.raises(ValueError, match="terms"):
        polynomial_features(rows, 5)


def test_reduced_pipeline(sets):
    from pyspark.ml.classification import LogisticRegression

    rows = as_vector(polynomial_features(sets["mixture"], 2))
    model = reduced_pipeline(3, LogisticRegression(featuresCol="reduced", labelCol="y")).fit(sides(rows)[0])
    assert score(model, rows, "y") > 0.6


def test_baselines(spark):
    rows = spark.range(3000).select(F.col("id").alias("key"), F.when(F.col("id") % 10 < 7, "b").otherwise("a").alias("y"))
    assert MajorityClass().fit(rows).transform(rows).select("prediction").distinct().collect()[0][0] == "b"
    drawn = PriorProportional(keyCol="key").fit(rows).transform(rows)
    assert drawn.filter("prediction = 'b'").count() / 3000 == pytest.approx(0.7, abs=0.03)
    tie = spark.createDataFrame([("b",), ("a",)], "y string")
    assert MajorityClass().fit(tie).transform(tie).first()["prediction"] == "a"


# Losses: analytic derivatives against finite differences.

FAMILIES = [
    Linear(3, "logistic"), Linear(3, "squared_hinge"), Linear(3, "squared"), Linear(3, "huber", margin=0.3), Linear(3, "tube"),
    Linear(3, "softmax", 3), Network(3, 4, 1, "tanh", "logistic"), Network(3, 4, 3, "logistic", "softmax"), Network(3, 4, 1, "tanh", "identity"),
]


@pytest.mark.parametrize("family", FAMILIES, ids=str)
def test_gradient_and_curvature(family):
    rng = np.random.default_rng(5)
    x, w, theta = rng.normal(size=(40, 3)), rng.uniform(0.5, 2, 40), rng.normal(size=family.size) * 0.5
    regress = getattr(family, "output", family.loss if isinstance(family, Linear) else "") in ("identity", "squared", "huber", "tube")
    y = rng.normal(size=40) if regress else rng.integers(0, 3 if family.outputs == 3 else 2, 40).astype(float)
    step = 1e-6 * np.eye(family.size)

    def numeric(f):
        return np.array([(f(theta + s) - f(theta - s)) / 2e-6 for s in step])

    _, gradient = family.loss_and_gradient(x, y, w, theta)
    assert gradient == pytest.approx(numeric(lambda t: family.loss_and_gradient(x, y, w, t)[0]), abs=1e-4)
    if isinstance(family, Linear):
        curved = family.curvature(x, y, w, theta)
        assert curved == pytest.approx(numeric(lambda t: family.loss_and_gradient(x, y, w, t)[1]), abs=1e-3)


@pytest.fixture(scope="module")
def line(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 0.3 + 0.1 * rng.normal(size=200)
    rows = spark.createDataFrame([(i, v.tolist(), float(t), i % 4) for i, (v, t) in enumerate(zip(x, y))], "key int, features array<double>, y double, fold int")
    return x, y, training_table(rows.repartition(5), "features", "y", "fold")


def test_least_squares_per_fold(line):
    x, y, table = line
    problems = [Problem(Linear(3, "squared"), holdout=f, tol=1e-10) for f in (None, 0, 3)]
    passes = fit_all(table, problems)
    assert passes <= 3
    for p in problems:
        keep = np.arange(200) % 4 != (-1 if p.holdout is None else p.holdout)
        want = np.linalg.lstsq(np.column_stack([x, np.ones(200)])[keep], y[keep], rcond=None)[0]
        assert p.theta == pytest.approx(want, abs=1e-8)


def test_l1_optimality(line):
    x, y, table = line
    strength = 130.0
    p = Problem(Linear(3, "squared"), l1=strength, tol=1e-9)
    fit_all(table, [p])
    slope = x.T @ (x @ p.theta[:3] + p.theta[3] - y)
    for t, g in zip(p.theta[:3], slope):
        assert abs(g) <= strength + 1e-3 if t == 0 else g == pytest.approx(-strength * np.sign(t), abs=1e-3)
    assert (p.theta[:3] == 0).any()


def test_quasi_newton_and_newton_agree(line, monkeypatch):
    from loomtab.models import shared_pass

    _, _, table = line
    made = []
    for size in (256, 0):
        monkeypatch.setattr(shared_pass, "NEWTON_SIZE", size)
        p = Problem(Linear(3, "huber", margin=0.05), l2=1.0, l1=2.0, tol=1e-9, max_iter=300)
        fit_all(table, [p])
        made.append(p.theta)
    assert made[0] == pytest.approx(made[1], abs=1e-4)


def test_many_partitions_give_the_same_fit(spark, line):
    x, y, table = line
    p, q = (Problem(Linear(3, "tube"), l2=1.0, tol=1e-9) for _ in range(2))
    fit_all(table, [p])
    wide = table.repartition(80).persist()  # more partial results than the driver adds up itself
    fit_all(wide, [q])
    wide.unpersist()
    assert p.theta == pytest.approx(q.theta, abs=1e-7)


def test_descent_with_one_partition_is_sequential(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 2))
    y = (x[:, 0] + x[:, 1] > 0).astype(float)
    rows = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "features array<double>, y double").coalesce(1)
    table = training_table(rows, "features", "y")
    net = Network(2, 3, 1, "tanh", "logistic")
    p = Problem(net, l2=0.01, seed=4)
    descend(table, p, Descent(batch_size=20, eta0=0.2, epochs=3, tol=0.0))
    theta = net.start(4)
    for _ in range(3):
        for at in range(0, 60, 20):
            _, g = net.loss_and_gradient(x[at : at + 20], y[at : at + 20], np.ones(20), theta)
            theta = theta - 0.2 * (g + 0.01 * net.penalised() * theta) / 20
    assert p.theta == pytest.approx(theta)
    table.unpersist()


def test_initial_weights_stay_in_their_interval():
    reach = np.sqrt(6 / (10 + 20))
    assert np.abs(Network(10, 20, 2).start(1)).max() <= reach
    assert reach < np.abs(Network(10, 20, 2, "logistic").start(1)).max() <= 4 * reach


# Perceptron with one hidden layer: contract of the estimators.


def test_network_parameters_are_checked(sets):
    train, _ = sides(sets["moons"])
    for bad in ({"alpha": -1.0}, {"activation": "relu"}, {"eta0": 0.0}, {"learningRate": "fast"}, {"maxIter": 0}, {"algorithm": "adam"}):
        with pytest.raises(ValueError, match=next(iter(bad))):
            MlpClassifier(**bad).fit(train)
    with pytest.raises(ValueError, match="no parameter"):
        MlpClassifier(hidden=3)


def test_network_outputs(sets, tmp_path):
    train, test = sides(sets["mixture"])
    model = MlpClassifier(labelCol="name", nHidden=4, maxIter=10).fit(train)
    out = model.transform(test).toPandas()
    p = np.array(out.probability.tolist())
    assert p.sum(1) == pytest.approx(1.0)
    assert np.array(out.log_probability.tolist()) == pytest.approx(np.log(p))
    assert out.prediction.tolist() == [NAMES[i] for i in p.argmax(1)]
    z = np.array(model.decision(test).toPandas().decision.tolist())
    assert np.exp(z) / np.exp(z).sum(1, keepdims=True) == pytest.approx(p)
    PipelineModel([model]).write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m")).transform(test).toPandas()
    assert again.prediction.tolist() == out.prediction.tolist()


def test_warm_start_continues(sets):
    train, _ = sides(sets["moons"])
    first = MlpClassifier(nHidden=5, maxIter=3).fit(train)
    second = MlpClassifier(warm=first, nHidden=5, maxIter=10).fit(train)
    table = training_table(train, "features", "y")
    net = Network(2, 5, 1, "tanh", "logistic")
    from loomtab.models.shared_pass import gradient_at

    costs = [gradient_at(table, Problem(net, l2=1e-5), np.array(m.fitted["theta"]))[0] for m in (first, second)]
    table.unpersist()
    assert costs[1] < costs[0]
    with pytest.raises(ValueError, match="warm start"):
        MlpClassifier(warm=first, nHidden=6, maxIter=3).fit(train)


def test_partial_fit_contract(sets):
    train, _ = sides(sets["mixture"])
    estimator = MlpClassifier(labelCol="name", nHidden=4, algorithm="sgd", learningRate="invscaling", eta0=0.4)
    with pytest.raises(ValueError, match="first call"):
        partial_fit(None, estimator, train)
    with pytest.raises(ValueError, match="sgd"):
        partial_fit(None, MlpClassifier(labelCol="name"), train, NAMES)
    half = train.filter("key % 2 = 0")
    model = partial_fit(None, estimator, half, NAMES)
    assert model.fitted["step"] == 2.0
    with pytest.raises(ValueError, match="differ"):
        partial_fit(model, estimator, half, NAMES[:2])
    one_class = partial_fit(model, estimator, half.filter("name = 'left'"))  # need not hold every class
    assert isinstance(one_class, MlpModel) and one_class.fitted["step"] == 3.0
    x = np.array([r[0] for r in half.select("features").collect()])
    y = np.array([NAMES.index(r[0]) for r in half.select("name").collect()], float)
    net = Network(2, 4, 3, "tanh", "softmax")
    theta = net.start(0)
    _, g = net.loss_and_gradient(x, y, np.ones(len(y)), theta)
    assert np.array(model.fitted["theta"]) == pytest.approx(theta - 0.4 * (g + 1e-5 * net.penalised() * theta) / len(y))


def test_unknown_class_in_a_batch_stops(sets):
    train, _ = sides(sets["mixture"])
    estimator = MlpClassifier(labelCol="name", nHidden=2, algorithm="sgd")
    with pytest.raises(Exception, match="outside the known classes"):
        partial_fit(None, estimator, train, NAMES[:2])


def test_regressors(spark):
    keys = spark.range(600).withColumnRenamed("id", "key")
    rows = split(generators.with_features(generators.moons(keys, "key"), ("x1", "y")), "key").persist()
    train, test = sides(rows)
    for estimator, floor in (
        (MlpRegressor(labelCol="x2", nHidden=6, maxIter=40), 0.45),
        (LinearScore(labelCol="x2", loss="tube", C=10.0), 0.3),
        (LinearScore(labelCol="x2", loss="huber", epsilon=0.2), 0.3),
    ):
        assert regression(estimator.fit(train).transform(test), "x2", "prediction").first()["r2"] > floor


@pytest.mark.parametrize("make", [lambda: Perceptron(), lambda: MlpClassifier(nHidden=2, algorithm="sgd", maxIter=4, batchSize=16, shuffle=True)])
def test_weights_do_not_depend_on_the_layout(spark, make):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 2))
    rows = spark.createDataFrame([(v.tolist(), int(v.sum() > 0)) for v in x], "features array<double>, y int")
    fitted = [make().named(labelCol="y").fit(rows.repartition(n)).fitted for n in (1, 4, 40)]
    weights = [np.ravel(f["rows"] if "rows" in f else f["theta"]) for f in fitted]
    assert np.array_equal(weights[0], weights[1]) and np.array_equal(weights[0], weights[2])


def test_rows_of_one_partition_are_dealt_to_all_cores(spark):
    rows = spark.range(5000).selectExpr("array(id * 1.0D, 1.0D) as features", "id % 2 * 1.0D as y").coalesce(1)
    table = training_table(rows, "features", "y")
    cores = spark.sparkContext.defaultParallelism
    assert table.rdd.getNumPartitions() == cores and table.count() == 5000
    assert table.selectExpr("sum(features[0])").first()[0] == sum(range(5000))
    table.unpersist()


@pytest.mark.parametrize("width", [5, 1000])
def test_sums_added_apart_are_those_of_the_driver(spark, width):
    df = spark.range(0, 90, 1, 7)

    def work(batches):
        return sum((b["id"].to_numpy().sum() * np.arange(1.0, width + 1) for b in batches), np.zeros(width))

    assert np.array_equal(summed_apart(df, work), summed(df, work, 7))
    assert np.array_equal(summed_apart(df, work), sum(range(90)) * np.arange(1.0, width + 1))


def test_long_sums_leave_one_vector_to_the_driver(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(v.tolist(), float(v[0] > 0.2)) for v in rng.normal(size=(200, 3))], "features array<double>, y double").repartition(3)
    table = training_table(rows, "features", "y")
    found = []
    for numbers in (1 << 20, 0):
        monkeypatch.setattr(shared_pass, "NUMBERS", numbers)
        problem = Problem(Linear(3, "logistic"), l2=1.0)
        fit_all(table, [problem])
        found.append(problem.theta)
    assert found[0] == pytest.approx(found[1], rel=1e-9)
    table.unpersist()
