"""Queries over closed-form models, generators, meshes and the cohort study."""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.catalog.common import (
    COHORT_FEATURES, FEATURE_SQL, cohort_rows, embeddings, hsql, nsql, query, r, rsql, usql,
)
from loomtab.functions import maths
from loomtab.functions.hashing import uniform
from loomtab.models.neighbors import Neighbors
from loomtab.models.simple import (
    GaussianBayes, LinearDiscriminant, MajorityClass, NearestCentroid, PriorProportional, QuadraticDiscriminant, class_moments,
)
from loomtab.operators import metrics
from loomtab.operators.aggregates import histogram
from loomtab.operators.columns import stack_frames
from loomtab.operators.ranking import best_model
from loomtab.plans.cohort import against_majority, run_study
from loomtab.plans.surface import mesh_over, score_mesh
from loomtab.session import load
from loomtab.sources import generators

_FS = [f"f{i}" for i in range(len(COHORT_FEATURES))]
_CENTROID_SQL = f"""{FEATURE_SQL},
centers as (select y as class, {", ".join(f"avg({f}) as c_{f}" for f in _FS)} from features where split = 'train' group by 1),
far as (select key, y, class, round(sqrt({" + ".join(f"(f.{f} - c_{f}) * (f.{f} - c_{f})" for f in _FS)}), 9) as d
  from features f, centers where split = 'test'),
predicted as (select key, y, class as p from (select *, row_number() over (partition by key order by d, class) as rn from far) where rn = 1)"""


@query(f"with {_CENTROID_SQL} select y, p, cast(count(*) as bigint) as n from predicted group by 1, 2")
def cohort_centroid_confusion(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: prepare two cohorts, fit centroids on the early one, predict the late one."""
    return run_study(cohort_rows(spark, folder), "key", "y", NearestCentroid()).confusion("y")


def _report_sql(truth: str, prediction: str, table: str) -> str:
    return f"""classes as (select distinct {truth} as class from {table} union select distinct {prediction} from {table}),
    c as (select class, (select count(*) from {table} where {truth} = class and {prediction} = class) as hit,
      (select count(*) from {table} where {prediction} = class) as predicted, (select count(*) from {table} where {truth} = class) as support from classes),
    rates as (select class, coalesce(hit / nullif(predicted, 0), 0) as precision, coalesce(hit / nullif(support, 0), 0) as recall,
      coalesce(2 * hit / nullif(predicted + support, 0), 0) as f1, support from c)
    select class, {rsql('precision')} as precision, {rsql('recall')} as recall, {rsql('f1')} as f1, cast(support as bigint) as support from rates
    union all select 'avg / total', {rsql('sum(precision * support) / sum(support)')}, {rsql('sum(recall * support) / sum(support)')},
    {rsql('sum(f1 * support) / sum(support)')}, cast(sum(support) as bigint) from rates"""


_MAJORITY_SQL = """top as (select y as p from rows_ where split = 'train' group by y order by count(*) desc, y limit 1),
    base as (select y, p from rows_, top where split = 'test')"""


@query(f"with {FEATURE_SQL}, {_MAJORITY_SQL}, {_report_sql('y', 'p', 'base')}")
def cohort_majority_report(spark: SparkSession, folder: str) -> DataFrame:
    """Report of the majority baseline on the late cohort."""
    rows = metrics.classification_report(against_majority(cohort_rows(spark, folder), "y"), "y", "prediction")
    return rows.select("class", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), "support")


@query(
    f"""with {_CENTROID_SQL}, {_MAJORITY_SQL},
    board as (select 'centroid' as name, avg(cast(y = p as double)) as score from predicted union all select 'majority', avg(cast(y = p as double)) from base)
    select name, {rsql('score')} as score, score = (select max(score) from board) as best from board"""
)
def cohort_leaderboard(spark: SparkSession, folder: str) -> DataFrame:
    """Centroid against the majority class, with the winner marked."""
    rows = cohort_rows(spark, folder)
    study = run_study(rows, "key", "y", NearestCentroid())
    scores = stack_frames(
        [
            metrics.accuracy(study.predictions, "y", "prediction").select(F.lit("centroid").alias("candidate"), F.col("accuracy").alias("score")),
            metrics.accuracy(against_majority(rows, "y"), "y", "prediction").select(F.lit("majority").alias("candidate"), F.col("accuracy").alias("score")),
        ]
    )
    winner = best_model(scores).select(F.col("candidate").alias("winner"))
    return scores.join(winner, F.col("candidate") == F.col("winner"), "left").select(
        F.col("candidate").alias("name"), r("score").alias("score"), F.col("winner").isNotNull().alias("best")
    )


@query(
    """select class, label as p, cast(count(*) as bigint) as n from (
      select o_orderkey, o_orderstatus as class, (select o_orderstatus from orders group by 1 order by count(*) desc, 1 limit 1) as label from orders) group by 1, 2"""
)
def dummy_majority(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "orders").select("o_orderkey", F.col("o_orderstatus").alias("class"))
    scored = MajorityClass(labelCol="class").fit(rows).transform(rows)
    return metrics.confusion(scored, "class", "prediction").select(F.col("y").alias("class"), "p", "n")


@query(
    f"""with c as (select o_orderstatus as class, count(*) as n from orders group by 1),
    cdf as (select class, cast(sum(n) over (order by class) as double) / (select sum(n) from c) as upper,
      cast(coalesce(sum(n) over (order by class rows between unbounded preceding and 1 preceding), 0) as double) / (select sum(n) from c) as lower from c),
    p as (select o_orderstatus as y, class as p from (select *, {usql('o_orderkey', 3)} as u from orders) join cdf on u >= lower and u < upper)
    select y, p, cast(count(*) as bigint) as n from p group by 1, 2"""
)
def dummy_stratified(spark: SparkSession, folder: str) -> DataFrame:
    """Predictions in proportion to the class shares."""
    rows = load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("y"))
    scored = PriorProportional(keyCol="key").fit(rows).transform(rows)
    return metrics.confusion(scored, "y", "prediction")


@query(
    f"""with e as (select label, unnest(cast(embedding as double[])) as x, unnest(range(len(embedding))) as dim from embeddings)
    select cast(label as int) as label, cast(dim as int) as dim, {rsql('avg(x)')} as mean, {rsql('var_pop(x)')} as variance from e group by 1, 2"""
)
def centroid_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and variance of every dimension per class."""
    rows = class_moments(embeddings(spark, folder), "features", "y")
    table = spark.createDataFrame([(m["class"], m["mean"], m["var"]) for m in rows], "label int, mean array<double>, variance array<double>")
    both = F.posexplode(F.arrays_zip("mean", "variance")).alias("dim", "v")
    return table.select("label", both).select("label", "dim", r("v.mean").alias("mean"), r("v.variance").alias("variance"))


_EMBED_SQL = """e as (select vec_id, label, unnest(cast(embedding as double[])) as x, unnest(range(len(embedding))) as dim from embeddings),
m as (select label as class, dim, avg(x) as mean, var_pop(x) as var from e group by 1, 2)"""


@query(
    f"""with {_EMBED_SQL},
    d as (select vec_id, label, class, round(sum(abs(x - mean)), 9) as d from e join m using (dim) group by all)
    select vec_id, cast(label as int) as label, cast(class as int) as prediction from d
    qualify row_number() over (partition by vec_id order by d, class) = 1"""
)
def centroid_predict(spark: SparkSession, folder: str) -> DataFrame:
    """Nearest class mean by Manhattan distance."""
    rows = embeddings(spark, folder)
    scored = NearestCentroid(metric="manhattan").fit(rows).transform(rows)
    return scored.select("vec_id", F.col("y").alias("label"), "prediction")


@query(
    f"""with {_EMBED_SQL}, share as (select label as class, count(*) / (select count(*) from embeddings) as share from embeddings group by 1),
    l as (select vec_id, label, class, sum(-0.5 * ln(2 * pi() * (var + 1e-9)) - (x - mean) * (x - mean) / (2 * (var + 1e-9))) as ll from e join m using (dim) group by all),
    s as (select vec_id, label, class, ll + ln(share) as score from l join share using (class))
    select vec_id, cast(label as int) as label, cast(class as int) as prediction, {rsql('score')} as score from s
    qualify row_number() over (partition by vec_id order by round(score, 9) desc, class) = 1"""
)
def gaussian_nb(spark: SparkSession, folder: str) -> DataFrame:
    """Class and joint log-likelihood of every vector."""
    rows = embeddings(spark, folder)
    scored = GaussianBayes().fit(rows).transform(rows)
    return scored.select("vec_id", F.col("y").alias("label"), "prediction", r(F.array_max("score")).alias("score"))


# Generators: one row per customer or order key.


def _moons_sql(noise: float, key: str = "c_custkey", table: str = "customer", seed: int = 0) -> str:
    angle = f"pi() * {usql(key, 2, seed)}"
    jitter = [f" + {noise} * {nsql(key, (0, 1), seed + s)}" if noise else "" for s in (0, 1000)]
    return f"""moons as (select key, y, case when y = 0 then cos(a) else 1 - cos(a) end{jitter[0].replace(key, 'key')} as x1,
      case when y = 0 then sin(a) else 0.5 - sin(a) end{jitter[1].replace(key, 'key')} as x2
      from (select {key} as key, cast({hsql(key, 3, seed)} % 2 as int) as y, {angle} as a from {table}))"""


def moons_rows(spark: SparkSession, folder: str, noise: float = 0.3) -> DataFrame:
    keys = load(spark, folder, "customer").select(F.col("c_custkey").alias("key"))
    return generators.moons(keys, "key", noise)


@query(f"with {_moons_sql(0)} select key, {rsql('x1')} as x1, {rsql('x2')} as x2, y from moons")
def moons(spark: SparkSession, folder: str) -> DataFrame:
    return moons_rows(spark, folder, 0.0).select("key", r("x1").alias("x1"), r("x2").alias("x2"), "y")


@query(f"with {_moons_sql(0.3)} select key, {rsql('x1')} as x1, {rsql('x2')} as x2, y from moons")
def moons_noisy(spark: SparkSession, folder: str) -> DataFrame:
    return moons_rows(spark, folder).select("key", r("x1").alias("x1"), r("x2").alias("x2"), "y")


@query(
    f"""select key, {rsql('radius * cos(a)')} as x1, {rsql('radius * sin(a)')} as x2, y from (
      select key, y, case when y = 1 then 0.5 else 1.0 end as radius, a from (
        select o_orderkey as key, cast({hsql('o_orderkey', 3, 1)} % 2 as int) as y, 2 * pi() * {usql('o_orderkey', 2, 1)} as a from orders))"""
)
def circles(spark: SparkSession, folder: str) -> DataFrame:
    keys = load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    return generators.circles(keys, "key", noise=0.0).select("key", r("x1").alias("x1"), r("x2").alias("x2"), "y")


@query(
    f"""select key, {rsql(f"side + 0.6 * {nsql('key', (0, 1), 2)} + 2.0 * {usql('key', 2, 2)}")} as x1,
    {rsql(f"side + 0.6 * {nsql('key', (0, 1), 1002)} + 2.0 * {usql('key', 2, 1002)}")} as x2, y from (
      select key, y, case when y = 1 then 2.5 else -2.5 end as side from (
        select o_orderkey as key, cast({hsql('o_orderkey', 3, 2)} % 2 as int) as y from orders))"""
)
def blobs(spark: SparkSession, folder: str) -> DataFrame:
    keys = load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    return generators.blobs(keys, "key").select("key", r("x1").alias("x1"), r("x2").alias("x2"), "y")


def mixture_rows(spark: SparkSession, folder: str) -> DataFrame:
    keys = load(spark, folder, "customer").select(F.col("c_custkey").alias("key"))
    return generators.mixture(keys, "key")


_MIXTURE_SQL = f"""mix as (select key, y,
  [-1.0, 2.0, 3.0][y + 1] + sqrt([1.0, 0.5, 1.5][y + 1]) * {nsql('key', (0, 1), 3)} as x1,
  [0.0, 4.0, 1.0][y + 1] + sqrt([1.0, 1.2, 0.7][y + 1]) * {nsql('key', (0, 1), 1003)} as x2
  from (select c_custkey as key, cast({hsql('c_custkey', 3, 3)} % 3 as int) as y from customer))"""


@query(f"with {_MIXTURE_SQL} select key, {rsql('x1')} as x1, {rsql('x2')} as x2, y from mix")
def mixture(spark: SparkSession, folder: str) -> DataFrame:
    return mixture_rows(spark, folder).select("key", r("x1").alias("x1"), r("x2").alias("x2"), "y")


@query(
    f"""with {_MIXTURE_SQL}, n as (select count(*) as n, count(distinct y) as k from mix),
    g as (select y as class, count(*) as nc, avg(x1) as m1, avg(x2) as m2, var_pop(x1) * count(*) as s11, var_pop(x2) * count(*) as s22,
      covar_pop(x1, x2) * count(*) as s12 from mix group by 1),
    w as (select sum(s11) / (any_value(n) - any_value(k)) as a, sum(s22) / (any_value(n) - any_value(k)) as b, sum(s12) / (any_value(n) - any_value(k)) as c from g, n),
    s as (select key, y, class, ((b * m1 - c * m2) * x1 + (a * m2 - c * m1) * x2) / (a * b - c * c)
      - 0.5 * (b * m1 * m1 - 2 * c * m1 * m2 + a * m2 * m2) / (a * b - c * c) + ln(nc / n) as score from mix, g, w, n)
    select key, y, cast(class as int) as prediction, {rsql('score', 5)} as score from s
    qualify row_number() over (partition by key order by round(score, 9) desc, class) = 1"""
)
def linear_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    rows = generators.with_features(mixture_rows(spark, folder))
    scored = LinearDiscriminant().fit(rows).transform(rows)
    return scored.select("key", "y", "prediction", r(F.array_max("score"), 5).alias("score"))


@query(
    f"""with {_MIXTURE_SQL}, n as (select count(*) as n from mix),
    g as (select y as class, count(*) as nc, avg(x1) as m1, avg(x2) as m2, var_samp(x1) as a, var_samp(x2) as b, covar_samp(x1, x2) as c from mix group by 1),
    s as (select key, y, class, ln(nc / n) - 0.5 * ln(a * b - c * c)
      - 0.5 * (b * (x1 - m1) * (x1 - m1) - 2 * c * (x1 - m1) * (x2 - m2) + a * (x2 - m2) * (x2 - m2)) / (a * b - c * c) as score from mix, g, n)
    select key, y, cast(class as int) as prediction, {rsql('score', 5)} as score from s
    qualify row_number() over (partition by key order by round(score, 9) desc, class) = 1"""
)
def quadratic_discriminant(spark: SparkSession, folder: str) -> DataFrame:
    rows = generators.with_features(mixture_rows(spark, folder))
    scored = QuadraticDiscriminant().fit(rows).transform(rows)
    return scored.select("key", "y", "prediction", r(F.array_max("score"), 5).alias("score"))


@query(
    f"""select p_partkey as key, {rsql(f"-300 * ln(1 - {usql('p_partkey', 0)})", 5)} as c_exponential, {rsql(f"1 + 1000 * power({usql('p_partkey', 1)}, 1 / 0.85)", 5)} as c_beta,
    {rsql(f"0.0000001 + power({usql('p_partkey', 2)}, 1 / 0.7)", 5)} as alpha, cast(floor(2 + {usql('p_partkey', 3)} * 98) as int) as k,
    {rsql(f"0.001 + {usql('p_partkey', 0, 1)} * 0.999", 5)} as eta0, case cast(floor({usql('p_partkey', 1, 1)} * 2) as int) when 0 then 'l1' else 'l2' end as penalty
    from part"""
)
def candidate_draws(spark: SparkSession, folder: str) -> DataFrame:
    """Random candidates from the search priors, one per part key."""
    key = "p_partkey"
    return load(spark, folder, "part").select(
        F.col(key).alias("key"), r(generators.exponential(uniform(key, 0), 300), 5).alias("c_exponential"),
        r(generators.power_beta(uniform(key, 1), 0.85, 1, 1000), 5).alias("c_beta"), r(generators.power_beta(uniform(key, 2), 0.7, 1e-7), 5).alias("alpha"),
        generators.whole(uniform(key, 3), 2, 100).alias("k"), r(generators.between(uniform(key, 0, 1), 0.001, 0.999), 5).alias("eta0"),
        generators.one_of(uniform(key, 1, 1), ["l1", "l2"]).alias("penalty"),
    )


@query(
    f"""with d as (select 0.00001 - 10 * ln(1 - {usql('o_orderkey', 0)}) as v from orders), s as (select min(v) as lo, max(v) as hi, count(*) as total from d),
    b as (select cast(least(floor((v - lo) / ((hi - lo) / 100)), 99) as int) as bin, count(*) as n from d, s group by 1)
    select cast(g.bin as int) as bin, cast(coalesce(n, 0) as bigint) as n, {rsql('lo', 9)} as low, {rsql('hi', 6)} as high
    from (select unnest(range(100)) as bin) g left join b using (bin), s"""
)
def prior_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Histogram and range of exponential prior draws, one draw per order."""
    draws = load(spark, folder, "orders").select((F.lit(0.00001) + generators.exponential(uniform("o_orderkey"), 10)).alias("v"))
    low, high = draws.agg(F.min("v"), F.max("v")).first()
    return histogram(draws, "v").select("bin", "n", r(F.lit(low), 9).alias("low"), r(F.lit(high)).alias("high"))


@query()
def prior_beta(spark: SparkSession, folder: str) -> DataFrame:
    """Beta(1.1, 50) draws, one per order; the inverse distribution has no SQL form."""
    key = "o_orderkey"
    return load(spark, folder, "orders").select(
        F.col(key).alias("key"), generators.beta_quantile(uniform(key), 1.1, 50, 0.0001, 30).alias("gamma")
    )


# Fixed-weight networks.

_W1 = [[0.4, -0.3, 0.2], [-0.5, 0.1, 0.6]]
_B1 = [0.1, -0.2, 0.05]
_W2 = [[0.7, -0.4, 0.3], [-0.6, 0.5, 0.2], [0.25, 0.35, -0.45]]
_B2 = [0.15, -0.1, 0.05]
_X = ["l_discount * 10", "l_tax * 10"]


def _hidden_sql() -> str:
    units = [f"{_B1[j]} + " + " + ".join(f"{x} * ({_W1[i][j]})" for i, x in enumerate(_X)) for j in range(3)]
    return ", ".join(f"(exp({u}) - exp(-({u}))) / (exp({u}) + exp(-({u}))) as h{j}" for j, u in enumerate(units))


def _score_sql(j: int) -> str:
    return f"({_B2[j]} + " + " + ".join(f"h{i} * ({_W2[i][j]})" for i in range(3)) + ")"


_NET_SQL = f"net as (select l_orderkey as key, l_linenumber as line, l_returnflag as flag, {_hidden_sql()} from lineitem)"


def _net_rows(spark: SparkSession, folder: str) -> DataFrame:
    x = F.array(F.col("l_discount") * 10, F.col("l_tax") * 10)
    hidden = F.transform(maths.dense(x, _W1, _B1), maths.tanh)
    return load(spark, folder, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"), hidden.alias("h"))


@query(f"with {_NET_SQL} select key, line, {rsql(f'1 / (1 + exp(-{_score_sql(0)}))')} as probability, cast(1 / (1 + exp(-{_score_sql(0)})) > 0.5 as int) as prediction from net")
def mlp_forward(spark: SparkSession, folder: str) -> DataFrame:
    """Binary forward pass with fixed weights: probability above one half is class 1."""
    score = maths.dense(F.col("h"), [[w[0]] for w in _W2], _B2[:1])[0]
    p = maths.logistic(score)
    return _net_rows(spark, folder).select("key", "line", r(p).alias("probability"), (p > 0.5).cast("int").alias("prediction"))


@query(
    f"""with {_NET_SQL}, s as (select key, line, {", ".join(f"exp({_score_sql(j)}) as s{j}" for j in range(3))} from net)
    select key, line, {", ".join(f"{rsql(f's{j} / (s0 + s1 + s2)')} as p{j}" for j in range(3))}, {rsql('ln(s0 / (s0 + s1 + s2))')} as log_p0,
    cast(case when s0 >= s1 and s0 >= s2 then 0 when s1 >= s2 then 1 else 2 end as int) as prediction from s"""
)
def mlp_forward_softmax(spark: SparkSession, folder: str) -> DataFrame:
    """Three-class forward pass: softmax probabilities and the first largest class."""
    scored = _net_rows(spark, folder).withColumn("z", maths.dense(F.col("h"), _W2, _B2)).withColumn("p", maths.softmax(F.col("z")))
    logs = maths.log_probabilities(F.col("p"))
    return scored.select("key", "line", *[r(F.col("p")[j]).alias(f"p{j}") for j in range(3)], r(logs[0]).alias("log_p0"), maths.arg_max(F.col("z")).alias("prediction"))


# Meshes over the data range of two columns.

_STEP, _MARGIN = 0.2, 0.5
_MESH_SQL = f"""m as (select min(x1) - {_MARGIN} as x0, max(x1) + {_MARGIN} as x9, min(x2) - {_MARGIN} as y0, max(x2) + {_MARGIN} as y9 from {{table}}),
cells as (select i, j, x0 + i * {_STEP} as x, y0 + j * {_STEP} as y from m, unnest(range(100000)) as a(i), unnest(range(1000)) as b(j)
  where x0 + i * {_STEP} < x9 and y0 + j * {_STEP} < y9 and i < 1000)"""


@query(f"with {_MIXTURE_SQL}, {_MESH_SQL.format(table='mix').replace('range(100000)', 'range(1000)')} select i, j, {rsql('x')} as x, {rsql('y')} as y from cells")
def mesh_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Regular mesh over the data range plus a margin."""
    cells = mesh_over(mixture_rows(spark, folder), "x1", "x2", _MARGIN, _STEP)
    return cells.select("i", "j", r("x").alias("x"), r("y").alias("y"))


@query(
    f"""with {_MIXTURE_SQL}, {_MESH_SQL.format(table='mix').replace('range(100000)', 'range(1000)')}, g as (select y as class, avg(x1) as m1, avg(x2) as m2 from mix group by 1),
    d as (select i, j, class, round(sqrt((x - m1) * (x - m1) + (y - m2) * (y - m2)), 9) as d from cells, g)
    select i, j, cast(class as int) as prediction from d qualify row_number() over (partition by i, j order by d, class) = 1"""
)
def mesh_centroid_surface(spark: SparkSession, folder: str) -> DataFrame:
    """Class regions of the nearest-centroid model on the mesh."""
    rows = generators.with_features(mixture_rows(spark, folder))
    model = NearestCentroid().fit(rows)
    return score_mesh(model, mesh_over(rows, "x1", "x2", _MARGIN, _STEP)).select("i", "j", "prediction")


@query(
    f"""with {_moons_sql(0.3)}, {_MESH_SQL.format(table='moons').replace('range(100000)', 'range(1000)')},
    near as (select i, j, moons.y as label, row_number() over (partition by i, j order by round(sqrt((x - x1) * (x - x1) + (cells.y - x2) * (cells.y - x2)), 9), key) as rn
      from cells, moons),
    v as (select i, j, label, count(*) as n from near where rn <= 3 group by all)
    select i, j, cast(label as int) as prediction from v qualify row_number() over (partition by i, j order by n desc, label) = 1"""
)
def mesh_knn_surface(spark: SparkSession, folder: str) -> DataFrame:
    """Class regions of the three-neighbour model on the mesh."""
    rows = generators.with_features(moons_rows(spark, folder))
    cells = mesh_over(rows, "x1", "x2", _MARGIN, _STEP).withColumn("key", F.col("i") * 100000 + F.col("j"))
    model = Neighbors(keyCol="key", k=3).fit(rows)
    return score_mesh(model, cells).select("i", "j", "prediction")


