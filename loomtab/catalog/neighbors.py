"""Queries over nearest-neighbour and radius joins; every vector is matched against all others."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.catalog.common import embeddings, hsql, query, r, rsql
from loomtab.operators.neighbors import Side, knn_join, neighbor_mean, neighbor_rows, radius_join, radius_mean, vote
from loomtab.operators.splits import stratified_kfold
from loomtab.plans.search import knn_grid

CLASSES = [float(c) for c in range(10)]


def _side(df: DataFrame, value: str = "y", exclude: str = "vec_id") -> Side:
    return Side(df, "vec_id", "features", value, exclude)


_DISTANCE = {
    "euclidean": "sqrt(list_sum(list_transform(list_zip(a.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))",
    "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))",
    "chebyshev": "list_max(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))",
    "minkowski": "power(list_sum(list_transform(list_zip(a.v, b.v), lambda z: power(abs(z[1] - z[2]), 3))), 1.0 / 3)",
}


def _ranked_sql(metric: str, k: int, other: str = "a.id <> b.id", extra: str = "") -> str:
    return f"""e as (select vec_id as id, label, cast(embedding as double[]) as v{extra} from embeddings),
pairs as (select a.id as q, a.label as truth, b.id as t, b.label, {_DISTANCE[metric]} as d from e a, e b where {other}),
near as (select *, row_number() over (partition by q order by round(d, 9), t) as rn from pairs qualify rn <= {k})"""


def _vote_sql(weight: str = "1.0") -> str:
    return f"""votes as (select q, truth, label, round(sum({weight}), 9) as w from near group by all),
best as (select *, row_number() over (partition by q order by w desc, label) as place from votes)
select q, cast(truth as int) as label, cast(label as int) as prediction from best where place = 1"""


def _classified(spark: SparkSession, folder: str, metric: str, k: int = 7, weights: str = "uniform") -> DataFrame:
    rows = embeddings(spark, folder)
    side = _side(rows)
    found = knn_join(side, side, k, metric)
    answer = found.select(F.col("id").alias("q"), vote(F.col("neighbors"), k, CLASSES, weights).cast("int").alias("prediction"))
    return rows.select(F.col("vec_id").alias("q"), F.col("y").alias("label")).join(answer, "q")


@query(f"with {_ranked_sql('euclidean', 7)}, {_vote_sql()}")
def knn_classify_euclidean(spark: SparkSession, folder: str) -> DataFrame:
    """Seven-neighbour vote of every vector, itself left out."""
    return _classified(spark, folder, "euclidean")


@query(f"with {_ranked_sql('manhattan', 7)}, {_vote_sql()}")
def knn_classify_manhattan(spark: SparkSession, folder: str) -> DataFrame:
    return _classified(spark, folder, "manhattan")


@query(f"with {_ranked_sql('euclidean', 7)}, {_vote_sql('1 / d')}")
def knn_classify_weighted(spark: SparkSession, folder: str) -> DataFrame:
    """Votes weighted by inverse distance."""
    return _classified(spark, folder, "euclidean", weights="distance")


def _neighbors(spark: SparkSession, folder: str, metric: str, strategy: str) -> DataFrame:
    side = _side(embeddings(spark, folder))
    found = knn_join(side, side, 5, metric, p=3.0, strategy=strategy, pivots=16, block_rows=200, chunk_rows=200)
    return neighbor_rows(found).select(F.col("id").alias("q"), F.col("rank").cast("bigint").alias("rank"), F.col("neighbor").alias("t"), r("distance").alias("d"))


@query(f"with {_ranked_sql('chebyshev', 5)} select q, rn as rank, t, {rsql('d')} as d from near")
def knn_neighbors_chebyshev(spark: SparkSession, folder: str) -> DataFrame:
    """Ranked neighbours by the blocked route (no broadcast)."""
    return _neighbors(spark, folder, "chebyshev", "blocks")


@query(f"with {_ranked_sql('minkowski', 5)} select q, rn as rank, t, {rsql('d')} as d from near")
def knn_neighbors_minkowski(spark: SparkSession, folder: str) -> DataFrame:
    return _neighbors(spark, folder, "minkowski", "auto")


@query(f"with {_ranked_sql('euclidean', 8)} select q, {rsql('sum(label / d) / sum(1 / d)')} as prediction from near group by 1")
def knn_regress_distance(spark: SparkSession, folder: str) -> DataFrame:
    side = _side(embeddings(spark, folder))
    found = knn_join(side, side, 8)
    return found.select(F.col("id").alias("q"), r(neighbor_mean(F.col("neighbors"), 8, "distance")).alias("prediction"))


@query(f"with {_ranked_sql('euclidean', 5)} select q, {rsql('avg(label)')} as prediction from near group by 1")
def knn_regress_uniform(spark: SparkSession, folder: str) -> DataFrame:
    side = _side(embeddings(spark, folder))
    found = knn_join(side, side, 5)
    return found.select(F.col("id").alias("q"), r(neighbor_mean(F.col("neighbors"), 5)).alias("prediction"))


_RADIUS_SQL = f"""e as (select vec_id as id, label, cast(embedding as double[]) as v from embeddings),
near as (select a.id as q, b.id as t, b.label, {_DISTANCE['euclidean']} as d from e a, e b where a.id <> b.id),
inside as (select q, label, d from near where round(d, 9) <= 1.3)"""


@query(
    f"""with {_RADIUS_SQL} select e.id as q, cast(count(i.q) as bigint) as n, {rsql('avg(i.label)')} as prediction
    from e left join inside i on e.id = i.q group by 1"""
)
def radius_regress(spark: SparkSession, folder: str) -> DataFrame:
    """Mean over all vectors within 1.3; NULL where there is none."""
    side = _side(embeddings(spark, folder))
    found = radius_join(side, side, 1.3)
    return found.select(F.col("id").alias("q"), F.col("n").cast("bigint").alias("n"), r(radius_mean()).alias("prediction"))


@query(
    f"""with {_RADIUS_SQL} select e.id as q, cast(count(i.q) as bigint) as n, {rsql('sum(i.label / i.d) / sum(1 / i.d)')} as prediction
    from e left join inside i on e.id = i.q group by 1"""
)
def radius_regress_distance(spark: SparkSession, folder: str) -> DataFrame:
    """Inverse-distance mean within 1.3, by the blocked route."""
    side = _side(embeddings(spark, folder))
    found = radius_join(side, side, 1.3, strategy="blocks", pivots=16, block_rows=200, chunk_rows=200)
    return found.select(F.col("id").alias("q"), F.col("n").cast("bigint").alias("n"), r(radius_mean("distance")).alias("prediction"))


KS = list(range(10, 100, 4))


def _grid_sql(other: str, extra: str = "") -> str:
    parts = []
    for metric in ("euclidean", "manhattan"):
        parts.append(
            f"""select '{metric}' as metric, 'uniform' as weights, cast(k as int) as k, cast(count(*) as bigint) as n,
            {rsql('avg(cast(label = truth as double))')} as accuracy from (
              select k, q, truth, label, row_number() over (partition by k, q order by count(*) desc, label) as place
              from near_{metric}, unnest(range(10, 100, 4)) as g(k) where rn <= k group by k, q, truth, label) where place = 1 group by k"""
        )
    heads = []
    for metric in ("euclidean", "manhattan"):
        heads.append(
            f"""near_{metric} as (select q, truth, label, rn from (select a.id as q, a.label as truth, b.id as t, b.label,
            row_number() over (partition by a.id order by round({_DISTANCE[metric]}, 9), b.id) as rn from e a, e b where {other}) where rn <= 98)"""
        )
    return f"with e as (select vec_id as id, label, cast(embedding as double[]) as v{extra} from embeddings), " + ", ".join(heads) + " " + " union all ".join(parts)


@query(_grid_sql("a.id <> b.id"))
def knn_grid_46(spark: SparkSession, folder: str) -> DataFrame:
    """23 values of k by two metrics, every candidate scored from one ranked join per metric."""
    scores = knn_grid(embeddings(spark, folder), "vec_id", "y", KS)
    return scores.select("metric", "weights", "k", "n", r("accuracy").alias("accuracy"))


@query(
    _grid_sql(
        "a.fold <> b.fold",
        f", cast((row_number() over (partition by label order by {hsql('vec_id')}, vec_id) - 1) % 5 as int) as fold",
    )
)
def knn_grid_cv5(spark: SparkSession, folder: str) -> DataFrame:
    """The same 46 candidates cross-validated over five stratified folds, still one join per metric."""
    rows = stratified_kfold(embeddings(spark, folder), "vec_id", "y", 5)
    scores = knn_grid(rows, "vec_id", "y", KS, exclude="fold")
    return scores.select("metric", "weights", "k", "n", r("accuracy").alias("accuracy"))
