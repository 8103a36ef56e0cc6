"""Registration of queries and the inputs they share.

Each query is a function (spark, folder) -> DataFrame over whole tables; its SQL, where
given, states the same result for an ANSI engine over the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.session import checkpointed, load
from loomtab.sources.tables import cohorts_by

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def r(value: str | Column, places: int = 6) -> Column:
    """Rounded for comparison, with -0.0 turned into 0.0."""
    return F.round(F.col(value) if isinstance(value, str) else value, places) + F.lit(0.0)


def rsql(value: str, places: int = 6) -> str:
    return f"(round({value}, {places}) + 0.0)"


def hsql(key: str, stream: int = 0, seed: int | None = None) -> str:
    """Key hash in SQL."""
    text = f"cast({key} as varchar)" if seed is None else f"'{seed}:' || cast({key} as varchar)"
    return f"cast('0x' || substr(md5({text}), {1 + 8 * stream}, 8) as bigint)"


def usql(key: str, stream: int = 0, seed: int | None = None) -> str:
    """Uniform draw in SQL."""
    return f"((cast({hsql(key, stream, seed)} as double) + 0.5) / 4294967296.0)"


def nsql(key: str, streams: tuple[int, int] = (0, 1), seed: int | None = None) -> str:
    """Normal draw in SQL."""
    return f"(sqrt(-2.0 * ln({usql(key, streams[0], seed)})) * cos(2.0 * pi() * {usql(key, streams[1], seed)}))"


TRAIN_BEFORE = "2000-01-01"


def cohort_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Orders with their customer: years before 2000 train, later ones test; NULLs induced by key."""
    orders, customer = load(spark, folder, "orders"), load(spark, folder, "customer")
    key = F.col("o_orderkey")
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey)
    rows = cohorts_by(joined, F.to_date("o_orderdate") < F.lit(TRAIN_BEFORE).cast("date"))
    return rows.select(
        key.alias("key"),
        "split",
        F.col("o_orderstatus").alias("y"),
        F.when(key % 7 != 0, F.col("o_totalprice")).alias("price"),
        F.when(key % 11 != 0, F.col("c_acctbal")).alias("balance"),
        F.when(key % 13 != 0, F.col("o_orderpriority")).alias("priority"),
        F.col("c_mktsegment").alias("segment"),
    )


COHORT_SQL = f"""rows_ as (
  select o_orderkey as key,
         case when o_orderdate < timestamp '{TRAIN_BEFORE}' then 'train' else 'test' end as split,
         o_orderstatus as y,
         case when o_orderkey % 7 <> 0 then o_totalprice end as price,
         case when o_orderkey % 11 <> 0 then c_acctbal end as balance,
         case when o_orderkey % 13 <> 0 then o_orderpriority end as priority,
         c_mktsegment as segment
  from orders join customer on o_custkey = c_custkey),
means as (select avg(price) as price, avg(balance) as balance from rows_ where split = 'train'),
pmode as (select priority from rows_ where split = 'train' and priority is not null
          group by priority order by count(*) desc, priority limit 1),
filled as (
  select r.key, r.split, r.y, coalesce(r.price, m.price) as price, coalesce(r.balance, m.balance) as balance,
         coalesce(r.priority, p.priority) as priority, r.segment
  from rows_ r, means m, pmode p)"""

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
COHORT_FEATURES = ["price", "balance"] + [f"priority_{p}" for p in PRIORITIES[:-1]] + [f"segment_{s}" for s in SEGMENTS[:-1]]


def _indicator_sql() -> str:
    parts = [f"cast(priority = '{p}' as int)" for p in PRIORITIES[:-1]] + [f"cast(segment = '{s}' as int)" for s in SEGMENTS[:-1]]
    return ", ".join(f"cast({p} as double) as f{i + 2}" for i, p in enumerate(parts))


# f0..f9: the prepared features of the cohorts, rescaled to [0, 1] on the train rows.
FEATURE_SQL = f"""{COHORT_SQL},
bounds as (select min(price) as p0, max(price) as p1, min(balance) as b0, max(balance) as b1 from filled where split = 'train'),
features as (
  select key, split, y, (price - p0) / (p1 - p0) as f0, (balance - b0) / (b1 - b0) as f1, {_indicator_sql()}
  from filled, bounds)"""


def fixed_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Order status against a prediction by price band."""
    price = F.col("o_totalprice")
    band = F.when(price < 150000, "F").when(price < 300000, "O").otherwise("P")
    return load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("y"), band.alias("p"), price.alias("price"))


FIXED_SQL = """preds as (
  select o_orderkey as key, o_orderstatus as y, o_totalprice as price,
         case when o_totalprice < 150000 then 'F' when o_totalprice < 300000 then 'O' else 'P' end as p
  from orders)"""


def scored_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Document quality with a score that grows with length (scores repeat)."""
    labels, documents = load(spark, folder, "labels"), load(spark, folder, "documents").select("doc_id", "n_chars")
    score = F.col("n_chars") / (F.col("n_chars") + 1000.0)
    return labels.join(documents, "doc_id").select("doc_id", F.col("quality").alias("y"), score.alias("score"))


SCORED_SQL = """scored as (
  select doc_id, quality as y, n_chars / (n_chars + 1000.0) as score from labels join documents using (doc_id))"""


def daily_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """One row per ship date, stored so that the passes over the ordered series do not read the items again."""
    items = load(spark, folder, "lineitem")
    return checkpointed(items.groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_extendedprice"), 2).alias("revenue")))


DAILY_SQL = """daily as (
  select cast(l_shipdate as date) as day, round(sum(l_extendedprice), 2) as revenue from lineitem group by 1),
placed as (select day, revenue, row_number() over (order by day) as position from daily)"""


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return load(spark, folder, "embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("features"), F.col("label").alias("y")
    )
