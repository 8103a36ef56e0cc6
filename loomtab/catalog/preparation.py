"""Queries over sources, column rewriting, feature preparation and splits."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.catalog.common import (
    COHORT_FEATURES, COHORT_SQL, DAILY_SQL, FEATURE_SQL, FIXED_SQL, PRIORITIES, SEGMENTS, TRAIN_BEFORE, cohort_rows, daily_revenue,
    fixed_predictions, hsql, query, r, rsql, usql,
)
from loomtab.operators import aggregates, columns, splits
from loomtab.operators.ordering import ordinal
from loomtab.operators.prepare import TablePrep, from_one_of_many, indicators, indicators_long, one_of_many
from loomtab.session import load, scratch_path
from loomtab.sources import sinks, tables

CARRIED = ["key", "y", "split"]


def _prep(**options) -> TablePrep:
    return TablePrep(keyCols=CARRIED, splitCol="split", **options)


@query(
    f"""with {COHORT_SQL}
    select key, {rsql('price', 4)} as price, {rsql('balance', 4)} as balance, priority, segment from filled"""
)
def prep_impute_mean_mode(spark: SparkSession, folder: str) -> DataFrame:
    """Mean and mode from the train cohort fill both cohorts."""
    rows = cohort_rows(spark, folder)
    filled = _prep().fit(rows).impute(rows)
    return filled.select("key", r("price", 4).alias("price"), r("balance", 4).alias("balance"), "priority", "segment")


@query(
    f"""with {COHORT_SQL}
    select key, coalesce(price, 0) as price, coalesce(balance, 0) as balance, priority from rows_"""
)
def prep_impute_zero(spark: SparkSession, folder: str) -> DataFrame:
    rows = cohort_rows(spark, folder)
    filled = _prep(numericFill="zero", textFill="none").fit(rows).impute(rows)
    return filled.select("key", "price", "balance", "priority")


@query(
    f"""with {FEATURE_SQL}
    select key, split, {", ".join(f"{rsql(f'f{i}')} as f{i}" for i in range(10))} from features"""
)
def prep_pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """The whole preparation as one fitted unit: impute, encode, rescale, assemble."""
    rows = cohort_rows(spark, folder)
    ready = _prep().fit(rows).transform(rows)
    return ready.select("key", "split", *[r(F.col("features")[i]).alias(f"f{i}") for i in range(len(COHORT_FEATURES))])


_MODE_SQL = " union all ".join(
    f"(select '{c}' as \"column\", cast({c} as varchar) as mode from orders where {c} is not null group by {c} order by count(*) desc, {c} limit 1)"
    for c in ("o_orderstatus", "o_orderpriority")
)


@query(_MODE_SQL)
def prep_mode(spark: SparkSession, folder: str) -> DataFrame:
    orders = load(spark, folder, "orders")
    return aggregates.modes(aggregates.value_counts(orders, ["o_orderstatus", "o_orderpriority"]))


@query(
    "select "
    + ", ".join(
        f"{rsql(f'avg({c})', 4)} as {c}_mean, min({c}) as {c}_min, max({c}) as {c}_max, {rsql(f'stddev_pop({c})', 4)} as {c}_std"
        for c in ("l_quantity", "l_extendedprice", "l_discount")
    )
    + " from lineitem"
)
def prep_profile(spark: SparkSession, folder: str) -> DataFrame:
    names = ["l_quantity", "l_extendedprice", "l_discount"]
    row = aggregates.profile(load(spark, folder, "lineitem"), names)
    return row.select(*[r(c, 4).alias(c) if c.endswith(("_mean", "_std")) else F.col(c) for c in row.columns])


_BOTH = "from orders join customer on o_custkey = c_custkey"


def _order_rows(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = load(spark, folder, "orders"), load(spark, folder, "customer")
    return orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment")
    )


def _flag(column: str, source: str, level: str) -> str:
    return f"coalesce(cast({source} = '{level}' as int), 0) as \"{column}_{level}\""


@query(
    "select o_orderkey as key, "
    + ", ".join([_flag("priority", "o_orderpriority", p) for p in PRIORITIES[:-1]] + [_flag("segment", "c_mktsegment", s) for s in SEGMENTS[:-1]])
    + f" {_BOTH}"
)
def prep_indicators(spark: SparkSession, folder: str) -> DataFrame:
    return indicators(_order_rows(spark, folder), ["priority", "segment"], ["key"])


@query(
    "select o_orderkey as key, "
    + ", ".join([_flag("priority", "o_orderpriority", PRIORITIES[0])] + [_flag("segment", "c_mktsegment", s) for s in SEGMENTS[:-1]])
    + f" {_BOTH}"
)
def prep_indicators_first_only(spark: SparkSession, folder: str) -> DataFrame:
    """Compatibility form: the first column keeps its first level only."""
    return indicators(_order_rows(spark, folder), ["priority", "segment"], ["key"], drop="first_only")


@query(
    f"""select "column", level, cast(count(*) as bigint) as n, cast(sum(key % 1000) as bigint) as keys from (
      select o_orderkey as key, 'priority' as "column", o_orderpriority as level {_BOTH}
      union all select o_orderkey, 'segment', c_mktsegment {_BOTH}
      union all select o_orderkey, 'customer', cast(o_custkey as varchar) {_BOTH}) group by 1, 2"""
)
def prep_indicators_long(spark: SparkSession, folder: str) -> DataFrame:
    """Coordinate form, for columns of any number of levels, counted per level."""
    orders, customer = load(spark, folder, "orders"), load(spark, folder, "customer")
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        F.col("o_orderkey").alias("key"), F.col("o_orderpriority").alias("priority"), F.col("c_mktsegment").alias("segment"),
        F.col("o_custkey").alias("customer"),
    )
    cells = indicators_long(rows, ["priority", "segment", "customer"], ["key"])
    return cells.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("key") % 1000).alias("keys"))


_STATS = "with s as (select min(o_totalprice) as lo, max(o_totalprice) as hi, avg(o_totalprice) as mean, stddev_pop(o_totalprice) as std from orders)"


def _scaled(spark: SparkSession, folder: str, how: str) -> DataFrame:
    rows = load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("z"))
    prep = TablePrep(keyCols=["key"], scale=how).fit(rows)
    return prep.widen(rows).select("key", r("z").alias("z"))


@query(f"{_STATS} select o_orderkey as key, {rsql('(2 * o_totalprice - hi - lo) / (hi - lo)')} as z from orders, s")
def prep_rescale_sym(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder, "symmetric")


@query(f"{_STATS} select o_orderkey as key, {rsql('(o_totalprice - lo) / (hi - lo)')} as z from orders, s")
def prep_rescale_unit(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder, "unit")


@query(f"{_STATS} select o_orderkey as key, {rsql('(o_totalprice - mean) / std')} as z from orders, s")
def prep_standardize(spark: SparkSession, folder: str) -> DataFrame:
    return _scaled(spark, folder, "standard")


@query(
    f"""{_STATS}, t as (select o_orderkey as key, (o_totalprice - mean) / std as z from orders, s),
    u as (select min(z) as lo, max(z) as hi from t)
    select key, {rsql('(z - lo) / (hi - lo)')} as z from t, u"""
)
def prep_standard_unit(spark: SparkSession, folder: str) -> DataFrame:
    """Standardise, then min-max: the composition equals min-max alone on any non-constant column."""
    return _scaled(spark, folder, "standard_unit")


@query("select o_orderkey as key, case o_orderstatus when 'P' then 0 when 'O' then 0 else 1 end as y from orders")
def prep_recode_binary(spark: SparkSession, folder: str) -> DataFrame:
    """A chain of replacements (P to O, O to 0, F to 1) folded into one expression."""
    rows = load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("y"))
    return columns.recode(rows, [("P", "O"), ("O", 0), ("F", 1)], "y", to="int")


_YEARS = list(range(1995, 2002))


def _year_sql(cohort: str, known: list[int]) -> str:
    cells = ", ".join(
        f"cast(year(o_orderdate) = {y} as int) as year_{y}" if y in known else f"0 as year_{y}" for y in _YEARS
    )
    side = "<" if cohort == "train" else ">="
    return f"select o_orderkey as key, '{cohort}' as split, {cells} from orders where o_orderdate {side} timestamp '{TRAIN_BEFORE}'"


@query(_year_sql("train", [1995, 1996, 1997, 1998, 1999]) + " union all " + _year_sql("test", [2000, 2001]))
def prep_align_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Cohorts that share no level end up with the same columns, absent ones 0."""
    day = F.to_date("o_orderdate")
    rows = load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), day.alias("day"), F.year(day).cast("string").alias("year"))
    cut = F.lit(TRAIN_BEFORE).cast("date")
    early = indicators(rows.filter(F.col("day") < cut).drop("day"), ["year"], ["key"], drop="none")
    late = indicators(rows.filter(F.col("day") >= cut).drop("day"), ["year"], ["key"], drop="none")
    early, late = columns.align_columns(early, late, keep=["key"])
    return tables.read_cohorts(early, late)


@query(
    f"""select l_returnflag as flag, {rsql('sum(case when l_discount > 0 then 1 / l_discount else 0 end)', 3)} as total,
    cast(count(case when l_discount > 0 then 1 end) as bigint) as present from lineitem group by 1"""
)
def prep_clean_inf(spark: SparkSession, folder: str) -> DataFrame:
    """Infinite values become missing, then 0."""
    inverse = F.when(F.col("l_discount") == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), F.col("l_discount")))
    rows = columns.clean_inf(load(spark, folder, "lineitem").select(F.col("l_returnflag").alias("flag"), inverse.alias("v")))
    present = rows.withColumn("here", F.col("v").isNotNull().cast("bigint"))
    filled = columns.fill_value(present, 0, ["v"])
    return filled.groupBy("flag").agg(r(F.sum("v"), 3).alias("total"), F.sum("here").alias("present"))


@query(
    f"""select l_linestatus as status, {rsql('sum(cast(cast(l_discount as float) as double))')} as discount,
    {rsql('sum(cast(cast(l_tax as float) as double))')} as tax from lineitem group by 1"""
)
def prep_cast_float(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "lineitem").select(F.col("l_linestatus").alias("status"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    small = columns.cast_all(rows, "float", ["discount", "tax"])
    return small.groupBy("status").agg(*[r(F.sum(F.col(c).cast("double"))).alias(c) for c in ("discount", "tax")])


@query("select p_partkey, p_size, p_retailprice from part")
def select_numeric(spark: SparkSession, folder: str) -> DataFrame:
    return columns.select_by_type(load(spark, folder, "part"), "numeric")


@query("select p_partkey, p_name, p_brand, p_type from part")
def select_categorical(spark: SparkSession, folder: str) -> DataFrame:
    return columns.select_by_type(load(spark, folder, "part"), "categorical", keep=["p_partkey"])


@query("select c_custkey as customer_key, c_mktsegment as market_segment, c_acctbal as account_balance from customer")
def names_normalized(spark: SparkSession, folder: str) -> DataFrame:
    raw = load(spark, folder, "customer").select(
        F.col("c_custkey").alias("Customer Key"), F.col("c_mktsegment").alias("Market Segment"), F.col("c_acctbal").alias("ACCOUNT balance")
    )
    return columns.normalize_names(raw)


@query(
    """select o_orderkey as key, cast(o_orderstatus = 'F' as int) as c0, cast(o_orderstatus = 'O' as int) as c1,
    cast(o_orderstatus = 'P' as int) as c2, o_orderstatus as decoded from orders"""
)
def label_one_of_many(spark: SparkSession, folder: str) -> DataFrame:
    """Label to 0/1 per class and back."""
    classes = ["F", "O", "P"]
    coded = load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"), one_of_many(F.col("o_orderstatus"), classes).alias("code"))
    return coded.select("key", *[F.col("code")[i].alias(f"c{i}") for i in range(3)], from_one_of_many(F.col("code"), classes).alias("decoded"))


@query("select o_orderkey, o_totalprice from orders where o_orderstatus = 'P'")
def rows_of_one_class(spark: SparkSession, folder: str) -> DataFrame:
    return columns.rows_of_class(load(spark, folder, "orders"), "o_orderstatus", "P").select("o_orderkey", "o_totalprice")


@query(f"with {DAILY_SQL} select day, revenue from placed where position between 101 and 1500")
def series_row_range(spark: SparkSession, folder: str) -> DataFrame:
    """Rows 100..1499 of the ordered series."""
    return columns.row_range(daily_revenue(spark, folder), "day", 100, 1500)


@query(
    """select c_custkey, c_mktsegment, case when c_custkey % 5 <> 0 then c_acctbal end as account_balance,
    row_number() over (order by c_custkey) - 1 as "index" from customer"""
)
def csv_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Write a results CSV in fixed column order, read it back with normalised names and missing cells as NULL."""
    rows = load(spark, folder, "customer").select(
        "c_custkey", "c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_acctbal")).alias("Account Balance")
    )
    path = scratch_path(spark, "csv")
    sinks.write_results(rows, path, "c_custkey", ["c_custkey", "c_mktsegment", "Account Balance"])
    schema = "`index` bigint, c_custkey bigint, c_mktsegment string, `Account Balance` double"
    return tables.read_table(spark, path, schema).select("c_custkey", "c_mktsegment", "account_balance", "index")


@query(
    """select split, cast(count(*) as bigint) as n, cast(count(balance) as bigint) as with_balance, cast(sum(key % 1000) as bigint) as keys from (
      select o_orderkey as key, 'train' as split, null as balance from orders
      union all select c_custkey, 'test', c_acctbal from customer) group by 1"""
)
def cohorts_union(spark: SparkSession, folder: str) -> DataFrame:
    """Two inputs with partly different columns under one contract."""
    left = load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    right = load(spark, folder, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    both = tables.read_cohorts(left, right)
    return both.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count("balance").alias("with_balance"), F.sum(F.col("key") % 1000).alias("keys"))


_OFFSETS = {"A": (2000, 2400, 251), "N": (1800, 2300, 251), "R": (1500, 2200, 62)}


@query(
    """with daily as (select l_returnflag as horizon, cast(l_shipdate as date) as day, round(sum(l_extendedprice), 2) as revenue
      from lineitem group by 1, 2),
    placed as (select *, row_number() over (partition by horizon order by day) - 1 as place from daily),
    o as (select * from (values ('A', 2000, 2400, 251), ('N', 1800, 2300, 251), ('R', 1500, 2200, 62)) t(horizon, n_train, n_last, win))
    select horizon, cast(sum(cast(place < n_train as int)) as bigint) as n_train,
      cast(sum(cast(place between n_last - win and n_last as int)) as bigint) as n_forecast,
      round(sum(case when place between n_last - win and n_last then revenue else 0 end), 2) + 0.0 as forecast_revenue
    from placed join o using (horizon) group by 1"""
)
def read_many_horizons(spark: SparkSession, folder: str) -> DataFrame:
    """A family of files read as one frame; each file's offsets come from a table, not a loop."""
    items = load(spark, folder, "lineitem")
    root = scratch_path(spark, "family")
    series = items.groupBy(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue")
    )
    series.write.partitionBy("flag").option("header", True).csv(root)
    paths = {name: f"{root}/flag={name}" for name in _OFFSETS}
    family = tables.read_many(spark, paths, "day date, revenue double")
    placed = ordinal(family, "day", group=["horizon"])
    marked = splits.horizon_split(
        placed.join(tables.offsets_table(spark, _OFFSETS), "horizon"), F.col("n_train"), F.col("n_last"), F.col("window")
    )
    inside = F.col("is_forecast")
    return marked.groupBy("horizon").agg(
        F.sum(F.col("is_train").cast("bigint")).alias("n_train"),
        F.sum(inside.cast("bigint")).alias("n_forecast"),
        r(F.sum(F.when(inside, F.col("revenue")).otherwise(0.0)), 2).alias("forecast_revenue"),
    )


# Splits and folds.


@query(
    f"""select case when {hsql('o_orderkey')} % 100 < 25 then 'test' else 'train' end as split, o_orderstatus as class,
    cast(count(*) as bigint) as n from orders group by 1, 2"""
)
def split_hash(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.split(load(spark, folder, "orders"), "o_orderkey")
    return rows.groupBy("split", F.col("o_orderstatus").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""with p as (select o_orderkey as key, row_number() over (order by {hsql('o_orderkey')}, o_orderkey) as place, count(*) over () as n from orders)
    select key, case when place <= ceil(n * 0.25) then 'test' else 'train' end as split from p"""
)
def split_exact(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    return splits.split_exact(rows, "key")


@query(
    f"""select case when {hsql('o_orderkey')} % 100 < 25 then 'test' when {hsql('o_orderkey', 1)} % 100 < 50 then 'dev' else 'fit' end as part,
    o_orderstatus as class, cast(count(*) as bigint) as n from orders group by 1, 2"""
)
def split_dev(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.dev_split(splits.split(load(spark, folder, "orders"), "o_orderkey"), "o_orderkey")
    return rows.groupBy("part", F.col("o_orderstatus").alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""select cast({hsql('o_orderkey', 2)} % 5 as int) as fold, cast(count(*) as bigint) as n, cast(sum(o_orderkey) as bigint) as keys
    from orders group by 1"""
)
def folds_plain(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.kfold(load(spark, folder, "orders"), "o_orderkey")
    return rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query(
    f"""select o_orderkey as key, cast((row_number() over (order by {hsql('o_orderkey')}, o_orderkey) - 1) % 5 as int) as fold from orders"""
)
def folds_even(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    return splits.kfold_even(rows, "key")


@query(
    f"""with p as (select o_orderstatus as class, o_orderkey as key, cast((row_number() over (partition by o_orderstatus
      order by {hsql('o_orderkey')}, o_orderkey) - 1) % 5 as int) as fold from orders)
    select fold, class, cast(count(*) as bigint) as n, cast(sum(key) as bigint) as keys from p group by 1, 2"""
)
def folds_stratified(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.stratified_kfold(load(spark, folder, "orders"), "o_orderkey", "o_orderstatus")
    return rows.groupBy("fold", F.col("o_orderstatus").alias("class")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))


@query(f"select o_orderkey as key, row_number() over (order by {hsql('o_orderkey')}, o_orderkey) as position from orders")
def shuffle_order(spark: SparkSession, folder: str) -> DataFrame:
    """Reproducible random position of every row."""
    rows = load(spark, folder, "orders").select(F.col("o_orderkey").alias("key"))
    hashed = rows.withColumn("h", splits.key_hash("key"))
    return ordinal(hashed, "h", ties=["key"], span=splits.SPAN).drop("h")


@query(
    f"""select cast({hsql('l_orderkey', 3)} % 40 as int) as batch, cast(count(*) as bigint) as n, {rsql('sum(l_quantity)', 2)} as quantity
    from lineitem group by 1"""
)
def mini_batches(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.batches(load(spark, folder, "lineitem"), "l_orderkey", 40)
    return rows.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_quantity"), 2).alias("quantity"))


def _poisson_sql(key: str, draw: int, terms: int = 12) -> str:
    total, mass, parts = 0.0, math.exp(-1.0), []
    for n in range(terms):
        total += mass
        parts.append(f"cast({usql(key, 0, draw)} > {total!r} as int)")
        mass /= n + 1
    return " + ".join(parts)


@query(
    f"""with b as (select o_orderstatus as class, 0 as draw, {_poisson_sql('o_orderkey', 0)} as w, o_totalprice as v from orders
      union all select o_orderstatus, 1, {_poisson_sql('o_orderkey', 1)}, o_totalprice from orders)
    select draw, class, cast(sum(w) as bigint) as n, {rsql('sum(w * v) / sum(w)', 4)} as mean from b group by 1, 2"""
)
def bootstrap_samples(spark: SparkSession, folder: str) -> DataFrame:
    """Two bootstrap resamples as weights, one pass over the table."""
    rows = load(spark, folder, "orders")
    draws = F.explode(F.array(*[F.struct(F.lit(d).alias("draw"), splits.bootstrap_weight("o_orderkey", d).alias("w")) for d in range(2)]))
    return (
        rows.select(F.col("o_orderstatus").alias("class"), F.col("o_totalprice").alias("v"), draws.alias("d"))
        .groupBy("d.draw", "class")
        .agg(F.sum("d.w").alias("n"), r(F.sum(F.col("d.w") * F.col("v")) / F.sum("d.w"), 4).alias("mean"))
    )


# Ordered series.


@query(
    f"""with {DAILY_SQL}
    select day, position, revenue, {", ".join(f"lag(revenue, {i}) over (order by day) as lag_{i}" for i in range(1, 6))},
    lead(revenue, 63) over (order by day) as target from placed"""
)
def horizon_frame(spark: SparkSession, folder: str) -> DataFrame:
    framed = splits.horizon_frame(daily_revenue(spark, folder), "day", "revenue", 63)
    return framed.select("day", "position", "revenue", *[f"lag_{i}" for i in range(1, 6)], "target")


@query(
    f"""with {DAILY_SQL}
    select day, position - 1 < 2000 as is_train, position - 1 between 2400 - 251 and 2400 as is_forecast from placed"""
)
def horizon_window(spark: SparkSession, folder: str) -> DataFrame:
    placed = ordinal(daily_revenue(spark, folder), "day")
    return splits.horizon_split(placed, 2000, 2400, F.lit(251)).select("day", "is_train", "is_forecast")


@query(
    """select l_returnflag as flag, max_by(revenue, day) as last from (
      select l_returnflag, cast(l_shipdate as date) as day, round(sum(l_extendedprice), 2) as revenue from lineitem group by 1, 2) group by 1"""
)
def forecast_last(spark: SparkSession, folder: str) -> DataFrame:
    """Last value of each ordered series."""
    from loomtab.operators.ranking import last_value

    series = load(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("flag"), F.to_date("l_shipdate").alias("day")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("revenue")
    )
    return last_value(series, "revenue", "day", ["flag"])


@query(
    f"""with {FIXED_SQL}
    select 'bands' as model, cast(null as varchar) as "C", '2' as n_hidden, 'accuracy' as "optimization score function",
      {rsql('avg(cast(y = p as double))')} as "Accuracy" from preds
    union all
    select 'constant', '1', null, 'accuracy', {rsql("avg(cast(y = 'F' as double))")} from preds"""
)
def results_ragged(spark: SparkSession, folder: str) -> DataFrame:
    """Records of different models under one wide layout."""
    rows = fixed_predictions(spark, folder)
    hit = (F.col("y") == F.col("p")).cast("double")
    first = rows.agg(r(F.avg(hit)).alias("Accuracy")).select(F.lit("bands").alias("model"), F.lit("2").alias("n_hidden"), F.lit("accuracy").alias("optimization score function"), "Accuracy")
    second = rows.agg(r(F.avg((F.col("y") == "F").cast("double"))).alias("Accuracy")).select(
        F.lit("constant").alias("model"), F.lit("1").alias("C"), F.lit("accuracy").alias("optimization score function"), "Accuracy"
    )
    stacked = columns.stack_frames([first, second])
    chosen = ["model", "C", "n_hidden", "optimization score function", "Accuracy"]
    return columns.reorder(sinks.arrange_results(stacked), [f"`{c}`" for c in chosen])


@query(
    f"""with {FIXED_SQL}
    select 'bands' as model, 'test' as stage, y || '|' || p as item, 'n' as measure, cast(count(*) as double) as value from preds group by y, p"""
)
def run_log_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A fit's report as rows of the run log."""
    from loomtab.operators.metrics import confusion

    return sinks.run_log(confusion(fixed_predictions(spark, folder), "y", "p"), "bands", "test")
