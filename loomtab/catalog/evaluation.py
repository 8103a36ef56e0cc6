"""Queries over metrics, histograms, fold summaries, candidate scoring and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.catalog.common import (
    FIXED_SQL, SCORED_SQL, fixed_predictions, hsql, query, r, rsql, scored_labels,
)
from loomtab.functions import maths
from loomtab.functions.distance import distance
from loomtab.operators import aggregates, metrics, ranking, splits
from loomtab.session import load


@query(f"with {FIXED_SQL} select y, p, cast(count(*) as bigint) as n from preds group by 1, 2")
def metric_confusion(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion(fixed_predictions(spark, folder), "y", "p")


@query(
    f"""with {FIXED_SQL} select y, cast(sum(cast(p = 'F' as int)) as bigint) as "F", cast(sum(cast(p = 'O' as int)) as bigint) as "O",
    cast(sum(cast(p = 'P' as int)) as bigint) as "P" from preds group by 1"""
)
def metric_confusion_matrix(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.confusion_matrix(fixed_predictions(spark, folder), "y", "p", ["F", "O", "P"])


PER_CLASS_SQL = f"""{FIXED_SQL},
classes as (select distinct y as class from preds union select distinct p from preds),
c as (select class,
        (select count(*) from preds where y = class and p = class) as hit,
        (select count(*) from preds where p = class) as predicted,
        (select count(*) from preds where y = class) as support from classes),
rates as (select class, coalesce(hit / nullif(predicted, 0), 0) as precision, coalesce(hit / nullif(support, 0), 0) as recall,
  coalesce(2 * hit / nullif(predicted + support, 0), 0) as f1, support from c)"""


@query(
    f"""with {PER_CLASS_SQL}
    select class, {rsql('precision')} as precision, {rsql('recall')} as recall, {rsql('f1')} as f1, cast(support as bigint) as support from rates
    union all select 'avg / total', {rsql('sum(precision * support) / sum(support)')}, {rsql('sum(recall * support) / sum(support)')},
    {rsql('sum(f1 * support) / sum(support)')}, cast(sum(support) as bigint) from rates"""
)
def metric_report(spark: SparkSession, folder: str) -> DataFrame:
    rows = metrics.classification_report(fixed_predictions(spark, folder), "y", "p")
    return rows.select("class", r("precision").alias("precision"), r("recall").alias("recall"), r("f1").alias("f1"), "support")


def _beta_sql(beta: float) -> str:
    b = beta * beta
    return f"sum((1 + {b}) * hit / nullif(predicted + {b} * support, 0) * support) / sum(support)"


SUMMARY_SQL = f"""with {PER_CLASS_SQL},
t as (select sum(hit) as hit, sum(support) as n, sum(predicted * support) as ps, sum(predicted * predicted) as pp, sum(support * support) as ss from c)
select {rsql('hit / n')} as accuracy,
  (select {rsql('sum(precision * support) / sum(support)')} from rates) as precision,
  (select {rsql('sum(recall * support) / sum(support)')} from rates) as recall,
  (select {rsql('sum(f1 * support) / sum(support)')} from rates) as f1,
  (select {rsql(_beta_sql(0.5))} from c) as f_half,
  (select {rsql(_beta_sql(2.0))} from c) as f_two,
  {rsql('1 - hit / n')} as hamming_loss, {rsql('1 - hit / n')} as zero_one_loss, {rsql('hit / n')} as jaccard,
  {rsql('(hit * n - ps) / sqrt(cast(n * n - pp as double) * cast(n * n - ss as double))')} as matthews
from t"""


@query(SUMMARY_SQL)
def metric_summary(spark: SparkSession, folder: str) -> DataFrame:
    row = metrics.summary(fixed_predictions(spark, folder), "y", "p")
    return row.select(*[r(c).alias(c) for c in row.columns])


@query(
    f"""with {FIXED_SQL}, b as (select y = 'F' as y, p = 'F' as p from preds)
    select {rsql("sum(cast(y and p as int)) / sum(cast(p as int))")} as precision, {rsql("sum(cast(y and p as int)) / sum(cast(y as int))")} as recall,
    {rsql("2 * sum(cast(y and p as int)) / (sum(cast(y as int)) + sum(cast(p as int)))")} as f1 from b"""
)
def metric_binary(spark: SparkSession, folder: str) -> DataFrame:
    """Precision, recall and F1 of one positive class."""
    cells = metrics.confusion(fixed_predictions(spark, folder), "y", "p")
    row = metrics.binary_from(cells, "F")
    return row.select(*[r(c).alias(c) for c in row.columns])


@query(f"with {SCORED_SQL} select {rsql('-avg(ln(greatest(case when y = 1 then score else 1 - score end, 1e-15)))')} as log_loss from scored")
def metric_logloss(spark: SparkSession, folder: str) -> DataFrame:
    p = F.when(F.col("y") == 1, F.col("score")).otherwise(1.0 - F.col("score"))
    return metrics.log_loss(scored_labels(spark, folder), p).select(r("log_loss").alias("log_loss"))


_AUC_SQL = """t as (select {by} score, sum(y) as pos, sum(1 - y) as neg from {table} group by all),
w as (select *, coalesce(sum(neg) over ({part} order by score rows between unbounded preceding and 1 preceding), 0) as below from t)
select {by} {value} as roc_auc from w {group}"""


@query(
    f"with {SCORED_SQL}, "
    + _AUC_SQL.format(by="", table="scored", part="", value=rsql("sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))"), group="")
)
def metric_auc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.roc_auc(scored_labels(spark, folder), "y", "score").select(r("roc_auc").alias("roc_auc"))


@query(
    "with scored as (select l_returnflag as flag, cast(l_linestatus = 'F' as int) as y, l_extendedprice * (1 - l_discount) as score from lineitem), "
    + _AUC_SQL.format(
        by="flag,", table="scored", part="partition by flag", value=rsql("sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg))"), group="group by flag"
    )
)
def metric_auc_by_group(spark: SparkSession, folder: str) -> DataFrame:
    """One area per group over the line items, with no group held in one task."""
    rows = load(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("flag"), (F.col("l_linestatus") == "F").cast("int").alias("y"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"),
    )
    return metrics.roc_auc(rows, "y", "score", ["flag"]).select("flag", r("roc_auc").alias("roc_auc"))


@query(
    f"""with {SCORED_SQL}, t as (select score, sum(y) as pos, count(*) as n from scored group by 1),
    w as (select pos, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as seen from t)
    select {rsql('sum(pos * tp / seen) / sum(pos)')} as average_precision from w"""
)
def metric_ap(spark: SparkSession, folder: str) -> DataFrame:
    row = metrics.average_precision(scored_labels(spark, folder), "y", "score")
    return row.select(r("average_precision").alias("average_precision"))


@query(
    f"""with c as (select cast(sum(cast(quality = 1 and toxic = 1 as int)) as double) as tp, cast(sum(cast(quality = 0 and toxic = 0 as int)) as double) as tn,
      cast(sum(cast(quality = 0 and toxic = 1 as int)) as double) as fp, cast(sum(cast(quality = 1 and toxic = 0 as int)) as double) as fn from labels)
    select {rsql('(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))')} as matthews from c"""
)
def metric_mcc(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.summary(load(spark, folder, "labels"), "quality", "toxic").select(r("matthews").alias("matthews"))


@query(
    f"""with t as (select l_extendedprice as y, 1500 * l_quantity as p, l_returnflag as flag from lineitem)
    select flag, {rsql('1 - avg((y - p) * (y - p)) / var_pop(y)')} as r2, {rsql('1 - var_pop(y - p) / var_pop(y)')} as explained_variance,
    {rsql('avg(abs(y - p))', 3)} as mae, {rsql('avg((y - p) * (y - p))', 0)} as mse from t group by 1"""
)
def metric_regression(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "lineitem").select(F.col("l_extendedprice").alias("y"), (1500 * F.col("l_quantity")).alias("p"), F.col("l_returnflag").alias("flag"))
    out = metrics.regression(rows, "y", "p", ["flag"])
    return out.select("flag", r("r2").alias("r2"), r("explained_variance").alias("explained_variance"), r("mae", 3).alias("mae"), r("mse", 0).alias("mse"))


@query(
    f"""with {FIXED_SQL} select cast({hsql('key', 2)} % 5 as int) as fold, {rsql('100 * avg(cast(y <> p as double))')} as percent_error from preds group by 1"""
)
def metric_percent_error(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.kfold(fixed_predictions(spark, folder), "key")
    return metrics.percent_error(rows, "y", "p", ["fold"]).select("fold", r("percent_error").alias("percent_error"))


@query(
    f"""with {SCORED_SQL}, c as (select y, score, least(greatest(score, 1e-8), 1 - 1e-8) as q from scored)
    select {rsql('avg(-(y * ln(q) + (1 - y) * ln(1 - q)))')} as log_loss, {rsql('avg((y - score) * (y - score) / 2)')} as half_square from c"""
)
def metric_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Clipped binary log loss and half mean square, as used while training."""
    y, p = F.col("y").cast("double"), F.col("score")
    return scored_labels(spark, folder).agg(
        r(F.avg(maths.binary_log_loss(y, p))).alias("log_loss"), r(F.avg(maths.half_square_loss(y, p))).alias("half_square")
    )


@query("select o_orderpriority as class, cast(count(*) as bigint) as n from orders group by 1")
def class_counts(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.class_counts(load(spark, folder, "orders"), "o_orderpriority")


@query(
    f"""with c as (select quality as class, count(*) as n from labels group by 1), t as (select sum(n) as total, count(*) as k from c)
    select class, cast(n as bigint) as n, {rsql('total / (k * n)')} as weight from c, t"""
)
def class_weights(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.class_weights(load(spark, folder, "labels"), "quality").select("class", "n", r("weight").alias("weight"))


@query(
    f"""with s as (select min(l_extendedprice) as lo, max(l_extendedprice) as hi, count(*) as total from lineitem),
    b as (select cast(least(floor((l_extendedprice - lo) / ((hi - lo) / 100)), 99) as int) as bin, count(*) as n from lineitem, s group by 1)
    select cast(g.bin as int) as bin, cast(coalesce(n, 0) as bigint) as n, {rsql('coalesce(n, 0) / total / ((hi - lo) / 100)', 12)} as density
    from (select unnest(range(100)) as bin) g left join b using (bin), s"""
)
def histogram_100(spark: SparkSession, folder: str) -> DataFrame:
    rows = aggregates.histogram(load(spark, folder, "lineitem"), "l_extendedprice")
    return rows.select("bin", "n", r("density", 12).alias("density"))


@query(
    f"""with {FIXED_SQL}, f as (select cast({hsql('key', 2)} % 5 as int) as fold, avg(cast(y = p as double)) as score from preds group by 1)
    select {rsql('avg(score)')} as mean, {rsql('stddev_samp(score) / sqrt(count(*))')} as sem, {rsql('stddev_pop(score)')} as std from f"""
)
def fold_summary(spark: SparkSession, folder: str) -> DataFrame:
    rows = splits.kfold(fixed_predictions(spark, folder), "key")
    folds = metrics.accuracy(rows, "y", "p", ["fold"])
    out = aggregates.fold_summary(folds, "accuracy")
    return out.select(*[r(c).alias(c) for c in out.columns])


# Candidate scoring: a grid of two price thresholds, every candidate scored on every fold in one pass.

_LOW, _HIGH = [80000, 120000, 160000, 200000], [240000, 300000, 360000]
_GRID_SQL = ", ".join(f"({i * len(_HIGH) + j}, {a}, {b})" for i, a in enumerate(_LOW) for j, b in enumerate(_HIGH))
_SCORES_SQL = f"""grid as (select * from (values {_GRID_SQL}) t(candidate, low, high)),
cells as (select candidate, cast({hsql('o_orderkey', 2)} % 5 as int) as fold, o_orderstatus as y,
  case when o_totalprice < low then 'F' when o_totalprice < high then 'O' else 'P' end as p, count(*) as n
  from orders, grid group by all),
classes as (select unnest(['F', 'O', 'P']) as class),
c as (select candidate, fold, class, sum(case when y = class and p = class then n else 0 end) as hit,
  sum(case when p = class then n else 0 end) as predicted, sum(case when y = class then n else 0 end) as support
  from cells, classes group by all),
s as (select candidate, fold, sum(hit) / sum(support) as accuracy,
  sum(coalesce(hit / nullif(predicted, 0), 0) * support) / sum(support) as precision,
  sum(coalesce(2 * hit / nullif(predicted + support, 0), 0) * support) / sum(support) as f1 from c group by all)"""


def _threshold_scores(spark: SparkSession, folder: str) -> DataFrame:
    from loomtab.plans.grids import grid_table

    grid = grid_table(spark, "bands", {"low": _LOW, "high": _HIGH})
    options = F.array(
        *[
            F.struct(F.lit(c["candidate"]).cast("bigint").alias("candidate"), F.lit(float(c["params"]["low"])).alias("low"), F.lit(float(c["params"]["high"])).alias("high"))
            for c in grid.orderBy("candidate").collect()
        ]
    )
    rows = splits.kfold(load(spark, folder, "orders"), "o_orderkey").select(
        "fold", F.col("o_orderstatus").alias("y"), F.col("o_totalprice").alias("price"), F.explode(options).alias("o")
    )
    price = F.col("price")
    p = F.when(price < F.col("o.low"), "F").when(price < F.col("o.high"), "O").otherwise("P")
    by = ["candidate", "fold"]
    return metrics.summary(rows.select("fold", "y", F.col("o.candidate").alias("candidate"), p.alias("p")), "y", "p", by)


@query(
    f"""with {_SCORES_SQL}
    select cast(candidate as bigint) as candidate, fold, {rsql('accuracy')} as accuracy, {rsql('precision')} as precision, {rsql('f1')} as f1 from s"""
)
def search_objectives(spark: SparkSession, folder: str) -> DataFrame:
    """Every candidate on every fold, all objectives from one confusion table."""
    scores = _threshold_scores(spark, folder)
    return scores.select("candidate", "fold", *[r(c).alias(c) for c in ("accuracy", "precision", "f1")])


@query(
    f"""with {_SCORES_SQL}, m as (select candidate, avg(accuracy) as mean, stddev_pop(accuracy) as std from s group by 1)
    select cast(candidate as bigint) as candidate, {rsql('mean')} as mean, {rsql('std')} as std,
    cast(row_number() over (order by round(mean, 12) desc, candidate) as int) as rank from m order by round(mean, 12) desc, candidate limit 3"""
)
def search_top_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The three best candidates by mean fold score."""
    scores = aggregates.fold_summary(_threshold_scores(spark, folder), "accuracy", ["candidate"])
    keyed = scores.withColumn("score", F.round("mean", 12))
    top = ranking.top_candidates(keyed, 3, "score")
    return top.select("candidate", r("mean").alias("mean"), r("std").alias("std"), "rank")


@query(
    f"""with {_SCORES_SQL}, m as (select candidate, fold, accuracy as score from s),
    k as (select fold, candidate, score, row_number() over (partition by fold order by score desc, candidate) as rn from m)
    select fold, cast(candidate as bigint) as candidate, {rsql('score')} as score from k where rn = 1"""
)
def best_per_fold(spark: SparkSession, folder: str) -> DataFrame:
    """Winner of each fold, smallest candidate on ties."""
    scores = _threshold_scores(spark, folder)
    out = ranking.best_model(scores.withColumnRenamed("accuracy", "score"), by=["fold"])
    return out.select("fold", "candidate", r("score").alias("score"))


# Scalar functions.


@query(
    f"""with x as (select l_orderkey as key, l_linenumber as line, l_partkey as part, l_suppkey as supp, l_quantity as q, (l_quantity - 25) / 10 as v, l_discount * 10 as w,
      l_tax * 10 as u from lineitem)
    select key, line, part, supp, q, {rsql('(exp(v) - exp(-v)) / (exp(v) + exp(-v))')} as th, {rsql('1 / (1 + exp(-v))')} as lg,
    {rsql('1 - power((exp(v) - exp(-v)) / (exp(v) + exp(-v)), 2)')} as th_slope, {rsql('(1 / (1 + exp(-v))) * (1 - 1 / (1 + exp(-v)))')} as lg_slope,
    {rsql('least(greatest(v, -1.0), 1.0)')} as clipped, {rsql('v')} as same,
    {rsql('exp(w) / (exp(v) + exp(w) + exp(u))')} as soft, {rsql('ln(exp(w) / (exp(v) + exp(w) + exp(u)))')} as log_soft,
    cast(case when v >= w and v >= u then 0 when w >= u then 1 else 2 end as int) as best, {rsql('0.5 / power(q, 0.25)')} as step
    from x"""
)
def activations(spark: SparkSession, folder: str) -> DataFrame:
    """Activations, their slopes, softmax, log probability, clip, arg-max and step decay per line item."""
    v = (F.col("l_quantity") - 25) / 10
    scores = F.array(v, F.col("l_discount") * 10, F.col("l_tax") * 10)
    rows = load(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").alias("q"), v.alias("v"), scores.alias("z"),
    )
    x, z = F.col("v"), F.col("z")
    soft = maths.softmax(z)
    return rows.select(
        "key", "line", "part", "supp", "q", r(maths.tanh(x)).alias("th"), r(maths.logistic(x)).alias("lg"),
        r(maths.tanh_slope(maths.tanh(x))).alias("th_slope"), r(maths.logistic_slope(maths.logistic(x))).alias("lg_slope"),
        r(maths.clip(x, -1.0, 1.0)).alias("clipped"), r(maths.identity(x)).alias("same"), r(soft[1]).alias("soft"),
        r(maths.log_probabilities(soft)[1]).alias("log_soft"), maths.arg_max(z).alias("best"), r(maths.step_size(0.5, F.col("q"), 0.25)).alias("step"),
    )


_GAPS = ["abs(l_quantity - 25)", "abs(l_discount * 100 - 5)", "abs(l_tax * 100 - 4)"]


@query(
    f"""select l_returnflag as flag, {rsql('avg(sqrt(' + ' + '.join(f'{g} * {g}' for g in _GAPS) + '))')} as euclidean,
    {rsql('avg(' + ' + '.join(_GAPS) + ')')} as manhattan, {rsql('avg(greatest(' + ', '.join(_GAPS) + '))')} as chebyshev,
    {rsql('avg(power(' + ' + '.join(f'power({g}, 3)' for g in _GAPS) + ', 1.0 / 3))')} as minkowski from lineitem group by 1"""
)
def distances(spark: SparkSession, folder: str) -> DataFrame:
    """The four distances of every line item to a fixed point, averaged."""
    point = F.array(F.lit(25.0), F.lit(5.0), F.lit(4.0))
    x = F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100)
    return load(spark, folder, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        *[r(F.avg(distance(x, point, m, 3.0))).alias(m) for m in ("euclidean", "manhattan", "chebyshev", "minkowski")]
    )


@query(
    """select event_id, replace(lower(event_type), 'r', '_') as name, substr(event_type, 1, 3) as prefix,
    left(event_type, length(event_type) - 2) as trimmed from events"""
)
def strings(spark: SparkSession, folder: str) -> DataFrame:
    """Replace, lower, prefix and dropping the last two characters."""
    kind = F.col("event_type")
    return load(spark, folder, "events").select(
        "event_id", F.replace(F.lower(kind), F.lit("r"), F.lit("_")).alias("name"), F.substring(kind, 1, 3).alias("prefix"),
        F.left(kind, F.length(kind) - 2).alias("trimmed"),
    )


@query(
    """select p_partkey, k, power(10.0, cast(e as double)) as c from part, unnest(range(10, 10 + p_size, 4)) as t(k), unnest(range(-1, 2)) as u(e)"""
)
def value_ranges(spark: SparkSession, folder: str) -> DataFrame:
    """Arithmetic and geometric candidate ranges, their length given per row."""
    from loomtab.functions.ranges import geometric

    ks = F.sequence(F.lit(10).cast("bigint"), F.col("p_size").cast("bigint") + 9, F.lit(4).cast("bigint"))
    rows = load(spark, folder, "part").select("p_partkey", F.explode(ks).alias("k"))
    return rows.select("p_partkey", "k", F.explode(geometric(10, -1, 2)).alias("c"))
