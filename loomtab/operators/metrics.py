"""Classification, ranking and regression metrics.

Class metrics all come from one (truth, prediction, n) table, so the predictions are
read once and reduced before the shuffle; ``by`` scores many candidates or folds in
that same pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.operators.ordering import running_before


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def confusion(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Long confusion table (by..., y, p, n); pairs that never occur are absent."""
    return df.groupBy(*by, F.col(truth).alias("y"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str, prediction: str, classes: Sequence[object]) -> DataFrame:
    """Wide matrix: one row per true class, one column per predicted class, zeros filled.

    Rows without a truth are left out; a truth or prediction that is not in ``classes`` (or missing) raises when the
    matrix is read, so no row goes uncounted.
    """
    spark = df.sparkSession

    def listed(name: str) -> Column:
        odd = F.concat(F.lit(f"{name} is not in classes: "), F.coalesce(F.col(name).cast("string"), F.lit("NULL")))
        return F.when(F.col(name).isin(list(classes)), F.col(name)).otherwise(F.raise_error(odd))

    pairs = confusion(df, truth, prediction).filter(F.col("y").isNotNull())
    cells = pairs.select(listed("y").alias("y"), listed("p").alias("p"), "n").groupBy("y").pivot("p", list(classes)).agg(F.sum("n"))
    rows = spark.createDataFrame([(c,) for c in classes], df.select(F.col(truth).alias("y")).schema)
    return rows.join(F.broadcast(cells), "y", "left").na.fill(0)


def per_class(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts per class from a long confusion table: hits, predicted, support."""
    sides = cells.select(
        *by,
        F.explode(
            F.array(
                F.struct(
                    F.col("y").alias("class"),
                    F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.col("n").alias("support"),
                ),
                F.struct(
                    F.col("p").alias("class"),
                    F.lit(0).cast("bigint").alias("hit"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("support"),
                ),
            )
        ).alias("side"),
    ).select(*by, "side.*")
    return sides.groupBy(*by, "class").agg(
        F.sum("hit").alias("hit"), F.sum("predicted").alias("predicted"), F.sum("support").alias("support")
    )


def _rates(beta: float) -> dict[str, Column]:
    weight = beta * beta
    return {
        "precision": _ratio(F.col("hit"), F.col("predicted")),
        "recall": _ratio(F.col("hit"), F.col("support")),
        "f1": _ratio(
            (1.0 + weight) * F.col("hit"), F.col("predicted") + F.lit(weight) * F.col("support")
        ),
    }


def report_from(cells: DataFrame, by: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    rates = _rates(beta)
    return per_class(cells, by).select(*by, "class", *[e.alias(n) for n, e in rates.items()], "support")


def classification_report(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = (), beta: float = 1.0) -> DataFrame:
    """Per-class rows plus one 'avg / total' row weighted by support."""
    rows = report_from(confusion(df, truth, prediction, by), by, beta)
    rows = rows.withColumn("class", F.col("class").cast("string"))
    average = rows.groupBy(*by).agg(
        *[_ratio(F.sum(F.col(m) * F.col("support")), F.sum("support")).alias(m) for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"),
    )
    return rows.unionByName(average.withColumn("class", F.lit("avg / total")))


def summary(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per group: accuracy, weighted precision/recall/F1, Hamming and zero-one loss, Jaccard, F-beta and Matthews."""
    return summary_from(confusion(df, truth, prediction, by), by)


def summary_from(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    rates = _rates(1.0)
    half, double = _rates(0.5)["f1"], _rates(2.0)["f1"]
    support = F.col("support").cast("double")
    predicted = F.col("predicted").cast("double")
    hit, n = F.sum("hit").cast("double"), F.sum("support").cast("double")

    def weighted(rate: Column) -> Column:
        return F.sum(rate * F.col("support")) / F.sum("support")

    spread = (n * n - F.sum(predicted * predicted)) * (n * n - F.sum(support * support))
    matthews = _ratio(hit * n - F.sum(predicted * support), F.sqrt(F.abs(spread)))
    accuracy = hit / n
    return per_class(cells, by).groupBy(*by).agg(
        accuracy.alias("accuracy"),
        weighted(rates["precision"]).alias("precision"),
        weighted(rates["recall"]).alias("recall"),
        weighted(rates["f1"]).alias("f1"),
        weighted(half).alias("f_half"),
        weighted(double).alias("f_two"),
        (1.0 - accuracy).alias("hamming_loss"),
        (1.0 - accuracy).alias("zero_one_loss"),
        accuracy.alias("jaccard"),
        matthews.alias("matthews"),
    )


def binary_from(cells: DataFrame, positive: object, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall and F1 of the positive class of a two-class problem."""
    cells = cells.withColumn("_y", F.col("y") == F.lit(positive)).withColumn("_p", F.col("p") == F.lit(positive))
    n = F.col("n")

    def count(keep: Column) -> Column:
        return F.sum(F.when(keep, n).otherwise(0))

    hit, claimed, real = count(F.col("_y") & F.col("_p")), count(F.col("_p")), count(F.col("_y"))
    return cells.groupBy(*by).agg(
        _ratio(hit, claimed).alias("precision"),
        _ratio(hit, real).alias("recall"),
        _ratio(2 * hit, claimed + real).alias("f1"),
    )


def accuracy(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Share of rows with a truth whose prediction equals it; a missing prediction is a miss."""
    hit = F.when(F.col(truth).isNotNull(), F.coalesce(F.col(truth) == F.col(prediction), F.lit(False)).cast("double"))
    return df.groupBy(*by).agg(F.avg(hit).alias("accuracy"))


def percent_error(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """Percentage of rows with a truth whose prediction does not equal it; a missing prediction is a miss."""
    miss = F.when(F.col(truth).isNotNull(), F.coalesce(F.col(truth) != F.col(prediction), F.lit(True)).cast("double"))
    return df.groupBy(*by).agg((100.0 * F.avg(miss)).alias("percent_error"))


def log_loss(df: DataFrame, true_probability: str | Column, by: Sequence[str] = (), edge: float = 1e-15) -> DataFrame:
    """Mean negative log of the probability given to the true class."""
    p = F.col(true_probability) if isinstance(true_probability, str) else true_probability
    return df.groupBy(*by).agg((-F.avg(F.log(F.greatest(p, F.lit(edge))))).alias("log_loss"))


def _score_table(df: DataFrame, truth: str, score: str, by: Sequence[str]) -> DataFrame:
    """Positives and negatives per distinct score: ties and hot scores collapse before any sort."""
    positive = F.col(truth).cast("int").cast("bigint")
    return df.groupBy(*by, F.col(score).alias("_score")).agg(
        F.sum(positive).alias("pos"), F.sum(F.lit(1).cast("bigint") - positive).alias("neg")
    )


def roc_auc(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve; tied scores count half. ``truth`` is 0/1."""
    table = _score_table(df, truth, score, by)
    ranked = running_before(table, "_score", ["neg"], group=by, source=df.select(F.col(score).alias("_score")))
    pairs = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0))
    return ranked.groupBy(*by).agg(
        F.try_divide(pairs, F.sum("pos").cast("double") * F.sum("neg").cast("double")).alias("roc_auc")
    )


def average_precision(df: DataFrame, truth: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Step-wise area under precision-recall, tied scores taken together."""
    table = _score_table(df, truth, score, by)
    ranked = running_before(
        table, "_score", ["pos", "neg"], group=by, descending=True, source=df.select(F.col(score).alias("_score"))
    )
    found = F.col("pos_before") + F.col("pos")
    seen = found + F.col("neg_before") + F.col("neg")
    return ranked.groupBy(*by).agg(
        F.try_divide(F.sum(F.col("pos") * found / seen), F.sum("pos").cast("double")).alias("average_precision")
    )


def regression(df: DataFrame, truth: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """r2, explained variance, MAE and MSE in one pass, all over the rows with a truth and a prediction."""
    miss = F.col(truth).cast("double") - F.col(prediction).cast("double")
    y = F.when(miss.isNotNull(), F.col(truth).cast("double"))
    square = F.avg(miss * miss)
    return df.groupBy(*by).agg(
        (1.0 - F.try_divide(square, F.var_pop(y))).alias("r2"),
        (1.0 - F.try_divide(F.var_pop(miss), F.var_pop(y))).alias("explained_variance"),
        F.avg(F.abs(miss)).alias("mae"),
        square.alias("mse"),
    )
