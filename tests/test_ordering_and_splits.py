from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomtab.functions.hashing import SPAN, key_hash
from loomtab.operators import columns, splits
from loomtab.operators.aggregates import histogram
from loomtab.operators.ordering import add_ranges, ordinal, running_before, shifted
from loomtab.sources.sinks import write_results


@pytest.mark.parametrize("ranges", [1, 3, 16])
@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_equal_pandas(spark, ranges, descending):
    rng = np.random.default_rng(ranges)
    n = 500
    frame = pd.DataFrame({"g": np.where(np.arange(n) < n // 3, 0, rng.integers(0, 4, n)), "o": rng.permutation(n) * 1.5, "v": rng.integers(-5, 9, n)})
    want = frame.sort_values("o", ascending=not descending)
    want["v_before"] = want.groupby("g").v.cumsum() - want.v
    got = running_before(spark.createDataFrame(frame), "o", ["v"], ["g"], descending=descending, ranges=ranges).toPandas()
    merged = got.sort_values("o").reset_index(drop=True)
    assert merged.v_before.tolist() == want.sort_values("o").v_before.tolist()


def test_rows_of_a_null_group_are_kept(spark):
    rows = spark.createDataFrame([(None, 1.0), ("a", 2.0), (None, 3.0), ("a", 4.0)], "g string, o double")
    got = sorted((r["g"] or "", r["o"], r["position"]) for r in ordinal(rows, "o", group=["g"]).collect())
    assert got == [("", 1.0, 1), ("", 3.0, 2), ("a", 2.0, 1), ("a", 4.0, 2)]


def test_ordinal_by_hash_spans_the_table_once(spark):
    rows = spark.range(1000).withColumn("h", key_hash("id"))
    got = ordinal(rows, "h", ties=["id"], span=SPAN).toPandas().sort_values(["h", "id"])
    assert got.position.tolist() == list(range(1, 1001))


def test_ordinal_of_dates(spark):
    rows = spark.range(40).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 40).cast("int")).alias("d"))
    got = ordinal(rows, "d").toPandas().sort_values("d")
    assert got.position.tolist() == list(range(1, 41))


@pytest.mark.parametrize("descending", [False, True])
def test_a_crowded_value_is_cut_by_its_ties(spark, descending):
    rng = np.random.default_rng(8)
    frame = pd.DataFrame({"o": np.where(np.arange(900) % 3 == 0, 5.0, rng.integers(0, 9, 900)), "t": rng.permutation(900)})
    ranged = add_ranges(spark.createDataFrame(frame), "o", ["t"], descending, ranges=8)
    sizes = ranged.groupBy("_range").count().toPandas()["count"]
    assert sizes.max() < 900 / 8 * 2
    got = running_before(
        spark.createDataFrame(frame).withColumn("v", F.lit(1)), "o", ["v"], ties=["t"], descending=descending, ranges=8
    ).toPandas().sort_values(["o", "t"], ascending=[not descending, True])
    assert got.v_before.tolist() == list(range(900))


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_shifted_equals_pandas(spark, block):
    frame = pd.DataFrame({"g": [0] * 60 + [1] * 25, "position": [*range(1, 61), *range(1, 26)], "v": np.arange(85.0)})
    got = shifted(
        spark.createDataFrame(frame), "position", {"back": ("v", -3), "ahead": ("v", 10)}, ["g"], block
    ).toPandas().sort_values(["g", "position"]).reset_index(drop=True)
    assert len(got) == len(frame)
    pd.testing.assert_series_equal(got.back, frame.groupby("g").v.shift(3), check_names=False)
    pd.testing.assert_series_equal(got.ahead, frame.groupby("g").v.shift(-10), check_names=False)


def test_row_range(spark):
    rows = spark.range(100).select((F.col("id") * 37 % 100).alias("o"))
    got = sorted(r["o"] for r in columns.row_range(rows, "o", 10, 25).collect())
    assert got == list(range(10, 25))


@pytest.fixture(scope="module")
def labelled(spark):
    hot = F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 50 == 1, "rare").otherwise("mid")
    return spark.range(997).select("id", hot.alias("y"))


def test_folds_partition_the_rows(labelled):
    even = splits.kfold_even(labelled, "id", 5).groupBy("fold").count().toPandas()
    assert even["count"].sum() == 997 and even["count"].max() - even["count"].min() <= 1
    per = splits.stratified_kfold(labelled, "id", "y", 5).groupBy("y", "fold").count().toPandas()
    assert per["count"].sum() == 997
    assert (per.groupby("y")["count"].max() - per.groupby("y")["count"].min()).max() <= 1


def test_splits_do_not_depend_on_partitioning(labelled):
    one = {r["id"]: r["fold"] for r in splits.stratified_kfold(labelled, "id", "y").collect()}
    other = {r["id"]: r["fold"] for r in splits.stratified_kfold(labelled.repartition(13), "id", "y").collect()}
    assert one == other


def test_exact_split_size(labelled):
    sizes = {r["split"]: r["count"] for r in splits.split_exact(labelled, "id", 0.25).groupBy("split").count().collect()}
    assert sizes == {"test": 250, "train": 747}


def test_dev_split_leaves_test_alone(labelled):
    rows = splits.dev_split(splits.split(labelled, "id"), "id")
    assert rows.filter("(split = 'test') <> (part = 'test')").isEmpty()
    assert {r[0] for r in rows.select("part").distinct().collect()} == {"fit", "dev", "test"}


def test_shuffle_is_a_reproducible_permutation(labelled):
    one = [r["id"] for r in splits.shuffled(labelled, "id", 1).collect()]
    assert one == [r["id"] for r in splits.shuffled(labelled.repartition(5), "id", 1).collect()]
    assert sorted(one) == list(range(997)) and one != sorted(one)


def test_bootstrap_weights_look_poisson(spark):
    rows = spark.range(20000).select(splits.bootstrap_weight("id", 7).alias("w")).toPandas()
    assert rows.w.mean() == pytest.approx(1.0, abs=0.03)
    assert rows.w.var() == pytest.approx(1.0, abs=0.06)


def test_horizon_split(spark):
    rows = splits.horizon_split(spark.range(1, 101).toDF("position"), 60, 99, 9).toPandas()
    assert rows.is_train.sum() == 60
    assert rows[rows.is_forecast].position.tolist() == list(range(91, 101))


def test_histogram_keeps_every_row(spark):
    rows = spark.range(1000).select((F.col("id") * F.col("id")).cast("double").alias("v"))
    got = histogram(rows, "v", 10).toPandas().sort_values("bin")
    want, edges = np.histogram(np.arange(1000.0) ** 2, 10)
    assert got.n.tolist() == want.tolist()
    assert (got.density * (edges[1] - edges[0])).sum() == pytest.approx(1.0)
    flat = histogram(spark.range(5).select(F.lit(2.0).alias("v")), "v", 4).toPandas()
    assert flat.n.tolist() == [5, 0, 0, 0]


def test_text_orders(spark):
    """A text column orders rows as Spark does, nulls first, whatever repeats."""
    names = [None, "", "b", "a", "aa", "é", "z" * 50, "Z"] + [f"common prefix {i:03d}" for i in range(200)] + ["hot"] * 300
    rows = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id long, name string").repartition(5)
    got = [r["id"] for r in ordinal(rows, "name", ["id"]).orderBy("position").collect()]
    assert got == [r["id"] for r in rows.orderBy("name", "id").collect()]
    loose = ordinal(rows, "name").orderBy("position").collect()
    assert [r["name"] for r in loose] == [r["name"] for r in rows.orderBy("name").collect()] and [r["position"] for r in loose] == list(range(1, len(names) + 1))


def test_a_column_of_one_value_is_spread(spark):
    rows = spark.createDataFrame([(i, "same", 1.0) for i in range(400)], "id long, name string, x double")
    for order in ("name", "x"):
        ranges = {r["_range"]: r["count"] for r in add_ranges(rows, order, ranges=8).groupBy("_range").count().collect()}
        assert len(ranges) > 4 and max(ranges.values()) < 200


def test_results_written_in_text_order(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1.0), ("a", 2.0), ("c", 0.5)], "model string, score double")
    write_results(rows, str(tmp_path / "out"), order="model")
    got = spark.read.option("header", True).csv(str(tmp_path / "out")).orderBy("index").collect()
    assert [(r["index"], r["model"]) for r in got] == [("0", "a"), ("1", "b"), ("2", "c")]
