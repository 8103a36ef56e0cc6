from __future__ import annotations

import math

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from loomtab.models.simple import NearestCentroid
from loomtab.operators import columns
from loomtab.operators.aggregates import modes, value_counts
from loomtab.operators.prepare import TablePrep, from_one_of_many, indicators, indicators_long, one_of_many
from loomtab.sources import tables


def test_names(spark):
    assert columns.normalize_names(spark.range(1).toDF("Exit Status")).columns == ["exit_status"]
    with pytest.raises(ValueError, match="collide"):
        columns.normalize_names(spark.createDataFrame([(1, 2)], "`A b` int, a_b int"))


def test_label_is_last_column_or_named(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert columns.pop_label(df) == (["a", "b"], "c")
    assert columns.pop_label(df, "a") == (["b", "c"], "a")
    with pytest.raises(ValueError):
        columns.pop_label(df, "z")


def test_recode_chain_and_all_columns(spark):
    df = spark.createDataFrame([("Trans", "Trans"), ("Drop", "x"), ("Grad", "Grad"), (None, "Drop")], "y string, other string")
    steps = [("Trans", "Drop"), ("Drop", 0), ("Grad", 1)]
    out = columns.recode(df, steps, "y", to="int").collect()
    assert [r["y"] for r in out] == [0, 0, 1, None]
    assert [r["other"] for r in out] == ["Trans", "x", "Grad", "Drop"]
    assert [r["other"] for r in columns.recode(df, steps, "*").collect()] == ["0", "x", "1", "0"]


def test_clean_inf_and_cast(spark):
    df = spark.createDataFrame([(float("inf"), "1.5"), (float("nan"), "x"), (-float("inf"), "2"), (1.0, None)], "a double, b string")
    assert [r["a"] for r in columns.clean_inf(df).collect()] == [None, None, None, 1.0]
    assert [r["b"] for r in columns.cast_all(df, "float", ["b"]).collect()] == [1.5, None, 2.0, None]


def test_align_columns(spark):
    left, right = spark.createDataFrame([(1, 2)], "b int, a int"), spark.createDataFrame([(3,)], "c int")
    one, two = columns.align_columns(left, right)
    assert one.columns == two.columns == ["a", "b", "c"]
    assert tuple(one.first()) == (2, 1, 0) and tuple(two.first()) == (0, 0, 3)


def test_csv_reader(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("Name X,Score\na,1.5\nb,NA\n,NaN\n")
    df = tables.read_table(spark, str(path))
    assert df.columns == ["name_x", "score"]
    assert dict(df.dtypes)["score"] == "double"
    assert sorted(((r[0] or "", r[1]) for r in df.collect())) == [("", None), ("a", 1.5), ("b", None)]


ROWS = [
    (1, "train", 1.0, "b", 3), (2, "train", None, "a", 3), (3, "train", 5.0, None, 3), (4, "train", 3.0, "b", 3),
    (5, "train", 7.0, "a", 3), (6, "test", None, None, 9), (7, "test", 11.0, "z", 4),
]


@pytest.fixture()
def frame(spark):
    return spark.createDataFrame(ROWS, "key int, split string, num double, cat string, whole int")


def prep(**options):
    return TablePrep(keyCols=["key", "split"], splitCol="split", **options)


def test_statistics_come_from_train_only(frame):
    model = prep().fit(frame)
    out = {r["key"]: r for r in model.impute(frame).collect()}
    assert out[6]["num"] == pytest.approx(4.0)
    assert out[6]["cat"] == "a"  # tie between a and b goes to the smaller
    wide = {r["key"]: r for r in model.widen(frame).collect()}
    assert wide[1]["num"] == 0.0 and wide[5]["num"] == 1.0
    assert wide[7]["num"] == pytest.approx((11 - 1) / 6)
    assert wide[7]["whole"] == 0.0  # constant on the train rows


@pytest.mark.parametrize("fill", ["mean", "mode", "zero"])
@pytest.mark.parametrize("scale", ["symmetric", "unit", "standard"])
def test_scale_statistics_are_those_of_the_filled_column(frame, fill, scale):
    model = prep(numericFill=fill, scale=scale).fit(frame)
    filled = [r["num"] for r in model.impute(frame).filter("split = 'train'").collect()]
    mean, low, high = sum(filled) / len(filled), min(filled), max(filled)
    std = math.sqrt(sum((v - mean) ** 2 for v in filled) / len(filled))
    want = {
        "symmetric": lambda v: (2 * v - high - low) / (high - low),
        "unit": lambda v: (v - low) / (high - low),
        "standard": lambda v: (v - mean) / std,
    }[scale]
    got = [r["num"] for r in model.widen(frame).filter("split = 'train'").collect()]
    assert got == pytest.approx([want(v) for v in filled])


def test_all_missing_column(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "key int, v double")
    out = TablePrep(keyCols=["key"]).fit(df).widen(df).collect()
    assert [r["v"] for r in out] == [0.0, 0.0]


def test_drop_rules(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, "c", "z"), (4, None, "x")], "key int, p string, q string")
    assert indicators(df, ["p", "q"], ["key"]).columns == ["key", "p_a", "p_b", "q_x", "q_y"]
    assert indicators(df, ["p", "q"], ["key"], drop="first_only").columns == ["key", "p_a", "q_x", "q_y"]
    assert indicators(df, ["p"], ["key"], drop="none").columns == ["key", "p_a", "p_b", "p_c"]
    row = indicators(df, ["p"], ["key"], drop="none").filter("key = 4").first()
    assert (row["p_a"], row["p_b"], row["p_c"]) == (0, 0, 0)
    assert indicators_long(df, ["p", "q"], ["key"]).count() == 7


def test_levels_of_the_test_cohort_are_optional(frame):
    assert "cat_b" not in prep().fit(frame).widen(frame).columns
    assert {"cat_a", "cat_b"} <= set(prep(levelsFrom="all").fit(frame).widen(frame).columns)


def test_too_many_levels_is_an_error_not_a_cut(spark):
    df = spark.range(50).select("id", F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError, match="too many levels"):
        TablePrep(keyCols=["id"], maxLevels=10).fit(df)


def test_bad_parameter_is_named(frame):
    with pytest.raises(ValueError, match="numericFill"):
        prep(numericFill="median").fit(frame)


def test_integers_can_be_left_out(frame):
    assert "whole" not in prep(integers=False).fit(frame).widen(frame).columns


def test_pipeline_saves_and_loads(frame, tmp_path):
    labelled = frame.withColumn("y", (F.col("key") % 2).cast("int"))
    pipe = Pipeline(stages=[TablePrep(keyCols=["key", "split", "y"], splitCol="split"), NearestCentroid()])
    model = pipe.fit(labelled)
    model.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model"))
    assert again.transform(labelled).collect() == model.transform(labelled).collect()


def test_modes_and_codes(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 10.0), ("a", 2.0), ("b", 10.0), (None, 9.0)], "s string, v double")
    assert modes(value_counts(df, ["s"])).first()["mode"] == "a"
    assert modes(value_counts(df, ["v"], "double")).first()["mode"] == 2.0
    coded = df.select("s", one_of_many(F.col("s"), ["b", "a"]).alias("c"))
    back = coded.select("s", "c", from_one_of_many(F.col("c"), ["b", "a"]).alias("t")).collect()
    assert all(r["s"] == r["t"] for r in back) and back[0]["c"] == [0, 1]
