"""Feature preparation as one Estimator: fill, encode, rescale, assemble.

``fit`` reads the rows twice at most: one aggregate for all numeric columns and one
value count for all text columns. ``transform`` is a projection of literals, so
it needs no join, works on streams, and never looks at the rows it scores.
"""

from __future__ import annotations

import json
import math
from typing import Any

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtab.operators.aggregates import modes, value_counts
from loomtab.operators.columns import categorical_columns, finite, numeric_columns

FILLS = ("mean", "mode", "zero", "none")
SCALES = ("symmetric", "unit", "standard", "standard_unit", "none")
DROPS = ("last", "none", "first_only")


class _PrepParams(Params):
    keyCols = Param(Params._dummy(), "keyCols", "columns carried through untouched", TypeConverters.toListString)
    splitCol = Param(Params._dummy(), "splitCol", "column whose value 'train' marks the rows to fit on; '' fits on all", TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "array<double> feature column", TypeConverters.toString)
    numericFill = Param(Params._dummy(), "numericFill", "mean, mode, zero or none", TypeConverters.toString)
    textFill = Param(Params._dummy(), "textFill", "mode or none", TypeConverters.toString)
    scale = Param(Params._dummy(), "scale", "symmetric, unit, standard, standard_unit or none", TypeConverters.toString)
    drop = Param(Params._dummy(), "drop", "indicator kept out per column: last, none, first_only", TypeConverters.toString)
    integers = Param(Params._dummy(), "integers", "keep integer columns", TypeConverters.toBoolean)
    maxLevels = Param(Params._dummy(), "maxLevels", "largest number of levels that becomes columns", TypeConverters.toInt)
    levelsFrom = Param(Params._dummy(), "levelsFrom", "rows whose levels become columns: train or all", TypeConverters.toString)


class TablePrep(Estimator, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    @keyword_only
    def __init__(
        self,
        keyCols: list[str] = [],
        splitCol: str = "",
        outputCol: str = "features",
        numericFill: str = "mean",
        textFill: str = "mode",
        scale: str = "unit",
        drop: str = "last",
        integers: bool = True,
        maxLevels: int = 1000,
        levelsFrom: str = "train",
    ):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(
            keyCols=[], splitCol="", outputCol="features", numericFill="mean", textFill="mode",
            scale="unit", drop="last", integers=True, maxLevels=1000, levelsFrom="train",
        )

    def _fit(self, df: DataFrame) -> PrepModel:
        get = self.getOrDefault
        for name, allowed in (("numericFill", FILLS), ("textFill", ("mode", "none")), ("scale", SCALES),
                              ("drop", DROPS), ("levelsFrom", ("train", "all"))):
            if get(name) not in allowed:
                raise ValueError(f"{name}={get(name)!r}: choose one of {allowed}")
        carried = set(get("keyCols")) | ({get("splitCol")} - {""})
        numeric = [c for c in numeric_columns(df, get("integers")) if c not in carried]
        text = [c for c in categorical_columns(df) if c not in carried]
        fits = F.col(get("splitCol")) == "train" if get("splitCol") else F.lit(True)
        train = df.filter(fits)
        state = {
            "numeric": self._numeric_state(train, numeric),
            "text": self._text_state(df, fits, text),
            "carried": [c for c in df.columns if c in carried],
        }
        model = PrepModel(state=json.dumps(state))
        return self._copyValues(model)

    def _numeric_state(self, train: DataFrame, names: list[str]) -> list[dict[str, Any]]:
        if not names:
            return []
        parts = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(names):
            value = finite(F.col(c).cast("double"))
            parts += [
                F.count(value).alias(f"n{i}"), F.avg(value).alias(f"m{i}"), F.var_pop(value).alias(f"v{i}"),
                F.min(value).alias(f"lo{i}"), F.max(value).alias(f"hi{i}"),
            ]
        row = train.agg(*parts).first()
        strategy = self.getOrDefault("numericFill")
        fills: dict[str, float] = {}
        if strategy == "mode":
            fills = {r["column"]: r["mode"] for r in modes(value_counts(train, names, "double")).collect()}
        states = []
        for i, c in enumerate(names):
            present, mean = row[f"n{i}"], row[f"m{i}"] or 0.0
            missing = row["rows"] - present
            fill = {"mean": mean, "zero": 0.0, "none": None}.get(strategy, fills.get(c, 0.0))
            states.append({"name": c, "fill": fill} | _after_fill(row, i, present, missing, mean, fill))
        return states

    def _text_state(self, df: DataFrame, fits: Column, names: list[str]) -> list[dict[str, Any]]:
        if not names:
            return []
        rows = df if self.getOrDefault("levelsFrom") == "all" else df.filter(fits)
        # One pass counts every value on the train rows and on all rows; the levels, their number and the modes follow.
        counts = value_counts(rows, names, weight=fits.cast("bigint")).persist()
        try:
            seen = F.col("weight") > 0 if self.getOrDefault("levelsFrom") == "train" else F.lit(True)
            facts = counts.groupBy("column").agg(
                F.count_if(seen).alias("levels"),
                F.min_by("value", F.when(F.col("weight") > 0, F.struct(-F.col("weight"), F.col("value")))).alias("mode"),
            )
            found = {r["column"]: r for r in facts.collect()}
            wide = {c: r["levels"] for c, r in found.items() if r["levels"] > self.getOrDefault("maxLevels")}
            if wide:
                raise ValueError(
                    f"too many levels for one column each: {wide}; leave these columns out of the frame and encode "
                    "them with indicators_long, which has no limit, or raise maxLevels"
                )
            levels: dict[str, list[str]] = {c: [] for c in names}
            for r in counts.filter(seen).select("column", "value").collect():
                levels[r["column"]].append(r["value"])
        finally:
            counts.unpersist()
        fills = {c: r["mode"] for c, r in found.items()} if self.getOrDefault("textFill") == "mode" else {}
        states = []
        for position, c in enumerate(names):
            known = sorted(levels[c])
            states.append({"name": c, "fill": fills.get(c), "levels": kept_levels(known, self.getOrDefault("drop"), position)})
        return states


def kept_levels(levels: list[str], drop: str, position: int) -> list[str]:
    """Levels that become columns. 'first_only' keeps one level of the first column and drops the last of the others."""
    if drop == "none":
        return levels
    if drop == "first_only" and position == 0:
        return levels[:1]
    return levels[:-1]


def _after_fill(row: Any, i: int, present: int, missing: int, mean: float, fill: float | None) -> dict[str, float]:
    """Statistics of the column once its missing values hold ``fill``, without a second pass."""
    spread = row[f"v{i}"] or 0.0
    low, high = row[f"lo{i}"], row[f"hi{i}"]
    if missing and fill is not None:
        total = present + missing
        center = (present * mean + missing * fill) / total
        spread = (present * (spread + (mean - center) ** 2) + missing * (fill - center) ** 2) / total
        mean = center
        low = fill if low is None else min(low, fill)
        high = fill if high is None else max(high, fill)
    return {"mean": mean, "std": math.sqrt(spread), "low": low or 0.0, "high": high or 0.0}


def scaled(value: Column, low: float, high: float, mean: float, std: float, how: str) -> Column:
    """Rescaled value; a constant column and a missing value both give 0."""
    if how == "none":
        return value
    if how == "standard":
        result = (value - F.lit(mean)) / F.lit(std) if std else F.lit(0.0)
    elif high == low:
        result = F.lit(0.0)
    elif how == "symmetric":
        result = (2.0 * value - F.lit(high) - F.lit(low)) / F.lit(high - low)
    else:
        result = (value - F.lit(low)) / F.lit(high - low)
    return F.coalesce(result, F.lit(0.0))


class PrepModel(Model, _PrepParams, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted statistics as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, state: str = "{}"):
        super().__init__()
        self._setDefault(
            keyCols=[], splitCol="", outputCol="features", numericFill="mean", textFill="mode",
            scale="unit", drop="last", integers=True, maxLevels=1000, levelsFrom="train",
        )
        self._set(**self._input_kwargs)

    @property
    def fitted(self) -> dict[str, Any]:
        return json.loads(self.getOrDefault("state"))

    def filled(self) -> dict[str, Column]:
        """Name -> expression with missing values filled, before encoding and scaling."""
        out: dict[str, Column] = {}
        for s in self.fitted["numeric"]:
            value = finite(F.col(s["name"]).cast("double"))
            out[s["name"]] = value if s["fill"] is None else F.coalesce(value, F.lit(float(s["fill"])))
        for s in self.fitted["text"]:
            value = F.col(s["name"])
            out[s["name"]] = value if s["fill"] is None else F.coalesce(value, F.lit(s["fill"]))
        return out

    def feature_columns(self) -> dict[str, Column]:
        """Name -> expression for every prepared column, numeric first, then indicators."""
        values = self.filled()
        how = self.getOrDefault("scale")
        out: dict[str, Column] = {}
        for s in self.fitted["numeric"]:
            out[s["name"]] = scaled(values[s["name"]], s["low"], s["high"], s["mean"], s["std"], how)
        for s in self.fitted["text"]:
            for level in s["levels"]:
                out[f"{s['name']}_{level}"] = indicator(values[s["name"]], level)
        return out

    def impute(self, df: DataFrame) -> DataFrame:
        values = self.filled()
        return df.select(*self.fitted["carried"], *[e.alias(c) for c, e in values.items()])

    def widen(self, df: DataFrame) -> DataFrame:
        """Carried columns plus one column per prepared feature."""
        return df.select(*self.fitted["carried"], *[e.alias(c) for c, e in self.feature_columns().items()])

    def _transform(self, df: DataFrame) -> DataFrame:
        parts = [e.cast("double") for e in self.feature_columns().values()]
        return df.select(*self.fitted["carried"], F.array(*parts).alias(self.getOrDefault("outputCol")))


def indicator(value: Column, level: str) -> Column:
    """1 where the value is this level, 0 elsewhere and for missing values."""
    return F.coalesce((value == F.lit(level)).cast("int"), F.lit(0))


def indicators(df: DataFrame, columns: list[str], keep: list[str], drop: str = "last", max_levels: int = 1000) -> DataFrame:
    """One 0/1 column per kept level, named column_level."""
    prep = TablePrep(keyCols=keep, textFill="none", numericFill="none", scale="none", drop=drop, maxLevels=max_levels)
    return prep.fit(df.select(*keep, *columns)).widen(df)


def indicators_long(df: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """Indicators in coordinate form, one row per (row, column, level): no limit on levels."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in columns])
    exploded = df.select(*keep, F.explode(cells).alias("cell")).select(*keep, "cell.*")
    return exploded.filter(F.col("level").isNotNull())


def one_of_many(label: Column, classes: list[str]) -> Column:
    """Label as an array of 0/1, classes in sorted order."""
    return F.array(*[F.coalesce((label == F.lit(c)).cast("int"), F.lit(0)) for c in sorted(classes)])


def from_one_of_many(code: Column, classes: list[str]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in sorted(classes)]), F.array_position(code, 1).cast("int") - 1)


def as_vector(df: DataFrame, features: str = "features", output: str = "vector") -> DataFrame:
    """ML vector next to an array<double> feature column."""
    return df.withColumn(output, array_to_vector(features))
