"""Shared shape of the estimators: fit learns a small JSON state, transform is a projection.

``predict`` receives a frame and the fitted state and adds the prediction columns with
column expressions (or one Arrow function), so fitted models score batches and streams
alike and are saved by the standard ML writers.
"""

from __future__ import annotations

import json
from typing import Any

from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Columns(Params):
    """Column names every model shares."""

    featuresCol = Param(Params._dummy(), "featuresCol", "array<double> features", TypeConverters.toString)
    labelCol = Param(Params._dummy(), "labelCol", "label column", TypeConverters.toString)
    predictionCol = Param(Params._dummy(), "predictionCol", "output column", TypeConverters.toString)
    probabilityCol = Param(Params._dummy(), "probabilityCol", "class probabilities, classes sorted", TypeConverters.toString)

    def _columns(self) -> None:
        self._setDefault(featuresCol="features", labelCol="y", predictionCol="prediction", probabilityCol="probability")

    def named(self, **names: Any):
        """Set parameters by name, rejecting unknown ones."""
        for name, value in names.items():
            if not self.hasParam(name):
                raise ValueError(f"{type(self).__name__} has no parameter {name!r}")
            self._set(**{name: value})
        return self

    def _get(self, name: str) -> Any:
        return self.getOrDefault(name)


class TableEstimator(Estimator, Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Subclasses name their model class and implement ``learn(df) -> state``."""

    model_class: type

    def __init__(self, **names: Any):
        super().__init__()
        self._columns()
        self._defaults()
        self.named(**names)

    def _defaults(self) -> None:
        pass

    def validate(self) -> None:
        """Raise ValueError naming the first bad parameter."""

    def learn(self, df: DataFrame) -> dict[str, Any]:
        raise NotImplementedError

    def _fit(self, df: DataFrame):
        self.validate()
        return self._model(self.learn(df))

    def _model(self, state: dict[str, Any]):
        model = self.model_class(state=json.dumps(state))
        for param in model.params:
            if self.hasParam(param.name) and self.isDefined(self.getParam(param.name)) and param.name != "state":
                model._set(**{param.name: self._get(param.name)})
        return model


class TableModel(Model, Columns, DefaultParamsReadable, DefaultParamsWritable):
    state = Param(Params._dummy(), "state", "fitted state as JSON", TypeConverters.toString)

    def __init__(self, state: str = "{}"):
        super().__init__()
        self._columns()
        self._set(state=state)

    @property
    def fitted(self) -> dict[str, Any]:
        return json.loads(self._get("state"))

    def predict(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        raise NotImplementedError

    def _transform(self, df: DataFrame) -> DataFrame:
        return self.predict(df, self.fitted)


MAX_CLASSES = 10000


def sorted_classes(df: DataFrame, label: str) -> list[Any]:
    """Distinct labels in order; refuses columns that are not a class label."""
    found = [r[0] for r in df.select(label).distinct().limit(MAX_CLASSES + 1).collect() if r[0] is not None]
    if len(found) > MAX_CLASSES:
        raise ValueError(f"{label!r} has more than {MAX_CLASSES} distinct values; is it a class label?")
    return sorted(found)


def class_index(label: Column, classes: list[Any], unknown: int | None = None) -> Column:
    """Position of the label among the sorted classes, from 0.

    A label outside the classes becomes ``unknown``, or stops the job when that is not given.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in classes]), label)
    if unknown is None:
        other = F.raise_error(F.concat(F.lit("label outside the known classes: "), label.cast("string"))).cast("int")
    else:
        other = F.lit(unknown)
    return F.when(place > 0, (place - 1).cast("int")).when(label.isNotNull(), other)


def class_at(index: Column, classes: list[Any]) -> Column:
    return F.get(F.array(*[F.lit(c) for c in classes]), index)
