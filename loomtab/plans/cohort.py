"""Cohort study: fit on one cohort, predict another, report next to the majority class."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtab.models.simple import MajorityClass
from loomtab.operators import metrics
from loomtab.operators.prepare import PrepModel, TablePrep


@dataclass
class Study:
    prep: PrepModel
    model: Model
    predictions: DataFrame

    def confusion(self, label: str) -> DataFrame:
        return metrics.confusion(self.predictions, label, "prediction")

    def report(self, label: str) -> DataFrame:
        return metrics.classification_report(self.predictions, label, "prediction")


def run_study(rows: DataFrame, key: str, label: str, estimator: Estimator, scale: str = "unit", **prep_options) -> Study:
    """``rows`` holds both cohorts with a 'split' column; statistics and model come from the train cohort only."""
    prep = TablePrep(keyCols=[key, label, "split"], splitCol="split", scale=scale, **prep_options).fit(rows)
    ready = prep.transform(rows)
    model = estimator.fit(ready.filter(F.col("split") == "train"))
    return Study(prep, model, model.transform(ready.filter(F.col("split") == "test")))


def against_majority(rows: DataFrame, label: str) -> DataFrame:
    """Predictions of the majority baseline on the test cohort."""
    model = MajorityClass(labelCol=label).fit(rows.filter(F.col("split") == "train"))
    return model.transform(rows.filter(F.col("split") == "test"))
