"""What is sent or read more often than it has to be grows with the table."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from loomtab.models.simple import MajorityClass, NearestCentroid
from loomtab.operators.neighbors import Side, knn_join
from loomtab.plans.families import Member, member_predictions


def test_members_share_the_written_folds(spark):
    hashed = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def fold(key):
        hashed.add(1)
        return key % 5

    rows = spark.range(500).select(F.col("id").alias("key"), F.array(F.col("id").cast("double")).alias("features"), (F.col("id") >= 250).cast("int").alias("y"))
    rows = rows.withColumn("fold", fold("key"))
    out = member_predictions(rows, [Member("c", estimator=NearestCentroid()), Member("m", estimator=MajorityClass())], "y")
    assert out.groupBy("member", "fold").count().count() == 10 and out.count() == 1000
    assert hashed.value <= 1000


def test_broadcast_vectors_are_narrow_where_that_is_exact(spark, monkeypatch):
    sent = []
    context = spark.sparkContext
    broadcast = context.broadcast
    monkeypatch.setattr(context, "broadcast", lambda value: sent.append(value[1].dtype) or broadcast(value))
    for step, kind in ((0.5, np.float32), (0.1, np.float64)):
        rows = spark.range(40).select("id", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: i * F.col("id") * step).alias("v"))
        side = Side(rows, "id", "v", None, "id")
        found = {r["id"]: [n["id"] for n in r["neighbors"]] for r in knn_join(side, side, 2, strategy="broadcast").collect()}
        assert sent.pop() == kind and found[0] == [1, 2] and found[7] == [6, 8]
