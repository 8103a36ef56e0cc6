"""Time-varying curriculum: sources mixed to target weights that change over training, natively in Spark.

Every source has a weight schedule, linear between its start and end weight over training time t in [0, 1]. Its demand
up to t is the integral D(t) = start * t + (end - start) * t^2 / 2, scaled so that D(1) is the words the source gives.
A document's words sit at a place in their source's order; the time at which demand reaches that place, the inverse of
D, is its training position. Documents are sorted by position with a range exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtab.llm.common import WORD, documents, query, stored

BUCKETS = 256


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(doc_id, source, size in words, check, rank): rank is a fixed shuffle of the documents, ``check`` a hash of the text."""
    size = F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(F.col(text), F.lit(WORD))).cast("long")
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), size.alias("size"),
        F.xxhash64(F.col(text)).alias("check"), F.xxhash64(F.col(key), F.col(text), F.lit("order")).alias("rank"),
    )


def targets(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """(source, source_size, weight, target) of every source.

    Sources by code point, null last, take the weights in turn and share all words by weight; none gets more than
    ``most`` times its own words, and what is over is shared again by weight. The shares are weight * level under one
    level, cut at the caps: sources sorted by cap / weight are capped up to the last whose cap lies under the level
    that the others would have. The windows run over one row per source.
    """
    by_name, by_cap = W.orderBy(F.col("source").asc_nulls_last()), W.orderBy("by_cap", F.col("source").asc_nulls_last())
    all_rows = W.partitionBy()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int") + 1)
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight.cast("long"))
    cap = F.col("source_size") * most
    upto = by_cap.rowsBetween(W.unboundedPreceding, 0)
    ranked = sums.withColumn("by_cap", cap / F.col("weight"))
    # With this source and all before it capped, the others share what is left; the level is right once no other is over its cap.
    left = F.sum("source_size").over(all_rows) - F.sum(cap).over(upto)
    others = F.sum("weight").over(all_rows) - F.sum("weight").over(upto)
    first_level = F.sum("source_size").over(all_rows) / F.sum("weight").over(all_rows)
    level = ranked.withColumn("first_level", first_level).withColumn("level", F.when(others > 0, left / others))
    before = F.coalesce(F.lag("level").over(by_cap), F.col("first_level"))  # the level before this source is capped
    capped = level.withColumn("capped", F.col("by_cap") < before)
    final = F.min(F.when(~F.col("capped"), F.struct("by_cap", F.col("before").alias("level")))).over(all_rows)["level"]
    out = capped.withColumn("before", before).withColumn("final", final)
    share = F.when(F.col("capped"), cap.cast("double")).otherwise(F.col("weight") * F.col("final"))
    return out.select("source", "source_size", "weight", share.cast("double").alias("target"))


def placed(rows: DataFrame, keys: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Rows with their source's columns and ``before``, the words of the source before them in rank order.

    Ranks are cut into buckets; a running sum inside a bucket is added to the totals of the source's earlier buckets, so
    a source that holds most rows is spread over ``buckets`` groups.
    """
    cut = rows.withColumn("bucket", F.pmod(F.shiftrightunsigned("rank", 40), F.lit(buckets)).cast("int"))
    sums = cut.groupBy("source", "bucket").agg(F.sum("size").alias("held"))
    earlier = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.withColumn("offset", F.coalesce(F.sum("held").over(earlier), F.lit(0))).drop("held")
    offsets = offsets.join(keys, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
    offsets = offsets.select(F.col("source").alias("s"), F.col("bucket").alias("b"), *[c for c in offsets.columns if c not in ("source", "bucket")])
    inside = W.partitionBy("source", "bucket").orderBy("rank", "doc_id", "check").rowsBetween(W.unboundedPreceding, -1)
    ran = cut.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    both = ran.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return both.withColumn("before", F.col("inside") + F.col("offset")).drop("s", "b", "inside", "offset", "bucket", "rank")


def takes(rows: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """Rows with target, ``copies`` and ``taken``: every document goes round whole, target / source_size times.

    The last round takes the documents whose middle lies under what is left of the target, so a source ends within half
    a document of it. A document of no words is taken in every whole round and costs nothing.
    """
    keys = targets(rows, weights, most).withColumnRenamed("source", "of_source")
    at = placed(rows, keys)
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(1)
    left = F.col("target") - F.col("rounds") * F.col("source_size")
    once_more = (F.col("before") + F.col("size") / 2.0 < F.col("left")) & (F.col("rounds") < most)
    out = at.withColumn("rounds", rounds).withColumn("left", left).withColumn("copies", F.col("rounds") + once_more.cast("long"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def inverse_demand(share: Column, start: Column, end: Column) -> Column:
    """The t at which the integral of a schedule linear from ``start`` to ``end`` reaches ``share`` of its whole.

    Solves start * t + (end - start) * t^2 / 2 = share * (start + end) / 2 in the form that is stable for equal ends.
    """
    whole = share * (start + end) / 2.0
    return 2.0 * whole / (start + F.sqrt(F.greatest(start * start + 2.0 * (end - start) * whole, F.lit(0.0))))


def scheduled(
    docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, drift: float = 0.5,
    key: str = "doc_id", source: str = "source", text: str = "text",
) -> DataFrame:
    """One row per row of ``docs``: doc_id, check, source, size, source_size, target, copies, taken and its copies' positions.

    ``drift`` in (-1, 1): a source's weight goes from 1 - d to 1 + d times its mean over training, where d runs from
    -drift for the lightest sources to +drift for the heaviest, so heavy sources come late and light ones early.
    A null text has size 0, rows without a source are one source, repeated rows count each, an empty table gives an empty
    one; other columns are not looked at. The order is a hash of doc_id and text, so reruns agree and rows without an id spread.
    """
    words = stored(sized(docs, key, source, text), "sizes")  # the texts are read once
    rows = takes(words, weights, most)
    middle = F.col("before") + F.col("size") / 2.0
    tilt = F.lit(drift) * (2.0 * (F.col("weight") - min(weights)) / max(1, max(weights) - min(weights)) - 1.0)

    def position(copy: Column) -> Column:
        share = F.least(F.lit(1.0), ((copy - 1) * F.col("source_size") + middle) / F.greatest(F.col("target"), F.lit(1.0)))
        return F.least(F.lit(1.0), inverse_demand(share, 1.0 - tilt, 1.0 + tilt))

    copies = F.when(F.col("copies") > 0, F.sequence(F.lit(1).cast("long"), F.col("copies"))).otherwise(F.array().cast("array<long>"))
    return rows.withColumn("positions", F.transform(copies, position)).select(
        "doc_id", "check", "source", "size", "source_size", "target", "copies", "taken", "positions"
    )


def curriculum(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """One row per copy taken, range-sorted by its position in [0, 1]: (doc_id, source, text, copy, size, position).

    Takes the options of ``scheduled``; a document that is not taken has no row. Texts join their positions by id and hash, so
    rows without an id get theirs too.
    """
    rows = scheduled(docs, key=key, source=source, text=text, **options)
    copies = rows.select("doc_id", "check", "source", "size", F.posexplode("positions").alias("copy", "position"))
    copies = copies.withColumn("copy", F.col("copy") + 1)
    said = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).cast("string").alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("check") == F.col("hash"))
    out = copies.join(said.dropDuplicates(["id", "hash"]), same).drop("id", "hash")
    return in_order(out).select("doc_id", "source", "text", "copy", "size", "position")


def in_order(copies: DataFrame) -> DataFrame:
    """Copies range-sorted by position; equal ones by id, copy and text."""
    return copies.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id", "copy", "check")


def with_places(rows: DataFrame) -> DataFrame:
    """Rows of ``scheduled`` with what the range-sorted order holds of each: taken, copies, first_position and first_place, from 1.

    The sorted order is written, without texts, with every row's number in its partition; the totals of the partitions
    before it, one row per partition, make that its place in the whole.
    """
    kept = stored(rows.withColumn("row", F.monotonically_increasing_id()), "scheduled")
    copies = kept.select("row", "doc_id", "check", "size", F.posexplode("positions").alias("copy", "position"))
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    order = stored(in_order(copies).select("row", "size", "position", F.spark_partition_id().alias("part"), number.alias("at")), "order")
    parts = order.groupBy("part").agg(F.count(F.lit(1)).alias("held"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    found = order.join(F.broadcast(offsets), "part").groupBy("row").agg(
        F.sum("size").alias("taken"), F.count(F.lit(1)).alias("copies"), F.min("position").alias("first_position"),
        F.min(F.col("offset") + F.col("at") + 1).alias("first_place"),
    )
    return kept.drop("taken", "copies", "positions").join(found, "row", "left").drop("row").na.fill(0, ["taken", "copies"])


@query()
def op9_mixing(spark, folder):
    """The mix of all documents: what the range-sorted order takes of each, and where its first copy stands in it."""
    rows = with_places(scheduled(documents(spark, folder)))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_position", "first_place")
