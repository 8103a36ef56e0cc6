"""Positions, running totals and lead/lag over a whole ordered table.

A window without PARTITION BY moves every row into one task. Here the order
column is cut into value ranges first: a small table of per-range totals gives each
range its starting offset and an ordinary window finishes the work inside the range.
A group that holds most of the rows is cut the same way, so no task grows with it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtab.session import shuffle_width


ORDERED = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def as_number(df: DataFrame, name: str) -> Column:
    """Order-preserving double for a numeric, date or timestamp column."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return F.unix_date(name).cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def _cuts(df: DataFrame, number: Column, count: int) -> list[float]:
    """Quantiles that cut a column into ``count`` ranges; repeats mark values held by many rows."""
    shares = [i / count for i in range(1, count)]
    return df.select(number.alias("_number")).approxQuantile("_number", shares, 1.0 / (4 * count)) if shares else []


def _between_cuts(df: DataFrame, number: Column, cuts: Sequence[float], name: str) -> DataFrame:
    """Add the index of the interval a number falls into, by binary search over the cuts."""
    if not cuts:
        return df.withColumn(name, F.lit(0))
    edges = [float("-inf"), *cuts, float("inf")]
    cutter = Bucketizer(splits=edges, inputCol="_number", outputCol="_bucket", handleInvalid="keep")
    return cutter.transform(df.withColumn("_number", number)).withColumn(name, F.col("_bucket").cast("int")).drop("_number", "_bucket")


SAMPLED = 50  # sampled texts for each range


def _text_cuts(df: DataFrame, name: str, count: int) -> list[str]:
    """Texts that cut a column into ``count`` ranges, from a bounded row sample; repeats mark values held by many rows."""
    rows = df.select(F.col(name).alias("_text")).filter("_text IS NOT NULL").orderBy(F.rand(11)).limit(SAMPLED * count).collect()
    found = sorted((r["_text"] for r in rows), key=lambda t: t.encode("utf-8", "surrogatepass"))
    return [found[len(found) * i // count] for i in range(1, count)] if found else []


def _between_texts(value: Column, cuts: Sequence[str]) -> Column:
    """Index of the interval of a text; every cut is an interval of its own and NULL comes first, as in Spark's order."""
    if not cuts:
        return F.when(value.isNull(), F.lit(-1)).otherwise(F.lit(0))
    known = F.array(*[F.lit(c) for c in cuts])
    place = F.size(F.filter(known, lambda c: c < value)) + F.size(F.filter(known, lambda c: c <= value))
    return F.when(value.isNull(), F.lit(-1)).otherwise(place)


def _intervals(df: DataFrame, name: str, count: int, read: DataFrame, output: str) -> tuple[DataFrame, list, int]:
    """(``df`` with the index of its interval, values held by many rows, number of intervals) of a number, date or text column."""
    if isinstance(df.schema[name].dataType, T.StringType):
        found = _text_cuts(read, name, count)
        cuts = list(dict.fromkeys(found))
        return df.withColumn(output, _between_texts(F.col(name), cuts)), [v for v, n in Counter(found).items() if n > 1], 2 * len(cuts) + 1
    found = _cuts(read, as_number(read, name), count)
    hot = sorted(v for v, times in Counter(found).items() if times > 1)
    edges = sorted({*found, *[math.nextafter(v, math.inf) for v in hot]})
    return _between_cuts(df, as_number(df, name), edges, output), hot, len(edges) + 2


def add_ranges(
    df: DataFrame,
    order: str,
    ties: Sequence[str] = (),
    descending: bool = False,
    span: int | None = None,
    ranges: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Tag each row with ``_range``, an index that grows along the wanted order.

    ``span`` says the order column is uniform on [0, span) (a key hash), so the cut points
    are known without reading the data. Otherwise a quantile sketch supplies them, taken
    from ``source`` when that frame has the same order column, is cheaper to read, and
    ``df`` holds one row per value of it. A text column is cut at texts of a bounded sample. A
    value that many rows share gets a range of its own, which is cut again by the first tie
    column, or by a hash of the row where no tie orders it.
    """
    count = ranges or shuffle_width(df.sparkSession)
    sign = -1 if descending else 1
    if span is not None:
        return df.withColumn("_range", sign * F.floor(F.col(order) * F.lit(count) / F.lit(span)).cast("int"))
    ranged, hot, _ = _intervals(df, order, count, df if source is None else source, "_range")
    able = (*ORDERED, T.StringType)
    tie = next((t for t in ties if isinstance(df.schema[t].dataType, able)), None)
    if not hot or source is not None or (ties and tie is None):
        return ranged.withColumn("_range", sign * F.col("_range"))
    text = isinstance(df.schema[order].dataType, T.StringType)
    crowded = (F.col(order) if text else as_number(df, order)).isin(hot)
    if tie is None:  # equal rows stand in any order
        parts = count
        parted = ranged.withColumn("_part", F.pmod(F.xxhash64(*[f.name for f in df.schema if not isinstance(f.dataType, T.MapType)]), F.lit(count)).cast("int"))
    else:
        parted, _, parts = _intervals(ranged, tie, count, df.filter(crowded), "_part")
    part = F.when(crowded, F.col("_part") + 1).otherwise(F.lit(0))
    return parted.withColumn("_range", sign * F.col("_range") * F.lit(parts + 2) + part).drop("_part")


def running_before(
    df: DataFrame,
    order: str,
    values: Sequence[str],
    group: Sequence[str] = (),
    ties: Sequence[str] = (),
    descending: bool = False,
    span: int | None = None,
    ranges: int | None = None,
    source: DataFrame | None = None,
) -> DataFrame:
    """Add ``<value>_before``: the total of ``value`` over all earlier rows of the group.

    ``ties`` orders rows with equal ``order`` and should make the order total.
    """
    group = list(group)
    ranged = add_ranges(df, order, ties, descending, span, ranges, source)
    subtotal = ranged.groupBy(*group, "_range").agg(*[F.sum(v).alias(f"_sub_{v}") for v in values])
    # At most one row per range and group reaches this window, however large the table is.
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    keys = [*group, "_range"]
    offsets = subtotal.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys],
        *[F.coalesce(F.sum(f"_sub_{v}").over(earlier), F.lit(0)).alias(f"_off_{v}") for v in values],
    )
    inside_order = [F.col(order).desc() if descending else F.col(order).asc(), *[F.col(t).asc() for t in ties]]
    inside = (
        Window.partitionBy(*group, "_range").orderBy(*inside_order).rowsBetween(Window.unboundedPreceding, -1)
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys])  # rows of a NULL group stay
    placed = ranged.join(offsets, same)
    return placed.select(
        *df.columns,
        *[
            (F.col(f"_off_{v}") + F.coalesce(F.sum(v).over(inside), F.lit(0))).alias(f"{v}_before")
            for v in values
        ],
    )


def ordinal(
    df: DataFrame,
    order: str,
    ties: Sequence[str] = (),
    group: Sequence[str] = (),
    span: int | None = None,
    name: str = "position",
    ranges: int | None = None,
) -> DataFrame:
    """Position of each row in its group, from 1."""
    counted = df.withColumn("_one", F.lit(1).cast("bigint"))
    placed = running_before(counted, order, ["_one"], group, ties, span=span, ranges=ranges)
    return placed.withColumn(name, F.col("_one_before") + 1).drop("_one", "_one_before")


def shifted(
    df: DataFrame,
    position: str,
    shifts: Mapping[str, tuple[str, int]],
    group: Sequence[str] = (),
    block: int = 65536,
) -> DataFrame:
    """Values ``offset`` positions away: ``shifts[new] = (column, offset)``, offset > 0 looks ahead.

    Positions are cut into blocks; rows that a neighbouring block looks at are copied
    there, so each block is computed alone and no task sees a whole series.
    """
    group = list(group)
    reach = max(abs(offset) for _, offset in shifts.values())
    size = max(block, reach)
    home = F.floor((F.col(position) - 1) / F.lit(size)).cast("bigint")
    seen_from = [F.floor((F.col(position) - F.lit(o) - 1) / F.lit(size)).cast("bigint") for _, o in shifts.values()]
    copied = df.withColumn("_home", home).withColumn(
        "_block", F.explode(F.array_distinct(F.array(home, *seen_from)))
    )
    near = Window.partitionBy(*group, "_block").orderBy(position)
    looked = copied.select(
        "*",
        *[
            F.first(column).over(near.rangeBetween(offset, offset)).alias(new)
            for new, (column, offset) in shifts.items()
        ],
    )
    return looked.filter(F.col("_block") == F.col("_home")).drop("_home", "_block")
