"""Table readers: CSV with a header, parquet, two-cohort inputs, families of files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomtab.operators.columns import clean_inf, normalize_names, stack_frames


def read_table(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | str | None = None,
    missing: str = "NA",
    kind: str | None = None,
) -> DataFrame:
    """CSV (header, empty and ``missing`` read as NULL) or parquet, names normalised, NaN as NULL.

    Pass ``schema`` in production jobs: without it a CSV is read twice to infer types.
    """
    return clean_inf(normalize_names(_reader(spark, [path] if isinstance(path, str) else list(path), schema, missing, kind)))


def _reader(spark: SparkSession, paths: list[str], schema: T.StructType | str | None, missing: str = "NA", kind: str | None = None) -> DataFrame:
    form = kind or ("parquet" if paths[0].rstrip("/").endswith(".parquet") else "csv")
    if form == "parquet":
        return spark.read.parquet(*paths)
    reader = spark.read.option("header", True).option("nullValue", missing).option("emptyValue", "")
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(paths)


def read_cohorts(train: DataFrame, test: DataFrame) -> DataFrame:
    """Two tables with one contract as a single frame with a 'split' column."""
    return stack_frames([train.withColumn("split", F.lit("train")), test.withColumn("split", F.lit("test"))])


def cohorts_by(df: DataFrame, is_train: Column) -> DataFrame:
    """The same frame when a predicate on the rows tells the cohorts apart."""
    return df.withColumn("split", F.when(is_train, F.lit("train")).otherwise(F.lit("test")))


def read_many(spark: SparkSession, paths: Mapping[str, str], schema: T.StructType | str | None = None, tag: str = "horizon") -> DataFrame:
    """A family of files or folders as one scan, tagged by the name of the path each row came from."""
    df = _reader(spark, list(paths.values()), schema)
    place = F.col("_metadata.file_path")
    origin = F.lit(None).cast("string")
    # Longer paths first, so that a path that extends another one is not taken for it.
    for name, path in sorted(paths.items(), key=lambda item: len(item[1])):
        origin = F.when(place.contains(quote(path, safe="/:=,+@&$!*'();~")), F.lit(name)).otherwise(origin)
    return clean_inf(normalize_names(df.select(*df.columns, origin.alias(tag))))


def offsets_table(spark: SparkSession, offsets: Mapping[str, tuple[int, int, int]], tag: str = "horizon") -> DataFrame:
    """(tag, n_train, n_last, window): per-file offsets, joined by tag instead of looped over."""
    rows = [(name, *numbers) for name, numbers in offsets.items()]
    return spark.createDataFrame(rows, f"{tag} string, n_train int, n_last int, `window` int")
