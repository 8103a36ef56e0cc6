"""Documents to a training order in five stages; each works on what the one before wrote.

All stages take null texts, rows without an id, repeated rows, empty tables and further columns, and all but the last return
the columns they got. Rows without an id are told apart by their text wherever a stage must name them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtab.llm.common import documents, stored
from loomtab.llm.curriculum import curriculum
from loomtab.llm.line_crf import fit_quality, with_quality
from loomtab.llm.line_dedup import with_kept_lines
from loomtab.llm.parity_join import parity_join
from loomtab.llm.string_tiling import with_tiles
from loomtab.session import load

THRESHOLD = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines score under the threshold go. A null or empty text scores like any other, by its one empty line."""
    chain = fit_quality(docs, load(spark, sf_dir, "labels"))
    return with_quality(docs, chain).filter(F.col("__score") >= THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document of which only blanks are left goes with them. Untouched texts stay as they are, null too."""
    rows = with_kept_lines(docs)
    kept = F.when(F.col("__dropped") > 0, F.col("__kept")).otherwise(F.col("text"))
    changed = {"text": kept, "n_chars": F.when(F.col("__dropped") > 0, F.char_length("__kept").cast("long")).otherwise(F.col("n_chars"))}
    left = rows.filter((F.col("__dropped") == 0) | (F.regexp_count("__kept", F.lit(r"[^\x20\x09-\x0D]")) > 0))
    return left.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each group stays. Of rows equal in id and text, or without an id and equal in text, one stays."""
    gone = parity_join(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.filter(F.col("doc_id").isNotNull()).join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
    rows = left.unionByName(docs.filter(F.col("doc_id").isNull())).withColumn("__mark", F.sha2(F.coalesce("text", F.lit("")), 256))
    return rows.dropDuplicates(["doc_id", "__mark"]).drop("__mark")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; texts and items without words match nothing."""
    return with_tiles(docs, load(spark, sf_dir, "benchmark")).filter("__items = 0").select(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training order: one row per copy taken, with its text, by position."""
    return curriculum(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

# The classifier's training and the tiling have no SQL form; the tests run the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's rows are written and read again before the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
