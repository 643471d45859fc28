"""A corpus from raw documents to packed sequences: five stages, each over all that the one before kept.

Null and empty texts pass the filters as their scores say, are never near-duplicates, and count no words in the mix; a
source without words is not drawn from, so they leave with it there. Null sources are a source, null ids are kept, extra
columns go, and no documents give no rows.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import minhash, mixing, packing, quality, toxicity
from textloom.llm.common import stored
from textloom.session import ship_package

ORACLE_SQL = None  # two stages apply fitted models

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not found toxic."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.score_toxicity(docs, labels).where(F.col("predicted") == 0).select(COLUMNS)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents worth keeping."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.score_quality(docs, labels).where(F.col("predicted") == 1).select(COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows that share an id are one document and stay together; rows without an id stay.
    """
    ship_package(spark)
    kept = minhash.near_duplicates(docs, threshold=80).where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs.doc_id.eqNullSafe(kept["__kept"]), "left_semi").select(COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    ship_package(spark)
    sized = docs.select(*COLUMNS, mixing.word_count("text").alias("size"))
    return mixing.in_training_order(mixing.curriculum(sized, "size")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, whose ids follow the order in which the documents were written."""
    ship_package(spark)
    return packing.pack(in_written_order(docs))


def in_written_order(docs: DataFrame) -> DataFrame:
    """``docs``, range-sorted into the order of the DataFrame that was written to the files they are read from.

    A scan puts large files first and several into one partition. Spark's writers number a file by its task, and by its
    place among the task's files; with the row's place in the file that is the order. A DataFrame that was not read from
    files has its own order, and keeps it.
    """
    try:
        rows = docs.select("*", F.col("_metadata.file_name").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    except AnalysisException:
        return docs
    number = lambda pattern: F.regexp_extract("__file", pattern, 1).try_cast("long")
    order = [number(r"^part-(\d+)-"), number(r"[.-]c(\d+)\."), F.col("__file"), F.col("__row")]
    rows = rows.select(*docs.columns, F.struct(*[o.alias(f"c{i}") for i, o in enumerate(order)]).alias("__order"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "__order").sortWithinPartitions("__order").select(*docs.columns)


STAGES = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
