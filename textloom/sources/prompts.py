"""Prompt files: one prompt per line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textloom.functions import strip_text

_BLOCK = ["file", "block"]
_BLOCK_LINES = 1 << 40


def read_prompts(spark: SparkSession, path: str, dense: bool = False) -> DataFrame:
    """Stripped non-blank lines with ``prompt_idx`` in the order of files by name, and of lines in each.

    Any line ending counts. The index has gaps between file blocks; ``dense=True`` numbers from 0, which counts the lines
    per block first and then adds up the blocks.
    """
    lines = (
        spark.read.text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("line"),
            strip_text(F.col("value")).alias("prompt"),
        )
        .where(F.length("prompt") > 0)
    )
    # one row per file block, not per line
    blocks = lines.groupBy(*_BLOCK).agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy(*_BLOCK)
    if dense:
        before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    else:
        before = (F.row_number().over(order) - 1) * F.lit(_BLOCK_LINES)
    nth = F.row_number().over(Window.partitionBy(*_BLOCK).orderBy("line"))
    numbered = lines.withColumn("nth", nth).join(blocks.select(*_BLOCK, before.alias("before")), _BLOCK)
    return numbered.select((F.col("before") + F.col("nth") - 1).cast("bigint").alias("prompt_idx"), "prompt")
