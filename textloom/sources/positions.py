"""Where a row stands in the files it was read from, without sorting or shuffling the rows.

A task reads blocks of files, and the rows of a block one after another. So a row's place is its place in its block plus
the rows of all blocks before, and only one row per block has to be put in order. Files that Spark wrote count by the
number of their task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILE, BLOCK, SERIAL = "__file", "__block", "__serial"
# Rows of a block table that are sent to all tasks at most; a block is 128 MB of input by default.
MOST_SENT = 2_000_000


def with_blocks(df: DataFrame, *more: Column) -> DataFrame:
    """Add the file (as a hash of its path), the block's place in it, and a number that rises within the block."""
    try:
        return df.select(
            "*",
            F.xxhash64("_metadata.file_path").alias(FILE),
            F.col("_metadata.file_block_start").alias(BLOCK),
            F.monotonically_increasing_id().alias(SERIAL),
            *more,
        )
    except AnalysisException:
        raise ValueError("rows have places only in files: read them with Spark's file sources, or give an order") from None


def file_order(path: Column) -> Column:
    """Folder, number of the task and of its file where Spark wrote it, then the name."""
    number = lambda pattern: F.coalesce(F.regexp_extract(path, pattern, 1).try_cast("long"), F.lit(0))
    folder = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.struct(folder, number(r"/part-(\d+)-[^/]*$"), number(r"[.-]c(\d+)\.[^/]*$"), path)


def sent_if_small(table: DataFrame, rows: int) -> DataFrame:
    """Mark a table for sending to all tasks only if its counted rows are few; else the planner decides."""
    return F.broadcast(table) if rows <= MOST_SENT else table


def _count_blocks(df: DataFrame) -> DataFrame:
    """One row per block with its rows, and how many rows stand before it; read from storage by what follows."""
    from textloom.session import new_dir
    from textloom.sources.sinks import materialise

    rows = with_blocks(df, F.col("_metadata.file_path").alias("__path"))
    blocks = rows.groupBy(FILE, BLOCK).agg(
        file_order(F.first("__path")).alias("order"), F.count(F.lit(1)).alias("n"), F.min(SERIAL).alias("first")
    )
    blocks = materialise(blocks, new_dir(df.sparkSession, "blocks"))
    before = Window.orderBy("order", BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select(FILE, BLOCK, "n", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def add_file_position(df: DataFrame, into: str = "position") -> tuple[DataFrame, int]:
    """``df`` with each row's place from 0 in the order of its files and of the rows in them, and the number of rows.

    ``df`` is what a file source of Spark's reads, perhaps with rows or columns left out; not what a join or a grouping
    made of it. Blocks are counted in one pass that needs no column; the places come with the rows' own pass.
    """
    blocks = _count_blocks(df)
    n, total = blocks.agg(F.count(F.lit(1)), F.sum("n")).first()
    placed = with_blocks(df).join(sent_if_small(blocks.drop("n"), n), [FILE, BLOCK])
    place = (F.col("before") + F.col(SERIAL) - F.col("first")).cast("bigint")
    return placed.select(*[F.col(f"`{c}`") for c in df.columns], place.alias(into)), total or 0


def same_columns(*tables: DataFrame) -> set[str]:
    """Names, in lower case, that more than one table has."""
    names = [{c.lower() for c in t.columns} for t in tables]
    return reduce(set.__or__, [a & b for i, a in enumerate(names) for b in names[i + 1 :]], set())
