"""Batches, seeded order, collation and step planning."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import attention_mask, pad_right, seeded_digest, up_to_multiple
from textloom.operators.ranking import add_position, default_chunks

DEFAULT_BATCH = 8
DEFAULT_SEED = 42


def assign_batches(
    df: DataFrame, key: str, batch_size: int = DEFAULT_BATCH, chunks: int | None = None
) -> DataFrame:
    """Consecutive batches of ``batch_size`` rows along ``key``; the last one may be short.

    Every row gets a batch: null keys come first, and rows that share a key follow each other in any order.
    """
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    positioned = add_position(df, [key], into="__pos", chunks=chunks)
    return positioned.withColumn("batch_id", F.expr(f"(__pos - 1) div {batch_size}").cast("bigint")).drop("__pos")


def seeded_order(df: DataFrame, key: str, seed: int = DEFAULT_SEED, chunks: int | None = None) -> DataFrame:
    """Position from 0 in an order that depends on the seed and the row key alone.

    The leading digits of the digest cut the order into even chunks, so no pass for cuts is needed.
    """
    n = chunks or default_chunks(df)
    with_digest = df.withColumn("__digest", seeded_digest(seed, F.col(key)))
    leading = F.conv(F.substring("__digest", 1, 8), 16, 10).cast("bigint")
    ranked = add_position(
        with_digest, ["__digest", key], into="__pos", chunk=F.floor(leading * n / F.lit(float(1 << 32))).cast("bigint")
    )
    return ranked.withColumn("shuffled_idx", F.col("__pos") - 1).drop("__digest", "__pos")


def with_labels(df: DataFrame, ids: str = "input_ids") -> DataFrame:
    """Labels are a copy of the ids unless the table brings its own; padding is not masked out."""
    return df if "labels" in df.columns else df.withColumn("labels", F.col(ids))


def collate(
    df: DataFrame,
    key: str,
    batch_size: int = DEFAULT_BATCH,
    ids: str = "input_ids",
    pad_id: int = 0,
    multiple: int = 8,
    chunks: int | None = None,
) -> DataFrame:
    """Pad every row to the longest of its batch, rounded up to ``multiple``; add batch, mask and labels.

    Rows are batched as they are, so null and repeated keys lose or multiply none. A batch is small, so the width is
    a window over it.
    """
    batched = assign_batches(df.withColumn("__n", F.size(ids)), key, batch_size, chunks)
    longest = F.max("__n").over(Window.partitionBy("batch_id"))
    padded = batched.withColumn("width", up_to_multiple(longest, multiple).cast("int")).drop("__n")
    mask = attention_mask(F.size(ids), F.col("width"))
    if "attention_mask" in df.columns:
        mask = pad_right(F.col("attention_mask"), F.col("width"), 0)
    padded = padded.withColumn("attention_mask", mask)
    if "labels" in df.columns:
        padded = padded.withColumn("labels", pad_right(F.col("labels"), F.col("width"), pad_id))
    return with_labels(padded.withColumn(ids, pad_right(F.col(ids), F.col("width"), pad_id)), ids)


def map_batches(batched: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a user's function to each whole batch; a batch is never larger than its ``batch_size``.

    ``collate`` needs no such function; this is for collating in a way of one's own.
    """
    return batched.groupBy("batch_id").applyInPandas(function, schema)


def plan_steps(
    df: DataFrame, batch_size: int = 16, accumulation: int = 1, epochs: int = 3, split: str = "split"
) -> DataFrame:
    """Rows, batches, effective batch, update steps per epoch and in total, for each split."""
    rows = df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"))
    batches = F.ceil(F.col("n_rows") / F.lit(float(batch_size))).cast("bigint")
    per_epoch = F.greatest(F.expr(f"n_batches div {accumulation}"), F.lit(1)).cast("bigint")
    return (
        rows.withColumn("n_batches", batches)
        .withColumn("effective_batch", F.lit(batch_size * accumulation).cast("bigint"))
        .withColumn("steps_per_epoch", per_epoch)
        .withColumn("total_steps", F.col("steps_per_epoch") * F.lit(epochs).cast("bigint"))
    )
