"""From raw text rows to fixed-length token rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from textloom.functions import attention_mask, is_filled, pad_right, truncate, words

DEFAULT_LENGTH = 512


def drop_empty(df: DataFrame, text: str = "text") -> DataFrame:
    """Keep rows whose value is not null and not of length zero; blank text stays."""
    return df.where(is_filled(F.col(text)))


def count_rows(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows on the way through, without a pass of its own; read it from ``.get`` after an action."""
    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("n_rows")), seen


def row_report(df: DataFrame, text: str = "text") -> DataFrame:
    """Rows read, null, of length zero, kept, and kept though blank, in one pass."""
    value = F.col(text)
    kept = is_filled(value)
    return df.agg(
        F.count(F.lit(1)).alias("rows_read"),
        F.count_if(value.isNull()).alias("rows_null"),
        F.count_if(value.isNotNull() & ~kept).alias("rows_zero_length"),
        F.count_if(kept).alias("rows_kept"),
        F.count_if(kept & value.cast("string").rlike(r"^\s+$")).alias("rows_blank_kept"),
    )


def pad_token(pad_id: Column, eos_id: Column) -> Column:
    """Padding id, or the end-of-sequence id where there is none; 0 is a proper padding id."""
    return F.coalesce(pad_id, eos_id)


def pad_and_mask(
    df: DataFrame, ids: str = "input_ids", max_length: int = DEFAULT_LENGTH, pad_id: int = 0
) -> DataFrame:
    """Cut at ``max_length``, pad on the right and add the mask; ``n_tokens`` counts the real ids kept."""
    return (
        df.withColumn(ids, truncate(F.col(ids), max_length))
        .withColumn("n_tokens", F.size(ids))
        .withColumn("attention_mask", attention_mask(F.col("n_tokens"), max_length))
        .withColumn(ids, pad_right(F.col(ids), max_length, pad_id))
    )


def prepare_text(
    df: DataFrame,
    vocabulary: DataFrame,
    key: str,
    text: str = "text",
    max_length: int = DEFAULT_LENGTH,
    pad_id: int = 0,
    lookup: str = "ship",
) -> DataFrame:
    """Filter, split, look up, cut and pad: ``(key, text, input_ids, attention_mask, n_tokens)``, one row per text kept.

    The other columns are dropped; the key stays so that results can be joined back. Words after ``max_length`` are
    never split off, let alone looked up. ``lookup`` is as in ``encode``.
    """
    from textloom.operators.vocabulary import encode

    kept = drop_empty(df.select(key, text), text).withColumn("__words", words(F.col(text).cast("string"), max_length))
    encoded = encode(kept, vocabulary, "__words", lookup=lookup).drop("__words")
    return pad_and_mask(encoded, "input_ids", max_length, pad_id).select(
        key, text, "input_ids", "attention_mask", "n_tokens"
    )


def length_report(df: DataFrame, group: str, text: str = "text", max_length: int = DEFAULT_LENGTH) -> DataFrame:
    """Per group: rows, tokens kept, tokens cut off and the share of padding, at a fixed row length."""
    n = F.size(words(F.col(text).cast("string"))).cast("bigint")
    kept = F.least(F.col("n"), F.lit(max_length).cast("bigint"))
    return (
        drop_empty(df, text)
        .select(group, n.alias("n"))
        .groupBy(group)
        .agg(
            F.count(F.lit(1)).alias("n_rows"),
            F.sum(kept).alias("tokens_kept"),
            F.sum(F.col("n") - kept).alias("tokens_cut"),
            F.round(1.0 - F.sum(kept) / (F.count(F.lit(1)) * F.lit(float(max_length))), 6).alias("pad_share"),
        )
    )
