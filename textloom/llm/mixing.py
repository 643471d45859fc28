"""Mixing sources to target weights along a curriculum, in DataFrame operations only.

Each source has a weight for every moment of training. Its integral is the source's cumulative demand for words; a
document's place in the source's supply, measured in words, is turned into the moment at which the demand reaches it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import WORD

WEIGHTS = (5.0, 2.0, 1.0)
REPEATS = 3
CHUNK_ROWS = 16_384


def word_count(text: str | Column) -> Column:
    """Runs without ASCII white space in the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _targets(sources: DataFrame, weights: tuple[float, ...], repeats: int) -> DataFrame:
    """``target`` per source: weights shared out over all sizes, none above ``repeats`` times its size.

    Resharing the excess until nothing is above its limit fills up to one level: target = min(limit, level * weight).
    Sorted by limit / weight, the first source that stays below its limit at the level set by those before it gives the
    level, which is the highest of all such levels. The windows here run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")
    )
    known = sources.withColumn("weight", cycle).withColumn("limit", F.col("source_size") * F.lit(float(repeats)))
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(by_limit.rowsBetween(0, Window.unboundedFollowing))
    level = known.withColumn("level", level)
    level = level.withColumn(
        "level", F.max(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.col("level"))).over(whole)
    )
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return level.select("source", "source_size", target.alias("target"), "weight")


def _moment(words: Column, target: Column, slope: Column) -> Column:
    """When a demand of target * (t + slope * (t * t - t)) reaches a number of words, for a slope from -1 to 1."""
    share = F.when(target > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), words / target))).otherwise(0.0)
    flat = 1 - slope
    # the root of slope t^2 + (1 - slope) t - share, in the form that holds for a slope of 0 as well
    return F.least(F.lit(1.0), 2 * share / (flat + F.sqrt(flat * flat + 4 * slope * share)))


def curriculum(
    docs: DataFrame,
    size: str,
    weights: tuple[float, ...] = WEIGHTS,
    repeats: int = REPEATS,
    slopes: tuple[float, ...] = (-0.5, 0.0, 0.5),
    seed: int = 10,
) -> DataFrame:
    """``docs`` with ``source_size``, ``target``, ``repeats`` and ``positions`` (moments from 0 to 1, one per repeat).

    ``weights`` go round over the sources by name (code points, null last) and share out the sum of ``size``; no source
    is asked for more than ``repeats`` times its size. A source's weight changes over time by its slope (they go round
    likewise): 1 - slope of its mean at the start, 1 + slope at the end. Its documents come in a seeded order of their
    ids, again and again; the last round takes those whose middle lies before the target, so a source misses its target
    by at most half a document. Documents of size 0 follow the same rule.

    Each row is one document; rows with a null source are a source of their own, null ids and equal ids are put in
    order by the remaining columns, and rows equal throughout take places side by side. No rows give no rows. Columns
    of ``docs`` with the names of the four, or starting with two underscores, are replaced.
    """
    kept = [c for c in docs.columns if not c.startswith("__") and c not in _ADDED]
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    if any(abs(s) >= 1 for s in slopes):
        raise ValueError("slopes must lie between -1 and 1")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(2 * parts, math.ceil(docs.count() / CHUNK_ROWS))
    leading = F.conv(F.substring("__key", 1, 8), 16, 10).cast("long")
    rows = docs.select(*kept).withColumn("__key", key)
    rows = rows.withColumn("__chunk", F.floor(leading * F.lit(float(chunks)) / F.lit(float(1 << 32))).cast("long"))
    rows = rows.withColumn("__source", F.struct("source"))
    per_chunk = rows.groupBy("__source", "__chunk").agg(F.sum(size).alias("__words"))
    sources = per_chunk.groupBy("__source").agg(F.sum("__words").alias("source_size"))
    sources = sources.select(F.col("__source.source").alias("source"), "source_size")
    targets = _targets(sources, weights, repeats)
    slope = F.lit(0.0)
    if slopes:
        of = [F.when(F.col("weight") == w, F.lit(s)) for w, s in zip(weights, slopes * len(weights))]
        slope = F.coalesce(*of, slope)
    targets = targets.select(F.struct("source").alias("__source"), "source_size", "target", slope.alias("__slope"))
    earlier = Window.partitionBy("__source").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(
        "__source", "__chunk", F.coalesce(F.sum("__words").over(earlier), F.lit(0)).alias("__before")
    ).join(targets, "__source")
    tie = [F.xxhash64(*[F.col(f"`{c}`") for c in kept if c in ("doc_id", "source", size)])]
    within = Window.partitionBy("__source", "__chunk").orderBy("__key", *tie, size).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    placed = rows.withColumn("__upto", F.sum(size).over(within)).join(offsets, ["__source", "__chunk"])
    middle = F.col("__before") + F.col("__upto") - F.col(size) / 2
    rounds = F.when(
        F.col("source_size") > 0,
        F.greatest(F.lit(0), F.ceil((F.col("target") - middle) / F.col("source_size"))),
    ).otherwise(0)
    placed = placed.withColumn("repeats", F.least(rounds, F.lit(repeats)).cast("int")).withColumn("__middle", middle)
    moment = lambda i: _moment(
        F.col("__middle") + i * F.col("source_size"), F.col("target"), F.col("__slope")
    )
    turns = F.slice(F.array(*[F.lit(i) for i in range(repeats)]), 1, "repeats")
    placed = placed.withColumn("positions", F.transform(turns, moment))
    return placed.select(*kept, *_ADDED)


_ADDED = ("source_size", "target", "repeats", "positions")


def in_training_order(planned: DataFrame) -> DataFrame:
    """One row per document and repeat, range-sorted by ``position``; documents that are not taken go."""
    kept = [c for c in planned.columns if c not in _ADDED]
    turns = planned.select(*kept, F.explode("positions").alias("position"))
    parts = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return turns.repartitionByRange(parts, "position").sortWithinPartitions("position", "doc_id")
