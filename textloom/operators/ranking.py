"""Positions in an order over a whole table or over groups that may be very large.

``row_number() over (order by key)`` runs in one task, and with a ``partition by`` it runs the biggest group in one
task. Here the order is cut into chunks of about equal size first; positions are counted inside each chunk, and a small
table of chunk counts tells how many rows come before it. Only a row's own values decide its chunk, so a lost executor
recomputes the same answer.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.session import new_dir
from textloom.sources.sinks import materialise

CHUNK = "__chunk"
GROUP = "__group"
PLACE = "__place"
TIE = "__tie"
_EXACT = float(1 << 53)


def default_chunks(df: DataFrame) -> int:
    """Twice the shuffle partitions, so that one chunk is at most half a task's usual share."""
    return max(2, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def _bucketed(df: DataFrame, source: str, cuts: list[float], into: str) -> DataFrame:
    """Number the ranges between ``cuts``; nulls come before all, NaN after all."""
    splits = [-math.inf, *cuts, math.inf]
    if len(splits) < 3:
        return df.withColumn(into, F.lit(0).cast("bigint"))
    bucketed = Bucketizer(splits=splits, inputCol=source, outputCol=into, handleInvalid="keep").transform(df)
    return bucketed.withColumn(into, (F.coalesce(F.col(into), F.lit(-1.0)) + 1).cast("bigint"))


def with_chunks(df: DataFrame, order_by: list[str], chunks: int | None = None) -> DataFrame:
    """Add a chunk number that never falls along ``order_by`` (ascending, nulls first).

    Keys are numbers, dates, timestamps, booleans or texts. The cuts are quantiles of the first key (one pass over that
    column; the driver gets the cuts only). A value so common that it fills m chunks gets a range of its own, and the
    second key cuts that range into m parts; with one key only, a hash of the row does, as the order of ties is free.
    With texts among the first two keys the rows are range-partitioned and stored instead.
    """
    n = chunks or default_chunks(df)
    if _has_text(df, order_by):
        return _by_range(df, order_by, n).drop(PLACE)
    names = ["__key0", "__key1"]
    numeric = df.withColumn(names[0], _as_number(df, order_by[0]))
    second_key = _as_number(df, order_by[1]) if len(order_by) > 1 else _row_hash(df)
    numeric = numeric.withColumn(names[1], second_key)
    quantiles = numeric.approxQuantile(names, [i / n for i in range(1, n)], 1.0 / (4 * n))
    filled = {v: m for v, m in Counter(quantiles[0]).items() if m > 1 and abs(v) < _EXACT}
    cuts = sorted(set(quantiles[0]) | {math.nextafter(v, math.inf) for v in filled})
    chunked = _bucketed(numeric, names[0], cuts, "__major")
    minor = F.lit(0)
    if filled:
        second = sorted(set(quantiles[1]))
        chunked = _bucketed(chunked, names[1], second, "__minor")
        parts = F.create_map(*[F.lit(x) for v, m in filled.items() for x in (v, m / (len(second) + 3))])
        minor = F.coalesce(F.floor(F.col("__minor") * F.try_element_at(parts, F.col(names[0]))), F.lit(0))
    chunk = F.col("__major") * n + minor
    return chunked.withColumn(CHUNK, chunk.cast("bigint")).drop(*names, "__major", "__minor")


def _has_text(df: DataFrame, order_by: list[str]) -> bool:
    return any(dict(df.dtypes)[k] == "string" for k in order_by[:2])


def _as_number(df: DataFrame, key: str) -> Column:
    dtype = dict(df.dtypes)[key]
    column = F.col(key)
    if dtype == "timestamp_ntz":
        return column.cast("timestamp").cast("double")
    if dtype == "date":
        return F.unix_date(column).cast("double")
    if dtype == "boolean":
        return column.cast("int").cast("double")
    return column.cast("double")


def _by_range(df: DataFrame, order_by: list[str], n: int) -> DataFrame:
    """Rows in ``n`` ranges of the keys and then their hash, for keys of any type, texts included; stored once, each range
    sorted, with its number and the row's place in it from 1.

    Spark's range sort finds the borders, which are whole keys: texts that begin alike, or are alike, are cut as others.
    A place that is stored stays, whatever is computed again after.
    """
    ranged = df.withColumn(TIE, _row_hash(df).cast("bigint")).repartitionByRange(n, *order_by, TIE)
    in_order = ranged.sortWithinPartitions(*order_by).drop(TIE)
    chunk, place = F.spark_partition_id().cast("bigint"), F.expr("(monotonically_increasing_id() & 8589934591) + 1")
    return materialise(in_order.withColumns({CHUNK: chunk, PLACE: place}), new_dir(df.sparkSession, "ranges"))


def _row_hash(df: DataFrame) -> Column:
    hashable = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    return F.xxhash64(*[F.col(f"`{c}`") for c in hashable]).cast("double")


def as_group(df: DataFrame, group_by: list[str]) -> DataFrame:
    """The group columns as one struct: structs of nulls are equal, so rows without a group are a group too."""
    return df.withColumn(GROUP, F.struct(*group_by) if group_by else F.lit(0))


def join_chunks(chunked: DataFrame, per_chunk: DataFrame) -> DataFrame:
    """Bring per-chunk values to the rows."""
    # how many chunks there are, which may be a caller's, and groups is the planner's to look at
    return chunked.join(per_chunk, [GROUP, CHUNK], "left")


def earlier_chunks():
    """All chunks of the group before this one; sorts one row per chunk, however many rows the group has."""
    return Window.partitionBy(GROUP).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)


def add_position(
    df: DataFrame,
    order_by: list[str],
    group_by: list[str] | None = None,
    into: str = "position",
    chunks: int | None = None,
    chunk: Column | None = None,
) -> DataFrame:
    """Dense position from 1 along ``order_by``, over the table or within each group.

    ``chunk`` replaces the quantile cuts by a given number that must never fall along the order (the caller bounds how
    many there are). Rows that ``order_by`` does not tell apart are numbered in any order.
    """
    stored = chunk is None and not group_by and _has_text(df, order_by)
    if chunk is not None:
        chunked = df.withColumn(CHUNK, chunk)
    elif stored:
        chunked = _by_range(df, order_by, chunks or default_chunks(df))
    else:
        chunked = with_chunks(df, order_by, chunks)
    chunked = as_group(chunked, group_by or [])
    counts = chunked.groupBy(GROUP, CHUNK).agg(F.count(F.lit(1)).alias("__n"))
    offsets = counts.select(GROUP, CHUNK, F.coalesce(F.sum("__n").over(earlier_chunks()), F.lit(0)).alias("__before"))
    nth = F.col(PLACE) if stored else F.row_number().over(Window.partitionBy(GROUP, CHUNK).orderBy(*order_by))
    if stored:
        offsets = F.broadcast(offsets)  # a row for each range, whose number is set above
    return (
        join_chunks(chunked, offsets)
        .withColumn(into, (F.col("__before") + nth).cast("bigint"))
        .drop(GROUP, CHUNK, PLACE, "__before")
    )
