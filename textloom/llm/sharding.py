"""Sharding by proportional stratified interleaving: every shard gets the mixture of the whole."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_ROWS = 16_384
OVERHEAD = 16


def row_size(text: str | Column) -> Column:
    """UTF-8 bytes of the text (none for null) plus ``OVERHEAD``."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("long")


def _ranked(rows: DataFrame, group: list[str], chunk: Column, order: list, into: str) -> DataFrame:
    """Rank from 0 along ``order`` within each group; ``chunk`` never falls along the order and cuts groups into parts.

    Counts per chunk, summed over the chunks before, are joined to ranks within the chunk, so that no task sorts more
    than a chunk.
    """
    chunked = rows.withColumn("__chunk", chunk)
    counts = chunked.groupBy(*group, "__chunk").agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.partitionBy(*group).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, "__chunk", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    nth = F.row_number().over(Window.partitionBy(*group, "__chunk").orderBy(*order))
    ranked = chunked.withColumn("__nth", nth).join(offsets, [*group, "__chunk"])
    return ranked.withColumn(into, F.col("__before") + F.col("__nth") - 1).drop("__chunk", "__before", "__nth")


def place(position: Column, total: int, shards: int) -> tuple[Column, Column]:
    """Shard and slot of a position from 0 to ``total`` - 1, in whole numbers, as a rounded quotient may reach the next
    shard."""
    whole = lambda value: value.cast("decimal(20,0)")
    number, of = F.lit(shards), F.lit(total)
    shard_of = F.call_function("div", whole(position) * number, whole(of)).cast("int")
    first = F.call_function("div", whole(shard_of) * of + (number - 1), whole(number))
    return shard_of, (position - first).cast("long")


def shard(docs: DataFrame, shards: int = 40, seed: int = 5) -> DataFrame:
    """``docs`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (from 0 in each shard, without gaps).

    Rows of a source are put in a seeded order of ``doc_id``. The i-th of n gets the fraction (i + phase) / n, the phase
    being the source's own, from its name; rows sorted by fraction are the interleaved sources, and cut into equal
    counts they are shards that differ by one row at most and hold each source in its share, to within a row or two.

    A null source is a source of its own. Rows with equal or null ids are told apart by a hash of all columns; rows that
    are equal throughout take neighbouring places, in either order. Fewer rows than shards leave shards empty, and no
    rows give none. Columns of ``docs`` called ``shard`` or ``slot`` are replaced, and such that start with two
    underscores are dropped. Carry only narrow columns: they move twice, and the text can be joined by its key.
    """
    kept = [c for c in docs.columns if not c.startswith("__") and c not in ("shard", "slot")]
    count = docs.count()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(2 * parts, math.ceil(count / CHUNK_ROWS))
    rows = docs.select(*kept)
    columns = [F.col(f"`{c}`") for c in kept]
    rows = rows.withColumn("__key", F.xxhash64(F.lit(seed), "doc_id", *columns)).withColumn("__source", F.struct("source"))
    share = (F.col("__key").cast("double") + 2.0**63) / 2.0**64
    order = ["__key", "doc_id"]
    in_source = _ranked(rows, ["__source"], F.floor(share * chunks).cast("long"), order, "__rank")
    sizes = rows.groupBy("__source").agg(F.count(F.lit(1)).alias("__size"))
    phase = F.pmod(F.xxhash64(F.lit(seed), "__source"), F.lit(1 << 20)) / float(1 << 20)
    placed = in_source.join(sizes, "__source").withColumn("__fraction", (F.col("__rank") + phase) / F.col("__size"))
    chunk = F.floor(F.col("__fraction") * chunks).cast("long")
    whole = placed.withColumn("__all", F.lit(0))
    positioned = _ranked(whole, ["__all"], chunk, ["__fraction", "__source", *order], "__position")
    shard_of, slot = place(F.col("__position"), max(1, count), shards)
    return positioned.select(*kept, shard_of.alias("shard"), slot.alias("slot"))
