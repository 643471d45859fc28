"""Exact quantiles per group, without sorting a large group in one task."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ranking import CHUNK, GROUP, as_group, earlier_chunks, with_chunks


def exact_quantiles(
    df: DataFrame, group_by: list[str], value: str, quantiles: Mapping[str, float], chunks: int | None = None
) -> DataFrame:
    """One row per group with a column per quantile: the value at rank ``ceil(q * n)`` of the group, nulls left out.

    Values are cut into even chunks over the whole table. Counts per group and chunk tell in which chunk a rank falls.
    If that chunk has one value only, it is the answer; else only the rows of such chunks are ranked.
    """
    chunked = as_group(with_chunks(df.select(*group_by, value).where(F.col(value).isNotNull()), [value], chunks), group_by)
    cells = chunked.groupBy(GROUP, CHUNK).agg(
        F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high")
    )
    placed = cells.withColumn("before", F.coalesce(F.sum("n").over(earlier_chunks()), F.lit(0))).withColumn(
        "total", F.sum("n").over(Window.partitionBy(GROUP))
    )
    wanted = F.array(
        *[F.struct(F.lit(name).alias("name"), F.lit(q).alias("q")) for name, q in quantiles.items()]
    )
    targets = (
        placed.withColumn("w", F.explode(wanted))
        .withColumn("rank", F.ceil(F.col("w.q") * F.col("total")))
        .where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("n")))
        .select(GROUP, CHUNK, "before", "low", "high", F.col("w.name").alias("name"), "rank")
    )
    known = targets.where(F.col("low") == F.col("high")).select(GROUP, "name", F.col("low").alias("v"))
    open_chunks = targets.where(F.col("low") != F.col("high"))
    candidates = chunked.join(open_chunks.select(GROUP, CHUNK).distinct(), [GROUP, CHUNK])
    nth = F.row_number().over(Window.partitionBy(GROUP, CHUNK).orderBy(value))
    ranked = candidates.select(GROUP, CHUNK, F.col(value).alias("v"), nth.alias("nth"))
    found = (
        ranked.join(open_chunks, [GROUP, CHUNK]).where(F.col("rank") == F.col("before") + F.col("nth"))
    ).select(GROUP, "name", "v")
    wide = known.unionByName(found).groupBy(GROUP).pivot("name", list(quantiles)).agg(F.first("v"))
    return wide.select(*[F.col(f"{GROUP}.{c}").alias(c) for c in group_by], *quantiles)
