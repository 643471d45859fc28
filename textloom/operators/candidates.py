"""Candidate filter: temperature, top-k, nucleus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ranking import CHUNK, GROUP, add_position, as_group, earlier_chunks, with_chunks

# Candidates per context up to which Spark limits each task's groups by itself.
FEW = 1000


def nucleus_filter(
    df: DataFrame,
    context: str,
    token: str,
    score: str,
    temperature: float = 1.0,
    top_k: int | None = 50,
    top_p: float = 0.9,
) -> DataFrame:
    """Candidates of each context that sampling may pick, with rank and renormalised probability.

    Top-k comes first; 0 or None switches it off. Up to ``FEW`` candidates per context each task passes on no more than
    those; beyond that the order of scores is cut into chunks whose counts and sums are put together, so that a context
    with as many candidates as a vocabulary, or more, is no task's. The candidate that crosses ``top_p`` stays. Null
    scores come last.
    """
    if temperature <= 0:
        raise ValueError("temperature must be above 0")
    if not 0 < top_p <= 1:
        raise ValueError("top_p must be in (0, 1]")
    if not top_k or top_k > FEW:
        return _by_chunks(df.select(context, token, score), context, token, score, temperature, top_k, top_p)
    ordered = Window.partitionBy(context).orderBy(F.desc(score), F.asc(token))
    whole = Window.partitionBy(context)
    ranked = df.select(context, token, score).withColumn("rank", F.row_number().over(ordered))
    ranked = ranked.where(F.col("rank") <= top_k)
    raised = F.exp((F.col(score) - F.max(score).over(whole)) / F.lit(float(temperature)))
    weighted = ranked.withColumn("__e", raised)
    shares = weighted.withColumn("__p", F.col("__e") / F.sum("__e").over(whole))
    if top_p < 1:
        before = F.sum("__p").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
        shares = shares.withColumn("__before", F.coalesce(before, F.lit(0.0))).where(F.col("__before") < top_p)
    return shares.withColumn("probability", F.col("__p") / F.sum("__p").over(whole)).select(
        context, token, F.col("rank").cast("bigint").alias("rank"), "probability"
    )


def _by_chunks(
    df: DataFrame, context: str, token: str, score: str, temperature: float, top_k: int | None, top_p: float
) -> DataFrame:
    """The same for any number of candidates per context: ranks and running sums by chunk, on top of those of the chunks
    before."""
    highest = df.groupBy(F.struct(context).alias(GROUP)).agg(F.max(score).alias("__max"))
    falling = df.withColumn("__falling", F.coalesce(-F.col(score).cast("double"), F.lit(float("inf"))))
    ranked = add_position(falling, ["__falling", token], [context], into="rank")
    if top_k:
        ranked = ranked.where(F.col("rank") <= top_k)
    chunked = as_group(with_chunks(ranked, ["__falling", token]), [context])
    raised = F.exp((F.col(score) - F.col("__max")) / F.lit(float(temperature)))
    weighted = chunked.join(highest, GROUP).withColumn("__e", raised)
    sums = weighted.groupBy(GROUP, CHUNK).agg(F.sum("__e").alias("s"))
    before = sums.select(GROUP, CHUNK, F.coalesce(F.sum("s").over(earlier_chunks()), F.lit(0.0)).alias("__earlier"))
    total = sums.groupBy(GROUP).agg(F.sum("s").alias("__total"))
    inside = Window.partitionBy(GROUP, CHUNK).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    running = F.col("__earlier") + F.coalesce(F.sum("__e").over(inside), F.lit(0.0))
    shares = weighted.join(before, [GROUP, CHUNK]).join(total, GROUP).withColumn("__before", running / F.col("__total"))
    kept = shares.where(F.coalesce(F.col("__before") < top_p, F.lit(top_p == 1))) if top_p < 1 else shares
    kept_total = kept.groupBy(GROUP).agg(F.sum("__e").alias("__kept"))
    probability = (F.col("__e") / F.col("__kept")).alias("probability")
    return kept.join(kept_total, GROUP).select(context, token, F.col("rank").cast("bigint").alias("rank"), probability)
