"""Run histories: every n-th step, best step, early stop, comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.operators.ranking import CHUNK, GROUP, as_group, earlier_chunks, join_chunks, with_chunks


def every_nth_step(df: DataFrame, n: int, step: str = "step") -> DataFrame:
    if n < 1:
        raise ValueError("n must be at least 1")
    return df.where(F.col(step) % n == 0)


def best_step(df: DataFrame, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """Step of the lowest loss of each run, the earliest on ties."""
    return df.groupBy(run).agg(
        F.min_by(step, F.when(F.col(loss).isNotNull(), F.struct(loss, step))).alias("best_step"),
        F.min(loss).alias("best_loss"),
    )


def early_stop(
    df: DataFrame,
    run: str,
    order_by: list[str],
    loss: str,
    patience: int = 3,
    chunks: int | None = None,
) -> DataFrame:
    """Number of evaluations, where each run would stop, and its best evaluation until then.

    A run stops at the first evaluation at which ``patience`` in a row did not beat the best loss before them. Steps
    count evaluations from 1; ``stop_step`` is null for a run that goes on.

    A long run is cut into chunks. A chunk needs two things from the ones before it: the best loss, and where the last
    improvement was. Both are prefix values over a table with one row per chunk.
    """
    chunked = as_group(with_chunks(df.select(run, *order_by, loss), order_by, chunks), [run])
    per_chunk = chunked.groupBy(GROUP, CHUNK).agg(F.count(F.lit(1)).alias("n"), F.min(loss).alias("low"))
    earlier = earlier_chunks()
    before = per_chunk.select(
        GROUP,
        CHUNK,
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__rows_before"),
        F.min("low").over(earlier).alias("__low_before"),
    )
    along = Window.partitionBy(GROUP, CHUNK).orderBy(*order_by)
    up_to_last = along.rowsBetween(Window.unboundedPreceding, -1)
    best_so_far = F.least(F.col("__low_before"), F.min(loss).over(up_to_last))
    improved = F.col(loss).isNotNull() & (best_so_far.isNull() | (F.col(loss) < best_so_far))
    step = (F.col("__rows_before") + F.row_number().over(along)).cast("bigint")
    marked = (
        join_chunks(chunked, before)
        .withColumns({"__step": step, "__improved": improved, "__best": F.least(best_so_far, F.col(loss))})
        .select(GROUP, CHUNK, "__step", "__best", F.when(F.col("__improved"), F.col("__step")).alias("__gain"))
    )
    last_gain = marked.groupBy(GROUP, CHUNK).agg(F.max("__gain").alias("m"))
    carried = last_gain.select(GROUP, CHUNK, F.max("m").over(earlier).alias("__gain_before"))
    by_step = Window.partitionBy(GROUP, CHUNK).orderBy("__step").rowsBetween(Window.unboundedPreceding, 0)
    gain = F.coalesce(F.greatest(F.col("__gain_before"), F.max("__gain").over(by_step)), F.lit(0))
    of_run = F.col(GROUP)[run].alias(run)
    state = join_chunks(marked, carried).select(of_run, "__step", "__best", gain.alias("__gain"))
    out = F.col("__step") - F.col("__gain") >= patience
    now = F.struct(F.col("__step").alias("step"), F.col("__gain").alias("gain"), F.col("__best").alias("best"))
    ends = state.groupBy(run).agg(
        F.max("__step").alias("n_steps"), F.min(F.when(out, now)).alias("stop"), F.max(now).alias("end")
    )
    last = F.coalesce("stop", "end")
    return ends.select(
        run,
        "n_steps",
        F.col("stop.step").alias("stop_step"),
        F.nullif(last.gain, F.lit(0)).alias("best_step"),
        last.best.alias("best_loss"),
    )


def compare_runs(
    df: DataFrame,
    metrics: Sequence[str],
    run: str = "run",
    metric: str = "metric",
    value: str = "value",
    step: str = "step",
    params: DataFrame | None = None,
) -> DataFrame:
    """One row per run: lowest and latest value of each metric, and the run's parameters if given."""
    wide = (
        df.groupBy(run)
        .pivot(metric, list(metrics))
        .agg(F.min(value).alias("min"), F.max_by(value, step).alias("last"))
    )
    return wide if params is None else wide.join(params, run, "left")
