"""Serving metrics per time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.operators.quantiles import exact_quantiles

# The latency quantiles reported.
QUANTILES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


def _counts() -> list[Column]:
    errors = F.count_if(F.col("status") == "error")
    return [
        F.count(F.lit(1)).alias("requests"),
        errors.alias("errors"),
        (errors / F.count(F.lit(1))).alias("error_rate"),
    ]


def _log(log: DataFrame, ts: str, status: str, latency: str) -> DataFrame:
    return log.select(F.col(ts).alias("ts"), F.col(status).alias("status"), F.col(latency).alias("latency"))


def window_metrics(
    log: DataFrame, ts: str = "ts", status: str = "status", latency: str = "latency", width: str = "15 seconds"
) -> DataFrame:
    """Requests, errors, error rate and exact latency quantiles per tumbling window of a table."""
    timed = _log(log, ts, status, latency).withColumn("w", F.window("ts", width))
    flat = timed.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "status", "latency")
    keys = ["window_start", "window_end"]
    quantiles = exact_quantiles(flat, keys, "latency", QUANTILES)
    return flat.groupBy(*keys).agg(*_counts()).join(quantiles, keys, "left")


def sketched_window_metrics(
    log: DataFrame,
    ts: str = "ts",
    status: str = "status",
    latency: str = "latency",
    width: str = "15 seconds",
    accuracy: int = 10_000,
) -> DataFrame:
    """The same in one aggregation, for tables and streams.

    Quantiles come from a mergeable sketch of fixed size: exact in windows of up to ``accuracy`` / 2 requests, beyond
    that off by at most one in ``accuracy`` ranks.
    """
    quantiles = F.percentile_approx("latency", list(QUANTILES.values()), accuracy)
    return (
        _log(log, ts, status, latency)
        .groupBy(F.window("ts", width).alias("w"))
        .agg(*_counts(), quantiles.alias("q"))
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            "requests",
            "errors",
            "error_rate",
            *[F.col("q")[i].alias(name) for i, name in enumerate(QUANTILES)],
        )
    )


# What a sketch keeps at most, as ``k`` of the KLL sketch; see ``rank_error``.
SKETCH_SIZE = 800


def rank_error(k: int = SKETCH_SIZE) -> float:
    """Largest difference in rank, as a share of all values, of a quantile out of sketches of size ``k`` (99% of the time).

    This is the published error of KLL sketches; merging sketches does not add to it. Sketches of up to ``k`` values are
    exact.
    """
    return 2.296 / k**0.9021


def window_sketches(
    log: DataFrame,
    ts: str = "ts",
    status: str = "status",
    latency: str = "latency",
    width: str = "15 seconds",
    k: int = SKETCH_SIZE,
) -> DataFrame:
    """``(window_start, window_end, requests, errors, latencies)`` per tumbling window, to be stored and merged later.

    ``latencies`` is a KLL sketch of some kilobytes, null where no request of the window has a latency.
    """
    timed = _log(log, ts, status, latency).withColumn("latency", F.col("latency").cast("double"))
    sketch = F.when(F.count("latency") > 0, F.kll_sketch_agg_double("latency", F.lit(k)))
    counts = [F.count(F.lit(1)).alias("requests"), F.count_if(F.col("status") == "error").alias("errors")]
    per_window = timed.groupBy(F.window("ts", width).alias("w")).agg(*counts, sketch.alias("latencies"))
    return per_window.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *per_window.columns[1:])


def roll_up(windows: DataFrame, width: str = "1 hour", k: int = SKETCH_SIZE) -> DataFrame:
    """Metrics per longer window out of stored ``window_sketches``, without the requests.

    A window counts where it begins, so ``width`` should be a multiple of theirs. Quantiles are off by ``rank_error`` at
    most, whatever the number of windows; a window without latencies has none.
    """
    merged = F.when(F.count("latencies") > 0, F.kll_merge_agg_double("latencies", F.lit(k)))
    longer = windows.groupBy(F.window("window_start", width).alias("w")).agg(
        F.sum("requests").alias("requests"), F.sum("errors").alias("errors"), merged.alias("latencies")
    )
    return longer.select(
        F.col("w.start").alias("window_start"),
        F.col("w.end").alias("window_end"),
        "requests",
        "errors",
        (F.col("errors") / F.col("requests")).alias("error_rate"),
        *[F.kll_sketch_get_quantile_double("latencies", F.lit(q)).alias(name) for name, q in QUANTILES.items()],
    )
