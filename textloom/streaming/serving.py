"""Streams of requests, responses and serving metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from textloom.operators.generation import Generator, generate, to_response
from textloom.operators.monitoring import sketched_window_metrics
from textloom.sources.sinks import append_metrics


def stream_metrics(
    log: DataFrame,
    ts: str = "ts",
    status: str = "status",
    latency: str = "latency",
    width: str = "15 seconds",
    delay: str = "1 minute",
    accuracy: int = 10_000,
) -> DataFrame:
    """Window metrics of a request stream; a window is final once the watermark, ``delay`` behind, has passed it.

    Event times without a zone become timestamps, which watermarks need. Quantiles are sketched: in windows of more than
    ``accuracy`` / 2 requests they may differ from the exact ones of ``window_metrics`` by one rank in ``accuracy``.
    """
    timed = log.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return sketched_window_metrics(timed, ts, status, latency, width, accuracy)


def stream_responses(requests: DataFrame, make_generator: Callable[[], Generator], batch_size: int = 8) -> DataFrame:
    """Requests in, responses out, one per request; a request that fails becomes a row with status ``error``."""
    return to_response(generate(requests, make_generator, batch_size=batch_size))


def write_stream(df: DataFrame, path: str, checkpoint: str, once: bool = False, mode: str = "append") -> StreamingQuery:
    """Start writing Parquet files, exactly once per row; ``once`` handles what is there now and then stops."""
    writer = df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start(path)


# The setting that names the state store, and the store that keyed state with maps and timers needs.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def write_latest(
    df: DataFrame, path: str, checkpoint: str, once: bool = False, keyed_state: bool = False
) -> StreamingQuery:
    """Write every change of a grouped stream, each micro-batch to its own folder; ``read_latest`` gives the state.

    Groups are there from their first row on, and not only once the watermark has closed them. A batch that is run again
    after a failure replaces its folder. ``keyed_state`` starts this query, and no other, with the state store that
    ``stream_early_stop`` needs.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    writer = df.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    if not keyed_state:
        return writer.start()
    conf = df.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, ROCKSDB)
    try:
        return writer.start()  # a query keeps the settings it was started with
    finally:
        conf.set(STORE, before) if before else conf.unset(STORE)


def read_latest(spark: SparkSession, path: str, schema: StructType, keys: list[str]) -> DataFrame:
    """The latest row of each group out of what ``write_latest`` wrote."""
    # the folders' names give the column ``batch``
    written = spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(path)
    latest = F.max_by(F.struct(*schema.names), "batch").alias("row")
    return written.groupBy(*keys).agg(latest).select("row.*")


def append_stream_metrics(metrics: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append each micro-batch of ``(run, step, metric, value)`` rows, to be read by ``read_metrics``.

    A batch that is run again after a failure replaces what it wrote, so no metric is counted twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        append_metrics(batch, path, f"stream-{batch_id}")

    writer = metrics.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if once:
        writer = writer.trigger(availableNow=True)
    return writer.start()
