"""Writers: results, metrics, parameters and cached copies."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import hash60


def write_results(results: DataFrame, path: str, order_by: str | None = None, mode: str = "errorifexists") -> None:
    """JSON Lines, ``generated_texts`` kept as an array; ``order_by`` sorts the files by the prompt order."""
    if order_by is not None:
        results = results.orderBy(order_by)
    results.write.mode(mode).json(path)


METRICS = "run string, step long, metric string, value double"


def append_metrics(metrics: DataFrame, path: str, batch: str | None = None) -> str:
    """Append ``(run, step, metric, value)`` rows as one batch, and return the batch's name.

    A batch is a folder that Spark's writer commits as a whole: what a failed task or job wrote is never read, and a batch
    that is written again under its name replaces itself, so it counts once. Files hold ranges of runs, sorted by run and
    step, so a reader of one run skips most of them; there is no folder per run.
    """
    batch = batch or uuid.uuid4().hex
    if not re.fullmatch(r"[\w-]+", batch):
        raise ValueError(f"a batch is named by letters, digits, - and _: {batch!r}")
    rows = metrics.select("run", "step", "metric", "value")
    parts = int(metrics.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "run", "step").sortWithinPartitions("run", "step")
    ranged.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
    return batch


def read_metrics(spark: SparkSession, path: str, schema: T.StructType | str = METRICS) -> DataFrame:
    """All rows that ``append_metrics`` and ``append_stream_metrics`` wrote, each batch once."""
    own = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    with_batch = T.StructType([*own.fields, T.StructField("batch", T.StringType())])
    return spark.read.schema(with_batch).parquet(path).select(own.fieldNames())


def _leaves(schema: T.StructType, prefix: str = "") -> list[str]:
    found = []
    for f in schema.fields:
        name = f"{prefix}{f.name}"
        found += _leaves(f.dataType, f"{name}.") if isinstance(f.dataType, T.StructType) else [name]
    return found


def params_long(df: DataFrame, run: str) -> DataFrame:
    """One ``(run, name, value)`` row per leaf field of each run's parameters; nulls stay as rows."""
    leaves = [c for c in _leaves(df.schema) if c != run]
    flat = df.select(F.col(run).alias("run"), *[F.col(c).cast("string").alias(c) for c in leaves])
    return flat.unpivot("run", [f"`{c}`" for c in leaves], "name", "value")


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Write a table once and go on from the written copy."""
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def _source_version(spark: SparkSession, data_path: str) -> str:
    """Fingerprint of the names, sizes and times of the source files (listing only)."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(data_path)
        row = files.select(hash60(F.col("path"), F.col("length"), F.col("modificationTime")).alias("h")).agg(
            F.expr("bit_xor(h)").alias("h"), F.count(F.lit(1)).alias("n")
        )
        h, n = row.first()
        return f"{n}-{h or 0:015x}"
    except AnalysisException:
        raise ValueError(f"cache_dir needs files to watch, and {data_path} has none") from None


def cached_copy(
    spark: SparkSession, data_path: str, cache_dir: str, build: Callable[[], DataFrame], *settings: object
) -> DataFrame:
    """Parquet copy of ``build()`` below ``cache_dir``, kept until the source files or the settings change.

    A copy counts once the mark beside it names its folder, so what a killed job left behind is written anew. Jobs that
    find no mark at the same time write folders of their own, and the mark that is written last counts.
    """
    import hashlib

    key = hashlib.md5(repr((data_path, _source_version(spark, data_path), settings)).encode()).hexdigest()
    base = f"{cache_dir.rstrip('/')}/{key}"
    mark = f"{base}/complete"
    try:
        marked = spark.read.schema("name string").parquet(mark).first()
    except AnalysisException:
        marked = None
    if marked is None or marked.name is None:
        folder = f"data-{uuid.uuid4().hex}"
        build().write.mode("errorifexists").parquet(f"{base}/{folder}")
        spark.range(1).select(F.lit(folder).alias("name")).coalesce(1).write.mode("overwrite").parquet(mark)
        return spark.read.parquet(f"{base}/{folder}")
    return spark.read.parquet(f"{base}/{marked.name}")


SOURCE_FILE = "__source_file"


def _file_version() -> Column:
    return hash60(F.col("_metadata.file_path"), F.col("_metadata.file_size"), F.unix_micros("_metadata.file_modification_time"))


def _file_versions(spark: SparkSession, path: str) -> list[int]:
    """Fingerprints of the files below a path as they are now (listing only)."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return [r.file for r in listing.select(_file_version().alias("file")).collect()]


def cached_files(
    spark: SparkSession, data_path: str, cache_dir: str, build: Callable[[], DataFrame], *settings: object
) -> DataFrame:
    """Parquet copy of ``build()``, rows out of one of Spark's own file readers, kept file by file below ``cache_dir``.

    A source file is known by its path, size and time. ``rows`` holds a folder of rows per file, ``files`` a table of the
    files that some job has copied whole. Files that the table has are taken from there; only the others are read, and
    join the table by one file of its own, the last thing that a job writes. So a killed job leaves nothing that counts,
    and where two jobs copy the same file, one of the copies is used. Another schema or other settings are another copy.
    A source that changes while it is copied is an error. The driver gets a number per file, as it does to plan a scan.
    """
    import hashlib

    present = _file_versions(spark, data_path)
    source = build()
    key = hashlib.md5(repr((data_path, source.schema.json(), settings)).encode()).hexdigest()
    base = f"{cache_dir.rstrip('/')}/{key}"

    def known() -> dict[int, tuple[str, int]]:
        copied = spark.read.schema("file bigint, batch string, n_rows bigint").parquet(f"{base}/files")
        copied = copied.join(spark.createDataFrame([(f,) for f in present], "file bigint"), "file", "left_semi")
        one = copied.groupBy("file").agg(F.min_by(F.struct("batch", "n_rows"), "batch").alias("copy"))
        return {r.file: (r.copy.batch, r.copy.n_rows) for r in one.select("file", "copy").collect()}

    if not present:
        return source
    try:
        copies = known()
    except AnalysisException:  # nothing has been copied yet
        copies = {}
    missing = [f for f in present if f not in copies]
    if missing:
        batch = uuid.uuid4().hex
        folder = f"{base}/rows/{batch}"
        # files are told by their metadata, so Spark leaves the others out of the scan
        rows = source.withColumn(SOURCE_FILE, _file_version())
        chosen = rows.where(_file_version().isin(missing)) if copies else rows
        chosen.write.partitionBy(SOURCE_FILE).parquet(folder)
        if not set(missing) <= set(_file_versions(spark, data_path)):
            raise RuntimeError(f"files of {data_path} changed while they were copied: try again")
        marked = spark.createDataFrame([(f,) for f in missing], "file bigint")
        written = spark.read.schema(f"{SOURCE_FILE} bigint").parquet(folder)
        sizes = written.groupBy(F.col(SOURCE_FILE).alias("file")).agg(F.count(F.lit(1)).alias("n"))
        marked = marked.join(sizes, "file", "left").select(
            "file", F.lit(batch).alias("batch"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_rows")
        )
        marked.coalesce(1).write.mode("append").parquet(f"{base}/files")
        copies = known()
    folders = sorted(f"{base}/rows/{batch}/{SOURCE_FILE}={file}" for file, (batch, n) in copies.items() if n)
    if not folders:
        return spark.createDataFrame([], source.schema)
    return spark.read.schema(source.schema).parquet(*folders)
