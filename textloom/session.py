"""Session settings and shared scratch folders."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# What a job on a cluster should set as well; local runs only change master and partition count.
RECOMMENDED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

_shipped: dict[str, str] = {}


def local_session(cores: int | str = "*", partitions: int = 8, app: str = "textloom", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for name, value in {**RECOMMENDED, **conf}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach: ``spark.checkpoint.dir``, or a temp folder in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = os.path.join(tempfile.gettempdir(), f"textloom-{spark.sparkContext.applicationId}")
    return root


def new_dir(spark: SparkSession, purpose: str) -> str:
    """A path below the shared folder that nothing has been written to yet."""
    return f"{shared_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def ship_package(spark: SparkSession) -> None:
    """Let Spark hand this package to the Python workers, once per application; needless where it is installed."""
    context = spark.sparkContext
    if _shipped.get("to") == context.applicationId:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    target = os.path.join(tempfile.mkdtemp(prefix="textloom-package-"), "textloom")
    context.addPyFile(shutil.make_archive(target, "zip", root, "textloom"))
    _shipped["to"] = context.applicationId
