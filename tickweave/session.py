"""Session settings the jobs are written for."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    # wall-clock columns are microseconds since the epoch, always read as UTC
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # rows for Python tasks: each batch is held outside the heap by the JVM and again by the worker
    "spark.sql.execution.arrow.maxBytesPerBatch": "12m",
    "spark.sql.parquet.compression.codec": "zstd",
    # list hourly partition folders with a bounded number of tasks
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "64",
    # keyed state outside the heap, with timers and map state
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# settings a running session cannot change any more
STATIC_SETTINGS = {
    # no Python stack capture per column expression while plans are built
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "tickweave", master: str | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**STATIC_SETTINGS, **SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return tune(builder.getOrCreate())


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime-changeable settings to a session someone else built."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: their Python tasks import it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        folder = tempfile.TemporaryDirectory(prefix="tickweave-")  # removed when the driver ends
        spark.sparkContext.addPyFile(shutil.make_archive(f"{folder.name}/{package.name}", "zip", package.parent, package.name))
        _shipped[app] = folder


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for streaming checkpoints and cut lineage.

    A cluster names it in ``spark.checkpoint.dir``. Without that setting it lies in the warehouse, which driver and
    executors share as well; no machine-local temporary folder is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several parts of a plan read, and read it back.

    It lands in the shared folder, so a lost executor costs nothing that was computed.
    """
    path = f"{checkpoint_root(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
