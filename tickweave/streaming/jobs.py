"""The continuous forms: the batch operators on streams, with event time and keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tickweave.functions import fleet
from tickweave.operators import align, decode, quality
from tickweave.operators.history import frame_history
from tickweave.streaming import stateful

BatchFn = Callable[[DataFrame], DataFrame]


def latest_layouts(layouts: DataFrame) -> DataFrame:
    """Per device the newest layout as STRUCT ``layout``, prepared for decoding."""
    ready = decode.prepare_layouts(layouts)
    return ready.groupBy("pmu_id").agg(F.max_by(F.struct(*decode.LAYOUT_OF_FRAME), "received_us").alias("layout"))


def stream_readings(raw: DataFrame, layouts: DataFrame) -> DataFrame:
    """Decoded readings of a raw stream; ``error`` is set on frames that do not decode.

    Layouts change rarely: the newest of each device is a static side of the join, and a
    restart of the query picks up new ones.
    """
    checked = decode.frame_validate(decode.frame_route(raw)).filter("frame_type = 'DATA'")
    joined = checked.withColumnRenamed("error", "_frame_error").join(latest_layouts(layouts), "pmu_id", "left")
    return decode.decode_data(joined).withColumn("error", F.coalesce("_frame_error", "error")).drop("_frame_error", "frame_type")


def stream_quality(readings: DataFrame, max_skew_us: int = quality.MAX_SKEW_US) -> DataFrame:
    """Gate verdicts on a stream of readings; stateless."""
    return quality.quality_gate(readings, max_skew_us)


def align_stream(readings: DataFrame, period_us: int, delay: str, capacity: int | None = None) -> DataFrame:
    """Aligned samples (device at tick) as soon as the watermark has passed the tick's window, by the rules of a table.

    All devices of a tick come out in the same micro-batch, so :func:`tickweave.operators.align.align_ticks` can be
    applied to each batch.
    """
    return stateful.aligned_samples(readings, period_us, delay, capacity)


def stream_sessions(frames: DataFrame, delay: str, width_us: int = 1_000_000) -> DataFrame:
    """`became_live` and `left_live` events of a stream of frames; ``data_rate`` sets the patience."""
    rate = F.col("data_rate") if "data_rate" in frames.columns else F.lit(0)
    return stateful.session_events(frames, fleet.liveness_timeout_us(rate), delay, width_us)


def stream_estimators(gated: DataFrame, ttl_ms: int | None = None) -> DataFrame:
    """Clock offset, frame rate, quality edges and trend points as state of each device.

    The row-by-row definitions are the ones the batch forms are built from. A device is one state key; its rows of a
    micro-batch are put in order in pages of state.
    """
    return stateful.estimates(gated, ["clock", "rate", "edge", "trend"], ttl_ms)


def stream_edges(gated: DataFrame) -> DataFrame:
    """Quality edges of a gated stream: a row where a device's verdict turns, or begins with a reject."""
    found = stateful.estimates(gated, ["edge"], changes=True)
    return found.select("pmu_id", "arrival_seq", "received_us", F.col("edge").alias("type"), "reason")


def stream_latest_state(delivered: DataFrame) -> DataFrame:
    """Running latest row and frame count per device (update or complete mode)."""
    last = F.max_by(F.struct("arrival_seq", "received_us", "meas_us", "freq", "stat"), "arrival_seq")
    return (
        delivered.groupBy("pmu_id")
        .agg(F.count(F.lit(1)).alias("total_frames"), last.alias("l"))
        .select("pmu_id", "total_frames", "l.*")
    )


# ------------------------------------------------------------------ running


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, tables: dict[str, BatchFn], mode: str = "append", interval: str | None = None
) -> StreamingQuery:
    """Start a query that writes each micro-batch to ``path/<table>/batch=<id>``.

    A batch that is run again after a failure overwrites its own folder, so every row
    lands exactly once. ``interval`` None: take what is there, then stop.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # several tables share one reading of the batch
        shared = batch.persist() if len(tables) > 1 else batch
        for name, fn in tables.items():
            fn(shared).write.mode("overwrite").parquet(f"{path}/{name}/batch={batch_id}")
        if len(tables) > 1:
            shared.unpersist()

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(write)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def read_batches(spark: SparkSession, path: str, table: str) -> DataFrame:
    return spark.read.option("basePath", f"{path}/{table}").parquet(f"{path}/{table}")


# ------------------------------------------------------------------ upserts


def upsert_batches(
    stream: DataFrame, path: str, checkpoint: str, key: str, buckets: int = 64, interval: str | None = None
) -> StreamingQuery:
    """Start a query in update mode whose changed rows replace those of their key in ``path``.

    Keys are dealt to buckets, and a bucket is a chain of versions. A batch writes a new version of the buckets with a changed
    key and of no other; run again after a failure it overwrites its own versions.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def write(batch: DataFrame, batch_id: int) -> None:
        changed = batch.withColumn("bucket", bucket).persist()
        touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # as many as there are buckets, at most
        if touched:
            known = _versions(batch.sparkSession, path, changed.drop("bucket").schema, batch_id)
            rows = changed
            if known is not None:
                old = newest_rows(known.filter(F.col("bucket").isin(touched)))
                rows = old.join(changed.select(key), key, "left_anti").unionByName(changed)
            rows.repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/version={batch_id}")
        changed.unpersist()

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)
    trigger = {"processingTime": interval} if interval else {"availableNow": True}
    return writer.trigger(**trigger).start()


def _versions(spark: SparkSession, path: str, schema: T.StructType, before: int | None = None) -> DataFrame | None:
    """All versions of all buckets, None if nothing has been written yet. Those of a batch that is run again don't count."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return None
    full = T.StructType([*schema.fields, T.StructField("bucket", T.IntegerType()), T.StructField("version", T.LongType())])
    rows = spark.read.schema(full).parquet(path)
    return rows if before is None else rows.filter(F.col("version") < before)


def newest_rows(versions: DataFrame) -> DataFrame:
    """The rows of each bucket's newest version."""
    newest = versions.groupBy("bucket").agg(F.max("version").alias("version"))
    return versions.join(newest, ["bucket", "version"], "left_semi").drop("version")


def read_upserts(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table as it stands."""
    found = _versions(spark, path, schema)
    return spark.createDataFrame([], schema) if found is None else newest_rows(found).drop("bucket")


def history_tables() -> dict[str, BatchFn]:
    """Frames of a gated stream, idempotent by batch."""
    return {"frames": frame_history}


def event_tables() -> dict[str, BatchFn]:
    """History events of the edges of a gated stream (:func:`stream_edges`), idempotent by batch."""

    def events(batch: DataFrame) -> DataFrame:
        detail = F.when(F.col("reason").isNotNull(), F.to_json(F.struct("reason")))
        return batch.select(F.col("received_us").alias("time_us"), "pmu_id", "type", "arrival_seq", detail.alias("detail"))

    return {"events": events}


def layout_tables() -> dict[str, BatchFn]:
    """Layout versions out of the CFG-2 frames of a raw stream."""

    def layouts(batch: DataFrame) -> DataFrame:
        return decode.decode_cfg2(decode.frame_route(batch).filter("frame_type = 'CFG2'"))

    return {"layouts": layouts}


def aligned_tables(expected: DataFrame) -> dict[str, BatchFn]:
    """Tick verdicts for each batch of :func:`align_stream`."""
    return {"points": lambda batch: batch, "ticks": lambda batch: align.align_ticks(batch, expected)}


def run_now(query: StreamingQuery) -> None:
    """Wait for a take-what-is-there query; raises what it failed with."""
    query.awaitTermination()
    if query.exception():
        raise query.exception()
