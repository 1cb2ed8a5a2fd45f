"""Reading and writing capture dumps, spooled readings and history tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOUR_US = 3_600_000_000


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_TEXT, _INT, _LONG, _DOUBLE = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType()

# --- fixed values: columns of a raw capture dump, in file order ---
RAW_CAPTURE = _schema(
    index=_LONG, pmu_name=_TEXT, captured_at=T.TimestampType(), soc=_LONG, fracsec_raw=_LONG, fracsec_count=_LONG,
    lag_ms=_DOUBLE, raw_hex=_TEXT, raw_bytes=_INT,
)

RAW_FRAMES = _schema(arrival_seq=_LONG, pmu_id=_TEXT, received_us=_LONG, raw=T.BinaryType())

# the part of a spooled reading that the jobs use; other keys are ignored
SPOOLED = _schema(
    pmu_name=_TEXT, timestamp=_TEXT, soc=_LONG, fracsec_count=_LONG, idcode=_INT, stat_raw=_INT,
    frequency_hz=_DOUBLE, rocof_hz_per_sec=_DOUBLE, digital=_INT,
)


def read_raw_capture(spark: SparkSession, path: str) -> DataFrame:
    """A raw capture dump as ``raw_frames`` with the dump's own columns beside them."""
    rows = spark.read.schema(RAW_CAPTURE).csv(path, header=True)
    return rows.select(
        F.col("index").alias("arrival_seq"),
        F.col("pmu_name").alias("pmu_id"),
        F.unix_micros("captured_at").alias("received_us"),
        "soc",
        "fracsec_raw",
        "fracsec_count",
        "lag_ms",
        F.unhex("raw_hex").alias("raw"),
        "raw_bytes",
    )


def raw_capture_rows(frames: DataFrame) -> DataFrame:
    """``raw_frames`` with header fields as the rows of a raw capture dump."""
    return frames.select(
        F.col("arrival_seq").alias("index"),
        F.col("pmu_id").alias("pmu_name"),
        F.date_format(F.timestamp_micros("received_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("captured_at"),
        "soc",
        "fracsec_raw",
        "fracsec_count",
        F.format_string("%.3f", "lag_ms").alias("lag_ms"),
        F.lower(F.hex("raw")).alias("raw_hex"),
        F.length("raw").alias("raw_bytes"),
    )


def stream_raw_frames(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Raw frames as they land in a folder of Parquet files."""
    reader = spark.readStream.schema(RAW_FRAMES)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stream_raw_kafka(spark: SparkSession, servers: str, topic: str, max_offsets: int | None = None) -> DataFrame:
    """Raw frames from a topic keyed by device (needs the Kafka connector on the class path)."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    rows = reader.load()
    return rows.select(
        F.col("offset").alias("arrival_seq"),
        F.col("key").cast("string").alias("pmu_id"),
        F.unix_micros("timestamp").alias("received_us"),
        F.col("value").alias("raw"),
    )


def read_spooled(spark: SparkSession, path: str) -> DataFrame:
    """Spooled readings, one JSON document a line; blank lines vanish.

    A line that is no document stays as a row with ``bad_line`` set, so nothing is lost.
    """
    schema = T.StructType([*SPOOLED.fields, T.StructField("bad_line", _TEXT)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad_line"}
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.from_json("value", schema, options).alias("r")).select("r.*")


def spool_good(spooled: DataFrame) -> DataFrame:
    return spooled.filter(F.col("bad_line").isNull()).drop("bad_line")


def spool_bad(spooled: DataFrame) -> DataFrame:
    return spooled.filter(F.col("bad_line").isNotNull()).select("bad_line")


def spool_counts_by_pmu(good: DataFrame) -> DataFrame:
    """Pending readings per device; readings without a device count for SYSTEM."""
    device = F.coalesce(F.nullif(F.trim("pmu_name"), F.lit("")), F.lit("SYSTEM"))
    return good.groupBy(device.alias("pmu_id")).agg(F.count(F.lit(1)).alias("pending"))


# ------------------------------------------------------------------ history tables


def hour_of(us) -> Column:
    c = F.col(us) if isinstance(us, str) else us
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd-HH")


# bytes of a row group: small, so that a device's rows lie in few of them
ROW_GROUP_BYTES = 8 << 20


def write_frame_history(rows: DataFrame, path: str, mode: str = "append", files_per_hour: int = 8, files_per_device: int = 2) -> None:
    """History rows in hourly partitions, clustered by device and sorted by device and time inside each file.

    A device's rows of an hour go to ``files_per_device`` of its ``files_per_hour`` files, by their second, so neither a
    busy hour nor a busy device ends up in one task. Row groups hold a Bloom filter of their devices, so a read of one device
    skips those of others by range and by filter.
    """
    turn = F.pmod(F.xxhash64(F.floor(F.col("time_us") / 1_000_000)), F.lit(files_per_device))
    spread = F.pmod(F.pmod(F.xxhash64("pmu_id"), F.lit(files_per_hour)) + turn, F.lit(files_per_hour))
    # a fixed number of tasks: merging small ones would write the hours one after another
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        rows.withColumn("hour", hour_of("time_us"))
        .withColumn("_spread", spread)
        .repartition(tasks, "hour", "_spread")
        .sortWithinPartitions("hour", "pmu_id", "time_us")
        .drop("_spread")
        .write.mode(mode)
        .partitionBy("hour")
        .option("compression", "zstd")
        .option("parquet.block.size", ROW_GROUP_BYTES)
        .option("parquet.bloom.filter.enabled#pmu_id", "true")
        .option("parquet.bloom.filter.expected.ndv#pmu_id", "10000")
        .parquet(path)
    )


def read_history(
    spark: SparkSession,
    path: str,
    pmu: str | None = None,
    from_us: int | None = None,
    to_us: int | None = None,
    quality_ok: bool | None = None,
) -> DataFrame:
    """History rows of a device, a verdict and a time range, newest first.

    The time range is also put on the ``hour`` partition column, so other hours are not
    opened; device and time reach the Parquet row groups, which are sorted by both.
    """
    schema_read = spark.read.option("basePath", path).parquet(path)
    out = schema_read
    if from_us is not None:
        out = out.filter((F.col("hour") >= hour_of(F.lit(from_us))) & (F.col("time_us") >= from_us))
    if to_us is not None:
        out = out.filter((F.col("hour") <= hour_of(F.lit(to_us))) & (F.col("time_us") < to_us))
    if pmu is not None:
        out = out.filter(F.col("pmu_id") == pmu)
    if quality_ok is not None:
        out = out.filter(F.col("quality_ok") == quality_ok)
    return out.orderBy(F.desc("time_us"))


def write_events(rows: DataFrame, path: str) -> None:
    rows.withColumn("day", F.date_format(F.timestamp_micros("time_us"), "yyyy-MM-dd")).write.mode("append").partitionBy(
        "day"
    ).parquet(path)
