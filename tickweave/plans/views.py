"""Synchrophasor views over the driver tables, as DataFrames and as SQL text.

FIXTURES.md (part B) states the formulas. Each view is derived from whole tables, so
the work of a query over it grows with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickweave.functions.phasor import angle_diff
from tickweave.operators.quality import drop_rejected, quality_gate
from tickweave.plans.registry import sql_view

HOUR_US = 3_600_000_000
QUARTER_US = 900_000_000
LIVE_US = HOUR_US  # how fresh the last frame of a connected device is in these tables
V1_US, V2_US = 1_704_067_200_000_000, 1_705_276_800_000_000  # 2024-01-01, 2024-01-15


_SCHEMAS: dict[str, StructType] = {}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; its footer is read for the schema only once per process."""
    path = f"{sf}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def micros(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp"))


def d6(c) -> Column:
    """Six decimals without a negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def wrap(x: Column) -> Column:
    return angle_diff(F.lit(0.0), x)


def pmu_of(k: Column) -> Column:
    return F.concat(F.lit("10.0.0."), k.cast("string"), F.lit(":4712"))


def frames(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("event_id")
    base = table(spark, sf, "events").select(
        e.alias("arrival_seq"),
        pmu_of(F.col("user_id") % 8).alias("pmu_id"),
        micros("ts").alias("meas_us"),
        (micros("ts") + (e * 7919) % 8000 * 1000).alias("received_us"),
        (
            F.when((F.col("event_type") == "error") & (e % 2 == 0), 16384).when(e % 13 == 0, 1024).otherwise(0)
            + e % 16
        )
        .cast("int")
        .alias("stat"),
        (50 + (F.col("value") - 50) / 25).alias("freq"),
        F.lit(50).alias("fnom"),
        (((e * 37) % 41 - 20) / 100.0).alias("rocof"),
        (230 + F.col("value") / 10).alias("va_mag"),
        ((e * 37) % 360 - 180).cast("double").alias("va_deg"),
        (F.col("value") / 10).alias("ia_mag"),
        F.array(F.col("value"), 0.3 * F.col("value")).alias("analogs"),
        F.array((e % 65536).cast("int")).alias("digitals"),
    )
    va, deg = F.col("va_mag"), F.col("va_deg")
    return base.select(
        "*",
        (va * 0.99).alias("vb_mag"),
        wrap(deg - 120).alias("vb_deg"),
        (va * 1.01).alias("vc_mag"),
        wrap(deg + 120).alias("vc_deg"),
        wrap(deg - 30).alias("ia_deg"),
    )


def _wrap_sql(x: str) -> str:
    return f"(CASE WHEN {x} > 180 THEN {x} - 360 WHEN {x} < -180 THEN {x} + 360 ELSE {x} END)"


sql_view(
    "frames",
    f"""
SELECT *, 0.99::DOUBLE * va_mag AS vb_mag, {_wrap_sql('(va_deg - 120)')} AS vb_deg,
  1.01::DOUBLE * va_mag AS vc_mag, {_wrap_sql('(va_deg + 120)')} AS vc_deg, {_wrap_sql('(va_deg - 30)')} AS ia_deg
FROM (
  SELECT event_id AS arrival_seq, '10.0.0.' || (user_id % 8) || ':4712' AS pmu_id, epoch_us(ts) AS meas_us,
    epoch_us(ts) + ((event_id * 7919) % 8000) * 1000 AS received_us,
    CAST(CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 16384 WHEN event_id % 13 = 0 THEN 1024 ELSE 0 END
      + event_id % 16 AS INTEGER) AS stat,
    50 + (value - 50) / 25 AS freq, 50 AS fnom, ((event_id * 37) % 41 - 20) / 100.0::DOUBLE AS rocof,
    230 + value / 10 AS va_mag, ((event_id * 37) % 360 - 180)::DOUBLE AS va_deg, value / 10 AS ia_mag,
    value AS analog1, 0.3::DOUBLE * value AS analog2, CAST(event_id % 65536 AS INTEGER) AS digital
  FROM events)
""",
)


def frames_edge(spark: SparkSession, sf: str) -> DataFrame:
    """Stamps floored to 15 minutes: duplicate keys and samples half a period off the grid."""
    return frames(spark, sf).withColumn("meas_us", F.col("meas_us") - F.col("meas_us") % QUARTER_US)


sql_view("frames_edge", f"SELECT * REPLACE (meas_us - meas_us % {QUARTER_US} AS meas_us) FROM frames")


def frames_bench(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    return li.select(
        (k * 8 + n).alias("arrival_seq"),
        pmu_of(F.col("l_suppkey") % 64).alias("pmu_id"),
        (micros("l_shipdate") + (k * 7 + n * 3571) % 86400 * 1_000_000).alias("meas_us"),
        (50 + (F.col("l_quantity") - 25) / 50).alias("freq"),
        (F.col("l_extendedprice") / 100).alias("va_mag"),
    )


sql_view(
    "frames_bench",
    """
SELECT l_orderkey * 8 + l_linenumber AS arrival_seq, '10.0.0.' || (l_suppkey % 64) || ':4712' AS pmu_id,
  epoch_us(l_shipdate) + ((l_orderkey * 7 + l_linenumber * 3571) % 86400) * 1000000 AS meas_us,
  50 + (l_quantity - 25) / 50 AS freq, l_extendedprice / 100 AS va_mag
FROM lineitem
""",
)


def frames_dense(spark: SparkSession, sf: str) -> DataFrame:
    """The same devices at about 25 frames a second: one frame per 40 ms in event order."""
    e = F.col("event_id")
    base = V1_US + F.floor(e / 8) * 40_000
    return table(spark, sf, "events").select(
        e.alias("arrival_seq"),
        pmu_of(e % 8).alias("pmu_id"),
        (base + (e * 31) % 7 * 100).alias("meas_us"),
        (base + 5_000 + (e * 7919) % 3_000 + F.when(e % 4001 < 8, 900_000).otherwise(0)).alias("received_us"),
        (50 + (F.col("value") - 50) / 25).alias("freq"),
        F.lit(25).alias("data_rate"),
    )


def gated(spark: SparkSession, sf: str) -> DataFrame:
    return quality_gate(frames(spark, sf))


def accepted(spark: SparkSession, sf: str) -> DataFrame:
    return drop_rejected(gated(spark, sf))


sql_view(
    "gated",
    """
SELECT *, reject_reason IS NULL AS quality_ok FROM (
  SELECT *, CASE
    WHEN abs(received_us - meas_us) > 5000000 THEN 'timestamp skew too high: ' || rtrim(rtrim(
      (abs(received_us - meas_us) // 1000000) || '.' || lpad(CAST(abs(received_us - meas_us) % 1000000 AS VARCHAR), 6, '0'),
      '0'), '.') || 's'
    WHEN (stat >> 14) & 3 <> 0 THEN 'bad status flag: ' || ((stat >> 14) & 3)
    WHEN (stat >> 10) & 1 = 1 THEN 'PMU unsynchronized (STAT bit 10)'
    WHEN freq < 45 OR freq > 65 THEN 'frequency out of range: ' || printf('%.3f', freq) END AS reject_reason
  FROM frames)
""",
)
sql_view("accepted", "SELECT * FROM gated WHERE quality_ok")


VENDORS = 3
VOLTAGES = ["765 kV", "400 kV", "220 kV", "HVDC"]


def registry(spark: SparkSession, sf: str) -> DataFrame:
    """One registered device per nation; most of them never send."""
    k = F.col("n_nationkey")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        pmu_of(k).alias("name"),
        F.concat(F.lit("10.0.0."), k.cast("string")).alias("ip"),
        F.lit(4712).alias("port"),
        F.lit("tcp").alias("protocol"),
        F.col("n_name").alias("station"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("vendor-"), (k % VENDORS).cast("string")).alias("vendor"),
        F.element_at(F.array(*map(F.lit, VOLTAGES)), (k % len(VOLTAGES) + 1).cast("int")).alias("voltage"),
        F.when(k % 3 == 0, 25).when(k % 3 == 1, 50).otherwise(-5).alias("data_rate"),
        (k != 7).alias("active"),
    )


sql_view(
    "registry",
    """
SELECT '10.0.0.' || n_nationkey || ':4712' AS name, '10.0.0.' || n_nationkey AS ip, 4712 AS port, 'tcp' AS protocol,
  n_name AS station, r_name AS region, 'vendor-' || (n_nationkey % 3) AS vendor,
  (['765 kV', '400 kV', '220 kV', 'HVDC'])[n_nationkey % 4 + 1] AS voltage,
  CASE n_nationkey % 3 WHEN 0 THEN 25 WHEN 1 THEN 50 ELSE -5 END AS data_rate, n_nationkey <> 7 AS active
FROM nation JOIN region ON n_regionkey = r_regionkey
""",
)

TZ_SAMPLES = ["IST", " utc ", "", "Local", "UTC+05:30", "Asia/Calcutta", "Europe/Berlin"]


def registry_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Registration forms as typed: stray blanks, mixed case, unset numbers."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("form_id"),
        F.when(k % 11 == 0, F.concat(F.lit(" 127.0.0."), (k % 250).cast("string")))
        .when(k % 23 == 0, F.lit("  "))
        .otherwise(F.concat(F.lit(" 10.1."), F.floor(k / 250).cast("string"), F.lit("."), (k % 250).cast("string"), F.lit(" ")))
        .alias("ip"),
        F.when(k % 29 == 0, 0).otherwise(4700 + k % 20).cast("int").alias("port"),
        F.when(k % 5 == 0, "UDP").when(k % 5 == 1, " udp").when(k % 5 == 2, "Tcp").otherwise("").alias("protocol"),
        F.lit(4713).alias("tcp_port"),
        F.when(k % 3 == 0, 0).otherwise(k % 90).cast("int").alias("timeout_sec"),
        F.when(k % 4 == 0, -1).otherwise(k % 30).cast("int").alias("reconnect_sec"),
        F.when(k % 6 == 0, "").otherwise(F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit(" "))).alias("station"),
        F.element_at(F.array(*map(F.lit, TZ_SAMPLES)), (k % len(TZ_SAMPLES) + 1).cast("int")).alias("timestamp_tz"),
        F.when(k % 7 == 0, F.concat(F.lit("old-"), k.cast("string"))).otherwise("").alias("name"),
        (k % 9 != 0).alias("active"),
    )


sql_view(
    "registry_forms",
    """
SELECT c_custkey AS form_id,
  CASE WHEN c_custkey % 11 = 0 THEN ' 127.0.0.' || (c_custkey % 250) WHEN c_custkey % 23 = 0 THEN '  '
    ELSE ' 10.1.' || (c_custkey // 250) || '.' || (c_custkey % 250) || ' ' END AS ip,
  CAST(CASE WHEN c_custkey % 29 = 0 THEN 0 ELSE 4700 + c_custkey % 20 END AS INTEGER) AS port,
  CASE c_custkey % 5 WHEN 0 THEN 'UDP' WHEN 1 THEN ' udp' WHEN 2 THEN 'Tcp' ELSE '' END AS protocol, 4713 AS tcp_port,
  CAST(CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey % 90 END AS INTEGER) AS timeout_sec,
  CAST(CASE WHEN c_custkey % 4 = 0 THEN -1 ELSE c_custkey % 30 END AS INTEGER) AS reconnect_sec,
  CASE WHEN c_custkey % 6 = 0 THEN '' ELSE ' ' || c_mktsegment || ' ' END AS station,
  (['IST', ' utc ', '', 'Local', 'UTC+05:30', 'Asia/Calcutta', 'Europe/Berlin'])[c_custkey % 7 + 1] AS timestamp_tz,
  CASE WHEN c_custkey % 7 = 0 THEN 'old-' || c_custkey ELSE '' END AS name, c_custkey % 9 <> 0 AS active
FROM customer
""",
)


def cfg_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Two layout versions per sending device; the second doubles positive rates."""
    devices = frames(spark, sf).select("pmu_id").distinct()
    k = F.regexp_extract("pmu_id", r"10\.0\.0\.(\d+):", 1).cast("int")
    rate = F.when(k % 3 == 0, 25).when(k % 3 == 1, 50).otherwise(-5)
    both = devices.withColumn("version", F.explode(F.array(F.lit(1), F.lit(2))))
    return both.select(
        "pmu_id",
        "version",
        F.when(F.col("version") == 1, V1_US).otherwise(V2_US).alias("received_us"),
        F.when((F.col("version") == 2) & (rate > 0), rate * 2).otherwise(rate).alias("data_rate"),
        F.concat(F.lit("STN-"), k.cast("string")).alias("station"),
        (k + 1).alias("idcode"),
        F.lit(1_000_000).alias("time_base"),
        F.lit(1).alias("format"),
        F.lit(4).alias("phnmr"),
        F.lit(2).alias("annmr"),
        F.lit(1).alias("dgnmr"),
        F.lit(50).alias("fnom"),
        F.array(
            *map(F.lit, ["VA", "VB", "VC", "IA", "Analog1", "Analog2"]),
            *(F.lit(f"D{i}") for i in range(16)),
        ).alias("channels"),
    )


sql_view(
    "cfg_profile",
    f"""
SELECT pmu_id, version, CASE WHEN version = 1 THEN {V1_US} ELSE {V2_US} END AS received_us,
  CAST(CASE WHEN version = 2 AND rate > 0 THEN rate * 2 ELSE rate END AS INTEGER) AS data_rate, 'STN-' || k AS station
FROM (SELECT pmu_id, k, CASE k % 3 WHEN 0 THEN 25 WHEN 1 THEN 50 ELSE -5 END AS rate
  FROM (SELECT DISTINCT pmu_id, CAST(regexp_extract(pmu_id, '10\\.0\\.0\\.(\\d+):', 1) AS INTEGER) AS k FROM frames))
  CROSS JOIN (VALUES (1), (2)) v(version)
""",
)


def hop_samples(spark: SparkSession, sf: str) -> DataFrame:
    from tickweave.operators.windows import frame_gap

    f = frame_gap(frames(spark, sf))
    e = F.col("arrival_seq")
    parse, dash = (e * 31) % 1000 / 100.0, (e * 13) % 500 / 100.0
    samples = F.array(
        F.struct(F.lit("frame_gap").alias("stage"), F.col("frame_gap_ms").alias("ms")),
        F.struct(F.lit("parse").alias("stage"), parse.alias("ms")),
        F.struct(F.lit("align_wait").alias("stage"), ((e * 17) % 3000 / 100.0).alias("ms")),
        F.struct(F.lit("dashboard_record").alias("stage"), dash.alias("ms")),
        F.struct(F.lit("e2e_recv_to_dashboard").alias("stage"), (parse + dash).alias("ms")),
    )
    return (
        f.select("pmu_id", e.alias("seq"), F.explode(samples).alias("s"))
        .select("pmu_id", "seq", "s.stage", "s.ms")
        .filter(F.col("ms").isNotNull())
    )


sql_view(
    "hop_samples",
    """
SELECT * FROM (
  SELECT pmu_id, arrival_seq AS seq, unnest([
      {'stage': 'frame_gap', 'ms': gap}, {'stage': 'parse', 'ms': ((arrival_seq * 31) % 1000) / 100.0::DOUBLE},
      {'stage': 'align_wait', 'ms': ((arrival_seq * 17) % 3000) / 100.0::DOUBLE},
      {'stage': 'dashboard_record', 'ms': ((arrival_seq * 13) % 500) / 100.0::DOUBLE},
      {'stage': 'e2e_recv_to_dashboard',
       'ms': ((arrival_seq * 31) % 1000) / 100.0::DOUBLE + ((arrival_seq * 13) % 500) / 100.0::DOUBLE}], recursive := true)
  FROM (SELECT *, (received_us - lag(received_us) OVER (PARTITION BY pmu_id ORDER BY arrival_seq)) / 1000.0::DOUBLE AS gap
    FROM frames))
WHERE ms IS NOT NULL
""",
)

STAGES = {"signup": "connect", "view": "stream", "click": "handshake", "purchase": "quality", "error": "parse"}


def events_log(spark: SparkSession, sf: str) -> DataFrame:
    e, kind = F.col("event_id"), F.col("event_type")
    stage = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in STAGES.items()))
    return table(spark, sf, "events").select(
        e.alias("seq"),
        micros("ts").alias("time_us"),
        pmu_of(F.col("user_id") % 8).alias("pmu_id"),
        stage.alias("stage"),
        F.when(kind == "error", "error")
        .when((kind == "purchase") & (e % 5 == 0), "rejected")
        .otherwise("ok")
        .alias("status"),
        F.concat(kind, F.lit(" "), F.col("props")).alias("message"),
        F.col("props").alias("detail"),
    )


sql_view(
    "events_log",
    """
SELECT event_id AS seq, epoch_us(ts) AS time_us, '10.0.0.' || (user_id % 8) || ':4712' AS pmu_id,
  CASE event_type WHEN 'signup' THEN 'connect' WHEN 'view' THEN 'stream' WHEN 'click' THEN 'handshake'
    WHEN 'purchase' THEN 'quality' WHEN 'error' THEN 'parse' END AS stage,
  CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'purchase' AND event_id % 5 = 0 THEN 'rejected'
    ELSE 'ok' END AS status,
  event_type || ' ' || props AS message, props AS detail
FROM events
""",
)
