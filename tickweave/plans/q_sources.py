"""Sources, sinks and exports."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tickweave.functions.bits import be_uint
from tickweave.operators import align, decode, exports, fleet_state, history, latency, windows
from tickweave.plans import views as v
from tickweave.plans.q_align import expected, hourly_ticks
from tickweave.plans.q_decode import layouts, raw_frames
from tickweave.plans.q_fleet import as_of, enabled
from tickweave.plans.registry import query, r6, sql_view
from tickweave.session import checkpoint_root
from tickweave.sources import tables

d6 = v.d6


def scratch(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@query(
    "src_raw_capture_csv",
    f"""
SELECT arrival_seq, pmu_id, received_us, meas_us // 1000000 AS soc, meas_us % 1000000 AS fracsec_count,
  round((received_us - meas_us) / 1000.0::DOUBLE, 3) AS lag_ms, CAST(CASE WHEN arrival_seq % 97 <> 0 AND arrival_seq % 101 = 0 THEN 39
    WHEN arrival_seq % 97 <> 0 AND arrival_seq % 103 = 0 THEN 47 ELSE 44 END AS INTEGER) AS raw_bytes, TRUE AS same_length
FROM frames
""",
)
def _(spark, sf):
    path = scratch(spark, "capture")
    timed = v.frames(spark, sf).select("arrival_seq", ((F.col("received_us") - F.col("meas_us")) / 1000.0).alias("lag_ms"))
    dump = tables.raw_capture_rows(decode.frame_envelope(raw_frames(spark, sf)).join(timed, "arrival_seq"))
    dump.write.csv(path, header=True)
    back = tables.read_raw_capture(spark, path)
    return back.select(
        "arrival_seq", "pmu_id", "received_us", "soc", "fracsec_count", "lag_ms", "raw_bytes",
        (F.length("raw") == F.col("raw_bytes")).alias("same_length"),
    )


def spooled(spark, sf):
    """A spool file of readings with blank and broken lines among them."""
    path = scratch(spark, "spool")
    e = F.col("arrival_seq")
    doc = F.to_json(
        F.struct(
            F.when(e % 19 == 0, " ").otherwise(F.col("pmu_id")).alias("pmu_name"),
            exports.iso_time("meas_us").alias("timestamp"),
            F.floor(F.col("meas_us") / 1_000_000).alias("soc"),
            F.col("freq").alias("frequency_hz"),
            F.col("stat").alias("stat_raw"),
        )
    )
    line = F.when(e % 31 == 0, F.lit("")).when(e % 37 == 0, F.lit('{"pmu_name": "cut off')).otherwise(doc)
    v.frames(spark, sf).select(line.alias("value")).write.text(path)
    return tables.read_spooled(spark, path)


sql_view(
    "spool_lines",
    "SELECT *, arrival_seq % 31 = 0 AS is_blank, arrival_seq % 31 <> 0 AND arrival_seq % 37 = 0 AS is_broken FROM frames",
)


@query(
    "src_readings_ndjson",
    f"""
SELECT CASE WHEN arrival_seq % 19 = 0 THEN ' ' ELSE pmu_id END AS pmu_name, meas_us // 1000000 AS soc, {r6('freq')} AS frequency_hz, stat AS stat_raw,
  CAST(NULL AS VARCHAR) AS bad_line FROM spool_lines WHERE NOT is_blank AND NOT is_broken
UNION ALL SELECT NULL, NULL, NULL, NULL, '{{"pmu_name": "cut off' FROM spool_lines WHERE is_broken
""",
)
def _(spark, sf):
    rows = spooled(spark, sf)
    good = tables.spool_good(rows).select("pmu_name", "soc", d6("frequency_hz").alias("frequency_hz"), "stat_raw")
    return good.unionByName(tables.spool_bad(rows), allowMissingColumns=True)


@query(
    "spool_counts_by_pmu",
    """
SELECT CASE WHEN arrival_seq % 19 = 0 THEN 'SYSTEM' ELSE pmu_id END AS pmu_id, count(*) AS pending
FROM spool_lines WHERE NOT is_blank AND NOT is_broken GROUP BY 1
""",
)
def _(spark, sf):
    return tables.spool_counts_by_pmu(tables.spool_good(spooled(spark, sf)))


def history_rows(spark, sf):
    gated = v.gated(spark, sf).withColumn("cfg_id", F.col("arrival_seq") % 5)
    return history.frame_history(gated)


_NUM = ["freq", "freq_dev", "rocof", *(f"{p}_{m}" for p in ("va", "vb", "vc", "ia") for m in ("mag", "ang"))]
sql_view(
    "history",
    "SELECT meas_us AS time_us, received_us, pmu_id, CASE WHEN arrival_seq % 5 > 0 THEN arrival_seq % 5 END AS cfg_id, quality_ok, reject_reason, "
    "stat, freq, freq - 50 AS freq_dev, rocof, "
    + ", ".join(f"{p}_mag, {p}_deg AS {p}_ang" for p in ("va", "vb", "vc", "ia"))
    + ", analog1, analog2, digital FROM gated",
)


@query(
    "sink_frame_history",
    "SELECT time_us, received_us, pmu_id, cfg_id, quality_ok, reject_reason, 0 AS idcode, stat, 0 AS time_quality, "
    + ", ".join(f"{r6(n)} AS {n}" for n in _NUM)
    + f", {r6('va_mag + vb_mag + vc_mag + ia_mag')} AS phasor_mag_sum, {r6('analog2')} AS analog2, digital AS digital0 FROM history",
)
def _(spark, sf):
    h = history_rows(spark, sf)
    return h.select(
        "time_us", "received_us", "pmu_id", "cfg_id", "quality_ok", "reject_reason", "idcode", "stat", "time_quality",
        *(d6(n).alias(n) for n in _NUM), d6(F.aggregate("phasor_mag", F.lit(0.0), lambda a, x: a + x)).alias("phasor_mag_sum"),
        d6(F.get("analogs", F.lit(1))).alias("analog2"), F.get("digitals", F.lit(0)).alias("digital0"),
    )


@query(
    "history_layout",
    """
SELECT strftime(make_timestamp(time_us), '%Y-%m-%d-%H') AS hour, count(*) AS n, count(DISTINCT pmu_id) AS devices, min(time_us) AS first_us,
  max(time_us) AS last_us FROM history GROUP BY 1
""",
)
def _(spark, sf):
    path = scratch(spark, "history")
    tables.write_frame_history(history_rows(spark, sf), path, files_per_hour=2)
    return spark.read.parquet(path).groupBy(F.col("hour").cast("string").alias("hour")).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("pmu_id").alias("devices"), F.min("time_us").alias("first_us"), F.max("time_us").alias("last_us")
    )


FROM_US, TO_US = v.V1_US + 9 * 24 * v.HOUR_US + 1_234_567, v.V1_US + 16 * 24 * v.HOUR_US


@query(
    "history_scan",
    f"""
SELECT time_us, pmu_id, quality_ok, {r6('freq')} AS freq FROM history
WHERE pmu_id = '10.0.0.5:4712' AND time_us >= {FROM_US} AND time_us < {TO_US} AND quality_ok
""",
)
def _(spark, sf):
    path = scratch(spark, "history")
    tables.write_frame_history(history_rows(spark, sf), path, files_per_hour=2)
    found = tables.read_history(spark, path, pmu="10.0.0.5:4712", from_us=FROM_US, to_us=TO_US, quality_ok=True)
    return found.select("time_us", "pmu_id", "quality_ok", d6("freq").alias("freq"))


@query(
    "sink_events",
    """
SELECT CASE WHEN seq % 50 = 0 THEN 1706745600000000 ELSE time_us END AS time_us, CASE WHEN seq % 41 = 0 THEN '' ELSE pmu_id END AS pmu_id,
  stage AS type, CASE WHEN seq % 3 = 0 THEN '{}' ELSE detail END AS detail FROM events_log
""",
)
def _(spark, sf):
    s = F.col("seq")
    rows = v.events_log(spark, sf).select(
        F.when(s % 50 != 0, F.col("time_us")).alias("time_us"),
        F.when(s % 41 != 0, F.col("pmu_id")).alias("pmu_id"),
        F.col("stage").alias("type"),
        F.when(s % 3 != 0, F.col("detail")).when(s % 2 == 0, "").alias("detail"),
    )
    path = scratch(spark, "events")
    tables.write_events(history.event_rows(rows, F.lit(1_706_745_600_000_000)), path)
    return spark.read.parquet(path).drop("day")


def _six(*names: str) -> str:
    return ", ".join(f"printf('%.6f', {e}) AS {n}" for n, e in (x.split("=") if "=" in x else (x, x) for x in names))


@query(
    "export_parsed_csv",
    f"""
SELECT CAST(row_number() OVER (ORDER BY arrival_seq) AS BIGINT) AS index, pmu_id AS pmu_name,
  strftime(make_timestamp(meas_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS time, 0 AS idcode, meas_us // 1000000 AS soc, meas_us % 1000000 AS fracsec_count,
  strftime(make_timestamp(received_us), '%Y-%m-%dT%H:%M:%S.%f') || 'Z' AS captured_at,
  printf('%.3f', (received_us - meas_us) / 1000.0::DOUBLE) AS lag_ms,
  {_six('freq', 'freq_dev=(freq - fnom)', 'rocof', 'mw=analog1', 'mvar=analog2', 'mva=s', 'power_factor=(CASE WHEN s > 0.1 THEN least(analog1 / s, 1) ELSE 1 END)',
        'va_mag', 'va_ang=va_deg', 'vb_mag', 'vb_ang=vb_deg', 'vc_mag', 'vc_ang=vc_deg', 'ia_mag', 'ia_ang=ia_deg')},
  stat, digital, TRUE AS crc_valid, 0 AS time_quality
FROM (SELECT *, sqrt(analog1 * analog1 + analog2 * analog2) AS s FROM frames)
""",
)
def _(spark, sf):
    from tickweave.functions import phasor

    numbered = windows.frame_filter_tail(v.frames(spark, sf), 0)
    power = {n: c for n, c in phasor.power_summary("analogs").items() if n != "power_factor_direction"}
    full = numbered.select(
        "*", *(c.alias(n) for n, c in power.items()), (F.col("freq") - F.col("fnom")).alias("freq_dev"),
        F.floor(F.col("meas_us") / 1_000_000).alias("soc"), (F.col("meas_us") % 1_000_000).alias("fracsec_count"),
        F.lit(0).alias("idcode"), F.lit(0).alias("time_quality"), F.lit(True).alias("crc_valid"), F.get("digitals", F.lit(0)).alias("digital"),
    )
    path = scratch(spark, "parsed")
    rows = exports.parsed_capture_rows(full)
    rows.write.csv(path, header=True)
    return spark.read.schema(rows.schema).csv(path, header=True)


@query("export_buffer_sheet")
def _(spark, sf):
    joined = decode.join_layout_asof(raw_frames(spark, sf), decode.prepare_layouts(layouts(spark, sf)), decode.LAYOUT_OF_FRAME)
    # frames with a broken checksum are errors, so those left have a good one
    readings = decode.decode_data(joined).filter("error IS NULL").withColumns(
        {"checksum_valid": F.lit(True), "frame_size": be_uint("raw", 2, 2).cast("int")}
    )
    held = windows.newest(readings, ["pmu_id"], ["arrival_seq"], windows.DEFAULT_CAPACITY)
    return exports.buffer_sheet(held)


@query("snapshot_state")
def _(spark, sf):
    ticks = hourly_ticks(spark, sf)
    status = align.aligner_status(ticks, expected(v.accepted(spark, sf)), v.HOUR_US)
    return exports.snapshot_state(
        fleet_state.connectivity_sort(enabled(spark, sf)),
        exports.trend_export(v.accepted(spark, sf), 120),
        latency.hop_stats(v.hop_samples(spark, sf)),
        status,
        windows.last_n_ticks(ticks),
        as_of(spark, sf),
    )
