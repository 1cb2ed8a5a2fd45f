"""Gate, filters and per-device ordered views over ``frames``."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.functions import fleet
from tickweave.operators import quality, windows
from tickweave.plans import views as v
from tickweave.plans.registry import query, r6, sql_view


@query("quality_gate", "SELECT arrival_seq, pmu_id, meas_us, quality_ok, reject_reason FROM gated")
def _(spark, sf):
    return v.gated(spark, sf).select("arrival_seq", "pmu_id", "meas_us", "quality_ok", "reject_reason")


@query("drop_rejected", f"SELECT arrival_seq, pmu_id, {r6('freq')} AS freq FROM accepted")
def _(spark, sf):
    return v.accepted(spark, sf).select("arrival_seq", "pmu_id", v.d6("freq").alias("freq"))


@query(
    "reject_counts",
    """
SELECT pmu_id, count(*) AS frames, count(*) FILTER (NOT quality_ok) AS quality_rejects,
  count(*) FILTER (NOT quality_ok AND lower(reject_reason) LIKE '%skew%') AS skew_rejects,
  arg_max(reject_reason, arrival_seq) FILTER (NOT quality_ok) AS last_reject
FROM gated GROUP BY pmu_id
""",
)
def _(spark, sf):
    return quality.reject_counts(v.gated(spark, sf))


@query(
    "skew_reject_filter",
    """
SELECT pmu_id, n AS skew_rejects, CAST(sum(n) OVER () AS BIGINT) AS total_skew_rejects FROM (
  SELECT pmu_id, count(*) AS n FROM gated WHERE NOT quality_ok AND lower(reject_reason) LIKE '%skew%' GROUP BY pmu_id)
""",
)
def _(spark, sf):
    return quality.skew_reject_filter(quality.reject_counts(v.gated(spark, sf)))


@query(
    "quality_edges",
    """
SELECT pmu_id, arrival_seq, received_us, CASE WHEN quality_ok THEN 'quality_recovered' ELSE 'quality_degraded' END AS type,
  reject_reason AS reason
FROM (SELECT *, lag(quality_ok) OVER (PARTITION BY pmu_id ORDER BY arrival_seq) AS prev FROM gated)
WHERE (quality_ok AND NOT prev) OR (NOT quality_ok AND coalesce(prev, TRUE))
""",
)
def _(spark, sf):
    return quality.quality_edges(v.gated(spark, sf))


# frames whose bytes were damaged (CRC) or whose layout was unknown (parse), by a fixed share
def _tagged(spark, sf):
    e = F.col("arrival_seq")
    return v.gated(spark, sf).select(
        "*",
        (e % 97 != 0).alias("crc_ok"),
        (e % 53 != 0).alias("parse_ok"),
        F.floor(F.col("meas_us") / 1_000_000).alias("soc"),
        (F.col("meas_us") % 1_000_000).alias("fracsec_count"),
    )


sql_view(
    "tagged",
    "SELECT *, arrival_seq % 97 <> 0 AS crc_ok, arrival_seq % 53 <> 0 AS parse_ok, meas_us // 1000000 AS soc, "
    "meas_us % 1000000 AS fracsec_count FROM gated",
)


@query(
    "frame_funnel",
    """
SELECT t.pmu_id, count(*) FILTER (crc_ok) AS complete, count(*) FILTER (NOT crc_ok) AS crc_fail,
  CAST(0 AS BIGINT) AS handler_drop, count(*) FILTER (crc_ok AND parse_ok) AS parse_ok,
  count(*) FILTER (crc_ok AND NOT parse_ok) AS parse_fail,
  count(*) FILTER (crc_ok AND parse_ok AND t.quality_ok) AS quality_ok,
  count(*) FILTER (crc_ok AND parse_ok AND NOT t.quality_ok) AS quality_flag,
  count(*) FILTER (crc_ok AND parse_ok AND NOT t.quality_ok) AS quality_drop,
  count(*) FILTER (crc_ok AND parse_ok AND t.quality_ok) AS delivered,
  any_value(r.data_rate) AS data_rate
FROM tagged t JOIN (SELECT pmu_id, arg_max(data_rate, received_us) AS data_rate FROM cfg_profile GROUP BY 1) r USING (pmu_id)
GROUP BY t.pmu_id
""",
)
def _(spark, sf):
    return quality.frame_funnel(_tagged(spark, sf), v.cfg_profile(spark, sf))


@query(
    "loss_samples",
    """
SELECT pmu_id, arrival_seq, stage, soc, fracsec_count, reason, received_us FROM (
  SELECT *, row_number() OVER (PARTITION BY pmu_id ORDER BY arrival_seq DESC, step DESC) AS rn FROM (
    SELECT pmu_id, arrival_seq, 'crc' AS stage, 0 AS step, soc, fracsec_count, reject_reason AS reason, received_us
      FROM tagged WHERE NOT crc_ok
    UNION ALL SELECT pmu_id, arrival_seq, 'parse', 0, soc, fracsec_count, reject_reason, received_us
      FROM tagged WHERE crc_ok AND NOT parse_ok
    UNION ALL SELECT pmu_id, arrival_seq, 'quality_flag', 0, soc, fracsec_count, reject_reason, received_us
      FROM tagged WHERE crc_ok AND parse_ok AND NOT quality_ok
    UNION ALL SELECT pmu_id, arrival_seq, 'quality', 1, soc, fracsec_count, reject_reason, received_us
      FROM tagged WHERE crc_ok AND parse_ok AND NOT quality_ok)) WHERE rn <= 32
""",
)
def _(spark, sf):
    return quality.loss_samples(_tagged(spark, sf))


@query(
    "frame_gap",
    f"""
SELECT pmu_id, arrival_seq,
  {r6('(received_us - lag(received_us) OVER (PARTITION BY pmu_id ORDER BY arrival_seq)) / 1000.0::DOUBLE')} AS frame_gap_ms
FROM frames
""",
)
def _(spark, sf):
    return windows.frame_gap(v.frames(spark, sf)).select("pmu_id", "arrival_seq", v.d6("frame_gap_ms").alias("frame_gap_ms"))


@query(
    "stamp_jumps",
    f"""
SELECT pmu_id, count(*) AS jumps, {r6('greatest(max(gap), 0)')} AS max_gap_ms,
  {r6('arg_max(gap, arrival_seq)')} AS last_gap_ms, arg_max(prev, arrival_seq) AS last_from_us,
  arg_max(meas_us, arrival_seq) AS last_to_us
FROM (SELECT *, (meas_us - prev) / 1000.0::DOUBLE AS gap FROM (
  SELECT *, lag(meas_us) OVER (PARTITION BY pmu_id ORDER BY arrival_seq) AS prev FROM frames))
WHERE gap > 100 OR gap < -10 GROUP BY pmu_id
""",
)
def _(spark, sf):
    j = windows.stamp_jumps(v.frames(spark, sf))
    return j.withColumn("max_gap_ms", v.d6("max_gap_ms")).withColumn("last_gap_ms", v.d6("last_gap_ms"))


@query("capture_lag", f"SELECT arrival_seq, pmu_id, {r6('(received_us - meas_us) / 1000.0::DOUBLE')} AS lag_ms FROM frames")
def _(spark, sf):
    return windows.capture_lag(v.frames(spark, sf)).select("arrival_seq", "pmu_id", v.d6("lag_ms").alias("lag_ms"))


@query(
    "live_sessions",
    """
SELECT pmu_id, CAST(row_number() OVER (PARTITION BY pmu_id ORDER BY became_live_us) AS BIGINT) AS session, became_live_us, last_us,
  last_us + 1000000 AS left_live_us, frames
FROM (
  SELECT pmu_id, run, min(received_us) AS became_live_us, max(received_us) AS last_us, count(*) AS frames FROM (
    SELECT pmu_id, received_us, sum(fresh) OVER (PARTITION BY pmu_id ORDER BY received_us, arrival_seq ROWS UNBOUNDED PRECEDING) AS run
    FROM (SELECT pmu_id, received_us, arrival_seq, CASE WHEN received_us - lag(received_us) OVER
        (PARTITION BY pmu_id ORDER BY received_us, arrival_seq) <= 1000000 THEN 0 ELSE 1 END AS fresh FROM frames))
  GROUP BY pmu_id, run)
""",
)
def _(spark, sf):
    return windows.live_sessions(v.frames(spark, sf))


@query(
    "lifecycle_events",
    """
SELECT event_id AS seq, epoch_us(ts) AS time_us, '10.0.0.' || (user_id % 8) || ':4712' AS pmu_id,
  unnest(CASE WHEN event_type = 'purchase' THEN ['operator_stop', 'left_live'] ELSE ['operator_start'] END) AS type
FROM events WHERE event_type IN ('signup', 'purchase')
""",
)
def _(spark, sf):
    kind = F.col("event_type")
    actions = v.table(spark, sf, "events").select(
        F.col("event_id").alias("seq"),
        v.micros("ts").alias("time_us"),
        v.pmu_of(F.col("user_id") % 8).alias("pmu_id"),
        F.when(kind == "purchase", "stop").when(kind == "signup", "start").alias("action"),
    )
    return windows.lifecycle_events(actions).select("seq", "time_us", "pmu_id", "type")


@query(
    "frame_filter_tail",
    """
SELECT arrival_seq, pmu_id, CAST(row_number() OVER (ORDER BY arrival_seq) AS INTEGER) AS index
FROM (SELECT arrival_seq, pmu_id FROM frames WHERE pmu_id = '10.0.0.3:4712' ORDER BY arrival_seq DESC LIMIT 300)
""",
)
def _(spark, sf):
    return windows.frame_filter_tail(v.frames(spark, sf), 300, "10.0.0.3:4712").select("arrival_seq", "pmu_id", "index")


@query(
    "capture_status",
    """
SELECT pmu_id, count(*) AS buffered, CAST(sum(count(*)) OVER () AS BIGINT) AS buffered_total
FROM (SELECT pmu_id FROM frames ORDER BY arrival_seq DESC LIMIT 1500) GROUP BY pmu_id
""",
)
def _(spark, sf):
    return windows.capture_status(v.frames(spark, sf))


@query(
    "last_n_per_device",
    """
SELECT pmu_id, meas_us, arrival_seq FROM (
  SELECT *, row_number() OVER (PARTITION BY pmu_id ORDER BY meas_us DESC) AS rn FROM (
    SELECT pmu_id, meas_us, max(arrival_seq) AS arrival_seq FROM frames_edge GROUP BY pmu_id, meas_us)) WHERE rn <= 200
""",
)
def _(spark, sf):
    from tickweave.operators.align import dedupe_latest

    kept = windows.last_n_per_device(dedupe_latest(v.frames_edge(spark, sf).select("pmu_id", "meas_us", "arrival_seq")))
    return kept


@query(
    "buffer_snapshot",
    """
SELECT pmu_id, count(*) AS held, min(meas_us) // 1000 AS oldest_ms, max(meas_us) // 1000 AS newest_ms,
  min(min(meas_us) // 1000) OVER () AS candidate_ms,
  string_agg(CAST(meas_us AS VARCHAR), ' ' ORDER BY arrival_seq) AS slots
FROM (SELECT *, row_number() OVER (PARTITION BY pmu_id ORDER BY arrival_seq DESC) AS rn FROM frames) WHERE rn <= 200
GROUP BY pmu_id
""",
)
def _(spark, sf):
    snap = windows.buffer_snapshot(v.frames(spark, sf))
    return snap.withColumn("slots", F.array_join(F.transform("slots", lambda x: x.cast("string")), " "))


@query(
    "recent_events",
    """
SELECT seq, pmu_id, stage, status, message FROM events_log
WHERE status IN ('error', 'rejected') OR stage IN ('connect', 'handshake') ORDER BY seq DESC LIMIT 200
""",
)
def _(spark, sf):
    return windows.recent_events(v.events_log(spark, sf)).select("seq", "pmu_id", "stage", "status", "message")


@query(
    "event_severity",
    """
SELECT seq, CASE WHEN status IN ('error', 'rejected') THEN 'ERROR' ELSE 'INFO' END AS severity,
  status IN ('error', 'rejected') AS errorish,
  status IN ('error', 'rejected') OR stage IN ('connect', 'handshake') AS ui_worthy
FROM events_log
""",
)
def _(spark, sf):
    return v.events_log(spark, sf).select(
        "seq",
        fleet.event_severity("status").alias("severity"),
        fleet.is_errorish("status").alias("errorish"),
        fleet.is_ui_worthy("stage", "status").alias("ui_worthy"),
    )


@query(
    "alert_severity",
    """
SELECT seq, CASE WHEN status || ' ' || message LIKE '%error%' THEN 'bad'
  WHEN status || ' ' || message LIKE '%warn%' OR status || ' ' || message LIKE '%reject%' THEN 'warn' ELSE 'info' END AS sev
FROM events_log
""",
)
def _(spark, sf):
    return v.events_log(spark, sf).select("seq", fleet.alert_severity("status", "message").alias("sev"))
