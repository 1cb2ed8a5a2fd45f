"""Estimators that carry state from row to row."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.operators import estimators
from tickweave.plans import views as v
from tickweave.plans.registry import query, r6, sql_view

d6 = v.d6

# the plain recursion: one step per frame of a device
sql_view(
    "numbered",
    "SELECT pmu_id, arrival_seq, meas_us, (received_us - meas_us)::DOUBLE AS x, row_number() OVER (PARTITION BY pmu_id ORDER BY arrival_seq) AS n FROM frames",
)
_OFFSETS = """WITH RECURSIVE {views}, walk AS (
  SELECT pmu_id, arrival_seq, meas_us, n, x AS off FROM numbered WHERE n = 1
  UNION ALL SELECT f.pmu_id, f.arrival_seq, f.meas_us, f.n,
    CASE WHEN abs(f.x - w.off) > 60000000 THEN f.x ELSE f.x + (w.off - f.x) * 0.9025::DOUBLE END
  FROM walk w JOIN numbered f ON f.pmu_id = w.pmu_id AND f.n = w.n + 1)
"""


def _recursive(body: str, walk: str = _OFFSETS, base: str = "numbered") -> str:
    from tickweave.plans.registry import with_views

    views = with_views(f"SELECT * FROM {base}").removeprefix("WITH ").removesuffix(f"\nSELECT * FROM {base}")
    return walk.replace("{views}", views) + body


sql_view(
    "frames_dense",
    f"""
SELECT arrival_seq, pmu_id, base + (arrival_seq * 31) % 7 * 100 AS meas_us,
  base + 5000 + (arrival_seq * 7919) % 3000 + CASE WHEN arrival_seq % 4001 < 8 THEN 900000 ELSE 0 END AS received_us
FROM (SELECT event_id AS arrival_seq, '10.0.0.' || (event_id % 8) || ':4712' AS pmu_id, {v.V1_US} + (event_id // 8) * 40000 AS base FROM events)
""",
)
sql_view(
    "paced",
    """
SELECT *, coalesce(received_us - lag(received_us) OVER d, 0) AS gap, coalesce(meas_us <> lag(meas_us) OVER d, TRUE) AS fresh,
  row_number() OVER d AS n FROM frames_dense WINDOW d AS (PARTITION BY pmu_id ORDER BY arrival_seq)
""",
)
# one counting window per device, row after row, at a configured rate of 25
_RATES = """WITH RECURSIVE {views}, walk AS (
  SELECT pmu_id, arrival_seq, n, meas_us AS start, 1 AS cnt, 0.0::DOUBLE AS rate FROM paced WHERE n = 1
  UNION ALL SELECT pmu_id, arrival_seq, n, CASE WHEN restart OR done THEN meas_us ELSE start END,
    CASE WHEN restart THEN fresh::INTEGER WHEN done THEN 1 ELSE cnt END,
    CASE WHEN NOT done THEN rate WHEN abs(inst - 25) <= 3 THEN 25 WHEN rate <= 0 THEN inst
      WHEN abs(rate * 0.35::DOUBLE + inst * 0.65::DOUBLE - 25) <= 3 THEN 25 ELSE rate * 0.35::DOUBLE + inst * 0.65::DOUBLE END
  FROM (SELECT *, NOT restart AND fresh AND meas_us - start >= 1000000 AND cnt >= 2 AS done,
      CASE WHEN meas_us > start THEN (cnt - 1) / ((meas_us - start) / 1e6::DOUBLE) ELSE 0 END AS inst FROM (
    SELECT p.pmu_id, p.arrival_seq, p.n, p.meas_us, p.fresh, w.start, w.cnt + p.fresh::INTEGER AS cnt, w.rate,
      p.gap > 750000 OR p.meas_us < w.start AS restart
    FROM walk w JOIN paced p ON p.pmu_id = w.pmu_id AND p.n = w.n + 1)))
"""
sql_view("measured_rates", _recursive("SELECT pmu_id, arg_max(rate, arrival_seq)::DOUBLE AS rate FROM walk GROUP BY pmu_id", _RATES, "paced"))
# jump from kept row to the first one a gap later
_KEPT = """WITH RECURSIVE {views}, walk AS (
  SELECT k, gap, min(t) AS t FROM timed GROUP BY k, gap
  UNION ALL SELECT w.k, w.gap, min(r.t) FROM walk w JOIN timed r ON r.k = w.k AND r.t >= w.t + w.gap GROUP BY w.k, w.gap)
"""


def offsets(spark, sf):
    return estimators.clock_offset_ema(v.frames(spark, sf).select("pmu_id", "arrival_seq", "meas_us", "received_us"))


@query("clock_offset_ema", _recursive(f"SELECT pmu_id, arrival_seq, {r6('off / 1000')} AS offset_ms FROM walk"))
def _(spark, sf):
    return offsets(spark, sf).select("pmu_id", "arrival_seq", d6(F.col("offset_us") / 1000).alias("offset_ms"))


@query(
    "corrected_lag",
    _recursive(f"""SELECT w.pmu_id, w.arrival_seq, {r6('((SELECT max(received_us) FROM frames) - (w.meas_us + w.off)) / 1000')} AS lag_ms,
  w.arrival_seq = (SELECT min(arrival_seq) FROM walk o WHERE o.pmu_id = w.pmu_id AND abs(o.off) >= 1000000) AS warn FROM walk w"""),
)
def _(spark, sf):
    now = v.frames(spark, sf).agg(F.max("received_us")).scalar()
    lag = estimators.corrected_lag(offsets(spark, sf), now)
    return lag.select("pmu_id", "arrival_seq", d6("lag_ms").alias("lag_ms"), "warn")


@query("fps_estimate", _recursive(f"SELECT pmu_id, arrival_seq, {r6('rate')} AS approx_fps FROM walk", _RATES, "paced"))
def _(spark, sf):
    out = estimators.fps_estimate(v.frames_dense(spark, sf))
    return out.select("pmu_id", "arrival_seq", d6("approx_fps").alias("approx_fps"))


sql_view("timed_trends", "SELECT pmu_id AS k, 100000 AS gap, received_us AS t FROM frames_dense")


@query(
    "trend_downsample",
    _recursive(
        """SELECT pmu_id, arrival_seq, received_us FROM (SELECT d.*, row_number() OVER (PARTITION BY pmu_id ORDER BY received_us DESC) AS back
  FROM walk w JOIN frames_dense d ON d.pmu_id = w.k AND d.received_us = w.t) WHERE back <= 120""",
        _KEPT.replace("timed", "timed_trends"),
        "timed_trends",
    ),
)
def _(spark, sf):
    return estimators.trend_downsample(v.frames_dense(spark, sf)).select("pmu_id", "arrival_seq", "received_us")


@query(
    "trend_buckets",
    """
SELECT pmu_id, arrival_seq, received_us FROM (
  SELECT *, row_number() OVER (PARTITION BY pmu_id ORDER BY received_us DESC, arrival_seq DESC) AS back FROM (
    SELECT *, row_number() OVER (PARTITION BY pmu_id, received_us // 100000 ORDER BY received_us, arrival_seq) AS rn FROM frames)
  WHERE rn = 1) WHERE back <= 120
""",
)
def _(spark, sf):
    return estimators.trend_downsample(v.frames(spark, sf), mode="bucket").select("pmu_id", "arrival_seq", "received_us")


# events come minutes apart; the limit is put on a clock that runs a thousand times faster
sql_view(
    "timed_events",
    "SELECT pmu_id || '|' || stage || '|' || status AS k, CASE WHEN status = 'ok' THEN 2000000 ELSE 500000 END AS gap, time_us // 1000 AS t FROM events_log",
)


@query(
    "rate_limit_events",
    _recursive(
        "SELECT e.seq, e.pmu_id, e.stage, e.status FROM walk w JOIN events_log e ON e.pmu_id || '|' || e.stage || '|' || e.status = w.k AND e.time_us // 1000 = w.t",
        _KEPT.replace("timed", "timed_events"),
        "timed_events",
    ),
)
def _(spark, sf):
    fast = v.events_log(spark, sf).withColumn("time_us", F.floor(F.col("time_us") / 1000))
    return estimators.rate_limit_events(fast).select("seq", "pmu_id", "stage", "status")
