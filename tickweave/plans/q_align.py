"""Alignment and what charts read from it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.operators import align
from tickweave.plans import views as v
from tickweave.plans.registry import query, r6, sql_view
from tickweave.session import materialize

HALF_HOUR_US = v.HOUR_US // 2


def _aligned_sql(prefix: str, source: str, period: int, cols: str) -> None:
    """SQL views ``<prefix>_points`` (device samples at their tick) and ``<prefix>_ticks``."""
    p, h = period, period // 2
    sql_view(f"{prefix}_one", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pmu_id, meas_us ORDER BY arrival_seq DESC) AS dup FROM {source}) WHERE dup = 1")
    sql_view(
        f"{prefix}_inner",
        f"SELECT *, ((meas_us + {h}) // {p}) * {p} AS tick_us FROM {prefix}_one WHERE meas_us % {p} <> {h}",
    )
    sql_view(
        f"{prefix}_edge",
        f"""
SELECT *, NOT first_value(inner_low) OVER (PARTITION BY pmu_id, run ORDER BY meas_us) AS goes_down FROM (
  SELECT *, sum(CASE WHEN inner_low OR NOT border_low THEN 1 ELSE 0 END)
      OVER (PARTITION BY pmu_id ORDER BY meas_us ROWS UNBOUNDED PRECEDING) AS run FROM (
    SELECT b.*, EXISTS (SELECT 1 FROM {prefix}_inner i WHERE i.pmu_id = b.pmu_id AND i.tick_us = b.meas_us - {h}) AS inner_low,
      EXISTS (SELECT 1 FROM {prefix}_inner i WHERE i.pmu_id = b.pmu_id AND i.tick_us = b.meas_us + {h}) AS inner_up,
      EXISTS (SELECT 1 FROM {prefix}_one e WHERE e.pmu_id = b.pmu_id AND e.meas_us = b.meas_us - {p}) AS border_low
    FROM {prefix}_one b WHERE b.meas_us % {p} = {h}))
""",
    )
    # before the slowest device holds anything back
    sql_view(
        f"{prefix}_samples",
        f"""
SELECT {cols}, tick_us FROM (SELECT *, row_number() OVER (PARTITION BY pmu_id, tick_us ORDER BY abs(meas_us - tick_us), meas_us) AS near
  FROM {prefix}_inner) WHERE near = 1
UNION ALL SELECT {cols}, CASE WHEN goes_down THEN meas_us - {h} ELSE meas_us + {h} END FROM {prefix}_edge
  WHERE goes_down OR NOT inner_up
""",
    )
    sql_view(
        f"{prefix}_points",
        f"SELECT * FROM {prefix}_samples WHERE tick_us <= (SELECT min(m) FROM (SELECT max(meas_us) AS m FROM {prefix}_one GROUP BY pmu_id))",
    )
    sql_view(
        f"{prefix}_ticks",
        f"""
SELECT tick_us, string_agg(pmu_id, ' ' ORDER BY pmu_id) AS present, count(*) AS n,
  (SELECT count(DISTINCT pmu_id) FROM {source}) AS fleet_n,
  coalesce((SELECT string_agg(e.pmu_id, ' ' ORDER BY e.pmu_id) FROM (SELECT DISTINCT pmu_id FROM {source}) e
    WHERE NOT EXISTS (SELECT 1 FROM {prefix}_points q WHERE q.tick_us = p.tick_us AND q.pmu_id = e.pmu_id)), '') AS missing
FROM {prefix}_points p GROUP BY tick_us
""",
    )


FRAME_COLS = (
    "arrival_seq, pmu_id, meas_us, received_us, stat, freq, fnom, rocof, va_mag, va_deg, vb_mag, vb_deg, vc_mag, vc_deg, "
    "ia_mag, ia_deg, analog1, analog2, digital"
)
_aligned_sql("hourly", "accepted", v.HOUR_US, FRAME_COLS)
_aligned_sql("half_hourly", "frames_edge", HALF_HOUR_US, FRAME_COLS)


def expected(readings):
    """The devices that send, as the small written table a registry would be."""
    return materialize(readings.select("pmu_id").distinct(), "expected")


def hourly_points(spark, sf):
    acc = v.accepted(spark, sf)
    return align.align_points(acc, expected(acc), v.HOUR_US)


def hourly_ticks(spark, sf):
    acc = v.accepted(spark, sf)
    devices = expected(acc)
    return align.align_ticks(align.align_points(acc, devices, v.HOUR_US), devices)


def _flat(ticks):
    return ticks.select(
        "tick_us",
        F.array_join("present", " ").alias("present"),
        F.array_join("missing", " ").alias("missing"),
        "complete",
        "reason",
    )


_TICKS = "SELECT tick_us, present, missing, missing = '' AS complete, CASE WHEN missing = '' THEN 'complete' ELSE 'partial' END AS reason FROM "


@query("align_ticks", _TICKS + "half_hourly_ticks")
def _(spark, sf):
    edge = v.frames_edge(spark, sf)
    devices = expected(edge)
    return _flat(align.align_ticks(align.align_points(edge, devices, HALF_HOUR_US), devices))


@query("align_ticks_hourly", _TICKS + "hourly_ticks")
def _(spark, sf):
    return _flat(hourly_ticks(spark, sf))


@query("join_nearest_tick", "SELECT tick_us, pmu_id, meas_us, arrival_seq FROM half_hourly_points")
def _(spark, sf):
    edge = v.frames_edge(spark, sf)
    return align.align_points(edge, expected(edge), HALF_HOUR_US).select("tick_us", "pmu_id", "meas_us", "arrival_seq")


_aligned_sql("bench", "frames_bench", v.HOUR_US, "arrival_seq, pmu_id, meas_us, freq, va_mag")


@query("align_volume", f"SELECT tick_us, pmu_id, {r6('freq')} AS freq FROM bench_points")
def _(spark, sf):
    rows = v.frames_bench(spark, sf)
    return align.align_points(rows, expected(rows), v.HOUR_US).select("tick_us", "pmu_id", v.d6("freq").alias("freq"))
