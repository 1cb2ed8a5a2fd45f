"""What charts read from aligned ticks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.operators import align, charts, windows
from tickweave.plans import views as v
from tickweave.plans.q_align import expected, hourly_points, hourly_ticks
from tickweave.plans.q_fleet import kept_fleet, online
from tickweave.plans.q_scalars import CHANNEL_SETS, with_channels
from tickweave.plans.registry import query, r6, sql_view
from tickweave.session import materialize

d6 = v.d6
# the device of single-device charts, and how many devices a wide chart has columns for at most
ONE_DEVICE, MOST_DEVICES = "10.0.0.3:4712", 200
# SQL has to name its columns: the devices that the views' formula makes
SQL_DEVICES = [f"10.0.0.{k}:4712" for k in range(8)]


def measures(spark, sf):
    return align.point_measures(hourly_points(spark, sf))


def kept_measures(spark, sf):
    """Aligned measures as a written table: charts read it several times."""
    return materialize(measures(spark, sf), "aligned")


_PH = ["va", "vb", "vc", "ia"]
sql_view(
    "measures",
    "SELECT tick_us, tick_us // 1000 AS tick_ms, pmu_id, freq AS frequency, freq - 50 AS frequency_dev, rocof, "
    + ", ".join(f"{p}_mag AS {p}" for p in _PH)
    + ", 0.0::DOUBLE AS ib, 0.0::DOUBLE AS ic, "
    + ", ".join(f"{p}_deg AS {p}_angle" for p in _PH)
    + ", 0.0::DOUBLE AS ib_angle, 0.0::DOUBLE AS ic_angle, analog1, analog2, received_us FROM hourly_points",
)


@query(
    "align_points",
    "SELECT tick_ms, pmu_id, "
    + ", ".join(f"{r6(f)} AS {f}" for f in align.POINT_FIELDS)
    + f", {r6('analog1')} AS analog1, {r6('analog2')} AS analog2 FROM measures",
)
def _(spark, sf):
    return measures(spark, sf).select(
        "tick_ms", "pmu_id", *(d6(f).alias(f) for f in align.POINT_FIELDS),
        d6(F.try_element_at("analogs", F.lit("Analog1"))).alias("analog1"), d6(F.try_element_at("analogs", F.lit("Analog2"))).alias("analog2"),
    )


@query("dedupe_latest", "SELECT pmu_id, meas_us, max(arrival_seq) AS arrival_seq FROM frames_edge GROUP BY pmu_id, meas_us")
def _(spark, sf):
    return align.dedupe_latest(v.frames_edge(spark, sf)).select("pmu_id", "meas_us", "arrival_seq")


# expected: every active registered device whose number is below ten, so two of them never send
@query(
    "device_bounds",
    """
SELECT e.pmu_id, b.oldest_us, b.newest_us, b.samples, min(oldest_us) OVER () AS min_oldest_us, max(newest_us) OVER () AS max_newest_us,
  CASE WHEN count(*) OVER () = count(newest_us) OVER () THEN min(newest_us) OVER () END AS min_newest_us
FROM (SELECT name AS pmu_id FROM registry WHERE active) e LEFT JOIN (
  SELECT pmu_id, min(meas_us) AS oldest_us, max(meas_us) AS newest_us, count(*) AS samples FROM accepted GROUP BY pmu_id) b USING (pmu_id)
""",
)
def _(spark, sf):
    listed = v.registry(spark, sf).filter("active").select(F.col("name").alias("pmu_id"))
    bounds = align.device_bounds(align.expected_filter(v.accepted(spark, sf), listed), listed)
    fleet = align.fleet_bounds(bounds)
    one = lambda c: fleet.select(c).scalar().alias(c)
    return bounds.select("*", one("min_oldest_us"), one("max_newest_us"), one("min_newest_us"))


@query(
    "expected_filter",
    "SELECT arrival_seq, pmu_id FROM frames WHERE pmu_id IN (SELECT name FROM registry WHERE active AND region <> 'EUROPE')",
)
def _(spark, sf):
    listed = v.registry(spark, sf).filter("active AND region <> 'EUROPE'").select(F.col("name").alias("pmu_id"))
    return align.expected_filter(v.frames(spark, sf), listed).select("arrival_seq", "pmu_id")


@query(
    "join_exact_tick",
    """
SELECT tick_us, pmu_id, max(arrival_seq) AS arrival_seq FROM (SELECT *, meas_us AS tick_us FROM frames_edge)
WHERE tick_us IN (SELECT tick_us FROM half_hourly_ticks) GROUP BY tick_us, pmu_id
""",
)
def _(spark, sf):
    edge = v.frames_edge(spark, sf)
    devices = expected(edge)
    ticks = align.align_ticks(align.align_points(edge, devices, v.HOUR_US // 2), devices)
    return align.exact_tick(edge, ticks).select("tick_us", "pmu_id", "arrival_seq")


@query(
    "missing_devices",
    """
SELECT t.tick_us, d.pmu_id FROM hourly_ticks t CROSS JOIN (SELECT DISTINCT pmu_id FROM accepted) d
WHERE NOT EXISTS (SELECT 1 FROM hourly_points p WHERE p.tick_us = t.tick_us AND p.pmu_id = d.pmu_id)
""",
)
def _(spark, sf):
    return align.missing_devices(hourly_ticks(spark, sf))


@query(
    "aligner_status",
    f"""
SELECT max(fleet_n) AS n, {1e6 / v.HOUR_US!r}::DOUBLE AS fps, {v.HOUR_US / 1000.0}::DOUBLE AS period_ms, count(*) AS emitted,
  count(*) FILTER (missing = '') AS complete, count(*) FILTER (missing <> '') AS partial,
  {r6("count(*) FILTER (missing = '') * 100.0::DOUBLE / count(*)")} AS complete_pct FROM hourly_ticks
""",
)
def _(spark, sf):
    status = align.aligner_status(hourly_ticks(spark, sf), expected(v.accepted(spark, sf)), v.HOUR_US)
    return status.withColumn("complete_pct", d6("complete_pct"))


@query(
    "points_map",
    f"""
SELECT tick_us, string_agg(pmu_id || '=' || printf('%.3f', round(frequency, 3)), ' ' ORDER BY pmu_id) AS points,
  any_value(t.missing) AS missing, bool_and(t.missing = '') AS complete FROM measures JOIN hourly_ticks t USING (tick_us) GROUP BY tick_us
""",
)
def _(spark, sf):
    packed = align.points_map(measures(spark, sf), hourly_ticks(spark, sf))
    shown = lambda k: F.format_string("%.3f", F.round(F.try_element_at("points", k)["frequency"], 3))
    entries = F.transform(F.array_sort(F.map_keys("points")), lambda k: F.concat(k, F.lit("="), shown(k)))
    return packed.select("tick_us", F.array_join(entries, " ").alias("points"), F.array_join("missing", " ").alias("missing"), "complete")


@query(
    "align_dynamic_expected",
    f"""
WITH runs AS (SELECT pmu_id, run, min(received_us) AS a, max(received_us) AS b FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY pmu_id ORDER BY received_us, arrival_seq ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT *, CASE WHEN received_us - lag(received_us) OVER (PARTITION BY pmu_id ORDER BY received_us, arrival_seq) <= {6 * v.HOUR_US} THEN 0 ELSE 1 END AS fresh
      FROM accepted)) GROUP BY pmu_id, run),
  duty AS (SELECT DISTINCT pmu_id, unnest(range(((a + {v.HOUR_US // 2}) // {v.HOUR_US}) * {v.HOUR_US}, ((b + {v.HOUR_US // 2}) // {v.HOUR_US}) * {v.HOUR_US} + 1, {v.HOUR_US})) AS tick_us FROM runs),
  near AS (SELECT DISTINCT pmu_id, ((meas_us + {v.HOUR_US // 2}) // {v.HOUR_US}) * {v.HOUR_US} AS tick_us FROM accepted)
SELECT tick_us, count(n.pmu_id) AS present, count(*) - count(n.pmu_id) AS missing, count(*) = count(n.pmu_id) AS complete
FROM duty d LEFT JOIN near n USING (pmu_id, tick_us) GROUP BY tick_us HAVING count(n.pmu_id) > 0
""",
)
def _(spark, sf):
    from tickweave.operators.chunked import islands

    acc = v.accepted(spark, sf)
    # with minutes between frames a device counts as live until six silent hours
    runs = islands(acc.withColumn("patience", F.lit(6 * v.HOUR_US)), ["pmu_id"], "received_us", "patience")
    sessions = runs.select("pmu_id", F.col("first_us").alias("became_live_us"), "last_us")
    ticks = align.align_dynamic_expected(acc, sessions, v.HOUR_US)
    return ticks.select("tick_us", F.size("present").cast("bigint").alias("present"), F.size("missing").cast("bigint").alias("missing"), "complete")


@query(
    "align_dwell",
    f"SELECT tick_us, pmu_id, {r6('(tick_us + 60000000 - received_us) / 1000.0::DOUBLE')} AS dwell_ms FROM measures "
    "WHERE tick_us + 60000000 - received_us >= 0 AND tick_us + 60000000 - received_us < 300000000",
)
def _(spark, sf):
    dwell = align.align_dwell(hourly_points(spark, sf), F.col("tick_us") + 60_000_000)
    return dwell.withColumn("dwell_ms", d6("dwell_ms"))


@query("last_n_ticks", "SELECT tick_us, missing FROM hourly_ticks ORDER BY tick_us DESC LIMIT 120")
def _(spark, sf):
    return windows.last_n_ticks(hourly_ticks(spark, sf)).select("tick_us", F.array_join("missing", " ").alias("missing"))


sql_view("chart_ticks", "SELECT DISTINCT tick_us FROM measures ORDER BY tick_us DESC LIMIT 90")


def _cells(values: dict[str, str]) -> str:
    return ", ".join(
        f"{r6(f'''max({expr}) FILTER (pmu_id = '{d}')''')} AS \"{charts.slug(d)}__{name}\"" for d in SQL_DEVICES for name, expr in values.items()
    )


def _rounded(wide):
    return wide.select("tick_us", *(d6(F.col(f"`{c}`")).alias(c) for c in wide.columns if c != "tick_us"))


@query(
    "aligned_pivot",
    "SELECT tick_us, " + _cells({m: m for m in charts.MEASURES}) + " FROM measures JOIN chart_ticks USING (tick_us) GROUP BY tick_us",
)
def _(spark, sf):
    kept = kept_measures(spark, sf)
    return _rounded(charts.aligned_pivot(kept, charts.devices_of(kept, MOST_DEVICES)))


@query(
    "channel_pivot",
    "SELECT tick_us, " + _cells({f"{p}Angle": f"{p}_angle" for p in ("va", "vb", "vc")}) + " FROM measures JOIN chart_ticks USING (tick_us) GROUP BY tick_us",
)
def _(spark, sf):
    kept = kept_measures(spark, sf)
    return _rounded(charts.channel_pivot(kept, charts.devices_of(kept, MOST_DEVICES), "angle", "voltage", charts.CHART_TICKS))


@query(
    "channel_pivot_analogs",
    "SELECT tick_us, " + _cells({"analog1": "analog1", "analog2": "analog2"}) + " FROM measures JOIN chart_ticks USING (tick_us) GROUP BY tick_us",
)
def _(spark, sf):
    kept = kept_measures(spark, sf)
    return _rounded(charts.channel_pivot(kept, charts.devices_of(kept, MOST_DEVICES), "analogs", "voltage", charts.CHART_TICKS, ["Analog1", "Analog2"]))


_TREND = ["frequency", "frequency_dev", "rocof", "va", "vb", "vc", "ia", "ib", "ic"]


@query(
    "device_trend",
    "SELECT tick_us, " + ", ".join(f"{r6(f)} AS {f}" for f in _TREND)
    + f", {r6('analog1')} AS mw, {r6('analog2')} AS mvar FROM measures JOIN chart_ticks USING (tick_us) WHERE pmu_id = '{ONE_DEVICE}'",
)
def _(spark, sf):
    t = charts.device_trend(kept_measures(spark, sf), ONE_DEVICE)
    return t.select("tick_us", *(d6(f).alias(f) for f in [*_TREND, "mw", "mvar"]))


sql_view("online_now", "SELECT pmu_id, label FROM enabled_fleet WHERE connected")
sql_view(
    "tick_now",
    "SELECT * FROM measures WHERE tick_us = (SELECT max(tick_us) FROM measures WHERE pmu_id IN (SELECT pmu_id FROM online_now))",
)


@query("latest_tick", f"SELECT tick_us, pmu_id, {r6('frequency')} AS frequency FROM tick_now")
def _(spark, sf):
    return charts.latest_tick(kept_measures(spark, sf), online(spark, sf)).select("tick_us", "pmu_id", d6("frequency").alias("frequency"))


@query(
    "diagram_vectors",
    "SELECT pmu_id, label, device, mag, deg, 'vector' AS kind FROM ("
    + " UNION ALL ".join(
        f"SELECT pmu_id, '{p.upper()}' AS label, o.label AS device, {r6(p)} AS mag, {r6(p + '_angle')} AS deg FROM tick_now JOIN online_now o USING (pmu_id)"
        for p in ("va", "vb", "vc")
    )
    + ") WHERE NOT (mag = 0 AND deg = 0) UNION ALL SELECT pmu_id, NULL, label, NULL, NULL, 'missing' FROM online_now WHERE pmu_id NOT IN (SELECT pmu_id FROM tick_now)",
)
def _(spark, sf):
    m, on = kept_measures(spark, sf), kept_fleet(spark, sf).filter("connected")
    vectors = charts.diagram_vectors(m, on, "voltage").select(
        "pmu_id", "label", "device", d6("mag").alias("mag"), d6("deg").alias("deg"), F.lit("vector").alias("kind")
    )
    gone = charts.diagram_missing(m, on).select("pmu_id", F.col("label").alias("device"), F.lit("missing").alias("kind"))
    return vectors.unionByName(gone, allowMissingColumns=True)


@query(
    "pair_angle_series",
    """
SELECT tick_us, regexp_replace(a.pmu_id, '[^a-z0-9]+', '-', 'g') || '__' || regexp_replace(b.pmu_id, '[^a-z0-9]+', '-', 'g') AS pair,
  round(CASE WHEN abs(a.va_angle - b.va_angle) > 180 THEN 360 - abs(a.va_angle - b.va_angle) ELSE abs(a.va_angle - b.va_angle) END, 2) + 0.0 AS delta
FROM measures a JOIN measures b USING (tick_us)
WHERE a.pmu_id < b.pmu_id AND a.pmu_id IN (SELECT pmu_id FROM online_now) AND b.pmu_id IN (SELECT pmu_id FROM online_now)
  AND tick_us IN (SELECT DISTINCT tick_us FROM measures ORDER BY tick_us DESC LIMIT 60)
""",
)
def _(spark, sf):
    return charts.pair_angle_series(kept_measures(spark, sf), online(spark, sf))


@query("distinct_channel_names", "SELECT DISTINCT unnest(CASE arrival_seq % 4 "
    + " ".join(f"WHEN {i} THEN {s!r}" for i, s in enumerate(CHANNEL_SETS)) + " END) AS name FROM frames")
def _(spark, sf):
    return windows.distinct_channel_names(with_channels(spark, sf), F.transform("channels", lambda c: c["name"]))


@query(
    "export_aligned_sheet",
    "SELECT tick_ms, strftime(make_timestamp(tick_us), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS time_utc, m.pmu_id AS pmu_name, t.missing = '' AS complete, "
    "CASE WHEN t.missing = '' THEN 'complete' ELSE 'partial' END AS reason, t.missing, "
    + f"{r6('frequency')} AS frequency_hz, {r6('frequency_dev')} AS frequency_dev_hz, {r6('rocof')} AS rocof_hz_per_sec, "
    + ", ".join(f"{r6(p)} AS {p}_mag, {r6(p + '_angle')} AS {p}_angle_deg" for p in ("va", "vb", "vc", "ia", "ib", "ic"))
    + f', {r6("analog1")} AS "Analog1", {r6("analog2")} AS "Analog2" FROM measures m JOIN hourly_ticks t USING (tick_us)',
)
def _(spark, sf):
    sheet = charts.aligned_sheet(measures(spark, sf), hourly_ticks(spark, sf), ["Analog1", "Analog2"])
    text = ["tick_ms", "time_utc", "pmu_name", "complete", "reason", "missing"]
    return sheet.select(*text, *(d6(c).alias(c) for c in sheet.columns if c not in text))


# --- polls: one row per hour and device -------------------------------------------------


def polls(spark, sf):
    """Hourly polls of every sending device: its last end-to-end hop, NULL when it was silent."""
    e2e = v.hop_samples(spark, sf).filter("stage = 'e2e_recv_to_dashboard'").select("pmu_id", F.col("seq").alias("arrival_seq"), "ms")
    f = v.frames(spark, sf).select("pmu_id", "arrival_seq", "received_us").join(e2e, ["pmu_id", "arrival_seq"])
    hour = F.floor(F.col("received_us") / v.HOUR_US) * v.HOUR_US
    last = f.groupBy(hour.alias("poll_us"), "pmu_id").agg(F.max_by("ms", "arrival_seq").alias("latency_ms"))
    hours = F.sequence(f.agg(F.min(hour)).scalar(), f.agg(F.max(hour)).scalar(), F.lit(v.HOUR_US))
    every = f.select("pmu_id").distinct().withColumn("poll_us", F.explode(hours))
    return every.join(last, ["poll_us", "pmu_id"], "left").select(
        "poll_us", "pmu_id", F.col("latency_ms").isNotNull().alias("connected"), F.coalesce("latency_ms", F.lit(999.0)).alias("latency_ms")
    )


sql_view(
    "polled",
    f"""
SELECT (received_us // {v.HOUR_US}) * {v.HOUR_US} AS poll_us, pmu_id,
  arg_max(((arrival_seq * 31) % 1000) / 100.0::DOUBLE + ((arrival_seq * 13) % 500) / 100.0::DOUBLE, arrival_seq) AS ms FROM frames GROUP BY ALL
""",
)


@query(
    "ffill_latency",
    f"""
SELECT poll_us, pmu_id, {r6('value')} AS value FROM (
  SELECT h.poll_us, d.pmu_id, last_value(p.ms IGNORE NULLS) OVER (PARTITION BY d.pmu_id ORDER BY h.poll_us ROWS UNBOUNDED PRECEDING) AS value
  FROM (SELECT unnest(range((SELECT min(poll_us) FROM polled), (SELECT max(poll_us) FROM polled) + 1, {v.HOUR_US})) AS poll_us) h
  CROSS JOIN (SELECT DISTINCT pmu_id FROM frames) d LEFT JOIN polled p ON p.poll_us = h.poll_us AND p.pmu_id = d.pmu_id)
WHERE value IS NOT NULL AND poll_us > (SELECT max(poll_us) FROM polled) - 60 * {v.HOUR_US}
""",
)
def _(spark, sf):
    devices = v.frames(spark, sf).select("pmu_id").distinct()
    return windows.ffill_latency(polls(spark, sf), devices).withColumn("value", d6("value"))


@query(
    "rolling_history",
    f"""
SELECT poll_us, {r6('avg(ms)')} AS pipeline, count(*) AS n, {r6('max(ms) - min(ms)')} AS spread FROM polled GROUP BY poll_us ORDER BY poll_us DESC LIMIT 60
""",
)
def _(spark, sf):
    ms = F.col("latency_ms")
    per = polls(spark, sf).filter("connected").groupBy("poll_us").agg(
        d6(F.avg(ms)).alias("pipeline"), F.count(F.lit(1)).alias("n"), d6(F.max(ms) - F.min(ms)).alias("spread")
    )
    return windows.rolling_history(per)
