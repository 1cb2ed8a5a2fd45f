"""Fleet views: states, KPIs, advice, pairs, latency."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.operators import estimators, latency
from tickweave.operators import fleet_state as fs
from tickweave.plans import q_estimators  # noqa: F401  (its view of measured rates)
from tickweave.plans import views as v
from tickweave.plans.registry import query, r6, sql_view
from tickweave.session import materialize

d6 = v.d6


def as_of(spark, sf):
    return v.accepted(spark, sf).agg(F.max("received_us")).scalar()


def states(spark, sf):
    return fs.latest_device_state(v.gated(spark, sf), as_of(spark, sf), within_us=v.LIVE_US)


def fleet_rows(spark, sf):
    devices = fs.registry_state_join(v.registry(spark, sf), states(spark, sf))
    # the rate that the estimate has come to over the device's dense frames
    rated = devices.join(estimators.measured_fps(v.frames_dense(spark, sf)), "pmu_id", "left").withColumn("approx_fps", F.coalesce("measured_fps", F.lit(0.0))).drop("measured_fps")
    return fs.fleet_table(rated, latency.last_hops(v.hop_samples(spark, sf)), fs.jitter(v.accepted(spark, sf)))


def kept_fleet(spark, sf):
    """The enabled devices as a written table, for plans that read it several times."""
    return materialize(fleet_rows(spark, sf).filter("active"), "fleet")


def enabled(spark, sf):
    return fleet_rows(spark, sf).filter("active")


def online(spark, sf):
    return enabled(spark, sf).filter("connected")


sql_view(
    "live_state",
    f"""
SELECT *, received_us >= (SELECT max(received_us) FROM accepted) - {v.LIVE_US} AS connected FROM (
  SELECT pmu_id, count(*) AS total_frames, max(received_us) FILTER (last) AS received_us, max(meas_us) FILTER (last) AS meas_us,
    max(freq) FILTER (last) AS freq, max(rocof) FILTER (last) AS rocof, max(stat) FILTER (last) AS stat, max(va_mag) FILTER (last) AS va_mag,
    max(va_deg) FILTER (last) AS va_deg
  FROM (SELECT *, row_number() OVER (PARTITION BY pmu_id ORDER BY arrival_seq DESC) = 1 AS last FROM accepted) GROUP BY pmu_id)
""",
)
sql_view(
    "hops_now",
    "SELECT pmu_id, "
    + ", ".join(f"arg_max(ms, seq) FILTER (stage = '{s}') AS hop_{s}" for s, _, _ in latency.STAGES)
    + " FROM hop_samples WHERE ms > 0 AND ms <= 300000 GROUP BY pmu_id",
)
sql_view(
    "jitters",
    """
SELECT pmu_id, CASE WHEN count(*) < 3 THEN 2 ELSE stddev_pop(freq) * 100 END AS jitter FROM (
  SELECT *, row_number() OVER (PARTITION BY pmu_id ORDER BY arrival_seq DESC) AS rn FROM accepted) WHERE rn <= 30 GROUP BY pmu_id
""",
)
sql_view(
    "rejects",
    """
SELECT pmu_id, count(*) FILTER (NOT quality_ok) AS quality_rejects,
  count(*) FILTER (NOT quality_ok AND reject_reason LIKE '%skew%') AS skew_rejects,
  arg_max(reject_reason, arrival_seq) FILTER (NOT quality_ok) AS last_reject FROM gated GROUP BY pmu_id
""",
)
sql_view(
    "devices",
    """
SELECT r.name AS pmu_id, r.active, r.station, r.region, r.vendor, r.voltage, r.ip, r.data_rate, coalesce(s.connected, FALSE) AS connected,
  r.station AS substation, s.received_us AS last_received_us, coalesce(s.total_frames, 0) AS total_frames,
  coalesce(j.quality_rejects, 0) AS quality_rejects, coalesce(j.skew_rejects, 0) AS skew_rejects, coalesce(j.last_reject, '') AS last_reject,
  CASE WHEN s.pmu_id IS NULL THEN 0 ELSE 50 END AS fnom, coalesce(s.freq, 0) AS freq, coalesce(s.freq - 50, 0) AS freq_dev,
  coalesce(s.rocof, 0) AS rocof, CASE WHEN s.connected THEN s.va_mag ELSE 0 END AS va_mag, CASE WHEN s.connected THEN s.va_deg ELSE 0 END AS va_deg,
  coalesce((s.stat >> 14) & 3 <> 0, FALSE) AS stat_data_error, h.* EXCLUDE (pmu_id),
  CASE WHEN m.rate > 0 THEN m.rate WHEN r.data_rate > 0 THEN r.data_rate ELSE 1.0::DOUBLE / -r.data_rate END AS approx_fps,
  CASE WHEN r.data_rate > 0 THEN r.data_rate ELSE 1.0::DOUBLE / -r.data_rate END AS cfg_fps,
  CASE WHEN s.connected THEN coalesce(t.jitter, 2) ELSE 99 END AS jitter,
  r.station || ' (:4712)' AS label
FROM registry r LEFT JOIN live_state s ON s.pmu_id = r.name LEFT JOIN rejects j ON j.pmu_id = r.name
  LEFT JOIN hops_now h ON h.pmu_id = r.name LEFT JOIN jitters t ON t.pmu_id = r.name LEFT JOIN measured_rates m ON m.pmu_id = r.name
""",
)
sql_view(
    "device_rates",
    """
SELECT *, CASE WHEN approx_fps >= 5 THEN approx_fps WHEN hop_frame_gap > 1 AND hop_frame_gap < 500 THEN 1000.0::DOUBLE / hop_frame_gap
    ELSE approx_fps END AS live_fps,
  CASE WHEN total_frames > 0 THEN quality_rejects * 100.0::DOUBLE / total_frames ELSE 0 END AS loss,
  CASE WHEN hop_e2e_recv_to_dashboard >= 0 THEN hop_e2e_recv_to_dashboard WHEN NOT connected THEN 999 ELSE 'NaN'::DOUBLE END AS latency
FROM devices
""",
)
sql_view(
    "device_shown",
    """
SELECT *, CASE WHEN connected AND live_fps > 0 AND abs(live_fps - cfg_fps) <= greatest(3, cfg_fps * 0.05) THEN cfg_fps ELSE live_fps END AS shown_fps,
  CASE WHEN live_fps >= 8 AND live_fps < cfg_fps * 0.55 THEN
    CASE WHEN live_fps >= 100 THEN 120 WHEN live_fps >= 45 THEN 60 WHEN live_fps >= 20 THEN 30 WHEN live_fps >= 8 THEN 10 END
    ELSE cfg_fps END AS target_fps FROM device_rates
""",
)
sql_view(
    "fleet",
    """
SELECT *, CASE WHEN NOT connected THEN 0 WHEN shown_fps <= 0 OR shown_fps / greatest(1, target_fps) >= 0.7 THEN 100
    ELSE greatest(0, least(100, floor(shown_fps / greatest(1, target_fps) * 1000 + 0.5) / 10)) END AS avail,
  CASE WHEN NOT connected THEN 'bad' WHEN loss > 1 THEN 'warn' ELSE 'ok' END AS tone,
  CASE WHEN NOT connected THEN 'Offline' WHEN loss > 1.5 OR (NOT isnan(latency) AND latency > 50) THEN 'Degraded' ELSE 'Healthy' END AS status_label,
  CASE WHEN NOT connected THEN 'Offline' WHEN loss > 1.5 THEN 'Degraded' ELSE 'Healthy' END AS device_status
FROM device_shown
""",
)


@query(
    "latest_device_state",
    f"""
SELECT pmu_id, total_frames, received_us AS last_received_us, meas_us, {r6('freq')} AS freq, {r6('freq - 50')} AS freq_dev, connected,
  CASE WHEN connected THEN 'receiving frames' ELSE 'disconnected' END AS connection_text,
  {r6('CASE WHEN connected THEN va_mag ELSE 0 END')} AS va_mag, {r6('CASE WHEN connected THEN va_deg ELSE 0 END')} AS va_deg FROM live_state
""",
)
def _(spark, sf):
    return states(spark, sf).select(
        "pmu_id", "total_frames", "last_received_us", "meas_us", d6("freq").alias("freq"), d6("freq_dev").alias("freq_dev"),
        "connected", "connection_text", d6("va_mag").alias("va_mag"), d6("va_deg").alias("va_deg"),
    )


@query(
    "registry_state_join",
    f"""
SELECT pmu_id, active, connected, station, region, substation, total_frames, quality_rejects, skew_rejects, last_reject, {r6('freq')} AS freq,
  {r6('freq_dev')} AS freq_dev, {r6('va_deg')} AS va_deg, stat_data_error FROM devices
""",
)
def _(spark, sf):
    rows = fs.registry_state_join(v.registry(spark, sf), states(spark, sf))
    return rows.select(
        "pmu_id", "active", "connected", "station", "region", "substation", "total_frames", "quality_rejects", "skew_rejects",
        "last_reject", d6("freq").alias("freq"), d6("freq_dev").alias("freq_dev"), d6("va_deg").alias("va_deg"), "stat_data_error",
    )


_HOPS = [f"hop_{s}" for s, _, _ in latency.STAGES]


@query("hops_join", "SELECT pmu_id, " + ", ".join(f"{r6(h)} AS {h}" for h in _HOPS) + f", {r6('approx_fps')} AS approx_fps FROM devices")
def _(spark, sf):
    return fleet_rows(spark, sf).select("pmu_id", *(d6(h).alias(h) for h in [*_HOPS, "approx_fps"]))


@query("jitter", f"SELECT pmu_id, {r6('jitter')} AS jitter FROM devices")
def _(spark, sf):
    return fleet_rows(spark, sf).select("pmu_id", d6("jitter").alias("jitter"))


@query(
    "device_filter",
    "SELECT pmu_id, region, tone FROM fleet WHERE active AND contains(lower(pmu_id || ' ' || substation || ' ' || vendor || ' ' || ip), 'vendor-1') "
    "AND tone = 'bad' AND region = 'ASIA'",
)
def _(spark, sf):
    hit = fs.device_filter(fleet_rows(spark, sf), tab="connected", search="Vendor-1", tone="BAD", region="ASIA")
    return hit.select("pmu_id", "region", "tone")


@query("issues_filter", f"SELECT pmu_id, connected, {r6('loss')} AS loss FROM fleet WHERE NOT connected OR loss > 1")
def _(spark, sf):
    return fs.issues_filter(fleet_rows(spark, sf)).select("pmu_id", "connected", d6("loss").alias("loss"))


@query(
    "region_summary",
    f"SELECT region, count(*) AS total, count(*) FILTER (connected) AS connected, {r6('avg(avail)')} AS availability FROM fleet WHERE active GROUP BY region",
)
def _(spark, sf):
    return fs.region_summary(enabled(spark, sf)).withColumn("availability", d6("availability"))


@query(
    "category_counts",
    """
SELECT 'region' AS kind, region AS name, count(*) AS n FROM fleet GROUP BY region
UNION ALL SELECT 'voltage', c.name, (SELECT count(*) FROM fleet f WHERE f.voltage = c.name) FROM
  (VALUES ('765 kV'), ('400 kV'), ('220 kV'), ('HVDC'), ('132 kV')) c(name)
UNION ALL SELECT 'vendor', vendor, count(*) FROM fleet GROUP BY vendor
""",
)
def _(spark, sf):
    return fs.category_counts(fleet_rows(spark, sf))


@query(
    "device_summary",
    """
SELECT count(*) AS registered, count(DISTINCT region) AS regions, count(*) FILTER (device_status = 'Healthy') AS healthy,
  count(*) FILTER (device_status = 'Degraded') AS degraded, count(*) FILTER (device_status = 'Offline') AS offline,
  round(avg(avail), 1) AS avg_availability, coalesce(round(avg(latency) FILTER (connected AND NOT isnan(latency)), 0), 0) AS avg_latency FROM fleet
""",
)
def _(spark, sf):
    return fs.device_summary(fleet_rows(spark, sf))


@query(
    "system_counts",
    """
SELECT *, CASE WHEN disconnected >= 2 THEN 'bad' WHEN disconnected > 0 THEN 'warn' ELSE 'ok' END AS tone,
  CASE WHEN disconnected >= 2 THEN disconnected || ' streams offline - operator action required'
    WHEN disconnected > 0 THEN disconnected || ' streams need attention' ELSE 'All systems nominal' END AS message
FROM (SELECT count(*) FILTER (active AND connected) AS connected, count(*) FILTER (active AND NOT connected) AS disconnected,
  CAST(sum(quality_rejects) FILTER (active) AS BIGINT) AS total_errors, count(*) FILTER (active) AS tab_active,
  count(*) FILTER (NOT active) AS tab_inactive FROM fleet)
""",
)
def _(spark, sf):
    return fs.system_counts(fleet_rows(spark, sf))


_WORST = "(SELECT {0} FROM enabled_fleet WHERE connected ORDER BY abs({1}) DESC, pmu_id DESC LIMIT 1)"
sql_view("enabled_fleet", "SELECT * FROM fleet WHERE active")


@query(
    "fleet_kpis",
    f"""
SELECT count(*) AS total, count(DISTINCT substation) AS substations, count(*) FILTER (NOT connected) AS offline,
  count(*) FILTER (NOT connected OR loss > 1) AS issues, CAST(floor(sum(shown_fps) + 0.5) AS BIGINT) AS total_fps,
  count(*) FILTER (connected AND stat_data_error) AS stat_errors, count(*) FILTER (connected) AS online,
  {r6(f"coalesce({_WORST.format('freq_dev', 'freq_dev')}, 0)")} AS worst_df, coalesce({_WORST.format('pmu_id', 'freq_dev')}, '—') AS worst_df_pmu,
  {r6(f"coalesce({_WORST.format('abs(rocof)', 'rocof')}, 0)")} AS max_rocof, coalesce({_WORST.format('pmu_id', 'rocof')}, '—') AS max_rocof_pmu
FROM enabled_fleet
""",
)
def _(spark, sf):
    k = fs.fleet_kpis(enabled(spark, sf))
    return k.withColumn("worst_df", d6("worst_df")).withColumn("max_rocof", d6("max_rocof"))


# half of the devices report another nominal frequency, some none
@query(
    "fleet_nominal",
    """
SELECT (SELECT f FROM n WHERE f > 0 GROUP BY f ORDER BY count(*) DESC, min(pmu_id) LIMIT 1) AS most_frequent,
  (SELECT f FROM n WHERE f > 0 ORDER BY pmu_id LIMIT 1) AS first_seen
FROM (SELECT 1)
""".replace(" n ", " (SELECT pmu_id, CASE length(station) % 3 WHEN 0 THEN 0 WHEN 1 THEN 50 ELSE 60 END AS f FROM fleet) "),
)
def _(spark, sf):
    k = F.length("station") % 3
    rows = fleet_rows(spark, sf).withColumn("fnom", F.when(k == 0, 0).when(k == 1, 50).otherwise(60))
    return fs.fleet_nominal(rows)


@query(
    "arrival_spread",
    f"""
SELECT {r6('(max(t) - min(t))::DOUBLE')} AS spread_ms, {r6('avg(hop_parse)')} AS parse_avg_ms, arg_min(pmu_id, (t, pmu_id)) AS earliest,
  arg_max(pmu_id, (t, pmu_id)) AS latest, count(*) AS n, {r6('(max(t) - min(t)) + avg(hop_parse)')} AS total_ms
FROM (SELECT *, last_received_us // 1000 AS t FROM enabled_fleet WHERE connected) HAVING count(*) >= 2
""".replace("arg_min(pmu_id, (t, pmu_id))", "first(pmu_id ORDER BY t, pmu_id)").replace("arg_max(pmu_id, (t, pmu_id))", "first(pmu_id ORDER BY t DESC, pmu_id DESC)"),
)
def _(spark, sf):
    s = fs.arrival_spread(enabled(spark, sf))
    return s.select(*(d6(c).alias(c) if c.endswith("_ms") else F.col(c) for c in s.columns))


sql_view(
    "cycles",
    """
SELECT wait AS pmu_wait, parse, pipeline, greatest(0, pipeline - parse) AS pipeline_rest, wait + pipeline AS total, 1000.0::DOUBLE / wait AS fps_hint
FROM (SELECT coalesce(CASE WHEN hop_frame_gap < 10000 THEN hop_frame_gap END, CASE WHEN approx_fps > 1 THEN 1000.0::DOUBLE / approx_fps END) AS wait,
  coalesce(hop_parse, 0) AS parse, coalesce(hop_e2e_recv_to_dashboard, latency) AS pipeline FROM enabled_fleet WHERE connected)
WHERE wait IS NOT NULL AND NOT isnan(pipeline) AND pipeline < 900
""",
)


@query(
    "mean_cycle_latency",
    "SELECT count(*) AS n, " + ", ".join(f"{r6(f'avg({f})')} AS {f}" for f in fs.CYCLE_FIELDS) + " FROM cycles HAVING count(*) > 0",
)
def _(spark, sf):
    m = fs.mean_cycle_latency(enabled(spark, sf))
    return m.select("n", *(d6(f).alias(f) for f in fs.CYCLE_FIELDS))


sql_view(
    "pairs",
    """
SELECT regexp_replace(a.pmu_id, '[^a-z0-9]+', '-', 'g') || '__' || regexp_replace(b.pmu_id, '[^a-z0-9]+', '-', 'g') AS pair,
  a.label || ' ↔ ' || b.label AS name, round(CASE WHEN abs(a.va_deg - b.va_deg) > 180 THEN 360 - abs(a.va_deg - b.va_deg) ELSE abs(a.va_deg - b.va_deg) END, 2) + 0.0 AS value,
  a.region AS region_a, b.region AS region_b
FROM enabled_fleet a JOIN enabled_fleet b ON a.connected AND b.connected AND a.pmu_id < b.pmu_id
""",
)


@query("device_pairs", "SELECT * FROM pairs")
def _(spark, sf):
    return fs.device_pairs(kept_fleet(spark, sf).filter("connected"))


@query("angle_pairs_topk", "SELECT pair, name, value FROM pairs ORDER BY value DESC, pair LIMIT 10")
def _(spark, sf):
    return fs.widest_pairs(kept_fleet(spark, sf).filter("connected")).select("pair", "name", "value")


@query(
    "connectivity_kpis",
    f"""
SELECT count(*) FILTER (tone <> 'ok') AS issues, count(*) FILTER (NOT connected) AS offline, count(*) FILTER (loss > 1.5) AS high_loss,
  {r6('coalesce(avg(latency) FILTER (connected AND NOT isnan(latency) AND latency < 900), 0)')} AS avg_latency,
  count(*) FILTER (connected AND NOT isnan(latency) AND latency < 900) AS measured, count(*) FILTER (connected) AS online, count(*) AS total
FROM enabled_fleet
""",
)
def _(spark, sf):
    return fs.connectivity_kpis(enabled(spark, sf)).withColumn("avg_latency", d6("avg_latency"))


_WEIGHT = "CASE WHEN NOT connected THEN 0 WHEN status_label = 'Degraded' THEN 1 ELSE 2 END"


@query("connectivity_sort", f"SELECT pmu_id, status_label, {_WEIGHT} AS weight, {r6('loss')} AS loss FROM enabled_fleet")
def _(spark, sf):
    rows = fs.connectivity_sort(enabled(spark, sf))
    return rows.select("pmu_id", "status_label", "weight", d6("loss").alias("loss"))


def _num(x: str, digits: int) -> str:
    return f"rtrim(rtrim(CAST(CAST(round({x}, {digits}) AS DECIMAL(18,{digits})) AS VARCHAR), '0'), '.')"


sql_view(
    "link_advice",
    f"""
SELECT * FROM (
  SELECT 0 AS rule, row_number() OVER (ORDER BY {_WEIGHT}, loss DESC, pmu_id) AS pos, 'bad' AS sev, 'Offline — ' || pmu_id AS title,
    '{fs.REC_TEXT['offline']}' AS "desc" FROM enabled_fleet WHERE NOT connected QUALIFY pos <= 4)
UNION ALL SELECT * FROM (SELECT 1, row_number() OVER (ORDER BY {_WEIGHT}, loss DESC, pmu_id) AS pos, 'warn', 'Packet loss — ' || pmu_id,
    'Quality rejects ' || {_num('loss', 2)} || '%. Inspect STAT / network path.' FROM enabled_fleet WHERE connected AND loss > 2 QUALIFY pos <= 3)
UNION ALL SELECT * FROM (SELECT 2, row_number() OVER (ORDER BY {_WEIGHT}, loss DESC, pmu_id) AS pos, 'warn', 'High latency — ' || pmu_id,
    'Receive→dashboard ' || {_num('latency', 2)} || ' ms (target under ~15 ms for local pipeline).' FROM enabled_fleet
    WHERE connected AND NOT isnan(latency) AND latency > 50 QUALIFY pos <= 3)
""",
)


@query("connectivity_recs", 'SELECT sev, title, "desc" FROM link_advice ORDER BY rule, pos LIMIT 8')
def _(spark, sf):
    return fs.connectivity_recs(kept_fleet(spark, sf)).select("sev", "title", "desc")


sql_view(
    "all_advice",
    f"""
SELECT 0 AS rule, 0 AS k0, 0.0::DOUBLE AS k1, '' AS k2, CASE WHEN value > 30 THEN 'bad' ELSE 'warn' END AS sev, 'Large angle separation: ' || name AS title,
  'Inter-PMU VA angle Δ = ' || {_num('value', 1)} || '° (from live phasors).' AS "desc" FROM (SELECT * FROM pairs ORDER BY value DESC, pair LIMIT 1) WHERE value > 25
UNION ALL SELECT 1, 0, 0, pmu_id || '#0', CASE WHEN abs(freq_dev) > 0.1 THEN 'warn' ELSE 'info' END, 'Frequency deviation on ' || pmu_id,
  'f = ' || {_num('freq', 3)} || ' Hz · Δf = ' || CASE WHEN freq_dev >= 0 THEN '+' ELSE '' END || {_num('freq_dev', 4)} || ' Hz vs CFG FNOM 50 Hz.'
  FROM enabled_fleet WHERE connected AND abs(freq_dev) > 0.05
UNION ALL SELECT 1, 0, 0, pmu_id || '#1', CASE WHEN abs(rocof) > 0.1 THEN 'warn' ELSE 'info' END, 'Elevated ROCOF on ' || pmu_id,
  '|ROCOF| = ' || {_num('abs(rocof)', 4)} || ' Hz/s from DATA frame DFREQ.' FROM enabled_fleet WHERE connected AND abs(rocof) > 0.05
UNION ALL SELECT 1, 0, 0, pmu_id || '#2', 'bad', 'STAT data error on ' || pmu_id, '{fs.REC_TEXT['stat']}' FROM enabled_fleet WHERE connected AND stat_data_error
UNION ALL SELECT 2, {_WEIGHT}, -loss, pmu_id, CASE WHEN connected THEN 'warn' ELSE 'bad' END, CASE WHEN connected THEN 'Quality rejects on ' ELSE 'Offline: ' END || pmu_id,
  CASE WHEN connected THEN 'Reject rate ≈ ' || {_num('loss', 2)} || '% of frames (qualityRejects / totalFrames).' ELSE '{fs.REC_TEXT['offline_analytics']}' END
  FROM enabled_fleet WHERE NOT connected OR loss > 1
UNION ALL SELECT 3, 0, -seq, '', CASE WHEN lower(status || ' ' || message) LIKE '%error%' THEN 'bad' ELSE 'info' END, stage || ' · ' || pmu_id, message
  FROM (SELECT * FROM events_log ORDER BY seq DESC LIMIT 5)
  WHERE lower(status || ' ' || message) LIKE '%error%' OR lower(status || ' ' || message) LIKE '%reject%' OR lower(status || ' ' || message) LIKE '%timeout%'
""",
)
_TOP_ADVICE = """SELECT sev, title, "desc" FROM (SELECT *, row_number() OVER (PARTITION BY title ORDER BY rule, k0, k1, k2) AS rn FROM all_advice)
WHERE rn = 1 ORDER BY rule, k0, k1, k2 LIMIT 8"""


def advisories(spark, sf, devices, pairs):
    return fs.analytics_recs(devices, pairs, v.events_log(spark, sf))


@query("analytics_recs", _TOP_ADVICE)
def _(spark, sf):
    devices = kept_fleet(spark, sf)
    return advisories(spark, sf, devices, fs.device_pairs(devices.filter("connected"))).select("sev", "title", "desc")


@query(
    "analytics_kpis",
    f"""
SELECT count(*) FILTER (connected) AS online, count(*) AS total, {r6('avg(freq) FILTER (connected)')} AS avg_freq, 50 AS fnom,
  (SELECT max(value) FROM pairs) AS max_angle, (SELECT name FROM pairs ORDER BY value DESC, pair LIMIT 1) AS max_angle_pair,
  {r6(_WORST.format('freq_dev', 'freq_dev'))} AS worst_df, {_WORST.format('pmu_id', 'freq_dev')} AS worst_df_pmu,
  {r6(_WORST.format('abs(rocof)', 'rocof'))} AS max_rocof, {_WORST.format('pmu_id', 'rocof')} AS max_rocof_pmu,
  (SELECT count(*) FROM ({_TOP_ADVICE})) AS advisories, CASE WHEN (SELECT max(value) FROM pairs) > 20 THEN 'warn' ELSE 'ok' END AS angle_tone,
  CASE WHEN abs({_WORST.format('freq_dev', 'freq_dev')}) > 0.05 THEN 'warn' ELSE 'ok' END AS df_tone,
  CASE WHEN {_WORST.format('abs(rocof)', 'rocof')} > 0.1 THEN 'warn' ELSE 'neutral' END AS rocof_tone,
  CASE WHEN count(*) FILTER (connected) < count(*) THEN 'warn' ELSE 'ok' END AS online_tone, 'accent' AS advisory_tone
FROM enabled_fleet
""",
)
def _(spark, sf):
    devices = kept_fleet(spark, sf)
    pairs = fs.device_pairs(devices.filter("connected"))
    k = fs.analytics_kpis(devices, pairs, advisories(spark, sf, devices, pairs))
    return k.withColumns({c: d6(c) for c in ("avg_freq", "worst_df", "max_rocof")})


@query(
    "live_alerts",
    f"""
SELECT sev, title, msg AS "desc" FROM (
  SELECT 0 AS part, 0 AS k, pmu_id AS n, CASE WHEN connected THEN 'warn' ELSE 'bad' END AS sev, CASE WHEN connected THEN 'Elevated packet loss' ELSE 'PMU offline' END AS title,
    pmu_id || ' - ' || CASE WHEN connected THEN {_num('loss', 2)} || '% loss' ELSE 'stream disconnected' END AS msg FROM enabled_fleet WHERE NOT connected OR loss > 1
  UNION ALL SELECT 1, -seq, '', CASE WHEN status || ' ' || message LIKE '%error%' THEN 'bad' WHEN status || ' ' || message LIKE '%reject%' THEN 'warn' ELSE 'info' END,
    stage, pmu_id || ' - ' || message FROM (SELECT * FROM events_log ORDER BY seq DESC LIMIT 18))
ORDER BY part, k, n LIMIT 24
""",
)
def _(spark, sf):
    return fs.live_alerts(enabled(spark, sf), v.events_log(spark, sf)).select("sev", "title", "desc")


# --- hops ----------------------------------------------------------------------------

sql_view("good_hops", "SELECT * FROM hop_samples WHERE ms > 0 AND ms <= 300000")
sql_view(
    "stage_stats",
    """
SELECT stage, last_ms, avg_ms, p95_ms, max_ms, n FROM (
  SELECT stage, max(ms) AS max_ms, count(*) AS n FROM good_hops GROUP BY stage) JOIN (
  SELECT stage, avg(ms) AS avg_ms, arg_max(ms, seq) AS last_ms, list_sort(list(ms))[CAST(ceil(count(*) * 0.95) AS BIGINT)] AS p95_ms FROM (
    SELECT *, row_number() OVER (PARTITION BY stage ORDER BY seq DESC) AS rn FROM good_hops) WHERE rn <= 256 GROUP BY stage) USING (stage)
""",
)


@query(
    "hop_stats",
    f"SELECT stage, {r6('last_ms')} AS last_ms, {r6('avg_ms')} AS avg_ms, {r6('p95_ms')} AS p95_ms, {r6('max_ms')} AS max_ms, n AS count FROM stage_stats",
)
def _(spark, sf):
    s = latency.hop_stats(v.hop_samples(spark, sf))
    return s.select("stage", *(d6(c).alias(c) for c in ("last_ms", "avg_ms", "p95_ms", "max_ms")), "count")


@query(
    "slowest_stage",
    f"SELECT stage, {r6('avg_ms')} AS avg_ms FROM stage_stats WHERE stage IN ('parse', 'align_wait', 'dashboard_record') ORDER BY avg_ms DESC LIMIT 1",
)
def _(spark, sf):
    s = latency.slowest_stage(latency.hop_stats(v.hop_samples(spark, sf)))
    return s.select("stage", d6("avg_ms").alias("avg_ms"))


@query(
    "hop_histogram",
    f"""
SELECT stage, le, count(*) FILTER (ms / 1000.0::DOUBLE <= le) AS n, {r6('sum(ms / 1000.0::DOUBLE)')} AS sum_s, count(*) AS count
FROM good_hops CROSS JOIN (SELECT unnest({latency.STAGE_BUCKETS}::DOUBLE[]) AS le) GROUP BY stage, le
""",
)
def _(spark, sf):
    return latency.hop_histogram(v.hop_samples(spark, sf)).withColumn("sum_s", d6("sum_s"))


@query(
    "last_hops",
    "SELECT pmu_id, " + ", ".join(f"{r6(h)} AS {h}" for h in _HOPS) + ", concat_ws(' ', "
    + ", ".join(f"'{s}=' || printf('%.2fms', round(hop_{s}, 2))" for s, _, _ in latency.STAGES) + ") AS line FROM hops_now",
)
def _(spark, sf):
    h = latency.last_hops(v.hop_samples(spark, sf))
    return h.select("pmu_id", *(d6(c).alias(c) for c in _HOPS), "line")
