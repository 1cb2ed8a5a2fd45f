"""Scalar functions applied to whole views."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tickweave.functions import bits, fleet, layout, phasor, registry
from tickweave.operators import align
from tickweave.plans import views as v
from tickweave.plans.q_align import hourly_points
from tickweave.plans.registry import query, r6, sql_view

d6 = v.d6


# --- phasors -------------------------------------------------------------------------

RECT = """
SELECT arrival_seq, va_mag * cos(radians(va_deg)) AS va_re, va_mag * sin(radians(va_deg)) AS va_im,
  vb_mag * cos(radians(vb_deg)) AS vb_re, vb_mag * sin(radians(vb_deg)) AS vb_im,
  vc_mag * cos(radians(vc_deg)) AS vc_re, vc_mag * sin(radians(vc_deg)) AS vc_im,
  ia_mag * cos(radians(ia_deg)) AS ia_re, ia_mag * sin(radians(ia_deg)) AS ia_im FROM frames
"""
sql_view("rect", RECT)
sql_view(
    "seqs",
    """
SELECT arrival_seq, sqrt(pr * pr + pi_ * pi_) AS pos, sqrt(nr * nr + ni * ni) AS neg, sqrt(zr * zr + zi * zi) AS zero FROM (
  SELECT arrival_seq,
    (va_re - 0.5 * vb_re - sqrt(3) / 2 * vb_im - 0.5 * vc_re + sqrt(3) / 2 * vc_im) / 3 AS pr,
    (va_im - 0.5 * vb_im + sqrt(3) / 2 * vb_re - 0.5 * vc_im - sqrt(3) / 2 * vc_re) / 3 AS pi_,
    (va_re - 0.5 * vb_re + sqrt(3) / 2 * vb_im - 0.5 * vc_re - sqrt(3) / 2 * vc_im) / 3 AS nr,
    (va_im - 0.5 * vb_im - sqrt(3) / 2 * vb_re - 0.5 * vc_im + sqrt(3) / 2 * vc_re) / 3 AS ni,
    (va_re + vb_re + vc_re) / 3 AS zr, (va_im + vb_im + vc_im) / 3 AS zi FROM rect)
""",
)


@query(
    "polar_to_rect",
    f"SELECT r.arrival_seq, {r6('va_re')} AS re, {r6('va_im')} AS im, "
    f"{r6('va_re / max(va_mag) OVER ()')} AS x, {r6('va_im / max(va_mag) OVER ()')} AS y "
    "FROM rect r JOIN frames f USING (arrival_seq)",
)
def _(spark, sf):
    f = v.frames(spark, sf)
    top = F.greatest(f.agg(F.max("va_mag")).scalar(), F.lit(1e-9))
    re, im = phasor.rect_of("va_mag", "va_deg")
    return f.select("arrival_seq", d6(re).alias("re"), d6(im).alias("im"), d6(re / top).alias("x"), d6(im / top).alias("y"))


@query(
    "rect_to_polar",
    f"SELECT arrival_seq, {r6('sqrt(va_re * va_re + va_im * va_im)')} AS mag, "
    f"abs({r6('degrees(atan2(va_im, va_re))')}) AS deg_abs FROM rect",
)
def _(spark, sf):
    # -180 and 180 are the same direction; rounding noise decides which comes out
    mag, deg = phasor.polar_of(*phasor.rect_of("va_mag", "va_deg"))
    return v.frames(spark, sf).select("arrival_seq", d6(mag).alias("mag"), F.abs(d6(deg)).alias("deg_abs"))


@query(
    "angle_diff_signed",
    "SELECT arrival_seq, CASE WHEN d > 180 THEN d - 360 WHEN d < -180 THEN d + 360 ELSE d END + 0.0 AS diff "
    "FROM (SELECT arrival_seq, ia_deg - va_deg AS d FROM frames)",
)
def _(spark, sf):
    return v.frames(spark, sf).select("arrival_seq", d6(phasor.angle_diff("va_deg", "ia_deg")).alias("diff"))


@query(
    "angle_delta_abs",
    "SELECT arrival_seq, CASE WHEN d > 180 THEN 360 - d ELSE d END + 0.0 AS delta "
    "FROM (SELECT arrival_seq, abs(ia_deg - vc_deg) AS d FROM frames)",
)
def _(spark, sf):
    return v.frames(spark, sf).select("arrival_seq", d6(phasor.angle_delta("ia_deg", "vc_deg")).alias("delta"))


def _seqs() -> tuple[Column, Column, Column]:
    return phasor.sequence_magnitudes(("va_mag", "va_deg"), ("vb_mag", "vb_deg"), ("vc_mag", "vc_deg"))


@query(
    "sequence_components",
    f"SELECT arrival_seq, {r6('pos')} AS pos, {r6('neg')} AS neg, {r6('zero')} AS zero FROM seqs",
)
def _(spark, sf):
    pos, neg, zero = _seqs()
    return v.frames(spark, sf).select("arrival_seq", d6(pos).alias("pos"), d6(neg).alias("neg"), d6(zero).alias("zero"))


@query(
    "voltage_imbalance_pct",
    f"SELECT arrival_seq, {r6('CASE WHEN pos > 0.1 THEN neg / pos * 100 ELSE 0 END')} AS imbalance_pct FROM seqs",
)
def _(spark, sf):
    pos, neg, _ = _seqs()
    return v.frames(spark, sf).select("arrival_seq", d6(phasor.imbalance_pct(pos, neg)).alias("imbalance_pct"))


def _wrap(a: str, b: str) -> str:
    d = f"({b} - {a})"
    return f"CASE WHEN {d} > 180 THEN {d} - 360 WHEN {d} < -180 THEN {d} + 360 ELSE {d} END + 0.0"


@query(
    "phase_differences",
    f"SELECT arrival_seq, {_wrap('va_deg', 'vb_deg')} AS vab, {_wrap('vb_deg', 'vc_deg')} AS vbc, "
    f"{_wrap('vc_deg', 'va_deg')} AS vca FROM frames",
)
def _(spark, sf):
    diff = phasor.angle_diff
    return v.frames(spark, sf).select(
        "arrival_seq",
        d6(diff("va_deg", "vb_deg")).alias("vab"),
        d6(diff("vb_deg", "vc_deg")).alias("vbc"),
        d6(diff("vc_deg", "va_deg")).alias("vca"),
    )


# FNOM as the layout says it (50, 60 or unset), FREQ as float or as an integer offset
@query(
    "frequency_deviation",
    f"""
SELECT arrival_seq, {r6('freq - nominal')} AS freq_dev, CAST(floor(nominal + 0.5) AS INTEGER) AS nominal FROM (
  SELECT *, CASE WHEN is_float AND abs(freq - base) > 5 AND abs(freq - other) < 3 THEN other ELSE base END AS nominal FROM (
    SELECT *, CASE WHEN base >= 55 THEN 50.0::DOUBLE ELSE 60.0::DOUBLE END AS other FROM (
      SELECT arrival_seq, freq, arrival_seq % 2 = 0 AS is_float,
        (CASE arrival_seq % 3 WHEN 0 THEN 50 WHEN 1 THEN 60 ELSE 50 END)::DOUBLE AS base FROM frames)))
""",
)
def _(spark, sf):
    e = F.col("arrival_seq")
    fnom = F.when(e % 3 == 0, 50).when(e % 3 == 1, 60).otherwise(0)
    nominal = phasor.nominal_hz("freq", fnom, e % 2 == 0)
    return v.frames(spark, sf).select(
        "arrival_seq", d6(F.col("freq") - nominal).alias("freq_dev"), F.floor(nominal + 0.5).cast("int").alias("nominal")
    )


@query(
    "complex_power",
    # products of the fixture have seven decimals, so a sixth would be rounded from exact ties
    "SELECT arrival_seq, round(va_re * ia_re + va_im * ia_im, 8) AS p, round(va_im * ia_re - va_re * ia_im, 8) AS q FROM rect",
)
def _(spark, sf):
    p, q = phasor.complex_power("va_mag", "va_deg", "ia_mag", "ia_deg")
    return v.frames(spark, sf).select("arrival_seq", F.round(p, 8).alias("p"), F.round(q, 8).alias("q"))


@query(
    "mw_mvar_mva_pf",
    f"""
SELECT arrival_seq, {r6('mw')} AS mw, {r6('mvar')} AS mvar, {r6('s')} AS mva,
  {r6('CASE WHEN s > 0.1 THEN least(mw / s, 1) ELSE 1 END')} AS power_factor,
  CASE WHEN s > 0.1 AND mvar > 0 THEN 'lagging' WHEN s > 0.1 AND mvar < 0 THEN 'leading' ELSE 'unity' END AS power_factor_direction
FROM (SELECT *, sqrt(mw * mw + mvar * mvar) AS s FROM (
  SELECT arrival_seq, analog1 AS mw, CASE WHEN arrival_seq % 4 = 0 THEN -analog2 WHEN arrival_seq % 4 = 1 THEN 0 ELSE analog2 END AS mvar FROM frames))
""",
)
def _(spark, sf):
    e, second = F.col("arrival_seq"), F.get("analogs", F.lit(1))
    mvar = F.when(e % 4 == 0, -second).when(e % 4 == 1, F.lit(0.0)).otherwise(second)
    out = phasor.power_summary(F.array(F.get("analogs", F.lit(0)), mvar))
    return v.frames(spark, sf).select(
        "arrival_seq", *((d6(c) if n != "power_factor_direction" else c).alias(n) for n, c in out.items())
    )


NAMES = ["VA", "PHASOR CH 1:V1", "BUS_A.AV", "ib-n", "Line 3 I3", "V2", "xCI", " vc ", "AUX", "PHASE-B", "CH:", "TI1"]
CLASSES = ["va", "va", "va", "ib", "ic", "vb", "ic", "vc", "", "vb", "", "ia"]


@query(
    "classify_phasor",
    f"SELECT event_id, ({NAMES!r})[event_id % {len(NAMES)} + 1] AS name, "
    f"({CLASSES!r})[event_id % {len(NAMES)} + 1] AS class FROM events",
)
def _(spark, sf):
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("event_id") % len(NAMES) + 1).cast("int"))
    return v.table(spark, sf, "events").select("event_id", name.alias("name")).withColumn("class", phasor.channel_class("name"))


# four kinds of layouts; the last has names that say nothing
CHANNEL_SETS = [
    ["VA", "VB", "VC", "IA"],
    ["PHASOR CH 1:V1", "PHASOR CH 2:I1"],
    ["VA1", "VA2", "X", "Y"],
    ["P1", "P2", "P3", "P4"],
]


def with_channels(spark, sf):
    mags, degs = ["va_mag", "vb_mag", "vc_mag", "ia_mag"], ["va_deg", "vb_deg", "vc_deg", "ia_deg"]
    sets = [
        F.array(*(F.struct(F.lit(n).alias("name"), F.col(m).alias("mag"), F.col(d).alias("deg")) for n, m, d in zip(s, mags, degs)))
        for s in CHANNEL_SETS
    ]
    kind = F.col("arrival_seq") % len(sets)
    pick = F.coalesce(*(F.when(kind == i, s) for i, s in enumerate(sets)))
    return v.frames(spark, sf).withColumn("channels", pick)


def slotted(spark, sf):
    c = with_channels(spark, sf)
    arrays = {"phasor_mag": F.col("channels.mag"), "phasor_deg": F.col("channels.deg")}
    bare = c.select("arrival_seq", F.col("channels.name").alias("phasor_names"), *(a.alias(n) for n, a in arrays.items()))
    return phasor.with_standard_slots(phasor.with_slot_plan(bare))


def _by_set(*exprs: str) -> str:
    return "CASE arrival_seq % 4 " + " ".join(f"WHEN {i} THEN {e}" for i, e in enumerate(exprs)) + " END"


def _slot_sql(field: str) -> dict[str, str]:
    va, vb, vc, ia = (f"{p}_{field}" for p in ("va", "vb", "vc", "ia"))
    return {
        "va": r6(_by_set(va, va, vb, va)),
        "vb": r6(_by_set(vb, "0", vb, vb)),
        "vc": r6(_by_set(vc, "0", "0", vc)),
        "ia": r6(_by_set(ia, vb, "0", ia)),
    }


@query(
    "map_standard_phasors",
    "SELECT arrival_seq, " + ", ".join(f"{e} AS {p}_{f}" for f in ("mag", "deg") for p, e in _slot_sql(f).items()) + " FROM frames",
)
def _(spark, sf):
    slots = [f"{p}_{f}" for f in ("mag", "deg") for p in phasor.SLOTS]
    return slotted(spark, sf).select("arrival_seq", *(d6(c).alias(c) for c in slots))


@query(
    "trend_phasors",
    "SELECT arrival_seq, "
    + ", ".join(f"{e} AS {p}_{f}" for f in ("mag", "deg") for p, e in _slot_sql(f).items())
    + ", 0.0::DOUBLE AS ib_mag, 0.0::DOUBLE AS ic_mag FROM frames",
)
def _(spark, sf):
    s = slotted(spark, sf)
    mags, degs = phasor.trend_values("mag", "phasor_mag"), phasor.trend_values("deg", "phasor_deg")
    return s.select(
        "arrival_seq",
        *(d6(c).alias(f"{p}_mag") for p, c in mags.items()),
        *(d6(degs[p]).alias(f"{p}_deg") for p in ("va", "vb", "vc", "ia")),
    )


@query(
    "display_phasors",
    "SELECT arrival_seq, "
    + _by_set("'VA VB VC IA'", "'VA IA'", "'VA VA Y X'", "'P4 P3 P2 P1'")
    + " AS labels, "
    + _by_set(
        "'IA, VC, VB, VA'",
        "'IA (PHASOR CH 2:I1), VA (PHASOR CH 1:V1)'",
        "'Y, X, VA (VA2), VA (VA1)'",
        "'P4, P3, P2, P1'",
    )
    + " AS cfg_list FROM frames",
)
def _(spark, sf):
    # unknown names keep their input order, here the reversed one
    names = F.reverse(F.transform("channels", lambda c: c["name"]))
    labels = F.transform(layout.display_order("names", "known"), lambda t: t["label"])
    return (
        with_channels(spark, sf)
        .withColumn("names", names)
        .withColumn("known", layout.display_labels("names"))
        .select("arrival_seq", F.array_join(labels, " ").alias("labels"), layout.cfg_list_text("names", "known").alias("cfg_list"))
    )


_PHASES = ["va", "vb", "vc", "ia", "ib", "ic"]
sql_view(
    "point_phasors",
    "SELECT * FROM ("
    + " UNION ALL ".join(
        f"SELECT tick_us, pmu_id, '{p.upper()}' AS label, {p}_mag AS mag, {p}_deg AS deg FROM hourly_points" for p in _PHASES[:4]
    )
    + ") WHERE NOT (mag = 0 AND deg = 0)",
)


def point_phasors(measures):
    """Aligned points as (tick, device, label, magnitude, angle) rows; empty phasors left out."""
    rows = F.array(*(F.struct(F.lit(p.upper()).alias("label"), F.col(p).alias("mag"), F.col(f"{p}_angle").alias("deg")) for p in _PHASES))
    return measures.select("tick_us", "pmu_id", F.explode(rows).alias("r")).select("tick_us", "pmu_id", "r.*").filter(
        (F.col("mag") != 0) | (F.col("deg") != 0)
    )


@query("nonzero_phasors", f"SELECT tick_us, pmu_id, label, {r6('mag')} AS mag, {r6('deg')} AS deg FROM point_phasors")
def _(spark, sf):
    rows = point_phasors(align.point_measures(hourly_points(spark, sf)))
    return rows.select("tick_us", "pmu_id", "label", d6("mag").alias("mag"), d6("deg").alias("deg"))


# --- registry ------------------------------------------------------------------------

TZ = """CASE WHEN lower(trim(timestamp_tz)) IN ('local', 'host', 'auto', 'system') THEN lower(trim(timestamp_tz))
  WHEN upper(trim(timestamp_tz)) IN ('UTC', 'GMT', 'Z', 'ZULU') THEN 'UTC'
  WHEN upper(trim(timestamp_tz)) IN ('IST', 'INDIA', 'ASIA/KOLKATA', 'ASIA/CALCUTTA') THEN 'Asia/Kolkata'
  ELSE trim(timestamp_tz) END"""
PROTO = "CASE WHEN lower(trim(protocol)) = 'udp' THEN 'udp' ELSE 'tcp' END"
IDENTITY = f"""CASE WHEN trim(ip) = '' OR port <= 0 THEN ''
  ELSE CASE WHEN {PROTO} = 'udp' THEN 'udp:' ELSE '' END || trim(ip) || ':' || port END"""


@query("normalize_tz", f"SELECT form_id, {TZ} AS tz FROM registry_forms")
def _(spark, sf):
    return v.registry_forms(spark, sf).select("form_id", registry.normalize_tz("timestamp_tz").alias("tz"))


@query(
    "effective_tz",
    f"""
SELECT form_id, CASE WHEN tz IN ('local', 'host', 'auto', 'system') THEN 'Europe/Paris' WHEN tz <> '' THEN tz
  WHEN trim(ip) LIKE '127.%' THEN 'UTC' ELSE 'Asia/Kolkata' END AS tz
FROM (SELECT form_id, ip, {TZ} AS tz FROM registry_forms)
""",
)
def _(spark, sf):
    tz = registry.effective_tz("timestamp_tz", "ip", fleet_tz="Asia/Kolkata", host_tz="Europe/Paris")
    return v.registry_forms(spark, sf).select("form_id", tz.alias("tz"))


@query(
    "reinterpret_tz",
    """
SELECT arrival_seq, meas_us - (CASE arrival_seq % 4 WHEN 0 THEN 0 WHEN 1 THEN 19800 WHEN 2 THEN 3600 ELSE -12600 END)
  * 1000000::BIGINT AS true_us FROM frames
""",
)
def _(spark, sf):
    # whole table lies in winter time
    e = F.col("arrival_seq") % 4
    tz = F.when(e == 0, "UTC").when(e == 1, "Asia/Kolkata").when(e == 2, "Europe/Berlin").otherwise("UTC-03:30")
    return v.frames(spark, sf).select("arrival_seq", registry.reinterpret_us("meas_us", tz).alias("true_us"))


@query(
    "endpoint_identity",
    f"SELECT form_id, {IDENTITY} AS identity, {PROTO} || '|' || trim(ip) || '|' || port AS endpoint_key FROM registry_forms",
)
def _(spark, sf):
    return v.registry_forms(spark, sf).select(
        "form_id",
        registry.endpoint_identity("ip", "port", "protocol").alias("identity"),
        registry.endpoint_key("ip", "port", "protocol").alias("endpoint_key"),
    )


@query(
    "registry_normalize",
    f"""
SELECT form_id, trim(ip) AS ip, port, {PROTO} AS protocol, CASE WHEN {PROTO} = 'tcp' THEN 0 ELSE tcp_port END AS tcp_port,
  CASE WHEN timeout_sec <= 0 THEN 60 ELSE timeout_sec END AS timeout_sec,
  CASE WHEN reconnect_sec <= 0 THEN 5 ELSE reconnect_sec END AS reconnect_sec, trim(station) AS station, {TZ} AS timestamp_tz,
  CASE WHEN {IDENTITY} <> '' THEN {IDENTITY} ELSE name END AS name, active
FROM registry_forms
""",
)
def _(spark, sf):
    from tickweave.operators.registry import registry_normalize

    return registry_normalize(v.registry_forms(spark, sf))


@query(
    "device_labels",
    """
SELECT name, regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS slug, CASE WHEN length(station) % 2 = 0 THEN station ELSE name END AS display,
  '4712' AS port, CASE WHEN length(station) % 2 = 0 THEN station || ' (:4712)' ELSE name END AS chart
FROM registry
""",
)
def _(spark, sf):
    station = F.when(F.length("station") % 2 == 0, F.concat(F.lit(" "), F.col("station"))).otherwise("  ")
    return v.registry(spark, sf).withColumn("station", station).select(
        "name",
        registry.device_slug("name").alias("slug"),
        registry.display_name("name", "station").alias("display"),
        registry.endpoint_port("name").alias("port"),
        registry.chart_label("name", "station").alias("chart"),
    )


# --- rates, loss, latency ------------------------------------------------------------


def live_stats(spark, sf):
    """One synthetic live state per event: rates, gaps, counters with gaps in them."""
    e, val = F.col("event_id"), F.col("value")
    return v.table(spark, sf, "events").select(
        e.alias("id"),
        (e % 5 != 0).alias("connected"),
        F.when(e % 7 == 0, 0.0).otherwise(val / 2).alias("approx_fps"),
        F.when(e % 3 == 0, ((e * 17) % 700).cast("double")).alias("frame_gap"),
        F.element_at(F.array(F.lit(25), F.lit(50), F.lit(-5), F.lit(0)), (e % 4 + 1).cast("int")).alias("data_rate"),
        (e % 2000).alias("total"),
        (e % 37).alias("rejects"),
        F.when(e % 11 != 0, val).alias("e2e"),
        F.when(e % 6 != 0, val / 10).alias("parse"),
        (val / 20).alias("jitter"),
    )


sql_view(
    "live_stats",
    """
SELECT *, CASE WHEN data_rate > 0 THEN data_rate WHEN data_rate < 0 THEN 1.0::DOUBLE / -data_rate ELSE 0 END AS cfg,
  CASE WHEN approx_fps >= 5 THEN approx_fps WHEN frame_gap > 1 AND frame_gap < 500 THEN 1000.0::DOUBLE / frame_gap ELSE approx_fps END AS live,
  CASE WHEN total > 0 THEN rejects * 100.0::DOUBLE / total ELSE 0 END AS loss,
  CASE WHEN e2e IS NOT NULL THEN e2e WHEN NOT connected THEN 999 ELSE 'NaN'::DOUBLE END AS latency
FROM (
  SELECT event_id AS id, event_id % 5 <> 0 AS connected, CASE WHEN event_id % 7 = 0 THEN 0 ELSE value / 2 END AS approx_fps,
    CASE WHEN event_id % 3 = 0 THEN ((event_id * 17) % 700)::DOUBLE END AS frame_gap, ([25, 50, -5, 0])[event_id % 4 + 1] AS data_rate,
    event_id % 2000 AS total, event_id % 37 AS rejects, CASE WHEN event_id % 11 <> 0 THEN value END AS e2e,
    CASE WHEN event_id % 6 <> 0 THEN value / 10 END AS parse, value / 20 AS jitter FROM events)
""",
)
sql_view(
    "live_rates",
    """
SELECT *, CASE WHEN connected AND cfg > 0 AND live > 0 AND abs(live - cfg) <= greatest(3, cfg * 0.05) THEN cfg ELSE live END AS shown,
  CASE WHEN live >= 8 AND cfg > 0 AND live < cfg * 0.55 THEN snapped WHEN cfg > 0 THEN cfg WHEN live > 1 THEN snapped ELSE 60 END AS target
FROM (SELECT *, CASE WHEN live >= 100 THEN 120 WHEN live >= 45 THEN 60 WHEN live >= 20 THEN 30 WHEN live >= 8 THEN 10
  ELSE greatest(1, floor(live + 0.5)) END AS snapped FROM live_stats)
""",
)
_LIVE = lambda: fleet.effective_fps("approx_fps", "frame_gap")
_CFG = lambda: fleet.cfg_rate_fps("data_rate")
_LOSS = lambda: fleet.loss_pct("rejects", "total")
_LATENCY = lambda: fleet.latency_ms("connected", "e2e")
NO_NAN = "CASE WHEN isnan({0}) THEN -1 ELSE {0} END"


def _no_nan(c: Column) -> Column:
    return F.when(F.isnan(c), F.lit(-1.0)).otherwise(c)


def _scalar(name: str, expr: str, column, source: str = "live_stats") -> None:
    """Register a one-number function of the live state."""

    @query(name, f"SELECT id, {r6(expr)} AS value FROM {source}")
    def _(spark, sf):
        return live_stats(spark, sf).select("id", d6(column()).alias("value"))


_scalar("cfg_rate_fps", "cfg", _CFG)
_scalar(
    "snap_reported_fps",
    "CASE WHEN cfg > 0 AND approx_fps > 0 AND abs(approx_fps - cfg) <= greatest(3, cfg * 0.05) THEN cfg ELSE approx_fps END",
    lambda: fleet.snap_fps("approx_fps", _CFG()),
)
_scalar("effective_fps", "live", _LIVE)
_scalar("target_fps", "target", lambda: fleet.target_fps(_LIVE(), _CFG()), "live_rates")
_scalar(
    "availability_pct",
    "CASE WHEN NOT connected THEN 0 WHEN shown <= 0 OR shown / greatest(1, target) >= 0.7 THEN 100 "
    "ELSE greatest(0, least(100, floor(shown / greatest(1, target) * 1000 + 0.5) / 10)) END",
    lambda: fleet.availability_pct("connected", _LIVE(), _CFG()),
    "live_rates",
)
_scalar("loss_pct", "loss", _LOSS)
_scalar("latency_ms", NO_NAN.format("latency"), lambda: _no_nan(_LATENCY()))


@query(
    "liveness_timeout",
    """
SELECT id, CAST(least(greatest(3 * floor(1e6 / greatest(CASE WHEN data_rate = 0 THEN 20 ELSE cfg END, 0.05)), 1000000), 30000000) AS BIGINT)
  AS timeout_us FROM live_stats
""",
)
def _(spark, sf):
    return live_stats(spark, sf).select("id", fleet.liveness_timeout_us("data_rate").alias("timeout_us"))


@query(
    "cycle_latency",
    f"""
SELECT id, {r6('wait')} AS pmu_wait, {r6('coalesce(parse, 0)')} AS parse, {r6('latency')} AS pipeline,
  {r6('greatest(0, latency - coalesce(parse, 0))')} AS pipeline_rest, {r6('wait + latency')} AS total,
  {r6('CASE WHEN wait > 0 THEN 1000.0::DOUBLE / wait ELSE approx_fps END')} AS fps_hint
FROM (SELECT *, coalesce(frame_gap, CASE WHEN approx_fps > 1 THEN 1000.0::DOUBLE / approx_fps END) AS wait FROM live_stats)
WHERE connected AND wait IS NOT NULL AND NOT isnan(latency) AND latency < 900
""",
)
def _(spark, sf):
    c = fleet.cycle_latency("connected", "frame_gap", "parse", "e2e", "approx_fps")
    fields = ["pmu_wait", "parse", "pipeline", "pipeline_rest", "total", "fps_hint"]
    rows = live_stats(spark, sf).select("id", c.alias("c")).filter(F.col("c").isNotNull())
    return rows.select("id", *(d6(F.col("c")[f]).alias(f) for f in fields))


@query(
    "status_tone",
    """
SELECT id, CASE WHEN NOT connected THEN 'bad' WHEN loss > 1 THEN 'warn' ELSE 'ok' END AS tone,
  CASE WHEN NOT connected THEN 'Offline' WHEN loss > 1.5 OR (NOT isnan(latency) AND latency > 50) THEN 'Degraded' ELSE 'Healthy' END AS link_status,
  CASE WHEN NOT connected THEN 'Offline' WHEN loss > 1.5 THEN 'Degraded' ELSE 'Healthy' END AS device_status
FROM live_stats
""",
)
def _(spark, sf):
    return live_stats(spark, sf).select(
        "id",
        fleet.device_tone("connected", _LOSS()).alias("tone"),
        fleet.link_status("connected", _LOSS(), _LATENCY()).alias("link_status"),
        fleet.device_status("connected", _LOSS()).alias("device_status"),
    )


@query(
    "link_recommendation",
    """
SELECT id, CASE WHEN NOT connected THEN 'Restart stream and verify source link' WHEN loss > 2 THEN 'Inspect quality gate and packet path'
    WHEN NOT isnan(latency) AND latency > 50 THEN 'Review network route and queueing' ELSE 'Healthy' END AS recommendation,
  CASE WHEN NOT connected THEN 'Restart stream / check link' WHEN loss > 2 THEN 'QoS / MPLS reclass'
    WHEN NOT isnan(latency) AND latency > 50 THEN 'Check path delay' WHEN jitter > 10 THEN 'Check jitter source' ELSE 'Healthy' END AS table_recommendation
FROM live_stats
""",
)
def _(spark, sf):
    advice = fleet.link_advice("connected", _LOSS(), _LATENCY(), "jitter")
    return live_stats(spark, sf).select("id", *(c.alias(n) for n, c in advice.items()))


GROUPS = {"frame_gap": "idle", "parse": "process", "align_wait": "process", "dashboard_record": "dashboard", "e2e_recv_to_dashboard": "e2e"}


@query(
    "hop_tone",
    """
SELECT pmu_id, seq, stage, CASE WHEN ms <= 0 OR stage = 'frame_gap' THEN 'ok'
  WHEN stage IN ('dashboard_record', 'e2e_recv_to_dashboard') THEN CASE WHEN ms > 150 THEN 'bad' WHEN ms > 50 THEN 'warn' ELSE 'ok' END
  ELSE CASE WHEN ms > 50 THEN 'bad' WHEN ms > 20 THEN 'warn' ELSE 'ok' END END AS tone
FROM (SELECT * REPLACE (ms * 8 AS ms) FROM hop_samples)
""",
)
def _(spark, sf):
    group = F.coalesce(*(F.when(F.col("stage") == k, F.lit(g)) for k, g in GROUPS.items()))
    return v.hop_samples(spark, sf).select("pmu_id", "seq", "stage", fleet.hop_tone(F.col("ms") * 8, group).alias("tone"))


# --- keys and layouts ----------------------------------------------------------------


@query("timestamp_key", "SELECT event_id, epoch_us(ts) AS meas_us FROM events WHERE ts IS NOT NULL AND epoch_us(ts) <> 0")
def _(spark, sf):
    return (
        v.table(spark, sf, "events")
        .select("event_id", v.micros("ts").alias("meas_us"))
        .filter(F.col("meas_us").isNotNull() & (F.col("meas_us") != 0))
    )


@query(
    "tick_period_us",
    """
SELECT CAST(CASE WHEN m >= 1 THEN greatest(floor(1e6 / m + 0.5), 1) ELSE 50000 END AS BIGINT) AS period_us
FROM (SELECT max(CASE WHEN data_rate > 0 THEN data_rate WHEN data_rate < 0 THEN 1.0::DOUBLE / -data_rate ELSE 0 END) AS m FROM cfg_profile)
""",
)
def _(spark, sf):
    return align.tick_period_us(v.cfg_profile(spark, sf))


CHANNELS_JSON = '["VA","VB","VC","IA","Analog1","Analog2",' + ",".join(f'"D{i}"' for i in range(16)) + "]"
sql_view(
    "hashed_layouts",
    f"""
SELECT pmu_id, version, received_us, data_rate, station, sha256('{{"station":"' || station || '","idcode":' || (CAST(substr(station, 5) AS INTEGER) + 1)
  || ',"time_base":1000000,"format":1,"phnmr":4,"annmr":2,"dgnmr":1,"fnom":50,"data_rate":' || data_rate
  || ',"channels":{CHANNELS_JSON}}}') AS layout_hash FROM cfg_profile
""",
)


def hashed_layouts(spark, sf):
    layouts = v.cfg_profile(spark, sf)
    return layouts.withColumn("layout_hash", layout.layout_hash(layouts))


@query("layout_hash", "SELECT pmu_id, version, layout_hash FROM hashed_layouts")
def _(spark, sf):
    return hashed_layouts(spark, sf).select("pmu_id", "version", "layout_hash")


@query(
    "channels_json",
    f"""
SELECT pmu_id, version, '{{"annmr":2,"an_float":false,"channels":{CHANNELS_JSON},"dgnmr":1,"fnom_hz":50,"freq_float":false,"ph_float":false,"phnmr":4,"polar":true}}' AS channels
FROM cfg_profile
""",
)
def _(spark, sf):
    return v.cfg_profile(spark, sf).select("pmu_id", "version", layout.channels_json().alias("channels"))


@query(
    "payload_size",
    """
SELECT pmu_id, version, fmt, CAST(2 + 4 * (CASE WHEN fmt & 2 > 0 THEN 8 ELSE 4 END) + (CASE WHEN fmt & 8 > 0 THEN 8 ELSE 4 END)
  + 2 * (CASE WHEN fmt & 4 > 0 THEN 4 ELSE 2 END) + 2 AS INTEGER) AS bytes
FROM (SELECT pmu_id, version, unnest(range(16)) AS fmt FROM cfg_profile)
""",
)
def _(spark, sf):
    each = v.cfg_profile(spark, sf).withColumn("fmt", F.explode(F.sequence(F.lit(0), F.lit(15)))).withColumn("fmt", F.col("fmt").cast("bigint"))
    return each.select("pmu_id", "version", "fmt", layout.payload_bytes("fmt", "phnmr", "annmr", "dgnmr").alias("bytes"))


@query(
    "unit_words",
    f"""
SELECT event_id, CAST(w >> 24 AS INTEGER) AS unit_type, {r6('(w & 16777215) * 0.00001::DOUBLE')} AS factor,
  CAST(w >> 16 AS INTEGER) AS normal_mask, CAST(w & 65535 AS INTEGER) AS valid_mask
FROM (SELECT event_id, (event_id * 2654435761) % 4294967296 AS w FROM events)
""",
)
def _(spark, sf):
    w = F.col("w")
    normal, valid = layout.digital_masks(w)
    words = v.table(spark, sf, "events").select("event_id", (F.col("event_id") * 2654435761 % 4294967296).alias("w"))
    return words.select(
        "event_id",
        layout.unit_type(w).alias("unit_type"),
        d6(layout.unit_factor(w)).alias("factor"),
        normal.alias("normal_mask"),
        valid.alias("valid_mask"),
    )


@query(
    "stat_bits",
    """
SELECT event_id, CAST((w >> 14) & 3 AS INTEGER) AS data_error_code, (w >> 14) & 3 <> 0 AS data_error, (w >> 13) & 1 = 1 AS cfg_change,
  (w >> 12) & 1 = 1 AS trigger, (w >> 11) & 1 = 1 AS sort_by_arrival, (w >> 10) & 1 = 1 AS sync_unlocked,
  CAST((w >> 6) & 15 AS INTEGER) AS pmu_time_quality, CAST((w >> 4) & 3 AS INTEGER) AS unlocked_duration, CAST(w & 15 AS INTEGER) AS trigger_reason
FROM (SELECT event_id, (event_id * 40503) % 65536 AS w FROM events)
""",
)
def _(spark, sf):
    words = v.table(spark, sf, "events").select("event_id", (F.col("event_id") * 40503 % 65536).alias("w"))
    return words.select("event_id", *(c.alias(n) for n, c in bits.stat_fields("w").items()))


@query(
    "time_quality_bits",
    """
SELECT event_id, CAST(b AS INTEGER) AS msg_tq_raw, (b >> 7) & 1 = 1 AS tq_reserved, (b >> 6) & 1 = 1 AS leap_second_direction,
  (b >> 5) & 1 = 1 AS leap_second_occurred, (b >> 4) & 1 = 1 AS leap_second_pending, CAST(b & 15 AS INTEGER) AS time_quality_code
FROM (SELECT event_id, ((event_id * 2654435761) % 4294967296) >> 24 AS b FROM events)
""",
)
def _(spark, sf):
    words = v.table(spark, sf, "events").select("event_id", (F.col("event_id") * 2654435761 % 4294967296).alias("w"))
    return words.select("event_id", *(c.alias(n) for n, c in bits.time_quality_fields("w").items()))


@query(
    "frame_timestamp",
    """
SELECT event_id, soc * 1000000 + (frac % 16777216) * 1000000 // (CASE WHEN tb % 16777216 = 0 THEN 1000000 ELSE tb % 16777216 END) AS time_us
FROM (SELECT event_id, epoch_us(ts) // 1000000 AS soc, (event_id * 40503) % 1000000 + 16777216 * (event_id % 200) AS frac,
  ([1000000, 16777216, 0, 83886080 + 1048576])[event_id % 4 + 1] AS tb FROM events)
""",
)
def _(spark, sf):
    e = F.col("event_id")
    tb = F.element_at(F.array(*(F.lit(x).cast("bigint") for x in (1_000_000, 16_777_216, 0, 83_886_080 + 1_048_576))), (e % 4 + 1).cast("int"))
    words = v.table(spark, sf, "events").select(
        "event_id",
        F.floor(v.micros("ts") / 1_000_000).alias("soc"),
        (e * 40503 % 1_000_000 + 16_777_216 * (e % 200)).alias("frac"),
        tb.alias("tb"),
    )
    return words.select("event_id", bits.frame_time_us("soc", "frac", "tb").alias("time_us"))


@query(
    "digital_bits",
    """
SELECT arrival_seq, CAST(b AS INTEGER) AS bit, CASE WHEN b < 3 THEN 'SW' || b ELSE 'bit' || b END AS name, (digital >> b) & 1 = 1 AS is_set
FROM (SELECT arrival_seq, digital, unnest(range(16)) AS b FROM frames)
""",
)
def _(spark, sf):
    from tickweave.operators.decode import digital_bits

    named = v.frames(spark, sf).withColumn("digital_names", F.array(*(F.lit(f"SW{i}") for i in range(3)), F.lit("")))
    return digital_bits(named).select("arrival_seq", "bit", "name", "is_set")


@query(
    "channel_names",
    """
SELECT pmu_id, version, 'VA VB PH3 IA' AS phasors, 'Analog1 ANA2' AS analogs,
  'D0 D1 D2 D3 D4 D5 D6 D7 D8 D9 D10 D11 D12 D13 D14 D15' AS digitals FROM cfg_profile
""",
)
def _(spark, sf):
    blanked = F.transform("channels", lambda c: F.when(c.isin("VC", "Analog2"), "").otherwise(c))
    groups = layout.channel_groups(blanked, "phnmr", "annmr")
    return v.cfg_profile(spark, sf).select(
        "pmu_id", "version", *(F.array_join(c, " ").alias(n.replace("_names", "s")) for n, c in groups.items())
    )
