"""Per-device rates, loss, latency and status as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: thresholds of the fleet views ---
MIN_TRUSTED_FPS = 5
FPS_TOLERANCE = 3
FPS_TOLERANCE_SHARE = 0.05
OFFLINE_LATENCY_MS = 999.0
UNMEASURED_LATENCY_MS = 900.0
OFFLINE_JITTER = 99.0
UNKNOWN_JITTER = 2.0
MAX_HOP_MS = 10_000.0


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def js_round(x) -> Column:
    return F.floor(_col(x) + 0.5).cast("double")


def cfg_rate_fps(rate) -> Column:
    """Frames per second of a configured rate; negative rates are seconds per frame."""
    rate = _col(rate)
    return (
        F.when(rate > 0, rate.cast("double"))
        .when(rate < 0, F.try_divide(F.lit(1.0), -rate.cast("double")))
        .otherwise(F.lit(0.0))
    )


def snap_fps(measured, configured) -> Column:
    """The configured rate when the measured one is within its tolerance."""
    m, c = _col(measured).cast("double"), _col(configured).cast("double")
    tolerance = F.greatest(F.lit(float(FPS_TOLERANCE)), c * FPS_TOLERANCE_SHARE)
    usable = (c > 0) & (m > 0) & ~F.isnan(m)
    return F.when(usable & (F.abs(m - c) <= tolerance), c).otherwise(m)


def hop_value(ms) -> Column:
    """A hop sample charts may use: finite, not negative, under ten seconds."""
    ms = _col(ms)
    return F.when(~F.isnan(ms) & (ms >= 0) & (ms < MAX_HOP_MS), ms)


def effective_fps(approx_fps, frame_gap_ms) -> Column:
    approx = F.coalesce(_col(approx_fps).cast("double"), F.lit(0.0))
    gap = hop_value(frame_gap_ms)
    from_gap = F.when((gap > 1) & (gap < 500), F.try_divide(F.lit(1000.0), gap))
    return F.when(approx >= MIN_TRUSTED_FPS, approx).otherwise(F.coalesce(from_gap, approx))


def snap_synchro_rate(live) -> Column:
    live = _col(live)
    return (
        F.when(live >= 100, F.lit(120.0))
        .when(live >= 45, F.lit(60.0))
        .when(live >= 20, F.lit(30.0))
        .when(live >= 8, F.lit(10.0))
        .otherwise(F.greatest(F.lit(1.0), js_round(live)))
    )


def target_fps(live, configured) -> Column:
    """Rate a device is held to: configured, unless it steadily sends far less."""
    live, cfg = _col(live), _col(configured)
    return (
        F.when((live >= 8) & (cfg > 0) & (live < cfg * 0.55), snap_synchro_rate(live))
        .when(cfg > 0, cfg)
        .when(live > 1, snap_synchro_rate(live))
        .otherwise(F.lit(60.0))
    )


def display_fps(connected, live, configured) -> Column:
    return F.when(_col(connected), snap_fps(live, configured)).otherwise(_col(live))


def availability_pct(connected, live, configured) -> Column:
    shown = display_fps(connected, live, configured)
    ratio = shown / F.greatest(F.lit(1.0), target_fps(live, configured))
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), js_round(ratio * 1000) / 10))
    return (
        F.when(~_col(connected), F.lit(0.0))
        .when(F.isnan(shown) | (shown <= 0) | (ratio >= 0.7), F.lit(100.0))
        .otherwise(clamped)
    )


def loss_pct(rejects, total) -> Column:
    share = F.try_divide(_col(rejects).cast("double"), _col(total).cast("double")) * 100
    return F.when(_col(total) > 0, share).otherwise(F.lit(0.0))


def latency_ms(connected, e2e_ms) -> Column:
    """End-to-end hop; 999 when offline; NaN when connected but not measured."""
    e2e = _col(e2e_ms)
    return (
        F.when(~F.isnan(e2e) & (e2e >= 0), e2e)
        .when(~_col(connected), F.lit(OFFLINE_LATENCY_MS))
        .otherwise(F.lit(float("nan")))
    )


def cycle_latency(connected, frame_gap_ms, parse_ms, e2e_ms, approx_fps) -> Column:
    """STRUCT of one sample cycle, NULL when it cannot be told."""
    approx = _col(approx_fps).cast("double")
    wait = F.coalesce(hop_value(frame_gap_ms), F.when(approx > 1, F.try_divide(F.lit(1000.0), approx)))
    parse = F.coalesce(hop_value(parse_ms), F.lit(0.0))
    pipeline = F.coalesce(hop_value(e2e_ms), latency_ms(connected, e2e_ms))
    known = _col(connected) & wait.isNotNull() & ~F.isnan(pipeline) & (pipeline < UNMEASURED_LATENCY_MS)
    hint = F.when(wait > 0, F.try_divide(F.lit(1000.0), wait)).otherwise(F.coalesce(approx, F.lit(0.0)))
    return F.when(
        known,
        F.struct(
            wait.alias("pmu_wait"),
            parse.alias("parse"),
            pipeline.alias("pipeline"),
            F.greatest(F.lit(0.0), pipeline - parse).alias("pipeline_rest"),
            (wait + pipeline).alias("total"),
            hint.alias("fps_hint"),
        ),
    )


def liveness_timeout_us(rate) -> Column:
    """Silence that ends a session: three frame periods, between 1 and 30 seconds."""
    fps = F.when(_col(rate) == 0, F.lit(20.0)).otherwise(cfg_rate_fps(rate))
    fps = F.greatest(F.coalesce(fps, F.lit(20.0)), F.lit(0.05))
    period = F.floor(F.lit(1e6) / fps)
    return F.least(F.greatest(period * 3, F.lit(1_000_000)), F.lit(30_000_000)).cast("bigint")


def device_tone(connected, loss) -> Column:
    return F.when(~_col(connected), "bad").when(_col(loss) > 1, "warn").otherwise("ok")


def link_status(connected, loss, latency) -> Column:
    slow = ~F.isnan(_col(latency)) & (_col(latency) > 50)
    return F.when(~_col(connected), "Offline").when((_col(loss) > 1.5) | slow, "Degraded").otherwise("Healthy")


def device_status(connected, loss) -> Column:
    """As :func:`link_status`, without looking at latency."""
    return F.when(~_col(connected), "Offline").when(_col(loss) > 1.5, "Degraded").otherwise("Healthy")


# --- fixed values: advice texts ---
TABLE_ADVICE = ["Restart stream / check link", "QoS / MPLS reclass", "Check path delay", "Check jitter source"]
LINK_ADVICE = [
    "Restart stream and verify source link",
    "Inspect quality gate and packet path",
    "Review network route and queueing",
]
NO_ADVICE = "Healthy"


def link_advice(connected, loss, latency, jitter) -> dict[str, Column]:
    slow = ~F.isnan(_col(latency)) & (_col(latency) > 50)
    tests = [~_col(connected), _col(loss) > 2, slow, _col(jitter) > 10]

    def first_of(texts: list[str]) -> Column:
        return F.coalesce(*(F.when(t, F.lit(x)) for t, x in zip(tests, texts)), F.lit(NO_ADVICE))

    return {"recommendation": first_of(LINK_ADVICE), "table_recommendation": first_of(TABLE_ADVICE)}


# --- fixed values: (warn above, bad above) in milliseconds per stage group ---
TONE_LIMITS = {"connection": (500, 2000), "e2e": (50, 150), "dashboard": (50, 150)}
OTHER_TONE_LIMIT = (20, 50)


def hop_tone(ms, group) -> Column:
    ms, group = _col(ms), _col(group)

    def graded(warn: int, bad: int) -> Column:
        return F.when(ms > bad, "bad").when(ms > warn, "warn").otherwise("ok")

    out = F.when(F.isnan(ms) | (ms <= 0) | (group == "idle"), "ok")
    for name, limits in TONE_LIMITS.items():
        out = out.when(group == name, graded(*limits))
    return out.otherwise(graded(*OTHER_TONE_LIMIT))


# --- fixed values: words that classify an event ---
ERROR_WORDS = ["error", "reject", "fail"]
WARN_WORDS = ["warn"]
SHOWN_STAGES = ["startup", "manager", "connection", "connect", "handshake"]
QUIET_STAGES = ["stream", "summary", "parse", "quality"]


def _mentions(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for word in words:
        out = out | text.contains(word)
    return out


def event_severity(status) -> Column:
    s = F.lower(_col(status))
    return F.when(_mentions(s, ERROR_WORDS), "ERROR").when(_mentions(s, WARN_WORDS), "WARN").otherwise("INFO")


def is_errorish(status) -> Column:
    return _mentions(F.lower(_col(status)), ERROR_WORDS + WARN_WORDS)


def is_ui_worthy(stage, status) -> Column:
    st, s = F.lower(F.trim(_col(stage))), F.lower(_col(status))
    return (
        F.when(is_errorish(status), True)
        .when(st.isin(SHOWN_STAGES), True)
        .when(st.isin(QUIET_STAGES), False)
        .otherwise(~s.isin("ok", "info"))
    )


def alert_severity(status, message) -> Column:
    text = F.lower(F.concat_ws(" ", _col(status), _col(message)))
    return F.when(text.contains("error"), "bad").when(_mentions(text, ["warn", "reject"]), "warn").otherwise("info")
