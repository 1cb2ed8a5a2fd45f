"""Per-device ordered views: gaps, jumps, edges, sessions, last-N, feeds and charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions import fleet
from tickweave.functions.registry import device_slug
from tickweave.operators.chunked import ARRIVALS, HOUR_US, forward_fill, islands, newest, ordinal, with_previous

# --- fixed values: limits of buffers, feeds and charts ---
JUMP_FORWARD_MS = 100
JUMP_BACKWARD_MS = -10
DEFAULT_CAPACITY, MIN_CAPACITY = 200, 1
RECENT_EVENTS = 200
EXPORTED_TICKS = 120
# arrivals that one task numbers
NUMBERED_TOGETHER = 1_000_000
CHART_POLLS = 60
CHART_STREAMS = 25


def frame_gap(frames: DataFrame) -> DataFrame:
    """Milliseconds since the device's frame before, NULL on its first."""
    seen = with_previous(frames, ["pmu_id"], ["arrival_seq"], ["received_us"], ARRIVALS)
    return seen.withColumn("frame_gap_ms", (F.col("received_us") - F.col("prev_received_us")) / 1000.0).drop(
        "prev_received_us", "prev_seen"
    )


def stamp_jumps(frames: DataFrame) -> DataFrame:
    """Per device: stamps that leap forward or step back against the arrival before."""
    rows = frames.select("pmu_id", "arrival_seq", "meas_us")
    seen = with_previous(rows, ["pmu_id"], ["arrival_seq"], ["meas_us"], ARRIVALS)
    gap = (F.col("meas_us") - F.col("prev_meas_us")) / 1000.0
    jumps = seen.withColumn("gap_ms", gap).filter(
        (F.col("gap_ms") > JUMP_FORWARD_MS) | (F.col("gap_ms") < JUMP_BACKWARD_MS)
    )
    last = F.struct("gap_ms", "prev_meas_us", "meas_us")
    return (
        jumps.groupBy("pmu_id")
        .agg(
            F.count(F.lit(1)).alias("jumps"),
            F.greatest(F.max("gap_ms"), F.lit(0.0)).alias("max_gap_ms"),
            F.max_by(last, "arrival_seq").alias("last"),
        )
        .select(
            "pmu_id",
            "jumps",
            "max_gap_ms",
            F.col("last.gap_ms").alias("last_gap_ms"),
            F.col("last.prev_meas_us").alias("last_from_us"),
            F.col("last.meas_us").alias("last_to_us"),
        )
    )


def capture_lag(frames: DataFrame) -> DataFrame:
    return frames.withColumn("lag_ms", (F.col("received_us") - F.col("meas_us")) / 1000.0)


def layout_changes(layouts: DataFrame, hash_col: str = "layout_hash") -> DataFrame:
    """``cfg_changed`` where a device's layout differs from its layout before."""
    seen = with_previous(layouts, ["pmu_id"], ["received_us"], [hash_col], 24 * HOUR_US)
    changed = F.col("prev_seen") & (F.col(hash_col) != F.col("prev_" + hash_col))
    return seen.filter(changed).select(
        "pmu_id", "received_us", F.lit("cfg_changed").alias("type"), hash_col, "prev_" + hash_col
    )


def live_sessions(frames: DataFrame, rates: DataFrame | None = None, width: int = HOUR_US) -> DataFrame:
    """Stretches in which a device never fell silent for longer than its liveness timeout.

    ``rates`` gives ``data_rate`` per device (one row each); without it the default
    rate applies. A session ends ``patience_us`` after its last frame.
    """
    if rates is None:
        timed = frames.withColumn("_patience", fleet.liveness_timeout_us(F.lit(0)))
    else:
        timed = frames.join(rates.select("pmu_id", F.col("data_rate").alias("_rate")), "pmu_id", "left").withColumn(
            "_patience", fleet.liveness_timeout_us(F.coalesce("_rate", F.lit(0)))
        )
    runs = islands(timed, ["pmu_id"], "received_us", "_patience", width)
    return runs.select(
        "pmu_id",
        F.col("run").alias("session"),
        F.col("first_us").alias("became_live_us"),
        "last_us",
        (F.col("last_us") + F.col("patience_us")).alias("left_live_us"),
        F.col("n").alias("frames"),
    )


def session_events(sessions: DataFrame) -> DataFrame:
    """``became_live`` and ``left_live`` rows of sessions."""
    pair = F.array(
        F.struct(F.lit("became_live").alias("type"), F.col("became_live_us").alias("time_us")),
        F.struct(F.lit("left_live").alias("type"), F.col("left_live_us").alias("time_us")),
    )
    return sessions.select("pmu_id", F.explode(pair).alias("e")).select("pmu_id", "e.type", "e.time_us")


def lifecycle_events(actions: DataFrame) -> DataFrame:
    """Operator actions as events; a stop also takes the device off the live set."""
    types = F.when(F.col("action") == "stop", F.array(F.lit("operator_stop"), F.lit("left_live"))).when(
        F.col("action") == "start", F.array(F.lit("operator_start"))
    )
    return actions.select("*", F.posexplode(types).alias("step", "type"))


def at_least_one(n: int) -> int:
    return max(MIN_CAPACITY, n)


def last_n_per_device(deduped: DataFrame, capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """The newest ``capacity`` distinct stamps of each device."""
    return newest(deduped, ["pmu_id"], ["meas_us"], at_least_one(capacity))


def buffer_snapshot(frames: DataFrame, capacity: int = DEFAULT_CAPACITY) -> DataFrame:
    """Per device: how many of its last arrivals are held and the stamps they span.

    ``slots`` keeps the stamps in arrival order; at most ``capacity`` per device.
    """
    held = newest(frames, ["pmu_id"], ["arrival_seq"], at_least_one(capacity))
    per = held.groupBy("pmu_id").agg(
        F.count(F.lit(1)).alias("held"),
        F.floor(F.min("meas_us") / 1000).alias("oldest_ms"),
        F.floor(F.max("meas_us") / 1000).alias("newest_ms"),
        F.transform(
            F.array_sort(F.collect_list(F.struct("arrival_seq", "meas_us"))), lambda s: s["meas_us"]
        ).alias("slots"),
    )
    return per.withColumn("candidate_ms", per.agg(F.min("oldest_ms")).scalar())


def last_n_ticks(ticks: DataFrame, n: int = EXPORTED_TICKS) -> DataFrame:
    """The last ``n`` ticks."""
    return ticks.orderBy(F.desc("tick_us")).limit(n)


def with_newest_ticks(points: DataFrame, n: int) -> DataFrame:
    """Rows of the last ``n`` distinct ticks."""
    last = points.select("tick_us").distinct().orderBy(F.desc("tick_us")).limit(n)
    return points.filter(F.col("tick_us") >= last.agg(F.min("tick_us")).scalar())


def recent_events(events: DataFrame, n: int = RECENT_EVENTS) -> DataFrame:
    """The last ``n`` events worth showing, newest first."""
    return events.filter(fleet.is_ui_worthy("stage", "status")).orderBy(F.desc("seq")).limit(n)


def last_errors(events: DataFrame) -> DataFrame:
    """Last error-like message per device."""
    return (
        events.filter(fleet.is_errorish("status"))
        .groupBy("pmu_id")
        .agg(F.max_by("message", "seq").alias("last_error"), F.max("time_us").alias("last_error_us"))
    )


def frame_filter_tail(frames: DataFrame, n: int, pmu: str | None = None) -> DataFrame:
    """The last ``n`` arrivals, or all of them if ``n`` is not positive, of one device if named, numbered from 1 with the newest last."""
    src = frames.filter(F.col("pmu_id") == pmu.strip()) if pmu and pmu.strip() else frames
    tail = src.orderBy(F.desc("arrival_seq")).limit(n) if n > 0 else src
    return ordinal(tail, ["arrival_seq"], NUMBERED_TOGETHER, "index")


def capture_status(frames: DataFrame, limit: int = 1500) -> DataFrame:
    """How many of the last ``limit`` arrivals each device holds, beside the total."""
    tape = frames.select("pmu_id", "arrival_seq").orderBy(F.desc("arrival_seq")).limit(limit)
    per = tape.groupBy("pmu_id").agg(F.count(F.lit(1)).alias("buffered"))
    return per.withColumn("buffered_total", per.agg(F.sum("buffered")).scalar())


def ffill_latency(polls: DataFrame, streams: DataFrame, window: int = CHART_POLLS) -> DataFrame:
    """Latency chart rows: the measured value, else the value of the poll before.

    ``polls`` has one row per (poll, device) with ``connected`` and ``latency_ms``;
    ``streams`` the charted devices. Polls where nothing is known yet are left out.
    """
    ms = F.col("latency_ms")
    usable = F.col("connected") & ~F.isnan(ms) & (ms >= 0) & (ms < fleet.UNMEASURED_LATENCY_MS)
    shown = polls.join(streams.select("pmu_id"), "pmu_id", "left_semi").withColumn("measured", F.when(usable, ms))
    held = forward_fill(shown, ["pmu_id"], ["poll_us"], "measured", 24 * HOUR_US, "value")
    known = held.filter(F.col("value").isNotNull())
    last = known.select("poll_us").distinct().orderBy(F.desc("poll_us")).limit(window)
    return known.filter(F.col("poll_us") >= last.agg(F.min("poll_us")).scalar()).select("poll_us", "pmu_id", "value")


def charted_streams(rows: DataFrame, limit: int = CHART_STREAMS) -> DataFrame:
    """Connected devices by name, the first ``limit`` of them."""
    return (
        rows.filter("connected")
        .orderBy("name")
        .limit(limit)
        .select(F.col("name").alias("pmu_id"), device_slug("name").alias("key"), "latency")
    )


def rolling_history(polls: DataFrame, window: int = CHART_POLLS) -> DataFrame:
    """The last ``window`` polls of a per-poll table."""
    return polls.orderBy(F.desc("poll_us")).limit(window)


def cfg_change_requests(flags: DataFrame, layouts: DataFrame, grace_us: int = 2_000_000) -> DataFrame:
    """When a layout is asked for: a change flag has stood ``grace_us`` without a new layout.

    ``flags``: (pmu_id, received_us) of frames with the change bit; ``layouts``:
    (pmu_id, received_us). A flag belongs to the stretch after the last layout before it;
    the first flag of a stretch starts the clock, a new layout ends it.
    """
    epochs = layouts.select("pmu_id", F.col("received_us").alias("layout_us")).distinct()
    marked = flags.select("pmu_id", "received_us", F.lit(None).cast("bigint").alias("layout_us")).unionByName(
        epochs.select("pmu_id", F.col("layout_us").alias("received_us"), "layout_us")
    ).withColumn("is_flag", F.col("layout_us").isNull())
    order = ["received_us", "is_flag"]
    since = forward_fill(marked, ["pmu_id"], order, "layout_us", HOUR_US, "epoch_us")
    started = (
        since.filter("is_flag")
        .groupBy("pmu_id", F.coalesce("epoch_us", F.lit(-1)).alias("epoch_us"))
        .agg(F.min("received_us").alias("flag_us"), F.count(F.lit(1)).alias("flagged"))
    )
    upcoming = epochs.withColumn("next_us", F.lead("layout_us").over(W.partitionBy("pmu_id").orderBy("layout_us")))
    before_any = epochs.groupBy("pmu_id").agg(F.min("layout_us").alias("next_us")).withColumn("layout_us", F.lit(-1))
    ends = upcoming.unionByName(before_any).withColumnRenamed("layout_us", "epoch_us")
    return (
        started.join(ends, ["pmu_id", "epoch_us"], "left")
        .withColumn("request_us", F.col("flag_us") + grace_us)
        .withColumn("requested", F.col("next_us").isNull() | (F.col("next_us") > F.col("request_us")))
        .select("pmu_id", "flag_us", "flagged", "next_us", F.when(F.col("requested"), F.col("request_us")).alias("request_us"))
    )


def distinct_channel_names(named: DataFrame, names: Column) -> DataFrame:
    """Distinct non-blank names out of an array column, sorted."""
    return named.select(F.explode(names).alias("name")).filter("name <> ''").distinct().orderBy("name")
