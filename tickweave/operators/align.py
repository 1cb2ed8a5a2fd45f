"""Time alignment: many devices onto one grid of ticks, nearest sample per device.

The live publisher walks the grid tick by tick and removes samples it has used. Over a
table the same result has a closed form, so nothing here loops over ticks:

* with period ``P`` and ``H = P div 2`` a sample strictly inside a window belongs to the
  one tick nearest to it, ``floor((ts + H) / P) * P``;
* only with an even ``P`` can a sample sit exactly on the border of two windows. It goes
  to the lower tick unless that tick has an inner sample, or is taken by the border
  sample one period earlier; then it may serve the upper tick. Border samples one period
  apart with nothing inside between them form a run and share the fate of its first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.functions import fleet

# --- fixed values: grid period when no rate is known, and the "this is milliseconds" bound ---
DEFAULT_PERIOD_US = 50_000
MS_BOUND = 1000

TICKS_PER_CHUNK = 1 << 16


def normalize_period_us(period: int) -> int:
    if period < 1:
        return DEFAULT_PERIOD_US
    return period * 1000 if period < MS_BOUND else period


def tick_period_us(layouts: DataFrame, expected: DataFrame | None = None, fallback: int = DEFAULT_PERIOD_US) -> DataFrame:
    """One row ``period_us``: a tick per frame of the fastest expected device."""
    rates = layouts if expected is None else layouts.join(expected.select("pmu_id").distinct(), "pmu_id", "left_semi")
    best = F.max(fleet.cfg_rate_fps("data_rate"))
    period = F.greatest(fleet.js_round(F.try_divide(F.lit(1e6), best)).cast("bigint"), F.lit(1))
    return rates.agg(
        F.when(best >= 1, period).otherwise(F.lit(normalize_period_us(fallback))).cast("bigint").alias("period_us")
    )


def dedupe_latest(readings: DataFrame) -> DataFrame:
    """One row per (device, stamp): the last arrival."""
    w = W.partitionBy("pmu_id", "meas_us").orderBy(F.desc("arrival_seq"))
    return readings.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def expected_filter(readings: DataFrame, expected: DataFrame) -> DataFrame:
    return readings.join(expected.select("pmu_id").distinct(), "pmu_id", "left_semi")


def device_bounds(readings: DataFrame, expected: DataFrame) -> DataFrame:
    """Oldest and newest stamp per expected device (NULL for one without samples)."""
    seen = readings.groupBy("pmu_id").agg(
        F.min("meas_us").alias("oldest_us"), F.max("meas_us").alias("newest_us"), F.count(F.lit(1)).alias("samples")
    )
    return expected.select("pmu_id").distinct().join(seen, "pmu_id", "left")


def fleet_bounds(bounds: DataFrame) -> DataFrame:
    """One row: oldest, newest, and the frontier, NULL while an expected device has nothing."""
    all_in = F.count(F.lit(1)) == F.count("newest_us")
    return bounds.agg(
        F.min("oldest_us").alias("min_oldest_us"),
        F.max("newest_us").alias("max_newest_us"),
        F.when(all_in, F.min("newest_us")).alias("min_newest_us"),
    )


def _floor_to(ts: Column, period: int) -> Column:
    return ts - F.pmod(ts, F.lit(period))


def _nearest_inside(rows: DataFrame) -> DataFrame:
    w = W.partitionBy("pmu_id", "tick_us").orderBy(
        F.abs(F.col("meas_us") - F.col("tick_us")), "meas_us", F.desc("arrival_seq")
    )
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def nearest_tick(readings: DataFrame, period_us: int) -> DataFrame:
    """Give each (device, tick) its nearest sample; adds ``tick_us``, a sample is used once.

    Several arrivals with one stamp count as one sample, the last arrival. Rows are
    shuffled once: by (device, tick) for an odd period, by (device, stretch of ticks) for
    an even one, whose border samples also look at the tick below.
    """
    half = period_us // 2
    rows = readings.withColumn("tick_us", _floor_to(F.col("meas_us") + half, period_us))
    return _nearest_inside(rows) if period_us % 2 else _nearest_with_borders(rows, period_us)


# one number for what makes a sample the nearest of its tick: twice the distance, one more after the tick; then the last arrival
_NEARER = (
    "CAST(abs(meas_us - tick_us) * 2 + IF(meas_us > tick_us, 1, 0) AS DECIMAL(19,0)) * 9223372036854775808BD"
    " + CAST(9223372036854775807 - arrival_seq AS DECIMAL(19,0))"
)


def _nearest_with_borders(rows: DataFrame, period_us: int) -> DataFrame:
    """The even period; every row carries its upper tick as ``tick_us``.

    Rows are reduced where they are read: of each tick at most an inner and a border sample go on, however many rows there are.
    Every column is picked by an aggregate of its own over one fixed-width number, so columns that nobody asks for aren't
    carried, and fixed-width ones are reduced by hash.
    """
    c, part = F.col, ["pmu_id", "_chunk"]
    span = period_us * TICKS_PER_CHUNK
    chunk = F.floor(c("tick_us") / span).cast("bigint")
    kept = rows.withColumn("_border", c("tick_us") - c("meas_us") == period_us // 2).withColumn("_n", F.expr(_NEARER))
    own = [f for f in rows.schema.fields if f.name not in ("pmu_id", "tick_us")]
    fixed = [f.name for f in own if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.TimestampType, T.DateType))]
    wide = [f.name for f in own if f.name not in fixed]
    picked = [F.min_by(n, "_n").alias(n) for n in fixed] + ([F.min_by(F.struct(*wide), "_n").alias("_wide")] if wide else [])
    nearest = kept.groupBy("pmu_id", "tick_us", "_border").agg(*picked)
    nearest = nearest.select("pmu_id", "tick_us", "_border", *fixed, *(F.col("_wide").getField(n).alias(n) for n in wide))
    # the last tick of a stretch is also shown to the next one
    shown = F.when(c("tick_us") == (chunk + 1) * span - period_us, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    best = nearest.select("*", F.explode(shown).alias("_guest")).withColumn("_chunk", chunk + c("_guest"))
    # a tick has at most an inner and a border row, so what a border row needs to know of its
    # own tick and the one below is among the three rows before it
    ticks = W.partitionBy(*part).orderBy("tick_us", "_border")
    near = [F.lag(F.struct("tick_us", "_border"), k).over(ticks).alias(f"_n{k}") for k in (1, 2, 3)]
    no = F.lit(False)

    def seen(steps: int, border: bool) -> Column:
        at = c("tick_us") - steps * period_us
        hits = [(c(f"_n{k}.tick_us") == at) & (c(f"_n{k}._border") == border) for k in (1, 2, 3)]
        return F.coalesce(hits[0], no) | F.coalesce(hits[1], no) | F.coalesce(hits[2], no)

    linked = best.select("*", *near).withColumns(
        {"_inner_up": seen(0, False), "_inner_low": seen(1, False), "_border_low": seen(1, True)}
    )
    # NULL inside a run of border samples: the fate of its first member is carried forward
    starts = c("_border") & (c("_guest") == 0) & (c("_inner_low") | ~c("_border_low"))
    own = F.last(F.when(starts, ~c("_inner_low")), ignorenulls=True)
    upto = ticks.rowsBetween(W.unboundedPreceding, W.currentRow)
    fated = linked.withColumn("_down", own.over(upto)).filter("_guest = 0")
    # runs that reach into a stretch get their fate from the stretches before it
    ends = fated.filter("_border").groupBy(*part).agg(F.max_by("_down", "tick_us").alias("_end"))
    before = W.partitionBy("pmu_id").orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    carried = ends.select(*part, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    down = F.when(c("_border"), F.coalesce("_down", "_carried")).otherwise(no)
    placed = fated.join(carried, part, "left").withColumn("_down", down).filter(c("_down") | ~c("_border") | ~c("_inner_up"))
    tick = F.when(c("_down"), c("tick_us") - period_us).otherwise(c("tick_us"))
    return placed.withColumn("tick_us", tick).select(rows.columns)


def exact_tick(readings: DataFrame, ticks: DataFrame) -> DataFrame:
    """Samples stamped exactly on a tick."""
    hit = readings.withColumn("tick_us", F.col("meas_us"))
    return dedupe_latest(hit.join(ticks.select("tick_us").distinct(), "tick_us", "left_semi"))


def align_points(readings: DataFrame, expected: DataFrame, period_us: int, flush: bool = False) -> DataFrame:
    """Aligned samples in long form: the rows of expected devices, with ``tick_us``.

    No tick beyond the frontier (the newest stamp of the slowest expected device) comes
    out, and none at all while an expected device has no sample; ``flush`` lifts this.
    """
    mine = expected_filter(readings, expected)
    points = nearest_tick(mine, normalize_period_us(period_us))
    if flush:
        return points
    frontier = fleet_bounds(device_bounds(mine, expected)).select("min_newest_us").scalar()
    return points.filter(F.col("tick_us") <= frontier)


def align_ticks(points: DataFrame, expected: DataFrame) -> DataFrame:
    """One row per tick with someone present: who is present, who is missing, the verdict."""
    everyone = expected.agg(F.array_sort(F.collect_set("pmu_id"))).scalar()
    return (
        points.groupBy("tick_us")
        .agg(F.array_sort(F.collect_set("pmu_id")).alias("present"))
        .withColumn("missing", F.array_except(everyone, F.col("present")))
        .withColumn("complete", F.size("missing") == 0)
        .withColumn("reason", F.when(F.col("complete"), "complete").otherwise("partial"))
    )


def missing_devices(ticks: DataFrame) -> DataFrame:
    return ticks.select("tick_us", F.explode("missing").alias("pmu_id"))


def aligner_status(ticks: DataFrame, expected: DataFrame, period_us: int) -> DataFrame:
    """One row of emit counters."""
    n = expected.select("pmu_id").distinct().agg(F.count(F.lit(1))).scalar()
    done = F.count_if("complete")
    return ticks.agg(
        F.count(F.lit(1)).alias("emitted"),
        done.alias("complete"),
        F.count_if(~F.col("complete")).alias("partial"),
        F.coalesce(F.try_divide(done * 100.0, F.count(F.lit(1))), F.lit(0.0)).alias("complete_pct"),
    ).select(
        n.alias("n"),
        F.lit(1e6 / period_us).alias("fps"),
        F.lit(period_us / 1000.0).alias("period_ms"),
        "*",
    )


# --- fixed values: the measures of one aligned point, in chart order ---
POINT_FIELDS = [
    "frequency", "frequency_dev", "rocof",
    "va", "vb", "vc", "ia", "ib", "ic",
    "va_angle", "vb_angle", "vc_angle", "ia_angle", "ib_angle", "ic_angle",
]


def point_measures(points: DataFrame) -> DataFrame:
    """Per (tick, device) the fifteen measures and the analog map, tick in milliseconds too."""
    c = F.col
    have = set(points.columns)
    fnom = F.coalesce(c("fnom").cast("double"), F.lit(0.0)) if "fnom" in have else F.lit(0.0)
    own_dev = c("freq_dev") if "freq_dev" in have else F.when(fnom > 0, c("freq") - fnom).otherwise(F.lit(0.0))

    def value(name: str) -> Column:
        return F.coalesce(c(name), F.lit(0.0)) if name in have else F.lit(0.0)

    analogs = c("analogs") if "analogs" in have else F.array().cast("array<double>")
    names = c("analog_names") if "analog_names" in have else F.transform(
        analogs, lambda _, i: F.concat(F.lit("Analog"), (i + 1).cast("string"))
    )
    return points.select(
        "tick_us",
        F.floor(c("tick_us") / 1000).alias("tick_ms"),
        "pmu_id",
        c("freq").alias("frequency"),
        own_dev.alias("frequency_dev"),
        value("rocof").alias("rocof"),
        *(value(f"{p}_mag").alias(p) for p in ("va", "vb", "vc", "ia", "ib", "ic")),
        *(value(f"{p}_deg").alias(f"{p}_angle") for p in ("va", "vb", "vc", "ia", "ib", "ic")),
        _last_named(names, analogs).alias("analogs"),
    )


def _last_named(names: Column, values: Column) -> Column:
    """Map of names to values: blank names are left out, of a repeated name the last value counts."""
    pairs = F.filter(F.arrays_zip(names.alias("name"), values.alias("value")), lambda p: F.trim(p["name"]) != "")
    later = lambda i: F.slice(F.transform(pairs, lambda p: p["name"]), i + 2, F.greatest(F.size(pairs), F.lit(1)))
    last = F.filter(pairs, lambda p, i: ~F.array_contains(later(i), p["name"]))
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["name"], p["value"])))


def points_map(measures: DataFrame, ticks: DataFrame) -> DataFrame:
    """Per tick the map device -> measures, beside who is missing."""
    packed = measures.groupBy("tick_us").agg(
        F.map_from_entries(F.collect_list(F.struct("pmu_id", F.struct(*POINT_FIELDS, "analogs")))).alias("points")
    )
    return packed.join(ticks.select("tick_us", "missing", "complete", "reason"), "tick_us")


def align_dwell(points: DataFrame, emitted_us: Column) -> DataFrame:
    """Milliseconds a sample waited for its tick, where under five minutes."""
    dwell = emitted_us - F.col("received_us")
    return points.select("tick_us", "pmu_id", (dwell / 1000.0).alias("dwell_ms")).filter(
        (dwell >= 0) & (dwell < 300_000_000)
    )


def align_dynamic_expected(readings: DataFrame, sessions: DataFrame, period_us: int) -> DataFrame:
    """Ticks against an expected set that changes: devices inside a live session.

    A session covers the grid ticks from the one of its first sample up to the one of its
    last. Each session lists its ticks, so the join is an equality on (tick, device) and
    a device that left is not missing afterwards.
    """
    period = normalize_period_us(period_us)
    points = nearest_tick(readings, period).select("tick_us", "pmu_id")
    half = period // 2
    first = _floor_to(F.col("became_live_us") + half, period)
    last = _floor_to(F.col("last_us") + half, period)
    on_duty = sessions.select(
        "pmu_id", F.explode(F.sequence(first, F.greatest(first, last), F.lit(period))).alias("tick_us")
    ).distinct()
    both = on_duty.join(points.withColumn("here", F.lit(True)), ["tick_us", "pmu_id"], "left")
    here = F.col("here").isNotNull()
    return (
        both.groupBy("tick_us")
        .agg(
            F.array_sort(F.collect_list(F.when(here, F.col("pmu_id")))).alias("present"),
            F.array_sort(F.collect_list(F.when(~here, F.col("pmu_id")))).alias("missing"),
        )
        .filter(F.size("present") > 0)
        .withColumn("complete", F.size("missing") == 0)
        .withColumn("reason", F.when(F.col("complete"), "complete").otherwise("partial"))
    )
