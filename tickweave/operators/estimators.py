"""Per-device running estimates whose next value depends on the last one.

Three of them cannot be written as window functions: the clock offset (smoothing that
restarts on a step), the frame rate (counting windows cut by their own length) and
thinning (keep a row once enough time has passed since the last kept one).

Each runs in three steps, so that no device is ever folded in one task:

1. every (key, chunk) is *summarised* in its own task: what would it do to any state it
   might be entered with? The summaries are small and exact;
2. the summaries of a key, one per chunk, are walked in order: the state each chunk is
   entered with;
3. every (key, chunk) is folded from its known entry state.

The ``*_step`` functions are the plain definitions, row by row. Streams use them as they
are; the tests hold the chunked form against them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.functions import fleet
from tickweave.operators.chunked import ARRIVALS, HOUR_US, chunk_of, newest, with_previous

# --- fixed values: clock model ---
MAX_OFFSET_US = 48 * HOUR_US
STEP_RESET_US = 60_000_000
SMOOTHING = 0.05
UPDATES_PER_FRAME = 2
WARN_OFFSET_US = 1_000_000

# --- fixed values: rate estimate ---
RATE_GAP_US = 750_000
RATE_WINDOW_US = 1_000_000
OLD_SHARE, NEW_SHARE = 0.35, 0.65

# --- fixed values: thinning ---
TREND_GAP_US = 100_000
EVENT_GAP_US, ERROR_GAP_US = 2_000_000, 500_000
EXPORTED_TRENDS = 120

NEGLIGIBLE = 1e-30


@dataclass(frozen=True)
class Fold:
    """``summarize(rows) -> summary``, ``advance(state, summary) -> state``, ``apply(rows, state) -> columns``."""

    summarize: Callable[[pd.DataFrame], object]
    advance: Callable[[object, object], object]
    apply: Callable[[pd.DataFrame, object], dict[str, np.ndarray]]
    outputs: dict[str, T.DataType]


def chunked_fold(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], width: int, fold: Fold) -> DataFrame:
    """Add the fold's output columns to ``rows``; ``order[0]`` is numeric and defines the chunks."""
    part = [*keys, "_chunk"]
    chunked = rows.withColumn("_chunk", chunk_of(order[0], width))
    key_schema = T.StructType([chunked.schema[c] for c in part])

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        summary = fold.summarize(pdf.sort_values(order))
        return pdf[part].head(1).assign(_text=json.dumps(summary))

    def carry(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_chunk")
        state, entries = None, []
        for text in pdf["_text"]:
            entries.append(json.dumps(state))
            state = fold.advance(state, json.loads(text))
        return pdf[part].assign(_text=entries)

    out_schema = T.StructType([*chunked.schema.fields, *(T.StructField(n, t) for n, t in fold.outputs.items())])

    def apply(pdf: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        state = json.loads(entry["_text"].iloc[0]) if len(entry) else None
        return pdf.assign(**fold.apply(pdf, state))

    text_schema = T.StructType([*key_schema.fields, T.StructField("_text", T.StringType())])
    narrow = chunked.select(*dict.fromkeys([*part, *order, *inputs]))
    summaries = narrow.groupBy(*part).applyInPandas(summarize, text_schema)
    entries = summaries.groupBy(*keys).applyInPandas(carry, text_schema)
    return chunked.groupBy(*part).cogroup(entries.groupBy(*part)).applyInPandas(apply, out_schema).drop("_chunk")


def fold_end(rows: DataFrame, keys: list[str], order: list[str], inputs: list[str], width: int, fold: Fold, field: T.StructField, value: Callable[[object], object]) -> DataFrame:
    """One row per key: what the fold's state says after all its rows. Chunks are summarised, but not gone through again."""
    part = [*keys, "_chunk"]
    chunked = rows.withColumn("_chunk", chunk_of(order[0], width)).select(*dict.fromkeys([*part, *order, *inputs]))
    text_schema = T.StructType([*(chunked.schema[c] for c in part), T.StructField("_text", T.StringType())])

    def summarize(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf[part].head(1).assign(_text=json.dumps(fold.summarize(pdf.sort_values(order))))

    def last(pdf: pd.DataFrame) -> pd.DataFrame:
        state = None
        for text in pdf.sort_values("_chunk")["_text"]:
            state = fold.advance(state, json.loads(text))
        return pdf[keys].head(1).assign(**{field.name: value(state)})

    summaries = chunked.groupBy(*part).applyInPandas(summarize, text_schema)
    return summaries.groupBy(*keys).applyInPandas(last, T.StructType([*(chunked.schema[c] for c in keys), field]))


# ------------------------------------------------------------------ clock offset


def clock_step(offset: float | None, sample: float, decay: float) -> float | None:
    """Offset after one frame; absurd samples change nothing, steps restart it."""
    if abs(sample) > MAX_OFFSET_US:
        return offset
    if offset is None or abs(sample - offset) > STEP_RESET_US:
        return float(sample)
    return sample + (offset - sample) * decay


def _run_clock(offset: float | None, samples: list[float], decay: float) -> float | None:
    for x in samples:
        offset = clock_step(offset, x, decay)
    return offset


def _clock_summary(samples: np.ndarray, decay: float) -> dict:
    """What a run of samples does to any offset it may be entered with.

    An offset inside ``[lo, hi]`` gets past a sample without a restart; it then is
    ``scale * offset + shift``. One that falls out restarts at that sample, and what
    follows no longer depends on it. The bounds widen as the scale shrinks, so there are
    few of them, and once the scale is negligible the rest is one known path.
    """
    xs = [float(x) for x in samples if abs(x) <= MAX_OFFSET_US]
    falls: list[tuple[float, float, float]] = []
    lo, hi, scale, shift = -float("inf"), float("inf"), 1.0, 0.0
    for i, x in enumerate(xs):
        if scale < NEGLIGIBLE:
            return {"fresh": falls[0][2], "falls": falls, "scale": 0.0, "shift": _run_clock(shift, xs[i:], decay)}
        low, high = (x - STEP_RESET_US - shift) / scale, (x + STEP_RESET_US - shift) / scale
        if low > lo or high < hi:
            lo, hi = max(lo, low), min(hi, high)
            falls.append((lo, hi, _run_clock(x, xs[i + 1 :], decay)))
            if lo > hi:
                break
        scale, shift = scale * decay, x + (shift - x) * decay
    return {"fresh": falls[0][2] if falls else None, "falls": falls, "scale": scale, "shift": shift}


def _clock_advance(offset: float | None, s: dict) -> float | None:
    if offset is None:
        return s["fresh"]
    for lo, hi, after in s["falls"]:
        if not lo <= offset <= hi:
            return after
    return s["scale"] * offset + s["shift"]


def _clock_fold(decay: float) -> Fold:
    def apply(pdf: pd.DataFrame, offset: float | None) -> dict[str, np.ndarray]:
        out = []
        for x in pdf["_sample"].tolist():
            offset = clock_step(offset, x, decay)
            out.append(offset)
        return {"offset_us": np.array(out, dtype=float)}

    return Fold(
        lambda pdf: _clock_summary(pdf["_sample"].to_numpy(), decay), _clock_advance, apply, {"offset_us": T.DoubleType()}
    )


def clock_offset_ema(readings: DataFrame, updates_per_frame: int = UPDATES_PER_FRAME, width: int = ARRIVALS) -> DataFrame:
    """Add ``offset_us``: the smoothed arrival-minus-measurement offset after each reading.

    The live pipeline refines the estimate twice per frame; ``updates_per_frame`` keeps that.
    """
    rows = readings.filter(F.col("received_us").isNotNull() & F.col("meas_us").isNotNull()).withColumn(
        "_sample", (F.col("received_us") - F.col("meas_us")).cast("double")
    )
    fold = _clock_fold((1 - SMOOTHING) ** updates_per_frame)
    out = chunked_fold(rows, ["pmu_id"], ["arrival_seq"], ["_sample"], width, fold).drop("_sample")
    return out.withColumn("offset_us", F.when(~F.isnan("offset_us"), F.col("offset_us")))


def corrected_lag(estimated: DataFrame, now_us) -> DataFrame:
    """Corrected time and remaining lag per reading; ``warn`` marks a device's first large offset."""
    large = F.abs("offset_us") >= WARN_OFFSET_US
    first = (
        estimated.filter(large).groupBy("pmu_id").agg(F.min("arrival_seq").alias("_first"))
    )
    corrected = F.col("meas_us") + F.coalesce("offset_us", F.lit(0.0))
    return (
        estimated.join(first, "pmu_id", "left")
        .withColumn("corrected_us", corrected)
        .withColumn("lag_ms", (now_us - F.col("corrected_us")) / 1000.0)
        .withColumn("warn", F.coalesce(F.col("arrival_seq") == F.col("_first"), F.lit(False)))
        .drop("_first")
    )


# ------------------------------------------------------------------ thinning


def thin_step(last: int | None, t: int, gap: int) -> tuple[int, bool]:
    keep = last is None or t - last >= gap
    return (t if keep else last), keep


def _next_kept(t: np.ndarray, gap: int) -> np.ndarray:
    return np.searchsorted(t, t + gap, side="left")


def _with_sure(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(times, which of them are rows): rows plus the row before each, where that is not a row here.

    The row before is either kept for certain or was decided in the chunk before; deciding
    it again changes nothing.
    """
    t, before = pdf["_t"].to_numpy(), pdf["_before"].to_numpy()
    missing = np.append(True, before[1:] != t[:-1])
    at = np.flatnonzero(missing)
    times = np.insert(t, at, before[at])
    real = np.insert(np.ones(len(t), dtype=bool), at, False)
    return times, real


def _thin_summary(pdf: pd.DataFrame) -> dict:
    """For every row that may be the first kept one: the last kept one that follows.

    The first kept row is at most one gap behind the first row, whatever came before.
    """
    t, gap = _with_sure(pdf)[0], int(pdf["_gap"].iloc[0])
    n = len(t)
    jump = np.append(_next_kept(t, gap), n)
    last = np.arange(n)
    while True:  # doubling: every round squares how far ``last`` is ahead
        after = jump[last]
        if (after >= n).all():
            break
        last = np.where(after < n, after, last)
        last = last[last]
    firsts = np.arange(min(n, int(jump[0]) + 1))
    return {"gap": gap, "first": t[firsts].tolist(), "last": t[last[firsts]].tolist()}


def _thin_advance(last: int | None, s: dict) -> int | None:
    if last is None:
        return s["last"][0]
    i = int(np.searchsorted(np.array(s["first"]), last + s["gap"], side="left"))
    return s["last"][i] if i < len(s["first"]) else last


def _thin_apply(pdf: pd.DataFrame, last: int | None) -> dict[str, np.ndarray]:
    (t, real), gap = _with_sure(pdf), int(pdf["_gap"].iloc[0])
    follow = _next_kept(t, gap)
    keep = np.zeros(len(t), dtype=bool)
    i = 0 if last is None else int(np.searchsorted(t, last + gap, side="left"))
    while i < len(t):
        keep[i] = True
        i = int(follow[i])
    return {"_keep": keep[real]}


THIN = Fold(_thin_summary, _thin_advance, _thin_apply, {"_keep": T.BooleanType()})


def thin(rows: DataFrame, keys: list[str], time: str, gap: str, tie: str, width: int = HOUR_US) -> DataFrame:
    """Keep a row when ``gap`` has passed since the last kept row of its key.

    ``gap`` is a column with one positive value per key; ``width`` must not be below it.
    Rows of one time keep the order of ``tie``. A row a whole gap behind the row before
    it is kept whatever happened earlier, so only the others are folded.
    """
    timed = rows.withColumn("_t", F.col(time)).withColumn("_gap", F.col(gap).cast("bigint"))
    seen = with_previous(timed, keys, ["_t", tie], ["_t"], width).withColumnRenamed("prev__t", "_before")
    sure = F.coalesce(F.col("_t") - F.col("_before") >= F.col("_gap"), F.lit(True))
    open_rows = seen.filter(~sure)
    folded = chunked_fold(open_rows, keys, ["_t", tie], ["_before", "_gap"], width, THIN).filter("_keep")
    return seen.filter(sure).unionByName(folded.drop("_keep")).select(*rows.columns)


def trend_downsample(readings: DataFrame, gap_us: int = TREND_GAP_US, mode: str = "greedy", keep: int = EXPORTED_TRENDS) -> DataFrame:
    """At most one trend point per gap and device, the last ``keep`` of them.

    ``mode="bucket"`` keeps the first row of each gap-wide bucket instead: no Python.
    """
    if mode == "bucket":
        first = F.row_number().over(
            W.partitionBy("pmu_id", F.floor(F.col("received_us") / gap_us)).orderBy("received_us", "arrival_seq")
        )
        points = readings.withColumn("_rank", first).filter("_rank = 1").drop("_rank")
    else:
        points = thin(readings.withColumn("_gap_us", F.lit(gap_us)), ["pmu_id"], "received_us", "_gap_us", "arrival_seq").drop("_gap_us")
    return newest(points, ["pmu_id"], ["received_us", "arrival_seq"], keep)


def rate_limit_events(events: DataFrame) -> DataFrame:
    """Events that pass the per (device, stage, status) rate limit, on event time."""
    gap = F.when(fleet.is_errorish("status"), ERROR_GAP_US).otherwise(EVENT_GAP_US)
    keyed = events.withColumn("_status", F.lower("status")).withColumn("_min_us", gap)
    return thin(keyed, ["pmu_id", "stage", "_status"], "time_us", "_min_us", "seq").drop("_status", "_min_us")


# ------------------------------------------------------------------ frame rate


def snap_rate(measured: float, cfg: float) -> float:
    if cfg <= 0 or not measured > 0:
        return measured
    tolerance = max(float(fleet.FPS_TOLERANCE), cfg * fleet.FPS_TOLERANCE_SHARE)
    return cfg if abs(measured - cfg) <= tolerance else measured


def blend_rate(rate: float, instant: float, cfg: float) -> float:
    """Estimate after one finished counting window."""
    instant = snap_rate(instant, cfg)
    if rate <= 0 or (cfg > 0 and instant == cfg):
        return instant
    return snap_rate(rate * OLD_SHARE + instant * NEW_SHARE, cfg)


def rate_step(state: list, meas: int, gap_us: float, new: bool, cfg: float) -> list:
    """[window start, stamps in it, estimate] after one frame."""
    start, count, rate = state
    if start is None or gap_us > RATE_GAP_US or meas < start:
        return [meas, int(new), rate]
    if not new:
        return state
    count += 1
    elapsed = (meas - start) / 1e6
    if elapsed < RATE_WINDOW_US / 1e6 or count < 2:
        return [start, count, rate]
    return [meas, 1, blend_rate(rate, (count - 1) / elapsed, cfg)]


class _Rates:
    """The frames of one chunk with jumps from one window start to the next.

    After a restart or a finished window at row ``j`` the state is (stamp of j, 1 or 0):
    it depends on ``j`` alone. So windows chain row to row whatever came before.
    """

    def __init__(self, pdf: pd.DataFrame) -> None:
        self.meas = pdf["meas_us"].to_numpy()
        self.gap = pdf["_gap"].to_numpy() > RATE_GAP_US
        self.new = pdf["_new"].to_numpy().astype(bool)
        self.cfg = float(pdf["_cfg"].iloc[0])
        self.cfgs = pdf["_cfg"].to_numpy()
        self.n = len(pdf)
        self.seen = np.cumsum(self.new)
        self.gaps = np.flatnonzero(self.gap)
        self.news = np.flatnonzero(self.new)
        self.sorted = bool((np.diff(self.meas) >= 0).all())

    def following(self, j: int) -> tuple[int, int]:
        """(row of the next restart or finished window after j, stamps counted by then)."""
        restart = self.gaps[np.searchsorted(self.gaps, j + 1)] if len(self.gaps) and self.gaps[-1] > j else self.n
        own = int(self.new[j])
        if self.sorted:
            k = int(np.searchsorted(self.meas, self.meas[j] + RATE_WINDOW_US, side="left"))
            if k < self.n and own + self.seen[k] - self.seen[j] < 2:
                after = np.searchsorted(self.news, k + 1)
                k = int(self.news[after]) if after < len(self.news) else self.n
        else:
            k = j + 1
            while k < self.n and not self.gap[k] and self.meas[k] >= self.meas[j]:
                full = self.new[k] and self.meas[k] - self.meas[j] >= RATE_WINDOW_US
                if full and own + self.seen[k] - self.seen[j] >= 2:
                    break
                k += 1
        k = min(k, int(restart))
        return k, own + int(self.seen[k] - self.seen[j]) if k < self.n else own + int(self.seen[-1] - self.seen[j])

    def windows(self, j: int):
        """(row, instant rate, configured rate) of each window finished from start ``j`` on; ends with the open window."""
        while True:
            k, count = self.following(j)
            if k >= self.n:
                return j, count
            if not self.gap[k] and self.meas[k] >= self.meas[j]:
                yield k, (count - 1) / ((self.meas[k] - self.meas[j]) / 1e6), float(self.cfgs[k])
            j = k

    def head(self) -> int:
        """Rows from the first one on by which any window open before has ended."""
        full = self.new & (self.meas - self.meas[0] >= RATE_WINDOW_US) & (self.seen >= 2)
        ends = np.flatnonzero(full | self.gap)
        return int(ends[0]) + 1 if len(ends) else self.n


# an estimate as a function of the one before it: pieces (up to, scale, shift)
_SAME = [[float("inf"), 1.0, 0.0]]


def _after_window(pieces: list, instant: float, cfg: float) -> list:
    """The pieces after one more finished window."""
    instant = snap_rate(instant, cfg)
    if cfg > 0 and instant == cfg:
        return [[float("inf"), 0.0, instant]]
    tolerance = max(float(fleet.FPS_TOLERANCE), cfg * fleet.FPS_TOLERANCE_SHARE)
    out: list = []

    def add(upto: float, scale: float, shift: float) -> None:
        if scale < NEGLIGIBLE:
            scale = 0.0
        if out and out[-1][1:] == [scale, shift]:
            out[-1][0] = upto
        elif not out or upto > out[-1][0]:
            out.append([upto, scale, shift])

    below = 0.0
    for upto, scale, shift in pieces:
        scale, shift = scale * OLD_SHARE, shift * OLD_SHARE + instant * NEW_SHARE
        if cfg <= 0:
            add(upto, scale, shift)
        elif scale < NEGLIGIBLE:
            add(upto, 0.0, snap_rate(shift, cfg))
        else:
            enter, leave = (cfg - tolerance - shift) / scale, (cfg + tolerance - shift) / scale
            if enter > below:
                add(min(enter, upto), scale, shift)
            if leave > below and enter < upto:
                add(min(leave, upto), 0.0, cfg)
            if leave < upto:
                add(upto, scale, shift)
        below = upto
    return out


def _evaluate(pieces: list, rate: float) -> float:
    for upto, scale, shift in pieces:
        if rate <= upto:
            return scale * rate + shift
    return rate


def _rate_summary(pdf: pd.DataFrame) -> dict:
    """The head rows, and for each of them as a window start: where it all ends."""
    r = _Rates(pdf)
    head = r.head()
    ends = []
    for j in range(head):
        pieces, fresh = _SAME, 0.0
        chain = r.windows(j)
        while True:
            try:
                _, instant, cfg = next(chain)
            except StopIteration as stop:
                start, count = stop.value
                break
            pieces, fresh = _after_window(pieces, instant, cfg), blend_rate(fresh, instant, cfg)
        ends.append([int(r.meas[start]), count, fresh, pieces])
    rows = [[int(m), bool(g), bool(w), float(c)] for m, g, w, c in zip(r.meas[:head], r.gap[:head], r.new[:head], r.cfgs[:head])]
    return {"rows": rows, "ends": ends}


def _first_start(state: list | None, rows: list) -> tuple[int | None, list]:
    """(row at which a window begins, state there) when entering ``rows`` with ``state``."""
    state = state or [None, 0, 0.0]
    for i, (meas, gap, new, cfg) in enumerate(rows):
        after = rate_step(state, meas, RATE_GAP_US + 1 if gap else 0, new, cfg)
        restarted = state[0] is None or gap or meas < state[0]
        finished = not restarted and new and after[1] == 1 and after[0] == meas and meas != state[0]
        state = after
        if restarted or finished:
            return i, state
    return None, state


def _rate_advance(state: list | None, s: dict) -> list:
    i, state = _first_start(state, s["rows"])
    if i is None:
        return state
    start, count, fresh, pieces = s["ends"][i]
    rate = state[2]
    return [start, count, _evaluate(pieces, rate) if rate > 0 else fresh]


def _rate_apply(pdf: pd.DataFrame, state: list | None) -> dict[str, np.ndarray]:
    r = _Rates(pdf)
    out = np.empty(r.n)
    before = (state or [None, 0, 0.0])[2]
    head = r.head()
    rows = [[int(m), bool(g), bool(w), float(c)] for m, g, w, c in zip(r.meas[:head], r.gap[:head], r.new[:head], r.cfgs[:head])]
    i, state = _first_start(state, rows)
    if i is None:
        out[:] = before
        return {"approx_fps": out}
    out[:i] = before
    at, rate = i, state[2]
    for k, instant, cfg in r.windows(i):
        out[at:k] = rate
        at, rate = k, blend_rate(rate, instant, cfg)
    out[at:] = rate
    return {"approx_fps": out}


RATE = Fold(_rate_summary, _rate_advance, _rate_apply, {"approx_fps": T.DoubleType()})


def fps_estimate(readings: DataFrame, width: int = ARRIVALS) -> DataFrame:
    """Add ``approx_fps``: distinct stamps per second of measurement time, smoothed.

    A window starts anew after a silence or when stamps run backwards. ``data_rate``, where
    present, is the configured rate estimates snap to.
    """
    return chunked_fold(_paced(readings, width), ["pmu_id"], ["arrival_seq"], _PACE, width, RATE).drop("_gap", "_new", "_cfg")


def measured_fps(readings: DataFrame, width: int = ARRIVALS) -> DataFrame:
    """pmu_id, measured_fps: the rate that :func:`fps_estimate` has come to at a device's last frame."""
    field = T.StructField("measured_fps", T.DoubleType())
    narrow = [c for c in ("pmu_id", "arrival_seq", "received_us", "meas_us", "data_rate") if c in readings.columns]
    return fold_end(_paced(readings.select(*narrow), width), ["pmu_id"], ["arrival_seq"], _PACE, width, RATE, field, lambda state: (state or [None, 0, 0.0])[2])


_PACE = ["meas_us", "_gap", "_new", "_cfg"]


def _paced(readings: DataFrame, width: int) -> DataFrame:
    cfg = fleet.cfg_rate_fps("data_rate") if "data_rate" in readings.columns else F.lit(0.0)
    seen = with_previous(readings, ["pmu_id"], ["arrival_seq"], ["received_us", "meas_us"], width)
    return (
        seen.withColumn("_gap", F.coalesce(F.col("received_us") - F.col("prev_received_us"), F.lit(0)).cast("double"))
        .withColumn("_new", F.coalesce(F.col("meas_us") != F.col("prev_meas_us"), F.lit(True)))
        .withColumn("_cfg", cfg)
        .drop("prev_received_us", "prev_meas_us", "prev_seen")
    )
