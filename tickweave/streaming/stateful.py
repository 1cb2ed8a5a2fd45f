"""Keyed state of the continuous forms: one device per key, value and map state, timers that fire without a new row.

Every processor holds a bounded part of a device's rows in memory, also when a micro-batch is one device's: what must be put in order
first lies in map state, in pages.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tickweave.functions import fleet
from tickweave.operators import estimators
from tickweave.operators.align import normalize_period_us

#: rows of a device that are ordered in memory, rows of a page of ordered ones, rows given on together
SORTED, PAGE, TOGETHER = 16_384, 512, 8_192
#: the same for rows that are two numbers: those ordered in memory, those of a page
RUN, LEAF = 262_144, 8_192


def records(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple]:
    """The rows of a device's frames, one after the other."""
    for frame in frames:
        yield from frame[columns].itertuples(index=False, name=None)


def framed(rows: Iterator[tuple], schema: T.StructType) -> Iterator[pd.DataFrame]:
    """Frames of a bounded number of rows."""
    some: list[tuple] = []
    for row in rows:
        some.append(row)
        if len(some) == TOGETHER:
            yield pd.DataFrame(some, columns=schema.names)
            some = []
    if some:
        yield pd.DataFrame(some, columns=schema.names)


class Sorter:
    """Puts one micro-batch of a device in order. More than SORTED rows become runs in map state that are merged page by page."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.pages = handle.getMapState("sorted_pages", "run int, page int", "rows binary")

    def ordered(self, rows: Iterator[tuple]) -> Iterator[tuple]:
        run: list[tuple] = []
        sizes: list[int] = []
        for row in rows:
            run.append(row)
            if len(run) == SORTED:
                sizes.append(self._store(len(sizes), run))
                run = []
        run.sort()
        if not sizes:
            yield from run
            return
        yield from heapq.merge(*(self._load(k, pages) for k, pages in enumerate(sizes)), run)

    def _store(self, run: int, rows: list[tuple]) -> int:
        rows.sort()
        pages = range(0, len(rows), PAGE)
        for page, at in enumerate(pages):
            self.pages.updateValue((run, page), (pickle.dumps(rows[at : at + PAGE]),))
        return len(pages)

    def _load(self, run: int, pages: int) -> Iterator[tuple]:
        for page in range(pages):
            (rows,) = self.pages.getValue((run, page))
            self.pages.removeKey((run, page))
            yield from pickle.loads(rows)


class Due:
    """The one timer of a device: the earliest of what it waits for."""

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.at = handle, handle.getValueState("due", "at long")

    def set(self, at_us: int | None) -> None:
        """Fire as soon as the watermark has passed a time."""
        wanted = None if at_us is None else at_us // 1000 + 1
        known = self.at.get()[0] if self.at.exists() else None
        if known == wanted:
            return
        if known is not None:
            self.handle.deleteTimer(known)
        if wanted is None:
            self.at.clear()
        else:
            self.handle.registerTimer(wanted)
            self.at.update((wanted,))

    def fired(self) -> None:
        self.at.clear()

    def earliest(self, at_us: int) -> None:
        known = self.at.get()[0] if self.at.exists() else None
        if known is None or at_us // 1000 + 1 < known:
            self.set(at_us)


class Waiting:
    """Rows of a device, a time and a number each, until the watermark has passed them: then they come out in order.

    Rows lie in pages, each in order of its own. A list says of each page its number, its rows, how many of them have come out, and
    the times of the next and of the last one, so that a page is read when its next row is due and written once.
    """

    def __init__(self, handle: StatefulProcessorHandle) -> None:
        self.pages, self.list = handle.getMapState("waiting", "page int", "rows binary"), handle.getValueState("waiting_pages", "pages binary")

    def _listed(self) -> np.ndarray:
        return np.frombuffer(self.list.get()[0] if self.list.exists() else b"", np.int64).reshape(-1, 5)

    def _keep(self, listed: np.ndarray) -> None:
        if len(listed):
            self.list.update((listed.tobytes(),))
        elif self.list.exists():
            self.list.clear()

    def _load(self, page: np.ndarray) -> np.ndarray:
        """Rows of a page that haven't come out."""
        (rows,) = self.pages.getValue((int(page[0]),))
        return np.frombuffer(rows, np.int64).reshape(-1, 2)[page[2] :]

    def put(self, parts: Iterator[np.ndarray]) -> int | None:
        """Keeps rows; the time of the first one."""
        listed = self._listed()
        left = listed[:, 1] - listed[:, 2]
        # what is left of small pages is written with the new rows, so that small batches don't leave a page each
        small = np.flatnonzero((left < LEAF // 2) & (np.cumsum(np.where(left < LEAF // 2, left, 0)) < RUN))
        held, n, first, found = [], 0, None, []
        number = int(listed[:, 0].max(initial=-1)) + 1
        for rows in parts:
            if not len(rows):
                continue
            first = min(int(rows[:, 0].min()), first if first is not None else int(rows[0, 0]))
            held.append(rows)
            n += len(rows)
            if n >= RUN:
                run = np.concatenate(held)
                full = n // LEAF * LEAF
                found += self._write(run[:full], number + len(found))
                held, n = [run[full:]], n - full
        if first is None:
            return None
        if n:
            run = np.concatenate([*held, *(self._load(listed[k]) for k in small)])
            found += self._write(run, number + len(found))
            for k in small:
                self.pages.removeKey((int(listed[k, 0]),))
            listed = np.delete(listed, small, axis=0)
        self._keep(np.concatenate([listed, np.array(found, np.int64).reshape(-1, 5)]))
        return first

    def _write(self, rows: np.ndarray, number: int) -> list[tuple]:
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        found = []
        for k, at in enumerate(range(0, len(rows), LEAF)):
            page = rows[at : at + LEAF]
            self.pages.updateValue((number + k,), (page.tobytes(),))
            found.append((number + k, len(page), 0, page[0, 0], page[-1, 0]))
        return found

    def passed(self, until_us: int) -> Iterator[np.ndarray]:
        """Rows before a time, in order, in parts; rows of equal times come in one part."""
        listed = self._listed().copy()
        ahead = [k for k in np.argsort(listed[:, 3], kind="stable") if listed[k, 3] < until_us][::-1]
        if not ahead:
            return
        read: dict[int, np.ndarray] = {}
        gone = []
        while ahead or read:
            # up to the end of the page that ends first, once all that begin before it have been read
            upto = min((listed[k, 4] for k in read), default=until_us)
            while ahead and (not read or listed[ahead[-1], 3] <= upto):
                k = ahead.pop()
                read[k] = self._load(listed[k])
                upto = min(upto, listed[k, 4])
            upto = min(upto, until_us - 1)
            parts = []
            for k, rows in list(read.items()):
                n = int(np.searchsorted(rows[:, 0], upto, side="right"))
                parts.append(rows[:n])
                if n == len(rows):
                    del read[k]
                    self.pages.removeKey((int(listed[k, 0]),))
                    gone.append(k)
                else:
                    read[k] = rows[n:]
                    listed[k, 2] += n
                    listed[k, 3] = rows[n, 0]
                    if rows[n, 0] >= until_us:
                        del read[k]
            together = np.concatenate(parts)
            yield together[np.lexsort((together[:, 1], together[:, 0]))]
        self._keep(np.delete(listed, gone, axis=0))

    def next(self) -> int | None:
        """The time of the first row."""
        listed = self._listed()
        return int(listed[:, 3].min()) if len(listed) else None


# ------------------------------------------------------------------ estimators

Step = Callable[[tuple | None, tuple], tuple[tuple, tuple]]


def _clock(updates: int) -> Step:
    decay = (1 - estimators.SMOOTHING) ** updates

    def step(state, row):
        _, at, stamp, *_ = row
        known = estimators.clock_step(state[0] if state else None, float(at - stamp), decay)
        return (known,), (known,)

    return step


def _rate(state, row):
    _, at, stamp, _, _, cfg = row
    start, count, rate, received, meas = state or (None, 0, 0.0, None, None)
    gap = at - received if received is not None else 0
    start, count, rate = estimators.rate_step([start, count, rate], stamp, gap, stamp != meas, cfg)
    return (start, count, rate, at, stamp), (rate,)


def _edge(state, row):
    ok, reason = bool(row[3]), row[4]
    edge = None if state and state[0] == ok else ("quality_degraded" if not ok else ("quality_recovered" if state else None))
    return (ok,), (edge, reason if edge == "quality_degraded" else None)


def _trend(state, row):
    last, keep = estimators.thin_step(state[0] if state else None, row[1], estimators.TREND_GAP_US)
    return (last,), (keep,)


#: of each estimator: its state, its outputs, and its step from a row (arrival_seq, received_us, meas_us, quality_ok, reason, configured rate)
ESTIMATORS: dict[str, tuple[str, list[T.StructField], Step]] = {
    "clock": ("offset double", [T.StructField("offset_us", T.DoubleType())], _clock(estimators.UPDATES_PER_FRAME)),
    "rate": ("start long, count long, rate double, received long, meas long", [T.StructField("approx_fps", T.DoubleType())], _rate),
    "edge": ("ok boolean", [T.StructField("edge", T.StringType()), T.StructField("reason", T.StringType())], _edge),
    "trend": ("last long", [T.StructField("trend_point", T.BooleanType())], _trend),
}
INPUTS = ["arrival_seq", "received_us", "meas_us", "quality_ok", "reason", "cfg"]


class Estimates(StatefulProcessor):
    """Running estimates of a device, each with a value state of its own that expires when the device has been silent for long."""

    def __init__(self, names: list[str], schema: T.StructType, ttl_ms: int | None, changes: bool) -> None:
        self.names, self.schema, self.ttl_ms, self.changes = names, schema, ttl_ms, changes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sorter = Sorter(handle)
        self.states = {n: handle.getValueState(n, ESTIMATORS[n][0], self.ttl_ms) for n in self.names}

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        return framed(self._estimated(key, rows), self.schema)

    def _estimated(self, key: tuple, rows: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        states = {n: s.get() if s.exists() else None for n, s in self.states.items()}
        for row in self.sorter.ordered(records(rows, INPUTS)):
            out: list = [key[0], row[0], row[1]]
            for n in self.names:
                states[n], found = ESTIMATORS[n][2](states[n], row)
                out += found
            if not self.changes or out[3] is not None:
                yield tuple(out)
        for n, s in self.states.items():
            s.update(states[n])


def estimates(gated: DataFrame, names: list[str], ttl_ms: int | None = None, changes: bool = False) -> DataFrame:
    """pmu_id, arrival_seq, received_us and the outputs of some estimators for every row of a gated stream, in arrival order of
    each device within a micro-batch. `changes`: only rows on which the first output says something.

    `ttl_ms` (of processing time) forgets a device that has sent nothing for so long.
    """
    have = set(gated.columns)
    cfg = fleet.cfg_rate_fps("data_rate") if "data_rate" in have else F.lit(0.0)
    reason = F.coalesce("reject_reason", F.lit("")) if "reject_reason" in have else F.lit("")
    rows = gated.select(
        "pmu_id", "arrival_seq", "received_us", "meas_us", "quality_ok", reason.alias("reason"), F.coalesce(cfg.cast("double"), F.lit(0.0)).alias("cfg")
    )
    head = [T.StructField("pmu_id", T.StringType()), T.StructField("arrival_seq", T.LongType()), T.StructField("received_us", T.LongType())]
    schema = T.StructType([*head, *(f for n in names for f in ESTIMATORS[n][1])])
    # with a clock of its own a query runs batch after batch, without new rows too
    mode = "none" if ttl_ms is None else "processingTime"
    return rows.groupBy("pmu_id").transformWithStateInPandas(Estimates(names, schema, ttl_ms, changes), schema, "append", mode)


# ------------------------------------------------------------------ sessions

SESSION_EVENTS = T.StructType(
    [
        T.StructField("pmu_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("time_us", T.LongType()),
        T.StructField("became_live_us", T.LongType()),
        T.StructField("frames", T.LongType()),
    ]
)


#: the events of a session, by number
TURNS = np.array(["left_live", "became_live"], object)


def session_turns(rows: np.ndarray, live: tuple | None) -> tuple[tuple[np.ndarray, ...], tuple]:
    """Events of frames in order (time, patience), after a session (first, last, patience, frames) that is open or None.

    Number in TURNS, time, begin and frames of each event; then the session that is open after the last frame.
    """
    at, patience = rows[:, 0], rows[:, 1]
    last = np.concatenate([[live[1] if live else at[0]], at[:-1]])
    bound = np.concatenate([[live[2] if live else -1], patience[:-1]])
    starts = np.flatnonzero(at - last > bound)
    # sessions that go on or begin here, and where their frames begin
    begun = np.concatenate([np.zeros(1 if live else 0, np.int64), starts])
    first = at[begun]
    frames = np.diff(begun, append=len(at))
    if live:
        first[0] = live[0]
        frames[0] += live[3]
    left = starts if live else starts[1:]
    told = len(left)
    # each beginning follows the end before it
    events = np.empty((4, len(starts), 2), np.int64)
    events[0] = 0, 1
    events[1, len(starts) - told :, 0], events[1, :, 1] = last[left] + bound[left], at[starts]
    events[2, len(starts) - told :, 0], events[2, :, 1] = first[:told], at[starts]
    events[3, len(starts) - told :, 0], events[3, :, 1] = frames[:told], 0
    flat = events.reshape(4, -1)[:, 0 if live else 1 :]
    return tuple(flat), (int(first[-1]), int(at[-1]), int(patience[-1]), int(frames[-1]))


class Sessions(StatefulProcessor):
    """Live and not-live events of a device: the first when its first frame has passed the watermark, the second at the silence deadline."""

    def __init__(self, width_us: int) -> None:
        self.width_us = width_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting, self.due = Waiting(handle), Due(handle)
        self.live = handle.getValueState("live", "first long, last long, patience long, frames long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first = self.waiting.put(frame[["received_us", "patience_us"]].to_numpy(np.int64) for frame in rows)
        if first is not None:
            self.due.earliest(self._end(first))
        return iter(())

    def _end(self, at_us: int) -> int:
        """The end of the slot of a time."""
        return (at_us // self.width_us + 1) * self.width_us - 1

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.due.fired()
        return self._passed(key, timerValues.getCurrentWatermarkInMs() * 1000)

    def _passed(self, key: tuple, watermark_us: int) -> Iterator[pd.DataFrame]:
        live = self.live.get() if self.live.exists() else None
        # no frame before this time is still to come
        known_us = watermark_us // self.width_us * self.width_us
        for rows in self.waiting.passed(known_us):
            events, live = session_turns(rows, live)
            yield from self._framed(key, *events)
        if live and live[1] + live[2] < known_us:
            yield from self._framed(key, *(np.array([x]) for x in (0, live[1] + live[2], live[0], live[3])))
            live = None
        if live:
            self.live.update(live)
        elif self.live.exists():
            self.live.clear()
        first = self.waiting.next()
        waits = [self._end(x) for x in (first, live and live[1] + live[2]) if x is not None]
        self.due.set(min(waits) if waits else None)

    @staticmethod
    def _framed(key: tuple, kind: np.ndarray, time: np.ndarray, first: np.ndarray, frames: np.ndarray) -> Iterator[pd.DataFrame]:
        for at in range(0, len(kind), TOGETHER):
            some = slice(at, at + TOGETHER)
            names = np.full(len(kind[some]), key[0], object)
            yield pd.DataFrame(dict(zip(SESSION_EVENTS.names, (names, TURNS[kind[some]], time[some], first[some], frames[some]), strict=True)))


def session_events(frames: DataFrame, patience_us: Any, delay: str, width_us: int = 1_000_000) -> DataFrame:
    """`became_live` and `left_live` rows of a stream of frames, each as soon as it is known.

    Frames are put in order of their arrival time; those later than `delay` are dropped. A device is live from its first frame on,
    and leaves `patience_us` (a column) after its last one if none has come: a timer says so, no further frame has to. Frames without
    an arrival time belong to no session.
    """
    timed = frames.filter(F.col("received_us").isNotNull())
    rows = timed.select("pmu_id", "received_us", patience_us.cast("long").alias("patience_us"), F.timestamp_micros("received_us").alias("_at"))
    keyed = rows.withWatermark("_at", delay).groupBy("pmu_id")
    return keyed.transformWithStateInPandas(Sessions(width_us), SESSION_EVENTS, "append", "eventTime")


# ------------------------------------------------------------------ alignment

POINTS = T.StructType(
    [
        T.StructField("tick_us", T.LongType()),
        T.StructField("pmu_id", T.StringType()),
        T.StructField("sample", T.StringType()),
    ]
)


class Ticks(StatefulProcessor):
    """Nearest sample of a device for every tick, each sample used once.

    Of a tick at most two samples are held: the nearest inside its window, and one exactly on the border to the tick below. Ticks
    are decided in order once the watermark has passed their window: then all that is older is gone, and a late sample can't
    open a tick again.
    """

    def __init__(self, period_us: int, capacity: int | None) -> None:
        self.period, self.half, self.capacity = period_us, period_us // 2, capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        # (distance, stamp, -arrival, sample) of the inner and of the border sample
        self.ticks = handle.getMapState("ticks", "tick long", "border boolean, held binary")
        self.done, self.due = handle.getValueState("done", "tick long, border long"), Due(handle)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        done = self.done.get()[0] if self.done.exists() else None
        first, held = None, {}
        for stamp, seq, sample in records(rows, ["meas_us", "arrival_seq", "sample"]):
            tick = (stamp + self.half) // self.period * self.period
            if done is not None and tick <= done:
                continue
            border = self.period % 2 == 0 and tick - stamp == self.half
            self._hold(held.setdefault(tick, [None, None]), border, (abs(stamp - tick), stamp, -seq, sample))
            opens = tick - self.period if border else tick
            first = opens if first is None else min(opens, first)
            if len(held) == SORTED:
                self._flush(held)
                held = {}
        self._flush(held)
        if first is not None:
            self.due.earliest(first + self.half)
        return iter(())

    @staticmethod
    def _hold(pair: list, border: bool, new: tuple) -> None:
        if pair[border] is None or new[:3] < pair[border][:3]:
            pair[border] = new

    def _flush(self, held: dict[int, list]) -> None:
        for tick, pair in held.items():
            if self.ticks.containsKey((tick,)):
                for border, known in enumerate(self._held(tick)):
                    if known is not None:
                        self._hold(pair, bool(border), known)
            self.ticks.updateValue((tick,), (pair[1] is not None, pickle.dumps(pair)))
        if self.capacity is not None and held:
            known = sorted(k[0] for k in self.ticks.keys())  # noqa: SIM118
            for tick in known[: max(0, len(known) - self.capacity)]:
                self.ticks.removeKey((tick,))

    def _open(self) -> list[int]:
        """Ticks that may get a sample, in order: those with one, and the tick below each border sample."""
        done = self.done.get()[0] if self.done.exists() else None
        opened = set()
        for (tick,), (border, _) in self.ticks.iterator():
            opened.update((tick, tick - self.period) if border else (tick,))
        return sorted(t for t in opened if done is None or t > done)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.due.fired()
        return framed(self._decided(key, timerValues.getCurrentWatermarkInMs() * 1000), POINTS)

    def _held(self, tick: int) -> list:
        return pickle.loads(self.ticks.getValue((tick,))[1]) if self.ticks.containsKey((tick,)) else [None, None]

    def _decided(self, key: tuple, watermark_us: int) -> Iterator[tuple]:
        done, used = self.done.get() if self.done.exists() else (None, None)
        ahead: tuple[int, list] | None = None  # what the next tick holds, if this one had to look
        waits = None
        for tick in self._open():
            if tick + self.half >= watermark_us:
                waits = tick + self.half
                break
            pair = ahead[1] if ahead and ahead[0] == tick else self._held(tick)
            inner, border = pair
            chosen = inner or (border if used != tick else None)
            if chosen is None and self.period % 2 == 0:
                # a sample halfway to the next tick, which then hasn't got it any more
                ahead = (tick + self.period, self._held(tick + self.period))
                if chosen := ahead[1][1]:
                    used = tick + self.period
            if chosen is not None:
                yield (tick, key[0], chosen[3])
            if pair != [None, None]:
                self.ticks.removeKey((tick,))
            done = tick
        if done is not None:
            self.done.update((done, used))
        self.due.set(waits)


def aligned_samples(readings: DataFrame, period_us: int, delay: str, capacity: int | None = None) -> DataFrame:
    """Aligned samples of a stream, as `nearest_tick` gives them for a table: nearest within half a period, ties to the earlier one, each
    sample used once, of equal stamps the last arrival.

    A tick comes out once the watermark has passed its window, each device on its own. `capacity`: ticks that a device may
    hold open; beyond it the oldest are dropped.
    """
    period = normalize_period_us(period_us)
    columns = [c for c in readings.columns if c != "pmu_id"]
    schema = T.StructType([readings.schema[c] for c in columns])
    rows = readings.select("pmu_id", "meas_us", "arrival_seq", F.to_json(F.struct(*columns)).alias("sample"), F.timestamp_micros("meas_us").alias("_at"))
    keyed = rows.withWatermark("_at", delay).groupBy("pmu_id")
    points = keyed.transformWithStateInPandas(Ticks(period, capacity), POINTS, "append", "eventTime")
    return points.select("tick_us", "pmu_id", F.from_json("sample", schema).alias("s")).select("tick_us", "pmu_id", "s.*")
