"""Processors row by row over a state in memory, against plain definitions."""

import json
import random

import pandas as pd
import pytest

from tickweave.operators import estimators
from tickweave.streaming import stateful
from tickweave.streaming.stateful import Estimates, Sessions, Sorter, Ticks


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Map(dict):
    most = 0

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        return self[key]

    def updateValue(self, key, value):
        self[key] = value
        self.most = max(self.most, len(self))

    def removeKey(self, key):
        self.pop(key, None)

    def iterator(self):
        return iter(list(self.items()))


class Handle:
    def __init__(self):
        self.timers, self.states = set(), {}

    def getMapState(self, name, schema, ttl=None):
        return self.states.setdefault(name, Map())

    def getValueState(self, name, schema, ttl=None):
        return self.states.setdefault(name, Value())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Device:
    """One device's key: rows in batches, and a watermark that fires timers."""

    def __init__(self, processor):
        self.processor, self.handle, self.out = processor, Handle(), []
        processor.init(self.handle)

    def send(self, frames):
        for frame in self.processor.handleInputRows(("d",), iter(frames), None):
            self.out += list(frame.itertuples(index=False, name=None))

    def pass_(self, watermark_ms):
        class Now:
            def getCurrentWatermarkInMs(self):
                return watermark_ms

        while due := [t for t in self.handle.timers if t <= watermark_ms]:
            at = min(due)
            for frame in self.processor.handleExpiredTimer(("d",), Now(), None):
                self.out += list(frame.itertuples(index=False, name=None))
            self.handle.timers.discard(at)


def nearest_by_loop(rows, period):
    """Tick by tick: the nearest sample within half a period, ties to the earlier one, taken away once used."""
    left = {}
    for stamp, seq in rows:
        left[stamp] = max(seq, left.get(stamp, -1))
    out = []
    for tick in range(min(left) // period * period - period, max(left) + period + 1, period):
        near = sorted((abs(s - tick), s) for s in left if abs(s - tick) <= period // 2)
        if near:
            out.append((tick, near[0][1], left.pop(near[0][1])))
        left = {s: q for s, q in left.items() if s >= tick}
    return out


@pytest.mark.parametrize("seed", range(12))
def test_ticks_against_a_loop(seed, monkeypatch):
    monkeypatch.setattr(stateful, "SORTED", 3)
    rng = random.Random(seed)
    period = rng.choice([4000, 6000, 5000, 10_000])
    stamps = [40_000 + rng.choice([rng.randrange(0, 200_000, 500), rng.randrange(0, 40) * period + period // 2]) for _ in range(120)]
    rows = [(s, k) for k, s in enumerate(sorted(stamps, key=lambda s: s + rng.randrange(9000)))]
    device = Device(Ticks(period, None))
    top = 0
    for at in range(0, 120, 10):
        part = [r for r in rows[at : at + 10] if r[0] >= top]
        rows[at : at + 10] = part + [None] * (10 - len(part))
        device.send([pd.DataFrame([(s, q, json.dumps([s, q])) for s, q in part], columns=["meas_us", "arrival_seq", "sample"])] if part else [])
        top = max([top, *(s - 20_000 for s, _ in part)]) // 1000 * 1000
        device.pass_(top // 1000)
    open_now = [t for t in device.handle.timers]
    device.pass_(10**6)
    got = [(t, *json.loads(x)) for t, _, x in device.out]
    assert got == nearest_by_loop([r for r in rows if r], period)
    # at most two samples of a tick, one timer, nothing left
    assert len(open_now) <= 1 and not device.handle.states["ticks"] and not device.handle.timers


def test_ticks_hold_no_more_than_their_capacity():
    device = Device(Ticks(1000, 5))
    device.send([pd.DataFrame([(k * 1000, k, str(k)) for k in range(50)], columns=["meas_us", "arrival_seq", "sample"])])
    assert len(device.handle.states["ticks"]) == 5
    device.pass_(10**6)
    assert [t for t, *_ in device.out] == [k * 1000 for k in range(45, 50)]


def sessions_by_loop(times, patience):
    out, times = [], sorted(times)
    for k, t in enumerate(times):
        if k == 0 or t - times[k - 1] > patience:
            out.append([t, t, 0])
        out[-1][1], out[-1][2] = t, out[-1][2] + 1
    return out


@pytest.mark.parametrize("seed", range(6))
def test_sessions_against_a_loop(seed):
    rng = random.Random(seed)
    times = [rng.randrange(0, 400) * 100_000 + rng.randrange(3) for _ in range(150)]
    device = Device(Sessions(1_000_000))
    for t in sorted(times):
        device.send([pd.DataFrame([(t, 700_000)], columns=["received_us", "patience_us"])])
        if rng.random() < 0.3:
            device.pass_(max(0, t - rng.randrange(900_000)) // 1000)
    device.pass_(10**7)
    want = []
    for first, last, n in sessions_by_loop(times, 700_000):
        want += [("d", "became_live", first, first, 0), ("d", "left_live", last + 700_000, first, n)]
    assert device.out == want and not device.handle.timers


def test_live_events_come_when_they_happen():
    device = Device(Sessions(1_000_000))
    device.send([pd.DataFrame([(500_000, 2_000_000), (900_000, 2_000_000)], columns=["received_us", "patience_us"])])
    device.pass_(999)
    assert not device.out
    device.pass_(1000)  # the session is open: it began
    assert [e[1:3] for e in device.out] == [("became_live", 500_000)]
    device.pass_(2900)
    assert len(device.out) == 1
    device.pass_(3000)  # no further frame: the timer of the silence deadline
    assert device.out[1][1:] == ("left_live", 2_900_000, 500_000, 2)


class Counted(Map):
    calls = 0


def _counted(name):
    def call(self, *args):
        Counted.calls += 1
        return getattr(Map, name)(self, *args)

    return call


for _name in ("containsKey", "getValue", "updateValue", "removeKey"):
    setattr(Counted, _name, _counted(_name))


def test_sessions_ask_state_by_pages_not_by_frames(monkeypatch):
    monkeypatch.setattr(Handle, "getMapState", lambda self, name, schema, ttl=None: self.states.setdefault(name, Counted()))
    monkeypatch.setattr(Counted, "calls", 0)
    device, n = Device(Sessions(1_000_000)), 20_000
    # a session of its own for each frame, in slots of their own
    for at in range(0, n, 5000):
        device.send([pd.DataFrame({"received_us": [k * 7_000_000 for k in range(at, at + 5000)], "patience_us": 1_000_000})])
        device.pass_((at + 4000) * 7_000)
    device.pass_(10**9)
    assert len(device.out) == 2 * n and not device.handle.states["waiting"]
    assert device.handle.states["waiting"].most < 10 and Counted.calls < 40


@pytest.mark.parametrize("seed", range(12))
def test_sessions_from_pages_against_a_loop(seed, monkeypatch):
    rng = random.Random(seed)
    monkeypatch.setattr(stateful, "RUN", rng.choice([8, 16, 64]), raising=False)
    monkeypatch.setattr(stateful, "LEAF", rng.choice([2, 4, 8]), raising=False)
    monkeypatch.setattr(stateful, "TOGETHER", rng.choice([1, 3, 100]))
    delay, device = rng.choice([0, 2_000_000, 30_000_000]), Device(Sessions(rng.choice([1_000_000, 250_000])))
    patience = {t: rng.choice([300_000, 700_000, 1_500_000]) for t in (rng.randrange(0, 400) * 100_000 + rng.randrange(3) for _ in range(300))}
    rows = sorted([*patience, *rng.choices([*patience], k=40)], key=lambda t: t + rng.randrange(delay + 1))
    top, taken = 0, []
    while rows:
        size = rng.choice([1, 5, 90])
        part, rows = [t for t in rows[:size] if t >= top * 1000], rows[size:]
        taken += part
        frames = [pd.DataFrame([(t, patience[t]) for t in part[k::3]], columns=["received_us", "patience_us"]) for k in range(3)]
        device.send([f for f in frames if len(f)])
        top = max([top, *((t - delay) // 1000 for t in part)])
        device.pass_(top)
        assert len(device.handle.timers) <= 1
    device.pass_(10**7)
    want, live = [], None
    for t in sorted(taken):
        if live and t - live[1] > live[2]:
            want.append(("d", "left_live", live[1] + live[2], live[0], live[3]))
            live = None
        if not live:
            want.append(("d", "became_live", t, t, 0))
        live = (live[0] if live else t, t, patience[t], live[3] + 1 if live else 1)
    want.append(("d", "left_live", live[1] + live[2], live[0], live[3]))
    assert device.out == want
    # nothing left
    assert not device.handle.timers and not any(s if isinstance(s, Map) else s.exists() and s.get()[0] is not None for n, s in device.handle.states.items())


def test_sorter_holds_pages(monkeypatch):
    monkeypatch.setattr(stateful, "SORTED", 20)
    monkeypatch.setattr(stateful, "PAGE", 4)
    handle, rng = Handle(), random.Random(1)
    rows = [(rng.randrange(1000), k) for k in range(207)]
    assert list(Sorter(handle).ordered(iter(rows))) == sorted(rows)
    pages = handle.states["sorted_pages"]
    assert pages.most == 50 and not pages


@pytest.mark.parametrize("size", [7, 10_000])
def test_estimates_against_steps(size, monkeypatch):
    monkeypatch.setattr(stateful, "SORTED", size)
    monkeypatch.setattr(stateful, "TOGETHER", 9)
    rng = random.Random(3)
    rows, at = [], 0
    for k in range(300):
        at += rng.choice([5_000, 20_000, 20_000, 900_000])
        rows.append((k, at, 0 if k % 11 == 0 else at - rng.randrange(9000), rng.random() < 0.8, "r", 50.0))
    names = ["clock", "rate", "edge", "trend"]
    fields = [f for n in names for f in stateful.ESTIMATORS[n][1]]
    schema = stateful.T.StructType([stateful.T.StructField(c, stateful.T.StringType()) for c in ("pmu_id", "arrival_seq", "received_us")] + fields)
    device = Device(Estimates(names, schema, None, False))
    for k in range(0, 300, 60):
        part = rows[k : k + 60]
        rng.shuffle(part)
        device.send([pd.DataFrame(part[:25], columns=stateful.INPUTS), pd.DataFrame(part[25:], columns=stateful.INPUTS)])
    offset, state, last, ok, kept, want = None, [None, 0, 0.0], None, None, None, []
    decay = (1 - estimators.SMOOTHING) ** estimators.UPDATES_PER_FRAME
    for seq, at, stamp, good, reason, cfg in rows:
        offset = estimators.clock_step(offset, float(at - stamp), decay)
        state = estimators.rate_step(state, stamp, at - last[0] if last else 0, last is None or stamp != last[1], cfg)
        edge = "quality_degraded" if not good and ok is not False else "quality_recovered" if good and ok is False else None
        kept, point = estimators.thin_step(kept, at, estimators.TREND_GAP_US)
        want.append((seq, offset, state[2], edge, reason if edge == "quality_degraded" else None, point))
        last, ok = (at, stamp), good
    got = [(o[1], *o[3:]) for o in device.out]
    clean = lambda rows: [tuple(None if x != x else x for x in r) for r in rows]
    assert clean(got) == clean(want)


def test_edges_only():
    schema = stateful.T.StructType([stateful.T.StructField(c, stateful.T.StringType()) for c in ("pmu_id", "arrival_seq", "received_us", "edge", "reason")])
    device = Device(Estimates(["edge"], schema, None, True))
    said = [(False, "skew"), (False, "skew"), (False, "unsync"), (True, ""), (True, "")]
    device.send([pd.DataFrame([(k, k, k, ok, why, 0.0) for k, (ok, why) in enumerate(said)], columns=stateful.INPUTS)])
    assert [o[3:] for o in device.out] == [("quality_degraded", "skew"), ("quality_recovered", None)]
    # a good first row is no edge
    other = Device(Estimates(["edge"], schema, None, True))
    other.send([pd.DataFrame([(0, 0, 0, True, "", 0.0)], columns=stateful.INPUTS)])
    assert not other.out
