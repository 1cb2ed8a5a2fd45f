"""The chunked folds against their row-by-row definitions, without Spark."""

import json
import random

import numpy as np
import pandas as pd

from tickweave.operators import estimators as e


def chunked(fold, chunks):
    """What the three Spark steps do, in one process, through the same JSON texts."""
    states, state = [], None
    for c in chunks:
        states.append(json.loads(json.dumps(state)))
        state = fold.advance(states[-1], json.loads(json.dumps(fold.summarize(c))))
    parts = [fold.apply(c, s) for c, s in zip(chunks, states)]
    return {k: np.concatenate([p[k] for p in parts]) for k in parts[0]}


def cut(pdf, rng):
    at = sorted(rng.sample(range(1, len(pdf)), min(len(pdf) - 1, rng.randint(1, 6)))) if len(pdf) > 1 else []
    edges = [0, *at, len(pdf)]
    return [pdf.iloc[a:b] for a, b in zip(edges, edges[1:])]


def thin_parts(t, gap, rng):
    """Rows the way ``thin`` splits them: sure ones, and chunks of open ones with the row before."""
    before = np.append(-(10**15), t[:-1])
    sure = t - before >= gap
    pdf = pd.DataFrame({"_t": t, "_before": before, "_gap": gap})[~sure]
    return sure, cut(pdf, rng) if len(pdf) else []


def thinned(t, gap, rng):
    sure, parts = thin_parts(t, gap, rng)
    keep = sure.copy()
    if parts:
        keep[~sure] = chunked(e.THIN, parts)["_keep"]
    return keep.tolist()


def test_thinning_matches_definition():
    rng = random.Random(1)
    for _ in range(600):
        gap = rng.choice([1, 5, 100])
        step = rng.choice([1, 3, 40, 200])
        t = np.cumsum([rng.randint(0, step) for _ in range(rng.randint(1, 80))])
        last, want = None, []
        for x in t.tolist():
            last, keep = e.thin_step(last, x, gap)
            want.append(keep)
        assert thinned(t, gap, rng) == want


def test_thinning_of_a_regular_stream():
    # 40 ms stamps, 100 ms gap: every third row, in a phase that never resynchronises
    kept = thinned(np.arange(1000) * 40, 100, random.Random(4))
    assert np.flatnonzero(kept).tolist() == list(range(0, 1000, 3))


def test_clock_offset_matches_definition():
    rng = random.Random(2)
    decay = 0.95**2
    for _ in range(300):
        level, xs = 0.0, []
        for _ in range(rng.randint(1, 120)):
            if rng.random() < 0.05:
                level = rng.choice([0, 59e6, 61e6, -7.2e9, 3e10, 2e11])
            xs.append(level + rng.uniform(-4e7, 4e7))
        pdf = pd.DataFrame({"_sample": xs})
        off, want = None, []
        for x in xs:
            off = e.clock_step(off, x, decay)
            want.append(np.nan if off is None else off)
        got = chunked(e._clock_fold(decay), cut(pdf, rng))["offset_us"]
        np.testing.assert_allclose(got.astype(float), want, rtol=1e-9, atol=1e-3)


def test_clock_summary_forgets_its_entry():
    s = e._clock_summary(np.array([1000.0] * 2000), 0.95**2)
    assert s["scale"] == 0.0 and len(s["falls"]) < 100


def test_rate_matches_definition():
    rng = random.Random(3)
    for case in range(300):
        fps = rng.choice([5, 10, 25, 30])
        cfg = rng.choice([0.0, 25.0, 30.0, 12.0])
        meas, recv, rows = 0, 0, []
        for _ in range(rng.randint(1, 250)):
            kind = rng.random()
            step = int(1e6 / fps)
            if kind < 0.03:
                step = rng.choice([-5_000_000, 3_000_000, 0])
            elif kind < 0.1:
                step = 0
            meas += step + (rng.randint(-2000, 2000) if step > 0 and case % 3 else 0)
            gap = 800_000 if rng.random() < 0.02 else 30_000
            recv += gap
            rows.append((meas, float(gap)))
        pdf = pd.DataFrame(rows, columns=["meas_us", "_gap"])
        pdf["_new"] = pdf["meas_us"].diff().fillna(1) != 0
        pdf["_cfg"] = cfg
        state, want = [None, 0, 0.0], []
        for m, g, w, c in pdf.itertuples(index=False):
            state = e.rate_step(state, int(m), g, bool(w), c)
            want.append(state[2])
        got = chunked(e.RATE, cut(pdf, rng))["approx_fps"]
        np.testing.assert_allclose(got, want, rtol=1e-9, atol=1e-9)


def test_rate_by_measurement_time():
    # 200 frames a second by their stamps, whatever the bursts they arrive in
    meas = 1_700_000_000_000_000 + np.arange(401) * 5000
    pdf = pd.DataFrame({"meas_us": meas, "_gap": 0.0, "_new": True, "_cfg": 200.0})
    assert e.RATE.apply(pdf, None)["approx_fps"][-1] == 200.0
