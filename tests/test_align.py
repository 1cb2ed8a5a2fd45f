import random

import pytest
from pyspark.sql import functions as F

from tickweave.operators import align

SCHEMA = "pmu_id string, meas_us long, arrival_seq long"


def publisher(devices: dict[str, list[int]], period: int, flush: bool = False):
    """A tick-by-tick loop: take the nearest sample within half a period, remove it, move on."""
    left = {d: sorted(set(ts)) for d, ts in devices.items()}
    if not flush and any(not ts for ts in left.values()):
        return []
    oldest = min(t for ts in left.values() for t in ts)
    newest = {d: max(ts) if ts else None for d, ts in left.items()}
    head = max(n for n in newest.values() if n is not None) + period if flush else min(newest.values())
    half, tick, out = period // 2, oldest // period * period, []
    while tick <= head:
        for d, ts in left.items():
            near = [t for t in ts if abs(t - tick) <= half]
            if near:
                best = min(near, key=lambda t: (abs(t - tick), t))
                ts.remove(best)
                out.append((tick, d, best))
        tick += period
    return out


def frame(spark, devices):
    rows = [(d, t, i) for d, ts in devices.items() for i, t in enumerate(ts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("period", [2, 3, 4, 5, 8, 10])
def test_nearest_tick_is_what_the_loop_takes(spark, period):
    rng = random.Random(period)
    devices, want = {}, []
    for case in range(400):
        half = period // 2
        base = 1000 * period
        stamps = [
            base + rng.randint(0, 6) * period + (half if rng.random() < 0.5 else rng.randint(0, period - 1))
            for _ in range(rng.randint(1, 9))
        ]
        devices[f"d{case}"] = stamps
        want += publisher({f"d{case}": stamps}, period, flush=True)
    got = align.nearest_tick(frame(spark, devices), period).select("tick_us", "pmu_id", "meas_us").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_border_runs_cross_chunks(spark, monkeypatch):
    # a run of border samples longer than a chunk: all share the fate of the first
    monkeypatch.setattr(align, "TICKS_PER_CHUNK", 4)
    free = [1005 + 10 * i for i in range(30)]
    blocked = [1000, *free]
    got = align.nearest_tick(frame(spark, {"free": free, "blocked": blocked}), 10)
    ticks = {(r.pmu_id, r.meas_us): r.tick_us for r in got.collect()}
    assert all(ticks["free", t] == t - 5 for t in free)
    assert all(ticks["blocked", t] == t + 5 for t in free)


@pytest.mark.parametrize("period", [6, 7, 10])
def test_frontier_matches_the_loop(spark, period):
    rng = random.Random(100 + period)
    for _ in range(6):
        devices = {d: [1000 + rng.randint(0, 60) for _ in range(rng.randint(1, 8))] for d in "abc"}
        readings = frame(spark, devices)
        expected = spark.createDataFrame([(d,) for d in devices], "pmu_id string")
        # periods below 1000 would be read as milliseconds, so times are scaled
        scaled = readings.withColumn("meas_us", F.col("meas_us") * 1000)
        got = align.align_points(scaled, expected, period * 1000).select("tick_us", "pmu_id", "meas_us").collect()
        want = publisher({d: [t * 1000 for t in ts] for d, ts in devices.items()}, period * 1000)
        assert sorted(map(tuple, got)) == sorted(want)


def ticks_of(spark, devices, period):
    ms = {d: [t * 1000 for t in ts] for d, ts in devices.items()}
    expected = spark.createDataFrame([(d,) for d in devices], "pmu_id string")
    ticks = align.align_ticks(align.align_points(frame(spark, ms), expected, period * 1000), expected)
    return [(r.tick_us // 1000, r.reason, r.missing) for r in ticks.orderBy("tick_us").collect()]


def test_complete_and_partial_ticks(spark):
    got = ticks_of(spark, {"a": [1000, 1050, 1100], "b": [1000, 1100]}, 50)
    assert got == [(1000, "complete", []), (1050, "partial", ["b"]), (1100, "complete", [])]


def test_slow_device_holds_the_frontier(spark):
    assert [t for t, _, _ in ticks_of(spark, {"a": [1000, 1050, 2000], "b": [1000]}, 50)] == [1000]
    assert [t for t, _, _ in ticks_of(spark, {"a": [1000, 1050, 2000], "b": [1000, 1050]}, 50)] == [1000, 1050]


def test_stamps_off_the_grid(spark):
    got = ticks_of(spark, {"a": [9159, 9200, 9240, 9280], "b": [9159, 9200, 9240, 9280]}, 40)
    assert [(t, r) for t, r, _ in got] == [(t, "complete") for t in (9160, 9200, 9240, 9280)]


def test_no_output_while_a_device_has_nothing(spark):
    readings = frame(spark, {"a": [1000, 2000]})
    expected = spark.createDataFrame([("a",), ("b",)], "pmu_id string")
    assert align.align_points(readings, expected, 50_000).count() == 0
    assert align.align_points(readings, expected, 50_000, flush=True).count() > 0


def test_sixty_frames_a_second(spark):
    layouts = spark.createDataFrame([("a", 60), ("b", -5)], "pmu_id string, data_rate int")
    assert align.tick_period_us(layouts).first().period_us == 16667
    unknown = spark.createDataFrame([("a", 0)], "pmu_id string, data_rate int")
    assert align.tick_period_us(unknown).first().period_us == 50_000
    stamps = [1_700_000_000_000_000 + i * 1_000_000 // 60 for i in range(61)]
    one = spark.createDataFrame([("a",)], "pmu_id string")
    assert align.align_points(frame(spark, {"a": stamps}), one, 16667).count() >= 59


def test_last_arrival_wins(spark):
    rows = spark.createDataFrame([("a", 1000, 1, 50.0), ("a", 1000, 2, 51.0)], SCHEMA + ", freq double")
    assert align.dedupe_latest(rows).first().freq == 51.0
    assert align.nearest_tick(rows, 5).first().freq == 51.0
    assert align.nearest_tick(rows, 16).first().freq == 51.0
