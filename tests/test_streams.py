"""Streams against the batch forms over the same rows."""

import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tickweave.operators import align, estimators, quality, windows
from tickweave.plans import views as v
from tickweave.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def run(spark, tmp_path):
    class Run:
        out = str(tmp_path / "out")

        def land(self, rows, files=3):
            path = str(tmp_path / f"in-{uuid.uuid4().hex[:6]}")
            top = rows.agg(F.max("arrival_seq")).first()[0] + 1
            for i in range(files):
                part = rows.filter(F.floor(F.col("arrival_seq") * files / top) == i)
                part.coalesce(1).write.mode("append").parquet(path)
            return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)

        def take(self, stream, tables, mode="append"):
            jobs.run_now(jobs.write_batches(stream, self.out, str(tmp_path / "state"), tables, mode))

        def table(self, name="rows"):
            return jobs.read_batches(spark, self.out, name)

    return Run()


AS_IS = {"rows": lambda b: b}


def test_estimators_carry_state_over_batches(spark, run):
    # arrivals in receive order, so that thinning by either is the same
    e = F.col("arrival_seq")
    dense = v.frames_dense(spark, SF).withColumn("received_us", F.col("meas_us") + 5_000 + e * 7919 % 3_000)
    rows = dense.withColumn("quality_ok", F.col("arrival_seq") % 100 < 80).withColumn("reject_reason", F.lit("x"))
    run.take(jobs.stream_estimators(run.land(rows)), AS_IS)
    got = {r.arrival_seq: r for r in run.table().collect()}
    offsets = estimators.clock_offset_ema(rows, width=64).select("arrival_seq", "offset_us").collect()
    rates = estimators.fps_estimate(rows, width=64).select("arrival_seq", "approx_fps").collect()
    edges = quality.quality_edges(rows).select("arrival_seq", "type").collect()
    assert len(got) == len(offsets) == len(rates)
    assert all(abs(got[r.arrival_seq].offset_us - r.offset_us) < 1e-3 for r in offsets)
    assert all(abs(got[r.arrival_seq].approx_fps - r.approx_fps) < 1e-9 for r in rates)
    assert {k: r.edge for k, r in got.items() if r.edge} == {r.arrival_seq: r.type for r in edges}
    trends = estimators.thin(rows.withColumn("g", F.lit(100_000)), ["pmu_id"], "received_us", "g", "arrival_seq", width=1_000_000)
    want = {r.arrival_seq for r in trends.select("arrival_seq").collect()}
    assert want == {k for k, r in got.items() if r.trend_point}


def landed(spark, rows, path, part, files=3):
    """One part of the rows by arrival."""
    top = rows.agg(F.max("arrival_seq")).first()[0] + 1
    rows.filter(F.floor(F.col("arrival_seq") * files / top) == part).repartition(2).write.mode("append").parquet(path)


def points_of(rows):
    return sorted((r.tick_us, r.pmu_id, r.arrival_seq) for r in rows.select("tick_us", "pmu_id", "arrival_seq").collect())


def test_aligned_stream_equals_batch_over_a_restart(spark, tmp_path):
    # stamps on quarters of an hour, ticks on half hours: border samples, equal stamps; an even period
    rows = v.frames_edge(spark, SF).select("arrival_seq", "pmu_id", "meas_us", "freq", F.lit(None).cast("long").alias("none"))
    path, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    period, delay = v.HOUR_US // 2, 3 * v.HOUR_US
    devices = rows.select("pmu_id").distinct()
    for part in range(3):  # stopped and started again after each part
        landed(spark, rows, path, part)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
        points = jobs.align_stream(stream, period, f"{delay} microseconds")
        jobs.run_now(jobs.write_batches(points, out, state, jobs.aligned_tables(devices)))
    got = jobs.read_batches(spark, out, "points")
    last = rows.agg(F.max("meas_us")).first()[0]
    seen = (last // 1000 - delay // 1000) * 1000 - period // 2
    want = [p for p in points_of(align.nearest_tick(rows, period)) if p[0] < seen]
    assert points_of(got) == want and len(want) > 300
    assert got.filter("none IS NOT NULL OR freq IS NULL").count() == 0 and got.schema["freq"].dataType == rows.schema["freq"].dataType
    ticks = jobs.read_batches(spark, out, "ticks")
    assert ticks.select("tick_us").distinct().count() == ticks.count() == len({t for t, _, _ in want})


def test_late_samples_open_no_tick_again(spark, tmp_path):
    path, hour = str(tmp_path / "in"), v.HOUR_US
    send = lambda rows: spark.createDataFrame(rows, "arrival_seq long, pmu_id string, meas_us long").coalesce(1).write.mode("append").parquet(path)
    batches = [[(1, "a", 10 * hour), (2, "b", 10 * hour + 5)], [(3, "a", 20 * hour), (4, "b", 20 * hour)], [(5, "a", 10 * hour - 1), (6, "b", 21 * hour)]]
    for rows in batches:
        send(rows)
        stream = spark.readStream.schema("arrival_seq long, pmu_id string, meas_us long").parquet(path)
        points = jobs.align_stream(stream, hour, "2 hours")
        jobs.run_now(jobs.write_batches(points, str(tmp_path / "out"), str(tmp_path / "state"), AS_IS))
    assert points_of(jobs.read_batches(spark, str(tmp_path / "out"), "rows")) == [(10 * hour, "a", 1), (10 * hour, "b", 2)]


def test_session_events_equal_batch(spark, run):
    rows = v.frames(spark, SF).select("arrival_seq", "pmu_id", "received_us")
    run.take(jobs.stream_sessions(run.land(rows), "3 hours"), AS_IS)
    events = run.table().select("pmu_id", "type", "time_us").collect()
    sessions = windows.live_sessions(rows).collect()
    seen = (rows.agg(F.max("received_us")).first()[0] // 1000 - 3 * 3_600_000) // 1000 * 1_000_000
    want = {(s.pmu_id, "became_live", s.became_live_us) for s in sessions if s.became_live_us < seen}
    want |= {(s.pmu_id, "left_live", s.left_live_us) for s in sessions if s.left_live_us < seen}
    assert sorted(map(tuple, events)) == sorted(want) and len(events) > 1000


def test_frames_without_an_arrival_time_belong_to_no_session(spark, run):
    rows = spark.createDataFrame([(k, ["a", None][k % 2], None if k % 5 == 0 else k * 10_000_000) for k in range(60)], "arrival_seq long, pmu_id string, received_us long")
    run.take(jobs.stream_sessions(run.land(rows), "0 seconds"), AS_IS)
    got = sorted(map(tuple, run.table().select("time_us", "type", "pmu_id", "frames").collect()))
    want = [(k * 10_000_000, k % 2) for k in range(60) if k % 5]
    events = [e for t, odd in want for e in ((t, "became_live", [None, "a"][1 - odd], 0), (t + 1_000_000, "left_live", [None, "a"][1 - odd], 1))]
    # the last frame is at the watermark, and no later one moves it
    assert got == sorted(events)[:-2] and len(got) > 90


def test_history_is_written_once(spark, run, tmp_path):
    rows = v.frames(spark, SF)
    stream = run.land(rows)
    run.take(jobs.stream_quality(stream), jobs.history_tables())
    # the same batches again, as after a lost commit: they replace themselves
    jobs.run_now(jobs.write_batches(jobs.stream_quality(stream), run.out, str(tmp_path / "again"), jobs.history_tables()))
    assert run.table("frames").count() == v.gated(spark, SF).count()


def test_edges_of_the_history_equal_batch(spark, run):
    gated = v.gated(spark, SF)
    run.take(jobs.stream_edges(jobs.stream_quality(run.land(v.frames(spark, SF)))), jobs.event_tables())
    got = run.table("events")
    assert got.columns[:4] == ["time_us", "pmu_id", "type", "arrival_seq"]
    want = sorted((r.received_us, r.pmu_id, r.type, r.reason) for r in quality.quality_edges(gated).collect())
    found = got.select("time_us", "pmu_id", "type", F.get_json_object("detail", "$.reason")).collect()
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_latest_state_is_upserted(spark, run, tmp_path):
    rows = spark.createDataFrame([(k, f"d{k % 40}" if k < 160 else "d7", k, k, 50.0, 0) for k in range(200)], "arrival_seq long, pmu_id string, received_us long, meas_us long, freq double, stat int")
    latest = jobs.stream_latest_state(run.land(rows, 5))
    jobs.run_now(jobs.upsert_batches(latest, run.out, str(tmp_path / "state"), "pmu_id", buckets=16))
    got = {r.pmu_id: (r.total_frames, r.arrival_seq) for r in jobs.read_upserts(spark, run.out, latest.schema).collect()}
    want = {f"d{k}": (4, 120 + k) for k in range(40)} | {"d7": (44, 199)}
    assert got == want
    files = {p.name: len(list(p.glob("bucket=*"))) for p in Path(run.out).iterdir() if p.name.startswith("version=")}
    # the first batch writes all buckets, the last, with one device, one
    assert files["version=0"] > 8 and files["version=4"] == 1
    # a batch that is run again replaces its own versions
    jobs.run_now(jobs.upsert_batches(latest, run.out, str(tmp_path / "again"), "pmu_id", buckets=16))
    assert {r.pmu_id: (r.total_frames, r.arrival_seq) for r in jobs.read_upserts(spark, run.out, latest.schema).collect()} == want
