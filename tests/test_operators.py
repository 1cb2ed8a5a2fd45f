"""Operators over small tables: address book, history, advice, folds on Spark."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.operators import estimators, history, registry, windows
from tickweave.sources import tables

BOOK = "name string, ip string, port int, protocol string, station string, timestamp_tz string, active boolean"


def test_upsert_keeps_what_is_not_given(spark):
    old = spark.createDataFrame([("1.1.1.1:5", "1.1.1.1", 5, "tcp", "OLD", "UTC", False), ("2.2.2.2:5", "2.2.2.2", 5, "tcp", "B", "", True)], BOOK)
    new = spark.createDataFrame([("1.1.1.1:5", "1.1.1.1", 5, "tcp", "", "", True), ("3.3.3.3:5", "3.3.3.3", 5, "tcp", "C", "", True)], BOOK)
    got = {r.name: r for r in registry.registry_upsert(old, new, F.lit(7)).collect()}
    assert (got["1.1.1.1:5"].station, got["1.1.1.1:5"].timestamp_tz, got["1.1.1.1:5"].active) == ("OLD", "UTC", True)
    assert got["2.2.2.2:5"].station == "B" and got["3.3.3.3:5"].station == "C" and len(got) == 3


def test_migration_of_nicknames(spark):
    rows = [("x", "1.1.1.1", 5, "tcp", "", "", True), ("y", "1.1.1.1", 5, "tcp", "", "", True), ("z", "2.2.2.2", 5, "udp", "", "", True),
            ("udp:2.2.2.2:5", "2.2.2.2", 5, "udp", "", "", True), ("off", "9.9.9.9", 5, "tcp", "", "", False)]
    got = {(r.name, r.active) for r in registry.identity_migration(spark.createDataFrame(rows, BOOK)).collect()}
    assert got == {("1.1.1.1:5", True), ("y", False), ("z", False), ("udp:2.2.2.2:5", True), ("off", False)}


def test_layout_versions_keep_their_ids(spark):
    schema = "pmu_id string, layout_hash string, received_us long, station string, raw_cfg string"
    first = spark.createDataFrame([("a", "h1", 1, "S1", "r1"), ("b", "h1", 2, "S", None)], schema)
    known = history.cfg_version_upsert(first)
    later = spark.createDataFrame([("a", "h1", 9, "S2", None), ("a", "h2", 10, "S3", "r3")], schema)
    got = {(r.pmu_id, r.layout_hash): r for r in history.cfg_version_upsert(later, known).collect()}
    assert {k: r.cfg_id for k, r in got.items()} == {("a", "h1"): 1, ("b", "h1"): 2, ("a", "h2"): 3}
    assert (got["a", "h1"].station, got["a", "h1"].raw_cfg) == ("S2", "r1")


def test_lifecycle(spark):
    rows = spark.createDataFrame([(1, "a", "start"), (2, "a", "stop")], "seq long, pmu_id string, action string")
    got = [r.type for r in windows.lifecycle_events(rows).orderBy("seq", "step").collect()]
    assert got == ["operator_start", "operator_stop", "left_live"]


def test_layout_request_after_a_flag(spark):
    s = 1_000_000
    flags = spark.createDataFrame([("a", 10 * s), ("a", 11 * s), ("a", 30 * s), ("b", 5 * s)], "pmu_id string, received_us long")
    sent = spark.createDataFrame([("a", 11 * s + 500_000), ("b", 9 * s)], "pmu_id string, received_us long")
    got = {(r.pmu_id, r.flag_us // s): (r.flagged, r.request_us and r.request_us // s) for r in windows.cfg_change_requests(flags, sent).collect()}
    # a layout within two seconds answers the first flag of a; the later one and b's are asked for
    assert got == {("a", 10): (2, None), ("a", 30): (1, 32), ("b", 5): (1, 7)}


@pytest.mark.parametrize("width", [50, 1000])
def test_clock_offset_on_spark(spark, width):
    rng = random.Random(6)
    rows = [("hot" if rng.random() < 0.8 else "cold", i, 10**15, 10**15 + rng.choice([0, 70_000_000, 2 * 10**11]) + rng.randint(0, 10**6)) for i in range(900)]
    df = spark.createDataFrame(rows, "pmu_id string, arrival_seq long, meas_us long, received_us long")
    got = {r.arrival_seq: r.offset_us for r in estimators.clock_offset_ema(df, width=width).collect()}
    state = {}
    for pmu, seq, meas, received in rows:
        state[pmu] = estimators.clock_step(state.get(pmu), float(received - meas), 0.95**2)
        want = state[pmu]
        assert (got[seq] is None) == (want is None) and (want is None or np.isclose(got[seq], want, rtol=1e-9))


@pytest.mark.parametrize("mode", ["greedy", "bucket"])
def test_trend_points(spark, mode):
    df = spark.createDataFrame([("a", i, i * 40_000) for i in range(50)], "pmu_id string, arrival_seq long, received_us long")
    got = sorted(r.arrival_seq for r in estimators.trend_downsample(df, mode=mode).collect())
    assert got == (list(range(0, 50, 3)) if mode == "greedy" else sorted({min(i for i in range(50) if i * 40_000 // 100_000 == b) for b in range(20)}))


def test_history_table_prunes_hours(spark, tmp_path):
    from tickweave.plans import views as v

    path = str(tmp_path / "h")
    rows = history.frame_history(v.gated(spark, "/root/testdata/sf0.001"))
    tables.write_frame_history(rows, path)
    lo, hi = v.V1_US + 30 * v.HOUR_US, v.V1_US + 200 * v.HOUR_US
    found = tables.read_history(spark, path, pmu="10.0.0.3:4712", from_us=lo, to_us=hi)
    want = rows.filter((F.col("time_us") >= lo) & (F.col("time_us") < hi) & (F.col("pmu_id") == "10.0.0.3:4712"))
    assert found.count() == want.count() > 0
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(hour" in plan and "PushedFilters: [IsNotNull(time_us)" in plan


def scanned(df):
    """Rows that the Parquet reader hands on: those of row groups it hasn't skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    while leaves.apply(0).nodeName().startswith(("AdaptiveSparkPlan", "ShuffleQueryStage", "ResultQueryStage")):
        leaves = (leaves.apply(0).executedPlan() if leaves.apply(0).nodeName().startswith("Adaptive") else leaves.apply(0).plan()).collectLeaves()
    return leaves.apply(0).metrics().apply("numOutputRows").value()


def test_history_of_a_device_skips_row_groups_of_others(spark, tmp_path):
    path, hour = str(tmp_path / "h"), 3_600_000_000
    # half of all rows are one device's
    rows = spark.range(20_000).selectExpr("id AS n", "IF(id % 2 = 0, 'd00', format_string('d%02d', id % 40)) AS pmu_id", f"{500 * hour} + id * 100000 AS time_us", "true AS quality_ok")
    tables.write_frame_history(rows, path)
    files = list((tmp_path / "h").glob("hour=*/*.parquet"))
    assert 3 <= len(files) <= 8
    assert tables.read_history(spark, path, pmu="d00").count() == 10_000 and tables.read_history(spark, path, pmu="d07").count() == 500
    # without the order of a read, which looks at its rows twice
    read = lambda pmu: spark.read.parquet(path).filter(F.col("pmu_id") == pmu)
    assert max(scanned(read(f"d{k:02d}")) for k in (0, 7, 11, 23)) < 15_000
    assert sum(scanned(read(f"d{k:02d}")) for k in range(1, 40, 2)) < 0.6 * 20 * 20_000
    # a name between others': the range can't tell, the Bloom filter does
    assert scanned(read("d07x")) == 0
    busiest = max(spark.read.parquet(str(f)).count() for f in files)
    assert busiest <= 0.5 * 20_000  # the four tasks of this session


def test_measured_rate_is_the_last_estimate(spark):
    from tickweave.plans import views as v

    dense = v.frames_dense(spark, "/root/testdata/sf0.001").withColumn("data_rate", F.lit(0))
    want = {r.pmu_id: r.f for r in estimators.fps_estimate(dense).groupBy("pmu_id").agg(F.max_by("approx_fps", "arrival_seq").alias("f")).collect()}
    for width in (64, 1 << 17):
        got = {r.pmu_id: r.measured_fps for r in estimators.measured_fps(dense, width=width).collect()}
        assert got.keys() == want.keys() and all(abs(got[d] - want[d]) < 1e-9 and got[d] > 20 for d in want)
