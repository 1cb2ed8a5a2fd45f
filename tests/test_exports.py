"""Limits that used to cut silently, and the buffer sheet in files."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tickweave.operators import align, exports, windows
from tickweave.plans import views as v
from tests.conftest import SF


def test_buffer_sheet_can_be_written(spark, tmp_path):
    sheet = entry.queries()["export_buffer_sheet"](spark, SF)
    assert sheet.columns[: len(exports.SHEET_COLUMNS)] == exports.SHEET_COLUMNS and len(exports.SHEET_COLUMNS) == 65
    assert len({c.lower() for c in sheet.columns}) == len(sheet.columns) > len(exports.SHEET_COLUMNS)
    n = sheet.count()
    assert n > 0
    sheet.write.parquet(str(tmp_path / "p"))
    sheet.write.csv(str(tmp_path / "c"), header=True)
    back = spark.read.parquet(str(tmp_path / "p"))
    assert back.count() == n == spark.read.csv(str(tmp_path / "c"), header=True).count()
    off = F.abs(F.hypot("va_real", "va_imag") - F.col("va_mag")) > 1e-6 * F.greatest(F.lit(1.0), F.col("va_mag"))
    assert back.filter(off).count() == 0


def test_sheet_names_differ_without_case():
    got = exports.sheet_names(["VA", "va", "ch_VA", "x"], exports.SHEET_COLUMNS)
    assert len({c.lower() for c in got.values()}) == 4 and got["x"] == "ch_x"


def test_whole_tape_is_numbered(spark):
    frames = v.frames(spark, SF)
    n = frames.count()
    for limit in (0, -1, 10**6):
        got = windows.frame_filter_tail(frames, limit).orderBy("arrival_seq").select("index").collect()
        assert [r["index"] for r in got] == list(range(1, n + 1))
    assert windows.frame_filter_tail(frames, 7).agg(F.max("arrival_seq")).first()[0] == frames.agg(F.max("arrival_seq")).first()[0]


def test_more_than_the_shown_numbers(spark):
    ticks = spark.range(1000).select(F.col("id").alias("tick_us"))
    assert windows.last_n_ticks(ticks, 700).count() == 700
    rows = spark.range(6000).select(F.lit("a").alias("pmu_id"), F.col("id").alias("meas_us"))
    assert windows.last_n_per_device(rows, 5500).count() == 5500


def test_repeated_and_blank_analog_names(spark):
    point = spark.createDataFrame(
        [(0, "a", 50.0, [1.0, 2.0, 3.0, 4.0], ["MW", "", "MW", "Q"]), (0, "b", 50.0, [], [])],
        "tick_us long, pmu_id string, freq double, analogs array<double>, analog_names array<string>",
    )
    got = {r.pmu_id: r.analogs for r in align.point_measures(point).collect()}
    assert got == {"a": {"MW": 3.0, "Q": 4.0}, "b": {}}
