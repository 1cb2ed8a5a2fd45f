"""Hand-computed values for single functions."""

import struct

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickweave.functions import bits, fleet, layout, phasor, registry
from tickweave.operators import decode, estimators, latency, quality


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(n) for n, c in cols.items())).first()


def test_crc_check_value():
    assert decode.crc_of_batch(pa.array([b"123456789", None, b""], pa.binary())).to_pylist() == [0x29B1, None, 0xFFFF]


def test_stat_word(spark):
    r = one(spark, **bits.stat_fields(F.lit(0b10_1_1_0_1_1010_10_0111)))
    assert (r.data_error_code, r.data_error, r.cfg_change, r.trigger, r.sort_by_arrival, r.sync_unlocked) == (2, True, True, True, False, True)
    assert (r.pmu_time_quality, r.unlocked_duration, r.trigger_reason) == (10, 2, 7)


def test_time_quality(spark):
    r = one(spark, **bits.time_quality_fields(F.lit(0x7A << 24).cast("bigint")))
    assert (r.msg_tq_raw, r.tq_reserved, r.leap_second_direction, r.leap_second_occurred, r.leap_second_pending, r.time_quality_code) == (
        0x7A, False, True, True, True, 10)


@pytest.mark.parametrize("value", [110.0, -0.15625, 0.0, 1e-40, 3.4e38, float("inf")])
def test_float32_bits(spark, value):
    word = struct.unpack(">I", struct.pack(">f", value))[0]
    assert one(spark, v=bits.float32_from_bits(F.lit(word).cast("bigint"))).v == struct.unpack(">f", struct.pack(">f", value))[0]


def test_payload_of_a_float_layout(spark):
    # 6 float phasors, float frequency, 2 float analogs, 3 digital words
    assert one(spark, n=layout.payload_bytes(F.lit(0x0F), F.lit(6), F.lit(2), F.lit(3))).n == 2 + 48 + 8 + 8 + 6


@pytest.mark.parametrize(
    ("name", "cls"),
    [("VA", "va"), ("V1", "va"), ("VAN", "va"), ("PHASOR CH 1:V1", "va"), ("CH1:IA", "ia"), ("I1", "ia"), ("PZR.BV", "vb"),
     ("x-CI", "ic"), ("MW", ""), ("", ""), ("Line V3", "vc"), ("IB_2", "ib")],
)
def test_channel_class(spark, name, cls):
    assert one(spark, c=phasor.channel_class(F.lit(name))).c == cls


def test_nominal_snaps_to_the_other_band(spark):
    n = lambda f, fnom, fl: one(spark, n=phasor.nominal_hz(F.lit(f), F.lit(fnom), F.lit(fl))).n
    assert n(59.9, 50, True) == 60 and n(59.9, 50, False) == 50 and n(50.2, 0, True) == 50 and n(53.0, 50, True) == 50


@pytest.mark.parametrize(("rate", "us"), [(60, 1_000_000), (1, 3_000_000), (0, 1_000_000), (-5, 15_000_000), (-60, 30_000_000)])
def test_liveness(spark, rate, us):
    assert one(spark, t=fleet.liveness_timeout_us(F.lit(rate))).t == us


def test_india_clock_face(spark):
    us = 1_700_000_000_000_000 // 86_400_000_000 * 86_400_000_000 + (15 * 60 + 14) * 60_000_000
    for tz in ("IST", "UTC+05:30"):
        got = one(spark, t=registry.reinterpret_us(F.lit(us), registry.normalize_tz(F.lit(tz)))).t
        assert got == us - (5 * 60 + 30) * 60_000_000


@pytest.mark.parametrize(
    ("measured", "cfg", "want"), [(199.0, 200.0, 200.0), (189.0, 200.0, 189.0), (28.0, 30.0, 30.0), (26.0, 30.0, 26.0), (48.0, 0.0, 48.0)]
)
def test_rate_snap(spark, measured, cfg, want):
    assert one(spark, v=fleet.snap_fps(F.lit(measured), F.lit(cfg))).v == want == estimators.snap_rate(measured, cfg)


def test_p95_is_nearest_rank(spark):
    rows = spark.createDataFrame([("p", "parse", i, float(i)) for i in range(1, 11)], "pmu_id string, stage string, seq long, ms double")
    r = latency.hop_stats(rows).first()
    assert (r.p95_ms, r.avg_ms, r.max_ms, r["count"]) == (10.0, 5.5, 10.0, 10)


def gate(spark, **kw):
    row = {"meas_us": 10_000_000, "received_us": 10_000_000, "stat": 0, "freq": 50.0, **kw}
    df = spark.createDataFrame([tuple(row.values())], "meas_us long, received_us long, stat int, freq double")
    return quality.quality_gate(df).first()


def test_gate(spark):
    assert gate(spark).quality_ok
    assert gate(spark, stat=1 << 10).reject_reason == "PMU unsynchronized (STAT bit 10)"
    assert gate(spark, received_us=40_500_000).reject_reason == "timestamp skew too high: 30.5s"
    assert gate(spark, received_us=15_000_000).quality_ok  # exactly the limit passes
    assert gate(spark, received_us=3_735_000_000).reject_reason == "timestamp skew too high: 1h2m5s"
    assert gate(spark, stat=2 << 14).reject_reason == "bad status flag: 2"
    assert gate(spark, freq=float("nan")).reject_reason.startswith("frequency out of range")
    assert gate(spark, freq=44.9).reject_reason == "frequency out of range: 44.900"


def data_frame(payload: bytes) -> bytes:
    body = struct.pack(">HHHII", 0xAA01, 14 + len(payload) + 2, 7, 1_700_000_000, 0x0A000000 | 250_000) + payload
    return body + struct.pack(">H", decode.crc_of_batch(pa.array([body], pa.binary()))[0].as_py())


def decoded(spark, payload, fmt, names, phnmr, annmr=0, dgnmr=0, factor=0.01, fnom=50):
    unit = F.array(*[F.struct(F.lit(0).alias("kind"), F.lit(factor).alias("factor"))] * max(phnmr, annmr, 1))
    lay = spark.range(1).select(
        F.lit("p").alias("pmu_id"), F.lit(0).cast("bigint").alias("received_us"), F.lit(1_000_000).alias("time_base"), F.lit(fmt).alias("format"),
        F.lit(phnmr).alias("phnmr"), F.lit(annmr).alias("annmr"), F.lit(dgnmr).alias("dgnmr"), F.lit(fnom).alias("fnom"),
        F.array(*map(F.lit, names)).alias("channels"), unit.alias("ph_units"), unit.alias("an_units"), F.lit(None).cast("int").alias("payload_bytes"),
    )
    raw = spark.createDataFrame([(1, "p", 5, data_frame(payload))], "arrival_seq long, pmu_id string, received_us long, raw binary")
    return decode.decode_data(decode.join_layout_asof(raw, decode.prepare_layouts(lay), decode.LAYOUT_OF_FRAME)).first()


def test_float_polar_frame(spark):
    r = decoded(spark, struct.pack(">Hffff", 0, 110.0, 1.5707963, 60.01, 0.25), 0x0B, ["V1"], 1)
    assert r.error is None and r.va_mag == 110.0 and abs(r.va_deg - 90) < 1e-4 and abs(r.freq - 60.01) < 1e-5
    assert r.fnom == 60 and r.meas_us == 1_700_000_000_250_000 and r.time_quality == 10


def test_int_polar_frame(spark):
    r = decoded(spark, struct.pack(">HHhhh", 0, 1000, 15708, 10, 5), 0x01, ["VA"], 1, fnom=60)
    assert abs(r.va_mag - 10) < 1e-9 and abs(r.va_deg - 90) < 1e-3 and abs(r.freq - 60.01) < 1e-9 and abs(r.rocof - 0.05) < 1e-9


def test_int_rect_and_float_rect_frames(spark):
    r = decoded(spark, struct.pack(">HhhhhhH", 0, 300, -400, 0, 0, -25, 9), 0x00, ["VA", "Analog1"] + [f"D{i}" for i in range(16)], 1, 1, 1)
    assert abs(r.va_mag - 5) < 1e-9 and abs(r.va_deg + 53.1301) < 1e-3 and abs(r.mw + 0.25) < 1e-9 and r.digitals == [9]
    r = decoded(spark, struct.pack(">Hffhhf", 0, 3.0, 4.0, 0, 0, 7.5), 0x06, ["VA", "A"], 1, 1)
    assert abs(r.va_mag - 5) < 1e-6 and r.analogs == [7.5]


def test_bad_frames_come_back_with_a_reason(spark):
    short = decoded(spark, struct.pack(">HHhh", 0, 1, 1, 1), 0x01, ["VA"], 1)
    assert short.error == "payload length 8 != expected 10" and short.freq is None


def layout_frame(blocks: list[bytes], version: int = 1, tail: bytes = b"") -> bytes:
    payload = struct.pack(">IH", 0x05000000 | 1_000_000, len(blocks)) + b"".join(blocks) + struct.pack(">h", -5) + tail
    return struct.pack(">HHHII", 0xAA30 | version, 16 + len(payload), 1, 0, 0) + payload + b"\0\0"


def block(name: bytes, channels: list[bytes]) -> bytes:
    names = b"".join(c.ljust(16, b"\0") for c in channels)
    return name.ljust(16) + struct.pack(">5H", 9, 1, len(channels), 0, 0) + names + struct.pack(f">{len(channels)}I", *[1000] * len(channels)) + struct.pack(">2H", 1, 3)


def test_layout_of_several_devices():
    got = decode.read_layout(layout_frame([block(b"ONE", [b"VA", b"IA"]), block(b"TWO", [b"VA"])]))
    assert (got["station"], got["channels"], got["data_rate"], got["num_pmu"], got["time_base"]) == ("ONE", ["VA", "IA"], -5, 2, 1_000_000)
    assert (got["block_bytes"], got["payload_bytes"], got["fnom"]) == (14, 24, 50)
    assert abs(got["ph_units"][0]["factor"] - 0.01) < 1e-12


@pytest.mark.parametrize(
    ("frame", "why"),
    [(b"\xaa\x31" + b"\0" * 20, "not a CFG2"), (layout_frame([block(b"A", [b"VA"])], version=3), "version 3"),
     (layout_frame([block(b"A", [b"VA"])], tail=b"\0\0"), "trailing"), (layout_frame([block(b"A", [b"VA"])])[:-6] + b"\0\0", "truncated")],
)
def test_unreadable_layouts(frame, why):
    with pytest.raises(ValueError, match=why):
        decode.read_layout(frame)


def test_quality_edges(spark):
    rows = [("a", i, i, ok, None if ok else "bad") for i, ok in enumerate([False, False, False, True, True])]
    rows += [("b", 9, 9, True, None)]
    df = spark.createDataFrame(rows, "pmu_id string, arrival_seq long, received_us long, quality_ok boolean, reject_reason string")
    got = [(r.pmu_id, r.type) for r in quality.quality_edges(df).orderBy("arrival_seq").collect()]
    assert got == [("a", "quality_degraded"), ("a", "quality_recovered")]


def test_display_labels_computed_once(spark):
    names = [["IA", "bus.av", None, "Y", "x:V2", "VB", "q:", ""], [], None]
    rows = spark.createDataFrame([(x,) for x in names], "names array<string>").withColumn("known", layout.display_labels("names"))
    want = (["VA", "VB", "VB", "IA", None, "Y", "q:", ""], "IA, VA (bus.av), Y, VB (x:V2), VB, q:, ")
    for known in (None, "known"):
        got = rows.select(F.col("names"), F.transform(layout.display_order("names", known), lambda t: t["label"]), layout.cfg_list_text("names", known))
        assert [tuple(r)[1:] for r in got.collect()] == [want, ([], ""), (None, None)]
    # a name is stripped once for either form, however often its label is mentioned
    for form in (layout.display_order("names"), layout.cfg_list_text("names")):
        plan = rows.select(form.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.split("Project")[1].count("regexp_replace(") == 1
