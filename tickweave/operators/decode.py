"""Raw C37.118 frames to readings, as projections over a BINARY column.

Header fields, verdicts and derived measures are Spark expressions, so a filter on device
or hour still reaches the scan. Python sees Arrow batches in two places: checksum and
measurements of DATA frames, read with array arithmetic over all frames of one shape, and
the rare layout frames, whose blocks have to be walked one after another.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickweave.functions import bits, layout, phasor
from tickweave.operators.chunked import HOUR_US, forward_fill

# --- fixed values: frame geometry and the checksum polynomial ---
SYNC_BYTE = 0xAA
HEADER_BYTES, CRC_BYTES, MIN_FRAME = 14, 2, 16
CRC_SEED, CRC_POLY = 0xFFFF, 0x1021
MIN_CFG2 = 40


def _crc_table() -> np.ndarray:
    """Effect of each top byte, from the polynomial."""
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, (table << 1) ^ CRC_POLY, table << 1) & 0xFFFF
    return table


CRC_TABLE = _crc_table()


def _bytes_of(raw: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all bytes, start, size) of a BINARY array; a NULL has size -1."""
    raw = raw.cast(pa.binary()) if not pa.types.is_binary(raw.type) else raw
    _, offsets, data = raw.buffers()
    ends = np.frombuffer(offsets, dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1].astype(np.int64)
    size = np.where(raw.is_valid().to_numpy(zero_copy_only=False), np.diff(ends), -1)
    flat = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat, ends[:-1], size


def _crc_of_block(block: np.ndarray) -> np.ndarray:
    """Checksum of each row of a byte matrix; all rows advance together."""
    crc = np.full(len(block), CRC_SEED, dtype=np.uint32)
    for j in range(block.shape[1]):
        crc = ((crc << 8) & 0xFFFF) ^ CRC_TABLE[(crc >> 8) ^ block[:, j]]
    return crc


def crc_of_batch(parts: pa.Array) -> pa.Array:
    """Checksum of each byte string, grouped by length."""
    flat, start, size = _bytes_of(parts)
    out = np.zeros(len(parts), dtype=np.int32)
    for n in np.unique(size[size >= 0]):
        at = np.flatnonzero(size == n)
        out[at] = _crc_of_block(flat[start[at][:, None] + np.arange(n)])
    return pa.array(out, mask=size < 0)


@F.arrow_udf(T.IntegerType())
def crc16(parts: pa.Array) -> pa.Array:
    """CRC-CCITT of a BINARY column."""
    return crc_of_batch(parts)


def body_crc(raw: str = "raw") -> Column:
    """Checksum over all but the last two bytes."""
    size = F.length(raw)
    return crc16(F.substring(F.col(raw), F.lit(1), F.greatest(size - CRC_BYTES, F.lit(0))))


def frame_envelope(raw_frames: DataFrame) -> DataFrame:
    """Header fields of each frame; a frame too short to have them gets zeros."""
    whole = F.length("raw") >= HEADER_BYTES
    field = lambda pos, n: F.when(whole, bits.be_uint("raw", pos, n)).otherwise(F.lit(0))
    return raw_frames.select(
        "*",
        field(0, 2).cast("int").alias("sync_word"),
        field(2, 2).cast("int").alias("frame_size"),
        field(4, 2).cast("int").alias("idcode"),
        field(6, 4).cast("bigint").alias("soc"),
        field(10, 4).cast("bigint").alias("fracsec_raw"),
        field(10, 4).bitwiseAND(F.lit(bits.FRACTION_MASK)).cast("bigint").alias("fracsec_count"),
    )


def frame_route(raw_frames: DataFrame) -> DataFrame:
    """Add ``frame_type``; split by filtering on it."""
    kind = F.when(F.length("raw") >= 2, bits.frame_kind(bits.be_uint("raw", 1, 1))).otherwise("UNKNOWN(0xFF)")
    return raw_frames.withColumn("frame_type", kind)


def _hex4(c: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(c), 4, "0"))


def frame_validate(packets: DataFrame) -> DataFrame:
    """Add ``error`` (NULL for a good frame) and cut ``raw`` to the size its header gives."""
    size = bits.be_uint("raw", 2, 2).cast("int")
    have = F.length("raw")
    sync = bits.be_uint("raw", 0, 1)
    early = (
        F.when(F.col("raw").isNull() | (have < MIN_FRAME), F.concat(F.lit("datagram too short: "), F.coalesce(have, F.lit(0)).cast("string"), F.lit(" (min 16)")))
        .when(sync != SYNC_BYTE, F.concat(F.lit("invalid SYNC byte: 0x"), F.lpad(F.hex(sync), 2, "0")))
        .when(size < MIN_FRAME, F.concat(F.lit("frame size too small: "), size.cast("string"), F.lit(" (min 16)")))
        .when(have < size, F.format_string("datagram truncated: have %d want %d", have, size))
    )
    cut = packets.withColumn("_early", early).withColumn(
        "raw", F.when(F.col("_early").isNull(), F.substring(F.col("raw"), F.lit(1), size)).otherwise(F.col("raw"))
    )
    want = bits.be_uint("raw", F.length("raw") - CRC_BYTES, CRC_BYTES).cast("int")
    checked = cut.withColumn("_want", want).withColumn("_got", body_crc())
    bad_crc = F.when(
        F.col("_want") != F.col("_got"),
        F.concat(F.lit("CRC mismatch: want "), _hex4(F.col("_want")), F.lit(" got "), _hex4(F.col("_got"))),
    )
    return checked.withColumn("error", F.coalesce("_early", bad_crc)).drop("_early", "_want", "_got")


def decode_header_text(frames: DataFrame) -> DataFrame:
    """Text of header frames: up to the first NUL, printable characters, trimmed."""
    size = bits.be_uint("raw", 2, 2).cast("int")
    kind = bits.be_uint("raw", 1, 1).bitwiseAND(F.lit(0x70))
    have = F.length("raw")
    error = (
        F.when(have < MIN_FRAME, F.concat(F.lit("header frame too short: "), have.cast("string")))
        .when(size != have, F.format_string("header frame size mismatch: header=%d actual=%d", size, have))
        .when(kind != 0x10, F.concat(F.lit("not a header frame: sync type=0x"), F.lpad(F.hex(kind), 2, "0")))
    )
    body = F.decode(F.substring(F.col("raw"), F.lit(HEADER_BYTES + 1), have - HEADER_BYTES - CRC_BYTES), "ISO-8859-1")
    printable = F.regexp_replace(F.substring_index(body, "\x00", 1), r"[^\n\r\t\x20-\x7e\xa1-\xac\xae-\xff]", "")
    trimmed = F.regexp_replace(printable, r"^[\s]+|[\s]+$", "")
    return frames.withColumn("error", error).withColumn("text", F.when(error.isNull(), trimmed))


def change_flagged(frames: DataFrame) -> DataFrame:
    """DATA frames whose STAT word announces a layout change."""
    data = (F.length("raw") >= MIN_FRAME) & (bits.be_uint("raw", 1, 1).bitwiseAND(F.lit(0x70)) == 0)
    return frames.filter(data & bits.flag_at(bits.be_uint("raw", HEADER_BYTES, 2), 13))


# ------------------------------------------------------------------ layout frames (CFG-2)

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


_INT, _TEXT = T.IntegerType(), T.StringType()
_UNITS = T.ArrayType(_struct(kind=_INT, factor=T.DoubleType()))
LAYOUT_SCHEMA = _struct(
    pmu_id=_TEXT, received_us=T.LongType(), error=_TEXT, station=_TEXT, idcode=_INT, sync_word=_INT,
    time_base=T.LongType(), num_pmu=_INT, format=_INT, phnmr=_INT, annmr=_INT, dgnmr=_INT, fnom=_INT, cfg_cnt=_INT,
    data_rate=_INT, channels=T.ArrayType(_TEXT), ph_units=_UNITS, an_units=_UNITS,
    dig_units=T.ArrayType(_struct(normal=_INT, valid=_INT)), block_bytes=_INT, payload_bytes=_INT,
)


class _Cursor:
    """Big-endian reads from a byte string, remembering the position."""

    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, fmt: str) -> tuple:
        values = struct.unpack_from(">" + fmt, self.data, self.at)
        self.at += struct.calcsize(">" + fmt)
        return values

    def texts(self, count: int) -> list[str]:
        fields = [f.split(b"\0", 1)[0].decode("latin-1").strip() for f in self.take("16s" * count)]
        return fields


def _read_block(cur: _Cursor) -> dict:
    (station,) = cur.texts(1)
    idcode, fmt, ph, an, dg = cur.take("5H")
    channels = cur.texts(ph + an + 16 * dg)
    scaled = lambda w: {"kind": w >> 24, "factor": (w & bits.FRACTION_MASK) * layout.UNIT_SCALE}
    ph_units, an_units = ([scaled(w) for w in cur.take(f"{n}I")] for n in (ph, an))
    dig_units = [{"normal": w >> 16, "valid": w & 0xFFFF} for w in cur.take(f"{dg}I")]
    fnom_word, cfg_cnt = cur.take("2H")
    wide = lambda bit, yes, no: yes if fmt >> bit & 1 else no
    size = (
        2
        + ph * wide(layout.PHASOR_FLOAT_BIT, 8, 4)
        + wide(layout.FREQ_FLOAT_BIT, 8, 4)
        + an * wide(layout.ANALOG_FLOAT_BIT, 4, 2)
        + dg * 2
    )
    return {
        "station": station, "idcode": idcode, "format": fmt, "phnmr": ph, "annmr": an, "dgnmr": dg,
        "channels": channels, "ph_units": ph_units, "an_units": an_units, "dig_units": dig_units,
        "fnom": 50 if fnom_word & 1 else 60, "cfg_cnt": cfg_cnt, "block_bytes": size,
    }


def read_layout(raw: bytes) -> dict:
    """One layout frame as a dict; raises ValueError with what is wrong."""
    if len(raw) < MIN_CFG2 or raw[0] != SYNC_BYTE or raw[1] & 0x70 != 0x30:
        raise ValueError("not a CFG2 frame")
    if raw[1] & 0x0F not in (1, 2):
        raise ValueError(f"unsupported SYNC version {raw[1] & 0x0F}")
    cur = _Cursor(raw[HEADER_BYTES:-CRC_BYTES])
    try:
        time_base, count = cur.take("IH")
        if count < 1:
            raise ValueError(f"NUM_PMU={count}")
        blocks = [_read_block(cur) for _ in range(count)]
        (rate,) = cur.take("h")
    except struct.error as short:
        raise ValueError(f"CFG2 truncated at {cur.at}") from short
    if cur.at != len(cur.data):
        raise ValueError(f"CFG2 trailing bytes: consumed={cur.at} payload={len(cur.data)}")
    return {
        **blocks[0],
        "sync_word": raw[0] << 8 | raw[1],
        "time_base": time_base & bits.FRACTION_MASK,
        "num_pmu": count,
        "data_rate": rate,
        "payload_bytes": sum(b["block_bytes"] for b in blocks),
    }


def decode_cfg2(frames: DataFrame) -> DataFrame:
    """Layout rows out of CFG-2 frames; an unreadable frame becomes a row with ``error``."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = LAYOUT_SCHEMA.names
        for batch in batches:
            out = []
            for pmu, at, raw in zip(batch["pmu_id"], batch["received_us"], batch["raw"]):
                try:
                    fields = read_layout(bytes(raw))
                except ValueError as bad:
                    fields = {"error": str(bad)}
                out.append({**dict.fromkeys(names), "pmu_id": pmu, "received_us": at, **fields})
            table = pd.DataFrame(out, columns=names)
            for f in LAYOUT_SCHEMA.fields:
                if isinstance(f.dataType, (T.IntegerType, T.LongType)):
                    table[f.name] = table[f.name].astype("Int64")
            yield table

    return frames.select("pmu_id", "received_us", "raw").mapInPandas(rows, LAYOUT_SCHEMA)


# ------------------------------------------------------------------ layout of a frame

LAYOUT_OF_FRAME = [
    "time_base", "format", "phnmr", "annmr", "dgnmr", "fnom", "ph_scale", "an_scale", "payload_bytes",
    "phasor_names", "analog_names", "digital_names", "plan",
]


def prepare_layouts(layouts: DataFrame) -> DataFrame:
    """Layouts with named channels, slot positions and scales: once per layout, not per frame."""

    def scales(units: str, count: str) -> Column:
        one = lambda i: F.when(F.get(F.col(units), i)["factor"] > 0, F.get(F.col(units), i)["factor"]).otherwise(F.lit(1.0))
        some = F.transform(F.sequence(F.lit(0), F.greatest(F.col(count), F.lit(1)) - 1), one)
        return F.when(F.col(count) > 0, some).otherwise(F.array().cast("array<double>"))

    named = layouts.select("*", *(c.alias(n) for n, c in layout.channel_groups("channels", "phnmr", "annmr").items()))
    scaled = named.withColumns({"ph_scale": scales("ph_units", "phnmr"), "an_scale": scales("an_units", "annmr")})
    return phasor.with_slot_plan(scaled)


def join_layout_asof(frames: DataFrame, layouts: DataFrame, cols: list[str], width: int = HOUR_US) -> DataFrame:
    """Attach, as STRUCT ``layout``, the latest layout a device had sent when a frame came.

    Layout rows are merged into the frame order and carried forward, so one shuffle on
    (device, hour) does it, whatever the share of one device. NULL: none known yet. A
    layout that came with the same stamp counts as known.
    """
    known = layouts.select("pmu_id", "received_us", F.struct(*cols).alias("_layout"), F.lit(False).alias("_frame"))
    rows = frames.withColumn("_frame", F.lit(True)).unionByName(known, allowMissingColumns=True)
    # a layout sorts before the frames of its own microsecond
    filled = forward_fill(rows, ["pmu_id"], ["received_us", "_frame"], "_layout", width, "layout")
    return filled.filter("_frame").select(*frames.columns, "layout")


# ------------------------------------------------------------------ DATA frames


FIELDS = _struct(
    crc=_INT, freq=T.DoubleType(), rocof=T.DoubleType(), phasor_mag=T.ArrayType(T.DoubleType()),
    phasor_deg=T.ArrayType(T.DoubleType()), analogs=T.ArrayType(T.DoubleType()), digitals=T.ArrayType(_INT),
)


class _Lists:
    """An ARRAY column filled group by group."""

    def __init__(self, lengths: np.ndarray, dtype: type) -> None:
        self.offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        self.values = np.zeros(self.offsets[-1], dtype=dtype)

    def put(self, rows: np.ndarray, block: np.ndarray) -> None:
        if block.shape[1]:
            self.values[self.offsets[rows][:, None] + np.arange(block.shape[1])] = block

    def array(self) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(self.offsets), pa.array(self.values))


def _scales_of(lists: pa.Array, rows: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` entries of each row of a list column, as a matrix."""
    starts = lists.offsets.to_numpy()[:-1].astype(np.int64)
    values = lists.values.to_numpy(zero_copy_only=False)
    return values[starts[rows][:, None] + np.arange(count)] if count else np.zeros((len(rows), 0))


def fields_of_batch(
    raw: pa.Array, fmt: pa.Array, phnmr: pa.Array, annmr: pa.Array, dgnmr: pa.Array, fnom: pa.Array, ph_scale: pa.Array, an_scale: pa.Array
) -> pa.Array:
    """Checksum and measurements of DATA frames; frames of one shape are read together.

    A frame shorter than its layout asks for has a checksum but zero measurements.
    """
    flat, start, size = _bytes_of(raw)
    number = lambda a: a.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    shape = np.stack([size, *(number(a) for a in (fmt, phnmr, annmr, dgnmr))], axis=1)
    n = len(raw)
    crc, freq, rocof = np.zeros(n, np.int32), np.zeros(n), np.zeros(n)
    nominal = number(fnom).astype(float)
    mags, degs = _Lists(shape[:, 2], float), _Lists(shape[:, 2], float)
    analogs, digitals = _Lists(shape[:, 3], float), _Lists(shape[:, 4], np.int32)
    shapes, member = np.unique(shape, axis=0, return_inverse=True)
    member = member.reshape(-1)
    for g, (length, f, ph, an, dg) in enumerate(shapes.tolist()):
        rows = np.flatnonzero(member == g)
        if length < CRC_BYTES:
            continue
        block = np.ascontiguousarray(flat[start[rows][:, None] + np.arange(length)])
        crc[rows] = _crc_of_block(block[:, :-CRC_BYTES])
        wide = lambda bit, f=f: bool(f >> bit & 1)
        ph_float, an_float = wide(layout.PHASOR_FLOAT_BIT), wide(layout.ANALOG_FLOAT_BIT)
        freq_float, polar = wide(layout.FREQ_FLOAT_BIT), wide(layout.POLAR_BIT)
        word = {True: ">f4", False: ">i2"}
        sizes = [ph * (8 if ph_float else 4), 8 if freq_float else 4, an * (4 if an_float else 2), dg * 2]
        edges = HEADER_BYTES + 2 + np.append(0, np.cumsum(sizes))
        if edges[-1] > length - CRC_BYTES:
            continue
        part = lambda i, kind, edges=edges, block=block: np.ascontiguousarray(block[:, edges[i] : edges[i + 1]]).view(kind)
        pair = part(0, word[ph_float]).astype(float)
        first, second = pair[:, 0::2], pair[:, 1::2]
        if not ph_float:
            scale = _scales_of(ph_scale, rows, ph)
            if polar:
                # magnitudes are unsigned, angles are in 1e-4 radians
                first, second = part(0, ">u2")[:, 0::2].astype(float) * scale, second * 1e-4
            else:
                first, second = first * scale, second * scale
        mags.put(rows, first if polar else np.hypot(first, second))
        degs.put(rows, np.degrees(second if polar else np.arctan2(second, first)))
        rates = part(1, word[freq_float]).astype(float)
        freq[rows] = rates[:, 0] if freq_float else nominal[rows] + rates[:, 0] / 1000
        rocof[rows] = rates[:, 1] if freq_float else rates[:, 1] / 100
        values = part(2, word[an_float]).astype(float)
        analogs.put(rows, values if an_float else values * _scales_of(an_scale, rows, an))
        digitals.put(rows, part(3, ">u2").astype(np.int32))
    columns = [pa.array(crc), pa.array(freq), pa.array(rocof), mags.array(), degs.array(), analogs.array(), digitals.array()]
    return pa.StructArray.from_arrays(columns, names=FIELDS.names)


@F.arrow_udf(FIELDS)
def frame_fields(
    raw: pa.Array, fmt: pa.Array, phnmr: pa.Array, annmr: pa.Array, dgnmr: pa.Array, fnom: pa.Array, ph_scale: pa.Array, an_scale: pa.Array
) -> pa.Array:
    return fields_of_batch(raw, fmt, phnmr, annmr, dgnmr, fnom, ph_scale, an_scale)


def _error() -> Column:
    have, size = F.length("raw"), bits.be_uint("raw", 2, 2).cast("int")
    not_data = (
        (have < MIN_FRAME)
        | (bits.be_uint("raw", 0, 1) != SYNC_BYTE)
        | (bits.be_uint("raw", 1, 1).bitwiseAND(F.lit(0x70)) != 0)
    )
    payload = have - HEADER_BYTES - CRC_BYTES
    rx, calc, want = F.col("_rx"), F.col("_f.crc"), F.col("_want")
    return (
        F.when(F.col("layout").isNull(), F.concat(F.lit('no CFG2 profile for "'), F.col("pmu_id"), F.lit('"')))
        .when(not_data, F.lit("not a data frame"))
        .when(size != have, F.format_string("frame size mismatch: header=%d actual=%d", size, have))
        .when(rx != calc, F.concat(F.lit("CRC mismatch: rx="), _hex4(rx), F.lit(" calc="), _hex4(calc)))
        .when(payload != want, F.format_string("payload length %d != expected %d", payload, want))
    )


def decode_data(frames: DataFrame) -> DataFrame:
    """Readings out of DATA frames that carry their prepared ``layout``.

    See :func:`prepare_layouts` and :func:`join_layout_asof`. Every frame comes back: a bad
    one with ``error`` set and no measurements. The measurements of a batch of frames are
    read with array arithmetic in one Arrow call; header fields, verdicts and everything
    derived stay in Spark expressions.
    """
    lay = F.col("layout")
    numbers = lambda c: F.coalesce(c, F.array().cast("array<double>"))
    fields = frame_fields(
        F.col("raw"), lay["format"], lay["phnmr"], lay["annmr"], lay["dgnmr"], lay["fnom"], numbers(lay["ph_scale"]), numbers(lay["an_scale"])
    )
    block = layout.payload_bytes(lay["format"], lay["phnmr"], lay["annmr"], lay["dgnmr"])
    read = (
        frames.withColumn("_f", fields)
        .withColumns(
            {
                "_want": F.coalesce(lay["payload_bytes"], block),
                "_rx": bits.be_uint("raw", F.length("raw") - CRC_BYTES, CRC_BYTES).cast("int"),
                "_soc": bits.be_uint("raw", 6, 4),
                "_frac": bits.be_uint("raw", 10, 4),
            }
        )
        .withColumn("error", _error())
    )
    good = F.col("error").isNull()
    flags = layout.format_flags(lay["format"])
    fields = {
        "idcode": bits.be_uint("raw", 4, 2).cast("int"),
        "soc": F.col("_soc"),
        "fracsec_raw": F.col("_frac"),
        "fracsec_count": F.col("_frac").bitwiseAND(F.lit(bits.FRACTION_MASK)),
        "time_quality": F.shiftright("_frac", 24).cast("int"),
        "meas_us": bits.frame_time_us("_soc", "_frac", lay["time_base"]),
        "stat": bits.be_uint("raw", HEADER_BYTES, 2).cast("int"),
        **{n: F.col(f"_f.{n}") for n in FIELDS.names if n != "crc"},
        "phasor_names": lay["phasor_names"],
        "analog_names": lay["analog_names"],
        "digital_names": lay["digital_names"],
        "plan": lay["plan"],
        "_nominal": phasor.nominal_hz(F.col("_f.freq"), lay["fnom"], flags["freq_float"]),
    }
    kept = [c for c in frames.columns if c != "layout"]
    decoded = read.select(
        *kept,
        "error",
        F.col("_rx").alias("checksum"),
        F.length("raw").alias("frame_bytes"),
        *(F.when(good, c).alias(n) for n, c in fields.items()),
    )
    slotted = phasor.with_standard_slots(decoded).withColumns(
        {"freq_dev": F.col("freq") - F.col("_nominal"), "fnom": F.floor(F.col("_nominal") + 0.5).cast("int")}
    )
    # chart values: a classified channel goes before the slot's stand-in; IB and IC have no slot
    mags, degs = phasor.trend_values("mag", "phasor_mag"), phasor.trend_values("deg", "phasor_deg")
    six = {f"{p}_{kind}": each[p] for kind, each in (("mag", mags), ("deg", degs)) for p in ("ib", "ic")}
    return with_derived(slotted.withColumns({n: F.when(F.col("error").isNull(), c) for n, c in six.items()}).drop("_nominal"))


def with_derived(readings: DataFrame) -> DataFrame:
    """The measures computed from the slots and the analog values."""
    pos, neg, zero = phasor.sequence_magnitudes(("va_mag", "va_deg"), ("vb_mag", "vb_deg"), ("vc_mag", "vc_deg"))
    p, q = phasor.complex_power("va_mag", "va_deg", "ia_mag", "ia_deg")
    staged = readings.withColumns({"seq_pos": pos, "seq_neg": neg, "seq_zero": zero})
    return staged.select(
        "*",
        phasor.imbalance_pct("seq_pos", "seq_neg").alias("imbalance_pct"),
        phasor.angle_diff("va_deg", "vb_deg").alias("vab_deg"),
        phasor.angle_diff("vb_deg", "vc_deg").alias("vbc_deg"),
        phasor.angle_diff("vc_deg", "va_deg").alias("vca_deg"),
        *(c.alias(n) for n, c in phasor.power_summary("analogs").items()),
        p.alias("power_real"),
        q.alias("power_imag"),
    )


def digital_bits(readings: DataFrame) -> DataFrame:
    """Sixteen rows per reading: the bits of its first digital word with their names."""
    word = F.coalesce(F.get("digitals", F.lit(0)), F.lit(0))
    names = F.col("digital_names") if "digital_names" in readings.columns else F.array().cast("array<string>")
    each = F.transform(
        F.sequence(F.lit(0), F.lit(15)),
        lambda b: F.struct(
            F.coalesce(F.nullif(F.get(names, b), F.lit("")), F.concat(F.lit("bit"), b.cast("string"))).alias("name"),
            F.getbit(word, b).cast("boolean").alias("is_set"),
        ),
    )
    return readings.select("*", F.posexplode(each).alias("bit", "_b")).select(
        *readings.columns, "bit", F.col("_b.name").alias("name"), F.col("_b.is_set").alias("is_set")
    )
