"""Big-endian fields of a BINARY column and bit fields of integer columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FRACTION_MASK = 0x00FFFFFF

# --- fixed values: frame kinds, keyed by SYNC bits 6-4 ---
FRAME_TYPES = {0x00: "DATA", 0x10: "HEADER", 0x20: "CFG1", 0x30: "CFG2", 0x40: "CMD", 0x50: "CFG3"}


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def be_uint(raw, pos, width: int) -> Column:
    """Unsigned big-endian integer of ``width`` bytes at 0-based ``pos``; NULL past the end."""
    pos = F.lit(pos) if isinstance(pos, int) else pos
    part = F.substring(_col(raw), (pos + 1).cast("int"), F.lit(width))
    return F.when(F.length(part) == width, F.conv(F.hex(part), 16, 10).cast("bigint"))


def be_int16(raw, pos) -> Column:
    v = be_uint(raw, pos, 2)
    return F.when(v >= 32768, v - 65536).otherwise(v)


def float32_from_bits(bits) -> Column:
    """The exact value of an IEEE-754 single whose bit pattern is in a BIGINT column."""
    bits = _col(bits)
    sign = F.when(F.shiftright(bits, 31) == 1, F.lit(-1.0)).otherwise(F.lit(1.0))
    exponent = F.shiftright(bits, 23).bitwiseAND(F.lit(0xFF))
    mantissa = bits.bitwiseAND(F.lit(0x7FFFFF)).cast("double")
    return (
        F.when((exponent == 255) & (mantissa > 0), F.lit(float("nan")))
        .when(exponent == 255, sign * F.lit(float("inf")))
        .when(exponent == 0, sign * mantissa * F.lit(2.0**-149))
        .otherwise(sign * (1 + mantissa / F.lit(float(2**23))) * F.pow(F.lit(2.0), exponent - 127))
    )


def be_float32(raw, pos) -> Column:
    return float32_from_bits(be_uint(raw, pos, 4))


def bits_at(word, shift: int, mask: int) -> Column:
    return F.shiftright(_col(word), shift).bitwiseAND(F.lit(mask))


def flag_at(word, bit: int) -> Column:
    return bits_at(word, bit, 1) == 1


def stat_fields(stat) -> dict[str, Column]:
    """The STAT word split into its named fields."""
    return {
        "data_error_code": bits_at(stat, 14, 3).cast("int"),
        "data_error": bits_at(stat, 14, 3) != 0,
        "cfg_change": flag_at(stat, 13),
        "trigger": flag_at(stat, 12),
        "sort_by_arrival": flag_at(stat, 11),
        "sync_unlocked": flag_at(stat, 10),
        "pmu_time_quality": bits_at(stat, 6, 15).cast("int"),
        "unlocked_duration": bits_at(stat, 4, 3).cast("int"),
        "trigger_reason": bits_at(stat, 0, 15).cast("int"),
    }


def time_quality_fields(fracsec) -> dict[str, Column]:
    """The top byte of FRACSEC split into its named fields."""
    top = bits_at(fracsec, 24, 0xFF)
    return {
        "msg_tq_raw": top.cast("int"),
        "tq_reserved": flag_at(top, 7),
        "leap_second_direction": flag_at(top, 6),
        "leap_second_occurred": flag_at(top, 5),
        "leap_second_pending": flag_at(top, 4),
        "time_quality_code": bits_at(top, 0, 15).cast("int"),
    }


def frame_kind(sync_low_byte) -> Column:
    """Name of the frame kind in SYNC bits 6-4; unknown kinds keep their code."""
    code = _col(sync_low_byte).bitwiseAND(F.lit(0x70))
    out = None
    for value, name in FRAME_TYPES.items():
        out = F.when(code == value, name) if out is None else out.when(code == value, name)
    return out.otherwise(F.concat(F.lit("UNKNOWN(0x"), F.lpad(F.hex(code), 2, "0"), F.lit(")")))


def frame_time_us(soc, fracsec, time_base) -> Column:
    """Epoch microseconds of SOC plus the FRACSEC fraction; an unset time base means 1e6."""
    base = _col(time_base).bitwiseAND(F.lit(FRACTION_MASK))
    base = F.when(base == 0, F.lit(1_000_000)).otherwise(base)
    count = _col(fracsec).bitwiseAND(F.lit(FRACTION_MASK))
    return _col(soc) * 1_000_000 + F.floor(count * 1_000_000 / base).cast("bigint")
