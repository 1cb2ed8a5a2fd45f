"""Device layouts: unit words, payload size, channel lists, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.bits import FRACTION_MASK, bits_at
from tickweave.functions.phasor import STANDARD_LABELS, display_label, once

# --- fixed values: FORMAT word bits and the unit scale ---
POLAR_BIT, PHASOR_FLOAT_BIT, ANALOG_FLOAT_BIT, FREQ_FLOAT_BIT = 0, 1, 2, 3
UNIT_SCALE = 1e-5

# fields of a layout that change how DATA frames decode
LAYOUT_FIELDS = [
    "station", "idcode", "time_base", "format", "phnmr", "annmr", "dgnmr", "fnom", "cfg_cnt", "data_rate",
    "channels", "ph_units", "an_units", "dig_units",
]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def format_flags(fmt) -> dict[str, Column]:
    return {
        "polar": bits_at(fmt, POLAR_BIT, 1) == 1,
        "ph_float": bits_at(fmt, PHASOR_FLOAT_BIT, 1) == 1,
        "an_float": bits_at(fmt, ANALOG_FLOAT_BIT, 1) == 1,
        "freq_float": bits_at(fmt, FREQ_FLOAT_BIT, 1) == 1,
    }


def unit_factor(word) -> Column:
    """Scale in the low 24 bits of a PHUNIT or ANUNIT word."""
    return _col(word).bitwiseAND(F.lit(FRACTION_MASK)) * F.lit(UNIT_SCALE)


def unit_type(word) -> Column:
    return bits_at(word, 24, 0xFF).cast("int")


def digital_masks(word) -> tuple[Column, Column]:
    """(normal, valid) masks of a DIGUNIT word."""
    return bits_at(word, 16, 0xFFFF).cast("int"), bits_at(word, 0, 0xFFFF).cast("int")


def payload_bytes(fmt, phnmr, annmr, dgnmr) -> Column:
    """Bytes of one device block in a DATA frame, STAT to the last digital word."""
    f = format_flags(fmt)
    phasor = F.when(f["ph_float"], 8).otherwise(4)
    freq = F.when(f["freq_float"], 8).otherwise(4)
    analog = F.when(f["an_float"], 4).otherwise(2)
    return (2 + _col(phnmr) * phasor + freq + _col(annmr) * analog + _col(dgnmr) * 2).cast("int")


def channel_groups(channels, phnmr, annmr) -> dict[str, Column]:
    """Phasor, analog and digital names of a layout; blank ones get PHi / ANAi."""
    ch, ph, an = _col(channels), _col(phnmr), _col(annmr)

    def named(offset: Column, count: Column, blank: str) -> Column:
        return F.when(count <= 0, F.array().cast("array<string>")).otherwise(
            F.transform(
                F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1),
                lambda i: F.coalesce(
                    F.nullif(F.get(ch, (offset + i).cast("int")), F.lit("")),
                    F.concat(F.lit(blank), (i + 1).cast("string")),
                ),
            )
        )

    return {
        "phasor_names": named(F.lit(0), ph, "PH"),
        "analog_names": named(ph, an, "ANA"),
        "digital_names": F.slice(ch, (ph + an + 1).cast("int"), F.greatest(F.size(ch) - ph - an, F.lit(0)).cast("int")),
    }


def layout_hash(layouts: DataFrame) -> Column:
    """Digest of the decoding fields a layout table has; equal layouts, equal digest."""
    fields = []
    for f in LAYOUT_FIELDS:
        if f in layouts.columns:
            c = F.col(f)
            fields.append((c.bitwiseAND(F.lit(FRACTION_MASK)) if f == "time_base" else c).alias(f))
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def channels_json() -> Column:
    """JSON document of a layout's channel list and format flags."""
    c = F.col
    flags = format_flags("format")
    return F.to_json(
        F.struct(
            c("annmr"), flags["an_float"].alias("an_float"), c("channels"), c("dgnmr"), c("fnom").alias("fnom_hz"),
            flags["freq_float"].alias("freq_float"), flags["ph_float"].alias("ph_float"), c("phnmr"),
            flags["polar"].alias("polar"),
        )
    )


def display_labels(names) -> Column:
    """The label of each name, NULL where unknown; for those who want both forms below, so that names are looked at once."""
    return F.transform(_col(names), display_label)


def display_order(names, labels=None) -> Column:
    """ARRAY<STRUCT<label, name, position>> in chart order: VA..IC, then the rest as given. labels: ``display_labels(names)``."""
    standard = F.array(*map(F.lit, STANDARD_LABELS))

    def tagged(label: Column, n: Column, i: Column) -> Column:
        place = F.array_position(standard, label).cast("int")
        return F.struct(
            F.when(place > 0, place - 1).otherwise(100 + i).alias("rank"), i.alias("position"), label.alias("label"), n.alias("name")
        )

    label_of = lambda n, i: display_label(n) if labels is None else F.get(_col(labels), i)
    ordered = F.transform(_col(names), lambda n, i: once(F.coalesce(label_of(n, i), n), lambda label: tagged(label, n, i)))
    return F.transform(F.array_sort(ordered), lambda t: F.struct(t["label"].alias("label"), t["name"].alias("name"), t["position"].alias("position")))


def cfg_list_text(names, labels=None) -> Column:
    """``VA (BUS.AV), Other`` in layout order, as device panels print it. labels: ``display_labels(names)``."""

    def shown(label: Column, n: Column) -> Column:
        return F.when(label.isNotNull() & (label != n), F.concat(label, F.lit(" ("), n, F.lit(")"))).otherwise(n)

    label_of = lambda n, i: display_label(n) if labels is None else F.get(_col(labels), i)
    return F.array_join(F.transform(_col(names), lambda n, i: once(label_of(n, i), lambda label: shown(label, n))), ", ")
