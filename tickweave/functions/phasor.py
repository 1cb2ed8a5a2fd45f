"""Phasor arithmetic and channel-name classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: exact channel-name aliases, after upper-casing and stripping ---
CHANNEL_ALIASES = {
    "va": ["VA", "VAN", "V1", "PHASEA", "PHASEAV", "VOLTAGEA"],
    "vb": ["VB", "VBN", "V2", "PHASEB", "PHASEBV", "VOLTAGEB"],
    "vc": ["VC", "VCN", "V3", "PHASEC", "PHASECV", "VOLTAGEC"],
    "ia": ["IA", "IAN", "I1", "CURRENTA", "PHASEAI"],
    "ib": ["IB", "IBN", "I2", "CURRENTB", "PHASEBI"],
    "ic": ["IC", "ICN", "I3", "CURRENTC", "PHASECI"],
}
STANDARD_LABELS = ["VA", "VB", "VC", "IA", "IB", "IC"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def polar_of(re, im) -> tuple[Column, Column]:
    """(magnitude, angle in degrees) of a rectangular phasor."""
    return F.hypot(_col(re), _col(im)), F.degrees(F.atan2(_col(im), _col(re)))


def rect_of(mag, deg) -> tuple[Column, Column]:
    """(real, imaginary) of a polar phasor."""
    rad = F.radians(_col(deg))
    return _col(mag) * F.cos(rad), _col(mag) * F.sin(rad)


def angle_diff(frm, to) -> Column:
    """``to - frm`` brought back by at most one turn; exactly -180 stays."""
    d = _col(to) - _col(frm)
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def angle_delta(a, b) -> Column:
    """Unsigned angle between two directions, 0..180."""
    d = F.abs(_col(a) - _col(b))
    return F.when(d > 180, 360 - d).otherwise(d)


def sequence_magnitudes(va, vb, vc) -> tuple[Column, Column, Column]:
    """Positive, negative and zero sequence magnitudes of three (mag, deg) pairs.

    Each component is the mean of the three phasors after turning the second and
    third by +-120 degrees (or not at all), so it is a plain sum of rotated vectors.
    """

    def mean_vector(turn_b: int, turn_c: int) -> Column:
        parts = [rect_of(m, _col(d) + t) for (m, d), t in ((va, 0), (vb, turn_b), (vc, turn_c))]
        return F.hypot(sum(p[0] for p in parts) / 3, sum(p[1] for p in parts) / 3)

    return mean_vector(120, -120), mean_vector(-120, 120), mean_vector(0, 0)


def imbalance_pct(pos, neg) -> Column:
    """Negative over positive sequence in percent; 0 where there is no positive sequence."""
    return F.when(_col(pos) > 0.1, F.try_divide(_col(neg), _col(pos)) * 100).otherwise(F.lit(0.0))


def nominal_hz(freq, fnom, freq_is_float) -> Column:
    """Nominal frequency; absolute (float) measurements clearly in the other band win."""
    base = F.when(_col(fnom) <= 0, F.lit(50.0)).otherwise(_col(fnom).cast("double"))
    other = F.when(base >= 55, F.lit(50.0)).otherwise(F.lit(60.0))
    in_other = (F.abs(_col(freq) - base) > 5) & (F.abs(_col(freq) - other) < 3)
    return F.when(_col(freq_is_float) & in_other, other).otherwise(base)


def complex_power(v_mag, v_deg, i_mag, i_deg) -> tuple[Column, Column]:
    """(active, reactive) power of V times the conjugate of I."""
    s = _col(v_mag) * _col(i_mag)
    angle = F.radians(_col(v_deg) - _col(i_deg))
    return s * F.cos(angle), s * F.sin(angle)


def power_summary(analogs) -> dict[str, Column]:
    """MW, MVAR, MVA, power factor and its direction from the first three analog values."""
    analogs = _col(analogs)
    at = lambda i: F.coalesce(F.get(analogs, F.lit(i)), F.lit(0.0))
    mw, mvar, third = at(0), at(1), at(2)
    pq = F.hypot(mw, mvar)
    mva = F.when((third == 0) & (pq > 0), pq).otherwise(third)
    s = F.when(pq > 0, pq).otherwise(mva)
    loaded = s > 0.1
    return {
        "mw": mw,
        "mvar": mvar,
        "mva": mva,
        "power_factor": F.when(loaded, F.least(F.try_divide(mw, s), F.lit(1.0))).otherwise(F.lit(1.0)),
        "power_factor_direction": F.when(loaded & (mvar > 0), "lagging")
        .when(loaded & (mvar < 0), "leading")
        .otherwise("unity"),
    }


def once(value, use) -> Column:
    """``use(value)`` with the value computed once per row: inside a lambda each mention of an expression is computed anew."""
    return F.transform(F.array(value), use)[0]


def _bare_name(name, strip_pattern: str) -> Column:
    """Upper-cased and stripped; of names with colons what follows the last one, unless that is nothing."""
    n = F.upper(F.trim(_col(name)))
    n = F.when(n.endswith(":"), n).otherwise(F.substring_index(n, ":", -1))
    return F.regexp_replace(n, strip_pattern, "")


def _first_class(bare: Column, rules: list[tuple[str, str]]) -> Column:
    """The class of the first pattern found; exact aliases come before ``rules``."""
    aliases = [(cls, f"^({'|'.join(names)})$") for cls, names in CHANNEL_ALIASES.items()]

    def first(bare: Column) -> Column:
        out = F.when(bare == "", F.lit(""))
        for cls, pattern in aliases:
            out = out.when(bare.rlike(pattern), cls)
        out = out.when(~bare.contains("V") & ~bare.contains("I"), F.lit(""))  # every rule asks for one of them
        for cls, pattern in rules:
            out = out.when(bare.rlike(pattern), cls)
        return out.otherwise(F.lit(""))

    return once(bare, first)


def _letter_rule(kind: str, phase: str) -> str:
    return f"{phase}{kind}$|^{kind}{phase}"


def _digit_rule(kind: str, digit: str) -> str:
    return f"^{kind}{digit}|{kind}{digit}$"


_PHASES = [("V", "A", "1"), ("V", "B", "2"), ("V", "C", "3"), ("I", "A", "1"), ("I", "B", "2"), ("I", "C", "3")]


def channel_class(name) -> Column:
    """va/vb/vc/ia/ib/ic for a channel name, '' when it is none of them.

    All letter rules are tried before any digit rule.
    """
    bare = _bare_name(name, "[ _.-]")
    rules = [((k + p).lower(), _letter_rule(k, p)) for k, p, _ in _PHASES]
    rules += [((k + p).lower(), _digit_rule(k, d)) for k, p, d in _PHASES]
    return _first_class(bare, rules)


def display_label(name) -> Column:
    """VA..IC for a channel name as charts show it, NULL when unknown.

    Here letter and digit rules are tried together, phase by phase.
    """
    bare = _bare_name(name, r"[\s_.-]")
    rules = [((k + p).lower(), f"{_letter_rule(k, p)}|{_digit_rule(k, d)}") for k, p, d in _PHASES]
    return once(F.upper(_first_class(bare, rules)), lambda label: F.when(label != "", label))


SLOTS = ("va", "vb", "vc", "ia")


def with_slot_plan(df: DataFrame, names: str = "phasor_names") -> DataFrame:
    """Add ``plan``: the channel positions of the standard slots, from channel names.

    Per slot the last channel of its class; the n-th voltage and the first current as
    stand-ins; ``lone_ia`` is the current of a device with one voltage and one current.
    Names change with the layout only, so this runs per layout, not per frame.
    """
    tagged = F.transform(
        names, lambda n, i: F.struct(i.alias("i"), channel_class(n).alias("cls"), F.upper(F.trim(n)).alias("up"))
    )

    def of_kind(kind: str) -> Column:
        mine = lambda t: t["cls"].startswith(kind.lower()) | ((t["cls"] == "") & t["up"].startswith(kind))
        return F.transform(F.filter("_tagged", mine), lambda t: t["i"])

    def last(cls: str) -> Column:
        back = F.array_position("_back", F.lit(cls)).cast("int")
        return F.when(back > 0, F.size("_back") - back)

    second = F.get("_tagged", F.lit(1))
    second_is_current = (second["cls"] == "ia") | second["up"].startswith("I")
    plan = F.struct(
        *(last(p).alias(p) for p in CHANNEL_ALIASES),
        *(F.get("_volts", F.lit(i)).alias(f"volt{i}") for i in range(3)),
        F.get("_amps", F.lit(0)).alias("amp0"),
        F.coalesce(F.get("_amps", F.lit(0)), F.when(second_is_current, F.lit(1))).alias("lone_ia"),
    )
    found = {"_volts": of_kind("V"), "_amps": of_kind("I"), "_back": F.reverse(F.col("_tagged.cls"))}
    return df.withColumn("_tagged", tagged).withColumns(found).withColumn("plan", plan).drop("_tagged", *found)


def with_standard_slots(df: DataFrame, mags: str = "phasor_mag", degs: str = "phasor_deg", plan: str = "plan") -> DataFrame:
    """Add ``va_mag``, ``va_deg`` .. ``ia_mag``, ``ia_deg`` from magnitude and angle arrays.

    An empty slot falls back to the plan's stand-ins, then to the position in the frame.
    """
    n = F.size(mags)
    mag = lambda i: F.coalesce(F.get(F.col(mags), i), F.lit(0.0))
    deg = lambda i: F.coalesce(F.get(F.col(degs), i), F.lit(0.0))
    own = lambda p: F.col(plan)[p]
    at = {p: F.col(f"_{p}") for p in SLOTS}
    stand_in = {"va": own("volt0"), "vb": own("volt1"), "vc": own("volt2"), "ia": own("amp0")}
    first = {f"_{p}": F.when(mag(own(p)) != 0, own(p)).otherwise(F.coalesce(stand_in[p], own(p))) for p in SLOTS}
    by_position = (mag(at["va"]) == 0) & (mag(at["vb"]) == 0) & (n >= 4)
    second = {f"_{p}": F.when(by_position, F.lit(i)).otherwise(at[p]) for i, p in enumerate(SLOTS)}
    third = {
        "_va": F.when((mag(at["va"]) == 0) & (n >= 1), F.lit(0)).otherwise(at["va"]),
        "_ia": F.when((mag(at["ia"]) == 0) & (n >= 2), F.coalesce(own("lone_ia"), at["ia"])).otherwise(at["ia"]),
    }
    placed = df.withColumns(first).withColumns(second).withColumns(third)
    return placed.select(
        *df.columns, *(f(at[p]).alias(f"{p}_{kind}") for kind, f in (("mag", mag), ("deg", deg)) for p in SLOTS)
    )


def trend_values(kind: str, values: str, plan: str = "plan") -> dict[str, Column]:
    """Six values va..ic of rows with slots: the last classified channel, else the slot, else 0.

    ``kind`` is mag or deg, ``values`` the array of that kind.
    """
    out = {}
    for cls in CHANNEL_ALIASES:
        channel = F.get(F.col(values), F.col(plan)[cls])
        slot = F.col(f"{cls}_{kind}") if cls in SLOTS else F.lit(None).cast("double")
        out[cls] = F.coalesce(channel, slot, F.lit(0.0))
    return out
