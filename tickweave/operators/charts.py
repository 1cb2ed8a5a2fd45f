"""Chart tables over aligned points: pivots, series, vectors, pair angles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.phasor import angle_delta
from tickweave.functions.registry import device_slug
from tickweave.operators.windows import with_newest_ticks

# --- fixed values: chart windows in ticks, and phase names ---
CHART_TICKS = 90
PAIR_TICKS = 60
PHASES = ["VA", "VB", "VC", "IA", "IB", "IC"]
MEASURES = ["frequency", "frequency_dev", "rocof"]


def slug(name: str) -> str:
    """The column prefix of a device name (see ``device_slug``)."""
    out, dash = [], False
    for ch in name.lower():
        keep = ch.isascii() and ch.isalnum()
        if keep or not dash:
            out.append(ch if keep else "-")
        dash = not keep
    return "".join(out)


def devices_of(points: DataFrame, most: int) -> list[str]:
    """The devices a wide chart has columns for, in order; more than ``most`` are an error, none is left out."""
    found = [r.pmu_id for r in points.select("pmu_id").distinct().orderBy("pmu_id").limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"more than {most} devices: choose those a wide chart shall have")
    return found


def _wide(points: DataFrame, devices: list[str], values: dict[str, Column]) -> DataFrame:
    """One row per tick, a column per (device, value); absent devices stay NULL."""
    mine = points.filter(F.col("pmu_id").isin(devices))
    cells = [
        F.max(F.when(F.col("pmu_id") == d, c)).alias(f"{slug(d)}__{name}") for d in devices for name, c in values.items()
    ]
    ticks = points.select("tick_us").distinct()
    return ticks.join(mine.groupBy("tick_us").agg(*cells), "tick_us", "left")


def aligned_pivot(measures: DataFrame, devices: list[str], window: int = CHART_TICKS) -> DataFrame:
    """Frequency, deviation and rate of change of the chosen devices over the last ticks."""
    return _wide(with_newest_ticks(measures, window), devices, {m: F.col(m) for m in MEASURES})


def channel_values(group: str, kind: str, analog_names: list[str] | None = None) -> dict[str, Column]:
    """Chart values of a group (magnitude, angle, analogs) for voltages or currents."""
    if group == "analogs":
        return {slug(n): F.try_element_at(F.col("analogs"), F.lit(n)) for n in analog_names or []}
    phases = [p.lower() for p in PHASES if p.startswith(kind[0].upper())]
    return {p if group == "magnitude" else f"{p}Angle": F.col(p if group == "magnitude" else f"{p}_angle") for p in phases}


def channel_pivot(
    measures: DataFrame, devices: list[str], group: str, kind: str, window: int, analog_names: list[str] | None = None
) -> DataFrame:
    return _wide(with_newest_ticks(measures, window), devices, channel_values(group, kind, analog_names))


def device_trend(measures: DataFrame, device: str, window: int = CHART_TICKS) -> DataFrame:
    """One device's series over the last ticks; MW and MVAR by analog name, else by position."""
    values = F.map_values("analogs")
    analog = lambda name, i: F.coalesce(
        F.try_element_at(F.col("analogs"), F.lit(name)), F.get(values, F.lit(i)), F.lit(0.0)
    )
    mine = with_newest_ticks(measures, window).filter(F.col("pmu_id") == device)
    return mine.select(
        "tick_us", *MEASURES, analog("Analog1", 0).alias("mw"), analog("Analog2", 1).alias("mvar"),
        *(p.lower() for p in PHASES),
    )


def latest_tick(measures: DataFrame, devices: DataFrame) -> DataFrame:
    """Points of the newest tick at which any of the given devices is present."""
    newest = measures.join(devices.select("pmu_id"), "pmu_id", "left_semi").agg(F.max("tick_us"))
    return measures.filter(F.col("tick_us") == newest.scalar())


def phasor_rows(points: DataFrame) -> DataFrame:
    """Points as (tick, device, label, magnitude, angle) rows; empty phasors are left out."""
    rows = F.array(
        *(F.struct(F.lit(p).alias("label"), F.col(p.lower()).alias("mag"), F.col(f"{p.lower()}_angle").alias("deg")) for p in PHASES)
    )
    return (
        points.select("tick_us", "pmu_id", F.explode(rows).alias("r"))
        .select("tick_us", "pmu_id", "r.*")
        .filter((F.col("mag") != 0) | (F.col("deg") != 0))
    )


def diagram_vectors(measures: DataFrame, online: DataFrame, kind: str, phase: str = "all") -> DataFrame:
    """Phasors of the online devices at their latest tick, for one kind and phase."""
    point = latest_tick(measures, online).join(online.select("pmu_id", "label"), "pmu_id").withColumnRenamed("label", "device")
    names = point.select("pmu_id", "device").distinct()
    rows = phasor_rows(point).filter(F.col("label").startswith(kind[0].upper()))
    if phase != "all":
        rows = rows.filter(F.col("label") == phase)
    return rows.join(names, "pmu_id")


def diagram_missing(measures: DataFrame, online: DataFrame) -> DataFrame:
    """Online devices without a point at the latest tick."""
    return online.select("pmu_id", "label").join(latest_tick(measures, online), "pmu_id", "left_anti")


def pair_angle_series(measures: DataFrame, online: DataFrame, channel: str = "va", window: int = PAIR_TICKS) -> DataFrame:
    """Angle between every two online devices at each of the last ticks, where both are present.

    Each tick holds one entry per device, so its pairs are formed inside one row from
    the array of that tick; no row is joined with another.
    """
    mine = with_newest_ticks(measures, window).join(online.select("pmu_id"), "pmu_id", "left_semi")
    held = mine.groupBy("tick_us").agg(
        F.array_sort(F.collect_list(F.struct("pmu_id", F.col(f"{channel}_angle").alias("deg")))).alias("held")
    )
    return (
        held.select("tick_us", "held", F.explode("held").alias("a"))
        .select("tick_us", "a", F.explode(F.filter("held", lambda b: b["pmu_id"] > F.col("a.pmu_id"))).alias("b"))
        .select(
            "tick_us",
            F.concat_ws("__", device_slug("a.pmu_id"), device_slug("b.pmu_id")).alias("pair"),
            F.round(angle_delta("a.deg", "b.deg"), 2).alias("delta"),
        )
    )


def aligned_sheet(measures: DataFrame, ticks: DataFrame, analog_names: list[str]) -> DataFrame:
    """Export of aligned points: fixed columns, then one column per analog name."""
    joined = measures.join(ticks.select("tick_us", "complete", "reason", "missing"), "tick_us")
    fixed = {
        "frequency_hz": "frequency", "frequency_dev_hz": "frequency_dev", "rocof_hz_per_sec": "rocof",
        **{f"{p.lower()}_mag": p.lower() for p in PHASES}, **{f"{p.lower()}_angle_deg": f"{p.lower()}_angle" for p in PHASES},
    }
    analog = lambda n: F.coalesce(F.try_element_at(F.col("analogs"), F.lit(n)), F.lit(0.0))
    return joined.select(
        "tick_ms",
        F.date_format(F.timestamp_millis("tick_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("time_utc"),
        F.col("pmu_id").alias("pmu_name"),
        "complete",
        "reason",
        F.array_join("missing", " ").alias("missing"),
        *(F.col(src).alias(out) for out, src in fixed.items()),
        *(analog(n).alias(n) for n in analog_names),
    )
