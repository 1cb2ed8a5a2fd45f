"""History rows, layout versions and expected-set changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.operators.chunked import HOUR_US, ordinal

DAY_US = 24 * HOUR_US

# --- fixed values: columns of a history row, in order ---
FRAME_COLUMNS = [
    "time_us", "received_us", "pmu_id", "cfg_id", "quality_ok", "reject_reason", "idcode", "stat", "time_quality",
    "freq", "freq_dev", "rocof", "va_mag", "va_ang", "vb_mag", "vb_ang", "vc_mag", "vc_ang", "ia_mag", "ia_ang",
    "phasor_mag", "phasor_ang", "analogs", "digitals",
]


def _has(df: DataFrame, name: str, kind: str, default) -> Column:
    value = F.col(name) if name in df.columns else F.lit(None)
    return F.coalesce(value.cast(kind), F.lit(default).cast(kind))


def frame_history(gated: DataFrame) -> DataFrame:
    """One 24-column history row per gated reading, rejected ones included."""
    c = F.col
    reason = F.when(~c("quality_ok"), F.nullif("reject_reason", F.lit("")))
    cfg = F.when(c("cfg_id") > 0, c("cfg_id")) if "cfg_id" in gated.columns else F.lit(None)
    if "phasor_mag" in gated.columns:
        mags, angs = c("phasor_mag"), c("phasor_deg")
    else:
        mags, angs = (F.array(*(c(f"{p}_{f}") for p in ("va", "vb", "vc", "ia"))) for f in ("mag", "deg"))
    dev = c("freq_dev") if "freq_dev" in gated.columns else c("freq") - c("fnom")
    values: dict[str, Column] = {
        "time_us": F.coalesce("meas_us", "received_us"),
        "received_us": c("received_us"),
        "pmu_id": c("pmu_id"),
        "cfg_id": cfg.cast("bigint"),
        "quality_ok": c("quality_ok"),
        "reject_reason": reason,
        "idcode": _has(gated, "idcode", "int", 0),
        "stat": _has(gated, "stat", "int", 0),
        "time_quality": _has(gated, "time_quality", "int", 0),
        "freq": c("freq"),
        "freq_dev": dev,
        "rocof": c("rocof"),
        **{f"{p}_mag": c(f"{p}_mag") for p in ("va", "vb", "vc", "ia")},
        **{f"{p}_ang": c(f"{p}_deg") for p in ("va", "vb", "vc", "ia")},
        "phasor_mag": mags,
        "phasor_ang": angs,
        "analogs": c("analogs"),
        "digitals": c("digitals"),
    }
    return gated.select(*(values[n].alias(n) for n in FRAME_COLUMNS))


def event_rows(events: DataFrame, now_us: Column | None = None) -> DataFrame:
    """(time_us, pmu_id, type, detail) rows; no detail is ``{}``, no time is now."""
    now = now_us if now_us is not None else F.unix_micros(F.current_timestamp())
    return events.select(
        F.coalesce("time_us", now).alias("time_us"),
        F.coalesce("pmu_id", F.lit("")).alias("pmu_id"),
        "type",
        F.coalesce(F.nullif("detail", F.lit("")), F.lit("{}")).alias("detail"),
    )


def cfg_version_upsert(sightings: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """One row per (device, layout hash): latest values, last raw layout that was given.

    ``cfg_id`` numbers versions by first sighting and never changes for a known one; new
    versions continue after the largest known id.
    """
    key = ["pmu_id", "layout_hash"]
    payload = [c for c in sightings.columns if c not in (*key, "received_us", "raw_cfg")]
    seen = sightings.groupBy(*key).agg(
        F.min("received_us").alias("received_us"),
        *(F.max_by(c, "received_us").alias(c) for c in payload),
        F.max_by("raw_cfg", F.when(F.col("raw_cfg").isNotNull(), F.col("received_us"))).alias("raw_cfg"),
    )
    if known is None:
        return ordinal(seen, ["received_us", *key], DAY_US, "cfg_id")
    fresh = ordinal(seen.join(known.select(*key), key, "left_anti"), ["received_us", *key], DAY_US, "cfg_id")
    top = F.coalesce(known.agg(F.max("cfg_id")).scalar(), F.lit(0))
    fresh = fresh.withColumn("cfg_id", F.col("cfg_id") + top)
    old, new = known.alias("o"), seen.alias("n")
    kept = old.join(new, key, "left").select(
        *key,
        F.col("o.received_us").alias("received_us"),
        *(F.when(F.col("n.received_us").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in payload),
        F.coalesce("n.raw_cfg", "o.raw_cfg").alias("raw_cfg"),
        F.col("o.cfg_id").alias("cfg_id"),
    )
    return kept.unionByName(fresh)


def _names(names: DataFrame) -> DataFrame:
    return names.select(F.col("name")).filter("name <> ''").distinct()


def live_set_diff(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, action) rows that turn one live set into the other; none when they are equal."""
    now, want = _names(current), _names(wanted)
    add = want.exceptAll(now).withColumn("action", F.lit("add"))
    remove = now.exceptAll(want).withColumn("action", F.lit("remove"))
    return add.unionByName(remove).orderBy("name")


def expected_add(expected: DataFrame, names: DataFrame) -> DataFrame:
    return _names(expected.unionByName(names))


def expected_remove(expected: DataFrame, names: DataFrame) -> DataFrame:
    return _names(expected).join(_names(names), "name", "left_anti")
