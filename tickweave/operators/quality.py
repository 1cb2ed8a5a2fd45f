"""The quality gate and what follows from its verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.bits import bits_at, flag_at
from tickweave.operators.chunked import ARRIVALS, newest, with_previous

MAX_SKEW_US = 5_000_000

# --- fixed values: reject reasons ---
NO_TIME = "missing timestamp"
SKEW = "timestamp skew too high: "
BAD_STAT = "bad status flag: "
UNSYNC = "PMU unsynchronized (STAT bit 10)"
BAD_FREQ = "frequency out of range: "


def duration_text(us: Column) -> Column:
    """Microseconds as ``1h2m3.5s``; zero parts in front and trailing zeros are left out."""
    sec = F.floor(us / 1_000_000)
    hours, minutes = F.floor(sec / 3600), F.floor(sec / 60) % 60
    fraction = F.concat((sec % 60).cast("string"), F.lit("."), F.lpad((us % 1_000_000).cast("string"), 6, "0"))
    seconds = F.regexp_replace(F.regexp_replace(fraction, "0+$", ""), r"\.$", "")
    return F.concat(
        F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h"))).otherwise(""),
        F.when(sec >= 60, F.concat(minutes.cast("string"), F.lit("m"))).otherwise(""),
        seconds,
        F.lit("s"),
    )


def quality_gate(readings: DataFrame, max_skew_us: int = MAX_SKEW_US) -> DataFrame:
    """Add ``reject_reason`` (first failing check, NULL when none) and ``quality_ok``.

    Skew is measured against the arrival time of the row, not the clock of the job, so
    a run over old data gives the verdicts the live gate gave.
    """
    skew = F.abs(F.col("received_us") - F.col("meas_us"))
    code = bits_at("stat", 14, 3)
    freq = F.col("freq")
    bad_freq = freq.isNull() | F.isnan(freq) | (freq < 45) | (freq > 65)
    reason = (
        F.when(F.col("meas_us").isNull() | (F.col("meas_us") == 0), NO_TIME)
        .when(skew > max_skew_us, F.concat(F.lit(SKEW), duration_text(skew)))
        .when(code != 0, F.concat(F.lit(BAD_STAT), code.cast("string")))
        .when(flag_at("stat", 10), UNSYNC)
        .when(bad_freq, F.concat(F.lit(BAD_FREQ), F.coalesce(F.format_string("%.3f", freq), F.lit("NaN"))))
    )
    return readings.withColumn("reject_reason", reason).withColumn("quality_ok", F.col("reject_reason").isNull())


def drop_rejected(gated: DataFrame, drop: bool = True) -> DataFrame:
    """The live path: rejected rows leave when ``drop`` is set. History keeps them all."""
    return gated.filter(F.col("quality_ok")) if drop else gated


def reject_counts(gated: DataFrame) -> DataFrame:
    """Per device: rejects, skew rejects, last reject reason."""
    bad = ~F.col("quality_ok")
    return gated.groupBy("pmu_id").agg(
        F.count(F.lit(1)).alias("frames"),
        F.count_if(bad).alias("quality_rejects"),
        F.count_if(bad & F.lower("reject_reason").contains("skew")).alias("skew_rejects"),
        F.max_by(F.when(bad, F.col("reject_reason")), F.when(bad, F.col("arrival_seq"))).alias("last_reject"),
    )


def skew_reject_filter(counts: DataFrame) -> DataFrame:
    """Devices with skew rejects, most first, beside the fleet total."""
    hit = counts.filter(F.col("skew_rejects") > 0).select("pmu_id", "skew_rejects")
    total = hit.agg(F.sum("skew_rejects"))
    return hit.withColumn("total_skew_rejects", total.scalar()).orderBy(F.desc("skew_rejects"), "pmu_id")


def quality_edges(gated: DataFrame) -> DataFrame:
    """``quality_degraded`` on ok->bad (or a bad first row), ``quality_recovered`` on bad->ok."""
    seen = with_previous(gated, ["pmu_id"], ["arrival_seq"], ["quality_ok"], ARRIVALS)
    ok, before = F.col("quality_ok"), F.col("prev_quality_ok")
    kind = F.when(~ok & F.coalesce(before, F.lit(True)), "quality_degraded").when(ok & ~before, "quality_recovered")
    return (
        seen.withColumn("type", kind)
        .filter(F.col("type").isNotNull())
        .select(
            "pmu_id", "arrival_seq", "received_us", "type", F.when(~ok, F.col("reject_reason")).alias("reason")
        )
    )


def frame_funnel(tagged: DataFrame, layouts: DataFrame | None = None, drop: bool = True) -> DataFrame:
    """Per device counts of frames by the stage they reached, beside the configured rate.

    ``tagged`` has ``crc_ok``, ``parse_ok`` and the gate's ``quality_ok`` per frame.
    """
    c = F.col
    complete = c("crc_ok")
    parsed = complete & c("parse_ok")
    good = parsed & c("quality_ok")
    flagged = parsed & ~c("quality_ok")
    dropped = flagged if drop else F.lit(False)
    out = tagged.groupBy("pmu_id").agg(
        F.count_if(complete).alias("complete"),
        F.count_if(~complete).alias("crc_fail"),
        F.lit(0).cast("bigint").alias("handler_drop"),
        F.count_if(parsed).alias("parse_ok"),
        F.count_if(complete & ~c("parse_ok")).alias("parse_fail"),
        F.count_if(good).alias("quality_ok"),
        F.count_if(flagged).alias("quality_flag"),
        F.count_if(dropped).alias("quality_drop"),
        F.count_if(parsed & ~dropped).alias("delivered"),
    )
    if layouts is None:
        return out
    rate = layouts.groupBy("pmu_id").agg(F.max_by("data_rate", "received_us").alias("data_rate"))
    return out.join(rate, "pmu_id", "left").withColumn("data_rate", F.coalesce("data_rate", F.lit(0)))


def loss_samples(tagged: DataFrame, drop: bool = True, n: int = 32) -> DataFrame:
    """The last ``n`` losses per device: which stage, which frame, why, when.

    A frame the live path drops leaves two samples, the flag and the drop.
    """
    c = F.col
    stages = F.array_compact(
        F.array(
            F.when(~c("crc_ok"), F.lit("crc")),
            F.when(c("crc_ok") & ~c("parse_ok"), F.lit("parse")),
            F.when(c("crc_ok") & c("parse_ok") & ~c("quality_ok"), F.lit("quality_flag")),
            F.when(c("crc_ok") & c("parse_ok") & ~c("quality_ok") & F.lit(drop), F.lit("quality")),
        )
    )
    lost = tagged.select("*", F.posexplode(stages).alias("step", "stage"))
    keep = newest(lost, ["pmu_id"], ["arrival_seq", "step"], n)
    return keep.select(
        "pmu_id", "arrival_seq", "stage", "soc", "fracsec_count", F.col("reject_reason").alias("reason"), "received_us"
    )
