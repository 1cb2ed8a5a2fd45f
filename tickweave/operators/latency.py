"""Statistics of pipeline hops: (pmu_id, stage, seq, ms) samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.operators.chunked import newest

# --- fixed values: pipeline stages in order, (stage, label, group) ---
STAGES = [
    ("frame_gap", "Frame gap (inter-arrival)", "idle"),
    ("parse", "Parse DATA", "process"),
    ("align_wait", "Align wait (buffer to emit)", "process"),
    ("dashboard_record", "Dashboard RecordReading", "dashboard"),
    ("e2e_recv_to_dashboard", "E2E receive to dashboard", "e2e"),
]
LATENCY_WINDOW = 256
MAX_SAMPLE_MS = 300_000

# --- fixed values: histogram bounds in seconds ---
STAGE_BUCKETS = [0.0001, 0.00025, 0.0005, 0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 1, 2, 5, 10]
PROCESSING_BUCKETS = [0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.25, 0.5, 1, 2, 5]


def valid_samples(samples: DataFrame) -> DataFrame:
    return samples.filter((F.col("ms") > 0) & (F.col("ms") <= MAX_SAMPLE_MS))


def stage_info(stage) -> tuple[Column, Column, Column]:
    """(label, group, ordinal) of a stage name."""
    c = F.col(stage) if isinstance(stage, str) else stage
    pick = lambda values: F.coalesce(*(F.when(c == s[0], F.lit(x)) for s, x in zip(STAGES, values)))
    return pick([s[1] for s in STAGES]), pick([s[2] for s in STAGES]), pick(list(range(len(STAGES))))


def hop_stats(samples: DataFrame) -> DataFrame:
    """Per stage: lifetime count and maximum; last, mean and nearest-rank p95 of the last 256."""
    good = valid_samples(samples)
    lifetime = good.groupBy("stage").agg(F.count(F.lit(1)).alias("count"), F.max("ms").alias("max_ms"))
    window = newest(good, ["stage"], ["seq"], LATENCY_WINDOW)
    recent = window.groupBy("stage").agg(
        F.avg("ms").alias("avg_ms"),
        F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY ms)").alias("p95_ms"),
        F.max_by("ms", "seq").alias("last_ms"),
    )
    label, group, _ = stage_info("stage")
    return lifetime.join(recent, "stage").select(
        "stage", label.alias("label"), group.alias("stage_group"), "last_ms", "avg_ms", "p95_ms", "max_ms", "count"
    )


def slowest_stage(stats: DataFrame) -> DataFrame:
    """One row: the stage with the highest mean; waiting and wrap-up stages do not count."""
    _, _, position = stage_info("stage")
    work = stats.filter(~F.col("stage_group").isin("idle", "e2e"))
    best = work.agg(F.max_by(F.struct("stage", "label", "avg_ms"), F.struct("avg_ms", position)).alias("b"))
    return best.select("b.stage", "b.label", "b.avg_ms")


def hop_histogram(samples: DataFrame, buckets: list[float] = STAGE_BUCKETS) -> DataFrame:
    """Cumulative histogram rows (stage, le, n) with the stage's sample sum and count."""
    seconds = F.col("ms") / 1000.0
    counts = [F.count_if(seconds <= F.lit(float(b))).alias(f"b{i}") for i, b in enumerate(buckets)]
    wide = valid_samples(samples).groupBy("stage").agg(
        *counts, F.sum(seconds).alias("sum_s"), F.count(F.lit(1)).alias("count")
    )
    rows = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)))
    return wide.select("stage", "sum_s", "count", F.explode(rows).alias("r")).select("stage", "r.le", "r.n", "sum_s", "count")


def last_hops(samples: DataFrame) -> DataFrame:
    """Latest value of each stage per device, one column a stage, and the printed line."""
    good = valid_samples(samples)
    of = lambda s: F.max_by(F.when(F.col("stage") == s, F.col("ms")), F.when(F.col("stage") == s, F.col("seq")))
    wide = good.groupBy(F.coalesce(F.nullif(F.trim("pmu_id"), F.lit("")), F.lit("SYSTEM")).alias("pmu_id")).agg(
        *(of(s).alias(f"hop_{s}") for s, _, _ in STAGES)
    )
    parts = [F.concat(F.lit(f"{s}="), F.format_string("%.2fms", F.col(f"hop_{s}"))) for s, _, _ in STAGES]
    guarded = [F.when(F.col(f"hop_{s}").isNotNull(), p) for (s, _, _), p in zip(STAGES, parts)]
    return wide.withColumn("line", F.concat_ws(" ", *guarded))


def hop_map(hops: DataFrame) -> DataFrame:
    """The stage columns of :func:`last_hops` as one MAP, absent stages left out."""
    pairs = F.filter(
        F.array(*(F.struct(F.lit(s).alias("k"), F.col(f"hop_{s}").alias("v")) for s, _, _ in STAGES)),
        lambda p: p["v"].isNotNull(),
    )
    return hops.select("pmu_id", F.map_from_entries(pairs).alias("hops"))
