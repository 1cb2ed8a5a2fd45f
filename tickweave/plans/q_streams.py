"""Streaming queries: the views land as files, a stream takes them, its table is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.plans import views as v
from tickweave.plans.q_align import HALF_HOUR_US
from tickweave.plans.q_decode import layouts, raw_cfg2, raw_frames
from tickweave.plans.registry import query, r6
from tickweave.session import checkpoint_root
from tickweave.sources import tables
from tickweave.streaming import jobs

d6 = v.d6
LANDINGS, FILES = 4, 4


class Run:
    """Folders of one run below the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.root = spark, f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.landing, self.out = f"{self.root}/landing", f"{self.root}/out"

    def land(self, rows: DataFrame) -> DataFrame:
        """Write rows in arrival order, landing by landing, each with some files, and stream back one landing at a time."""
        bounds = rows.agg(F.min("arrival_seq").alias("lo"), F.max("arrival_seq").alias("hi")).first()
        step = (bounds.hi - bounds.lo) // LANDINGS + 1
        for i in range(LANDINGS):
            part = rows.filter(F.floor((F.col("arrival_seq") - bounds.lo) / step) == i)
            part.repartition(FILES).write.mode("append").parquet(self.landing)
        reader = self.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES)
        return reader.parquet(self.landing)

    def take(self, stream: DataFrame, tables: dict, mode: str = "append") -> None:
        jobs.run_now(jobs.write_batches(stream, self.out, f"{self.root}/state", tables, mode))

    def table(self, name: str) -> DataFrame:
        return jobs.read_batches(self.spark, self.out, name)


AS_IS = {"rows": lambda batch: batch}


@query("src_raw_stream", "SELECT arrival_seq, pmu_id, received_us FROM frames")
def _(spark, sf):
    run = Run(spark, "raw")
    run.land(raw_frames(spark, sf))
    stream = tables.stream_raw_frames(spark, run.landing, max_files=FILES)
    run.take(stream, AS_IS)
    return run.table("rows").select("arrival_seq", "pmu_id", "received_us")


@query("stream_quality", "SELECT arrival_seq, quality_ok, reject_reason FROM gated")
def _(spark, sf):
    run = Run(spark, "quality")
    stream = jobs.stream_quality(run.land(v.frames(spark, sf)))
    sides = {"good": lambda b: b.filter("quality_ok"), "rejected": lambda b: b.filter("NOT quality_ok")}
    run.take(stream, sides)
    both = run.table("good").unionByName(run.table("rejected"))
    return both.select("arrival_seq", "quality_ok", "reject_reason")


@query(
    "stream_decode",
    f"""
SELECT arrival_seq, CASE WHEN arrival_seq % 97 = 0 OR arrival_seq % 101 = 0 OR arrival_seq % 107 = 0 THEN FALSE ELSE TRUE END AS good,
  {r6('CASE WHEN NOT (arrival_seq % 97 = 0 OR arrival_seq % 101 = 0 OR arrival_seq % 107 = 0) THEN 50 + freq_q / 1000.0::DOUBLE END')} AS freq FROM quantised
""",
)
def _(spark, sf):
    run = Run(spark, "decode")
    readings = jobs.stream_readings(run.land(raw_frames(spark, sf)), layouts(spark, sf))
    run.take(readings.select("arrival_seq", "error", "freq"), AS_IS)
    return run.table("rows").select("arrival_seq", F.col("error").isNull().alias("good"), d6("freq").alias("freq"))


DELAY_US = 3 * v.HOUR_US


def _watermark_ms(stamp: str, source: str) -> str:
    return f"((SELECT max({stamp}) FROM {source}) // 1000 - {DELAY_US // 1000})"


@query(
    "align_stream",
    f"""
SELECT tick_us, pmu_id, arrival_seq FROM half_hourly_samples
WHERE tick_us + {HALF_HOUR_US // 2} < {_watermark_ms("meas_us", "frames_edge")} * 1000
""",
)
def _(spark, sf):
    run = Run(spark, "align")
    rows = v.frames_edge(spark, sf).select("arrival_seq", "pmu_id", "meas_us", "freq")
    points = jobs.align_stream(run.land(rows), HALF_HOUR_US, f"{DELAY_US} microseconds")
    run.take(points, {"points": lambda batch: batch})
    return run.table("points").select("tick_us", "pmu_id", "arrival_seq")


# event times before this have all been seen: whole seconds before the watermark
_SEEN = f"{_watermark_ms('received_us', 'frames')} // 1000 * 1000000"


@query(
    "stream_sessions",
    f"""
WITH s AS (
  SELECT pmu_id, min(received_us) AS became_live_us, max(received_us) + 1000000 AS left_live_us, count(*) AS frames FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY pmu_id ORDER BY received_us ROWS UNBOUNDED PRECEDING) AS run FROM (
      SELECT pmu_id, received_us, CASE WHEN received_us - lag(received_us) OVER (PARTITION BY pmu_id ORDER BY received_us) <= 1000000
        THEN 0 ELSE 1 END AS fresh FROM frames)) GROUP BY pmu_id, run)
SELECT pmu_id, 'became_live' AS type, became_live_us AS time_us, became_live_us, CAST(0 AS BIGINT) AS frames FROM s WHERE became_live_us < {_SEEN}
UNION ALL SELECT pmu_id, 'left_live', left_live_us, became_live_us, frames FROM s WHERE left_live_us < {_SEEN}
""",
)
def _(spark, sf):
    run = Run(spark, "sessions")
    rows = v.frames(spark, sf).select("arrival_seq", "pmu_id", "received_us")
    run.take(jobs.stream_sessions(run.land(rows), f"{DELAY_US} microseconds"), AS_IS)
    return run.table("rows").drop("batch")


@query("stream_estimators")
def _(spark, sf):
    run = Run(spark, "estimators")
    rows = v.frames_dense(spark, sf).withColumn("quality_ok", F.col("arrival_seq") % 1000 < 900)
    run.take(jobs.stream_estimators(run.land(rows)), AS_IS)
    return run.table("rows").drop("batch")


_EDGES = """
SELECT pmu_id, arrival_seq, received_us, CASE WHEN quality_ok THEN 'quality_recovered' ELSE 'quality_degraded' END AS type, reject_reason AS reason
FROM (SELECT *, lag(quality_ok) OVER (PARTITION BY pmu_id ORDER BY arrival_seq) AS prev FROM gated)
WHERE (quality_ok AND NOT prev) OR (NOT quality_ok AND coalesce(prev, TRUE))"""


@query(
    "stream_history",
    f"""
SELECT 'frame' AS kind, pmu_id, received_us AS time_us, CASE WHEN quality_ok THEN 'ok' ELSE reject_reason END AS what FROM gated
UNION ALL SELECT 'event', pmu_id, received_us, type || coalesce(':' || reason, '') FROM ({_EDGES})
UNION ALL SELECT 'layouts', NULL, count(*), NULL FROM cfg_profile
""",
)
def _(spark, sf):
    run, edges = Run(spark, "history"), Run(spark, "events")
    landed = run.land(v.frames(spark, sf))
    run.take(jobs.stream_quality(landed), jobs.history_tables())
    edges.take(jobs.stream_edges(jobs.stream_quality(landed)), jobs.event_tables())
    lay = Run(spark, "layouts")
    sent = raw_cfg2(spark, sf).withColumn("arrival_seq", F.col("received_us"))
    lay.take(lay.land(sent), jobs.layout_tables())
    frames, events, none = run.table("frames"), edges.table("events"), F.lit(None).cast("string")
    reason = F.get_json_object("detail", "$.reason")
    return (
        frames.select(F.lit("frame").alias("kind"), "pmu_id", F.col("received_us").alias("time_us"), F.when(F.col("quality_ok"), "ok").otherwise(F.col("reject_reason")).alias("what"))
        .unionByName(events.select(F.lit("event").alias("kind"), "pmu_id", "time_us", F.concat("type", F.when(reason.isNotNull(), F.concat(F.lit(":"), reason)).otherwise("")).alias("what")))
        .unionByName(lay.table("layouts").agg(F.count(F.lit(1)).alias("time_us")).select(F.lit("layouts").alias("kind"), none.alias("pmu_id"), "time_us", none.alias("what")))
    )


@query("stream_quality_edges", _EDGES)
def _(spark, sf):
    run = Run(spark, "edges")
    run.take(jobs.stream_edges(jobs.stream_quality(run.land(v.frames(spark, sf)))), AS_IS)
    return run.table("rows").drop("batch")


@query(
    "sink_history_stream",
    f"""
SELECT received_us, pmu_id, quality_ok, reject_reason, stat, {r6('freq')} AS freq, {r6('freq - 50')} AS freq_dev FROM gated
""",
)
def _(spark, sf):
    run = Run(spark, "sink")
    frames_only = {"frames": jobs.history_tables()["frames"]}
    run.take(jobs.stream_quality(run.land(v.frames(spark, sf))), frames_only)
    return run.table("frames").select(
        "received_us", "pmu_id", "quality_ok", "reject_reason", "stat", d6("freq").alias("freq"), d6("freq_dev").alias("freq_dev")
    )


@query(
    "stream_latest_state",
    f"SELECT pmu_id, count(*) AS total_frames, max(arrival_seq) AS arrival_seq, {r6('arg_max(freq, arrival_seq)')} AS freq FROM accepted GROUP BY pmu_id",
)
def _(spark, sf):
    run = Run(spark, "latest")
    latest = jobs.stream_latest_state(jobs.stream_quality(run.land(v.frames(spark, sf))).filter("quality_ok"))
    jobs.run_now(jobs.upsert_batches(latest, run.out, f"{run.root}/state", "pmu_id", buckets=4))
    rows = jobs.read_upserts(spark, run.out, latest.schema)
    return rows.select("pmu_id", "total_frames", "arrival_seq", d6("freq").alias("freq"))
