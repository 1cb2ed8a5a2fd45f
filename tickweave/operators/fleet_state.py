"""Device states and what the fleet views derive from them.

Tables here have one row per registered device. They are joined on the device name with
plain joins: the optimizer broadcasts a side when its measured size allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions import fleet
from tickweave.functions.bits import bits_at
from tickweave.functions.phasor import angle_delta
from tickweave.functions.registry import chart_label, device_slug
from tickweave.operators.chunked import newest

CONNECTED_WITHIN_US = 3_000_000
TREND_POINTS = 30

# --- fixed values: texts and limits of the fleet views ---
NO_DEVICE = "—"
PAIR_MARK = " ↔ "
VOLTAGE_CLASSES = ["765 kV", "400 kV", "220 kV", "HVDC", "132 kV"]
FALLBACK_HZ = 60
MAX_RECOMMENDATIONS, RULE_RECOMMENDATIONS = 8, (4, 3, 3)
MAX_ALERTS, ALERT_EVENTS, REC_EVENTS = 24, 18, 5


def number_text(x, digits: int) -> Column:
    """A number rounded to ``digits``, without trailing zeros."""
    c = F.col(x) if isinstance(x, str) else x
    fixed = F.round(c, digits).cast(f"decimal(18,{digits})").cast("string")
    return F.regexp_replace(F.regexp_replace(fixed, "0+$", ""), r"\.$", "")


LAST_FIELDS = [
    "received_us", "meas_us", "freq", "rocof", "fnom", "stat",
    "va_mag", "va_deg", "vb_mag", "vb_deg", "vc_mag", "vc_deg", "ia_mag", "ia_deg",
]


def latest_device_state(
    readings: DataFrame, as_of_us: Column, handshakes: DataFrame | None = None, within_us: int = CONNECTED_WITHIN_US
) -> DataFrame:
    """Per device the last delivered reading; phasors are blanked once it has gone silent.

    ``readings`` are delivered ones, or gated ones with their verdict: then the device's
    reject counters come out of the same pass.
    """
    gated = "quality_ok" in readings.columns
    ok = F.col("quality_ok") if gated else F.lit(True)
    skew = F.lower("reject_reason").contains("skew") if gated else F.lit(False)
    counters = {
        "quality_rejects": F.count_if(~ok),
        "skew_rejects": F.count_if(~ok & skew),
        "last_reject": F.max_by(F.when(~ok, F.col("reject_reason")), F.when(~ok, F.col("arrival_seq"))) if gated else None,
    }
    last = readings.groupBy("pmu_id").agg(
        F.count_if(ok).alias("total_frames"),
        F.max_by(F.when(ok, F.struct(*LAST_FIELDS)), F.when(ok, F.col("arrival_seq"))).alias("l"),
        *(c.alias(n) for n, c in counters.items() if gated),
    )
    extra = list(counters) if gated else []
    flat = last.select("pmu_id", "total_frames", *extra, *(F.col(f"l.{c}").alias(c) for c in LAST_FIELDS))
    connected = F.coalesce(as_of_us - F.col("received_us") <= within_us, F.lit(False))
    waiting = F.lit(False)
    if handshakes is not None:
        flat = flat.join(handshakes.select("pmu_id", F.lit(True).alias("_shook")).distinct(), "pmu_id", "left")
        waiting = F.coalesce("_shook", F.lit(False))
    text = (
        F.when(F.col("connected"), "receiving frames")
        .when(waiting, "handshake done, waiting for data")
        .otherwise("disconnected")
    )
    phasors = [c for c in LAST_FIELDS if c.endswith(("_mag", "_deg"))]
    plain = [c for c in LAST_FIELDS if c not in phasors and c != "received_us"]
    return flat.withColumn("connected", connected).select(
        "pmu_id",
        "total_frames",
        *extra,
        F.col("received_us").alias("last_received_us"),
        *plain,
        (F.col("freq") - F.col("fnom")).alias("freq_dev"),
        (bits_at("stat", 14, 3) != 0).alias("stat_data_error"),
        "connected",
        text.alias("connection_text"),
        *(F.when(F.col("connected"), F.col(c)).otherwise(F.lit(0.0)).alias(c) for c in phasors),
    )


def jitter(delivered: DataFrame) -> DataFrame:
    """Frequency spread over a device's last trend points, times 100; 2 below three points."""
    last = newest(delivered.select("pmu_id", "arrival_seq", "freq"), ["pmu_id"], ["arrival_seq"], TREND_POINTS)
    few = F.count(F.lit(1)) < 3
    return last.groupBy("pmu_id").agg(
        F.when(few, F.lit(fleet.UNKNOWN_JITTER)).otherwise(F.stddev_pop("freq") * 100).alias("jitter")
    )


def hops_join(states: DataFrame, hops: DataFrame) -> DataFrame:
    """States with their latest hops and a frame rate.

    A measured rate (``approx_fps``) wins, then the configured one, then, for a connected
    device, the one its inter-arrival time suggests.
    """
    measured = F.col("approx_fps") if "approx_fps" in states.columns else F.lit(0.0)
    out = states.withColumn("_measured", measured).join(hops, "pmu_id", "left")
    cfg = fleet.cfg_rate_fps("data_rate")
    gap = F.col("hop_frame_gap")
    from_gap = F.when(F.col("connected") & (gap > 1) & (gap < 500), F.try_divide(F.lit(1000.0), gap))
    return out.withColumn(
        "approx_fps",
        F.when(F.col("_measured") > 0, F.col("_measured")).when(cfg > 0, cfg).otherwise(F.coalesce(from_gap, F.lit(0.0))),
    ).drop("_measured")


def registry_state_join(registry: DataFrame, states: DataFrame) -> DataFrame:
    """Every registered device with its live state, or with what an offline device shows.

    ``states`` come from gated readings, with their reject counters.
    """
    c = F.col
    joined = registry.withColumnRenamed("name", "pmu_id").join(states, "pmu_id", "left")
    zero = lambda n, v=0.0: F.coalesce(c(n), F.lit(v)).alias(n)
    own = ["pmu_id", "active", "station", "region", "vendor", "voltage", "ip", "data_rate"]
    return joined.select(
        *own,
        F.coalesce("connected", F.lit(False)).alias("connected"),
        F.coalesce("connection_text", F.lit("disconnected")).alias("connection_text"),
        F.coalesce(F.nullif(F.trim("station"), F.lit("")), c("pmu_id")).alias("substation"),
        F.when(c("data_rate") > 0, c("data_rate")).otherwise(0).alias("target_rate"),
        "last_received_us",
        *(zero(n, 0) for n in ("total_frames", "quality_rejects", "skew_rejects", "fnom")),
        F.coalesce("last_reject", F.lit("")).alias("last_reject"),
        *(zero(n) for n in ("freq", "freq_dev", "rocof", "va_mag", "va_deg")),
        F.coalesce("stat_data_error", F.lit(False)).alias("stat_data_error"),
    )


def fleet_table(devices: DataFrame, hops: DataFrame, jitters: DataFrame) -> DataFrame:
    """Devices with every derived measure the fleet views use, one row per device."""
    c = F.col
    base = hops_join(devices, hops).join(jitters, "pmu_id", "left")
    live, cfg = fleet.effective_fps("approx_fps", "hop_frame_gap"), fleet.cfg_rate_fps("data_rate")
    measured = base.withColumns(
        {
            "live_fps": live,
            "cfg_fps": cfg,
            "loss": fleet.loss_pct("quality_rejects", "total_frames"),
            "latency": fleet.latency_ms("connected", "hop_e2e_recv_to_dashboard"),
            "jitter": F.when(~c("connected"), F.lit(fleet.OFFLINE_JITTER)).otherwise(
                F.coalesce("jitter", F.lit(fleet.UNKNOWN_JITTER))
            ),
        }
    )
    advice = fleet.link_advice("connected", "loss", "latency", "jitter")
    return measured.withColumns(
        {
            "shown_fps": fleet.display_fps("connected", "live_fps", "cfg_fps"),
            "avail": fleet.availability_pct("connected", "live_fps", "cfg_fps"),
            "tone": fleet.device_tone("connected", "loss"),
            "status_label": fleet.link_status("connected", "loss", "latency"),
            "device_status": fleet.device_status("connected", "loss"),
            "link": F.when(c("connected"), "Primary").otherwise("Down"),
            "label": chart_label("pmu_id", "station"),
            **advice,
        }
    )


# ------------------------------------------------------------------ filters


def device_filter(
    devices: DataFrame, tab: str = "all", search: str = "", tone: str = "ALL", region: str = "ALL"
) -> DataFrame:
    c = F.col
    text = F.lower(F.concat_ws(" ", "pmu_id", "substation", "vendor", "ip"))
    out = devices.filter(text.contains(search.lower()))
    if tab == "connected":
        out = out.filter("active")
    elif tab == "disconnected":
        out = out.filter(~c("active"))
    if tone != "ALL":
        out = out.filter(F.upper("tone") == tone)
    if region != "ALL":
        out = out.filter(c("region") == region)
    return out


def issues_filter(devices: DataFrame) -> DataFrame:
    return devices.filter(~F.col("connected") | (F.col("loss") > 1))


# ------------------------------------------------------------------ summaries


def region_summary(devices: DataFrame) -> DataFrame:
    return devices.groupBy("region").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("connected").alias("connected"), F.avg("avail").alias("availability")
    )


def category_counts(devices: DataFrame) -> DataFrame:
    """(kind, name, n): devices per region and vendor, and per voltage class with zeros kept."""
    region = F.coalesce(F.nullif("region", F.lit("")), F.lit("Unknown"))
    by = lambda kind, key: devices.groupBy(key.alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    per_class = devices.agg(*(F.count_if(F.col("voltage") == v).alias(v) for v in VOLTAGE_CLASSES))
    rows = F.array(*(F.struct(F.lit(v).alias("name"), F.col(f"`{v}`").alias("n")) for v in VOLTAGE_CLASSES))
    classes = per_class.select(F.explode(rows).alias("r")).select(F.lit("voltage").alias("kind"), "r.name", "r.n")
    return by("region", region).unionByName(classes).unionByName(by("vendor", F.col("vendor")))


def device_summary(devices: DataFrame) -> DataFrame:
    """One row; connected devices without a latency are left out of its mean."""
    status = F.col("device_status")
    measured = F.when(F.col("connected") & ~F.isnan("latency"), F.col("latency"))
    return devices.agg(
        F.count(F.lit(1)).alias("registered"),
        F.countDistinct("region").alias("regions"),
        *(F.count_if(status == s).alias(s.lower()) for s in ("Healthy", "Degraded", "Offline")),
        F.coalesce(F.round(F.avg("avail"), 1), F.lit(0.0)).alias("avg_availability"),
        F.coalesce(F.round(F.avg(measured), 0), F.lit(0.0)).alias("avg_latency"),
    )


def system_counts(devices: DataFrame) -> DataFrame:
    """One row over the enabled devices, and the tab counts over all."""
    on = F.col("active")
    counts = devices.agg(
        F.count_if(on & F.col("connected")).alias("connected"),
        F.count_if(on & ~F.col("connected")).alias("disconnected"),
        F.coalesce(F.sum(F.when(on, F.col("quality_rejects"))), F.lit(0)).alias("total_errors"),
        F.count_if(on).alias("tab_active"),
        F.count_if(~on).alias("tab_inactive"),
    )
    gone = F.col("disconnected")
    return counts.withColumn("tone", F.when(gone >= 2, "bad").when(gone > 0, "warn").otherwise("ok")).withColumn(
        "message",
        F.when(gone >= 2, F.concat(gone.cast("string"), F.lit(" streams offline - operator action required")))
        .when(gone > 0, F.concat(gone.cast("string"), F.lit(" streams need attention")))
        .otherwise("All systems nominal"),
    )


def _worst(flag: Column, value: Column, name: str = "pmu_id") -> Column:
    """STRUCT(value, name) of the largest |value| among flagged rows; ties go to the last name."""
    pick = F.struct(value.alias("value"), F.col(name).alias("name"))
    return F.max_by(F.when(flag, pick), F.when(flag, F.struct(F.abs(value), F.col(name))))


def fleet_kpis(devices: DataFrame) -> DataFrame:
    """One row of overview numbers over the given devices."""
    on = F.col("connected")
    rows = devices.agg(
        F.count(F.lit(1)).alias("total"),
        F.countDistinct("substation").alias("substations"),
        F.count_if(~on).alias("offline"),
        F.count_if(~on | (F.col("loss") > 1)).alias("issues"),
        fleet.js_round(F.sum("shown_fps")).cast("bigint").alias("total_fps"),
        _worst(on, F.col("freq_dev")).alias("df"),
        _worst(on, F.abs("rocof")).alias("ro"),
        F.count_if(on & F.col("stat_data_error")).alias("stat_errors"),
        F.count_if(on).alias("online"),
    )
    return rows.select(
        "total", "substations", "offline", "issues", "total_fps", "stat_errors", "online",
        F.coalesce("df.value", F.lit(0.0)).alias("worst_df"), F.coalesce("df.name", F.lit(NO_DEVICE)).alias("worst_df_pmu"),
        F.coalesce("ro.value", F.lit(0.0)).alias("max_rocof"), F.coalesce("ro.name", F.lit(NO_DEVICE)).alias("max_rocof_pmu"),
    )


def fleet_nominal(devices: DataFrame, fallback: int = FALLBACK_HZ) -> DataFrame:
    """One row: most frequent nominal Hz (ties: met first) and that of the first device."""
    known = devices.filter(F.col("fnom") > 0).groupBy("fnom").agg(
        F.count(F.lit(1)).alias("n"), F.min("pmu_id").alias("first_name")
    )
    return known.agg(
        # smallest (-n, first name) is the most frequent, first-met value
        F.coalesce(F.min_by("fnom", F.struct(-F.col("n"), F.col("first_name"))), F.lit(fallback)).alias("most_frequent"),
        F.coalesce(F.min_by("fnom", "first_name"), F.lit(fallback)).alias("first_seen"),
    )


def arrival_spread(devices: DataFrame) -> DataFrame:
    """One row: how far apart the online devices' last arrivals are; none below two devices."""
    t = F.floor(F.col("last_received_us") / 1000)
    online = devices.filter(F.col("connected") & F.col("last_received_us").isNotNull()).withColumn("t", t)
    parse = F.coalesce(F.avg(fleet.hop_value("hop_parse")), F.lit(0.0))
    order = F.struct("t", "pmu_id")
    rows = online.agg(
        (F.max("t") - F.min("t")).cast("double").alias("spread_ms"),
        parse.alias("parse_avg_ms"),
        F.min_by("pmu_id", order).alias("earliest"),
        F.max_by("pmu_id", order).alias("latest"),
        F.count(F.lit(1)).alias("n"),
    )
    return rows.filter("n >= 2").withColumn("total_ms", F.col("spread_ms") + F.col("parse_avg_ms"))


CYCLE_FIELDS = ["pmu_wait", "parse", "pipeline", "pipeline_rest", "total", "fps_hint"]


def mean_cycle_latency(devices: DataFrame) -> DataFrame:
    """One row: the mean sample cycle over devices that have one."""
    cycle = fleet.cycle_latency("connected", "hop_frame_gap", "hop_parse", "hop_e2e_recv_to_dashboard", "approx_fps")
    known = devices.select(cycle.alias("c")).filter(F.col("c").isNotNull())
    rows = known.agg(F.count(F.lit(1)).alias("n"), *(F.avg(f"c.{f}").alias(f) for f in CYCLE_FIELDS))
    return rows.filter("n > 0")


# ------------------------------------------------------------------ angles between devices


def device_pairs(online: DataFrame) -> DataFrame:
    """All unordered pairs of the given devices with the angle between their VA phasors.

    The result is quadratic in the number of online devices by its definition. Each
    device is paired with the part of the sorted fleet array behind it, without a join.
    """
    one = F.struct(
        F.col("pmu_id").alias("pmu_id"), device_slug("pmu_id").alias("slug"), F.col("label").alias("label"),
        F.col("region").alias("region"), F.col("va_deg").alias("va_deg"),
    )
    everyone = online.agg(F.array_sort(F.collect_list(one))).scalar()
    later = online.select("*", F.explode(everyone).alias("o")).filter(F.col("o.pmu_id") > F.col("pmu_id"))
    return later.select(
        F.concat_ws("__", device_slug("pmu_id"), F.col("o.slug")).alias("pair"),
        F.concat(F.col("label"), F.lit(PAIR_MARK), F.col("o.label")).alias("name"),
        F.round(angle_delta("va_deg", F.col("o.va_deg")), 2).alias("value"),
        F.col("region").alias("region_a"),
        F.col("o.region").alias("region_b"),
    )


def angle_pairs_topk(pairs: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` widest pairs; equal ones in fleet order."""
    return pairs.orderBy(F.desc("value"), "pair").limit(k)


def widest_pairs(online: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` widest of :func:`device_pairs`, without forming all of them.

    Devices are numbered round the circle by angle. A device's widest partners stand nearest to the point opposite to it, so it
    meets the ``2 k`` before and after that point alone: the pairs formed are ``4 k`` for each device. Of devices with one angle
    the first ``k + 1`` are enough, as all of them make the same angles. Angles that differ by less than the second decimal
    of a pair's value may change places with their equals.
    """
    at = F.pmod(F.col("va_deg").cast("double"), F.lit(360.0))
    same = W.partitionBy("_at").orderBy("pmu_id")
    one = online.select("pmu_id", device_slug("pmu_id").alias("slug"), "label", "region", "va_deg", at.alias("_at")).filter("_at IS NOT NULL")
    one = one.withColumn("_r", F.row_number().over(same)).filter(F.col("_r") <= k + 1).drop("_r")
    # marks of devices and of the points opposite to them, counted degree by degree: how many devices stand before each
    marks = one.select(F.col("_at").alias("_mark"), F.lit(1).alias("_is"), "pmu_id").unionByName(
        one.select(F.pmod(F.col("_at") + 180, F.lit(360.0)).alias("_mark"), F.lit(0).alias("_is"), "pmu_id")
    )
    marks = marks.withColumn("_chunk", F.floor("_mark"))
    sizes = marks.groupBy("_chunk").agg(F.sum("_is").alias("_n"))
    offsets = sizes.select("_chunk", F.coalesce(F.sum("_n").over(W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = W.partitionBy("_chunk").orderBy("_mark", "_is", "pmu_id").rowsBetween(W.unboundedPreceding, -1)
    placed = marks.withColumn("_own", F.coalesce(F.sum("_is").over(inside), F.lit(0))).join(offsets, "_chunk")
    placed = placed.select("pmu_id", "_is", (F.col("_before") + F.col("_own")).alias("_pos"))
    n = one.agg(F.count(F.lit(1))).scalar()
    near = F.explode(F.sequence(F.lit(-2 * k), F.lit(2 * k - 1)))
    meets = placed.filter("_is = 0").select("pmu_id", "_pos", near.alias("_step")).select("pmu_id", F.pmod(F.col("_pos") + F.col("_step"), n).alias("_pos"))
    others = placed.filter("_is = 1").select("_pos", F.col("pmu_id").alias("_other"))
    met = meets.join(others, "_pos").filter("pmu_id <> _other")
    met = met.select(F.least("pmu_id", "_other").alias("pmu_id"), F.greatest("pmu_id", "_other").alias("_other")).distinct()
    b = one.select(*(F.col(c).alias(f"o_{c}") for c in ("pmu_id", "slug", "label", "region", "va_deg")))
    pairs = met.join(one, "pmu_id").join(b, F.col("_other") == F.col("o_pmu_id")).select(
        F.concat_ws("__", "slug", "o_slug").alias("pair"),
        F.concat("label", F.lit(PAIR_MARK), "o_label").alias("name"),
        F.round(angle_delta("va_deg", F.col("o_va_deg")), 2).alias("value"),
        F.col("region").alias("region_a"),
        F.col("o_region").alias("region_b"),
    )
    return angle_pairs_topk(pairs, k)


# ------------------------------------------------------------------ advice


def connectivity_kpis(rows: DataFrame) -> DataFrame:
    """One row of link numbers."""
    on = F.col("connected")
    measured = F.when(on & ~F.isnan("latency") & (F.col("latency") < fleet.UNMEASURED_LATENCY_MS), F.col("latency"))
    return rows.agg(
        F.count_if(F.col("tone") != "ok").alias("issues"),
        F.count_if(~on).alias("offline"),
        F.count_if(F.col("loss") > 1.5).alias("high_loss"),
        F.coalesce(F.avg(measured), F.lit(0.0)).alias("avg_latency"),
        F.count(measured).alias("measured"),
        F.count_if(on).alias("online"),
        F.count(F.lit(1)).alias("total"),
    )


def connectivity_sort(rows: DataFrame) -> DataFrame:
    """Offline, then degraded, then healthy; the lossier first."""
    weight = F.when(~F.col("connected"), 0).when(F.col("status_label") == "Degraded", 1).otherwise(2)
    return rows.withColumn("weight", weight).orderBy("weight", F.desc("loss"), "pmu_id")


def _advice(rows: DataFrame, rule: int, sev, title: Column, desc: Column, *order: Column) -> DataFrame:
    sev = F.lit(sev) if isinstance(sev, str) else sev
    keys = [F.lit(rule).alias("rule"), *(o.alias(f"k{i}") for i, o in enumerate(order))]
    return rows.select(F.struct(*keys).alias("ord"), sev.alias("sev"), title.alias("title"), desc.alias("desc"))


# --- fixed values: advice texts ---
REC_TEXT = {
    "offline": "No recent frames. Check IP/port, protocol, and that only one DATA client is connected.",
    "offline_analytics": "No recent DATA frames. Check reachability and PDC receiver link.",
    "nominal": "No offline streams or latency/loss alerts on the current snapshot.",
    "stat": "Latest STAT word reports a data-error condition.",
}


def connectivity_recs(rows: DataFrame, most: int = MAX_RECOMMENDATIONS, per_rule: tuple[int, int, int] = RULE_RECOMMENDATIONS) -> DataFrame:
    """The first ``most`` pieces of advice in rule order, of each rule (offline, loss, latency) at most ``per_rule``, or the all-clear."""
    c, t = F.col, F.lit
    # the order of the connectivity table: offline first, then by weight and loss
    table = rows.withColumn("_w", F.when(~c("connected"), 0).when(c("status_label") == "Degraded", 1).otherwise(2))
    order = [c("_w"), -c("loss"), c("pmu_id")]

    def rule(no: int, test: Column, k: int, sev: str, title: str, desc: Column) -> DataFrame:
        hit = table.filter(test).orderBy(*order).limit(k)
        return _advice(hit, no, sev, F.concat(t(title), c("pmu_id")), desc, *order)

    slow = c("connected") & ~F.isnan("latency") & (c("latency") > 50)
    found = (
        rule(0, ~c("connected"), per_rule[0], "bad", "Offline — ", t(REC_TEXT["offline"]))
        .unionByName(
            rule(1, c("connected") & (c("loss") > 2), per_rule[1], "warn", "Packet loss — ",
                 F.concat(t("Quality rejects "), number_text("loss", 2), t("%. Inspect STAT / network path.")))
        )
        .unionByName(
            rule(2, slow, per_rule[2], "warn", "High latency — ",
                 F.concat(t("Receive→dashboard "), number_text("latency", 2), t(" ms (target under ~15 ms for local pipeline).")))
        )
    )
    clear = F.struct(
        F.struct(t(3).alias("rule"), t(0).alias("k0"), t(0.0).alias("k1"), t("").alias("k2")).alias("ord"),
        t("info").alias("sev"), t("Links nominal").alias("title"), t(REC_TEXT["nominal"]).alias("desc"),
    )
    none_found = found.agg(F.count(t(1)).alias("n")).filter("n = 0").select(F.explode(F.array(clear)).alias("r")).select("r.*")
    return found.unionByName(none_found).orderBy("ord").limit(most)


def analytics_recs(
    devices: DataFrame, pairs: DataFrame, events: DataFrame, most: int = MAX_RECOMMENDATIONS, newest_events: int = REC_EVENTS
) -> DataFrame:
    """The first ``most`` advisories in rule order; a title shows once.

    ``events``: the feed newest last (``seq``); its ``newest_events`` last are looked at.
    """
    c, t = F.col, F.lit
    null = lambda kind: F.lit(None).cast(kind)
    worst = angle_pairs_topk(pairs, 1).filter("value > 25")
    angle = _advice(
        worst, 0, F.when(c("value") > 30, "bad").otherwise("warn"), F.concat(t("Large angle separation: "), c("name")),
        F.concat(t("Inter-PMU VA angle Δ = "), number_text("value", 1), t("° (from live phasors).")),
        t(0), null("double"), t(""),
    )
    # three checks per connected device, in device order
    fnom = F.when(c("fnom") > 0, c("fnom")).otherwise(FALLBACK_HZ)
    df, rocof = c("freq_dev"), F.abs("rocof")
    check = lambda test, step, sev, title, desc: F.when(
        test,
        F.struct(t(step).alias("step"), F.coalesce(sev, t("info")).alias("sev"), F.concat(t(title), c("pmu_id")).alias("title"), desc.alias("desc")),
    )
    checks = F.array_compact(
        F.array(
            check(
                F.abs(df) > 0.05, 0, F.when(F.abs(df) > 0.1, "warn"), "Frequency deviation on ",
                F.concat(
                    t("f = "), number_text("freq", 3), t(" Hz · Δf = "), F.when(df >= 0, "+").otherwise(""), number_text(df, 4),
                    t(" Hz vs CFG FNOM "), fnom.cast("string"), t(" Hz."),
                ),
            ),
            check(
                rocof > 0.05, 1, F.when(rocof > 0.1, "warn"), "Elevated ROCOF on ",
                F.concat(t("|ROCOF| = "), number_text(rocof, 4), t(" Hz/s from DATA frame DFREQ.")),
            ),
            check(c("stat_data_error"), 2, t("bad"), "STAT data error on ", t(REC_TEXT["stat"])),
        )
    )
    per_device = devices.filter("connected").select("pmu_id", F.explode(checks).alias("r"))
    state = _advice(per_device, 1, c("r.sev"), c("r.title"), c("r.desc"), t(0), null("double"), F.concat_ws("#", "pmu_id", c("r.step").cast("string")))
    weight = F.when(~c("connected"), 0).when(c("status_label") == "Degraded", 1).otherwise(2)
    lossy = c("connected") & (c("loss") > 1)
    links = _advice(
        devices.filter(~c("connected") | lossy), 2, F.when(c("connected"), "warn").otherwise("bad"),
        F.concat(F.when(c("connected"), "Quality rejects on ").otherwise("Offline: "), c("pmu_id")),
        F.when(
            c("connected"),
            F.concat(t("Reject rate ≈ "), number_text("loss", 2), t("% of frames (qualityRejects / totalFrames).")),
        ).otherwise(REC_TEXT["offline_analytics"]),
        weight, -c("loss"), c("pmu_id"),
    )
    text = F.lower(F.concat_ws(" ", "status", "message"))
    feed = events.orderBy(F.desc("seq")).limit(newest_events).filter(
        text.contains("error") | text.contains("reject") | text.contains("timeout")
    )
    noted = _advice(
        feed, 3, F.when(text.contains("error"), "bad").otherwise("info"), F.concat_ws(" · ", "stage", "pmu_id"), c("message"),
        t(0), -c("seq").cast("double"), t(""),
    )
    every = angle.unionByName(state).unionByName(links).unionByName(noted)
    first = every.groupBy("title").agg(F.min_by(F.struct("ord", "sev", "desc"), "ord").alias("f"))
    return first.select("f.ord", "f.sev", "title", "f.desc").orderBy("ord").limit(most)


def analytics_kpis(devices: DataFrame, pairs: DataFrame, recs: DataFrame) -> DataFrame:
    """One row: angle, frequency, deviation and advisory numbers with their tones."""
    on = F.col("connected")
    nominal = F.coalesce(F.min_by(F.when(on & (F.col("fnom") > 0), F.col("fnom")), F.when(on & (F.col("fnom") > 0), F.col("pmu_id"))), F.lit(FALLBACK_HZ))
    rows = devices.agg(
        F.count_if(on).alias("online"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.avg(F.when(on, F.col("freq"))), nominal.cast("double")).alias("avg_freq"),
        nominal.alias("fnom"),
        _worst(on, F.col("freq_dev")).alias("df"),
        _worst(on, F.abs("rocof")).alias("ro"),
    )
    top = angle_pairs_topk(pairs, 1)
    tone = lambda test, yes, no: F.when(test, yes).otherwise(no)
    c = F.col
    flat = rows.select(
        "online", "total", "avg_freq", "fnom",
        F.coalesce(top.agg(F.max("value")).scalar(), F.lit(0.0)).alias("max_angle"),
        top.agg(F.max("name")).scalar().alias("max_angle_pair"),
        F.coalesce("df.value", F.lit(0.0)).alias("worst_df"), F.coalesce("df.name", F.lit(NO_DEVICE)).alias("worst_df_pmu"),
        F.coalesce("ro.value", F.lit(0.0)).alias("max_rocof"), F.coalesce("ro.name", F.lit(NO_DEVICE)).alias("max_rocof_pmu"),
        recs.agg(F.count(F.lit(1))).scalar().alias("advisories"),
    )
    return flat.withColumns(
        {
            "angle_tone": F.when(c("online") < 2, "neutral").otherwise(tone(c("max_angle") > 20, "warn", "ok")),
            "df_tone": tone(F.abs("worst_df") > 0.05, "warn", "ok"),
            "rocof_tone": tone(c("max_rocof") > 0.1, "warn", "neutral"),
            "online_tone": tone(c("online") < c("total"), "warn", "ok"),
            "advisory_tone": tone(c("advisories") > 0, "accent", "ok"),
        }
    )


def live_alerts(devices: DataFrame, events: DataFrame, most: int = MAX_ALERTS, newest_events: int = ALERT_EVENTS) -> DataFrame:
    """State alerts, then the ``newest_events`` last events; the first ``most`` of them."""
    c, t = F.col, F.lit
    on = c("connected")
    state = _advice(
        issues_filter(devices), 0, F.when(on, "warn").otherwise("bad"),
        F.when(on, "Elevated packet loss").otherwise("PMU offline"),
        F.concat(c("pmu_id"), t(" - "), F.when(on, F.concat(number_text("loss", 2), t("% loss"))).otherwise("stream disconnected")),
        F.lit(0.0), c("pmu_id"),
    )
    feed = events.orderBy(F.desc("seq")).limit(newest_events)
    noted = _advice(
        feed, 1, fleet.alert_severity("status", "message"), c("stage"), F.concat(c("pmu_id"), t(" - "), c("message")),
        -c("seq").cast("double"), t(""),
    )
    return state.unionByName(noted).orderBy("ord").limit(most)
