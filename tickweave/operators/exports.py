"""Tables people take away: parsed dumps, buffer sheets, the state document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickweave.functions.bits import stat_fields, time_quality_fields
from tickweave.operators import latency
from tickweave.operators.chunked import newest
from tickweave.operators.fleet_state import TREND_POINTS

# --- fixed values: numbers printed with six decimals in a parsed dump, in order ---
PARSED_NUMBERS = [
    "freq", "freq_dev", "rocof", "mw", "mvar", "mva", "power_factor",
    "va_mag", "va_ang", "vb_mag", "vb_ang", "vc_mag", "vc_ang", "ia_mag", "ia_ang",
]


def iso_time(us) -> Column:
    c = F.col(us) if isinstance(us, str) else us
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def parsed_capture_rows(frames: DataFrame) -> DataFrame:
    """The 27 columns of a parsed dump, numbers as text with fixed decimals."""
    c = F.col
    number = {n: c(n.replace("_ang", "_deg")) for n in PARSED_NUMBERS}
    six = lambda x: x.cast("decimal(24,6)").cast("string")
    return frames.select(
        "index",
        iso_time("meas_us").alias("time"),
        c("pmu_id").alias("pmu_name"),
        "idcode",
        "soc",
        "fracsec_count",
        iso_time("received_us").alias("captured_at"),
        ((c("received_us") - c("meas_us")) / 1000.0).cast("decimal(24,3)").cast("string").alias("lag_ms"),
        *(six(x).alias(n) for n, x in number.items()),
        "stat",
        "digital",
        "crc_valid",
        "time_quality",
    )


# --- fixed values: the columns of a buffer sheet before the channels, in order ---
SHEET_COLUMNS = [
    "ts_ms", "time_utc", "pmu_name", "idcode",
    "wire_soc", "fracsec_raw", "fracsec_count", "timestamp",
    "received_at_ns", "received_at_utc",
    "checksum", "checksum_valid", "frame_size", "frame_bytes",
    "stat_raw", "data_error_code", "data_error", "cfg_change", "trigger",
    "sort_by_arrival", "sync_unlocked", "pmu_time_quality", "unlocked_duration", "trigger_reason",
    "msg_tq_raw", "leap_second_direction", "leap_second_occurred", "leap_second_pending", "time_quality_code",
    "fnom_hz", "frequency_hz", "frequency_deviation_hz", "rocof_hz_per_sec",
    "va_real", "va_imag", "va_mag", "va_angle_deg",
    "vb_real", "vb_imag", "vb_mag", "vb_angle_deg",
    "vc_real", "vc_imag", "vc_mag", "vc_angle_deg",
    "ia_real", "ia_imag", "ia_mag", "ia_angle_deg",
    "voltage_imbalance_percent", "vab_phase_diff_deg", "vbc_phase_diff_deg", "vca_phase_diff_deg",
    "sequence_positive_rms", "sequence_negative_rms", "sequence_zero_rms",
    "mw", "mvar", "mva", "power_factor", "power_factor_direction",
    "total_power_real_w", "total_power_imag_var",
    "digital", "digitals",
]

# sheet columns that are a reading's own under another name
RENAMED = {
    "wire_soc": "soc", "stat_raw": "stat", "fnom_hz": "fnom", "frequency_hz": "freq", "frequency_deviation_hz": "freq_dev",
    "rocof_hz_per_sec": "rocof", "voltage_imbalance_percent": "imbalance_pct", "vab_phase_diff_deg": "vab_deg",
    "vbc_phase_diff_deg": "vbc_deg", "vca_phase_diff_deg": "vca_deg", "sequence_positive_rms": "seq_pos",
    "sequence_negative_rms": "seq_neg", "sequence_zero_rms": "seq_zero", "total_power_real_w": "power_real",
    "total_power_imag_var": "power_imag", "pmu_name": "pmu_id",
    **{f"{p}_angle_deg": f"{p}_deg" for p in ("va", "vb", "vc", "ia")},
}


def channel_names(readings: DataFrame, names: str) -> list[str]:
    """The distinct channel names in the data, sorted: as many as the layouts name, whatever the number of frames."""
    return [r.name for r in readings.select(F.explode(names).alias("name")).filter("name <> ''").distinct().orderBy("name").collect()]


def sheet_names(names: list[str], taken: list[str]) -> dict[str, str]:
    """A column name for each channel that differs from all others also without regard to case."""
    used, out = {t.lower() for t in taken}, {}
    for name in names:
        column, k = f"ch_{name}", 2
        while {column.lower(), f"{column}_mag".lower(), f"{column}_angle_deg".lower()} & used:
            column, k = f"ch_{name}_{k}", k + 1
        used |= {column.lower(), f"{column}_mag".lower(), f"{column}_angle_deg".lower()}
        out[name] = column
    return out


def buffer_sheet(readings: DataFrame, phasor_names: list[str] | None = None, analog_names: list[str] | None = None) -> DataFrame:
    """One row per buffered reading: the fixed columns, then two columns per phasor channel and one per analog channel.

    Channels are named ``ch_<name>_mag``, ``ch_<name>_angle_deg`` and ``ch_<name>``, so that they differ from the fixed columns
    without regard to case; without lists they are those found in the data. A channel that a reading doesn't have shows as 0, of
    repeated names the last counts.
    """
    c = F.col
    phasors = channel_names(readings, "phasor_names") if phasor_names is None else phasor_names
    analogs = channel_names(readings, "analog_names") if analog_names is None else analog_names

    def at(values: str, names: str, n: str) -> Column:
        back = F.array_position(F.reverse(F.col(names)), F.lit(n)).cast("int")
        return F.coalesce(F.when(back > 0, F.get(F.col(values), F.size(names) - back)), F.lit(0.0))

    rect = {}
    for p in ("va", "vb", "vc", "ia"):
        angle = F.radians(f"{p}_deg")
        rect |= {f"{p}_real": c(f"{p}_mag") * F.cos(angle), f"{p}_imag": c(f"{p}_mag") * F.sin(angle)}
    made = {
        "ts_ms": F.floor(c("meas_us") / 1000), "time_utc": iso_time("meas_us"), "timestamp": iso_time("meas_us"),
        "received_at_ns": c("received_us") * 1000, "received_at_utc": iso_time("received_us"),
        "digital": F.coalesce(F.get("digitals", F.lit(0)), F.lit(0)),
        "digitals": F.array_join(F.transform("digitals", lambda d: d.cast("string")), " "),
        **stat_fields("stat"), **{n: x for n, x in time_quality_fields("fracsec_raw").items() if n in SHEET_COLUMNS}, **rect,
    }
    fixed = [(made[n] if n in made else c(RENAMED.get(n, n))).alias(n) for n in SHEET_COLUMNS]
    at_phasor = sheet_names(phasors, SHEET_COLUMNS)
    at_analog = sheet_names(analogs, [*SHEET_COLUMNS, *(f"{x}{end}" for x in at_phasor.values() for end in ("", "_mag", "_angle_deg"))])
    return readings.select(
        *fixed,
        *(x for n, k in at_phasor.items() for x in (at("phasor_mag", "phasor_names", n).alias(f"{k}_mag"), at("phasor_deg", "phasor_names", n).alias(f"{k}_angle_deg"))),
        *(at("analogs", "analog_names", n).alias(k) for n, k in at_analog.items()),
    )


def trend_export(delivered: DataFrame, n: int = TREND_POINTS) -> DataFrame:
    """Per device the last ``n`` trend points, oldest first, as one array."""
    kept = newest(delivered, ["pmu_id"], ["arrival_seq"], n)
    point = F.struct("arrival_seq", F.floor(F.col("meas_us") / 1000).alias("ts"), "freq", "rocof")
    return kept.groupBy("pmu_id").agg(F.array_sort(F.collect_list(point)).alias("trends"))


def snapshot_state(
    devices: DataFrame, trends: DataFrame, stats: DataFrame, status: DataFrame, points: DataFrame, as_of_us: Column
) -> DataFrame:
    """The whole state as JSON documents: one per device in name order, then the fleet parts.

    Rows are (part, name, doc), sorted; a consumer joins the lines. Nothing is gathered
    into one value, so a large fleet stays distributed.
    """
    def part(df: DataFrame, order: int, name: Column) -> DataFrame:
        return df.select(F.lit(order).alias("part"), name.alias("name"), F.to_json(F.struct("*")).alias("doc"))

    hops = [f"hop_{s}" for s, _, _ in latency.STAGES]
    cols = [
        "pmu_id", "connected", "total_frames", "approx_fps", "quality_rejects", "skew_rejects", "last_reject",
        "freq", "freq_dev", "rocof", "va_deg", "fnom", "stat_data_error", *hops,
    ]
    states = devices.select(*cols).join(trends, "pmu_id", "left")
    head = status.withColumn("now_us", as_of_us)
    return (
        part(head, 0, F.lit("aligner"))
        .unionByName(part(stats, 1, F.col("stage")))
        .unionByName(part(states, 2, F.col("pmu_id")))
        .unionByName(part(points, 3, F.lpad(F.col("tick_us").cast("string"), 20, "0")))
        .orderBy("part", "name")
    )
