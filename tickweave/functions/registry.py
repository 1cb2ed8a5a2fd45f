"""Time zones, endpoint identities and labels of registered devices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: time-zone aliases and "use the host zone" words ---
UTC_ALIASES = ["UTC", "GMT", "Z", "ZULU"]
INDIA_ALIASES = ["IST", "INDIA", "ASIA/KOLKATA", "ASIA/CALCUTTA"]
HOST_WORDS = ["local", "host", "auto", "system"]

# --- fixed values: registration defaults ---
DEFAULT_TIMEOUT_SEC = 60
DEFAULT_RECONNECT_SEC = 5


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _text(c) -> Column:
    return F.coalesce(F.trim(_col(c)), F.lit(""))


def normalize_tz(tz) -> Column:
    s = _text(tz)
    return (
        F.when(F.lower(s).isin(HOST_WORDS), F.lower(s))
        .when(F.upper(s).isin(UTC_ALIASES), "UTC")
        .when(F.upper(s).isin(INDIA_ALIASES), "Asia/Kolkata")
        .otherwise(s)
    )


def is_loopback(ip) -> Column:
    host = F.lower(_text(ip))
    return (host == "localhost") | (host == "::1") | host.rlike(r"^127(\.\d{1,3}){3}$")


def effective_tz(tz, ip, fleet_tz: str = "UTC", host_tz: str = "UTC") -> Column:
    """Device zone, else UTC for loopback devices, else the fleet zone."""
    own = normalize_tz(tz)
    return (
        F.when(own.isin(HOST_WORDS), F.lit(host_tz))
        .when(own != "", own)
        .when(is_loopback(ip), F.lit("UTC"))
        .otherwise(F.lit(fleet_tz))
    )


def reinterpret_us(us, tz) -> Column:
    """Read the UTC clock face of ``us`` as wall time in ``tz``; true UTC microseconds."""
    wall = F.timestamp_micros(_col(us))
    return F.unix_micros(F.to_utc_timestamp(wall, _col(tz)))


def protocol_of(protocol) -> Column:
    return F.when(F.lower(_text(protocol)) == "udp", "udp").otherwise("tcp")


def endpoint_identity(ip, port, protocol) -> Column:
    host, proto = _text(ip), protocol_of(protocol)
    address = F.concat_ws(":", host, _col(port).cast("string"))
    return (
        F.when((host == "") | F.coalesce(_col(port) <= 0, F.lit(True)), "")
        .when(proto == "udp", F.concat(F.lit("udp:"), address))
        .otherwise(address)
    )


def endpoint_key(ip, port, protocol) -> Column:
    return F.concat_ws("|", protocol_of(protocol), _text(ip), _col(port).cast("string"))


def device_slug(name) -> Column:
    return F.regexp_replace(F.lower(_col(name)), "[^a-z0-9]+", "-")


def display_name(name, station, cfg_station=None) -> Column:
    """Station learned from the layout, else the stored one, else the name."""
    learned = F.nullif(_text(cfg_station), F.lit("")) if cfg_station is not None else F.lit(None).cast("string")
    return F.coalesce(learned, F.nullif(_text(station), F.lit("")), _col(name))


def endpoint_port(name) -> Column:
    tail = F.substring_index(_col(name), ":", -1)
    has_port = _col(name).contains(":") & tail.rlike("^[0-9]+$")
    return F.when(has_port, tail).otherwise("")


def chart_label(name, station, cfg_station=None) -> Column:
    """``station (:port)``, so that equally named stations stay apart."""
    label, port = display_name(name, station, cfg_station), endpoint_port(name)
    plain = (port == "") | (label == _col(name)) | label.endswith(F.concat(F.lit(":"), port))
    return F.when(plain, label).otherwise(F.concat(label, F.lit(" (:"), port, F.lit(")")))
