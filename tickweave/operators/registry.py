"""The device address book: normalising, conflicts, upserts, renames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.functions import registry as r


def registry_normalize(forms: DataFrame) -> DataFrame:
    """Registration forms with blanks filled and the endpoint identity as name."""
    identity = r.endpoint_identity("ip", "port", "protocol")
    positive = lambda c, default: F.when(F.col(c) > 0, F.col(c)).otherwise(default)
    clean: dict[str, Column] = {
        "ip": F.trim("ip"),
        "protocol": r.protocol_of("protocol"),
        "tcp_port": F.when(r.protocol_of("protocol") == "tcp", 0).otherwise(F.col("tcp_port")),
        "timeout_sec": positive("timeout_sec", r.DEFAULT_TIMEOUT_SEC),
        "reconnect_sec": positive("reconnect_sec", r.DEFAULT_RECONNECT_SEC),
        "station": F.trim("station"),
        "timestamp_tz": r.normalize_tz("timestamp_tz"),
        "name": F.coalesce(F.nullif(identity, F.lit("")), F.col("name")),
    }
    return forms.select(*(clean[c].alias(c) if c in clean else F.col(c) for c in forms.columns))


def registry_scan(registry: DataFrame, active_only: bool = False) -> DataFrame:
    rows = registry.filter("active") if active_only else registry
    return rows.orderBy(F.desc("active"), "name")


def endpoint_conflicts(incoming: DataFrame, registry: DataFrame, replace: str | None = None) -> DataFrame:
    """Incoming rows whose endpoint another registered device already has."""
    key = r.endpoint_key("ip", "port", "protocol")
    taken = registry.select(key.alias("_key"), F.col("name").alias("_owner"))
    if replace:
        taken = taken.filter(F.col("_owner") != replace)
    mine = incoming.withColumn("_key", key)
    return mine.join(taken, (mine["_key"] == taken["_key"]) & (mine["name"] != taken["_owner"]), "left_semi").drop("_key")


def duplicate_endpoints(rows: DataFrame) -> DataFrame:
    """Endpoint keys more than one row of a list uses."""
    key = r.endpoint_key("ip", "port", "protocol").alias("endpoint_key")
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first_name")).filter("n > 1")


def registry_upsert(registry: DataFrame, incoming: DataFrame, at_us: Column) -> DataFrame:
    """Insert or update by name; a blank station or zone keeps the stored one; all become active.

    ``incoming`` is normalised and has one row per name.
    """
    cols = [c for c in registry.columns if c not in ("name", "active", "updated_us")]
    old, new = registry.alias("o"), incoming.alias("n")
    both = old.join(new, F.col("o.name") == F.col("n.name"), "full_outer")
    arrived = F.col("n.name").isNotNull()

    def merged(c: str) -> Column:
        kept = F.col(f"o.{c}")
        if c not in incoming.columns:
            return kept
        fresh = F.col(f"n.{c}")
        if c in ("station", "timestamp_tz"):
            fresh = F.coalesce(F.nullif(fresh, F.lit("")), kept, F.lit(""))
        return F.when(arrived, fresh).otherwise(kept)

    out = both.select(
        F.coalesce("n.name", "o.name").alias("name"),
        *(merged(c).alias(c) for c in cols),
        (arrived | F.col("o.active")).alias("active"),
        F.when(arrived, at_us).otherwise(F.col("o.updated_us") if "updated_us" in registry.columns else None).alias("updated_us"),
    )
    return out


def registry_set_active(registry: DataFrame, changes: DataFrame) -> DataFrame:
    """Apply (name, active) changes; unknown names come back with ``error`` set."""
    want = changes.select("name", F.col("active").alias("_want"))
    known = registry.join(want, "name", "left").select(
        *(F.coalesce("_want", "active").alias(c) if c == "active" else F.col(c) for c in registry.columns),
        F.lit(None).cast("string").alias("error"),
    )
    unknown = want.join(registry, "name", "left_anti").select(
        "name", F.concat(F.lit("PMU "), F.col("name"), F.lit(" not found")).alias("error")
    )
    return known.unionByName(unknown, allowMissingColumns=True)


def identity_migration(registry: DataFrame) -> DataFrame:
    """Rename active rows to their endpoint identity; where that name exists, switch the old row off.

    Of several rows with one identity the first by old name gets it. Inactive rows stay.
    """
    identity = r.endpoint_identity("ip", "port", "protocol")
    rows = registry.withColumn("_id", F.when(F.col("active") & (identity != ""), identity))
    taken = registry.select(F.col("name").alias("_id"), F.lit(True).alias("_taken"))
    moving = F.col("_id").isNotNull() & (F.col("_id") != F.col("name"))
    ranked = (
        rows.join(taken, "_id", "left")
        .withColumn("_moving", moving)
        .withColumn(
            "_rank",
            F.row_number().over(W.partitionBy(F.coalesce("_id", "name"), "_moving").orderBy("name")),
        )
    )
    wins = F.col("_moving") & F.col("_taken").isNull() & (F.col("_rank") == 1)
    loses = F.col("_moving") & ~wins
    return ranked.select(
        *(
            F.when(wins, F.col("_id")).otherwise(F.col("name")).alias("name")
            if c == "name"
            else (F.col("active") & ~F.coalesce(loses, F.lit(False))).alias("active")
            if c == "active"
            else F.col(c)
            for c in registry.columns
        ),
        F.when(wins, F.col("name")).alias("old_name"),
    )


def source_filter(packets: DataFrame, registry: DataFrame) -> DataFrame:
    """Packets sent from the address their device is registered with.

    A blank or any-address registration accepts every source, a loopback one any loopback.
    """
    want = F.trim(F.coalesce(F.col("_want"), F.lit("")))
    src = F.col("source_ip")
    allowed = (
        src.isNull()
        | want.isin("", "0.0.0.0", "::")
        | F.when(want.isin("127.0.0.1", "localhost"), r.is_loopback(src)).otherwise(src == want)
    )
    known = registry.select(F.col("name").alias("pmu_id"), F.col("ip").alias("_want"))
    return packets.join(known, "pmu_id").filter(allowed).drop("_want")
