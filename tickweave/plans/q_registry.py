"""Address book, layout versions, expected sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickweave.functions import registry as r
from tickweave.operators import history, registry, windows
from tickweave.plans import views as v
from tickweave.plans.q_scalars import IDENTITY, PROTO, TZ, hashed_layouts
from tickweave.plans.registry import query, sql_view


@query("registry_scan", "SELECT name, active, station, region, vendor FROM registry")
def _(spark, sf):
    return registry.registry_scan(v.registry(spark, sf)).select("name", "active", "station", "region", "vendor")


@query("registry_scan_active", "SELECT name, station FROM registry WHERE active")
def _(spark, sf):
    return registry.registry_scan(v.registry(spark, sf), active_only=True).select("name", "station")


# --- an address book out of the registration forms: one row per identity ---------------

sql_view(
    "book",
    f"""
SELECT name, ip, port, protocol, station, timestamp_tz, active, form_id FROM (
  SELECT *, row_number() OVER (PARTITION BY name ORDER BY form_id) AS rn FROM (
    SELECT form_id, {IDENTITY} AS name, trim(ip) AS ip, port, {PROTO} AS protocol, trim(station) AS station, {TZ} AS timestamp_tz, active
    FROM registry_forms) WHERE name <> '') WHERE rn = 1
""",
)


def book(spark, sf):
    rows = registry.registry_normalize(v.registry_forms(spark, sf))
    named = rows.filter(r.endpoint_identity("ip", "port", "protocol") != "")
    kept = named.groupBy("name").agg(F.min_by(F.struct("ip", "port", "protocol", "station", "timestamp_tz", "active", "form_id"), "form_id").alias("r"))
    return kept.select("name", "r.*")


# every device registers again from the orders of its customer: other station, or none
sql_view(
    "re_registered",
    """
SELECT b.name, b.ip, b.port, b.protocol, CASE WHEN o.n % 3 = 0 THEN '' ELSE 'again-' || o.n END AS station,
  CASE WHEN o.n % 2 = 0 THEN '' ELSE 'UTC' END AS timestamp_tz
FROM book b JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) o ON o.o_custkey = b.form_id
UNION ALL SELECT 'udp:10.9.0.' || s_suppkey || ':4712', '10.9.0.' || s_suppkey, 4712, 'udp', s_name, '' FROM supplier
""",
)


def again(spark, sf):
    n = v.table(spark, sf, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    b = book(spark, sf)
    seen = b.join(n, b.form_id == n.o_custkey).select(
        "name", "ip", "port", "protocol",
        F.when(F.col("n") % 3 == 0, "").otherwise(F.concat(F.lit("again-"), F.col("n").cast("string"))).alias("station"),
        F.when(F.col("n") % 2 == 0, "").otherwise("UTC").alias("timestamp_tz"),
    )
    ip = F.concat(F.lit("10.9.0."), F.col("s_suppkey").cast("string"))
    fresh = v.table(spark, sf, "supplier").select(
        F.concat(F.lit("udp:"), ip, F.lit(":4712")).alias("name"), ip.alias("ip"), F.lit(4712).alias("port"),
        F.lit("udp").alias("protocol"), F.col("s_name").alias("station"), F.lit("").alias("timestamp_tz"),
    )
    return seen.unionByName(fresh)


@query(
    "registry_upsert",
    """
SELECT coalesce(n.name, o.name) AS name, coalesce(n.ip, o.ip) AS ip, coalesce(n.protocol, o.protocol) AS protocol,
  CASE WHEN n.name IS NULL THEN o.station WHEN n.station <> '' THEN n.station ELSE coalesce(o.station, '') END AS station,
  CASE WHEN n.name IS NULL THEN o.timestamp_tz WHEN n.timestamp_tz <> '' THEN n.timestamp_tz ELSE coalesce(o.timestamp_tz, '') END AS timestamp_tz,
  n.name IS NOT NULL OR o.active AS active
FROM book o FULL OUTER JOIN re_registered n ON n.name = o.name
""",
)
def _(spark, sf):
    out = registry.registry_upsert(book(spark, sf), again(spark, sf), F.lit(v.V2_US))
    return out.select("name", "ip", "protocol", "station", "timestamp_tz", "active")


# one switch per supplier: those whose name is unknown come back as errors
sql_view(
    "switches",
    "SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'nobody-' || s_suppkey ELSE b.name END AS name, s_acctbal > 0 AS active "
    "FROM supplier JOIN book b ON b.form_id = s_suppkey",
)


@query(
    "registry_set_active",
    """
SELECT b.name, coalesce(s.active, b.active) AS active, CAST(NULL AS VARCHAR) AS error FROM book b LEFT JOIN switches s ON s.name = b.name
UNION ALL SELECT name, NULL, 'PMU ' || name || ' not found' FROM switches s WHERE NOT EXISTS (SELECT 1 FROM book b WHERE b.name = s.name)
""",
)
def _(spark, sf):
    b = book(spark, sf)
    s = v.table(spark, sf, "supplier")
    nobody = F.concat(F.lit("nobody-"), F.col("s_suppkey").cast("string"))
    changes = s.join(b, s.s_suppkey == b.form_id).select(
        F.when(F.col("s_suppkey") % 4 == 0, nobody).otherwise(F.col("name")).alias("name"), (F.col("s_acctbal") > 0).alias("active")
    )
    return registry.registry_set_active(b, changes).select("name", "active", "error")


# every seventh customer still has a nickname; every other of those shares the next one's endpoint
def nicknamed(spark, sf):
    k = F.col("c_custkey")
    own = F.when(k % 14 == 0, k + 1).otherwise(k)
    ip = F.concat(F.lit("10.1."), F.floor(own / 250).cast("string"), F.lit("."), (own % 250).cast("string"))
    return v.table(spark, sf, "customer").select(
        F.when(k % 7 == 0, F.concat(F.lit("old-"), k.cast("string"))).otherwise(F.concat(ip, F.lit(":4712"))).alias("name"),
        ip.alias("ip"), F.lit(4712).alias("port"), F.lit("tcp").alias("protocol"), (k % 5 != 0).alias("active"),
    )


sql_view(
    "nicknamed",
    """
SELECT CASE WHEN k % 7 = 0 THEN 'old-' || k ELSE ip || ':4712' END AS name, ip, 4712 AS port, 'tcp' AS protocol, k % 5 <> 0 AS active FROM (
  SELECT c_custkey AS k, '10.1.' || (CASE WHEN c_custkey % 14 = 0 THEN c_custkey + 1 ELSE c_custkey END // 250) || '.'
    || (CASE WHEN c_custkey % 14 = 0 THEN c_custkey + 1 ELSE c_custkey END % 250) AS ip FROM customer)
""",
)


@query(
    "identity_migration",
    """
SELECT CASE WHEN moves AND NOT taken THEN identity ELSE name END AS name, active AND NOT (moves AND taken) AS active,
  CASE WHEN moves AND NOT taken THEN name END AS old_name
FROM (SELECT *, ip || ':4712' AS identity, active AND name <> ip || ':4712' AS moves,
  EXISTS (SELECT 1 FROM nicknamed o WHERE o.name = n.ip || ':4712') AS taken FROM nicknamed n)
""",
)
def _(spark, sf):
    return registry.identity_migration(nicknamed(spark, sf)).select("name", "active", "old_name")


@query(
    "endpoint_conflicts",
    """
SELECT n.name, n.ip FROM (SELECT DISTINCT ip || ':4712' AS name, ip FROM nicknamed) n
WHERE EXISTS (SELECT 1 FROM nicknamed o WHERE o.ip = n.ip AND o.name <> n.name)
""",
)
def _(spark, sf):
    known = nicknamed(spark, sf)
    incoming = known.select(F.concat("ip", F.lit(":4712")).alias("name"), "ip", "port", "protocol").distinct()
    return registry.endpoint_conflicts(incoming, known).select("name", "ip")


@query(
    "duplicate_endpoints",
    "SELECT 'tcp|' || ip || '|4712' AS endpoint_key, count(*) AS n, min(name) AS first_name FROM nicknamed GROUP BY ip HAVING count(*) > 1",
)
def _(spark, sf):
    return registry.duplicate_endpoints(nicknamed(spark, sf))


@query(
    "source_filter",
    """
SELECT event_id, pmu_id, source_ip FROM (
  SELECT event_id, '10.0.0.' || (user_id % 8) || ':4712' AS pmu_id, CASE event_type WHEN 'error' THEN '10.9.9.9' WHEN 'view' THEN '127.0.0.9'
    ELSE '10.0.0.' || (user_id % 8) END AS source_ip, user_id % 8 AS k FROM events)
WHERE CASE k WHEN 0 THEN TRUE WHEN 1 THEN source_ip LIKE '127.%' WHEN 2 THEN TRUE ELSE source_ip = '10.0.0.' || k END
""",
)
def _(spark, sf):
    k = F.col("user_id") % 8
    own = F.concat(F.lit("10.0.0."), k.cast("string"))
    packets = v.table(spark, sf, "events").select(
        "event_id",
        v.pmu_of(k).alias("pmu_id"),
        F.when(F.col("event_type") == "error", "10.9.9.9").when(F.col("event_type") == "view", "127.0.0.9").otherwise(own).alias("source_ip"),
    )
    no = F.regexp_extract("name", r"10\.0\.0\.(\d+):", 1).cast("int")
    listed = v.registry(spark, sf).withColumn(
        "ip", F.when(no == 0, "0.0.0.0").when(no == 1, " localhost ").when(no == 2, "").otherwise(F.col("ip"))
    )
    return registry.source_filter(packets, listed)


# --- layout versions ------------------------------------------------------------------


def sightings(spark, sf):
    e = F.col("event_id")
    return v.table(spark, sf, "events").select(
        v.pmu_of(F.col("user_id") % 8).alias("pmu_id"),
        F.concat(F.lit("h"), (F.floor(e / 3000) % 3).cast("string")).alias("layout_hash"),
        v.micros("ts").alias("received_us"),
        F.concat(F.lit("S"), (e % 100).cast("string")).alias("station"),
        F.when(e % 3 == 0, F.encode("event_type", "UTF-8")).alias("raw_cfg"),
    )


@query(
    "cfg_version_upsert",
    """
SELECT pmu_id, layout_hash, received_us, station, raw_cfg, row_number() OVER (ORDER BY received_us, pmu_id, layout_hash) AS cfg_id FROM (
  SELECT pmu_id, layout_hash, min(t) AS received_us, arg_max(station, t) AS station, arg_max(raw, t) FILTER (raw IS NOT NULL) AS raw_cfg FROM (
    SELECT '10.0.0.' || (user_id % 8) || ':4712' AS pmu_id, 'h' || ((event_id // 3000) % 3) AS layout_hash, epoch_us(ts) AS t,
      'S' || (event_id % 100) AS station, CASE WHEN event_id % 3 = 0 THEN event_type END AS raw FROM events) GROUP BY pmu_id, layout_hash)
""",
)
def _(spark, sf):
    return history.cfg_version_upsert(sightings(spark, sf)).withColumn("raw_cfg", F.decode("raw_cfg", "UTF-8"))


@query(
    "layout_changes",
    """
SELECT pmu_id, received_us, 'cfg_changed' AS type, layout_hash, prev AS prev_layout_hash FROM (
  SELECT *, lag(layout_hash) OVER (PARTITION BY pmu_id ORDER BY received_us) AS prev FROM hashed_layouts) WHERE prev <> layout_hash
""",
)
def _(spark, sf):
    return windows.layout_changes(hashed_layouts(spark, sf).select("pmu_id", "received_us", "layout_hash"))


# --- expected sets ----------------------------------------------------------------------

sql_view(
    "live_before",
    "SELECT CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'C' || o_custkey END AS name FROM orders WHERE o_orderstatus <> 'O'",
)
sql_view("live_after", "SELECT 'C' || o_custkey AS name FROM orders WHERE o_orderpriority LIKE '1%' OR o_orderpriority LIKE '2%'")


def _live_sets(spark, sf):
    name = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    orders = v.table(spark, sf, "orders")
    status = F.col("o_orderstatus")
    before = orders.filter(status != "O").select(F.when(status == "P", "").otherwise(name).alias("name"))
    after = orders.filter(F.col("o_orderpriority").rlike("^[12]")).select(name.alias("name"))
    return before, after


@query(
    "live_set_diff",
    """
SELECT name, 'add' AS action FROM (SELECT DISTINCT name FROM live_after WHERE name <> '' EXCEPT SELECT name FROM live_before)
UNION ALL SELECT name, 'remove' FROM (SELECT DISTINCT name FROM live_before WHERE name <> '' EXCEPT SELECT name FROM live_after)
""",
)
def _(spark, sf):
    return history.live_set_diff(*_live_sets(spark, sf))


@query(
    "expected_add_remove",
    """
SELECT name FROM (SELECT name FROM live_before UNION SELECT name FROM live_after) WHERE name <> ''
EXCEPT SELECT 'C' || c_custkey FROM customer WHERE c_acctbal < 0
""",
)
def _(spark, sf):
    before, after = _live_sets(spark, sf)
    gone = v.table(spark, sf, "customer").filter("c_acctbal < 0").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("name"))
    return history.expected_remove(history.expected_add(before, after), gone)
