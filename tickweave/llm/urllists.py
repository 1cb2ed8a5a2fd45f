"""URL filters with dated lists: entries become validity intervals, and each capture is held against those active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import written

#: cells of time that the days from the first entry to the last capture are cut into
TIME_CELLS = 64


def host_of(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port or a last dot; empty if there is none."""
    return F.rtrim(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1), F.lit("."))


def segments_of(url: Column) -> Column:
    """Path segments of a URL, without empty ones, query and fragment."""
    return F.array_remove(F.split(F.regexp_extract(url, r"^[^/?#]*://[^/?#]*(/[^?#]*)", 1), "/"), "")


def url_keys(url: Column, depth: Column) -> Column:
    """What a list may name a URL by: its host, the domains it lies in, and host with the first one to `depth` path segments."""
    host, labels, parts = host_of(url), F.split(host_of(url), r"\."), segments_of(url)
    domains = F.transform(
        F.filter(F.sequence(F.lit(1), F.size(labels)), lambda i: i < F.size(labels)),
        lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")),
    )
    depths = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(depth, F.size(parts)))), lambda i: i <= F.least(depth, F.size(parts)))
    prefixes = F.transform(depths, lambda i: F.concat(F.lit("prefix:"), host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/")))
    return F.when(host != "", F.concat(F.array(F.concat(F.lit("host:"), host)), domains, prefixes)).otherwise(F.array().cast("array<string>"))


def intervals(entries: DataFrame) -> DataFrame:
    """(key, valid_from, valid_to) while a key is listed; valid_to is null while it still is.

    entries: key, day, listed (false takes the key off again). Of entries for one key and day one that lists it wins. Rows with
    a null in any of the three don't count. A key has one row a day at most before days are put in order, however many entries.
    """
    daily = entries.filter("key IS NOT NULL AND day IS NOT NULL AND listed IS NOT NULL").groupBy("key", "day").agg(F.max("listed").alias("listed"))
    by_day = Window.partitionBy("key").orderBy("day")
    changes = daily.withColumn("was", F.lag("listed", 1, False).over(by_day)).filter("listed <> was")
    return changes.withColumn("valid_to", F.lead("day").over(by_day)).filter("listed").select("key", F.col("day").alias("valid_from"), "valid_to")


def filter_captures(captures: DataFrame, entries: DataFrame, key: str = "page_id", url: str = "url", day: str = "day") -> DataFrame:
    """page_id, url, day, blocked, n_active (list keys that hold at that day), entry (the longest of them, ties to the first in order).

    Captures and intervals meet by key and cell of time, so a host with many captures and a long history is dealt over the cells;
    each URL and day is decided once. Null or unusable URLs and null days: nothing is active. Repeated rows: each has its row.
    Empty tables: no rows, or nothing active.
    """
    rows = captures.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(day).cast("int").alias("day"))
    spans = written(intervals(entries), "intervals")
    # two numbers that place the cells, and the most path segments that any entry names
    last = rows.agg(F.max("day")).first()[0]
    first, depth = spans.agg(F.min("valid_from"), F.max(F.when(F.col("key").startswith("prefix:"), F.size(F.split("key", "/")) - 1).otherwise(0))).first()
    width = max(1, -(-(max(last or 0, first or 0) - (first or 0) + 1) // TIME_CELLS))
    cell = lambda c: F.floor((c - F.lit(first or 0)) / width).cast("int")

    until = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(last or 0)), F.lit(last or 0))
    placed = spans.filter(F.col("valid_from") <= F.lit(last or 0)).select("key", "valid_from", "valid_to", F.explode(F.sequence(cell(F.col("valid_from")), cell(until))).alias("cell"))
    asked = rows.select("url", "day").filter(f"url IS NOT NULL AND day >= {first or 0}").distinct()
    asked = asked.select("url", "day", cell(F.col("day")).alias("cell"), F.explode(F.array_distinct(url_keys(F.col("url"), F.lit(depth or 0)))).alias("key"))
    active = asked.join(placed, ["key", "cell"]).filter("day >= valid_from AND (valid_to IS NULL OR day < valid_to)")
    decided = active.groupBy("url", "day").agg(F.count("*").alias("n_active"), F.min(F.struct(-F.length("key"), "key")).alias("entry"))
    decided = decided.select("url", "day", "n_active", "entry.key")
    return rows.join(decided, ["url", "day"], "left").select(
        "page_id", "url", "day", F.col("n_active").isNotNull().alias("blocked"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.col("key").alias("entry")
    )
