"""Ordered per-key computations that never put one key into one task.

A device may hold a third of all rows. A window partitioned by device alone would
then run in a single task. Here the ordered axis is cut into chunks of a fixed width;
the window runs per (key, chunk), and what has to cross a chunk border travels as one
extra row per non-empty chunk. Only those border rows are ever ordered per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
ARRIVALS = 1 << 17
# above this rank Spark does not prune window groups before the shuffle by itself
GROUP_LIMIT_MAX = 1000
SALT_BUCKETS = 64


def chunk_of(order, width: int) -> Column:
    c = F.col(order) if isinstance(order, str) else order
    return F.floor(c / F.lit(width)).cast("bigint")


def with_previous(
    df: DataFrame, keys: list[str], order: list[str], cols: list[str], width: int, prefix: str = "prev_"
) -> DataFrame:
    """Add ``prev_<c>`` for the row before in ``order`` within ``keys`` (NULL on the first).

    ``order[0]`` is numeric and defines the chunks. ``prev_seen`` tells a first row
    from a previous row that held NULL.
    """
    part = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk_of(order[0], width)).withColumn("_carried", F.lit(False))
    carried_cols = list(dict.fromkeys([*order, *cols]))
    tails = (
        rows.select(*part, *carried_cols)
        .groupBy(*part)
        .agg(F.max_by(F.struct(*carried_cols), F.struct(*order)).alias("_t"))
    )
    heads = (
        tails.withColumn("_chunk", F.lead("_chunk").over(W.partitionBy(*keys).orderBy("_chunk")))
        .filter(F.col("_chunk").isNotNull())
        .select(*part, "_t.*", F.lit(True).alias("_carried"))
    )
    both = rows.unionByName(heads, allowMissingColumns=True)
    w = W.partitionBy(*part).orderBy(*order)
    prev = F.lag(F.struct(*cols)).over(w)
    return (
        both.withColumn("_p", prev)
        .filter(~F.col("_carried"))
        .select(
            *df.columns,
            *(F.col("_p")[c].alias(prefix + c) for c in cols),
            F.col("_p").isNotNull().alias(prefix + "seen"),
        )
    )


def forward_fill(
    df: DataFrame, keys: list[str], order: list[str], value: str, width: int, out: str
) -> DataFrame:
    """Last non-NULL ``value`` up to and including each row, in ``order`` within ``keys``."""
    part = [*keys, "_chunk"]
    rows = df.withColumn("_chunk", chunk_of(order[0], width)).withColumn("_carried", F.lit(0))
    held = F.col(value).isNotNull()
    # a chunk without a value of its own still passes on the one before
    chunks = rows.groupBy(*part).agg(
        F.max_by(F.when(held, F.col(value)), F.when(held, F.struct(*order))).alias(value)
    )
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    heads = (
        chunks.withColumn(value, F.last(value, ignorenulls=True).over(before))
        .filter(F.col(value).isNotNull())
        .select(*part, value, F.lit(-1).alias("_carried"))
    )
    both = rows.unionByName(heads, allowMissingColumns=True)
    w = W.partitionBy(*part).orderBy("_carried", *order)
    filled = F.last(value, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))
    return both.withColumn(out, filled).filter(F.col("_carried") == 0).select(*dict.fromkeys([*df.columns, out]))


def newest(df: DataFrame, keys: list[str], order: list[str], n: int, rank: str | None = None) -> DataFrame:
    """The ``n`` last rows of each key in ``order``; at most ``n`` per key and task are shuffled."""
    desc = [F.desc(c) for c in order]
    cut = df
    if n >= GROUP_LIMIT_MAX:
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(SALT_BUCKETS)))
        inner = F.row_number().over(W.partitionBy(*keys, "_salt").orderBy(*desc))
        cut = salted.withColumn("_r", inner).filter(F.col("_r") <= n).drop("_r", "_salt")
    name = rank or "_rank"
    out = cut.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*desc))).filter(F.col(name) <= n)
    return out if rank else out.drop(name)


# chunks that make one of the next level: hours to days to months; then all that is left of a key
LEVELS = (24, 30)


def islands(
    df: DataFrame, keys: list[str], time: str, patience: str, width: int = HOUR_US, levels: tuple[int, ...] = LEVELS
) -> DataFrame:
    """Runs of rows whose silence stays within the ``patience`` of the row before, numbered from 1 per key.

    Rows are folded into runs per (key, chunk) first. Of a chunk only the first and the last run can go on outside it, so
    level by level these alone meet in wider chunks; no window ever holds all runs of a key.
    """
    part = [*keys, "_chunk"]
    w = W.partitionBy(*part).orderBy(time)
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    starts = F.col(time) - F.lag(time).over(w) > F.lag(patience).over(w)
    runs = (
        df.select(*keys, time, patience)
        .withColumn("_chunk", chunk_of(time, width))
        .withColumn("_new", F.coalesce(starts.cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(upto))
        .groupBy(*part, "_run")
        .agg(
            F.min(time).alias("_first"),
            F.max(time).alias("_last"),
            F.max_by(patience, time).alias("_patience"),
            F.count(F.lit(1)).alias("_n"),
        )
        .withColumn("_open", F.lit(True))
    )
    for factor in (*levels, None):
        # runs that have neighbours on both sides are finished, and each a group of its own from here on
        at = W.partitionBy(*part, "_open")
        outer = (F.col("_first") == F.min("_first").over(at)) | (F.col("_first") == F.max("_first").over(at))
        runs = runs.withColumn("_open", F.col("_open") & outer)
        width = width * factor if factor else None
        alone = F.when(F.col("_open"), F.lit(None).cast("bigint")).otherwise(F.col("_first"))
        runs = runs.withColumn("_chunk", chunk_of("_first", width) if width else F.lit(0).cast("bigint")).withColumn("_alone", alone)
        runs = _glued(runs, [*part, "_alone"])
    return _numbered(runs, keys, 24 * 30 * HOUR_US)


def _glued(runs: DataFrame, part: list[str]) -> DataFrame:
    """Joins runs of a part that follow on one another."""
    k = W.partitionBy(*part).orderBy("_first")
    fresh = F.col("_first") - F.lag("_last").over(k) > F.lag("_patience").over(k)
    return (
        runs.withColumn("_new", F.coalesce(fresh.cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(k.rowsBetween(W.unboundedPreceding, W.currentRow)))
        .groupBy(*part, "_run")
        .agg(
            F.min("_first").alias("_first"),
            F.max("_last").alias("_last"),
            F.max_by("_patience", "_last").alias("_patience"),
            F.sum("_n").alias("_n"),
            F.first("_open").alias("_open"),
        )
    )


def _numbered(runs: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Numbers the runs of a key chunk by chunk; one row per chunk, its size, is ordered per key."""
    part = [*keys, "_chunk"]
    rows = runs.withColumn("_chunk", chunk_of("_first", width))
    sizes = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_size"))
    before = W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*part, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(W.partitionBy(*part).orderBy("_first"))
    return (
        rows.withColumn("_rank", rank)
        .join(offsets, part)
        .select(
            *keys,
            (F.col("_offset") + F.col("_rank")).cast("bigint").alias("run"),
            F.col("_first").alias("first_us"),
            F.col("_last").alias("last_us"),
            F.col("_patience").alias("patience_us"),
            F.col("_n").alias("n"),
        )
    )


def ordinal(df: DataFrame, order: list[str], width: int, out: str) -> DataFrame:
    """Number all rows 1..n by ``order`` (``order[0]`` numeric), chunk by chunk.

    Only one row per chunk, its size, is ordered globally.
    """
    rows = df.withColumn("_chunk", chunk_of(order[0], width))
    sizes = rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    rank = F.row_number().over(W.partitionBy("_chunk").orderBy(*order))
    return (
        rows.withColumn("_rank", rank)
        .join(offsets, "_chunk")
        .withColumn(out, (F.col("_offset") + F.col("_rank")).cast("bigint"))
        .drop("_chunk", "_rank", "_offset")
    )
