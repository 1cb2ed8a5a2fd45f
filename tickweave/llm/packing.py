"""Concatenate and cut: documents laid end to end and cut into windows of equal length."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import keyed_text, written
from tickweave.llm.tokens import prefix_sums, tokenized

WINDOW = 2048


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of documents, one row each: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset.

    First pass: every task encodes its rows, counts the ids before each row and writes all that once. The totals of the
    tasks (one row per input partition, summed on one task) give each task its place on one global line of ids. Second
    pass: a document that lies over window borders is cut there, with one record on each side. No document moves between
    tasks, so neither a hot source nor a group of copies is gathered, and only the last window is not full.

    Null text: the end id alone. Null key: kept, with a null doc_id. Repeated rows: each is packed. Empty table: no rows.
    Any length of text; texts over a window give several pieces.
    """
    ids = written(tokenized(keyed_text(docs, key, text), vocabulary, end_id), "pack")
    totals = ids.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    # one row per input partition: small enough for every executor
    placed = ids.join(F.broadcast(prefix_sums(totals, "part", "total")), "part").withColumn("at", F.col("base") + F.col("before"))
    size = F.lit(window).cast("long")
    cut = placed.select(
        "doc_id", "ids", "n_tokens", "at",
        F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n_tokens") - 1) / size))).alias("sequence_id"),
    )
    begin = F.greatest(F.col("at"), F.col("sequence_id") * size)
    end = F.least(F.col("at") + F.col("n_tokens"), (F.col("sequence_id") + 1) * size)
    return cut.select(
        "doc_id",
        (begin - F.col("at")).alias("start"),
        (end - begin).alias("length"),
        F.substring("ids", ((begin - F.col("at")) * 4 + 1).cast("int"), ((end - begin) * 4).cast("int")).alias("ids"),
        F.col("n_tokens").alias("doc_tokens"),
        "sequence_id",
        (begin - F.col("sequence_id") * size).alias("offset"),
    )
