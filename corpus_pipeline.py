"""From raw documents to packed training sequences: quality rules, toxicity, near copies, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.common import keyed_text, table, written
from tickweave.llm.jaccard import one_of_each
from tickweave.llm.packing import pack
from tickweave.llm.quality import keep_good, trusted_texts
from tickweave.llm.queries import fold, vocabulary
from tickweave.llm.toxicity import drop_toxic
from tickweave.session import tune

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules and the hashed ratio keep."""
    tune(spark)
    return keep_good(docs, trusted_texts(keyed_text(docs, "doc_id", "text"), table(spark, sf_dir, "labels")))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic."""
    tune(spark)
    return drop_toxic(docs, table(spark, sf_dir, "labels"), may_learn=fold() != 0)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares four fifths of its shingles."""
    tune(spark)
    return one_of_each(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 ids."""
    tune(spark)
    pieces = pack(docs, vocabulary(), window=2048, end_id=1)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Stage]] = [("quality", quality), ("toxicity", toxicity), ("near copies", near_copies), ("packing", packing)]
# the ratio's hashes, the toxicity model and the tokenizer can't be stated in SQL; tests/llm/test_pipeline.py has a brute-force version
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each reading what the one before has written."""
    tune(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, name.replace(" ", "-"))
    return docs
