"""What the operators of this subpackage share: input columns, scratch tables and files in the shared folder."""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.session import checkpoint_root, materialize

if TYPE_CHECKING:
    import pyarrow as pa

#: characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return
WORD_BREAKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_text(df: DataFrame, key: str, text: str) -> DataFrame:
    """Key and text alone, under fixed names; whatever other columns the input has can't clash. Null text: empty."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have, however it is spelt."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written once to the shared folder and read back: later steps don't repeat what made it."""
    return materialize(df, f"llm-{name}")


def shared_folder(spark: SparkSession, name: str) -> str:
    """URI of a new folder that driver and executors share. A folder without a scheme lies in the default file system."""
    root = checkpoint_root(spark)
    if ":/" not in root:
        root = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").rstrip("/") + root
    if root.startswith("file:"):
        root = "file:///" + root.removeprefix("file:").lstrip("/")
    return f"{root}/llm-{name}-{uuid.uuid4().hex[:12]}"


def pieces_of(text):
    """Column: what lies between the blanks of a text, empty pieces included."""
    return F.split(text, r"[ \t\n\x0B\f\r]")


def bind(value, use):
    """Column: `use(value)` with the value computed once per row, also where `use` names it inside a lambda."""
    return F.transform(F.array(value), use)[0]


def slices(batches: Iterator[pa.RecordBatch], most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of about `most` bytes, a tenth more at most but for long rows, all of a batch with as many rows."""
    for batch in batches:
        parts = max(1, min(batch.num_rows, math.ceil(batch.nbytes / (1.1 * most))))
        step = max(1, -(-batch.num_rows // parts))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)
