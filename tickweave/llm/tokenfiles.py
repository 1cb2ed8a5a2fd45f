"""Binary token files: ids ranked by frequency, one to four bytes each, lengths in control bytes of their own.

A file holds blocks. A block: the number of documents, ids, control bytes and data bytes (four unsigned 64-bit integers), then
for each document its key, its number of ids and a flag (1: null key) as 64-bit integers, then the control bytes, then the
data bytes. Every control byte gives the byte lengths, less one, of four ids, the first in its lowest bits; a document starts
with a new control byte. Data bytes are ranks, little-endian. The header is the magic word and the code book: the id of each rank.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickweave.llm.common import keyed_text, shared_folder, slices, written
from tickweave.llm.files import attempt_name, reader, writer
from tickweave.llm.tokens import ids_of, prefix_sums, tokenized

MAGIC = b"TWTOK1\0\0"
#: ids in one file, about, and files at most: of a large corpus they grow instead. Places that are looked at for each border of files
IDS_PER_FILE, FILES, PLACES = 8_000_000, 8_192, 64
BLOCK_BYTES = 4 << 20

#: for each control byte: byte lengths of its four ids
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + np.uint8(1)


def encode_ranks(ranks: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Control and data bytes of several documents' ranks, and how many of each every document has."""
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    controls = (counts + 3) // 4
    first_slot = np.cumsum(controls) * 4 - controls * 4
    slot = np.arange(len(ranks)) + np.repeat(first_slot - (np.cumsum(counts) - counts), counts)
    codes = np.zeros(int(controls.sum()) * 4, dtype=np.uint8)
    codes[slot] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4, dtype=np.uint8) < size[:, None]]
    ends = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    stops = np.cumsum(counts)
    return control.astype(np.uint8), data, controls, ends[stops] - ends[stops - counts]


def decode_ranks(control: np.ndarray, data: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ranks of several documents, by looking up each control byte's lengths."""
    controls = (counts + 3) // 4
    last = np.cumsum(controls) * 4
    used = np.ones(len(control) * 4, dtype=bool)
    for k in range(1, 4):  # slots of a document's last control byte that hold nothing
        some = last[(counts % 4 != 0) & (4 - counts % 4 >= k)] - k
        used[some] = False
    size = LENGTHS[control].reshape(-1)[used].astype(np.int64)
    start = np.cumsum(size) - size
    data = np.concatenate([data, np.zeros(4, dtype=np.uint8)])
    ranks = data[start].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        if len(longer):
            ranks[longer] |= data[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return ranks


def code_book(ids: DataFrame) -> np.ndarray:
    """The id of every rank, commonest first, ties to the smaller id: one entry for each id in use, so at most the vocabulary's size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for batch in slices(batches):
            seen = np.bincount(ids_of(batch.column(0))[0])
            if len(seen) > len(total):
                total = np.concatenate([total, np.zeros(len(seen) - len(total), dtype=np.int64)])
            total[: len(seen)] += seen
        used = np.flatnonzero(total)
        yield pa.record_batch({"id": pa.array(used), "n": pa.array(total[used])})

    counts = ids.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return counts.orderBy(F.desc("n"), "id").toPandas()["id"].to_numpy(dtype="<u4")


def write_token_files(
    docs: DataFrame, vocabulary: str, end_id: int = 2, ids_per_file: int = IDS_PER_FILE, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode, rank and write all documents in ascending key order (null keys first, equal keys in the order they are read).

    Returns the manifest, written itself: shard, path, n_docs, n_ids. Rows are dealt to files by ranges of the key and the place a
    row was read at, so equal keys can be split too; a sample of places, some for each file, gives the borders. Ranked bytes travel,
    not ids.

    Null text: the end id alone. Repeated rows: each is written. Empty table: an empty manifest.
    """
    spark = docs.sparkSession
    ids = written(tokenized(keyed_text(docs, key, text), vocabulary, end_id), "ids")
    book = code_book(ids)
    rows, total = ids.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    shards = min(FILES, max(1, math.ceil(total / ids_per_file)))
    borders = _borders(ids, rows, shards)
    folder = shared_folder(spark, "tokens")
    rank_of = np.zeros(int(book.max()) + 1 if len(book) else 1, dtype="<u4")
    rank_of[book] = np.arange(len(book), dtype="<u4")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4 << 20):
            flat, counts = ids_of(batch.column("ids"))
            control, data, controls, sizes = encode_ranks(rank_of[flat], counts)
            places = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "part", "row")), strict=True)
            yield pa.record_batch(
                {
                    "shard": pa.array([bisect_right(borders, _place(*p)) for p in places], type=pa.int32()),
                    **{c: batch.column(c) for c in ("doc_id", "part", "row", "n_tokens")},
                    "control": _split(control, controls),
                    "data": _split(data, sizes),
                }
            )

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, n_docs, n_ids = attempt_name(folder, ".tok"), 0, 0
        first = next((f for f in frames if len(f)), None)
        if first is None:
            return
        with writer(path) as out:
            out.write(MAGIC + len(book).to_bytes(8, "little") + book.tobytes())
            for frame in _chain(first, frames):
                n_docs, n_ids = n_docs + len(frame), n_ids + int(frame["n_tokens"].sum())
                size = frame["control"].map(len) + frame["data"].map(len)
                for _, block in frame.groupby(size.cumsum() // BLOCK_BYTES, sort=False):
                    _write_block(out, block)
        yield pd.DataFrame({"shard": [int(first["shard"].iloc[0])], "path": [path], "n_docs": [n_docs], "n_ids": [n_ids]})

    ranked = ids.select("doc_id", "part", "row", "n_tokens", "ids").mapInArrow(
        rank, "shard int, doc_id long, part int, row long, n_tokens long, control binary, data binary"
    )
    dealt = ranked.repartitionById(shards, F.col("shard"))
    manifest = dealt.sortWithinPartitions("doc_id", "part", "row").mapInPandas(write, "shard int, path string, n_docs long, n_ids long")
    return written(manifest, "manifest")


def _place(doc_id: int | None, part: int, row: int) -> tuple[bool, int, int, int]:
    return (doc_id is not None, doc_id or 0, part, row)


def _borders(ids: DataFrame, rows: int, shards: int) -> list[tuple[bool, int, int, int]]:
    """Where files begin, from PLACES for each of at most FILES files: no more than that comes to the driver, however many rows there are."""
    if shards == 1:
        return []
    places = ids.select("doc_id", "part", "row")
    places = places.sample(fraction=PLACES * shards / rows, seed=7) if PLACES * shards < rows else places
    some = sorted(_place(*r) for r in places.collect())
    return [some[len(some) * k // shards] for k in range(1, shards)] if some else []


def _split(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])


def _chain(first: pd.DataFrame, rest: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    yield first
    yield from rest


def _write_block(out, block: pd.DataFrame) -> None:
    control, data = b"".join(block["control"]), b"".join(block["data"])
    null = block["doc_id"].isna()
    rows = np.stack([block["doc_id"].fillna(0).to_numpy(dtype="<i8"), block["n_tokens"].to_numpy(dtype="<i8"), null.to_numpy(dtype="<i8")], axis=1)
    total = int(block["n_tokens"].sum())
    out.write(np.array([len(block), total, len(control), len(data)], dtype="<u8").tobytes())
    out.write(np.ascontiguousarray(rows).tobytes())
    out.write(control)
    out.write(data)


def blocks_of(source) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(documents: key, number of ids, null flag; ids of all of them), block by block."""
    if source.read(8) != MAGIC:
        raise ValueError("not a token file")
    size = int.from_bytes(source.read(8), "little")
    book = np.frombuffer(source.read(4 * size), dtype="<u4")
    while head := source.read(32):
        n_docs, n_ids, n_control, n_data = np.frombuffer(head, dtype="<u8").tolist()
        rows = np.frombuffer(source.read(24 * n_docs), dtype="<i8").reshape(-1, 3)
        control = np.frombuffer(source.read(n_control), dtype=np.uint8)
        data = np.frombuffer(source.read(n_data), dtype=np.uint8)
        ids = book[decode_ranks(control, data, rows[:, 1])]
        if len(ids) != n_ids:
            raise ValueError("a token block is broken")
        yield rows, ids


def read_token_files(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Documents of the files a manifest names: doc_id, start (ids of all documents before it), n_tokens, ids (binary).

    One task per file; a file is read block by block. Files without documents aren't in a manifest.
    """
    placed = manifest.join(F.broadcast(prefix_sums(manifest, "shard", "n_ids")), "shard")  # one row per file
    tasks = max(1, manifest.count())

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for batch in frames:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                with reader(path) as source:
                    for rows, ids in blocks_of(source):
                        n = rows[:, 1]
                        ends = np.cumsum(n)
                        yield pa.record_batch(
                            {
                                "doc_id": pa.array(rows[:, 0], mask=rows[:, 2] == 1),
                                "start": pa.array(start + ends - n),
                                "n_tokens": pa.array(n),
                                "ids": _split(np.ascontiguousarray(ids, dtype="<u4").view(np.uint8), n * 4),
                            }
                        )
                        start += int(ends[-1])

    dealt = placed.repartitionByRange(tasks, "shard").select("path", "base")
    return dealt.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
