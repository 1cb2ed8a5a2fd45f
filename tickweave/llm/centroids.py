"""Lloyd's clustering with the dimensions dealt to shards.

Vectors are cut into blocks of rows and columns. A task over a column block adds up exact partial distances to its slice of the
centroids; partial distances of a block of rows are added over the shards, and the smallest names the cluster. Every shard gets the
names back and moves its own slice. Whole vectors and whole centroids never meet.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickweave.llm.common import written

#: vectors of a block of rows, and blocks of a task
ROWS, BLOCKS = 2048, 64
#: tasks whose sums come to the driver as they are; of more tasks they meet by shard first
SUMMED = 256
#: whole-number components lie below this, so that a squared distance of 64 of them fits a long
LARGEST = 1 << 27


def _blocks(scale: int, dims: int, shards: int):
    """Record batches of (vec_id, vector) to blocks: their number, ids, and whole-number components by shard, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids, parts, waiting = [], [], 0
        for batch in batches:
            vectors = batch.column("v")
            flat = vectors.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            whole = np.floor(flat * scale)
            if len(whole) and np.abs(whole).max() >= LARGEST:
                raise ValueError(f"a component times {scale} is {LARGEST} or more: squared distances don't fit a long")
            for at in range(0, len(whole), ROWS):
                ids.append(batch.column("vec_id").slice(at, ROWS))
                parts.append(whole[at : at + ROWS].astype(np.int32))
                waiting += len(parts[-1])
                if waiting >= ROWS:
                    yield _packed(number, ids, parts, shards)
                    number, ids, parts, waiting = number + 1, [], [], 0
        if waiting:
            yield _packed(number, ids, parts, shards)

    return run


def _packed(number: int, ids: list[pa.Array], parts: list[np.ndarray], shards: int) -> pa.RecordBatch:
    rows = np.concatenate(parts)
    slices = [np.ascontiguousarray(s).tobytes() for s in np.array_split(rows, shards, axis=1)]
    keys = pa.concat_arrays(ids)
    keys = pa.ListArray.from_arrays(pa.array([0, len(keys)], type=pa.int32()), keys)
    return pa.record_batch({"block": pa.array([number]), "ids": keys, "slices": pa.array([slices], type=pa.list_(pa.binary()))})


def _narrow(x: np.ndarray) -> np.ndarray:
    """In 32 bits where they do: partial distances travel."""
    return x.astype(np.uint32) if x.size and x.max() < 1 << 32 else x


def _plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _narrow(a.astype(np.int64) + b)


def partial_distances(rows: np.ndarray, centres: list[np.ndarray]) -> np.ndarray:
    """Squared distances of each row to each centre over some columns, exactly."""
    rows = rows.astype(np.int64)
    return np.stack([((rows - c) ** 2).sum(axis=1) for c in centres], axis=1)


@dataclass
class Shards:
    """Blocks of all shards, keyed by (shard, block), where they stay; every round's names and distances come to them."""

    blocks: RDD
    tasks: int
    width: list[int]

    def nearest(self, centres: list[list[np.ndarray]]) -> RDD:
        """(block, (cluster of each row, its squared distance)): partial distances of the shards, added; ties to the smaller cluster."""

        def distances(item):
            (shard, block), (n, data) = item
            return block, _narrow(partial_distances(np.frombuffer(data, dtype=np.int32).reshape(n, -1), centres[shard]))

        def smallest(total):
            total = total.astype(np.int64)
            own = total.argmin(axis=1)
            return own.astype(np.int32), total[np.arange(len(own)), own]

        return self.blocks.map(distances).reduceByKey(_plus, self.tasks).mapValues(smallest)

    def moved(self, centres: list[list[np.ndarray]]) -> list[list[np.ndarray]]:
        """Each shard's slice of the centroids after a round: floor of the mean of a cluster's rows; an empty one stays."""
        shards, k = len(self.width), len(centres[0])
        small = np.int8 if k <= 127 else np.int32
        names = self.nearest(centres).flatMap(lambda x: [((s, x[0]), x[1][0].astype(small)) for s in range(shards)])
        met = self.blocks.union(names.partitionBy(self.tasks)).groupByKey(self.tasks)

        def sums(item):
            (shard, _), values = item
            values = list(values)
            n, data = next(v for v in values if isinstance(v, tuple))
            own = next(v for v in values if not isinstance(v, tuple))
            rows = np.frombuffer(data, dtype=np.int32).reshape(n, -1).astype(np.int64)
            # whole numbers below 2^27 in blocks of some thousand rows: exact as doubles
            total = (own[:, None] == np.arange(k)).T.astype(np.float64) @ rows.astype(np.float64)
            # Python's integers from here on, so that no sum overflows
            return shard, (total.astype(np.int64).astype(object), np.bincount(own, minlength=k).astype(object))

        def added(items):
            own = {}
            for shard, (total, n) in items:
                own[shard] = (own[shard][0] + total, own[shard][1] + n) if shard in own else (total, n)
            return iter(own.items())

        of_task = met.map(sums).mapPartitions(added)
        if self.tasks > SUMMED:
            of_task = of_task.reduceByKey(lambda a, b: (a[0] + b[0], a[1] + b[1]), min(self.tasks, shards))
        of_shard = dict(added(of_task.collect()))
        return [
            [np.array([int(x) // int(n) for x in total], dtype=np.int64) if n else old for total, n, old in zip(*of_shard[s], centres[s], strict=True)]
            for s in range(shards)
        ]


def lloyd(
    vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, shards: int = 4, seed: int = 3, key: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: a row per usable vector.

    Vectors with exactly `dims` components, none null or non-finite, take part, as floor(scale * x). The centroids start as the k with the
    smallest sha256 of `<seed>:<vec_id>`; fewer vectors: as many centroids. Each round assigns by squared distance (ties: the smaller
    number) and replaces each non-empty centroid by the floor of its mean; at the end all are assigned once more. Whole-number
    arithmetic throughout; a component that is 2^27 or more after scaling can't be computed exactly and raises an error.

    Null keys: the vectors take part, and start a centroid only where others are lacking. Repeated rows count each; for one key with
    several vectors, the smaller vector is the first to start a centroid. No usable vector, or an empty table: no rows. The driver
    holds k centroids, and in a round a sum and a count of each from SUMMED tasks at most.
    """
    spark = vectors.sparkSession
    raw = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    fine = (F.size("v") == dims) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    usable = raw.filter(F.col("v").isNotNull() & fine)
    first = usable.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "v").limit(k).collect()
    form = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], form)
    shards = min(shards, dims)
    centres = np.array([[math.floor(scale * x) for x in r.v] for r in first], dtype=object)
    if np.abs(centres).max() >= LARGEST:
        raise ValueError(f"a component times {scale} is {LARGEST} or more: squared distances don't fit a long")
    slices = [[np.array(c, dtype=np.int64) for c in s] for s in np.array_split(centres, shards, axis=1)]

    blocks = written(usable.mapInArrow(_blocks(scale, dims, shards), "block long, ids array<long>, slices array<binary>"), "blocks")
    tasks = max(shards, -(-blocks.count() * shards // BLOCKS))
    cut = blocks.select("block", F.size("ids").alias("n"), F.posexplode("slices").alias("shard", "data")).rdd
    # dealt once; rounds read what this shuffle has left, and only names and partial distances travel
    dealt = cut.map(lambda r: ((r.shard, r.block), (r.n, bytes(r.data)))).partitionBy(tasks)
    own = Shards(dealt, dealt.getNumPartitions(), [len(s[0]) for s in slices])
    for _ in range(rounds):
        slices = own.moved(slices)

    packed = own.nearest(slices).map(lambda x: (x[0], x[1][0].tobytes(), x[1][1].tobytes()))
    named = spark.createDataFrame(packed, "block long, names binary, distances binary")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, names, distances in zip(batch.column("ids"), batch.column("names").to_pylist(), batch.column("distances").to_pylist(), strict=True):
                yield pa.record_batch({"vec_id": ids.values, "cluster": pa.array(np.frombuffer(names, dtype=np.int32)), "distance": pa.array(np.frombuffer(distances, dtype=np.int64))})

    found = written(blocks.select("block", "ids").join(named, "block").select("ids", "names", "distances").mapInArrow(rows, "vec_id long, cluster int, distance long"), "clusters")
    inertia = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).cast("long").alias("s")).collect())
    total = sum(inertia.values())
    last = [[int(x) for s in slices for x in s[c]] for c in range(len(first))]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in last]
    facts = spark.createDataFrame([(c, inertia.get(c, 0), total, hashes[c]) for c in range(len(first))], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(facts), "cluster").select(*(c.split()[0] for c in form.split(", ")))  # one row per centroid
