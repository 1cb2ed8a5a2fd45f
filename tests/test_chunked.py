"""Chunked windows against plain ones, one device holding most rows."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tickweave.operators import chunked


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = [("hot" if rng.random() < 0.7 else f"d{rng.randint(0, 5)}", t, rng.choice([None, None, t]), i) for i, t in
            enumerate(sorted(rng.randint(0, 4000) for _ in range(1500)))]
    return spark.createDataFrame(data, "k string, t long, v long, i long").cache()


@pytest.mark.parametrize("width", [1, 7, 100, 100_000])
def test_with_previous(rows, width):
    w = W.partitionBy("k").orderBy("t", "i")
    want = rows.withColumn("p", F.lag("v").over(w)).withColumn("s", F.lag("i").over(w).isNotNull())
    got = chunked.with_previous(rows, ["k"], ["t", "i"], ["v"], width).select("k", "t", "v", "i", "prev_v", "prev_seen")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("k", "t", "v", "i", F.col("p").alias("prev_v"), F.col("s").alias("prev_seen")).collect()))


@pytest.mark.parametrize("width", [1, 7, 100, 100_000])
def test_forward_fill(rows, width):
    w = W.partitionBy("k").orderBy("t", "i").rowsBetween(W.unboundedPreceding, 0)
    want = rows.withColumn("f", F.last("v", ignorenulls=True).over(w))
    got = chunked.forward_fill(rows, ["k"], ["t", "i"], "v", width, "f")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("n", [3, 200, 1200])
def test_newest(rows, n):
    w = W.partitionBy("k").orderBy(F.desc("t"), F.desc("i"))
    want = rows.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= n).select("k", "i")
    got = chunked.newest(rows, ["k"], ["t", "i"], n).select("k", "i")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("width", [2, 50, 100_000])
def test_islands(rows, width):
    patience = rows.withColumn("p", F.when(F.col("k") == "hot", 3).otherwise(40))
    got = chunked.islands(patience, ["k"], "t", "p", width).collect()
    by_key = {}
    for r in rows.orderBy("t").collect():
        by_key.setdefault(r.k, []).append(r.t)
    want = []
    for k, ts in by_key.items():
        limit, run = (3 if k == "hot" else 40), [ts[0]]
        for t in ts[1:]:
            if t - run[-1] > limit:
                want.append((k, run[0], run[-1], len(run)))
                run = []
            run.append(t)
        want.append((k, run[0], run[-1], len(run)))
    assert sorted((r.k, r.first_us, r.last_us, r.n) for r in got) == sorted(want)


def test_ordinal(rows):
    got = chunked.ordinal(rows, ["t", "i"], 300, "no").orderBy("t", "i").collect()
    assert [r.no for r in got] == list(range(1, len(got) + 1))
