"""Sharded clustering against a plain loop over whole vectors."""

import hashlib
import math
import random

import pytest

from tickweave.llm import centroids
from tickweave.llm.centroids import lloyd

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<double>, block long, ids string, cluster string, distance int, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 7, "x", "y", 0, 1) for i, v in rows], SCHEMA)


def plain(rows, k, rounds, dims, scale, seed):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((r for r in kept), key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [list(v) for _, v in order[:k]]

    def assign():
        out = []
        for i, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centres]
            out.append((i, d.index(min(d)), min(d), v))
        return out

    for _ in range(rounds):
        found = assign()
        for c in range(len(centres)):
            own = [v for _, x, _, v in found if x == c]
            if own:
                centres[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    found = assign()
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    own = [sum(d for _, x, d, _ in found if x == c) for c in range(len(centres))]
    return sorted(((i, c, d, own[c], sum(own), hashes[c]) for i, c, d, _ in found), key=repr)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


@pytest.mark.parametrize(("dims", "shards", "k"), [(6, 3, 4), (5, 2, 3), (3, 8, 8)])
def test_against_loop(spark, monkeypatch, dims, shards, k):
    monkeypatch.setattr(centroids, "ROWS", 16)
    rng = random.Random(dims)
    rows = [(i, [rng.gauss(3 * (i % 3), 1) for _ in range(dims)]) for i in range(150)]
    rows += [(i, rows[0][1]) for i in range(200, 230)]  # one vector under many keys
    rows += [(7, rows[7][1]), (7, rows[7][1]), (8, rows[9][1])]  # repeated rows, a key with two vectors
    got = lloyd(table(spark, rows).repartition(5), k=k, rounds=4, dims=dims, scale=64, shards=shards)
    assert rows_of(got) == plain(rows, k, 4, dims, 64, 3)


def test_odd_rows(spark):
    fine = [(1, [0.0, 0.5]), (2, [1.0, -0.5]), (None, [0.25, 0.25]), (3, [1e5, -1e5])]
    odd = [(4, None), (5, []), (6, [1.0]), (7, [1.0, None]), (8, [NAN, 1.0]), (9, [INF, 1.0]), (10, [1.0, 2.0, 3.0])]
    got = lloyd(table(spark, fine + odd), k=8, rounds=3, dims=2, scale=1024)
    # fewer vectors than centroids: as many centroids
    assert rows_of(got) == plain(fine + odd, 8, 3, 2, 1024, 3) and got.count() == 4
    for none in (odd, []):
        empty = lloyd(table(spark, none), dims=2)
        assert empty.count() == 0 and empty.columns == got.columns


def test_ties_and_empty_clusters(spark):
    # all vectors equal: every distance ties, the other centroids never move
    rows = [(i, [1.0, 1.0]) for i in range(20)]
    got = rows_of(lloyd(table(spark, rows), k=3, rounds=2, dims=2))
    assert got == plain(rows, 3, 2, 2, 1024, 3) and {r[1] for r in got} == {0}


def test_too_large(spark):
    with pytest.raises(Exception, match="don't fit a long"):
        lloyd(table(spark, [(1, [1e6, 0.0])]), dims=2).collect()


def test_sums_need_no_stage_of_their_own(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, [rng.gauss(i % 3, 1) for _ in range(4)]) for i in range(60)]
    tracker, used = spark.sparkContext.statusTracker(), {}
    for most in (256, 0):
        monkeypatch.setattr(centroids, "SUMMED", most)
        seen = []

        def moved(self, centres, most=most, seen=seen, plain=centroids.Shards.moved):
            spark.sparkContext.setJobGroup(f"round-{most}", "")
            try:
                return plain(self, centres)
            finally:
                seen.extend(tracker.getJobIdsForGroup(f"round-{most}"))
                spark.sparkContext.setJobGroup("other", "")

        with monkeypatch.context() as m:
            m.setattr(centroids.Shards, "moved", moved)
            assert rows_of(lloyd(table(spark, rows), k=3, rounds=1, dims=4, shards=2)) == plain(rows, 3, 1, 4, 1024, 3)
        used[most] = max(len(tracker.getJobInfo(j).stageIds) for j in seen)
    # vectors dealt, partial distances, names, sums
    assert used == {256: 4, 0: 5}
