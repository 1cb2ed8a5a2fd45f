"""M-tree search against all inner products."""

import pickle

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickweave.llm import topk
from tickweave.llm.topk import MTree, largest_products


def brute(ids, vectors, query, k, skip):
    scores = sorted(((-int(s), int(i)) for s, i in zip(vectors @ query, ids, strict=True) if i != skip))[:k]
    return [(-s, i) for s, i in scores]


@pytest.mark.parametrize("seed", range(6))
def test_tree(seed):
    rng = np.random.default_rng(seed)
    n = [0, 1, 40, 700, 3000, 900][seed]
    centres = rng.integers(-60, 60, (7, 12))
    vectors = (centres[rng.integers(0, 7, n)] + rng.integers(-9, 9, (n, 12)) * (seed != 5)).astype(float)
    ids = rng.permutation(n * 2)[:n]
    tree = pickle.loads(pickle.dumps(MTree(ids, vectors, float((vectors * vectors).sum(axis=1).max()) if n else 0.0, page=16)))
    queries = np.stack([vectors[q % n] if n else np.zeros(12) for q in range(30)])
    own = np.array([int(ids[q % n]) if n and q % 2 else -1 for q in range(30)])
    scores, found = tree.search(queries, own, 5)
    want = [brute(ids, vectors, query, 5, skip) for query, skip in zip(queries, own, strict=True)]
    assert [[(int(a), int(b)) for a, b in zip(s, i, strict=True) if np.isfinite(a)] for s, i in zip(scores, found, strict=True)] == want
    computed = tree.computed
    if n == 3000:
        assert computed < 30 * n * 0.7  # the bounds spare distances
    if n > 5:  # all that scores as much as the fifth is found, with fewer distances
        least = np.array([w[-1][0] for w in want], dtype=float)
        assert (tree.search(queries, own, 5, least)[1] == found).all() and tree.computed - computed <= computed


def clustered(spark, n):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=8) * 0.1).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), [(i, np.floor(256 * np.array(v))) for i, v in rows]


def test_far_regions_are_spared(spark, monkeypatch):
    monkeypatch.setattr(topk, "TREE_ROWS", 60)
    df, rows = clustered(spark, 1200)
    sent = []
    keep = topk.written
    monkeypatch.setattr(topk, "written", lambda frame, name: sent.append(out := keep(frame, name)) or out if name == "sent" else keep(frame, name))
    got = [tuple(r) for r in largest_products(df, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect()]
    want = []
    for q, a in rows[::10]:
        best = sorted((-int(a @ b), j) for j, b in rows if j != q)[:5]
        want += [(q, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert got == want
    first, second = (s.groupBy("vec_id").count().agg(F.avg("count")).first()[0] for s in sent)
    assert first == 1 and second < 10  # of twenty trees and more


def test_a_region_of_many_equal_vectors_has_several_trees(spark, monkeypatch):
    monkeypatch.setattr(topk, "TREE_ROWS", 20)
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    df = spark.createDataFrame([(i, [1.0, 2.0] if i % 3 else [float(i), 1.0]) for i in range(300)], "vec_id long, embedding array<double>")
    got = largest_products(df, F.col("vec_id") % 50 == 1, k=4).orderBy("query_id", "rank").collect()
    values = {i: np.floor(256 * np.array([1.0, 2.0] if i % 3 else [float(i), 1.0])) for i in range(300)}
    want = [(q, r, j, -s) for q in range(1, 300, 50) for r, (s, j) in enumerate(sorted((-int(values[q] @ b), j) for j, b in values.items() if j != q)[:4], 1)]
    assert [tuple(r) for r in got] == want


def test_operator_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "TREE_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(120)] + [(0, [1.0, 0.0, 0.0, 0.0]), (5, None), (6, [1.0, None, 0.0, 0.0]), (10, [float("nan"), 0.0, 0.0, 0.0])]
    rows += [(None, [1.0] * 4), (20, [float("inf"), 0.0, 0.0, 0.0]), (30, [1.0, 2.0]), (31, [1.0, 2.0]), (200, []), (7, rng.normal(size=4).tolist())]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, rank string")
    got = [tuple(r) for r in largest_products(df, F.col("vec_id") % 10 == 0, k=5).orderBy("query_id", "rank").collect()]
    good = [(i, np.floor(256 * np.array(v))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in good if i % 10 == 0}):
        scores = {(-int(a @ b), j) for i, a in good if i == q for j, b in good if j != q and len(a) == len(b)}
        want += [(q, r, j, -s) for r, (s, j) in enumerate(sorted(scores)[:5], 1)]
    assert got == want


def test_repeated_rows_take_one_place(spark, monkeypatch):
    for size in (16_384, 7):
        monkeypatch.setattr(topk, "TREE_ROWS", size)
        rows = [(10, [1.0, 0.0]), (10, [1.0, 0.0])] + [(1, [9.0, 0.0])] * 20 + [(2, [8.0, float(y)]) for y in range(8)] + [(i, [10.0 - i, 0.0]) for i in range(3, 9)]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        got = [tuple(r) for r in largest_products(df, F.col("vec_id") == 10, k=5).orderBy("rank").collect()]
        assert got == [(10, r, r, 256 * 256 * (10 - r)) for r in range(1, 6)]


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert largest_products(df, F.col("vec_id") % 10 == 0).count() == 0
