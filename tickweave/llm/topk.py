"""Exact search for the largest inner products with M-trees: paged metric nodes with covering radii and parent distances.

Vectors are whole numbers. One more coordinate, the root of what a vector's squared length lacks to the largest, makes all equally
long: then the nearest by distance are those with the largest inner products. Vectors are dealt to trees by region, that of the nearest
pivot, and each tree is built once. A query first asks the tree of its nearest pivot; what it finds there bounds which other
regions, by their pivot and radius, can still hold an answer. Queries of a block go through a tree together.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickweave.llm.common import written

#: entries of a node
PAGE = 64
#: vectors of a tree, and queries that go through it together, about
TREE_ROWS, QUERY_ROWS = 16_384, 8_192
#: regions at most: beyond, regions have several trees, so that the table of pivots stays small
REGIONS = 1024
#: slack for rounding, of distances computed in double precision
SLACK = 1e-9
_LAST = np.iinfo(np.int64).max


class Node:
    """A page: for each entry its vector, distance to the page's own centre, and, in inner pages, covering radius and child."""

    __slots__ = ("rows", "to_parent", "radius", "children")

    def __init__(self, rows, to_parent, radius=None, children=None):
        self.rows, self.to_parent, self.radius, self.children = rows, to_parent, radius, children


class MTree:
    """Over whole-number vectors (as doubles) of equal dimension, with `most` at least the largest squared length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, page: int = PAGE):
        self.ids, self.vectors, self.most, self.page, self.computed = ids, vectors, most, max(2, page), 0
        self.root = self._build(_levelled(vectors, most), np.arange(len(ids)), None)

    def _build(self, points: np.ndarray, rows: np.ndarray, centre: int | None) -> Node:
        """Parts the rows by their nearest of a page's centres, spread out, and builds each part."""
        away = lambda rows, c: np.zeros(len(rows)) if c is None else np.sqrt(((points[rows] - points[c]) ** 2).sum(axis=1))
        if len(rows) <= self.page:
            return Node(rows, away(rows, centre))
        n = min(self.page, math.ceil(len(rows) / self.page))
        centres = [int(rows[0])]
        nearest = away(rows, centres[0])
        part = np.zeros(len(rows), dtype=np.int64)
        for k in range(1, max(2, n)):
            far = int(np.argmax(nearest))
            if nearest[far] == 0:
                break
            centres.append(int(rows[far]))
            own = away(rows, centres[-1])
            part[own < nearest] = k
            nearest = np.minimum(own, nearest)
        if len(centres) == 1:  # equal vectors: pages of them, side by side
            groups = np.array_split(rows, n)
            centres = [int(g[0]) for g in groups]
        else:
            groups = [rows[part == k] for k in range(len(centres))]
        centres_ = np.array(centres)
        radius = np.array([away(g, c).max() for g, c in zip(groups, centres, strict=True)])
        return Node(centres_, away(centres_, centre), radius, [self._build(points, g, c) for g, c in zip(groups, centres, strict=True)])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """For each query the scores and ids of the k largest inner products, ties to the smaller id; -inf where there are fewer.

        The vectors of a query's own id take no part, equal (id, score) take one place, and what scores less than `least` needn't be found.
        Best-first over pages: a page's entries meet, in one product, all queries whose bounds still admit one of them.
        """
        n = len(queries)
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), _LAST)
        if not n or not len(self.ids) or k < 1:
            return scores, ids
        length = (queries * queries).sum(axis=1)
        least = np.full(n, -np.inf) if least is None else least
        far = _reach(length, self.most, least)  # what an answer may be away
        order, queue = 0, [(0.0, 0, self.root, np.arange(n), np.zeros(n), None)]
        while queue:
            bound, _, node, some, bounds, up = heapq.heappop(queue)
            if bound > far.max():
                break
            still = bounds <= far[some]
            some = some[still]
            entries = np.arange(len(node.rows))
            if up is not None and len(some):
                # by the triangle inequality, from the stored distances to the parent alone
                reach = far[some][:, None] + (0 if node.radius is None else node.radius[None, :])
                near = np.abs(up[still][:, None] - node.to_parent[None, :]) <= reach
                entries, still = np.flatnonzero(near.any(axis=0)), near.any(axis=1)
                some = some[still]
            if not len(some) or not len(entries):
                continue
            self.computed += len(some) * len(entries)
            product = queries[some] @ self.vectors[node.rows[entries]].T
            if node.children is None:
                self._offer(scores, ids, some, product, self.ids[node.rows[entries]], own, least)
                far[some] = np.minimum(far[some], _reach(length[some], self.most, scores[some, -1]))
                continue
            away = np.sqrt(np.maximum(length[some][:, None] + self.most - 2 * product, 0.0))
            lower = np.maximum(away - node.radius[entries], 0.0)
            admitted = lower <= far[some][:, None]
            for e in np.flatnonzero(admitted.any(axis=0)).tolist():
                of = np.flatnonzero(admitted[:, e])
                order += 1
                heapq.heappush(queue, (float(lower[of, e].min()), order, node.children[entries[e]], some[of], lower[of, e], away[of, e]))
        return scores, ids

    @staticmethod
    def _offer(scores, ids, some, product, found, own, least) -> None:
        """Takes what a leaf has for its queries into their best."""
        k = scores.shape[1]
        product[found[None, :] == own[some][:, None]] = -np.inf
        better = np.flatnonzero((product >= np.maximum(np.maximum(scores[some, -1], least[some]), np.finfo(float).min)[:, None]).any(axis=1))
        if not len(better):
            return
        to = some[better]
        s = np.concatenate([scores[to], product[better]], axis=1)
        i = np.concatenate([ids[to], np.broadcast_to(found, (len(to), len(found)))], axis=1)
        i = np.where(np.isneginf(s), _LAST, i)
        for _ in range(2):
            order = np.lexsort((i, -s), axis=1)
            s, i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            again = (s[:, 1:] == s[:, :-1]) & (i[:, 1:] == i[:, :-1]) & ~np.isneginf(s[:, 1:])
            if not again.any():
                break
            # a key on several rows takes one place
            s[:, 1:][again], i[:, 1:][again] = -np.inf, _LAST
        scores[to], ids[to] = s[:, :k], i[:, :k]

    def __getstate__(self):
        small = self.vectors.astype(np.int32)
        return {**self.__dict__, "vectors": small if (small == self.vectors).all() else self.vectors}

    def __setstate__(self, state):
        self.__dict__.update(state, vectors=state["vectors"].astype(np.float64))


def _levelled(vectors: np.ndarray, most: float) -> np.ndarray:
    """With the coordinate that makes all equally long."""
    return np.concatenate([vectors, np.sqrt(np.maximum(most - (vectors * vectors).sum(axis=1), 0.0))[:, None]], axis=1)


def _reach(length: np.ndarray, most: float, score: np.ndarray) -> np.ndarray:
    """Distance at which a vector has a score, with slack."""
    return np.sqrt(np.maximum(length + most - 2 * score, 0.0)) * (1 + SLACK) + SLACK


def whole_numbers(vector: str = "embedding", scale: int = 256) -> Column:
    """floor(scale * x) of each component; null if the vector is null or has a null or non-finite component."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.col(vector).isNotNull() & fine, F.transform(x, lambda v: F.floor(v * scale)))


def _matrices(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dimension, rows, their vectors) for each dimension among some rows."""
    values = batch.column("v")
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    dim = batch.column("dim").to_numpy()
    flat = values.flatten().to_numpy().astype(np.float64)
    starts = np.cumsum(dim) - dim
    for d in np.unique(dim).tolist():
        rows = np.flatnonzero(dim == d)
        yield d, rows, flat[starts[rows][:, None] + np.arange(d)].reshape(len(rows), d)


class Regions:
    """Pivots of each dimension. A dimension without any has one region, -1, around the point that stands for the zero vector."""

    def __init__(self, pivots: list[list[int]], most: float):
        self.most, self.pivots = most, {}
        for d in {len(p) for p in pivots}:
            own = [p for p in pivots if len(p) == d]
            self.pivots[d] = np.array(own, dtype=np.float64).reshape(len(own), d)

    def place(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """region (of the nearest pivot), away (the distance to it) and first (the region nearest to the row as a query)."""
        for batch in batches:
            region, first, away = (np.zeros(batch.num_rows, dtype=t) for t in (np.int32, np.int32, np.float64))
            for d, rows, vectors in _matrices(batch):
                points = _levelled(vectors, self.most)
                if d not in self.pivots:
                    region[rows] = first[rows] = -1
                    away[rows] = np.sqrt((vectors * vectors).sum(axis=1) + (points[:, -1] - math.sqrt(self.most)) ** 2)
                    continue
                pivots = _levelled(self.pivots[d], self.most)
                region[rows] = (points @ pivots.T).argmax(axis=1)
                first[rows] = (vectors @ self.pivots[d].T).argmax(axis=1)
                away[rows] = np.sqrt(((points - pivots[region[rows]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("vec_id", "v", "asks", "dim")), pa.array(region), pa.array(first), pa.array(away)],
                names=["vec_id", "v", "asks", "dim", "region", "first", "away"],
            )

    def admitting(self, radius: dict[tuple[int, int], float]):
        """Rows of (vec_id, v, dim, least) with each region that can hold an answer."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                least = batch.column("least").to_numpy()
                for d, rows, vectors in _matrices(batch):
                    if d not in self.pivots:
                        at, region = np.arange(len(rows)), np.full(len(rows), -1)
                    else:
                        length = (vectors * vectors).sum(axis=1)
                        away = np.sqrt(np.maximum(length[:, None] + self.most - 2 * vectors @ self.pivots[d].T, 0.0))
                        # a pivot without vectors admits none
                        reach = np.array([radius.get((d, r), -math.inf) for r in range(len(self.pivots[d]))]) * (1 + SLACK) + SLACK
                        at, region = np.nonzero(away - reach <= _reach(length, self.most, least[rows])[:, None])
                    for i in range(0, len(at), 4096):  # a query goes to many regions
                        some = batch.take(pa.array(rows[at[i : i + 4096]]))
                        yield some.append_column("region", pa.array(region[i : i + 4096].astype(np.int32)))

        return run


def largest_products(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score: for each row where `queries` (a condition on vec_id) holds, the k other rows with the largest
    inner products of whole-number vectors; fewer if there are fewer. Ties go to the smaller vec_id.

    Rows with a null key or an unusable vector take no part. Vectors of another dimension than the query's aren't compared. A key on
    several rows: each row is a candidate, and each query row asks for itself; a row is never a candidate for its own key.
    Repeated answers of one query key are given once and take one of the k places, so that equal rows count as one. Empty table: no rows.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), whole_numbers(vector, scale).alias("v")).filter("vec_id IS NOT NULL AND v IS NOT NULL")
    # equal rows give equal answers; one of them is dealt, so that copies neither take an answer's place nor make a hot group
    rows = written(rows.distinct().withColumn("asks", F.coalesce(queries, F.lit(False))).withColumn("dim", F.size("v")), "vectors")
    squares = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)
    sums = rows.agg(F.count("*").alias("n"), F.sum(F.col("asks").cast("long")).alias("q"), F.max(squares).alias("most")).first()
    n, q, most = sums.n, sums.q or 0, float(sums.most or 0)

    hashed = lambda name: F.xxhash64(F.lit(name), "vec_id", "v")
    pivots = rows.orderBy(hashed("pivot"), "vec_id").select("v").limit(min(REGIONS, -(-n // TREE_ROWS))).collect()
    regions = Regions([list(r.v) for r in pivots], most)
    placed = written(rows.mapInArrow(regions.place, "vec_id long, v array<long>, asks boolean, dim int, region int, first int, away double"), "placed")
    # one row for each region; one with many vectors has several trees
    facts = placed.groupBy("dim", "region").agg(F.max("away").alias("radius"), F.ceil(F.count("*") / TREE_ROWS).alias("parts"))
    facts = written(facts, "regions")
    parts = facts.select("dim", "region", "parts")

    def build(group: pa.Table) -> pa.Table:
        _, order, matrix = next(_matrices(group))
        tree = MTree(group.column("vec_id").to_numpy()[order], matrix, most)
        return pa.table({c: group.column(c)[:1] for c in ("dim", "region", "deal")} | {"tree": pa.array([pickle.dumps(tree)], type=pa.binary())})

    dealt = placed.join(parts, ["dim", "region"]).withColumn("deal", F.pmod(hashed("deal"), F.col("parts")))
    trees = dealt.select("vec_id", "v", "dim", "region", "deal").groupBy("dim", "region", "deal").applyInArrow(build, "dim int, region int, deal long, tree binary")
    trees = written(trees, "trees")
    place = ["dim", "region", "deal", "block"]

    def ask(sent: DataFrame) -> DataFrame:
        """Answers of trees to the queries sent to them, block by block. A tree travels to the blocks that ask it."""
        sent = written(sent.select("vec_id", "v", "least", "dim", "region", "deal", F.pmod(hashed("block"), F.lit(max(1, -(-q // QUERY_ROWS)))).alias("block")), "sent")
        asked = sent.select(*place).distinct().toDF("dim", "region", "deal", "at")
        copies = trees.join(asked, ["dim", "region", "deal"]).select("dim", "region", "deal", F.col("at").alias("block"), "tree")

        def search(own_block: pa.Table, tree: pa.Table) -> pa.Table:
            ids = scores = own = np.zeros(0, dtype=np.int64)
            if len(own_block) and len(tree):
                _, order, matrix = next(_matrices(own_block))
                own = own_block.column("vec_id").to_numpy()[order]
                scores, ids = pickle.loads(tree.column("tree")[0].as_py()).search(matrix, own, k, own_block.column("least").to_numpy()[order])
                own, there = np.repeat(own, k), np.isfinite(scores.ravel())
                own, ids, scores = own[there], ids.ravel()[there], scores.ravel()[there].astype(np.int64)
            return pa.table({"query_id": pa.array(own), "vec_id": pa.array(ids), "score": pa.array(scores)})

        return sent.groupBy(*place).cogroup(copies.groupBy(*place)).applyInArrow(search, "query_id long, vec_id long, score long")

    asked = placed.filter("asks").select("vec_id", "v", "dim", "first", hashed("first").alias("hash"))
    nearest = asked.withColumnRenamed("first", "region").join(parts, ["dim", "region"]).withColumn("deal", F.pmod("hash", "parts"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.distinct().withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    first = written(ranked(ask(nearest.withColumn("least", F.lit(-math.inf)))), "first")

    known = asked.join(first.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("least")), "vec_id", "left")
    known = known.select("vec_id", "v", "dim", "first", "hash", F.coalesce("least", F.lit(-math.inf)).alias("least"))
    radius = {(r.dim, r.region): r.radius for r in facts.filter("region >= 0").collect()}  # no more than there are pivots
    admitted = known.mapInArrow(regions.admitting(radius), "vec_id long, v array<long>, dim int, first int, hash long, least double, region int")
    admitted = admitted.join(parts, ["dim", "region"]).withColumn("deal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    others = admitted.filter(~((F.col("region") == F.col("first")) & (F.col("deal") == F.pmod("hash", "parts"))))
    answers = first.select("query_id", "vec_id", "score").unionByName(ask(others))
    return ranked(answers).select("query_id", "rank", "vec_id", "score")
