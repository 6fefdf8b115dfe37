"""Exact top-k inner products with an M-tree, searched best first (operator 9)."""

from __future__ import annotations

import heapq
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common
from .ann import first_of, usable

#: Rows of one tree, queries of one unit of work, entries of a leaf page and of an inner node.
SHARD, QUERY_BLOCK, PAGE, FANOUT = 16_384, 4096, 256, 8
#: Relative slack of every bound, against rounding; bounds only save work, scores are exact integers.
_EPS = 1e-9


class Node:
    """A page: its routing object, covering radius, and either children or rows, each with its distance to the routing object.

    A leaf's rows lie together in the tree's table, from ``first`` on, the nearest to the routing object first."""

    __slots__ = ("center", "radius", "children", "first", "apart", "centers", "radii")

    def __init__(self, center, radius, children, first, apart):
        self.center, self.radius, self.children, self.first, self.apart = center, radius, children, first, apart
        self.centers = np.array([c.center for c in children or ()])
        self.radii = np.array([c.radius for c in children or ()])


class MTree:
    """Rows under the Euclidean distance after one more coordinate makes all of them equally long.

    With v' = (v, sqrt(M^2 - |v|^2)) and q' = (q, 0), |q' - v'|^2 = |q|^2 + M^2 - 2 q.v: nearest is
    largest inner product, and the triangle inequality holds.
    """

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.rows, self.ids = rows[order], ids[order]
        norms = (self.rows * self.rows).sum(axis=1)
        self.top = float(norms.max()) if len(norms) else 0.0
        self.points = np.concatenate([self.rows, np.sqrt(self.top - norms)[:, None]], axis=1)
        self.leaves: list[np.ndarray] = []
        self.root = self._build(np.arange(len(self.rows)))
        order = np.concatenate(self.leaves)
        self.rows, self.ids = self.rows[order], self.ids[order]

    def _apart(self, center: np.ndarray, at: np.ndarray) -> np.ndarray:
        d = self.points[at] - center
        return np.sqrt((d * d).sum(axis=1))

    def _build(self, at: np.ndarray) -> Node:
        center = self.points[at[len(at) // 2]] if len(at) else np.zeros(self.points.shape[1])
        apart = self._apart(center, at)
        radius = float(apart.max()) if len(at) else 0.0
        if len(at) <= PAGE:
            near = np.argsort(apart, kind="stable")
            first = sum(map(len, self.leaves))
            self.leaves.append(at[near])
            return Node(center, radius, None, first, apart[near])
        seeds = [int(np.argmax(apart))]
        dist = self._apart(self.points[at[seeds[0]]], at)
        own = np.zeros(len(at), "i4")
        while len(seeds) < FANOUT and dist.max() > 0:
            seeds.append(int(np.argmax(dist)))
            d = self._apart(self.points[at[seeds[-1]]], at)
            own[d < dist] = len(seeds) - 1
            dist = np.minimum(dist, d)
        parts = [at[own == k] for k in range(len(seeds))]
        parts = [p for p in parts if len(p)]
        if len(parts) < 2:  # all alike: pages of any rows are as good
            parts = np.array_split(at, min(FANOUT, -(-len(at) // PAGE)))
        children = [self._build(p) for p in parts]
        return Node(center, radius, children, None, np.array([math.sqrt(((c.center - center) ** 2).sum()) for c in children]))

    def search(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """(score, id) of the k largest inner products, larger first, ties to smaller ids; ``own`` is left out."""
        if not len(self.ids):
            return []
        base = float((query * query).sum()) + self.top
        point = np.concatenate([query, [0.0]])
        best_s, best_i = np.zeros(0), np.zeros(0, "i8")
        least = -math.inf  # the k-th score so far
        slack = _EPS * (1 + base)

        def reach(distance: float) -> float:
            return (base - max(0.0, distance) ** 2) / 2 + slack

        def limit() -> float:
            """Beyond this distance no row can reach the k-th score."""
            return math.inf if least == -math.inf else math.sqrt(max(0.0, base - 2 * (least - slack)))

        d = math.sqrt(((point - self.root.center) ** 2).sum())
        heap, n = [(-reach(d - self.root.radius), 0, self.root, d)], 0
        while heap:
            bound, _, node, d = heapq.heappop(heap)
            if -bound < least:
                break
            far = limit()
            if node.children is None:
                # |d(q, center) - d(row, center)| bounds d(q, row): rows outside the ring need no product
                a, b = np.searchsorted(node.apart, (d - far, d + far)) if far < math.inf else (0, len(node.apart))
                at = slice(node.first + max(0, a - 1), node.first + min(len(node.apart), b + 1))
                score = self.rows[at] @ query
                if not len(score) or score.max() < least:
                    continue
                ids = self.ids[at]
                keep = (score >= least) & (ids != own)
                if keep.any():
                    best_s, best_i = np.concatenate([best_s, score[keep]]), np.concatenate([best_i, ids[keep]])
                    order = np.lexsort((best_i, -best_s))
                    order = order[first_of(best_s[order], best_i[order])][:k]
                    best_s, best_i = best_s[order], best_i[order]
                    if len(best_s) == k:
                        least = float(best_s[-1])
                continue
            some = np.flatnonzero(np.abs(d - node.apart) - node.radii <= far)  # by the stored parent distance alone
            apart = np.sqrt(((node.centers[some] - point) ** 2).sum(axis=1))
            for c, dc in zip(some.tolist(), apart.tolist(), strict=True):
                c = node.children[c]
                if (r := reach(dc - c.radius)) >= least:
                    n += 1
                    heapq.heappush(heap, (-r, n, c, dc))
        return [(int(s), int(i)) for s, i in zip(best_s, best_i, strict=True)]


def integers(v: np.ndarray) -> np.ndarray:
    """floor(64 x), as doubles; their products and sums are exact below 2**53."""
    return np.floor(64.0 * v)


def search(vectors: DataFrame, every: int = 20, k: int = 20, shard: int = SHARD) -> DataFrame:
    """The k largest integer inner products of each row whose vec_id is divisible by ``every``.

    Rows are dealt to shards by a hash; each shard becomes an M-tree, and each block of queries
    searches each tree in a task of its own. Every unit passes on k rows a query, which are
    ranked once more. Exact for scores within 2**53. Null or non-finite components, a null vector or a null
    vec_id: the row takes no part. Shorter vectors count as filled up with zeros. Rows that share the
    query's vec_id are not its candidates; rows repeated under one vec_id with one score count once.
    """
    spark = vectors.sparkSession
    common.ship(spark)
    v = usable(vectors, nonzero=False)
    n = v.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-n // (every * QUERY_BLOCK)))
    part = lambda of, seed: F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(of)).cast("int")
    rows = v.select(part(shards, 1).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(0).alias("asks"), "vec_id", "embedding")
    asked = v.where(F.col("vec_id") % every == 0)
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), part(blocks, 2).alias("block"), F.lit(1).alias("asks"), "vec_id", "embedding")
    units = rows.unionByName(asked).repartition(max(common.partitions(spark), shards * blocks), "shard", "block").sortWithinPartitions("shard", "block", "asks")

    def run(batches):
        import pyarrow as pa

        for _, t in common.runs(batches, ["shard", "block"]):
            asks = t.column("asks").to_numpy() == 1
            ids, m = t.column("vec_id").to_numpy(), integers(common.matrix(t.column("embedding")))
            tree, out = MTree(m[~asks], ids[~asks]), []
            for q, own in zip(m[asks], ids[asks].tolist(), strict=True):
                out += [(own, i, s) for s, i in tree.search(q, own, k)]
            q, i, s = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (q, i, s)], names=["query_id", "vec_id", "score"])

    found = units.mapInArrow(run, "query_id long, vec_id long, score long").distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
