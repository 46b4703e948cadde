"""Exact top-k by inner product: M-trees searched best first.

Vectors are dealt into shards of bounded size, and a metric tree is built over each. In a
shard a vector v gets one more coordinate, sqrt(M^2 - |v|^2) with M the largest norm there;
a query's is 0. Then |q - v|^2 = |q|^2 + M^2 - 2 q.v is a metric distance that falls as the
inner product rises, and the triangle inequality holds for it.

A node has a routing vector, a covering radius and its distance to its parent. From the
distance of query and parent the least possible distance to a child or a vector is known
without computing it; only what could still be among the k best is computed. Bounds are
compared with a margin above rounding, scores are exact integers.

Queries, in blocks, meet every shard once; each gives its k best, and those are ranked.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.common import batches, pin

SCALE = 1024
SHARD = 8192
BLOCK = 1024
PAGE = 256
FANOUT = 16


class MTree:
    """A metric tree over integer vectors. Nodes and vectors lie in arrays, children and pages side by side."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, page: int = PAGE, fanout: int = FANOUT):
        self.page, self.fanout = page, fanout
        norm = (vectors.astype(float) ** 2).sum(axis=1)
        self.top = float(norm.max())
        full = np.column_stack([vectors.astype(float), np.sqrt(np.maximum(self.top - norm, 0.0))])
        self.order: list[np.ndarray] = []
        self.near: list[np.ndarray] = []
        self.nodes: list[list] = []  # routing vector, radius, to parent, is page, first, last
        self.size = 0
        root = np.arange(len(ids))
        self.nodes.append([])
        self._grow(full, 0, root, 0, -1.0)
        order = np.concatenate(self.order)
        self.ids, self.vectors, self.to_page = ids[order], vectors[order], np.concatenate(self.near)
        self.plain = self.vectors.astype(float)
        self.routing = full[np.array([n[0] for n in self.nodes])]
        self.radius, self.to_parent = (np.array([n[i] for n in self.nodes]) for i in (1, 2))
        self.leaf = np.array([n[3] for n in self.nodes])
        self.first, self.last = (np.array([n[i] for n in self.nodes]) for i in (4, 5))

    def _grow(self, full: np.ndarray, at: int, rows: np.ndarray, routing: int, to_parent: float) -> None:
        d = np.sqrt(((full[rows] - full[routing]) ** 2).sum(axis=1))
        radius = float(d.max())
        if len(rows) <= self.page:
            self.nodes[at] = [routing, radius, to_parent, True, self.size, self.size + len(rows)]
            self.order.append(rows)
            self.near.append(d)
            self.size += len(rows)
            return
        parts, centres = self._split(full, rows, d)
        first = len(self.nodes)
        self.nodes[at] = [routing, radius, to_parent, False, first, first + len(parts)]
        self.nodes.extend([] for _ in parts)
        for i, (part, c) in enumerate(zip(parts, centres, strict=True)):
            self._grow(full, first + i, part, c, float(np.sqrt(((full[c] - full[routing]) ** 2).sum())))

    def _split(self, full: np.ndarray, rows: np.ndarray, d: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
        """Parts around vectors that are far from each other; equal vectors are cut into equal parts."""
        k = min(self.fanout, -(-len(rows) // self.page))
        centres, least, owner = [], np.full(len(rows), np.inf), np.zeros(len(rows), np.int64)
        at = int(d.argmax())
        for i in range(k):
            new = np.sqrt(((full[rows] - full[rows[at]]) ** 2).sum(axis=1))
            owner[new < least] = i
            least = np.minimum(least, new)
            centres.append(int(rows[at]))
            at = int(least.argmax())
            if least[at] == 0.0:
                break
        if len(centres) == 1:
            parts = np.array_split(rows, k)
            return parts, [int(p[0]) for p in parts]
        used = [i for i in range(len(centres)) if (owner == i).any()]
        return [rows[owner == i] for i in used], [centres[i] for i in used]

    def search(self, q: np.ndarray, k: int, own: int) -> list[tuple[int, int]]:
        """The k best (score, id) for query ``q``, without rows of id ``own``; ties to the smaller id."""
        full = np.append(q.astype(float), 0.0)
        base = float(full @ full) + self.top
        margin = 1e-7 * np.sqrt(base) + 1e-9
        # sums below 2**52 are exact in floating point, and faster
        exact = float(q.astype(float) @ q.astype(float)) * self.top < 2.0**104
        best: list[tuple[int, int]] = []  # a heap of (score, -id)
        limit = np.inf

        def distance(node: int) -> float:
            return float(np.sqrt(((full - self.routing[node]) ** 2).sum()))

        d0 = distance(0)
        todo = [(max(0.0, d0 - self.radius[0]), 0, d0)]
        while todo:
            bound, node, d = heapq.heappop(todo)
            if bound > limit + margin:
                break
            a, b = self.first[node], self.last[node]
            if self.leaf[node]:
                at = a + np.flatnonzero(np.abs(d - self.to_page[a:b]) <= limit + margin)
                at = at[self.ids[at] != own]
                scores = (self.plain[at] @ full[:-1]).astype(np.int64) if exact else self.vectors[at] @ q
                if len(best) == k:
                    keep = scores >= best[0][0]
                    at, scores = at[keep], scores[keep]
                if len(scores) > 4 * k:
                    at, scores = (x[scores >= np.partition(scores, -k)[-k]] for x in (at, scores))
                for s, i in zip(scores.tolist(), self.ids[at].tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
                if len(best) == k:
                    limit = np.sqrt(max(0.0, base - 2.0 * best[0][0]))
            else:
                at = a + np.flatnonzero(np.abs(d - self.to_parent[a:b]) - self.radius[a:b] <= limit + margin)
                ds = np.sqrt(((self.routing[at] - full) ** 2).sum(axis=1))
                for n, x in zip(at.tolist(), ds.tolist(), strict=True):
                    low = max(0.0, x - self.radius[n])
                    if low <= limit + margin:
                        heapq.heappush(todo, (low, n, x))
        return [(s, -i) for s, i in sorted(best, reverse=True)]


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, v (floor(scale * x) of each component), dim; without null ids, and vectors that are null or hold null, NaN or infinity."""
    x = F.col(vector_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.col(id_col).isNotNull() & x.isNotNull() & ~bad).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * float(scale))).alias("v"), F.size(x).alias("dim")
    )


def _packed(rows: DataFrame, part: str) -> DataFrame:
    """dim, ``part``, ids, content: the vectors of each part in one binary."""

    def pack(key: tuple, t: pa.Table) -> pa.Table:
        order = np.argsort(ids := t.column("vec_id").to_numpy(), kind="stable")
        v = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), key[0].as_py())
        return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), part: pa.array([key[1].as_py()], pa.int64()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "content": pa.array([v[order].tobytes()], pa.binary())})

    return rows.groupBy("dim", part).applyInArrow(pack, f"dim int, {part} long, ids binary, content binary")


def top_k(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = SCALE, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best inner products of every query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates all rows of the
    same number of components, except those of the query's own id. Fewer candidates than k:
    all of them. Ties go to the smaller vec_id. Repeated rows are candidates of their own,
    but one query: of different vectors of a query's id, the shortest and then least one.
    Empty vectors score 0. See :func:`usable` for what takes no part. Scores are exact as
    long as they fit a long. An empty table, or no query, gives no rows.
    """
    rows = pin(usable(vectors, scale=scale), "vectors")
    per = pin(rows.groupBy("dim").agg(F.ceil(F.count("*") / shard).alias("shards"), F.ceil(F.count_if(F.col("vec_id") % every == 0) / block).alias("blocks")), "vector-counts")
    known = rows.join(per.filter("blocks > 0"), "dim")
    shards = _packed(known.withColumn("shard", F.pmod(F.xxhash64(F.lit(1), "vec_id"), "shards")).select("dim", "shard", "vec_id", "v"), "shard")
    asked = known.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("dim", "v", "blocks")).alias("q")).select("vec_id", "q.*")
    blocks = _packed(asked.withColumn("block", F.pmod(F.xxhash64(F.lit(2), "vec_id"), "blocks")).select("dim", "block", "vec_id", "v"), "block")
    # each shard meets each block: the pair is the key, on both sides
    left = shards.join(per, "dim").select("dim", "shard", "ids", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    right = blocks.join(per, "dim").select("dim", "block", F.col("ids").alias("q_ids"), F.col("content").alias("q_content"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"))
    batches(vectors.sparkSession, 16)

    def search(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for dim, ids, content, q_ids, q_content in zip(*(b.column(i) for i in range(5)), strict=True):
                n = dim.as_py()
                own, queries = np.frombuffer(ids.as_py(), np.int64), np.frombuffer(q_ids.as_py(), np.int64)
                tree = MTree(own, np.frombuffer(content.as_py(), np.int64).reshape(len(own), n))
                found = [(int(q), i, s) for q, v in zip(queries, np.frombuffer(q_content.as_py(), np.int64).reshape(len(queries), n), strict=True) for s, i in tree.search(v, k, int(q))]
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["query_id", "vec_id", "score"])

    found = left.join(right, ["dim", "shard", "block"]).select("dim", "ids", "content", "q_ids", "q_content").mapInArrow(search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
