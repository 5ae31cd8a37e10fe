"""Approximate nearest neighbours with forests of random-projection trees.

Vectors are dealt by a hash of their id into blocks of about ``BLOCK`` rows. Each block grows one forest, which is stored:
a node splits its rows in halves at the median of their projections on the difference of two of them; leaves hold up to
``LEAF`` rows. A query searches all trees of a block through one priority queue: a leaf waits in it under the largest
margin by which the way to it crosses to the far side of a split, so the leaves that come out first are those the query
nearly falls into, whichever tree they are in. The queue is served in one go, by selecting the leaves of the smallest
margins, ``VISITS`` times the rows of the block in all. A row that many of them hold is likely near: the rows that
stand in most of them are the candidates, ``WIDTH`` times the geometric mean of the neighbours asked for and the block's
rows. These are ranked exactly, in double precision, and the best of all blocks are merged.

Queries are dealt into chunks and meet every block in a task of its own, so no task holds more than one block and one
chunk, and nothing is broadcast. Every query visits every block, so the rows that move grow with the product of the two.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do rows
without an id; of rows that share an id the largest vector (compared component by component) takes part; vectors of
different lengths never meet; equal vectors split at random and tie by id; with fewer candidates than asked for, all
are returned; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.llm.shared import settle, table

BLOCK, CHUNK, TREES, LEAF, VISITS, WIDTH, NEAREST = 16_384, 8192, 64, 32, 10, 2.5, 20
#: Queries that a task handles at a time.
AT_ONCE = 64


class Forest:
    """Trees of one depth over the rows of ``x``. A tree is the order of its rows, leaf after leaf, and for each inner node the two rows of its normal and the cut."""

    def __init__(self, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7, stored: bytes | None = None):
        self.x, self.trees, self.seed = x, trees, seed
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
        self.bounds = np.array([0, len(x)])
        for _ in range(self.depth):
            self.bounds = np.sort(np.concatenate([self.bounds, self._middles(self.bounds)]))
        inner = 2**self.depth - 1
        if stored is None:
            self.order, self.pairs, self.cuts = np.empty((trees, len(x)), np.int32), np.empty((trees, inner, 2), np.int32), np.empty((trees, inner))
            for t in range(trees):
                self._grow(t)
        else:
            parts = np.split(np.frombuffer(stored, np.uint8), np.cumsum([4 * trees * len(x), 8 * trees * inner]))
            self.order, self.pairs, self.cuts = parts[0].view(np.int32).reshape(trees, -1), parts[1].view(np.int32).reshape(trees, inner, 2), parts[2].view(np.float64).reshape(trees, inner)

    def stored(self) -> bytes:
        return self.order.tobytes() + self.pairs.tobytes() + self.cuts.tobytes()

    @staticmethod
    def _middles(bounds: np.ndarray) -> np.ndarray:
        return bounds[:-1] + np.diff(bounds) // 2

    def _normals(self, t: int, level: int) -> np.ndarray:
        a, b = self.pairs[t, 2**level - 1 : 2 ** (level + 1) - 1].T
        normals = self.x[a] - self.x[b]
        alike = ~normals.any(1)
        normals[alike] = np.random.default_rng((self.seed, t, level)).standard_normal((int(alike.sum()), self.x.shape[1]))
        return normals / np.sqrt((normals * normals).sum(1, keepdims=True))

    def _grow(self, t: int) -> None:
        rng, bounds = np.random.default_rng((self.seed, t)), np.array([0, len(self.x)])
        order = rng.permutation(len(self.x))  # rows of equal projections are dealt by this order
        for level in range(self.depth):
            starts, sizes = bounds[:-1], np.diff(bounds)
            first = rng.integers(0, sizes)
            second = (first + rng.integers(1, np.maximum(sizes, 2))) % sizes
            here = slice(2**level - 1, 2 ** (level + 1) - 1)
            self.pairs[t, here] = np.stack([order[starts + first], order[starts + second]], 1)
            node = np.repeat(np.arange(len(sizes)), sizes)
            at = (self.x[order] * self._normals(t, level)[node]).sum(1)
            by = np.lexsort((at, node))
            order, at, middles = order[by], at[by], self._middles(bounds)
            self.cuts[t, here] = (at[np.maximum(middles - 1, 0)] + at[middles]) / 2
            bounds = np.sort(np.concatenate([bounds, middles]))
        self.order[t] = order

    def margins(self, queries: np.ndarray) -> np.ndarray:
        """For each query the place in the queue of every leaf of every tree."""
        out = np.empty((len(queries), self.trees, 2**self.depth), np.float32)
        for t in range(self.trees):
            far = np.zeros((len(queries), 1))
            for level in range(self.depth):
                m = queries @ self.planes[t][level].T - self.cuts[t, 2**level - 1 : 2 ** (level + 1) - 1]
                across = np.maximum(far, np.abs(m))
                far = np.stack([np.where(m < 0, far, across), np.where(m < 0, across, far)], 2).reshape(len(queries), -1)
            out[:, t] = far
        return out.reshape(len(queries), -1)

    def search(self, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, nearest: int, width: float = WIDTH, visits: float = VISITS):
        """For each query (place, ids, scores) of its nearest candidates. ``own``: the ids of the queries themselves."""
        n, leaves = len(self.x), 2**self.depth
        wanted = min(n, max(nearest + 1, int(np.ceil(width * np.sqrt(nearest * n)))))
        self.planes = [[self._normals(t, level) for level in range(self.depth)] for t in range(self.trees)]
        sizes = np.diff(self.bounds)
        spots = self.bounds[:-1, None] + np.minimum(np.arange(sizes.max()), sizes[:, None])  # one beyond a smaller leaf's end
        padded = np.concatenate([self.order, np.full((self.trees, 1), n, np.int32)], 1)
        members = padded[:, spots]
        members[:, np.arange(sizes.max()) >= sizes[:, None]] = n
        members = members.reshape(self.trees * leaves, -1)
        served = min(self.trees * leaves, int(np.ceil(visits * leaves)))
        for at in range(0, len(queries), AT_ONCE):
            margins = self.margins(queries[at : at + AT_ONCE])
            for k, q in enumerate(queries[at : at + AT_ONCE]):
                out = np.argpartition(margins[k], served - 1)[:served]
                votes = np.bincount(members[out].reshape(-1), minlength=n + 1)[:n]
                rows = np.argpartition(-votes, wanted - 1)[:wanted]
                rows = rows[(ids[rows] != own[at + k]) & (votes[rows] > 0)]
                scores = (self.x[rows] * q).sum(1)  # a row's sum doesn't depend on its place, so equal vectors tie
                if len(rows) > nearest:
                    edge = np.partition(scores, len(rows) - nearest)[len(rows) - nearest]
                    rows, scores = rows[scores >= edge], scores[scores >= edge]
                best = np.lexsort((ids[rows], -scores))[:nearest]
                yield at + k, ids[rows[best]], scores[best]


def valid(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """key, vector (doubles) and dim of the rows that take part, one for each key."""
    v = F.col(vector).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.where(F.col(key).isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0.0))
    one = rows.groupBy(F.col(key).cast("long").alias("key")).agg(F.max(v).alias("vector"))
    return one.withColumn("dim", F.size("vector"))


def _matrix(t: pa.Table, key: str, vector: str) -> tuple[np.ndarray, np.ndarray]:
    ids = t.column(key).to_numpy()
    flat = t.column(vector).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    order = np.argsort(ids)  # the same forest however the rows arrive
    return ids[order], flat.reshape(len(ids), -1)[order]


def grow(rows: DataFrame, trees: int = TREES, leaf: int = LEAF) -> DataFrame:
    """dim, block, forest: one stored forest for each block of ``rows``."""

    def work(keys, t):
        _, x = _matrix(t, "key", "vector")
        return pa.table({"dim": pa.array([keys[0].as_py()], pa.int32()), "block": pa.array([keys[1].as_py()], pa.int32()), "forest": pa.array([Forest(x, trees, leaf).stored()], pa.binary())})

    return settle(rows.groupBy("dim", "block").applyInArrow(work, "dim int, block int, forest binary"), "forests")


def nearest(vectors: DataFrame, is_query: Column, k: int = NEAREST, width: float = WIDTH, trees: int = TREES, leaf: int = LEAF, visits: float = VISITS) -> DataFrame:
    """query, rank, key, score. ``vectors`` as from ``valid``; ``is_query`` is a condition on its columns."""
    vectors = settle(vectors, "vectors")
    sizes = vectors.groupBy("dim").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"), F.ceil(F.greatest(F.sum(is_query.cast("int")), F.lit(1)) / F.lit(CHUNK)).cast("int").alias("chunks"))
    sized = vectors.join(F.broadcast(sizes), "dim")  # one row for each vector length
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rows = sized.select("dim", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"), "chunks", "key", "vector")
    forests = grow(rows.drop("chunks"), trees, leaf).join(F.broadcast(sizes), "dim")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    held = rows.select("dim", "block", upto("chunks").alias("chunk"), "key", "vector", none("binary", "forest"))
    held = held.unionByName(forests.select("dim", "block", upto("chunks").alias("chunk"), none("long", "key"), none("array<double>", "vector"), "forest"))
    queries = sized.where(is_query).select(
        F.col("dim").alias("_dim"), upto("blocks").alias("_block"), F.pmod(F.xxhash64("key", F.lit(1)), F.col("chunks")).cast("int").alias("_chunk"), F.col("key").alias("own"), F.col("vector").alias("sought")
    )

    def work(left, right):
        if not left.num_rows or not right.num_rows:
            return pa.table({"query": pa.array([], pa.int64()), "key": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        there = left.column("forest").is_valid()
        stored = left.filter(there).column("forest")[0].as_py()
        ids, x = _matrix(left.filter(left.column("key").is_valid()), "key", "vector")
        own, q = _matrix(right, "own", "sought")
        out = [(np.full(len(found), own[i]), found, scores) for i, found, scores in Forest(x, trees, leaf, stored=stored).search(q, ids, own, k, width, visits)]
        return pa.table({name: np.concatenate(c) for name, c in zip(("query", "key", "score"), zip(*out, strict=True), strict=True)})

    found = held.select(F.col("dim").alias("d"), F.col("block").alias("b"), F.col("chunk").alias("c"), "key", "vector", "forest").groupBy("d", "b", "c").cogroup(queries.groupBy("_dim", "_block", "_chunk")).applyInArrow(work, "query long, key long, score double")
    order = W.partitionBy("query").orderBy(F.col("score").desc(), "key")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "rank", "key", "score")


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = nearest(valid(table(spark, sf_dir, "embeddings")), F.col("key") % 20 == 0)
    return found.select(F.col("query").alias("query_id"), "rank", F.col("key").alias("vec_id"), "score")
