"""Exact top-k by inner product: one KD-tree per shard, best-first with box bounds.

Vectors are dealt to shards of bounded size; a shard's tree (median splits, tight boxes) is one row of the index table. Query
blocks meet shards in two passes: every block first searches one shard, which gives each query a k-th score; that score goes
along to the other shards, where a box whose bound stays below it is never opened.

Defined results: vectors that are null, empty, or hold a null or non-finite component take no part; a query's own row is any
row with its id, and repeated query ids are answered once, for the smallest of their vectors; vectors of another length than the query's are not compared
(shards hold one length); fewer than k candidates give all of them; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

SCALE = 1024
SHARD_ROWS = 20_000
QUERY_BLOCK = 256
LEAF_ROWS = 64
EXACT = float(1 << 53)

VECTORS = "vec_id long, dim int, vector binary"
FOUND = "query_id long, vec_id long, score long"


def quantised(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """``floor(scale * x)`` of every valid vector, as little-endian doubles that hold whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, v in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_numpy(zero_copy_only=False), strict=True):
                if i is None or v is None or len(v) == 0:
                    continue
                x = np.asarray(v, dtype=np.float64)  # null components become NaN
                if np.isfinite(x).all():
                    rows.append((i, len(x), np.floor(scale * x).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.int64(), pa.int32(), pa.binary()))], names=["vec_id", "dim", "vector"])

    return embeddings.select("vec_id", "embedding").mapInArrow(run, VECTORS)


class Tree:
    """A KD-tree over the rows of ``points``; nodes in arrays, each with the tight box of its rows."""

    def __init__(self, ids: np.ndarray, points: np.ndarray, leaf: int = LEAF_ROWS):
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        perm = np.arange(len(ids))
        self.low, self.high, self.span, self.child = [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            node = len(self.span)
            if parent >= 0:
                self.child[parent][side] = node
            rows = points[perm[a:b]]
            low, high = rows.min(axis=0), rows.max(axis=0)
            self.low.append(low)
            self.high.append(high)
            self.span.append((a, b))
            self.child.append([-1, -1])
            axis = int((high - low).argmax())
            if b - a > leaf and high[axis] > low[axis]:
                mid = (b - a) // 2
                perm[a:b] = perm[a:b][np.argpartition(rows[:, axis], mid)]
                stack += [(a, a + mid, node, 0), (a + mid, b, node, 1)]
        self.ids, self.points = ids[perm], points[perm]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.most = float(np.abs(points).max())

    def search(self, query_id: int, q: np.ndarray, k: int, bounds: np.ndarray, floor: float) -> list[tuple[int, int]]:
        """The k best (score, id) of this tree that reach ``floor``."""
        exact = self.most * float(np.abs(q).max()) * len(q) < EXACT
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst first
        heap = [(-float(bounds[0]), 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            bar = max(floor, best[0][0]) if len(best) == k else floor
            if -bound < bar:
                break
            if self.child[node][0] >= 0:
                for c in self.child[node]:
                    heapq.heappush(heap, (-float(bounds[c]), c))
                continue
            a, b = self.span[node]
            ids = self.ids[a:b]
            if exact:
                scores = self.points[a:b] @ q
                take = np.flatnonzero((scores >= bar) & (ids != query_id))
                found = zip(scores[take].astype(np.int64).tolist(), ids[take].tolist(), strict=True)
            else:
                whole = [int(x) for x in q]
                found = [(sum(int(x) * y for x, y in zip(p, whole, strict=True)), i) for p, i in zip(self.points[a:b].tolist(), ids.tolist(), strict=True) if i != query_id]
            for score, i in found:
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
        return [(s, -i) for s, i in best]


def search_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """``pairs`` (tree, queries: pickled) to each query's best in that shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree_row, block in zip(batch.column("tree"), batch.column("queries"), strict=True):
                tree: Tree = pickle.loads(tree_row.as_py())
                ids, vectors, floors = pickle.loads(block.as_py())
                # Bound of each box for each query, in double precision with room for its rounding.
                bounds = np.maximum(vectors, 0) @ tree.high.T + np.minimum(vectors, 0) @ tree.low.T
                bounds += np.abs(bounds) * 1e-9
                for i, q, b, f in zip(ids.tolist(), vectors, bounds, floors.tolist(), strict=True):
                    out += [(i, v, s if -(1 << 63) <= s < 1 << 63 else None) for s, v in tree.search(i, q, k, b, f)]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, FOUND)


def blocks(queries: DataFrame, by: list[str]) -> DataFrame:
    """Rows of (vec_id, vector, floor) gathered into pickled blocks of bounded size."""

    def gather(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        vectors = np.vstack([np.frombuffer(v, dtype=np.float64) for v in rows["vector"]])
        block = pickle.dumps((rows["vec_id"].to_numpy(np.int64), vectors, rows["floor"].to_numpy(np.float64)))
        return pd.DataFrame([(*[int(x) for x in key], block)], columns=[*by, "queries"])

    return queries.groupBy(*by).applyInPandas(gather, ", ".join(f"{c} {'long' if c == 'block' else 'int'}" for c in by) + ", queries binary")


def top_k(embeddings: DataFrame, is_query: F.Column, k: int = 10, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest scores among all other rows."""
    vectors = durable(quantised(embeddings, scale))
    sizes = {r["dim"]: r["count"] for r in vectors.groupBy("dim").count().collect()}  # one row per vector length in use
    spark = embeddings.sparkSession
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = F.create_map(*[F.lit(x) for d, n in sizes.items() for x in (d, -(-n // shard_rows))])[F.col("dim")]
    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id"), shards).cast("int"))

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        points = np.vstack([np.frombuffer(v, dtype=np.float64) for v in rows["vector"]])
        return pd.DataFrame([(*[int(x) for x in key], pickle.dumps(Tree(rows["vec_id"].to_numpy(np.int64), points)))], columns=["dim", "shard", "tree"])

    index = durable(dealt.groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, tree binary"))
    # Of rows that repeat a query's id the smallest vector (by length, then by its bytes) asks.
    asked = vectors.where(is_query).groupBy("vec_id").agg(F.min(F.struct("dim", "vector")).alias("least")).select("vec_id", "least.dim", "least.vector")
    n_asked = max(1, asked.count())
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(-(-n_asked // QUERY_BLOCK)))).withColumn("shards", shards)
    # First pass: each block searches one shard.
    home = F.pmod(F.col("block"), F.col("shards")).cast("int")
    first = blocks(asked.withColumn("shard", home).withColumn("floor", F.lit(float("-inf"))), ["dim", "shard", "block"])
    at_home = durable(search_pairs(first.join(index, ["dim", "shard"]), k))
    kth = at_home.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor"))
    # Second pass: the k-th scores go along to the other shards.
    bounded = blocks(
        asked.join(kth.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(float("-inf")))), ["dim", "block"]
    )
    elsewhere = bounded.withColumn("shards", shards).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)))
    elsewhere = elsewhere.where(F.col("shard") != home).select("dim", "shard", "queries")
    found = at_home.unionByName(search_pairs(elsewhere.join(index, ["dim", "shard"]), k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_exact_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.pmod(F.col("vec_id"), F.lit(100)) == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
