"""Connected components of a link table, by stars on small rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove, stored


def large_star(edges: DataFrame) -> DataFrame:
    """Every vertex hangs its larger neighbours on the smallest one it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), F.least("a", "m").alias("m"))
    return edges.join(least, "b").select("a", F.col("m").alias("b"))


def small_star(edges: DataFrame) -> DataFrame:
    """Every vertex hangs itself and its smaller neighbours on the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``v, c``: for every end of ``links`` (a, b) the smallest end that it reaches. The table stays in the shared folder.

    Links are undirected. Alternating large and small stars (a round is one job) until nothing changes; a round at least
    halves the depth of what hangs on a vertex, and minima are taken before rows are shuffled. Once every vertex hangs on its
    component's smallest one a round changes nothing.
    """
    ends = links.select(F.col("a").alias("v")).union(links.select("b")).distinct()
    edges, path = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, paths = None, [path]
    while True:
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == before:
            break
        before = now
        edges, path = stored(small_star(large_star(edges)))
        paths.append(path)
    out, _ = stored(ends.join(edges.select(F.col("a").alias("v"), F.col("b").alias("c")), "v", "left").select("v", F.coalesce("c", "v").alias("c")))
    for p in paths:
        remove(links.sparkSession, p)
    return out
