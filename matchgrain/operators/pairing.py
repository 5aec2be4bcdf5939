"""One-to-one pairing of two event streams inside a time tolerance, nearest pairs first; and the clocks between them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


#: Pairs of a cluster that are settled in one pass over a sorted list; a larger cluster is thinned by rounds first.
CLUSTER_PAIRS = 400
ROUNDS = 3


def candidates(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float) -> DataFrame:
    """Pairs within the tolerance: events meet in time buckets of its width, so the join is an equi-join."""
    bucket = F.floor(F.col("seconds") / tolerance)
    x = a.select(*keys, F.col("event_id").alias("a"), F.col("seconds").alias("sa"), "start_x", "start_y", bucket.alias("k"))
    y = b.select(*keys, F.col("event_id").alias("b"), F.col("seconds").alias("sb"), F.col("start_x").alias("bx"), F.col("start_y").alias("by"), bucket.alias("kb"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("k"))
    gap = F.abs(F.col("sa") - F.col("sb"))
    met = x.join(y, [*keys, "k"]).where(gap <= tolerance)
    return met.select(*keys, F.col("k").alias("ka"), "kb", "a", "b", gap.alias("gap"), F.hypot(F.col("start_x") - F.col("bx"), F.col("start_y") - F.col("by")).alias("distance"))


def clustered(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """``pairs`` with the ``cluster`` of each: runs of time buckets that hold a paired event, no bucket left out.

    Pairs of different clusters share no event. The window runs over occupied buckets, as many as a half has at most,
    however many events there are.
    """
    held = pairs.select(*keys, F.explode(F.array("ka", "kb")).alias("ka")).distinct()
    order = Window.partitionBy(*keys).orderBy("ka")
    opens = F.when(F.col("ka") - F.lag("ka").over(order) > 1, 1).otherwise(0)
    runs = held.withColumn("opens", opens).withColumn("cluster", F.sum("opens").over(order)).drop("opens")
    return pairs.join(runs, [*keys, "ka"])


def greedy(pairs: DataFrame, group: list[str]) -> DataFrame:
    """The greedy pass by (gap, distance, ids) inside each group: a fold over its sorted pairs."""
    kinds = dict(pairs.dtypes)
    kept = f"array<struct<a:{kinds['a']},b:{kinds['b']},gap:double>>"
    start = F.struct(F.array().cast(f"array<{kinds['a']}>").alias("a"), F.array().cast(f"array<{kinds['b']}>").alias("b"), F.array().cast(kept).alias("kept"))

    def step(done: Column, p: Column) -> Column:
        new = F.struct(F.concat(done["a"], F.array(p["a"])).alias("a"), F.concat(done["b"], F.array(p["b"])).alias("b"), F.concat(done["kept"], F.array(F.struct(p["a"].alias("a"), p["b"].alias("b"), p["gap"].alias("gap"))).cast(kept)).alias("kept"))
        return F.when(F.array_contains(done["a"], p["a"]) | F.array_contains(done["b"], p["b"]), done).otherwise(new)

    one = pairs.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("gap", "distance", "a", "b"))).alias("pairs"))
    return one.select(F.explode(F.aggregate("pairs", start, step)["kept"]).alias("p")).select("p.a", "p.b", "p.gap")


def pair_events(a: DataFrame, b: DataFrame, keys: list[str], tolerance: float, cluster_pairs: int = CLUSTER_PAIRS) -> DataFrame:
    """``a, b, gap``: what a greedy pass over all pairs by (gap, distance, ids) would keep.

    Events fall into clusters that have nothing to do with each other; a cluster of a bounded number of pairs is settled by
    itself. In a larger one, a pair that is the nearest left for both its events is in the greedy result whatever else
    happens: rounds of such mutual choices, by grouped minima, thin it until what is left falls into small clusters.
    """
    left = cut(candidates(a, b, keys, tolerance))
    order = F.struct("gap", "distance", "a", "b")
    found = None
    while not left.isEmpty():
        marked = clustered(left, keys)
        size = marked.groupBy(*keys, "cluster").agg(F.count("*").alias("size"))
        marked = cut(marked.join(size, [*keys, "cluster"]))
        some = cut(greedy(marked.where(F.col("size") <= cluster_pairs), [*keys, "cluster"]))
        found = some if found is None else found.unionByName(some)
        left = marked.where(F.col("size") > cluster_pairs).drop("cluster", "size")
        for _ in range(ROUNDS):
            if left.isEmpty():
                break
            one = left.groupBy("a").agg(F.min(order).alias("m")).select("m.*")
            two = left.groupBy("b").agg(F.min(order).alias("m")).select("m.*")
            both = cut(one.join(two.select("a", "b"), ["a", "b"]).select("a", "b", "gap"))
            found = found.unionByName(both)
            left = cut(left.join(both.select("a"), "a", "left_anti").join(both.select("b"), "b", "left_anti"))
    return left.select("a", "b", "gap") if found is None else found


def clock_offsets(a: DataFrame, b: DataFrame, keys: list[str], team: str, grid: Sequence[float], window: float) -> DataFrame:
    """``keys, offset, hits``: the offset of ``grid`` under which most events of ``a`` have one of ``b``, same team, near.

    Ties go to the smallest absolute offset, then to the negative one. The grid is declared and short, so each event is
    repeated once for each of its offsets and meets ``b`` in buckets of the window's width.
    """
    shifted = a.select(*keys, team, "event_id", "seconds", F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("offset")).withColumn("at", F.col("seconds") + F.col("offset"))
    bucket = F.floor(F.col("at") / window)
    near = b.select(*keys, team, F.col("seconds").alias("other"), F.explode(F.array(*[F.floor(F.col("seconds") / window) + d for d in (-1, 0, 1)])).alias("k")).distinct()
    hit = shifted.withColumn("k", bucket).join(near, [*keys, team, "k"]).where(F.abs(F.col("at") - F.col("other")) <= window).select(*keys, "event_id", "offset").distinct()
    counts = hit.groupBy(*keys, "offset").count()
    every = a.select(*keys).union(b.select(*keys)).distinct()
    best = counts.groupBy(*keys).agg(F.min(F.struct((-F.col("count")).alias("c"), F.abs("offset").alias("d"), "offset")).alias("m"))
    return every.join(best, keys, "left").select(*keys, F.coalesce("m.offset", F.lit(float(min(grid, key=lambda g: (abs(g), g))))).alias("offset"), F.coalesce(-F.col("m.c"), F.lit(0)).cast("long").alias("hits"))


def derangement(rows: DataFrame, key: str, stratum: str, order: F.Column) -> DataFrame:
    """Each row's partner in its stratum, never itself: the next one in a declared order, round the circle. Alone: null."""
    w = Window.partitionBy(stratum).orderBy(order, key)
    every = Window.partitionBy(stratum)
    first = F.min(F.struct(order.alias("o"), F.col(key).alias("k"))).over(every)["k"]
    return rows.select(key, stratum, F.when(F.count("*").over(every) > 1, F.coalesce(F.lead(key).over(w), first)).alias("partner"))
