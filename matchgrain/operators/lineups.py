"""Exact selection without a solver: the feasible player sets of a formation, as a relation, for any number of squads.

Slots are filled one after another and equal sets collapse after each slot, so permutations never pile up. A question about
selections is then an aggregate over the sets, by squad where ``by`` names the squad's columns. The number of sets of a squad is
bounded before any work: beyond ``cap`` the answer is refused, never cut. Squads may be as many as there are: their sets are
dealt to as many partitions as they need at ``SETS`` sets each, by squad, and stay there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


#: Sets in a partition, about.
SETS = 100_000


class TooManySets(ValueError):
    """The relation would exceed its cap; the question stays undecided."""


def _and(parts: Sequence[Column]) -> Column:
    return reduce(Column.__and__, parts, F.lit(True))


def _bounds(candidates: DataFrame, formation: Mapping[str, int], by: Sequence[str]) -> tuple[int, int]:
    n = candidates.groupBy(*by).agg(*[F.count_if(F.array_contains("slots", s)).alias(f"_{i}") for i, s in enumerate(formation)])
    ways = F.lit(1.0)
    for i, places in enumerate(formation.values()):
        for k in range(places):
            ways = ways * F.greatest(F.lit(0), F.col(f"_{i}") - k) / (k + 1)
    every, most = n.agg(F.sum(ways), F.max(ways)).first()
    return round(every or 0), round(most or 0)


def most_sets(candidates: DataFrame, formation: Mapping[str, int], by: Sequence[str] = ()) -> int:
    """No more sets than this are feasible: the product over the slots of the ways to choose, summed over squads."""
    return _bounds(candidates, formation, by)[0]


def feasible_sets(candidates: DataFrame, formation: Mapping[str, int], cap: int = 5_000_000, by: Sequence[str] = (), names: Sequence[str] = ()) -> DataFrame:
    """``candidates`` (player_id, slots array) to ``xi``: sorted arrays of players that fill ``formation`` (slot -> places).

    The sums of the candidates' columns ``names`` (longs) come along. ``cap`` bounds the sets of one squad.
    """
    candidates = cut(candidates.select(*by, "player_id", "slots", *names))
    every, bound = _bounds(candidates, formation, by)
    if bound > cap:
        raise TooManySets(f"up to {bound} sets, the cap is {cap}")
    several = bool(candidates.where(F.size("slots") > 1).take(1))
    empty = [F.array().cast("array<long>").alias("xi"), *[F.lit(0).cast("long").alias(n) for n in names]]
    # Few bytes go in and many sets come out: a fixed number of partitions, which are not put together by their size.
    n = max(int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-every // SETS))
    state = candidates.select(*by).distinct().repartition(n, *by).select(*by, *empty) if by else candidates.sparkSession.range(1).select(empty)
    for slot, places in formation.items():
        fit = candidates.where(F.array_contains("slots", slot)).select(*[F.col(b).alias(f"_{b}") for b in by], F.col("player_id").alias("p"), *[F.coalesce(m, F.lit(0)).alias(f"_{m}") for m in names])
        state = state.withColumn("prev", F.lit(None).cast("long"))
        for _ in range(places):
            # Within one slot kind players come in ascending order: no permutations.
            new = ~F.array_contains("xi", F.col("p")) & (F.col("prev").isNull() | (F.col("p") > F.col("prev")))
            grown = state.join(fit, _and([F.col(b) == F.col(f"_{b}") for b in by] + [new]))
            state = grown.select(*by, F.concat("xi", F.array("p")).alias("xi"), *[(F.col(m) + F.col(f"_{m}")).alias(m) for m in names], F.col("p").alias("prev"))
        state = state.select(*by, F.array_sort("xi").alias("xi"), *names)
        if several:  # the same players may stand in different slots
            state = state.distinct()
    return state


def sums(sets: DataFrame, coefficients: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``xi`` with the sums of its players' integers. ``coefficients``: player_id (each once) and a long each."""
    table = coefficients.select(F.col("player_id").alias("p"), *names)
    return sets.withColumn("p", F.explode("xi")).join(table, "p").groupBy(*by, "xi").agg(*[F.sum(n).alias(n) for n in names])


def shortfalls(sum_of: Mapping[str, Column], minima: Mapping[str, int]) -> tuple[Column, Column]:
    """The largest and the total shortfall of sums against minima."""
    short = [F.greatest(F.lit(0), F.lit(m) - sum_of[n]).cast("long") for n, m in minima.items()]
    return F.greatest(*short) if len(short) > 1 else short[0], sum(short[1:], short[0])


def losses(sets: DataFrame, coefficients: DataFrame | None, minima: Mapping[str, int], by: Sequence[str] = ()) -> DataFrame:
    """``xi``, its integer sums, and the pair (largest shortfall, total shortfall); without ``coefficients`` the sets have the sums."""
    worst, total = shortfalls({n: F.col(n) for n in minima}, minima)
    summed = sets if coefficients is None else sums(sets, coefficients, list(minima), by)
    return summed.withColumn("max_short", worst).withColumn("total_short", total)


def least(rows: DataFrame, key: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """All rows whose ``key`` is the least of their squad."""
    m = rows.groupBy(*by).agg(F.min(F.struct(*key)).alias("_m"))
    met = rows.join(m, list(by)) if by else rows.join(F.broadcast(m))
    return met.where(_and([F.col(k) == F.col("_m")[k] for k in key])).drop("_m")


def best(loss: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All sets of the least loss: the optimum and its ties."""
    return least(loss, ("max_short", "total_short"), by)


def membership(level: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Players in some and in all of the best sets."""
    n = level.groupBy(*by).agg(F.count("*").alias("n"))
    c = level.select(*by, F.explode("xi").alias("player_id")).groupBy(*by, "player_id").count()
    met = c.join(n, list(by)) if by else c.join(F.broadcast(n))
    return met.select(*by, "player_id", (F.col("count") == F.col("n")).alias("necessary"))


def diverse(level: DataFrame, changes: int, most: int, by: Sequence[str] = ()) -> DataFrame:
    """``nth, xi``: of sets that are equally good the first one, then each time the first that differs from every one before
    in at least ``changes`` players."""
    left, out = level.select(*by, "xi"), None
    for k in range(most):
        first = left.groupBy(*by).agg(F.min("xi").alias("xi"))
        one = first.select(*by, F.lit(k + 1).alias("nth"), "xi")
        out = one if out is None else out.unionByName(one)
        taken = first.withColumnRenamed("xi", "_x")
        met = left.join(taken, list(by)) if by else left.join(F.broadcast(taken))
        left = met.where(F.size(F.array_except("xi", "_x")) >= changes).drop("_x")
    return out.where("xi is not null")


def frontier(loss: DataFrame, dims: list[str], by: Sequence[str] = ()) -> DataFrame:
    """Nondominated distinct sum vectors. Two dimensions need one sort and a running maximum for each squad."""
    points = loss.select(*by, *dims).distinct()
    if len(dims) == 2:
        before = Window.partitionBy(*by).orderBy(*[F.desc(d) for d in dims]).rowsBetween(Window.unboundedPreceding, -1)
        return points.withColumn("_top", F.max(dims[1]).over(before)).where(F.col("_top").isNull() | (F.col(dims[1]) > F.col("_top"))).drop("_top")
    other = points.toDF(*[f"_{c}" for c in points.columns])
    better = reduce(Column.__or__, [F.col(f"_{d}") > F.col(d) for d in dims])
    return points.join(other, _and([F.col(b) == F.col(f"_{b}") for b in by] + [F.col(f"_{d}") >= F.col(d) for d in dims]) & better, "left_anti")


def absence(loss: DataFrame, players: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The least loss without each single player; no row means that no set is left."""
    p = players.select(*[F.col(b).alias(f"_{b}") for b in by], F.col("player_id").alias("absent"))
    met = loss.join(p, _and([F.col(b) == F.col(f"_{b}") for b in by] + [~F.array_contains("xi", F.col("absent"))]))
    return met.groupBy(*by, "absent").agg(F.min(F.struct("max_short", "total_short")).alias("m")).select(*by, "absent", "m.max_short", "m.total_short")


def conflict(feasible: Sequence[Column], names: Sequence[str]) -> Column:
    """The minimal conflicting set of declarations, by deletion: ``feasible[m]`` says whether some set meets all declarations in
    the bits of m. Each is dropped in turn if the rest is infeasible without it; nothing if all can be met."""
    table = F.array(*feasible)
    mask = F.lit((1 << len(names)) - 1)
    for i in range(len(names)):
        without = mask.bitwiseAND(F.lit(~(1 << i)))
        mask = F.when(~F.element_at(table, without + 1), without).otherwise(mask)
    kept = F.filter(F.array(*[F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(n)) for i, n in enumerate(names)]), lambda x: x.isNotNull())
    return F.when(feasible[-1], F.lit("")).otherwise(F.concat_ws(" + ", kept))
