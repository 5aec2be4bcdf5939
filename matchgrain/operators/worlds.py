"""Resampled worlds that all units share: multinomial weights of matches, drawn the same way in every engine."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def match_weights(games: DataFrame, worlds: int, seed: int) -> DataFrame:
    """``game_id, w, k``: how often each match is drawn in each world, as many draws as there are matches.

    A draw is the first 32 bits of md5(seed, world, draw) modulo the matches, so SQL can repeat it. The table has matches times
    worlds rows at most and is made once for all units.
    """
    g = games.select("game_id").distinct().withColumn("i", F.row_number().over(Window.orderBy("game_id")) - 1)  # the match list
    n = g.count()
    spark = games.sparkSession
    draws = spark.range(worlds * n).select(F.floor(F.col("id") / n).alias("w"), (F.col("id") % n).alias("d"))
    text = F.concat_ws("-", F.lit(seed), F.col("w"), F.col("d"))
    pick = draws.withColumn("i", F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") % n)
    return pick.groupBy("w", "i").agg(F.count("*").alias("k")).join(F.broadcast(g), "i").select("game_id", "w", "k")


def weights_sql(games: str, worlds: int, seed: int, name: str = "mw") -> str:
    """The same weights for the oracle, as common table expressions over ``games`` (a relation with ``game_id``)."""
    return f"""{name}_g AS (SELECT game_id, row_number() OVER (ORDER BY game_id) - 1 AS i FROM (SELECT DISTINCT game_id FROM {games})), {name}_n AS (SELECT count(*) AS n FROM {name}_g),
{name}_d AS (SELECT w, CAST('0x' || substr(md5('{seed}-' || w || '-' || d), 1, 8) AS BIGINT) % n AS i FROM {name}_n, (SELECT unnest(range({worlds})) AS w) ws, (SELECT unnest(range((SELECT n FROM {name}_n))) AS d) ds),
{name} AS (SELECT game_id, w, count(*) AS k FROM {name}_d JOIN {name}_g USING (i) GROUP BY ALL)"""


def ratios(parts: DataFrame, weights: DataFrame, unit: str, top: str, bottom: str) -> DataFrame:
    """``unit, w, x``: ratio of weighted sums in every world; a world without exposure is a hole, not a zero."""
    s = parts.join(F.broadcast(weights), "game_id").groupBy(unit, "w").agg(F.sum(F.col(top) * F.col("k")).alias("_t"), F.sum(F.col(bottom) * F.col("k")).alias("_b"))
    return s.select(unit, "w", F.try_divide(F.col("_t"), F.nullif(F.col("_b"), F.lit(0))).alias("x"))


#: A Poisson(1) draw is the number of these that 32 hashed bits reach: the distribution's steps, times 2**32.
POISSON = tuple(int(sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) * 2**32) for k in range(12))


def poisson_weight(unit: Column, world: Column, seed: int) -> Column:
    """How often a unit is drawn in a world, from a hash of both: no table of weights, no order of units, the same everywhere."""
    text = F.concat_ws("-", F.lit(seed), unit, world)
    bits = F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long")
    return sum((F.when(bits >= s, 1).otherwise(0) for s in POISSON), F.lit(0))


def poisson_sql(unit: str, world: str, seed: int) -> str:
    bits = f"CAST('0x' || substr(md5('{seed}-' || {unit} || '-' || {world}), 1, 8) AS BIGINT)"
    return f"len(list_filter([{', '.join(map(str, POISSON))}], lambda s: {bits} >= s))"


def in_worlds(rows: DataFrame, worlds: int) -> DataFrame:
    """Each row once for every world, to be summed at once: put it behind an aggregation by unit."""
    return rows.withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(worlds - 1))))
