"""Agreement of two measurements of the same players, under several ways to resample, with controls and admission.

The two measurements are a player's completion on even and on odd days. What is drawn again: players, single days, weeks (a
block keeps its days together), or days and players at once (pigeonhole). Every weight is a hash of (unit, world) where the
row is, so nothing is drawn beforehand and no unit list exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import worlds as ws
from ..sources import neutral
from ..sources.store import cut
from .registry import query
from .statistics import PM, per_match

WORLDS, SEED = 40, 613
#: scheme: (what a row's weight is drawn by, what a player's is drawn by)
SCHEMES = {"players": (None, "player_id"), "days": ("game_id", None), "weeks": ("game_id // 7", None), "pigeonhole": ("game_id", "player_id")}
#: The different weights of rows; days are drawn alike with and without players.
DRAWN = ("one", "days", "weeks")
LEAST_PLAYERS, BAR = 8, 0.1

_LINK = """, link AS (SELECT player_id, coalesce(position, 'none') AS stratum, coalesce(lead(player_id) OVER w, first_value(player_id) OVER w) AS partner FROM players WINDOW w AS (PARTITION BY coalesce(position, 'none') ORDER BY md5('613-' || player_id), player_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""


def _w(by: str | None, world: str, seed: int) -> str:
    return "1" if by is None else ws.poisson_sql(f"({by})", world, seed)


_CASES = [f"SELECT '{n}' AS scheme, w, player_id, game_id % 2 AS odd, sum(n * k) AS n, sum(d * k) AS d FROM (SELECT *, {_w(a, 'w', SEED)} AS k FROM pm, (SELECT unnest(range({WORLDS})) AS w)) GROUP BY ALL" for n, (a, _) in SCHEMES.items()]
_KP = "CASE scheme " + " ".join(f"WHEN '{n}' THEN {_w(b, 'w', SEED + 1)}" for n, (_, b) in SCHEMES.items()) + " END"
_M = lambda c: f"sum(kp * {c}) / sum(kp)"
_R = f"CASE WHEN count(*) FILTER (WHERE kp > 0) >= 3 AND {_M('x * x')} - pow({_M('x')}, 2) > 1e-12 AND {_M('y * y')} - pow({_M('y')}, 2) > 1e-12 THEN ({_M('x * y')} - {_M('x')} * {_M('y')}) / sqrt(({_M('x * x')} - pow({_M('x')}, 2)) * ({_M('y * y')} - pow({_M('y')}, 2))) END"
CELLS = PM + _LINK + f""", parts AS ({' UNION ALL '.join(_CASES)} UNION ALL SELECT 'point', 0, player_id, game_id % 2, sum(n), sum(d) FROM pm GROUP BY ALL),
rate AS (SELECT scheme, w, player_id, sum(n) FILTER (WHERE odd = 0) / nullif(sum(d) FILTER (WHERE odd = 0), 0) AS x, sum(n) FILTER (WHERE odd = 1) / nullif(sum(d) FILTER (WHERE odd = 1), 0) AS y FROM parts GROUP BY ALL),
paired AS (SELECT a.scheme, a.w, a.player_id, stratum, a.x, a.y, b.y AS other, CASE WHEN a.scheme = 'point' THEN 1 ELSE coalesce({_KP.replace('player_id', 'a.player_id').replace('scheme', 'a.scheme').replace("'w'", "a.w").replace("|| w)", "|| a.w)")}, 1) END AS kp
  FROM rate a JOIN link USING (player_id) LEFT JOIN rate b ON b.scheme = a.scheme AND b.w = a.w AND b.player_id = partner),
long AS (SELECT scheme, w, stratum, 'link' AS kind, x, y, kp FROM paired WHERE x IS NOT NULL AND y IS NOT NULL UNION ALL SELECT scheme, w, stratum, 'permuted', x, other, kp FROM paired WHERE x IS NOT NULL AND other IS NOT NULL),
r AS (SELECT scheme, w, stratum, kind, count(*) AS players, {_R} AS r FROM long GROUP BY ALL HAVING sum(kp) > 0),
point AS (SELECT stratum, max(r) FILTER (WHERE kind = 'link') AS r, max(players) FILTER (WHERE kind = 'link') AS players, max(r) FILTER (WHERE kind = 'permuted') AS control FROM r WHERE scheme = 'point' GROUP BY stratum),
cell AS (SELECT stratum, scheme, count(r) AS worlds, quantile_cont(r, 0.05) AS low, quantile_cont(r, 0.95) AS high FROM r WHERE scheme <> 'point' AND kind = 'link' GROUP BY ALL),
decided AS (SELECT cell.*, point.r, point.players, point.control, CASE WHEN point.players < {LEAST_PLAYERS} OR point.r IS NULL THEN 'TOO_FEW' WHEN low >= {BAR} THEN 'AGREES' WHEN high < {BAR} THEN 'DISAGREES' ELSE 'INCONCLUSIVE' END AS decision FROM cell JOIN point USING (stratum))"""


def _weight(by: str, seed: int, world: Column) -> Column:
    return ws.poisson_weight(F.expr(by.replace("//", "div")), world, seed)


def _correlation() -> Column:
    m = lambda c: F.sum(F.col("kp") * c) / F.sum("kp")
    x, y = F.col("x"), F.col("y")
    vx, vy = m(x * x) - m(x) * m(x), m(y * y) - m(y) * m(y)
    return F.when((F.count_if(F.col("kp") > 0) >= 3) & (vx > 1e-12) & (vy > 1e-12), (m(x * y) - m(x) * m(y)) / F.sqrt(vx * vy))


def decided(spark, sf_dir) -> DataFrame:
    """A row for each stratum and scheme: the point, its control under permuted links, the interval and the decision."""
    pm = per_match(spark, sf_dir).select("player_id", "game_id", "n", "d")
    # Days and weeks are drawn once for the match list, not where their rows are; a player's rows stay together over all worlds.
    each = lambda by: F.transform(F.sequence(F.lit(0), F.lit(WORLDS - 1)), lambda w: _weight(by, SEED, w))
    games = cut(pm.select("game_id").distinct().select("game_id", *[each(SCHEMES[s][0]).alias(s) for s in ("days", "weeks")]))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    worlds = pm.join(F.broadcast(games), "game_id").repartition(n, "player_id")
    worlds = worlds.select("player_id", (F.col("game_id") % 2).alias("odd"), "n", "d", F.posexplode(F.arrays_zip("days", "weeks")).alias("w", "k")).select("*", "k.days", "k.weeks", F.lit(1).alias("one"))
    at = lambda odd, c, k: F.sum(F.when(F.col("odd") == odd, F.col(c) * F.col(k)))
    rate = worlds.groupBy("player_id", "w").agg(*[ratio(at(odd, "n", k), at(odd, "d", k)).alias(f"{name}_{k}") for k in DRAWN for odd, name in ((0, "x"), (1, "y"))])
    a = neutral.actions(spark, sf_dir)
    circle = Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws("-", F.lit(SEED), "player_id").cast("binary")), "player_id")
    whole = circle.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    link = neutral.players(a).select("player_id", F.coalesce("position", F.lit("none")).alias("stratum"))
    link = link.withColumn("partner", F.coalesce(F.lead("player_id").over(circle), F.first("player_id").over(whole)))
    other = rate.select("w", F.col("player_id").alias("partner"), *[F.col(f"y_{k}").alias(f"other_{k}") for k in DRAWN])
    paired = rate.join(link, "player_id").join(other, ["w", "partner"], "left").withColumn("drawn", _weight("player_id", SEED + 1, F.col("w")))
    cases = [(n, "one" if a is None else "weeks" if n == "weeks" else "days", F.lit(1) if b is None else F.col("drawn")) for n, (a, b) in SCHEMES.items()] + [("point", "one", F.lit(1))]
    kinds = [F.struct(F.lit(n).alias("scheme"), F.lit(kind).alias("kind"), F.col(f"x_{k}").alias("x"), F.col(f"{of}_{k}").alias("y"), kp.alias("kp")) for n, k, kp in cases for kind, of in (("link", "y"), ("permuted", "other"))]
    long = paired.select("w", "stratum", F.explode(F.array(*kinds)).alias("z")).select("w", "stratum", "z.*").where("scheme <> 'point' or w = 0").dropna(subset=["x", "y"])
    r = long.groupBy("scheme", "w", "stratum", "kind").agg(F.count("*").alias("players"), F.sum("kp").alias("drawn"), _correlation().alias("r")).where("drawn > 0")
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    point = r.where("scheme = 'point'").groupBy("stratum").agg(pick("link", "r").alias("r"), pick("link", "players").alias("players"), pick("permuted", "r").alias("control"))
    cell = r.where("scheme <> 'point' and kind = 'link'").groupBy("stratum", "scheme").agg(F.count("r").alias("worlds"), F.percentile("r", F.lit(0.05)).alias("low"), F.percentile("r", F.lit(0.95)).alias("high"))
    few = (F.col("players") < LEAST_PLAYERS) | F.col("r").isNull()
    decision = F.when(few, "TOO_FEW").when(F.col("low") >= BAR, "AGREES").when(F.col("high") < BAR, "DISAGREES").otherwise("INCONCLUSIVE")
    return cell.join(point, "stratum").withColumn("decision", decision)


_ROUNDED = ("r", "control", "low", "high")


@query(CELLS + " SELECT stratum, scheme, players, worlds, " + ", ".join(f"round({c}, 5) + 0.0 AS {c}" for c in _ROUNDED) + ", decision FROM decided")
def agreement_cells(spark, sf_dir):
    return decided(spark, sf_dir).select("stratum", "scheme", "players", "worlds", *[(F.round(c, 5) + 0.0).alias(c) for c in _ROUNDED], "decision")


@query(
    CELLS + """ SELECT stratum, count(*) FILTER (WHERE decision = 'AGREES') AS agreeing, any_value(r) > any_value(control) AS control_holds,
  CASE WHEN bool_or(decision = 'TOO_FEW') THEN 'NOT_ADMITTED: too few players' WHEN NOT coalesce(any_value(r) > any_value(control), FALSE) THEN 'NOT_ADMITTED: control' WHEN bool_and(decision = 'AGREES') THEN 'ADMITTED' WHEN bool_or(decision = 'DISAGREES') THEN 'NOT_ADMITTED: disagrees' ELSE 'NOT_ADMITTED: inconclusive' END AS admission FROM decided GROUP BY stratum"""
)
def agreement_admission(spark, sf_dir):
    """A measure is admitted in a stratum if all schemes agree and linked players agree better than permuted ones."""
    d = decided(spark, sf_dir)
    holds = F.first("r") > F.first("control")
    has = lambda x: F.bool_or(F.col("decision") == x)
    word = F.when(has("TOO_FEW"), "NOT_ADMITTED: too few players").when(~F.coalesce(holds, F.lit(False)), "NOT_ADMITTED: control").when(F.bool_and(F.col("decision") == "AGREES"), "ADMITTED")
    word = word.when(has("DISAGREES"), "NOT_ADMITTED: disagrees").otherwise("NOT_ADMITTED: inconclusive")
    return d.groupBy("stratum").agg(F.count_if(F.col("decision") == "AGREES").alias("agreeing"), holds.alias("control_holds"), word.alias("admission"))
