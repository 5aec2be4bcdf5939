"""Reliability, ranks, residuals, resampling, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import gain, ratio
from ..operators import worlds as ws
from ..operators.ranks import average_ranks
from ..sources import neutral
from .registry import query

PM = neutral.SQL + """, pm AS (SELECT player_id, game_id, count(*) FILTER (WHERE type = 'pass' AND success) AS n, count(*) AS d,
  coalesce(sum(greatest(delta, 0.0)) FILTER (WHERE type = 'pass' AND success), 0.0) AS g FROM gained WHERE player_id <> 0 GROUP BY ALL)"""


def per_match(spark, sf_dir):
    """Numerators and denominators of each player-match: the partial aggregate that all resampling reuses."""
    a = neutral.actions(spark, sf_dir).where("player_id <> 0")
    done = (F.col("type") == "pass") & F.col("success")
    delta = F.greatest(gain(F.col("start_x"), F.col("end_x")), F.lit(0.0))
    return a.groupBy("player_id", "game_id").agg(F.count_if(done).alias("n"), F.count("*").alias("d"), F.coalesce(F.sum(F.when(done, delta)), F.lit(0.0)).alias("g"))


def pearson(x: str, y: str) -> F.Column:
    """From centred sums; a constant has no correlation and gives null."""
    spread = lambda a: F.var_pop(a) > 1e-12 * F.avg(F.col(a) * F.col(a))
    return F.when((F.count(x) >= 3) & spread(x) & spread(y), F.covar_pop(x, y) / F.sqrt(F.var_pop(x) * F.var_pop(y)))


def pearson_sql(x: str, y: str) -> str:
    spread = lambda a: f"var_pop({a}) > 1e-12 * avg({a} * {a})"
    return f"CASE WHEN count({x}) >= 3 AND {spread(x)} AND {spread(y)} THEN covar_pop({x}, {y}) / sqrt(var_pop({x}) * var_pop({y})) END"


@query(PM + f""", g AS (SELECT game_id, dense_rank() OVER (ORDER BY game_id) % 2 AS half FROM (SELECT DISTINCT game_id FROM pm)),
h AS (SELECT player_id, sum(n) FILTER (WHERE half = 0) / nullif(sum(d) FILTER (WHERE half = 0), 0) AS x, sum(n) FILTER (WHERE half = 1) / nullif(sum(d) FILTER (WHERE half = 1), 0) AS y FROM pm JOIN g USING (game_id) GROUP BY player_id),
k AS (SELECT * FROM h WHERE x IS NOT NULL AND y IS NOT NULL), r AS (SELECT count(*) AS players, {pearson_sql("x", "y")} AS r FROM k)
SELECT players, round(r, 6) AS half_r, round(2 * r / (1 + r), 6) AS reliability FROM r""")
def split_half_reliability(spark, sf_dir):
    """Halves by the parity of the match's rank; Spearman-Brown steps the half correlation up."""
    pm = per_match(spark, sf_dir)
    # Matches are days, a few for each season: their rank is taken over the match list, not over the actions.
    g = pm.select("game_id").distinct().withColumn("half", F.dense_rank().over(Window.orderBy("game_id")) % 2)
    s = pm.join(F.broadcast(g), "game_id").groupBy("player_id")
    h = s.agg(*[ratio(F.sum(F.when(F.col("half") == k, F.col("n"))), F.sum(F.when(F.col("half") == k, F.col("d")))).alias(c) for k, c in ((0, "x"), (1, "y"))]).dropna()
    r = h.agg(F.count("*").alias("players"), pearson("x", "y").alias("r"))
    return r.select("players", F.round("r", 6).alias("half_r"), F.round(2 * F.col("r") / (1 + F.col("r")), 6).alias("reliability"))


@query(PM + f""", t AS (SELECT player_id, CAST(sum(n) AS DOUBLE) AS passes, CAST(sum(d) AS DOUBLE) AS touches FROM pm GROUP BY player_id),
k AS (SELECT rank() OVER (ORDER BY passes) + (count(*) OVER (PARTITION BY passes) - 1) / 2.0 AS a, rank() OVER (ORDER BY touches) + (count(*) OVER (PARTITION BY touches) - 1) / 2.0 AS b FROM t)
SELECT round({pearson_sql("a", "b")}, 6) AS rho, count(*) AS players FROM k""")
def rank_correlation(spark, sf_dir):
    """Average ranks: row order does not matter under ties."""
    t = per_match(spark, sf_dir).groupBy("player_id").agg(F.sum("n").cast("double").alias("passes"), F.sum("d").cast("double").alias("touches"))
    k = average_ranks(average_ranks(t, "passes", "a"), "touches", "b")
    return k.agg(F.round(pearson("a", "b"), 6).alias("rho"), F.count("*").alias("players"))


@query(PM + """, t AS (SELECT player_id, sum(n) AS v FROM pm GROUP BY player_id), o AS (SELECT *, row_number() OVER (ORDER BY v DESC, player_id) AS r FROM t)
SELECT player_id, CAST(v AS BIGINT) AS v, (SELECT v FROM o WHERE r = 10) = (SELECT v FROM o WHERE r = 11) AS undefined FROM o WHERE r <= 10""")
def top_k_with_tie_refusal(spark, sf_dir):
    """A top ten whose last place is tied with the next one is undefined, and says so."""
    t = per_match(spark, sf_dir).groupBy("player_id").agg(F.sum("n").alias("v")).orderBy(F.desc("v"), "player_id").limit(11)
    t = t.withColumn("r", F.row_number().over(Window.orderBy(F.desc("v"), "player_id")))  # eleven rows
    edge = t.agg((F.max(F.when(F.col("r") == 10, F.col("v"))) == F.max(F.when(F.col("r") == 11, F.col("v")))).alias("undefined"))
    return t.where("r <= 10").join(F.broadcast(edge)).select("player_id", "v", "undefined")


WORLDS, SEED = 40, 20260831
WORLD_RATES = PM + ", " + ws.weights_sql("pm", WORLDS, SEED) + ", v AS (SELECT player_id, w, sum(g * k) / nullif(sum(d * k), 0) AS x FROM pm JOIN mw USING (game_id) GROUP BY ALL)"


def world_rates(spark, sf_dir) -> DataFrame:
    pm = per_match(spark, sf_dir)
    return ws.ratios(pm, ws.match_weights(pm, WORLDS, SEED), "player_id", "g", "d")


@query(WORLD_RATES + " SELECT player_id, count(x) AS worlds, round(quantile_cont(x, 0.05), 5) AS low, round(quantile_cont(x, 0.5), 5) AS mid, round(quantile_cont(x, 0.95), 5) AS high FROM v GROUP BY player_id")
def shared_match_bootstrap(spark, sf_dir):
    """Resampled matches are shared by all players of a world; a world without exposure is a hole, not a zero."""
    q = world_rates(spark, sf_dir).groupBy("player_id")
    return q.agg(F.count("x").alias("worlds"), *[F.round(F.percentile("x", F.lit(p)), 5).alias(c) for p, c in ((0.05, "low"), (0.5, "mid"), (0.95, "high"))])


@query(WORLD_RATES + """ SELECT a.player_id AS a, b.player_id AS b, count(*) AS worlds, round(avg(a.x - b.x), 6) + 0.0 AS mean, round(avg(CASE WHEN a.x > b.x THEN 1.0 ELSE 0.0 END), 6) AS share
FROM v a JOIN v b ON b.player_id = a.player_id + 1 AND a.w = b.w WHERE a.x IS NOT NULL AND b.x IS NOT NULL GROUP BY ALL HAVING count(*) >= 2""")
def paired_differences(spark, sf_dir):
    """Differences of two players world by world; both must be measured."""
    s = world_rates(spark, sf_dir).where("x is not null")
    a, b = s.toDF("a", "w", "xa"), s.toDF("b", "w", "xb")
    j = a.join(b, (F.col("b") == F.col("a") + 1) & (a["w"] == b["w"]))
    out = j.groupBy("a", "b").agg(F.count("*").alias("worlds"), (F.round(F.avg(F.col("xa") - F.col("xb")), 6) + 0.0).alias("mean"), F.round(F.avg((F.col("xa") > F.col("xb")).cast("double")), 6).alias("share"))
    return out.where("worlds >= 2")


@query(PM + """, t AS (SELECT p.player_id, p.position, CAST(sum(n) AS DOUBLE) AS y, CAST(sum(d) AS DOUBLE) AS x FROM pm JOIN players p USING (player_id) WHERE position IS NOT NULL GROUP BY ALL),
c AS (SELECT *, y - avg(y) OVER (PARTITION BY position) AS yc, x - avg(x) OVER (PARTITION BY position) AS xc FROM t), b AS (SELECT sum(xc * yc) / nullif(sum(xc * xc), 0) AS slope FROM c)
SELECT player_id, round(yc - slope * xc, 5) AS residual FROM c, b""")
def group_residuals(spark, sf_dir):
    """Least squares with one slope and a dummy for each group: demeaning within groups gives the same residuals."""
    acts = neutral.actions(spark, sf_dir)
    t = per_match(spark, sf_dir).groupBy("player_id").agg(F.sum("n").cast("double").alias("y"), F.sum("d").cast("double").alias("x"))
    t = t.join(neutral.players(acts).where("position is not null"), "player_id")
    means = t.groupBy("position").agg(F.avg("y").alias("my"), F.avg("x").alias("mx"))
    c = t.join(F.broadcast(means), "position").select("player_id", (F.col("y") - F.col("my")).alias("yc"), (F.col("x") - F.col("mx")).alias("xc"))
    b = c.agg(ratio(F.sum(F.col("xc") * F.col("yc")), F.sum(F.col("xc") * F.col("xc"))).alias("slope"))
    return c.join(F.broadcast(b)).select("player_id", F.round(F.col("yc") - F.col("slope") * F.col("xc"), 5).alias("residual"))


@query(PM + """, t AS (SELECT player_id, CAST(sum(n) AS DOUBLE) AS a, CAST(sum(d) AS DOUBLE) / 3 AS b FROM pm GROUP BY player_id)
SELECT count(*) AS n, round(2 * covar_pop(a, b) / (var_pop(a) + var_pop(b) + pow(avg(a) - avg(b), 2)), 6) AS concordance, round(avg(a - b), 6) AS bias, round(avg(a - b) - 1.96 * stddev_samp(a - b), 6) AS low, round(avg(a - b) + 1.96 * stddev_samp(a - b), 6) AS high FROM t""")
def agreement(spark, sf_dir):
    """Lin's concordance and limits of agreement of two measurements."""
    t = per_match(spark, sf_dir).groupBy("player_id").agg(F.sum("n").cast("double").alias("a"), (F.sum("d").cast("double") / 3).alias("b"))
    d = F.col("a") - F.col("b")
    bottom = F.var_pop("a") + F.var_pop("b") + F.pow(F.avg("a") - F.avg("b"), F.lit(2))
    return t.agg(F.count("*").alias("n"), F.round(2 * F.covar_pop("a", "b") / bottom, 6).alias("concordance"), F.round(F.avg(d), 6).alias("bias"), F.round(F.avg(d) - 1.96 * F.stddev_samp(d), 6).alias("low"), F.round(F.avg(d) + 1.96 * F.stddev_samp(d), 6).alias("high"))


def wilson(k: F.Column, n: F.Column, sign: int, z: float = 1.96) -> F.Column:
    p = k / n
    return (p + z * z / (2 * n) + sign * z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


@query(neutral.SQL + """, t AS (SELECT player_id, CAST(count(*) FILTER (WHERE success) AS DOUBLE) AS k, CAST(count(success) AS DOUBLE) AS n FROM actions WHERE type = 'pass' AND player_id <> 0 GROUP BY player_id HAVING count(success) > 0)
SELECT player_id, round((k/n + 1.96*1.96/(2*n) - 1.96 * sqrt(k/n * (1 - k/n) / n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n), 6) AS low, round((k/n + 1.96*1.96/(2*n) + 1.96 * sqrt(k/n * (1 - k/n) / n + 1.96*1.96/(4*n*n))) / (1 + 1.96*1.96/n), 6) AS high,
  round(k/n * n / (n + 20) + 0.8 * 20 / (n + 20), 6) AS shrunk FROM t""")
def completion_intervals(spark, sf_dir):
    """Wilson intervals, and the rate shrunk to a prior of 0.8 worth 20 passes."""
    t = neutral.actions(spark, sf_dir).where("type = 'pass' and player_id <> 0").groupBy("player_id").agg(F.count_if("success").cast("double").alias("k"), F.count("success").cast("double").alias("n")).where("n > 0")
    k, n = F.col("k"), F.col("n")
    return t.select("player_id", F.round(wilson(k, n, -1), 6).alias("low"), F.round(wilson(k, n, 1), 6).alias("high"), F.round(k / n * n / (n + 20) + 0.8 * 20 / (n + 20), 6).alias("shrunk"))
