"""Reliability, replication, resampled intervals, forecasts and their gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio
from ..operators import worlds as ws
from ..operators.ranks import average_ranks
from ..sources import neutral
from .matches import SIDES, _sides
from .players import gained
from .registry import query
from .statistics import PM, SEED, WORLDS, pearson, pearson_sql, per_match

HALVES = PM + """, gm AS (SELECT game_id, dense_rank() OVER (PARTITION BY game_id % 3 ORDER BY game_id) % 2 AS half, game_id % 3 AS league FROM (SELECT DISTINCT game_id FROM pm)),
hv AS (SELECT player_id, league, sum(d) AS d, sum(d) FILTER (WHERE half = 0) AS d0, sum(d) FILTER (WHERE half = 1) AS d1, sum(n) FILTER (WHERE half = 0) / nullif(sum(d) FILTER (WHERE half = 0), 0) AS x, sum(n) FILTER (WHERE half = 1) / nullif(sum(d) FILTER (WHERE half = 1), 0) AS y FROM pm JOIN gm USING (game_id) GROUP BY ALL)"""


def halves(spark, sf_dir) -> DataFrame:
    """A player's rate in each half of each league's matches, with the exposure of both."""
    pm = per_match(spark, sf_dir)
    league = F.col("game_id") % 3
    g = pm.select("game_id").distinct().withColumn("half", F.dense_rank().over(Window.partitionBy(league).orderBy("game_id")) % 2).withColumn("league", league)
    at = lambda h, c: F.sum(F.when(F.col("half") == h, F.col(c)))
    s = pm.join(F.broadcast(g), "game_id").groupBy("player_id", "league")
    return s.agg(F.sum("d").alias("d"), at(0, "d").alias("d0"), at(1, "d").alias("d1"), ratio(at(0, "n"), at(0, "d")).alias("x"), ratio(at(1, "n"), at(1, "d")).alias("y"))


def stepped_up(r: Column) -> Column:
    return 2 * r / (1 + r)


def grade(r: Column) -> Column:
    return F.when(r.isNull(), "unknown").when(r >= 0.7, "number").when(r >= 0.5, "band").otherwise("withheld")


_GRADE = "CASE WHEN {0} IS NULL THEN 'unknown' WHEN {0} >= 0.7 THEN 'number' WHEN {0} >= 0.5 THEN 'band' ELSE 'withheld' END"


@query(
    HALVES + f""", r AS (SELECT league, count(*) AS players, {pearson_sql('x', 'y')} AS r FROM hv WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY league), s AS (SELECT *, 2 * r / (1 + r) AS sb FROM r)
SELECT league, players, round(sb, 5) AS reliability, round(tanh(atanh(greatest(-0.999999, least(0.999999, sb))) - 1.6448536269514722 / sqrt(players - 3)), 5) AS low, round(tanh(atanh(greatest(-0.999999, least(0.999999, sb))) + 1.6448536269514722 / sqrt(players - 3)), 5) AS high,
  {_GRADE.format('sb')} AS grade, round(greatest(0.0, least(1.0, (sb - 0.5) / 0.2)), 5) AS weight FROM s WHERE players > 3"""
)
def reliability_intervals(spark, sf_dir):
    """Split-half reliability of each league with its Fisher interval at 0.90, a grade, and the weight it may carry."""
    r = halves(spark, sf_dir).dropna(subset=["x", "y"]).groupBy("league").agg(F.count("*").alias("players"), pearson("x", "y").alias("r")).where("players > 3")
    sb = stepped_up(F.col("r"))
    z, e = F.atanh(F.greatest(F.lit(-0.999999), F.least(F.lit(0.999999), F.col("sb")))), 1.6448536269514722 / F.sqrt(F.col("players") - 3)
    r = r.withColumn("sb", sb)
    return r.select("league", "players", F.round("sb", 5).alias("reliability"), F.round(F.tanh(z - e), 5).alias("low"), F.round(F.tanh(z + e), 5).alias("high"), grade(F.col("sb")).alias("grade"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("sb") - 0.5) / 0.2)), 5).alias("weight"))


@query(
    HALVES + f""", c AS (SELECT league, count(*) AS n, {pearson_sql('x', 'y')} AS r FROM hv WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY league), s AS (SELECT league, {_GRADE.format('2 * r / (1 + r)')} AS status FROM c)
SELECT status, count(*) AS leagues, CASE WHEN count(*) = sum(count(*)) OVER () THEN 'replicated' WHEN count(*) * 2 > sum(count(*)) OVER () THEN 'mostly' ELSE 'partial' END AS verdict FROM s GROUP BY status"""
)
def replication(spark, sf_dir):
    """How many leagues give a quantity each status, and what that makes of it."""
    c = halves(spark, sf_dir).dropna(subset=["x", "y"]).groupBy("league").agg(pearson("x", "y").alias("r")).select("league", grade(stepped_up(F.col("r"))).alias("status"))
    by, total = c.groupBy("status").agg(F.count("*").alias("leagues")), c.agg(F.count("*").alias("n"))
    return by.join(F.broadcast(total)).select("status", "leagues", F.when(F.col("leagues") == F.col("n"), "replicated").when(F.col("leagues") * 2 > F.col("n"), "mostly").otherwise("partial").alias("verdict"))


FLOORS = (2, 8, 20, 40)


@query(
    HALVES + f""", f AS (SELECT unnest([{', '.join(map(str, FLOORS))}]) AS floor), p AS (SELECT player_id, position FROM players),
k AS (SELECT floor, keepers, x, y FROM f, hv JOIN p USING (player_id), (SELECT unnest([TRUE, FALSE]) AS keepers) WHERE hv.d >= floor AND d0 * 3 >= floor AND d1 * 3 >= floor AND x IS NOT NULL AND y IS NOT NULL AND (keepers OR coalesce(position, '') <> 'GK'))
SELECT floor, keepers, count(*) AS players, round(2 * {pearson_sql('x', 'y')} / (1 + {pearson_sql('x', 'y')}), 5) AS reliability FROM k GROUP BY ALL"""
)
def reliability_curve(spark, sf_dir):
    """Pooled reliability by the floor of exposure, with and without goalkeepers; each half needs a third of the floor."""
    p = neutral.players(neutral.actions(spark, sf_dir)).select("player_id", "position")
    h = halves(spark, sf_dir).dropna(subset=["x", "y"]).join(p, "player_id").withColumn("floor", F.explode(F.array(*map(F.lit, FLOORS)))).withColumn("keepers", F.explode(F.array(F.lit(True), F.lit(False))))
    ok = (F.col("d") >= F.col("floor")) & (F.col("d0") * 3 >= F.col("floor")) & (F.col("d1") * 3 >= F.col("floor")) & (F.col("keepers") | (F.coalesce("position", F.lit("")) != "GK"))
    r = h.where(ok).groupBy("floor", "keepers").agg(F.count("*").alias("players"), pearson("x", "y").alias("r"))
    return r.select("floor", "keepers", "players", F.round(stepped_up(F.col("r")), 5).alias("reliability"))


LADDER = ((40, 0.72), (20, 0.66), (8, 0.55))


@query(PM + ", t AS (SELECT player_id, sum(d) AS d FROM pm GROUP BY player_id) SELECT player_id, CASE " + " ".join(f"WHEN d >= {a} THEN {b}::DOUBLE" for a, b in LADDER) + " END AS reliability FROM t")
def reliability_by_exposure(spark, sf_dir):
    """The step curve read at each player's own exposure; below its first step nothing is known."""
    d = F.col("d")
    step = F.when(d >= LADDER[0][0], LADDER[0][1])
    for a, b in LADDER[1:]:
        step = step.when(d >= a, b)
    return per_match(spark, sf_dir).groupBy("player_id").agg(F.sum("d").alias("d")).select("player_id", step.alias("reliability"))


TOTALS = PM + ", t AS (SELECT player_id, CAST(sum(n) AS DOUBLE) AS y, CAST(sum(d) AS DOUBLE) AS x FROM pm GROUP BY player_id)"


@query(
    TOTALS + f""", m AS (SELECT avg(x) AS mx, avg(y) AS my, covar_pop(x, y) / nullif(var_pop(x), 0) AS b, pow({pearson_sql('x', 'y')}, 2) AS r2 FROM t), e AS (SELECT t.*, y - my - b * (x - mx) AS res FROM t, m),
k AS (SELECT rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) + 1) / 2.0 - 1 AS a, rank() OVER (ORDER BY round(res, 9)) + (count(*) OVER (PARTITION BY round(res, 9)) + 1) / 2.0 - 1 AS c FROM e),
ty AS (SELECT player_id, y, row_number() OVER (ORDER BY y DESC, player_id) AS r FROM e), tr AS (SELECT player_id, round(res, 9) AS res, row_number() OVER (ORDER BY round(res, 9) DESC, player_id) AS r FROM e)
SELECT round((SELECT r2 FROM m), 5) AS explained, round((SELECT {pearson_sql('a', 'c')} FROM k), 5) AS rank_after,
  CASE WHEN (SELECT count(DISTINCT y) FROM ty WHERE r IN (5, 6)) < 2 OR (SELECT count(DISTINCT res) FROM tr WHERE r IN (5, 6)) < 2 THEN NULL ELSE (SELECT count(*) FROM ty JOIN tr USING (player_id) WHERE ty.r <= 5 AND tr.r <= 5) / 5.0 END AS survival"""
)
def discriminant_validity(spark, sf_dir):
    """What a confounder explains, and what of the order and of the top five is left without it; a tied top is undefined."""
    t = per_match(spark, sf_dir).groupBy("player_id").agg(F.sum("n").cast("double").alias("y"), F.sum("d").cast("double").alias("x"))
    m = t.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), ratio(F.covar_pop("x", "y"), F.var_pop("x")).alias("b"), F.pow(pearson("x", "y"), F.lit(2)).alias("r2"))
    e = t.join(F.broadcast(m)).withColumn("res", F.round(F.col("y") - F.col("my") - F.col("b") * (F.col("x") - F.col("mx")), 9))
    k = average_ranks(average_ranks(e.select("player_id", "y", "res"), "y", "a"), "res", "c").agg(pearson("a", "c").alias("rank_after"))

    def top(value: str) -> DataFrame:
        six = e.select("player_id", F.col(value).alias("v")).orderBy(F.desc("v"), "player_id").limit(6)
        return six.withColumn("r", F.row_number().over(Window.orderBy(F.desc("v"), "player_id")))  # six rows

    y, r = top("y"), top("res")
    edge = lambda d, name: d.agg((F.max(F.when(F.col("r") == 5, F.col("v"))) == F.max(F.when(F.col("r") == 6, F.col("v")))).alias(name))
    both = y.where("r <= 5").join(r.where("r <= 5").select("player_id"), "player_id").agg((F.count("*") / 5.0).alias("s"))
    one = m.select(F.round("r2", 5).alias("explained")).join(F.broadcast(k)).join(F.broadcast(both)).join(F.broadcast(edge(y, "ty"))).join(F.broadcast(edge(r, "tr")))
    return one.select("explained", F.round("rank_after", 5).alias("rank_after"), F.when(~(F.coalesce("ty", F.lit(True)) | F.coalesce("tr", F.lit(True))), F.col("s")).alias("survival"))


QUANTILES = (0.0, 0.05, 0.1, 0.25, 0.4, 0.5, 0.6, 0.75, 0.9, 0.95, 1.0)


@query(
    PM + ", " + ws.weights_sql("pm", WORLDS, SEED) + f""", s AS (SELECT player_id, w, sum(g * k) / nullif(sum(d * k), 0) AS x FROM pm JOIN mw USING (game_id) GROUP BY ALL), q AS (SELECT player_id, count(x) AS used, quantile_cont(x, [{', '.join(map(str, QUANTILES))}]) AS q FROM s GROUP BY player_id)
SELECT player_id, used, used < {WORLDS} * 0.9 AS degenerate, """ + ", ".join(f"round(q[{i + 1}], 5) AS q{int(100 * p)}" for i, p in enumerate(QUANTILES)) + " FROM q WHERE used > 0"
)
def player_intervals(spark, sf_dir):
    """Eleven quantiles of each player's rate over shared multinomial worlds; who is missing from a tenth of them is degenerate."""
    pm = per_match(spark, sf_dir)
    x = ws.ratios(pm, ws.match_weights(pm, WORLDS, SEED), "player_id", "g", "d")
    q = x.groupBy("player_id").agg(F.count("x").alias("used"), F.percentile("x", F.array(*map(F.lit, QUANTILES))).alias("q")).where("used > 0")
    return q.select("player_id", "used", (F.col("used") < WORLDS * 0.9).alias("degenerate"), *[F.round(F.col("q")[i], 5).alias(f"q{int(100 * p)}") for i, p in enumerate(QUANTILES)])


@query(
    PM + ", " + ws.weights_sql("pm", WORLDS, SEED) + f""", c AS (SELECT pm.player_id % 2 AS cluster, w, sum(n * k) / nullif(sum(d * k), 0) AS x FROM pm JOIN mw USING (game_id) GROUP BY ALL), b AS (SELECT w, max(x) FILTER (WHERE cluster = 0) - max(x) FILTER (WHERE cluster = 1) AS diff FROM c GROUP BY w)
SELECT count(diff) AS worlds, {WORLDS} - count(diff) AS holes, round(quantile_cont(diff, 0.05), 5) AS low, round(quantile_cont(diff, 0.95), 5) AS high, round((1 + count(*) FILTER (WHERE diff >= 0)) / (1.0 + count(diff)), 5) AS p FROM b"""
)
def cluster_difference(spark, sf_dir):
    """Two clubs' ratio in the same worlds: the interval of the difference, and how often it is not below zero."""
    pm = per_match(spark, sf_dir).withColumn("cluster", F.col("player_id") % 2)
    x = ws.ratios(pm, ws.match_weights(pm, WORLDS, SEED), "cluster", "n", "d")
    at = lambda c: F.max(F.when(F.col("cluster") == c, F.col("x")))
    b = x.groupBy("w").agg((at(0) - at(1)).alias("diff"))
    p = (1 + F.count_if(F.col("diff") >= 0)) / (1.0 + F.count("diff"))
    return b.agg(F.count("diff").alias("worlds"), (WORLDS - F.count("diff")).alias("holes"), F.round(F.percentile("diff", F.lit(0.05)), 5).alias("low"), F.round(F.percentile("diff", F.lit(0.95)), 5).alias("high"), F.round(p, 5).alias("p"))


@query(
    PM + f""", d AS (SELECT w, n, d, {ws.poisson_sql('game_id', 'w', SEED)} * {ws.poisson_sql('player_id', 'w', SEED + 1)} AS k FROM pm, (SELECT unnest(range({WORLDS})) AS w)), s AS (SELECT w, sum(n * k) / nullif(sum(d * k), 0) AS x FROM d GROUP BY w)
SELECT count(x) AS worlds, round(quantile_cont(x, 0.05), 5) AS low, round(quantile_cont(x, 0.5), 5) AS mid, round(quantile_cont(x, 0.95), 5) AS high FROM s"""
)
def two_way_interval(spark, sf_dir):
    """Matches and players resampled at once: a row's weight is the product of both, each from a hash where the row is."""
    k = ws.poisson_weight(F.col("game_id"), F.col("w"), SEED) * ws.poisson_weight(F.col("player_id"), F.col("w"), SEED + 1)
    x = ws.in_worlds(per_match(spark, sf_dir), WORLDS).withColumn("k", k).groupBy("w").agg(ratio(F.sum(F.col("n") * F.col("k")), F.sum(F.col("d") * F.col("k"))).alias("x"))
    return x.agg(F.count("x").alias("worlds"), *[F.round(F.percentile("x", F.lit(q)), 5).alias(c) for q, c in ((0.05, "low"), (0.5, "mid"), (0.95, "high"))])


KS = (1, 2, 4, 8, 16, 32)


@query(
    PM + f""", a AS (SELECT player_id, sum(n) FILTER (WHERE game_id < 15) AS n0, sum(d) FILTER (WHERE game_id < 15) AS d0, sum(n) FILTER (WHERE game_id >= 15) AS n1, sum(d) FILTER (WHERE game_id >= 15) AS d1 FROM pm GROUP BY player_id),
p AS (SELECT sum(n0) / sum(d0) AS prior FROM a), l AS (SELECT k, avg(pow((n0 + k * prior) / (d0 + k) - n1 / d1, 2)) AS loss FROM a, p, (SELECT unnest([{', '.join(map(str, KS))}]) AS k) WHERE d0 > 0 AND d1 > 0 GROUP BY k)
SELECT CAST(k AS INTEGER) AS k, round(loss, 6) AS loss, k = (SELECT max(k) FROM l WHERE loss <= (SELECT min(loss) FROM l) * 1.001) AS chosen FROM l"""
)
def chosen_shrinkage(spark, sf_dir):
    """Loss of each strength of shrinkage on later matches; of those that are as good as the best the largest is chosen."""
    before = F.col("game_id") < 15
    a = per_match(spark, sf_dir).groupBy("player_id").agg(*[F.sum(F.when(before, F.col(c))).alias(f"{c}0") for c in "nd"], *[F.sum(F.when(~before, F.col(c))).alias(f"{c}1") for c in "nd"])
    prior = a.agg((F.sum("n0") / F.sum("d0")).alias("prior"))
    k = F.col("k")
    l = a.where("d0 > 0 and d1 > 0").join(F.broadcast(prior)).withColumn("k", F.explode(F.array(*map(F.lit, KS))))  # noqa: E741
    l = l.groupBy("k").agg(F.avg(F.pow((F.col("n0") + k * F.col("prior")) / (F.col("d0") + k) - F.col("n1") / F.col("d1"), F.lit(2))).alias("loss"))  # noqa: E741
    least = l.agg(F.min("loss").alias("m"))
    best = l.join(F.broadcast(least)).where(F.col("loss") <= F.col("m") * 1.001).agg(F.max("k").alias("best"))
    return l.join(F.broadcast(best)).select("k", F.round("loss", 6).alias("loss"), (F.col("k") == F.col("best")).alias("chosen"))


PRIOR = SIDES + """, pr AS (SELECT team, game_id, gf, count(*) OVER w AS played, avg(gf) OVER w AS form, avg(ga) OVER w AS leak FROM s WINDOW w AS (PARTITION BY team ORDER BY game_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
fr AS (SELECT *, list_sort(list_filter([CASE WHEN played < 3 THEN 'few matches' END, CASE WHEN form = 0 THEN 'never scored' END, CASE WHEN game_id % 9 = 4 THEN 'match not valid' END], lambda x: x IS NOT NULL)) AS reasons FROM pr)"""


def forecast(spark, sf_dir) -> DataFrame:
    """Each team-match with its team's record strictly before it, and every reason not to use it."""
    w = Window.partitionBy("team").orderBy("game_id").rowsBetween(Window.unboundedPreceding, -1)
    pr = _sides(spark, sf_dir).select("team", "game_id", "gf", F.count("*").over(w).alias("played"), F.avg("gf").over(w).alias("form"), F.avg("ga").over(w).alias("leak"))
    why = F.array(F.when(F.col("played") < 3, "few matches"), F.when(F.col("form") == 0, "never scored"), F.when(F.col("game_id") % 9 == 4, "match not valid"))
    return pr.withColumn("reasons", F.array_sort(F.filter(why, lambda x: x.isNotNull())))


@query(neutral.SQL + PRIOR + " SELECT team, game_id, played, round(form, 6) AS form, array_to_string(reasons, '; ') AS reasons FROM fr")
def forecast_rows(spark, sf_dir):
    return forecast(spark, sf_dir).select("team", "game_id", "played", F.round("form", 6).alias("form"), F.concat_ws("; ", "reasons").alias("reasons"))


@query(
    neutral.SQL + PRIOR + """, u AS (SELECT *, game_id < 18 AS train FROM fr WHERE len(reasons) = 0), m AS (SELECT avg(form) AS mx, avg(gf) AS my, coalesce(covar_pop(form, gf) / nullif(var_pop(form), 0), 0) AS b FROM u WHERE train),
e AS (SELECT game_id // 7 AS week, gf, greatest(0.0, my + b * (form - mx)) AS linear, my AS mean FROM u, m WHERE NOT train)
SELECT week, count(*) AS n, round(avg(pow(gf - linear, 2)), 6) AS mse_linear, round(avg(pow(gf - mean, 2)), 6) AS mse_mean, round(avg(abs(gf - linear)), 6) AS mae_linear, round(avg(pow(gf - linear, 2) - pow(gf - mean, 2)), 6) + 0.0 AS gain FROM e GROUP BY week"""
)
def forecast_errors(spark, sf_dir):
    """A line fitted on earlier matches, held against their mean on later ones, week by week."""
    u = forecast(spark, sf_dir).where("size(reasons) = 0")
    m = u.where("game_id < 18").agg(F.avg("form").alias("mx"), F.avg("gf").alias("my"), F.coalesce(ratio(F.covar_pop("form", "gf"), F.var_pop("form")), F.lit(0.0)).alias("b"))
    e = u.where("game_id >= 18").join(F.broadcast(m)).select(F.floor(F.col("game_id") / 7).alias("week"), "gf", F.greatest(F.lit(0.0), F.col("my") + F.col("b") * (F.col("form") - F.col("mx"))).alias("linear"), "my")
    sq = lambda c: F.pow(F.col("gf") - F.col(c), F.lit(2))
    return e.groupBy("week").agg(F.count("*").alias("n"), F.round(F.avg(sq("linear")), 6).alias("mse_linear"), F.round(F.avg(sq("my")), 6).alias("mse_mean"), F.round(F.avg(F.abs(F.col("gf") - F.col("linear"))), 6).alias("mae_linear"), (F.round(F.avg(sq("linear") - sq("my")), 6) + 0.0).alias("gain"))


@query(
    neutral.SQL + PRIOR + """, c AS (SELECT *, floor(least(3, form)) AS bin FROM fr WHERE len(reasons) = 0) SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, count(*) >= 5 AS enough, round(avg(form), 6) AS predicted, round(avg(gf), 6) AS observed,
  round(coalesce(covar_pop(form, gf) / nullif(var_pop(form), 0), 0), 5) + 0.0 AS slope FROM c GROUP BY bin"""
)
def calibration(spark, sf_dir):
    """Predicted against observed in bins of the prediction, with the slope inside each and the gate on its size."""
    c = forecast(spark, sf_dir).where("size(reasons) = 0").withColumn("bin", F.floor(F.least(F.lit(3.0), F.col("form"))))
    slope = F.coalesce(ratio(F.covar_pop("form", "gf"), F.var_pop("form")), F.lit(0.0))
    return c.groupBy("bin").agg(F.count("*").alias("n"), (F.count("*") >= 5).alias("enough"), F.round(F.avg("form"), 6).alias("predicted"), F.round(F.avg("gf"), 6).alias("observed"), (F.round(slope, 5) + 0.0).alias("slope"))


@query(
    neutral.SQL + PRIOR + """, a AS (SELECT x.team, x.game_id, x.gf, x.form AS own, y.leak AS other, avg(x.gf) OVER (PARTITION BY x.game_id % 2) AS flat FROM fr x JOIN fr y ON x.game_id = y.game_id AND x.team <> y.team WHERE len(x.reasons) = 0 AND len(y.reasons) = 0),
d AS (SELECT game_id // 10 AS block, own, other, (own + other) / 2 AS mix, gf FROM a) SELECT block, count(*) AS n, round(avg(own - gf * ln(greatest(own, 0.05))), 6) AS own, round(avg(other - gf * ln(greatest(other, 0.05))), 6) AS other, round(avg(mix - gf * ln(greatest(mix, 0.05))), 6) AS mix FROM d GROUP BY block"""
)
def walk_forward_loss(spark, sf_dir):
    """Poisson loss of three predictors known before each match: the team's form, what the opponent lets in, and their mean."""
    f = forecast(spark, sf_dir).where("size(reasons) = 0")
    other = f.select("game_id", F.col("team").alias("against"), F.col("leak").alias("other"))
    d = f.join(other, "game_id").where("team <> against").withColumn("own", F.col("form")).withColumn("mix", (F.col("own") + F.col("other")) / 2)
    loss = lambda c: F.round(F.avg(F.col(c) - F.col("gf") * F.log(F.greatest(F.col(c), F.lit(0.05)))), 6).alias(c)
    return d.groupBy(F.floor(F.col("game_id") / 10).alias("block")).agg(F.count("*").alias("n"), loss("own"), loss("other"), loss("mix"))


@query(
    neutral.SQL + f""", v AS (SELECT player_id, position, CAST(count(*) AS DOUBLE) AS touches, CAST(count(*) FILTER (WHERE type = 'shot') AS DOUBLE) AS shots, CAST(count(*) FILTER (WHERE type = 'pass') AS DOUBLE) AS passes FROM actions JOIN players USING (player_id) WHERE position IS NOT NULL GROUP BY ALL)
SELECT position, count(*) AS players, round({pearson_sql('touches', 'shots')}, 5) AS touches_shots, round({pearson_sql('touches', 'passes')}, 5) AS touches_passes, round({pearson_sql('shots', 'passes')}, 5) AS shots_passes FROM v GROUP BY position"""
)
def correlation_battery(spark, sf_dir):
    """How a match's counts go together inside each position; a constant or two players have no correlation."""
    a = neutral.actions(spark, sf_dir)
    v = a.where("player_id <> 0").groupBy("player_id").agg(F.count("*").cast("double").alias("touches"), F.count_if(F.col("type") == "shot").cast("double").alias("shots"), F.count_if(F.col("type") == "pass").cast("double").alias("passes"))
    v = v.join(neutral.players(a).where("position is not null").select("player_id", "position"), "player_id")
    pairs = (("touches", "shots"), ("touches", "passes"), ("shots", "passes"))
    return v.groupBy("position").agg(F.count("*").alias("players"), *[F.round(pearson(x, y), 5).alias(f"{x}_{y}") for x, y in pairs])


@query(neutral.SQL + """, v AS (SELECT player_id, position, CAST(count(*) AS DOUBLE) AS touches FROM actions JOIN players USING (player_id) WHERE position IS NOT NULL GROUP BY ALL)
SELECT player_id, round((touches - avg(touches) OVER w) / nullif(stddev_samp(touches) OVER w, 0), 6) AS z FROM v WINDOW w AS (PARTITION BY position)""")
def role_scores(spark, sf_dir):
    """Standard scores inside the position; moments are aggregated and joined, so a position is never one task."""
    a = neutral.actions(spark, sf_dir)
    v = a.where("player_id <> 0").groupBy("player_id").agg(F.count("*").cast("double").alias("t")).join(neutral.players(a).where("position is not null").select("player_id", "position"), "player_id")
    m = v.groupBy("position").agg(F.avg("t").alias("m"), F.stddev_samp("t").alias("s"))
    return v.join(F.broadcast(m), "position").select("player_id", F.round(ratio(F.col("t") - F.col("m"), F.col("s")), 6).alias("z"))


@query(neutral.SQL + """, m AS (SELECT player_id, type AS role, count(*) AS n FROM actions WHERE player_id <> 0 GROUP BY ALL), s AS (SELECT *, n / sum(n) OVER (PARTITION BY player_id) AS p, row_number() OVER (PARTITION BY player_id ORDER BY n DESC, role) AS r, lead(n, 1, 0) OVER (PARTITION BY player_id ORDER BY n DESC, role) AS nxt, sum(n) OVER (PARTITION BY player_id) AS t FROM m)
SELECT player_id, role, round(p, 6) AS share, p < 0.5 OR (n - nxt) / t < 0.1 AS ambiguous FROM s WHERE r = 1""")
def role_distributions(spark, sf_dir):
    """Shares of roles as a normalised map; the largest names the role unless it is below half or hardly ahead."""
    m = neutral.actions(spark, sf_dir).where("player_id <> 0").groupBy("player_id", "type").count()
    d = m.groupBy("player_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "count"))).alias("m"))
    total = F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, b: a + b)
    ranked = F.array_sort(F.transform(F.map_entries("m"), lambda e: F.struct((-e.value).alias("n"), e.key.alias("role"))))
    d = d.select("player_id", ranked.alias("r"), total.alias("t"))
    n, nxt = -F.col("r")[0].n, F.coalesce(-F.try_element_at("r", F.lit(2)).n, F.lit(0))
    return d.select("player_id", F.col("r")[0].role.alias("role"), F.round(n / F.col("t"), 6).alias("share"), ((n / F.col("t") < 0.5) | ((n - nxt) / F.col("t") < 0.1)).alias("ambiguous"))


@query("SELECT status, tier, executed, CASE WHEN NOT executed THEN 'not run' WHEN status = 'passed' AND tier = 'confirmatory' THEN 'admissible' WHEN status = 'passed' THEN 'exploratory' ELSE 'rejected' END AS verdict, executed AND status = 'passed' AND tier = 'confirmatory' AS may_gate FROM (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'passed' WHEN 'O' THEN 'failed' ELSE 'withdrawn' END AS status, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'confirmatory' ELSE 'exploratory' END AS tier, o_orderkey % 4 <> 1 AS executed FROM orders)")
def verdicts(spark, sf_dir):
    """What an experiment's status, tier and execution allow; only an executed confirmatory pass may gate anything."""
    s, p = F.col("o_orderstatus"), F.col("o_orderpriority")
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.when(s == "F", "passed").when(s == "O", "failed").otherwise("withdrawn").alias("status"), F.when(p.isin("1-URGENT", "2-HIGH"), "confirmatory").otherwise("exploratory").alias("tier"), (F.col("o_orderkey") % 4 != 1).alias("executed")).distinct()
    gate = F.col("executed") & (F.col("status") == "passed") & (F.col("tier") == "confirmatory")
    verdict = F.when(~F.col("executed"), "not run").when(gate, "admissible").when(F.col("status") == "passed", "exploratory").otherwise("rejected")
    return o.select("status", "tier", "executed", verdict.alias("verdict"), gate.alias("may_gate"))


_V1 = "count(*) FILTER (WHERE type = 'pass' AND success) AS done, count(*) FILTER (WHERE type IN ('pass', 'touch')) AS kept_of, count(*) FILTER (WHERE type IN ('pass', 'touch') AND coalesce(success, FALSE) AND NOT dangerous_loss) AS kept, sum(end_x - start_x) FILTER (WHERE type = 'pass' AND success) AS fwd, sum(sqrt(pow(end_x - start_x, 2) + pow(end_y - start_y, 2))) FILTER (WHERE type = 'pass' AND success) AS dist"


@query(neutral.SQL + f", v AS (SELECT player_id, {_V1} FROM actions WHERE player_id <> 0 GROUP BY player_id) SELECT player_id, round(kept / nullif(kept_of, 0), 6) AS retention, round(fwd / nullif(dist, 0), 6) AS verticality FROM v")
def first_axes(spark, sf_dir):
    """The superseded axes, kept for replication: how much of the ball is kept, and how much of the passing goes forward."""
    a = gained(spark, sf_dir).where("player_id <> 0")
    done, ball = (F.col("type") == "pass") & F.col("success"), F.col("type").isin("pass", "touch")
    length = F.sqrt(F.pow(F.col("end_x") - F.col("start_x"), F.lit(2)) + F.pow(F.col("end_y") - F.col("start_y"), F.lit(2)))
    v = a.groupBy("player_id").agg(F.count_if(ball).alias("of"), F.count_if(ball & F.coalesce("success", F.lit(False)) & ~F.col("dangerous_loss")).alias("kept"), F.sum(F.when(done, F.col("end_x") - F.col("start_x"))).alias("fwd"), F.sum(F.when(done, length)).alias("dist"))
    return v.select("player_id", F.round(ratio(F.col("kept"), F.col("of")), 6).alias("retention"), F.round(ratio(F.col("fwd"), F.col("dist")), 6).alias("verticality"))


SNAP = PM + """, b AS (SELECT player_id, sum(n) AS n FROM pm WHERE game_id < 20 GROUP BY player_id), mi AS (SELECT player_id, sum(minutes) AS minutes FROM lineups WHERE game_id < 20 GROUP BY player_id),
ra AS (SELECT player_id, n * 90.0 / minutes AS rate FROM b JOIN mi USING (player_id)), xi AS (SELECT game_id, team_id, sum(rate) AS total, count(*) AS starters FROM lineups JOIN ra USING (player_id) WHERE started AND game_id < 20 GROUP BY ALL)"""


def starters(spark, sf_dir) -> DataFrame:
    """Summed prior rates of the starters of each team-match before the cutoff day."""
    a = neutral.actions(spark, sf_dir)
    minutes = neutral.lineups(a).where("game_id < 20")
    rate = per_match(spark, sf_dir).where("game_id < 20").groupBy("player_id").agg(F.sum("n").alias("n")).join(minutes.groupBy("player_id").agg(F.sum("minutes").alias("m")), "player_id").select("player_id", (F.col("n") * 90.0 / F.col("m")).alias("rate"))
    return minutes.where("started").join(rate, "player_id").groupBy("game_id", "team_id").agg(F.sum("rate").alias("total"), F.count("*").alias("starters"))


@query(SNAP + " SELECT team_id, count(*) AS matches, round(median(total), 5) AS minimum FROM xi GROUP BY team_id")
def club_snapshot(spark, sf_dir):
    """A club's requirement: the median of what its own starting line-ups summed to before the cutoff day."""
    return starters(spark, sf_dir).groupBy("team_id").agg(F.count("*").alias("matches"), F.round(F.median("total"), 5).alias("minimum"))


@query(SNAP + """, q AS (SELECT unnest([25, 50, 75]) AS p, unnest(quantile_disc(total, [0.25, 0.5, 0.75])) AS v FROM xi) SELECT team_id, CAST(p AS INTEGER) AS percent, count(*) AS matches, count(*) FILTER (WHERE round(total, 9) >= round(v, 9)) AS attained FROM xi, q GROUP BY ALL""")
def attained_percentiles(spark, sf_dir):
    """How often each club's line-ups reach a declared percentile of the league's."""
    from ..operators.ranks import order_statistics

    xi = starters(spark, sf_dir).withColumn("total", F.round("total", 9))
    q = order_statistics(xi, "total", (25, 50, 75)).toDF("percent", "v")
    return xi.join(F.broadcast(q)).groupBy("team_id", "percent").agg(F.count("*").alias("matches"), F.count_if(F.col("total") >= F.col("v")).alias("attained"))
