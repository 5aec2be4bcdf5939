"""Per-player queries: constructs, gates, percentiles, baselines, lanes, exploration, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import channel, gain, located, ratio, strictly_below, third
from ..operators.constructs import components, rates
from ..operators.ranks import order_statistics
from ..operators.surface import fit_surface, surface_frame, with_delta
from ..sources import neutral
from .registry import query

FLOOR = 90  #: minutes below which a value is withheld


def gained(spark, sf_dir) -> DataFrame:
    return neutral.actions(spark, sf_dir).withColumn("delta", gain(F.col("start_x"), F.col("end_x")))


def total_minutes(acts: DataFrame) -> DataFrame:
    return neutral.lineups(acts).groupBy("player_id").agg(F.sum("minutes").alias("minutes"))


MINUTES = ", mins AS (SELECT player_id, CAST(sum(minutes) AS BIGINT) AS minutes FROM lineups GROUP BY player_id)"
LANE = "CASE WHEN start_y < 0.21 OR start_y > 0.79 THEN 'wide' WHEN start_y BETWEEN 0.21 AND 0.37 OR start_y BETWEEN 0.63 AND 0.79 THEN 'half_space' ELSE 'centre' END"
RATES = f"""{MINUTES}, parts AS (
  SELECT player_id, coalesce(sum(greatest(delta, 0.0)) FILTER (WHERE type = 'pass' AND success), 0.0) AS progression_n,
    coalesce(sum(delta) FILTER (WHERE type = 'pass' AND success AND key_pass), 0.0) AS chance_n,
    CAST(count(*) FILTER (WHERE type = 'pass' AND success) AS DOUBLE) AS passes,
    CAST(count(*) FILTER (WHERE type = 'pass' AND success AND {LANE} = 'half_space') AS DOUBLE) AS half_n,
    CAST(count(*) FILTER (WHERE type = 'pass' AND success AND {LANE} = 'wide') AS DOUBLE) AS wide_n FROM gained GROUP BY player_id
), rates AS (
  SELECT m.player_id, m.minutes, round(progression_n * 90.0 / nullif(minutes, 0), 6) AS progression, round(progression_n / nullif(passes, 0), 6) AS progression_per_action,
    round(chance_n * 90.0 / nullif(minutes, 0), 6) AS chance_creation, round(half_n / nullif(passes, 0), 6) AS half_space_share, round(wide_n / nullif(passes, 0), 6) AS width
  FROM mins m LEFT JOIN parts p ON p.player_id = m.player_id
)"""
NAMES = ("progression", "progression_per_action", "chance_creation", "half_space_share", "width")


def construct_rates(spark, sf_dir) -> DataFrame:
    acts = gained(spark, sf_dir)
    out = rates(components(acts), total_minutes(acts))
    return out.select("player_id", "minutes", *[F.round(c, 6).alias(c) for c in NAMES])


@query(neutral.SQL + RATES + " SELECT * FROM rates")
def constructs_per_player(spark, sf_dir):
    """All five constructs of every player with minutes, in one grouped aggregate."""
    return construct_rates(spark, sf_dir)


@query(
    neutral.SQL + RATES + f""" SELECT r.player_id, position, minutes, minutes < {FLOOR} AS below_floor,
  CASE WHEN position IS NULL OR position = 'GK' OR minutes < {FLOOR} THEN NULL ELSE progression END AS progression,
  CASE WHEN position IS NULL OR position = 'GK' OR minutes < {FLOOR} OR progression IS NULL THEN NULL ELSE
    round((rank() OVER (PARTITION BY position, (position IS NULL OR position = 'GK' OR minutes < {FLOOR} OR progression IS NULL) ORDER BY progression) - 1) * 100.0
      / count(*) OVER (PARTITION BY position, (position IS NULL OR position = 'GK' OR minutes < {FLOOR} OR progression IS NULL)), 6) END AS percentile
FROM rates r JOIN players p ON p.player_id = r.player_id"""
)
def profile_table(spark, sf_dir):
    """Served profiles: values withheld below the minutes floor and outside their context, percentiles strictly below."""
    acts = neutral.actions(spark, sf_dir)
    r = construct_rates(spark, sf_dir).join(neutral.players(acts), "player_id")
    gate = F.col("position").isNull() | (F.col("position") == "GK") | (F.col("minutes") < FLOOR)
    r = r.withColumn("progression", F.when(~gate, F.col("progression")))
    return r.select("player_id", "position", "minutes", (F.col("minutes") < FLOOR).alias("below_floor"), "progression", F.round(strictly_below("progression", "position"), 6).alias("percentile"))


@query(
    neutral.SQL + """ SELECT player_id, count(*) AS touches, round(count(*) FILTER (WHERE type = 'pass' AND success) / nullif(count(*) FILTER (WHERE type = 'pass' AND success IS NOT NULL), 0), 6) AS completion,
  round(avg(start_x), 10) AS mean_x, round(avg(start_y), 10) AS mean_y, round(avg(sqrt((end_x - start_x) * (end_x - start_x) + (end_y - start_y) * (end_y - start_y))) FILTER (WHERE type = 'pass'), 6) AS mean_length,
  count(*) FILTER (WHERE type = 'shot') AS shots FROM actions WHERE player_id <> 0 GROUP BY player_id"""
)
def baselines(spark, sf_dir):
    a = neutral.actions(spark, sf_dir).where("player_id <> 0")
    passes = F.col("type") == "pass"
    dx, dy = F.col("end_x") - F.col("start_x"), F.col("end_y") - F.col("start_y")
    return a.groupBy("player_id").agg(
        F.count("*").alias("touches"),
        F.round(ratio(F.count_if(passes & F.col("success")), F.count_if(passes & F.col("success").isNotNull())), 6).alias("completion"),
        F.round(F.avg("start_x"), 10).alias("mean_x"), F.round(F.avg("start_y"), 10).alias("mean_y"),
        F.round(F.avg(F.when(passes, F.sqrt(dx * dx + dy * dy))), 6).alias("mean_length"), F.count_if(F.col("type") == "shot").alias("shots"),
    )


@query(
    neutral.SQL + f""" SELECT player_id, {LANE} AS lane, CASE WHEN start_x < 1/3 THEN 'own' WHEN start_x < 2/3 THEN 'middle' ELSE 'final' END AS third, count(*) AS n
FROM actions WHERE type = 'pass' AND success AND player_id <> 0 GROUP BY ALL"""
)
def zone_shares(spark, sf_dir):
    a = neutral.actions(spark, sf_dir).where("type = 'pass' and success and player_id <> 0")
    return a.groupBy("player_id", channel(F.col("start_y")).alias("lane"), third(F.col("start_x")).alias("third")).agg(F.count("*").alias("n"))


@query(
    neutral.SQL + """ SELECT type, count(*) AS n, count(*) FILTER (WHERE success) AS done, count(*) FILTER (WHERE success IS NULL) AS unjudged,
  count(*) FILTER (WHERE NOT coalesce(success, false)) AS not_done, count(*) FILTER (WHERE start_x BETWEEN 0 AND 1 AND start_y BETWEEN 0 AND 1 AND NOT (start_x = 0 AND start_y = 0) AND NOT (start_x = 1 AND start_y = 1)) AS located
FROM actions GROUP BY type"""
)
def action_filters(spark, sf_dir):
    """Three-valued success and located points: the negation keeps what nobody judged."""
    a = neutral.actions(spark, sf_dir)
    return a.groupBy("type").agg(
        F.count("*").alias("n"), F.count_if("success").alias("done"), F.count_if(F.col("success").isNull()).alias("unjudged"),
        F.count_if(~F.coalesce("success", F.lit(False))).alias("not_done"), F.count_if(located(F.col("start_x"), F.col("start_y"))).alias("located"),
    )


@query(neutral.SQL + RATES + ", f AS (SELECT *, abs(width - 0.42) AS distance FROM rates WHERE width IS NOT NULL) SELECT player_id, width, round(distance, 6) AS distance, min(width) OVER () AS low, max(width) OVER () AS high FROM f QUALIFY row_number() OVER (ORDER BY round(distance, 6) DESC, player_id) <= 20")
def explore_style(spark, sf_dir):
    """A style construct ordered by its distance from the pitch-area reference, not by size; the range is over all rows."""
    r = construct_rates(spark, sf_dir).where("width is not null").withColumn("distance", F.round(F.abs(F.col("width") - 0.42), 6))
    span = r.agg(F.min("width").alias("low"), F.max("width").alias("high"))
    return r.orderBy(F.desc("distance"), "player_id").limit(20).join(F.broadcast(span)).select("player_id", "width", "distance", "low", "high")


@query(neutral.SQL + RATES + """, pairs AS (SELECT a.player_id AS a, b.player_id AS b, a.progression - b.progression AS diff, a.width - b.width AS style_diff
  FROM rates a JOIN rates b ON b.player_id = a.player_id + 1)
SELECT a, b, round(diff, 6) AS diff, CASE WHEN diff IS NULL THEN 'not comparable' WHEN abs(diff) < 0.05 THEN 'tie' WHEN diff > 0 THEN 'first' ELSE 'second' END AS leader, round(style_diff, 6) AS style_diff FROM pairs""")
def compare_neighbours(spark, sf_dir):
    """Comparison of players with neighbouring ids: a leader on quality only, never on style."""
    r = construct_rates(spark, sf_dir)
    a, b = r.select(F.col("player_id").alias("a"), F.col("progression").alias("pa"), F.col("width").alias("wa")), r.select(F.col("player_id").alias("b"), F.col("progression").alias("pb"), F.col("width").alias("wb"))
    d = F.col("pa") - F.col("pb")
    leader = F.when(d.isNull(), "not comparable").when(F.abs(d) < 0.05, "tie").when(d > 0, "first").otherwise("second")
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(d, 6).alias("diff"), leader.alias("leader"), F.round(F.col("wa") - F.col("wb"), 6).alias("style_diff"))


def construct_rates_declared(spark, sf_dir) -> DataFrame:
    """Constructs on the declared surface, with each player's minutes and position."""
    acts = gained(spark, sf_dir)
    return rates(components(acts), total_minutes(acts)).join(neutral.players(acts).select("player_id", "position"), "player_id")


_CELL = "CAST(least(11, floor({1} * 12)) AS INTEGER) * 16 + CAST(least(15, floor({0} * 16)) AS INTEGER)"
#: The fixed point by a recursive query, far beyond where it stands still.
SURFACE = neutral.SQL.replace("WITH ev", "WITH RECURSIVE ev", 1) + f""", sr AS (SELECT {_CELL.format('start_x', 'start_y')} AS c, {_CELL.format('end_x', 'end_y')} AS e, type IN ('pass', 'touch') AND coalesce(success, FALSE) AND NOT dangerous_loss AS m, type = 'shot' AS s, goal AS g,
  (type = 'pass' AND coalesce(NOT success, FALSE)) OR dangerous_loss AS l FROM actions),
sc AS (SELECT c, count(*) FILTER (WHERE m) AS m, count(*) FILTER (WHERE s) AS s, count(*) FILTER (WHERE g) AS g, greatest(1, count(*) FILTER (WHERE m) + count(*) FILTER (WHERE s) + count(*) FILTER (WHERE l)) AS t FROM sr GROUP BY c),
sm AS (SELECT c, e, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY c) AS p FROM sr WHERE m GROUP BY c, e),
cells AS (SELECT CAST(unnest(range(192)) AS INTEGER) AS c), par AS (SELECT cells.c, coalesce(s / t * g / greatest(s, 1), 0) AS score, coalesce(m / t, 0) AS move FROM cells LEFT JOIN sc USING (c)),
it AS (SELECT 0 AS k, c, 0.0::DOUBLE AS v FROM par UNION ALL SELECT k + 1, c, score + move * coalesce((SELECT sum(p * it.v) FROM sm JOIN it ON it.c = sm.e WHERE sm.c = par.c), 0) FROM par, (SELECT DISTINCT k FROM it) WHERE k < 120),
surface AS (SELECT c, v FROM it WHERE k = 120)"""


@query(SURFACE + " SELECT c AS cell, round(v, 4) AS value FROM surface")
def value_surface(spark, sf_dir):
    """The fitted surface, one row a cell."""
    return surface_frame(spark, fit_surface(neutral.actions(spark, sf_dir))).withColumn("value", F.round("value", 4))


@query(SURFACE + f"""{MINUTES}, d AS (SELECT a.player_id, y.v - x.v AS delta FROM actions a JOIN surface x ON x.c = {_CELL.format('a.start_x', 'a.start_y')} JOIN surface y ON y.c = {_CELL.format('a.end_x', 'a.end_y')} WHERE type = 'pass' AND success)
SELECT m.player_id, m.minutes, round(coalesce(sum(greatest(delta, 0.0)), 0.0) * 90 / m.minutes, 3) AS progression, round(sum(greatest(delta, 0.0)) / nullif(count(delta), 0), 3) AS progression_per_action FROM mins m LEFT JOIN d USING (player_id) GROUP BY m.player_id, m.minutes""")
def fitted_progression(spark, sf_dir):
    """Progression on the fitted surface, which is joined by broadcast."""
    acts = neutral.actions(spark, sf_dir)
    r = rates(components(with_delta(acts, surface_frame(spark, fit_surface(acts)))), total_minutes(acts))
    return r.select("player_id", "minutes", *[F.round(c, 3).alias(c) for c in ("progression", "progression_per_action")])


@query(neutral.SQL + """, l AS (SELECT *, row_number() OVER (PARTITION BY player_id ORDER BY game_id DESC, team_id) AS r FROM lineups)
SELECT player_id, max(team_id) FILTER (WHERE r = 1) AS club, CAST(coalesce(sum(minutes) FILTER (WHERE team_id = lt), 0) AS BIGINT) AS club_minutes, count(DISTINCT team_id) AS clubs
FROM (SELECT l.*, first_value(team_id) OVER (PARTITION BY player_id ORDER BY game_id DESC, team_id) AS lt FROM l) GROUP BY player_id""")
def current_stints(spark, sf_dir):
    """The latest club of each player, and the minutes for that club only."""
    by_club = neutral.lineups(neutral.actions(spark, sf_dir)).groupBy("player_id", "team_id").agg(F.sum("minutes").alias("m"), F.max(F.struct("game_id", -F.col("team_id"))).alias("last"))
    return by_club.groupBy("player_id").agg(F.max_by("team_id", "last").alias("club"), F.max_by("m", "last").alias("club_minutes"), F.count("*").alias("clubs"))


@query(neutral.SQL + f"""{MINUTES}, pool AS (SELECT p.player_id, CASE WHEN position IS NULL THEN 'no position' WHEN position = 'GK' THEN 'keeper' WHEN minutes < 90 THEN 'few minutes' ELSE 'kept' END AS reason
  FROM players p LEFT JOIN mins m ON m.player_id = p.player_id) SELECT reason, count(*) AS n FROM pool GROUP BY reason""")
def universe_reasons(spark, sf_dir):
    """Every candidate has exactly one reason; the first that holds counts."""
    acts = neutral.actions(spark, sf_dir)
    p = neutral.players(acts).join(total_minutes(acts), "player_id", "left")
    reason = F.when(F.col("position").isNull(), "no position").when(F.col("position") == "GK", "keeper").when(F.col("minutes") < 90, "few minutes").otherwise("kept")
    return p.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(neutral.SQL + ", prior AS (SELECT * FROM actions WHERE CAST(ts AS DATE) < DATE '2024-01-16') SELECT player_id, count(*) AS n, max(game_id) AS last_game FROM prior GROUP BY player_id")
def prior_day_snapshot(spark, sf_dir):
    """Strictly before the cutoff day; the filter reaches the scan."""
    acts = neutral.actions(spark, sf_dir).where(F.to_date("ts") < F.lit("2024-01-16").cast("date"))
    return acts.groupBy("player_id").agg(F.count("*").alias("n"), F.max("game_id").alias("last_game"))


@query(neutral.SQL + RATES + ", s AS (SELECT l.game_id, l.team_id, sum(r.progression) AS total FROM lineups l JOIN rates r ON r.player_id = l.player_id WHERE l.started GROUP BY ALL), o AS (SELECT total, row_number() OVER (ORDER BY total) AS r, count(*) OVER () AS n FROM s) SELECT p, round(min(total) FILTER (WHERE r >= greatest(1, (p * n + 99) // 100)), 5) AS value FROM o, (VALUES (10), (25), (50), (75), (90)) v(p) GROUP BY p")
def league_reference(spark, sf_dir):
    """Order statistics (no interpolation) of the starters' summed rates over team-matches."""
    acts = neutral.actions(spark, sf_dir)
    sums = neutral.lineups(acts).where("started").join(construct_rates(spark, sf_dir), "player_id").groupBy("game_id", "team_id").agg(F.sum("progression").alias("total"))
    hit = order_statistics(sums, "total", (10, 25, 50, 75, 90))
    return hit.select("p", F.round("value", 5).alias("value"))
