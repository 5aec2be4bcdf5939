"""Per-match queries: state as of each event, windows, bins, networks, tables, standings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import gain, ratio
from ..sources import neutral
from .registry import query

PERIOD_NO = "CASE period WHEN '1H' THEN 1 ELSE 2 END"


@query(
    neutral.SQL + f""", a AS (SELECT *, {PERIOD_NO} AS pn FROM actions)
SELECT e.event_id, CAST((SELECT count(*) FROM a i WHERE i.game_id = e.game_id AND (i.pn, i.seconds) < (e.pn, e.seconds) AND i.goal AND i.team_id = e.team_id) AS BIGINT) AS own_goals,
  CAST((SELECT count(*) FROM a i WHERE i.game_id = e.game_id AND (i.pn, i.seconds) < (e.pn, e.seconds) AND i.goal AND i.team_id <> e.team_id) AS BIGINT) AS their_goals,
  CAST((SELECT count(*) FROM a i WHERE i.game_id = e.game_id AND (i.pn, i.seconds) < (e.pn, e.seconds) AND i.dismissal) AS BIGINT) AS dismissals FROM a e"""
)
def match_state(spark, sf_dir):
    """Score and dismissals strictly before each event: the running sum minus what happened at the same moment."""
    a = neutral.actions(spark, sf_dir).withColumn("at", F.when(F.col("period") == "1H", 0.0).otherwise(100_000.0) + F.col("seconds"))
    run = Window.partitionBy("game_id").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    now = Window.partitionBy("game_id", "at")

    def before(flag):
        one = flag.cast("long")
        return F.sum(one).over(run) - F.sum(one).over(now)

    one, two = before(F.col("goal") & (F.col("team_id") == 0)), before(F.col("goal") & (F.col("team_id") == 1))
    home = F.col("team_id") == 0
    return a.select("event_id", F.when(home, one).otherwise(two).alias("own_goals"), F.when(home, two).otherwise(one).alias("their_goals"), before(F.col("dismissal")).alias("dismissals"))


@query(
    neutral.SQL + """, t AS (SELECT game_id, team_id, count(*) AS actions, count(*) FILTER (WHERE type = 'pass' AND success) AS passes, count(*) FILTER (WHERE type = 'shot') AS shots,
  count(*) FILTER (WHERE goal) AS goals, round(coalesce(sum(greatest(delta, 0.0)) FILTER (WHERE type = 'pass' AND success), 0.0), 6) AS gain FROM gained GROUP BY ALL)
SELECT t.*, o.passes AS passes_against, o.shots AS shots_against, o.goals AS goals_against FROM t LEFT JOIN t o ON o.game_id = t.game_id AND o.team_id <> t.team_id"""
)
def team_match_table(spark, sf_dir):
    """Counts of each team-match with the opponent's own beside them; two teams a match, so the self join stays linear."""
    a = neutral.actions(spark, sf_dir)
    done = (F.col("type") == "pass") & F.col("success")
    delta = gain(F.col("start_x"), F.col("end_x"))
    t = a.groupBy("game_id", "team_id").agg(
        F.count("*").alias("actions"), F.count_if(done).alias("passes"), F.count_if(F.col("type") == "shot").alias("shots"), F.count_if("goal").alias("goals"),
        F.round(F.coalesce(F.sum(F.when(done, F.greatest(delta, F.lit(0.0)))), F.lit(0.0)), 6).alias("gain"),
    )
    o = t.select("game_id", (1 - F.col("team_id")).alias("team_id"), *[F.col(c).alias(f"{c}_against") for c in ("passes", "shots", "goals")])
    return t.join(o, ["game_id", "team_id"], "left")


@query(
    neutral.SQL + f""", e AS (SELECT game_id, {PERIOD_NO} AS pn, seconds, sum(CASE WHEN goal THEN CASE WHEN team_id = 0 THEN 1 ELSE -1 END ELSE 0 END) AS d FROM actions GROUP BY ALL),
s AS (SELECT *, sum(d) OVER (PARTITION BY game_id ORDER BY pn, seconds) AS lead_now, lead(seconds) OVER (PARTITION BY game_id, pn ORDER BY seconds) AS nxt FROM e)
SELECT game_id, CASE WHEN lead_now > 0 THEN 'ahead' WHEN lead_now < 0 THEN 'behind' ELSE 'level' END AS state, CAST(sum(nxt - seconds) AS DOUBLE) AS seconds FROM s WHERE nxt IS NOT NULL GROUP BY ALL"""
)
def window_seconds(spark, sf_dir):
    """Seconds that team 0 spent ahead, level and behind, between breakpoints of one period."""
    sign = F.when(F.col("goal"), F.when(F.col("team_id") == 0, 1).otherwise(-1)).otherwise(0)
    e = neutral.actions(spark, sf_dir).groupBy("game_id", F.when(F.col("period") == "1H", 1).otherwise(2).alias("pn"), "seconds").agg(F.sum(sign).alias("d"))
    game = Window.partitionBy("game_id").orderBy("pn", "seconds")
    s = e.withColumn("now", F.sum("d").over(game)).withColumn("nxt", F.lead("seconds").over(Window.partitionBy("game_id", "pn").orderBy("seconds"))).where("nxt is not null")
    state = F.when(F.col("now") > 0, "ahead").when(F.col("now") < 0, "behind").otherwise("level")
    return s.groupBy("game_id", state.alias("state")).agg(F.sum(F.col("nxt") - F.col("seconds")).alias("seconds"))


@query(
    neutral.SQL + """, b AS (SELECT game_id, team_id, period, CAST(floor(seconds / 300) AS BIGINT) AS bin, sum(greatest(delta, 0.0)) AS g FROM gained WHERE type = 'pass' AND success GROUP BY ALL),
m AS (SELECT game_id, team_id, period, max(bin) AS top FROM b GROUP BY ALL), d AS (SELECT game_id, team_id, period, unnest(range(top + 1)) AS bin FROM m)
SELECT d.game_id, d.team_id, d.period, d.bin, round(coalesce(g, 0.0), 6) AS gain, round(sum(coalesce(g, 0.0)) OVER (PARTITION BY d.game_id, d.team_id ORDER BY d.period, d.bin), 6) AS running FROM d LEFT JOIN b USING (game_id, team_id, period, bin)"""
)
def threat_bins(spark, sf_dir):
    """Five-minute tumbling bins in each period; empty bins are present, the running sum goes on across periods."""
    a = neutral.actions(spark, sf_dir).where("type = 'pass' and success").withColumn("bin", F.floor(F.col("seconds") / 300))
    keys = ["game_id", "team_id", "period"]
    b = a.groupBy(*keys, "bin").agg(F.sum(F.greatest(gain(F.col("start_x"), F.col("end_x")), F.lit(0.0))).alias("g"))
    d = b.groupBy(*keys).agg(F.max("bin").alias("top")).select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), "top")).alias("bin"))
    run = Window.partitionBy("game_id", "team_id").orderBy("period", "bin")
    return d.join(b, [*keys, "bin"], "left").withColumn("g", F.coalesce("g", F.lit(0.0))).select(*keys, "bin", F.round("g", 6).alias("gain"), F.round(F.sum("g").over(run), 6).alias("running"))


NEXT = f"""n AS (SELECT *, lead(player_id) OVER w AS to_player, lead(team_id) OVER w AS to_team, lead(period) OVER w AS to_period, lead(seconds) OVER w - seconds AS gap
  FROM gained WINDOW w AS (PARTITION BY game_id ORDER BY {PERIOD_NO}, seconds, event_id)),
e AS (SELECT game_id, team_id, player_id AS source, to_player AS target, delta, start_x, start_y FROM n
  WHERE type = 'pass' AND success AND player_id <> 0 AND to_player <> 0 AND to_player <> player_id AND to_team = team_id AND to_period = period AND gap <= 900)"""


def _edges(spark, sf_dir):
    w = Window.partitionBy("game_id").orderBy("period", "seconds", "event_id")
    a = neutral.actions(spark, sf_dir)
    n = a.withColumn("nx", F.lead(F.struct("player_id", "team_id", "period", "seconds")).over(w)).where("type = 'pass' and success and player_id <> 0")
    ok = (F.col("nx.player_id") != 0) & (F.col("nx.player_id") != F.col("player_id")) & (F.col("nx.team_id") == F.col("team_id")) & (F.col("nx.period") == F.col("period"))
    n = n.where(ok & (F.col("nx.seconds") - F.col("seconds") <= 900))
    return n.select("game_id", "team_id", F.col("player_id").alias("source"), F.col("nx.player_id").alias("target"), gain(F.col("start_x"), F.col("end_x")).alias("delta"), "start_x", "start_y")


@query(neutral.SQL + ", " + NEXT + " SELECT game_id, team_id, source, target, count(*) AS passes, round(sum(delta), 6) AS gain FROM e GROUP BY ALL")
def pass_network_edges(spark, sf_dir):
    """Receiver = who acts next for the same team, in the same period, soon enough."""
    return _edges(spark, sf_dir).groupBy("game_id", "team_id", "source", "target").agg(F.count("*").alias("passes"), F.round(F.sum("delta"), 6).alias("gain"))


@query(neutral.SQL + ", " + NEXT + """, s AS (SELECT game_id, team_id, source AS player_id, count(*) AS passes, round(avg(start_x), 6) AS x, round(avg(start_y), 6) AS y FROM e GROUP BY ALL),
t AS (SELECT DISTINCT game_id, team_id, target AS player_id FROM e) SELECT game_id, team_id, player_id, coalesce(passes, 0) AS passes, x, y FROM s FULL JOIN t USING (game_id, team_id, player_id)""")
def pass_network_nodes(spark, sf_dir):
    """Passers and receivers; who only receives has no place."""
    e = _edges(spark, sf_dir)
    s = e.groupBy("game_id", "team_id", F.col("source").alias("player_id")).agg(F.count("*").alias("passes"), F.round(F.avg("start_x"), 6).alias("x"), F.round(F.avg("start_y"), 6).alias("y"))
    t = e.select("game_id", "team_id", F.col("target").alias("player_id")).distinct()
    return s.join(t, ["game_id", "team_id", "player_id"], "full").withColumn("passes", F.coalesce("passes", F.lit(0).cast("long")))


@query(
    neutral.SQL + """ SELECT event_id, game_id, CASE WHEN own_goal THEN 'own goal' WHEN goal THEN 'goal' WHEN dismissal THEN 'card' WHEN type = 'shot' THEN 'shot' ELSE type END AS kind,
  CASE WHEN own_goal OR goal OR dismissal THEN 'KEY' WHEN type = 'shot' THEN 'TACTICAL' ELSE 'ALL' END AS level,
  CASE period WHEN '1H' THEN CASE WHEN floor(seconds / 60) >= 45 THEN '45+' || CAST(floor(seconds / 60) - 44 AS BIGINT) ELSE CAST(CAST(floor(seconds / 60) + 1 AS BIGINT) AS VARCHAR) END
    ELSE CASE WHEN floor(seconds / 60) >= 45 THEN '90+' || CAST(floor(seconds / 60) - 44 AS BIGINT) ELSE CAST(CAST(floor(seconds / 60) + 46 AS BIGINT) AS VARCHAR) END END AS clock FROM actions"""
)
def timeline(spark, sf_dir):
    """Event kinds by precedence, their level, and a clock label in which 45+2 precedes 46."""
    key = F.col("own_goal") | F.col("goal") | F.col("dismissal")
    shot = F.col("type") == "shot"
    kind = F.when(F.col("own_goal"), "own goal").when(F.col("goal"), "goal").when(F.col("dismissal"), "card").when(shot, "shot").otherwise(F.col("type"))
    minute = F.floor(F.col("seconds") / 60)
    first = F.col("period") == "1H"
    over = F.concat(F.when(first, "45+").otherwise("90+"), (minute - 44).cast("string"))
    clock = F.when(minute >= 45, over).otherwise((minute + F.when(first, 1).otherwise(46)).cast("string"))
    return neutral.actions(spark, sf_dir).select("event_id", "game_id", kind.alias("kind"), F.when(key, "KEY").when(shot, "TACTICAL").otherwise("ALL").alias("level"), clock.alias("clock"))


@query(neutral.SQL + """, p AS (SELECT event_id, game_id, delta, quantile_cont(delta, 0.9) OVER (PARTITION BY game_id) AS q FROM gained WHERE type = 'pass' AND success AND delta > 0)
SELECT event_id, game_id, round(delta, 6) AS gain FROM p WHERE delta >= q""")
def top_decile_gains(spark, sf_dir):
    """Passes at or above the match's own 90th percentile of positive gains (exact, interpolated)."""
    p = neutral.actions(spark, sf_dir).where("type = 'pass' and success").withColumn("delta", gain(F.col("start_x"), F.col("end_x"))).where("delta > 0")
    q = p.groupBy("game_id").agg(F.percentile("delta", F.lit(0.9)).alias("q"))
    return p.join(q, "game_id").where("delta >= q").select("event_id", "game_id", F.round("delta", 6).alias("gain"))


SIDES = """, g AS (SELECT game_id, CAST(count(*) FILTER (WHERE goal AND team_id = 0) AS BIGINT) AS h, CAST(count(*) FILTER (WHERE goal AND team_id = 1) AS BIGINT) AS a FROM actions GROUP BY game_id),
s AS (SELECT game_id, 'team' || (game_id % 6) AS team, h AS gf, a AS ga FROM g UNION ALL SELECT game_id, 'team' || ((game_id * 5 + 1) % 6), a, h FROM g)"""


def _sides(spark, sf_dir):
    g = neutral.actions(spark, sf_dir).groupBy("game_id").agg(F.count_if(F.col("goal") & (F.col("team_id") == 0)).alias("h"), F.count_if(F.col("goal") & (F.col("team_id") == 1)).alias("a"))
    home = g.select("game_id", F.concat(F.lit("team"), F.col("game_id") % 6).alias("team"), F.col("h").alias("gf"), F.col("a").alias("ga"))
    away = g.select("game_id", F.concat(F.lit("team"), (F.col("game_id") * 5 + 1) % 6).alias("team"), F.col("a").alias("gf"), F.col("h").alias("ga"))
    return home.unionByName(away)


@query(neutral.SQL + SIDES + """, t AS (SELECT team, count(*) AS played, CAST(sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS BIGINT) AS points, CAST(sum(gf - ga) AS BIGINT) AS gd, CAST(sum(gf) AS BIGINT) AS gf FROM s WHERE game_id < 25 GROUP BY team)
SELECT *, CAST(rank() OVER (ORDER BY points DESC, gd DESC, gf DESC) AS INTEGER) AS place FROM t""")
def standings(spark, sf_dir):
    """A table as of a day; equal records share a place. Its rows are the teams of a league."""
    points = F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0)
    t = _sides(spark, sf_dir).where("game_id < 25").groupBy("team").agg(F.count("*").alias("played"), F.sum(points).alias("points"), F.sum(F.col("gf") - F.col("ga")).alias("gd"), F.sum("gf").alias("gf"))
    return t.withColumn("place", F.rank().over(Window.orderBy(F.desc("points"), F.desc("gd"), F.desc("gf"))).cast("int"))


@query(neutral.SQL + SIDES + """, r AS (SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS p FROM s)
SELECT team, game_id, CAST(coalesce(sum(p) OVER w, 0) AS BIGINT) AS points_before, round(avg(gf) OVER (PARTITION BY team ORDER BY game_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 6) AS form
FROM r WINDOW w AS (PARTITION BY team ORDER BY game_id RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def walk_forward_table(spark, sf_dir):
    """Points strictly before each match day, and the mean of the last five matches."""
    r = _sides(spark, sf_dir).withColumn("p", F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0))
    by = Window.partitionBy("team").orderBy("game_id")
    before = F.sum("p").over(by.rangeBetween(Window.unboundedPreceding, -1))
    return r.select("team", "game_id", F.coalesce(before, F.lit(0).cast("long")).alias("points_before"), F.round(F.avg("gf").over(by.rowsBetween(-5, -1)), 6).alias("form"))


@query(neutral.SQL + """, v AS (SELECT game_id, count(*) AS n, count(DISTINCT period) AS periods, count(*) FILTER (WHERE dismissal) AS sent_off, count(*) FILTER (WHERE success IS NULL) AS unjudged FROM actions GROUP BY game_id)
SELECT game_id, n, CASE WHEN periods < 2 THEN 'period_missing' WHEN n < 0.5 * m THEN 'few_actions' WHEN n > 2 * m THEN 'many_actions' WHEN sent_off > 3 THEN 'many_dismissals' ELSE 'valid' END AS status, round(unjudged / n, 6) AS unjudged_share
FROM v, (SELECT median(n) AS m FROM v)""")
def match_validity(spark, sf_dir):
    """The first failing reason of each match, with the volume held against the median match."""
    v = neutral.actions(spark, sf_dir).groupBy("game_id").agg(
        F.count("*").alias("n"), F.count_distinct("period").alias("periods"), F.count_if("dismissal").alias("sent_off"), F.count_if(F.col("success").isNull()).alias("unjudged")
    )
    m = v.agg(F.median("n").alias("m"))
    n = F.col("n")
    status = F.when(F.col("periods") < 2, "period_missing").when(n < 0.5 * F.col("m"), "few_actions").when(n > 2 * F.col("m"), "many_actions").when(F.col("sent_off") > 3, "many_dismissals").otherwise("valid")
    return v.join(F.broadcast(m)).select("game_id", "n", status.alias("status"), F.round(ratio(F.col("unjudged"), n), 6).alias("unjudged_share"))


@query(neutral.SQL + """ SELECT team_id, type, CAST(grouping(type) AS INTEGER) AS all_types, count(*) AS n, count(*) FILTER (WHERE success) AS done FROM actions GROUP BY GROUPING SETS ((team_id, type), (team_id))""")
def pooled_counts(spark, sf_dir):
    """Each subset and the pool of all of them."""
    a = neutral.actions(spark, sf_dir)
    out = a.rollup("team_id", "type").agg(F.grouping("type").cast("int").alias("all_types"), F.grouping("team_id").alias("_all"), F.count("*").alias("n"), F.count_if("success").alias("done"))
    return out.where("_all = 0").drop("_all")
