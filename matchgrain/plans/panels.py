"""Match inputs of providers, panels of player-matches, audits, and the windows and listings over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from ..functions.scalars import cell, gain, located, ratio
from ..sources import neutral
from .matches import SIDES, _sides
from .players import RATES, gained, total_minutes
from .registry import query

PASS = "type = 'pass'"
#: Flags of one action, alike for every provider; each is true or false, never unknown.
FLAGS = {
    "open_play_pass": ("type = 'pass' AND NOT key_pass", lambda: (F.col("type") == "pass") & ~F.col("key_pass")),
    "completed_pass": ("type = 'pass' AND coalesce(success, FALSE)", lambda: (F.col("type") == "pass") & F.coalesce("success", F.lit(False))),
    "unjudged_pass": ("type = 'pass' AND success IS NULL", lambda: (F.col("type") == "pass") & F.col("success").isNull()),
    "shot": ("type = 'shot'", lambda: F.col("type") == "shot"),
    "scored": ("goal AND NOT own_goal", lambda: F.col("goal") & ~F.col("own_goal")),
    "duel_won": ("type = 'duel' AND coalesce(success, FALSE)", lambda: (F.col("type") == "duel") & F.coalesce("success", F.lit(False))),
    "lost": ("dangerous_loss OR (type = 'pass' AND coalesce(NOT success, FALSE))", lambda: F.col("dangerous_loss") | ((F.col("type") == "pass") & F.coalesce(~F.col("success"), F.lit(False)))),
    "into_last_third": ("end_x >= 2.0 / 3 AND start_x < 2.0 / 3", lambda: (F.col("end_x") >= 2.0 / 3) & (F.col("start_x") < 2.0 / 3)),
    "into_box": ("end_x > 0.84 AND end_y BETWEEN 0.21 AND 0.79", lambda: (F.col("end_x") > 0.84) & F.col("end_y").between(0.21, 0.79)),
}
_FLAG_SQL = ", ".join(f"CAST({sql} AS INTEGER) AS {n}" for n, (sql, _) in FLAGS.items())
_COUNT_SQL = ", ".join(f"count(*) FILTER (WHERE {sql}) AS {n}" for n, (sql, _) in FLAGS.items())


def counted() -> list[Column]:
    return [F.count_if(f()).alias(n) for n, (_, f) in FLAGS.items()]


@query(neutral.SQL + f" SELECT event_id, {_FLAG_SQL} FROM actions")
def provider_flags(spark, sf_dir):
    return neutral.actions(spark, sf_dir).select("event_id", *[f().cast("int").alias(n) for n, (_, f) in FLAGS.items()])


@query(neutral.SQL + " SELECT event_id, CASE WHEN start_x BETWEEN 0 AND 1 AND start_y BETWEEN 0 AND 1 AND NOT (start_x = 0 AND start_y = 0) AND NOT (start_x = 1 AND start_y = 1) THEN start_x END AS x, CASE WHEN start_x BETWEEN 0 AND 1 AND start_y BETWEEN 0 AND 1 AND NOT (start_x = 0 AND start_y = 0) AND NOT (start_x = 1 AND start_y = 1) THEN start_y END AS y FROM actions")
def known_points(spark, sf_dir):
    """Coordinates that say "unknown" become missing."""
    ok = located(F.col("start_x"), F.col("start_y"))
    return neutral.actions(spark, sf_dir).select("event_id", F.when(ok, F.col("start_x")).alias("x"), F.when(ok, F.col("start_y")).alias("y"))


@dataclass(frozen=True)
class Wanted:
    """A declared filter of candidates; what is not set asks for nothing."""

    youngest: int = 0
    oldest: int = 99
    foot: frozenset[str] = frozenset()
    positions: frozenset[str] = frozenset()

    def column(self) -> Column:
        out = F.col("age").between(self.youngest, self.oldest)
        out = out & F.col("foot").isin(*sorted(self.foot)) if self.foot else out
        return F.coalesce(out & F.col("position").isin(*sorted(self.positions)) if self.positions else out, F.lit(False))


@query(neutral.SQL + " SELECT player_id, age, foot, position FROM (SELECT player_id, position, 17 + player_id % 20 AS age, ['left', 'right', 'both'][player_id % 3 + 1] AS foot FROM players) WHERE age BETWEEN 20 AND 28 AND foot IN ('left', 'both') AND position IN ('DF', 'MD')")
def candidate_filter(spark, sf_dir):
    p = F.col("player_id")
    c = neutral.players(neutral.actions(spark, sf_dir)).select("player_id", "position", (17 + p % 20).alias("age"), F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("both")), (p % 3 + 1).cast("int")).alias("foot"))
    return c.where(Wanted(20, 28, frozenset({"left", "both"}), frozenset({"DF", "MD"})).column()).select("player_id", "age", "foot", "position")


@query(neutral.SQL + """, c AS (SELECT player_id, game_id, count(*) AS n FROM actions WHERE player_id <> 0 GROUP BY ALL), b AS (SELECT DISTINCT ON (player_id) player_id, game_id FROM c ORDER BY player_id, n DESC, game_id)
SELECT event_id, player_id, game_id, type, start_x, start_y FROM actions JOIN b USING (player_id, game_id) WHERE start_x BETWEEN 0 AND 1 AND start_y BETWEEN 0 AND 1 AND NOT (start_x = 0 AND start_y = 0) AND NOT (start_x = 1 AND start_y = 1)""")
def player_activity(spark, sf_dir):
    """The located events of everybody's busiest match."""
    a = neutral.actions(spark, sf_dir).where("player_id <> 0")
    busiest = a.groupBy("player_id", "game_id").count().groupBy("player_id").agg(F.min_by("game_id", F.struct(-F.col("count"), "game_id")).alias("game_id"))
    return a.join(busiest, ["player_id", "game_id"]).where(located(F.col("start_x"), F.col("start_y"))).select("event_id", "player_id", "game_id", "type", "start_x", "start_y")


@query(neutral.SQL + f" SELECT game_id, player_id, {_COUNT_SQL} FROM actions WHERE player_id <> 0 GROUP BY ALL")
def player_match_inputs(spark, sf_dir):
    return neutral.actions(spark, sf_dir).where("player_id <> 0").groupBy("game_id", "player_id").agg(*counted())


@query(neutral.SQL + f", t AS (SELECT game_id, team_id, {_COUNT_SQL} FROM actions GROUP BY ALL), m AS (SELECT game_id, {', '.join(f'CAST(sum({n}) AS BIGINT) AS {n}' for n in FLAGS)} FROM t GROUP BY game_id) SELECT t.*, {', '.join(f'm.{n} - t.{n} AS {n}_against' for n in FLAGS)} FROM t JOIN m USING (game_id)")
def team_match_inputs(spark, sf_dir):
    """A team's quantities, and the opponent's as the match's total without its own."""
    t = neutral.actions(spark, sf_dir).groupBy("game_id", "team_id").agg(*counted())
    m = t.groupBy("game_id").agg(*[F.sum(n).alias(f"_{n}") for n in FLAGS])
    return t.join(m, "game_id").select(*t.columns, *[(F.col(f"_{n}") - F.col(n)).alias(f"{n}_against") for n in FLAGS])


@query(
    neutral.SQL + """, s AS (SELECT player_id, sum(minutes) AS minutes, sum(minutes) FILTER (WHERE (game_id + player_id) % 4 <> 0) AS observed FROM lineups GROUP BY player_id),
d AS (SELECT player_id, count(*) FILTER (WHERE type = 'duel') AS duels FROM actions WHERE (game_id + player_id) % 4 <> 0 GROUP BY player_id),
r AS (SELECT s.player_id, position, CAST(minutes AS BIGINT) AS minutes, CAST(observed AS BIGINT) AS observed, coalesce(duels, 0) * 90.0 / observed AS rate FROM s LEFT JOIN d USING (player_id) JOIN players USING (player_id) WHERE observed >= 20)
SELECT player_id, minutes, observed, round(rate, 6) AS rate, round(rate - avg(rate) OVER (PARTITION BY position), 6) + 0.0 AS gap FROM r WHERE position IS NOT NULL"""
)
def scouting_sample(spark, sf_dir):
    """Rates over the minutes in which the quantity was reported, and the gap to the player's position."""
    a = neutral.actions(spark, sf_dir)
    seen = (F.col("game_id") + F.col("player_id")) % 4 != 0
    s = neutral.lineups(a).groupBy("player_id").agg(F.sum("minutes").alias("minutes"), F.sum(F.when(seen, F.col("minutes"))).alias("observed"))
    d = a.where(seen).groupBy("player_id").agg(F.count_if(F.col("type") == "duel").alias("duels"))
    r = s.where("observed >= 20").join(d, "player_id", "left").join(neutral.players(a).select("player_id", "position"), "player_id").where("position is not null").withColumn("rate", F.coalesce("duels", F.lit(0)) * 90.0 / F.col("observed"))
    role = r.groupBy("position").agg(F.avg("rate").alias("mean"))
    return r.join(F.broadcast(role), "position").select("player_id", "minutes", "observed", F.round("rate", 6).alias("rate"), (F.round(F.col("rate") - F.col("mean"), 6) + 0.0).alias("gap"))


@query(neutral.SQL + SIDES + " SELECT team = 'team0' AS subject, count(*) AS matches, CAST(sum(gf) AS BIGINT) AS goals, round(avg(gf), 6) AS goals_for, round(avg(ga), 6) AS goals_against FROM s GROUP BY ALL")
def club_against_the_rest(spark, sf_dir):
    return _sides(spark, sf_dir).groupBy((F.col("team") == "team0").alias("subject")).agg(F.count("*").alias("matches"), F.sum("gf").alias("goals"), F.round(F.avg("gf"), 6).alias("goals_for"), F.round(F.avg("ga"), 6).alias("goals_against"))


@query(
    neutral.SQL + """, p AS (SELECT game_id, team_id, count(*) FILTER (WHERE period = '1H' AND seconds < 1800) AS opening, count(*) FILTER (WHERE success IS NULL) AS unjudged, count(*) FILTER (WHERE dismissal) AS sent_off, count(*) FILTER (WHERE goal) AS target FROM actions GROUP BY ALL)
SELECT game_id, team_id, opening, unjudged > 3 AS many_unjudged, sent_off > 0 AS dismissed, opening < 1 AS empty, CASE WHEN sent_off > 0 OR opening < 1 THEN NULL ELSE CAST(target AS DOUBLE) END AS target FROM p"""
)
def opening_panel(spark, sf_dir):
    """The first thirty minutes of each team-match with its quality flags; a target that cannot be trusted is missing."""
    early = (F.col("period") == "1H") & (F.col("seconds") < 1800)
    p = neutral.actions(spark, sf_dir).groupBy("game_id", "team_id").agg(F.count_if(early).alias("opening"), F.count_if(F.col("success").isNull()).alias("unjudged"), F.count_if("dismissal").alias("sent_off"), F.count_if("goal").alias("target"))
    bad = (F.col("sent_off") > 0) | (F.col("opening") < 1)
    return p.select("game_id", "team_id", "opening", (F.col("unjudged") > 3).alias("many_unjudged"), (F.col("sent_off") > 0).alias("dismissed"), (F.col("opening") < 1).alias("empty"), F.when(~bad, F.col("target").cast("double")).alias("target"))


_VECTOR = "count(*) AS actions, count(*) FILTER (WHERE type = 'shot') AS shots, count(*) FILTER (WHERE goal) AS goals, coalesce(sum(greatest(delta, 0.0)) FILTER (WHERE type = 'pass' AND success), 0.0) AS progression"


@query(
    neutral.SQL + f""", p AS (SELECT game_id, player_id, {_VECTOR} FROM gained WHERE player_id <> 0 GROUP BY ALL), t AS (SELECT game_id, team_id, {_VECTOR} FROM gained GROUP BY ALL)
SELECT 'player' AS unit, game_id, player_id AS id, actions, shots, goals, CASE WHEN position IS NULL OR position = 'GK' THEN NULL ELSE round(progression, 6) END AS progression,
  CASE WHEN position IS NULL THEN 'position unknown' WHEN position = 'GK' THEN 'goalkeeper' ELSE '' END AS withheld FROM p JOIN players USING (player_id)
UNION ALL SELECT 'team', game_id, team_id, actions, shots, goals, round(progression, 6), '' FROM t"""
)
def match_vectors(spark, sf_dir):
    """Every quantity of a player-match and a team-match in one pass each; gates hold for players only."""
    a = gained(spark, sf_dir)
    done = (F.col("type") == "pass") & F.col("success")
    agg = [F.count("*").alias("actions"), F.count_if(F.col("type") == "shot").alias("shots"), F.count_if("goal").alias("goals"), F.round(F.coalesce(F.sum(F.when(done, F.greatest("delta", F.lit(0.0)))), F.lit(0.0)), 6).alias("progression")]
    p = a.where("player_id <> 0").groupBy("game_id", "player_id").agg(*agg).join(neutral.players(a).select("player_id", "position"), "player_id")
    why = F.when(F.col("position").isNull(), "position unknown").when(F.col("position") == "GK", "goalkeeper").otherwise("")
    cols = ["actions", "shots", "goals"]
    players = p.select(F.lit("player").alias("unit"), "game_id", F.col("player_id").alias("id"), *cols, F.when(why == "", F.col("progression")).alias("progression"), why.alias("withheld"))
    teams = a.groupBy("game_id", "team_id").agg(*agg).select(F.lit("team").alias("unit"), "game_id", F.col("team_id").alias("id"), *cols, "progression", F.lit("").alias("withheld"))
    return players.unionByName(teams)


@query(
    neutral.SQL + """, a AS (SELECT game_id, player_id, team_id, count(*) AS n, count(*) FILTER (WHERE type = 'pass') AS p, least(90, 10 * count(*)) AS m FROM actions WHERE player_id <> 0 GROUP BY ALL),
b AS (SELECT game_id, player_id, count(*) AS n, count(*) FILTER (WHERE type = 'pass') AS p, least(90, 12 * count(*)) AS m FROM actions WHERE player_id <> 0 AND event_id % 5 <> 0 GROUP BY ALL),
j AS (SELECT game_id, player_id, team_id, a.n AS n1, a.p AS p1, b.n AS n2, b.p AS p2 FROM a JOIN b USING (game_id, player_id) WHERE a.m >= 20 AND b.m >= 20), c AS (SELECT player_id, team_id, count(*) AS k FROM j GROUP BY ALL),
q AS (SELECT DISTINCT ON (player_id) player_id, team_id FROM c ORDER BY player_id, k DESC, team_id)
SELECT player_id, team_id, count(*) AS matches, round(sum(p1) / sum(n1), 6) AS share_one, round(sum(p2) / sum(n2), 6) AS share_two FROM (SELECT * EXCLUDE team_id FROM j) JOIN q USING (player_id) GROUP BY ALL HAVING sum(n1) >= 4 AND sum(n2) >= 4"""
)
def joint_panel(spark, sf_dir):
    """Players whom both providers saw for long enough in one match: ratios of sums, and the club of most of these matches."""
    a = neutral.actions(spark, sf_dir).where("player_id <> 0")
    one = a.groupBy("game_id", "player_id", "team_id").agg(F.count("*").alias("n1"), F.count_if(F.col("type") == "pass").alias("p1")).where(F.least(F.lit(90), 10 * F.col("n1")) >= 20)
    two = a.where("event_id % 5 <> 0").groupBy("game_id", "player_id").agg(F.count("*").alias("n2"), F.count_if(F.col("type") == "pass").alias("p2")).where(F.least(F.lit(90), 12 * F.col("n2")) >= 20)
    by = one.join(two, ["game_id", "player_id"]).groupBy("player_id", "team_id").agg(F.count("*").alias("k"), *[F.sum(c).alias(c) for c in ("n1", "p1", "n2", "p2")])
    out = by.groupBy("player_id").agg(F.min_by("team_id", F.struct(-F.col("k"), "team_id")).alias("team_id"), F.sum("k").alias("matches"), *[F.sum(c).alias(c) for c in ("n1", "p1", "n2", "p2")])
    return out.where("n1 >= 4 and n2 >= 4").select("player_id", "team_id", "matches", F.round(ratio(F.col("p1"), F.col("n1")), 6).alias("share_one"), F.round(ratio(F.col("p2"), F.col("n2")), 6).alias("share_two"))


@query(
    neutral.SQL + """, b AS (SELECT event_id, game_id, team_id, CASE WHEN event_id % 13 = 0 THEN player_id + 1 ELSE player_id END AS player_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE coalesce(success, FALSE) END AS done, key_pass AND event_id % 3 <> 0 AS kp, least(start_x + (event_id % 4) / 100.0, 1.0) AS x FROM actions WHERE type = 'pass')
SELECT a.team_id, count(*) AS pairs, round(avg(CAST(a.player_id = b.player_id AS INTEGER)), 6) AS same_player, round(avg(CAST(coalesce(a.success, FALSE) = done AS INTEGER)), 6) AS same_outcome,
  round(count(*) FILTER (WHERE key_pass AND kp) / nullif(count(*) FILTER (WHERE key_pass OR kp), 0), 6) AS key_pass_overlap, round(quantile_cont(abs(start_x - x), 0.5), 6) AS shift_half, round(quantile_cont(abs(start_x - x), 0.9), 6) AS shift_most
FROM actions a JOIN b USING (event_id) GROUP BY a.team_id"""
)
def pairing_description(spark, sf_dir):
    """How two providers' records of the same passes agree: who, the outcome, what counts as a key pass, and where."""
    e = F.col("event_id")
    a = neutral.actions(spark, sf_dir).where(PASS)
    b = a.select("event_id", F.when(e % 13 == 0, F.col("player_id") + 1).otherwise(F.col("player_id")).alias("other"), F.when(e % 17 != 0, F.coalesce("success", F.lit(False))).alias("done"), (F.col("key_pass") & (e % 3 != 0)).alias("kp"), F.least(F.col("start_x") + (e % 4) / 100.0, F.lit(1.0)).alias("x"))
    shift = F.abs(F.col("start_x") - F.col("x"))
    return a.join(b, "event_id").groupBy("team_id").agg(
        F.count("*").alias("pairs"), F.round(F.avg((F.col("player_id") == F.col("other")).cast("int")), 6).alias("same_player"), F.round(F.avg((F.coalesce("success", F.lit(False)) == F.col("done")).cast("int")), 6).alias("same_outcome"),
        F.round(ratio(F.count_if(F.col("key_pass") & F.col("kp")), F.count_if(F.col("key_pass") | F.col("kp"))), 6).alias("key_pass_overlap"), F.round(F.percentile(shift, F.lit(0.5)), 6).alias("shift_half"), F.round(F.percentile(shift, F.lit(0.9)), 6).alias("shift_most"),
    )


_CELL = "CAST(least(11, floor({1} * 12)) AS INTEGER) * 16 + CAST(least(15, floor({0} * 16)) AS INTEGER)"


@query(neutral.SQL + f""", m AS (SELECT {_CELL.format('start_x', 'start_y')} AS "at", {_CELL.format('end_x', 'end_y')} AS "to", start_x = 1 AND start_y = 1 AS dropped FROM actions WHERE type = 'pass' AND success)
SELECT "at", "to", count(*) FILTER (WHERE NOT dropped) AS moves, count(*) FILTER (WHERE dropped) AS dropped FROM m GROUP BY ALL""")
def surface_counts(spark, sf_dir):
    """Transitions between cells as a reference surface counts them, with what was dropped for its place."""
    gone = (F.col("start_x") == 1) & (F.col("start_y") == 1)
    m = neutral.actions(spark, sf_dir).where("type = 'pass' and success")
    return m.groupBy(cell(F.col("start_x"), F.col("start_y")).alias("at"), cell(F.col("end_x"), F.col("end_y")).alias("to")).agg(F.count_if(~gone).alias("moves"), F.count_if(gone).alias("dropped"))


@query(
    neutral.SQL + """, sp AS (SELECT game_id, player_id, unnest([{'a': 0, 'b': least(45, minutes), 'p': 'P' || (player_id % 3)}, {'a': 45, 'b': minutes, 'p': 'P' || (player_id % 5)}]) AS s FROM lineups),
m AS (SELECT game_id, player_id, s.p AS p, CAST(sum(greatest(0, s.b - s.a)) AS BIGINT) AS m FROM sp GROUP BY ALL)
SELECT game_id, player_id, CAST(sum(m) AS BIGINT) AS minutes, arg_min(p, (-m, p)) AS position FROM m GROUP BY ALL"""
)
def spell_minutes(spark, sf_dir):
    """Minutes from a sheet's spells, and the position of most of them."""
    p = F.col("player_id")
    spell = lambda a, b, n: F.struct(F.lit(a).alias("a"), b.alias("b"), F.concat(F.lit("P"), p % n).alias("p"))
    s = neutral.lineups(neutral.actions(spark, sf_dir)).select("game_id", "player_id", F.explode(F.array(spell(0, F.least(F.lit(45), "minutes").cast("long"), 3), spell(45, F.col("minutes").cast("long"), 5))).alias("s"))
    m = s.groupBy("game_id", "player_id", F.col("s.p").alias("p")).agg(F.sum(F.greatest(F.lit(0), F.col("s.b") - F.col("s.a"))).alias("m"))
    return m.groupBy("game_id", "player_id").agg(F.sum("m").alias("minutes"), F.min_by("p", F.struct(-F.col("m"), "p")).alias("position"))


@query(
    neutral.SQL + """, c AS (SELECT game_id, player_id FROM actions WHERE dismissal AND player_id <> 0 GROUP BY ALL), s AS (SELECT game_id, player_id FROM lineups WHERE (game_id * 3 + player_id) % 29 = 0 UNION SELECT game_id, player_id FROM c WHERE player_id % 4 <> 0)
SELECT g.game_id % 3 AS league, (SELECT count(*) FROM c WHERE game_id % 3 = g.game_id % 3 AND (game_id, player_id) IN (SELECT (game_id, player_id) FROM s)) AS agree, (SELECT count(*) FROM c WHERE game_id % 3 = g.game_id % 3 AND (game_id, player_id) NOT IN (SELECT (game_id, player_id) FROM s)) AS events_only,
  (SELECT count(*) FROM s WHERE game_id % 3 = g.game_id % 3 AND (game_id, player_id) NOT IN (SELECT (game_id, player_id) FROM c)) AS sheet_only FROM actions g GROUP BY ALL"""
)
def card_audit(spark, sf_dir):
    """Cards by the events and by the sheets: what both know, and what only one of them does."""
    a = neutral.actions(spark, sf_dir)
    k = ["game_id", "player_id"]
    c = a.where("dismissal and player_id <> 0").select(*k).distinct()
    s = neutral.lineups(a).where("(game_id * 3 + player_id) % 29 = 0").select(*k).union(c.where("player_id % 4 <> 0")).distinct()
    both = c.withColumn("e", F.lit(1)).join(s.withColumn("s", F.lit(1)), k, "full")
    e, t = F.col("e").isNotNull(), F.col("s").isNotNull()
    counts = both.groupBy((F.col("game_id") % 3).alias("league")).agg(F.count_if(e & t).alias("agree"), F.count_if(e & ~t).alias("events_only"), F.count_if(~e & t).alias("sheet_only"))
    leagues = a.select((F.col("game_id") % 3).alias("league")).distinct()
    return leagues.join(counts, "league", "left").na.fill(0)


@query("SELECT o_orderkey, round(coalesce(sum(w) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(w) OVER (PARTITION BY o_orderpriority, o_totalprice) / 2.0 + 0.5, 6) AS rank FROM (SELECT *, 1 + o_orderkey % 3 AS w FROM orders)")
def weighted_ranks(spark, sf_dir):
    """Ranks in strata where rows weigh more than one: all that is below, half of the peers, and a half.

    Weights are summed by distinct value first, so the window runs over values, not rows.
    """
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderpriority", "o_totalprice", (1 + F.col("o_orderkey") % 3).alias("w"))
    v = o.groupBy("o_orderpriority", "o_totalprice").agg(F.sum("w").alias("peers"))
    v = v.withColumn("upto", F.sum("peers").over(Window.partitionBy("o_orderpriority").orderBy("o_totalprice")))
    return o.join(v, ["o_orderpriority", "o_totalprice"]).select("o_orderkey", F.round(F.col("upto") - F.col("peers") / 2.0 + 0.5, 6).alias("rank"))


@query(neutral.SQL + " SELECT game_id, least(h, a) AS one, greatest(h, a) AS two, row_number() OVER w - 1 AS meeting, (row_number() OVER w - 1 + least(h, a)) % 2 AS half FROM (SELECT DISTINCT game_id, game_id % 6 AS h, (game_id * 5 + 1) % 6 AS a FROM actions) WINDOW w AS (PARTITION BY least(h, a), greatest(h, a) ORDER BY game_id)")
def meetings(spark, sf_dir):
    """The how-manieth meeting of two teams a match is, and the half it falls in by turns."""
    g = neutral.actions(spark, sf_dir).select("game_id").distinct().withColumn("h", F.col("game_id") % 6).withColumn("a", (F.col("game_id") * 5 + 1) % 6)
    g = g.select("game_id", F.least("h", "a").alias("one"), F.greatest("h", "a").alias("two"))
    nth = (F.row_number().over(Window.partitionBy("one", "two").orderBy("game_id")) - 1).cast("long")
    return g.select("game_id", "one", "two", nth.alias("meeting"), ((nth + F.col("one")) % 2).alias("half"))


@query(
    neutral.SQL + SIDES + """, d AS (SELECT DISTINCT game_id AS day FROM s), b AS (SELECT d.day, s.team, count(*) AS played, sum(CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END) AS points FROM d JOIN s ON s.game_id < d.day GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY day ORDER BY points DESC) AS k, min(played) OVER (PARTITION BY day) AS least, count(*) OVER (PARTITION BY day) AS n FROM b)
SELECT day, team, CAST(points AS BIGINT) AS points, CASE WHEN least < 2 OR n < 6 THEN 'too early' WHEN k + count(*) OVER (PARTITION BY day, k) - 1 <= 3 THEN 'in' WHEN k > 3 THEN 'out' ELSE 'unresolved' END AS cut FROM r"""
)
def top_cut_by_day(spark, sf_dir):
    """Who is in the upper half before each match day; a tie across the cut stays unresolved."""
    s = _sides(spark, sf_dir).withColumn("p", F.when(F.col("gf") > F.col("ga"), 3).when(F.col("gf") == F.col("ga"), 1).otherwise(0))
    by = Window.partitionBy("team").orderBy("game_id")
    run = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = s.agg(F.max("game_id").alias("last"))
    rec = s.select("team", F.col("game_id").alias("from"), F.lead("game_id").over(by).alias("next"), F.count("*").over(run).alias("played"), F.sum("p").over(run).alias("points")).join(F.broadcast(last))
    held = rec.where(F.col("from") + 1 <= F.coalesce("next", "last")).select("team", "played", "points", F.explode(F.sequence(F.col("from") + 1, F.coalesce("next", "last"))).alias("day"))
    held = held.join(s.select(F.col("game_id").alias("day")).distinct(), "day", "left_semi")
    day = Window.partitionBy("day")
    r = held.withColumn("k", F.rank().over(day.orderBy(F.desc("points")))).withColumn("least", F.min("played").over(day)).withColumn("n", F.count("*").over(day))
    peers = F.count("*").over(Window.partitionBy("day", "k"))
    cut = F.when((F.col("least") < 2) | (F.col("n") < 6), "too early").when(F.col("k") + peers - 1 <= 3, "in").when(F.col("k") > 3, "out").otherwise("unresolved")
    return r.select("day", "team", "points", cut.alias("cut"))


@query(
    neutral.SQL + """, r AS (SELECT game_id, team_id, row_number() OVER (PARTITION BY game_id ORDER BY CASE period WHEN '1H' THEN 1 ELSE 2 END, seconds, event_id) AS total, sum(1 - team_id) OVER (PARTITION BY game_id ORDER BY CASE period WHEN '1H' THEN 1 ELSE 2 END, seconds, event_id) AS h FROM actions WHERE goal),
e AS (SELECT game_id, total, h, total - h AS a FROM r UNION ALL SELECT game_id, total, h + 1, total - h - 1 FROM r WHERE (game_id + total) % 5 = 0 UNION ALL SELECT game_id, total, h, total - h FROM r WHERE total % 2 = 0),
d AS (SELECT game_id, total, min(h) AS h, min(a) AS a FROM e GROUP BY ALL HAVING count(DISTINCT h) = 1), l AS (SELECT *, lag(total, 1, 0) OVER w AS pt, lag(h, 1, 0) OVER w AS ph, lag(a, 1, 0) OVER w AS pa FROM d WINDOW w AS (PARTITION BY game_id ORDER BY total))
SELECT game_id, total, CAST(h AS BIGINT) AS home, CAST(a AS BIGINT) AS away, CASE WHEN total <> pt + 1 THEN 'unknown' WHEN h = ph + 1 AND a = pa THEN 'home' WHEN a = pa + 1 AND h = ph THEN 'away' ELSE 'unknown' END AS side FROM l"""
)
def goals_by_running_score(spark, sf_dir):
    """A goal timeline from score reports: one entry a total, contradictory totals dropped, the side from what changed."""
    order = Window.partitionBy("game_id").orderBy("period", "seconds", "event_id")
    r = neutral.actions(spark, sf_dir).where("goal").select("game_id", F.row_number().over(order).cast("long").alias("total"), F.sum(1 - F.col("team_id")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("h"))
    e = r.unionByName(r.where((F.col("game_id") + F.col("total")) % 5 == 0).withColumn("h", F.col("h") + 1)).unionByName(r.where("total % 2 = 0")).withColumn("a", F.col("total") - F.col("h"))
    d = e.groupBy("game_id", "total").agg(F.min("h").alias("home"), F.min("a").alias("away"), F.max("h").alias("most")).where("home = most").drop("most")
    w = Window.partitionBy("game_id").orderBy("total")
    pt, ph, pa = (F.lag(c, 1, 0).over(w) for c in ("total", "home", "away"))
    home, away = (F.col("home") == ph + 1) & (F.col("away") == pa), (F.col("away") == pa + 1) & (F.col("home") == ph)
    return d.select("game_id", "total", "home", "away", F.when(F.col("total") != pt + 1, "unknown").when(home, "home").when(away, "away").otherwise("unknown").alias("side"))


@query(neutral.SQL + SIDES + """, n AS (SELECT team, min(game_id) FILTER (WHERE game_id >= 12) AS upcoming, max(game_id) FILTER (WHERE game_id < 12) AS earlier, min(game_id) FILTER (WHERE game_id > 12) AS later FROM s GROUP BY team)
SELECT team, CAST(upcoming AS VARCHAR) AS upcoming, CAST(earlier AS VARCHAR) AS earlier, CAST(later AS VARCHAR) AS later FROM n""")
def nearest_match_days(spark, sf_dir):
    """Each club's next fixture from a day on, and its nearest match days before and after."""
    g = F.col("game_id")
    n = _sides(spark, sf_dir).groupBy("team").agg(F.min(F.when(g >= 12, g)).alias("upcoming"), F.max(F.when(g < 12, g)).alias("earlier"), F.min(F.when(g > 12, g)).alias("later"))
    return n.select("team", *[F.col(c).cast("string").alias(c) for c in ("upcoming", "earlier", "later")])


@query(neutral.SQL + """, m AS (SELECT unnest(range(1, 16)) AS mask), e AS (SELECT player_id, CASE position WHEN 'GK' THEN 1 WHEN 'DF' THEN 2 | CASE WHEN player_id % 3 = 0 THEN 4 ELSE 0 END WHEN 'MD' THEN 4 | CASE WHEN player_id % 5 = 0 THEN 8 ELSE 0 END ELSE 8 END AS slots FROM players WHERE position IS NOT NULL)
SELECT CAST(mask AS INTEGER) AS mask, count(*) FILTER (WHERE slots & mask <> 0) AS able, count(*) FILTER (WHERE slots & mask = slots) AS only_here FROM m, e GROUP BY mask""")
def slot_groups(spark, sf_dir):
    """For every group of slots: who can fill one of them, and who can fill nothing else.

    Players collapse to their slot sets first (at most 15), so the lattice meets counts and not players.
    """
    p = neutral.players(neutral.actions(spark, sf_dir)).where("position is not null")
    extra = lambda n, bit: F.when(F.col("player_id") % n == 0, bit).otherwise(0)
    slots = F.when(F.col("position") == "GK", 1).when(F.col("position") == "DF", 2 + extra(3, 4)).when(F.col("position") == "MD", 4 + extra(5, 8)).otherwise(8)
    kinds = p.groupBy(slots.alias("slots")).count().select("slots", "count", F.explode(F.sequence(F.lit(1), F.lit(15))).alias("mask"))
    met = F.col("slots").bitwiseAND(F.col("mask"))
    return kinds.groupBy("mask").agg(F.sum(F.when(met != 0, F.col("count")).otherwise(0)).alias("able"), F.sum(F.when(met == F.col("slots"), F.col("count")).otherwise(0)).alias("only_here"))


@query(neutral.SQL + RATES + " SELECT player_id, minutes, progression, chance_creation FROM rates JOIN players USING (player_id) WHERE minutes >= 90 AND position IS NOT NULL AND position <> 'GK' AND progression IS NOT NULL AND chance_creation IS NOT NULL")
def scatter(spark, sf_dir):
    """Two constructs of the same players, where both are point estimates."""
    from ..operators.constructs import components, rates

    a = gained(spark, sf_dir)
    r = rates(components(a), total_minutes(a)).join(neutral.players(a).select("player_id", "position"), "player_id")
    ok = (F.col("minutes") >= 90) & (F.col("position") != "GK") & F.col("progression").isNotNull() & F.col("chance_creation").isNotNull()
    return r.where(ok).select("player_id", "minutes", F.round("progression", 6).alias("progression"), F.round("chance_creation", 6).alias("chance_creation"))


@query(neutral.SQL + RATES + """, g AS (SELECT player_id, CASE WHEN position IS NULL THEN 3 WHEN position = 'GK' THEN 2 WHEN minutes < 90 THEN 1 ELSE 0 END AS grp, progression FROM rates JOIN players USING (player_id))
SELECT player_id, grp AS outcome, dense_rank() OVER (PARTITION BY grp ORDER BY progression DESC NULLS LAST) AS place, count(*) OVER (PARTITION BY grp, progression) AS tied FROM g""")
def transfer_listing(spark, sf_dir):
    """Candidates by outcome group, then by one declared key; ties share a place and missing values come last."""
    from ..operators.constructs import components, rates

    a = gained(spark, sf_dir)
    r = rates(components(a), total_minutes(a)).join(neutral.players(a).select("player_id", "position"), "player_id").withColumn("v", F.round("progression", 6))
    group = F.when(F.col("position").isNull(), 3).when(F.col("position") == "GK", 2).when(F.col("minutes") < 90, 1).otherwise(0)
    r = r.withColumn("outcome", group)
    place = F.dense_rank().over(Window.partitionBy("outcome").orderBy(F.desc_nulls_last("v"))).cast("long")
    return r.select("player_id", "outcome", place.alias("place"), F.count("*").over(Window.partitionBy("outcome", "v")).alias("tied"))
