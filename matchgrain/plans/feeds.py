"""Provider files written as the providers write them, and read back through the sources; and the text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.scalars import quantise, ratio
from ..operators.descriptors import ATTACKS
from ..sources import feeds, neutral, store
from . import teams
from .registry import query


def _t(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def provider_events(spark, sf_dir) -> str:
    """The first provider's event files."""
    a = neutral.actions(spark, sf_dir)
    point = lambda x, y: F.struct((F.col(x) * 100).alias("x"), (F.col(y) * 100).alias("y"))
    tag = lambda ok, n: F.when(ok, F.struct(F.lit(n).alias("id")))
    e = F.col("event_id")
    tags = F.filter(F.array(
        tag(F.col("success"), feeds.ACCURATE), tag(~F.col("success"), feeds.NOT_ACCURATE), tag(F.col("goal"), feeds.GOAL), tag(F.col("key_pass"), feeds.KEY_PASS), tag(F.col("dangerous_loss"), feeds.DANGEROUS_LOSS),
        tag(e % 3 == 0, 402), tag(e % 5 == 0, 401), tag(e % 3 == 0, 402), tag(e % 4 == 1, 2101), tag(e % 4 == 2, 1216),
    ), lambda x: x.isNotNull())
    out = a.select(
        e.alias("id"), F.initcap("type").alias("eventName"), F.lit("").alias("subEventName"), F.col("game_id").alias("matchId"), F.col("team_id").alias("teamId"), F.nullif(F.col("player_id"), F.lit(0)).alias("playerId"),
        F.col("period").alias("matchPeriod"), F.col("seconds").alias("eventSec"), F.when(e % 6 == 0, F.array(point("start_x", "start_y"))).otherwise(F.array(point("start_x", "start_y"), point("end_x", "end_y"))).alias("positions"), tags.alias("tags"),
    )
    path = store.workspace(spark)
    out.write.json(path)
    return path


@query(neutral.SQL + """ SELECT event_id, game_id, team_id, player_id, period, seconds, type, round(start_x, 6) AS start_x, round(CASE WHEN event_id % 6 = 0 THEN start_x ELSE end_x END, 6) AS end_x, round(CASE WHEN event_id % 6 = 0 THEN start_y ELSE end_y END, 6) AS end_y,
  CASE WHEN success IS NULL THEN 'unjudged' WHEN success THEN 'done' ELSE 'failed' END AS outcome, goal, key_pass, dangerous_loss FROM actions""")
def first_provider_events(spark, sf_dir):
    """Event files to neutral actions: flags from tags, a missing end copies the start, an unjudged action stays unjudged."""
    a = feeds.read_events(spark, provider_events(spark, sf_dir), lines=True)
    outcome = F.when(F.col("success").isNull(), "unjudged").when(F.col("success"), "done").otherwise("failed")
    return a.select("event_id", "game_id", "team_id", "player_id", "period", "seconds", "type", *[F.round(c, 6).alias(c) for c in ("start_x", "end_x", "end_y")], outcome.alias("outcome"), "goal", "key_pass", "dangerous_loss")


@query(neutral.SQL + """ SELECT event_id, CASE WHEN event_id % 15 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'right foot' WHEN event_id % 5 = 0 THEN 'left foot' END AS body_part, CASE WHEN event_id % 3 = 0 THEN 'right foot' WHEN event_id % 5 = 0 THEN 'left foot' END AS first_body_part,
  CASE WHEN type = 'shot' THEN CASE WHEN goal THEN 'goal' WHEN event_id % 4 = 1 THEN 'blocked' WHEN event_id % 4 = 2 THEN 'off target' ELSE 'on target' END END AS outcome,
  CAST(CASE WHEN success IS NULL THEN 0 ELSE 1 END + goal::INT + key_pass::INT + dangerous_loss::INT + (event_id % 3 = 0)::INT + (event_id % 5 = 0)::INT + (event_id % 4 IN (1, 2))::INT AS INTEGER) AS tags FROM actions""")
def event_tags(spark, sf_dir):
    """Nested tags flattened: distinct ids, the body part where only one is given, a shot's outcome by precedence."""
    raw = spark.read.schema(feeds.EVENTS).json(provider_events(spark, sf_dir))
    return feeds.tag_rows(raw).withColumn("tags", F.size("tags"))


def sheets(spark, sf_dir):
    """The first provider's match sheets: starters, a bench, and each team's first substitute for its last starter."""
    s = neutral.lineups(neutral.actions(spark, sf_dir))
    side = s.groupBy("game_id", "team_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("started"), F.struct(F.col("player_id").alias("playerId"))))).alias("lineup"), F.array_sort(F.collect_list(F.when(~F.col("started"), F.struct(F.col("player_id").alias("playerId"))))).alias("bench")
    )
    change = F.struct(F.col("bench")[0].playerId.alias("playerIn"), F.element_at("lineup", -1).playerId.alias("playerOut"), (50 + F.col("game_id") % 60).cast("int").alias("minute"))
    changes = F.when((F.size("lineup") > 0) & (F.size("bench") > 0), F.array(change)).otherwise(F.array().cast("array<struct<playerIn:bigint,playerOut:bigint,minute:int>>"))
    side = side.withColumn("value", F.struct(F.when(F.col("team_id") == 0, "home").otherwise("away").alias("side"), F.lit(0).alias("score"), F.struct("lineup", "bench", changes.alias("substitutions")).alias("formation")))
    out = side.groupBy(F.col("game_id").alias("wyId")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("team_id").cast("string"), "value"))).alias("teamsData"))
    path = store.workspace(spark)
    out.select("wyId", F.lit("2024-01-01").alias("dateutc"), F.lit(1).alias("gameweek"), F.lit("x").alias("label"), F.lit("Played").alias("status"), "teamsData").write.json(path)
    return feeds.read_sheets(spark, path, lines=True)


SHEET = """, li AS (SELECT game_id, team_id, max(player_id) FILTER (WHERE started) AS last_starter, min(player_id) FILTER (WHERE NOT started) AS sub FROM lineups GROUP BY ALL), ch AS (SELECT game_id, team_id, last_starter AS off_id, sub AS on_id, CAST(50 + game_id % 60 AS INTEGER) AS minute FROM li WHERE last_starter IS NOT NULL AND sub IS NOT NULL)"""


@query(neutral.SQL + SHEET + " SELECT l.game_id, l.team_id, player_id, TRUE AS started, coalesce(minute, 90) AS minutes FROM lineups l LEFT JOIN ch ON ch.game_id = l.game_id AND ch.team_id = l.team_id AND off_id = player_id WHERE l.started UNION ALL SELECT game_id, team_id, on_id, FALSE, greatest(0, 90 - minute) FROM ch")
def sheet_minutes(spark, sf_dir):
    """Minutes from line-ups and substitutions, with the provider's own arithmetic at the end of a match."""
    return feeds.minutes_played(sheets(spark, sf_dir))


@query(neutral.SQL + SHEET + " SELECT l.game_id, l.team_id, player_id, started, CAST(a.minute AS VARCHAR) AS \"on\", CAST(b.minute AS VARCHAR) AS off, FALSE AS contradiction FROM lineups l LEFT JOIN ch a ON a.game_id = l.game_id AND a.team_id = l.team_id AND a.on_id = player_id LEFT JOIN ch b ON b.game_id = l.game_id AND b.team_id = l.team_id AND b.off_id = player_id")
def match_squads(spark, sf_dir):
    return feeds.squads(sheets(spark, sf_dir)).withColumns({c: F.col(c).cast("string") for c in ("on", "off")})


@query(neutral.SQL + " SELECT DISTINCT game_id, 0 AS home_team_id, 1 AS away_team_id FROM lineups WHERE game_id IN (SELECT game_id FROM lineups WHERE team_id = 0) AND game_id IN (SELECT game_id FROM lineups WHERE team_id = 1)")
def match_sheet(spark, sf_dir):
    m = feeds.matches(sheets(spark, sf_dir)).where("home_team_id is not null and away_team_id is not null")
    return m.select("game_id", F.col("home_team_id").cast("int").alias("home_team_id"), F.col("away_team_id").cast("int").alias("away_team_id"))


def match_files(spark, sf_dir) -> str:
    """The second provider's files: a folder a match."""
    a = neutral.actions(spark, sf_dir)
    s = F.col("seconds").cast("long")
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    stamp = F.concat(pad(F.floor(s / 3600)), F.lit(":"), pad(F.floor(s / 60) % 60), F.lit(":"), pad(s % 60), F.lit(".250"))
    name = F.when(F.col("type") == "touch", "Carry").when(F.col("type") == "set_piece", "Foul Won").otherwise(F.initcap("type"))
    failed = F.when(~F.coalesce("success", F.lit(True)), F.struct(F.lit("Incomplete").alias("name")))
    out = a.select(
        F.col("game_id").alias("match"), F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("index"), F.when(F.col("period") == "1H", 1).otherwise(2).alias("period"), stamp.alias("timestamp"), F.struct(name.alias("name")).alias("type"),
        F.struct(F.col("team_id").alias("id")).alias("team"), F.when(F.col("player_id") > 0, F.struct(F.col("player_id").alias("id"))).alias("player"), F.array(F.col("start_x") * 120, F.col("start_y") * 80).alias("location"),
        F.when(F.col("type") == "pass", F.struct(F.array(F.col("end_x") * 120, F.col("end_y") * 80).alias("end_location"), failed.alias("outcome"))).alias("pass"), F.when(F.col("type") == "shot", F.struct(F.struct(F.when(F.col("goal"), "Goal").otherwise("Saved").alias("name")).alias("outcome"))).alias("shot"),
    )
    path = store.workspace(spark)
    out.repartition("match").write.partitionBy("match").json(path)
    return path


@query(neutral.SQL + """ SELECT game_id, event_id, CASE period WHEN '1H' THEN 1 ELSE 2 END AS period, CAST(seconds AS BIGINT) + 0.25::DOUBLE AS seconds, CASE type WHEN 'set_piece' THEN 'other' ELSE type END AS type, player_id, round(start_x, 6) AS start_x, round(CASE type WHEN 'pass' THEN end_y ELSE start_y END, 6) AS end_y,
  CASE WHEN type <> 'pass' THEN 'none' WHEN coalesce(success, TRUE) THEN 'done' ELSE 'failed' END AS outcome, goal FROM actions""")
def second_provider_events(spark, sf_dir):
    """Another provider's match files in the same neutral form: its own pitch, clock, types and outcomes."""
    a = feeds.read_match_files(spark, match_files(spark, sf_dir))
    outcome = F.when(F.col("success").isNull(), "none").when(F.col("success"), "done").otherwise("failed")
    return a.select("game_id", "event_id", "period", "seconds", "type", "player_id", F.round("start_x", 6).alias("start_x"), F.round("end_y", 6).alias("end_y"), outcome.alias("outcome"), "goal")


@query(neutral.SQL + " SELECT CASE type WHEN 'set_piece' THEN 'Foul Won' WHEN 'touch' THEN 'Carry' ELSE upper(type[1]) || type[2:] END AS name, count(*) AS n, count(DISTINCT game_id) AS matches FROM actions GROUP BY ALL")
def folder_vocabulary(spark, sf_dir):
    """Every type name in a provider's folder, how often and in how many files."""
    raw = spark.read.schema("type struct<name:string>").json(match_files(spark, sf_dir)).select("type.name", F.col("_metadata.file_path").alias("file"))
    return raw.groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("file").alias("matches"))


@query("SELECT c_custkey AS player_id, 'José ' || c_custkey AS name, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE strftime(DATE '1990-01-01' + CAST(c_custkey % 365 AS INTEGER), '%Y-%m-%d') END AS born, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS team_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'MD' END AS position FROM customer")
def provider_players(spark, sf_dir):
    """The players file: escapes decoded, and the word null is no value."""
    k = F.col("c_custkey")
    raw = _t(spark, sf_dir, "customer").select(
        k.alias("wyId"), F.lit("Jos\\u00e9").alias("firstName"), k.cast("string").alias("lastName"), F.when(k % 4 == 0, "null").otherwise(F.date_add(F.lit("1990-01-01").cast("date"), (k % 365).cast("int")).cast("string")).alias("birthDate"),
        F.when(k % 3 == 0, "null").otherwise(F.col("c_nationkey").cast("string")).alias("currentTeamId"), F.struct(F.when(k % 5 == 0, "").otherwise("MD").alias("code2")).alias("role"), F.lit("left").alias("foot"),
    )
    path = store.workspace(spark)
    raw.write.json(path)
    return feeds.read_players(spark, path).select("player_id", "name", F.col("born").cast("string").alias("born"), F.col("team_id").cast("string").alias("team_id"), "position")


@query(neutral.SQL + ", s AS (SELECT game_id, team_id, count(*) AS n, count(*) FILTER (WHERE type = 'shot') AS shots FROM actions GROUP BY ALL) SELECT game_id, team_id, 'share' AS name, round(100.0 * n / (n + 50), 3) AS value FROM s UNION ALL SELECT game_id, team_id, 'shots', CASE WHEN shots = 0 THEN NULL ELSE CAST(shots AS DOUBLE) END FROM s")
def live_statistics(spark, sf_dir):
    """Nested live reports flattened; a statistic that was not reported is missing, not zero."""
    s = neutral.actions(spark, sf_dir).groupBy("game_id", "team_id").agg(F.count("*").alias("n"), F.count_if(F.col("type") == "shot").alias("shots"))
    share = F.concat(F.round(100.0 * F.col("n") / (F.col("n") + 50), 3).cast("string"), F.lit("%"))
    one = lambda n, v: F.struct(F.col("team_id").alias("team"), F.lit(n).alias("name"), v.alias("value"))
    r = s.withColumn("s", F.array(one("share", share), one("shots", F.when(F.col("shots") > 0, F.col("shots").cast("string"))))).groupBy("game_id").agg(F.flatten(F.collect_list("s")).alias("statistics"))
    path = store.workspace(spark)
    r.select(F.struct(F.col("game_id").alias("id"), F.lit("FT").alias("status")).alias("fixture"), "statistics").write.json(path)
    return feeds.report_statistics(spark.read.schema(feeds.REPORT).json(path))


@query("SELECT p_partkey, array_to_string(list_filter([CASE WHEN regexp_matches(t, '\\bsmall\\b') THEN 'small' END, CASE WHEN regexp_matches(t, '\\bcold\\b') THEN 'cold' END], lambda x: x IS NOT NULL), ',') AS banned FROM (SELECT p_partkey, regexp_replace(lower(p_name), '\\bcold widget\\b', ' ', 'g') AS t FROM part)")
def banned_words(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.concat_ws(",", T.banned_words(F.col("p_name"), ["small", "cold"], ["cold widget"])).alias("banned"))


@query(neutral.SQL + ", g AS (SELECT game_id, count(*) FILTER (WHERE goal AND team_id = 0) AS h, count(*) FILTER (WHERE goal AND team_id = 1) AS a FROM actions GROUP BY game_id) SELECT game_id, h AS home, a AS away FROM g WHERE game_id % 4 <> 0")
def scores_from_labels(spark, sf_dir):
    g = neutral.actions(spark, sf_dir).groupBy("game_id").agg(F.count_if(F.col("goal") & (F.col("team_id") == 0)).alias("h"), F.count_if(F.col("goal") & (F.col("team_id") == 1)).alias("a"))
    label = F.when(F.col("game_id") % 4 == 0, "Home - Away, postponed").otherwise(F.concat(F.lit("Home - Away, "), "h", F.lit(" - "), "a"))
    return g.select("game_id", T.score_of(label).alias("s")).where("s is not null").select("game_id", "s.home", "s.away")


@query("SELECT p_partkey, CASE WHEN x = 0 THEN 0.0 ELSE round(floor(x / u + 0.5) * u, 6) END AS honest FROM (SELECT p_partkey, x, pow(10.0, CASE WHEN floor(x / pow(10.0, floor(log10(x)))) = 1 THEN floor(log10(x)) - 1 ELSE floor(log10(x)) END) AS u FROM (SELECT p_partkey, p_retailprice AS x FROM part))")
def honest_numbers(spark, sf_dir):
    return _t(spark, sf_dir, "part").select("p_partkey", F.round(T.honest(F.col("p_retailprice")), 6).alias("honest"))


@query("SELECT o_orderkey, date_diff('year', b, d) - CASE WHEN (month(d), day(d)) < (month(b), day(b)) THEN 1 ELSE 0 END AS age, year(d) - CASE WHEN month(d) < 7 THEN 1 ELSE 0 END AS season, strftime(date_trunc('week', d), '%Y-%m-%d') AS week FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, DATE '1970-01-01' + CAST(o_custkey % 3000 AS INTEGER) AS b FROM orders)")
def ages_and_seasons(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"), F.date_add(F.lit("1970-01-01").cast("date"), (F.col("o_custkey") % 3000).cast("int")).alias("b"))
    return o.select("o_orderkey", T.age(F.col("b"), F.col("d")).cast("long").alias("age"), T.season(F.col("d")).cast("long").alias("season"), F.date_format(F.date_trunc("week", "d"), "yyyy-MM-dd").alias("week"))


@query(neutral.SQL + " SELECT event_id, CASE event_id % 3 WHEN 0 THEN CAST(seconds AS BIGINT) + 0.5::DOUBLE WHEN 1 THEN CAST(CAST(seconds AS BIGINT) % 3600 AS DOUBLE) END AS seconds FROM actions")
def clock_readings(spark, sf_dir):
    """Clock strings of two forms; others are unknown."""
    s, e = F.col("seconds").cast("long"), F.col("event_id")
    pad = lambda x: F.lpad(x.cast("string"), 2, "0")
    m = F.floor(s / 60) % 60
    stamp = F.when(e % 3 == 0, F.concat(pad(F.floor(s / 3600)), F.lit(":"), pad(m), F.lit(":"), pad(s % 60), F.lit(".500"))).when(e % 3 == 1, F.concat(pad(m), F.lit(":"), pad(s % 60))).otherwise("half time")
    return neutral.actions(spark, sf_dir).select("event_id", T.clock(stamp).alias("seconds"))


@query(neutral.SQL + """, c AS (SELECT game_id, count(*) FILTER (WHERE type = 'pass') + 1.0 AS a, count(*) FILTER (WHERE type = 'touch') + 1.0 AS b, count(*) FILTER (WHERE type = 'shot') + 1.0 AS c FROM actions GROUP BY game_id)
SELECT game_id, round((ln(a) - ln(b)) / sqrt(2), 6) + 0.0 AS first, round((ln(a) + ln(b) - 2 * ln(c)) / sqrt(6), 6) + 0.0 AS second, round(sqrt(1 / a + 1 / b + 1 / c), 6) AS error FROM c""")
def log_ratio_coordinates(spark, sf_dir):
    """A composition of three counts as isometric log-ratios, with the error that independent counts give."""
    n = lambda t: (F.count_if(F.col("type") == t) + 1.0).alias(t)
    c = neutral.actions(spark, sf_dir).groupBy("game_id").agg(n("pass"), n("touch"), n("shot"))
    first, second = T.log_ratios([F.col("pass"), F.col("touch"), F.col("shot")])
    error = T.combined_error(*[1 / F.sqrt(x) for x in ("pass", "touch", "shot")])
    return c.select("game_id", (F.round(first, 6) + 0.0).alias("first"), (F.round(second, 6) + 0.0).alias("second"), F.round(error, 6).alias("error"))


@query(neutral.SQL + """, p AS (SELECT player_id, count(*) FILTER (WHERE type = 'pass') AS n, count(*) AS d FROM actions WHERE player_id <> 0 GROUP BY player_id) SELECT player_id, CAST(round_even(n / d / 0.3 * 100, 0) AS BIGINT) AS quanta,
  CASE WHEN round(n / d - 0.3, 9) >= 0.14 THEN 'far above' WHEN round(n / d - 0.3, 9) >= 0.05 THEN 'above' WHEN round(n / d - 0.3, 9) > -0.05 THEN 'about' WHEN round(n / d - 0.3, 9) > -0.14 THEN 'below' ELSE 'far below' END AS band,
  CASE WHEN n % 100 BETWEEN 11 AND 13 THEN n || 'th' WHEN n % 10 = 1 THEN n || 'st' WHEN n % 10 = 2 THEN n || 'nd' WHEN n % 10 = 3 THEN n || 'rd' ELSE n || 'th' END AS spoken FROM p""")
def style_bands(spark, sf_dir):
    """Shares in whole hundredths of a reference, in words, and spoken as an ordinal."""
    p = neutral.actions(spark, sf_dir).where("player_id <> 0").groupBy("player_id").agg(F.count_if(F.col("type") == "pass").alias("n"), F.count("*").alias("d"))
    share = ratio(F.col("n"), F.col("d"))
    return p.select("player_id", quantise(share, F.lit(0.3)).alias("quanta"), T.band(share, 0.3).alias("band"), T.ordinal(F.col("n")).alias("spoken"))


@query("SELECT o_orderkey, sha256(o_custkey || '|' || o_orderstatus || '|' || o_orderpriority) AS fingerprint FROM orders")
def row_fingerprints(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select("o_orderkey", T.fingerprint(F.col("o_custkey").cast("string"), "o_orderstatus", "o_orderpriority").alias("fingerprint"))


@query(neutral.SQL + """ SELECT event_id, round(sqrt(pow((1 - start_x) * 105, 2) + pow((start_y - 0.5) * 68, 2)), 6) AS distance, round(CASE WHEN a < 0 THEN a + pi() ELSE a END, 6) AS angle, start_x >= 1 - 16.5 / 105 AND abs(start_y - 0.5) <= 20.16 / 68 AS inside
FROM (SELECT *, atan2(7.32 * (1 - start_x) * 105, pow((1 - start_x) * 105, 2) + pow((start_y - 0.5) * 68, 2) - pow(7.32 / 2, 2)) AS a FROM actions WHERE type = 'shot')""")
def shot_geometry(spark, sf_dir):
    """Distance to the goal, the angle its mouth fills, and whether the shot comes from inside the penalty area."""
    x, y = (1 - F.col("start_x")) * 105, (F.col("start_y") - 0.5) * 68
    a = F.atan2(7.32 * x, x * x + y * y - (7.32 / 2) ** 2)
    inside = (F.col("start_x") >= 1 - 16.5 / 105) & (F.abs(F.col("start_y") - 0.5) <= 20.16 / 68)
    return neutral.actions(spark, sf_dir).where("type = 'shot'").select("event_id", F.round(F.sqrt(x * x + y * y), 6).alias("distance"), F.round(F.when(a < 0, a + F.pi()).otherwise(a), 6).alias("angle"), inside.alias("inside"))


@query(neutral.SQL + """, m AS (SELECT player_id, type, count(*) AS n FROM actions WHERE player_id <> 0 GROUP BY ALL), p AS (SELECT DISTINCT player_id FROM m)
SELECT player_id, k AS metric, CAST(n AS DOUBLE) AS value FROM p CROSS JOIN (SELECT unnest(['pass', 'shot', 'tackle']) AS k) LEFT JOIN (SELECT player_id, type AS k, n FROM m) USING (player_id, k)""")
def named_values(spark, sf_dir):
    """Values by name: a metric that a player has no value for is missing, never zero."""
    m = neutral.actions(spark, sf_dir).where("player_id <> 0").groupBy("player_id", "type").count()
    v = m.groupBy("player_id").agg(F.map_from_entries(F.collect_list(F.struct("type", "count"))).alias("values"))
    v = v.withColumn("metric", F.explode(F.array(*map(F.lit, ("pass", "shot", "tackle")))))
    return v.select("player_id", "metric", F.try_element_at("values", F.col("metric")).cast("double").alias("value"))


@query(neutral.SQL + teams.ROWS + f" SELECT '{ATTACKS.events.words}' AS events, '{', '.join(ATTACKS.names)}' AS parts, CAST(sum(n_left + n_right + n_centre) AS BIGINT) AS counted, CAST(sum(dropped) AS BIGINT) AS dropped FROM r")
def descriptor_sentence(spark, sf_dir):
    """What the team descriptor counts, in its own words, and how many actions that are."""
    n = teams.rows(spark, sf_dir).agg(F.sum(sum((F.col(f"n_{p}") for p in teams.PARTS), F.lit(0))).alias("counted"), F.sum("dropped").alias("dropped"))
    return n.select(F.lit(ATTACKS.events.words).alias("events"), F.lit(", ".join(ATTACKS.names)).alias("parts"), "counted", "dropped")


@query(neutral.SQL + " SELECT l.game_id, l.team_id, l.player_id, 'Player ' || l.player_id AS name, CAST(minutes AS BIGINT) AS minutes FROM lineups l")
def roster_tables(spark, sf_dir):
    """A team's roster page, one HTML table, back to rows."""
    s = neutral.lineups(neutral.actions(spark, sf_dir))
    row = F.concat(F.lit("<tr class=r><td>"), F.col("player_id"), F.lit("</td>\n<TD><a href='#'>Player "), F.col("player_id"), F.lit("</a> </td><td><b>"), F.col("minutes"), F.lit("</b></td></tr>"))
    page = s.groupBy("game_id", "team_id").agg(F.concat(F.lit("<table><tr><th>Id</th><th>Name</th></tr>"), F.array_join(F.collect_list(row), ""), F.lit("</table>")).alias("html"))
    r = page.select("game_id", "team_id", F.explode(T.table_rows(F.col("html"))).alias("c"))
    return r.select("game_id", "team_id", F.col("c")[0].cast("long").alias("player_id"), F.col("c")[1].alias("name"), F.col("c")[2].cast("long").alias("minutes"))


@query("SELECT p_partkey, round(CASE WHEN x = 0 THEN 0 ELSE sign(x) * sqrt(sqrt(pow(2 / (3.141592653589793 * 0.147) + ln(1 - x * x) / 2, 2) - ln(1 - x * x) / 0.147) - (2 / (3.141592653589793 * 0.147) + ln(1 - x * x) / 2)) END, 6) + 0.0 AS z FROM (SELECT p_partkey, CAST(p_partkey % 199 - 99 AS DOUBLE) / 100 AS x FROM part)")
def normal_scores(spark, sf_dir):
    """Shares to standard scores by the inverse error function."""
    x = (F.col("p_partkey") % 199 - 99).cast("double") / 100
    return _t(spark, sf_dir, "part").select("p_partkey", (F.round(T.inverse_erf(x), 6) + 0.0).alias("z"))


@query(neutral.SQL + """, m AS (SELECT player_id, sum(minutes) AS minutes FROM lineups GROUP BY player_id), v AS (SELECT player_id, count(*) FILTER (WHERE type = 'pass' AND success IS NOT NULL) AS judged, count(*) FILTER (WHERE type = 'pass' AND success) AS done FROM actions GROUP BY player_id),
s AS (SELECT unnest(['left back', 'centre', 'wing']) AS slot), c AS (SELECT p.player_id, slot, CASE WHEN coalesce(minutes, 0) <= 0 THEN 'no minutes' WHEN position IS NULL OR position = 'GK' THEN 'position' WHEN NOT (CASE slot WHEN 'left back' THEN position = 'DF' WHEN 'centre' THEN position IN ('DF', 'MD') ELSE position IN ('MD', 'FW') END) THEN 'slot' WHEN coalesce(judged, 0) = 0 THEN 'not measured' ELSE 'eligible' END AS status
  FROM players p LEFT JOIN m USING (player_id) LEFT JOIN v USING (player_id), s) SELECT player_id, slot, status FROM c""")
def eligible_assignments(spark, sf_dir):
    """Who may stand where: minutes, position, slot, and a value for every active metric; the first that fails is named."""
    a = neutral.actions(spark, sf_dir)
    p = neutral.players(a).select("player_id", "position").join(neutral.lineups(a).groupBy("player_id").agg(F.sum("minutes").alias("minutes")), "player_id", "left")
    p = p.join(a.groupBy("player_id").agg(F.count_if((F.col("type") == "pass") & F.col("success").isNotNull()).alias("judged")), "player_id", "left")
    slots = {"left back": ("DF",), "centre": ("DF", "MD"), "wing": ("MD", "FW")}
    p = p.withColumn("s", F.explode(F.array(*[F.struct(F.lit(n).alias("slot"), F.array(*map(F.lit, at)).alias("at")) for n, at in slots.items()])))
    status = F.when(F.coalesce("minutes", F.lit(0)) <= 0, "no minutes").when(F.col("position").isNull() | (F.col("position") == "GK"), "position").when(~F.array_contains("s.at", F.col("position")), "slot")
    return p.select("player_id", F.col("s.slot").alias("slot"), status.when(F.coalesce("judged", F.lit(0)) == 0, "not measured").otherwise("eligible").alias("status"))
