"""Two sources of the same people, fixtures, sheets and events brought together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tokens
from ..operators.identity import match_fixtures, pair_sheets, resolve, tiered_links
from ..operators.pairing import clock_offsets, derangement, pair_events
from ..sources import neutral
from .registry import query

_TOK = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda x: length(x) > 1))"
PEOPLE = f"""WITH a AS (SELECT c_custkey AS id, 'f' || (c_custkey % 23) || ' l' || (c_custkey % 101) || ' n' || (c_custkey % 7) AS name, DATE '1990-01-01' + CAST(c_custkey % 365 AS INTEGER) AS born,
  c_custkey % 5 AS team, c_nationkey AS country, c_custkey % 30 AS shirt, CASE WHEN c_custkey % 2 = 0 THEN 'L' || (c_custkey % 101) || ' F' || (c_custkey % 23) END AS known_as FROM customer),
b AS (SELECT id + 1000000 AS id, CASE id % 4 WHEN 0 THEN 'L' || (id % 101) || ', F' || (id % 23) WHEN 1 THEN upper(name) WHEN 2 THEN 'n' || (id % 7) ELSE 'zz' || id || ' yy' END AS name,
  CASE WHEN id % 5 = 0 THEN NULL WHEN id % 11 = 0 THEN born + 1 ELSE born END AS born, team, country, shirt FROM a WHERE id % 3 <> 0),
l AS (SELECT *, {_TOK.format('name')} AS t, {_TOK.format("coalesce(known_as, '')")} AS k FROM a), r AS (SELECT *, {_TOK.format('name')} AS t FROM b)"""


def named(df: DataFrame, *cols: str) -> DataFrame:
    """Ids that may be missing, as text."""
    return df.withColumns({c: F.col(c).cast("string") for c in cols or ("other",)})


def people(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers as one provider knows them, and another provider's spelling of two thirds of them."""
    k = F.col("c_custkey")
    part = lambda c, n: F.concat(F.lit(c), k % n)
    a = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        k.alias("id"), F.concat_ws(" ", part("f", 23), part("l", 101), part("n", 7)).alias("name"), F.date_add(F.lit("1990-01-01").cast("date"), (k % 365).cast("int")).alias("born"),
        (k % 5).alias("team"), F.col("c_nationkey").alias("country"), (k % 30).alias("shirt"), F.when(k % 2 == 0, F.concat_ws(" ", part("L", 101), part("F", 23))).alias("known_as"),
    )
    k = F.col("id")
    name = F.when(k % 4 == 0, F.concat_ws(", ", part("L", 101), part("F", 23))).when(k % 4 == 1, F.upper("name")).when(k % 4 == 2, part("n", 7)).otherwise(F.concat(F.lit("zz"), k, F.lit(" yy")))
    born = F.when(k % 5 == 0, None).when(k % 11 == 0, F.date_add("born", 1)).otherwise(F.col("born"))
    b = a.where(k % 3 != 0).select(name.alias("name"), born.alias("born"), "team", "country", "shirt", (k + 1_000_000).alias("id"))
    return a, b


@query(
    PEOPLE + """, s AS (SELECT l.id, r.id AS other, len(list_intersect(l.t, r.t)) AS i, len(l.t) AS n, len(r.t) AS m, coalesce(l.born = r.born, FALSE) AS same, l.team = r.team AS st, l.country = r.country AS sc, l.shirt = r.shirt AS ss FROM l, r),
v AS (SELECT *, CASE WHEN n = 0 OR m = 0 THEN 0.0 ELSE i / (n + m - i) END AS o FROM s),
w AS (SELECT id, other, round(CASE WHEN same THEN CASE WHEN o >= 0.999 THEN 1.0 WHEN o > 0 THEN 0.95 ELSE 0.80 END WHEN least(n, m) = 0 OR (least(n, m) = 1 AND n <> m AND i = least(n, m)) THEN 0.30
  ELSE least(0.6 * o + CASE WHEN st THEN 0.15 ELSE 0 END + CASE WHEN sc THEN 0.08 ELSE 0 END + CASE WHEN ss THEN 0.05 ELSE 0 END, 0.89) END, 6) AS score FROM v),
q AS (SELECT *, coalesce(lead(score) OVER o, 0) AS nxt, row_number() OVER o AS k FROM w WHERE score >= 0.72 WINDOW o AS (PARTITION BY id ORDER BY score DESC, other)),
f AS (SELECT id, other, score, CASE WHEN score >= 0.999 THEN CASE WHEN nxt >= 0.999 THEN 'ambiguous' ELSE 'exact' END WHEN score >= 0.9 AND round(score - nxt, 6) < 0.05 THEN 'ambiguous' WHEN score >= 0.9 THEN 'high confidence' ELSE 'ambiguous' END AS status FROM q WHERE k = 1)
SELECT l.id, CAST(CASE WHEN status IN ('exact', 'high confidence') THEN other END AS VARCHAR) AS other, CAST(score AS DOUBLE) AS score, coalesce(status, 'unresolved') AS status FROM l LEFT JOIN f USING (id)"""
)
def identity_links(spark, sf_dir):
    """Every person of one provider against the other's, scored on birth date, name and context."""
    a, b = people(spark, sf_dir)
    return named(resolve(a, b))


TIERS = """, c AS (SELECT l.id, r.id AS other, CASE WHEN len(l.t) >= 2 AND list_sort(l.t) = list_sort(r.t) THEN 0 WHEN len(l.k) >= 2 AND list_sort(l.k) = list_sort(r.t) THEN 1
  WHEN least(len(l.t), len(r.t)) >= 2 AND len(l.t) <> len(r.t) AND len(list_intersect(l.t, r.t)) = least(len(l.t), len(r.t)) THEN 2 END AS n FROM l JOIN r ON l.country = r.country{hide}),
d AS (SELECT id, n, count(*) AS c, min(other) AS other FROM c WHERE n IS NOT NULL GROUP BY ALL), e AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY n) = 1),
g AS (SELECT id, n, CASE WHEN c = 1 THEN other END AS other, c FROM e), h AS (SELECT *, count(*) FILTER (WHERE c = 1) OVER (PARTITION BY other) AS claims FROM g),
o AS (SELECT l.id, h.other, ['A', 'N', 'B'][n + 1] AS tier, CASE WHEN h.id IS NULL THEN 'no candidate' WHEN c > 1 THEN 'ambiguous' WHEN claims > 1 THEN 'claimed twice' ELSE 'linked' END AS outcome FROM l LEFT JOIN h USING (id))"""


@query(PEOPLE + TIERS.format(hide="") + " SELECT id, CAST(other AS VARCHAR) AS other, tier, outcome FROM o")
def name_links(spark, sf_dir):
    """Links by name and country in tiers; the first tier with a candidate decides."""
    a, b = people(spark, sf_dir)
    return named(tiered_links(a.withColumn("hidden", F.lit(None).cast("long")), b))


GRADE = "CASE WHEN outcome <> 'linked' THEN 'NO_LINK' WHEN id % 3 = 0 THEN 'UNVERIFIABLE' WHEN other = id + 1000000 THEN 'CORRECT' ELSE 'FALSE' END"


@query(
    PEOPLE + TIERS.format(hide="") + f", p AS (SELECT 'all' AS world, {GRADE} AS grade, count(*) AS n FROM o GROUP BY ALL) SELECT * FROM p UNION ALL SELECT * FROM ({PEOPLE} "
    + TIERS.format(hide=" AND r.id <> l.id + 1000000") + f" SELECT 'partner absent' AS world, {GRADE} AS grade, count(*) AS n FROM o GROUP BY ALL)"
)
def graded_links(spark, sf_dir):
    """The links held against the truth, and again with everybody's true partner hidden: then every link is false."""
    a, b = people(spark, sf_dir)
    linked, truth = F.col("outcome") == "linked", F.col("id") + 1_000_000
    grade = F.when(~linked, "NO_LINK").when(F.col("id") % 3 == 0, "UNVERIFIABLE").when(F.col("other") == truth, "CORRECT").otherwise("FALSE")
    worlds = {"all": a.withColumn("hidden", F.lit(None).cast("long")), "partner absent": a.withColumn("hidden", truth)}
    parts = [tiered_links(left, b).select(F.lit(w).alias("world"), grade.alias("grade")) for w, left in worlds.items()]
    return parts[0].unionByName(parts[1]).groupBy("world", "grade").agg(F.count("*").alias("n"))


FIXTURES = f""", g AS (SELECT game_id AS g, CAST(count(*) FILTER (WHERE goal AND team_id = 0) AS BIGINT) AS h, CAST(count(*) FILTER (WHERE goal AND team_id = 1) AS BIGINT) AS a FROM actions GROUP BY game_id),
fl AS (SELECT g AS id, g AS day, {_TOK.format("'City' || (g % 6) || ' Club'")} AS home, {_TOK.format("'City' || ((g * 5 + 1) % 6) || ' Club'")} AS away, h AS hg, a AS ag FROM g),
fr AS (SELECT g + 1000 AS id, g + g % 3 - 1 AS day, {_TOK.format("'city' || CASE WHEN g % 5 = 0 THEN (g * 5 + 1) % 6 ELSE g % 6 END || ' fc'")} AS home, {_TOK.format("'city' || CASE WHEN g % 5 = 0 THEN g % 6 ELSE (g * 5 + 1) % 6 END || ' fc'")} AS away,
  CASE WHEN g % 5 = 0 THEN a ELSE h END + CASE WHEN g % 11 = 5 THEN 1 ELSE 0 END AS hg, CASE WHEN g % 5 = 0 THEN h ELSE a END AS ag FROM g WHERE g % 7 <> 3)"""


def _fixtures(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    g = neutral.actions(spark, sf_dir).groupBy(F.col("game_id").alias("g")).agg(F.count_if(F.col("goal") & (F.col("team_id") == 0)).alias("h"), F.count_if(F.col("goal") & (F.col("team_id") == 1)).alias("a"))
    k = F.col("g")
    home, away, turned = k % 6, (k * 5 + 1) % 6, k % 5 == 0
    name = lambda a, n, b: tokens(F.concat(F.lit(a), n, F.lit(b)))
    left = g.select(k.alias("id"), k.alias("day"), name("City", home, " Club").alias("home"), name("City", away, " Club").alias("away"), F.col("h").alias("hg"), F.col("a").alias("ag"))
    right = g.where(k % 7 != 3).select(
        (k + 1000).alias("id"), (k + k % 3 - 1).alias("day"), name("city", F.when(turned, away).otherwise(home), " fc").alias("home"), name("city", F.when(turned, home).otherwise(away), " fc").alias("away"),
        (F.when(turned, F.col("a")).otherwise(F.col("h")) + F.when(k % 11 == 5, 1).otherwise(0)).alias("hg"), F.when(turned, F.col("h")).otherwise(F.col("a")).alias("ag"),
    )
    return left, right


_J = "coalesce(len(list_intersect({0}, {1})) / nullif(len({0}) + len({1}) - len(list_intersect({0}, {1})), 0), 0)"


@query(
    neutral.SQL + FIXTURES + f""", m AS (SELECT l.id, r.id AS other, least({_J.format('l.home', 'r.home')}, {_J.format('l.away', 'r.away')}) AS s, least({_J.format('l.home', 'r.away')}, {_J.format('l.away', 'r.home')}) AS c, l.hg, l.ag, r.hg AS ohg, r.ag AS oag
  FROM fl l JOIN fr r ON abs(l.day - r.day) <= 1), q AS (SELECT *, count(*) OVER (PARTITION BY other) AS claims, count(*) OVER (PARTITION BY id) AS n FROM m WHERE s <> c AND greatest(s, c) > 0.3),
d AS (SELECT DISTINCT ON (id) * FROM q ORDER BY id, other), z AS (SELECT fl.id, d.other, CAST(c > s AS INTEGER) AS swapped, CASE WHEN n IS NULL THEN 'no candidate' WHEN n > 1 THEN 'ambiguous' WHEN claims > 1 THEN 'claimed twice'
  WHEN NOT (CASE WHEN c > s THEN d.hg = oag AND d.ag = ohg ELSE d.hg = ohg AND d.ag = oag END) THEN 'goals disagree' ELSE 'linked' END AS outcome FROM fl LEFT JOIN d USING (id))
SELECT id, CAST(CASE WHEN outcome = 'linked' THEN other END AS VARCHAR) AS other, CAST(CASE WHEN outcome = 'linked' THEN swapped END AS VARCHAR) AS swapped, outcome FROM z"""
)
def fixture_links(spark, sf_dir):
    """Fixtures of two sources within a day of each other, by team names in either orientation, then by the score."""
    return named(match_fixtures(*_fixtures(spark, sf_dir), 1, 0.3), "other", "swapped")


SHEETS = f""", sl AS (SELECT game_id, team_id, player_id AS id, {_TOK.format("'p' || (player_id % 13) || ' q' || (player_id % 5)")} AS t FROM lineups),
sr AS (SELECT game_id, team_id, player_id + 5000 AS other, {_TOK.format("'p' || (player_id % 13) || ' r' || (player_id % 3)")} AS u FROM lineups WHERE player_id % 6 <> 0)"""


@query(
    neutral.SQL + SHEETS + f""", m AS (SELECT game_id, team_id, id, other, {_J.format('t', 'u')} AS o FROM sl JOIN sr USING (game_id, team_id) WHERE len(list_intersect(t, u)) > 0),
x AS (SELECT * FROM m QUALIFY o = max(o) OVER (PARTITION BY game_id, team_id, id)), y AS (SELECT * FROM m QUALIFY o = max(o) OVER (PARTITION BY game_id, team_id, other)),
xx AS (SELECT * FROM x QUALIFY count(*) OVER (PARTITION BY game_id, team_id, id) = 1), yy AS (SELECT * FROM y QUALIFY count(*) OVER (PARTITION BY game_id, team_id, other) = 1),
nm AS (SELECT game_id, team_id, id, other FROM xx JOIN yy USING (game_id, team_id, id, other)),
ra AS (SELECT game_id, team_id, min(id) AS id FROM sl ANTI JOIN nm USING (game_id, team_id, id) GROUP BY ALL HAVING count(*) = 1), rb AS (SELECT game_id, team_id, min(other) AS other FROM sr ANTI JOIN nm USING (game_id, team_id, other) GROUP BY ALL HAVING count(*) = 1),
f AS (SELECT *, 'name' AS how FROM nm UNION ALL SELECT game_id, team_id, id, other, 'elimination' FROM ra JOIN rb USING (game_id, team_id)) SELECT game_id, team_id, id, CAST(other AS VARCHAR) AS other, coalesce(how, 'open') AS how FROM sl LEFT JOIN f USING (game_id, team_id, id)"""
)
def sheet_links(spark, sf_dir):
    """Two versions of each team sheet: by names, then by elimination."""
    s = neutral.lineups(neutral.actions(spark, sf_dir))
    p = F.col("player_id")
    t = lambda c, n: tokens(F.concat(F.lit("p"), p % 13, F.lit(f" {c}"), p % n))
    return named(pair_sheets(s.select("game_id", "team_id", p.alias("id"), t("q", 5).alias("t")), s.where(p % 6 != 0).select("game_id", "team_id", (p + 5000).alias("id"), t("r", 3).alias("t")), ["game_id", "team_id"]))


def streams(spark, sf_dir, shift) -> tuple[DataFrame, DataFrame]:
    a = neutral.actions(spark, sf_dir).where("type = 'pass'").select("game_id", "period", "team_id", "seconds", "event_id", "start_x", "start_y")
    return a, a.where("event_id % 5 <> 0").withColumn("seconds", F.col("seconds") + shift).withColumn("event_id", F.col("event_id") + 10_000_000)


@query(
    neutral.SQL + """, pa AS (SELECT game_id, period, team_id, seconds, event_id, start_x, start_y FROM actions WHERE type = 'pass'), pb AS (SELECT game_id, period, team_id, seconds + event_id % 3 AS seconds, event_id + 10000000 AS event_id, start_x, start_y FROM pa WHERE event_id % 5 <> 0),
pr AS (SELECT pa.game_id, pa.period, pa.team_id, pa.event_id AS a, pb.event_id AS b, abs(pa.seconds - pb.seconds) AS gap, sqrt(pow(pa.start_x - pb.start_x, 2) + pow(pa.start_y - pb.start_y, 2)) AS distance FROM pa JOIN pb ON pb.game_id = pa.game_id AND pb.period = pa.period AND pb.team_id = pa.team_id AND abs(pa.seconds - pb.seconds) <= 5),
gl AS (SELECT list({'a': a, 'b': b, 'gap': gap, 'la': [a], 'lb': [b], 'kept': [{'a': a, 'b': b, 'gap': gap}]} ORDER BY gap, distance, a, b) AS l FROM pr GROUP BY game_id, period, team_id),
fd AS (SELECT list_reduce(l, lambda d, p: CASE WHEN list_contains(d.la, p.a) OR list_contains(d.lb, p.b) THEN d ELSE {'a': p.a, 'b': p.b, 'gap': p.gap, 'la': list_append(d.la, p.a), 'lb': list_append(d.lb, p.b), 'kept': list_append(d.kept, {'a': p.a, 'b': p.b, 'gap': p.gap})} END).kept AS kept FROM gl)
SELECT k.a AS a, k.b AS b, k.gap AS gap FROM (SELECT unnest(kept) AS k FROM fd)"""
)
def paired_events(spark, sf_dir):
    """Two providers' events of one match matched one to one in time, nearest first."""
    return pair_events(*streams(spark, sf_dir, F.col("event_id") % 3), ["game_id", "period", "team_id"], 5.0)


@query(
    neutral.SQL + """, pa AS (SELECT game_id, period, team_id, seconds, event_id FROM actions WHERE type = 'pass'), pb AS (SELECT game_id, period, team_id, seconds + (game_id % 3 - 1) * 10 AS seconds FROM pa WHERE event_id % 5 <> 0),
gr AS (SELECT unnest([-20.0, -15.0, -10.0, -5.0, 0.0, 5.0, 10.0, 15.0, 20.0])::DOUBLE AS "offset"), hit AS (SELECT game_id, period, "offset", count(*) AS hits FROM pa, gr
  WHERE EXISTS (SELECT 1 FROM pb WHERE pb.game_id = pa.game_id AND pb.period = pa.period AND pb.team_id = pa.team_id AND abs(pa.seconds + "offset" - pb.seconds) <= 2) GROUP BY ALL),
k AS (SELECT DISTINCT game_id, period FROM pa), best AS (SELECT DISTINCT ON (game_id, period) * FROM hit ORDER BY game_id, period, hits DESC, abs("offset"), "offset")
SELECT game_id, period, coalesce("offset", 0.0) AS "offset", CAST(coalesce(hits, 0) AS BIGINT) AS hits FROM k LEFT JOIN best USING (game_id, period)"""
)
def clock_alignment(spark, sf_dir):
    """The offset between two providers' clocks in each half of each match."""
    return clock_offsets(*streams(spark, sf_dir, (F.col("game_id") % 3 - 1) * 10), ["game_id", "period"], "team_id", range(-20, 21, 5), 2.0)


@query("SELECT c_custkey, c_nationkey, CASE WHEN count(*) OVER e > 1 THEN coalesce(lead(c_custkey) OVER w, first_value(c_custkey) OVER w) END AS partner FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY (c_custkey * 7919 + 13) % 10007, c_custkey), e AS (PARTITION BY c_nationkey)")
def permuted_partners(spark, sf_dir):
    """Everybody's stand-in from their own stratum, never themselves."""
    return derangement(spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", "c_nationkey", (F.col("c_custkey") * 7919 + 13) % 10007)


@query(neutral.SQL + " SELECT a.game_id, a.player_id, count(*) AS actions FROM actions a JOIN lineups USING (game_id, player_id) WHERE a.team_id = lineups.team_id AND started GROUP BY ALL")
def own_club_actions(spark, sf_dir):
    """A starter's actions, counted only for the club whose sheet lists the player."""
    a = neutral.actions(spark, sf_dir)
    sheet = neutral.lineups(a).where("started").select("game_id", "player_id", F.col("team_id").alias("club"))
    return a.join(sheet, ["game_id", "player_id"]).where("team_id = club").groupBy("game_id", "player_id").agg(F.count("*").alias("actions"))


SIGNATURES = """, sc AS (SELECT DISTINCT game_id // 3 AS round, 'home' AS side, 'team' || (game_id % 6) AS team, game_id FROM actions UNION SELECT game_id // 3, 'away', 'team' || ((game_id * 5 + 1) % 6), game_id FROM actions)"""


@query(
    neutral.SQL + SIGNATURES + """, fd AS (SELECT round, side, 'x' || team AS feed FROM sc WHERE game_id % 4 <> 1), fs AS (SELECT feed, count(DISTINCT (round, side)) AS n FROM fd GROUP BY feed),
m AS (SELECT feed, team FROM (SELECT DISTINCT feed, round, side FROM fd) JOIN (SELECT DISTINCT team, round, side FROM sc) USING (round, side) JOIN fs USING (feed) GROUP BY feed, team, n HAVING count(*) = n),
u AS (SELECT *, count(*) OVER (PARTITION BY feed) AS a, count(*) OVER (PARTITION BY team) AS b FROM m) SELECT feed, CASE WHEN max(a) = 1 AND max(b) = 1 THEN max(team) END AS team, CAST(max(a) AS BIGINT) AS fits FROM u GROUP BY feed"""
)
def fixture_signatures(spark, sf_dir):
    """Teams of a feed without dates, found by the rounds and sides they play: their set must fit one scheduled team only."""
    g = neutral.actions(spark, sf_dir).select("game_id").distinct()
    r = F.floor(F.col("game_id") / 3)
    sc = g.select("game_id", r.alias("round"), F.explode(F.array(F.struct(F.lit("home").alias("side"), F.concat(F.lit("team"), F.col("game_id") % 6).alias("team")), F.struct(F.lit("away").alias("side"), F.concat(F.lit("team"), (F.col("game_id") * 5 + 1) % 6).alias("team")))).alias("s"))
    sc = sc.select("game_id", "round", "s.side", "s.team")
    fd = sc.where("game_id % 4 <> 1").select(F.concat(F.lit("x"), F.col("team")).alias("feed"), "round", "side").distinct()
    n = fd.groupBy("feed").agg(F.count("*").alias("n"))
    m = fd.join(sc.select("team", "round", "side").distinct(), ["round", "side"]).groupBy("feed", "team").agg(F.count("*").alias("c")).join(n, "feed").where("c = n").select("feed", "team")
    a, b = m.groupBy("feed").agg(F.count("*").alias("fits")), m.groupBy("team").agg(F.count("*").alias("b"))
    u = m.join(a, "feed").join(b, "team")
    return u.groupBy("feed").agg(F.when((F.max("fits") == 1) & (F.max("b") == 1), F.max("team")).alias("team"), F.max("fits").alias("fits"))


@query(neutral.SQL + " SELECT DISTINCT 'c' || (game_id % 3) || '|2024|team' || (game_id % 6) || '|team' || ((game_id * 5 + 1) % 6) AS match_key FROM actions")
def match_keys(spark, sf_dir):
    """A fixture's identity without its date: competition, season, home, away."""
    g = F.col("game_id")
    return neutral.actions(spark, sf_dir).select(F.concat_ws("|", F.concat(F.lit("c"), g % 3), F.lit("2024"), F.concat(F.lit("team"), g % 6), F.concat(F.lit("team"), (g * 5 + 1) % 6)).alias("match_key")).distinct()
