"""Exact selection for every squad at once: who is chosen under declared minima, and how firmly.

A squad is a declared unit, 24 neighbouring player ids; all its players with an outfield position take part, with whole
numbers of passes and shots for each 90 minutes. Five places are filled: two DF, two MD, one FW.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import lineups as L
from ..sources import neutral
from .registry import query

FORMATION = {"DF": 2, "MD": 2, "FW": 1}
MINIMA = {"passes": 17, "shots": 12}
BY = ("squad",)
SQUAD = neutral.SQL + f""", t AS (SELECT player_id, position, player_id // 24 AS squad, count(*) FILTER (WHERE type = 'pass') AS p, count(*) FILTER (WHERE type = 'shot') AS s FROM actions JOIN players USING (player_id) WHERE position IN ('DF', 'MD', 'FW') GROUP BY ALL),
mn AS (SELECT player_id, sum(minutes) AS m FROM lineups GROUP BY player_id), squad AS (SELECT player_id, position, squad, CAST(p * 90 // m AS BIGINT) AS passes, CAST(s * 90 // m AS BIGINT) AS shots, m FROM t JOIN mn USING (player_id)),
back AS (SELECT a.squad, [a.player_id, b.player_id, c.player_id, d.player_id] AS four, a.passes + b.passes + c.passes + d.passes AS passes, a.shots + b.shots + c.shots + d.shots AS shots
  FROM squad a JOIN squad b ON b.squad = a.squad AND b.player_id > a.player_id AND a.position = 'DF' AND b.position = 'DF' JOIN squad c ON c.squad = a.squad AND c.position = 'MD' JOIN squad d ON d.squad = a.squad AND d.player_id > c.player_id AND d.position = 'MD'),
loss AS (SELECT squad, xi, passes, shots, greatest(0, {MINIMA['passes']} - passes, {MINIMA['shots']} - shots) AS max_short, greatest(0, {MINIMA['passes']} - passes) + greatest(0, {MINIMA['shots']} - shots) AS total_short
  FROM (SELECT b.squad, list_sort(list_append(four, e.player_id)) AS xi, b.passes + e.passes AS passes, b.shots + e.shots AS shots FROM back b JOIN squad e ON e.squad = b.squad AND e.position = 'FW')),
level AS (SELECT * FROM loss QUALIFY rank() OVER (PARTITION BY squad ORDER BY max_short, total_short) = 1)"""
XI = "array_to_string(xi, ',') AS xi"


def squads(spark, sf_dir) -> DataFrame:
    a = neutral.actions(spark, sf_dir)
    p = neutral.players(a).where(F.col("position").isin(*FORMATION)).select("player_id", "position")
    t = a.join(p, "player_id").groupBy("player_id", "position").agg(F.count_if(F.col("type") == "pass").alias("p"), F.count_if(F.col("type") == "shot").alias("s"))
    m = neutral.lineups(a).groupBy("player_id").agg(F.sum("minutes").alias("m"))
    return t.join(m, "player_id").select("player_id", F.expr("player_id div 24").alias("squad"), "position", F.array("position").alias("slots"), F.expr("p * 90 div m").alias("passes"), F.expr("s * 90 div m").alias("shots"), "m")


def loss(spark, sf_dir) -> DataFrame:
    s = squads(spark, sf_dir)
    return L.losses(L.feasible_sets(s, FORMATION, by=BY, names=list(MINIMA)), None, MINIMA, BY)


def spelled(df: DataFrame) -> DataFrame:
    return df.withColumn("xi", F.concat_ws(",", F.col("xi").cast("array<string>")))


@query(SQUAD + f" SELECT squad, {XI}, passes, shots, CAST(max_short AS BIGINT) AS max_short, CAST(total_short AS BIGINT) AS total_short FROM level")
def best_selections(spark, sf_dir):
    """Every set of least (largest, total) shortfall."""
    return spelled(L.best(loss(spark, sf_dir), BY))


@query(SQUAD + ", m AS (SELECT squad, unnest(xi) AS player_id FROM level), n AS (SELECT squad, count(*) AS n FROM level GROUP BY squad) SELECT squad, player_id, count(*) = n AS necessary FROM m JOIN n USING (squad) GROUP BY squad, player_id, n")
def tie_membership(spark, sf_dir):
    return L.membership(L.best(loss(spark, sf_dir), BY), BY)


@query(SQUAD + ", v AS (SELECT DISTINCT squad, passes, shots FROM loss) SELECT squad, passes, shots FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.squad = a.squad AND b.passes >= a.passes AND b.shots >= a.shots AND (b.passes > a.passes OR b.shots > a.shots))")
def sum_frontier(spark, sf_dir):
    return L.frontier(loss(spark, sf_dir), ["passes", "shots"], BY)


@query(SQUAD + ", r AS (SELECT squad, s.player_id AS absent, max_short, total_short, row_number() OVER (PARTITION BY s.player_id ORDER BY max_short, total_short) AS k FROM loss JOIN squad s USING (squad) WHERE NOT list_contains(xi, s.player_id)) SELECT squad, absent, CAST(max_short AS BIGINT) AS max_short, CAST(total_short AS BIGINT) AS total_short FROM r WHERE k = 1")
def single_absences(spark, sf_dir):
    return L.absence(loss(spark, sf_dir), squads(spark, sf_dir), BY)


@query(SQUAD + """, pr AS (SELECT a.squad, a.player_id AS p, b.player_id AS q FROM squad a JOIN squad b ON a.squad = b.squad AND a.player_id < b.player_id),
w AS (SELECT pr.squad, p, q, min(CASE WHEN xi IS NOT NULL THEN {'m': max_short, 't': total_short} END) AS z FROM pr LEFT JOIN loss l ON l.squad = pr.squad AND NOT list_contains(xi, p) AND NOT list_contains(xi, q) GROUP BY ALL)
SELECT squad, count(*) AS pairs, count(*) FILTER (WHERE z IS NULL) AS unfieldable, CAST(max(z).m AS BIGINT) AS worst_max, CAST(max(z).t AS BIGINT) AS worst_total FROM w GROUP BY squad HAVING max(z) IS NOT NULL""")
def pair_absences(spark, sf_dir):
    """Every two absences at once: how many leave no set at all, and the worst loss of the others."""
    s = squads(spark, sf_dir).select("squad", "player_id")
    pairs = s.withColumnRenamed("player_id", "p").join(s.withColumnRenamed("player_id", "q"), "squad").where("p < q")
    met = loss(spark, sf_dir).join(pairs, "squad").where(~F.array_contains("xi", F.col("p")) & ~F.array_contains("xi", F.col("q")))
    z = met.groupBy("squad", "p", "q").agg(F.min(F.struct("max_short", "total_short")).alias("z"))
    every = pairs.join(z, ["squad", "p", "q"], "left").groupBy("squad").agg(F.count("*").alias("pairs"), F.count_if(F.col("z").isNull()).alias("unfieldable"), F.max("z").alias("z"))
    return every.where("z is not null").select("squad", "pairs", "unfieldable", F.col("z.max_short").alias("worst_max"), F.col("z.total_short").alias("worst_total"))


@query(SQUAD + " SELECT squad, min(passes) AS passes_low, max(passes) AS passes_high, min(shots) AS shots_low, max(shots) AS shots_high, count(*) AS sets FROM loss GROUP BY squad")
def attainable_ranges(spark, sf_dir):
    return loss(spark, sf_dir).groupBy(*BY).agg(F.min("passes").alias("passes_low"), F.max("passes").alias("passes_high"), F.min("shots").alias("shots_low"), F.max("shots").alias("shots_high"), F.count("*").alias("sets"))


@query(SQUAD + """, c1 AS (SELECT squad, min(xi) AS xi FROM level GROUP BY squad), l2 AS (SELECT level.squad, level.xi FROM level JOIN c1 USING (squad) WHERE 5 - len(list_intersect(level.xi, c1.xi)) >= 2), c2 AS (SELECT squad, min(xi) AS xi FROM l2 GROUP BY squad),
c3 AS (SELECT l2.squad, min(l2.xi) AS xi FROM l2 JOIN c2 USING (squad) WHERE 5 - len(list_intersect(l2.xi, c2.xi)) >= 2 GROUP BY l2.squad)
SELECT squad, nth, array_to_string(xi, ',') AS xi FROM (SELECT squad, 1 AS nth, xi FROM c1 UNION ALL SELECT squad, 2, xi FROM c2 UNION ALL SELECT squad, 3, xi FROM c3)""")
def diverse_selections(spark, sf_dir):
    """Up to three equally good sets that differ in two players or more."""
    return spelled(L.diverse(L.best(loss(spark, sf_dir), BY), 2, 3, BY))


@query(SQUAD + f", m AS (SELECT squad, max(shots) AS most FROM loss WHERE passes >= {MINIMA['passes']} GROUP BY squad), a AS (SELECT squad, count(*) AS sets FROM loss GROUP BY squad) SELECT squad, CASE WHEN most IS NULL THEN 'NOT_SATISFIABLE' ELSE 'OPTIMAL' END AS status, CAST(most AS VARCHAR) AS most, (SELECT count(*) FROM loss l WHERE l.squad = a.squad AND l.passes >= {MINIMA['passes']} AND l.shots = m.most) AS ties FROM a LEFT JOIN m USING (squad)")
def most_shots(spark, sf_dir):
    """One sum maximised with the other as a hard floor; where no set meets the floor nothing is claimed."""
    l = loss(spark, sf_dir)  # noqa: E741
    ok = F.col("passes") >= MINIMA["passes"]
    m = l.where(ok).groupBy("squad", "shots").count().groupBy("squad").agg(F.max("shots").alias("most"), F.max_by("count", "shots").alias("ties"))
    every = l.select("squad").distinct().join(m, "squad", "left")
    return every.select("squad", F.when(F.col("most").isNull(), "NOT_SATISFIABLE").otherwise("OPTIMAL").alias("status"), F.col("most").cast("string").alias("most"), F.coalesce("ties", F.lit(0).cast("long")).alias("ties"))


DECLARED = {"passes >= 24": "passes >= 24", "shots >= 15": "shots >= 15", "both >= 36": "passes + shots >= 36"}
_MASKS = [" AND ".join([f"({c})" for i, c in enumerate(DECLARED.values()) if m >> i & 1]) or "TRUE" for m in range(8)]


@query(
    SQUAD + ", f AS (SELECT squad, " + ", ".join(f"bool_or({c}) AS f{m}" for m, c in enumerate(_MASKS)) + """ FROM loss GROUP BY squad), a AS (SELECT *, CASE WHEN NOT f6 THEN 6 ELSE 7 END AS m1 FROM f),
b AS (SELECT *, CASE WHEN m1 = 7 THEN CASE WHEN NOT f5 THEN 5 ELSE 7 END ELSE CASE WHEN NOT f4 THEN 4 ELSE 6 END END AS m2 FROM a), c AS (SELECT *, CASE WHEN NOT [f0, f1, f2, f3, f4, f5, f6, f7][(m2 & 3) + 1] THEN m2 & 3 ELSE m2 END AS m3 FROM b)
SELECT squad, CASE WHEN f7 THEN '' ELSE array_to_string(list_filter([CASE WHEN m3 & 1 <> 0 THEN 'passes >= 24' END, CASE WHEN m3 & 2 <> 0 THEN 'shots >= 15' END, CASE WHEN m3 & 4 <> 0 THEN 'both >= 36' END], lambda x: x IS NOT NULL), ' + ') END AS conflict FROM c"""
)
def minimal_conflicts(spark, sf_dir):
    """Which declarations cannot be met together, none of them dispensable."""
    l = loss(spark, sf_dir)  # noqa: E741
    f = l.groupBy("squad").agg(*[F.bool_or(F.expr(c)).alias(f"f{m}") for m, c in enumerate(_MASKS)])
    return f.select("squad", L.conflict([F.col(f"f{m}") for m in range(8)], list(DECLARED)).alias("conflict"))


WORLDS = 5
WORLD = f""", w AS (SELECT unnest(range({WORLDS})) AS w), pl AS (SELECT squad, xi, w, sum(s.passes * (8 + (s.player_id + w) % 5)) AS v FROM (SELECT squad, xi, unnest(xi) AS player_id FROM loss) JOIN squad s USING (squad, player_id), w GROUP BY ALL),
wl AS (SELECT squad, xi, w, CAST(greatest(0, {10 * MINIMA['passes']} - v) AS BIGINT) AS m FROM pl)"""


def world_losses(spark, sf_dir) -> DataFrame:
    """``squad, xi, w, m``: the shortfall of every set in every world."""
    s = squads(spark, sf_dir)
    c = s.select("squad", "player_id", "slots", *[(F.col("passes") * (8 + (F.col("player_id") + w) % 5)).alias(f"w{w}") for w in range(WORLDS)])
    v = L.feasible_sets(c, FORMATION, by=BY, names=[f"w{w}" for w in range(WORLDS)])
    m = [F.struct(F.lit(w).cast("long").alias("w"), F.greatest(F.lit(0), 10 * MINIMA["passes"] - F.col(f"w{w}")).cast("long").alias("m")) for w in range(WORLDS)]
    return v.select("squad", "xi", F.explode(F.array(*m)).alias("x")).select("squad", "xi", "x.w", "x.m")


@query(
    SQUAD + WORLD + """, k AS (SELECT *, row_number() OVER (PARTITION BY squad, xi ORDER BY m DESC, w) AS r, m - min(m) OVER (PARTITION BY squad, w) AS gap FROM wl),
s AS (SELECT squad, xi, sum(m) FILTER (WHERE r <= 2) AS tail, max(m) AS worst, max(gap) AS regret FROM k GROUP BY ALL), r AS (SELECT squad, xi, unnest([{'rule': 'tail', 'z': tail}, {'rule': 'worst', 'z': worst}, {'rule': 'regret', 'z': regret}]) AS u FROM s)
SELECT squad, u.rule AS rule, array_to_string(xi, ',') AS xi, CAST(u.z AS BIGINT) AS loss FROM r QUALIFY rank() OVER (PARTITION BY squad, u.rule ORDER BY u.z) = 1"""
)
def risk_selections(spark, sf_dir):
    """The best sets by three declared rules: the sum of the two worst worlds, the worst world, the largest regret."""
    wl = world_losses(spark, sf_dir)
    least = wl.groupBy("squad", "w").agg(F.min("m").alias("z"))
    s = wl.join(least, ["squad", "w"]).groupBy("squad", "xi").agg(F.sort_array(F.collect_list("m"), False).alias("l"), F.max(F.col("m") - F.col("z")).alias("regret"))
    rules = [("tail", F.col("l")[0] + F.col("l")[1]), ("worst", F.col("l")[0]), ("regret", F.col("regret"))]
    r = s.select("squad", "xi", F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), z.cast("long").alias("loss")) for n, z in rules])).alias("u")).select("squad", "xi", "u.rule", "u.loss")
    return spelled(L.least(r, ("loss",), ("squad", "rule")))


@query(
    SQUAD + WORLD + """, h AS (SELECT DISTINCT squad, w FROM squad, w WHERE (player_id * 7 + w) % 53 = 0), b AS (SELECT * FROM wl QUALIFY m = min(m) OVER (PARTITION BY squad, w)), u AS (SELECT b.* FROM b ANTI JOIN h USING (squad, w)),
n AS (SELECT squad, w, count(*) AS n FROM u GROUP BY ALL), p AS (SELECT squad, w, player_id, count(*) AS c FROM (SELECT squad, w, unnest(xi) AS player_id FROM u) GROUP BY ALL), d AS (SELECT squad, count(*) AS worlds FROM n GROUP BY squad),
q AS (SELECT p.squad, p.player_id, d.worlds, sum(p.c / n.n) / d.worlds AS f FROM p JOIN n ON n.squad = p.squad AND n.w = p.w JOIN d ON d.squad = p.squad GROUP BY p.squad, p.player_id, d.worlds)
SELECT squad, player_id, worlds, round(f, 6) AS frequency, CASE WHEN round(f, 6) >= 0.8 THEN 'CORE' WHEN round(f, 6) >= 0.5 THEN 'FAVORED' WHEN round(f, 6) >= 0.2 THEN 'CONTESTED' ELSE 'FRINGE' END AS standing FROM q"""
)
def selection_frequencies(spark, sf_dir):
    """How often each player is in the best set over the worlds, ties shared; a world with a hole is discarded for its squad."""
    s = squads(spark, sf_dir)
    holes = s.select("squad", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(WORLDS - 1).cast("long"))).alias("w"), "player_id").where("(player_id * 7 + w) % 53 = 0").select("squad", "w").distinct()
    u = L.least(world_losses(spark, sf_dir), ("m",), ("squad", "w")).join(holes, ["squad", "w"], "left_anti")
    n = u.groupBy("squad", "w").agg(F.count("*").alias("n"))
    p = u.select("squad", "w", F.explode("xi").alias("player_id")).groupBy("squad", "w", "player_id").agg(F.count("*").alias("c"))
    d = n.groupBy("squad").agg(F.count("*").alias("worlds"))
    q = p.join(n, ["squad", "w"]).join(d, "squad").groupBy("squad", "player_id", "worlds").agg(F.sum(F.col("c") / F.col("n")).alias("f")).withColumn("frequency", F.round(F.col("f") / F.col("worlds"), 6))
    f = F.col("frequency")
    return q.select("squad", "player_id", "worlds", "frequency", F.when(f >= 0.8, "CORE").when(f >= 0.5, "FAVORED").when(f >= 0.2, "CONTESTED").otherwise("FRINGE").alias("standing"))


def _loss(p: str, s: str) -> str:
    a, b = f"{MINIMA['passes']} - ({p})", f"{MINIMA['shots']} - ({s})"
    return f"{{'m': greatest(0, {a}, {b}), 't': greatest(0, {a}) + greatest(0, {b})}}"


INJECT = SQUAD + """, rb AS (SELECT DISTINCT squad, passes, shots FROM back), cd AS (SELECT player_id AS candidate, squad - 1 AS squad, passes, shots FROM squad WHERE position = 'FW' AND m >= 90), z0 AS (SELECT squad, min({'m': max_short, 't': total_short}) AS z0 FROM loss GROUP BY squad)"""


def vacant(spark, sf_dir) -> DataFrame:
    """Distinct sums of the sets with the forward's place left open: all that matters of them for who comes in."""
    s = squads(spark, sf_dir)
    four = L.feasible_sets(s, {k: v for k, v in FORMATION.items() if k != "FW"}, by=BY, names=list(MINIMA))
    return four.select("squad", "passes", "shots").distinct()


def injectable(spark, sf_dir) -> DataFrame:
    """Forwards of the next squad with enough minutes, as candidates for this one."""
    return squads(spark, sf_dir).where("position = 'FW' and m >= 90").select(F.col("player_id").alias("candidate"), (F.col("squad") - 1).alias("squad"), F.col("passes").alias("p"), F.col("shots").alias("s"))


def with_candidate(p: F.Column, s: F.Column) -> F.Column:
    worst, total = L.shortfalls({"passes": F.col("passes") + p, "shots": F.col("shots") + s}, MINIMA)
    return F.min(F.struct(worst.alias("max_short"), total.alias("total_short")))


@query(INJECT + f", zc AS (SELECT squad, candidate, min({_loss('rb.passes + cd.passes', 'rb.shots + cd.shots')}) AS zc FROM rb JOIN cd USING (squad) GROUP BY ALL) SELECT squad, candidate, CAST(zc.m AS BIGINT) AS max_short, CAST(zc.t AS BIGINT) AS total_short, CASE WHEN zc < z0 THEN 'necessary' WHEN zc = z0 THEN 'possible' ELSE 'not chosen' END AS outcome FROM zc JOIN z0 USING (squad)")
def injected_candidates(spark, sf_dir):
    """The least loss with a candidate forced in, against the squad's own: lower, the candidate is in every best set; equal, in some."""
    zc = vacant(spark, sf_dir).join(injectable(spark, sf_dir), "squad").groupBy("squad", "candidate").agg(with_candidate(F.col("p"), F.col("s")).alias("zc"))
    z0 = loss(spark, sf_dir).groupBy("squad").agg(F.min(F.struct("max_short", "total_short")).alias("z0"))
    o = F.when(F.col("zc") < F.col("z0"), "necessary").when(F.col("zc") == F.col("z0"), "possible").otherwise("not chosen")
    return zc.join(z0, "squad").select("squad", "candidate", "zc.max_short", "zc.total_short", o.alias("outcome"))


@query(INJECT + f", g AS (SELECT unnest(range(21)) AS k), zc AS (SELECT squad, candidate, k, min({_loss('rb.passes + cd.passes * k // 20', 'rb.shots + cd.shots * k // 20')}) AS zc FROM rb JOIN cd USING (squad), g GROUP BY ALL) SELECT squad, candidate, CAST(min(k) FILTER (WHERE zc <= z0) AS VARCHAR) AS break_even, count(*) FILTER (WHERE zc <= z0) AS holds FROM zc JOIN z0 USING (squad) GROUP BY ALL")
def break_even_retention(spark, sf_dir):
    """The least twentieths of a candidate's rates that must carry over for the squad to be no worse; all 21 steps are looked at."""
    c = injectable(spark, sf_dir).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(20))))
    zc = vacant(spark, sf_dir).join(c, "squad").groupBy("squad", "candidate", "k").agg(with_candidate(F.expr("p * k div 20"), F.expr("s * k div 20")).alias("zc"))
    z0 = loss(spark, sf_dir).groupBy("squad").agg(F.min(F.struct("max_short", "total_short")).alias("z0"))
    ok = F.col("zc") <= F.col("z0")
    return zc.join(z0, "squad").groupBy("squad", "candidate").agg(F.min(F.when(ok, F.col("k"))).cast("string").alias("break_even"), F.count_if(ok).alias("holds"))


@query(INJECT + f""", nd AS (SELECT DISTINCT squad, greatest(0, {MINIMA['passes']} - passes) AS p, greatest(0, {MINIMA['shots']} - shots) AS s FROM rb), mi AS (SELECT * FROM nd a WHERE NOT EXISTS (SELECT 1 FROM nd b WHERE b.squad = a.squad AND b.p <= a.p AND b.s <= a.s AND (b.p < a.p OR b.s < a.s)))
SELECT squad, CAST(p AS BIGINT) AS passes_needed, CAST(s AS BIGINT) AS shots_needed, (SELECT count(*) FROM cd WHERE cd.squad = mi.squad AND cd.passes >= p AND cd.shots >= s) AS meeting FROM mi""")
def role_briefs(spark, sf_dir):
    """What a newcomer at the open place must bring, as minimal pairs of needs, and how many candidates bring it."""
    need = lambda n: F.greatest(F.lit(0), MINIMA[n] - F.col(n)).cast("long")
    nd = vacant(spark, sf_dir).select("squad", (-need("passes")).alias("a"), (-need("shots")).alias("b"))
    mi = L.frontier(nd, ["a", "b"], BY).select("squad", (-F.col("a")).alias("passes_needed"), (-F.col("b")).alias("shots_needed"))
    met = mi.join(injectable(spark, sf_dir), "squad", "left")
    ok = (F.col("p") >= F.col("passes_needed")) & (F.col("s") >= F.col("shots_needed"))
    return met.groupBy("squad", "passes_needed", "shots_needed").agg(F.count_if(ok).alias("meeting"))


@query(SQUAD + """, e AS (SELECT squad, player_id, CASE position WHEN 'DF' THEN 1 WHEN 'MD' THEN 2 ELSE 4 END | CASE WHEN player_id % 3 = 0 THEN 2 ELSE 0 END AS slots FROM squad), g AS (SELECT unnest([{'mask': 1, 'n': 2}, {'mask': 2, 'n': 2}, {'mask': 3, 'n': 4}, {'mask': 4, 'n': 1}, {'mask': 5, 'n': 3}, {'mask': 6, 'n': 3}, {'mask': 7, 'n': 5}]) AS g)
SELECT squad, CAST(g.mask AS INTEGER) AS slots, count(*) FILTER (WHERE slots & g.mask <> 0) AS able, count(*) FILTER (WHERE slots & g.mask <> 0) - g.n AS spare FROM e, g GROUP BY squad, g.mask, g.n""")
def squad_depth(spark, sf_dir):
    """For every group of slots the players who can stand in it, less its places: a group without spare players is tight."""
    bit = F.when(F.col("position") == "DF", 1).when(F.col("position") == "MD", 2).otherwise(4)
    e = squads(spark, sf_dir).withColumn("own", bit.bitwiseOR(F.when(F.col("player_id") % 3 == 0, 2).otherwise(0))).groupBy("squad", "own").count()
    places = {1: 2, 2: 2, 3: 4, 4: 1, 5: 3, 6: 3, 7: 5}
    g = e.withColumn("g", F.explode(F.array(*[F.struct(F.lit(m).alias("slots"), F.lit(n).alias("n")) for m, n in places.items()])))
    able = F.sum(F.when(F.col("own").bitwiseAND(F.col("g.slots")) != 0, F.col("count")).otherwise(0))
    return g.groupBy("squad", F.col("g.slots").alias("slots"), F.col("g.n").alias("n")).agg(able.alias("able")).select("squad", "slots", "able", (F.col("able") - F.col("n")).alias("spare"))
