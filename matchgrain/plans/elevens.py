"""Full elevens for every squad: least losses under declarations, absences, standing places, depth and conflicts.

A squad is 24 neighbouring player ids. All its players with a position take part, a third of the defenders and forwards also
as midfielders; passes, shots and touches come as whole numbers for each three matches, and count for outfield places.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import elevens as E
from ..sources import neutral
from ..sources.store import cut
from .registry import query

FORMATION = {"GK": 1, "DF": 4, "MD": 3, "FW": 3}
MINIMA = {"passes": 56, "shots": 54, "touches": 55}
APPLIES = {n: ("DF", "MD", "FW") for n in MINIMA}
#: A player needs so many minutes to be asked to play.
GATE = 600

SQUAD = neutral.SQL + """, t AS (SELECT player_id, position, player_id // 24 AS squad, count(*) FILTER (WHERE type = 'pass') AS p, count(*) FILTER (WHERE type = 'shot') AS s, count(*) FILTER (WHERE type = 'touch') AS u
  FROM actions JOIN players USING (player_id) WHERE position IS NOT NULL GROUP BY ALL), mn AS (SELECT player_id, sum(minutes) AS m FROM lineups GROUP BY player_id),
squad AS (SELECT squad, player_id, position, CAST(m AS BIGINT) AS m, CAST(p * 270 // m AS BIGINT) AS passes, CAST(s * 270 // m AS BIGINT) AS shots, CAST(u * 270 // m AS BIGINT) AS touches, CAST(1 AS BIGINT) << (player_id % 24) AS bit,
  CASE WHEN position IN ('DF', 'FW') AND player_id % 3 = 0 THEN [position, 'MD'] ELSE [position] END AS slots FROM t JOIN mn USING (player_id))"""

_SUMS = ", ".join(f"{{}}{n} AS {n}" for n in MINIMA)


def _set(name: str, slot: str, n: int, source: str = "squad") -> str:
    """SQL of all sets of ``n`` players in a slot: squad, mask and sums (no sums for goalkeepers)."""
    a = [f"a{i}" for i in range(n)]
    joins = f"{source} a0" + "".join(f" JOIN {source} a{i} ON a{i}.squad = a0.squad AND a{i}.player_id > a{i - 1}.player_id AND list_contains(a{i}.slots, '{slot}')" for i in range(1, n))
    sums = ", ".join(("0" if slot == "GK" else " + ".join(f"{x}.{m}" for x in a)) + f" AS {m}" for m in MINIMA)
    return f"{name} AS (SELECT a0.squad, {' | '.join(f'{x}.bit' for x in a)} AS mask, {sums} FROM {joins} WHERE list_contains(a0.slots, '{slot}'))"


def _join(name: str, parts: str) -> str:
    """SQL of all disjoint choices of the four slots' sets, with their masks by slot."""
    g, d, m, f = parts.split()
    sums = ", ".join(f"g.{n} + d.{n} + m.{n} + f.{n} AS {n}" for n in MINIMA)
    return f"{name} AS (SELECT g.squad, g.mask AS gm, d.mask AS dm, m.mask AS mm, f.mask AS fm, g.mask | d.mask | m.mask | f.mask AS mask, {sums} FROM {g} g JOIN {d} d ON d.squad = g.squad JOIN {m} m ON m.squad = g.squad AND m.mask & d.mask = 0 JOIN {f} f ON f.squad = g.squad AND f.mask & (d.mask | m.mask) = 0)"


_SHORT = [f"greatest(0, {v} - {n})" for n, v in MINIMA.items()]
_LOSS = f"{{'m': greatest({', '.join(_SHORT)}), 't': {' + '.join(_SHORT)}}}"
SETS = SQUAD + ", " + ", ".join([_set("gk", "GK", 1), _set("df", "DF", 4), _set("md", "MD", 3), _set("fw", "FW", 3), _join("eleven", "gk df md fw")])
# The masks of a squad's elevens with the least loss of each: what a question about players needs.
SETS += f", loss AS (SELECT squad, gm, dm, mm, fm, mask, {_LOSS} AS z FROM eleven)"
_STATUS = "CASE WHEN z IS NULL THEN 'UNFIELDABLE' ELSE 'CERTIFIED' END AS status, CAST(z.m AS VARCHAR) AS max_short, CAST(z.t AS VARCHAR) AS total_short"


def squads(spark, sf_dir) -> DataFrame:
    a = neutral.actions(spark, sf_dir)
    p = neutral.players(a).where("position is not null").select("player_id", "position")
    count = lambda kind: F.count_if(F.col("type") == kind)
    t = a.join(p, "player_id").groupBy("player_id", "position").agg(count("pass").alias("p"), count("shot").alias("s"), count("touch").alias("u"))
    m = neutral.lineups(a).groupBy("player_id").agg(F.sum("minutes").alias("m"))
    also = F.col("position").isin("DF", "FW") & (F.col("player_id") % 3 == 0)
    rates = [F.expr(f"{c} * 270 div m").alias(n) for c, n in (("p", "passes"), ("s", "shots"), ("u", "touches"))]
    return cut(t.join(m, "player_id").select(F.expr("player_id div 24").alias("squad"), "player_id", "position", "m", *rates, F.when(also, F.array("position", F.lit("MD"))).otherwise(F.array("position")).alias("slots")))


def valued(s: DataFrame, declared: DataFrame, scenario: str) -> DataFrame:
    return E.variants(s, FORMATION, MINIMA, declared, ("squad",), scenario, APPLIES).drop("xi")


def least(s: DataFrame) -> DataFrame:
    """``squad, z0, xi``: each squad's least loss and players who have it; null without one."""
    v = E.values(s, FORMATION, MINIMA, None, ("squad",), APPLIES)
    return cut(v.select("squad", F.when(F.col("status") == "CERTIFIED", F.struct("max_short", "total_short")).alias("z0"), "xi"))


def spelled(df: DataFrame) -> DataFrame:
    """Losses as text, where no eleven leaves them out."""
    return df.withColumn("max_short", F.col("max_short").cast("string")).withColumn("total_short", F.col("total_short").cast("string"))


_PICK = """, pick AS (SELECT squad, 'base' AS scenario, NULL AS player_id, NULL AS kind, NULL AS slot FROM squad GROUP BY squad
  UNION ALL SELECT squad, 'without the most passes', max_by(player_id, {'p': passes, 'i': player_id}), 'EXCLUDED', NULL FROM squad WHERE position <> 'GK' GROUP BY squad
  UNION ALL SELECT squad, 'with the fewest passes', min_by(player_id, {'p': passes, 'i': player_id}), 'LOCKED', NULL FROM squad WHERE position <> 'GK' GROUP BY squad
  UNION ALL SELECT squad, 'one pinned to MD', min(player_id), 'PINNED', 'MD' FROM squad WHERE list_contains(slots, 'MD') AND position <> 'MD' GROUP BY squad
  UNION ALL SELECT squad, 'a forward vacant', NULL, 'VACANT', 'FW' FROM squad GROUP BY squad)"""


@query(
    SETS + ", " + _set("fw2", "FW", 2) + ", " + _join("ten", "gk df md fw2") + f", tens AS (SELECT squad, min({_LOSS}) AS z FROM ten GROUP BY squad)" + _PICK + f""",
found AS (SELECT p.squad, p.scenario, min(l.z) FILTER (WHERE CASE p.kind WHEN 'EXCLUDED' THEN l.mask >> (p.player_id % 24) & 1 = 0 WHEN 'LOCKED' THEN l.mask >> (p.player_id % 24) & 1 = 1
    WHEN 'PINNED' THEN l.mm >> (p.player_id % 24) & 1 = 1 ELSE true END) AS z FROM pick p LEFT JOIN loss l USING (squad) WHERE p.kind IS DISTINCT FROM 'VACANT' GROUP BY p.squad, p.scenario
  UNION ALL SELECT p.squad, p.scenario, z FROM pick p LEFT JOIN tens USING (squad) WHERE p.kind = 'VACANT') SELECT squad, scenario, {_STATUS} FROM found"""
)
def eleven_values(spark, sf_dir):
    """Each squad's least loss as it is, with one player out, in, or pinned to a slot, and with a place left open."""
    s = squads(spark, sf_dir)
    out = F.col("position") != "GK"
    one = lambda name, rows, pick, kind, slot: rows.groupBy("squad").agg(pick.alias("player_id")).select("squad", F.lit(name).alias("scenario"), "player_id", F.lit(kind).alias("kind"), F.lit(slot).cast("string").alias("slot"))
    by_passes = F.struct("passes", "player_id")
    nobody = F.first(F.lit(None).cast("long"))
    declared = one("base", s, nobody, None, None)
    declared = declared.unionByName(one("without the most passes", s.where(out), F.max(by_passes)["player_id"], "EXCLUDED", None))
    declared = declared.unionByName(one("with the fewest passes", s.where(out), F.min(by_passes)["player_id"], "LOCKED", None))
    declared = declared.unionByName(one("one pinned to MD", s.where(F.array_contains("slots", "MD") & (F.col("position") != "MD")), F.min("player_id"), "PINNED", "MD"))
    declared = declared.unionByName(one("a forward vacant", s, nobody, "VACANT", "FW"))
    return spelled(valued(s, cut(declared), "scenario"))


@query(
    SETS + """, base AS (SELECT squad, min(z) AS z0 FROM loss GROUP BY squad), found AS (SELECT s.squad, s.player_id, min(l.z) AS z FROM squad s LEFT JOIN loss l ON l.squad = s.squad AND l.mask & s.bit = 0 GROUP BY s.squad, s.player_id)
SELECT squad, player_id, """ + _STATUS + """, z0 IS NOT NULL AND z IS DISTINCT FROM z0 AS necessary FROM found LEFT JOIN base USING (squad)"""
)
def eleven_absences(spark, sf_dir):
    """Every squad without each of its players; necessary: every best eleven has the player."""
    s = squads(spark, sf_dir)
    base = least(s)
    one = s.withColumn("bit", E.member(["squad"])).join(base, "squad")
    # Who is not among a best eleven's players leaves it as it is.
    one = cut(one.select("squad", F.col("player_id").alias("absent"), "z0", F.coalesce(F.col("bit").bitwiseAND(F.col("xi")) == 0, F.lit(False)).alias("idle")))
    declared = one.where("not idle and z0 is not null").select("squad", "absent", F.col("absent").alias("player_id"), F.lit("EXCLUDED").alias("kind"), F.lit(None).cast("string").alias("slot"))
    v = one.join(valued(s, declared, "absent"), ["squad", "absent"], "left")
    loss = F.when(F.col("idle"), F.col("z0")).otherwise(F.when(F.col("status") == "CERTIFIED", F.struct("max_short", "total_short")))
    v = v.withColumn("z", loss).withColumn("necessary", F.col("z0").isNotNull() & ~F.col("z").eqNullSafe(F.col("z0")))
    return spelled(v.select("squad", F.col("absent").alias("player_id"), F.when(F.col("z").isNull(), "UNFIELDABLE").otherwise("CERTIFIED").alias("status"), "z.max_short", "z.total_short", "necessary"))


_STANDING = """, base AS (SELECT squad, min(z) AS z0 FROM loss GROUP BY squad), place AS (SELECT squad, player_id, bit, unnest(slots) AS slot FROM squad),
pinned AS (SELECT p.squad, p.player_id, p.slot, min(l.z) AS z FROM place p LEFT JOIN loss l ON l.squad = p.squad AND CASE p.slot WHEN 'GK' THEN gm WHEN 'DF' THEN dm WHEN 'MD' THEN mm ELSE fm END & p.bit <> 0 GROUP BY ALL),
standing AS (SELECT squad, player_id, slot, z, CASE WHEN z IS NULL THEN 'UNFIELDABLE_IF_PINNED' WHEN z = z0 THEN 'NEUTRAL' ELSE 'RAISES_SHORTFALL' END AS standing FROM pinned LEFT JOIN base USING (squad))"""


def standings(s: DataFrame) -> DataFrame:
    """``squad, player_id, slot`` of every place open to a player, with the squad's loss when pinned there and its standing."""
    base = least(s)
    places = s.withColumn("bit", E.member(["squad"])).select("squad", "player_id", "bit", F.size("slots").alias("open"), F.explode("slots").alias("slot")).join(base, "squad")
    # Who has a single slot and is among a best eleven's players stands there in it.
    stands = F.coalesce((F.col("open") == 1) & (F.col("bit").bitwiseAND(F.col("xi")) != 0), F.lit(False))
    places = cut(places.select("squad", "player_id", "slot", "z0", stands.alias("stands"), F.concat_ws("@", "player_id", "slot").alias("place")))
    declared = places.where("not stands and z0 is not null").select("squad", "place", "player_id", F.lit("PINNED").alias("kind"), "slot")
    v = places.join(valued(s, declared, "place"), ["squad", "place"], "left")
    loss = F.when(F.col("stands"), F.col("z0")).otherwise(F.when(F.col("status") == "CERTIFIED", F.struct("max_short", "total_short")))
    v = v.withColumn("z", loss)
    word = F.when(F.col("z").isNull(), "UNFIELDABLE_IF_PINNED").when(F.col("z") == F.col("z0"), "NEUTRAL").otherwise("RAISES_SHORTFALL")
    return v.select("squad", "player_id", "slot", word.alias("standing"), "z.max_short", "z.total_short")


@query(SETS + _STANDING + " SELECT squad, player_id, slot, standing, CAST(z.m AS VARCHAR) AS max_short, CAST(z.t AS VARCHAR) AS total_short FROM standing")
def eleven_standings(spark, sf_dir):
    """Whether a player in a slot leaves the squad's least loss alone, raises it, or leaves no eleven."""
    return spelled(standings(squads(spark, sf_dir)))


_ABSENT = """, base AS (SELECT DISTINCT squad FROM loss), member AS (SELECT squad, player_id, bit FROM squad JOIN base USING (squad)), single AS (SELECT squad, 1 AS k, bit AS absent FROM member),
pair AS (SELECT a.squad, 2 AS k, a.bit | b.bit AS absent FROM member a JOIN member b ON b.squad = a.squad AND b.player_id > a.player_id),
triple AS (SELECT a.squad, 3 AS k, a.bit | b.bit | c.bit AS absent FROM member a JOIN member b ON b.squad = a.squad AND b.player_id > a.player_id JOIN member c ON c.squad = a.squad AND c.player_id > b.player_id),
away AS (SELECT * FROM single UNION ALL SELECT * FROM pair UNION ALL SELECT * FROM triple)"""
# Elevens with the same loss, by the players that some set of absences could take away from all better ones.
_WORST = _ABSENT + """, distinct_loss AS (SELECT squad, mask, min(z) AS z FROM loss GROUP BY squad, mask), ev2 AS (SELECT w.squad, w.k, w.absent, (SELECT min(l.z) FROM distinct_loss l WHERE l.squad = w.squad AND l.mask & w.absent = 0) AS z FROM away w)"""


@query(
    SETS + _WORST + """, top AS (SELECT squad, k, max(z) AS top FROM ev2 GROUP BY squad, k)
SELECT squad, k, count(*) AS sets, count(*) FILTER (WHERE z IS NULL) AS unfieldable, CAST(any_value(top).m AS BIGINT) AS worst_max, CAST(any_value(top).t AS BIGINT) AS worst_total, count(*) FILTER (WHERE z = top) AS worst_sets FROM ev2 JOIN top USING (squad, k) GROUP BY squad, k"""
)
def eleven_stress(spark, sf_dir):
    """All sets of one to three absences: how many leave no eleven, the largest loss of the others, and how many sets reach it."""
    s = squads(spark, sf_dir)
    alike = E.stress(s, FORMATION, MINIMA, 3, APPLIES).groupBy("squad", "k", "status", "max_short", "total_short").agg(F.count("*").alias("n"))
    certified = F.col("status") == "CERTIFIED"
    top = F.max(F.when(certified, F.struct("max_short", "total_short", "n")))
    level = cut(alike.groupBy("squad", "k").agg(F.sum(F.when(certified, F.col("n"))).alias("fieldable"), top.alias("top")))
    n = s.groupBy("squad").agg(F.count("*").alias("n")).join(level.select("squad").distinct(), "squad").withColumn("k", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    ways = F.when(F.col("k") == 1, F.col("n")).when(F.col("k") == 2, F.expr("n * (n - 1) div 2")).otherwise(F.expr("n * (n - 1) * (n - 2) div 6"))
    every = n.withColumn("sets", ways).join(level, ["squad", "k"], "left")
    lost = F.col("sets") - F.coalesce("fieldable", F.lit(0))
    return every.select("squad", "k", "sets", lost.alias("unfieldable"), F.col("top.max_short").alias("worst_max"), F.col("top.total_short").alias("worst_total"), F.coalesce("top.n", F.lit(0)).alias("worst_sets"))


_GROUPS = ", ".join(f"({m}, {sum(n for i, n in enumerate(FORMATION.values()) if m >> i & 1)}, '{'+'.join(s for i, s in enumerate(FORMATION) if m >> i & 1)}')" for m in range(1, 16))


@query(
    SETS + _ABSENT + f""", slot_group AS (SELECT * FROM (VALUES {_GROUPS}) AS v(g, places, name)), own AS (SELECT squad, player_id, bit, list_sum(list_transform(slots, lambda x: CASE x WHEN 'GK' THEN 1 WHEN 'DF' THEN 2 WHEN 'MD' THEN 4 ELSE 8 END)) AS own FROM squad),
able AS (SELECT squad, g, places, name, bit_or(CASE WHEN CAST(own AS BIGINT) & g <> 0 THEN bit ELSE 0 END) AS able FROM own, slot_group GROUP BY ALL), lost AS (SELECT DISTINCT squad, k, absent FROM away WHERE NOT EXISTS (SELECT 1 FROM eleven e WHERE e.squad = away.squad AND e.mask & away.absent = 0)),
core AS (SELECT * FROM lost a WHERE NOT EXISTS (SELECT 1 FROM lost b WHERE b.squad = a.squad AND b.k < a.k AND b.absent & a.absent = b.absent)),
why AS (SELECT core.*, min_by(name, {{'n': bit_count(g), 'g': g}}) AS slots, min_by(bit_count(able & ~absent), {{'n': bit_count(g), 'g': g}}) AS left_over FROM core JOIN able ON able.squad = core.squad AND bit_count(able & ~absent) < places GROUP BY core.squad, core.k, core.absent)
SELECT w.squad, CAST(k AS INTEGER) AS k, string_agg(CAST(player_id AS VARCHAR), ',' ORDER BY player_id) AS absent, slots, CAST(left_over AS BIGINT) AS left_over FROM why w JOIN member m ON m.squad = w.squad AND m.bit & w.absent <> 0 GROUP BY w.squad, k, w.absent, slots, left_over"""
)
def eleven_cores(spark, sf_dir):
    """Minimal sets of up to three absences that leave no eleven, each with a group of slots that has too few players left."""
    s = squads(spark, sf_dir)
    core = E.absences(s, FORMATION).where("not fieldable").select("squad", "k", "absent")
    able = E.slot_groups(s, FORMATION).withColumn("places", E.places(FORMATION)).withColumn("name", E.spelled_group(FORMATION))
    remain = F.bit_count(F.col("able").bitwiseAND(F.bitwise_not(F.col("absent"))))
    met = core.join(able, "squad").withColumn("remain", remain.cast("long")).where(F.col("remain") < F.col("places"))
    why = met.groupBy("squad", "k", "absent").agg(F.min(F.struct(F.bit_count("mask").alias("n"), "mask", "name", "remain")).alias("w"))
    who = s.select("squad", "player_id", E.member(["squad"]).alias("bit"))
    named = why.join(who, "squad").where(F.col("bit").bitwiseAND(F.col("absent")) != 0).groupBy("squad", "k", "absent", "w").agg(F.array_sort(F.collect_list("player_id")).alias("ids"))
    return named.select("squad", "k", F.concat_ws(",", F.col("ids").cast("array<string>")).alias("absent"), F.col("w.name").alias("slots"), F.col("w.remain").alias("left_over"))


#: Declarations of every squad: slots covered, three defenders out, floors, and players who must be in.
FLOORS = {"passes": 52, "shots": 51, "touches": 52}
OUT, IN = 3, 3
DECLARATIONS = [f"cover {s}" for s in FORMATION] + [f"out {i + 1}" for i in range(OUT)] + [f"{n} >= {v}" for n, v in FLOORS.items()] + [f"in {i + 1}" for i in range(IN)]
_EVERY = (1 << len(DECLARATIONS)) - 1


def _upto(name: str, slot: str) -> str:
    """SQL of all sets of a slot with no more players than places."""
    parts = [_set(f"{name}{k}", slot, k) for k in range(1, FORMATION[slot] + 1)]
    rows = [f"SELECT squad, mask, {k} AS filled, {', '.join(MINIMA)} FROM {name}{k}" for k in range(1, FORMATION[slot] + 1)]
    return ", ".join(parts) + f", {name}_any AS ({' UNION ALL '.join(rows)} UNION ALL SELECT DISTINCT squad, CAST(0 AS BIGINT), 0, {', '.join('0' for _ in MINIMA)} FROM squad)"


_SAT = " + ".join(
    [f"CASE WHEN {x}.filled = {n} THEN {1 << i} ELSE 0 END" for i, (x, n) in enumerate(zip("gdmf", FORMATION.values(), strict=True))]
    + [f"CASE WHEN (g.mask | d.mask | m.mask | f.mask) & t.out{i + 1} = 0 THEN {1 << (4 + i)} ELSE 0 END" for i in range(OUT)]
    + [f"CASE WHEN g.{n} + d.{n} + m.{n} + f.{n} >= {v} THEN {1 << (4 + OUT + i)} ELSE 0 END" for i, (n, v) in enumerate(FLOORS.items())]
    + [f"CASE WHEN (g.mask | d.mask | m.mask | f.mask) & t.in{i + 1} <> 0 THEN {1 << (4 + OUT + len(FLOORS) + i)} ELSE 0 END" for i in range(IN)]
)
_BITS = lambda col: "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {col} & {1 << i} <> 0 THEN '{n}' END" for i, n in enumerate(DECLARATIONS)) + "], lambda x: x IS NOT NULL), ' + ')"


@query(
    SQUAD + ", " + ", ".join(_upto(a, s) for a, s in zip(("pg", "pd", "pm", "pf"), FORMATION, strict=True)) + f""",
ranked AS (SELECT squad, bit, CASE WHEN position = 'DF' THEN row_number() OVER (PARTITION BY squad, position ORDER BY passes DESC, player_id) END AS o,
  CASE WHEN position = 'FW' THEN row_number() OVER (PARTITION BY squad, position ORDER BY passes, player_id) WHEN position = 'DF' AND row_number() OVER (PARTITION BY squad, position ORDER BY passes DESC, player_id) = 1 THEN {IN} END AS i FROM squad),
tags AS (SELECT squad, {', '.join(f"coalesce(max(CASE WHEN o = {i + 1} THEN bit END), 0) AS out{i + 1}" for i in range(OUT))}, {', '.join(f"coalesce(max(CASE WHEN i = {i + 1} THEN bit END) FILTER (WHERE {'o IS NULL' if i + 1 < IN else 'o = 1'}), 0) AS in{i + 1}" for i in range(IN))} FROM ranked GROUP BY squad),
sat AS (SELECT DISTINCT g.squad, CAST({_SAT} AS BIGINT) AS sat FROM pg_any g JOIN pd_any d ON d.squad = g.squad JOIN pm_any m ON m.squad = g.squad AND m.mask & d.mask = 0 JOIN pf_any f ON f.squad = g.squad AND f.mask & (d.mask | m.mask) = 0 JOIN tags t ON t.squad = g.squad),
sats AS (SELECT squad, list(sat) AS sats FROM sat GROUP BY squad),
fold AS (SELECT squad, len(list_filter(sats, lambda s: s = {_EVERY})) > 0 AS ok, sats, list_reduce(list_prepend(CAST({_EVERY} AS BIGINT), CAST(range({len(DECLARATIONS)}) AS BIGINT[])), lambda t, i: CASE WHEN len(list_filter(sats, lambda s: s & (t & ~(CAST(1 AS BIGINT) << i)) = t & ~(CAST(1 AS BIGINT) << i))) > 0 THEN t ELSE t & ~(CAST(1 AS BIGINT) << i) END) AS kept,
  list_sum(list_transform(range({len(DECLARATIONS)}), lambda i: CASE WHEN len(list_filter(sats, lambda s: s & ({_EVERY} & ~(CAST(1 AS BIGINT) << i)) = {_EVERY} & ~(CAST(1 AS BIGINT) << i))) > 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS back FROM sats)
SELECT squad, CASE WHEN ok THEN 'FEASIBLE' ELSE 'CONFLICT' END AS status, CASE WHEN ok THEN '' ELSE {_BITS('kept')} END AS conflict, CASE WHEN ok THEN '' ELSE {_BITS('CAST(back AS BIGINT)')} END AS restores FROM fold"""
)
def eleven_conflicts(spark, sf_dir):
    """Which of a squad's declarations cannot hold together, none of them dispensable, over all partial assignments; and the
    single ones without which all the others can. One defender is declared both out and in."""
    s = squads(spark, sf_dir)
    o = F.row_number().over(Window.partitionBy("squad", "position").orderBy(F.desc("passes"), "player_id"))
    i = F.row_number().over(Window.partitionBy("squad", "position").orderBy("passes", "player_id"))
    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))
    out = F.when((F.col("position") == "DF") & (F.col("o") <= OUT), bit(F.col("o") - 1)).otherwise(0)
    into = F.when((F.col("position") == "FW") & (F.col("i") < IN), bit(F.col("i") - 1 + OUT)).when((F.col("position") == "DF") & (F.col("o") == 1), 1 << (OUT + IN - 1)).otherwise(0)
    tagged = s.withColumn("o", o).withColumn("i", i).withColumn("tag", out + into)
    c = E.conflicts(E.satisfied(tagged, FORMATION, FLOORS, OUT, IN, applies=APPLIES), len(DECLARATIONS))
    return c.select("squad", "status", E.named_bits("conflict", DECLARATIONS).alias("conflict"), E.named_bits("restores", DECLARATIONS).alias("restores"))


@query(
    SETS + """, v AS (SELECT DISTINCT squad, passes, shots, touches FROM eleven), best AS (SELECT * FROM v a WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.squad = a.squad AND b.passes >= a.passes AND b.shots >= a.shots AND b.touches >= a.touches AND (b.passes > a.passes OR b.shots > a.shots OR b.touches > a.touches))),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY squad ORDER BY passes DESC, shots DESC, touches DESC) AS INTEGER) AS place, count(*) OVER (PARTITION BY squad) AS n FROM best)
SELECT squad, place, CAST(passes AS BIGINT) AS passes, CAST(shots AS BIGINT) AS shots, CAST(touches AS BIGINT) AS touches, n <= 64 AS complete FROM k WHERE place <= 64"""
)
def eleven_frontier(spark, sf_dir):
    """The nondominated sums of all elevens in three requirements, complete or the largest part in descending order."""
    return E.skyline(E.totals(squads(spark, sf_dir), FORMATION, list(MINIMA), applies=APPLIES), list(MINIMA))


#: Stages of a player's way into a slot; each takes away from the one before.
STAGES = ("position_admissible", "rule_eligible", "gated", "measured", "available", "shortfall_neutral")
_OWN = "list_sum(list_transform(slots, lambda x: CASE x WHEN 'GK' THEN 1 WHEN 'DF' THEN 2 WHEN 'MD' THEN 4 ELSE 8 END))"
_STAGE = f"""roster AS (SELECT * REPLACE (slots AS slots), CASE position WHEN 'GK' THEN 1 WHEN 'MD' THEN 4 WHEN 'DF' THEN 6 ELSE 12 END AS s0, CAST({_OWN} AS BIGINT) AS s1, m >= {GATE} AS in_gate, least(passes, shots, touches) > 0 OR position = 'GK' AS has_all, player_id % 29 <> 0 AS stays FROM squad),
stage AS (SELECT *, CASE WHEN in_gate THEN s1 ELSE 0 END AS s2, CASE WHEN in_gate AND has_all THEN s1 ELSE 0 END AS s3, CASE WHEN in_gate AND has_all AND stays THEN s1 ELSE 0 END AS s4 FROM roster)"""
_CHAIN = (
    SQUAD + ", " + _STAGE + ", ready AS (SELECT * FROM stage WHERE s4 <> 0), " + ", ".join([_set("gk", "GK", 1, "ready"), _set("df", "DF", 4, "ready"), _set("md", "MD", 3, "ready"), _set("fw", "FW", 3, "ready"), _join("eleven", "gk df md fw")])
    + f", loss AS (SELECT squad, gm, dm, mm, fm, mask, {_LOSS} AS z FROM eleven)" + _STANDING.replace("FROM squad)", "FROM ready)", 1)
    + ", neutral AS (SELECT squad, player_id, sum(CASE slot WHEN 'GK' THEN 1 WHEN 'DF' THEN 2 WHEN 'MD' THEN 4 ELSE 8 END) AS s5 FROM standing WHERE standing = 'NEUTRAL' GROUP BY squad, player_id), chain AS (SELECT stage.*, CAST(coalesce(s5, 0) AS BIGINT) AS s5 FROM stage LEFT JOIN neutral USING (squad, player_id))"
)


def depth_stages(spark, sf_dir) -> DataFrame:
    """Each player's slots (bits) at each stage; the last one asks whether the squad's least loss stands with the player there."""
    s = squads(spark, sf_dir)
    own = sum((F.when(F.array_contains("slots", x), 1 << i).otherwise(0) for i, x in enumerate(FORMATION)), F.lit(0))
    position = F.when(F.col("position") == "GK", 1).when(F.col("position") == "MD", 4).when(F.col("position") == "DF", 6).otherwise(12)
    measured = (F.least(*MINIMA) > 0) | (F.col("position") == "GK")
    gated, stays = F.col("m") >= GATE, F.col("player_id") % 29 != 0
    keep = lambda ok: F.when(ok, F.col("rule_eligible")).otherwise(0)
    rows = s.withColumn("position_admissible", position).withColumn("rule_eligible", own)
    rows = rows.withColumn("gated", keep(gated)).withColumn("measured", keep(gated & measured)).withColumn("available", keep(gated & measured & stays))
    at = F.array_position(F.array(*[F.lit(x) for x in FORMATION]), F.col("slot")) - 1
    neutral_at = standings(rows.where("available <> 0")).where("standing = 'NEUTRAL'").groupBy("squad", "player_id").agg(F.sum(F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))).alias("shortfall_neutral"))
    return rows.join(neutral_at, ["squad", "player_id"], "left").fillna(0, ["shortfall_neutral"])


_LONG = " UNION ALL ".join(f"SELECT squad, player_id, {i} AS step, '{n}' AS stage, CAST(s{i} AS BIGINT) AS own FROM chain" for i, n in enumerate(STAGES))


@query(_CHAIN + f", long AS ({_LONG}) SELECT squad, stage, slot, count(*) FILTER (WHERE own & bit <> 0) AS players FROM long, (VALUES ('GK', 1), ('DF', 2), ('MD', 4), ('FW', 8)) AS b(slot, bit) GROUP BY squad, stage, slot")
def depth_chain(spark, sf_dir):
    """How many players each stage leaves for each slot."""
    rows = depth_stages(spark, sf_dir)
    cells = [F.struct(F.lit(n).alias("stage"), F.lit(s).alias("slot"), (F.col(n).bitwiseAND(F.lit(1 << i)) != 0).alias("on")) for n in STAGES for i, s in enumerate(FORMATION)]
    return rows.select("squad", F.explode(F.array(*cells)).alias("c")).groupBy("squad", "c.stage", "c.slot").agg(F.count_if("c.on").alias("players"))


@query(
    _CHAIN + f", long AS ({_LONG}), slot_group AS (SELECT * FROM (VALUES {_GROUPS}) AS v(g, places, name))," + """
spare AS (SELECT squad, step, stage, g, name, count(*) FILTER (WHERE own & g <> 0) - places AS spare FROM long, slot_group GROUP BY squad, step, stage, g, name, places), low AS (SELECT *, min(spare) OVER (PARTITION BY squad, step) AS least FROM spare),
tight AS (SELECT squad, step, string_agg(name, ' ' ORDER BY name) AS tight FROM low a WHERE spare = least AND NOT EXISTS (SELECT 1 FROM low b WHERE b.squad = a.squad AND b.step = a.step AND b.spare = b.least AND b.g <> a.g AND b.g & a.g = a.g) GROUP BY squad, step),
k AS (SELECT squad, step, stage, any_value(least) AS least FROM low GROUP BY squad, step, stage), f AS (SELECT *, 11 + least(0, least) AS filled FROM k)
SELECT squad, stage, CAST(least + 1 AS BIGINT) AS kappa, CAST(filled AS BIGINT) AS filled, CAST(coalesce(lag(filled) OVER (PARTITION BY squad ORDER BY step), 11) - filled AS BIGINT) AS lost, tight FROM f JOIN tight USING (squad, step)"""
)
def depth_by_stage(spark, sf_dir):
    """The fewest absences that can leave a place open, the places that can be filled, and those that each stage costs."""
    return E.depth(depth_stages(spark, sf_dir), FORMATION, STAGES)
