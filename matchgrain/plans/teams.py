"""Team descriptors, prior states, shrunken estimates and walk-forward schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import estimators as est
from ..operators.descriptors import ATTACKS
from ..sources import neutral
from .registry import query

PARTS = ATTACKS.names
CUT, PSEUDO, K_CONTEXT, K_UNIT = 20, 1.0, 8.0, 12.0

_PLACED = "(start_x BETWEEN 0 AND 1 AND start_y BETWEEN 0 AND 1 AND NOT (start_x = 0 AND start_y = 0) AND NOT (start_x = 1 AND start_y = 1) AND end_x BETWEEN 0 AND 1 AND end_y BETWEEN 0 AND 1 AND NOT (end_x = 0 AND end_y = 0) AND NOT (end_x = 1 AND end_y = 1))"
_HIT = "((type = 'pass' AND success IS NOT DISTINCT FROM TRUE) OR type = 'shot') AND NOT (start_x >= 0.8) AND end_x > 0.5"
ROWS = f""", c AS (SELECT game_id, team_id, count(*) FILTER (WHERE {_HIT} AND {_PLACED} AND end_y < 0.35) AS n_left, count(*) FILTER (WHERE {_HIT} AND {_PLACED} AND end_y > 0.65) AS n_right,
  count(*) FILTER (WHERE {_HIT} AND {_PLACED} AND NOT (end_y < 0.35) AND NOT (end_y > 0.65)) AS n_centre, count(*) FILTER (WHERE {_HIT} AND NOT {_PLACED}) AS dropped,
  CAST(count(*) FILTER (WHERE goal) AS BIGINT) AS goals_for FROM actions GROUP BY ALL),
x AS (SELECT game_id, sum(m) / 60.0 AS exposure FROM (SELECT game_id, period, max(seconds) AS m FROM actions GROUP BY ALL) GROUP BY game_id),
r AS (SELECT c.game_id AS day, CASE c.team_id WHEN 0 THEN c.game_id % 6 ELSE (c.game_id * 5 + 1) % 6 END AS unit_id, CASE c.team_id WHEN 1 THEN c.game_id % 6 ELSE (c.game_id * 5 + 1) % 6 END AS context_id,
  CAST(c.team_id AS INTEGER) AS context_home, c.n_left, c.n_right, c.n_centre, c.dropped, exposure, c.goals_for, o.goals_for AS goals_against, c.game_id % 9 <> 4 AS valid
  FROM c JOIN x USING (game_id) JOIN c o ON o.game_id = c.game_id AND o.team_id <> c.team_id)"""
STATE = ROWS + f""", s AS (SELECT context_id, unit_id, context_home, sum(n_left * 1.0 / (1 + day % 2)) AS l, sum(n_right * 1.0 / (1 + day % 2)) AS r, sum(n_centre * 1.0 / (1 + day % 2)) AS c, sum(exposure / (1 + day % 2)) AS exposure
  FROM r WHERE valid AND day < {CUT} GROUP BY ALL)"""
SHAPE = STATE + f""", v AS (SELECT coalesce(sum(l) FILTER (WHERE context_home = 0), 0) AS l0, coalesce(sum(r) FILTER (WHERE context_home = 0), 0) AS r0, coalesce(sum(c) FILTER (WHERE context_home = 0), 0) AS c0,
  coalesce(sum(l) FILTER (WHERE context_home = 1), 0) AS l1, coalesce(sum(r) FILTER (WHERE context_home = 1), 0) AS r1, coalesce(sum(c) FILTER (WHERE context_home = 1), 0) AS c1 FROM s),
g AS (SELECT (l0 + l1 + 1) / (l0 + l1 + r0 + r1 + c0 + c1 + 3) AS pl, (r0 + r1 + 1) / (l0 + l1 + r0 + r1 + c0 + c1 + 3) AS pr, (c0 + c1 + 1) / (l0 + l1 + r0 + r1 + c0 + c1 + 3) AS pc,
  (l0 + 1) / (l0 + r0 + c0 + 3) AS vl0, (r0 + 1) / (l0 + r0 + c0 + 3) AS vr0, (c0 + 1) / (l0 + r0 + c0 + 3) AS vc0, (l1 + 1) / (l1 + r1 + c1 + 3) AS vl1, (r1 + 1) / (l1 + r1 + c1 + 3) AS vr1, (c1 + 1) / (l1 + r1 + c1 + 3) AS vc1 FROM v),
bc AS (SELECT context_id, sum(l) AS l, sum(r) AS r, sum(c) AS c FROM s GROUP BY context_id), bu AS (SELECT context_id, unit_id, sum(l) AS l, sum(r) AS r, sum(c) AS c FROM s GROUP BY ALL),
w AS (SELECT context_id, unit_id, bc.l - bu.l + {K_CONTEXT} * pl AS wl, bc.r - bu.r + {K_CONTEXT} * pr AS wr, bc.c - bu.c + {K_CONTEXT} * pc AS wc FROM bu JOIN bc USING (context_id), g),
q AS (SELECT s.*, CASE context_home WHEN 1 THEN wl * vl1 / pl ELSE wl * vl0 / pl END AS a, CASE context_home WHEN 1 THEN wr * vr1 / pr ELSE wr * vr0 / pr END AS b, CASE context_home WHEN 1 THEN wc * vc1 / pc ELSE wc * vc0 / pc END AS d FROM s JOIN w USING (context_id, unit_id), g),
u AS (SELECT unit_id, sum(l) AS l, sum(r) AS r, sum(c) AS c, sum(l + r + c) AS total, sum((l + r + c) * a / (a + b + d)) AS el, sum((l + r + c) * b / (a + b + d)) AS er, sum((l + r + c) * d / (a + b + d)) AS ec FROM q GROUP BY unit_id),
h AS (SELECT unit_id, total, CASE WHEN total > 0 THEN ln((l + {K_UNIT} * el / total) / (total + {K_UNIT})) - ln(el / total) ELSE 0 END AS dl, CASE WHEN total > 0 THEN ln((r + {K_UNIT} * er / total) / (total + {K_UNIT})) - ln(er / total) ELSE 0 END AS dr,
  CASE WHEN total > 0 THEN ln((c + {K_UNIT} * ec / total) / (total + {K_UNIT})) - ln(ec / total) ELSE 0 END AS dc FROM u)"""
LEVEL = STATE + f""", e AS (SELECT *, l + r + c AS events FROM s), rr AS (SELECT sum(events) FILTER (WHERE context_home = 0) / sum(exposure) FILTER (WHERE context_home = 0) AS r0, sum(events) FILTER (WHERE context_home = 1) / sum(exposure) FILTER (WHERE context_home = 1) AS r1, sum(events) / sum(exposure) AS rate FROM e),
b AS (SELECT e.*, CASE WHEN exposure > 0 THEN exposure * CASE context_home WHEN 1 THEN r1 ELSE r0 END ELSE 0 END AS baseline, rate FROM e, rr),
lc AS (SELECT context_id, sum(events) + {K_CONTEXT} AS ce, sum(baseline) + {K_CONTEXT} AS cb FROM b GROUP BY context_id), lo AS (SELECT context_id, unit_id, sum(events) AS oe, sum(baseline) AS ob FROM b GROUP BY ALL),
lu AS (SELECT unit_id, sum(oe) AS observed, sum(ob * (ce - oe) / (cb - ob)) AS expected FROM lo JOIN lc USING (context_id) GROUP BY unit_id),
lv AS (SELECT unit_id, observed, expected, rate, (observed + {K_UNIT}) / (expected + {K_UNIT}) AS unit_ratio FROM lu, rr)"""


def rows(spark, sf_dir) -> DataFrame:
    """A descriptor row of each team-match: the unit's counts by part, the match's exposure in minutes, both scores."""
    a = neutral.actions(spark, sf_dir)
    counts = ATTACKS.counts(a, "game_id", "team_id").join(a.groupBy("game_id", "team_id").agg(F.count_if("goal").alias("goals_for")), ["game_id", "team_id"])
    exposure = a.groupBy("game_id", "period").agg(F.max("seconds").alias("m")).groupBy("game_id").agg((F.sum("m") / 60.0).alias("exposure"))
    against = counts.select("game_id", (1 - F.col("team_id")).alias("team_id"), F.col("goals_for").alias("goals_against"))
    home, away = F.col("game_id") % 6, (F.col("game_id") * 5 + 1) % 6
    first = F.col("team_id") == 0
    return counts.join(exposure, "game_id").join(against, ["game_id", "team_id"]).select(
        F.col("game_id").alias("day"), F.when(first, home).otherwise(away).alias("unit_id"), F.when(first, away).otherwise(home).alias("context_id"), F.col("team_id").cast("int").alias("context_home"),
        *[f"n_{p}" for p in PARTS], "dropped", "exposure", "goals_for", "goals_against", (F.col("game_id") % 9 != 4).alias("valid"),
    )


def state(spark, sf_dir) -> DataFrame:
    return est.state_at(rows(spark, sf_dir), PARTS, F.col("day") < CUT, 1.0 / (1 + F.col("day") % 2))


@query(neutral.SQL + ROWS + " SELECT day, unit_id, context_id, context_home, n_left, n_right, n_centre, dropped, round(exposure, 6) AS exposure, goals_for, goals_against, valid FROM r")
def descriptor_rows(spark, sf_dir):
    return rows(spark, sf_dir).withColumn("exposure", F.round("exposure", 6))


@query(neutral.SQL + STATE + ' SELECT context_id, unit_id, context_home, round(l, 6) AS "left", round(r, 6) AS "right", round(c, 6) AS centre, round(exposure, 6) AS exposure FROM s')
def prior_state(spark, sf_dir):
    """Weighted sums by opponent, team and venue over matches strictly before a day."""
    return state(spark, sf_dir).select(*est.KEYS, *[F.round(p, 6).alias(p) for p in PARTS], F.round("exposure", 6).alias("exposure"))


@query(neutral.SQL + SHAPE + " SELECT unit_id, round(total, 6) AS total, round(dl, 6) + 0.0 AS delta_left, round(dr, 6) + 0.0 AS delta_right, round(dc, 6) + 0.0 AS delta_centre FROM h")
def shape_estimate(spark, sf_dir):
    """Leave-one-unit-out composition of each team as log deviations."""
    s = est.shape(state(spark, sf_dir), PARTS, PSEUDO, K_CONTEXT, K_UNIT)
    return s.select("unit_id", F.round("total", 6).alias("total"), *[(F.round(f"delta_{p}", 6) + 0.0).alias(f"delta_{p}") for p in PARTS])


@query(neutral.SQL + LEVEL + " SELECT unit_id, round(observed, 6) AS observed, round(expected, 6) AS expected, round(unit_ratio, 6) AS unit_ratio FROM lv")
def level_estimate(spark, sf_dir):
    """Observed over expected events of each team, the expectation without its own matches."""
    lv = est.level(state(spark, sf_dir), PARTS, K_CONTEXT, K_UNIT)
    return lv.select("unit_id", *[F.round(c, 6).alias(c) for c in ("observed", "expected", "unit_ratio")])


@query(
    neutral.SQL + SHAPE + LEVEL[len(STATE) :] + f""", z AS (SELECT unit_id, total, pl * exp(dl) AS zl, pr * exp(dr) AS zr, pc * exp(dc) AS zc FROM h, g)
SELECT z.unit_id, round(zl / (zl + zr + zc), 6) AS share_left, round(zr / (zl + zr + zc), 6) AS share_right, round(zc / (zl + zr + zc), 6) AS share_centre, round(total / (total + {K_UNIT}), 6) AS shape_weight,
  round(rate * unit_ratio, 6) AS volume, round(expected / (expected + {K_UNIT}), 6) AS volume_weight FROM z JOIN lv USING (unit_id)"""
)
def served_teams(spark, sf_dir):
    """What is shown of a team: composition and volume, each with the weight that its own data have."""
    s = state(spark, sf_dir)
    lg = F.broadcast(est.league(s, PARTS, PSEUDO))
    comp = est.composition([F.col(f"pi_{p}") * F.exp(f"delta_{p}") for p in PARTS])
    shape = est.shape(s, PARTS, PSEUDO, K_CONTEXT, K_UNIT).join(lg)
    shape = shape.select("unit_id", *[F.round(c, 6).alias(f"share_{p}") for c, p in zip(comp, PARTS, strict=True)], F.round(F.col("total") / (F.col("total") + K_UNIT), 6).alias("shape_weight"))
    lv = est.level(s, PARTS, K_CONTEXT, K_UNIT)
    lv = lv.select("unit_id", F.round(F.col("rate") * F.col("unit_ratio"), 6).alias("volume"), F.round(F.col("expected") / (F.col("expected") + K_UNIT), 6).alias("volume_weight"))
    return shape.join(lv, "unit_id")


@query(
    neutral.SQL + SHAPE + LEVEL[len(STATE) :] + f""", k AS (SELECT context_id, (l + {K_CONTEXT} * pl) / (l + r + c + {K_CONTEXT}) AS kl, (r + {K_CONTEXT} * pr) / (l + r + c + {K_CONTEXT}) AS kr, (c + {K_CONTEXT} * pc) / (l + r + c + {K_CONTEXT}) AS kc FROM bc, g),
t AS (SELECT r.day, r.unit_id, r.exposure, kl * exp(dl) * CASE context_home WHEN 1 THEN vl1 ELSE vl0 END / pl AS a, kr * exp(dr) * CASE context_home WHEN 1 THEN vr1 ELSE vr0 END / pr AS b, kc * exp(dc) * CASE context_home WHEN 1 THEN vc1 ELSE vc0 END / pc AS d,
  r.exposure * CASE context_home WHEN 1 THEN r1 ELSE r0 END * ce / cb * unit_ratio AS volume FROM r JOIN k USING (context_id) JOIN h USING (unit_id) JOIN lc USING (context_id) JOIN lv ON lv.unit_id = r.unit_id, g, rr WHERE r.day >= {CUT})
SELECT day, unit_id, round(a / (a + b + d), 6) AS p_left, round(b / (a + b + d), 6) AS p_right, round(d / (a + b + d), 6) AS p_centre, round(volume, 6) AS volume FROM t"""
)
def predicted_matches(spark, sf_dir):
    """Composition and volume that the prior state predicts for every later match."""
    s = state(spark, sf_dir)
    lg = est.league(s, PARTS, PSEUDO)
    _, rates = est._baselines(s, PARTS)
    rate = F.when(F.col("context_home") == 1, F.col("rate1")).otherwise(F.col("rate0"))
    r = rows(spark, sf_dir).where(F.col("day") >= CUT).select("day", "unit_id", "context_id", "context_home", "exposure")
    r = r.join(est.contexts(s, PARTS, lg, K_CONTEXT), "context_id").join(est.shape(s, PARTS, PSEUDO, K_CONTEXT, K_UNIT), "unit_id").join(est.context_levels(s, PARTS, K_CONTEXT), "context_id")
    r = r.join(est.level(s, PARTS, K_CONTEXT, K_UNIT).select("unit_id", "unit_ratio"), "unit_id").join(F.broadcast(lg)).join(F.broadcast(rates.drop("rate")))
    comp = est.composition([F.col(f"ctx_{p}") * F.exp(est.nu(p) + F.col(f"delta_{p}")) for p in PARTS])
    return r.select("day", "unit_id", *[F.round(c, 6).alias(f"p_{p}") for c, p in zip(comp, PARTS, strict=True)], F.round(F.col("exposure") * rate * F.col("context_ratio") * F.col("unit_ratio"), 6).alias("volume"))


@query(
    neutral.SQL + ROWS + """, b AS (SELECT unit_id, day, CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END AS p, goals_for - goals_against AS m, valid FROM r),
days AS (SELECT unnest(range(min(day) + 1, max(day) + 1)) AS day FROM r), rec AS (SELECT b.unit_id, d.day, count(*) AS sheet, count(*) FILTER (WHERE valid) AS played, sum(p) AS points, sum(m) AS margin FROM days d JOIN b ON b.day < d.day GROUP BY ALL)
SELECT unit_id, day, CAST(floor(3 * (row_number() OVER (PARTITION BY day ORDER BY points / sheet DESC, margin / sheet DESC, unit_id) - 1) / count(*) OVER (PARTITION BY day)) AS INTEGER) AS tier, played, played >= 3 AS ready FROM rec"""
)
def strength_groups(spark, sf_dir):
    """Thirds of the table before each day; what a day brings is never part of its own groups."""
    return est.tiers(rows(spark, sf_dir).select("unit_id", "day", "goals_for", "goals_against", "valid"), 3, 3)


@query(
    neutral.SQL + ROWS + """ SELECT unit_id, day, CAST(coalesce(sum(n_left) OVER w, 0) AS BIGINT) AS recent_left, CAST(coalesce(sum(n_right) OVER w, 0) AS BIGINT) AS recent_right, CAST(coalesce(sum(n_centre) OVER w, 0) AS BIGINT) AS recent_centre,
  round(coalesce(sum(exposure) OVER w, 0.0), 6) AS recent_exposure FROM r WHERE valid WINDOW w AS (PARTITION BY unit_id ORDER BY day ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"""
)
def recent_matches(spark, sf_dir):
    """A ring of the last three valid matches of each team."""
    return est.recent(rows(spark, sf_dir), PARTS, 3)
