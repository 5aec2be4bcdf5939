"""Forecasts refitted fold by fold, held against each other by week, and composition losses against simpler histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import estimators, linear
from ..operators import worlds as ws
from ..sources import neutral
from . import teams
from .registry import query
from .reliability import PRIOR, forecast

STARTS = (12, 17, 22, 27)
DESIGNS = {"context": ("home", "other"), "augmented": ("home", "other", "form")}
WORLDS, SEED = 60, 41
LEAST_ROWS, LEAST_WEEKS = 20, 3

_PAIR = PRIOR + """, pair AS (SELECT x.team, x.game_id, x.gf, x.form, y.leak AS other, CASE WHEN x.team = 'team' || (x.game_id % 6) THEN 1.0 ELSE 0.0 END AS home FROM fr x JOIN fr y ON x.game_id = y.game_id AND x.team <> y.team WHERE len(x.reasons) = 0 AND len(y.reasons) = 0)"""


def pairs(spark, sf_dir):
    """Team-matches that may be forecast: the team's form, what the opponent lets in, and the venue, all from before the day."""
    f = forecast(spark, sf_dir).where("size(reasons) = 0")
    other = f.select("game_id", F.col("team").alias("against"), F.col("leak").alias("other"))
    home = F.when(F.col("team") == F.concat(F.lit("team"), F.col("game_id") % 6), 1.0).otherwise(0.0)
    return f.join(other, "game_id").where("team <> against").select("team", "game_id", "gf", "form", "other", home.alias("home"))


def _cholesky(source: str, name: str, p: int, g, r) -> str:
    """SQL that solves a symmetric system a step at a time; ``g(i, j)`` and ``r(i)`` give its entries."""
    steps, n = [], 0

    def step(column: str, expression: str) -> None:
        nonlocal n
        steps.append(f"{name}{n + 1} AS (SELECT *, {expression} AS {column} FROM {source if n == 0 else f'{name}{n}'})")
        n += 1

    for j in range(p):
        minus = "".join(f" - {name}_l{j}{k} * {name}_l{j}{k}" for k in range(j))
        step(f"{name}_l{j}{j}", f"CASE WHEN {g(j, j)}{minus} > {linear.SINGULAR!r} * {g(j, j)} THEN sqrt({g(j, j)}{minus}) END")
        for i in range(j + 1, p):
            step(f"{name}_l{i}{j}", f"({g(i, j)}" + "".join(f" - {name}_l{i}{k} * {name}_l{j}{k}" for k in range(j)) + f") / {name}_l{j}{j}")
    for i in range(p):
        step(f"{name}_y{i}", f"({r(i)}" + "".join(f" - {name}_l{i}{k} * {name}_y{k}" for k in range(i)) + f") / {name}_l{i}{i}")
    for i in reversed(range(p)):
        step(f"{name}_{i}", f"({name}_y{i}" + "".join(f" - {name}_l{k}{i} * {name}_{k}" for k in range(i + 1, p)) + f") / {name}_l{i}{i}")
    return ", ".join(steps), f"{name}{n}"


_COLUMNS = ["1.0", "home", "other", "form"]
_FOLD = "(" + " + ".join(f"CASE WHEN game_id >= {s} THEN 1 ELSE 0 END" for s in STARTS) + ")"
# The oracle reads each fold's past anew.
_GRAM = ", ".join(f"coalesce(sum({a} * {b}), 0.0) AS g{i}{j}" for i, a in enumerate(_COLUMNS) for j, b in enumerate(_COLUMNS) if j <= i) + ", " + ", ".join(f"coalesce(sum({a} * gf), 0.0) AS r{i}" for i, a in enumerate(_COLUMNS))
_C, _C_LAST = _cholesky("base", "context", 3, lambda i, j: f"g{i}{j}", lambda i: f"r{i}")
_A, _A_LAST = _cholesky(_C_LAST, "augmented", 4, lambda i, j: f"g{i}{j}", lambda i: f"r{i}")
FOLDS = neutral.SQL + _PAIR + f""", folds AS (SELECT * FROM (VALUES {', '.join(f'({i + 1}, {s})' for i, s in enumerate(STARTS))}) AS v(fold, start)),
base AS (SELECT fold, count(game_id) AS fitted_rows, {_GRAM} FROM folds LEFT JOIN pair ON game_id < start GROUP BY fold), {_C}, {_A},
pred AS (SELECT p.*, f.fold, fitted_rows, context_0 + context_1 * home + context_2 * other AS craw, augmented_0 + augmented_1 * home + augmented_2 * other + augmented_3 * form AS araw
  FROM (SELECT *, {_FOLD} AS in_fold FROM pair) p JOIN {_A_LAST} f ON f.fold = p.in_fold),
err AS (SELECT *, greatest(craw, 0.0) AS context, greatest(araw, 0.0) AS augmented FROM pred)"""


def predicted(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return linear.predictions(p, linear.fold_fits(p, DESIGNS, "gf", "game_id", STARTS), DESIGNS, "game_id", STARTS)


@query(
    FOLDS + """ SELECT CAST(fold AS INTEGER) AS fold, any_value(fitted_rows) AS fitted_rows, count(*) AS n, count(*) FILTER (WHERE craw < 0) AS clipped_context, count(*) FILTER (WHERE araw < 0) AS clipped_augmented,
  round(avg(pow(context - gf, 2)), 5) AS mse_context, round(avg(pow(augmented - gf, 2)), 5) AS mse_augmented, round(avg(abs(context - gf)), 5) AS mae_context, round(avg(abs(augmented - gf)), 5) AS mae_augmented FROM err GROUP BY fold"""
)
def fold_errors(spark, sf_dir):
    """Two linear forecasts, refitted before every fold on all that came before, and their errors in it."""
    e = predicted(spark, sf_dir)
    error = lambda c: F.col(c) - F.col("gf")
    return e.groupBy("fold").agg(
        F.first("fitted_rows").alias("fitted_rows"), F.count("*").alias("n"), *[F.count_if(f"{d}_clipped").alias(f"clipped_{d}") for d in DESIGNS],
        *[F.round(F.avg(F.pow(error(d), F.lit(2))), 5).alias(f"mse_{d}") for d in DESIGNS], *[F.round(F.avg(F.abs(error(d))), 5).alias(f"mae_{d}") for d in DESIGNS],
    )


@query(
    FOLDS + f""", d AS (SELECT game_id // 7 AS week, sum(pow(augmented - gf, 2) - pow(context - gf, 2)) AS s, count(augmented) AS n FROM err GROUP BY 1), drawn AS (SELECT w, sum(k * s) / nullif(sum(k * n), 0) AS x FROM (SELECT *, {ws.poisson_sql('week', 'w', SEED)} AS k FROM d, (SELECT unnest(range({WORLDS})) AS w)) GROUP BY w),
i AS (SELECT count(x) AS worlds, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM drawn), t AS (SELECT sum(s) / sum(n) AS difference, sum(n) AS n, count(*) AS weeks FROM d)
SELECT CAST(n AS BIGINT) AS n, weeks, worlds, round(difference, 5) AS difference, round(low, 5) AS low, round(high, 5) AS high, CASE WHEN n < {LEAST_ROWS} OR weeks < {LEAST_WEEKS} THEN 'INCONCLUSIVE' WHEN high < 0 THEN 'INCREMENTAL_PREDICTION' ELSE 'NOT_ESTABLISHED' END AS status FROM t, i"""
)
def fold_verdict(spark, sf_dir):
    """The paired difference of both forecasts' squared errors, weeks resampled by hashed weights, and what it establishes."""
    e = predicted(spark, sf_dir)
    sq = lambda c: F.pow(F.col(c) - F.col("gf"), F.lit(2))
    d = e.groupBy(F.expr("game_id div 7").alias("week")).agg(F.sum(sq("augmented") - sq("context")).alias("s"), F.count("augmented").alias("n"))
    k = ws.poisson_weight(F.col("week"), F.col("w"), SEED)
    drawn = ws.in_worlds(d, WORLDS).withColumn("k", k).groupBy("w").agg(F.try_divide(F.sum(F.col("k") * F.col("s")), F.nullif(F.sum(F.col("k") * F.col("n")), F.lit(0))).alias("x"))
    i = drawn.agg(F.count("x").alias("worlds"), F.percentile("x", F.lit(0.025)).alias("low"), F.percentile("x", F.lit(0.975)).alias("high"))
    t = d.agg((F.sum("s") / F.sum("n")).alias("difference"), F.sum("n").alias("n"), F.count("*").alias("weeks")).join(F.broadcast(i))
    few = (F.col("n") < LEAST_ROWS) | (F.col("weeks") < LEAST_WEEKS)
    status = F.when(few, "INCONCLUSIVE").when(F.col("high") < 0, "INCREMENTAL_PREDICTION").otherwise("NOT_ESTABLISHED")
    return t.select("n", "weeks", "worlds", *[F.round(c, 5).alias(c) for c in ("difference", "low", "high")], status.alias("status"))


STRENGTHS, RECENT, SMOOTHING, TEAM_SEED = (4.0, 16.0, 64.0), 5, 0.5, 97
_SWAP = {"l": "r", "r": "l", "c": "c"}


def _three(f) -> str:
    return ", ".join(f(p) for p in "lrc")


def _dev(prefix: str, p: str) -> str:
    n, t = f"{prefix}{p}", f"({prefix}l + {prefix}r + {prefix}c)"
    return f"CASE WHEN {t} > 0 THEN ln(({n} + k * ({prefix}e{p} / {t})) / ({t} + k)) - ln({prefix}e{p} / {t}) ELSE 0 END"


def _log_loss(weights: dict[str, str]) -> str:
    total = " + ".join(f"({w})" for w in weights.values())
    return "-(" + " + ".join(f"n_{p} * ln(({w}) / ({total}))" for p, w in weights.items()) + ")"


_BASE = {p: f"k{p} * (CASE context_home WHEN 1 THEN v{p}1 ELSE v{p}0 END / p{p})" for p in "lrc"}
_FORECASTS = {
    "candidate": {p: f"({_BASE[p]}) * exp(d_{p})" for p in "lrc"}, "league_venue": {p: f"CASE context_home WHEN 1 THEN v{p}1 ELSE v{p}0 END" for p in "lrc"}, "context": _BASE, "recent": {p: f"recent_{p} + {SMOOTHING}" for p in "lrc"},
    "mirror": {p: f"({_BASE[p]}) * exp(d_{_SWAP[p]})" for p in "lrc"}, "peers": {p: f"({_BASE[p]}) * exp(peer_{p})" for p in "lrc"}, "permuted": {p: f"({_BASE[p]}) * exp(donor_{p})" for p in "lrc"},
}
# The oracle sums every day's past anew.
COMPOSITION = neutral.SQL + teams.ROWS + f""", m AS (SELECT day, unit_id, context_id, context_home, n_left AS n_l, n_right AS n_r, n_centre AS n_c FROM r WHERE valid),
st AS (SELECT t.day, m.context_id, m.unit_id, m.context_home, {_three(lambda p: f"CAST(sum(n_{p}) AS DOUBLE) AS {p}")} FROM (SELECT DISTINCT day FROM m) t JOIN m ON m.day < t.day GROUP BY ALL),
v AS (SELECT day, {", ".join(f"coalesce(sum({p}) FILTER (WHERE context_home = {h}), 0) AS {p}{h}" for p in "lrc" for h in (0, 1))} FROM st GROUP BY day),
g AS (SELECT day, {_three(lambda p: f"({p}0 + {p}1 + 1) / (l0 + l1 + r0 + r1 + c0 + c1 + 3) AS p{p}")}, {", ".join(f"({p}{h} + 1) / (l{h} + r{h} + c{h} + 3) AS v{p}{h}" for p in "lrc" for h in (0, 1))} FROM v),
bc AS (SELECT day, context_id, {_three(lambda p: f"sum({p}) AS {p}")} FROM st GROUP BY ALL), bu AS (SELECT day, context_id, unit_id, {_three(lambda p: f"sum({p}) AS {p}")} FROM st GROUP BY ALL),
w AS (SELECT bu.day, context_id, unit_id, {_three(lambda p: f"bc.{p} - bu.{p} + {teams.K_CONTEXT} * p{p} AS w{p}")} FROM bu JOIN bc USING (day, context_id) JOIN g USING (day)),
q AS (SELECT st.*, {_three(lambda p: f"w{p} * CASE context_home WHEN 1 THEN v{p}1 ELSE v{p}0 END / p{p} AS q{p}")} FROM st JOIN w USING (day, context_id, unit_id) JOIN g USING (day)),
u AS (SELECT day, unit_id, {_three(lambda p: f"sum({p}) AS {p}")}, {_three(lambda p: f"sum((l + r + c) * q{p} / (ql + qr + qc)) AS e{p}")} FROM q GROUP BY ALL),
b AS (SELECT unit_id, day, CASE WHEN goals_for > goals_against THEN 3 WHEN goals_for = goals_against THEN 1 ELSE 0 END AS p, goals_for - goals_against AS m, valid FROM r),
days AS (SELECT unnest(range(min(day) + 1, max(day) + 1)) AS day FROM r), rec AS (SELECT b.unit_id, d.day, count(*) AS sheet, count(*) FILTER (WHERE valid) AS played, sum(p) AS points, sum(m) AS margin FROM days d JOIN b ON b.day < d.day GROUP BY ALL),
tier AS (SELECT unit_id, day, CAST(floor(3 * (row_number() OVER (PARTITION BY day ORDER BY points / sheet DESC, margin / sheet DESC, unit_id) - 1) / count(*) OVER (PARTITION BY day)) AS INTEGER) AS tier, played >= 3 AS ready FROM rec),
known AS (SELECT * FROM tier JOIN u USING (day, unit_id)), pool AS (SELECT day, tier, {", ".join(f"sum({c}) AS t{c}" for c in ("l", "r", "c", "el", "er", "ec"))} FROM known GROUP BY ALL),
peer AS (SELECT known.*, {", ".join(f"t{c} - {c} AS p_{c}" for c in ("l", "r", "c", "el", "er", "ec"))} FROM known JOIN pool USING (day, tier)),
mixed AS (SELECT day, tier, unit_id, row_number() OVER (PARTITION BY day, tier ORDER BY unit_id) AS i, row_number() OVER (PARTITION BY day, tier ORDER BY md5('{TEAM_SEED}-' || day || '-' || unit_id), unit_id) AS j FROM known),
donor AS (SELECT a.day, a.unit_id, b.unit_id AS donor FROM mixed a JOIN mixed b ON b.day = a.day AND b.tier = a.tier AND b.j = a.i),
near AS (SELECT unit_id, day, {_three(lambda p: f"coalesce(sum(n_{p}) OVER w, 0) AS recent_{p}")} FROM m WINDOW w AS (PARTITION BY unit_id ORDER BY day ROWS BETWEEN {RECENT} PRECEDING AND 1 PRECEDING)),
ctx AS (SELECT bc.day, context_id, {_three(lambda p: f"({p} + {teams.K_CONTEXT} * p{p}) / (l + r + c + {teams.K_CONTEXT}) AS k{p}")} FROM bc JOIN g USING (day)),
met AS (SELECT m.*, k, donor <> m.unit_id AS donor_changed, {_three(lambda p: f"recent_{p}, k{p}, p{p}, v{p}0, v{p}1")}, {", ".join(f"peer.{c} AS o_{c}, p_{c}, z.{c} AS z_{c}" for c in ("l", "r", "c", "el", "er", "ec"))}
  FROM m JOIN peer ON peer.day = m.day AND peer.unit_id = m.unit_id AND ready JOIN donor ON donor.day = m.day AND donor.unit_id = m.unit_id JOIN u z ON z.day = m.day AND z.unit_id = donor JOIN near ON near.day = m.day AND near.unit_id = m.unit_id
  JOIN ctx ON ctx.day = m.day AND ctx.context_id = m.context_id JOIN g ON g.day = m.day, (SELECT unnest([{', '.join(map(str, STRENGTHS))}]) AS k)),
dv AS (SELECT *, {_three(lambda p: f"{_dev('o_', p)} AS d_{p}, {_dev('p_', p)} AS peer_{p}, {_dev('z_', p)} AS donor_{p}")} FROM met),
ls AS (SELECT day, unit_id, k, n_l + n_r + n_c AS events, donor_changed, {', '.join(f'{_log_loss(w)} AS {n}' for n, w in _FORECASTS.items())} FROM dv)"""


@query(
    COMPOSITION + " SELECT CAST(k AS DOUBLE) AS k, count(*) AS matches, CAST(sum(events) AS BIGINT) AS events, count(*) FILTER (WHERE donor_changed) AS donors_changed, " + ", ".join(f"round(sum({n}) / sum(events), 5) AS {n}" for n in _FORECASTS)
    + f", round(sum(candidate) / sum(events) - least({', '.join(f'sum({n})' for n in _FORECASTS if n != 'candidate')}) / sum(events), 5) + 0.0 AS above_best FROM ls GROUP BY k"
)
def composition_loss(spark, sf_dir):
    """Loss an event of a team's composition forecast and of six simpler ones, walking forward, for each strength of shrinkage."""
    r = teams.rows(spark, sf_dir)
    ls = estimators.composition_losses(r, teams.PARTS, [1, 0, 2], STRENGTHS, teams.PSEUDO, teams.K_CONTEXT, RECENT, SMOOTHING, TEAM_SEED)
    others = [n for n in _FORECASTS if n != "candidate"]
    best = F.least(*[F.sum(n) for n in others])
    per = lambda c: F.round(c / F.sum("events"), 5)
    return ls.groupBy("k").agg(
        F.count("*").alias("matches"), F.sum("events").alias("events"), F.count_if("donor_changed").alias("donors_changed"), *[per(F.sum(n)).alias(n) for n in _FORECASTS], (per(F.sum("candidate") - best) + 0.0).alias("above_best")
    )
