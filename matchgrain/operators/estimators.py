"""Prior states of teams and shrunken estimates from them, as grouped sums and joins on small team tables.

A state holds weighted part counts and exposure by (context, unit, home): the unit's events against the context team, and
whether the context team is at home. An estimate for a unit leaves its own matches out of the context it is held against.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut

KEYS = ("context_id", "unit_id", "context_home")


def _sum(cols: Sequence[Column]) -> Column:
    return sum(cols[1:], cols[0])


def composition(cols: Sequence[Column]) -> list[Column]:
    total = _sum(list(cols))
    return [c / total for c in cols]


def state_at(rows: DataFrame, parts: Sequence[str], before: Column, weight: Column) -> DataFrame:
    """Sums of valid rows strictly before a day; a weight of zero counts as absent."""
    w = weight.cast("double")
    return rows.where(before & F.col("valid") & (w > 0)).groupBy(*KEYS).agg(*[F.sum(F.col(f"n_{p}") * w).alias(p) for p in parts], F.sum(F.col("exposure") * w).alias("exposure"))


def league(state: DataFrame, parts: Sequence[str], pseudo: float, by: Sequence[str] = ()) -> DataFrame:
    """One row for each of ``by``: the league's composition ``pi_*`` and its venue offsets ``nu0_*`` (away), ``nu1_*`` (home)."""
    at = lambda h, p: F.coalesce(F.sum(F.when(F.col("context_home") == h, F.col(p))), F.lit(0.0))
    sums = state.groupBy(*by).agg(*[at(h, p).alias(f"v{h}_{p}") for h in (0, 1) for p in parts])
    pi = composition([F.col(f"v0_{p}") + F.col(f"v1_{p}") + pseudo for p in parts])
    venue = {h: composition([F.col(f"v{h}_{p}") + pseudo for p in parts]) for h in (0, 1)}
    return sums.select(*by, *[c.alias(f"pi_{p}") for c, p in zip(pi, parts, strict=True)], *[(F.log(v) - F.log(c)).alias(f"nu{h}_{p}") for h in (0, 1) for v, c, p in zip(venue[h], pi, parts, strict=True)])


def with_league(df: DataFrame, lg: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.join(lg, list(by)) if by else df.join(F.broadcast(lg))


def nu(p: str) -> Column:
    return F.when(F.col("context_home") == 1, F.col(f"nu1_{p}")).otherwise(F.col(f"nu0_{p}"))


def contexts(state: DataFrame, parts: Sequence[str], lg: DataFrame, k_context: float, by: Sequence[str] = ()) -> DataFrame:
    """Each context team's composition, shrunk to the league's."""
    own = with_league(state.groupBy(*by, "context_id").agg(*[F.sum(p).alias(p) for p in parts]), lg, by)
    comp = composition([F.col(p) + k_context * F.col(f"pi_{p}") for p in parts])
    return own.select(*by, "context_id", *[c.alias(f"ctx_{p}") for c, p in zip(comp, parts, strict=True)])


def expected(state: DataFrame, parts: Sequence[str], pseudo: float, k_context: float, by: Sequence[str] = ()) -> DataFrame:
    """``by, unit_id``, a unit's counts, ``e_*`` that its opponents (without it) and venues let expect, and ``total``."""
    lg = league(state, parts, pseudo, by)
    by_context = state.groupBy(*by, "context_id").agg(*[F.sum(p).alias(f"c_{p}") for p in parts])
    own = state.groupBy(*by, "context_id", "unit_id").agg(*[F.sum(p).alias(f"o_{p}") for p in parts])
    without = with_league(own.join(by_context, [*by, "context_id"]), lg, by)
    rest = composition([F.col(f"c_{p}") - F.col(f"o_{p}") + k_context * F.col(f"pi_{p}") for p in parts])
    without = without.select(*by, "context_id", "unit_id", *[c.alias(f"w_{p}") for c, p in zip(rest, parts, strict=True)])
    met = with_league(state.join(without, [*by, "context_id", "unit_id"]), lg, by)
    share = composition([F.col(f"w_{p}") * F.exp(nu(p)) for p in parts])
    total = _sum([F.col(p) for p in parts])
    return met.groupBy(*by, "unit_id").agg(*[F.sum(p).alias(p) for p in parts], *[F.sum(total * s).alias(f"e_{p}") for s, p in zip(share, parts, strict=True)]).withColumn("total", total)


def deviation(counts: Sequence[Column], expected: Sequence[Column], k_unit: Column | float) -> list[Column]:
    """Log deviations of counts from what is expected of as many, shrunk by ``k_unit`` expected ones; none without counts."""
    total = _sum(counts)
    prior = [e / total for e in expected]
    return [F.when(total > 0, F.log((n + k_unit * q) / (total + k_unit)) - F.log(q)).otherwise(0.0) for n, q in zip(counts, prior, strict=True)]


def shape(state: DataFrame, parts: Sequence[str], pseudo: float, k_context: float, k_unit: float) -> DataFrame:
    """``unit_id, total, delta_*``: log deviation of a unit's composition from what its opponents and venues let expect."""
    units = expected(state, parts, pseudo, k_context)
    delta = deviation([F.col(p) for p in parts], [F.col(f"e_{p}") for p in parts], k_unit)
    return units.select("unit_id", "total", *[d.alias(f"delta_{p}") for d, p in zip(delta, parts, strict=True)])


def _baselines(state: DataFrame, parts: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The state with ``events`` and ``baseline`` (exposure times the venue's league rate), and the rates in one row."""
    events = state.withColumn("events", _sum([F.col(p) for p in parts]))
    at = lambda h, c: F.sum(F.when(F.col("context_home") == h, F.col(c)))
    rates = events.agg(*[F.try_divide(at(h, "events"), F.nullif(at(h, "exposure"), F.lit(0.0))).alias(f"rate{h}") for h in (0, 1)], F.try_divide(F.sum("events"), F.nullif(F.sum("exposure"), F.lit(0.0))).alias("rate"))
    rate = F.when(F.col("context_home") == 1, F.col("rate1")).otherwise(F.col("rate0"))
    return events.join(F.broadcast(rates)).withColumn("baseline", F.when(F.col("exposure") > 0, F.col("exposure") * rate).otherwise(0.0)), rates


def context_levels(state: DataFrame, parts: Sequence[str], k_context: float) -> DataFrame:
    based, _ = _baselines(state, parts)
    return based.groupBy("context_id").agg(((F.sum("events") + k_context) / (F.sum("baseline") + k_context)).alias("context_ratio"))


def level(state: DataFrame, parts: Sequence[str], k_context: float, k_unit: float) -> DataFrame:
    """``unit_id, observed, expected, unit_ratio, rate``: events of a unit against what its opponents let others have."""
    based, _ = _baselines(state, parts)
    by_context = based.groupBy("context_id").agg((F.sum("events") + k_context).alias("ce"), (F.sum("baseline") + k_context).alias("cb"))
    own = based.groupBy("context_id", "unit_id").agg(F.sum("events").alias("oe"), F.sum("baseline").alias("ob"), F.first("rate").alias("rate"))
    held = own.join(by_context, "context_id").withColumn("without", (F.col("ce") - F.col("oe")) / (F.col("cb") - F.col("ob")))
    units = held.groupBy("unit_id").agg(F.sum("oe").alias("observed"), F.sum(F.col("ob") * F.col("without")).alias("expected"), F.first("rate").alias("rate"))
    return units.withColumn("unit_ratio", (F.col("observed") + k_unit) / (F.col("expected") + k_unit))


def tiers(sides: DataFrame, k: int, least: int) -> DataFrame:
    """``unit_id, day, tier, played``: strength groups of the teams before each day (points, then margin a match).

    A team's record holds from the day after a match to its next one, so records are carried forward by their own spans; the
    rank of a day runs over the teams of one league.
    """
    by = Window.partitionBy("unit_id").orderBy("day")
    diff = F.col("goals_for") - F.col("goals_against")
    run = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = sides.agg(F.max("day").alias("last"))
    record = sides.select(
        "unit_id", "day", F.lead("day").over(by).alias("next"), F.count("*").over(run).alias("sheet"), F.count_if("valid").over(run).alias("played"),
        F.sum(F.when(diff > 0, 3).when(diff == 0, 1).otherwise(0)).over(run).alias("points"), F.sum(diff).over(run).alias("margin"),
    ).join(F.broadcast(last))
    until = F.coalesce("next", F.col("last"))
    held = record.where(F.col("day") + 1 <= until).select("unit_id", "sheet", "played", "points", "margin", F.explode(F.sequence(F.col("day") + 1, until)).alias("day"))
    order = Window.partitionBy("day").orderBy(F.desc(F.col("points") / F.col("sheet")), F.desc(F.col("margin") / F.col("sheet")), "unit_id")
    rank, n = F.row_number().over(order) - 1, F.count("*").over(Window.partitionBy("day"))
    return held.select("unit_id", "day", F.floor(k * rank / n).cast("int").alias("tier"), "played").withColumn("ready", F.col("played") >= least)


def recent(rows: DataFrame, parts: Sequence[str], k: int) -> DataFrame:
    """Sums over the last ``k`` valid matches strictly before each valid match."""
    w = Window.partitionBy("unit_id").orderBy("day").rowsBetween(-k, -1)
    return rows.where("valid").select("unit_id", "day", *[F.coalesce(F.sum(f"n_{p}").over(w), F.lit(0)).cast("long").alias(f"recent_{p}") for p in parts], F.round(F.coalesce(F.sum("exposure").over(w), F.lit(0.0)), 6).alias("recent_exposure"))


def prior_states(rows: DataFrame, parts: Sequence[str]) -> DataFrame:
    """``day`` and ``KEYS``: sums of valid matches strictly before every match day, from running sums carried forward.

    A day's matches are in no state of that day. Rows come only for days on which a valid match is played.
    """
    valid = rows.where("valid")
    by = Window.partitionBy(*KEYS).orderBy("day")
    run = by.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    days = valid.select("day").distinct()
    per_day = valid.groupBy(*KEYS, "day").agg(*[F.sum(f"n_{p}").cast("double").alias(p) for p in parts])
    last = days.agg(F.max("day").alias("last"))
    held = per_day.select(*KEYS, "day", F.lead("day").over(by).alias("next"), *[F.sum(p).over(run).alias(p) for p in parts]).join(F.broadcast(last))
    until = F.coalesce("next", F.col("last"))
    spread = held.where(F.col("day") + 1 <= until).select(*KEYS, *parts, F.explode(F.sequence(F.col("day") + 1, until)).alias("day"))
    return spread.join(days, "day", "left_semi")


def donors(tiers: DataFrame, seed: int) -> DataFrame:
    """``day, unit_id, donor``: a permutation of each tier, the i-th team by id against the i-th by a hash of (seed, day, team)."""
    text = F.concat_ws("-", F.lit(seed), "day", "unit_id")
    ids = Window.partitionBy("day", "tier").orderBy("unit_id")
    mixed = Window.partitionBy("day", "tier").orderBy(F.md5(text.cast("binary")), "unit_id")
    a = tiers.select("day", "tier", "unit_id", F.row_number().over(ids).alias("i"))
    b = tiers.select("day", "tier", F.col("unit_id").alias("donor"), F.row_number().over(mixed).alias("i"))
    return a.join(b, ["day", "tier", "i"]).select("day", "unit_id", "donor")


def composition_losses(rows: DataFrame, parts: Sequence[str], mirror: Sequence[int], strengths: Sequence[float], pseudo: float, k_context: float, recent_matches: int, smoothing: float, seed: int, n_tiers: int = 3, least: int = 3) -> DataFrame:
    """``day, unit_id, k, events`` and the log loss of each forecast of a match's composition, all known before its day.

    ``candidate``: opponent, venue and the team's own deviation, shrunk by ``k``; against the league at the venue, opponent and
    venue alone, the team's last matches raw, the deviation with its parts swapped by ``mirror``, that of the other teams of its
    strength, and that of a donor drawn in its strength group.
    """
    by = ["day"]
    rows = cut(rows)
    states = cut(prior_states(rows, parts))
    lg = league(states, parts, pseudo, by)
    ctx = contexts(states, parts, lg, k_context, by)
    units = cut(expected(states, parts, pseudo, k_context, by))
    standing = tiers(rows.select("unit_id", "day", "goals_for", "goals_against", "valid"), n_tiers, least)
    pooled = [*parts, *[f"e_{p}" for p in parts]]
    known = standing.select("day", "unit_id", "tier", "ready").join(units, ["day", "unit_id"])
    groups = known.groupBy("day", "tier").agg(*[F.sum(c).alias(f"t_{c}") for c in pooled])
    peers = known.join(groups, ["day", "tier"]).select("day", "unit_id", "ready", *pooled, *[(F.col(f"t_{c}") - F.col(c)).alias(f"peer_{c}") for c in pooled])
    given = units.select("day", F.col("unit_id").alias("donor"), *[F.col(c).alias(f"donor_{c}") for c in pooled])
    past = recent(rows, parts, recent_matches).select("unit_id", "day", *[f"recent_{p}" for p in parts])
    target = rows.where("valid").select("day", "unit_id", "context_id", "context_home", *[f"n_{p}" for p in parts])
    met = target.join(peers.where("ready"), ["day", "unit_id"]).join(donors(known, seed), ["day", "unit_id"]).join(given, ["day", "donor"]).join(past, ["unit_id", "day"])
    met = with_league(met.join(ctx, ["day", "context_id"]), lg, by).withColumn("k", F.explode(F.array(*[F.lit(float(k)) for k in strengths])))
    base = [F.col(f"ctx_{p}") * F.exp(nu(p)) for p in parts]
    delta = lambda prefix: deviation([F.col(f"{prefix}{p}") for p in parts], [F.col(f"{prefix}e_{p}") for p in parts], F.col("k"))
    moved = lambda d: composition([b * F.exp(x) for b, x in zip(base, d, strict=True)])
    own = delta("")
    forecasts = {
        "candidate": moved(own), "league_venue": composition([F.col(f"pi_{p}") * F.exp(nu(p)) for p in parts]), "context": composition(base), "recent": composition([F.col(f"recent_{p}") + smoothing for p in parts]),
        "mirror": moved([own[i] for i in mirror]), "peers": moved(delta("peer_")), "permuted": moved(delta("donor_")),
    }
    counts = [F.col(f"n_{p}") for p in parts]
    loss = lambda shares: -_sum([n * F.log(q) for n, q in zip(counts, shares, strict=True)])
    return met.select("day", "unit_id", "k", _sum(counts).alias("events"), (F.col("donor") != F.col("unit_id")).alias("donor_changed"), *[loss(q).alias(n) for n, q in forecasts.items()])
