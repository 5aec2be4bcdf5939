"""Measures from outside the library: a function of actions to player-match parts, admitted only by a verdict that survives.

An extension gives ``player_id, game_id, numerator, denominator``. What it gives is held against that schema before anything
is summed; what cannot be pooled (a repeated player-match, a negative or missing denominator) fails the job that reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Components = Callable[[DataFrame], DataFrame]
SCHEMA = {"player_id": "bigint", "game_id": "bigint", "numerator": "double", "denominator": "double"}
_EXTENSIONS: dict[str, Components] = {}


class ExtensionError(ValueError):
    """An extension that is unknown, named twice, not admitted, or not of the schema."""


def extension(name: str) -> Callable[[Components], Components]:
    """Register a function under a name that nothing else has."""

    def put(f: Components) -> Components:
        if name in _EXTENSIONS and _EXTENSIONS[name] is not f:
            raise ExtensionError(f"{name} is registered already")
        _EXTENSIONS[name] = f
        return f

    return put


def components(name: str, actions: DataFrame) -> DataFrame:
    """The parts that an extension makes of ``actions``, checked and one row a player-match."""
    if name not in _EXTENSIONS:
        raise ExtensionError(f"no extension {name}")
    made = _EXTENSIONS[name](actions)
    kinds = dict(made.dtypes)
    wrong = [f"{c} {kinds.get(c, 'missing')}" for c, kind in SCHEMA.items() if kinds.get(c) != kind]
    if wrong:
        raise ExtensionError(f"{name} gives {', '.join(wrong)}")
    bad = F.col("player_id").isNull() | F.col("game_id").isNull() | ~F.coalesce(F.col("denominator") >= 0, F.lit(False)) | (F.col("n") > 1)
    parts = made.groupBy("player_id", "game_id").agg(F.sum("numerator").alias("numerator"), F.sum("denominator").alias("denominator"), F.count("*").alias("n"))
    held = F.when(bad, F.raise_error(F.lit(f"{name}: a player-match is repeated, unnamed or has no denominator")).cast("double")).otherwise(F.col("denominator"))
    return parts.select("player_id", "game_id", "numerator", held.alias("denominator"))


def all_components(actions: DataFrame, names: list[str]) -> DataFrame:
    """``extension`` and its parts, for several extensions."""
    out = None
    for n in names:
        one = components(n, actions).select(F.lit(n).alias("extension"), *SCHEMA)
        out = one if out is None else out.unionByName(one)
    return out


def verdicts(parts: DataFrame, least_players: int, bar: float) -> DataFrame:
    """``extension, players, reliability, status``: split-half reliability over even and odd matches, stepped up."""
    at = lambda odd, c: F.sum(F.when(F.col("game_id") % 2 == odd, F.col(c)))
    share = lambda odd: F.try_divide(at(odd, "numerator"), F.nullif(at(odd, "denominator"), F.lit(0.0)))
    halves = parts.groupBy("extension", "player_id").agg(share(0).alias("x"), share(1).alias("y")).dropna(subset=["x", "y"])
    moves = (F.var_pop("x") > 1e-12 * F.avg(F.col("x") * F.col("x"))) & (F.var_pop("y") > 1e-12 * F.avg(F.col("y") * F.col("y")))
    r = F.when(moves, F.covar_pop("x", "y") / F.sqrt(F.var_pop("x") * F.var_pop("y")))
    out = halves.groupBy("extension").agg(F.count("*").alias("players"), r.alias("r")).withColumn("reliability", 2 * F.col("r") / (1 + F.col("r")))
    status = F.when((F.col("players") < least_players) | F.col("reliability").isNull(), "UNTESTED").when(F.col("reliability") >= bar, "SURVIVES").otherwise("REJECTED")
    return out.select("extension", "players", "reliability", status.alias("status"))


def admitted(parts: DataFrame, verdict: DataFrame, surviving: str = "SURVIVES") -> DataFrame:
    """Only the parts of extensions whose verdict survives; an extension without a verdict is not admitted."""
    return parts.join(verdict.where(F.col("status") == surviving).select("extension").distinct(), "extension", "left_semi")


def pooled(parts: DataFrame) -> DataFrame:
    """``extension, player_id, matches, value``: a ratio of sums; nothing where there is no exposure."""
    n, d = F.sum("numerator"), F.sum("denominator")
    return parts.groupBy("extension", "player_id").agg(F.count("*").alias("matches"), F.try_divide(n, F.nullif(d, F.lit(0.0))).alias("value"))


def scope(requirements: DataFrame, opt_in: bool) -> DataFrame:
    """``requirement`` rows with ``active`` and why: an experimental one takes part only where that was declared."""
    reason: Column = F.when(F.col("minimum").isNull(), "no minimum").when(F.col("experimental") & F.lit(not opt_in), "experimental, not opted in").otherwise("")
    return requirements.withColumn("reason", reason).withColumn("active", reason == "")


def typed_inputs(candidates: DataFrame, requirements: DataFrame, applies: Mapping[str, list[str]], opt_in: bool) -> DataFrame:
    """``candidates`` with ``slots`` cut to those where every active requirement that counts there is measured, and ``missing``.

    ``values`` is a map of measures; a player keeps a slot in which nothing needed is missing.
    """
    active = [r["requirement"] for r in scope(requirements, opt_in).where("active").select("requirement").orderBy("requirement").collect()]  # a declared list
    measured = lambda s: [F.col("values")[n].isNotNull() for n in active if s in applies[n]]
    slots = sorted({s for n in applies for s in applies[n]})
    open_to = lambda x: F.when(F.lit(False), F.lit(False))
    for s in slots:
        needed = measured(s)
        ok = F.lit(True)
        for m in needed:
            ok = ok & m
        open_to = (lambda before, s, ok: lambda x: F.when(x == s, ok).otherwise(before(x)))(open_to, s, ok)
    kept = F.filter("slots", lambda x: F.coalesce(open_to(x), F.lit(True)))
    missing = F.array_compact(F.array(*[F.when(F.col("values")[n].isNull(), F.lit(n)) for n in active])) if active else F.array().cast("array<string>")
    return candidates.withColumn("kept", kept).withColumn("missing", missing)
