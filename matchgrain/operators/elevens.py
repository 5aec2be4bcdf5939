"""Exact values of full elevens for many squads and scenarios at once, by a state relation in the place of player sets.

A state says how many places of each slot a block of players fills and what they bring to each requirement, cut at the
minimum (more than enough is enough, as no coefficient is negative). A player's own states are: left out, or in one of the
slots open to them. Neighbouring blocks merge pairwise, level by level; of states that fill the same places only those stay
that no other one dominates in all requirements, and where whole elevens are asked for, only those that leave no more places
than the players of other blocks can fill. What is left of a squad's single block has the least loss of all its elevens,
whatever their number.

Declarations are rows: a LOCKED player is never left out, a PINNED one stands in the named slot, an EXCLUDED one is left out,
a VACANT slot has one place that nobody fills. Blocks follow the first slot of each player, so that most of them fill one kind
of place only. A squad and scenario is a group of its own; the number of states depends on places and minima alone.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut
from . import ranked
from .lineups import shortfalls

DECLARED = "player_id long, kind string, slot string"
KINDS = ("LOCKED", "PINNED", "EXCLUDED", "VACANT")


def _all(parts: Sequence[Column]) -> Column:
    return reduce(Column.__and__, parts, F.lit(True))


def checked(candidates: DataFrame, names: Sequence[str]) -> DataFrame:
    """The same rows; a negative or missing coefficient fails the job, as a state could not be cut at the minimum."""
    for n in names:
        candidates = candidates.withColumn(n, F.when(F.col(n) >= 0, F.col(n)).otherwise(F.raise_error(F.lit(f"{n} must not be negative or missing")).cast("long")))
    return candidates


def member(by: Sequence[str]) -> Column:
    """A squad's players as bits of a long, by ascending id; a squad has 63 at most."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy("player_id")) - 1
    return F.when(at < 63, F.call_function("shiftleft", F.lit(1).cast("long"), at.cast("int"))).otherwise(F.raise_error(F.lit("a squad has more than 63 players")).cast("long"))


#: A count of players by slot, a squad's 63 at most, has so many bits in a long; slots beyond the long are not counted.
COUNT_BITS = 7
COUNTED_SLOTS = 63 // COUNT_BITS


def _counts(by_slot: Sequence[Column]) -> Column:
    return reduce(Column.__add__, [F.call_function("shiftleft", c.cast("long"), F.lit(COUNT_BITS * i)) for i, c in enumerate(by_slot)])


def _count(counts: str, i: int) -> Column:
    return F.shiftright(counts, COUNT_BITS * i).bitwiseAND(F.lit((1 << COUNT_BITS) - 1))


def _kinds() -> list[Column]:
    pin = F.max(F.when(F.col("kind") == "PINNED", F.col("slot")))
    return [F.bool_or(F.col("kind") == "EXCLUDED").alias("excluded"), F.bool_or(F.col("kind").isin("LOCKED", "PINNED")).alias("must"), pin.alias("pin")]


def leaves(candidates: DataFrame, formation: Mapping[str, int], minima: Mapping[str, int], declared: DataFrame | None, by: Sequence[str], applies: Mapping[str, Sequence[str]], whole: bool) -> tuple[DataFrame, int]:
    """One-player states with their ``block``, and the number of blocks (a power of two).

    ``able``: by slot, how many players of the block can stand there; ``slack``: how many of the squad's need not. A squad with
    too few players for a slot has no states, if ``whole``.
    """
    slots, names = list(formation), list(minima)
    counted = slots[:COUNTED_SLOTS]
    tag = F.col("tag") if "tag" in candidates.columns else F.lit(0)
    rows = checked(candidates, names).select(*by, "player_id", "slots", *names, tag.cast("long").alias("tag"))
    if declared is None:
        rows = rows.withColumn("excluded", F.lit(False)).withColumn("must", F.lit(False)).withColumn("pin", F.lit(None).cast("string"))
    else:
        d = declared.where(F.col("kind") != "VACANT").groupBy(*by, "player_id").agg(*_kinds())
        rows = rows.join(d, [*by, "player_id"], "left").fillna(False, ["excluded", "must"])
    group = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in slots]), F.element_at("slots", 1)) - 1, F.lit(0))
    rows = rows.where(F.size("slots") > 0).withColumn("g", group)
    open_to = {s: F.array_contains("slots", s) & ~F.col("excluded") & (F.col("pin").isNull() | (F.col("pin") == s)) for s in slots}
    if whole:
        spare = {s: F.sum(open_to[s].cast("int")).over(Window.partitionBy(*by)) - k for s, k in formation.items()}
        if declared is not None:
            rows = rows.join(vacancies(declared, formation, by), list(by), "left").fillna(0, [f"v_{s}" for s in slots])
            spare = {s: c + F.col(f"v_{s}") for s, c in spare.items()}
        rows = rows.select(*rows.columns, *[c.alias(f"spare_{s}") for s, c in spare.items()]).where(_all([F.col(f"spare_{s}") >= 0 for s in slots]))
        rows = rows.withColumn("slack", _counts([F.col(f"spare_{s}") for s in counted]))
    else:
        rows = rows.withColumn("slack", _counts([F.lit(63)] * len(counted)))
    rows = rows.withColumn("able", _counts([open_to[s].cast("int") for s in counted]))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy(*by, "g").orderBy("player_id")) - 1).withColumn("bit", member(by))
    rows = cut(rows)
    wide = 1 << max((rows.agg(F.max("i")).first()[0] or 0), 1).bit_length()
    groups = 1 << (len(slots) - 1).bit_length()
    rows = rows.withColumn("block", (F.col("g") * wide + F.col("i")).cast("long"))

    def state(slot: str | None) -> Column:
        fills = [F.lit(int(s == slot)).cast("int").alias(f"f_{s}") for s in slots]
        brings = [(F.least(F.lit(minima[n]), F.col(n)) if slot in applies[n] else F.lit(0)).cast("long").alias(n) for n in names]
        return F.struct(*fills, *brings, (F.lit(0) if slot is None else F.col("bit")).cast("long").alias("xi"), (F.lit(0) if slot is None else F.col("tag")).cast("long").alias("tag"))

    choice = [F.when(~F.col("must"), state(None))]
    choice += [F.when(open_to[s], state(s)) for s in slots]
    own = rows.select(*by, "block", "able", "slack", F.explode(F.filter(F.array(*choice), lambda x: x.isNotNull())).alias("x")).select(*by, "block", "able", "slack", "x.*")
    nobody = [F.lit(0).cast("int").alias(f"f_{s}") for s in slots] + [F.lit(0).cast("long").alias(n) for n in (*names, "xi", "tag")]
    every = rows.select(*by, "slack").distinct().withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups * wide - 1).cast("long"))))
    empty = every.join(rows.select(*by, "block"), [*by, "block"], "left_anti").select(*by, "block", F.lit(0).cast("long").alias("able"), "slack", *nobody)
    return own.unionByName(empty), groups * wide


def vacancies(declared: DataFrame, formation: Mapping[str, int], by: Sequence[str]) -> DataFrame:
    return declared.where(F.col("kind") == "VACANT").groupBy(*by).agg(*[F.count_if(F.col("slot") == s).alias(f"v_{s}") for s in formation])


def undominated(states: DataFrame, key: Sequence[str], names: Sequence[str], carried: Sequence[str] = (), n: int | None = None) -> DataFrame:
    """The states that no other one of their key has as much of everything as; one of equal ones. ``carried`` columns follow from the key."""
    *others, last = names
    best = states.groupBy(*key, *carried, *others).agg(F.max(F.struct(last, "xi")).alias("_b")).select(*key, *carried, *others, f"_b.{last}", "_b.xi")
    if not others:
        return best
    best = best.repartition(*([n] if n else []), *key)
    other = best.select(*[F.col(k).alias(f"_{k}") for k in (*key, *names)])
    more = reduce(Column.__or__, [F.col(f"_{n}") > F.col(n) for n in others])
    return best.join(other, _all([F.col(k) == F.col(f"_{k}") for k in key]) & _all([F.col(f"_{n}") >= F.col(n) for n in names]) & more, "left_anti")


def halves(candidates: DataFrame, formation: Mapping[str, int], minima: Mapping[str, int], declared: DataFrame | None, by: Sequence[str], applies: Mapping[str, Sequence[str]] | None, down_to: int = 2, whole: bool = True) -> DataFrame:
    """``by``, ``block`` (0 or 1), places filled and sums: what each half of a squad's blocks can do within the formation, or
    towards filling all of it if ``whole``.

    A column ``tag`` of the candidates (bits) is kept apart: a state says which tags its players have. The blocks of a pair meet in one of a fixed number of partitions: few bytes go in and much work comes out, so partitions
    must not be put together by their size.
    """
    rows, blocks = leaves(candidates, formation, minima, declared, by, applies or {n: list(formation) for n in minima}, whole)
    while blocks > down_to:
        rows, blocks = merged(cut(rows), formation, minima, by, whole), blocks // 2
    return rows


def merged(rows: DataFrame, formation: Mapping[str, int], minima: Mapping[str, int], by: Sequence[str], whole: bool) -> DataFrame:
    """The states of each two neighbouring blocks together."""
    n, fills = partitions(rows), [f"f_{s}" for s in formation]
    half, pair = F.col("block") % 2, F.expr("block div 2").alias("block")
    right = rows.where(half == 1).select(*by, pair, *[F.col(c).alias(f"_{c}") for c in (*fills, *minima, "xi", "tag", "able")]).repartition(n, *by, "block")
    room = _all([F.col(f"f_{s}") + F.col(f"_f_{s}") <= most for s, most in formation.items()])
    left = rows.where(half == 0).select(*by, pair, *fills, *minima, "xi", "tag", "able", "slack").repartition(n, *by, "block")
    met = left.join(right, [*by, "block"]).where(room)
    met = met.select(*by, "block", *[(F.col(f) + F.col(f"_{f}")).alias(f) for f in (*fills, "able")], "slack", *_together(minima))
    if whole:  # more players of the block stay idle than the squad can spare: a place stays open
        met = met.where(_all([_count("able", i) - F.col(f"f_{s}") <= _count("slack", i) for i, s in enumerate([*formation][:COUNTED_SLOTS])]))
    return undominated(met, [*by, "block", *fills, "tag"], list(minima), ["able", "slack"], n)


def partitions(df: DataFrame) -> int:
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)


def _together(minima: Mapping[str, int]) -> list[Column]:
    sums = [F.least(F.lit(m), F.col(n) + F.col(f"_{n}")).alias(n) for n, m in minima.items()]
    return sums + [F.col(c).bitwiseOR(F.col(f"_{c}")).alias(c) for c in ("xi", "tag")]


def values(candidates: DataFrame, formation: Mapping[str, int], minima: Mapping[str, int], declared: DataFrame | None = None, by: Sequence[str] = ("squad",), applies: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``by, status, max_short, total_short, xi``: the least loss of each squad and players who have it (bits by ascending id), or
    UNFIELDABLE (proven: all states were kept).

    ``candidates``: player_id, slots (array, the first one is the own), a whole number for each of ``minima``; ``applies``
    names the slots that a requirement counts (all, if not given); ``declared`` has the columns of ``by`` and ``DECLARED``.
    """
    return least(cut(halves(candidates, formation, minima, declared, by, applies)), candidates.select(*by).distinct(), formation, minima, declared, by)


def variants(candidates: DataFrame, formation: Mapping[str, int], minima: Mapping[str, int], declared: DataFrame, by: Sequence[str], scenario: str, applies: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``values`` of every scenario that ``declared`` names for a squad: ``by, scenario, status, max_short, total_short, xi``.

    A scenario is its squad but for the players it declares, so only the blocks with such a player are merged for it; the
    others are the squad's own, merged once.
    """
    names, all_by = list(minima), [*by, scenario]
    most = vacancies(declared, formation, all_by).groupBy(*by).agg(*[F.max(f"v_{s}").cast("int").alias(f"v_{s}") for s in formation])
    free = [F.array_repeat(F.struct(F.lit("VACANT").alias("kind"), F.lit(s).alias("slot")), F.col(f"v_{s}")) for s in formation]
    allowed = most.select(*by, F.lit(None).cast("long").alias("player_id"), F.explode(F.concat(*free)).alias("d")).select(*by, "player_id", "d.*")
    rows, blocks = leaves(candidates, formation, minima, allowed, by, applies or {n: list(formation) for n in names}, True)
    own = cut(rows)
    # A declared player's states, of the squad's own ones.
    d = declared.where(F.col("player_id").isNotNull() & (F.col("kind") != "VACANT")).groupBy(*all_by, "player_id").agg(*_kinds())
    d = cut(d.join(candidates.where(F.size("slots") > 0).select(*by, "player_id", member(by).alias("bit")), [*by, "player_id"]))
    at = own.where("xi <> 0").select(*by, "block", F.col("xi").alias("bit")).distinct()
    of = cut(d.join(at, [*by, "bit"]).select(*all_by, "block", "excluded", "must", "pin"))
    idle, stands = _all([F.col(f"f_{s}") == 0 for s in formation]), reduce(Column.__or__, [(F.col("pin") == s) & (F.col(f"f_{s}") == 1) for s in formation])
    rows = own.join(of, [*by, "block"]).where(F.when(idle, ~F.col("must")).otherwise(~F.col("excluded") & (F.col("pin").isNull() | stands)))
    changed, touched = rows.select(*all_by, *[c for c in own.columns if c not in by]), of.select(*all_by, "block")
    asked = cut(declared.select(*all_by).distinct().join(candidates.select(*by).distinct(), list(by)))

    def beside(blocks_of: DataFrame) -> DataFrame:
        """The changed states, and the squad's own ones of the other halves of these blocks."""
        both = blocks_of.withColumn("block", F.explode(F.array(F.col("block") * 2, F.col("block") * 2 + 1)))
        rest = both.join(touched, [*all_by, "block"], "left_anti").join(own, [*by, "block"])
        return cut(changed.unionByName(rest.select(*changed.columns)))

    while blocks > 2:
        above = touched.select(*all_by, F.expr("block div 2").alias("block")).distinct()
        changed = merged(beside(above), formation, minima, all_by, True)
        touched, own, blocks = above, cut(merged(own, formation, minima, by, True)), blocks // 2
    rows = beside(asked.withColumn("block", F.lit(0).cast("long")))
    return least(rows, asked, formation, minima, declared, all_by)


def least(rows: DataFrame, asked: DataFrame, formation: Mapping[str, int], minima: Mapping[str, int], declared: DataFrame | None, by: Sequence[str]) -> DataFrame:
    """The least loss of each of ``asked`` over its two halves."""
    names, n = list(minima), partitions(rows)
    left = rows.where("block = 0")
    want = {s: F.lit(k) for s, k in formation.items()}
    if declared is not None:
        left = left.join(vacancies(declared, formation, by), list(by), "left").fillna(0, [f"v_{s}" for s in formation])
        want = {s: k - F.col(f"v_{s}") for s, k in formation.items()}
    # One half fills what the other leaves open.
    needs = [f"need_{s}" for s in formation]
    left = left.select(*by, *[(want[s] - F.col(f"f_{s}")).cast("long").alias(f"need_{s}") for s in formation], *names, "xi", "tag").repartition(n, *by, *needs)
    right = rows.where("block = 1").select(*by, *[F.col(f"f_{s}").cast("long").alias(f"need_{s}") for s in formation], *[F.col(c).alias(f"_{c}") for c in (*names, "xi", "tag")]).repartition(n, *by, *needs)
    met = left.join(right, [*by, *needs]).select(*by, *_together(minima))
    worst, total = shortfalls({m: F.col(m) for m in minima}, minima)
    best = met.groupBy(*by).agg(F.min(F.struct(worst.alias("max_short"), total.alias("total_short"), "xi")).alias("z"))
    return asked.join(best, list(by), "left").select(*by, F.when(F.col("z").isNull(), "UNFIELDABLE").otherwise("CERTIFIED").alias("status"), "z.max_short", "z.total_short", "z.xi")


def totals(candidates: DataFrame, formation: Mapping[str, int], names: Sequence[str], by: Sequence[str] = ("squad",), applies: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``by`` and sums of elevens: every nondominated one is there, and some that others dominate."""
    no_cut = dict.fromkeys(names, 1 << 40)
    rows = cut(halves(candidates, formation, no_cut, None, by, applies))
    n, needs = partitions(candidates), [f"need_{s}" for s in formation]
    left = rows.where("block = 0").select(*by, *[(F.lit(k) - F.col(f"f_{s}")).cast("long").alias(f"need_{s}") for s, k in formation.items()], *names).repartition(n, *by, *needs)
    right = rows.where("block = 1").select(*by, *[F.col(f"f_{s}").cast("long").alias(f"need_{s}") for s in formation], *[F.col(m).alias(f"_{m}") for m in names]).repartition(n, *by, *needs)
    return left.join(right, [*by, *needs]).select(*by, *[(F.col(m) + F.col(f"_{m}")).alias(m) for m in names]).distinct()


def scenarios(candidates: DataFrame, declared: DataFrame, by: Sequence[str], scenario: str = "scenario") -> DataFrame:
    """``candidates`` once for each scenario that ``declared`` names for their squad."""
    return candidates.join(declared.select(*by, scenario).distinct(), list(by))


def elements(mask: Column) -> Column:
    """The bits of a squad's set, ascending."""
    return F.filter(F.sequence(F.lit(0), F.lit(62)), lambda i: F.call_function("getbit", mask, i) == 1)


def without(mask: Column, i: Column) -> Column:
    return mask.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), i)))


def absences(candidates: DataFrame, formation: Mapping[str, int], most: int = 3) -> DataFrame:
    """``squad, k, absent, fieldable``: every set of up to ``most`` players of a squad that has an eleven, without sets that hold
    a smaller one after which there is none.

    Sets grow level by level: two that differ in their last player make one, which stays if every set with one player less
    leaves an eleven. Whether it does itself is counted: an eleven is left if every group of slots keeps as many players as
    places. ``absent`` has bits by ascending id; a row that is not fieldable is a core.
    """
    groups = cut(slot_groups(candidates, formation).withColumn("places", places(formation)).groupBy("squad").agg(F.collect_list(F.struct("able", "places")).alias("groups")))
    kept = lambda g, gone: F.bit_count(g["able"].bitwiseAND(F.bitwise_not(gone))) >= g["places"]
    whole = groups.where(F.forall("groups", lambda g: kept(g, F.lit(0).cast("long"))))
    sets = cut(candidates.withColumn("absent", member(["squad"])).select("squad", "absent").join(whole.select("squad"), "squad"))
    out = None
    for k in range(1, most + 1):
        if k > 1:
            last = F.element_at(elements(F.col("absent")), -1)
            one = level.where("fieldable").select("squad", "absent", last.alias("top"), without(F.col("absent"), last).alias("rest"))
            two = one.select("squad", "rest", F.col("absent").alias("_absent"), F.col("top").alias("_top"))
            sets = one.join(two, ["squad", "rest"]).where("top < _top").select("squad", F.col("absent").bitwiseOR(F.col("_absent")).alias("absent"))
            parts = sets.select("squad", "absent", F.explode(elements(F.col("absent"))).alias("i")).select("squad", F.col("absent").alias("more"), without(F.col("absent"), F.col("i")).alias("absent"))
            held = parts.join(level.where("fieldable").select("squad", "absent"), ["squad", "absent"]).groupBy("squad", F.col("more").alias("absent")).count()
            sets = held.where(F.col("count") == k).drop("count")
        level = sets.join(whole, "squad").select("squad", F.lit(k).alias("k"), "absent", F.forall("groups", lambda g: kept(g, F.col("absent"))).alias("fieldable"))
        level = cut(level)
        out = level if out is None else out.unionByName(level)
    return out


#: A squad with no more ways than this to choose each slot's players has all its elevens looked at in one task.
WAYS = 1 << 20


def stress(candidates: DataFrame, formation: Mapping[str, int], minima: Mapping[str, int], most: int = 3, applies: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``squad, k, absent, status, max_short, total_short``: what each set of ``absences`` leaves of its squad. An UNFIELDABLE
    row is a core.

    A squad's elevens are put in a row once and serve all its sets, as each set's loss is that of the first eleven without its
    players. Squads with too many ways for that are solved by states, set by set.
    """
    open_to = [F.coalesce(F.array_contains("slots", s), F.lit(False)) for s in formation]
    ways = F.lit(1.0)
    for c, places in zip(open_to, formation.values(), strict=True):
        able = F.sum(c.cast("int")).over(Window.partitionBy("squad"))
        for k in range(places):
            ways = ways * F.greatest(F.lit(0), able - k) / (k + 1)
    own = reduce(Column.__add__, [F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(open_to)])
    rows = cut(checked(candidates, list(minima)).where("squad is not null").select("squad", "player_id", "slots", *minima, own.cast("long").alias("own"), member(["squad"]).alias("bit"), ways.alias("ways")))
    few, many = rows.where((F.col("ways") > 0) & (F.col("ways") <= WAYS)), rows.where(F.col("ways") > WAYS)
    out = stress_by_rank(few, formation, minima, most, applies)
    return out if many.isEmpty() else out.unionByName(stress_by_states(many.select("squad", "player_id", "slots", *minima), formation, minima, most, applies))


def stress_by_rank(rows: DataFrame, formation: Mapping[str, int], minima: Mapping[str, int], most: int, applies: Mapping[str, Sequence[str]] | None) -> DataFrame:
    """``stress`` of squads with few ways; ``own`` has the bits of a player's slots in the formation's order."""
    names, slots = list(minima), list(formation)
    counts = np.array([[applies is None or s in applies[n] for n in names] for s in slots]).astype(int)

    def run(key: tuple, players: pa.Table) -> pa.Table:
        players = players.sort_by("bit")
        able = players["own"].to_numpy()[None] >> np.arange(len(slots))[:, None] & 1 > 0
        worth = np.stack([players[n].to_numpy() for n in names], axis=1)
        masks, worst, total = ranked.ranked(able, worth, counts, list(formation.values()), list(minima.values()), most)
        k, absent, at = ranked.after_absences(masks, players.num_rows, most) if len(masks) else np.zeros((3, 0), dtype=np.int64)
        loss = [pa.array(x[at] if len(masks) else at, mask=at < 0) for x in (worst, total)]
        return pa.table({"squad": pa.repeat(key[0], len(k)), "k": k.astype(np.int32), "absent": absent, "max_short": loss[0], "total_short": loss[1]})

    # Few bytes go in and much work is done: a fixed number of partitions, which are not put together by their size.
    dealt = rows.select("squad", "bit", "own", *[F.col(n).cast("long").alias(n) for n in names]).repartition(partitions(rows), "squad")
    found = dealt.groupBy("squad").applyInArrow(run, f"squad {rows.schema['squad'].dataType.simpleString()}, k int, absent long, max_short long, total_short long")
    return found.select("squad", "k", "absent", F.when(F.col("max_short").isNull(), "UNFIELDABLE").otherwise("CERTIFIED").alias("status"), "max_short", "total_short")


def stress_by_states(candidates: DataFrame, formation: Mapping[str, int], minima: Mapping[str, int], most: int = 3, applies: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``stress`` of squads of any number of elevens.

    If the best eleven without all but one of a set's players does without that one too, the set inherits its loss; the
    others are solved, a level of all squads at once.
    """
    sets = absences(candidates, formation, most)
    bits = cut(candidates.withColumn("bit", member(["squad"])))
    base = values(candidates, formation, minima, None, ("squad",), applies).where(F.col("status") == "CERTIFIED")
    known = cut(base.select("squad", F.lit(0).cast("long").alias("absent"), "max_short", "total_short", "xi"))
    out = sets.where("not fieldable").select("squad", "k", "absent", F.lit("UNFIELDABLE").alias("status"), F.lit(None).cast("long").alias("max_short"), F.lit(None).cast("long").alias("total_short"))
    for k in range(1, most + 1):
        own = sets.where(F.col("fieldable") & (F.col("k") == k)).select("squad", "absent")
        parts = own.select("squad", "absent", F.explode(elements(F.col("absent"))).alias("i")).withColumn("less", without(F.col("absent"), F.col("i")))
        smaller = known.select("squad", F.col("absent").alias("less"), "max_short", "total_short", "xi")
        idle = F.when(F.call_function("getbit", "xi", F.col("i")) == 0, F.struct("max_short", "total_short", "xi"))
        met = cut(parts.join(smaller, ["squad", "less"]).groupBy("squad", "absent").agg(F.min(idle).alias("z")))
        asked = met.where(F.col("z").isNull()).select("squad", "absent")
        gone = asked.join(bits.select("squad", "player_id", "bit"), "squad").where(F.col("bit").bitwiseAND(F.col("absent")) != 0)
        declared = gone.select("squad", "absent", "player_id", F.lit("EXCLUDED").alias("kind"), F.lit(None).cast("string").alias("slot"))
        solved = variants(bits.drop("bit"), formation, minima, declared, ("squad",), "absent", applies)
        known = cut(met.where(F.col("z").isNotNull()).select("squad", "absent", "z.*").unionByName(solved.drop("status")))
        out = out.unionByName(known.select("squad", F.lit(k).alias("k"), "absent", F.lit("CERTIFIED").alias("status"), "max_short", "total_short"))
    return out


def slot_groups(candidates: DataFrame, formation: Mapping[str, int], by: Sequence[str] = ("squad",)) -> DataFrame:
    """``by, mask, able``: for every group of slots (bits in the formation's order) the players, as bits, who can stand in it."""
    own = reduce(Column.bitwiseOR, [F.when(F.array_contains("slots", s), 1 << i).otherwise(0) for i, s in enumerate(formation)])
    rows = candidates.select(*by, member(by).alias("bit"), own.alias("own"))
    every = F.array(*[F.lit(m) for m in range(1, 1 << len(formation))])
    return rows.withColumn("mask", F.explode(every)).groupBy(*by, "mask").agg(F.bit_or(F.when(F.col("own").bitwiseAND(F.col("mask")) != 0, F.col("bit")).otherwise(0)).alias("able"))


def places(formation: Mapping[str, int], mask: str = "mask") -> Column:
    """How many places a group of slots has."""
    return reduce(Column.__add__, [F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, n).otherwise(0) for i, n in enumerate(formation.values())])


def spelled_group(formation: Mapping[str, int], mask: str = "mask") -> Column:
    return F.concat_ws("+", *[F.when(F.col(mask).bitwiseAND(F.lit(1 << i)) != 0, F.lit(s)) for i, s in enumerate(formation)])


def satisfied(candidates: DataFrame, formation: Mapping[str, int], floors: Mapping[str, int], excluded: int, locked: int, by: Sequence[str] = ("squad",), applies: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """``by, sats``: the sets of declarations (as bits) that some partial assignment meets together.

    Bits go by the declared order: coverage of each slot, then ``excluded`` players, then floors, then ``locked`` players; a
    candidate's ``tag`` has the bits of their exclusion (0 on) and lock (``excluded`` on). A place may stay empty and an
    excluded player may stand in one, which then does not meet that declaration. One state relation answers all subsets.
    """
    slots, names = list(formation), list(floors)
    rows = halves(candidates, formation, floors, None, by, applies, down_to=1, whole=False)
    met = [F.when(F.col(f"f_{s}") == n, 1 << i).otherwise(0) for i, (s, n) in enumerate(formation.items())]
    at = len(slots)
    met += [F.when(F.call_function("getbit", "tag", F.lit(i)) == 0, 1 << (at + i)).otherwise(0) for i in range(excluded)]
    at += excluded
    met += [F.when(F.col(n) >= floors[n], 1 << (at + i)).otherwise(0) for i, n in enumerate(names)]
    at += len(names)
    met += [F.when(F.call_function("getbit", "tag", F.lit(excluded + i)) == 1, 1 << (at + i)).otherwise(0) for i in range(locked)]
    return rows.select(*by, reduce(Column.__add__, met).cast("long").alias("sat")).distinct().groupBy(*by).agg(F.collect_list("sat").alias("sats"))


def _holds(sats: Column, mask: Column) -> Column:
    return F.exists(sats, lambda s: s.bitwiseAND(mask) == mask)


def conflicts(sats: DataFrame, declarations: int, by: Sequence[str] = ("squad",)) -> DataFrame:
    """``by, status, conflict, restores``: by deletion, in the declared order, a minimal set that cannot be met (bits), and the
    single declarations without which all others can."""
    every = F.lit((1 << declarations) - 1).cast("long")
    order = F.sequence(F.lit(0), F.lit(declarations - 1))
    bit = lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)

    def dropped(mask: Column, i: Column) -> Column:
        rest = mask.bitwiseAND(F.bitwise_not(bit(i)))
        return F.when(_holds(F.col("sats"), rest), mask).otherwise(rest)

    feasible = _holds(F.col("sats"), every)
    kept = F.when(~feasible, F.aggregate(order, every, dropped)).otherwise(F.lit(0).cast("long"))
    restores = F.aggregate(order, F.lit(0).cast("long"), lambda m, i: F.when(~feasible & _holds(F.col("sats"), every.bitwiseAND(F.bitwise_not(bit(i)))), m.bitwiseOR(bit(i))).otherwise(m))
    return sats.select(*by, F.when(feasible, "FEASIBLE").otherwise("CONFLICT").alias("status"), kept.alias("conflict"), restores.alias("restores"))


def named_bits(mask: str, names: Sequence[str]) -> Column:
    return F.concat_ws(" + ", *[F.when(F.col(mask).bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(n)) for i, n in enumerate(names)])


def skyline(points: DataFrame, dims: Sequence[str], by: Sequence[str] = ("squad",), most: int = 64) -> DataFrame:
    """``by, place, dims, complete``: nondominated vectors of three dimensions in descending order, the first ``most`` of them.

    Points are dealt to ranges of the first dimension. In a range, a point falls to one with no less of anything; across
    ranges, it falls if the staircase of all higher ranges (most of the third for so much of the second or more) reaches it.
    Staircases have a step for each value of the second dimension, and running maxima merge them. A list that is cut is the
    largest part in that order, and says so.
    """
    a, b, c = dims
    best = points.groupBy(*by, a, b).agg(F.max(c).alias(c))
    column = Window.partitionBy(*by, b).orderBy(F.desc(a)).rowsBetween(Window.unboundedPreceding, -1)
    row = Window.partitionBy(*by, a).orderBy(F.desc(b)).rowsBetween(Window.unboundedPreceding, -1)
    best = best.withColumn("_c", F.max(c).over(column)).where(F.col("_c").isNull() | (F.col(c) > F.col("_c"))).drop("_c")
    best = best.withColumn("_c", F.max(c).over(row)).where(F.col("_c").isNull() | (F.col(c) > F.col("_c"))).drop("_c")
    span = best.groupBy(*by).agg(F.min(a).alias("_low"), F.greatest(F.expr(f"(max({a}) - min({a})) div 64"), F.lit(1)).alias("_wide"))
    best = cut(best.join(span, list(by)).withColumn("_range", F.expr(f"({a} - _low) div _wide")).drop("_low", "_wide"))
    # Across ranges: a staircase for every range, then the running maximum over higher ranges and over more of the second.
    steps = best.groupBy(*by, "_range", b).agg(F.max(c).alias("_top"))
    grid = best.select(*by, "_range").distinct().join(best.select(*by, b).distinct(), list(by)).join(steps, [*by, "_range", b], "left")
    higher = Window.partitionBy(*by, b).orderBy(F.desc("_range")).rowsBetween(Window.unboundedPreceding, -1)
    more = Window.partitionBy(*by, "_range").orderBy(F.desc(b)).rowsBetween(Window.unboundedPreceding, 0)
    grid = grid.withColumn("_top", F.max("_top").over(higher)).withColumn("_top", F.max("_top").over(more)).where(F.col("_top").isNotNull())
    left = best.join(grid, [*by, "_range", b], "left").where(F.col("_top").isNull() | (F.col(c) > F.col("_top"))).drop("_top")
    # In a range.
    other = left.toDF(*[f"_{x}" for x in left.columns])
    same = _all([F.col(x) == F.col(f"_{x}") for x in (*by, "_range")])
    reached = _all([F.col(f"_{d}") >= F.col(d) for d in dims]) & reduce(Column.__or__, [F.col(f"_{d}") > F.col(d) for d in dims])
    left = left.join(other, same & reached, "left_anti").drop("_range")
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*[F.desc(d) for d in dims]))
    n = F.count("*").over(Window.partitionBy(*by))
    return left.withColumn("place", place).withColumn("complete", n <= most).where(F.col("place") <= most).select(*by, "place", *dims, "complete")


def depth(stages: DataFrame, formation: Mapping[str, int], names: Sequence[str], by: Sequence[str] = ("squad",)) -> DataFrame:
    """``by, stage, kappa, filled, lost, tight``: how firm each stage of a chain leaves a squad.

    ``stages``: a player's slots at each stage, as a column of bits with the stage's name. A group of slots has so many
    players to spare as can stand in it beyond its places; ``kappa`` is the least spare of all groups and one, the smallest
    number of absences that can leave a place open. The most places that can be filled are those of the formation less the
    largest deficit of a group; ``lost`` is what the stage itself takes of them. ``tight`` names the largest groups with the
    least spare.
    """
    long = stages.select(*by, "player_id", F.explode(F.array(*[F.struct(F.lit(i).alias("at"), F.lit(n).alias("stage"), F.col(n).cast("long").alias("own")) for i, n in enumerate(names)])).alias("x")).select(*by, "x.*")
    masks = F.explode(F.array(*[F.lit(m) for m in range(1, 1 << len(formation))]))
    able = long.groupBy(*by, "at", "stage", "own").count().withColumn("mask", masks)
    able = able.groupBy(*by, "at", "stage", "mask").agg(F.sum(F.when(F.col("own").bitwiseAND(F.col("mask")) != 0, F.col("count")).otherwise(0)).alias("able"))
    spare = able.withColumn("spare", F.col("able") - places(formation))
    group = spare.groupBy(*by, "at", "stage").agg(F.min("spare").alias("least"), F.collect_list(F.struct("spare", "mask", spelled_group(formation).alias("name"))).alias("all"))
    low = F.filter("all", lambda g: g["spare"] == F.col("least"))
    widest = F.filter("low", lambda g: ~F.exists("low", lambda h: (h["mask"] != g["mask"]) & (h["mask"].bitwiseAND(g["mask"]) == g["mask"])))
    group = group.withColumn("low", low).withColumn("tight", F.concat_ws(" ", F.array_sort(F.transform(widest, lambda g: g["name"]))))
    filled = sum(formation.values()) + F.least(F.lit(0), F.col("least"))
    before = F.lag("filled").over(Window.partitionBy(*by).orderBy("at"))
    out = group.withColumn("filled", filled).withColumn("lost", F.coalesce(before, F.lit(sum(formation.values()))) - F.col("filled"))
    return out.select(*by, "stage", (F.col("least") + 1).alias("kappa"), "filled", "lost", "tight")
