"""Elevens by states against enumeration of all assignments, on many small squads at once."""

import itertools
import random

import pytest

from matchgrain.operators import elevens as E

FORMATION = {"A": 1, "B": 2, "C": 2}
MINIMA = {"x": 9, "y": 8, "z": 7}
APPLIES = {"x": ("B", "C"), "y": ("A", "B", "C"), "z": ("C",)}
SCHEMA = "squad long, player_id long, slots array<string>, x long, y long, z long"


def squads(n=10, seed=1):
    r, rows = random.Random(seed), []
    for q in range(n):
        for i in range(r.randrange(4, 9)):
            slots = r.sample(list(FORMATION), r.choice([1, 1, 2, 3]))
            rows.append((q, 100 * q + i, slots, r.randrange(6), r.randrange(6), r.randrange(6)))
    return rows


def assignments(players, partial=False, places=None):
    """All ways to fill the places, as (slot, player) pairs; with empty places if ``partial``."""
    kinds = [s for s, n in (places or FORMATION).items() for _ in range(n)]

    def fill(at, used):
        if at == len(kinds):
            yield ()
            return
        for p in players:
            if p[1] not in used and kinds[at] in p[2]:
                for rest in fill(at + 1, used | {p[1]}):
                    yield ((kinds[at], p), *rest)
        if partial:
            yield from fill(at + 1, used)

    return fill(0, frozenset())


def sums(chosen):
    return tuple(sum(p[3 + i] for s, p in chosen if s in APPLIES[n]) for i, n in enumerate(MINIMA))


def least(found):
    losses = []
    for chosen in found:
        short = [max(0, m - v) for m, v in zip(MINIMA.values(), sums(chosen), strict=True)]
        losses.append((max(short), sum(short)))
    return min(losses, default=None)


def of(rows, squad):
    return [r for r in rows if r[0] == squad]


def test_values_under_declarations(spark):
    rows, r, declared = squads(), random.Random(2), []
    for q in range(10):
        mine = of(rows, q)
        for k in range(6):
            for p in r.sample(mine, r.randrange(3)):
                kind = r.choice(["LOCKED", "EXCLUDED", "PINNED"])
                declared.append((q, k, p[1], kind, r.choice(p[2]) if kind == "PINNED" else None))
            if k == 5:
                declared.append((q, k, None, "VACANT", "B"))
    frame = spark.createDataFrame(declared, "squad long, scenario long, player_id long, kind string, slot string")
    table = spark.createDataFrame(rows, SCHEMA)
    got = {(g["squad"], g["scenario"]): g for g in E.values(E.scenarios(table, frame, ["squad"]), FORMATION, MINIMA, frame, ("squad", "scenario"), APPLIES).collect()}
    assert got.keys() == {d[:2] for d in declared}
    for (q, k), g in got.items():
        own = [d for d in declared if d[:2] == (q, k)]
        places = dict(FORMATION)
        for d in own:
            if d[3] == "VACANT":
                places[d[4]] -= 1
        ok = lambda c: all({"LOCKED": d[2] in {p[1] for _, p in c}, "EXCLUDED": d[2] not in {p[1] for _, p in c}, "PINNED": (d[4], d[2]) in {(s, p[1]) for s, p in c}, "VACANT": True}[d[3]] for d in own)  # noqa: B023, E731
        want = least(c for c in assignments(of(rows, q), places=places) if ok(c))
        assert (g["max_short"], g["total_short"]) == (want or (None, None)) and g["status"] == ("CERTIFIED" if want else "UNFIELDABLE")
        if want:  # the players that are named have that loss
            ids = sorted(p[1] for p in of(rows, q))
            xi = {ids[i] for i in range(len(ids)) if g["xi"] >> i & 1}
            assert want == least(c for c in assignments([p for p in of(rows, q) if p[1] in xi], places=places) if ok(c) and len(c) == len(xi))


def test_absences_with_cores_and_inherited_losses(spark):
    rows = squads(8, 5)
    got = {(g["squad"], g["absent"]): g for g in E.stress(spark.createDataFrame(rows, SCHEMA), FORMATION, MINIMA, 3, APPLIES).collect()}
    for q in range(8):
        mine = sorted(of(rows, q), key=lambda p: p[1])
        if least(assignments(mine)) is None:
            assert not any(k[0] == q for k in got)
            continue
        cores = []
        for k in (1, 2, 3):
            for gone in itertools.combinations(range(len(mine)), k):
                key = (q, sum(1 << i for i in gone))
                if any(set(c) <= set(gone) for c in cores):
                    assert key not in got
                    continue
                want = least(assignments([p for i, p in enumerate(mine) if i not in gone]))
                if want is None:
                    cores.append(gone)
                assert (got[key]["status"], got[key]["max_short"], got[key]["total_short"]) == (("UNFIELDABLE", None, None) if want is None else ("CERTIFIED", *want))


def test_conflicts_over_partial_assignments(spark):
    rows, floors = squads(10, 9), {"x": 9, "y": 12, "z": 6}
    tagged = []
    for q in range(10):
        for i, p in enumerate(of(rows, q)):
            tagged.append((*p, {0: 1, 1: 2 + 4, 2: 8}.get(i, 0)))  # the second is declared out and in
    names = ["cover A", "cover B", "cover C", "out 1", "out 2", "x", "y", "z", "in 1", "in 2"]
    table = spark.createDataFrame(tagged, SCHEMA + ", tag long")
    got = {g["squad"]: g for g in E.conflicts(E.satisfied(table, FORMATION, floors, 2, 2, applies=APPLIES), len(names)).collect()}
    for q in range(10):
        sats = set()
        for c in assignments(of(tagged, q), partial=True):
            tags = 0
            for _, p in c:
                tags |= p[6]
            s = [sum(1 for x, _ in c if x == slot) == n for slot, n in FORMATION.items()] + [not tags & 1, not tags & 2] + [v >= f for v, f in zip(sums(c), floors.values(), strict=True)] + [tags & 4, tags & 8]
            sats.add(sum(1 << i for i, x in enumerate(s) if x))
        holds = lambda m: any(x & m == m for x in sats)  # noqa: B023, E731
        mask = every = (1 << len(names)) - 1
        for i in range(len(names)):
            if not holds(mask & ~(1 << i)):
                mask &= ~(1 << i)
        want = ("FEASIBLE", 0, 0) if holds(every) else ("CONFLICT", mask, sum(1 << i for i in range(len(names)) if holds(every & ~(1 << i))))
        assert (got[q]["status"], got[q]["conflict"], got[q]["restores"]) == want
        if want[0] == "CONFLICT":  # minimal: whatever is left out, the rest holds
            assert not holds(mask) and all(holds(mask & ~(1 << i)) for i in range(len(names)) if mask >> i & 1)


@pytest.mark.parametrize("spread,most", [(5, 64), (300, 64), (300, 3)])
def test_skyline(spark, spread, most):
    r = random.Random(spread)
    points = [(q, *(r.randrange(spread) for _ in range(3))) for q in range(4) for _ in range(150)] + [(9, 1, 1, 1)] * 3
    got = E.skyline(spark.createDataFrame(points, "squad long, x long, y long, z long"), ["x", "y", "z"], most=most).collect()
    for q in {p[0] for p in points}:
        own = {p[1:] for p in points if p[0] == q}
        best = sorted((p for p in own if not any(o != p and all(a >= b for a, b in zip(o, p, strict=True)) for o in own)), reverse=True)
        rows = sorted((g for g in got if g["squad"] == q), key=lambda g: g["place"])
        assert [(g["x"], g["y"], g["z"]) for g in rows] == best[:most] and [g["place"] for g in rows] == list(range(1, len(rows) + 1))
        assert all(g["complete"] == (len(best) <= most) for g in rows)


def test_totals_hold_every_nondominated_sum(spark):
    rows = squads(6, 11)
    got = E.totals(spark.createDataFrame(rows, SCHEMA), FORMATION, list(MINIMA), applies=APPLIES).collect()
    for q in range(6):
        own = {sums(c) for c in assignments(of(rows, q))}
        best = {p for p in own if not any(o != p and all(a >= b for a, b in zip(o, p, strict=True)) for o in own)}
        mine = {(g["x"], g["y"], g["z"]) for g in got if g["squad"] == q}
        assert best <= mine <= own


def test_no_squads_and_what_is_refused(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert E.values(none, FORMATION, MINIMA).count() == 0 and E.stress(none, FORMATION, MINIMA, 2).count() == 0
    for bad in (-1, None):
        with pytest.raises(Exception, match="negative or missing"):
            E.values(spark.createDataFrame([(1, 1, ["A"], bad, 0, 0)], SCHEMA), FORMATION, MINIMA).collect()
