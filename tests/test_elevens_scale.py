"""What grows with squads and scenarios: states that others dominate go, and a scenario merges only what it changes."""

import random

import numpy as np
import pytest

from matchgrain.operators import elevens as E
from matchgrain.operators import ranked
from test_elevens import APPLIES, FORMATION, MINIMA, SCHEMA, least, assignments, of, squads


def test_only_undominated_states_stay(spark):
    rows = [(1, 3, 3, 3, 7), (1, 2, 2, 2, 6), (1, 3, 3, 3, 5), (1, 4, 0, 0, 4), (1, 2, 3, 1, 3), (2, 0, 0, 0, 2)]
    got = E.undominated(spark.createDataFrame(rows, "k long, x long, y long, z long, xi long"), ["k"], ["x", "y", "z"])
    assert sorted(tuple(r) for r in got.collect()) == [(1, 3, 3, 3, 7), (1, 4, 0, 0, 4), (2, 0, 0, 0, 2)]


def test_variants_merge_only_what_they_change(spark, monkeypatch):
    rows, r, declared = squads(6, 3), random.Random(4), []
    for q in range(6):
        for k in range(5):
            for p in r.sample(of(rows, q), (0, 1, 1, 2, 3)[k]):
                kind = r.choice(["LOCKED", "EXCLUDED", "PINNED"])
                declared.append((q, k, p[1], kind, r.choice(p[2]) if kind == "PINNED" else None))
            if k in (0, 2):
                declared.append((q, k, None, "VACANT", "B"))
        p = of(rows, q)[0]
        declared += [(q, 5, p[1], "EXCLUDED", None), (q, 5, p[1], "LOCKED", None)]  # has no eleven
    frame = spark.createDataFrame(declared, "squad long, scenario long, player_id long, kind string, slot string")
    table, leaves, made = spark.createDataFrame(rows, SCHEMA), E.leaves, []
    monkeypatch.setattr(E, "leaves", lambda *a: made.append(leaves(*a)) or made[-1])
    got = {(g["squad"], g["scenario"]): g for g in E.variants(table, FORMATION, MINIMA, frame, ("squad",), "scenario", APPLIES).collect()}
    assert len(made) == 1 and "scenario" not in made[0][0].columns
    assert got.keys() == {d[:2] for d in declared}
    for (q, k), g in got.items():
        own, places = [d for d in declared if d[:2] == (q, k)], dict(FORMATION)
        for d in own:
            if d[3] == "VACANT":
                places[d[4]] -= 1
        ok = lambda c: all({"LOCKED": d[2] in {p[1] for _, p in c}, "EXCLUDED": d[2] not in {p[1] for _, p in c}, "PINNED": (d[4], d[2]) in {(s, p[1]) for s, p in c}, "VACANT": True}[d[3]] for d in own)  # noqa: B023, E731
        want = least(c for c in assignments(of(rows, q), places=places) if ok(c))
        assert (g["status"], g["max_short"], g["total_short"]) == (("CERTIFIED", *want) if want else ("UNFIELDABLE", None, None))


def test_absences_of_ordinary_squads_make_no_scenarios(spark, monkeypatch):
    monkeypatch.setattr(E, "variants", lambda *a: pytest.fail("a scenario for each set of absences"))
    assert E.stress(spark.createDataFrame(squads(3, 7), SCHEMA), FORMATION, MINIMA, 3, APPLIES).count() > 0


def test_absences_by_rank_and_by_states_are_the_same(spark, monkeypatch):
    r, rows = random.Random(8), []
    for q in range(4):
        for i in range(8 + q):
            rows.append((q, 100 * q + i, r.sample(list(FORMATION), r.choice([1, 1, 2])), *[3 if q == 3 else r.randrange(12) for _ in MINIMA]))
    rows += [(9, 900, ["A"], 1, 1, 1)]  # has no eleven
    table, made, states = spark.createDataFrame(rows, SCHEMA), [], E.stress_by_states
    run = lambda: sorted(map(str, E.stress(table, FORMATION, MINIMA, 2, APPLIES).collect()))
    by_rank = run()
    monkeypatch.setattr(E, "stress_by_states", lambda *a: made.append(states(*a)) or made[-1])
    monkeypatch.setattr(E, "WAYS", 100)
    assert run() == by_rank
    assert {g["squad"] for g in made[0].collect()} not in (set(), {0, 1, 2, 3})


def test_only_elevens_stay_that_absences_can_make_the_best():
    able, worth = np.ones((1, 6), dtype=bool), np.array([[6], [5], [5], [3], [2], [1]])
    masks, worst, total = ranked.ranked(able, worth, np.ones((1, 1), dtype=int), [3], [16], 1)
    assert masks.tolist() == [0b000111, 0b001011, 0b001101, 0b001110] and worst.tolist() == total.tolist() == [0, 2, 2, 3]
    assert ranked.ranked(able, worth, np.ones((1, 1), dtype=int), [7], [16], 1)[0].size == 0
    k, gone, at = ranked.after_absences(np.array([0b0111, 0b1011]), 4, 2)
    found = dict(zip(gone.tolist(), at.tolist(), strict=True))
    assert found == {0b0001: -1, 0b0010: -1, 0b0100: 1, 0b1000: 0, 0b1100: -1} and k.tolist() == [1, 1, 1, 1, 2]
