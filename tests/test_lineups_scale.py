"""Any number of squads: the cap is a squad's, sums come along, and sets stay in the partitions of their squad."""

import pytest
from matchgrain.operators import lineups as L


def test_cap_is_for_a_squad_and_sets_are_dealt(spark, monkeypatch):
    rows = [(s, 10 * s + p, ["A"] if p < 3 else ["B"], p) for s in range(20) for p in range(5)]
    c = spark.createDataFrame(rows, "squad long, player_id long, slots array<string>, x long")
    monkeypatch.setattr(L, "SETS", 6)
    sets = L.feasible_sets(c, {"A": 2, "B": 1}, cap=6, by=("squad",), names=["x"])  # 6 a squad, 120 in all
    got = sets.collect()
    assert sets.rdd.getNumPartitions() == 20
    assert len(got) == 120 == len({(r.squad, tuple(r.xi)) for r in got})
    assert all(r.x == sum(p - 10 * r.squad for p in r.xi) for r in got)
    with pytest.raises(L.TooManySets):
        L.feasible_sets(c, {"A": 2, "B": 1}, cap=5, by=("squad",))


def test_two_slots_make_no_set_twice(spark):
    c = spark.createDataFrame([(1, ["A", "B"], 1), (2, ["A", "B"], 2), (3, ["B"], 4)], "player_id long, slots array<string>, x long")
    assert sorted((r.xi, r.x) for r in L.feasible_sets(c, {"A": 1, "B": 1}, names=["x"]).collect()) == [([1, 2], 3), ([1, 3], 5), ([2, 3], 6)]
