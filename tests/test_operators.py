"""Literal fixtures: null judgements, ties, caps, pairing, feeds, streams."""

import json
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchgrain.functions.scalars import average_rank, channel, fold, located, ratio, strictly_below
from matchgrain.operators import lineups as L
from matchgrain.operators.constructs import CONSTRUCTS, PASSES, ActionFilter, components
from matchgrain.operators.identity import resolve
from matchgrain.operators.pairing import pair_events
from matchgrain.operators.surface import fit_surface
from matchgrain.sources import feeds, neutral
from matchgrain.streaming.bins import five_minute_counts

SMALL = "/root/testdata/sf0.001"


def test_unjudged_is_neither_done_nor_failed(spark):
    df = spark.createDataFrame([(1, "pass", True), (2, "pass", None), (3, "pass", False)], "i int, type string, success boolean")
    assert [r.i for r in df.where(PASSES.column()).collect()] == [1]
    assert [r.i for r in df.where(~PASSES.column()).orderBy("i").collect()] == [2, 3]


def test_filter_text_and_print():
    f = ActionFilter(frozenset({"pass"}), True, frozenset({"key_pass"}))
    assert f.describe() == "completed pass flagged key_pass"
    assert f.fingerprint() == ActionFilter(frozenset({"pass"}), True, frozenset({"key_pass"})).fingerprint() != PASSES.fingerprint()


def test_lane_edges_and_sentinels(spark):
    df = spark.createDataFrame([(0.21,), (0.37,), (0.63,), (0.79,), (0.2,), (0.8,), (0.5,), (None,)], "y double")
    assert [r[0] for r in df.select(channel(F.col("y"))).collect()] == ["half_space"] * 4 + ["wide"] * 2 + ["centre", None]
    pts = spark.createDataFrame([(0.0, 0.0), (1.0, 1.0), (0.5, 0.5), (1.2, 0.1), (None, 0.1)], "x double, y double")
    assert [r[0] for r in pts.select(located(F.col("x"), F.col("y"))).collect()] == [False, False, True, False, False]


def test_ranks_ratio_fold(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 3.0), ("d", None)], "k string, v double")
    got = {r.k: (r.p, r.r) for r in df.select("k", strictly_below("v").alias("p"), average_rank("v").alias("r")).collect()}
    assert got["a"][0] == got["b"][0] == 0 and abs(got["c"][0] - 200 / 3) < 1e-9 and got["d"][0] is None
    assert got["a"][1] == got["b"][1] == 2.5
    assert df.select(ratio(F.lit(1), F.lit(0)).alias("x"), fold(F.lit("Müller Øst")).alias("n")).first()[:] == (None, "muller ost")


def test_lineups_against_itertools(spark):
    people = [(i, [s], v, w) for i, s, v, w in ((1, "A", 3, 1), (2, "A", 1, 4), (3, "B", 2, 2), (4, "B", 5, 0), (5, "B", 0, 6), (6, "A", 3, 1))]
    c = spark.createDataFrame(people, "player_id long, slots array<string>, x long, y long")
    loss = L.losses(L.feasible_sets(c, {"A": 1, "B": 2}), c, {"x": 9, "y": 7})
    table = {p: (x, y) for p, _, x, y in people}
    want = {}
    for a in (1, 2, 6):
        for b in combinations((3, 4, 5), 2):
            xi = tuple(sorted((a, *b)))
            s = [sum(table[p][k] for p in xi) for k in (0, 1)]
            d = [max(0, 9 - s[0]), max(0, 7 - s[1])]
            want[xi] = (max(d), sum(d))
    assert {tuple(r.xi): (r.max_short, r.total_short) for r in loss.collect()} == want
    least = min(want.values())
    assert {tuple(r.xi) for r in L.best(loss).collect()} == {k for k, v in want.items() if v == least}
    with pytest.raises(L.TooManySets):
        L.feasible_sets(c, {"A": 1, "B": 2}, cap=3)


def test_pairing_is_one_to_one_and_nearest_first(spark):
    cols = "g long, seconds double, event_id long, start_x double, start_y double"
    a = spark.createDataFrame([(1, 10.0, 1, 0.0, 0.0), (1, 12.0, 2, 0.0, 0.0)], cols)
    b = spark.createDataFrame([(1, 11.5, 7, 0.0, 0.0), (1, 30.0, 8, 0.0, 0.0)], cols)
    assert [(r.a, r.b) for r in pair_events(a, b, ["g"], 5.0).collect()] == [(2, 7)]


def greedy(a, b, tolerance):
    """One pass over all pairs, nearest first."""
    pairs = sorted(
        (abs(x.seconds - y.seconds), ((x.start_x - y.start_x) ** 2 + (x.start_y - y.start_y) ** 2) ** 0.5, x.event_id, y.event_id)
        for x in a for y in b if (x.game_id, x.period, x.team_id) == (y.game_id, y.period, y.team_id) and abs(x.seconds - y.seconds) <= tolerance
    )
    left, right, out = set(), set(), set()
    for gap, _, x, y in pairs:
        if x not in left and y not in right:
            left.add(x)
            right.add(y)
            out.add((x, y, gap))
    return out


def test_pairing_as_by_a_greedy_pass(spark):
    from matchgrain.plans.links import paired_events, streams

    p = paired_events(spark, SMALL).collect()
    a, b = (x.collect() for x in streams(spark, SMALL, F.col("event_id") % 3))
    assert {(r.a, r.b, r.gap) for r in p} == greedy(a, b, 5.0)
    # A dense stream in one group, where choices hang on each other for many rounds.
    cols = "game_id long, period string, team_id long, seconds double, event_id long, start_x double, start_y double"
    rows = [(1, "1H", 0, float((i * 37) % 50) / 4, i, (i % 7) / 7, (i % 5) / 5) for i in range(60)]
    x = spark.createDataFrame(rows, cols)
    y = spark.createDataFrame([(g, p, t, s + (e % 4) * 0.3, e + 1000, u, v) for g, p, t, s, e, u, v in rows if e % 3], cols)
    got = {(r.a, r.b, round(r.gap, 9)) for r in pair_events(x, y, ["game_id", "period", "team_id"], 1.0).collect()}
    assert got == {(i, j, round(gap, 9)) for i, j, gap in greedy(x.collect(), y.collect(), 1.0)}
    assert pair_events(x.limit(0), y, ["game_id", "period", "team_id"], 1.0).count() == 0
    for most in (0, 5):  # clusters that are too large for one pass, thinned by rounds
        assert got == {(r.a, r.b, round(r.gap, 9)) for r in pair_events(x, y, ["game_id", "period", "team_id"], 1.0, most).collect()}


def test_a_chain_of_falling_gaps_is_one_pass(spark):
    """Every pair is nearer than the one before, so mutual choices would take a round each."""
    at, times = 0.0, []
    for k in range(60):
        times.append(at)
        at += 4.0 - k * 0.05
    rows = [("g", t, i, 0.0, 0.0) for i, t in enumerate(times)]
    cols = "g string, seconds double, event_id long, start_x double, start_y double"
    a, b = spark.createDataFrame(rows[::2], cols), spark.createDataFrame(rows[1::2], cols)
    got = {(r.a, r.b) for r in pair_events(a, b, ["g"], 5.0).collect()}
    pairs = sorted((round(abs(x[1] - y[1]), 9), x[2], y[2]) for x in rows[::2] for y in rows[1::2] if abs(x[1] - y[1]) <= 5)
    used, want = set(), set()
    for _, x, y in pairs:
        if not {x, y} & used:
            used |= {x, y}
            want.add((x, y))
    assert got == want


def test_identity(spark):
    import datetime as dt

    d = dt.date(1990, 1, 1)
    cols = "id long, name string, born date, team long, country long, shirt long"
    left = spark.createDataFrame([(1, "José Pérez", d, 1, 1, 9), (2, "Nobody", d, 1, 1, 9), (3, "Twin One", d, 2, 2, 2), (4, "Andrey", None, 5, 5, 5), (5, "Ana Maria Silva", None, 7, 7, 7)], cols)
    right = spark.createDataFrame([
        (10, "JOSE PEREZ", d, 1, 1, 9), (11, "twin one", d, 2, 2, 2), (12, "Twin One", d, 2, 2, 2), (13, "Andrey Semenov", None, 5, 5, 5), (14, "Silva, Ana Maria", None, 7, 7, 7),
    ], cols)
    got = {r.id: (r.other, r.status, r.score) for r in resolve(left, right).collect()}
    assert got[1] == (10, "exact", 1.0)
    assert got[2] == (None, "ambiguous", 0.8)  # the birth date alone
    assert got[3] == (None, "ambiguous", 1.0)  # two perfect candidates
    assert got[4] == (None, "unresolved", None)  # a single name never swallows a full one
    assert got[5] == (None, "ambiguous", 0.88)  # a name is not enough, whatever the context


def test_store_refuses_what_is_not_there(spark, tmp_path):
    from matchgrain.sources import store

    a = spark.createDataFrame([(1, "c0", store.PROVIDER), (2, "c1", store.PROVIDER)], "event_id long, competition string, provider string")
    root = str(tmp_path / "s")
    with pytest.raises(store.StoreError):
        store.load(spark, root, "actions", "c0")
    store.publish(spark, root, {"actions": a}, {"actions": ("event_id",)})
    assert store.competitions(spark, root, ["actions"]) == ["c0", "c1"]
    assert store.load(spark, root, "actions", "c0", ["event_id"], verify=True).collect()[0].event_id == 1
    for table, competition, columns in (("actions", "c9", None), ("lineups", "c0", None), ("actions", "c0", ["nothing"])):
        with pytest.raises(store.StoreError):
            store.load(spark, root, table, competition, columns)
    with pytest.raises(store.StoreError):
        store.publish(spark, root, {"actions": a})
    with pytest.raises(store.StoreError):
        store.publish(spark, str(tmp_path / "n"), {"actions": a.withColumn("event_id", F.lit(None).cast("long"))}, {"actions": ("event_id",)})
    for bad, schema, unique in ((a, ("event_id string",), {}), (a, ("nothing",), {}), (a.unionByName(a), (), {"actions": "event_id"})):
        with pytest.raises(store.StoreError):  # the store that is there stays as it was
            store.publish(spark, root, {"actions": bad}, {"actions": schema}, unique, replace=True)
        assert store.load(spark, root, "actions", "c0", ["event_id"], verify=True).count() == 1
    store.publish(spark, root, {"actions": a.unionByName(a.withColumn("event_id", F.col("event_id") + 10))}, replace=True)
    assert store.load(spark, root, "actions", "c0", ["event_id"], verify=True).count() == 2 and not list(tmp_path.glob("*staging*"))
    gone = {(r.competition, r.side, r.n, r.least) for r in store.key_differences(a, a.where("event_id = 1").unionByName(a.where("event_id = 1")), "event_id", "competition").collect()}
    assert gone == {("c0", "only theirs", 1, 1), ("c1", "only ours", 1, 2)}
    a.where("competition = 'c0'").write.mode("append").partitionBy("competition").parquet(f"{root}/actions")
    with pytest.raises(store.StoreError):
        store.load(spark, root, "actions", "c0")
    other = str(tmp_path / "o")
    store.publish(spark, other, {"actions": a.withColumn("provider", F.lit("someone"))})
    with pytest.raises(store.StoreError):
        store.load(spark, other, "actions", "c0")
    side = spark.createDataFrame([(1, 5), (1, 6)], "event_id long, zone long")
    for s in (side, side.limit(1)):
        with pytest.raises(store.StoreError):
            store.attach(a, s, "event_id", ["zone"])
    store.write_bundle(a, str(tmp_path / "b"), "v1")
    with pytest.raises(store.StoreError):
        store.read_bundle(spark, str(tmp_path / "b"), "event_id long, competition string, provider string", "v2")


def test_tally_says_what_it_counts():
    from matchgrain.operators.descriptors import ATTACKS

    assert ATTACKS.events.words == "either a completed pass or a shot and not from the last fifth (start x at least 4/5) and into the attacking half (end x above 1/2)"
    assert ATTACKS.names == ("left", "right", "centre") and ATTACKS.events.ends == {"start", "end"}


def test_tally_against_a_loop(spark):
    """Unknown outcomes and flags meet no condition and so meet its negation; sentinel and missing places are dropped, not counted."""
    from fractions import Fraction
    from itertools import product

    from matchgrain.operators.descriptors import Along, Tally, done, marked

    rows = [(k, s, f, x, y) for k, s, f, x, y in product(("pass", "shot", None), (True, False, None), (True, None), (None, 0.0, 0.5, 0.75, 1.0, 1.5), (None, 0.0, 0.35, 0.7, 1.0))]
    acts = spark.createDataFrame(rows, "type string, success boolean, key boolean, end_x double, end_y double")
    tally = Tally((done("pass", False) | done("shot") & ~marked("key")) & ~Along("end", "x").up_to(Fraction(1, 2)), {"low": Along("end", "y").below(Fraction(7, 20)), "mid": Along("end", "y").up_to(Fraction(7, 10))}, "high")
    want = {"n_low": 0, "n_mid": 0, "n_high": 0, "dropped": 0}
    for k, s, f, x, y in rows:
        if ((k == "pass" and s is False) or (k == "shot" and not f)) and not (x is not None and x <= 0.5):
            placed = x is not None and y is not None and 0 <= x <= 1 and 0 <= y <= 1 and (x, y) not in ((0, 0), (1, 1))
            want["dropped" if not placed else "n_low" if y < 0.35 else "n_mid" if y <= 0.7 else "n_high"] += 1
    assert tally.counts(acts).first().asDict() == want and min(want.values()) > 0


def test_surface_is_a_fixed_point(spark):
    v = fit_surface(neutral.actions(spark, SMALL))
    assert len(v) == 192 and (v >= 0).all() and (v <= 1).all() and np.isfinite(v).all()


def test_components_keep_quality_and_style_apart():
    assert {c.family for c in CONSTRUCTS} == {"quality", "style"} and components is not None


def test_feeds(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps([
        {"id": 1, "eventId": 8, "eventName": "Pass", "subEventName": "", "matchId": 5, "teamId": 9, "playerId": 7, "matchPeriod": "1H", "eventSec": 1.5, "positions": [{"x": 50, "y": 20}], "tags": [{"id": 1801}, {"id": 302}]},
        {"id": 2, "eventId": 8, "eventName": "Duel", "subEventName": "Air", "matchId": 5, "teamId": 9, "playerId": None, "matchPeriod": "1H", "eventSec": 2.0, "positions": [], "tags": []},
    ]))
    a, b = feeds.read_events(spark, str(tmp_path / "e.json")).orderBy("event_id").collect()
    assert (a.start_x, a.end_x, a.success, a.key_pass, a.subtype) == (0.5, 0.5, True, True, None)
    assert (b.player_id, b.start_x, b.success) == (0, None, None)
    team = lambda side, off: {"side": side, "score": 1, "formation": {"lineup": [{"playerId": 1}, {"playerId": 2}], "bench": [], "substitutions": [{"playerIn": 3, "playerOut": 2, "minute": off}]}}
    (tmp_path / "m.json").write_text(json.dumps([{"wyId": 5, "dateutc": "2018-01-01", "gameweek": 1, "label": "x", "status": "Played", "teamsData": {"9": team("home", 60), "8": team("away", 95)}}]))
    sheets = feeds.read_sheets(spark, str(tmp_path / "m.json"))
    assert feeds.matches(sheets).first()[-2:] == (9, 8)
    got = {(r.team_id, r.player_id): r.minutes for r in feeds.minutes_played(sheets).collect()}
    assert got == {(9, 1): 90, (9, 2): 60, (9, 3): 30, (8, 1): 90, (8, 2): 95, (8, 3): 0}


def test_stream_counts_like_the_batch(spark, tmp_path):
    e = spark.read.parquet(f"{SMALL}/events.parquet").select("ts", "event_type")
    e.write.parquet(str(tmp_path / "in"))
    s = five_minute_counts(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("bins").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    want = e.groupBy(F.window("ts", "5 minutes").start.alias("start"), "event_type").count()
    assert spark.table("bins").count() == want.count() and spark.table("bins").agg(F.sum("n")).first()[0] == e.count()


def test_entry_and_registry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_fields_and_licences_are_refused(spark):
    from matchgrain.functions.text import refused_fields
    from matchgrain.operators.evidence import NotAllowed, assert_may

    df = spark.sql("select 1 as id, named_struct('overall', 1, 'x', array(named_struct('player_rating', 2))) as body, map('a', named_struct('fine', 1)) as m, 3 as operating")
    assert refused_fields(df.schema) == ["body.overall", "body.x[].player_rating"]
    assert_may("open-events", "commit")
    for provider, use in (("research-only", "host"), ("unheard-of", "ingest")):
        with pytest.raises(NotAllowed):
            assert_may(provider, use)


def test_value_ranks_as_by_sorting(spark):
    from matchgrain.operators.ranks import average_ranks, order_statistics

    values = [5.0, 1.0, 1.0, 3.0, 5.0, 5.0, 2.0, 9.0, None]
    rows = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    known = sorted(v for v in values if v is not None)
    want = {v: sum(k + 1 for k, x in enumerate(known) if x == v) / known.count(v) for v in known}
    assert {(r.v, r.r) for r in average_ranks(rows, "v", "r").collect()} == set(want.items())
    assert {r.p: r.value for r in order_statistics(rows, "v", (1, 50, 100)).collect()} == {1: 1.0, 50: 3.0, 100: 9.0}
