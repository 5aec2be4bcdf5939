"""Lattice likelihood and mixing rates."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
from cases import SMALL, collected, documents, messy_rows, ordered, small_documents, words
from hypothesis import given, settings
from hypothesis import strategies as st

from matchgrain.llm import lattice_lm as lm
from matchgrain.llm import mixing


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@given(st.text(alphabet="ab", min_size=1, max_size=9))
@settings(max_examples=60, deadline=None)
def test_forward_sums_all_segmentations(word):
    weight = {b" a": 0.2, b"a": 0.1, b"b": 0.15, b"ab": 0.25, b"bb": 0.1, b" ": 0.15, b"bab": 0.05}

    def total(text):
        return 1.0 if not text else sum(w * total(text[len(p) :]) for p, w in weight.items() if text.startswith(p))

    lattice = lm.Lattice(list(weight), np.array(list(weight.values())))
    assert lattice.forward([word.encode()])[0] == pytest.approx(math.log(total(b" " + word.encode())), rel=1e-9)
    # Expected uses: the derivative of the log probability by the log weight.
    uses = lattice.expected([word.encode()])
    p = list(weight)[3]
    bigger = dict(weight)
    bigger[p] *= 1 + 1e-6
    step = lm.Lattice(list(bigger), np.array(list(bigger.values()))).forward([word.encode()])[0] - lattice.forward([word.encode()])[0]
    assert uses[3] == pytest.approx(step / 1e-6, abs=1e-3)


@pytest.mark.parametrize("rows", [messy_rows(), small_documents()], ids=["messy", "small"])
def test_base_scores_and_held_out_gain(spark, rows):
    docs = documents(spark, rows)
    fold = mixing.F.pmod(mixing.F.crc32(mixing.F.col("doc_id").cast("string").cast("binary")), mixing.F.lit(7)) == 2
    got = lm.lattice_scores(docs, mixing.F.coalesce(fold, mixing.F.lit(False))).collect()
    tokens = [[*words(lower(t)), "\n"] for _, t in rows]
    c = Counter(w for (i, _), ws in zip(rows, tokens, strict=True) if not held_out(i) for w in ws)
    n, v = sum(c.values()), len(c)
    want = [(i, held_out(i), len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, _), ws in zip(rows, tokens, strict=True)]
    assert ordered([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got]) == ordered(want)
    assert all(math.isfinite(r.score) and r.score <= 0 for r in got)


def test_held_out_gain(spark):
    """On documents that it has not seen the model does better than the add-one unigram."""
    got = lm.op5_lattice_lm(spark, "/root/testdata/sf0.1").where("held_out").agg(mixing.F.sum("score"), mixing.F.sum("base_score")).first()
    assert got[0] > got[1]


def test_no_documents_and_none_in_training(spark):
    none = mixing.F.lit(False)
    assert lm.lattice_scores(documents(spark, []), none).count() == 0
    got = lm.lattice_scores(documents(spark, [(1, "only held out"), (2, None)]), mixing.F.lit(True)).collect()
    assert {(r.doc_id, r.train_tokens, r.n_known) for r in got} == {(1, 0, 0), (2, 0, 0)} and all(math.isfinite(r.score) for r in got)


_EDGE = regex.compile(r"[ \t\n\x0b\f\r\p{Z}]+|(?<=[\p{L}\p{N}])(?=[^ \t\n\x0b\f\r\p{Z}\p{L}\p{N}])", regex.V1)


def plain_rates(rows, labels, targets=mixing.TARGETS):
    """The same classifier and projected steps with plain Python and numpy."""
    domain = {}
    for i, quality, toxic in labels:
        if i is not None and not (quality is None and toxic is None):
            domain.setdefault(i, []).append((quality, toxic))
    domain = {i: 2 if 1 in [t for _, t in x] else 0 if min((q for q, _ in x if q is not None), default=None) == 1 else 1 for i, x in domain.items()}
    sets = [set(_EDGE.split((t or "").lower())) for _, t in rows]
    total, seen = [0, 0, 0], {}
    for (i, _), s in zip(rows, sets, strict=True):
        if i in domain:
            total[domain[i]] += 1
            for w in s - {""}:
                seen.setdefault(w, [0, 0, 0])[domain[i]] += 1
    n = sum(total)
    p, odds = np.full((len(rows), 3), 1 / 3), {}
    if n:
        gain = lambda x: sum(a * math.log(a * n / (sum(x) * total[k])) for k, a in enumerate(x) if a)
        share = {w: [(a + 0.5 * sum(x) / n) / (t + 0.5) for a, t in zip(x, total, strict=True)] for w, x in seen.items()}
        strong = lambda q: max(a for a, t in zip(q, total, strict=True) if t) >= mixing.LEAST_RATIO * min(a for a, t in zip(q, total, strict=True) if t)
        best = sorted(((-gain(x), w) for w, x in seen.items() if gain(x) >= mixing.LEAST_GAIN and strong(share[w])))[: mixing.FEATURES]
        odds = {w: [math.log(a) - mixing.ABSENCE * math.log(1 - a) for a in share[w]] for _, w in best}
        none = [math.log((total[k] + 1) / (n + 3)) + mixing.ABSENCE * sum(math.log(1 - share[w][k]) for w in odds) for k in range(3)]
        score = np.array([[none[k] + sum(odds[w][k] for w in s if w in odds) for k in range(3)] for s in sets]).reshape(-1, 3)
        p = np.exp(score - score.max(axis=1, keepdims=True, initial=-1e300))
        p /= p.sum(axis=1, keepdims=True)
    t = np.array([len(words(x)) for _, x in rows], float)
    rate = np.ones(len(rows))
    mass = (t * rate) @ p
    if mass.sum() > 0 and odds:
        everything = mass.sum()
        wanted = np.array([targets[d] for d in mixing.DOMAINS]) * mass[0] / targets["clean"]
        gap, stalled = mixing.distance(mass, wanted), 0
        for _ in range(mixing.STEPS):
            if gap <= mixing.TOLERANCE or stalled == mixing.STALLS:
                break
            still = rate > 0
            gram = (p[still] * t[still, None]).T @ p[still] + mixing.RIDGE * everything * np.eye(3)
            step = np.linalg.solve(gram, mass - wanted)
            tries = [np.maximum(0, rate - p @ (step / 2**h)) for h in range(mixing.HALVINGS)]
            better = next((r for r in tries if mixing.distance((t * r) @ p, wanted) < gap), None)
            if better is None:
                break
            rate, mass, before = better, (t * better) @ p, gap
            gap = mixing.distance(mass, wanted)
            stalled = stalled + 1 if before - gap < mixing.LEAST_CLOSED * before else 0
    return t, p, rate, mass


def copies_of(spark, rows, p, rate):
    """How often the pipeline's stage gives each row: by its rate and the hash of the row, the toxic never, the clean once at least."""
    frame = spark.createDataFrame([(k, i, x) for k, (i, x) in enumerate(rows)], "k long, doc_id long, text string")
    chance = mixing.F.pmod(mixing.F.xxhash64("doc_id", "text"), mixing.F.lit(1 << 32)) / mixing.F.lit(float(1 << 32))
    at = {r.k: r.c for r in frame.select("k", chance.alias("c")).collect()}
    out = []
    for k, (q, r) in enumerate(zip(p, rate, strict=True)):
        n = math.floor(r + at[k])
        out.append(0 if q[2] > max(q[0], q[1]) else max(1, n) if q[0] >= max(q[1], q[2]) else n)
    return [row for row, n in zip(rows, out, strict=True) for _ in range(n)]


def label_rows(folder=SMALL):
    return duckdb.sql(f"select doc_id, quality, toxic from read_parquet('{folder}/labels.parquet')").fetchall()


@pytest.mark.parametrize("rows,labels", [
    (small_documents(), label_rows()), (messy_rows(), [(1, 1, 0), (2, 1, 0), (2, 0, 1), (13, 0, 0), (14, None, None), (None, 1, 0), (999, 1, 0)]), (messy_rows(), []), ([], [(1, 1, 0)]),
], ids=["small", "messy", "no labels", "empty"])
def test_rates_as_by_plain_steps(spark, rows, labels):
    docs = documents(spark, rows)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = mixing.mixing_rates(docs.select("doc_id", "text", "source", "rate", "n_tokens"), lab)
    t, p, rate, mass = plain_rates(rows, labels)
    want = ordered([(i, int(a), *[round(float(x), 5) for x in b], round(float(c), 4)) for (i, _), a, b, c in zip(rows, t, p, rate, strict=True)])
    found = ordered([(r.doc_id, r.n_tokens, round(r.p_clean, 5), round(r.p_low, 5), round(r.p_toxic, 5), round(r.rate, 4)) for r in got.collect()])
    assert len(found) == len(want)
    for a, b in zip(found, want, strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=2e-4)
    kept = mixing.keep_mixed(docs, lab)
    assert kept.columns == docs.columns
    assert collected(kept, "doc_id", "text") == ordered(copies_of(spark, rows, p, rate))
    if not labels:
        assert kept.count() == len(rows) and all(r.rate == 1 for r in got.collect())


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01", "sf0.1"])
def test_each_target_is_met_and_the_toxic_go(size):
    folder = f"/root/testdata/{size}"
    rows, labels = duckdb.sql(f"select doc_id, text from read_parquet('{folder}/documents.parquet')").fetchall(), label_rows(folder)
    _, p, rate, mass = plain_rates(rows, labels)
    assert (rate >= 0).all() and mass / mass.sum() == pytest.approx([mixing.TARGETS[d] for d in mixing.DOMAINS], rel=0.01)
    r = {i: c for (i, _), c in zip(rows, rate, strict=True)}
    assert np.mean([r[i] for i, _, x in labels if x == 1]) <= 0.25
    toxic = {i for (i, _), q in zip(rows, p, strict=True) if q[2] > max(q[0], q[1])}
    assert np.mean([i in toxic for i, _, x in labels if x == 1]) >= 0.95 and np.mean([i in toxic for i, q, x in labels if q == 1 and x == 0]) <= 0.05


def test_the_query_meets_its_targets(spark):
    got = mixing.op6_mixing_rates(spark, "/root/testdata/sf0.01").collect()
    mass = np.array([[r.n_tokens * r.rate * x for x in (r.p_clean, r.p_low, r.p_toxic)] for r in got]).sum(axis=0)
    assert mass / mass.sum() == pytest.approx([mixing.TARGETS[d] for d in mixing.DOMAINS], rel=0.01) and {r.gap < 0.01 for r in got} == {True}


def test_what_no_rates_can_meet_is_reported(spark):
    """Every document is half toxic as far as anyone can tell."""
    rows = [(i, f"same words here {i}") for i in range(40)]
    labels = [(i, int(i % 2 == 0), int(i % 2)) for i in range(40)]
    got = mixing.mixing_rates(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len(got) == 40 and all(r.gap > 1 and r.rate == 1 for r in got)


def test_vocabulary_score_is_the_lattice_alone(spark):
    rows = messy_rows()
    pieces, given = lm.vocabulary_pieces()
    lattice = lm.Lattice(pieces, given)
    got = {}
    for r in lm.lattice_scores(documents(spark, rows), mixing.F.col("doc_id").eqNullSafe(1)).collect():
        got.setdefault(r.doc_id, []).append(round(r.vocabulary_score, 1))
    for i in {i for i, _ in rows}:
        want = sorted(round(float(lattice.forward([*(w.encode() for w in words(lower(t))), b""]).sum()) / math.log(10), 1) for d, t in rows if d == i)
        assert sorted(got[i]) == pytest.approx(want, rel=1e-5, abs=0.11)


def test_long_words_teach_pieces_too(monkeypatch):
    pieces = [bytes([b]) for b in range(256)] + [b" ab", b"abc", b"bca", b"cabcab"]
    lattice = lm.Lattice(pieces, np.full(len(pieces), 1 / len(pieces)))
    for words in ([b"abc" * 300, b"bca" * 300], [b"ab" + b"cab" * 85], [b"x" * (lm.LONG * 2 - 1)]):
        uses = lattice.expected(words)
        assert np.isclose(uses @ np.array([len(p) for p in pieces]), sum(len(w) + 1 for w in words))  # every byte is covered once
        with monkeypatch.context() as m:
            m.setattr(lm, "LONG", 10_000)
            assert np.allclose(uses, lattice.expected(words))
