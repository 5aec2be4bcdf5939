"""Ranked lexical search against scoring every document."""

import math
import re
from collections import Counter

import pytest
from cases import CLASHING, documents, messy_rows, small_documents, stored

from matchgrain.llm import lexical_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def plain(rows, items, k):
    docs = [(i, Counter(t), len(t)) for i, x in rows if (t := terms(x))]
    total, size = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    asks = {}
    for i, text in items:
        asks.setdefault(i, []).append(text)
    out = []
    for i, texts in asks.items():
        asked = Counter(terms(min((t for t in texts if t is not None), default=None)))
        scored = []
        for d, c, n in docs:
            m = 100 - 75 + 75 * n * total // size
            s = sum(r * math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t, r in asked.items() if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, at + 1, d, -s) for at, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return Counter(out)


def items():
    rows = [(0, "w1 w2 w3 W4 w5"), (1, "w7"), (2, "same line here same"), (3, None), (4, ""), (5, "nowhere"), (None, "one two"), (6, "Été 日本語 naïve ωmega Ωmega"), (7, "x"), (7, "a"), (7, None), (8, "the that in abc abc w9, w10|w11 w12")]
    return [*rows, *((20 + j, " ".join(f"w{j * k % 400}" for k in range(1, 40))) for j in range(1, 12))]


def asked(spark):
    return spark.createDataFrame([(i, t, *(("x",) * len(CLASHING))) for i, t in items()], "item_id long, text string, " + ", ".join(f"{c} string" for c in CLASHING))


@pytest.mark.parametrize("known_terms,seed_postings", [(0, 1), (10**6, 1000)])
def test_as_by_scoring_all(spark, tmp_path, known_terms, seed_postings):
    rows = messy_rows() + [(1000 + i, t) for i, t in small_documents(40)]
    got = lexical_search.ranked(stored(spark, tmp_path, rows), asked(spark), 4, known_terms, seed_postings).select("item_id", "rank", "doc_id", "score")
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, items(), 4)


@pytest.mark.parametrize("rows", [[], [(1, None), (2, " - ")]], ids=["empty", "without terms"])
def test_nothing_to_rank(spark, rows):
    got = lexical_search.ranked(documents(spark, rows), asked(spark))
    assert got.count() == 0 and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_no_items(spark):
    assert lexical_search.ranked(documents(spark, messy_rows()), asked(spark).limit(0)).count() == 0


def test_leaving_out_terms_saves_sums_and_loses_none(spark, tmp_path):
    """A hot term's postings are not summed for an item whose floor they cannot reach."""
    rows = [(i, "common " * 3 + f"word{i % 50}" + (" needle thread eye" if i < 12 else "")) for i in range(900)]
    items = [(0, "common needle thread eye"), (1, "common"), (2, "common word3 word4")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    got = lexical_search.ranked(stored(spark, tmp_path, rows), frame, seed_postings=1)
    assert Counter(tuple(r) for r in got.collect()) == plain(rows, items, 10)
