"""Exact top-k and token counts."""

import math
import struct

import numpy as np
import public_tokenizers
import pytest
from cases import collected, messy_rows, ordered, small_documents, stored
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matchgrain.llm import token_counts, topk

EMB = "vec_id long, embedding array<float>, label int, query_id long, score long, rank int, block long, shard int"


def plain_top(rows, k, every):
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q in sorted({i for i, _ in good if i % every == 0}):
        mine = next(v for i, v in good if i == q)
        scores = sorted((-sum(a * b for a, b in zip(mine, v, strict=True)), i) for i, v in good if i != q and len(v) == len(mine))
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return ordered(out)


def vectors():
    r = np.random.default_rng(0)
    rows = [(i, [float(x) for x in r.normal(size=8)], 0, 1, 1, 1, 1, 1) for i in range(300)]
    rows += [(300 + i, rows[5][1], *rows[0][2:]) for i in range(40)]  # ties
    bad = [None, [], [None] * 8, [float("nan")] * 8, [float("inf")] + [0.0] * 7, [1.0] * 7 + [None]]
    rows += [(400 + i, v, None, None, None, None, None, None) for i, v in enumerate(bad)] + [(None, rows[0][1], *rows[0][2:])]
    rows += [(500, [0.5, 2.0, -1.0], 1, 1, 1, 1, 1, 1), (502, [1.5, 2.0, 1.0], 1, 1, 1, 1, 1, 1)]  # another length
    rows += [(600, [3e8] * 8, 1, 1, 1, 1, 1, 1), (601, [-3e4] * 8, 1, 1, 1, 1, 1, 1)]  # beyond what doubles hold exactly
    return rows


@pytest.mark.parametrize("shard_rows", [16, 20_000])
def test_top_k_as_by_all_pairs(spark, shard_rows):
    rows = vectors()
    got = topk.top_k(spark.createDataFrame(rows, EMB), F.pmod("vec_id", F.lit(4)) == 0, k=5, shard_rows=shard_rows)
    assert collected(got, "query_id", "rank", "vec_id", "score") == plain_top(rows, 5, 4)


def test_top_k_of_nothing_and_of_few(spark):
    assert topk.top_k(spark.createDataFrame([], EMB), F.col("vec_id") == 0).count() == 0
    two = spark.createDataFrame([(0, [1.0], 0, 0, 0, 0, 0, 0), (1, [-2.5], 0, 0, 0, 0, 0, 0)], EMB)
    assert collected(topk.top_k(two, F.col("vec_id") == 0), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 1024 * -2560)]


def test_repeated_query_ids_are_answered_alike_however_rows_lie(spark):
    rows = [(0, [1.0, 2.0], 0, 0, 0, 0, 0, 0), (0, [0.5, -9.0], 0, 0, 0, 0, 0, 0), (0, [3.0, 0.0], 0, 0, 0, 0, 0, 0)] + [(i, [float(i), float(5 - i)], 0, 0, 0, 0, 0, 0) for i in range(1, 9)]
    got = [collected(topk.top_k(spark.createDataFrame(r, EMB).repartition(n), F.col("vec_id") == 0, k=3), "query_id", "rank", "vec_id", "score") for r in (rows, rows[::-1]) for n in (1, 3)]
    assert len(got[0]) == 3 and all(g == got[0] for g in got)


@given(st.lists(st.lists(st.integers(-5, 5), min_size=3, max_size=3), min_size=1, max_size=80), st.lists(st.integers(-5, 5), min_size=3, max_size=3), st.integers(1, 6))
@settings(max_examples=100, deadline=None)
def test_tree_search(points, q, k):
    points, q = np.array(points, float), np.array(q, float)
    tree = topk.Tree(np.arange(len(points)), points, leaf=4)
    bounds = np.maximum(q, 0) @ tree.high.T + np.minimum(q, 0) @ tree.low.T
    got = tree.search(-1, q, k, bounds, float("-inf"))
    want = sorted(((int(s), i) for i, s in enumerate(points @ q)), key=lambda x: (-x[0], x[1]))[:k]
    assert sorted(got, key=lambda x: (-x[0], x[1])) == want


@pytest.mark.parametrize("width,block", [(2, 1), (2, 7), (4, 3), (2, 1 << 18)])
def test_separator_scan(spark, width, block):
    r = np.random.default_rng(2)
    files = []
    want = []
    for f, (n, share) in enumerate([(0, 0), (1, 1), (50, 0.3), (200, 0.02), (64, 1), (33, 0)]):
        ids = [9 if r.random() < share else int(r.integers(10, 5000)) for _ in range(n)]
        files.append((f"f{f}", struct.pack(f"<{n}{'H' if width == 2 else 'I'}", *ids)))
        start = no = 0
        for k, x in enumerate([*ids, None]):
            if x == 9 or (x is None and start < n):
                want.append((f"f{f}", no, start, k - start, x == 9))
                start, no = k + 1, no + 1
    got = token_counts.count_tokens(spark.createDataFrame(files, "path string, content binary"), end=9, width=width, block_tokens=block)
    assert collected(got, "path", "doc_no", "start", "n_tokens", "closed") == ordered(want)


@pytest.mark.parametrize("rows", [messy_rows(), small_documents(), []], ids=["messy", "small", "empty"])
def test_counts_are_those_of_the_tokenizer(spark, tmp_path, rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    docs = stored(spark, tmp_path, rows)
    got = token_counts.corpus_token_counts(docs)
    assert collected(got, "doc_id", "n_tokens") == ordered([(i, len(t.encode(x or "", add_special_tokens=False).ids)) for i, x in rows])
