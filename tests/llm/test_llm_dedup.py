"""Repeated passages (words) and repeated byte strings against brute force."""

import hashlib
from collections import Counter

import numpy as np
import pytest
from cases import collected, documents, messy_rows, ordered, small_documents, stored, words
from hypothesis import given, settings
from hypothesis import strategies as st

from matchgrain.llm import substring_dedup as s4
from matchgrain.llm import suffix_dedup as s9

HOT = dict(hot_runs=2, shard_bytes=1 << 12)


def plain_words(rows, window=35):
    texts = [words(t) for _, t in rows]
    c = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(rows, texts, strict=True):
        gone = {i + j for i in range(len(w) - window + 1) if c[tuple(w[i : i + window])] > 1 for j in range(window)}
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((doc_id, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return ordered(out)


@pytest.mark.parametrize("limits", [{}, HOT], ids=["usual", "all hot"])
@pytest.mark.parametrize("rows", [messy_rows(), small_documents(), []], ids=["messy", "small", "empty"])
def test_repeated_passages(spark, tmp_path, rows, limits):
    docs = stored(spark, tmp_path, rows)
    assert collected(s4.substring_dedup(docs, **limits), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_words(rows)


def test_stage_cuts_passages_and_keeps_columns(spark, tmp_path):
    rows = messy_rows()
    docs = stored(spark, tmp_path, rows)
    got = s4.without_repeats(docs)
    assert got.columns == docs.columns
    left = got.collect()
    want = {(i, h) for i, _, _, h in plain_words(rows)}
    assert {(r.doc_id, hashlib.sha256(" ".join(words(r.text)).encode()).hexdigest()) for r in left} == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in left)


def plain_bytes(rows, window=100):
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is not None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        raw = (rows[k][1] or "").encode()
        gone = np.zeros(len(raw), dtype=bool)
        for i in range(len(raw) - window + 1):
            if (piece := raw[i : i + window]) in seen:
                gone[i : i + window] = True
            else:
                seen.add(piece)
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out[k] = (rows[k][0], len(raw), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return ordered(list(out.values()))


@pytest.mark.parametrize("limits", [{}, HOT, {"budget": 4096}], ids=["usual", "all hot", "queues on disk"])
@pytest.mark.parametrize("rows", [messy_rows(), small_documents(), []], ids=["messy", "small", "empty"])
def test_repeated_bytes(spark, rows, limits):
    docs = documents(spark, rows).coalesce(1)  # rows with one id are told apart by their order
    assert collected(s9.suffix_dedup(docs, **limits), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == plain_bytes(rows)


@given(st.lists(st.integers(0, 3), min_size=1, max_size=200), st.sampled_from([64, 1 << 20]))
@settings(max_examples=200, deadline=None)
def test_induced_order(values, budget):
    text = np.array([v + 1 for v in values] + [0], dtype=np.int16)
    depth = 12
    order, prefix = s9.induced_order(text, depth, budget)
    deep = [text[i : i + depth].tolist() for i in range(len(text))]
    assert sorted(order.tolist()) == list(range(len(text)))
    assert all(deep[a] <= deep[b] for a, b in zip(order[:-1], order[1:], strict=True))
    for k in range(1, len(order)):
        a, b = text[order[k - 1] :].tolist(), text[order[k] :].tolist()
        same = next((j for j, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert prefix[k] == min(same, depth)


@given(st.lists(st.integers(1, 4), min_size=1, max_size=120), st.integers(1, 5), st.integers(0, 119))
@settings(max_examples=150, deadline=None)
def test_backward_search_counts(values, m, at):
    whole = [*values, 5]  # patterns never hold the separator, as in a shard
    index = s4.FMIndex(np.array(whole, dtype=np.int64), 8)
    pattern = values[at % len(values) :][:m]
    low, high = np.array([0]), np.array([len(whole)])
    for x in reversed(pattern):
        low, high = index.extend(np.array([x]), low, high)
    assert high[0] - low[0] == sum(whole[i : i + len(pattern)] == pattern for i in range(len(whole)))
