import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from cases import documents, messy_rows, ordered, small_documents
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from matchgrain.llm import packing, tokens

_T = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
_T.encode_special_tokens = True


def ids_of(text):
    return _T.encode(text or "", add_special_tokens=False).ids


@given(st.lists(st.text(alphabet=st.sampled_from(list("ab '.,1é日\n\t  　\x85 \r  ")), max_size=25), max_size=6))
@settings(max_examples=300, deadline=None)
def test_encoder_gives_the_tokenizers_ids(texts):
    ids, count = tokens.Encoder.__call__(tokens.encoder(), [t.encode() for t in texts])
    cut = np.cumsum(count)
    assert [x.tolist() for x in np.split(ids, cut[:-1])] == [ids_of(t) for t in texts] if texts else len(ids) == 0


@pytest.mark.parametrize("rows", [messy_rows(), small_documents(), []], ids=["messy", "small", "empty"])
def test_pieces_fill_sequences_without_gaps(spark, rows):
    got = packing.pack(packing.token_pieces(documents(spark, rows))).collect()
    want = []
    for doc_id, text in rows:
        ids = [*ids_of(text), 2]
        head = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        for p, (a, b) in enumerate(zip([0, *range(head, len(ids), 1024)], range(head, len(ids) + 1, 1024), strict=True)):
            want.append((doc_id, p, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())))
    assert ordered([(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got]) == ordered(want)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 1024
    # No more than best fit decreasing on the same lengths needs.
    bins = []
    for n in sorted((w[3] for w in want), reverse=True):
        room = [b for b in bins if b[0] >= n]
        if room:
            min(room)[0] -= n
        else:
            bins.append([1024 - n])
    assert len(sequences) <= len(bins)


def test_knapsack_is_exact():
    import itertools

    lengths, price = np.array([3, 4, 7]), np.array([2.0, 3.1, 5.0])
    best = max(a * 2.0 + b * 3.1 + c * 5.0 for a, b, c in itertools.product(range(7), repeat=3) if 3 * a + 4 * b + 7 * c <= 20)
    c = packing.best_configuration(lengths, price, np.array([9, 9, 9]), 20)
    assert c @ lengths <= 20 and c @ price == pytest.approx(best)


def test_special_strings_are_ordinary_text(spark):
    text = "a <|endoftext|> b"
    ids, _ = tokens.encoder()([text.encode()])
    assert ids.tolist() == ids_of(text) and tokens.END_OF_TEXT not in ids_of(text)
    got = packing.token_pieces(documents(spark, [(1, text)])).collect()
    assert [(r.length, r.ids_crc32) for r in got] == [(len(ids) + 1, zlib.crc32(np.append(ids, 2).astype("<u4").tobytes()))]


@given(st.lists(st.integers(1, 40), max_size=60))
@settings(max_examples=100, deadline=None)
def test_plans_use_up_the_counts(pieces):
    h = np.bincount(pieces, minlength=1)
    lengths = np.flatnonzero(h)
    plan = packing.plan(lengths, h[lengths], 40)
    assert sum((k * c for c, k, _ in plan), np.zeros(len(lengths), np.int64)).tolist() == h[lengths].tolist()
    assert all(k > 0 and c @ lengths <= 40 for c, k, _ in plan)
    # Never more than first fit could need: all but one sequence are more than half full.
    assert sum(k for _, k, _ in plan) <= 2 * sum(pieces) / 40 + 1


def test_limits_bind_the_knapsack():
    c = packing.best_configuration(np.array([3, 4, 7]), np.array([2.0, 3.1, 5.0]), np.array([9, 1, 1]), 20)
    assert c.tolist() == [3, 1, 1]


def test_the_program_decides(monkeypatch):
    """Most sequences are configurations of the program, and without it more of them are needed."""
    pieces = [10, 15, 18, 19, 21, 30, 34, 34, 35, 37, 37, 42, 43, 43, 44, 45, 46, 47, 49, 50, 55, 55, 56, 57, 57]

    def run(sizes, capacity):
        h = np.bincount(sizes)
        lengths = np.flatnonzero(h)
        return packing.plan(lengths, h[lengths], capacity)

    got = run(pieces, 100)
    many = run(np.random.default_rng(1).integers(1, 300, 3000), 300)
    assert sum(k for _, k, program in many if program) >= 0.8 * sum(k for _, k, _ in many)
    monkeypatch.setattr(packing, "solve", lambda *_: {})
    assert sum(k for _, k, _ in got) < sum(k for _, k, _ in run(pieces, 100))
