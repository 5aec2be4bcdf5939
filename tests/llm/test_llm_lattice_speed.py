"""The lattice in plain products agrees with the one in logarithms, which only long and improbable words still need."""

import numpy as np

from matchgrain.llm.lattice_lm import Lattice


def lattice(models):
    rng = np.random.default_rng(5)
    pieces = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"abc", b"bc", b" ab", b"ca", b"bca"]
    weights = rng.random((models, len(pieces)))
    return Lattice(pieces, weights / weights.sum(axis=1, keepdims=True))


def words(rng, n, longest):
    return [bytes(rng.choice(list(b"abc"), rng.integers(0, longest + 1)).tolist()) for _ in range(n)]


def test_usual_words_need_no_logarithms(monkeypatch):
    rng, one, seen = np.random.default_rng(6), lattice(2), []
    many = words(rng, 300, 30)
    monkeypatch.setattr(np, "logaddexp", lambda *a: seen.append(a))
    monkeypatch.setattr(np, "exp", lambda *a: seen.append(a))
    one.forward(many)
    one.expected(many)
    assert not seen


def test_as_in_logarithms():
    rng, one = np.random.default_rng(7), lattice(2)
    many = words(rng, 200, 12) + [b"ab" * 120, b"\xff" * 200, b"abc" * 150, b""]
    uses, want = np.zeros(len(one.hashes)), []
    for w in many:
        want.append(one._in_logarithms(np.frombuffer(b" " + w, np.uint8)[None], uses)[0])
    ordered = np.zeros(len(uses))
    ordered[one.order] = uses
    assert np.allclose(one.forward(many), want, rtol=1e-11) and np.allclose(one.expected(many), ordered, rtol=1e-9)
    assert min(w[0] for w in want) < np.log(1e-250)
