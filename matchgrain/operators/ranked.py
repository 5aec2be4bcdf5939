"""A squad's elevens in a row, the least loss first, so that what absences leave is the first one without those players.

Small helpers for one squad inside a task; players are bits, by ascending id. Of all elevens those stay that can be the best
one after some set of up to ``most`` absences. A player is behind another one who can stand wherever they can and brings no
less of anything that counts there (of equal ones the first is ahead). An eleven with a player in and one ahead of them out is
no better than the one that changes the two, so it is needed only if all who are out and ahead of someone in it are absent:
with more than ``most`` of them it never is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cache
from itertools import combinations
from math import comb

import numpy as np


@cache
def subsets(n: int, k: int) -> np.ndarray:
    """All sets of k of n players, as bits."""
    return (np.int64(1) << np.array([*combinations(range(n), k)], dtype=np.int64).reshape(-1, k)).sum(1)


def _bits(flags: np.ndarray) -> np.ndarray:
    """Rows of flags, one for each player, as bits."""
    return np.where(flags, np.int64(1) << np.arange(flags.shape[-1], dtype=np.int64), 0).sum(-1)


def ahead(able: np.ndarray, worth: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each player, as bits, those who are ahead. ``able``: slots by players; ``worth``: players by requirements;
    ``counts``: slots by requirements."""
    n = able.shape[1]
    asked = able.T.astype(int) @ counts > 0  # what counts somewhere that the player can stand
    no_less = (able[:, :, None] <= able[:, None, :]).all(0) & ((worth[None] >= worth[:, None]) | ~asked[:, None]).all(2)
    return _bits(no_less & ~(no_less.T & (np.arange(n)[None] >= np.arange(n)[:, None])))


def ranked(able: np.ndarray, worth: np.ndarray, counts: np.ndarray, places: Sequence[int], minima: Sequence[int], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Players, largest and total shortfall of a squad's elevens, in ascending order of the two."""
    worth = np.minimum(worth, minima)  # more than enough is enough
    before = ahead(able, worth, counts)
    mask, better, sums = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros((1, len(minima)), np.int64)
    for i, k in enumerate(places):
        ids = np.flatnonzero(able[i])
        own = np.array([*combinations(ids, k)], dtype=np.int64).reshape(comb(len(ids), k), k)
        m, b, v = (np.int64(1) << own).sum(1), np.bitwise_or.reduce(before[own], axis=1), worth[own].sum(1) * counts[i]
        left, right = np.nonzero((mask[:, None] & m) == 0)
        mask, better, sums = mask[left] | m[right], better[left] | b[right], sums[left] + v[right]
        # Who is out and can stand in none of the slots to come stays out.
        out = better & ~mask & _bits(~able[i + 1 :].any(0))
        keep = np.bitwise_count(out) <= most
        mask, better, sums = mask[keep], better[keep], sums[keep]
    short = np.maximum(0, np.array(minima, dtype=np.int64) - sums)
    worst, total = short.max(1), short.sum(1)
    order = np.lexsort((total, worst))
    return mask[order], worst[order], total[order]


def first_without(masks: np.ndarray, gone: np.ndarray) -> np.ndarray:
    """For each set of players the place of the first of ``masks`` that has none of them; -1 if all have some."""
    at, left, start = np.full(len(gone), -1), np.arange(len(gone)), 0
    while len(left) and start < len(masks):
        step = max(16, (1 << 17) // len(left))  # so much is looked at at once
        free = (gone[left, None] & masks[start : start + step]) == 0
        met = free.any(1)
        at[left[met]] = start + free[met].argmax(1)
        left, start = left[~met], start + step
    return at


def after_absences(masks: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of players, sets of up to ``most`` of a squad's n, and the place of the first of ``masks`` without them: -1 for a
    core. Sets that hold a smaller one after which there is none are left out."""
    sizes, gone = [], []
    for k in range(1, min(most, n) + 1):
        gone.append(subsets(n, k))
        sizes.append(np.full(len(gone[-1]), k))
    k, gone = np.concatenate(sizes), np.concatenate(gone)
    at = first_without(masks, gone)
    some = {0, *gone[at >= 0].tolist()}
    core = [at[i] >= 0 or all(g & ~(1 << b) in some for b in range(n) if g >> b & 1) for i, g in enumerate(gone.tolist())]
    return k[core], gone[core], at[core]
