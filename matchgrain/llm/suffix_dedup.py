"""Suffix-array dedup of repeated byte strings by external induced sorting.

Passages that may repeat (see ``anchors``) are dealt to shards. A shard sorts its suffixes by induction: the suffixes that
start a rise (the leftmost ones) are sorted first, on 8-byte keys down to the depth that can matter; the falling suffixes
follow from them in one sweep upwards, the rising ones in one sweep downwards. What a sweep has placed pushes its predecessors
into queues, one a byte value; the queues keep to a memory budget and go on in a temporary file beyond it. Each placed
suffix carries its common prefix with the one before it: one more than the least between the two suffixes that induced them.

The reduced problem is not solved by recursion but by the keys, because suffixes need order only as deep as a window (100
bytes): equal windows then stand together, and a common prefix of 100 tells them apart from the rest.

Defined results: null and empty texts have no bytes; occurrences overlap freely; "earlier" is a smaller doc_id (a null one is
smallest), then for rows with one id the earlier row, then the earlier start; matches never cross documents.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Unit, covered, repeated_windows
from .common import short
from .substring_dedup import with_rows

WINDOW, GRAM = 100, 32
#: Bytes that a shard's queues hold in memory before they go on in a file.
QUEUE_BYTES = 64 << 20


class Queues:
    """First-in first-out queues of (order, position) arrays, one a symbol, beyond ``budget`` bytes on disk."""

    def __init__(self, symbols: int, budget: int = QUEUE_BYTES):
        self.parts: list[list] = [[] for _ in range(symbols)]
        self.budget, self.held, self.file = budget, 0, None

    def push(self, symbol: np.ndarray, order: np.ndarray, position: np.ndarray) -> None:
        by = np.argsort(symbol, kind="stable")
        symbol, order, position = symbol[by], order[by], position[by]
        cut = np.flatnonzero(np.diff(symbol)) + 1
        for s, o, p in zip(np.split(symbol, cut), np.split(order, cut), np.split(position, cut), strict=True):
            if len(s):
                self.parts[s[0]].append((o, p))
                self.held += o.nbytes + p.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for q in self.parts:
            for i, part in enumerate(q):
                if isinstance(part[0], np.ndarray):
                    at = self.file.tell()
                    for x in part:
                        self.file.write(np.ascontiguousarray(x, dtype=np.int32).tobytes())
                    q[i] = (at, len(part[0]))
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray]:
        orders, positions = [], []
        for a, b in self.parts[symbol]:
            if isinstance(a, np.ndarray):
                self.held -= a.nbytes + b.nbytes
            else:
                self.file.seek(a)
                both = np.frombuffer(self.file.read(8 * b), dtype=np.int32)
                a, b = both[:b], both[b:]
            orders.append(a)
            positions.append(b)
        self.parts[symbol] = []
        if not orders:
            return np.zeros(0, np.int32), np.zeros(0, np.int32)
        return np.concatenate(orders), np.concatenate(positions)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def rising(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the text's end is below every symbol."""
    n = len(text)
    step = np.sign(np.diff(text.astype(np.int32), append=-1))
    differs = np.where(step != 0, np.arange(n), n)
    nearest = np.minimum.accumulate(differs[::-1])[::-1]
    return step[nearest] > 0


SYMBOLS, BITS = 7, 9  #: symbols that fit one 64-bit key


def packed(text: np.ndarray, depth: int) -> np.ndarray:
    """For each place the next seven symbols in one number; beyond the end there is nothing but zeros."""
    padded = np.concatenate((text, np.zeros(depth + 2 * SYMBOLS, text.dtype))).astype(np.uint64)
    key = padded[: len(padded) - SYMBOLS + 1].copy()
    for j in range(1, SYMBOLS):
        key <<= np.uint64(BITS)
        key |= padded[j : len(padded) - SYMBOLS + 1 + j]
    return key


def common(keys: np.ndarray, n: int, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b of a text of n symbols, up to ``most``; seven symbols at a time."""
    out = np.zeros(len(a), dtype=np.int32)
    live = np.arange(len(a))
    for k in range(0, most, SYMBOLS):
        x = keys[np.minimum(a[live] + k, len(keys) - 1)] ^ keys[np.minimum(b[live] + k, len(keys) - 1)]
        differ = x != 0
        at = live[differ]
        # Leading symbols that agree: the first one that differs is the highest set one.
        agree = np.zeros(len(at), dtype=np.int64)
        for j in range(SYMBOLS - 1, 0, -1):
            agree += x[differ] >> np.uint64(BITS * j) == 0
        out[at] = k + agree
        live = live[~differ]
        out[live] = k + SYMBOLS
        if not len(live):
            break
    return np.minimum(np.minimum(out, most), n - np.maximum(a, b))


def named(keys: np.ndarray, low: np.ndarray, n: int) -> np.ndarray:
    """Ranks of the pieces of text from each of ``low`` (ascending places) to the next one, its first symbol included, or to the end.

    Where one piece begins like another and goes on, it is the smaller one: a piece ends before a rise, and what goes on falls.
    """
    size = np.append(np.diff(low) + 1, n - low[-1])
    name, todo = np.zeros(len(low), dtype=np.int64), np.arange(len(low))
    for k in range(0, int(size.max()) + SYMBOLS, SYMBOLS):
        # Beyond a piece's end stands what is larger than any symbol.
        cut = np.clip(k + SYMBOLS - size[todo], 0, SYMBOLS).astype(np.uint64) * np.uint64(BITS)
        key = keys[np.minimum(low[todo] + k, len(keys) - 1)] >> cut << cut | (np.uint64(1) << cut) - np.uint64(1)
        order = np.argsort(key) if k == 0 else np.lexsort((key, name[todo]))
        key, group = key[order], name[todo[order]]
        other = np.ones(len(order), dtype=bool)
        other[1:] = group[1:] != group[:-1]
        new = other.copy()
        new[1:] |= key[1:] != key[:-1]
        at = np.arange(len(order))
        name[todo[order]] = group + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(other, at, 0))
        alone = new & np.append(new[1:], True)
        todo = np.sort(todo[order[~alone & (cut[order] == 0)]])
        if not len(todo):
            break
    return name


def reduced_order(name: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes of the reduced text of names, as deep as ``depth`` names, by doubling: the recursion's last step;
    and whether each one is the same as the one before it, that deep."""
    n, rank, have = len(name), np.unique(name, return_inverse=True)[1].astype(np.uint64), 1
    while True:
        nxt = np.zeros(n, dtype=np.uint64)
        nxt[: n - have] = rank[have:] + np.uint64(1)
        key = rank << np.uint64(32) | nxt
        order = np.argsort(key)
        key = key[order]
        new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1]))).astype(np.uint64)
        have *= 2
        if have >= depth or new[-1] == n - 1:
            return order, np.append(False, new[1:] == new[:-1])
        rank = np.empty(n, dtype=np.uint64)
        rank[order] = new


def induced_order(text: np.ndarray, depth: int, budget: int = QUEUE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of ``text`` (symbols from 0 on) in order as deep as ``depth``, and common prefixes with the one before."""
    n, symbols = len(text), int(text.max()) + 1 if len(text) else 0
    up, keys = rising(text), packed(text, depth)
    low = np.flatnonzero(up[1:] & ~up[:-1]) + 1
    if len(low):
        # The text is cut at these places; its pieces get names, and the text of names is ordered in place of the suffixes.
        # A piece spans two symbols at least, so half as many names reach as deep.
        order, same = reduced_order(named(keys, low, n), depth // 2 + 1)
        low = low[order]
    low = low.astype(np.int32)
    low_prefix = np.zeros(len(low), np.int32)
    if len(low):
        # Where the names agree all the way the prefix is as long as it can matter, but for the text's end.
        apart = np.flatnonzero(~same)[1:]
        low_prefix[1:] = np.minimum(depth, n - np.maximum(low[:-1], low[1:]))
        low_prefix[apart] = common(keys, n, low[apart - 1], low[apart], depth)
    low_cut = np.searchsorted(text[low], np.arange(symbols + 1)) if len(low) else np.zeros(symbols + 1, np.int64)

    def sweep(seeds, falling: bool) -> tuple[list, np.ndarray, np.ndarray]:
        """Place what the seeds induce. ``seeds(c)``: suffixes of symbol c known beforehand, in sweep order, with prefixes."""
        queue = Queues(symbols, budget)
        placed, prefix = np.empty(n + len(low) + 2, dtype=np.int32), np.empty(n + len(low) + 2, dtype=np.int32)
        size, parts = 0, []

        def put(at: np.ndarray, lcp: np.ndarray) -> np.ndarray:
            nonlocal size
            placed[size : size + len(at)], prefix[size : size + len(at)] = at, lcp
            order = np.arange(size, size + len(at), dtype=np.int32)
            size += len(at)
            return order

        def prefixes(order: np.ndarray) -> np.ndarray:
            """Each induced suffix's common prefix with the one before it in the bucket, from what induced the two."""
            lcp = np.zeros(len(order), dtype=np.int32)
            if len(order) > 1:
                lcp[1:] = 1 + np.minimum.reduceat(prefix[: order[-1] + 2], order + 1)[:-1]
            return np.minimum(lcp, depth)

        def induce(at: np.ndarray, order: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
            """Push predecessors; those of the same symbol come back at once."""
            ok = at > 0
            p, o = at[ok] - 1, order[ok]
            ok = up[p] != falling  # a falling suffix begins with no smaller a symbol than the next one, a rising one with no larger
            p, o = p[ok], o[ok]
            same = text[p] == c
            queue.push(text[p[~same]].astype(np.uint16), o[~same], p[~same])
            return o[same], p[same]

        for c in range(symbols) if falling else range(symbols - 1, -1, -1):
            begin = size
            order, at = queue.pop(c)
            if falling and n and text[n - 1] == c:  # the last suffix follows from the end
                at, order = np.append(np.int32(n - 1), at).astype(np.int32), np.append(np.int32(-1), order).astype(np.int32)
            while len(at):
                lcp = np.zeros(len(at), np.int32)
                real = order >= 0
                lcp[real] = prefixes(order[real])
                if not real.all():
                    lcp[1:2] = 1
                if size > begin:  # the last of the round before
                    lcp[0] = common(keys, n, placed[size - 1 : size], at[:1], depth)[0]
                order, at = induce(at, put(at, lcp), c)
            made = (placed[begin:size].copy(), prefix[begin:size].copy())
            at, lcp = seeds(c)
            if len(at):
                lcp = lcp.copy()
                lcp[0] = common(keys, n, placed[size - 1 : size], at[:1], depth)[0] if size else 0
                induce(at, put(at, lcp), c)
            parts.append(made)
        queue.close()
        return parts

    down = sweep(lambda c: (low[low_cut[c] : low_cut[c + 1]], low_prefix[low_cut[c] : low_cut[c + 1]]), True)

    def fallen(c: int) -> tuple[np.ndarray, np.ndarray]:
        at, lcp = down[c]
        return at[::-1], np.append(lcp[1:], 0)[::-1]

    risen = sweep(fallen, False)[::-1]
    order, prefix = [], []
    for c in range(symbols):
        order += [down[c][0], risen[c][0][::-1]]
        up_lcp = risen[c][1][::-1]
        prefix += [down[c][1], np.concatenate(([0], up_lcp[:-1])) if len(up_lcp) else up_lcp]
    order = np.concatenate(order) if order else np.zeros(0, np.int64)
    prefix = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
    if n:  # seams: the first of each bucket's falling and rising part
        sizes = np.cumsum([0] + [len(x) for c in range(symbols) for x in (down[c][0], risen[c][0])])[:-1]
        seams = np.unique(sizes[(sizes > 0) & (sizes < n)])
        prefix[seams] = common(keys, n, order[seams - 1], order[seams], depth)
        prefix[0] = 0
    return order, prefix


def judge(window: int, budget: int):
    def decide(contents: list[bytes], copies: np.ndarray, at: pd.DataFrame) -> list[list[tuple[int, int]]]:
        text = np.frombuffer(b"".join(c + b"\xff" for c in contents), dtype=np.uint8).astype(np.int16) + 1
        size = np.fromiter(map(len, contents), np.int64, len(contents))
        begin = np.cumsum(size + 1) - size - 1
        text[begin + size] = 0
        order, prefix = induced_order(text, window, budget)
        group = np.cumsum(prefix < window)
        passage = np.repeat(np.arange(len(contents), dtype=np.int32), size + 1)
        offset = np.arange(len(text), dtype=np.int32) - begin.astype(np.int32)[passage]
        whole = (offset + window <= size[passage])[order]
        order, group = order[whole], group[whole]
        # When each window first occurs: by document, row and start.
        row = at.groupby(["doc_id", "rid"]).ngroup().to_numpy(np.int64)
        when = (row[passage] << 31) + at["start"].to_numpy(np.int64)[passage] + offset
        new = np.flatnonzero(np.diff(group, prepend=-1))
        earliest = np.repeat(np.minimum.reduceat(when[order], new), np.diff(np.append(new, len(order)))) if len(order) else when[order]
        later = np.zeros(len(text) + 1, dtype=np.int8)
        later[order[when[order] > earliest]] = 1
        edge = np.diff(later, prepend=0)
        spans: list[list[tuple[int, int]]] = [[] for _ in contents]
        for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True):
            p = int(passage[a])
            spans[p].append((a - int(begin[p]), b - int(begin[p])))
        return spans

    return decide


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, budget: int = QUEUE_BYTES, **limits: int) -> DataFrame:
    """One row per document: bytes, bytes removed, maximal removed runs, and the hash of the bytes that stay."""
    rows = with_rows(docs.select("doc_id", "text"))
    slim = rows.select("rid", F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    repeats = repeated_windows(slim, Unit(False, window, gram), judge(window, budget), True, **limits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            out = []
            for doc_id, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans")), strict=True):
                raw = text.as_py().encode()
                kept, removed, n = raw, 0, 0
                if spans.is_valid:
                    gone = covered(spans.as_py(), len(raw), window)
                    removed, n = int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
                    kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
                out.append((doc_id.as_py(), len(raw), removed, n, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate([pa.int64()] * 4 + [pa.string()])], names=[c.split()[0] for c in RESULT.split(", ")])

    return slim.join(repeats, "rid", "left").select("doc_id", "text", "spans").mapInArrow(run, RESULT)


def op9_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
