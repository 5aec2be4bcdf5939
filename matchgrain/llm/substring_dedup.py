"""Substring dedup with a compressed FM-index per shard.

Documents' passages that may repeat (see ``anchors``) are indexed shard by shard: a suffix order of their words, its
Burrows-Wheeler transform in a wavelet matrix of packed bits with rank counts. The passages then stream through the index:
backward search extends matches word by word to the left, and where a match dies every window around that place is done with.

Defined results: null and empty texts have no words; overlapping windows and windows of one document count; a row's own
occurrence does not; rows with the same id stay apart; texts shorter than a window never change; other columns do not matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Unit, covered, repeated_windows
from .common import fixed, free_name, short

WINDOW, GRAM = 35, 8


class Wavelet:
    """A wavelet matrix over whole numbers below ``2 ** levels``: packed bits, and the ones before each 64 of them."""

    def __init__(self, values: np.ndarray, levels: int):
        self.bits, self.ones, self.zeros = [], [], []
        for level in range(levels - 1, -1, -1):
            bit = (values >> level) & 1
            packed = np.packbits(bit.astype(np.uint8), bitorder="little")
            packed = np.concatenate((packed, np.zeros(8 - len(packed) % 8 + 8, np.uint8))).view("<u8")
            self.bits.append(packed)
            self.ones.append(np.concatenate(([0], np.cumsum(np.bitwise_count(packed))[:-1])).astype(np.int64))
            self.zeros.append(int(len(bit) - bit.sum()))
            values = np.concatenate((values[bit == 0], values[bit == 1]))
        self.levels = levels

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Where ``place`` goes when all values are sorted by symbol: the symbol's occurrences before it follow by subtraction."""
        for j in range(self.levels):
            word, rest = place >> 6, (place & 63).astype(np.uint64)
            one = self.ones[j][word] + np.bitwise_count(self.bits[j][word] & ((np.uint64(1) << rest) - np.uint64(1)))
            place = np.where((symbol >> (self.levels - 1 - j)) & 1, self.zeros[j] + one, place - one)
        return place


class FMIndex:
    """Backward search over texts of whole numbers >= 1; ``order`` symbols decide the suffix order, so patterns may be as long."""

    def __init__(self, text: np.ndarray, order: int):
        n = len(text)
        rank, have = text.astype(np.int64), 1
        while True:
            nxt = np.zeros(n, dtype=np.int64)
            nxt[: n - have] = rank[have:] + 1
            key = rank * (nxt.max() + 1 if n else 1) + nxt
            suffixes = np.argsort(key, kind="stable")
            key = key[suffixes]
            new = np.concatenate(([0], np.cumsum(key[1:] != key[:-1])))
            rank = np.empty(n, dtype=np.int64)
            rank[suffixes] = new
            have *= 2
            if have >= order or (n and new[-1] == n - 1):
                break
        before = text[suffixes - 1]
        self.tree = Wavelet(before, max(1, int(text.max()).bit_length()))
        count = np.bincount(text)
        self.first = np.cumsum(count) - count  # suffixes that begin with a smaller symbol
        self.origin = self.tree.rank(np.arange(len(count)), np.zeros(len(count), dtype=np.int64))
        self.size = n

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of symbol + pattern from those of the patterns."""
        base = self.first[symbol] - self.origin[symbol]
        both = self.tree.rank(np.concatenate((symbol, symbol)), np.concatenate((low, high)))
        return base + both[: len(low)], base + both[len(low) :]


def match(index: FMIndex, text: np.ndarray, begin: np.ndarray, size: np.ndarray, window: int) -> list[list[tuple[int, int]]]:
    """For each indexed passage, its windows that occur elsewhere too, as spans of starts. All passages advance together."""
    n = len(begin)
    hit: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    left = np.zeros(n, dtype=np.int64)  # first window not decided
    last = size - window  # last window not decided
    # First from the right end, as far as the match goes; then from the left, window by window.
    whole = np.ones(n, dtype=bool)
    place, low, high = size - 1, np.zeros(n, dtype=np.int64), np.full(n, index.size, dtype=np.int64)
    active = np.flatnonzero(last >= left)
    while len(active):
        low[active], high[active] = index.extend(text[begin[active] + place[active]], low[active], high[active])
        dead = high[active] - low[active] < 2
        done = ~dead & (place[active] == left[active])
        for i in active[(dead | done) & whole[active]].tolist():
            q = int(place[i]) if high[i] - low[i] < 2 else -1
            if q < last[i]:
                hit[i].append((q + 1, int(last[i]) + 1))
            last[i] = min(q, int(last[i]) - 1) if q < last[i] else last[i]
        one = ~whole[active]
        for i in active[done & one].tolist():
            hit[i].append((int(left[i]), int(left[i]) + 1))
        left[active[done & one]] += 1
        left[active[dead & one]] = place[active[dead & one]] + 1
        again = active[dead | done]
        whole[again] = False
        place[active] -= 1
        place[again] = left[again] + window - 1
        low[again], high[again] = 0, index.size
        active = active[left[active] <= last[active]]
    return hit


def judge(window: int):
    def decide(contents: list[bytes], copies: np.ndarray, _: pd.DataFrame) -> list[list[tuple[int, int]]]:
        words = [c.split(b" ") for c in contents]
        size = np.fromiter(map(len, words), np.int64, len(words))
        number: dict[bytes, int] = {}
        flat = np.fromiter((number.setdefault(w, len(number) + 1) for ws in words for w in (*ws, b"")), np.int64, int(size.sum()) + len(words))
        begin = np.cumsum(size + 1) - size - 1
        index = FMIndex(flat, window)
        alone = np.flatnonzero(copies == 1)
        spans: list[list[tuple[int, int]]] = [[(0, int(s) - window + 1)] for s in size]
        for i, s in zip(alone.tolist(), match(index, flat, begin[alone], size[alone], window), strict=True):
            spans[i] = s
        return spans

    return decide


RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def with_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a number for each row, the same in every job. Who numbers rows twice does so on one ``fixed`` table."""
    return fixed(docs).withColumn("rid", F.monotonically_increasing_id())


def marked_documents(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **limits: int) -> DataFrame:
    """``docs`` and, as the last column, the spans of its windows (starts, in words) that occur anywhere else."""
    docs, rid, spans = fixed(docs), free_name(docs.columns, "rid"), free_name(docs.columns, "spans")
    slim = with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))).select("rid", "doc_id", "text")
    found = repeated_windows(slim, Unit(True, window, gram), judge(window), False, **limits).select(F.col("rid").alias(rid), F.col("spans").alias(spans))
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(found, rid, "left").select(*docs.columns, spans)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, **limits: int) -> DataFrame:
    """One row per document: words, words removed, and the hash of the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            out = []
            for doc_id, text, spans in zip(*(batch.column(c) for c in ("doc_id", "text", "spans")), strict=True):
                words = (text.as_py() or "").encode().split()
                gone = covered(spans.as_py(), len(words), window) if spans.is_valid else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                out.append((doc_id.as_py(), len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=[c.split()[0] for c in RESULT.split(", ")])

    return marked_documents(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), window, gram, **limits).mapInArrow(run, RESULT)


def without_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``docs`` with the repeated words cut out of ``text`` and ``n_chars`` counted anew (pipeline stage)."""
    names = docs.columns

    def cut(text: str, spans: list[dict]) -> str:
        raw = text.encode()
        at = [m.span() for m in _WORD.finditer(raw)]
        gone = covered(spans, len(at), window)
        out, begin = [], 0
        for (a, b), g in zip(at, gone.tolist(), strict=True):
            if g:  # the word goes with the white space before it
                out.append(raw[begin:a].rstrip() if begin < a else b"")
                begin = b
        out.append(raw[begin:])
        return b"".join(out).decode().strip()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches):
            texts = [cut(t.as_py(), s.as_py()) if s.is_valid and t.is_valid else t.as_py() for t, s in zip(batch.column("text"), batch.columns[-1], strict=True)]
            cols = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in cols:
                cols["n_chars"] = pa.array([None if t is None else len(t) for t in texts], cols["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return marked_documents(docs, window, gram).mapInArrow(run, docs.schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
