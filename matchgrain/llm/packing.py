"""Best-fit packing of token pieces into fixed-length sequences.

The length histogram (at most ``capacity`` rows, whatever the input) goes to the driver, which solves the configuration
linear program on it: multiplicative weights price the lengths, a knapsack dynamic program finds the best configuration at
these prices. The fractional multiplicities are rounded to whole ones while the pieces last, and the program is solved
again for what is left, until a rounding places little.
Pieces then get their places on Spark: a rank within their length picks the configuration copy and the slot.

Defined results: strings of special tokens in a text, such as ``<|endoftext|>``, are ordinary text, since a document must not
be able to end itself (``encode_special_tokens`` of tokenizers); a null or empty text is one piece that holds only the end token; every row of the input is packed, also
repeated ones; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import durable, text_slices

CAPACITY = 1024
END = 2
#: Ranks are dealt in groups of about this many pieces of one length.
GROUP_ROWS = 20_000
#: The share of the tokens that a solution may leave to the next one, which prices them afresh, and how fast a covered
#: length loses weight.
UNCOVERED, EPSILON = 0.5, 0.3
#: The program is solved again while a rounding places at least this share of the tokens left.
LEAST_PLACED = 0.1
#: First prices: a piece's share of a sequence to this power, so that long pieces find their fillings before these run short.
LONG_FIRST = 1.1
#: On what is left a piece's price is its share of a sequence to this power: a little dearer by length, so that short pieces,
#: which fill any gap, are spent last.
BIAS = 1.05

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Each text's ids with the end token, cut into pieces of ``capacity``; the first one takes the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder()
        for doc_id, texts in text_slices(batches, ["doc_id", "text"], tokens.SLICE_BYTES):
            ids, count = encode(texts)
            at = np.cumsum(count) - count
            rows: list[tuple[int, int, int, int, int]] = []
            for i, (a, n) in enumerate(zip(at.tolist(), count.tolist(), strict=True)):
                raw = np.append(ids[a : a + n], end).astype("<u4").tobytes()
                n += 1
                begin, piece = 0, 0
                size = n if n <= capacity else n % capacity or capacity
                while begin < n:
                    rows.append((i, piece, begin, size, zlib.crc32(raw[4 * begin : 4 * (begin + size)])))
                    begin, piece, size = begin + size, piece + 1, capacity
            cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            yield pa.RecordBatch.from_arrays(
                [doc_id.cast(pa.int64()).take(pa.array(cols[0])), pa.array(cols[1], pa.int64()).cast(pa.int32())] + [pa.array(c, pa.int64()) for c in cols[2:]],
                names=[c.split()[0] for c in PIECES.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def unbounded_configuration(lengths: np.ndarray, price: np.ndarray, capacity: int) -> np.ndarray:
    """The dearest configuration with any number of each length: a pass over the room used, all lengths at once."""
    by_length = np.zeros(capacity + 1)
    by_length[lengths] = price
    best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for w in range(1, capacity + 1):
        gain = best[:w] + by_length[w:0:-1]  # a piece of length w - j on top of the best for j
        j = int(gain.argmax())
        best[w], took[w] = (gain[j], w - j) if gain[j] > best[w - 1] else (best[w - 1], 0)
    out, w = np.zeros(capacity + 1, dtype=np.int64), capacity
    while w > 0:
        out[took[w]] += 1
        w -= max(1, int(took[w]))
    return out[lengths]


def best_configuration(lengths: np.ndarray, price: np.ndarray, limit: np.ndarray, capacity: int) -> np.ndarray:
    """Knapsack by dynamic programming: the dearest configuration within ``capacity``, with at most ``limit`` of each length."""
    free = unbounded_configuration(lengths, price, capacity)
    if (free <= limit).all():
        return free
    best, took = np.zeros(capacity + 1), []
    for i, (size, most) in enumerate(zip(lengths.tolist(), np.minimum(limit, capacity // lengths).tolist(), strict=True)):
        some = 1
        while most > 0:
            k = min(some, most)
            gain = best[: capacity + 1 - k * size] + k * price[i]
            better = gain > best[k * size :] + 1e-12
            best[k * size :] = np.where(better, gain, best[k * size :])
            took.append((i, k, k * size, better))
            most, some = most - k, 2 * some
    out, room = np.zeros(len(lengths), dtype=np.int64), capacity
    for i, k, size, better in reversed(took):
        if room >= size and better[room - size]:
            out[i] += k
            room -= size
    return out


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, uncovered: float = UNCOVERED, epsilon: float = EPSILON) -> dict[tuple, float]:
    """Multiplicative weights on the configuration program: configuration -> fractional multiplicity.

    Prices start near the pieces' share of a sequence, which is the dual solution wherever whole sequences can be filled; a
    length loses weight as it is covered, so that the next configurations turn to the others. Every configuration goes in as
    often as its scarcest length allows. It ends when all but ``uncovered`` of the tokens are covered; what is covered more
    than once is scaled down at rounding, where the pieces run out.
    """
    weight, cover = np.ones(len(lengths)), np.zeros(len(lengths))
    mass = lengths * counts
    x: dict[tuple, float] = {}
    while len(lengths) and float((mass * np.maximum(0, 1 - cover)).sum()) > uncovered * float(mass.sum()):
        c = best_configuration(lengths, (lengths / capacity) ** LONG_FIRST * weight, counts, capacity)
        used = np.flatnonzero(c)
        step = float((counts[used] / c[used]).min())
        key = tuple(c.tolist())
        x[key] = x.get(key, 0.0) + step
        cover += step * c / counts
        weight *= np.exp(-epsilon * step * c / counts)
        weight /= weight.max()
    return x


def plan(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int, bool]]:
    """Configurations (how many of each length) with whole multiplicities that use up exactly ``counts``.

    The program's full configurations are taken in order of their multiplicities, each as often as these say and the pieces
    left allow; then the program is solved again for what is left, until a rounding places little. The last
    flag says whether the program gave a configuration. Only what the last rounding cannot place is filled sequence by
    sequence: the longest piece left with the dearest filling for the rest.
    """
    left, out = counts.copy(), []

    def take(c: np.ndarray, k: int, program: bool) -> None:
        nonlocal left
        out.append((c, k, program))
        left = left - k * c

    placed = True
    while placed and left.any():
        before, have = int(left @ lengths), np.flatnonzero(left)
        for key, v in sorted(solve(lengths[have], left[have], capacity).items(), key=lambda kv: (-kv[1], kv[0])):
            c = np.zeros_like(left)
            c[have] = key
            k = min(int(np.ceil(v)), int((left[c > 0] // c[c > 0]).min()))
            if k and c @ lengths == capacity:
                take(c, k, True)
        placed = before - int(left @ lengths) >= LEAST_PLACED * before
    while left.any():
        c = np.zeros_like(left)
        longest = int(np.flatnonzero(left)[-1])
        c[longest] = 1
        room = capacity - int(lengths[longest])
        here = (left > c) & (lengths <= room)
        if here.any():
            c[here] += best_configuration(lengths[here], (lengths[here] / capacity) ** BIAS, (left - c)[here], room)
        take(c, int((left[c > 0] // c[c > 0]).min()), False)
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (key columns ``doc_id``, ``piece``, and ``length`` up to ``capacity``) with ``sequence_id`` and ``offset``."""
    spark = pieces.sparkSession
    pieces = durable(pieces)
    histogram = pieces.groupBy("length").count().orderBy("length").collect()  # at most ``capacity`` rows
    lengths = np.array([r["length"] for r in histogram], dtype=np.int64)
    counts = np.array([r["count"] for r in histogram], dtype=np.int64)
    rows, base, rank = [], 0, np.zeros(len(lengths), dtype=np.int64)
    for c, k, _ in plan(lengths, counts, capacity):
        at = 0
        for i in np.flatnonzero(c):
            m = int(c[i])
            rows.append((int(lengths[i]), int(rank[i]), int(rank[i]) + k * m, m, base, at))
            rank[i] += k * m
            at += m * int(lengths[i])
        base += k
    # Rows: configurations times lengths in each; both are bounded by the capacity, not by the input.
    places = spark.createDataFrame(rows, "length long, first long, until long, each long, base long, at long")
    groups = spark.createDataFrame([(int(n), -(-int(c) // GROUP_ROWS)) for n, c in zip(lengths, counts, strict=True)], "length long, groups long")
    dealt = pieces.join(F.broadcast(groups), "length").withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece"), F.col("groups"))).drop("groups")
    before = (
        dealt.groupBy("length", "grp")
        .count()
        .withColumn("before", F.sum("count").over(Window.partitionBy("length").orderBy("grp")) - F.col("count"))
        .drop("count")
    )
    inside = F.row_number().over(Window.partitionBy("length", "grp").orderBy("doc_id", "piece", *[c for c in ("ids_crc32",) if c in pieces.columns]))
    ranked = dealt.withColumn("inside", inside).join(before, ["length", "grp"]).withColumn("rank", F.col("before") + F.col("inside") - 1)
    p, q = ranked.alias("p"), F.broadcast(places).alias("q")
    nth = F.col("p.rank") - F.col("q.first")
    return p.join(q, (F.col("p.length") == F.col("q.length")) & (F.col("p.rank") >= F.col("q.first")) & (F.col("p.rank") < F.col("q.until"))).select(
        *[F.col(f"p.{c}") for c in pieces.columns],
        (F.col("q.base") + F.floor(nth / F.col("q.each"))).cast("long").alias("sequence_id"),
        (F.col("q.at") + F.pmod(nth, F.col("q.each")) * F.col("p.length")).cast("long").alias("offset"),
    )


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack(token_pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
