"""Passages that may repeat: windows are brought together by their smallest gram.

Every window of L symbols (words or bytes) is named by the smallest hash among its grams of k symbols, so equal windows have
equal names. Runs of neighbouring windows with one name form a passage; names that occur once cannot repeat and drop out
before any text is moved. The passages left are dealt to shards by name and collapsed there by content; a shard's own index
then decides, on the symbols themselves, which windows repeat. A name with very many runs is dealt out further: window by
window, by its fingerprint, equal windows brought down to one with their number before they are moved.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BASE, _BYTE, Words, durable, mix, partitions, powers, remove, short, stored, text_slices

#: Runs of one name beyond which its windows are dealt out one by one.
HOT_RUNS = 20_000
#: Bytes of passages for each shard, about.
SHARD_BYTES = 6 << 20
#: Bytes of distinct passages judged at once, about; one name's passages stay together.
JUDGED_BYTES = 3 << 20


class Unit(NamedTuple):
    """What counts as a symbol, and the lengths of windows and grams in symbols."""

    words: bool
    window: int
    gram: int

    @property
    def grams(self) -> int:
        return self.window - self.gram + 1


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of ``width`` neighbours from each place on; the last ``width - 1`` places hold the minimum of fewer."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[: len(out) - step] = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def byte_grams(buf: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on (k a power of two), by doubling."""
    h, have, base = _BYTE[buf], 1, 0xD1342543DE82EF95
    while have < k:
        nxt = h * np.uint64(base)
        nxt[: len(h) - have] += h[have:]
        h, have, base = nxt, 2 * have, base * base % (1 << 64)
    return mix(h)


def window_names(unit: Unit, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every whole window: index of its text, its start in symbols, its name and where its first gram is in ``grams``."""
    if unit.words:
        w = Words(texts)
        at = np.flatnonzero(w.whole(unit.window))
        grams = w.grams(unit.gram)
        return w.doc[at], at - w.first[w.doc[at]], sliding_min(grams, unit.grams)[at], at, grams
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(len(texts)), size)
    place = np.arange(len(buf)) - begin[doc]
    at = np.flatnonzero(place + unit.window <= size[doc])
    grams = byte_grams(buf, unit.gram) if len(at) else np.zeros(0, np.uint64)
    return doc[at], place[at], sliding_min(grams, unit.grams)[at], at, grams


def runs(rows: DataFrame, unit: Unit) -> DataFrame:
    """``name, rid, start, n, again``: n neighbouring windows of one name, from window ``start`` of row ``rid`` on.

    ``again``: the gram that gives the name occurs more than once in the run, so that it may repeat in itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, texts in text_slices(batches, ["rid", "text"]):
            doc, start, name, at, grams = window_names(unit, texts)
            if not len(doc):
                continue
            new = np.ones(len(doc), dtype=bool)
            new[1:] = (doc[1:] != doc[:-1]) | (name[1:] != name[:-1])
            first = np.flatnonzero(new)
            n = np.diff(np.append(first, len(doc)))
            again = np.zeros(len(first), dtype=bool)
            near = np.arange(unit.grams)
            for a in range(0, len(first), 50_000):
                f = first[a : a + 50_000]
                z = f + n[a : a + 50_000] - 1
                leftmost = at[f] + (grams[at[f][:, None] + near] == name[f][:, None]).argmax(axis=1)
                rightmost = at[z] + unit.grams - 1 - (grams[at[z][:, None] + near[::-1]] == name[f][:, None]).argmax(axis=1)
                again[a : a + 50_000] = leftmost != rightmost
            yield pa.RecordBatch.from_arrays(
                [pa.array(name[first].view(np.int64)), rid.take(pa.array(doc[first])), pa.array(start[first].astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(again)],
                names=["name", "rid", "start", "n", "again"],
            )

    return rows.select("rid", "text").mapInArrow(run, "name long, rid long, start int, n int, again boolean")


PASSAGES = "name long, sid long, doc_id long, rid long, start int, n int, again boolean, hot boolean, content binary"


def prints(raw: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64 bits of each span of bytes; with the 64 bits of the name they identify a passage."""
    value = _BYTE[np.frombuffer(raw, dtype=np.uint8)]
    value *= powers(len(value))[: len(value)]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    back = powers(len(value), np.uint64(pow(int(_BASE), -1, 1 << 64)))  # so that the place of a span does not matter
    return mix((total[b] - total[a]) * back[np.minimum(a, len(back) - 1)] + mix((b - a).astype(np.uint64))).view(np.int64)


def passages(rows: DataFrame, wanted: DataFrame, unit: Unit) -> DataFrame:
    """The passages of ``wanted`` (``rid``, ``runs`` of start, n, name, hot) with their symbols.

    Long runs, those of periodic text, are cut: their pieces have one name and so meet again. A hot run gives one row a
    window.
    """

    names = [c.split()[0] for c in PASSAGES.split(", ")]

    def symbols(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
        """All texts as one, words by single spaces; where each symbol begins, and the first symbol of each text."""
        if not unit.words:
            size = np.fromiter(map(len, texts), np.int64, len(texts))
            return b"".join(texts), np.arange(int(size.sum()) + 1), np.cumsum(size) - size
        words = [t.split() for t in texts]
        flat = [w for ws in words for w in ws]
        size = np.fromiter(map(len, words), np.int64, len(words))
        return b" ".join(flat), np.concatenate(([0], np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1))), np.cumsum(size) - size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 500):
            raw, begin, first = symbols([t.encode() for t in batch.column("text").to_pylist()])
            lists = batch.column("runs")
            row, run = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
            start, n, name, hot, again = (run.field(f).to_numpy(zero_copy_only=False) for f in ("start", "n", "name", "hot", "again"))
            step = np.where(hot, 1, unit.grams)
            pieces = -(-n // step)
            of = np.repeat(np.arange(len(n)), pieces)
            offset = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * step[of]
            at, size = start[of] + offset, np.minimum(step[of], n[of] - offset)
            a = begin[first[row[of]] + at]
            b = begin[first[row[of]] + at + size + unit.window - 1] - unit.words  # no space after the last word
            sid = prints(raw, a, b)
            content = pa.array([raw[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)], pa.binary())
            rows = pa.array(row[of])
            cols = [pa.array(name[of]), pa.array(sid), batch.column("doc_id").take(rows), batch.column("rid").take(rows), pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(again[of]), pa.array(hot[of]), content]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return rows.join(wanted, "rid").select("rid", "doc_id", "runs", "text").mapInArrow(run, PASSAGES)


#: For a shard's distinct passages (symbols, copies, first place) the windows that repeat, as offsets (from, to) of window starts.
Judge = Callable[[list[bytes], np.ndarray, pd.DataFrame], list[list[tuple[int, int]]]]


def repeated_windows(rows: DataFrame, unit: Unit, judge: Judge, first_stays: bool, hot_runs: int = HOT_RUNS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``rid, spans``: the spans of window starts in each row of ``rows`` (rid, doc_id, text) that repeat.

    With ``first_stays`` the earliest occurrence (by doc_id, rid, start) does not count as a repeat.
    """
    spark = rows.sparkSession
    found, runs_path = stored(runs(rows, unit))
    names = found.groupBy("name").agg(F.count("*").alias("c"), F.max("again").alias("again"))
    shared = names.where((F.col("c") > 1) | F.col("again")).select("name", (F.col("c") > hot_runs).alias("hot"), F.col("again").alias("any_again"))
    wanted = found.drop("again").join(shared.withColumnRenamed("any_again", "again"), "name").groupBy("rid").agg(F.collect_list(F.struct("start", "n", "name", "hot", "again")).alias("runs"))
    parts, parts_path = stored(passages(rows, wanted, unit))
    remove(spark, runs_path)
    spark.sparkContext._jvm.System.gc()  # lets Spark's cleaner drop the shuffle files of the phase that is over
    total = parts.where("not hot").agg(F.sum(F.length("content"))).first()[0] or 0
    shards = max(partitions(spark), -(-total // shard_bytes))
    span = "array<struct<a:int,b:int>>"
    result = f"name long, sid long, at_rid long, at_start int, spans {span}"

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a shard, whose size the number of shards bounds
        if not held:
            return
        rows = pa.Table.from_batches(held)
        col = {c: rows.column(c).to_numpy() for c in ("name", "sid", "rid", "start", "copies")}
        # Nulls before all ids.
        doc = np.array([-(1 << 63) if d is None else d for d in rows.column("doc_id").to_pylist()], dtype=np.int64)
        order = np.lexsort((col["start"], col["rid"], doc, col["sid"], col["name"]))
        name, sid = col["name"][order], col["sid"][order]
        first = np.flatnonzero(np.append(True, (name[1:] != name[:-1]) | (sid[1:] != sid[:-1])))
        copies, take = np.add.reduceat(col["copies"][order], first), order[first]
        at = pd.DataFrame({"doc_id": doc[take], "rid": col["rid"][take], "start": col["start"][take]})
        # Names have nothing in common, so a shard is judged a few names at a time: memory is bounded however names are dealt.
        content = rows.column("content").take(pa.array(take))
        size = np.cumsum(pc.binary_length(content).to_numpy())
        lead = np.flatnonzero(np.append(True, name[first][1:] != name[first][:-1]))
        part = (size[lead] - 1) // JUDGED_BYTES
        cut = np.append(lead[np.append(True, part[1:] != part[:-1])], len(take)).tolist()
        spans: list[list[tuple[int, int]]] = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            spans += judge(content.slice(a, b - a).to_pylist(), copies[a:b], at.iloc[a:b].reset_index(drop=True))
        keep = [i for i, s in enumerate(spans) if s or (first_stays and copies[i] > 1)]
        kept = take[keep]
        listed = pa.array([[{"a": a, "b": b} for a, b in spans[i]] for i in keep], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
        yield pa.RecordBatch.from_arrays([pa.array(col[c][kept]) for c in ("name", "sid", "rid", "start")] + [listed], names=["name", "sid", "at_rid", "at_start", "spans"])

    # Passages of one name meet in one partition, which is a shard: their symbols are shuffled once.
    own = ["name", "sid", "doc_id", "rid", "start", "content"]
    plain = parts.where("not hot").select(*own, F.lit(1).cast("long").alias("copies"), F.col("name").alias("shard"))
    hot = parts.where("hot").groupBy("name", "sid").agg(F.count("*").alias("copies"), F.min(F.struct(*own[2:])).alias("at"))
    hot = hot.select("name", "sid", *[f"at.{c}" for c in own[2:]], "copies", F.col("sid").alias("shard"))
    decided = plain.unionByName(hot).repartition(shards, "shard").mapInArrow(decide, result)
    is_first = (F.col("rid") == F.col("at_rid")) & (F.col("start") == F.col("at_start"))
    everything = F.array(F.struct(F.lit(0).alias("a"), F.col("n").alias("b")))
    spans = F.when(~is_first, everything).otherwise(F.col("spans")) if first_stays else F.col("spans")
    marked = (
        parts.drop("content", "doc_id", "again", "hot")
        .join(decided, ["name", "sid"])
        .select("rid", F.transform(spans, lambda s: F.struct((s.a + F.col("start")).alias("a"), (s.b + F.col("start")).alias("b"))).alias("spans"))
        .where(F.size("spans") > 0)
    )
    out = durable(marked.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans")))
    remove(spark, parts_path)
    spark.sparkContext._jvm.System.gc()
    return out


def covered(spans: list[dict] | None, symbols: int, window: int) -> np.ndarray:
    """Which symbols the windows that start in ``spans`` cover."""
    edge = np.zeros(symbols + 1, dtype=np.int64)
    for s in spans or ():
        edge[s["a"]] += 1
        edge[s["b"] + window - 1] -= 1
    return np.cumsum(edge)[:-1] > 0
