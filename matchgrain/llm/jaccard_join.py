"""N-gram Jaccard join by prefix lists, with set-relation skipping.

A document is the set of its distinct word shingles. Shingles are ordered, very frequent ones last, and two sets can only be
similar enough if they share a shingle of their prefixes: the documents of each prefix shingle form an index list. Lists are
ordered by set size and skip, block by block, every pair whose sizes or positions rule it out. Links are found in two rounds:

* each list's smallest set meets all others (and near neighbours meet each other); copies of one set count as one;
* pairs that are left in long lists are first judged by these answers, whole blocks of a list at once where sizes and
  positions allow it. Sets already in one component need no link, and where both distances to a common set are known, the
  triangle inequality of the Jaccard distance decides most others. Of what stays open, the pairs that could join components
  are compared first: the answers of a set then hold for all that are linked with it, and only pairs between components
  that are left are compared after them.

Before texts are moved, a pair's sketches (how many shingles fall into each of some hash buckets) bound its intersection
from above; pairs whose bound is too low are not similar, and their bound serves the second round as a distance bound.

Defined results: texts of fewer words than a shingle are one shingle; a null text or one without words is empty, linked
with nothing, and its own component; equal sets are linked; a component's id is its smallest doc_id (null ids count only
where there is no other); repeated rows are documents of their own; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Words, durable, fixed, free_name, mix, partitions, remove, stored, text_slices
from .components import components
from .substring_dedup import with_rows

SHINGLE = 5
#: Two sets link when 100 * intersection >= THRESHOLD * union.
THRESHOLD = 75
#: A shingle in more than this share of the documents comes last in the order; the number of such shingles is bounded.
FREQUENT_SHARE, FREQUENT_LEAST, FREQUENT_MOST = 1 / 2000, 50, 200_000
#: Prefix entries for each index task, about.
TASK_ENTRIES = 1_500_000
#: Neighbours in a list that meet in the first round; lists up to one more are then complete.
NEAR = 4
#: Entries of a list that are skipped together by their largest size and earliest position.
SKIP_BLOCK = 64
#: Pairs of a list that a task looks at together.
PAIRS_AT_ONCE = 1 << 16
#: Row ids that are broadcast to pick texts (16 MB); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Entries of one lead's lists for each task of the second round, about.
LEAD_ENTRIES = 16_384
#: Documents of one list for each task of the second round, and partners of one document for each comparing task.
LIST_BLOCK, PARTNERS = 4096, 2000


def shingles(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text: (index of the text, hash), in order of both."""
    w = Words(texts, lower=True)
    ok = w.whole(k)
    doc, h = w.doc[ok], w.grams(k)[ok]
    for short in range(1, k):
        few = np.flatnonzero(w.count == short)
        if len(few):
            doc = np.concatenate((doc, few))
            h = np.concatenate((h, mix(w.grams(short)[w.first[few]] ^ np.uint64(short))))
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), dtype=bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[new], h[new]


def prefix_size(n: np.ndarray, threshold: int) -> np.ndarray:
    return n - -(-threshold * n // 100) + 1


def similar(n1: np.ndarray, n2: np.ndarray, common: np.ndarray, threshold: int) -> np.ndarray:
    return 100 * common >= threshold * (n1 + n2 - common)


def sketches(doc: np.ndarray, h: np.ndarray, n: np.ndarray) -> list[bytes | None]:
    """Of each set the numbers of hashes in equal ranges, two to four a range on average; none if one exceeds a byte."""
    bits = np.ceil(np.log2(np.maximum(n, 16) / 4)).astype(np.int64)
    to = np.cumsum(1 << bits)
    place = (to - (1 << bits))[doc] + (h >> (64 - bits[doc]).astype(np.uint64)).astype(np.int64)
    counts = np.bincount(place, minlength=int(to[-1]) if len(to) else 0)
    parts = np.split(counts, to[:-1]) if len(to) else []
    return [p.astype(np.uint8).tobytes() if p.max() < 256 else None for p in parts]


def most_common(sketch: list[bytes | None], n: np.ndarray):
    """``bound(x, y)``: no more hashes than this can each set of ``x`` have in common with that of ``y``, by their sketches.

    Sketches of one width stand in one matrix; where widths differ, the finer one is summed to the coarser.
    """
    width = np.fromiter((0 if x is None else len(x) for x in sketch), np.int64, len(sketch))
    by: dict[int, np.ndarray] = {}
    row = np.zeros(len(sketch), dtype=np.int64)
    for w in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == w)
        row[at] = np.arange(len(at))
        by[w] = np.frombuffer(b"".join(sketch[i] for i in at.tolist()), np.uint8).reshape(-1, w)

    def bound(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        out = np.minimum(n[x], n[y])
        coarse, fine = np.where(width[x] <= width[y], x, y), np.where(width[x] <= width[y], y, x)
        kinds = width[coarse] << 32 | width[fine]
        for kind in np.unique(kinds[width[coarse] > 0]).tolist():
            a, b = kind >> 32, kind & 0xFFFFFFFF
            at = np.flatnonzero(kinds == kind)
            for part in np.array_split(at, -(-len(at) * b // (4 << 20))):
                other = by[b][row[fine[part]]]
                if b > a:
                    other = other.reshape(len(part), a, b // a).sum(axis=2, dtype=np.int32)
                out[part] = np.minimum(by[a][row[coarse[part]]], other).sum(axis=1, dtype=np.int64)
        return out

    return bound


def fits(n1, p1, n2, p2, threshold: int) -> np.ndarray:
    """Whether sets of these sizes whose first common shingle is at these positions can still be similar enough."""
    return similar(n1, n2, 1 + np.minimum(n1 - p1 - 1, n2 - p2 - 1), threshold)


def documents(rows: DataFrame) -> DataFrame:
    """``rid, n, fp_a, fp_b, sketch`` of each row, and among them, as rows with ``h`` and ``c``, shingles frequent in a part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["rid", "n", "fp_a", "fp_b", "h", "c", "sketch"]
        seen: list[np.ndarray] = []
        size, docs = 0, 0

        def frequent() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(seen), return_counts=True)
            often = c >= max(3, FREQUENT_SHARE * docs)
            n = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64())] * 4 + [pa.array(h[often].view(np.int64)), pa.array(c[often]), pa.nulls(n, pa.binary())], names=names)

        for rid, texts in text_slices(batches, ["rid", "text"]):
            doc, h = shingles(texts)
            n = np.bincount(doc, minlength=len(texts))
            a, b = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
            if len(doc):
                first = np.flatnonzero(np.diff(doc, prepend=-1))
                a[doc[first]] = np.add.reduceat(mix(h), first)
                b[doc[first]] = np.bitwise_xor.reduceat(mix(h ^ np.uint64(0x5DEECE66D)), first)
            yield pa.RecordBatch.from_arrays([rid, pa.array(n, pa.int64()), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), *[pa.nulls(len(n), pa.int64())] * 2, pa.array(sketches(doc, h, n), pa.binary())], names=names)
            seen.append(h)
            size, docs = size + len(h), docs + len(texts)
            if size > 4_000_000:
                yield frequent()
                seen, size, docs = [], 0, 0
        if seen:
            yield frequent()

    return rows.select("rid", "text").mapInArrow(run, "rid long, n long, fp_a long, fp_b long, h long, c long, sketch binary")


def prefix_blocks(rows: DataFrame, frequent: np.ndarray, tasks: int, threshold: int) -> DataFrame:
    """Prefix entries, gathered by the task of their shingle: ``task, docs`` (rid, n, print, entries), ``hashes``, ``places``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, texts in text_slices(batches, ["rid", "text"], 2 << 20):
            doc, h = shingles(texts)
            if not len(doc):
                continue
            n = np.bincount(doc, minlength=len(texts))
            fp = np.zeros(len(texts), np.uint64)
            first = np.flatnonzero(np.diff(doc, prepend=-1))
            fp[doc[first]] = np.add.reduceat(mix(h), first)
            if len(frequent):
                late = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
                order = np.argsort(doc * 2 + late, kind="stable")
                doc, h = doc[order], h[order]
            place = np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
            keep = place < prefix_size(n, threshold)[doc]
            # Of equal sets in a slice one speaks for all.
            _, one = np.unique(np.stack((fp, n.astype(np.uint64))), axis=1, return_index=True)
            alone = np.zeros(len(texts), dtype=bool)
            alone[one] = True
            keep &= alone[doc]
            doc, h, place = doc[keep], h[keep], place[keep]
            task = (mix(h) % np.uint64(tasks)).astype(np.int64)
            order = np.argsort(task, kind="stable")
            cut = np.flatnonzero(np.diff(task[order], prepend=-1))
            rids = rid.to_numpy()
            out = []
            for part in np.split(order, cut[1:]):
                d, count = np.unique(doc[part], return_counts=True)
                part = part[np.argsort(doc[part], kind="stable")]
                table = np.stack((rids[d], n[d], fp[d].view(np.int64), count))
                out.append((int(task[part[0]]), table.tobytes(), h[part].tobytes(), place[part].astype(np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["task", "docs", "hashes", "places"])

    return rows.select("rid", "text").mapInArrow(run, "task int, docs binary, hashes binary, places binary")


LISTS = "a long, b long, h long, rid long, n long, place int"


def index_lists(blocks: DataFrame, tasks: int, threshold: int) -> DataFrame:
    """First-round pairs (``a, b``) of every list, and the entries (``h, rid, n, place``) of lists that need a second round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, types = [c.split()[0] for c in LISTS.split(", ")], [pa.int64()] * 5 + [pa.int32()]
        docs, hashes, places, counts = [], [], [], []
        for batch in batches:
            for d, h, p in zip(batch.column("docs"), batch.column("hashes"), batch.column("places"), strict=True):
                table = np.frombuffer(d.as_buffer(), dtype=np.int64).reshape(4, -1)
                docs.append(table[:3])
                counts.append(table[3])
                hashes.append(np.frombuffer(h.as_buffer(), dtype=np.uint64))
                places.append(np.frombuffer(p.as_buffer(), dtype=np.int32))
        if not docs:
            return
        rid, n, fp = (np.repeat(x, np.concatenate(counts)) for x in np.concatenate(docs, axis=1))
        h, place = np.concatenate(hashes), np.concatenate(places).astype(np.int64)
        order = np.lexsort((rid, fp, n, h))
        rid, n, fp, h, place = (x[order] for x in (rid, n, fp, h, place))
        same = np.zeros(len(h), dtype=bool)  # a copy of the set before it
        same[1:] = (h[1:] == h[:-1]) & (n[1:] == n[:-1]) & (fp[1:] == fp[:-1])
        rid, n, h, place = (x[~same] for x in (rid, n, h, place))
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.append(first, len(h)))
        begin = np.repeat(first, size)
        me = np.arange(len(h))
        pairs = []
        for step in range(1, NEAR + 1):
            x = me[: len(h) - step]
            pairs.append((x, x + step))
        star = me[me - begin > NEAR]
        pairs.append((begin[star], star))
        found = []
        for x, y in pairs:
            ok = h[x] == h[y]
            x, y = x[ok], y[ok]
            ok = fits(n[x], place[x], n[y], place[y], threshold)
            found.append(np.stack((np.minimum(rid[x[ok]], rid[y[ok]]), np.maximum(rid[x[ok]], rid[y[ok]]))))
        a, b = np.concatenate(found, axis=1)
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        a, b = a[new], b[new]
        none = lambda k, m: [pa.nulls(m, t) for t in types[k:]]
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none(2, len(a))], names=names)
        long = np.repeat(size > NEAR + 1, size)
        m = int(long.sum())
        yield pa.RecordBatch.from_arrays([*[pa.nulls(m, pa.int64())] * 2, pa.array(h[long].view(np.int64)), pa.array(rid[long]), pa.array(n[long]), pa.array(place[long].astype(np.int32))], names=names)

    return blocks.repartition(tasks, "task").mapInArrow(run, LISTS)


def spanning(x: np.ndarray, y: np.ndarray, common: np.ndarray, n: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which of the pairs (x, y), most similar first by what they may have in common, still join components ``c``."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = v = root[root[v]]
        return v

    take = []
    for i in np.lexsort((y, x, -common / (n[x] + n[y] - common))).tolist():
        a, b = find(int(c[x[i]])), find(int(c[y[i]]))
        if a != b:
            root[a] = b
            take.append(i)
    return np.array(take, dtype=np.int64)


def by_lead(entries: DataFrame, labels: DataFrame, dist: DataFrame, sketched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The lists that still hold several components, gathered by their first (smallest) set, the lead.

    ``lead, rid, n, low, high, sketch, lists``: a set once for all lists (``h``, ``place``) that it shares with one lead, with
    bounds of its distance to it; and ``lead, buckets, blocks``: into how many parts a lead's lists, and each of them, are dealt.
    """
    placed = entries.join(labels.withColumnRenamed("v", "rid"), "rid", "left").withColumn("c", F.coalesce("c", "rid"))
    mixed = placed.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct("n", "rid")).alias("lead"), F.count("*").alias("size")).where("lo <> hi").select("h", F.col("lead.rid").alias("lead"), "size")
    parts = mixed.groupBy("lead").agg(F.ceil(F.sum("size") / LEAD_ENTRIES).cast("int").alias("buckets"), F.ceil(F.max("size") / LIST_BLOCK).cast("int").alias("blocks"))
    sets = entries.join(mixed.drop("size"), "h").groupBy("lead", "rid").agg(F.first("n").alias("n"), F.collect_list(F.struct("h", "place")).alias("lists"))
    known = sets.withColumn("a", F.least("rid", "lead")).withColumn("b", F.greatest("rid", "lead")).join(dist, ["a", "b"], "left")
    itself = F.col("rid") == F.col("lead")
    low, high = F.when(itself, 0.0).otherwise(F.coalesce("low", F.lit(0.0))), F.when(itself, 0.0).otherwise(F.coalesce("high", F.lit(1.0)))
    return known.select("lead", "rid", "n", low.alias("low"), high.alias("high"), "lists").join(sketched.select("rid", "sketch"), "rid"), parts


def open_pairs(sets: DataFrame, parts: DataFrame, threshold: int, every: bool) -> DataFrame:
    """Pairs across components ``c`` in the lists of ``sets`` (see ``by_lead``) that may be similar enough by all that is known.

    Sorted by size, a list is cut into blocks that carry their largest size and the position of their earliest entry: for a
    set, whole blocks are skipped by these, and the pairs of the others are tested. A pair that several lists give is judged
    once: by the triangle inequality over the lead, then by its sketches. A long list is dealt out as pairs of its blocks, and
    a lead with very many entries by its lists.

    Without ``every``, only each set's most promising partner is looked at, and of these pairs only those that would join
    components that nothing joins yet: fewer than there are components.
    """
    far = 1 - threshold / 100
    dealt = sets.join(parts, "lead").withColumn("i", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    bucket = lambda x: F.pmod(F.xxhash64(x.h), F.col("buckets")).cast("int")
    dealt = dealt.withColumn("bucket", F.explode(F.array_distinct(F.transform("lists", bucket)))).withColumn("lists", F.filter("lists", lambda x: bucket(x) == F.col("bucket")))
    dealt = dealt.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    key = ["lead", "bucket", "x", "y"]
    dealt = dealt.select("lead", "bucket", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "rid", "n", "c", "low", "high", "sketch", "lists")

    def in_list(n: np.ndarray, place: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a list, which is sorted by size, that sizes and positions allow."""
        m = len(n)
        begin = np.arange(0, m, SKIP_BLOCK)
        largest, earliest = np.maximum.reduceat(n, begin), np.minimum.reduceat(place, begin)
        step = max(1, PAIRS_AT_ONCE // m)
        for k in range(0, m, step):
            me = np.arange(k, min(k + step, m))[:, None]
            # The most that a block allows: sets from its smallest size on, sharing from its earliest position to its largest size.
            share = 1 + np.minimum(n[me] - place[me] - 1, largest - earliest - 1)
            x, block = np.nonzero((begin + SKIP_BLOCK > me + 1) & similar(n[me], n[np.maximum(begin, me)], share, threshold))
            x, y = np.repeat(x + k, SKIP_BLOCK), (begin[block][:, None] + np.arange(SKIP_BLOCK)).ravel()
            x, y = (v[(y > x) & (y < m)] for v in (x, y))
            ok = fits(n[x], place[x], n[y], place[y], threshold)
            yield x[ok], y[ok]

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.take(pa.array(np.lexsort((rows.column("rid").to_numpy(), rows.column("n").to_numpy())))).combine_chunks()
        i, rid, n, c, low, high = (rows.column(k).to_numpy() for k in ("i", "rid", "n", "c", "low", "high"))
        m = len(rid)
        if (c == c[0]).all():
            return
        cross = rows.column("x")[0].as_py() != rows.column("y")[0].as_py()
        lists = rows.column("lists").combine_chunks()
        of, flat = pc.list_parent_indices(lists).to_numpy(), lists.flatten()
        h, place = flat.field("h").to_numpy(), flat.field("place").to_numpy().astype(np.int64)
        order = np.lexsort((of, h))
        of, h, place = of[order], h[order], place[order]
        bound = most_common(rows.column("sketch").to_pylist(), n)
        codes: list[np.ndarray] = []
        kept = [np.zeros((3, 0), dtype=np.int64)]

        def nearest(x: np.ndarray, y: np.ndarray, common: np.ndarray) -> np.ndarray:
            """Of these pairs, those that are the nearest of one of their sets."""
            order = np.lexsort((-y, -x, common / (n[x] + n[y] - common)))
            last = np.full(m, -1)
            for end in (x, y):
                last[end[order]] = np.maximum(last[end[order]], np.arange(len(order)))  # of a set's pairs the nearest comes last
            return order[np.unique(last[last >= 0])]

        def judge() -> None:
            """The pairs gathered so far, each once: what their sketches leave is kept."""
            code = np.unique(np.concatenate(codes)) if codes else np.zeros(0, np.int64)
            codes.clear()
            x, y = code // m, code % m
            common = bound(x, y)
            ok = similar(n[x], n[y], common, threshold)
            found = np.stack((x[ok], y[ok], common[ok]))
            kept.append(found if every else found[:, nearest(*found)])

        held = 0
        for members, at in zip(*(np.split(v, np.flatnonzero(np.diff(h)) + 1) for v in (of, place)), strict=True):
            for x, y in in_list(n[members], at):
                x, y = members[x], members[y]
                ok = (c[x] != c[y]) & (np.maximum(low[y] - high[x], low[x] - high[y]) <= far + 1e-9)
                if cross:
                    ok &= i[x] != i[y]
                codes.append(x[ok] * m + y[ok])
                held += len(codes[-1])
                if held > 4 * PAIRS_AT_ONCE:
                    judge()
                    held = 0
        judge()
        x, y, common = np.unique(np.concatenate(kept, axis=1), axis=1)
        if not every:
            take = nearest(x, y, common)
            take = take[spanning(x[take], y[take], common[take], n, c)]
            x, y = x[take], y[take]
        if len(x):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(rid[x], rid[y])), pa.array(np.maximum(rid[x], rid[y]))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(k).to_pylist() for k in key), strict=True))
            begin = 0
            for k in range(len(keys)):
                if keys[k] != now:
                    if k > begin:
                        held.append(batch.slice(begin, k - begin))
                    if held:
                        yield from pairs(pa.Table.from_batches(held))
                    held, now, begin = [], keys[k], k
            held.append(batch.slice(begin))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return dealt.repartition(partitions(sets.sparkSession), *key).sortWithinPartitions(*key).mapInArrow(run, "a long, b long").distinct()


def promising(pairs: DataFrame, sketched: DataFrame, threshold: int) -> DataFrame:
    """``a, b, low, open``: whether each pair may be similar enough by its sketches, and the least distance it can have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            n = np.concatenate((batch.column("na").to_numpy(), batch.column("nb").to_numpy()))
            bound = most_common([*batch.column("sa").to_pylist(), *batch.column("sb").to_pylist()], n)
            common = bound(np.arange(m), np.arange(m) + m)
            low = 1 - common / np.maximum(n[:m] + n[m:] - common, 1)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(low), pa.array(similar(n[:m], n[m:], common, threshold))], names=["a", "b", "low", "open"])

    one = sketched.select(F.col("rid").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sketched.select(F.col("rid").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a long, b long, low double, open boolean")


def compare(pairs: DataFrame, texts: DataFrame, threshold: int) -> DataFrame:
    """``a, b, common, na, nb, linked`` of each pair, from the texts (``rid``, ``text``)."""
    many = pairs.groupBy("a").agg(F.ceil(F.count("*") / PARTNERS).cast("int").alias("parts"))
    right = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    right = right.join(texts.withColumnRenamed("rid", "b"), "b").select("a", "part", "b", "text")
    left = texts.withColumnRenamed("rid", "a").join(many, "a").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, mine = None, np.zeros(0, np.uint64)
        for a, part, b, texts in text_slices(batches, ["a", "part", "b", "text"]):
            doc, h = shingles(texts)
            cut = np.searchsorted(doc, np.arange(len(texts) + 1))
            out = []
            for k, (x, p, y) in enumerate(zip(a.to_pylist(), part.to_pylist(), b.to_pylist(), strict=True)):
                own = h[cut[k] : cut[k + 1]]
                if y is None:
                    key, mine = (x, p), own.copy()
                    continue
                assert key == (x, p)
                common = int((mine[np.minimum(np.searchsorted(mine, own), len(mine) - 1)] == own).sum())
                out.append((x, y, common, len(mine), len(own)))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["a", "b", "common", "na", "nb"])

    tasks = partitions(pairs.sparkSession)
    met = left.unionByName(right).repartition(tasks, "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    compared = met.mapInArrow(run, "a long, b long, common long, na long, nb long")
    return compared.withColumn("linked", 100 * F.col("common") >= threshold * (F.col("na") + F.col("nb") - F.col("common")))


def jaccard_components(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` rows by ``rid`` with ``doc_id``, ``n_shingles`` and ``c``: the smallest row of their component."""
    spark = docs.sparkSession
    rows = with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    paths: list[str] = []

    def keep(df: DataFrame) -> DataFrame:
        """Cut the lineage; tables on disk also tell the planner how small they are."""
        table, path = stored(df)
        paths.append(path)
        return table

    known = keep(documents(rows))
    prints = known.where("rid is not null").select("rid", "n", "fp_a", "fp_b")
    sketched = known.where("n > 0").select("rid", "n", "sketch")
    total = prints.agg(F.count("*"), F.sum("n")).first()
    n_docs, n_shingles = int(total[0]), int(total[1] or 0)
    often = known.where("rid is null").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") > max(FREQUENT_LEAST, FREQUENT_SHARE * n_docs))
    frequent = np.sort(np.array([r["h"] for r in often.orderBy(F.desc("c"), "h").limit(FREQUENT_MOST).collect()], dtype=np.int64).view(np.uint64))
    tasks = max(partitions(spark), n_shingles * (100 - threshold) // 100 // TASK_ENTRIES + 1)
    lists = keep(index_lists(prefix_blocks(rows, frequent, tasks, threshold), tasks, threshold))
    entries = lists.where("h is not null").select("h", "rid", "n", "place")
    first = keep(promising(lists.where("a is not null").select("a", "b").distinct(), sketched, threshold))

    def compared(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("rid")).union(pairs.select("b")).distinct()
        some = ends.count()
        return keep(compare(pairs, rows.select("rid", "text").join(F.broadcast(ends) if some <= BROADCAST_IDS else ends, "rid"), threshold))

    answers = compared(first.where("open").select("a", "b"))
    labels = components(answers.where("linked").select("a", "b"))
    # Second round: entries of lists that still hold several components, with their distance to the list's first set.
    dist = answers.select("a", "b", (1 - F.col("common") / (F.col("na") + F.col("nb") - F.col("common"))).alias("low")).withColumn("high", F.col("low"))
    dist = dist.union(first.where("not open").select("a", "b", "low", F.lit(1.0)))
    sets, parts = map(keep, by_lead(entries, labels, dist, sketched))
    asked = first.select("a", "b")
    # What one set is found to be linked with, all sets linked with it need not ask again: first the pairs that would join
    # components, then those that are still open between components.
    for every in (False, True):
        here = sets.join(labels.withColumnRenamed("v", "rid"), "rid", "left").withColumn("c", F.coalesce("c", "rid"))
        more = keep(open_pairs(here, parts, threshold, every).join(asked, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
        asked = asked.union(more)
        labels = components(compared(more).where("linked").select("a", "b").union(labels))
    # Equal sets: the smallest row speaks for all, as in the lists.
    rep = prints.where("n > 0").groupBy("n", "fp_a", "fp_b").agg(F.min("rid").alias("rep"))
    rep = rep.join(labels.withColumnRenamed("v", "rep"), "rep", "left").select("n", "fp_a", "fp_b", F.coalesce("c", "rep").alias("c"))
    out = prints.join(rep, ["n", "fp_a", "fp_b"], "left").select("rid", F.col("n").alias("n_shingles"), F.coalesce("c", "rid").alias("c"))
    out = durable(out.join(rows.select("rid", "doc_id"), "rid"))
    for path in paths:
        remove(spark, path)
    return out


def jaccard_join(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """One row per document: set size and component, named by its smallest doc_id."""
    found = jaccard_components(docs, threshold)
    smallest = found.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    return found.join(smallest, "c").select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one document of each component: the smallest doc_id, then the earlier row (pipeline stage)."""
    docs = fixed(docs)
    found = jaccard_components(docs, threshold)
    keep = found.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "rid")).alias("k")).select(F.col("k.rid").alias("rid"))
    rid = free_name(docs.columns, "rid")
    return docs.withColumn(rid, F.monotonically_increasing_id()).join(keep.withColumnRenamed("rid", rid), rid, "left_semi").select(*docs.columns)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_join(spark.read.parquet(f"{sf_dir}/documents.parquet"))
