"""Document likelihood from a subword lattice.

A word's probability sums over all its segmentations into the pieces of an existing vocabulary, by a forward recursion in
log space over all words of one length at once, joined by one arc for the whole word where training documents hold it:
``max(c - d, 0) / N + d V / N * lattice(word)``. The pieces' weights start from the vocabulary's own scores (its merge ranks,
read as ``1 / (2 - score)``) and are fitted by expectation-maximisation on the distinct training words; ``d`` is the
Good-Turing discount. All this is fitted for each language of the training documents; a document's probability is the
mixture, by the languages' shares, of the products over its words and one end. Its own language label is not read.
``vocabulary_score`` beside it is the lattice alone, under the vocabulary's scores as they are: nothing in it is learnt.

Words are counted and looked up in blocks of documents: a block sends each distinct word once, and gets back its count and
log probability, whatever number of documents hold it.

Defined results: a null or empty text is one end token; a null id belongs to training; without training
documents the lattice alone scores; without a column ``lang`` there is one language; languages with less than
``LEAST_SHARE`` of the training documents, and null, count as one; every row gives one row; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _BYTE, Words, durable, remove, stored, text_slices

#: UTF-8 bytes of text in a block, about.
BLOCK_BYTES = 16 << 20
END = b" "  #: no word holds a space
EM_STEPS = 2
#: Words of a language whose pieces' uses are found together.
AT_ONCE = 30_000
FOLDS, HELD_OUT = 7, 2
#: Share of the training documents that a language needs for a model of its own; so there are at most 51 models.
LEAST_SHARE = 0.02
_BASE = np.uint64(0xD1342543DE82EF95)
#: Ends of a word whose arcs are held at a time on the way back; of longer words they are found again, part by part.
LONG = 256
#: Below this a word's probability is found in logarithms: paths that are lost to underflow would weigh less than 1e-50 of it above.
TINY = 1e-250


def vocabulary_pieces(path: str | None = None) -> tuple[list[bytes], np.ndarray]:
    """Pieces (a leading space marks a word's begin) and weights from the vocabulary's scores; single bytes always exist."""
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
    weight = {bytes([b]): 1e-6 for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i)):
            weight[model.id_to_piece(i).replace("▁", " ").encode()] = 1 / (2 - model.get_score(i))
    total = sum(weight.values())
    return list(weight), np.array(list(weight.values())) / total


class Lattice:
    """Marginal log probabilities of words, and the expected use of each piece.

    ``weights``: one for each piece, or several rows of them, one a model; the arcs of a word are found once for all models.
    """

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        hashes = np.array([self._hash(p) for p in pieces], dtype=np.uint64)
        self.longest = max(map(len, pieces))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        self.one = weights.ndim == 1
        with np.errstate(divide="ignore"):
            log = np.log(np.atleast_2d(weights))[:, self.order]
        self.log = np.concatenate((log, np.full((len(log), 1), -np.inf)), axis=1)  # the last stands for no piece
        self.weight = np.exp(self.log)
        self.maybe = np.zeros(1 << 20, dtype=bool)  # by the first bits of the hash: most spans are no piece
        self.maybe[self.hashes >> np.uint64(44)] = True

    @staticmethod
    def _hash(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * int(_BASE) + int(_BYTE[b])) % (1 << 64)
        return h

    def _arcs(self, text: np.ndarray):
        """For each end j: the first start i, and what is a piece, as (start - i) * words + word with its place among the pieces."""
        n, length = text.shape
        value = _BYTE[text]
        h = np.zeros((length, n), dtype=np.uint64)
        for j in range(1, length + 1):
            i = max(0, j - self.longest)
            now = h[i:j]
            now *= _BASE
            now += value[:, j - 1]
            flat = now.ravel()
            there = np.flatnonzero(self.maybe[flat >> np.uint64(44)])
            found = flat[there]
            place = np.minimum(np.searchsorted(self.hashes, found), len(self.hashes) - 1)
            ok = self.hashes[place] == found
            yield j, i, there[ok], place[ok]

    def forward(self, words: list[bytes]) -> np.ndarray:
        """Natural log probability of each word, with the space before it; one column a model if there are several."""
        out = self._each(words, None)
        return out[:, 0] if self.one else out

    def expected(self, words: list[bytes]) -> np.ndarray:
        """Expected number of uses of each piece (under the first model), every word counted once."""
        uses = np.zeros(len(self.hashes))
        self._each(words, uses)
        out = np.zeros(len(uses))
        out[self.order] = uses
        return out

    def _each(self, words: list[bytes], uses: np.ndarray | None) -> np.ndarray:
        out = np.zeros((len(words), len(self.log)))
        size = np.fromiter(map(len, words), np.int64, len(words))
        for length in np.unique(size):
            rows = np.flatnonzero(size == length)
            step = max(1, 1_500_000 // (int(length + 1) * min(int(length) + 1, self.longest)))
            for a in range(0, len(rows), step):
                part = rows[a : a + step]
                text = np.frombuffer(b"".join(b" " + words[i] for i in part.tolist()), dtype=np.uint8).reshape(len(part), -1)
                out[part] = self._one_length(text, uses)
        return out

    def _one_length(self, text: np.ndarray, uses: np.ndarray | None) -> np.ndarray:
        n, length = text.shape
        if length > LONG:
            return self._in_logarithms(text, uses)
        alpha = np.zeros((len(self.log), length + 1, n))
        alpha[:, 0] = 1
        arcs = []
        for j, i, there, piece in self._arcs(text):
            start, word = there + i * n, there % n
            for weight, reached in zip(self.weight, alpha, strict=True):
                reached[j] = np.bincount(word, reached.ravel()[start] * weight[piece], n)
            if uses is not None:
                arcs.append((j, start, word, piece))
        tiny = np.flatnonzero((alpha[:, length] < TINY).any(axis=0))
        with np.errstate(divide="ignore"):
            out = np.log(alpha[:, length].T)
        if uses is not None:
            beta = np.zeros((length + 1, n))
            with np.errstate(divide="ignore"):
                beta[length] = 1 / alpha[0, length]
            beta[length, tiny] = 0
            shares = []
            for j, start, word, piece in reversed(arcs):
                rest = self.weight[0][piece] * beta[j][word]
                shares.append(alpha[0].ravel()[start] * rest)
                beta.ravel()[start] += rest  # a start has one arc a word to this end
            uses += np.bincount(np.concatenate([piece for *_, piece in reversed(arcs)]), np.concatenate(shares), len(uses))
        if len(tiny):
            out[tiny] = self._in_logarithms(text[tiny], uses)
        return out

    def _in_logarithms(self, text: np.ndarray, uses: np.ndarray | None) -> np.ndarray:
        n, length = text.shape
        keep, short = uses is not None, length <= LONG
        alpha = np.full((len(self.log), length + 1, n), -np.inf)
        alpha[:, 0] = 0
        arcs = []
        for j, i, there, piece in self._arcs(text):
            at = np.full((j - i) * n, len(self.hashes), dtype=np.int32)
            at[there] = piece
            at = at.reshape(j - i, n)
            for log, reached in zip(self.log, alpha, strict=True):
                paths = reached[i:j] + log[at]
                top = paths.max(axis=0)
                with np.errstate(invalid="ignore", divide="ignore"):
                    reached[j] = np.where(np.isfinite(top), top + np.log(np.exp(paths - top).sum(axis=0)), -np.inf)
            if keep and short:
                arcs.append((j, i, piece, there))
        if keep:
            first, beta = alpha[0], np.full((length + 1, n), -np.inf)
            beta[length] = 0
            for j, i, piece, there in reversed(arcs) if short else self._backwards(text):
                start, word = i + there // n, there % n
                rest = self.log[0][piece] + beta[j][word]
                with np.errstate(invalid="ignore"):
                    share = np.exp(first[start, word] + rest - first[length][word])
                share[~np.isfinite(share)] = 0
                uses += np.bincount(piece, share, minlength=len(uses))
                beta[start, word] = np.logaddexp(beta[start, word], rest)
        return alpha[:, length].T

    def _backwards(self, text: np.ndarray):
        """The arcs from the last end to the first, of ``LONG`` ends at a time: an arc reaches back by the longest piece only."""
        n, length = text.shape
        for a in range((length - 1) // LONG * LONG, -1, -LONG):
            first = max(0, a - self.longest)
            part = [(first + j, first + i, piece, there) for j, i, there, piece in self._arcs(text[:, first : a + LONG]) if first + j > a]
            yield from reversed(part)


BLOCKS = "block long, wid int, word binary, c array<long>, row long, doc_id long, held_out boolean, ids binary"


def word_blocks(docs: DataFrame, models: int) -> DataFrame:
    """Blocks of documents: a row for each distinct word (``wid, word``, and ``c``, its training counts by language) and one
    for each document (``ids``)."""
    names, types = [c.split()[0] for c in BLOCKS.split(", ")], [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, 0
        wid: dict[int, int] = {}
        words, counts, rows = [], [], []

        def flush() -> Iterator[pa.RecordBatch]:
            block, n = task << 32 | number, len(words)
            nothing = [pa.nulls(n, t) for t in types]
            model = np.concatenate(counts)  # of each token; held-out ones count for none
            token = np.concatenate([w for w, *_ in rows])[model >= 0]
            count = np.bincount(token * models + model[model >= 0], minlength=n * models)
            count = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * models), pa.array(count.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block)), pa.array(np.arange(n, dtype=np.int32)), pa.array(words, pa.binary()), count, *nothing[4:]], names=names)
            docs = [(block, None, None, None, r, d, h, i.astype("<u4").tobytes()) for _, *many in rows for r, d, h, i in zip(*many, strict=True)]
            for a in range(0, len(docs), 2000):
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*docs[a : a + 2000], strict=True), types, strict=True)], names=names)

        for row, doc_id, held_out, model, texts in text_slices(batches, ["row", "doc_id", "held_out", "model", "text"]):
            w = Words(texts, lower=True)
            kinds, first, kind = np.unique(w.hash, return_index=True, return_inverse=True)
            local = np.empty(len(kinds) + 1, dtype=np.int64)
            start, end = w.start[first].tolist(), w.end[first].tolist()
            for i, h in enumerate(kinds.tolist()):
                k = wid.get(h)
                if k is None:
                    k = wid[h] = len(words)
                    words.append(w.raw[start[i] : end[i]])
                local[i] = k
            if -1 not in wid:
                wid[-1] = len(words)
                words.append(END)
            ids = local[kind]
            of = np.where(np.array(held_out.to_pylist(), dtype=bool), -1, model.to_numpy())
            each = [np.append(ids[a : a + n], wid[-1]) for a, n in zip(w.first.tolist(), w.count.tolist(), strict=True)]
            rows.append((np.concatenate(each), row.to_pylist(), doc_id.to_pylist(), held_out.to_pylist(), each))
            counts.append(np.repeat(of, w.count + 1).astype(np.int64))
            held += sum(map(len, texts))
            if held >= BLOCK_BYTES:
                yield from flush()
                number, held = number + 1, 0
                wid, words, counts, rows = {}, [], [], []
        if rows:
            yield from flush()

    return docs.mapInArrow(run, BLOCKS)


def fit_pieces(words: DataFrame, pieces: list[bytes], weights: np.ndarray, models: int, steps: int = EM_STEPS) -> np.ndarray:
    """Expectation-maximisation over the distinct words (``word``, ``c``) of each language; only sums for each piece of the
    vocabulary reach the driver. One row of weights a language."""
    weights = np.tile(weights, (models, 1))
    for _ in range(steps):

        def run(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            lattices, total = [Lattice(pieces, w) for w in weights], np.zeros(weights.shape)
            waiting: list[list[bytes]] = [[] for _ in lattices]
            for batch in batches:
                words, c = batch.column("word").to_pylist(), batch.column("c").flatten().to_numpy().reshape(-1, models)
                for k, lattice in enumerate(lattices):
                    waiting[k] += [words[i] for i in np.flatnonzero(c[:, k]).tolist() if words[i] != END]
                    if len(waiting[k]) >= AT_ONCE or sum(map(len, waiting[k])) >= BLOCK_BYTES:  # few words of one length at once cost most by the calls
                        total[k] += lattice.expected(waiting[k])
                        waiting[k] = []
            for k, lattice in enumerate(lattices):
                total[k] += lattice.expected(waiting[k])
            model, used = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(model.astype(np.int32)), pa.array(used.astype(np.int32)), pa.array(total[model, used])], names=["model", "piece", "uses"])

        sums = words.select("word", "c").mapInArrow(run, "model int, piece int, uses double").groupBy("model", "piece").agg(F.sum("uses").alias("uses")).collect()
        new = np.zeros(weights.shape)
        for r in sums:
            new[r["model"], r["piece"]] = r["uses"]
        total = new.sum(axis=1, keepdims=True)
        new = (1 - 1e-6) * new / np.where(total > 0, total, 1) + 1e-6 / 256 * np.array([len(p) == 1 for p in pieces])  # any byte stays possible
        weights = np.where(total > 0, new, weights)
    return weights


def languages(docs: DataFrame) -> dict[str, int]:
    """Languages with a model of their own, numbered from 1; at most ``1 / LEAST_SHARE``."""
    if "lang" not in docs.columns:
        return {}
    seen = docs.where(~F.col("held_out") & F.col("lang").isNotNull()).groupBy("lang").count()
    total = docs.where(~F.col("held_out")).count()
    return {r["lang"]: k + 1 for k, r in enumerate(seen.where(F.col("count") >= LEAST_SHARE * total).orderBy("lang").collect())}


RESULT = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, vocabulary_score double"


def lattice_scores(docs: DataFrame, held_out: F.Column, path: str | None = None) -> DataFrame:
    """Scores of all documents by a model of those where ``held_out`` is false."""
    spark = docs.sparkSession
    own = [F.col("lang").cast("string").alias("lang")] if "lang" in docs.columns else []
    slim = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), *own, F.coalesce("text", F.lit("")).alias("text"))
    number = languages(slim)
    models = len(number) + 1
    model = F.coalesce(F.create_map(*[F.lit(x) for kv in number.items() for x in kv])[F.col("lang")], F.lit(0)) if number else F.lit(0)
    blocks, blocks_path = stored(word_blocks(slim.select("row", "doc_id", "held_out", model.alias("model"), "text"), models))
    in_blocks = blocks.where("word is not null").select("block", "wid", "word", "c")
    counted, words_path = stored(in_blocks.groupBy("word").agg(*[F.sum(F.col("c")[k]).alias(f"c{k}") for k in range(models)]).select("word", F.array(*[f"c{k}" for k in range(models)]).alias("c")))
    whole = F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x)
    seen = counted.where(whole > 0)
    each = [f(F.col("c")[k]).alias(f"{name}{k}") for k in range(models) for name, f in (("n", F.sum), ("v", lambda x: F.count_if(x > 0)), ("n1", lambda x: F.count_if(x == 1)), ("n2", lambda x: F.count_if(x == 2)))]
    sums = seen.agg(F.sum(whole).alias("n"), F.count("*").alias("v"), *each).first()
    n, v = int(sums["n"] or 0), int(sums["v"])
    tokens, kinds, n1, n2 = (np.array([float(sums[f"{name}{k}"] or 0) for k in range(models)]) for name in ("n", "v", "n1", "n2"))
    discount = np.where((n1 > 0) & (n2 > 0), n1 / np.maximum(n1 + 2 * n2, 1), 0.5)
    ends = seen.where(F.col("word") == F.lit(END)).select("c").first()  # one a document
    docs_of = np.array(ends["c"] if ends else [1] + [0] * (models - 1), dtype=float)
    live = np.flatnonzero(docs_of)
    with np.errstate(divide="ignore"):
        share = np.log10(docs_of / docs_of.sum())
    pieces, given = vocabulary_pieces(path)
    weights = fit_pieces(seen, pieces, given, models)

    def score_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces, np.vstack((weights[live], given)))
        for batch in batches:
            words, c = batch.column("word").to_pylist(), batch.column("c").flatten().to_numpy().reshape(-1, models)
            spelt = [w if w != END else b"" for w in words]
            log = np.full((len(c), models + 1), -np.inf)
            inside = lattice.forward(spelt)
            log[:, models] = inside[:, -1]
            for k, spelling in zip(live.tolist(), inside.T[:-1], strict=True):
                if tokens[k]:
                    with np.errstate(divide="ignore"):
                        known = np.log(np.maximum(c[:, k] - discount[k], 0) / tokens[k])
                    log[:, k] = np.logaddexp(known, spelling + math.log(discount[k] * kinds[k] / tokens[k]))
                else:
                    log[:, k] = spelling
            single = (log / math.log(10)).astype("<f4")  # one run of bytes a word: smaller to shuffle than an array
            at = np.arange(len(words) + 1, dtype=np.int32) * (4 * (models + 1))
            log10 = pa.Array.from_buffers(pa.binary(), len(words), [None, pa.py_buffer(at), pa.py_buffer(single.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("word"), pa.array(c.sum(axis=1)), log10], names=["word", "c", "log10"])

    priced = counted.mapInArrow(score_words, "word binary, c long, log10 binary")
    values = in_blocks.drop("c").join(priced, "word").select("block", "wid", "c", "log10")

    def mixture(log10: np.ndarray) -> float:
        """Log10 of the mixture over languages of a text whose words have these log probabilities."""
        by = log10[:, :models].sum(axis=0, dtype=np.float64) + share
        return float(by.max() + np.log10((10 ** (by - by.max())).sum()))

    def score(words: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        c, log10 = np.zeros(len(words), np.int64), np.zeros((len(words), models + 1), np.float32)
        c[words["wid"]], log10[words["wid"]] = words["c"], np.frombuffer(b"".join(words["log10"]), "<f4").reshape(-1, models + 1)
        base = np.log10((c + 1) / (n + v + 1))
        ids = [np.frombuffer(b, dtype="<u4") for b in rows["ids"]]
        return pd.DataFrame(
            {
                "row": rows["row"], "doc_id": rows["doc_id"], "held_out": rows["held_out"], "n_tokens": [len(i) for i in ids], "n_known": [int((c[i] > 0).sum()) for i in ids],
                "train_tokens": n, "base_score": [math.fsum(base[i]) for i in ids], "score": [mixture(log10[i]) for i in ids], "vocabulary_score": [float(log10[i, models].sum(dtype=np.float64)) for i in ids],
            }
        )

    documents = blocks.where("ids is not null").select(F.col("block").alias("of_block"), "row", "doc_id", "held_out", "ids")
    scored = durable(values.groupBy("block").cogroup(documents.groupBy("of_block")).applyInPandas(score, RESULT))
    remove(spark, blocks_path)
    remove(spark, words_path)
    return scored.drop("row")


def op5_lattice_lm(spark, sf_dir: str) -> DataFrame:
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == HELD_OUT
    return lattice_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.coalesce(fold, F.lit(False)))
