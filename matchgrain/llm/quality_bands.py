"""Quality rules by compression bands.

Zstandard ratios (compressed bytes over UTF-8 bytes) of the whole text and of its fixed chunks are held against limits that
depend on the text's length. A low ratio is repetitive text, a high one incompressible text.

Defined results: a null or empty text has no words, fails the base rules and is rejected; every row gives one row, repeated
ids included; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import Words, short, text_slices


class Band(NamedTuple):
    below: int  #: the band holds texts of fewer UTF-8 bytes than this
    low: float
    high: float


#: Zstandard level 3. Short texts carry frame overhead and little history, so both limits fall with the length.
BANDS: tuple[Band, ...] = (
    Band(256, 0.40, 6.0), Band(512, 0.47, 0.95), Band(1024, 0.46, 0.85), Band(2048, 0.44, 0.78), Band(4096, 0.425, 0.72),
    Band(8192, 0.405, 0.68), Band(16384, 0.385, 0.66), Band(1 << 62, 0.37, 0.65),
)
CHUNK_BYTES = 2048
CHUNK_LOW, CHUNK_HIGH = 0.30, 0.75
#: A text goes when more than this share of its whole chunks lies outside the chunk limits.
CHUNK_SHARE = 0.3
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, n_chunks long, chunks_out long, verdict string"
)


def repeated_words(words: Words, k: int = 3) -> np.ndarray:
    """Per text, the words inside k-word windows that occur at least twice in it."""
    out = np.zeros(len(words.count), dtype=np.int64)
    ok = np.flatnonzero(words.whole(k))
    if not len(ok):
        return out
    gram, doc = words.grams(k)[ok], words.doc[ok]
    order = np.lexsort((gram, doc))
    same = (gram[order][1:] == gram[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    twice = np.zeros(len(ok), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(words.hash), dtype=bool)
    for j in range(k):
        cover[ok[twice] + j] = True
    return out + np.bincount(words.doc[cover], minlength=len(out))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def rate(text: bytes, squeeze, bands: Sequence[Band]) -> tuple[float, int, int, str]:
    """Ratio of the whole, number of whole chunks, chunks outside their limits, and the verdict."""
    if not text:
        return 0.0, 0, 0, "empty"
    band = next(b for b in bands if len(text) < b.below)
    ratio = len(squeeze(text)) / len(text)
    n = len(text) // CHUNK_BYTES
    rates = [len(squeeze(text[i * CHUNK_BYTES : (i + 1) * CHUNK_BYTES])) / CHUNK_BYTES for i in range(n)] if n > 1 else []
    low, high = sum(r < CHUNK_LOW for r in rates), sum(r > CHUNK_HIGH for r in rates)
    if ratio < band.low:
        verdict = "repetitive"
    elif ratio > band.high:
        verdict = "incompressible"
    elif low + high > CHUNK_SHARE * len(rates):
        verdict = "repetitive chunks" if low >= high else "incompressible chunks"
    else:
        verdict = "kept"
    return ratio, len(rates), low + high, verdict


def quality_bands(docs: DataFrame, bands: Sequence[Band] = BANDS) -> DataFrame:
    """One row per row of ``docs`` (``doc_id``, ``text``) with its counts, ratios and verdict. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for ids, texts in text_slices(batches, ["doc_id", "text"]):
            w = Words(texts)
            chars = np.bincount(w.doc, minlength=len(texts)) * 0
            # Code points inside words: bytes that are neither spaces nor continuation bytes.
            inside = np.repeat(np.arange(len(texts)), np.diff(np.append(w.at, len(w.buf))))
            point = ((w.buf & 0xC0) != 0x80) & ~np.isin(w.buf, (9, 10, 11, 12, 13, 32))
            chars = np.bincount(inside[point], minlength=len(texts))
            symbols = [len(t) - len(t.translate(None, SYMBOLS)) for t in texts]
            lines = [duplicate_lines(t) for t in texts]
            again = repeated_words(w)
            failed = (w.count < MIN_WORDS) | (100 * again > 50 * w.count)
            rates = [rate(t, squeeze, bands) for t in texts]
            kept = [not f and r[3] == "kept" for f, r in zip(failed.tolist(), rates, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(w.count, pa.int64()), pa.array(chars, pa.int64()), pa.array(symbols, pa.int64()), pa.array(lines, pa.int64()), pa.array(again, pa.int64()), pa.array(failed), pa.array(kept)]
                + [pa.array([r[i] for r in rates], t) for i, t in enumerate((pa.float64(), pa.int64(), pa.int64(), pa.string()))],
                names=[c.split()[0] for c in SCHEMA.split(", ")],
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def op1_quality_bands(spark, sf_dir: str) -> DataFrame:
    return quality_bands(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns (pipeline stage).

    The verdict is taken where the row is read: no join back, and rows with repeated or null ids stay apart.
    """
    schema, names = docs.schema, docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3).compress
        for batch in short(batches):
            kept: list[bool] = []
            for (texts,) in text_slices([batch], ["text"]):
                w = Words(texts)
                failed = (w.count < MIN_WORDS) | (100 * repeated_words(w) > 50 * w.count)
                kept += [not f and rate(t, squeeze, BANDS)[3] == "kept" for f, t in zip(failed.tolist(), texts, strict=True)]
            yield pa.RecordBatch.from_arrays(batch.columns, names=names).filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, schema)
