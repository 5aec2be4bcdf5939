from collections import Counter

import pytest
import zstandard
from cases import collected, documents, messy_rows, ordered, small_documents, words

from matchgrain.llm import quality_bands as q

COLS = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def plain(doc_id, text):
    text = text or ""
    w = words(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:], strict=False))
    cover = {i + j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(3)}
    failed = len(w) < 50 or 100 * len(cover) > 50 * len(w)
    raw = text.encode()
    size = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b))
    good = bool(raw)
    if good:
        band = next(b for b in q.BANDS if len(raw) < b.below)
        chunks = [size(raw[k : k + 2048]) / 2048 for k in range(0, len(raw) - 2047, 2048)]
        chunks = chunks if len(chunks) > 1 else []
        good = band.low <= size(raw) / len(raw) <= band.high and sum(not q.CHUNK_LOW <= r <= q.CHUNK_HIGH for r in chunks) <= q.CHUNK_SHARE * len(chunks)
    return doc_id, len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), dup, len(cover), failed, not failed and good


@pytest.mark.parametrize("rows", [messy_rows(), small_documents(), []], ids=["messy", "small", "empty"])
def test_as_counted_plainly(spark, rows):
    docs = documents(spark, rows)
    want = ordered([plain(*r) for r in rows])
    assert collected(q.quality_bands(docs), *COLS) == want
    kept = collected(q.keep_good(docs), "doc_id", "text")
    assert kept == ordered([r for r in rows if plain(*r)[-1]]) and q.keep_good(docs).columns == docs.columns


def test_bands_catch_both_ends():
    import random

    r = random.Random(1)
    squeeze = zstandard.ZstdCompressor(level=3).compress
    noise = "".join(chr(r.randrange(33, 127)) for _ in range(9000)).encode()
    assert q.rate(noise, squeeze, q.BANDS)[3] == "incompressible"
    assert q.rate(b"buy now and save " * 400, squeeze, q.BANDS)[3] == "repetitive"
