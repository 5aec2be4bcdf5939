"""The corpus pipeline against its stages done plainly, one after the other."""

import zlib

import duckdb
import numpy as np
import pytest
from cases import SMALL, documents, messy_rows, ordered, small_documents, words
from test_llm_dedup import plain_words
from test_llm_jaccard import plain as plain_sets
from test_llm_models import copies_of, plain_rates
from test_llm_packing import ids_of
from test_llm_quality import plain as plain_quality

import corpus_pipeline


def cut(rows):
    """The rows with repeated passages cut out; the layout between kept words is not compared."""
    import hashlib
    from collections import Counter

    texts = [words(t) for _, t in rows]
    c = Counter(tuple(w[i : i + 35]) for w in texts for i in range(len(w) - 34))
    out = []
    for (i, _), w in zip(rows, texts, strict=True):
        gone = {k + j for k in range(len(w) - 34) if c[tuple(w[k : k + 35])] > 1 for j in range(35)}
        out.append((i, [x for k, x in enumerate(w) if k not in gone]))
    assert ordered([(i, hashlib.sha256(" ".join(w).encode()).hexdigest()) for i, w in out]) == ordered([(r[0], r[3]) for r in plain_words(rows)])
    return out


@pytest.mark.parametrize("rows", [small_documents(), messy_rows()], ids=["small", "messy"])
def test_stages_as_done_plainly(spark, tmp_path, rows):
    folder = str(tmp_path)
    documents(spark, rows).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    labels = duckdb.sql(f"select doc_id, quality, toxic from read_parquet('{SMALL}/labels.parquet')").fetchall()
    spark.read.parquet(f"{SMALL}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    docs, columns = spark.read.parquet(f"{folder}/documents.parquet"), None
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        columns = docs.columns
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stage-{k}")
        docs = spark.read.parquet(f"{folder}/stage-{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
            seen[name] = [(r.doc_id, r.text) for r in docs.collect()]
    good = [r for r in rows if plain_quality(*r)[-1]]
    assert ordered(seen["quality rules"]) == ordered(good)
    groups = plain_sets(good)
    kept = seen["n-gram Jaccard join"]
    assert {i for i, _ in kept if i is not None} == {c for _, _, c in groups if c is not None}
    left = cut(kept)
    assert ordered([(i, words(t)) for i, t in seen["substring dedup"]]) == ordered(left)
    _, p, rate, _ = plain_rates(seen["substring dedup"], labels)
    assert ordered(seen["mixing sources to target weights"]) == ordered(copies_of(spark, seen["substring dedup"], p, rate))
    pieces = ordered([(r.doc_id, r.piece, r.length, r.ids_crc32) for r in docs.collect()])
    want = []
    for i, t in seen["mixing sources to target weights"]:
        ids = [*ids_of(t), 2]
        at = [0, *range(len(ids) % 1024 or 1024, len(ids), 1024), len(ids)] if len(ids) > 1024 else [0, len(ids)]
        want += [(i, p, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for p, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True))]
    assert pieces == ordered(want)


def test_run_gives_the_last_stage(spark):
    got = corpus_pipeline.run(spark, SMALL)
    assert {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
