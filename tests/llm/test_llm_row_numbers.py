"""Rows keep their numbers while the splits of their file change from job to job."""

from itertools import cycle

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from cases import collected, messy_rows, ordered, words
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql.readwriter import DataFrameWriter
from test_llm_dedup import plain_words

from matchgrain.llm import jaccard_join, substring_dedup, token_counts

KEY = "spark.sql.files.maxPartitionBytes"


@pytest.fixture
def restless(spark, tmp_path, monkeypatch):
    """A file of many row groups, and a session that splits files otherwise after every table it has written."""
    rows = [(k, f"{t or ''} number {k}") for k, (_, t) in enumerate(messy_rows())]
    path = str(tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]}), path, row_group_size=2)
    sizes, before = cycle(["9000", "3000"]), spark.conf.get(KEY)

    def then_change(owner, name):
        own = getattr(owner, name)

        def run(self, *a, **b):
            out = own(self, *a, **b)
            spark.conf.set(KEY, next(sizes))
            return out

        monkeypatch.setattr(owner, name, run)

    then_change(DataFrameWriter, "parquet")
    then_change(DataFrameWriter, "text")
    then_change(DataFrame, "checkpoint")
    yield rows, spark.read.parquet(path)
    spark.conf.set(KEY, before)


def test_passages_are_cut_from_their_own_documents(restless):
    rows, docs = restless
    assert collected(substring_dedup.substring_dedup(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == plain_words(rows)


def test_one_of_each_keeps_its_own_rows(restless):
    rows, docs = restless
    components = jaccard_join.jaccard_join(docs).collect()
    assert {r.doc_id for r in jaccard_join.one_of_each(docs).collect()} == {r.component_id for r in components}
    assert {(r.doc_id, r.n_shingles > 0) for r in components} == {(i, len(words(t)) > 0) for i, t in rows}


def test_counts_have_their_own_documents(spark, restless):
    rows, docs = restless
    got = collected(token_counts.corpus_token_counts(docs), "doc_id", "n_tokens")
    from test_llm_packing import ids_of

    assert got == ordered([(i, len(ids_of(t))) for i, t in rows])
