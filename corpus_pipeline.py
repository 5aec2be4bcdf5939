"""The corpus pipeline: quality rules, near duplicates, repeated passages, mixing, packing.

Each stage works on all rows that its predecessor kept, and its decisions take effect: rejected documents go, one document
of each group of near duplicates stays, repeated passages are cut out of the texts, toxic documents go and low-quality ones
are thinned or repeated as often as the mix's rates say, and the last stage packs what is left into sequences.

Defined results: an empty table gives no rows at any stage; null and empty texts fail the quality rules; rows with a null or
repeated doc_id are documents of their own; of equal documents the one with the smallest doc_id stays (a null one last);
further columns travel along unchanged up to packing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from matchgrain.llm.common import shared_folder
from matchgrain.llm.jaccard_join import one_of_each
from matchgrain.llm.mixing import keep_mixed
from matchgrain.llm.packing import pack, token_pieces
from matchgrain.llm.quality_bands import keep_good
from matchgrain.llm.substring_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_mixed(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(token_pieces(docs))


#: (name, function); all but the last return the columns of documents.
STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing sources to target weights", mix),
    ("best-fit packing", packing),
]

#: Compression and tokenizers have no SQL form; tests/llm/test_llm_pipeline.py holds the run against brute-force stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
    return docs
