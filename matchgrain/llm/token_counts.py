"""Token counts of flat, unindexed token files by a separator scan.

A flat file is nothing but 16- or 32-bit little-endian ids; a document ends with the end-of-document id. Each file is scanned
in blocks: one vectorised search finds the separators of a block, and a prefix scan over the blocks (a running maximum of the
last separator's position, a running sum of their number) stitches the documents that cross block boundaries.

Defined results: a file may end without a separator, its last document then counts as open (``closed`` false); an empty
document has 0 tokens; an empty file has no documents; a length that is no multiple of the id width is an error; files are
independent and each holds less than 2 GB (Spark's limit for one binary value), a folder any number.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import durable, fixed, shared_folder, text_slices

BLOCK_TOKENS = 1 << 18
SCANNED = "path string, block long, first long, n long, last boolean, separators array<long>"


def write_flat(docs: DataFrame, path: str, end: int = tokens.END_OF_TEXT) -> None:
    """Write each text's ids as 16-bit flat files, one a partition, in the order of its rows.

    Spark's text writer puts the ids out as they are, with the end id's two bytes as its line separator.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder()
        for (texts,) in text_slices(batches, ["text"], tokens.SLICE_BYTES):
            ids, count = encode(texts)
            ids = ids.astype("<u2")
            at = np.cumsum(count) - count
            yield pa.RecordBatch.from_arrays([pa.array([ids[a : a + n].tobytes() for a, n in zip(at.tolist(), count.tolist(), strict=True)], pa.binary())], names=["ids"])

    separator = end.to_bytes(2, "little").decode("latin-1")
    flat = docs.select("text").mapInArrow(run, "ids binary").select(F.col("ids").cast("string").alias("value"))
    flat.write.option("lineSep", separator).option("encoding", "ISO-8859-1").text(path)


def scan_blocks(files: DataFrame, end: int, width: int, block_tokens: int) -> DataFrame:
    """Blocks of flat files (``path``, ``content``) with the positions of their separators in the file."""
    dtype = {2: "<u2", 4: "<u4"}[width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                ids = np.frombuffer(content.as_buffer(), dtype=dtype)
                for b, first in enumerate(range(0, len(ids), block_tokens)):
                    part = ids[first : first + block_tokens]
                    found = np.flatnonzero(part == end) + first
                    yield pa.RecordBatch.from_pylist(
                        [{"path": path, "block": b, "first": first, "n": len(part), "last": first + len(part) == len(ids), "separators": found}],
                        schema=pa.schema([("path", pa.string()), ("block", pa.int64()), ("first", pa.int64()), ("n", pa.int64()), ("last", pa.bool_()), ("separators", pa.list_(pa.int64()))]),
                    )

    return files.select("path", "content").mapInArrow(run, SCANNED)


def count_tokens(files: DataFrame, end: int = tokens.END_OF_TEXT, width: int = 2, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per document of the flat files: ``path, doc_no, start, n_tokens, closed``."""
    earlier = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = (
        scan_blocks(files, end, width, block_tokens)
        .withColumn("begin", F.coalesce(F.max(F.try_element_at("separators", F.lit(-1))).over(earlier) + 1, F.lit(0)))
        .withColumn("before", F.coalesce(F.sum(F.size("separators")).over(earlier), F.lit(0)))
        .withColumn("stop", F.col("first") + F.col("n"))
        .withColumn("tail", F.coalesce(F.try_element_at("separators", F.lit(-1)) + 1, F.col("begin")))
        .withColumn("open", F.col("last") & (F.col("tail") < F.col("stop")))
        .withColumn("ends", F.when(F.col("open"), F.concat("separators", F.array("stop"))).otherwise(F.col("separators")))
        .withColumn("starts", F.concat(F.array("begin"), F.transform("separators", lambda s: s + 1)))
    )
    docs = stitched.select("path", "before", "open", "stop", F.size("ends").alias("m"), F.posexplode(F.arrays_zip("starts", "ends")).alias("i", "span"))
    return docs.where(F.col("i") < F.col("m")).select(
        "path",
        (F.col("before") + F.col("i")).cast("long").alias("doc_no"),
        F.col("span.starts").alias("start"),
        (F.col("span.ends") - F.col("span.starts")).alias("n_tokens"),
        (~F.col("open") | (F.col("i") < F.col("m") - 1)).alias("closed"),
    )


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def corpus_token_counts(docs: DataFrame) -> DataFrame:
    """Write the texts as flat files into the shared folder, scan those, and name each count's document.

    A flat file knows no ids: its number and order are those of the scan's partitions and rows, which is also how
    ``monotonically_increasing_id`` counts, so that is what the spans are joined on. Both jobs read one fixed list of
    splits. The files are removed afterwards.
    """
    spark, docs = docs.sparkSession, fixed(docs.select("doc_id", "text"))
    path = f"{shared_folder(spark)}/flat-{uuid.uuid4().hex}"
    write_flat(docs, path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    number = F.regexp_extract("path", r"part-(\d+)", 1).cast("long")
    spans = durable(count_tokens(files).select(number.alias("file"), "doc_no", "start", "n_tokens", "closed"))
    remove(spark, path)
    named = docs.select("doc_id").withColumn("row", F.monotonically_increasing_id())
    named = named.select("doc_id", F.shiftrightunsigned("row", 33).alias("file"), F.col("row").bitwiseAND((1 << 33) - 1).alias("doc_no"))
    return spans.join(named, ["file", "doc_no"], "left").select("doc_id", "n_tokens", "file", "doc_no", "start", "closed")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return corpus_token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
