"""What the operators of this subpackage share: table reading, durable lineage cuts, vectorised words."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Documents' text handled at once inside a task, in UTF-8 bytes; a longer single text forms a slice of its own.
SLICE_BYTES = 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where it is unset, one of our own on a single machine only."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir is unset: executors would not see each other's files")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fixed(df: DataFrame) -> DataFrame:
    """``df`` with its partitions decided here and now, so that numbered rows have the same numbers in every later job.

    A plan of its own would split the files anew for each job, by the cores that are registered at that moment. A scan
    keeps the list of its splits and is not stored; rows from behind a shuffle, whose order may change, are, and so is a
    table without rows, which costs nothing.
    """
    run = df._jdf.queryExecution()
    if df.isEmpty() or "Exchange" in run.executedPlan().toString():
        return durable(df)
    return type(df)(df.sparkSession._jsparkSession.internalCreateDataFrame(run.toRdd(), df._jdf.schema(), False), df.sparkSession)


def stored(df: DataFrame) -> tuple[DataFrame, str]:
    """Write a table into the shared folder: smaller there than a checkpoint. The caller removes it."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def partitions(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def free_name(taken: Iterable[str], name: str) -> str:
    """``name``, or one like it that no column in ``taken`` has."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def short(batches: Iterable, rows: int = 1000) -> Iterator:
    """The same rows in shorter batches, so that what a task builds from one of them stays small."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)
    pa.default_memory_pool().release_unused()


def text_slices(batches: Iterable, columns: list[str], most: int = SLICE_BYTES) -> Iterator[tuple]:
    """Arrow batches to (lists of the columns ..., list of UTF-8 texts) of about ``most`` bytes; null texts become empty.

    The text is the batch's last column among ``columns``.
    """
    for batch in batches:
        cols = [batch.column(c) for c in columns[:-1]]
        texts = batch.column(columns[-1])
        held: list[bytes] = []
        first, size = 0, 0
        for i, t in enumerate(texts):
            b = (t.as_py() or "").encode("utf-8", "surrogatepass")
            held.append(b)
            size += len(b)
            if size >= most:
                yield *(c.slice(first, i + 1 - first) for c in cols), held
                held, first, size = [], i + 1, 0
        if held:
            yield *(c.slice(first, len(held)) for c in cols), held
    pa.default_memory_pool().release_unused()


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = np.uint64(0xD1342543DE82EF95)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hash(buf: np.ndarray, gap: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits for each byte span; ``gap`` marks the bytes between spans."""
    length = end - start
    inside = np.arange(len(buf), dtype=np.int32 if len(buf) < 1 << 31 else np.int64)
    inside[start[0] :] -= np.repeat(start.astype(inside.dtype), np.diff(np.append(start, len(buf))))
    value = _BYTE[buf]
    value[gap] = 0
    inside[gap] = 0
    value *= powers(int(length.max()) + 1)[inside]
    return mix(np.add.reduceat(value, start) + length.astype(np.uint64) * _MIX)


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice of texts, found and hashed with array operations.

    ``start``/``end``: byte spans in ``buf``; ``doc``: index of the text; ``count``: words of each text;
    ``first``: index of each text's first word; ``hash``: 64 bits a word. ASCII upper case counts as lower with ``lower``.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        joined = b"\n".join(texts) + b"\n"
        if lower:
            joined = joined.lower()
        self.raw = joined
        self.buf = buf = np.frombuffer(joined, dtype=np.uint8)
        size = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        self.at = np.concatenate(([0], np.cumsum(size + 1)[:-1])) if len(texts) else np.zeros(0, np.int64)
        space = _SPACE[buf]
        edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=np.int8(1)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.count = np.diff(np.searchsorted(self.start, np.append(self.at, len(buf))))
        self.first = np.concatenate(([0], np.cumsum(self.count)[:-1])) if len(texts) else self.at
        self.doc = np.repeat(np.arange(len(texts)), self.count)
        if len(self.start) == 0:
            self.hash = np.zeros(0, dtype=np.uint64)
            return
        self.hash = span_hash(buf, space, self.start, self.end)

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; meaningless where they would leave the text (see ``whole``)."""
        h = self.hash
        out = np.zeros(len(h), dtype=np.uint64)
        n = len(h) - k + 1
        if n > 0:
            acc = np.zeros(n, dtype=np.uint64)
            for j, p in enumerate(powers(k)):
                acc += h[j : j + n] * p
            out[:n] = mix(acc)
        return out

    def whole(self, k: int) -> np.ndarray:
        """Whether k words from each word on are all in its text."""
        return np.arange(len(self.hash)) - self.first[self.doc] + k <= self.count[self.doc]
