"""Running sums over a total order, as a distributed prefix sum: range partitions, one sum a partition, offsets."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, free_name, partitions


def running(df: DataFrame, order: Sequence[str], sums: dict[str, str]) -> DataFrame:
    """``df`` sorted by ``order`` with a column for each of ``sums`` (new name: whole-number column): the sum over all earlier rows.

    The sorted rows are cut off durably, so that partitions and their rows' order stay as they were counted. The driver
    gets one row a partition. Nulls count as nothing; an empty table stays empty.
    """
    names = df.columns
    pid = free_name(names, "pid")
    rows = df.repartitionByRange(partitions(df.sparkSession), *order).sortWithinPartitions(*order)
    rows = durable(rows.withColumn(pid, F.spark_partition_id()))
    each = rows.groupBy(pid).agg(*[F.sum(c).alias(to) for to, c in sums.items()]).orderBy(pid).collect()
    before: dict[str, dict[int, int]] = {}
    for to in sums:
        total = 0
        before[to] = {}
        for r in each:
            before[to][r[pid]] = total
            total += r[to] or 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is None:
                at = batch.column(pid)[0].as_py()
                held = {to: before[to][at] for to in sums}
            new = []
            for to, c in sums.items():
                own = batch.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                up = np.cumsum(own) + held[to]
                new.append(pa.array(up - own, pa.int64()))
                held[to] = int(up[-1])
            columns = [batch.column(c) for c in names] + new
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *sums])

    schema = rows.drop(pid)
    for to in sums:
        schema = schema.withColumn(to, F.lit(0).cast("long"))
    return rows.mapInArrow(run, schema.schema)
