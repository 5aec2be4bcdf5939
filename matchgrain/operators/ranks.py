"""Ranks over all rows without one task for all of them: by distinct value, in ranges, with the ranges' offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import cut


def value_ranks(rows: DataFrame, value: str) -> DataFrame:
    """``value, peers, below``: each distinct value, its rows, and the rows strictly below it.

    Values are dealt out by range; the running sums of a range start at what the ranges before it hold, which is one number
    for each partition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    v = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("peers"))
    v = cut(v.repartitionByRange(parts, value).withColumn("_part", F.spark_partition_id()))
    held = v.groupBy("_part").agg(F.sum("peers").alias("held"))
    offset = held.select("_part", (F.sum("held").over(Window.orderBy("_part")) - F.col("held")).alias("_offset"))  # one row a partition
    inside = F.sum("peers").over(Window.partitionBy("_part").orderBy(value)) - F.col("peers")
    return v.withColumn("_inside", inside).join(F.broadcast(offset), "_part").select(value, "peers", (F.col("_offset") + F.col("_inside")).alias("below"))


def average_ranks(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with ties sharing the mean of their ranks."""
    r = value_ranks(rows, value)
    return rows.join(r.select(value, (F.col("below") + (F.col("peers") + 1) / 2.0).alias(name)), value)


def order_statistics(rows: DataFrame, value: str, percents: tuple[int, ...]) -> DataFrame:
    """``p, value``: the smallest value with at least p percent of the rows at or below it."""
    r = value_ranks(rows, value)
    total = rows.where(F.col(value).isNotNull()).agg(F.count("*").alias("n"))
    wanted = r.join(F.broadcast(total)).withColumn("p", F.explode(F.array(*[F.lit(p) for p in percents])))
    place = F.greatest(F.lit(1), F.floor((F.col("p") * F.col("n") + 99) / 100))
    return wanted.where((F.col("below") < place) & (place <= F.col("below") + F.col("peers"))).select("p", F.col(value).alias("value"))
