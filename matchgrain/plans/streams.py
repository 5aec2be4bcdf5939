"""Queries that run as streams over a table's files until all of them are read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import store
from ..streaming import prior
from .registry import query


@query(
    """WITH d AS (SELECT user_id AS unit_id, CAST(ts AS DATE) AS day, count(*) AS n, coalesce(sum(value), 0) AS total FROM events WHERE ts IS NOT NULL GROUP BY ALL),
x AS (SELECT max(day) AS last FROM d) SELECT unit_id, CAST(day AS VARCHAR) AS day, n, round(total, 4) AS total, CAST(coalesce(sum(n) OVER w, 0) AS BIGINT) AS prior_n, round(coalesce(sum(total) OVER w, 0), 4) AS prior_total
FROM d, x WHERE day < last WINDOW w AS (PARTITION BY unit_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
)
def prior_day_stream(spark, sf_dir):
    """What every unit had before each closed day; the last day is still open when the files end."""
    root, table = store.workspace(spark), spark.read.parquet(f"{sf_dir}/events.parquet")
    # A pattern, since a stream's plain path must be a folder and a table may be a single file.
    stream = spark.readStream.schema(table.schema).parquet(f"{sf_dir}/events.parque[t]").select(F.col("user_id").alias("unit_id"), "ts", "value")
    run = prior.prior_totals(stream).writeStream.format("parquet").option("path", f"{root}/prior").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    out = spark.read.schema(prior.RESULT).parquet(f"{root}/prior")
    return out.select("unit_id", F.col("day").cast("string").alias("day"), "n", F.round("total", 4).alias("total"), "prior_n", F.round("prior_total", 4).alias("prior_total"))
