"""The grid Markov value surface: counts on Spark, a fixed point over the cells (a constant number) on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import cell

N_X, N_Y = 16, 12


class NotConverged(ArithmeticError):
    """The fixed point was not reached; no last iterate is passed off as one."""


def fit_surface(acts: DataFrame, n_x: int = N_X, n_y: int = N_Y, most: int = 200, tolerance: float = 1e-7) -> np.ndarray:
    """Value of each cell: shoot and score, or move on; failed passes and dangerous losses end the possession."""
    n = n_x * n_y
    at, to = cell(F.col("start_x"), F.col("start_y"), n_x, n_y).alias("at"), cell(F.col("end_x"), F.col("end_y"), n_x, n_y).alias("to")
    moved = F.col("type").isin("pass", "touch") & F.coalesce("success", F.lit(False)) & ~F.col("dangerous_loss")
    lost = ((F.col("type") == "pass") & (F.col("success") == F.lit(False))) | F.col("dangerous_loss")
    rows = acts.select(at, to, F.coalesce(moved, F.lit(False)).alias("m"), (F.col("type") == "shot").alias("s"), F.col("goal").alias("g"), F.coalesce(lost, F.lit(False)).alias("l"))
    counts = rows.groupBy("at").agg(*[F.count_if(F.col(c)).alias(c) for c in "msgl"]).where("at is not null").collect()  # one row a cell
    moves = rows.where("m").groupBy("at", "to").count().where("at is not null and to is not null").collect()  # cells squared at most
    c = {k: np.zeros(n) for k in "msgl"}
    for r in counts:
        for k in "msgl":
            c[k][r["at"]] = r[k]
    total = np.maximum(c["m"] + c["s"] + c["l"], 1)
    transition = np.zeros((n, n))
    for r in moves:
        transition[r["at"], r["to"]] = r["count"]
    transition /= np.maximum(transition.sum(axis=1, keepdims=True), 1)
    score = c["s"] / total * c["g"] / np.maximum(c["s"], 1)
    value = np.zeros(n)
    for _ in range(most):
        new = score + c["m"] / total * (transition @ value)
        if np.abs(new - value).max() < tolerance:
            return new
        value = new
    raise NotConverged(f"the surface still moves after {most} rounds")


def surface_frame(spark, value: np.ndarray) -> DataFrame:
    """The surface as rows (one a cell), for a broadcast join: its size is that of the grid."""
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(value)], "cell int, value double")


def with_delta(acts: DataFrame, surface: DataFrame) -> DataFrame:
    a = surface.select(F.col("cell").alias("_s"), F.col("value").alias("_from"))
    b = surface.select(F.col("cell").alias("_e"), F.col("value").alias("_to"))
    placed = acts.withColumn("_s", cell(F.col("start_x"), F.col("start_y"))).withColumn("_e", cell(F.col("end_x"), F.col("end_y")))
    return placed.join(F.broadcast(a), "_s", "left").join(F.broadcast(b), "_e", "left").withColumn("delta", F.col("_to") - F.col("_from")).drop("_s", "_e", "_from", "_to")
