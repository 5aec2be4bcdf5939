"""Derivation chains: what a result rests on, carried along every path from its sources.

Results are nodes of a directed graph without cycles, an edge table names what each is made of. A node's class is the weakest
of all that it rests on and of what its own operation makes of it (a sum of observations is one); assumptions add up along all
paths; draws stay usable only while everything that has draws has them under one key, and mixing keys is an assumption itself.

A round hands on what the last one has resolved, so each edge is joined once; a node is resolved when all its inputs have
reported. Inputs are folded by maxima, bit sums and counts before they are shuffled: a node may have any number of them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut

#: Classes of evidence, strongest first.
CLASSES = ("OBSERVED", "REPORTED", "DERIVED", "MODELLED")
#: The assumption that is made by combining draws of different keys.
INDEPENDENT = "draws of different keys are independent"

_FOLD = ("reported", "class", "assumed", "low_key", "high_key", "paths")


def _folded(rows: DataFrame) -> DataFrame:
    return rows.groupBy("node").agg(F.sum("reported").alias("reported"), F.max("class").alias("class"), F.bit_or("assumed").alias("assumed"), F.min("low_key").alias("low_key"), F.max("high_key").alias("high_key"), F.sum("paths").alias("paths"))


def chains(nodes: DataFrame, edges: DataFrame, assumptions: Sequence[str]) -> DataFrame:
    """``node, class, assumed, draw_key, depth, paths`` of every node; one that rests on a cycle or on an unknown node has no class.

    ``nodes``: node, class (the least its operation makes of it, as a number in ``CLASSES``), assumed (bits in
    ``assumptions``), draw_key (of a source with draws). ``edges``: node, input. ``paths`` counts ways back to a source.
    """
    mixed = 1 << len(assumptions)
    own = nodes.select("node", F.col("class").alias("own_class"), F.col("assumed").alias("own_assumed"), "draw_key")
    degree = edges.groupBy("node").agg(F.count("*").alias("degree"))
    own = cut(own.join(degree, "node", "left"))
    source = own.where("degree is null")
    fresh = cut(source.select("node", F.col("own_class").alias("class"), F.col("own_assumed").cast("long").alias("assumed"), F.col("draw_key").alias("low_key"), F.col("draw_key").alias("high_key"), F.lit(1).cast("long").alias("paths"), F.lit(0).alias("depth")))
    waiting, done, depth = None, fresh, 0
    while not fresh.isEmpty():
        depth += 1
        news = edges.join(fresh.withColumnRenamed("node", "input"), "input").select("node", F.lit(1).cast("long").alias("reported"), "class", "assumed", "low_key", "high_key", "paths")
        waiting = cut(_folded(news) if waiting is None else _folded(waiting.unionByName(_folded(news))))
        ready = waiting.join(own, "node").where(F.col("reported") == F.col("degree"))
        keys = F.when(F.col("low_key") != F.col("high_key"), mixed).otherwise(0)
        fresh = ready.select("node", F.greatest("class", "own_class").alias("class"), F.col("assumed").bitwiseOR(F.col("own_assumed").cast("long")).bitwiseOR(keys.cast("long")).alias("assumed"), "low_key", "high_key", "paths", F.lit(depth).alias("depth"))
        fresh = cut(fresh)
        waiting = cut(waiting.join(fresh.select("node"), "node", "left_anti"))
        done = done.unionByName(fresh)
    one = F.when(F.col("low_key") == F.col("high_key"), F.col("low_key"))
    return own.select("node").join(done, "node", "left").select("node", "class", "assumed", one.alias("draw_key"), "depth", "paths")


def class_name(column: str = "class") -> Column:
    return F.coalesce(F.element_at(F.array(*[F.lit(c) for c in CLASSES]), F.col(column) + 1), F.lit("UNRESOLVED"))


def assumption_names(assumptions: Sequence[str], column: str = "assumed") -> Column:
    every = [*assumptions, INDEPENDENT]
    return F.concat_ws("; ", *[F.when(F.col(column).bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(a)) for i, a in enumerate(every)])


def operations(rules: Mapping[str, tuple[str, str | None]], assumptions: Sequence[str], op: str = "op") -> tuple[Column, Column]:
    """The class and the assumption bits that each operation brings along."""
    kind, bits = F.lit(0), F.lit(0)
    for name, (least, assumed) in rules.items():
        kind = F.when(F.col(op) == name, CLASSES.index(least)).otherwise(kind)
        bits = F.when(F.col(op) == name, 0 if assumed is None else 1 << assumptions.index(assumed)).otherwise(bits)
    return kind, bits
