"""The prefix trie of conversations, encoded by preorder intervals.

Distinct conversations are ranked lexicographically (by their turns' digests, any fixed order of symbols will do); a node is
met first by the conversation of rank ``first_rank`` and last by that of rank ``last_rank``. Nodes in the order of (first
rank, depth) stand in preorder, a subtree is an interval of it, and its end is the last node of the conversation ranked
``last_rank``. Sums over a subtree are then differences of two prefix sums, taken by a distributed scan.

A turn is known by 128 bits of its role and text, a node by 128 bits of its turns in order.

Defined results: a null role or text is empty; equal turn numbers go by role, then text; rows without conv_id belong to no
conversation and take no part; an empty table gives no rows, not even a root; further columns do not matter. A
conversation's turns (16 bytes each), as its text would, fit a row; the number of conversations at a node is not bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, partitions, remove, short, stored
from .prefix_sums import running

#: Conversations that share openings: those of one hundred ids, each with so many turns of the first at most.
SHARED, MOST_TURNS = 100, 5
#: Ids of a node's conversations that travel as one row.
ID_BLOCK = 10_000
NO_ENDS = hashlib.sha256(b"").hexdigest()


def conversation_paths(conversations: DataFrame) -> DataFrame:
    """``conv_id, symbols, chars``: each conversation's turns in order, as digests and as code points of their texts."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = conversations.where(F.col("conv_id").isNotNull()).select("conv_id", "turn", role.alias("role"), text.alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    symbol = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))))
    rows = rows.select("conv_id", F.row_number().over(order).alias("at"), symbol.alias("symbol"), F.length("text").alias("chars"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("at", "symbol", "chars"))).alias("turns"))
    return turns.select("conv_id", F.col("turns.symbol").alias("symbols"), F.col("turns.chars").alias("chars"))


def share_openings(paths: DataFrame) -> DataFrame:
    """The first h turns of conversation ``c - c % 100`` in the place of the first h of c, ``h = crc32(c) % 6``."""
    first = paths.select(F.col("conv_id").alias("base"), F.slice("symbols", 1, MOST_TURNS).alias("base_symbols"), F.slice("chars", 1, MOST_TURNS).alias("base_chars"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % (MOST_TURNS + 1)).cast("int")
    both = paths.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARED).join(first.where(F.col("base") % SHARED == 0), "base", "left").withColumn("h", h)

    def rebuilt(c: str):
        head = F.when(F.col(f"base_{c}").isNull(), F.slice(c, 1, 0)).otherwise(F.slice(f"base_{c}", F.lit(1), F.col("h")))
        return F.concat(head, F.slice(c, F.col("h") + 1, F.size(c))).alias(c)

    return both.select("conv_id", rebuilt("symbols"), rebuilt("chars"))


def _key(symbols: str):
    return F.unhex(F.md5(F.array_join(F.transform(symbols, F.hex), "")))


def prefixes(ranked: DataFrame) -> DataFrame:
    """A row for each conversation and depth: the node's key, its parent's, and what the conversation adds to it."""
    schema = "key binary, parent binary, depth long, chars long, rank long, n long, least long, ends boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in short(batches, 200):
            key, parent, depth, chars, ends, times = [], [], [], [], [], []
            for symbols, sizes in zip(batch.column("symbols").to_pylist(), batch.column("chars").to_pylist(), strict=True):
                md = hashlib.md5()
                up, here = None, md.digest()
                for d in range(len(symbols) + 1):
                    if d:
                        md.update(symbols[d - 1].hex().upper().encode())
                        up, here = here, md.digest()
                    key.append(here)
                    parent.append(up)
                    depth.append(d)
                    chars.append(sizes[d - 1] if d else 0)
                    ends.append(d == len(symbols))
                times.append(len(symbols) + 1)
            at = pa.array([i for i, t in enumerate(times) for _ in range(t)], pa.int32())
            own = [batch.column(c).take(at) for c in ("rank", "n", "least")]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.binary()), pa.array(parent, pa.binary()), pa.array(depth, pa.int64()), pa.array(chars, pa.int64()), *own, pa.array(ends, pa.bool_())], names=[c.split()[0] for c in schema.split(", ")])

    return ranked.select("symbols", "chars", "rank", "n", "least").mapInArrow(run, schema)


def ends_digest(ends: DataFrame, block: int = ID_BLOCK) -> DataFrame:
    """``key, ends_sha256`` of (key, conv_id): the SHA-256 of a key's ascending decimal ids, joined by commas.

    Ids are sorted over range partitions and joined to blocks there; a key's blocks then stream through one digest, in order,
    a block at a time.
    """
    n = partitions(ends.sparkSession)
    lined = ends.repartitionByRange(n, "key", "conv_id").sortWithinPartitions("key", "conv_id").withColumn("pid", F.spark_partition_id())

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        no = 0
        for batch in short(batches, block):
            rows: list[tuple[bytes, list[str]]] = []
            for k, c in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if not rows or rows[-1][0] != k:
                    rows.append((k, []))
                rows[-1][1].append(str(c))
            if rows:
                at = [*range(no, no + len(rows))]
                no += len(rows)
                pid = batch.column("pid")[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.binary()), pa.array([pid] * len(rows), pa.int32()), pa.array(at, pa.int64()), pa.array([",".join(c) for _, c in rows])], names=["key", "pid", "no", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha, out = None, None, []
        for batch in batches:
            for k, ids in zip(batch.column("key").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if k == key:
                    sha.update(b",")
                else:
                    if key is not None:
                        out.append((key, sha.hexdigest()))
                    key, sha = k, hashlib.sha256()
                sha.update(ids.encode())
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out])], names=["key", "ends_sha256"])
                out = []
        if key is not None:
            out.append((key, sha.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], names=["key", "ends_sha256"])

    blocks = lined.mapInArrow(join, "key binary, pid int, no long, ids string")
    return blocks.repartition(n, "key").sortWithinPartitions("key", "pid", "no").drop("pid", "no").mapInArrow(digest, "key binary, ends_sha256 string")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """One row per node of the trie over ``conv_id, symbols, chars``, with its preorder interval ``position .. subtree_end``."""
    spark = paths.sparkSession
    keyed, keyed_path = stored(paths.withColumn("key", _key("symbols")))
    distinct = keyed.groupBy("key").agg(F.first("symbols").alias("symbols"), F.first("chars").alias("chars"), F.count("*").alias("n"), F.min("conv_id").alias("least"))
    ranked = running(distinct.drop("key").withColumn("one", F.lit(1)), ["symbols"], {"rank": "one"})

    nodes = prefixes(ranked).groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("chars").alias("chars"), F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank"),
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"), F.max("ends").alias("ends"),
    )
    nodes, nodes_path = stored(nodes)
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = nodes.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saving", (F.col("n_convs") - 1) * F.col("chars")).withColumn("one", F.lit(1))
    placed, placed_path = stored(running(nodes, ["first_rank", "depth"], {"position": "one", "leaves_before": "leaf", "saved_before": "saving"}))
    # A conversation's last node is new with it, for a prefix of an earlier one would have come before that.
    closed = placed.where("ends").select(F.col("first_rank").alias("last_rank"), F.col("position").alias("subtree_end"), (F.col("leaves_before") + F.col("leaf")).alias("leaves_to"), (F.col("saved_before") + F.col("saving")).alias("saved_to"))
    spans = placed.join(closed, "last_rank").withColumn("n_leaves", F.col("leaves_to") - F.col("leaves_before")).withColumn("saved_tokens", F.col("saved_to") - F.col("saved_before"))
    parents = placed.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    ends = ends_digest(keyed.select("key", "conv_id"))
    out = spans.join(ends, "key", "left").join(parents, "parent", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))
    out = durable(out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "position", "subtree_end"))
    for path in (keyed_path, nodes_path, placed_path):
        remove(spark, path)
    return out


def op13_prefix_trie(spark, sf_dir: str) -> DataFrame:
    paths = share_openings(conversation_paths(spark.read.parquet(f"{sf_dir}/conversations.parquet")))
    return prefix_trie(paths).drop("position", "subtree_end")


OP13_SQL = """
WITH own AS (
  SELECT conv_id, list({r: coalesce(role, ''), t: coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), crc_table AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS f FROM range(256) AS r(i)
), short AS (
  SELECT conv_id, p, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, x: xor(c >> 8, f[CAST(xor(c, x) & 255 AS BIGINT) + 1])), 4294967295) % 6 AS BIGINT) AS h FROM own, crc_table
), rebuilt AS (
  SELECT s.conv_id, list_concat(coalesce(b.p[1:s.h], []), s.p[s.h + 1:]) AS p FROM short s LEFT JOIN own b ON b.conv_id = s.conv_id - s.conv_id % 100
), steps AS (
  SELECT conv_id, p AS whole, d, p[1:d] AS p FROM (SELECT conv_id, p, unnest(range(0, len(p) + 1)) AS d FROM rebuilt)
), node AS (
  SELECT p, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(whole) = d), '')) AS ends_sha256 FROM steps GROUP BY p
), child AS (SELECT p[1:depth - 1] AS p, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY 1),
sized AS (
  SELECT node.*, coalesce(n_children, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(node.p[depth].t) END AS saving
  FROM node LEFT JOIN child USING (p)
), up AS (SELECT p[1:a] AS p, n_children, saving FROM (SELECT *, unnest(range(0, depth + 1)) AS a FROM sized)),
sums AS (SELECT p, CAST(sum(CAST(n_children = 0 AS INTEGER)) AS BIGINT) AS n_leaves, CAST(sum(saving) AS BIGINT) AS saved_tokens FROM up GROUP BY p)
SELECT s.conv_id, CAST(s.depth AS BIGINT) AS depth, q.conv_id AS parent_conv_id, s.n_convs, s.n_children, n_leaves, saved_tokens, s.ends_sha256
FROM sized s JOIN sums USING (p) LEFT JOIN sized q ON q.p = s.p[1:s.depth - 1] AND s.depth > 0
"""
