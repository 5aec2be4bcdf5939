"""Where every figure of a player, a position and a squad comes from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import provenance as P
from ..sources import neutral
from .registry import query
from .statistics import PM, per_match

ASSUMPTIONS = ("minutes follow from counts", "players of a position are exchangeable")
#: What each kind of figure is at best, and what it assumes.
RULES = {"count": ("OBSERVED", None), "minutes": ("REPORTED", ASSUMPTIONS[0]), "sum": ("OBSERVED", None), "rate": ("DERIVED", None), "prior": ("MODELLED", ASSUMPTIONS[1]), "shrunk": ("MODELLED", None), "squad": ("DERIVED", None)}

_BITS = "CASE op " + " ".join(f"WHEN '{n}' THEN {0 if a is None else 1 << ASSUMPTIONS.index(a)}" for n, (_, a) in RULES.items()) + " END"
_CLASS = "CASE op " + " ".join(f"WHEN '{n}' THEN {P.CLASSES.index(c)}" for n, (c, _) in RULES.items()) + " END"
_NAMES = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN assumed & {1 << i} <> 0 THEN '{a}' END" for i, a in enumerate((*ASSUMPTIONS, P.INDEPENDENT))) + "], lambda x: x IS NOT NULL), '; ')"

# Reachability in the oracle: every node with all that it rests on.
GRAPH = PM.replace("WITH ev AS", "WITH RECURSIVE ev AS", 1) + f""", who AS (SELECT player_id, coalesce(position, 'none') AS position, player_id // 24 AS squad FROM players),
e0 AS (SELECT 'sum:' || player_id AS node, 'count:' || player_id || ':' || game_id AS input FROM pm UNION ALL SELECT 'rate:' || player_id, 'sum:' || player_id FROM who UNION ALL SELECT 'rate:' || player_id, 'minutes:' || player_id FROM who
  UNION ALL SELECT 'prior:' || position, 'rate:' || player_id FROM who UNION ALL SELECT 'shrunk:' || player_id, 'rate:' || player_id FROM who UNION ALL SELECT 'shrunk:' || player_id, 'prior:' || position FROM who
  UNION ALL SELECT 'squad:' || squad, 'shrunk:' || player_id FROM who),
nd AS (SELECT node, split_part(node, ':', 1) AS op FROM (SELECT node FROM e0 UNION SELECT input FROM e0)), nc AS (SELECT node, op, {_CLASS} AS class, {_BITS} AS own, CASE WHEN op = 'count' THEN 'half ' || (CAST(split_part(node, ':', 2) AS BIGINT) % 2) END AS draw_key FROM nd),
up(node, anc) AS (SELECT node, node FROM nd UNION SELECT up.node, e0.input FROM up JOIN e0 ON e0.node = up.anc),
ch AS (SELECT up.node, max(a.class) AS class, bit_or(a.own) | CASE WHEN count(DISTINCT a.draw_key) > 1 THEN {1 << len(ASSUMPTIONS)} ELSE 0 END AS assumed, CASE WHEN count(DISTINCT a.draw_key) = 1 THEN min(a.draw_key) END AS draw_key, count(*) FILTER (WHERE a.op IN ('count', 'minutes')) AS sources FROM up JOIN nc a ON a.node = up.anc GROUP BY up.node)"""


def graph(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    pm = per_match(spark, sf_dir)
    who = neutral.players(neutral.actions(spark, sf_dir)).select("player_id", F.coalesce("position", F.lit("none")).alias("position"), F.expr("player_id div 24").alias("squad"))
    name = lambda op, *c: F.concat_ws(":", F.lit(op), *c)
    edge = lambda rows, a, b: rows.select(a.alias("node"), b.alias("input"))
    edges = edge(pm, name("sum", "player_id"), name("count", "player_id", "game_id"))
    for a, b in (("rate", "sum"), ("rate", "minutes"), ("shrunk", "rate")):
        edges = edges.unionByName(edge(who, name(a, "player_id"), name(b, "player_id")))
    edges = edges.unionByName(edge(who, name("prior", "position"), name("rate", "player_id"))).unionByName(edge(who, name("shrunk", "player_id"), name("prior", "position")))
    edges = P.cut(edges.unionByName(edge(who, name("squad", "squad"), name("shrunk", "player_id"))))
    op = F.split("node", ":")[0]
    nodes = edges.select("node").union(edges.select("input")).distinct().withColumn("op", op)
    kind, bits = P.operations(RULES, ASSUMPTIONS)
    key = F.when(F.col("op") == "count", F.concat(F.lit("half "), F.split("node", ":")[1].cast("long") % 2))
    return nodes.select("node", "op", kind.alias("class"), bits.alias("assumed"), key.alias("draw_key")), edges


_CLASS_NAME = "CASE class " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(P.CLASSES)) + " END"


@query(GRAPH + f" SELECT ch.node, {_CLASS_NAME} AS class, {_NAMES} AS assumptions, draw_key FROM ch JOIN nd USING (node) WHERE op <> 'count'")
def derivation_chains(spark, sf_dir):
    """The weakest evidence and all assumptions behind every figure, and the key of its draws if there is one."""
    nodes, edges = graph(spark, sf_dir)
    c = P.chains(nodes, edges, ASSUMPTIONS)
    return c.where(~F.col("node").startswith("count:")).select("node", P.class_name().alias("class"), P.assumption_names(ASSUMPTIONS).alias("assumptions"), "draw_key")


@query(
    GRAPH + """, paths(node, anc) AS (SELECT node, node FROM nd WHERE op = 'squad' UNION ALL SELECT paths.node, e0.input FROM paths JOIN e0 ON e0.node = paths.anc)
SELECT node, count(*) AS paths FROM paths WHERE split_part(anc, ':', 1) IN ('count', 'minutes') GROUP BY node"""
)
def source_paths(spark, sf_dir):
    """Over how many ways each squad's figure goes back to a source."""
    nodes, edges = graph(spark, sf_dir)
    return P.chains(nodes, edges, ASSUMPTIONS).where(F.col("node").startswith("squad:")).select("node", "paths")
