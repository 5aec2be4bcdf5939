"""Evidence classes, licences, lifecycle stages and the quality listing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import worlds as ws
from ..operators.evidence import POSTURES, spread, sum_kind, weakest
from ..sources import neutral
from .players import RATES, construct_rates_declared
from .registry import query
from .statistics import PM, SEED, WORLDS, per_match


@query(
    PM + ", " + ws.weights_sql("pm", WORLDS, SEED) + """, x AS (SELECT player_id, w, sum(g * k) / nullif(sum(d * k), 0) AS a, sum(n * k) / nullif(sum(d * k), 0) AS b FROM pm JOIN mw USING (game_id) GROUP BY ALL),
s AS (SELECT player_id, count(*) AS draws, stddev_samp(a + b) AS same, sqrt(var_samp(a) + var_samp(b)) AS apart FROM x WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY player_id HAVING count(*) > 1)
SELECT player_id, CASE player_id % 3 WHEN 0 THEN 'observed' WHEN 1 THEN 'modelled' ELSE 'derived' END AS kind, CASE player_id % 3 WHEN 0 THEN 'observed' WHEN 1 THEN 'modelled' ELSE 'derived' END AS sum_kind,
  draws, round(CASE WHEN player_id % 2 = 0 THEN same ELSE apart END, 6) AS error FROM s"""
)
def combined_evidence(spark, sf_dir):
    """Two figures of a player added up: the weaker class, and an error from shared draws only where the worlds are the same."""
    pm, w = per_match(spark, sf_dir), ws.match_weights(per_match(spark, sf_dir), WORLDS, SEED)
    a, b = ws.ratios(pm, w, "player_id", "g", "d").withColumnRenamed("x", "a"), ws.ratios(pm, w, "player_id", "n", "d").withColumnRenamed("x", "b")
    x = a.join(b, ["player_id", "w"]).dropna().groupBy("player_id").agg(F.array_sort(F.collect_list(F.struct("w", "a", "b"))).alias("x")).where("size(x) > 1")
    p = F.col("player_id")
    x = x.select("player_id", F.size("x").cast("long").alias("draws"), F.col("x.a").alias("a"), F.col("x.b").alias("b"), F.when(p % 3 == 1, "modelled").otherwise("observed").alias("ka"), F.when(p % 3 == 2, "derived").otherwise("observed").alias("kb"), F.when(p % 2 == 0, "worlds").otherwise("other").alias("key"))
    kinds = [F.col("ka"), F.col("kb")]
    return x.select("player_id", weakest(kinds).alias("kind"), sum_kind(kinds).alias("sum_kind"), "draws", F.round(spread(F.col("a"), F.col("b"), F.lit("worlds"), F.col("key")), 6).alias("error"))


@query("SELECT provider, use, provider = 'open-events' OR (provider = 'research-only' AND use = 'ingest') AS allowed FROM (SELECT DISTINCT ['open-events', 'research-only', 'unlisted'][c_custkey % 3 + 1] AS provider, ['ingest', 'host', 'commit'][c_custkey // 3 % 3 + 1] AS use FROM customer)")
def licence_table(spark, sf_dir):
    """What every provider of a request log allows."""
    pick = lambda names, k: F.element_at(F.array(*map(F.lit, names)), k.cast("int") + 1)
    k = F.col("c_custkey")
    r = spark.read.parquet(f"{sf_dir}/customer.parquet").select(pick(("open-events", "research-only", "unlisted"), k % 3).alias("provider"), pick(("ingest", "host", "commit"), F.floor(k / 3) % 3).alias("use")).distinct()
    allowed = F.lit(False)
    for provider, uses in POSTURES.items():
        allowed = allowed | ((F.col("provider") == provider) & F.col("use").isin(*sorted(uses)))
    return r.select("provider", "use", allowed.alias("allowed"))


@query("SELECT o_orderpriority AS metric, count(*) AS n, CASE WHEN count(*) < 50 THEN 'proposed' WHEN avg(CAST(o_orderstatus = 'F' AS INTEGER)) < 0.1 THEN 'retired' WHEN max(abs(o_totalprice)) > 400000 AND avg(CAST(o_orderstatus = 'P' AS INTEGER)) > 0.4 THEN 'confounded' ELSE 'served' END AS stage FROM orders GROUP BY o_orderpriority")
def lifecycle_stages(spark, sf_dir):
    """The stage of each metric: the first rule that holds."""
    share = lambda s: F.avg((F.col("o_orderstatus") == s).cast("int"))
    stage = F.when(F.count("*") < 50, "proposed").when(share("F") < 0.1, "retired").when((F.max(F.abs("o_totalprice")) > 400000) & (share("P") > 0.4), "confounded").otherwise("served")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy(F.col("o_orderpriority").alias("metric")).agg(F.count("*").alias("n"), stage.alias("stage"))


@query(neutral.SQL + RATES + ", k AS (SELECT player_id, progression FROM rates JOIN players USING (player_id) WHERE minutes >= 90 AND position <> 'GK' AND progression IS NOT NULL) SELECT player_id, progression, row_number() OVER (ORDER BY progression DESC, player_id) AS place, (SELECT min(progression) FROM k) AS lowest, (SELECT max(progression) FROM k) AS highest FROM k QUALIFY place <= 25")
def explore_quality(spark, sf_dir):
    """The 25 highest values of a quality construct, ties by id, with the range over all players."""
    r = construct_rates_declared(spark, sf_dir).where("minutes >= 90 and position <> 'GK' and progression is not null").select("player_id", F.round("progression", 6).alias("progression"))
    span = r.agg(F.min("progression").alias("lowest"), F.max("progression").alias("highest"))
    top = r.orderBy(F.desc("progression"), "player_id").limit(25)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("progression"), "player_id")).cast("long")).join(F.broadcast(span))  # twenty-five rows
