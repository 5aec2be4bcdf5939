"""Tables that are written to the store and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import neutral, store
from .registry import query

#: Days of a competition belong to it by turns.
COMPETITION = "'c' || (game_id % 3)"


def published(spark, sf_dir) -> str:
    root = store.workspace(spark)
    a = neutral.actions(spark, sf_dir).withColumn("competition", F.concat(F.lit("c"), F.col("game_id") % 3)).withColumn("provider", F.lit(store.PROVIDER))
    minutes = neutral.lineups(a).withColumn("competition", F.concat(F.lit("c"), F.col("game_id") % 3))
    schemas = {"actions": ("event_id bigint", "game_id bigint", "type string"), "lineups": ("player_id", "minutes")}
    store.publish(spark, root, {"actions": a, "lineups": minutes}, schemas, {"actions": "event_id"})
    return root


@query(neutral.SQL + f" SELECT 'actions' AS \"table\", {COMPETITION} AS competition, count(*) AS rows FROM actions GROUP BY ALL UNION ALL SELECT 'lineups', {COMPETITION}, count(*) FROM lineups GROUP BY ALL")
def store_manifest(spark, sf_dir):
    """What was published: one line a table and competition, written after the tables."""
    return store.manifest(spark, published(spark, sf_dir)).select("table", "competition", "rows")


@query(neutral.SQL + f" SELECT event_id, game_id, player_id, type, key_pass FROM actions WHERE {COMPETITION} = 'c1' AND type = 'pass'")
def stored_actions(spark, sf_dir):
    """A projected, verified scan of one partition, with a filter that reaches the files."""
    root = published(spark, sf_dir)
    return store.load(spark, root, "actions", "c1", ["event_id", "game_id", "player_id", "type", "key_pass"], verify=True).where("type = 'pass'")


@query(neutral.SQL + f" SELECT {COMPETITION} AS competition FROM actions INTERSECT SELECT {COMPETITION} FROM lineups")
def stored_competitions(spark, sf_dir):
    root = published(spark, sf_dir)
    return spark.createDataFrame([(c,) for c in store.competitions(spark, root, ["actions", "lineups"])], "competition string")


@query(neutral.SQL + " SELECT event_id, row_number() OVER (PARTITION BY game_id ORDER BY CASE period WHEN '1H' THEN 1 ELSE 2 END, seconds, event_id) AS place FROM actions")
def canonical_places(spark, sf_dir):
    """Each action's place in the canonical order of its match."""
    from pyspark.sql import Window

    order = Window.partitionBy("game_id").orderBy(F.when(F.col("period") == "1H", 1).otherwise(2), "seconds", "event_id")
    return neutral.actions(spark, sf_dir).select("event_id", F.row_number().over(order).cast("long").alias("place"))


@query(neutral.SQL + " SELECT event_id, game_id, type, event_id % 4 AS zone, event_id % 3 = 0 AS pressed FROM actions")
def attached_side_table(spark, sf_dir):
    """One-to-one join with a side table, refused unless both sides have every key once."""
    a = neutral.actions(spark, sf_dir)
    side = a.select("event_id", (F.col("event_id") % 4).alias("zone"), (F.col("event_id") % 3 == 0).alias("pressed"))
    return store.attach(a.select("event_id", "game_id", "type"), side, "event_id", ["zone", "pressed"])


@query(neutral.SQL + " SELECT player_id, team_id, position FROM players")
def cached_players(spark, sf_dir):
    """Made at the first reading, read from the shared folder from then on."""
    path = store.workspace(spark)
    for _ in range(2):
        out = store.read_through(spark, path, lambda: neutral.players(neutral.actions(spark, sf_dir)))
    return out


@query(neutral.SQL + " SELECT player_id, CAST(sum(minutes) AS BIGINT) AS minutes FROM lineups GROUP BY player_id")
def bundled_minutes(spark, sf_dir):
    """A JSON bundle with its version; another version is refused."""
    path = store.workspace(spark)
    store.write_bundle(neutral.lineups(neutral.actions(spark, sf_dir)).groupBy("player_id").agg(F.sum("minutes").alias("minutes")), path, "v2")
    return store.read_bundle(spark, path, "player_id long, minutes long", "v2")


@query(neutral.SQL + f" SELECT {COMPETITION} AS competition, 'only ours' AS side, count(*) AS n, min(event_id) AS least FROM actions WHERE start_x = 0 OR success IS NULL GROUP BY ALL")
def sidecar_differences(spark, sf_dir):
    """Events of the published actions that a sidecar, which leaves out unjudged ones, does not have."""
    root = published(spark, sf_dir)
    every = [store.load(spark, root, "actions", c, ["event_id", "start_x", "success"]).withColumn("competition", F.lit(c)) for c in store.competitions(spark, root, ["actions"])]
    ours = every[0]
    for e in every[1:]:
        ours = ours.unionByName(e)
    return store.key_differences(ours, ours.where("start_x <> 0 and success is not null"), "event_id", "competition")
