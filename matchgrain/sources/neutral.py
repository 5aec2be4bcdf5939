"""The neutral action schema: read from event logs, with the SQL of the same reading for the oracle.

A null ``success`` means that nobody judged the action; it is neither true nor false. Player 0 is nobody.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Days are matches; the first is match 0.
FIRST_DAY = "2024-01-01"
#: How the event log's types read.
TYPES = {"click": "pass", "view": "touch", "error": "duel", "signup": "set_piece", "purchase": "shot"}
POSITIONS = ("GK", "DF", "MD", "FW")

SQL = f"""
WITH ev AS (
  SELECT event_id, ts, user_id, value, CAST(date_diff('day', DATE '{FIRST_DAY}', CAST(ts AS DATE)) AS BIGINT) AS game_id,
    CASE WHEN hour(ts) < 12 THEN '1H' ELSE '2H' END AS period,
    CAST((hour(ts) % 12) * 3600 + minute(ts) * 60 + second(ts) AS DOUBLE) AS seconds,
    CASE WHEN user_id % 37 = 0 THEN 0 ELSE user_id END AS player_id, user_id % 2 AS team_id,
    CASE event_type WHEN 'click' THEN 'pass' WHEN 'view' THEN 'touch' WHEN 'error' THEN 'duel' WHEN 'signup' THEN 'set_piece' ELSE 'shot' END AS type,
    least(value / 150.0, 1.0) AS start_x, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) / 100.0 AS start_y,
    CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 5 <> 0 END AS success
  FROM events
), actions AS (
  SELECT event_id, ts, game_id, period, seconds, player_id, team_id, type, start_x, start_y,
    coalesce(lead(start_x) OVER w, start_x) AS end_x, coalesce(lead(start_y) OVER w, start_y) AS end_y, success,
    type = 'shot' AND event_id % 4 = 0 AS goal, type = 'pass' AND coalesce(lead(type) OVER w, '') = 'shot' AS key_pass,
    event_id % 11 = 0 AS dangerous_loss, event_id % 101 = 0 AS dismissal, event_id % 97 = 0 AS own_goal
  FROM ev WINDOW w AS (PARTITION BY game_id, team_id ORDER BY ts, event_id)
), lineups AS (
  SELECT game_id, team_id, player_id, least(90, 10 * count(*)) AS minutes, count(*) >= 3 AS started FROM actions WHERE player_id <> 0 GROUP BY ALL
), players AS (
  SELECT player_id, min(team_id) AS team_id, CASE WHEN player_id % 41 = 0 THEN NULL WHEN player_id % 4 = 0 THEN 'GK' WHEN player_id % 4 = 1 THEN 'DF'
    WHEN player_id % 4 = 2 THEN 'MD' ELSE 'FW' END AS position FROM actions WHERE player_id <> 0 GROUP BY player_id
), gained AS (
  SELECT *, pow((least(15, CAST(floor(end_x * 16) AS INTEGER)) + 1) / 16.0, 2) - pow((least(15, CAST(floor(start_x * 16) AS INTEGER)) + 1) / 16.0, 2) AS delta FROM actions
)
"""


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    base = e.select(
        "event_id",
        "ts",
        F.datediff("ts", F.lit(FIRST_DAY)).cast("long").alias("game_id"),
        F.when(F.hour("ts") < 12, "1H").otherwise("2H").alias("period"),
        (F.hour("ts") % 12 * 3600 + F.minute("ts") * 60 + F.second("ts")).cast("double").alias("seconds"),
        F.when(F.col("user_id") % 37 == 0, 0).otherwise(F.col("user_id")).alias("player_id"),
        (F.col("user_id") % 2).alias("team_id"),
        kind[F.col("event_type")].alias("type"),
        F.least(F.col("value") / 150.0, F.lit(1.0)).alias("start_x"),
        (F.regexp_extract("props", "([0-9]+)", 1).cast("int") / 100.0).alias("start_y"),
        F.when(F.col("event_id") % 7 != 0, F.col("event_id") % 5 != 0).alias("success"),
    )
    # A team's actions of one match: bounded by the length of a match, so one window is enough.
    nxt = Window.partitionBy("game_id", "team_id").orderBy("ts", "event_id")
    return base.select(
        "*",
        F.coalesce(F.lead("start_x").over(nxt), "start_x").alias("end_x"),
        F.coalesce(F.lead("start_y").over(nxt), "start_y").alias("end_y"),
        ((F.col("type") == "shot") & (F.col("event_id") % 4 == 0)).alias("goal"),
        ((F.col("type") == "pass") & (F.coalesce(F.lead("type").over(nxt), F.lit("")) == "shot")).alias("key_pass"),
        (F.col("event_id") % 11 == 0).alias("dangerous_loss"),
        (F.col("event_id") % 101 == 0).alias("dismissal"),
        (F.col("event_id") % 97 == 0).alias("own_goal"),
    )


def lineups(acts: DataFrame) -> DataFrame:
    return acts.where("player_id <> 0").groupBy("game_id", "team_id", "player_id").agg(F.least(F.lit(90), 10 * F.count("*")).alias("minutes"), (F.count("*") >= 3).alias("started"))


def players(acts: DataFrame) -> DataFrame:
    position = F.when(F.col("player_id") % 41 == 0, None).otherwise(F.element_at(F.array(*[F.lit(p) for p in POSITIONS]), (F.col("player_id") % 4 + 1).cast("int")))
    return acts.where("player_id <> 0").groupBy("player_id").agg(F.min("team_id").alias("team_id")).withColumn("position", position)
