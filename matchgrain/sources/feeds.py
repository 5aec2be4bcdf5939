"""Provider JSON read with explicit schemas: events, match sheets with line-ups and substitutions, players."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clock, real, unescaped

EVENTS = (
    "id long, eventId int, eventName string, subEventName string, matchId long, teamId long, playerId long, matchPeriod string, eventSec double, "
    "positions array<struct<x:double,y:double>>, tags array<struct<id:int>>"
)
SHEETS = (
    "wyId long, dateutc string, gameweek int, label string, status string, teamsData map<string,struct<side:string,score:int,formation:struct<"
    "lineup:array<struct<playerId:long>>,bench:array<struct<playerId:long>>,substitutions:array<struct<playerIn:long,playerOut:long,minute:int>>>>>"
)
#: Fixed values of the tag vocabulary.
GOAL, ASSIST, KEY_PASS, COUNTER, INTERCEPTION, DANGEROUS_LOSS, ACCURATE, NOT_ACCURATE = 101, 301, 302, 1901, 1401, 2001, 1801, 1802


def tagged(tag: int) -> F.Column:
    return F.exists("tags", lambda t: t["id"] == tag)


def read_events(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Provider events as neutral actions; a missing end copies the start, an unjudged action stays null.

    With ``lines`` a file holds one object a line, and large files are split.
    """
    raw = spark.read.schema(EVENTS).option("multiLine", not lines).json(path)
    start, end = F.try_element_at("positions", F.lit(1)), F.try_element_at("positions", F.lit(2))
    return raw.select(
        F.col("id").alias("event_id"), F.col("matchId").alias("game_id"), F.col("teamId").alias("team_id"), F.coalesce("playerId", F.lit(0)).alias("player_id"),
        F.col("matchPeriod").alias("period"), F.col("eventSec").alias("seconds"), F.lower("eventName").alias("type"), F.nullif(F.col("subEventName"), F.lit("")).alias("subtype"),
        (start.x / 100).alias("start_x"), (start.y / 100).alias("start_y"), F.coalesce(end.x / 100, start.x / 100).alias("end_x"), F.coalesce(end.y / 100, start.y / 100).alias("end_y"),
        F.when(tagged(ACCURATE), True).when(tagged(NOT_ACCURATE), False).alias("success"),
        tagged(GOAL).alias("goal"), tagged(ASSIST).alias("assist"), tagged(KEY_PASS).alias("key_pass"), tagged(COUNTER).alias("counter_attack"),
        tagged(INTERCEPTION).alias("interception"), tagged(DANGEROUS_LOSS).alias("dangerous_loss"),
    )


def read_sheets(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    raw = spark.read.schema(SHEETS).option("multiLine", not lines).json(path)
    return raw.select("wyId", "dateutc", "gameweek", "label", "status", F.explode(F.map_entries("teamsData")).alias("team"))


def matches(sheets: DataFrame) -> DataFrame:
    side = F.col("team.value.side")
    return sheets.groupBy(F.col("wyId").alias("game_id"), F.col("dateutc").alias("date"), "gameweek", "label", "status").agg(
        F.max(F.when(side == "home", F.col("team.key").cast("long"))).alias("home_team_id"), F.max(F.when(side == "away", F.col("team.key").cast("long"))).alias("away_team_id")
    )


def minutes_played(sheets: DataFrame) -> DataFrame:
    """Starters play until they are replaced (or 90), substitutes from their entry to 90, never below 0."""
    team = sheets.select(F.col("wyId").alias("game_id"), F.col("team.key").cast("long").alias("team_id"), F.col("team.value.formation").alias("f"))
    changes = team.select("game_id", "team_id", F.explode("f.substitutions").alias("s"))
    off = changes.select("game_id", "team_id", F.col("s.playerOut").alias("player_id"), F.col("s.minute").alias("off"))
    started = team.select("game_id", "team_id", F.explode("f.lineup.playerId").alias("player_id")).join(off, ["game_id", "team_id", "player_id"], "left")
    started = started.select("game_id", "team_id", "player_id", F.lit(True).alias("started"), F.coalesce("off", F.lit(90)).alias("minutes"))
    entered = changes.select("game_id", "team_id", F.col("s.playerIn").alias("player_id"), F.lit(False).alias("started"), F.greatest(F.lit(0), 90 - F.col("s.minute")).alias("minutes"))
    return started.unionByName(entered.where("player_id > 0"))


def read_players(spark: SparkSession, path: str) -> DataFrame:
    r"""The players file: ``\uXXXX`` left in names is decoded, "null" and "" are missing."""
    raw = spark.read.schema("wyId long, firstName string, lastName string, birthDate string, currentTeamId string, role struct<code2:string>, foot string").json(path)
    name = lambda c: unescaped(F.coalesce(real(F.col(c)), F.lit("")))
    return raw.select(
        F.col("wyId").alias("player_id"), F.trim(F.concat_ws(" ", name("firstName"), name("lastName"))).alias("name"), real(F.col("birthDate")).try_cast("date").alias("born"),
        real(F.col("currentTeamId")).try_cast("long").alias("team_id"), real(F.col("role.code2")).alias("position"), real(F.col("foot")).alias("foot"),
    )


#: Families of tags of which an event may carry one; two of a family say nothing.
BODY = {401: "left foot", 402: "right foot", 403: "head or body"}


def exactly_one(family: dict[int, str]) -> F.Column:
    """The name of the only tag of a family that an event carries."""
    ids = F.array_distinct(F.transform("tags", lambda t: t["id"]))
    met = F.array_intersect(ids, F.array(*[F.lit(k) for k in family]))
    names = F.create_map(*[F.lit(x) for kv in family.items() for x in kv])
    return F.when(F.size(met) == 1, names[met[0]])


def first_of(family: dict[int, str]) -> F.Column:
    """The name of the first tag of a family, in the event's own order."""
    names = F.create_map(*[F.lit(x) for kv in family.items() for x in kv])
    return F.try_element_at(F.filter(F.transform("tags", lambda t: names[t["id"]]), lambda n: n.isNotNull()), F.lit(1))


#: Fixed values of a shot's tags, in the order in which they decide.
OUTCOMES = ((GOAL, "goal"), (2101, "blocked"), (1223, "woodwork"), (1216, "off target"))


def shot_outcome() -> F.Column:
    out = F.when(tagged(OUTCOMES[0][0]), OUTCOMES[0][1])
    for tag, name in OUTCOMES[1:]:
        out = out.when(tagged(tag), name)
    return out.otherwise("on target")


def tag_rows(raw: DataFrame) -> DataFrame:
    """A side table of each event's tags: sorted distinct ids, body part by two readings, a shot's outcome."""
    return raw.select(
        F.col("id").alias("event_id"), F.array_sort(F.array_distinct(F.transform("tags", lambda t: t["id"].cast("short")))).alias("tags"),
        exactly_one(BODY).alias("body_part"), first_of(BODY).alias("first_body_part"), F.when(F.col("eventName") == "Shot", shot_outcome()).alias("outcome"),
    )


def squads(sheets: DataFrame) -> DataFrame:
    """One row a listed player: started, came on, went off; who is replaced twice, or comes on twice, contradicts the sheet."""
    team = sheets.select(F.col("wyId").alias("game_id"), F.col("team.key").cast("long").alias("team_id"), F.col("team.value.formation").alias("f"))
    listed = team.select("game_id", "team_id", F.explode("f.lineup.playerId").alias("player_id"), F.lit(True).alias("started"))
    listed = listed.unionByName(team.select("game_id", "team_id", F.explode("f.bench.playerId").alias("player_id"), F.lit(False).alias("started")))
    change = team.select("game_id", "team_id", F.explode("f.substitutions").alias("s"))
    key = ["game_id", "team_id", "player_id"]
    on = change.groupBy("game_id", "team_id", F.col("s.playerIn").alias("player_id")).agg(F.min("s.minute").alias("on"), F.count("*").alias("n_on"))
    off = change.groupBy("game_id", "team_id", F.col("s.playerOut").alias("player_id")).agg(F.min("s.minute").alias("off"), F.count("*").alias("n_off"))
    wrong = (F.coalesce("n_on", F.lit(0)) > 1) | (F.coalesce("n_off", F.lit(0)) > 1) | (F.col("started") & F.col("on").isNotNull())
    return listed.join(on, key, "left").join(off, key, "left").select(*key, "started", "on", "off", F.coalesce(wrong, F.lit(False)).alias("contradiction"))


MATCH_EVENTS = "id string, index long, period int, timestamp string, type struct<name:string>, team struct<id:long>, player struct<id:long>, location array<double>, pass struct<end_location:array<double>,outcome:struct<name:string>>, shot struct<outcome:struct<name:string>>"
#: The second provider's pitch, and how its types read.
LENGTH, WIDTH = 120.0, 80.0
KINDS = {"Pass": "pass", "Carry": "touch", "Duel": "duel", "Shot": "shot"}


def read_match_files(spark: SparkSession, path: str) -> DataFrame:
    """The second provider's events, one file (or folder) a match, named by it; unit coordinates, an outcome means failure."""
    raw = spark.read.schema(MATCH_EVENTS).json(path)
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])
    end = F.coalesce(F.col("pass.end_location"), F.col("location"))
    at = lambda a, i, of: F.try_element_at(a, F.lit(i)) / of
    return raw.select(
        F.regexp_extract(F.col("_metadata.file_path"), r"match(?:%3D|=|_)?(\d+)", 1).cast("long").alias("game_id"), F.col("index").alias("event_id"), "period", clock(F.col("timestamp")).alias("seconds"),
        F.coalesce(kind[F.col("type.name")], F.lit("other")).alias("type"), F.col("team.id").alias("team_id"), F.coalesce("player.id", F.lit(0)).alias("player_id"),
        at(F.col("location"), 1, LENGTH).alias("start_x"), at(F.col("location"), 2, WIDTH).alias("start_y"), at(end, 1, LENGTH).alias("end_x"), at(end, 2, WIDTH).alias("end_y"),
        F.when(F.col("type.name") == "Pass", F.col("pass.outcome.name").isNull()).alias("success"), F.coalesce(F.col("shot.outcome.name") == "Goal", F.lit(False)).alias("goal"),
    )


REPORT = "fixture struct<id:long,status:string>, events array<struct<minute:int,kind:string,team:long,player:long>>, statistics array<struct<team:long,name:string,value:string>>"


def report_statistics(reports: DataFrame) -> DataFrame:
    """One row a reported statistic; percentages lose their sign, and what was not reported stays missing, not zero."""
    s = reports.select(F.col("fixture.id").alias("game_id"), F.explode_outer("statistics").alias("s"))
    return s.select("game_id", F.col("s.team").alias("team_id"), F.col("s.name").alias("name"), F.replace(F.col("s.value"), F.lit("%"), F.lit("")).try_cast("double").alias("value"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``file, bytes, sha256`` of every file below a folder, read where the files are."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
