"""Measures that are registered from outside, their verdicts, and typed inputs for selections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extensions as X
from ..sources import neutral
from .elevens import SQUAD, squads
from .registry import query

LEAST_PLAYERS, BAR = 20, 0.0
NAMES = ["completed_share", "late_share", "shot_share"]


def _share(actions: DataFrame, top: F.Column, bottom: F.Column) -> DataFrame:
    own = actions.where("player_id <> 0").groupBy("player_id", F.col("game_id").cast("long").alias("game_id"))
    return own.agg(F.count_if(top).cast("double").alias("numerator"), F.count_if(bottom).cast("double").alias("denominator"))


@X.extension("completed_share")
def completed_share(actions: DataFrame) -> DataFrame:
    return _share(actions, (F.col("type") == "pass") & F.col("success"), F.col("type") == "pass")


@X.extension("late_share")
def late_share(actions: DataFrame) -> DataFrame:
    return _share(actions, F.col("period") == "2H", F.lit(True))


@X.extension("shot_share")
def shot_share(actions: DataFrame) -> DataFrame:
    return _share(actions, F.col("type") == "shot", F.lit(True))


_ONE = "SELECT '{0}' AS extension, player_id, game_id, CAST(count(*) FILTER (WHERE {1}) AS DOUBLE) AS numerator, CAST(count(*) FILTER (WHERE {2}) AS DOUBLE) AS denominator FROM actions WHERE player_id <> 0 GROUP BY player_id, game_id"
PARTS = neutral.SQL + ", parts AS (" + " UNION ALL ".join(_ONE.format(*x) for x in (("completed_share", "type = 'pass' AND success", "type = 'pass'"), ("late_share", "period = '2H'", "TRUE"), ("shot_share", "type = 'shot'", "TRUE"))) + f"""),
halves AS (SELECT extension, player_id, sum(numerator) FILTER (WHERE game_id % 2 = 0) / nullif(sum(denominator) FILTER (WHERE game_id % 2 = 0), 0) AS x, sum(numerator) FILTER (WHERE game_id % 2 = 1) / nullif(sum(denominator) FILTER (WHERE game_id % 2 = 1), 0) AS y FROM parts GROUP BY ALL),
rr AS (SELECT extension, count(*) AS players, CASE WHEN var_pop(x) > 1e-12 * avg(x * x) AND var_pop(y) > 1e-12 * avg(y * y) THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) END AS r FROM halves WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY extension),
vd AS (SELECT extension, players, 2 * r / (1 + r) AS reliability, CASE WHEN players < {LEAST_PLAYERS} OR r IS NULL THEN 'UNTESTED' WHEN 2 * r / (1 + r) >= {BAR} THEN 'SURVIVES' ELSE 'REJECTED' END AS status FROM rr)"""


def parts(spark, sf_dir) -> DataFrame:
    return X.all_components(neutral.actions(spark, sf_dir), NAMES)


@query(PARTS + " SELECT extension, players, round(reliability, 5) AS reliability, status FROM vd")
def extension_verdicts(spark, sf_dir):
    return X.verdicts(parts(spark, sf_dir), LEAST_PLAYERS, BAR).withColumn("reliability", F.round("reliability", 5))


@query(PARTS + " SELECT extension, player_id, count(*) AS matches, round(sum(numerator) / nullif(sum(denominator), 0), 6) AS value FROM parts WHERE extension IN (SELECT extension FROM vd WHERE status = 'SURVIVES') GROUP BY extension, player_id")
def extension_values(spark, sf_dir):
    """Pooled values of the extensions that are admitted."""
    p = parts(spark, sf_dir)
    return X.pooled(X.admitted(p, X.verdicts(p, LEAST_PLAYERS, BAR))).withColumn("value", F.round("value", 6))


#: requirement, minimum, experimental
REQUIREMENTS = (("passes", 50, False), ("shots", 40, False), ("touches", 45, True), ("duels", None, False))
APPLIES = {"passes": ["DF", "MD"], "shots": ["FW", "MD"], "touches": ["DF", "MD", "FW"], "duels": ["DF"]}


def typed(spark, sf_dir, opt_in: bool) -> DataFrame:
    """The squads' players with the slots that a selection may use; a rate of zero counts as not measured."""
    table = spark.createDataFrame([*REQUIREMENTS], "requirement string, minimum int, experimental boolean")
    rows = squads(spark, sf_dir)
    values = F.create_map(*[x for n in ("passes", "shots", "touches") for x in (F.lit(n), F.when(F.col(n) > 0, F.col(n)))])
    return X.typed_inputs(rows.withColumn("values", values), table, APPLIES, opt_in)


def _typed_sql(opt_in: bool) -> str:
    need = {"passes": APPLIES["passes"], "shots": APPLIES["shots"]} | ({"touches": APPLIES["touches"]} if opt_in else {})
    bad = " OR ".join(f"({n} = 0 AND x IN ({', '.join(repr(s) for s in slots)}))" for n, slots in need.items())
    names = ", ".join(f"CASE WHEN {n} = 0 THEN '{n}' END" for n in sorted(need))
    return f"SELECT {str(opt_in).upper()} AS opted_in, squad, player_id, array_to_string(list_filter(slots, lambda x: NOT ({bad})), ',') AS slots, array_to_string(list_filter([{names}], lambda x: x IS NOT NULL), ',') AS missing FROM squad"


@query(SQUAD + " " + _typed_sql(False) + " UNION ALL " + _typed_sql(True))
def typed_candidates(spark, sf_dir):
    """What a selection gets of each player without and with the experimental requirement: open slots, missing measures."""
    one = lambda opt: typed(spark, sf_dir, opt).select(F.lit(opt).alias("opted_in"), "squad", "player_id", F.concat_ws(",", "kept").alias("slots"), F.concat_ws(",", "missing").alias("missing"))
    return one(False).unionByName(one(True))
