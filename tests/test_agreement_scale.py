"""Days and weeks are drawn for the match list only."""

from matchgrain.plans import agreement
from matchgrain.plans.agreement import decided
from pyspark.sql import functions as F


def test_drawn_once_a_match(spark, monkeypatch):
    lists, cut = [], agreement.cut
    monkeypatch.setattr(agreement, "cut", lambda df: lists.append(cut(df)) or lists[-1])
    decided(spark, "/root/testdata/sf0.001")
    (games,) = lists
    assert games.count() == games.select("game_id").distinct().count() and games.where(F.size("days") != agreement.WORLDS).count() == 0
