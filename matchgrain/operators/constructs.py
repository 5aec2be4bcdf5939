"""Declarative per-player constructs: filtered sums or counts over minutes or over filtered counts, all in one pass."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import channel, ratio


@dataclass(frozen=True)
class ActionFilter:
    types: frozenset[str] = frozenset()
    completed: bool | None = None
    flags: frozenset[str] = frozenset()
    lane: str | None = None

    def column(self) -> Column:
        out = F.lit(True)
        if self.types:
            out = out & F.col("type").isin(*sorted(self.types))
        if self.completed is not None:
            out = out & (F.col("success") == F.lit(self.completed))  # null was not judged and does not pass
        for f in sorted(self.flags):
            out = out & F.col(f)
        if self.lane:
            out = out & (channel(F.col("start_y")) == self.lane)
        return F.coalesce(out, F.lit(False))

    def describe(self) -> str:
        words = ["completed" if self.completed else "failed"] if self.completed is not None else []
        words += [f"{' or '.join(sorted(self.types))}" if self.types else "action"]
        words += [f"flagged {' and '.join(sorted(self.flags))}"] if self.flags else []
        words += [f"from the {self.lane} lane"] if self.lane else []
        return " ".join(words)

    def fingerprint(self) -> str:
        text = repr((sorted(self.types), self.completed, sorted(self.flags), self.lane))
        return hashlib.sha256(text.encode()).hexdigest()[:12]


PASSES = ActionFilter(frozenset({"pass"}), True)


@dataclass(frozen=True)
class Construct:
    name: str
    family: str  #: quality may be compared; style has no better or worse
    measure: str  #: positive, signed or count
    numerator: ActionFilter
    denominator: ActionFilter | None = None  #: None: per 90 minutes
    excludes: frozenset[str] = field(default_factory=lambda: frozenset({"GK"}))

    def top(self, delta: Column) -> Column:
        hit = self.numerator.column()
        if self.measure == "count":
            return F.count_if(hit).cast("double")
        value = F.greatest(delta, F.lit(0.0)) if self.measure == "positive" else delta
        return F.coalesce(F.sum(F.when(hit, value)), F.lit(0.0))


CONSTRUCTS = (
    Construct("progression", "quality", "positive", PASSES),
    Construct("progression_per_action", "quality", "positive", PASSES, PASSES),
    Construct("chance_creation", "quality", "signed", ActionFilter(frozenset({"pass"}), True, frozenset({"key_pass"}))),
    Construct("half_space_share", "style", "count", ActionFilter(frozenset({"pass"}), True, lane="half_space"), PASSES),
    Construct("width", "style", "count", ActionFilter(frozenset({"pass"}), True, lane="wide"), PASSES),
)


def components(acts: DataFrame, by: tuple[str, ...] = ("player_id",), constructs=CONSTRUCTS) -> DataFrame:
    """Numerators and denominators of all constructs in one grouped aggregate over ``acts`` with ``delta``."""
    aggs = [c.top(F.col("delta")).alias(f"{c.name}_n") for c in constructs]
    aggs += [F.count_if(c.denominator.column()).cast("double").alias(f"{c.name}_d") for c in constructs if c.denominator]
    return acts.groupBy(*by).agg(*aggs)


def rates(parts: DataFrame, minutes: DataFrame, constructs=CONSTRUCTS) -> DataFrame:
    """Rates for every row of ``minutes``; a player without actions has a zero numerator, a zero denominator gives null."""
    joined = minutes.join(parts, "player_id", "left")
    top = {c.name: F.coalesce(f"{c.name}_n", F.lit(0.0)) for c in constructs}
    return joined.select(
        *minutes.columns,
        *[ratio(top[c.name], F.coalesce(f"{c.name}_d", F.lit(0.0))).alias(c.name) if c.denominator else ratio(top[c.name] * 90.0, F.col("minutes").cast("double")).alias(c.name) for c in constructs],
    )
