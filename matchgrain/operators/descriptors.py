"""Tallies of events: conditions that combine by ``&``, ``|`` and ``~``, compile to one column and say what they ask for.

A condition is SQL text that is never null: what nobody knows does not meet a condition, and so meets its negation. It also
knows at which ends of an event it looks, so that a tally can tell events without a place there from those that do not count.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import located


@dataclass(frozen=True)
class Condition:
    sql: str
    words: str
    ends: frozenset[str] = frozenset()

    def __and__(self, other: Condition) -> Condition:
        return Condition(f"({self.sql} AND {other.sql})", f"{self.words} and {other.words}", self.ends | other.ends)

    def __or__(self, other: Condition) -> Condition:
        return Condition(f"({self.sql} OR {other.sql})", f"either {self.words} or {other.words}", self.ends | other.ends)

    def __invert__(self) -> Condition:
        return Condition(f"(NOT {self.sql})", f"not {self.words}", self.ends)

    def called(self, name: str) -> Condition:
        """The same condition under a name, spelled out in brackets."""
        return Condition(self.sql, f"{name} ({self.words})", self.ends)

    def column(self) -> Column:
        return F.expr(self.sql)

    def placed(self) -> Column:
        """Whether the event has a place at every end that the condition looks at."""
        return reduce(and_, [located(F.col(f"{e}_x"), F.col(f"{e}_y")) for e in sorted(self.ends)], F.lit(True))


def done(kind: str, outcome: bool | None = None) -> Condition:
    """An event of a type; with an outcome, one that was judged and had it."""
    judged = "" if outcome is None else f" AND success = {str(outcome).lower()}"
    return Condition(f"coalesce(type = '{kind}'{judged}, false)", {None: "a ", True: "a completed ", False: "a failed "}[outcome] + kind)


def marked(flag: str) -> Condition:
    return Condition(f"coalesce({flag}, false)", f"marked {flag}")


@dataclass(frozen=True)
class Along:
    """A coordinate of the start or end of an event; its edges are exact fractions of the pitch."""

    end: str
    axis: str

    def _edge(self, sign: str, said: str, edge: Fraction) -> Condition:
        return Condition(f"coalesce({self.end}_{self.axis} {sign} {float(edge)!r}D, false)", f"{self.end} {self.axis} {said} {edge}", frozenset({self.end}))

    def below(self, edge: Fraction) -> Condition:
        return self._edge("<", "below", edge)

    def above(self, edge: Fraction) -> Condition:
        return self._edge(">", "above", edge)

    def up_to(self, edge: Fraction) -> Condition:
        return self._edge("<=", "up to", edge)

    def at_least(self, edge: Fraction) -> Condition:
        return self._edge(">=", "at least", edge)


@dataclass(frozen=True)
class Tally:
    """Events that meet a condition, by the first of ``parts`` that they meet; ``rest`` takes those that meet none."""

    events: Condition
    parts: dict[str, Condition]
    rest: str

    @property
    def names(self) -> tuple[str, ...]:
        return (*self.parts, self.rest)

    def part(self) -> Column:
        return F.expr("CASE " + " ".join(f"WHEN {c.sql} THEN '{n}'" for n, c in self.parts.items()) + f" ELSE '{self.rest}' END") if self.parts else F.lit(self.rest)

    def counts(self, acts: DataFrame, *by: str) -> DataFrame:
        """``n_<part>`` of the events with a place, and as ``dropped`` those without one: a single aggregate."""
        whole = reduce(lambda a, c: Condition(a.sql, a.words, a.ends | c.ends), self.parts.values(), self.events)
        of = F.when(self.events.column(), F.when(whole.placed(), self.part()).otherwise("dropped"))
        return acts.withColumn("_part", of).groupBy(*by).agg(*[F.count_if(F.col("_part") == n).alias(f"n_{n}") for n in self.names], F.count_if(F.col("_part") == "dropped").alias("dropped"))


#: Completed passes and all shots that end in the attacking half and do not start in the last fifth, by lane.
ATTACKS = Tally(
    (done("pass", True) | done("shot")) & ~Along("start", "x").at_least(Fraction(4, 5)).called("from the last fifth") & Along("end", "x").above(Fraction(1, 2)).called("into the attacking half"),
    {"left": Along("end", "y").below(Fraction(7, 20)), "right": Along("end", "y").above(Fraction(13, 20))},
    "centre",
)
