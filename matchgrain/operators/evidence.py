"""What combined figures may still claim, and what providers allow."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From strongest to weakest; a figure is no stronger than its weakest part.
CLASSES = ("observed", "derived", "modelled", "assumed")


def strength(kind: Column) -> Column:
    """Place in ``CLASSES``; what is no class counts as the weakest."""
    at = F.array_position(F.array(*map(F.lit, CLASSES)), kind)
    return F.when(at > 0, at - 1).otherwise(len(CLASSES) - 1).cast("int")


def weakest(kinds: Sequence[Column]) -> Column:
    return F.element_at(F.array(*map(F.lit, CLASSES)), F.greatest(*map(strength, kinds)) + 1)


def sum_kind(kinds: Sequence[Column]) -> Column:
    """A sum of observations is an observation; of anything else, at best derived."""
    every = F.greatest(*map(strength, kinds)) == 0
    return F.when(every, CLASSES[0]).otherwise(F.element_at(F.array(*map(F.lit, CLASSES)), F.greatest(F.greatest(*map(strength, kinds)), F.lit(1)) + 1))


def spread(a: Column, b: Column, key_a: Column, key_b: Column) -> Column:
    """Standard error of a sum of two figures with ``draws``: draw by draw where both come from the same worlds, else as if
    independent."""
    total = F.zip_with(a, b, lambda x, y: x + y)
    return F.when(key_a == key_b, deviation(total)).otherwise(F.sqrt(F.pow(deviation(a), F.lit(2)) + F.pow(deviation(b), F.lit(2))))


def deviation(draws: Column) -> Column:
    """Sample standard deviation of an array."""
    n = F.size(draws)
    mean = F.aggregate(draws, F.lit(0.0), lambda s, x: s + x) / n
    return F.sqrt(F.aggregate(draws, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / (n - 1))


class NotAllowed(PermissionError):
    """A provider's licence forbids this use."""


#: What each provider allows; a provider that is not listed allows nothing.
POSTURES = {"open-events": frozenset({"ingest", "host", "commit"}), "research-only": frozenset({"ingest"})}


def assert_may(provider: str, use: str) -> None:
    """Before any scan: refuse what the provider does not allow."""
    if use not in POSTURES.get(provider, frozenset()):
        raise NotAllowed(f"{provider} does not allow to {use}")
