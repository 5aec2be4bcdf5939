"""Column builders: grid cells, channels, thirds, safe ratios, ranks, name folding, rounding policies."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

#: Inclusive half-space edges and strict wide edges of the unit pitch.
HALF_SPACES = ((0.21, 0.37), (0.63, 0.79))
WIDE = (0.21, 0.79)


def cell_x(x: Column, n: int = 16) -> Column:
    """Truncates toward zero, then clips; null stays null."""
    return F.greatest(F.lit(0), F.least(F.lit(n - 1), F.floor(x * n))).cast("int")


def cell(x: Column, y: Column, n_x: int = 16, n_y: int = 12) -> Column:
    return cell_x(y, n_y) * n_x + cell_x(x, n_x)


def rising_value(x: Column) -> Column:
    """A declared surface that rises with the square of the column: for checks that must not depend on a fit."""
    return F.pow((cell_x(x) + 1) / 16.0, F.lit(2))


def gain(start_x: Column, end_x: Column) -> Column:
    return rising_value(end_x) - rising_value(start_x)


def channel(y: Column) -> Column:
    half = F.lit(False)
    for a, b in HALF_SPACES:
        half = half | y.between(a, b)
    return F.when(y.isNull(), None).when((y < WIDE[0]) | (y > WIDE[1]), "wide").when(half, "half_space").otherwise("centre")


def third(x: Column) -> Column:
    return F.when(x.isNull(), None).when(x < 1 / 3, "own").when(x < 2 / 3, "middle").otherwise("final")


def located(x: Column, y: Column, sentinels: tuple[tuple[float, float], ...] = ((0.0, 0.0), (1.0, 1.0))) -> Column:
    """In range, and not one of the points that providers write for "unknown"."""
    ok = x.between(0, 1) & y.between(0, 1)
    for a, b in sentinels:
        ok = ok & ~((x == a) & (y == b))
    return F.coalesce(ok, F.lit(False))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0)))


def strictly_below(value: str, *by: str) -> Column:
    """Percentile as the share strictly below, times 100; nulls are no members."""
    w = Window.partitionBy(*by, F.col(value).isNull())
    return F.when(F.col(value).isNotNull(), (F.rank().over(w.orderBy(value)) - 1) / F.count(value).over(w) * 100.0)


def average_rank(value: str, *by: str) -> Column:
    """Ties share the mean of their ranks."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count("*").over(Window.partitionBy(*by, value)) - 1) / 2.0


def fold(name: Column) -> Column:
    """Lower case without the common Latin accents and stroked letters."""
    return F.translate(F.lower(name), "áàâäãåéèêëíìîïóòôöõøúùûüñçýÿłđ", "aaaaaaeeeeiiiioooooouuuuncyyld")


def tokens(name: Column) -> Column:
    """Distinct folded words of two letters or more."""
    return F.filter(F.array_distinct(F.split(fold(name), "[^a-z0-9]+")), lambda t: F.length(t) > 1)


def quantise(rate: Column, unit: Column, q: int = 100) -> Column:
    """Half-even whole number of q-ths."""
    return F.bround(rate / unit * q).cast("long")
