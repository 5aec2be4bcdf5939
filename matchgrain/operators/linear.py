"""Least squares refitted at every fold from prefix sums: a fold's past is never read again.

A row adds to the cross products of the bin that its day falls in; running sums over bins give each fold the cross products of
everything before it, and a short Cholesky solve in columns gives its coefficients. A singular system has no coefficients.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A pivot below this share of its diagonal element counts as zero.
SINGULAR = 1e-9


def solved(df: DataFrame, gram: Mapping[tuple[int, int], Column], right: Sequence[Column], names: Sequence[str]) -> DataFrame:
    """``df`` with the solution of the symmetric system in ``names``; ``gram`` has the entries (i, j) with j <= i."""
    p = len(right)
    df = df.withColumns({f"_g{i}{j}": gram[i, j].cast("double") for i in range(p) for j in range(i + 1)} | {f"_r{i}": right[i].cast("double") for i in range(p)})
    for j in range(p):
        pivot = F.col(f"_g{j}{j}") - sum((F.col(f"_l{j}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))
        df = df.withColumn(f"_l{j}{j}", F.when(pivot > SINGULAR * F.col(f"_g{j}{j}"), F.sqrt(pivot)))
        for i in range(j + 1, p):
            rest = F.col(f"_g{i}{j}") - sum((F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"_l{i}{j}", rest / F.col(f"_l{j}{j}"))
    for i in range(p):
        df = df.withColumn(f"_y{i}", (F.col(f"_r{i}") - sum((F.col(f"_l{i}{k}") * F.col(f"_y{k}") for k in range(i)), F.lit(0.0))) / F.col(f"_l{i}{i}"))
    for i in reversed(range(p)):
        df = df.withColumn(names[i], (F.col(f"_y{i}") - sum((F.col(f"_l{k}{i}") * F.col(names[k]) for k in range(i + 1, p)), F.lit(0.0))) / F.col(f"_l{i}{i}"))
    return df.drop(*[c for c in df.columns if c[:2] in ("_g", "_r", "_l", "_y") and c[2:].isdigit()])


def fold_of(day: Column, starts: Sequence[int]) -> Column:
    """The number of the fold a day belongs to, from 1; 0 before the first one starts."""
    return sum((F.when(day >= s, 1).otherwise(0) for s in starts), F.lit(0))


def fold_fits(rows: DataFrame, designs: Mapping[str, Sequence[str]], target: str, day: str, starts: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """``by, fold, fitted_rows`` and ``<design>_<i>`` for each design's coefficients, fitted on all days before the fold.

    A design is a list of columns; the constant comes first by itself.
    """
    features = sorted({c for d in designs.values() for c in d})
    values = {"": F.lit(1.0), **{c: F.col(c).cast("double") for c in features}}
    keys = list(values)
    pairs = {(a, b): f"_p{x}_{y}" for x, a in enumerate(keys) for y, b in enumerate(keys) if y <= x}
    sums = [F.sum(values[a] * values[b]).alias(n) for (a, b), n in pairs.items()] + [F.sum(values[a] * F.col(target)).alias(f"_t{x}") for x, a in enumerate(keys)]
    bins = rows.withColumn("fold", fold_of(F.col(day), starts) + 1).groupBy(*by, "fold").agg(*sums)
    every = rows.select(*by).distinct() if by else rows.sparkSession.range(1).drop("id")
    every = every.withColumn("fold", F.explode(F.array(*[F.lit(i + 1) for i in range(len(starts))])))
    past = Window.partitionBy(*by).orderBy("fold").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [*pairs.values(), *(f"_t{x}" for x in range(len(keys)))]
    fits = every.join(bins, [*by, "fold"], "left").select(*by, "fold", *[F.coalesce(F.sum(n).over(past), F.lit(0.0)).alias(n) for n in names])
    fits = fits.withColumn("fitted_rows", F.col(pairs["", ""]).cast("long"))
    at = {a: x for x, a in enumerate(keys)}
    for name, columns in designs.items():
        own = ["", *columns]
        entry = lambda a, b: F.col(pairs[(a, b) if at[b] <= at[a] else (b, a)])  # noqa: B023, E731
        fits = solved(fits, {(i, j): entry(own[i], own[j]) for i in range(len(own)) for j in range(i + 1)}, [F.col(f"_t{at[a]}") for a in own], [f"{name}_{i}" for i in range(len(own))])
    return fits.drop(*names)


def predictions(rows: DataFrame, fits: DataFrame, designs: Mapping[str, Sequence[str]], day: str, starts: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """The rows of each fold with ``<design>`` (not below zero) and ``<design>_clipped``, under the fit made before it."""
    met = rows.withColumn("fold", fold_of(F.col(day), starts)).where("fold > 0").join(fits, [*by, "fold"])
    for name, columns in designs.items():
        raw = F.col(f"{name}_0") + sum((F.col(f"{name}_{i + 1}") * F.col(c) for i, c in enumerate(columns)), F.lit(0.0))
        met = met.withColumn(f"{name}_clipped", raw < 0).withColumn(name, F.greatest(raw, F.lit(0.0)))
    return met.drop(*[f"{n}_{i}" for n, d in designs.items() for i in range(len(d) + 1)])
