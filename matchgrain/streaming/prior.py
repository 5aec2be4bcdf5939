"""Totals of strictly earlier days, as a stream: what a day brings counts only once that day is over, and then as a whole.

Every unit is a state of its own, so a hot league is dealt over its units. The event time of a row is the beginning of its
day; a day closes when a later day has been seen, and then gives one row with the totals before it. Days close in order, so
the result is that of the batch window (``prior_batch``) over the rows that were in time.

Defined results: a row whose day is closed when it comes is late and counts nowhere; rows in time come in any order; a null
value counts as a row without a value; rows without a day are left out; days that are still open wait in the state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

EPOCH = date(1970, 1, 1)
RESULT = "unit_id long, day date, n long, total double, prior_n long, prior_total double"
#: Days closed so far, and the open ones with their end in milliseconds.
STATE = "n long, total double, days array<int>, ends array<long>, ns array<long>, totals array<double>"


def _days(rows: DataFrame) -> DataFrame:
    return rows.where("ts is not null").select(F.col("unit_id").cast("long").alias("unit_id"), F.to_date("ts").alias("day"), F.col("value").cast("double").alias("value"))


def _unit(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    n, total, days, ends, ns, totals = state.get if state.exists else (0, 0.0, [], [], [], [])
    open_days = {d: (e, c, t) for d, e, c, t in zip(days, ends, ns, totals, strict=True)}
    for batch in batches:
        # Plain arrays: most units have few rows, and a data frame's own grouping would cost more than all else.
        since, first, at = np.unique(batch["since"].to_numpy(), return_index=True, return_inverse=True)
        value = batch["value"].to_numpy(dtype=float, na_value=np.nan)
        sums = np.bincount(at, np.where(np.isnan(value), 0.0, value), len(since))
        for d, e, m, v in zip(since.tolist(), batch["ends"].to_numpy()[first].tolist(), np.bincount(at).tolist(), sums.tolist(), strict=True):
            _, c, t = open_days.get(d, (0, 0, 0.0))
            open_days[d] = (int(e), c + m, t + v)
    out, now = [], state.getCurrentWatermarkMs()
    for d in sorted(open_days):
        end, c, t = open_days[d]
        if end > now:
            break
        out.append((key[0], EPOCH + timedelta(days=d), c, t, n, total))
        n, total = n + c, total + t
        del open_days[d]
    left = sorted(open_days.items())
    state.update((n, total, [d for d, _ in left], [e for _, (e, _, _) in left], [c for _, (_, c, _) in left], [t for _, (_, _, t) in left]))
    if left:
        state.setTimeoutTimestamp(max(left[0][1][0] - 1, now + 1))  # a timer fires once the watermark is past it
    if out:
        yield pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])


def prior_totals(stream: DataFrame, late_days: int = 0) -> DataFrame:
    """One row a unit and closed day of a stream of ``unit_id, ts, value``; a day closes when a day more than ``late_days`` later has begun."""
    # A row at the watermark is late to Spark, so the watermark stays a millisecond before the day that is still open.
    rows = _days(stream).withColumn("begins", F.to_timestamp("day")).withWatermark("begins", f"{late_days * 86_400_000 + 1} milliseconds")
    ends = F.unix_millis(F.to_timestamp(F.date_add("day", 1))) - 1
    rows = rows.select("unit_id", "value", "begins", F.unix_date("day").alias("since"), ends.alias("ends"))
    return rows.groupBy("unit_id").applyInPandasWithState(_unit, RESULT, STATE, "append", "EventTimeTimeout")


def prior_batch(rows: DataFrame) -> DataFrame:
    """The same rows from a whole table, all days closed."""
    days = _days(rows).groupBy("unit_id", "day").agg(F.count("*").alias("n"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("total"))
    before = Window.partitionBy("unit_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return days.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("prior_n"), F.coalesce(F.sum("total").over(before), F.lit(0.0)).alias("prior_total"))
