"""Lag/rolling feature frame (W1-W10) over monthly series.

``Window.partitionBy(keys).orderBy(date)`` throughout: with series keys the
windows are partitioned by key (one shuffle of the small monthly table); with
a single series they run on one partition, which holds tens of rows.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ONE = "__series"

BASE_FEATURES = ["time_index", "month", "quarter", "month_sin", "month_cos",
                 "lag_1", "lag_2", "lag_3", "rolling_mean_3", "rolling_std_3",
                 "pct_change_1", "pct_change_3"]
LONG_LAG_FEATURES = {"lag_6": 12, "rolling_mean_6": 12, "lag_12": 24}


def feature_columns(n: int) -> list[str]:
    """Columns the frame carries for a series of length ``n`` (in frame order)."""
    cols = ["time_index", "month", "quarter", "month_sin", "month_cos", "lag_1", "lag_2", "lag_3"]
    if n >= 12:
        cols.append("lag_6")
    if n >= 24:
        cols.append("lag_12")
    cols += ["rolling_mean_3", "rolling_std_3"]
    if n >= 12:
        cols.append("rolling_mean_6")
    cols += ["pct_change_1", "pct_change_3"]
    return cols


def _k(df, keys):
    keys = list(keys or [])
    return (df, keys) if keys else (df.withColumn(_ONE, F.lit(0)), [_ONE])


def add_features(monthly: DataFrame, keys: Sequence[str] | None = None,
                 pct_change: str = "current") -> DataFrame:
    """W1-W7 for every row (nothing dropped), plus ``series_n`` (series length).

    ``pct_change="current"`` reproduces the reference (change into the current
    row, which uses the target itself); ``"lagged"`` uses the change into the
    previous row, which is free of that leakage.
    """
    m, k = _k(monthly, keys)
    w = Window.partitionBy(*k).orderBy("date")
    whole = Window.partitionBy(*k)
    t = F.col("target")
    n = F.count(F.lit(1)).over(whole)

    def roll(size, fn):
        frame = w.rowsBetween(-size, -1)
        return F.when(F.count(t).over(frame) == size, fn(t).over(frame))

    lag = lambda j: F.lag(t, j).over(w)
    base = t if pct_change == "current" else lag(1)
    base_l1 = lag(1) if pct_change == "current" else lag(2)
    base_l3 = lag(3) if pct_change == "current" else lag(4)
    month = F.month("date")
    out = m.select(
        *k, "date", "target", n.alias("series_n"),
        (F.row_number().over(w) - 1).alias("time_index"),
        month.alias("month"), F.quarter("date").alias("quarter"),
        F.sin(2 * math.pi * month / 12).alias("month_sin"),
        F.cos(2 * math.pi * month / 12).alias("month_cos"),
        lag(1).alias("lag_1"), lag(2).alias("lag_2"), lag(3).alias("lag_3"),
        F.when(n >= 12, lag(6)).alias("lag_6"),
        F.when(n >= 24, lag(12)).alias("lag_12"),
        roll(3, F.avg).alias("rolling_mean_3"),
        roll(3, F.stddev_samp).alias("rolling_std_3"),
        F.when(n >= 12, roll(6, F.avg)).alias("rolling_mean_6"),
        (F.try_divide(base, base_l1) - 1).alias("pct_change_1"),
        (F.try_divide(base, base_l3) - 1).alias("pct_change_3"),
    )
    return out if keys else out.drop(_ONE)


def feature_frame(monthly: DataFrame, keys: Sequence[str] | None = None,
                  pct_change: str = "current") -> DataFrame:
    """Features, then rows with any missing *active* feature dropped.

    Without keys the columns match the series length (lag_6 / rolling_mean_6
    from 12 months, lag_12 from 24).  With keys every column is present and
    inactive ones are null for shorter series.
    """
    keys = list(keys or [])
    f = add_features(monthly, keys, pct_change)
    inf = float("inf")

    def present(c):
        col = F.col(c)
        ok = col.isNotNull()
        if c.startswith("pct_change"):
            ok = ok & ~F.isnan(col) & (F.abs(col) != inf)
        need = LONG_LAG_FEATURES.get(c)
        return ok if need is None else (ok | (F.col("series_n") < need))

    cond = None
    for c in BASE_FEATURES + list(LONG_LAG_FEATURES):
        cond = present(c) if cond is None else (cond & present(c))
    f = f.where(cond)
    if keys:
        return f.select(*keys, "date", "target", *feature_columns(24), "series_n")
    n = monthly.count()
    return f.select("date", "target", *feature_columns(n))


def minmax_scale(monthly: DataFrame, keys: Sequence[str] | None = None, col: str = "target") -> DataFrame:
    """Per-series min-max scaling; a constant series scales to 0."""
    m, k = _k(monthly, keys)
    whole = Window.partitionBy(*k)
    lo, hi = F.min(col).over(whole), F.max(col).over(whole)
    rng = hi - lo
    out = m.select("*", lo.alias("scale_min"), hi.alias("scale_max"),
                   F.when(rng == 0, F.col(col) - lo).otherwise((F.col(col) - lo) / rng).alias("scaled"))
    return out if keys else out.drop(_ONE)


def window_size(train_len: Column | int):
    """Sequence window: 6 points when the training slice has >= 12, else 3."""
    if isinstance(train_len, int):
        return 6 if train_len >= 12 else 3
    return F.when(train_len >= 12, F.lit(6)).otherwise(F.lit(3))


def lag_sequences(scaled: DataFrame, keys: Sequence[str] | None = None, window: int | None = None) -> DataFrame:
    """Sliding windows of ``window`` previous scaled values and the next value.

    ``window=None`` picks 6 or 3 per series from its length.
    """
    m, k = _k(scaled, keys)
    w = Window.partitionBy(*k).orderBy("date")
    whole = Window.partitionBy(*k)
    n = F.count(F.lit(1)).over(whole)
    size = F.lit(window) if window else window_size(n)
    hist = F.collect_list("scaled").over(w.rowsBetween(-(window or 6), -1))
    x = F.slice(hist, F.greatest(F.lit(1), F.size(hist) - size + 1), size)
    out = (m.select(*k, "date", x.alias("x"), F.col("scaled").alias("y"), size.alias("window"))
           .where(F.size("x") == F.col("window")))
    return out if keys else out.drop(_ONE)


from pyspark.sql import Column  # noqa: E402
