"""Holdout split, metrics and the moving-average baseline (M1, M2, M5, M6).

Per-series history arrays are at most a few hundred months long, so the
recursive "feed the prediction back" steps are array folds (``aggregate``)
inside one projection: no Python, no driver loop, one row per series.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.exprs import round_half_up

_ONE = "__series"
FORECAST_MONTHS = 3
BASELINE_MODEL = "Seasonal Baseline"
BASELINE_MIN_HISTORY = 4
BASELINE_SKIP_REASON = "Not enough history for baseline evaluation."


def _k(df, keys):
    keys = list(keys or [])
    return (df, keys) if keys else (df.withColumn(_ONE, F.lit(0)), [_ONE])


def holdout_size(n: Column) -> Column:
    """M1: last min(3, max(1, n // 4)) months are held out."""
    return F.least(F.lit(FORECAST_MONTHS), F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def split_holdout(monthly: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """M1: adds ``series_n``, ``holdout`` and ``is_holdout`` per row."""
    m, k = _k(monthly, keys)
    whole = Window.partitionBy(*k)
    desc = Window.partitionBy(*k).orderBy(F.col("date").desc())
    n = F.count(F.lit(1)).over(whole)
    out = (m.withColumn("series_n", n)
           .withColumn("holdout", holdout_size(F.col("series_n")))
           .withColumn("is_holdout", F.row_number().over(desc) <= F.col("holdout")))
    return out if keys else out.drop(_ONE)


def metrics(pairs: DataFrame, keys: Sequence[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """M2: MAE, RMSE, MAPE % (zero actuals skipped, null if all zero), R2 = 1 - SSE/SST (null if n <= 1)."""
    keys = list(keys)
    a, p = F.col(actual), F.col(predicted)
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    mean_a = F.avg(a).over(w)
    x = pairs.select(*keys, a.alias("_a"), p.alias("_p"), mean_a.alias("_ma"))
    a, p = F.col("_a"), F.col("_p")
    err = a - p
    agg = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg(F.abs(err)).alias("mae"),
        F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(F.when(a != 0, F.abs(err / a))) * 100).alias("mape"),
        F.sum(err * err).alias("_sse"),
        F.sum((a - F.col("_ma")) * (a - F.col("_ma"))).alias("_sst"))
    r2 = (F.when(F.col("_n") <= 1, F.lit(None).cast("double"))
          .when(F.col("_sst") == 0, F.when(F.col("_sse") == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
          .otherwise(1 - F.col("_sse") / F.col("_sst")))
    return agg.select(*keys, "mae", "rmse", "mape", r2.alias("r2"))


def _tail_mean(arr: Column, size: Column) -> Column:
    tail = F.slice(arr, F.greatest(F.lit(1), F.size(arr) - size + 1), size)
    return F.aggregate(tail, F.lit(0.0), lambda s, v: s + v) / F.size(tail)


def _histories(monthly: DataFrame, keys: list[str]) -> DataFrame:
    """Per series: ordered values, holdout size and last date (one row per series)."""
    s = split_holdout(monthly, keys)
    ordered = F.array_sort(F.collect_list(F.struct("date", "target", "is_holdout")))
    g = s.groupBy(*keys).agg(ordered.alias("_rows"), F.max("date").alias("last_date"),
                            F.first("holdout").alias("holdout"))
    return g.select(*keys, "last_date", "holdout",
                    F.transform("_rows", lambda r: r["target"]).alias("values"),
                    F.transform(F.filter("_rows", lambda r: ~r["is_holdout"]), lambda r: r["target"]).alias("train"),
                    F.transform(F.filter("_rows", lambda r: r["is_holdout"]), lambda r: r["target"]).alias("actual"))


def baseline_predictions(monthly: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """M5: holdout predictions of the moving-average baseline, one row per (series, step).

    Window 3 when the training slice has fewer than 12 points, else 12, kept
    fixed while predictions are fed back; series shorter than 4 are skipped.
    """
    m, k = _k(monthly, keys)
    h = _histories(m, k).where(F.size("values") >= BASELINE_MIN_HISTORY)
    sw = F.when(F.size("train") < 12, F.lit(3)).otherwise(F.lit(12))
    folded = F.aggregate(F.sequence(F.lit(1), F.col("holdout")), F.col("train"),
                         lambda acc, i: F.concat(acc, F.array(_tail_mean(acc, sw))))
    preds = F.slice(folded, F.size("train") + 1, F.col("holdout"))
    z = h.select(*k, F.posexplode(F.arrays_zip(F.col("actual").alias("actual"), preds.alias("predicted"))))
    out = z.select(*k, (F.col("pos") + 1).alias("step"), F.col("col.actual").alias("actual"),
                   F.col("col.predicted").alias("predicted"))
    return out if keys else out.drop(_ONE)


def baseline_eval(monthly: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """M2 + M5: one result row per series (status 'trained' or 'skipped')."""
    m, k = _k(monthly, keys)
    preds = baseline_predictions(m, k)
    met = metrics(preds, k)
    series = m.groupBy(*k).agg(F.count(F.lit(1)).alias("_n"))
    j = series.join(met, k, "left")
    trained = F.col("_n") >= BASELINE_MIN_HISTORY
    out = j.select(
        *k, F.lit(BASELINE_MODEL).alias("model"),
        *[F.when(trained, F.col(c)).alias(c) for c in ("mae", "rmse", "mape", "r2")],
        F.when(trained, F.lit("trained")).otherwise(F.lit("skipped")).alias("status"),
        F.when(trained, F.lit(None).cast("string")).otherwise(F.lit(BASELINE_SKIP_REASON)).alias("reason"))
    return out if keys else out.drop(_ONE)


def baseline_forecast(monthly: DataFrame, keys: Sequence[str] | None = None,
                      horizon: int = FORECAST_MONTHS) -> DataFrame:
    """M6: next ``horizon`` months; window re-chosen as history grows; clamp >= 0 on output only."""
    m, k = _k(monthly, keys)
    h = _histories(m, k).where(F.size("values") >= BASELINE_MIN_HISTORY)
    folded = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), F.col("values"),
                         lambda acc, i: F.concat(acc, F.array(_tail_mean(
                             acc, F.when(F.size(acc) < 12, F.lit(3)).otherwise(F.lit(12))))))
    preds = F.slice(folded, F.size("values") + 1, horizon)
    z = h.select(*k, "last_date", F.posexplode(preds).alias("pos", "pred"))
    out = z.select(*k, F.add_months("last_date", F.col("pos") + 1).alias("date"),
                   F.lit(BASELINE_MODEL).alias("model"),
                   round_half_up(F.greatest(F.lit(0.0), F.col("pred"))).alias("value"))
    return out if keys else out.drop(_ONE)


def round_metrics(results: DataFrame, digits: int = 4) -> DataFrame:
    """Presentation: metrics at ``digits`` decimals (NaN/inf -> null)."""
    cols = []
    for c in results.columns:
        if c in ("mae", "rmse", "mape", "r2"):
            v = F.col(c)
            v = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None)).otherwise(v)
            cols.append(round_half_up(v, digits).alias(c))
        else:
            cols.append(F.col(c))
    return results.select(*cols)
