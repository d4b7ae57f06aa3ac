"""Tree and window-autoregression forecasters.

Models are Spark ML estimators fitted on the pooled feature rows of all
series that share a feature set (length class), so one fit serves any number
of series.  Recursive forecasting is a driver loop over *steps* (at most the
horizon), never over rows or series: each step is one ``model.transform`` of
a frame holding one history array per series, followed by ``array_append``.
"""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Callable, Sequence

from pyspark import StorageLevel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from shelfcast.functions.exprs import round_half_up
from shelfcast.operators import boosting as bo
from shelfcast.operators import regression as rg
from shelfcast.operators.evaluate import FORECAST_MONTHS, metrics, split_holdout
from shelfcast.operators.features import add_features, feature_columns
from shelfcast.session import materialize

_ONE = "__series"
SEED = 42
TREE_MIN_MONTHS = 8
TREE_MIN_FEATURE_ROWS = 4
AR_MIN_MONTHS = 10
AR_MIN_SEQUENCES = 3
#: Added to the squares of the scaled lags; 6 lags and a constant may meet as few as 6 windows.
AR_RIDGE = 0.01
#: Boosted series that one task fits; a fit takes about a second.
SERIES_PER_TASK = 4
#: Partitions of the forest's training rows.  Seeded bagging depends on it, so it does not follow the data.
TRAINING_PARTITIONS = 4

# Reference hyper-parameters.
FOREST_PARAMS = dict(numTrees=500, maxDepth=10, minInstancesPerNode=1, featureSubsetStrategy="all")

FOREST = "Random Forest"
BOOSTING = "Gradient Boosting"
WINDOW_AR = "Window AR"
MODEL_ORDER = [FOREST, BOOSTING, "Seasonal Baseline", WINDOW_AR]


class NotEnoughHistory(ValueError):
    pass


# Execution options (not model settings): fine-grained bins so splits are close
# to exact thresholds on small series, and node ids cached per training row so
# deep trees do not re-route every row through the trees on each level.
_EXEC = dict(maxBins=256, cacheNodeIds=True)


def forest(**overrides):
    p = dict(FOREST_PARAMS, **_EXEC)
    p.update(overrides)
    return lambda: RandomForestRegressor(featuresCol="features", labelCol="target", seed=SEED, **p)


def boosting(**overrides):
    return lambda: bo.Boosting(**overrides)


def _k(df, keys):
    keys = list(keys or [])
    return (df, keys) if keys else (df.withColumn(_ONE, F.lit(0)), [_ONE])


def length_class(n: Column) -> Column:
    """Feature-set class of a series of length n: 0 (<12), 1 (12-23), 2 (>=24)."""
    return F.when(n >= 24, F.lit(2)).when(n >= 12, F.lit(1)).otherwise(F.lit(0))


_CLASS_LEN = {0: 0, 1: 12, 2: 24}


# ---------------------------------------------------------------- M3: next-step feature row

def _at(h: Column, k: int) -> Column:
    """h[-k] if the history has k values, else h[-1]."""
    return F.when(F.size(h) >= k, F.try_element_at(h, F.lit(-k))).otherwise(F.try_element_at(h, F.lit(-1)))


def _mean(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v) / F.size(a)


def _tail(h: Column, k: int) -> Column:
    return F.slice(h, F.greatest(F.lit(1), F.size(h) - k + 1), k)


#: Names of ``recursive_feature_row``, in its order.
RECURSIVE_FEATURES = ["time_index", "month", "quarter", "month_sin", "month_cos", "lag_1", "lag_2", "lag_3", "lag_6", "lag_12",
                      "rolling_mean_3", "rolling_std_3", "rolling_mean_6", "pct_change_1", "pct_change_3"]


def recursive_feature_row(h: Column, date: Column) -> list[Column]:
    """Features of the next month from the history array (own predictions included)."""
    month = F.month(date)
    r3 = _tail(h, 3)
    m3 = _mean(r3)
    sd3 = F.when(F.size(r3) > 1, F.sqrt(F.aggregate(r3, F.lit(0.0), lambda s, v: s + (v - m3) * (v - m3))
                                        / (F.size(r3) - 1))).otherwise(F.lit(0.0))
    prev1, prev3 = F.try_element_at(h, F.lit(-2)), F.try_element_at(h, F.lit(-4))
    last = F.try_element_at(h, F.lit(-1))
    return [
        F.size(h).alias("time_index"), month.alias("month"), F.quarter(date).alias("quarter"),
        F.sin(2 * math.pi * month / 12).alias("month_sin"), F.cos(2 * math.pi * month / 12).alias("month_cos"),
        last.alias("lag_1"), _at(h, 2).alias("lag_2"), _at(h, 3).alias("lag_3"),
        _at(h, 6).alias("lag_6"), _at(h, 12).alias("lag_12"),
        m3.alias("rolling_mean_3"), sd3.alias("rolling_std_3"),
        F.when(F.size(h) >= 6, _mean(_tail(h, 6))).otherwise(_mean(h)).alias("rolling_mean_6"),
        F.when((F.size(h) >= 2) & (prev1 != 0), (last - prev1) / prev1).otherwise(F.lit(0.0)).alias("pct_change_1"),
        F.when((F.size(h) >= 4) & (prev3 != 0), (last - prev3) / prev3).otherwise(F.lit(0.0)).alias("pct_change_3"),
    ]


def next_feature_rows(monthly: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """M3: for every month of a series, the feature row of the month after it, from the history up to it.

    A model that is fed its own predictions reads such rows.  Histories shorter than a lag or a
    rolling window fall back to the last value, or to what there is.
    """
    m, k = _k(monthly.select(*(keys or []), "date", "target"), keys)
    h = _histories(m, k).select(*k, "dates", F.posexplode("hist").alias("pos", "v"), "hist")
    date = F.add_months(F.get("dates", F.col("pos")), 1)
    rows = h.select(*k, date.alias("date"), F.slice("hist", F.lit(1), F.col("pos") + 1).alias("hist"))
    out = rows.select(*k, "date", *recursive_feature_row(F.col("hist"), F.col("date")))
    return out if keys else out.drop(_ONE)


# ---------------------------------------------------------------- M4 / M7 / M8 / M9

@dataclass
class ModelRun:
    results: DataFrame     # (keys, model, mae, rmse, mape, r2, status, reason)
    forecasts: DataFrame   # (keys, model, date, value)


def _histories(monthly: DataFrame, k: list[str]) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("date", "target")))
    return monthly.groupBy(*k).agg(ordered.alias("_r")).select(
        *k, F.transform("_r", lambda r: r["target"]).alias("hist"),
        F.transform("_r", lambda r: r["date"]).alias("dates"))


def _recursive(model, state: DataFrame, k: list[str], cols: list[str], steps: int) -> DataFrame:
    """state: (keys, hist, n0, targets) -> adds ``pred`` array (clamped >= 0) for each target date."""
    for s in range(1, steps + 1):
        active = F.size("targets") >= s
        date = F.try_element_at("targets", F.least(F.lit(s), F.greatest(F.size("targets"), F.lit(1))))
        feats = state.select("*", *[c for c in recursive_feature_row(F.col("hist"), date)])
        assembled = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(feats)
        scored = model.transform(assembled)
        state = scored.select(*k, F.when(active, F.array_append("hist", F.greatest(F.lit(0.0), F.col("prediction"))))
                              .otherwise(F.col("hist")).alias("hist"), "n0", "targets")
    return state.select(*k, "targets", F.slice("hist", F.col("n0") + 1, F.size("targets")).alias("pred"))


def _fit_by_class(train_monthly: DataFrame, k: list[str], factory: Callable, targets: DataFrame,
                  min_rows: int = TREE_MIN_FEATURE_ROWS):
    """Fit one model per length class on pooled feature rows; forecast each series' target dates.

    Returns (predictions (keys, date, pred), fitted series keys).
    """
    feats = materialize(add_features(train_monthly, k), "table")
    hist = _histories(train_monthly, k)
    cls = materialize(hist.select(*k, length_class(F.size("hist")).alias("cls"), F.size("hist").alias("n0"), "hist"),
                      "table")
    present = sorted(r["cls"] for r in cls.select("cls").distinct().collect())
    outputs = []
    for c in present:
        cols = feature_columns(_CLASS_LEN[c])
        keys_c = cls.where(F.col("cls") == c).select(*k)
        rows = feats.join(keys_c, k)
        cond = None
        for col in cols:
            x = F.col(col).isNotNull()
            if col.startswith("pct_change"):
                x = x & ~F.isnan(col) & (F.abs(F.col(col)) != float("inf"))
            cond = x if cond is None else cond & x
        rows = rows.where(cond)
        # Series with fewer than ``min_rows`` feature rows are not fitted.
        enough = rows.groupBy(*k).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") >= min_rows).select(*k)
        rows = VectorAssembler(inputCols=cols, outputCol="features").transform(rows.join(enough, k))
        # Iterative learners scan the training rows once per tree level / round: keep them on executors.
        rows = (rows.repartition(TRAINING_PARTITIONS, *k).sortWithinPartitions(*k, "date")
                .select("features", "target").persist(StorageLevel.MEMORY_AND_DISK))
        if rows.isEmpty():
            rows.unpersist()
            continue
        est = factory().fit(rows)
        rows.unpersist()
        state = (cls.where(F.col("cls") == c).join(enough, k).join(targets, k)
                 .select(*k, "hist", "n0", "targets"))
        pred = _recursive(est, state, k, cols, FORECAST_MONTHS)
        outputs.append(pred.select(*k, F.posexplode(F.arrays_zip("targets", "pred"))).select(
            *k, F.col("col.targets").alias("date"), F.col("col.pred").alias("pred")))
    if not outputs:
        return None
    out = outputs[0]
    for o in outputs[1:]:
        out = out.unionByName(o)
    return out


def side_by_side(spark, *calls):
    """Results of independent jobs that run at the same time."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [r.result() for r in [pool.submit(inheritable_thread_target(spark)(c)) for c in calls]]


def _class_array(of: Callable[[str], Column], n: Column) -> Column:
    """The active features of a series of length ``n``, in frame order, as an array."""
    row = lambda c: F.array(*[of(x).cast("double") for x in feature_columns(_CLASS_LEN[c])])
    return F.when(length_class(n) == 2, row(2)).when(length_class(n) == 1, row(1)).otherwise(row(0))


def _boost_series(train: DataFrame, test_targets: DataFrame, full: DataFrame, future: DataFrame, k: list[str], p: bo.Boosting):
    """M8: one model per series and fit; predictions (keys, date, pred) of the evaluation and of the final fit.

    Feature rows, history and forecast dates of a series become one row of arrays, as long as the
    series has months; rows are dealt out in small parts, and fitting and the recursion run in one
    stage without a shuffle of models.
    """
    kk = [*k, "__fit"]
    both = train.withColumn("__fit", F.lit("eval")).unionByName(full.withColumn("__fit", F.lit("final")))
    targets = test_targets.withColumn("__fit", F.lit("eval")).unionByName(future.withColumn("__fit", F.lit("final")))
    feats = add_features(both, kk)
    x = _class_array(F.col, F.col("series_n"))
    usable = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = feats.select(*kk, "date", "target", "series_n", x.alias("x")).withColumn("x", F.when(usable, F.col("x")))
    series = rows.groupBy(*kk).agg(F.array_sort(F.collect_list(F.struct("date", "target", "x"))).alias("r"), F.first("series_n").alias("n0"))
    used = F.filter("r", lambda r: r["x"].isNotNull())
    # Series with too few feature rows are not fitted
    series = series.where(F.size(used) >= TREE_MIN_FEATURE_ROWS).join(targets, kk).select(
        *kk, "n0", "targets", F.transform("r", lambda r: r["target"]).alias("hist"),
        F.transform(used, lambda r: r["x"]).alias("xs"), F.transform(used, lambda r: r["target"]).alias("ys"))
    series = materialize(series, "table")
    parts = -(-series.count() // SERIES_PER_TASK)
    state = bo.with_models(series.repartition(max(1, parts), *kk), p)
    for s in range(1, FORECAST_MONTHS + 1):
        date = F.try_element_at("targets", F.least(F.lit(s), F.greatest(F.size("targets"), F.lit(1))))
        # the class is that of the series the model was fitted on, not of the growing history
        names = dict(zip(RECURSIVE_FEATURES, recursive_feature_row(F.col("hist"), date)))
        state = bo.with_predictions(state.withColumn("x", _class_array(names.__getitem__, F.col("n0"))), p)
        state = state.withColumn("hist", F.when(F.size("targets") >= s, F.array_append("hist", F.greatest(F.lit(0.0), F.col("prediction"))))
                                 .otherwise(F.col("hist"))).drop("prediction")
    out = materialize(state.select(*kk, "targets", F.slice("hist", F.col("n0") + 1, F.size("targets")).alias("pred")), "table")
    out = out.select(*kk, F.posexplode(F.arrays_zip("targets", "pred"))).select(*kk, F.col("col.targets").alias("date"), F.col("col.pred").alias("pred"))
    return tuple(out.where(F.col("__fit") == fit).drop("__fit") for fit in ("eval", "final"))


def tree_model(monthly: DataFrame, name: str, factory: Callable, keys: Sequence[str] | None = None,
               strict: bool | None = None) -> ModelRun:
    """M9 for one tree model: fit on the training slice, evaluate recursively on the holdout,
    refit on the whole series and forecast the next three months."""
    m, k = _k(monthly.select(*(keys or []), "date", "target"), keys)
    # The monthly table is small and read by every fit/step: write it once.
    m = materialize(m, "table")
    strict = (not keys) if strict is None else strict
    split = materialize(split_holdout(m, k), "table")
    n_series = m.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    if strict:
        n = n_series.first()["n"]
        if n < TREE_MIN_MONTHS:
            raise NotEnoughHistory("Not enough monthly history to train forecasting models reliably.")
    eligible = n_series.where(F.col("n") >= TREE_MIN_MONTHS).select(*k)
    train = split.where(~F.col("is_holdout")).join(eligible, k).select(*k, "date", "target")
    test = split.where(F.col("is_holdout")).join(eligible, k)
    test_targets = test.groupBy(*k).agg(F.array_sort(F.collect_list("date")).alias("targets"))
    last = m.join(eligible, k).groupBy(*k).agg(F.max("date").alias("_last"))
    future = last.select(*k, F.transform(F.sequence(F.lit(1), F.lit(FORECAST_MONTHS)),
                                         lambda i: F.add_months("_last", i)).alias("targets"))
    full = m.join(eligible, k).select(*k, "date", "target")
    learner = factory()
    if isinstance(learner, bo.Boosting):
        ev, fin = _boost_series(train, test_targets, full, future, k, learner)
        if strict and ev.isEmpty():
            ev = None
    else:
        # Two independent fits, of many small jobs each: side by side.
        ev, fin = side_by_side(monthly.sparkSession, *(
            lambda rows=rows, dates=dates: _fit_by_class(rows, k, factory, dates) for rows, dates in ((train, test_targets), (full, future))))
    if strict and ev is None:
        raise NotEnoughHistory("Not enough lagged history to train forecasting models reliably.")
    spark = monthly.sparkSession
    if ev is None:
        pairs = spark.createDataFrame([], test.select(*k, F.lit(0.0).alias("actual"), F.lit(0.0).alias("predicted")).schema)
    else:
        pairs = test.select(*k, "date", F.col("target").alias("actual")).join(ev, k + ["date"]) \
            .select(*k, "actual", F.col("pred").alias("predicted"))
    met = metrics(pairs, k)
    res = n_series.join(met, k, "left").select(
        *k, F.lit(name).alias("model"), "mae", "rmse", "mape", "r2",
        F.when(F.col("rmse").isNotNull(), F.lit("trained")).otherwise(F.lit("skipped")).alias("status"),
        F.when(F.col("rmse").isNotNull(), F.lit(None).cast("string"))
         .otherwise(F.lit("Not enough monthly history to train forecasting models reliably.")).alias("reason"))
    if fin is None:
        fc = spark.createDataFrame([], "date date, pred double")
        for c in reversed(k):
            fc = fc.withColumn(c, F.lit(None).cast(dict(m.dtypes)[c]))
    else:
        fc = fin
    fcs = fc.select(*k, F.lit(name).alias("model"), "date", round_half_up(F.col("pred")).alias("value"))
    fcs = fcs.join(res.where(F.col("status") == "trained").select(*k), k, "left_semi")  # M10: none for a skipped series
    if not keys:
        res, fcs = res.drop(_ONE), fcs.drop(_ONE)
    return ModelRun(res, fcs)


# ---------------------------------------------------------------- M11: window autoregression

def _ar_state(monthly: DataFrame, k: list[str]) -> DataFrame:
    """Per series: values, min/max scaling and window size (W10, W9 sizing)."""
    h = _histories(monthly, k)
    lo = F.array_min("hist")
    hi = F.array_max("hist")
    rng = hi - lo
    scaled = F.transform("hist", lambda v: F.when(rng == 0, v - lo).otherwise((v - lo) / rng))
    return h.select(*k, "hist", "dates", lo.alias("lo"), hi.alias("hi"), scaled.alias("scaled"),
                    F.when(F.size("hist") >= 12, F.lit(6)).otherwise(F.lit(3)).alias("w"))


def _ar_fit_predict(monthly: DataFrame, k: list[str], targets: DataFrame) -> DataFrame:
    """(keys, date, pred): one regression per series on its own windows, fed its own predictions."""
    st = _ar_state(monthly, k).where(F.size("hist") - F.col("w") >= AR_MIN_SEQUENCES)
    # W9 and the fit: written once, so that the elimination is not repeated for every use of a coefficient
    fitted = materialize(st.select(*k, "lo", "hi", "scaled", "w", rg.window_equations(F.col("scaled"), F.col("w"), AR_RIDGE).alias("eq"))
                         .withColumn("c", rg.solve(F.col("eq"), F.col("w") + 1)), "table")
    ahead = fitted.join(targets, k).withColumn("all", rg.feed_back(F.col("scaled"), F.col("c"), F.col("w"), F.size("targets")))
    rng = F.col("hi") - F.col("lo")
    pred = F.transform(F.slice("all", F.size("scaled") + 1, F.size("targets")),
                       lambda v: F.greatest(F.lit(0.0), F.when(rng == 0, v + F.col("lo")).otherwise(v * rng + F.col("lo"))))
    return ahead.select(*k, F.posexplode(F.arrays_zip("targets", pred.alias("pred")))).select(
        *k, F.col("col.targets").alias("date"), F.col("col.pred").alias("pred"))


def window_ar(monthly: DataFrame, keys: Sequence[str] | None = None) -> ModelRun:
    """Linear autoregression on the last 3/6 min-max-scaled months, one-step feedback; a model per series."""
    m, k = _k(monthly.select(*(keys or []), "date", "target"), keys)
    m = materialize(m, "table")
    split = materialize(split_holdout(m, k), "table")
    n_series = m.groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    eligible = n_series.where(F.col("n") >= AR_MIN_MONTHS).select(*k)
    train = split.where(~F.col("is_holdout")).join(eligible, k).select(*k, "date", "target")
    # pre-holdout history must exceed window + 2
    tl = train.groupBy(*k).agg(F.count(F.lit(1)).alias("tn"))
    eligible = tl.where(F.col("tn") > F.when(F.col("tn") >= 12, 6).otherwise(3) + 2).select(*k)
    train = train.join(eligible, k)
    test = split.where(F.col("is_holdout")).join(eligible, k)
    tt = test.groupBy(*k).agg(F.array_sort(F.collect_list("date")).alias("targets"))
    ev = _ar_fit_predict(train, k, tt)
    last = m.join(eligible, k).groupBy(*k).agg(F.max("date").alias("_last"))
    future = last.select(*k, F.transform(F.sequence(F.lit(1), F.lit(FORECAST_MONTHS)),
                                         lambda i: F.add_months("_last", i)).alias("targets"))
    fin = _ar_fit_predict(m.join(eligible, k).select(*k, "date", "target"), k, future)
    pairs = test.select(*k, "date", F.col("target").alias("actual")).join(ev, k + ["date"]) \
        .select(*k, "actual", F.col("pred").alias("predicted"))
    met = metrics(pairs, k)
    res = n_series.join(met, k, "left").select(
        *k, F.lit(WINDOW_AR).alias("model"), "mae", "rmse", "mape", "r2",
        F.when(F.col("rmse").isNotNull(), F.lit("trained")).otherwise(F.lit("skipped")).alias("status"),
        F.when(F.col("rmse").isNotNull(), F.lit(None).cast("string"))
         .otherwise(F.lit("Not enough history for stable window autoregression.")).alias("reason"))
    fcs = fin.select(*k, F.lit(WINDOW_AR).alias("model"), "date", round_half_up(F.col("pred")).alias("value"))
    fcs = fcs.join(res.where(F.col("status") == "trained").select(*k), k, "left_semi")  # M10: none for a skipped series
    if not keys:
        res, fcs = res.drop(_ONE), fcs.drop(_ONE)
    return ModelRun(res, fcs)
