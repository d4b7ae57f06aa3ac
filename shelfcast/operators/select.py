"""Model choice, confidence label and forecast summary (M12-M14), one row per series."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.exprs import round_half_up
from shelfcast.operators.forecast import MODEL_ORDER

BASELINE = "Seasonal Baseline"

# Explanation texts.
REASON_BASELINE_BEST = ("It produced the lowest leakage-free holdout RMSE, so the simpler baseline is "
                        "preferred over the ML models for this upload.")
REASON_MODEL_BEST = "It delivered the lowest leakage-free holdout RMSE among the trained candidates."
REASON_UNAVAILABLE = "No candidate models were trained successfully."
CONFIDENCE_TEXT = {
    "Baseline-led": ("The seasonal baseline outperformed the trained ML models on the leakage-free holdout, "
                     "so it is the most defensible forecast for this upload."),
    "Strong": ("The selected model clearly beat the baseline on this upload and is suitable for confident "
               "directional forecasting."),
    "Directional": ("The selected model beat the baseline and is suitable for directional planning, though it "
                    "should still be explained with its metrics."),
    "Exploratory": ("The forecast is useful for pattern review, but this upload still needs careful "
                    "interpretation before making inventory decisions."),
}
# Gaps are interpolated, so the note says so.
GAP_NOTE = " Some months had no rows in the upload, so those periods were filled by linear interpolation."
STRONG_MAPE, DIRECTIONAL_MAPE, BEATS_RATIO = 12.0, 20.0, 0.95


def _order(model: F.Column) -> F.Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(m) for m in MODEL_ORDER]), model), F.lit(99))


def best_model(results: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Lowest RMSE (compared at 4 decimals) among trained models; ties -> listed model order."""
    keys = list(keys or [])
    trained = results.where((F.col("status") == "trained") & F.col("rmse").isNotNull())
    rank_key = F.struct(round_half_up(F.col("rmse"), 4).alias("r"), _order(F.col("model")).alias("o"))
    pick = trained.groupBy(*keys).agg(F.min_by(F.struct("model", "mae", "rmse", "mape", "r2"), rank_key).alias("b"))
    # A global aggregate always yields one row (b is null when nothing was trained).
    j = results.select(*keys).distinct().join(pick, keys, "left") if keys else pick
    b = F.col("b")
    return j.select(*keys, F.coalesce(b["model"], F.lit("Unavailable")).alias("model"),
                    b["mae"].alias("mae"), b["rmse"].alias("rmse"), b["mape"].alias("mape"), b["r2"].alias("r2"),
                    F.when(b.isNull(), F.lit(REASON_UNAVAILABLE))
                     .when(b["model"] == BASELINE, F.lit(REASON_BASELINE_BEST))
                     .otherwise(F.lit(REASON_MODEL_BEST)).alias("reason"))


def confidence(results: DataFrame, best: DataFrame, meta: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Baseline-led / Strong / Directional / Exploratory with the reasons and inputs."""
    keys = list(keys or [])
    base = (results.where((F.col("model") == BASELINE) & (F.col("status") == "trained"))
            .select(*keys, F.col("model").alias("baseline_model"), F.col("rmse").alias("baseline_rmse")))
    b = best.select(*keys, F.col("model").alias("_best"), F.col("rmse").alias("best_model_rmse"),
                    F.col("r2").alias("best_model_r2"), F.col("mape").alias("best_model_mape"))
    m = meta.select(*keys, "missing_months_filled", "partial_last_period_removed")
    if keys:
        j = b.join(base, keys, "left").join(m, keys, "left")
    else:
        j = b.withColumn("_j", F.lit(1)).join(base.withColumn("_j", F.lit(1)), "_j", "left") \
            .join(m.withColumn("_j", F.lit(1)), "_j", "left").drop("_j")
    sel_base = F.col("_best") == BASELINE
    beats = (F.col("baseline_rmse").isNotNull() & F.col("best_model_rmse").isNotNull() & ~sel_base
             & (F.col("best_model_rmse") <= F.col("baseline_rmse") * BEATS_RATIO))
    beats = F.coalesce(beats, F.lit(False))
    gaps = F.coalesce(F.col("missing_months_filled"), F.lit(0))
    sparse = (gaps > 0) | F.coalesce(F.col("partial_last_period_removed"), F.lit(False))
    mape = F.col("best_model_mape")
    label = (F.when(sel_base, F.lit("Baseline-led"))
             .when(mape.isNotNull() & (mape <= STRONG_MAPE) & beats & ~sparse, F.lit("Strong"))
             .when(mape.isNotNull() & (mape <= DIRECTIONAL_MAPE) & beats, F.lit("Directional"))
             .otherwise(F.lit("Exploratory")))
    reason = F.lit(None).cast("string")
    for name, text in CONFIDENCE_TEXT.items():
        reason = F.when(label == name, F.lit(text)).otherwise(reason)
    reason = F.when(gaps > 0, F.concat(reason, F.lit(GAP_NOTE))).otherwise(reason)
    return j.select(*keys, label.alias("label"), reason.alias("reason"), beats.alias("beats_baseline"),
                    F.coalesce(sel_base, F.lit(False)).alias("selected_is_baseline"), "baseline_model",
                    "baseline_rmse", "best_model_rmse", "best_model_r2", "best_model_mape",
                    sparse.alias("sparse_series"))


def final_best(best: DataFrame, conf: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The chosen model with its reason rewritten to name the reliability label."""
    keys = list(keys or [])
    c = conf.select(*keys, F.col("label").alias("_label"))
    j = best.join(c, keys) if keys else best.withColumn("_j", F.lit(1)).join(c.withColumn("_j", F.lit(1)), "_j").drop("_j")
    text = F.concat(F.col("model"), F.lit(" was selected because it achieved the lowest RMSE on the leakage-free "
                                           "holdout evaluation. Forecast reliability for this upload is "),
                    F.col("_label"), F.lit("."))
    return j.select(*keys, "model", "mae", "rmse", "mape", "r2",
                    F.when(F.col("model") == "Unavailable", F.col("reason")).otherwise(text).alias("reason"))


def forecast_summary(forecasts: DataFrame, best: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The winner's forecast points, else those of the first model that has any."""
    keys = list(keys or [])
    avail = forecasts.groupBy(*keys, "model").agg(F.count(F.lit(1)).alias("_n"))
    b = best.select(*keys, F.col("model").alias("_best"))
    j = avail.join(b, keys, "left") if keys else avail.withColumn("_j", F.lit(1)).join(
        b.withColumn("_j", F.lit(1)), "_j", "left").drop("_j")
    pick = j.groupBy(*keys).agg(F.min_by("model", F.struct(
        (F.col("model") != F.coalesce(F.col("_best"), F.lit(""))).alias("not_best"),
        _order(F.col("model")).alias("o"))).alias("model"))
    return forecasts.join(pick, keys + ["model"]).select(*keys, "model", "date", "value")
