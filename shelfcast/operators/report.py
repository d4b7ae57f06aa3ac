"""Dashboard tables and chat answers."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.exprs import compact_number, float_text, fmt2


def trend_series(monthly: DataFrame, forecast: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """History then forecast, months as yyyy-MM; the last history month also carries the
    forecast line (bridge) when a forecast exists."""
    keys = list(keys or [])
    last = monthly.groupBy(*keys).agg(F.max("date").alias("_last"))
    has_fc = forecast.groupBy(*keys).agg(F.lit(True).alias("_has"))
    h = monthly.join(last, keys) if keys else monthly.withColumn("_j", F.lit(1)).join(
        last.withColumn("_j", F.lit(1)), "_j").drop("_j")
    h = h.join(has_fc, keys, "left") if keys else h.withColumn("_j", F.lit(1)).join(
        has_fc.withColumn("_j", F.lit(1)), "_j", "left").drop("_j")
    hist = h.select(*keys, F.date_format("date", "yyyy-MM").alias("date"), F.lit(0).alias("part"),
                    F.col("target").alias("historical"),
                    F.when(F.coalesce(F.col("_has"), F.lit(False)) & (F.col("date") == F.col("_last")),
                           F.col("target")).alias("forecast"))
    fc = forecast.select(*keys, F.date_format("date", "yyyy-MM").alias("date"), F.lit(1).alias("part"),
                         F.lit(None).cast("double").alias("historical"), F.col("value").alias("forecast"))
    return hist.unionByName(fc)


def forecast_average(summary: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Mean forecast value, 0 when there is none."""
    keys = list(keys or [])
    return summary.groupBy(*keys).agg(F.coalesce(F.avg("value"), F.lit(0.0)).alias("forecast_average"))


def headline(recs: DataFrame) -> DataFrame:
    """D3: dashboard headline from the top recommendation."""
    top = recs.limit(1)
    text = F.when(F.col("risk") == "low", F.concat(F.col("item"), F.lit(" currently has the strongest recent demand."))) \
        .otherwise(F.concat(F.col("item"), F.lit(" needs inventory attention.")))
    one = recs.sparkSession.range(1).select(F.lit(1).alias("_j"))
    j = one.join(top.select(text.alias("_t")).withColumn("_j", F.lit(1)), "_j", "left")
    return j.select(F.coalesce(F.col("_t"), F.lit("Recommendations ready")).alias("headline"))


def model_table(results: DataFrame, best: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Trained models with metrics at 2 decimals ('-' when missing) and the selected flag."""
    keys = list(keys or [])
    b = best.select(*keys, F.col("model").alias("_best"))
    t = results.where(F.col("status") == "trained")
    j = t.join(b, keys, "left") if keys else t.withColumn("_j", F.lit(1)).join(
        b.withColumn("_j", F.lit(1)), "_j", "left").drop("_j")
    return j.select(*keys, "model", fmt2(F.col("mae")).alias("mae"), fmt2(F.col("rmse")).alias("rmse"),
                    fmt2(F.col("mape")).alias("mape"), fmt2(F.col("r2")).alias("r2"),
                    F.coalesce(F.col("model") == F.col("_best"), F.lit(False)).alias("selected"))


def _thousands(c):
    return F.format_number(c.cast("long"), 0)


def cleaning_report(summary: DataFrame, meta: DataFrame) -> DataFrame:
    """label/value rows of the cleaning summary (one-row inputs)."""
    s = summary.withColumn("_j", F.lit(1)).join(meta.withColumn("_j", F.lit(1)), "_j")
    def row(pos, label, value):
        return F.struct(F.lit(pos).alias("pos"), F.lit(label).alias("label"), value.alias("value"))

    pairs = F.array(
        row(1, "Rows before cleaning", _thousands(F.col("original_rows"))),
        row(2, "Rows after cleaning", _thousands(F.col("rows_after_cleaning"))),
        row(3, "Duplicates removed", _thousands(F.col("duplicates_removed"))),
        row(4, "Invalid dates removed", _thousands(F.col("invalid_dates_removed"))),
        row(5, "Invalid target rows removed", _thousands(F.coalesce(F.col("target_values_removed"), F.lit(0)))),
        row(6, "Monthly gaps handled",
            F.concat(_thousands(F.col("missing_months_filled")), F.lit(" ("),
                     F.coalesce(F.col("missing_months_method"), F.lit("not needed")), F.lit(")"))),
        row(7, "Trimmed text columns",
            F.when(F.size("trimmed_text_columns") > 0, F.array_join("trimmed_text_columns", ", "))
            .otherwise(F.lit("None"))),
    )
    return s.select(F.inline(pairs))


def compact(df: DataFrame, col: str, out: str = "compact") -> DataFrame:
    """Add an English compact rendering of ``col``."""
    return df.withColumn(out, compact_number(F.col(col)))


# ---------------------------------------------------------------- Q1

# Keyword lists per intent, in priority order.
INTENTS = [
    ("cleaning", ["duplicate", "missing", "clean", "format"]),
    ("reliability", ["reliability", "confidence", "trust", "accurate"]),
    ("why_model", None),
    ("model_metrics", ["best model", "accuracy", "mae", "rmse", "xgboost", "random forest", "lstm", "model"]),
    ("stock", ["stock", "restock", "recommend", "inventory"]),
    ("forecast", ["forecast", "next", "future", "predict"]),
    ("dataset", ["chart", "trend", "summary", "dataset", "column", "data"]),
]


def intent(message: F.Column) -> F.Column:
    """First matching intent of a question (case-insensitive substring rules)."""
    q = F.lower(F.trim(message))
    expr = None
    for name, words in INTENTS:
        cond = (q.contains("why") & q.contains("model")) if words is None else None
        if words is not None:
            for w in words:
                cond = q.contains(w) if cond is None else (cond | q.contains(w))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("fallback"))


def classify_questions(questions: DataFrame, message_col: str = "message") -> DataFrame:
    return questions.withColumn("intent", intent(F.col(message_col)))


def answer_questions(questions: DataFrame, run: DataFrame, message_col: str = "message",
                     on: Sequence[str] = ("run_id",)) -> DataFrame:
    """Q1 in bulk: (run_id, message) rows joined to their run row -> templated answer.

    ``run`` carries one row per run with flat fields (see pipeline.run_row).
    """
    on = list(on)
    q = classify_questions(questions, message_col).join(run, on, "left")
    c = F.col
    yes = lambda b, t, f: F.when(b, F.lit(t)).otherwise(F.lit(f))
    s = lambda x: F.coalesce(x.cast("string"), F.lit("None"))
    fl = lambda x: F.coalesce(float_text(x), F.lit("None"))
    cleaning = F.concat(
        F.lit("The upload pipeline "), yes(c("cleaning_applied"), "did", "did not need to"), F.lit(" apply cleaning. "),
        F.lit("It removed "), s(c("duplicates_removed")), F.lit(" duplicate rows and "), s(c("invalid_dates_removed")),
        F.lit(" rows with invalid dates. Missing numeric fills were applied to "), s(c("filled_numeric_count")),
        F.lit(" columns and categorical fills to "), s(c("filled_categorical_count")), F.lit(" columns."))
    reliability = F.concat(F.lit("Forecast reliability for this upload is "), F.coalesce(c("confidence_label"), F.lit("Developing")),
                           F.lit(". "), F.coalesce(c("confidence_reason"), F.lit("The forecast is best used as directional guidance.")))
    why = F.trim(F.concat(F.coalesce(c("best_model"), F.lit("The selected model")),
                          F.lit(" was chosen because it produced the lowest RMSE in the leakage-free holdout evaluation. "),
                          F.coalesce(c("best_reason"), F.lit("")), F.lit(" The current reliability label is "),
                          F.coalesce(c("confidence_label"), F.lit("Developing")), F.lit(": "),
                          F.coalesce(c("confidence_reason"), F.lit(""))))
    metrics = F.trim(F.concat(F.lit("The selected model for this upload is "), F.coalesce(c("best_model"), F.lit("Unavailable")),
                              F.lit(". "), F.coalesce(c("best_reason"), F.lit("")), F.lit(" "),
                              F.coalesce(c("model_lines"), F.lit(""))))
    no_recs = F.coalesce(c("top_item").isNull(), F.lit(True))
    stock = (F.when(no_recs, F.lit("This dataset did not provide enough item-level detail to generate restocking recommendations."))
             .when(c("top_risk") == "low", F.concat(
                 F.lit("No urgent stock action is being flagged right now. "), c("top_item"),
                 F.lit(" currently leads the recent sales view in "), c("top_group"),
                 F.lit(", and the recommended action is to maintain the current stock plan and monitor the next upload.")))
             .otherwise(F.concat(F.lit("The strongest current restocking signal is "), c("top_item"), F.lit(" in "), c("top_group"),
                                 F.lit(". Recent sales were "), fl(c("top_recent")), F.lit(" versus "), fl(c("top_prior")),
                                 F.lit(" before, giving "), fl(c("top_growth")), F.lit("% growth. Recommended action: "),
                                 c("top_action"), F.lit("."))))
    forecast = F.when(F.coalesce(F.length(c("forecast_points")), F.lit(0)) == 0,
                      F.lit("A future forecast is not available for this run yet.")) \
        .otherwise(F.concat(F.lit("The current 3-month forecast based on "),
                            F.coalesce(c("best_model"), F.lit("the best available model")), F.lit(" is "),
                            c("forecast_points"), F.lit(".")))
    dataset = F.concat(F.lit("The dataset covers "), c("date_start"), F.lit(" to "), c("date_end"), F.lit(" with "),
                       s(c("row_count")), F.lit(" cleaned rows across "), s(c("column_count")),
                       F.lit(" columns. The detected target column is "), c("target_column"),
                       F.lit(" with total observed value "), fl(c("target_sum")), F.lit(". Trend direction is "),
                       F.coalesce(c("trend_direction"), F.lit("not available yet")),
                       F.lit(", and current forecast quality is marked as "),
                       F.coalesce(c("confidence_label"), F.lit("Developing")), F.lit("."))
    fallback = F.when(~no_recs, F.concat(
        F.lit("This run used "), s(c("row_count")), F.lit(" rows and found "),
        F.coalesce(c("best_model"), F.lit("the best available model")),
        F.lit(" as the strongest model. The top recommendation is "), c("top_item"), F.lit(" with action '"),
        c("top_action"), F.lit("'. Ask me about cleaning, forecasts, models, or recommendations for more detail."))) \
        .otherwise(F.concat(F.lit("This run analyzed "), s(c("row_count")), F.lit(" rows and selected "),
                            F.coalesce(c("best_model"), F.lit("the best available model")),
                            F.lit(" as the strongest model. Ask me about cleaning, forecasts, models, charts, or recommendations.")))
    answer = (F.when(c("intent") == "cleaning", cleaning).when(c("intent") == "reliability", reliability)
              .when(c("intent") == "why_model", why).when(c("intent") == "model_metrics", metrics)
              .when(c("intent") == "stock", stock).when(c("intent") == "forecast", forecast)
              .when(c("intent") == "dataset", dataset).otherwise(fallback))
    base_cols = [x for x in questions.columns]
    return q.select(*base_cols, "intent", answer.alias("answer"))
