"""The full analysis as one chain of DataFrame operators.

``analyze`` returns lazy DataFrames for every part of the result plus a
one-row run document.  With ``series_keys`` every monthly-level table carries
the keys, and there is one run document per series (else one per upload).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce
from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from shelfcast.functions.exprs import float_text
from shelfcast.operators import evaluate as ev
from shelfcast.operators import forecast as fc
from shelfcast.operators import insights as ins
from shelfcast.operators import monthly as mo
from shelfcast.operators import recommend as rec
from shelfcast.operators import report as rp
from shelfcast.operators import select as sel
from shelfcast.operators.cleaning import CleanResult, clean, drop_all_null_columns, require_rows
from shelfcast.operators.roles import RoleSchema, detect_roles, normalize_columns
from shelfcast.session import materialize


@dataclass
class Analysis:
    run_id: str
    schema: RoleSchema
    cleaning: CleanResult
    monthly: DataFrame
    meta: DataFrame
    overview: DataFrame
    top_segments: DataFrame
    seasonal: DataFrame
    anomalies: DataFrame
    trend: DataFrame
    peak_low: DataFrame
    results: DataFrame
    forecasts: DataFrame
    best: DataFrame
    confidence: DataFrame
    forecast_summary: DataFrame
    recommendations: DataFrame
    run: DataFrame | None


def fit_models(series: DataFrame, keys: Sequence[str] | None = None, forest_factory=None, boosting_factory=None):
    """(results, forecasts) of all four models on (keys, date, target), fitted side by side."""
    keys = list(keys or [])
    series = materialize(series, "table")
    forest, boosting, ar, base = fc.side_by_side(
        series.sparkSession,
        lambda: fc.tree_model(series, fc.FOREST, forest_factory or fc.forest(), keys),
        lambda: fc.tree_model(series, fc.BOOSTING, boosting_factory or fc.boosting(), keys),
        lambda: fc.window_ar(series, keys),
        lambda: fc.ModelRun(ev.baseline_eval(series, keys), ev.baseline_forecast(series, keys)))
    runs = [forest, boosting, base, ar]
    results, forecasts = runs[0].results, runs[0].forecasts
    for r in runs[1:]:
        results, forecasts = results.unionByName(r.results), forecasts.unionByName(r.forecasts)
    return materialize(ev.round_metrics(results), "table"), materialize(forecasts, "table")


def choose(results: DataFrame, meta: DataFrame, keys: Sequence[str] | None = None):
    """(best, confidence): M12 and M13, with the reason that names the reliability."""
    best = sel.best_model(results, keys)
    conf = sel.confidence(results, best, meta, keys)
    return sel.final_best(best, conf, keys), conf


def analyze(raw: DataFrame, date_column: str | None = None, target_column: str | None = None,
            item_column: str | None = None, series_keys: Sequence[str] | None = None,
            forest_factory=None, boosting_factory=None, run_id: str | None = None,
            date_format: str | None = None) -> Analysis:
    keys = list(series_keys or [])
    run_id = run_id or uuid.uuid4().hex
    raw = require_rows(drop_all_null_columns(raw))                      # S3, S4
    schema = detect_roles(normalize_columns(raw), date_column, target_column, item_column)  # P1-P6
    cleaned = clean(raw, schema, date_format=date_format)                # C1-C14
    target = schema.target_column
    rows = cleaned.frame
    partial = schema.date_column is not None
    monthly, meta = mo.monthly_series_and_meta(rows, target, keys, partial_rule=partial)
    series = monthly.select(*keys, "date", "target")

    results, forecasts = fit_models(series, keys, forest_factory, boosting_factory)
    best, conf = choose(results, meta, keys)
    summary = sel.forecast_summary(forecasts, best, keys)
    recs = rec.recommendations(rows, schema, target)
    a = Analysis(run_id, schema, cleaned, monthly, meta, ins.overview(rows, schema, target),
                 ins.top_segments(rows, schema, target), ins.seasonal_pattern(series, keys),
                 ins.iqr_anomalies(series, keys), ins.trend_direction(series, keys), ins.peak_low(series, keys),
                 results, forecasts, best, conf, summary, recs, None)
    a.run = run_row(a, keys)
    return a


def _one(df: DataFrame, run_id: str) -> DataFrame:
    return df.withColumn("run_id", F.lit(run_id))


def run_row(a: Analysis, keys: Sequence[str] | None = None) -> DataFrame:
    """Flat run record (what Q1 and the dashboard read): one row per run, or per
    series when ``keys`` are given (run-wide fields repeated on each)."""
    keys = list(keys or [])
    rid = a.run_id
    s = a.cleaning.summary.select(
        "cleaning_applied", "duplicates_removed", "invalid_dates_removed",
        F.size(F.map_keys("filled_numeric_columns")).alias("filled_numeric_count"),
        F.size(F.map_keys("filled_categorical_columns")).alias("filled_categorical_count"))
    conf = a.confidence.select(*keys, F.col("label").alias("confidence_label"), F.col("reason").alias("confidence_reason"))
    best = a.best.select(*keys, F.col("model").alias("best_model"), F.col("reason").alias("best_reason"))
    num = lambda c: F.coalesce(float_text(F.col(c)), F.lit("None"))
    line = F.when(F.col("status") == "trained", F.concat(
        F.col("model"), F.lit(": MAE "), num("mae"), F.lit(", RMSE "), num("rmse"), F.lit(", MAPE "), num("mape"),
        F.lit(", R2 "), num("r2"))).otherwise(F.concat(F.col("model"), F.lit(": "),
                                                        F.coalesce(F.col("reason"), F.lit("not trained"))))
    order = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in fc.MODEL_ORDER]), F.col("model")), F.lit(99))
    lines = a.results.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l")))), lambda x: x["l"]), " | ")
        .alias("model_lines"))
    top = a.recommendations.limit(1).select(
        F.col("item").alias("top_item"), F.col("group").alias("top_group"), F.col("recent_sales").alias("top_recent"),
        F.col("prior_sales").alias("top_prior"), F.col("growth_pct").alias("top_growth"),
        F.col("action").alias("top_action"), F.col("risk").alias("top_risk"))
    pts = a.forecast_summary.groupBy(*keys).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("date", "value"))),
        lambda p: F.concat(F.date_format(p["date"], "yyyy-MM-dd"), F.lit(": "), float_text(p["value"]))),
        ", ").alias("forecast_points"))
    ov = a.overview.select("date_start", "date_end", "row_count", "column_count", "target_column", "target_sum")
    tr = a.trend.select(*keys, "trend_direction")
    # per-series pieces join on the keys; run-wide pieces (one row each) on run_id
    series = conf
    for piece, how in [(best, "inner"), (lines, "left"), (pts, "left"), (tr, "left")]:
        if keys:
            series = series.join(piece, keys, how)
        else:
            series = _one(series, rid).join(_one(piece, rid), "run_id", how).drop("run_id")
    out = _one(s, rid).join(_one(series, rid), "run_id")
    for piece, how in [(top, "left"), (ov, "inner")]:
        out = out.join(_one(piece, rid), "run_id", how)
    return out


def _assembled(pieces: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per ``keys`` (one row without keys) that holds the column of every piece."""
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pieces)
    first = [F.first(c, ignorenulls=True).alias(c) for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(*first)


def _record(df: DataFrame, name: str, keys: Sequence[str] = (), *more) -> DataFrame:
    return df.select(*keys, F.struct(*[F.col(c) for c in df.columns if c not in keys], *more).alias(name))


def _records(df: DataFrame, name: str, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    cols = [*order, *[c for c in df.columns if c not in (*order, *keys)]]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))


def run_document(a: Analysis, file_name: str = "", size_bytes: int = 0, keys: Sequence[str] | None = None) -> DataFrame:
    """The nested run result, ready for :func:`shelfcast.sources.save_run`: one row, or one per
    series when ``keys`` are given.

    The parts of a series are united and grouped once by the keys.  What describes the whole run
    (roles, cleaning, overview, the first 12 rows, the top lists) is one small row; it is fetched
    and stands in every document.
    """
    keys = list(keys or [])
    sc = a.schema
    schema_row = a.cleaning.summary.sparkSession.createDataFrame(
        [(sc.date_column, sc.year_column, sc.month_column, sc.time_column, sc.target_column, sc.item_column,
          sc.item_group_column, list(sc.sales_columns), list(sc.date_candidates), list(sc.target_candidates),
          list(sc.item_candidates), sc.can_auto_detect)],
        "date_column string, year_column string, month_column string, time_column string, target_column string, "
        "item_column string, item_group_column string, sales_columns array<string>, date_candidates array<string>, "
        "target_candidates array<string>, item_candidates array<string>, can_auto_detect boolean")
    context = a.cleaning.summary.sparkSession.createDataFrame(
        [([(t, list(c)) for t, c in sc.context_columns],)], "context_columns array<struct<type: string, columns: array<string>>>")
    columns = F.array(*[F.lit(c) for c in a.cleaning.frame.columns]).alias("columns")
    rank = F.monotonically_increasing_id().alias("rank")
    whole = _assembled([
        _record(schema_row, "schema"), context, _record(a.cleaning.summary, "cleaning_summary"),
        _record(a.overview.drop("columns"), "overview", (), columns),
        _records(ins.preview(a.cleaning.frame).select(rank, F.struct("*").alias("row")), "preview_rows", ["rank"])
        .select(F.transform("preview_rows", lambda r: r["row"]).alias("preview_rows")),
        _records(a.recommendations.select(rank, "*"), "recommendations", ["rank"]),
        _records(a.top_segments.select(rank, "*"), "top_segments", ["rank"])], [])
    dated = F.date_format("date", "yyyy-MM-dd").alias("date")
    order = F.array_position(F.array(*[F.lit(m) for m in fc.MODEL_ORDER]), F.col("model")).alias("o")
    pieces = [
        _record(a.meta, "monthly_meta", keys), _record(a.confidence, "confidence_summary", keys),
        _records(a.monthly.select(*keys, dated, F.col("target").alias("value")), "monthly_series", ["date"], keys),
        _records(a.results.select(*keys, order, "model", "mae", "rmse", "mape", "r2", "status", "reason"), "model_results", ["o"], keys),
        _record(a.best, "best_model", keys),
        _records(a.forecast_summary.select(*keys, dated, "value"), "forecast_summary", ["date"], keys),
        _records(a.forecasts.select(*keys, "model", dated, "value"), "forecasts", ["model", "date"], keys),
        _record(a.trend, "trend", keys), _record(a.anomalies, "anomalies", keys), _record(a.peak_low, "peak_low", keys),
        _records(a.seasonal, "seasonal_pattern", ["month_num"], keys)]
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S") + "Z"
    text = whole.select(F.to_json(F.struct("*")).alias("j")).first()["j"]
    run = F.from_json(F.lit(text), whole.schema)
    series = _assembled(pieces, keys)
    parts = [F.coalesce(F.col(f.name), F.array().cast(f.dataType)).alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name)
             for f in series.schema.fields if f.name not in keys]
    return series.select(F.lit(a.run_id).alias("run_id"), *keys,
                         F.struct(F.lit(file_name).alias("name"), F.lit(size_bytes).alias("size_bytes")).alias("file"),
                         *[run[c].alias(c) for c in whole.columns], *parts, F.lit(now).alias("generated_at"))


def chat(a_run: DataFrame, questions: DataFrame, message_col: str = "message",
         on: Sequence[str] = ("run_id",)) -> DataFrame:
    """Q1 for a batch of questions against run rows (joined on run_id, plus the series keys
    when the run was keyed)."""
    return rp.answer_questions(questions, a_run, message_col, on)
