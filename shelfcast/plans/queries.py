"""Query registry: each entry runs one operator family over the driver tables.

``QUERIES[name](spark, sf_dir) -> DataFrame`` and, where the semantics are
SQL-expressible, ``ORACLE_SQL[name]`` re-states the same result in DuckDB SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.operators import monthly as mo
from shelfcast.operators.cleaning import CleanResult, clean
from shelfcast.operators.roles import detect_roles
from shelfcast.plans import fixtures as fx
from shelfcast.plans import sql_monthly as sm

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn
    return deco


def clean_view(spark: SparkSession, sf_dir: str, view: str = "retail") -> CleanResult:
    raw = {"retail": fx.retail, "retail_gaps": fx.retail_gaps, "retail_dirty": fx.retail_dirty}[view](spark, sf_dir)
    schema = detect_roles(raw)
    return clean(raw, schema)


# ---------------------------------------------------------------- monthly

@register("monthly_sales", sm.monthly_sales_sql())
def q_monthly_sales(spark, sf_dir) -> DataFrame:
    c = clean_view(spark, sf_dir)
    return mo.monthly_sales(c.frame, c.schema.target_column)


@register("monthly_sales_by_type", sm.monthly_sales_sql(["item_type"]))
def q_monthly_sales_by_type(spark, sf_dir) -> DataFrame:
    c = clean_view(spark, sf_dir)
    return mo.monthly_sales(c.frame, c.schema.target_column, keys=["item_type"])


@register("observed_days", sm.observed_days_sql())
def q_observed_days(spark, sf_dir) -> DataFrame:
    c = clean_view(spark, sf_dir)
    return mo.observed_days(c.frame)


@register("monthly_dense", sm.monthly_dense_sql())
def q_monthly_dense(spark, sf_dir) -> DataFrame:
    c = clean_view(spark, sf_dir, "retail_gaps")
    return mo.monthly_series(c.frame, c.schema.target_column)


@register("monthly_dense_by_type", sm.monthly_dense_sql(["item_type"]))
def q_monthly_dense_by_type(spark, sf_dir) -> DataFrame:
    c = clean_view(spark, sf_dir, "retail_gaps")
    return mo.monthly_series(c.frame, c.schema.target_column, keys=["item_type"])


@register("monthly_meta", sm.monthly_meta_sql(["item_type"]))
def q_monthly_meta(spark, sf_dir) -> DataFrame:
    c = clean_view(spark, sf_dir)
    return mo.monthly_meta(c.frame, c.schema.target_column, keys=["item_type"])


@register("monthly_meta_gaps", sm.monthly_meta_sql(gaps=True))
def q_monthly_meta_gaps(spark, sf_dir) -> DataFrame:
    c = clean_view(spark, sf_dir, "retail_gaps")
    return mo.monthly_meta(c.frame, c.schema.target_column)


# ---------------------------------------------------------------- insights
from shelfcast.operators import insights as ins  # noqa: E402
from shelfcast.operators import recommend as rec  # noqa: E402
from shelfcast.plans import sql_insights as si  # noqa: E402


def _dense(spark, sf_dir, keys=()):
    c = clean_view(spark, sf_dir)
    return mo.monthly_series(c.frame, c.schema.target_column, keys=list(keys))


@register("overview", si.OVERVIEW_SQL)
def q_overview(spark, sf_dir):
    c = clean_view(spark, sf_dir)
    return ins.overview(c.frame, c.schema, c.schema.target_column)


@register("top_segments", si.TOP_SEGMENTS_SQL)
def q_top_segments(spark, sf_dir):
    c = clean_view(spark, sf_dir)
    return ins.top_segments(c.frame, c.schema, c.schema.target_column)


@register("seasonal_pattern", si.seasonal_sql())
def q_seasonal(spark, sf_dir):
    return ins.seasonal_pattern(_dense(spark, sf_dir))


@register("seasonal_pattern_by_type", si.seasonal_sql(["item_type"]))
def q_seasonal_by_type(spark, sf_dir):
    return ins.seasonal_pattern(_dense(spark, sf_dir, ["item_type"]), ["item_type"])


@register("iqr_anomalies", si.iqr_sql())
def q_iqr(spark, sf_dir):
    return ins.iqr_anomalies(_dense(spark, sf_dir))


@register("iqr_anomalies_by_type", si.iqr_sql(["item_type"]))
def q_iqr_by_type(spark, sf_dir):
    return ins.iqr_anomalies(_dense(spark, sf_dir, ["item_type"]), ["item_type"])


@register("trend_direction", si.trend_sql())
def q_trend(spark, sf_dir):
    return ins.trend_direction(_dense(spark, sf_dir))


@register("trend_direction_by_type", si.trend_sql(["item_type"]))
def q_trend_by_type(spark, sf_dir):
    return ins.trend_direction(_dense(spark, sf_dir, ["item_type"]), ["item_type"])


@register("peak_low", si.peak_low_sql())
def q_peak_low(spark, sf_dir):
    return ins.peak_low(_dense(spark, sf_dir))


@register("peak_low_by_type", si.peak_low_sql(["item_type"]))
def q_peak_low_by_type(spark, sf_dir):
    return ins.peak_low(_dense(spark, sf_dir, ["item_type"]), ["item_type"])


@register("preview", si.PREVIEW_SQL)
def q_preview(spark, sf_dir):
    c = clean_view(spark, sf_dir)
    return ins.preview(c.frame)


@register("recommendations", si.item_risk_sql(top=5))
def q_recommendations(spark, sf_dir):
    c = clean_view(spark, sf_dir)
    return rec.recommendations(c.frame, c.schema, c.schema.target_column)


@register("item_risk", si.item_risk_sql())
def q_item_risk(spark, sf_dir):
    c = clean_view(spark, sf_dir)
    return rec.item_risk(c.frame, c.schema, c.schema.target_column).select(*rec.OUTPUT)


# ---------------------------------------------------------------- features and baseline (W, M1, M2, M5, M6)
from shelfcast.functions.exprs import round_half_up  # noqa: E402
from shelfcast.operators import evaluate as ev  # noqa: E402
from shelfcast.operators import features as fe  # noqa: E402
from shelfcast.plans import sql_features as sf_  # noqa: E402

_FEATURE_DOUBLES = ["month_sin", "month_cos", "lag_1", "lag_2", "lag_3", "lag_6", "lag_12", "rolling_mean_3",
                    "rolling_std_3", "rolling_mean_6", "pct_change_1", "pct_change_3"]


def _round_cols(df, cols, digits):
    return df.select(*[round_half_up(F.col(c), digits).alias(c) if c in cols else F.col(c) for c in df.columns])


@register("features", sf_.features_sql())
def q_features(spark, sf_dir):
    return _round_cols(fe.feature_frame(_dense(spark, sf_dir)), _FEATURE_DOUBLES, 6)


@register("features_by_type", sf_.features_sql(["item_type"]))
def q_features_by_type(spark, sf_dir):
    return _round_cols(fe.feature_frame(_dense(spark, sf_dir, ["item_type"]), ["item_type"]), _FEATURE_DOUBLES, 6)


@register("minmax_scale", sf_.minmax_sql())
def q_minmax(spark, sf_dir):
    return _round_cols(fe.minmax_scale(_dense(spark, sf_dir).select("date", "target")), ["scaled"], 6)


@register("lag_sequences", sf_.lag_sequences_sql())
def q_lag_sequences(spark, sf_dir):
    s = fe.minmax_scale(_dense(spark, sf_dir).select("date", "target"))
    seq = fe.lag_sequences(s)
    return seq.select("date", F.array_join(F.transform("x", lambda v: F.format_string("%.6f", v)), ",").alias("x"),
                      round_half_up(F.col("y"), 6).alias("y"), F.col("window").alias("seq_window"))


@register("baseline_eval", sf_.baseline_eval_sql())
def q_baseline_eval(spark, sf_dir):
    return ev.round_metrics(ev.baseline_eval(_dense(spark, sf_dir).select("date", "target")))


@register("baseline_eval_by_type", sf_.baseline_eval_sql(["item_type"]))
def q_baseline_eval_by_type(spark, sf_dir):
    return ev.round_metrics(ev.baseline_eval(_dense(spark, sf_dir, ["item_type"]).select("item_type", "date", "target"),
                                             ["item_type"]))


@register("baseline_forecast", sf_.baseline_forecast_sql())
def q_baseline_forecast(spark, sf_dir):
    return ev.baseline_forecast(_dense(spark, sf_dir).select("date", "target"))


@register("baseline_forecast_by_type", sf_.baseline_forecast_sql(["item_type"]))
def q_baseline_forecast_by_type(spark, sf_dir):
    return ev.baseline_forecast(_dense(spark, sf_dir, ["item_type"]).select("item_type", "date", "target"), ["item_type"])


# ---------------------------------------------------------------- roles (P1-P7) and cleaning
from shelfcast.operators import roles as ro  # noqa: E402
from shelfcast.plans import sql_roles as sr  # noqa: E402


def _catalog(spark, sf_dir):
    """The column catalog of the driver's tables, and the profile of their rows."""
    frames = {t: fx.table(spark, sf_dir, t) for t in fx.TABLES}
    return ro.catalog_from_frames(spark, frames), ro.column_profile(frames)


@register("normalized_columns", sr.NORMALIZED_SQL)
def q_normalized_columns(spark, sf_dir):
    catalog, profile = _catalog(spark, sf_dir)
    return ro.normalized_catalog(catalog).join(profile, ["table_name", "column_name"])


def _profiled(df, profile, column, **values):
    """Columns of the profile of the (normalised) column that ``column`` names, under other names."""
    p = profile.select(F.col("table_name").alias("__t"), ro.normalize_name_expr(F.col("column_name")).alias("__c"), *[F.col(v).alias(k) for k, v in values.items()])
    return df.join(p, (F.col("table_name") == F.col("__t")) & (F.col(column) == F.col("__c")), "left").drop("__t", "__c")


@register("role_scores", sr.ROLE_SCORES_SQL)
def q_role_scores(spark, sf_dir):
    catalog, profile = _catalog(spark, sf_dir)
    return _profiled(ro.role_scores(catalog), profile, "column_name", non_null="non_null", distinct_values="distinct_values")


@register("role_detection", sr.ROLE_DETECTION_SQL)
def q_role_detection(spark, sf_dir):
    from shelfcast.session import materialize
    catalog, profile = _catalog(spark, sf_dir)
    profile = materialize(profile, "table")
    d = ro.detect_roles_catalog(catalog)
    lists = ["sales_columns", "date_candidates", "target_candidates", "item_candidates"]
    d = d.select("table_name", "date_column", "year_column", "month_column", "time_column", "target_column",
                 "item_column", "item_group_column", *[F.array_join(c, ",").alias(c) for c in lists],
                 "can_auto_detect")
    for column, new, value in (("date_column", "date_values", "non_null"), ("target_column", "target_values", "non_null"),
                               ("item_column", "distinct_items", "distinct_values"), ("item_group_column", "distinct_groups", "distinct_values")):
        d = _profiled(d, profile, column, **{new: value}).withColumn(new, F.coalesce(F.col(new), F.lit(0)))
    return d


@register("context_columns", sr.CONTEXT_SQL)
def q_context_columns(spark, sf_dir):
    catalog, profile = _catalog(spark, sf_dir)
    rows = ro.context_columns(catalog).select("table_name", "tag", "tag_order", F.explode("columns").alias("c"), F.array_join("columns", ",").alias("columns"))
    return _profiled(rows, profile, "c", n="non_null").groupBy("table_name", "tag", "tag_order", "columns").agg(F.sum("n").alias("non_null"))


@register("clean_rows", sr.CLEAN_ROWS_SQL)
def q_clean_rows(spark, sf_dir):
    return clean_view(spark, sf_dir, "retail_dirty").frame


@register("missing_profile", sr.MISSING_PROFILE_SQL)
def q_missing_profile(spark, sf_dir):
    return clean_view(spark, sf_dir, "retail_dirty").missing


def _dated_rows(raw: DataFrame) -> DataFrame:
    """Rows, sum and range of the analysis date per month of a cleaned view."""
    rows = clean(raw, detect_roles(raw)).frame
    seen = lambda f: F.date_format(f("analysis_date"), "yyyy-MM-dd HH:mm:ss.SSS")
    return rows.groupBy(F.trunc("analysis_date", "month").alias("date")).agg(
        F.count(F.lit(1)).alias("row_count"), F.sum("retail_sales").alias("target"), seen(F.min).alias("first_seen"), seen(F.max).alias("last_seen"))


@register("dates_with_zone", sr.dated_rows_sql(fx.RETAIL_STAMPS_SQL))
def q_dates_with_zone(spark, sf_dir):
    return _dated_rows(fx.retail_stamps(spark, sf_dir))


@register("dates_with_time", sr.dated_rows_sql(fx.RETAIL_TIMED_SQL))
def q_dates_with_time(spark, sf_dir):
    return _dated_rows(fx.retail_timed(spark, sf_dir))


@register("dates_from_year_month", sr.dated_rows_sql(fx.RETAIL_YEAR_MONTH_SQL))
def q_dates_from_year_month(spark, sf_dir):
    return _dated_rows(fx.retail_year_month(spark, sf_dir))


def _map_text(c):
    return F.array_join(F.transform(F.array_sort(F.map_entries(c)),
                                    lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


@register("cleaning_summary", sr.CLEANING_SUMMARY_SQL)
def q_cleaning_summary(spark, sf_dir):
    s = clean_view(spark, sf_dir, "retail_dirty").summary
    return s.select("original_rows", "rows_after_cleaning", "duplicates_removed", "invalid_dates_removed",
                    "target_values_removed", F.array_join("trimmed_text_columns", ",").alias("trimmed_text_columns"),
                    _map_text(F.col("missing_values_before")).alias("missing_values_before"),
                    _map_text(F.col("missing_values_after")).alias("missing_values_after"),
                    _map_text(F.col("filled_numeric_columns")).alias("filled_numeric_columns"),
                    _map_text(F.col("filled_categorical_columns")).alias("filled_categorical_columns"),
                    "cleaning_applied")


# ---------------------------------------------------------------- models, choice, reports, chat
from shelfcast.operators import forecast as fc  # noqa: E402
from shelfcast.operators import report as rp  # noqa: E402
from shelfcast.operators import select as sl  # noqa: E402
from shelfcast.plans import sql_report as sq  # noqa: E402


def _series(spark, sf_dir, keys=()):
    return _dense(spark, sf_dir, keys).select(*keys, "date", "target")


@register("forest_forecast")
def q_forest(spark, sf_dir):
    r = fc.tree_model(_series(spark, sf_dir), fc.FOREST, fc.forest())
    return r.forecasts


@register("boosting_forecast")
def q_boosting(spark, sf_dir):
    r = fc.tree_model(_series(spark, sf_dir), fc.BOOSTING, fc.boosting())
    return r.forecasts


@register("next_feature_row", sf_.next_feature_row_sql(["item_type"]))
def q_next_feature_row(spark, sf_dir):
    return _round_cols(fc.next_feature_rows(_series(spark, sf_dir, ["item_type"]), ["item_type"]), _FEATURE_DOUBLES, 6)


@register("window_ar_forecast", sf_.window_ar_forecast_sql())
def q_window_ar(spark, sf_dir):
    return fc.window_ar(_series(spark, sf_dir)).forecasts


@register("window_ar_by_type", sf_.window_ar_by_type_sql())
def q_window_ar_by_type(spark, sf_dir):
    r = fc.window_ar(_series(spark, sf_dir, ["item_type"]), ["item_type"])
    return ev.round_metrics(r.results)


@register("forest_by_type")
def q_forest_by_type(spark, sf_dir):
    r = fc.tree_model(_series(spark, sf_dir, ["item_type"]), fc.FOREST, fc.forest(), ["item_type"])
    return ev.round_metrics(r.results).join(r.forecasts.groupBy("item_type").agg(
        F.array_sort(F.collect_list(F.struct("date", "value"))).alias("forecast")), "item_type", "left")


def _models(spark, sf_dir):
    """Results of all models on the single series, and its metadata."""
    from shelfcast.plans.pipeline import fit_models
    c = clean_view(spark, sf_dir)
    series, meta = mo.monthly_series_and_meta(c.frame, c.schema.target_column)
    return fit_models(series.select("date", "target"))[0], meta


@register("model_results")
def q_model_results(spark, sf_dir):
    return _models(spark, sf_dir)[0]


@register("best_model")
def q_best_model(spark, sf_dir):
    from shelfcast.plans.pipeline import choose
    return choose(*_models(spark, sf_dir))[0]


@register("confidence")
def q_confidence(spark, sf_dir):
    from shelfcast.plans.pipeline import choose
    return choose(*_models(spark, sf_dir))[1]


def _choice_by_type(spark, sf_dir):
    """The choice between the moving average and the window regression, per item type."""
    from shelfcast.plans.pipeline import choose
    c = clean_view(spark, sf_dir)
    keys = ["item_type"]
    series, meta = mo.monthly_series_and_meta(c.frame, c.schema.target_column, keys)
    m = series.select(*keys, "date", "target")
    results = ev.round_metrics(ev.baseline_eval(m, keys).unionByName(fc.window_ar(m, keys).results))
    return choose(results, meta, keys)


@register("best_model_by_type", sq.best_model_by_type_sql())
def q_best_model_by_type(spark, sf_dir):
    return _choice_by_type(spark, sf_dir)[0]


@register("confidence_by_type", sq.confidence_by_type_sql())
def q_confidence_by_type(spark, sf_dir):
    return _choice_by_type(spark, sf_dir)[1]


@register("analysis_run")
def q_analysis_run(spark, sf_dir):
    from shelfcast.plans.pipeline import analyze
    return analyze(fx.retail(spark, sf_dir)).run


@register("chat_answers")
def q_chat_answers(spark, sf_dir):
    from shelfcast.plans.pipeline import analyze
    a = analyze(fx.retail(spark, sf_dir))
    conv = fx.table(spark, sf_dir, "conversations").where(F.col("role") == "user") \
        .select("conv_id", "turn", F.col("text").alias("message"), F.lit(a.run_id).alias("run_id"))
    return rp.answer_questions(conv, F.broadcast(a.run))


@register("answer_intents", sq.intents_sql())
def q_answer_intents(spark, sf_dir):
    conv = fx.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return rp.classify_questions(conv, "text").drop("text")


@register("trend_series", sq.trend_series_sql())
def q_trend_series(spark, sf_dir):
    from shelfcast.session import materialize
    # history and forecast both read the monthly table: write it once
    m = materialize(_series(spark, sf_dir, ["item_type"]), "table")
    return rp.trend_series(m, ev.baseline_forecast(m, ["item_type"]), ["item_type"])


@register("forecast_average", sq.forecast_average_sql())
def q_forecast_average(spark, sf_dir):
    m = _series(spark, sf_dir, ["item_type"])
    out = rp.forecast_average(ev.baseline_forecast(m, ["item_type"]), ["item_type"])
    return out.select("item_type", round_half_up(F.col("forecast_average"), 6).alias("forecast_average"))


@register("headline", sq.headline_sql())
def q_headline(spark, sf_dir):
    c = clean_view(spark, sf_dir)
    return rp.headline(rec.recommendations(c.frame, c.schema, c.schema.target_column))


@register("model_table", sq.model_table_sql())
def q_model_table(spark, sf_dir):
    m = _series(spark, sf_dir, ["item_type"])
    res = ev.round_metrics(ev.baseline_eval(m, ["item_type"]))
    return rp.model_table(res, sl.best_model(res, ["item_type"]), ["item_type"])


@register("compact_numbers", sq.compact_numbers_sql())
def q_compact_numbers(spark, sf_dir):
    c = clean_view(spark, sf_dir)
    m = mo.monthly_series(c.frame, c.schema.target_column, keys=["item_type"]).select("item_type", "date", "target")
    return rp.compact(m, "target")


@register("cleaning_report", sr.cleaning_report_sql())
def q_cleaning_report(spark, sf_dir):
    c = clean_view(spark, sf_dir, "retail_dirty")
    meta = mo.monthly_meta(c.frame, c.schema.target_column)
    return rp.cleaning_report(c.summary, meta)


# ---------------------------------------------------------------- S1: CSV scan of data derived from the tables
from shelfcast.sources.files import read_csv  # noqa: E402


def _dirty_csv(spark, sf_dir) -> str:
    """Write retail_dirty as CSV under the checkpoint folder (one fresh folder per call)."""
    import uuid

    from shelfcast.session import ensure_checkpoint_dir
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/csv/{uuid.uuid4().hex}"
    note = F.concat(F.lit('5" ('), "l_partkey", F.lit('),\n"'), "item_code", F.lit('",'))
    fx.retail_dirty(spark, sf_dir).withColumn("note", note).write.options(header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, escape='"').csv(path)
    return path


@register("csv_scan", sr.CSV_SCAN_SQL)
def q_csv_scan(spark, sf_dir):
    return read_csv(spark, _dirty_csv(spark, sf_dir))


# ---------------------------------------------------------------- S5-S7: a run stored and looked up
from shelfcast.sources import runs as ru  # noqa: E402


def _run_parts(spark, sf_dir, view: str) -> DataFrame:
    """(part, name, value) of a run: overview, segments, seasonality, baseline forecast, and values JSON has no numbers for."""
    c = clean_view(spark, sf_dir, view)
    target = c.schema.target_column
    series = mo.monthly_series(c.frame, target)
    piece = lambda df, part, name, value: df.select(F.lit(part).alias("part"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    over = ins.overview(c.frame, c.schema, target).select(F.explode(F.create_map(
        *[x for k in ("row_count", "target_sum", "target_mean", "item_count") for x in (F.lit(k), F.col(k).cast("double"))])))
    odd = c.frame.agg(F.avg(target).alias("mean"), (F.max(target) * float("inf")).alias("inf"), (F.max(target) * float("nan")).alias("nan"))
    odd = odd.select(F.explode(F.create_map(*[x for k in ("mean", "inf", "nan") for x in (F.lit(k), F.col(k))])))
    parts = [piece(over, "overview", F.col("key"), F.col("value")),
             piece(ins.top_segments(c.frame, c.schema, target), "segment", F.col("name"), F.col("value")),
             piece(ins.seasonal_pattern(series), "seasonal", F.col("month_num"), F.col("target")),
             piece(ev.baseline_forecast(series.select("date", "target")), "forecast", F.date_format("date", "yyyy-MM"), F.col("value")),
             piece(odd, "odd", F.col("key"), F.col("value"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("run_store_roundtrip", sq.run_store_sql())
def q_run_store(spark, sf_dir):
    import uuid

    from shelfcast.session import ensure_checkpoint_dir
    store = f"{ensure_checkpoint_dir(spark).rstrip('/')}/runs/{uuid.uuid4().hex}"
    for run_id, view in (("whole", "retail"), ("gaps", "retail_gaps")):
        parts = _run_parts(spark, sf_dir, view).withColumn("run_id", F.lit(run_id))
        ru.save_run(parts.groupBy("run_id").agg(F.collect_list(F.struct("part", "name", "value")).alias("parts")), store)
    kept = "run_id string, parts array<struct<part:string,name:string,value:double>>"
    loaded = [ru.load_run(spark, store, r, T._parse_datatype_string(kept)).select("run_id", F.inline("parts")) for r in ("whole", "gaps")]
    return loaded[0].unionByName(loaded[1])
