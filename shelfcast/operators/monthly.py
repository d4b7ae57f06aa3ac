"""Monthly series operators.

All heavy work is one ``groupBy(keys, month)`` over the cleaned rows, with
the per-day distinct count planned as a two-phase aggregate (map-side
partial on ``(keys, month, day)``), so a hot key collapses before the shuffle.
Everything after that runs on the monthly table: tens to hundreds of rows per
series, partitioned by the series keys.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.exprs import exact_sum, month_start, to_double
from shelfcast.session import materialize

_ONE = "__series"


def _keys(keys: Sequence[str] | None) -> list[str]:
    return list(keys or [])


def _with_series_key(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    """Monthly-level tables always carry a key; a single series gets a constant one."""
    if keys:
        return df, keys
    return df.withColumn(_ONE, F.lit(0)), [_ONE]


def _drop_series_key(df: DataFrame) -> DataFrame:
    return df.drop(_ONE)


def monthly_totals(df: DataFrame, target: str, keys: Sequence[str] | None = None,
                   date_col: str = "analysis_date") -> DataFrame:
    """A1 + A2 + A3: per (keys, month) the target sum, distinct days observed and last day seen.

    Rows whose target does not coerce to a number are dropped first, as is the
    month bucket of a null timestamp.
    """
    keys = _keys(keys)
    v = to_double(F.col(target)) if dict(df.dtypes)[target] == "string" else F.col(target).cast("double")
    working = (df.select(*keys, F.col(date_col).alias("_ts"), v.alias("_v"))
               .where(F.col("_v").isNotNull() & F.col("_ts").isNotNull()))
    return (working.groupBy(*keys, month_start(F.col("_ts")).alias("date"))
            .agg(exact_sum(F.col("_v")).alias("target"),
                 F.countDistinct(F.to_date("_ts")).alias("observed_days"),
                 F.max(F.dayofmonth("_ts")).alias("last_day_seen")))


def stored_totals(df: DataFrame, target: str, keys: Sequence[str] | None = None,
                  date_col: str = "analysis_date") -> DataFrame:
    """``monthly_totals`` written once: the partial-month rule, the series and its metadata all read
    this table of months x series, and the rows are scanned a single time."""
    return materialize(monthly_totals(df, target, keys, date_col), "table")


def observed_days(df: DataFrame, keys: Sequence[str] | None = None,
                  date_col: str = "analysis_date") -> DataFrame:
    """A3 on its own: distinct calendar days per month."""
    keys = _keys(keys)
    return (df.where(F.col(date_col).isNotNull())
            .groupBy(*keys, month_start(F.col(date_col)).alias("date"))
            .agg(F.countDistinct(F.to_date(date_col)).alias("observed_days")))


def partial_month_stats(totals: DataFrame, keys: Sequence[str] | None = None,
                        partial_rule: bool = True) -> DataFrame:
    """A4 decision per series.

    The latest month is dropped iff the rule is on, the series has >= 3 months,
    its last observed day is before the month's last calendar day, and its
    observed days are below max(3, 0.6 x median days of the earlier months).
    """
    keys = _keys(keys)
    t, k = _with_series_key(totals, keys)
    w = Window.partitionBy(*k).orderBy(F.col("date").desc())
    ranked = t.withColumn("_rn", F.row_number().over(w))
    latest = F.col("_rn") == 1
    stats = ranked.groupBy(*k).agg(
        F.max("date").alias("latest_month"),
        F.count(F.lit(1)).alias("raw_months"),
        F.max(F.when(latest, F.col("observed_days"))).alias("_latest_days"),
        F.max(F.when(latest, F.col("last_day_seen"))).alias("_latest_last_day"),
        F.median(F.when(~latest, F.col("observed_days").cast("double"))).alias("_typical"),
    )
    enough = F.col("raw_months") >= 3
    typical = F.round(F.col("_typical"), 2)
    incomplete = F.col("_latest_last_day") < F.dayofmonth(F.last_day("latest_month"))
    sparse = F.col("_latest_days") < F.greatest(F.lit(3.0), typical * 0.6)
    removed = F.lit(bool(partial_rule)) & enough & incomplete & sparse
    out = stats.select(
        *k, "latest_month", "raw_months",
        F.coalesce(removed, F.lit(False)).alias("partial_last_period_removed"),
        F.when(removed, F.date_format("latest_month", "yyyy-MM")).alias("partial_last_period"),
        F.when(F.lit(bool(partial_rule)) & enough, F.col("_latest_days").cast("int")).alias("latest_period_days_observed"),
        F.when(F.lit(bool(partial_rule)) & enough, typical).alias("typical_period_days_observed"),
    )
    return out if keys else out


def monthly_sales(df: DataFrame, target: str, keys: Sequence[str] | None = None,
                  partial_rule: bool = True, date_col: str = "analysis_date") -> DataFrame:
    """A1 A2 A4: monthly sums with the incomplete latest month removed -> (keys, date, target)."""
    keys = _keys(keys)
    totals = stored_totals(df, target, keys, date_col)
    return _apply_partial(totals, keys, partial_rule).select(*keys, "date", "target")


def _apply_partial(totals: DataFrame, keys: list[str], partial_rule: bool,
                   stats: DataFrame | None = None) -> DataFrame:
    t, k = _with_series_key(totals, keys)
    stats = partial_month_stats(totals, keys, partial_rule) if stats is None else stats
    if not keys:
        stats = stats.withColumn(_ONE, F.lit(0)) if _ONE not in stats.columns else stats
    kept = (t.join(stats.select(*k, "latest_month", "partial_last_period_removed"), k)
            .where(~(F.col("partial_last_period_removed") & (F.col("date") == F.col("latest_month"))))
            .drop("latest_month", "partial_last_period_removed"))
    return _drop_series_key(kept)


def month_spine(monthly: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """A5: every month between each series' first and last month."""
    keys = _keys(keys)
    m, k = _with_series_key(monthly, keys)
    bounds = m.groupBy(*k).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    spine = bounds.select(*k, F.explode(F.sequence("_lo", "_hi", F.expr("INTERVAL 1 MONTH"))).alias("date"))
    return spine if keys else spine.drop(_ONE)


def fill_gaps(monthly: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """A5 + J4 + A6: dense months, linear interpolation over month positions.

    Output ``(keys, date, target, filled)``; ``filled`` marks interpolated months.
    """
    keys = _keys(keys)
    m, k = _with_series_key(monthly, keys)
    spine = month_spine(m, k)
    dense = spine.join(m, k + ["date"], "left")
    w = Window.partitionBy(*k).orderBy("date")
    back = w.rowsBetween(Window.unboundedPreceding, 0)
    fwd = w.rowsBetween(0, Window.unboundedFollowing)
    pos = F.row_number().over(w)
    dense = dense.withColumn("_pos", pos)
    obs_pos = F.when(F.col("target").isNotNull(), F.col("_pos"))
    dense = (dense
             .withColumn("_pv", F.last("target", ignorenulls=True).over(back))
             .withColumn("_pp", F.last(obs_pos, ignorenulls=True).over(back))
             .withColumn("_nv", F.first("target", ignorenulls=True).over(fwd))
             .withColumn("_np", F.first(obs_pos, ignorenulls=True).over(fwd)))
    interp = F.col("_pv") + (F.col("_nv") - F.col("_pv")) * (F.col("_pos") - F.col("_pp")).cast("double") \
        / (F.col("_np") - F.col("_pp")).cast("double")
    value = (F.when(F.col("target").isNotNull(), F.col("target"))
             .when(F.col("_pp").isNull(), F.col("_nv"))
             .when(F.col("_np").isNull(), F.col("_pv"))
             .otherwise(interp))
    out = dense.select(*k, "date", F.coalesce(value, F.lit(0.0)).alias("target"),
                       F.col("target").isNull().alias("filled"))
    return out if keys else out.drop(_ONE)


def monthly_series(df: DataFrame, target: str, keys: Sequence[str] | None = None,
                   partial_rule: bool = True, date_col: str = "analysis_date") -> DataFrame:
    """The dense, partial-month-trimmed monthly series ``(keys, date, target, filled)``."""
    keys = _keys(keys)
    return fill_gaps(monthly_sales(df, target, keys, partial_rule, date_col), keys)


def monthly_meta(df: DataFrame, target: str, keys: Sequence[str] | None = None,
                 partial_rule: bool = True, date_col: str = "analysis_date") -> DataFrame:
    """One row per series describing gaps, length and the partial-month decision."""
    return monthly_series_and_meta(df, target, keys, partial_rule, date_col)[1]


def monthly_series_and_meta(df: DataFrame, target: str, keys: Sequence[str] | None = None,
                            partial_rule: bool = True, date_col: str = "analysis_date") -> tuple[DataFrame, DataFrame]:
    """The dense series and its metadata, from one stored table of totals and one of decisions."""
    keys = _keys(keys)
    totals = stored_totals(df, target, keys, date_col)
    stats = materialize(partial_month_stats(totals, keys, partial_rule), "table")
    kept = _apply_partial(totals, keys, partial_rule, stats)
    dense = materialize(fill_gaps(kept.select(*keys, "date", "target"), keys), "table")
    return dense, _meta(dense, stats, keys)


def _meta(dense: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    d, k = _with_series_key(dense, keys)
    s = stats if keys else stats.withColumn(_ONE, F.lit(0))
    agg = d.groupBy(*k).agg(F.sum(F.col("filled").cast("int")).alias("missing_months_filled"),
                           F.count(F.lit(1)).alias("series_length"),
                           F.sum((~F.col("filled")).cast("int")).alias("observed_months"))
    j = agg.join(s, k)
    filled = F.col("missing_months_filled") > 0
    gap_text = F.when(filled, F.lit("missing months were linearly interpolated for model continuity")) \
        .otherwise(F.lit("no monthly gaps were found"))
    gap_text = F.when(F.col("partial_last_period_removed"),
                      F.concat(gap_text, F.lit("; incomplete latest period "), F.col("partial_last_period"),
                               F.lit(" was excluded from model training"))).otherwise(gap_text)
    out = j.select(
        *k,
        F.col("missing_months_filled").cast("int").alias("missing_months_filled"),
        F.when(filled, F.lit("linear interpolation")).otherwise(F.lit("not needed")).alias("missing_months_method"),
        "partial_last_period_removed", "partial_last_period",
        F.col("series_length").cast("int").alias("series_length"),
        F.col("observed_months").cast("int").alias("observed_months"),
        "latest_period_days_observed", "typical_period_days_observed",
        gap_text.alias("gap_handling"),
    )
    return out if keys else out.drop(_ONE)
