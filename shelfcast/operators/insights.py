"""Overview and exploratory summaries.

A8/A9 aggregate the cleaned rows (partial + final HashAggregate, top-k via
TakeOrderedAndProject).  A10-A14 run on the monthly series, one row per
series key.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.functions.exprs import exact_sum, round_half_up
from shelfcast.operators.roles import RoleSchema

_ONE = "__series"


def _k(df: DataFrame, keys):
    keys = list(keys or [])
    if keys:
        return df, keys
    return df.withColumn(_ONE, F.lit(0)), [_ONE]


def overview(df: DataFrame, schema: RoleSchema, target: str) -> DataFrame:
    """Rows, columns, date range, target sum/mean, distinct items (one aggregate)."""
    item = schema.item_column if schema.item_column in df.columns else None
    aggs = [F.count(F.lit(1)).alias("row_count"),
            F.date_format(F.min("analysis_date"), "yyyy-MM-dd").alias("date_start"),
            F.date_format(F.max("analysis_date"), "yyyy-MM-dd").alias("date_end"),
            round_half_up(exact_sum(F.col(target))).alias("target_sum"),
            round_half_up(F.avg(F.col(target))).alias("target_mean"),
            (F.countDistinct(F.col(item)) if item else F.lit(None).cast("long")).alias("item_count")]
    return df.agg(*aggs).select(
        "row_count", F.lit(len(df.columns)).alias("column_count"), "date_start", "date_end",
        F.lit(target).alias("target_column"), "target_sum", "target_mean", "item_count",
        F.lit(",".join(df.columns)).alias("columns"))


def grouping_column(df: DataFrame, schema: RoleSchema) -> str | None:
    if schema.item_group_column and schema.item_group_column in df.columns:
        return schema.item_group_column
    if schema.item_column and schema.item_column in df.columns:
        return schema.item_column
    return None


def top_segments(df: DataFrame, schema: RoleSchema, target: str, n: int = 6) -> DataFrame:
    """Target sum per group column (else item column), top ``n`` descending, ties by name."""
    g = grouping_column(df, schema)
    if g is None:
        return df.sparkSession.createDataFrame([], "name string, value double")
    agg = df.groupBy(F.col(g).cast("string").alias("name")).agg(exact_sum(F.col(target)).alias("value"))
    return (agg.orderBy(F.col("value").desc(), F.col("name").asc()).limit(n)
            .select("name", round_half_up(F.col("value")).alias("value")))


def seasonal_pattern(monthly: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """A10: mean monthly value by calendar month (Jan..Dec order via ``month_num``)."""
    keys = list(keys or [])
    return (monthly.groupBy(*keys, F.month("date").alias("month_num"),
                            F.date_format("date", "MMM").alias("month_name"))
            .agg(F.avg("target").alias("target")))


def iqr_anomalies(monthly: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Quartiles (linear interpolation) and the count outside Q1-1.5*IQR .. Q3+1.5*IQR."""
    m, k = _k(monthly, keys)
    q = m.groupBy(*k).agg(F.percentile("target", 0.25).alias("q1"), F.percentile("target", 0.75).alias("q3"))
    q = (q.withColumn("iqr", F.col("q3") - F.col("q1"))
         .withColumn("lower_bound", F.col("q1") - 1.5 * F.col("iqr"))
         .withColumn("upper_bound", F.col("q3") + 1.5 * F.col("iqr")))
    j = m.join(q, k)
    out = j.groupBy(*k, "q1", "q3", "iqr", "lower_bound", "upper_bound").agg(
        F.count(F.when((F.col("target") < F.col("lower_bound")) | (F.col("target") > F.col("upper_bound")), 1))
        .cast("int").alias("anomaly_count"))
    return out if keys else out.drop(_ONE)


def trend_direction(monthly: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """Mean of the first 3 vs last 3 months -> Rising / Softening / Stable."""
    m, k = _k(monthly, keys)
    wa = Window.partitionBy(*k).orderBy(F.col("date").asc())
    wd = Window.partitionBy(*k).orderBy(F.col("date").desc())
    r = m.withColumn("_a", F.row_number().over(wa)).withColumn("_d", F.row_number().over(wd))
    s = r.groupBy(*k).agg(F.avg(F.when(F.col("_a") <= 3, F.col("target"))).alias("early_average"),
                         F.avg(F.when(F.col("_d") <= 3, F.col("target"))).alias("recent_average"))
    e, rc = F.coalesce(F.col("early_average"), F.lit(0.0)), F.coalesce(F.col("recent_average"), F.lit(0.0))
    direction = (F.when(rc > e * 1.1, F.lit("Rising"))
                 .when((e > 0) & (rc < e * 0.9), F.lit("Softening"))
                 .otherwise(F.lit("Stable")))
    out = s.withColumn("trend_direction", direction)
    return out if keys else out.drop(_ONE)


def peak_low(monthly: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """A13 + A14: peak and lowest month (earliest on ties) and the average monthly value."""
    m, k = _k(monthly, keys)
    out = m.groupBy(*k).agg(
        F.min_by("date", F.struct(-F.col("target"), F.col("date"))).alias("peak_date"),
        F.max("target").alias("peak_value"),
        F.min_by("date", F.struct(F.col("target"), F.col("date"))).alias("low_date"),
        F.min("target").alias("low_value"),
        F.avg("target").alias("average_monthly_sales"))
    out = out.select(*k, F.date_format("peak_date", "yyyy-MM-dd").alias("peak_date"),
                     round_half_up(F.col("peak_value")).alias("peak_value"),
                     F.date_format("low_date", "yyyy-MM-dd").alias("low_date"),
                     round_half_up(F.col("low_value")).alias("low_value"),
                     round_half_up(F.col("average_monthly_sales")).alias("average_monthly_sales"))
    return out if keys else out.drop(_ONE)


def preview(df: DataFrame, n: int = 12, order_by: Sequence[str] | None = None) -> DataFrame:
    """The first ``n`` rows in a deterministic order, timestamps as yyyy-MM-dd."""
    order = list(order_by or df.columns)
    dt = dict(df.dtypes)
    rows = df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(n)
    return rows.select(*[
        (F.date_format(F.col(c), "yyyy-MM-dd") if dt[c] in ("timestamp", "timestamp_ntz", "date") else F.col(c)).alias(c)
        for c in df.columns])
