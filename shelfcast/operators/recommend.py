"""Restocking recommendations.

One ``groupBy(item)`` with conditional sums over the latest six months gives
recent, prior and warehouse totals in a single shuffle; the date filter reaches
the scan.  Only the
latest month (a one-row aggregate) is fetched to the driver, so the window
bounds are literals in the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.functions.exprs import exact_sum, month_start, round_half_up
from shelfcast.operators.roles import RoleSchema

# Action and reason texts per risk class.
RISK_TEXT = {
    "high": ("Increase stock immediately", "Retail demand is running ahead of warehouse support."),
    "medium": ("Pre-order extra stock", "Recent demand is climbing quickly over the previous period."),
    "low": ("Maintain current stock plan", "Demand looks stable relative to recent months."),
}
SUPPORT_COLUMN = "warehouse_sales"
MEDIUM_GROWTH = 0.25

OUTPUT = ["item", "group", "recent_sales", "prior_sales", "growth_pct", "warehouse_support",
          "risk", "action", "reason"]


def _groups(df: DataFrame, schema: RoleSchema) -> DataFrame | None:
    """(item, _group) over all rows; reads two columns."""
    item, group = schema.item_column, schema.item_group_column
    if not group or group not in df.columns or group == item:
        return None
    return df.groupBy(F.col(item).cast("string").alias("item")).agg(F.min(F.col(group).cast("string")).alias("_group"))


def _risk(df: DataFrame, schema: RoleSchema, target: str) -> DataFrame:
    """R1-R4 + J1-J2 for every item sold in the latest three months; only six months are read."""
    item = schema.item_column
    latest = df.agg(F.max("analysis_date").alias("m")).select(month_start(F.col("m")).alias("m")).first()["m"]
    m = month_start(F.col("analysis_date"))
    lit = F.lit(latest)
    df = df.where(F.col("analysis_date") >= F.add_months(lit, -5).cast("timestamp_ntz"))
    recent = m.between(F.add_months(lit, -2), lit)
    prior = m.between(F.add_months(lit, -5), F.add_months(lit, -3))
    v = F.coalesce(F.col(target).cast("double"), F.lit(0.0))
    has_support = SUPPORT_COLUMN in df.columns
    aggs = [exact_sum(F.when(recent, v)).alias("recent_sales"),
            F.count(F.when(recent, 1)).alias("_n_recent"),
            F.coalesce(exact_sum(F.when(prior, v)), F.lit(0.0)).alias("prior_sales"),
            (F.coalesce(exact_sum(F.when(recent, F.col(SUPPORT_COLUMN).cast("double"))), F.lit(0.0))
             if has_support else F.lit(0.0)).alias("recent_warehouse_sales")]
    per_item = (df.groupBy(F.col(item).cast("string").alias("item")).agg(*aggs)
                .where(F.col("_n_recent") > 0))
    r, p, w = F.col("recent_sales"), F.col("prior_sales"), F.col("recent_warehouse_sales")
    growth = F.when((p <= 0) & (r > 0), F.lit(1.0)).when(p > 0, (r - p) / p).otherwise(F.lit(0.0))
    growth_pct = F.when((p <= 0) & (r > 0), F.lit(100.0)).when(p > 0, (r - p) / p * 100).otherwise(F.lit(0.0))
    risk = (F.when((r > 0) & (w > 0) & (r > w), F.lit("high"))
            .when(growth >= MEDIUM_GROWTH, F.lit("medium")).otherwise(F.lit("low")))
    action = F.when(risk == "high", RISK_TEXT["high"][0]).when(risk == "medium", RISK_TEXT["medium"][0]) \
        .otherwise(RISK_TEXT["low"][0])
    reason = F.when(risk == "high", RISK_TEXT["high"][1]).when(risk == "medium", RISK_TEXT["medium"][1]) \
        .otherwise(RISK_TEXT["low"][1])
    return per_item.select(
        "item", round_half_up(r).alias("recent_sales"), round_half_up(p).alias("prior_sales"),
        round_half_up(growth_pct).alias("growth_pct"), round_half_up(w).alias("warehouse_support"),
        risk.alias("risk"), action.alias("action"), reason.alias("reason"), r.alias("_recent_raw"))


def _named(rows: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The rows with their item's group, "General" where there is none."""
    if groups is None:
        return rows.withColumn("group", F.lit("General"))
    same = rows["item"].eqNullSafe(groups["item"])
    return rows.join(groups, same, "left").drop(groups["item"]).withColumn("group", F.coalesce("_group", F.lit("General")))


def _no_items(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "item string, group string, recent_sales double, prior_sales double, "
                                               "growth_pct double, warehouse_support double, risk string, "
                                               "action string, reason string")


def item_risk(df: DataFrame, schema: RoleSchema, target: str) -> DataFrame:
    """R1-R4 + J1-J3 for every item sold in the latest three months."""
    if not schema.item_column or schema.item_column not in df.columns:
        return _no_items(df)
    return _named(_risk(df, schema, target), _groups(df, schema)).select(*OUTPUT, "_recent_raw")


def recommendations(df: DataFrame, schema: RoleSchema, target: str, n: int = 5) -> DataFrame:
    """R5 + R6: top ``n`` items by recent sales (ties by item name); only their groups are looked up."""
    item = schema.item_column
    if not item or item not in df.columns:
        return _no_items(df)
    top = _risk(df, schema, target).orderBy(F.col("_recent_raw").desc(), F.col("item").asc()).limit(n)
    rows = df.join(F.broadcast(top.select(F.col("item").alias("_top"))), F.col(item).cast("string").eqNullSafe(F.col("_top")), "left_semi")
    return _named(top, _groups(rows, schema)).orderBy(F.col("_recent_raw").desc(), F.col("item").asc()).select(*OUTPUT)
