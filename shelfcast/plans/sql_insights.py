"""DuckDB oracle SQL for A8-A15 and R1-R6."""

from __future__ import annotations

from shelfcast.plans.fixtures import RETAIL_SQL
from shelfcast.plans.sql_monthly import _gb, _k, _on, _part, clean_cte, dense_ctes, totals_ctes, with_ctes


def r2(x: str) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), 2) AS DOUBLE)"


def dsum(x: str) -> str:
    return f"CAST(SUM(CAST({x} AS DECIMAL(38,6))) AS DOUBLE)"


def _monthly(keys=()):
    return with_ctes(RETAIL_SQL, clean_cte(), totals_ctes(keys), dense_ctes(keys))


OVERVIEW_SQL = with_ctes(RETAIL_SQL, clean_cte()) + f"""
SELECT COUNT(*) AS row_count, 6 AS column_count,
       strftime(MIN(analysis_date), '%Y-%m-%d') AS date_start,
       strftime(MAX(analysis_date), '%Y-%m-%d') AS date_end,
       'retail_sales' AS target_column,
       {r2(dsum('retail_sales'))} AS target_sum,
       {r2('AVG(retail_sales)')} AS target_mean,
       COUNT(DISTINCT item_code) AS item_count,
       'sale_date,retail_sales,item_code,item_type,warehouse_sales,analysis_date' AS columns
FROM clean"""

TOP_SEGMENTS_SQL = with_ctes(RETAIL_SQL, clean_cte()) + f"""
SELECT name, {r2('value')} AS value FROM (
  SELECT CAST(item_type AS VARCHAR) AS name, {dsum('retail_sales')} AS value FROM clean GROUP BY 1
) ORDER BY value DESC, name ASC LIMIT 6"""


def seasonal_sql(keys=()):
    k = _k(keys)
    return _monthly(keys) + f"""
SELECT {k}CAST(month(date) AS INTEGER) AS month_num, strftime(date, '%b') AS month_name, AVG(target) AS target
FROM dense GROUP BY {k}month(date), strftime(date, '%b')"""


def iqr_sql(keys=()):
    k = _k(keys)
    return _monthly(keys) + f"""
, q AS (SELECT {k}quantile_cont(target, 0.25) AS q1, quantile_cont(target, 0.75) AS q3 FROM dense {_gb(keys)}),
qb AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound, q3 + 1.5 * (q3 - q1) AS upper_bound FROM q)
SELECT {_k(keys, 'qb.')}qb.q1, qb.q3, qb.iqr, qb.lower_bound, qb.upper_bound,
       CAST(COUNT(CASE WHEN d.target < qb.lower_bound OR d.target > qb.upper_bound THEN 1 END) AS INTEGER) AS anomaly_count
FROM dense d JOIN qb ON {_on(keys, 'd', 'qb')}
GROUP BY {_k(keys, 'qb.')}qb.q1, qb.q3, qb.iqr, qb.lower_bound, qb.upper_bound"""


def trend_sql(keys=()):
    k = _k(keys)
    return _monthly(keys) + f"""
, r AS (SELECT *, row_number() OVER ({_part(keys)} ORDER BY date ASC) AS a,
                  row_number() OVER ({_part(keys)} ORDER BY date DESC) AS d FROM dense),
s AS (SELECT {k}AVG(CASE WHEN a <= 3 THEN target END) AS early_average,
             AVG(CASE WHEN d <= 3 THEN target END) AS recent_average FROM r {_gb(keys)})
SELECT *, CASE WHEN COALESCE(recent_average, 0.0) > COALESCE(early_average, 0.0) * 1.1 THEN 'Rising'
               WHEN COALESCE(early_average, 0.0) > 0 AND COALESCE(recent_average, 0.0) < COALESCE(early_average, 0.0) * 0.9 THEN 'Softening'
               ELSE 'Stable' END AS trend_direction
FROM s"""


def peak_low_sql(keys=()):
    k = _k(keys)
    return _monthly(keys) + f"""
SELECT {k}strftime(arg_min(date, (-target, date)), '%Y-%m-%d') AS peak_date, {r2('MAX(target)')} AS peak_value,
       strftime(arg_min(date, (target, date)), '%Y-%m-%d') AS low_date, {r2('MIN(target)')} AS low_value,
       {r2('AVG(target)')} AS average_monthly_sales
FROM dense {_gb(keys)}"""


PREVIEW_SQL = with_ctes(RETAIL_SQL, clean_cte()) + """
SELECT strftime(sale_date, '%Y-%m-%d') AS sale_date, retail_sales, item_code, item_type, warehouse_sales,
       strftime(analysis_date, '%Y-%m-%d') AS analysis_date
FROM clean ORDER BY clean.sale_date, retail_sales, item_code, item_type, warehouse_sales, clean.analysis_date LIMIT 12"""


def item_risk_sql(top: int | None = None):
    lim = "" if top is None else f"ORDER BY recent_raw DESC, item ASC LIMIT {top}"
    g = "CASE WHEN p <= 0 AND r > 0 THEN 1.0 WHEN p > 0 THEN (r - p) / p ELSE 0.0 END"
    risk = f"CASE WHEN r > 0 AND w > 0 AND r > w THEN 'high' WHEN {g} >= 0.25 THEN 'medium' ELSE 'low' END"
    return with_ctes(RETAIL_SQL, clean_cte()) + f"""
, lm AS (SELECT MAX(CAST(date_trunc('month', analysis_date) AS DATE)) AS latest FROM clean),
x AS (SELECT c.*, CAST(date_trunc('month', analysis_date) AS DATE) AS m, lm.latest FROM clean c, lm),
per AS (
  SELECT CAST(item_code AS VARCHAR) AS item,
    {dsum("CASE WHEN m BETWEEN latest - INTERVAL 2 MONTH AND latest THEN COALESCE(retail_sales, 0.0) END")} AS r,
    COUNT(CASE WHEN m BETWEEN latest - INTERVAL 2 MONTH AND latest THEN 1 END) AS n_recent,
    COALESCE({dsum("CASE WHEN m BETWEEN latest - INTERVAL 5 MONTH AND latest - INTERVAL 3 MONTH THEN COALESCE(retail_sales, 0.0) END")}, 0.0) AS p,
    COALESCE({dsum("CASE WHEN m BETWEEN latest - INTERVAL 2 MONTH AND latest THEN warehouse_sales END")}, 0.0) AS w,
    MIN(CAST(item_type AS VARCHAR)) AS grp
  FROM x GROUP BY 1
),
cls AS (
  SELECT item, COALESCE(grp, 'General') AS "group", {r2('r')} AS recent_sales, {r2('p')} AS prior_sales,
    {r2("CASE WHEN p <= 0 AND r > 0 THEN 100.0 WHEN p > 0 THEN (r - p) / p * 100 ELSE 0.0 END")} AS growth_pct,
    {r2('w')} AS warehouse_support, {risk} AS risk, r AS recent_raw
  FROM per WHERE n_recent > 0
)
SELECT item, "group", recent_sales, prior_sales, growth_pct, warehouse_support, risk,
  CASE risk WHEN 'high' THEN 'Increase stock immediately' WHEN 'medium' THEN 'Pre-order extra stock'
            ELSE 'Maintain current stock plan' END AS action,
  CASE risk WHEN 'high' THEN 'Retail demand is running ahead of warehouse support.'
            WHEN 'medium' THEN 'Recent demand is climbing quickly over the previous period.'
            ELSE 'Demand looks stable relative to recent months.' END AS reason
FROM cls {lim}"""
