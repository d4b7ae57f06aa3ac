"""DuckDB oracle SQL for D1-D4, D6 and the Q1 intent rules."""

from __future__ import annotations

from shelfcast.plans import sql_features as sf_
from shelfcast.plans import sql_insights as si
from shelfcast.plans.fixtures import RETAIL_GAPS_SQL, RETAIL_SQL
from shelfcast.plans.sql_monthly import clean_cte, dense_ctes, monthly_dense_sql, monthly_meta_sql, totals_ctes, with_ctes


# Words of the question rules, in the order in which the rules are tried.
QUESTION_WORDS = [
    ("cleaning", ["duplicate", "missing", "clean", "format"]),
    ("reliability", ["reliability", "confidence", "trust", "accurate"]),
    ("why_model", None),
    ("model_metrics", ["best model", "accuracy", "mae", "rmse", "xgboost", "random forest", "lstm", "model"]),
    ("stock", ["stock", "restock", "recommend", "inventory"]),
    ("forecast", ["forecast", "next", "future", "predict"]),
    ("dataset", ["chart", "trend", "summary", "dataset", "column", "data"]),
]


def intents_sql() -> str:
    q = "lower(trim(text))"
    whens = []
    for name, words in QUESTION_WORDS:
        found = [f"contains({q}, '{w}')" for w in words or ()]
        cond = " OR ".join(found) if found else f"contains({q}, 'why') AND contains({q}, 'model')"
        whens.append(f"WHEN {cond} THEN '{name}'")
    return f"SELECT conv_id, turn, role, CASE {' '.join(whens)} ELSE 'fallback' END AS intent FROM conversations"


def _baseline_fc_cte():
    # baseline forecasts by item_type as a CTE named bfc
    body = sf_.baseline_forecast_sql(["item_type"])
    return body


def trend_series_sql() -> str:
    fc = sf_.baseline_forecast_sql(["item_type"])
    # reuse the forecast query as a sub-select over the same CTE chain
    head, tail = fc.rsplit("\nSELECT ", 1)
    return head + f"""
, bfc AS (SELECT {tail}),
last AS (SELECT item_type, MAX(date) AS last_date FROM dense GROUP BY item_type),
hasf AS (SELECT DISTINCT item_type FROM bfc)
SELECT d.item_type, strftime(d.date, '%Y-%m') AS date, 0 AS part, d.target AS historical,
       CASE WHEN h.item_type IS NOT NULL AND d.date = l.last_date THEN d.target END AS forecast
FROM dense d JOIN last l ON d.item_type = l.item_type LEFT JOIN hasf h ON d.item_type = h.item_type
UNION ALL
SELECT item_type, strftime(date, '%Y-%m') AS date, 1 AS part, CAST(NULL AS DOUBLE) AS historical, value AS forecast FROM bfc"""


def forecast_average_sql() -> str:
    fc = sf_.baseline_forecast_sql(["item_type"])
    head, tail = fc.rsplit("\nSELECT ", 1)
    return head + f"""
, bfc AS (SELECT {tail})
SELECT item_type, {sf_.rd('COALESCE(AVG(value), 0.0)', 6)} AS forecast_average FROM bfc GROUP BY item_type"""


def headline_sql() -> str:
    recs = si.item_risk_sql(top=1)
    return f"""SELECT COALESCE((SELECT CASE WHEN risk = 'low' THEN item || ' currently has the strongest recent demand.'
        ELSE item || ' needs inventory attention.' END FROM ({recs}) t), 'Recommendations ready') AS headline"""


def _f2(c):
    return f"CASE WHEN {c} IS NULL OR isnan({c}) THEN '-' ELSE printf('%.2f', {c}) END"


def model_table_sql() -> str:
    ev = sf_.baseline_eval_sql(["item_type"])
    return f"""WITH res AS ({ev}),
best AS (SELECT item_type, arg_min(model, (ROUND(rmse, 4), 3)) AS best FROM res WHERE status = 'trained' AND rmse IS NOT NULL GROUP BY item_type)
SELECT r.item_type, r.model, {_f2('r.mae')} AS mae, {_f2('r.rmse')} AS rmse, {_f2('r.mape')} AS mape, {_f2('r.r2')} AS r2,
       COALESCE(r.model = b.best, FALSE) AS selected
FROM res r LEFT JOIN best b ON r.item_type = b.item_type WHERE r.status = 'trained'"""


def _fmt(v):
    return f"regexp_replace(CAST(CAST(ROUND(CAST({v} AS DECIMAL(38,10)), 2) AS DECIMAL(38,2)) AS VARCHAR), '\\.?0+$', '')"


def compact_sql_expr(x: str) -> str:
    parts = []
    for lim, suf in [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]:
        parts.append(f"WHEN ROUND(CAST(ABS({x}) / {lim!r} AS DECIMAL(38,10)), 2) >= 1 THEN {_fmt(f'{x} / {lim!r}')} || '{suf}'")
    return f"CASE WHEN {x} IS NULL THEN NULL {' '.join(parts)} ELSE {_fmt(x)} END"


def compact_numbers_sql() -> str:
    body = monthly_dense_sql(["item_type"], gaps=False)
    head, tail = body.rsplit("\nSELECT ", 1)
    return head + f"\nSELECT item_type, date, target, {compact_sql_expr('target')} AS compact FROM dense"


def _choice_ctes() -> str:
    """``best`` and ``conf`` per item type, over the moving average and the window regression."""
    base = sf_.baseline_eval_sql(["item_type"])
    ar = sf_.window_ar_by_type_sql()
    meta = monthly_meta_sql(["item_type"])
    return f"""WITH res AS ({base} UNION ALL FROM ({ar})),
meta AS ({meta}),
tr AS (SELECT *, row_number() OVER (PARTITION BY item_type ORDER BY ROUND(rmse, 4), CASE model WHEN 'Seasonal Baseline' THEN 1 ELSE 2 END) AS place
       FROM res WHERE status = 'trained' AND rmse IS NOT NULL),
best AS (SELECT k.item_type, COALESCE(t.model, 'Unavailable') AS model, t.mae, t.rmse, t.mape, t.r2
         FROM (SELECT DISTINCT item_type FROM res) k LEFT JOIN tr t ON t.item_type = k.item_type AND t.place = 1),
c0 AS (
  SELECT b.*, l.model AS baseline_model, l.rmse AS baseline_rmse, m.missing_months_filled AS gaps,
         m.missing_months_filled > 0 OR m.partial_last_period_removed AS sparse, b.model = 'Seasonal Baseline' AS is_base
  FROM best b LEFT JOIN res l ON l.item_type = b.item_type AND l.model = 'Seasonal Baseline' AND l.status = 'trained'
  LEFT JOIN meta m ON m.item_type = b.item_type),
c1 AS (SELECT *, COALESCE(NOT is_base AND rmse <= baseline_rmse * 0.95, FALSE) AS beats FROM c0),
conf AS (
  SELECT *, CASE WHEN is_base THEN 'Baseline-led' WHEN mape <= 12 AND beats AND NOT sparse THEN 'Strong'
                 WHEN mape <= 20 AND beats THEN 'Directional' ELSE 'Exploratory' END AS label FROM c1)"""


def best_model_by_type_sql() -> str:
    return _choice_ctes() + """
SELECT item_type, model, mae, rmse, mape, r2,
  CASE WHEN model = 'Unavailable' THEN 'No candidate models were trained successfully.'
       ELSE model || ' was selected because it achieved the lowest RMSE on the leakage-free holdout evaluation. Forecast reliability for this upload is ' || label || '.' END AS reason
FROM conf"""


def confidence_by_type_sql() -> str:
    return _choice_ctes() + """
SELECT item_type, label,
  CASE label
    WHEN 'Baseline-led' THEN 'The seasonal baseline outperformed the trained ML models on the leakage-free holdout, so it is the most defensible forecast for this upload.'
    WHEN 'Strong' THEN 'The selected model clearly beat the baseline on this upload and is suitable for confident directional forecasting.'
    WHEN 'Directional' THEN 'The selected model beat the baseline and is suitable for directional planning, though it should still be explained with its metrics.'
    ELSE 'The forecast is useful for pattern review, but this upload still needs careful interpretation before making inventory decisions.' END
  || CASE WHEN gaps > 0 THEN ' Some months had no rows in the upload, so those periods were filled by linear interpolation.' ELSE '' END AS reason,
  beats AS beats_baseline, is_base AS selected_is_baseline, baseline_model, baseline_rmse, rmse AS best_model_rmse,
  r2 AS best_model_r2, mape AS best_model_mape, sparse AS sparse_series
FROM conf"""


def run_store_sql() -> str:
    """What comes back from the run store: values at four digits, none for NaN and infinities."""
    ahead = sf_.baseline_forecast_sql().removeprefix(sf_._monthly())
    ctes, forecast = ahead.rsplit("\nSELECT ", 1)
    runs = []
    for run_id, view, sources in (("whole", "retail", [RETAIL_SQL]), ("gaps", "retail_gaps", [RETAIL_SQL, RETAIL_GAPS_SQL])):
        two = lambda x: f"ROUND(CAST({x} AS DECIMAL(38,10)), 2)"
        runs.append("SELECT * FROM (" + with_ctes(*sources, clean_cte(view), totals_ctes(), dense_ctes()) + ctes + f"""
, bfc AS (SELECT {forecast}),
seg AS (SELECT item_type AS name, SUM(retail_sales) AS value FROM clean GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 6),
parts AS (
  SELECT 'overview' AS part, 'row_count' AS name, COUNT(*)::DOUBLE AS value FROM clean
  UNION ALL SELECT 'overview', 'target_sum', {two('SUM(retail_sales)')} FROM clean
  UNION ALL SELECT 'overview', 'target_mean', {two('AVG(retail_sales)')} FROM clean
  UNION ALL SELECT 'overview', 'item_count', COUNT(DISTINCT item_code) FROM clean
  UNION ALL SELECT 'segment', name, {two('value')} FROM seg
  UNION ALL SELECT 'seasonal', CAST(month(date) AS VARCHAR), AVG(target) FROM dense GROUP BY month(date)
  UNION ALL SELECT 'forecast', strftime(date, '%Y-%m'), value FROM bfc
  UNION ALL SELECT 'odd', 'mean', AVG(retail_sales) FROM clean
  UNION ALL SELECT 'odd', 'inf', NULL UNION ALL SELECT 'odd', 'nan', NULL)
SELECT '{run_id}' AS run_id, part, name, {sf_.rd('value', 4)} AS value FROM parts)""")
    return "\nUNION ALL\n".join(runs)
