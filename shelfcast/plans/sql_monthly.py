"""DuckDB oracle SQL for the monthly operators (independent re-statement of A1-A7)."""

from __future__ import annotations

from shelfcast.plans.fixtures import RETAIL_GAPS_SQL, RETAIL_SQL


def _k(keys, prefix=""):
    return "".join(f"{prefix}{k}, " for k in keys)


def _on(keys, a, b):
    return " AND ".join([f"{a}.{k} = {b}.{k}" for k in keys] + ["TRUE"])


def _part(keys):
    return ("PARTITION BY " + ", ".join(keys)) if keys else ""


def _gb(keys, extra=""):
    cols = list(keys) + ([extra] if extra else [])
    return ("GROUP BY " + ", ".join(cols)) if cols else ""


def clean_cte(source: str = "retail") -> str:
    """The cleaned typed retail rows: whole-row DISTINCT, analysis_date = sale_date."""
    return f"""
rc AS (SELECT DISTINCT sale_date, retail_sales, item_code, item_type, warehouse_sales FROM {source}),
clean AS (SELECT *, sale_date AS analysis_date FROM rc)"""


def totals_ctes(keys=(), target="retail_sales") -> str:
    k = _k(keys)
    return f"""
tot AS (
  SELECT {k}CAST(date_trunc('month', analysis_date) AS DATE) AS date,
         CAST(SUM(CAST({target} AS DECIMAL(38,6))) AS DOUBLE) AS target,
         COUNT(DISTINCT CAST(analysis_date AS DATE)) AS observed_days,
         MAX(day(analysis_date)) AS last_day_seen
  FROM clean WHERE {target} IS NOT NULL AND analysis_date IS NOT NULL
  GROUP BY {k}CAST(date_trunc('month', analysis_date) AS DATE)
),
ranked AS (SELECT *, row_number() OVER ({_part(keys)} ORDER BY date DESC) AS rn FROM tot),
pstat AS (
  SELECT {k}MAX(date) AS latest_month, COUNT(*) AS raw_months,
         MAX(CASE WHEN rn = 1 THEN observed_days END) AS latest_days,
         MAX(CASE WHEN rn = 1 THEN last_day_seen END) AS latest_last_day,
         ROUND(MEDIAN(CASE WHEN rn > 1 THEN CAST(observed_days AS DOUBLE) END), 2) AS typical
  FROM ranked {_gb(keys)}
),
pflag AS (
  SELECT *, COALESCE(raw_months >= 3 AND latest_last_day < day(last_day(latest_month))
                     AND latest_days < GREATEST(3.0, typical * 0.6), FALSE) AS removed
  FROM pstat
),
kept AS (
  SELECT {_k(keys, 't.')}t.date, t.target FROM tot t JOIN pflag p ON {_on(keys, 't', 'p')}
  WHERE NOT (p.removed AND t.date = p.latest_month)
)"""


def dense_ctes(keys=()) -> str:
    k = _k(keys)
    kb = _k(keys, "b.")
    part = _part(keys)
    return f"""
bounds AS (SELECT {k}MIN(date) AS lo, MAX(date) AS hi FROM kept {_gb(keys)}),
spine AS (
  SELECT {kb}CAST(unnest(generate_series(CAST(b.lo AS TIMESTAMP), CAST(b.hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS DATE) AS date
  FROM bounds b
),
dj AS (
  SELECT {_k(keys, 's.')}s.date, m.target,
         row_number() OVER ({_part(['s.' + x for x in keys])} ORDER BY s.date) AS pos
  FROM spine s LEFT JOIN kept m ON {_on(keys, 's', 'm')} AND s.date = m.date
),
dw AS (
  SELECT *,
    last_value(target IGNORE NULLS) OVER ({part} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
    last_value(CASE WHEN target IS NOT NULL THEN pos END IGNORE NULLS) OVER ({part} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
    first_value(target IGNORE NULLS) OVER ({part} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
    first_value(CASE WHEN target IS NOT NULL THEN pos END IGNORE NULLS) OVER ({part} ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
  FROM dj
),
dense AS (
  SELECT {k}date,
    COALESCE(CASE WHEN target IS NOT NULL THEN target
         WHEN pp IS NULL THEN nv WHEN np IS NULL THEN pv
         ELSE pv + (nv - pv) * CAST(pos - pp AS DOUBLE) / CAST(np - pp AS DOUBLE) END, 0.0) AS target,
    target IS NULL AS filled
  FROM dw
)"""


def with_ctes(*parts: str) -> str:
    body = ",".join(p.strip("\n") for p in parts)
    return "WITH " + body.lstrip()


def monthly_sales_sql(keys=()) -> str:
    return with_ctes(RETAIL_SQL, clean_cte(), totals_ctes(keys)) + f"\nSELECT {_k(keys)}date, target FROM kept"


def observed_days_sql() -> str:
    return with_ctes(RETAIL_SQL, clean_cte()) + """
SELECT CAST(date_trunc('month', analysis_date) AS DATE) AS date,
       COUNT(DISTINCT CAST(analysis_date AS DATE)) AS observed_days
FROM clean GROUP BY 1"""


def monthly_dense_sql(keys=(), gaps=True) -> str:
    src = [RETAIL_SQL, RETAIL_GAPS_SQL] if gaps else [RETAIL_SQL]
    return with_ctes(*src, clean_cte("retail_gaps" if gaps else "retail"), totals_ctes(keys),
                     dense_ctes(keys)) + f"\nSELECT {_k(keys)}date, target, filled FROM dense"


def monthly_meta_sql(keys=(), gaps=False) -> str:
    src = [RETAIL_SQL, RETAIL_GAPS_SQL] if gaps else [RETAIL_SQL]
    k = _k(keys)
    return with_ctes(*src, clean_cte("retail_gaps" if gaps else "retail"), totals_ctes(keys),
                     dense_ctes(keys)) + f"""
, agg AS (SELECT {k}CAST(SUM(CAST(filled AS INTEGER)) AS INTEGER) AS missing_months_filled,
              CAST(COUNT(*) AS INTEGER) AS series_length,
              CAST(SUM(CAST(NOT filled AS INTEGER)) AS INTEGER) AS observed_months
          FROM dense {_gb(keys)})
SELECT {_k(keys, 'a.')}a.missing_months_filled,
  CASE WHEN a.missing_months_filled > 0 THEN 'linear interpolation' ELSE 'not needed' END AS missing_months_method,
  p.removed AS partial_last_period_removed,
  CASE WHEN p.removed THEN strftime(p.latest_month, '%Y-%m') END AS partial_last_period,
  a.series_length, a.observed_months,
  CASE WHEN p.raw_months >= 3 THEN CAST(p.latest_days AS INTEGER) END AS latest_period_days_observed,
  CASE WHEN p.raw_months >= 3 THEN p.typical END AS typical_period_days_observed,
  CASE WHEN a.missing_months_filled > 0 THEN 'missing months were linearly interpolated for model continuity'
       ELSE 'no monthly gaps were found' END
  || CASE WHEN p.removed THEN '; incomplete latest period ' || strftime(p.latest_month, '%Y-%m') || ' was excluded from model training' ELSE '' END
  AS gap_handling
FROM agg a JOIN pflag p ON {_on(keys, 'a', 'p')}"""
