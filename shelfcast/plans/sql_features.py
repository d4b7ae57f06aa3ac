"""DuckDB oracle SQL for W1-W10 and M1, M2, M5, M6."""

from __future__ import annotations

from shelfcast.plans.fixtures import RETAIL_SQL
from shelfcast.plans.sql_monthly import _gb, _k, _on, _part, clean_cte, dense_ctes, totals_ctes, with_ctes


def rd(x: str, d: int) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(38,10)), {d}) AS DOUBLE)"


def _monthly(keys=()):
    return with_ctes(RETAIL_SQL, clean_cte(), totals_ctes(keys), dense_ctes(keys))


def features_sql(keys=()):
    k = _k(keys)
    w = f"({_part(keys)} ORDER BY date)"
    fr = lambda n: f"({_part(keys)} ORDER BY date ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    nn = f"COUNT(*) OVER ({_part(keys)})"
    lag = lambda j: f"lag(target, {j}) OVER {w}"
    pct = lambda j: f"CASE WHEN {lag(j)} = 0 THEN NULL ELSE target / {lag(j)} - 1 END"
    roll = lambda n, fn: f"CASE WHEN COUNT(target) OVER {fr(n)} = {n} THEN {fn}(target) OVER {fr(n)} END"
    keep = ("time_index IS NOT NULL AND lag_1 IS NOT NULL AND lag_2 IS NOT NULL AND lag_3 IS NOT NULL "
            "AND rolling_mean_3 IS NOT NULL AND rolling_std_3 IS NOT NULL AND pct_change_1 IS NOT NULL "
            "AND pct_change_3 IS NOT NULL AND (lag_6 IS NOT NULL OR series_n < 12) "
            "AND (rolling_mean_6 IS NOT NULL OR series_n < 12) AND (lag_12 IS NOT NULL OR series_n < 24)")
    dbl = ["month_sin", "month_cos", "lag_1", "lag_2", "lag_3", "lag_6", "lag_12", "rolling_mean_3",
           "rolling_std_3", "rolling_mean_6", "pct_change_1", "pct_change_3"]
    sel = ", ".join([f"{rd(c, 6)} AS {c}" for c in dbl])
    extra = ", series_n" if keys else ""
    return _monthly(keys) + f"""
, f AS (
  SELECT {k}date, target, {nn} AS series_n,
    CAST(row_number() OVER {w} - 1 AS INTEGER) AS time_index,
    CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
    sin(6.283185307179586 * month(date) / 12) AS month_sin,
    cos(6.283185307179586 * month(date) / 12) AS month_cos,
    {lag(1)} AS lag_1, {lag(2)} AS lag_2, {lag(3)} AS lag_3,
    CASE WHEN {nn} >= 12 THEN {lag(6)} END AS lag_6,
    CASE WHEN {nn} >= 24 THEN {lag(12)} END AS lag_12,
    {roll(3, 'AVG')} AS rolling_mean_3,
    {roll(3, 'STDDEV_SAMP')} AS rolling_std_3,
    CASE WHEN {nn} >= 12 THEN {roll(6, 'AVG')} END AS rolling_mean_6,
    {pct(1)} AS pct_change_1, {pct(3)} AS pct_change_3
  FROM dense
)
SELECT {k}date, target, time_index, month, quarter, {sel}{extra} FROM f WHERE {keep}"""


def minmax_sql(keys=()):
    k = _k(keys)
    p = f"OVER ({_part(keys)})"
    return _monthly(keys) + f"""
SELECT {k}date, target, MIN(target) {p} AS scale_min, MAX(target) {p} AS scale_max,
  {rd(f"CASE WHEN MAX(target) {p} = MIN(target) {p} THEN target - MIN(target) {p} ELSE (target - MIN(target) {p}) / (MAX(target) {p} - MIN(target) {p}) END", 6)} AS scaled
FROM dense"""


def lag_sequences_sql(keys=()):
    k = _k(keys)
    p = f"OVER ({_part(keys)})"
    w = f"OVER ({_part(keys)} ORDER BY date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)"
    return _monthly(keys) + f"""
, s AS (
  SELECT {k}date, COUNT(*) {p} AS n,
    CASE WHEN MAX(target) {p} = MIN(target) {p} THEN target - MIN(target) {p}
         ELSE (target - MIN(target) {p}) / (MAX(target) {p} - MIN(target) {p}) END AS scaled
  FROM dense
),
h AS (SELECT *, CASE WHEN n >= 12 THEN 6 ELSE 3 END AS seq_window, list(scaled) {w} AS hist FROM s),
x AS (SELECT *, list_slice(hist, GREATEST(1, len(hist) - seq_window + 1), GREATEST(1, len(hist) - seq_window + 1) + seq_window - 1) AS xs FROM h)
SELECT {k}date, array_to_string(list_transform(xs, lambda v: printf('%.6f', v)), ',') AS x,
       {rd('scaled', 6)} AS y, seq_window
FROM x WHERE len(xs) = seq_window"""


def _tail_mean(arr: str, sw: str) -> str:
    sl = f"list_slice({arr}, GREATEST(1, len({arr}) - ({sw}) + 1), len({arr}))"
    return f"(list_reduce(list_prepend(0.0, {sl}), lambda s, v: s + v) / len({sl}))"


def _hist_ctes(keys):
    k = _k(keys)
    return f"""
, h AS (SELECT {k}list(target ORDER BY date) AS vals, COUNT(*) AS n, MAX(date) AS last_date FROM dense {_gb(keys)}),
hh AS (SELECT *, LEAST(3, GREATEST(1, n // 4)) AS hold FROM h WHERE n >= 4),
tr AS (SELECT *, list_slice(vals, 1, n - hold) AS train, list_slice(vals, n - hold + 1, n) AS actual,
              CASE WHEN n - hold < 12 THEN 3 ELSE 12 END AS sw FROM hh),
s1 AS (SELECT *, list_append(train, {_tail_mean('train', 'sw')}) AS a1 FROM tr),
s2 AS (SELECT *, list_append(a1, {_tail_mean('a1', 'sw')}) AS a2 FROM s1),
s3 AS (SELECT *, list_append(a2, {_tail_mean('a2', 'sw')}) AS a3 FROM s2),
pr AS (SELECT *, list_slice(a3, len(train) + 1, len(train) + hold) AS preds FROM s3),
pairs AS (SELECT {k}unnest(actual) AS a, unnest(preds) AS p FROM pr)"""


def baseline_eval_sql(keys=()):
    k = _k(keys)
    return _monthly(keys) + _hist_ctes(keys) + f"""
, ma AS (SELECT *, AVG(a) OVER ({_part(keys)}) AS mean_a FROM pairs),
met AS (
  SELECT {k}COUNT(*) AS cnt, AVG(ABS(a - p)) AS mae, SQRT(AVG((a - p) * (a - p))) AS rmse,
         AVG(CASE WHEN a <> 0 THEN ABS((a - p) / a) END) * 100 AS mape,
         SUM((a - p) * (a - p)) AS sse, SUM((a - mean_a) * (a - mean_a)) AS sst
  FROM ma {_gb(keys)}
),
ser AS (SELECT {k}COUNT(*) AS n FROM dense {_gb(keys)})
SELECT {_k(keys, 's.')}'Seasonal Baseline' AS model,
  CASE WHEN s.n >= 4 THEN {rd('m.mae', 4)} END AS mae,
  CASE WHEN s.n >= 4 THEN {rd('m.rmse', 4)} END AS rmse,
  CASE WHEN s.n >= 4 THEN {rd('m.mape', 4)} END AS mape,
  CASE WHEN s.n >= 4 THEN {rd("CASE WHEN m.cnt <= 1 THEN NULL WHEN m.sst = 0 THEN (CASE WHEN m.sse = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - m.sse / m.sst END", 4)} END AS r2,
  CASE WHEN s.n >= 4 THEN 'trained' ELSE 'skipped' END AS status,
  CASE WHEN s.n >= 4 THEN NULL ELSE 'Not enough history for baseline evaluation.' END AS reason
FROM ser s LEFT JOIN met m ON {_on(keys, 's', 'm')}"""


def baseline_forecast_sql(keys=()):
    k = _k(keys)
    sw = lambda a: f"(CASE WHEN len({a}) < 12 THEN 3 ELSE 12 END)"
    return _monthly(keys) + f"""
, h AS (SELECT {k}list(target ORDER BY date) AS vals, COUNT(*) AS n, MAX(date) AS last_date FROM dense {_gb(keys)}),
f1 AS (SELECT *, list_append(vals, {_tail_mean('vals', sw('vals'))}) AS a1 FROM h WHERE n >= 4),
f2 AS (SELECT *, list_append(a1, {_tail_mean('a1', sw('a1'))}) AS a2 FROM f1),
f3 AS (SELECT *, list_append(a2, {_tail_mean('a2', sw('a2'))}) AS a3 FROM f2),
u AS (SELECT {k}last_date, unnest(list_slice(a3, n + 1, n + 3)) AS pred, unnest([1, 2, 3]) AS step FROM f3)
SELECT {k}CAST(last_date + step * INTERVAL 1 MONTH AS DATE) AS date, 'Seasonal Baseline' AS model,
       {rd('GREATEST(0.0, pred)', 2)} AS value
FROM u"""


def next_feature_row_sql(keys=()):
    """M3: windows over the dense months; a short history falls back to its last value or to what it has."""
    k = _k(keys)
    w = f"({_part(keys)} ORDER BY date)"
    last = lambda n: f"({_part(keys)} ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    lag = lambda j: f"COALESCE(lag(target, {j - 1}) OVER {w}, target)"
    pct = lambda j: f"CASE WHEN lag(target, {j}) OVER {w} <> 0 THEN (target - lag(target, {j}) OVER {w}) / lag(target, {j}) OVER {w} ELSE 0.0 END"
    six = f"CASE WHEN row_number() OVER {w} >= 6 THEN AVG(target) OVER {last(6)} ELSE AVG(target) OVER {w} END"
    cols = {"lag_1": "target", **{f"lag_{j}": lag(j) for j in (2, 3, 6, 12)}, "rolling_mean_3": f"AVG(target) OVER {last(3)}",
            "rolling_std_3": f"COALESCE(STDDEV_SAMP(target) OVER {last(3)}, 0.0)", "rolling_mean_6": six, "pct_change_1": pct(1), "pct_change_3": pct(3)}
    inner = ", ".join(f"{e} AS {c}" for c, e in cols.items())
    return _monthly(keys) + f"""
, f AS (SELECT {k}CAST(date + INTERVAL 1 MONTH AS DATE) AS date, CAST(row_number() OVER {w} AS INTEGER) AS time_index, {inner} FROM dense)
SELECT {k}date, time_index, CAST(month(date) AS INTEGER) AS month, CAST(quarter(date) AS INTEGER) AS quarter,
       {rd("sin(6.283185307179586 * month(date) / 12)", 6)} AS month_sin, {rd("cos(6.283185307179586 * month(date) / 12)", 6)} AS month_cos,
       {", ".join(f"{rd(c, 6)} AS {c}" for c in cols)}
FROM f"""


def _window_ar_ctes(keys=()):
    """A regression on 3 or 6 scaled lags per series, for the training slice and for the whole series."""
    k, ids = _k(keys), list(keys) + ["fit"]
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in ids)
    key = ", ".join(ids)
    out = f"""
, h AS (SELECT {k}list(target ORDER BY date) AS vals, COUNT(*) AS n, MAX(date) AS last_date FROM dense {_gb(keys)}),
hh AS (SELECT *, LEAST(3, GREATEST(1, n // 4)) AS hold FROM h WHERE n >= 10),
ok AS (SELECT * FROM hh WHERE n - hold > CASE WHEN n - hold >= 12 THEN 6 ELSE 3 END + 2),
both_fits AS (
  SELECT {k}'eval' AS fit, list_slice(vals, 1, n - hold) AS vals, list_slice(vals, n - hold + 1, n) AS actual, hold AS steps, last_date FROM ok
  UNION ALL SELECT {k}'final', vals, NULL, 3, last_date FROM ok),
sc AS (SELECT *, list_min(vals) AS lo, list_max(vals) - list_min(vals) AS rng, CASE WHEN len(vals) >= 12 THEN 6 ELSE 3 END AS w FROM both_fits),
st AS (SELECT *, list_transform(vals, lambda v: CASE WHEN rng = 0 THEN v - lo ELSE (v - lo) / rng END) AS s FROM sc WHERE len(vals) - w >= 3),
z AS (
  SELECT {key}, w, t, i, CASE WHEN i < w THEN s[t - w + i + 1] WHEN i = w THEN 1.0 ELSE s[t + 1] END AS v
  FROM (SELECT *, unnest(range(0, w + 2)) AS i FROM (SELECT {key}, w, s, unnest(range(w, len(s))) AS t FROM st))),
e0 AS MATERIALIZED (
  SELECT {", ".join(f"a.{c}" for c in ids)}, a.w, a.i, b.i AS j, SUM(a.v * b.v) + CASE WHEN a.i = b.i AND a.i < a.w THEN 0.01 ELSE 0.0 END AS v
  FROM z a JOIN z b ON {on("a", "b")} AND a.t = b.t WHERE a.i <= a.w
  GROUP BY {", ".join(f"a.{c}" for c in ids)}, a.w, a.i, b.i)"""
    for p in range(7):
        out += f""",
e{p + 1} AS MATERIALIZED (
  SELECT {", ".join(f"a.{c}" for c in ids)}, a.w, a.i, a.j,
         CASE WHEN q.v IS NULL THEN a.v WHEN a.i = {p} THEN a.v / q.v ELSE a.v - c.v * (r.v / q.v) END AS v
  FROM e{p} a LEFT JOIN e{p} q ON {on("a", "q")} AND q.i = {p} AND q.j = {p}
  LEFT JOIN e{p} c ON {on("a", "c")} AND c.i = a.i AND c.j = {p} LEFT JOIN e{p} r ON {on("a", "r")} AND r.i = {p} AND r.j = a.j)"""
    nxt = lambda a: f"list_append({a}, list_inner_product(list_slice(c, 1, w), list_slice({a}, len({a}) - w + 1, len({a}))) + c[w + 1])"
    return out + f""",
co AS (SELECT {key}, list(v ORDER BY i) AS c FROM e7 WHERE j = w + 1 GROUP BY ALL),
a1 AS (SELECT st.*, c, {nxt("s")} AS x1 FROM st JOIN co ON {on("st", "co")}),
a2 AS (SELECT *, {nxt("x1")} AS x2 FROM a1),
a3 AS (SELECT *, {nxt("x2")} AS x3 FROM a2),
pr AS (SELECT *, list_transform(list_slice(x3, len(s) + 1, len(s) + steps), lambda v: GREATEST(0.0, CASE WHEN rng = 0 THEN v + lo ELSE v * rng + lo END)) AS preds FROM a3)"""


def window_ar_results_ctes(keys=()):
    """``arr``: the results of M11 with metrics unrounded, one row per series."""
    k = _k(keys)
    return _window_ar_ctes(keys) + f"""
, pa AS (SELECT {k}unnest(actual) AS a, unnest(preds) AS p FROM pr WHERE fit = 'eval'),
ma AS (SELECT *, AVG(a) OVER ({_part(keys)}) AS mean_a FROM pa),
met AS (
  SELECT {k}COUNT(*) AS cnt, AVG(ABS(a - p)) AS mae, SQRT(AVG((a - p) * (a - p))) AS rmse,
         AVG(CASE WHEN a <> 0 THEN ABS((a - p) / a) END) * 100 AS mape,
         SUM((a - p) * (a - p)) AS sse, SUM((a - mean_a) * (a - mean_a)) AS sst
  FROM ma {_gb(keys)}),
arr AS (
  SELECT {_k(keys, 's.')}'Window AR' AS model, m.mae, m.rmse, m.mape,
         CASE WHEN m.cnt <= 1 THEN NULL WHEN m.sst = 0 THEN (CASE WHEN m.sse = 0 THEN 1.0 ELSE 0.0 END) ELSE 1 - m.sse / m.sst END AS r2,
         CASE WHEN m.rmse IS NOT NULL THEN 'trained' ELSE 'skipped' END AS status,
         CASE WHEN m.rmse IS NOT NULL THEN NULL ELSE 'Not enough history for stable window autoregression.' END AS reason
  FROM (SELECT {k}COUNT(*) AS n FROM dense {_gb(keys)}) s LEFT JOIN met m ON {_on(keys, 's', 'm')})"""


def window_ar_by_type_sql():
    return _monthly(["item_type"]) + window_ar_results_ctes(["item_type"]) + f"""
SELECT item_type, model, {", ".join(f"{rd(c, 4)} AS {c}" for c in ("mae", "rmse", "mape", "r2"))}, status, reason FROM arr"""


def window_ar_forecast_sql(keys=()):
    k = _k(keys)
    return _monthly(keys) + _window_ar_ctes(keys) + f"""
, u AS (SELECT {k}last_date, unnest(preds) AS pred, unnest([1, 2, 3]) AS step FROM pr WHERE fit = 'final')
SELECT {k}'Window AR' AS model, CAST(last_date + step * INTERVAL 1 MONTH AS DATE) AS date, {rd('pred', 2)} AS value FROM u"""
