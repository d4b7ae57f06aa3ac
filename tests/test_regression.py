"""Next-step feature rows and window regressions against plain numpy."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.operators import forecast as fc
from shelfcast.operators import regression as rg


def monthly(spark, series):
    rows = [(k, dt.date(2019 + i // 12, i % 12 + 1, 1), float(v)) for k, vs in series.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, date date, target double").repartition(3)


def plain_ar(values, steps):
    v = np.array(values, float)
    lo, rng = v.min(), v.max() - v.min()
    s = list((v - lo) / rng if rng else v - lo)
    w = 6 if len(s) >= 12 else 3
    x = np.array([[*s[t - w:t], 1.0] for t in range(w, len(s))])
    a = x.T @ x + np.diag([fc.AR_RIDGE] * w + [0.0])
    c = np.linalg.solve(a, x.T @ np.array(s[w:]))
    out = []
    for _ in range(steps):
        s.append(float(np.dot(c[:w], s[-w:]) + c[w]))
        out.append(max(0.0, s[-1] * rng + lo if rng else s[-1] + lo))
    return out


def test_solve_equals_numpy(spark):
    rng = np.random.default_rng(2)
    systems = []
    for n in (1, 2, 4, 7):
        m = rng.normal(size=(n + 3, n))
        systems.append((n, m.T @ m + 0.01 * np.eye(n), rng.normal(size=n)))
    rows = [(n, [float(v) for v in np.column_stack([a, b]).ravel()]) for n, a, b in systems]
    got = spark.createDataFrame(rows, "n int, m array<double>").select("n", rg.solve(F.col("m"), F.col("n")).alias("x")).collect()
    for n, a, b in systems:
        assert next(r.x for r in got if r.n == n) == pytest.approx(np.linalg.solve(a, b), rel=1e-8)


def test_window_ar_equals_numpy(spark):
    rng = np.random.default_rng(3)
    series = {"long": 100 + np.arange(40) + 20 * np.sin(np.arange(40)), "twelve": rng.uniform(5, 9, 12), "ten": rng.uniform(5, 9, 10),
              "flat": [7.0] * 20, "falling": 1000.0 - 45 * np.arange(22), "short": [1.0, 2.0, 3.0], "nine": range(9)}
    run = fc.window_ar(monthly(spark, series), ["k"])
    status = {r.k: r.status for r in run.results.collect()}
    assert status == {k: "skipped" if k in ("short", "nine") else "trained" for k in series}
    got = {}
    for r in run.forecasts.orderBy("date").collect():
        got.setdefault(r.k, []).append(r.value)
    for k in got:
        assert got[k] == pytest.approx(plain_ar(series[k], 3), abs=0.0051)
    held = {r.k: r.mae for r in run.results.collect()}
    v = list(series["long"])
    assert held["long"] == pytest.approx(np.mean(np.abs(np.array(plain_ar(v[:-3], 3)) - v[-3:])), rel=1e-9)
    assert set(got) == {k for k, s in status.items() if s == "trained"}
    assert fc.window_ar(monthly(spark, {"short": [1.0, 2.0]}), ["k"]).forecasts.count() == 0


def test_next_feature_rows_of_short_histories(spark):
    values = [4.0, 0.0, 6.0, 2.0, 5.0, 1.0, 8.0, 3.0, 9.0, 7.0, 10.0, 12.0, 11.0]
    rows = fc.next_feature_rows(monthly(spark, {"a": values}), ["k"]).orderBy("date").collect()
    assert len(rows) == len(values)
    for n, r in enumerate(rows, 1):
        h = values[:n]
        at = lambda j: h[-j] if len(h) >= j else h[-1]  # noqa: E731, B023
        change = lambda j: (h[-1] - h[-1 - j]) / h[-1 - j] if len(h) > j and h[-1 - j] else 0.0  # noqa: E731, B023
        month = n % 12 + 1
        assert (r.time_index, r.month, r.quarter, str(r.date)[:7]) == (n, month, (month - 1) // 3 + 1, f"{2019 + n // 12}-{month:02d}")
        assert [r.lag_1, r.lag_2, r.lag_3, r.lag_6, r.lag_12] == [at(1), at(2), at(3), at(6), at(12)]
        assert r.rolling_mean_3 == pytest.approx(np.mean(h[-3:])) and r.rolling_mean_6 == pytest.approx(np.mean(h[-6:]))
        assert r.rolling_std_3 == pytest.approx(np.std(h[-3:], ddof=1) if n > 1 else 0.0)
        assert [r.pct_change_1, r.pct_change_3] == pytest.approx([change(1), change(3)])
