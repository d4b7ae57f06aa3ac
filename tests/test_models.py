import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from shelfcast.operators import evaluate as ev
from shelfcast.operators import features as fe
from shelfcast.operators import forecast as fc
from shelfcast.operators import select as sl
from tests.conftest import SF001


def series(spark, values, key=None):
    rows = []
    for i, v in enumerate(values):
        d = dt.date(2020 + i // 12, i % 12 + 1, 1)
        rows.append((key, d, float(v)) if key else (d, float(v)))
    return spark.createDataFrame(rows, ("k string, " if key else "") + "date date, target double")


@pytest.mark.parametrize("n,cols", [(9, 12), (12, 14), (24, 15)])
def test_feature_columns_by_length(spark, n, cols):
    f = fe.feature_frame(series(spark, range(1, n + 1)))
    assert len(f.columns) == 2 + cols
    # rows survive once every active lag/rolling window is full
    need = 12 if n >= 24 else (6 if n >= 12 else 3)
    assert f.count() == n - need


def test_zero_month_drops_rows(spark):
    vals = [5, 6, 7, 8, 0, 9, 10, 11, 12]
    f = fe.feature_frame(series(spark, vals)).collect()
    # pct_change into/after the zero month is undefined -> those rows vanish
    assert all(r["lag_1"] != 0 and r["lag_3"] != 0 for r in f)


def test_metrics_cases(spark):
    def m(a, p):
        df = spark.createDataFrame([("s", float(x), float(y)) for x, y in zip(a, p)], "k string, actual double, predicted double")
        return ev.metrics(df, ["k"]).first()
    r = m([1, 2, 3], [1, 3, 2])
    assert r["r2"] == pytest.approx(0.0) and r["mae"] == pytest.approx(2 / 3)
    assert m([4, 4], [4, 4])["r2"] == 1.0 and m([4, 4], [4, 5])["r2"] == 0.0
    assert m([0, 0], [1, 2])["mape"] is None
    assert m([5], [4])["r2"] is None


def test_baseline_eval_and_forecast(spark):
    s = series(spark, [10, 20, 30, 40, 50, 60, 70, 80])
    r = ev.baseline_eval(s).first()
    # n=8 -> holdout 2, train 6 (< 12 -> window 3): mean(40,50,60)=50, then mean(50,60,50)
    assert r["status"] == "trained" and r["mae"] == pytest.approx((20 + (80 - 160 / 3)) / 2)
    f = ev.baseline_forecast(s).orderBy("date").collect()
    assert [x["value"] for x in f] == [70.0, 73.33, 74.44]
    assert str(f[0]["date"]) == "2020-09-01"
    assert ev.baseline_eval(series(spark, [1, 2, 3])).first()["status"] == "skipped"


def test_holdout_sizes(spark):
    for n, h in [(4, 1), (8, 2), (11, 2), (12, 3), (27, 3)]:
        s = ev.split_holdout(series(spark, range(n)))
        assert s.where("is_holdout").count() == h


def test_window_ar_and_forest_small(spark):
    vals = [100 + 10 * (i % 12) + i for i in range(30)]
    s = series(spark, vals)
    ar = fc.window_ar(s)
    assert ar.results.first()["status"] == "trained"
    assert ar.forecasts.count() == 3 and ar.forecasts.where("value < 0").count() == 0
    rf = fc.tree_model(s, fc.FOREST, fc.forest(numTrees=10))
    assert rf.forecasts.count() == 3 and rf.results.first()["rmse"] is not None
    with pytest.raises(fc.NotEnoughHistory):
        fc.tree_model(series(spark, range(7)), fc.FOREST, fc.forest(numTrees=5))


def test_pooled_by_key(spark):
    a = series(spark, [100 + i for i in range(14)], "a")
    b = series(spark, [50 + 2 * i for i in range(26)], "b")
    c = series(spark, [1, 2, 3], "c")
    run = fc.tree_model(a.unionByName(b).unionByName(c), fc.FOREST, fc.forest(numTrees=5), ["k"])
    st = {r["k"]: r["status"] for r in run.results.collect()}
    assert st == {"a": "trained", "b": "trained", "c": "skipped"}
    assert run.forecasts.groupBy("k").count().count() == 2


def results(spark, rows):
    return spark.createDataFrame(rows, "model string, mae double, rmse double, mape double, r2 double, "
                                       "status string, reason string")


def test_best_model_ties_follow_model_order(spark):
    r = results(spark, [("Window AR", 1.0, 2.00001, 5.0, 0.1, "trained", None),
                        ("Seasonal Baseline", 1.0, 2.0, 5.0, 0.1, "trained", None),
                        ("Random Forest", 1.0, 3.0, 5.0, 0.1, "trained", None)])
    assert sl.best_model(r).first()["model"] == "Seasonal Baseline"
    none = results(spark, [("Random Forest", None, None, None, None, "skipped", "x")])
    assert sl.best_model(none).first()["model"] == "Unavailable"


@pytest.mark.parametrize("mape,ratio,gaps,label", [
    (12.0, 0.95, 0, "Strong"), (12.01, 0.95, 0, "Directional"), (20.0, 0.95, 0, "Directional"),
    (20.01, 0.95, 0, "Exploratory"), (12.0, 0.951, 0, "Exploratory"), (12.0, 0.95, 2, "Directional")])
def test_confidence_labels(spark, mape, ratio, gaps, label):
    r = results(spark, [("Random Forest", 1.0, 100.0 * ratio, mape, 0.5, "trained", None),
                        ("Seasonal Baseline", 1.0, 100.0, 30.0, 0.1, "trained", None)])
    meta = spark.createDataFrame([(gaps, False)], "missing_months_filled int, partial_last_period_removed boolean")
    b = sl.best_model(r)
    c = sl.confidence(r, b, meta).first()
    assert c["label"] == label
    assert ("interpolation" in c["reason"]) == (gaps > 0)


def test_features_with_keys_mixed_lengths(spark):
    a = series(spark, [10 + i for i in range(9)], "a")
    b = series(spark, [20 + i for i in range(14)], "b")
    f = fe.feature_frame(a.unionByName(b), ["k"])
    counts = {r["k"]: r["count"] for r in f.groupBy("k").count().collect()}
    assert counts == {"a": 9 - 3, "b": 14 - 6}
    short = f.where("k = 'a'")
    assert short.where("lag_6 IS NOT NULL OR rolling_mean_6 IS NOT NULL OR lag_12 IS NOT NULL").count() == 0
    assert f.where("k = 'b' AND lag_6 IS NULL").count() == 0


@pytest.mark.parametrize("query", ["boosting_forecast", "model_results"])
def test_queries_boost_all_rounds(spark, monkeypatch, query):
    class Fitted(Exception):
        pass

    def tree_model(monthly, name, factory, keys=None):
        if name == fc.BOOSTING:
            raise Fitted(factory().rounds)

    monkeypatch.setattr(fc, "tree_model", tree_model)
    with pytest.raises(Fitted) as e:
        E.queries()[query](spark, SF001)
    assert e.value.args == (500,)
