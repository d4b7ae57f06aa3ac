import os
import tempfile

from pyspark.sql import functions as F

from shelfcast.functions.exprs import compact_number
from shelfcast.operators import recommend as rec
from shelfcast.operators import report as rp
from shelfcast.operators.roles import RoleSchema
from shelfcast.sources import load_run, read_csv, sanitize, save_run


def test_intents(spark):
    qs = [("How many duplicate rows?", "cleaning"), ("Give me more information", "cleaning"),
          ("Is this safe enough for inventory planning?", "stock"), ("Can I trust it?", "reliability"),
          ("Why this model?", "why_model"), ("What is the RMSE?", "model_metrics"),
          ("What comes next?", "forecast"), ("Show the trend", "dataset"), ("hello", "fallback")]
    df = spark.createDataFrame([(q,) for q, _ in qs], "message string")
    got = [r["intent"] for r in rp.classify_questions(df).collect()]
    assert got == [i for _, i in qs]


def test_compact_numbers(spark):
    vals = [(0.0, "0"), (12.5, "12.5"), (999.999, "1K"), (1234.0, "1.23K"), (999999.0, "1M"),
            (1500000.0, "1.5M"), (2.5e9, "2.5B"), (-1500.0, "-1.5K")]
    df = spark.createDataFrame([(v,) for v, _ in vals], "x double")
    assert [r[0] for r in df.select(compact_number(F.col("x"))).collect()] == [c for _, c in vals]


def test_growth_and_risk(spark):
    import datetime as dt
    rows = []
    # item a: prior 0, recent 10 -> growth 100, medium; b: prior 8 recent 10 -> 25% medium;
    # c: recent 10 with warehouse 5 -> high; d: equal -> low
    for item, prior, recent, wh in [("a", 0, 10, 20), ("b", 8, 10, 20), ("c", 10, 10, 5), ("d", 10, 10, 20)]:
        rows.append((dt.datetime(2024, 1, 15), item, float(prior), 0.0))
        rows.append((dt.datetime(2024, 6, 15), item, float(recent), float(wh)))
    df = spark.createDataFrame(rows, "analysis_date timestamp_ntz, item string, sales double, warehouse_sales double")
    sch = RoleSchema(target_column="sales", item_column="item")
    got = {r["item"]: (r["growth_pct"], r["risk"], r["group"]) for r in rec.item_risk(df, sch, "sales").collect()}
    assert got == {"a": (100.0, "medium", "General"), "b": (25.0, "medium", "General"),
                   "c": (0.0, "high", "General"), "d": (0.0, "low", "General")}


def test_csv_scan_and_run_store(spark):
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as f:
        f.write("Sale Date,Qty,Note\n2024-01-01,1,NA\n2024-01-02,2.5,#N/A\n2024-01-03,,ok\n")
    df = read_csv(spark, p)
    assert dict(df.dtypes)["Qty"] == "double" and df.where(F.col("Note").isNull()).count() == 2
    run = spark.createDataFrame([("abc123", float("nan"), 1.23456)], "run_id string, x double, y double")
    save_run(run, os.path.join(d, "runs"))
    back = load_run(spark, os.path.join(d, "runs"), "abc123").first()
    assert back["run_id"] == "abc123" and back["y"] == 1.2346 and back["x"] is None
    assert sanitize(run).first()["x"] is None


def test_csv_numeric_typing_makes_duplicates_equal(spark):
    from shelfcast.operators.cleaning import clean
    from shelfcast.operators.roles import detect_roles
    d = tempfile.mkdtemp(dir="/tmp")
    p = os.path.join(d, "in.csv")
    with open(p, "w") as f:
        f.write("date,sales,item\n2024-01-01,1,a\n2024-01-01,1.0,a\n2024-01-02,2,b\n")
    df = read_csv(spark, p)
    r = clean(df, detect_roles(df))
    assert r.stats["duplicates_removed"] == 1 and r.stats["rows_after_cleaning"] == 2
