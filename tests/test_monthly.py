import datetime as dt

from pyspark.sql import functions as F

from shelfcast.operators import monthly as mo


def rows_for(spark, days_by_month):
    rows = []
    for (y, m), days in days_by_month.items():
        for d in days:
            rows.append((dt.datetime(y, m, d), 1.0))
    return spark.createDataFrame(rows, "analysis_date timestamp_ntz, sales double")


def test_partial_month_removed(spark):
    df = rows_for(spark, {(2024, 1): range(1, 32), (2024, 2): range(1, 30), (2024, 3): [1, 2]})
    out = mo.monthly_sales(df, "sales").orderBy("date").collect()
    assert [str(r["date"]) for r in out] == ["2024-01-01", "2024-02-01"]
    meta = mo.monthly_meta(df, "sales").first()
    assert meta["partial_last_period_removed"] and meta["partial_last_period"] == "2024-03"
    assert meta["latest_period_days_observed"] == 2 and meta["typical_period_days_observed"] == 30.0


def test_partial_month_kept_when_dense(spark):
    df = rows_for(spark, {(2024, 1): range(1, 32), (2024, 2): range(1, 30), (2024, 3): range(1, 26)})
    assert mo.monthly_sales(df, "sales").count() == 3
    # rule off (year/month input) and short series
    assert mo.monthly_sales(df, "sales", partial_rule=False).count() == 3
    two = rows_for(spark, {(2024, 1): range(1, 32), (2024, 2): [1]})
    assert mo.monthly_sales(two, "sales").count() == 2


def test_gap_interpolation(spark):
    m = spark.createDataFrame([(dt.date(2024, 1, 1), 1.0), (dt.date(2024, 4, 1), 7.0)], "date date, target double")
    out = mo.fill_gaps(m).orderBy("date").collect()
    assert [r["target"] for r in out] == [1.0, 3.0, 5.0, 7.0]
    assert [r["filled"] for r in out] == [False, True, True, False]


def test_keys_do_not_change_totals(spark):
    df = rows_for(spark, {(2024, 1): range(1, 32), (2024, 2): range(1, 30)}).withColumn(
        "k", (F.dayofmonth("analysis_date") % 3).cast("string"))
    a = mo.monthly_sales(df, "sales").agg(F.sum("target")).first()[0]
    b = mo.monthly_sales(df, "sales", keys=["k"]).agg(F.sum("target")).first()[0]
    assert a == b == 60.0


def test_partition_invariance(spark):
    from tests.conftest import SF001
    from shelfcast.plans.queries import clean_view
    c = clean_view(spark, SF001)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(mo.monthly_series(c.frame, "retail_sales").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    b = sorted(mo.monthly_series(c.frame, "retail_sales").collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert a == b


def test_hot_key_and_hot_duplicates(spark):
    """One key holds a third of the rows and many rows are identical: totals stay exact."""
    from shelfcast.operators.cleaning import clean
    from shelfcast.operators.roles import detect_roles
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{i % 97}"
        day = 1 + (i % 28)
        rows.append((f"2024-{1 + i % 6:02d}-{day:02d}", key, 1.0 if key == "hot" else float(i % 5)))
    rows += [("2024-01-01", "hot", 1.0)] * 1000          # a hot duplicate group
    df = spark.createDataFrame(rows, "date string, item string, sales double")
    r = clean(df, detect_roles(df))
    assert r.stats["duplicates_removed"] == r.stats["original_rows"] - r.frame.count()
    want = r.frame.groupBy("item").agg(F.sum("sales").alias("s"))
    got = mo.monthly_sales(r.frame, "sales", keys=["item"], partial_rule=False).groupBy("item") \
        .agg(F.sum("target").alias("s"))
    assert sorted(want.collect()) == sorted(got.collect())
