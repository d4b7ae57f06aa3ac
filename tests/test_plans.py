"""Plan checks: pruning and pushdown reach the scans."""

import os

from shelfcast.operators import monthly as mo
from shelfcast.session import drop_tables, materialize
from tests.conftest import SF001


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_retail_gaps_reads_all_dates_and_prunes(spark):
    from shelfcast.plans import fixtures as fx
    p = plan_text(fx.retail_gaps(spark, SF001))
    assert "LessThan(l_shipdate" not in p  # no date cut: the view drops whole months by rank only
    # lineitem read schema holds only the five columns the view needs
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double,l_discount:double,l_tax:double,l_shipdate" in p


def test_cleaned_table_scan_gets_validity_filters(spark):
    from shelfcast.plans.queries import clean_view
    c = clean_view(spark, SF001)
    p = plan_text(c.frame.select("retail_sales"))
    assert "PushedFilters: [IsNotNull(analysis_date), IsNotNull(retail_sales)]" in p


def test_monthly_totals_single_exchange_with_partial_aggregation(spark):
    from shelfcast.operators.monthly import monthly_totals
    from shelfcast.plans.queries import clean_view
    c = clean_view(spark, SF001)
    p = monthly_totals(c.frame, "retail_sales", ["item_type"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_sum" in p or "partial_" in p


def _scans(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("FileScan parquet"), plan


def test_monthly_operators_scan_the_rows_once(spark, tmp_path):
    """What consumers read are the stored totals; the rows are read by the single job that writes them."""
    path = str(tmp_path / "rows")
    spark.range(5000).selectExpr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 900 as int)) AS analysis_date",
                                 "cast(id % 7 as double) AS sold", "concat('k', id % 3) AS kind").write.parquet(path)
    rows = spark.read.parquet(path)
    for keys in ([], ["kind"]):
        for df in (mo.monthly_sales(rows, "sold", keys), mo.monthly_series(rows, "sold", keys), *mo.monthly_series_and_meta(rows, "sold", keys)):
            _, plan = _scans(df)
            assert df.count() and path not in plan


def test_written_tables_can_be_removed(spark):
    from pyspark.sql import functions as F
    drop_tables(spark)
    frame = materialize(spark.range(3).select(F.col("id")))
    folder = frame.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    assert os.path.isdir(folder) and drop_tables(spark) == 1 and not os.path.exists(folder) and drop_tables(spark) == 0
