"""Spark results equal the DuckDB oracle SQL at the smoke scale (the driver's gate runs sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from shelfcast.plans.fixtures import TABLES
from tests.conftest import SF001
from tools.oracle_check import digest

NAMES = ["monthly_sales", "monthly_dense", "monthly_meta", "item_risk", "features", "baseline_eval_by_type",
         "baseline_forecast", "role_detection", "answer_intents", "clean_rows", "cleaning_summary",
         "compact_numbers", "trend_series", "csv_scan"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF001).toPandas()
    odf = con.execute(E.oracle_sql()[name]).fetchdf()
    assert sorted(sdf.columns) == sorted(odf.columns)
    assert len(sdf) == len(odf)
    assert digest(sdf)[0] == digest(odf)[0]
