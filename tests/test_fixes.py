"""Inputs that once lost data: long codes, tiny and infinite values, long windows, quoted CSV, missing folders."""

import pytest
from pyspark.sql import functions as F

from shelfcast.functions.exprs import exact_sum
from shelfcast.operators.features import lag_sequences
from shelfcast.sources.files import read_csv
from shelfcast.sources.runs import load_run


def test_sum_keeps_small_and_infinite_values(spark):
    tiny = spark.range(1000).select(F.lit(4e-7).alias("v"))
    assert tiny.agg(exact_sum(F.col("v"))).first()[0] == pytest.approx(4e-4)
    rows = spark.createDataFrame([(float("inf"),), (10.0,), (4.0,)], "v double")
    assert rows.agg(exact_sum(F.col("v"))).first()[0] == float("inf")
    assert spark.createDataFrame([(None,)], "v double").agg(exact_sum(F.col("v"))).first()[0] is None
    assert spark.createDataFrame([(1e30,), (1e30,)], "v double").agg(exact_sum(F.col("v"))).first()[0] == 2e30


def test_long_window_has_all_its_values(spark):
    rows = spark.range(40).select(F.date_add(F.lit("2020-01-01"), F.col("id").cast("int")).alias("date"), F.col("id").cast("double").alias("scaled"))
    got = lag_sequences(rows, window=24).orderBy("date").collect()
    assert len(got) == 16 and got[0]["x"] == [float(i) for i in range(24)]


def test_csv_with_quotes_breaks_dots_and_codes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Sale.Date,item,code,flag\n2020-01-01,"5"" pipe, steel",12345678901234567890,True\n2020-01-02,"two\nlines",22345678901234567890,False\n')
    rows = read_csv(spark, str(tmp_path)).collect()
    assert [r["item"] for r in rows] == ['5" pipe, steel', "two\nlines"]
    assert [r["code"] for r in rows] == ["12345678901234567890", "22345678901234567890"]
    assert [r["flag"] for r in rows] == [True, False] and rows[0]["Sale.Date"] == "2020-01-01"


def test_csv_with_line_breaks_is_parsed_once(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Sale.Date,"a b,c",n\n2020-01-01,"two\nlines",1\n2020-01-02,NA,2\n')
    rows = read_csv(spark, str(tmp_path))
    assert rows.inputFiles() and all(f.endswith(".parquet") for f in rows.inputFiles())
    assert [tuple(r) for r in rows.collect()] == [("2020-01-01", "two\nlines", 1), ("2020-01-02", None, 2)]
    assert rows.columns == ["Sale.Date", "a b,c", "n"]


def test_absent_run_is_a_key_error(spark, tmp_path):
    with pytest.raises(KeyError):
        load_run(spark, str(tmp_path), "nope")
