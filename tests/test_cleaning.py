import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfcast.functions.exprs import to_double
from shelfcast.operators import cleaning, stats
from shelfcast.operators.cleaning import clean, drop_all_null_columns
from shelfcast.operators.roles import detect_roles
from shelfcast.operators.stats import exact_median, modes
from shelfcast.session import materialize


def run(spark, rows, schema):
    df = spark.createDataFrame(rows, schema)
    return clean(df, detect_roles(df))


def test_duplicates_and_trim(spark):
    rows = [("2024-01-05", "a", "1"), ("2024-01-05", "a", "1"), ("2024-01-05", " a", "1"),
            ("2024-01-06", None, "2"), ("2024-01-06", None, "2")]
    r = run(spark, rows, "date string, item string, sales string")
    assert r.stats["duplicates_removed"] == 2          # ' a' differs before trimming
    assert r.stats["trimmed_text_columns"] == ["item"]
    assert r.stats["rows_after_cleaning"] == 3


def test_blanks_and_numbers(spark):
    rows = [("2024-01-01", "\tx\n", "1"), ("2024-01-02", "", "1,000"), ("2024-01-03", "nan", " 12 "),
            ("2024-01-04", "None", "1d"), ("2024-01-05", "NA", "inf"), ("2024-01-06", "null", "1e3"),
            ("2024-01-07", "y", "x")]
    r = run(spark, rows, "date string, item string, sales string")
    got = {row["date"]: row["sales"] for row in r.frame.collect()}
    assert got == {"2024-01-01": 1.0, "2024-01-03": 12.0, "2024-01-05": float("inf"), "2024-01-06": 1000.0}
    assert r.stats["target_values_removed"] == 3


@pytest.mark.parametrize("dtype,values", [
    ("double", [0.1, -0.0, 5e-324, 1.7976931348623157e308, 1e7, 12345678.9, float("inf"), float("-inf"), float("nan"), None]),
    ("bigint", [0, -1, 2**53 + 1, 2**63 - 1, -2**63, None]), ("int", [2**31 - 1, -2**31, None]), ("smallint", [-7, None]), ("tinyint", [7, None])])
def test_typed_numbers_are_those_of_their_text(spark, dtype, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {dtype}")
    rows = df.select(to_double(F.col("v")).alias("text"), to_double(F.col("v"), dtype).alias("typed"), "i").orderBy("i").collect()
    assert [repr(r["typed"]) for r in rows] == [repr(r["text"]) for r in rows]


def test_typed_numbers_are_not_read_as_text(spark, capsys):
    rows = [(dt.date(2024, 1, 5), 1.5, 2), (dt.date(2024, 1, 6), float("nan"), 3), (dt.date(2024, 1, 7), None, 4)]
    df = spark.createDataFrame(rows, "date date, sales double, amount int")
    plans = []
    with pytest.MonkeyPatch.context() as m:
        m.setattr(cleaning, "materialize", lambda d, how="table": (plans.append(d), materialize(d, how))[1])
        r = clean(df, detect_roles(df))
    plans[0].explain(extended=True)
    plan = capsys.readouterr().out
    assert "Project" in plan and "rlike" not in plan.lower()
    assert r.stats["target_values_removed"] == 2 and [x["sales"] for x in r.frame.collect()] == [1.5]
    assert dict(r.frame.dtypes)["amount"] == "double"


def test_bad_dates_pick_majority_layout(spark):
    rows = [("2024-01-02", "1"), ("2024-01-03", "1"), ("01/02/2024", "1"), ("2024-02-30", "1"),
            ("20240102", "1"), (None, "1")]
    r = run(spark, rows, "date string, sales string")
    assert r.stats["invalid_dates_removed"] == 4
    assert r.stats["rows_after_cleaning"] == 2


def test_year_month(spark):
    rows = [(2024, 0, 1.0), (2024, 1, 1.0), (2024, 12, 1.0), (2024, 13, 1.0), (2024, None, 1.0), (None, 5, 1.0)]
    r = run(spark, rows, "year int, month int, sales double")
    dates = sorted(str(x["analysis_date"])[:10] for x in r.frame.collect())
    assert dates == ["2024-01-01", "2024-01-01", "2024-12-01"]
    assert r.stats["invalid_dates_removed"] == 3


def test_fills(spark):
    rows = [("2024-01-01", 1.0, None, "b", None), ("2024-01-02", 2.0, 1.0, "a", None),
            ("2024-01-03", 3.0, 4.0, "b", None), ("2024-01-04", 4.0, None, "a", None),
            ("2024-01-05", 5.0, 2.0, None, None), ("2024-01-06", 6.0, 3.0, None, None)]
    r = run(spark, rows, "date string, sales double, price_per_unit double, item string, age double")
    assert r.stats["filled_numeric_columns"] == {"price_per_unit": 2.5, "age": 0.0}
    assert r.stats["filled_categorical_columns"] == {"item": "a"}   # tie a/b -> smallest
    assert r.stats["missing_values_before"] == {"price_per_unit": 2, "item": 2, "age": 6}
    assert r.stats["missing_values_after"] == {}
    assert r.frame.where(F.col("price_per_unit").isNull()).count() == 0


def test_drop_all_null_columns(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert drop_all_null_columns(df).columns == ["a"]


@pytest.mark.parametrize("accuracy,blocks", [(100_000, 1024), (50, 4), (1000, 1)])
def test_exact_medians_of_many_columns(spark, monkeypatch, accuracy, blocks):
    monkeypatch.setattr(stats, "_ACCURACY", accuracy)
    monkeypatch.setattr(stats, "_BLOCKS", blocks)
    rng = np.random.default_rng(7)
    n = 3001
    columns = {"normal": rng.normal(size=n), "hot": np.where(rng.random(n) < 0.5, 0.25, rng.normal(size=n)), "whole": rng.integers(0, 9, n),
               "wide": rng.choice([-1e300, -1.0, 0.0, 2.0, 1e300, np.inf, -np.inf], n), "one.dot": np.full(n, 3.0)}
    rows = [[None if (i * 7 + j) % 5 == 0 else float(v[i]) for j, v in enumerate(columns.values())] + [None] for i in range(n)]
    df = spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in [*columns, "empty"])).repartition(5)
    got = stats.exact_medians(df, [*columns, "empty"])
    for j, c in enumerate(columns):
        assert got[c] == pytest.approx(np.median([r[j] for r in rows if r[j] is not None]), rel=1e-12), c
    assert got["empty"] is None and exact_median(df.where("whole = 3"), "whole") == 3.0 and stats.exact_medians(df, []) == {}


def test_medians_take_three_jobs(spark):
    df = spark.range(4000).selectExpr(*[f"cast(id * {i} % 97 as double) AS c{i}" for i in range(1, 12)])
    spark.sparkContext.setJobGroup("medians", "medians")
    stats.exact_medians(df, df.columns)
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("medians")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    single = len(jobs)
    spark.sparkContext.setJobGroup("median", "median")
    stats.exact_medians(df, df.columns[:1])
    assert single == len(spark.sparkContext.statusTracker().getJobIdsForGroup("median"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_modes_tie_smallest(spark):
    df = spark.createDataFrame([("b", "x"), ("a", "x"), ("b", "y"), ("a", None)], "c1 string, c2 string")
    assert modes(df, ["c1", "c2"]) == {"c1": "a", "c2": "x"}


def test_date_plus_time(spark):
    rows = [("2024-01-05", "10:30:00", "1"), ("2024-01-06", None, "2"), ("2024-01-07", "25:99:00", "3"),
            ("2024-01-08", "08:00:00", "4")]
    r = run(spark, rows, "sale_date string, sale_time string, sales string")
    got = sorted(str(x["analysis_date"]) for x in r.frame.collect())
    assert got == ["2024-01-05 10:30:00", "2024-01-08 08:00:00"]
    assert r.stats["invalid_dates_removed"] == 2


@pytest.mark.parametrize("texts,want", [
    (["2024-01-05 10:30:00.125", "2024-01-06 11:00:00", "2024-01-07T11:00:00"], ["2024-01-05 10:30:00.125000", "2024-01-06 11:00:00"]),
    (["2024-01-05T23:30:00Z", "2024-01-06T23:30:00.5+05:30", "2024-01-07T01:00:00-0800", "2024-01-08T01:00:00 UTC"],
     ["2024-01-05 23:30:00", "2024-01-06 23:30:00.500000", "2024-01-07 01:00:00", "2024-01-08 01:00:00"]),
    (["1/15/2024 2:05 PM", "1/6/2024 12:00 am", "1/7/2024"], ["2024-01-06 00:00:00", "2024-01-15 14:05:00"]),
    (["2024-01-05", "2024-01-06", "x"], ["2024-01-05 00:00:00", "2024-01-06 00:00:00"]),
    (["31.12.2023 7:08", "1.1.2024 23:59"], ["2023-12-31 07:08:00", "2024-01-01 23:59:00"]),
])
def test_common_time_stamps(spark, texts, want):
    r = run(spark, [(t, 1.0) for t in texts], "sale_date string, sales double")
    assert sorted(str(x["analysis_date"]) for x in r.frame.collect()) == want


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
def test_typed_date_plus_time(spark, kind):
    df = spark.createDataFrame([("2024-01-05", "10:30:00", 1.0), ("2024-01-06", "9:15", 2.0), ("2024-01-07", "08:00:01.5", 3.0), ("2024-01-08", None, 4.0)],
                               "sale_date string, sale_time string, sales double").withColumn("sale_date", F.col("sale_date").cast(kind))
    r = clean(df, detect_roles(df))
    assert sorted(str(x["analysis_date"]) for x in r.frame.collect()) == ["2024-01-05 10:30:00", "2024-01-07 08:00:01.500000"]


def test_headers_with_dots_and_large_totals(spark):
    from shelfcast.functions.exprs import compact_number, round_half_up
    from shelfcast.operators import insights as ins
    from shelfcast.operators.roles import normalize_columns
    raw = spark.createDataFrame([("2024-01-05", "a", 1e30, None), ("2024-01-06", "b", 1e30, None), ("2024-01-07", "c", float("inf"), None)],
                                "`Sale.Date` string, `item.name` string, sales double, `no``thing.` string")
    kept = drop_all_null_columns(raw)
    assert kept.columns == ["Sale.Date", "item.name", "sales"]
    df = normalize_columns(kept)
    schema = detect_roles(df, "sale_date", "sales", "item_name")
    rows = clean(df, schema).frame
    finite = rows.where("sales < 1e31")
    assert ins.overview(finite, schema, "sales").first()["target_sum"] == 2e30
    assert ins.overview(rows, schema, "sales").first()["target_sum"] == float("inf")
    assert [tuple(r) for r in ins.top_segments(rows, schema, "sales", 1).collect()] == [("c", float("inf"))]
    values = spark.createDataFrame([(2.345,), (1e15,), (float("-inf"),), (None,), (1e29,), (999999.0,)], "v double")
    assert [r[0] for r in values.select(round_half_up(F.col("v"))).collect()] == [2.35, 1e15, float("-inf"), None, 1e29, 999999.0]
    assert [r[0] for r in values.select(compact_number(F.col("v"))).collect()] == ["2.35", "1000T", "-Infinity", None, "1.0E29", "1M"]


def test_empty_input_guard(spark):

    from shelfcast.operators.cleaning import require_rows
    with pytest.raises(ValueError):
        require_rows(spark.createDataFrame([], "a string"))


def test_strip_is_that_of_python(spark):
    from shelfcast.functions.exprs import WHITESPACE, has_edge_ws, strip_ws
    texts = [None, "", "a", "​x", "\x7f", "é"] + [a + m + b for a in [*WHITESPACE, "é", ""] for m in ("", "x y", "日本", "\x7f") for b in ("", *WHITESPACE[:3], "　", "​")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strip_ws(F.col("t")).alias("s"), has_edge_ws(F.col("t")).alias("edge")).collect()
    assert all((r.s, r.edge) == ((None, None) if r.t is None else (r.t.strip(), r.t != r.t.strip())) for r in rows)


def test_no_generated_method_is_too_long_for_the_jvm_to_compile(spark, monkeypatch):
    import re

    from shelfcast.operators import cleaning
    sizes = []

    def seen(df, how="table"):
        plan = df._jdf.queryExecution().executedPlan()
        text = spark.sparkContext._jvm.org.apache.spark.sql.execution.debug.package.codegenString(plan)
        sizes.extend(int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", text))
        # whole-stage code above the limit is not used
        assert all(x <= 8000 or int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000 for x in sizes)
        return how_it_was(df, how)
    how_it_was = cleaning.materialize
    monkeypatch.setattr(cleaning, "materialize", seen)
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        raw = spark.createDataFrame([(f"2020-01-{1 + i % 9:02d}", " 1.5 ", "x", "a ", "b", "c", "d") for i in range(20)],
                                    "sale_date string, retail_sales string, item_code string, item_type string, e string, f string, g string")
        cleaning.clean(raw, detect_roles(raw))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes


def test_text_that_is_no_number_is_told_before_the_cast(spark):
    import itertools

    from shelfcast.functions.exprs import to_double
    texts = ["".join(t) for n in range(5) for t in itertools.product("1.eE+-dfx \t", repeat=n)]
    texts += ["inf", "-INF", " +Infinity\t", "nan", "NaN", "0x1p3", "-0X.8P1", "0x1p3d", "\t1d", "1\n", "\x001", "1_0", "١", "1,0", "2020-01-02", "infinit", "é", "1e400", "."]
    s = F.trim("t")
    v = F.when(~s.rlike(r"(?i)^[+-]?[0-9.]+(e[+-]?[0-9]+)?[df]$"), s.try_cast("double"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", to_double(F.col("t")).alias("got"), F.when(~F.isnan(v), v).alias("want"))
    assert rows.where(~F.col("got").eqNullSafe(F.col("want"))).collect() == []
    assert rows.where("want IS NOT NULL").count() > 100
    # of what the guard lets through, only hexadecimal look-alikes may fail to parse
    from shelfcast.functions.exprs import _MAYBE_NUMBER
    assert {r.t.strip() for r in rows.where(F.col("t").rlike(_MAYBE_NUMBER) & F.col("t").try_cast("double").isNull()).collect()} <= {"1e400", *[t for t in texts if "x" in t.lower()]}
