"""Derived inputs over the driver tables (see FIXTURES.md).

Each view is a lazy DataFrame over the parquet files, so every query that uses
it scans the whole tables.  The SQL text of the same views is kept next to the
Spark definition; the oracle queries embed it as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def retail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem joined to part, renamed so the role detector recognises every column."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_partkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    return j.select(
        F.col("l_shipdate").alias("sale_date"),
        F.col("l_quantity").alias("retail_sales"),
        F.col("p_partkey").cast("string").alias("item_code"),
        F.col("p_type").alias("item_type"),
        (F.col("l_quantity") * (1 + F.col("l_discount") - F.col("l_tax"))).alias("warehouse_sales"),
    )


RETAIL_SQL = """
retail AS (
  SELECT l_shipdate AS sale_date, l_quantity AS retail_sales,
         CAST(p_partkey AS VARCHAR) AS item_code, p_type AS item_type,
         l_quantity * (1 + l_discount - l_tax) AS warehouse_sales
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def retail_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of ``retail`` without the months whose ascending rank % 7 = 3."""
    r = retail(spark, sf_dir)
    months = (r.select(F.trunc("sale_date", "month").alias("m")).distinct()
              .withColumn("rk", F.row_number().over(Window.orderBy("m"))))
    dropped = months.where(F.col("rk") % 7 == 3).select("m")
    return (r.withColumn("m", F.trunc("sale_date", "month"))
            .join(F.broadcast(dropped), "m", "left_anti").drop("m"))


RETAIL_GAPS_SQL = """
retail_gaps AS (
  WITH r AS (SELECT * FROM retail),
  months AS (SELECT m, row_number() OVER (ORDER BY m) AS rk
             FROM (SELECT DISTINCT CAST(date_trunc('month', sale_date) AS DATE) AS m FROM r) x)
  SELECT r.* FROM r
  WHERE CAST(date_trunc('month', sale_date) AS DATE) NOT IN (SELECT m FROM months WHERE rk % 7 = 3)
)"""


def retail_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps with fraction and zone as text; a tenth of the orders in another layout, which loses the vote."""
    k, day = F.col("l_orderkey"), F.col("l_shipdate")
    zone = F.when(k % 3 == 0, "Z").when(k % 3 == 1, "+02:00").otherwise(" UTC")
    iso = F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T"), F.lpad((k % 24).cast("string"), 2, "0"), F.lit(":07:30.250"), zone)
    other = F.concat(F.date_format(day, "M/d/yyyy"), F.lit(" 2:05 PM"))
    return table(spark, sf_dir, "lineitem").select(F.when(k % 10 == 0, other).otherwise(iso).alias("sale_date"),
                                                   F.col("l_quantity").alias("retail_sales"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


RETAIL_STAMPS_SQL = """
dated AS (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS retail_sales,
         CASE WHEN l_orderkey % 10 <> 0 THEN l_shipdate + to_hours(l_orderkey % 24) + INTERVAL 7 MINUTE + INTERVAL 30250 MILLISECOND END AS analysis_date
  FROM lineitem)"""


def retail_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A typed date and a text time of day; some times are missing, some impossible."""
    k = F.col("l_orderkey")
    clock = F.concat_ws(":", (k % 24).cast("string"), F.lpad((k % 60).cast("string"), 2, "0"), F.lit("05"))
    return table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("sale_date"),
                                                   F.when(k % 31 == 0, None).when(k % 29 == 0, "25:99:00").otherwise(clock).alias("sale_time"),
                                                   F.col("l_quantity").alias("retail_sales"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


RETAIL_TIMED_SQL = """
dated AS (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS retail_sales,
         CASE WHEN l_orderkey % 31 <> 0 AND l_orderkey % 29 <> 0
              THEN l_shipdate + to_hours(l_orderkey % 24) + to_minutes(l_orderkey % 60) + INTERVAL 5 SECOND END AS analysis_date
  FROM lineitem)"""


def retail_year_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year and month as numbers: month 13, no month (January) and no year (invalid) among them."""
    k = F.col("l_orderkey")
    return table(spark, sf_dir, "lineitem").select(F.when(k % 43 != 0, F.year("l_shipdate")).alias("year"),
                                                   F.when(k % 37 == 0, 13).when(k % 41 != 0, F.month("l_shipdate")).alias("month"),
                                                   F.col("l_quantity").alias("retail_sales"), k.alias("basket"), "l_linenumber", "l_partkey", "l_suppkey")


RETAIL_YEAR_MONTH_SQL = """
dated AS (
  SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity AS retail_sales,
         CASE WHEN l_orderkey % 43 = 0 OR l_orderkey % 37 = 0 THEN NULL
              ELSE make_timestamp(year(l_shipdate), CASE WHEN l_orderkey % 41 = 0 THEN 1 ELSE month(l_shipdate) END, 1, 0, 0, 0) END AS analysis_date
  FROM lineitem)"""


def retail_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-string copy of lineitem ⋈ part with deterministic defects (FIXTURES.md)."""
    li = table(spark, sf_dir, "lineitem")
    pt = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    j = li.join(pt, li.l_partkey == pt.p_partkey)
    k = F.col("l_orderkey")
    base = j.select(
        k.cast("string").alias("l_orderkey"),
        F.col("l_linenumber").cast("string").alias("l_linenumber"),
        F.col("l_partkey").cast("string").alias("l_partkey"),
        F.col("l_suppkey").cast("string").alias("l_suppkey"),
        F.when(k % 97 == 0, F.when(k % 2 == 0, F.lit(None)).otherwise(F.lit("31/31/1999")))
         .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("sale_date"),
        F.when(k % 89 == 0, F.lit("n/a?"))
         .otherwise(F.col("l_quantity").cast("decimal(18,2)").cast("string")).alias("retail_sales"),
        F.col("p_partkey").cast("string").alias("item_code"),
        # missing, a blank token, blanks only, or blanks around the value
        F.when(k % 61 == 0, F.lit(None)).when(k % 67 == 0, F.lit("nan")).when(k % 71 == 0, F.lit(" \t "))
         .when(k % 73 == 0, F.concat(F.lit("\t"), F.col("p_type"), F.lit(" \n"))).otherwise(F.col("p_type")).alias("item_type"),
        F.when(k % 53 == 0, F.lit(None)).otherwise(
            (F.col("l_quantity") * (1 + F.col("l_discount") - F.col("l_tax")))
            .cast("decimal(18,4)").cast("string")).alias("warehouse_sales"),
    )
    dups = base.where(F.col("l_orderkey").cast("long") % 50 == 0)
    return base.unionByName(dups)


RETAIL_DIRTY_SQL = """
dirty_base AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey,
         CAST(l_linenumber AS VARCHAR) AS l_linenumber,
         CAST(l_partkey AS VARCHAR) AS l_partkey,
         CAST(l_suppkey AS VARCHAR) AS l_suppkey,
         CASE WHEN l_orderkey % 97 = 0 THEN (CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE '31/31/1999' END)
              ELSE strftime(l_shipdate, '%Y-%m-%d') END AS sale_date,
         CASE WHEN l_orderkey % 89 = 0 THEN 'n/a?'
              ELSE CAST(CAST(l_quantity AS DECIMAL(18,2)) AS VARCHAR) END AS retail_sales,
         CAST(p_partkey AS VARCHAR) AS item_code,
         CASE WHEN l_orderkey % 61 = 0 THEN NULL WHEN l_orderkey % 67 = 0 THEN 'nan' WHEN l_orderkey % 71 = 0 THEN ' ' || chr(9) || ' '
              WHEN l_orderkey % 73 = 0 THEN chr(9) || p_type || ' ' || chr(10) ELSE p_type END AS item_type,
         CASE WHEN l_orderkey % 53 = 0 THEN NULL
              ELSE CAST(CAST(l_quantity * (1 + l_discount - l_tax) AS DECIMAL(18,4)) AS VARCHAR) END AS warehouse_sales,
         l_orderkey AS k
  FROM lineitem JOIN part ON l_partkey = p_partkey
),
retail_dirty AS (
  SELECT * EXCLUDE (k) FROM dirty_base
  UNION ALL
  SELECT * EXCLUDE (k) FROM dirty_base WHERE k % 50 = 0
)"""
