"""Run store and JSON sanitising.

Runs are appended as JSON partitioned by ``run_id``; a lookup reads only its
partition folder, so the store scales with the number of runs.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.exprs import round_half_up


def _clean_value(c: F.Column, dt: T.DataType) -> F.Column:
    if isinstance(dt, (T.DoubleType, T.FloatType)):
        v = c.cast("double")
        return F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.lit(None).cast("double")).otherwise(round_half_up(v, 4))
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    if isinstance(dt, T.ArrayType):
        return F.transform(c, lambda x: _clean_value(x, dt.elementType))
    if isinstance(dt, T.StructType):
        return F.struct(*[_clean_value(c[f.name], f.dataType).alias(f.name) for f in dt.fields])
    if isinstance(dt, T.MapType):
        return F.transform_values(c, lambda k, v: _clean_value(v, dt.valueType))
    return c


def sanitize(df: DataFrame) -> DataFrame:
    """NaN/inf -> null and floats to 4 decimals at every nesting level; timestamps as ISO text."""
    return df.select(*[_clean_value(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields])


def save_run(run: DataFrame, store_dir: str) -> None:
    """Append the run document(s) as JSON, one folder per run_id."""
    sanitize(run).write.mode("append").option("ignoreNullFields", "false").partitionBy("run_id").json(store_dir)


def load_run(spark: SparkSession, store_dir: str, run_id: str, schema: T.StructType | None = None) -> DataFrame:
    """Read one run; error when it does not exist.  Reads only that partition folder,
    and keeps ``run_id`` as text (no partition-type inference)."""
    part = f"{store_dir.rstrip('/')}/run_id={run_id}"
    reader = spark.read
    if schema is not None:
        reader = reader.schema(T.StructType([f for f in schema.fields if f.name != "run_id"]))
    try:
        df = reader.json(part)  # through Spark's file system, wherever the store is
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raise KeyError("Analysis run not found.") from e
    return df.withColumn("run_id", F.lit(run_id))
