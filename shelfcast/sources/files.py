"""File scans.

CSV is read with every column as text (no schema inference pass), the
missing-value tokens are nulled explicitly, and columns whose non-null values
all parse as numbers are cast in one aggregate pass, so de-duplication sees
``1`` and ``1.0`` as equal like a typed reader would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfcast.functions.exprs import NA_TOKENS, na_to_null, to_double
from shelfcast.session import compiled_projections, materialize
from shelfcast.sources.records import parse, records


def infer_numeric(df: DataFrame) -> DataFrame:
    """Cast text columns by what all their non-null values are: 64-bit integers, numbers or booleans.

    Whole numbers that do not all fit into 64 bits stay text: they are codes, and a double would
    change their digits.
    """
    cols = [c for c, t in df.dtypes if t == "string"]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        col = F.col(f"`{c}`")
        whole = F.trim(col).rlike(r"^[+-]?[0-9]+$")
        aggs += [F.count(col).alias(f"n_{i}"), F.count(to_double(col)).alias(f"d_{i}"), F.count_if(whole).alias(f"w_{i}"),
                 F.count(F.when(whole, F.trim(col).try_cast("long"))).alias(f"i_{i}"),
                 F.count_if(F.trim(col).isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b_{i}")]
    row = df.agg(*aggs).first()
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        i = cols.index(c) if c in cols else -1
        n = row[f"n_{i}"] if i >= 0 else 0
        if n and row[f"i_{i}"] == n:
            col = F.trim(col).try_cast("long")
        elif n and row[f"d_{i}"] == n and row[f"w_{i}"] < n:
            col = to_double(col)
        elif n and row[f"b_{i}"] == n:
            col = F.lower(F.trim(col)) == "true"
        out.append(col.alias(c))
    return df.select(*out)


def read_csv(spark: SparkSession, path: str, infer: bool = True, multi_line: bool = True) -> DataFrame:
    """Header row, missing-value tokens -> null, columns typed.

    Quoted fields may hold commas, doubled quotes and line breaks; large files are read in splits
    all the same (see ``records``).  The parsed rows are written once as Parquet, from which types
    are inferred and rows read.  ``multi_line=False`` leaves the files to the plain scan, where no
    field has a line break.  Each file's header must name the columns in the same order.
    """
    compiled_projections(spark)
    scan = (spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False)
            .option("escape", '"').option("mode", "PERMISSIVE"))
    if not multi_line:
        raw = scan.csv(path)
        raw = raw.select(*[na_to_null(F.col(f"`{c}`"), NA_TOKENS).alias(c) for c in raw.columns])
        return infer_numeric(raw) if infer else raw
    names = scan.option("multiLine", True).csv(path).columns  # reads a header, not the files
    rows = parse(records(spark, path, names), names)
    # by position: Parquet is written under plain names
    rows = materialize(rows.select(*[na_to_null(F.col(c), NA_TOKENS).alias(c) for c in rows.columns]), "table").toDF(*names)
    return infer_numeric(rows) if infer else rows
