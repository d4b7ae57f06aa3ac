"""Row cleaning.

Plan: de-duplicate whole rows (one shuffle, partial aggregation collapses hot
duplicate groups map-side), trim/blank/coerce/parse in one projection, write
that frame once to the shared checkpoint folder, then answer every count,
median and mode from it.  The returned frame reads the checkpoint, so the
de-duplication shuffle runs once however many statistics are taken.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfcast.functions.exprs import BLANK_TOKENS, has_edge_ws, parse_timestamp, strip_ws, to_double
from shelfcast.operators.roles import RoleSchema, normalize_columns
from shelfcast.operators.stats import exact_medians, modes
from shelfcast.session import compiled_projections, materialize

# Extra columns always coerced to numbers when present.
EXTRA_NUMERIC = ["price_per_unit", "cogs", "age"]

# Candidate date layouts, tried in this order; the one that parses most values wins
# (month-first before day-first on ties).
DATE_FORMATS = [
    "yyyy-M-d H:m:s[.SSSSSSSSS]", "yyyy-M-d'T'H:m:s[.SSSSSSSSS]", "yyyy-M-d H:m", "yyyy-M-d'T'H:m", "yyyy-M-d",
    "yyyy-M-d h:m:s[.SSSSSSSSS] a", "yyyy-M-d h:m a",
    "yyyy/M/d H:m:s[.SSSSSSSSS]", "yyyy/M/d H:m", "yyyy/M/d", "M/d/yyyy H:m:s[.SSSSSSSSS]", "M/d/yyyy H:m", "M/d/yyyy h:m:s[.SSSSSSSSS] a",
    "M/d/yyyy h:m a", "M/d/yyyy",
    "d/M/yyyy H:m:s[.SSSSSSSSS]", "d/M/yyyy H:m", "d/M/yyyy h:m:s[.SSSSSSSSS] a", "d/M/yyyy h:m a", "d/M/yyyy", "yyyyMMdd", "M-d-yyyy", "d-M-yyyy",
    "d.M.yyyy H:m:s[.SSSSSSSSS]", "d.M.yyyy H:m", "d.M.yyyy", "M/d/yy", "d-MMM-yyyy", "MMM d, yyyy",
]
TIME_FORMATS = ["H:m:s[.SSSSSSSSS]", "H:m", "h:m:s[.SSSSSSSSS] a", "h:m a"]

#: A time of day with a zone behind it; the wall time is kept, the zone is not.
_ZONED = "^(.*\\d:\\d{2}(?::\\d{2}(?:\\.\\d{1,9})?)?)\\s*(?:[Zz]|UTC|GMT|[+-]\\d{2}(?::?\\d{2})?)$"

_NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass
class CleanResult:
    frame: DataFrame          # cleaned rows with ``analysis_date``
    summary: DataFrame        # C14, one row
    missing: DataFrame        # C11, (stage, column_name, missing)
    schema: RoleSchema
    stats: dict               # the same figures as plain Python values


def _is_numeric(dt) -> bool:
    return isinstance(dt, _NUMERIC)


def choose_date_format(df: DataFrame, col_expr, formats=DATE_FORMATS) -> str | None:
    """Pick the layout that parses the most non-null values (one aggregate pass)."""
    # Parse each *distinct* text once, weighted by its row count: the group-by
    # collapses rows map-side (days repeat), so every layout is tried on a
    # small table instead of on every row.
    vals = df.groupBy(col_expr.cast("string").alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    aggs = [F.coalesce(F.sum(F.when(parse_timestamp(F.col("_v"), f).isNotNull(), F.col("_c"))), F.lit(0)).alias(f"f{i}")
            for i, f in enumerate(formats)]
    row = vals.agg(*aggs).first()
    best, best_n = None, 0
    for i, f in enumerate(formats):
        if row[f"f{i}"] > best_n:
            best, best_n = f, row[f"f{i}"]
    return best


def analysis_date_expr(df: DataFrame, schema: RoleSchema, date_format: str | None = None,
                       probe: DataFrame | None = None):
    """The timestamp each row is analysed at (null when invalid).

    The layout is chosen on ``probe`` (default ``df``): pass the frame before
    de-duplication so choosing it does not run that shuffle a second time.
    """
    dtypes = dict(df.dtypes)
    probe = df if probe is None else probe
    typed = ("timestamp", "timestamp_ntz", "date")
    if schema.date_column:
        d = F.col(schema.date_column)
        typed_date = dtypes[schema.date_column] in typed
        if schema.time_column:
            # of a typed date or time only that part of it is used
            day = d.cast("date").cast("string") if typed_date else strip_ws(d.cast("string"))
            t = F.col(schema.time_column)
            clock = F.date_format(t, "HH:mm:ss.SSSSSS") if dtypes[schema.time_column] in typed else strip_ws(t.cast("string"))
            text = wall_time(F.concat(day, F.lit(" "), clock))
            layouts = [f"{day} {time}" for time in TIME_FORMATS for day in (["yyyy-MM-dd"] if typed_date else _date_only())]
        elif typed_date:
            return parse_timestamp(d)
        else:
            text, layouts = wall_time(strip_ws(d.cast("string"))), DATE_FORMATS
        fmt = date_format or choose_date_format(probe, text, layouts)
        return parse_timestamp(text, fmt) if fmt else F.lit(None).cast("timestamp_ntz")
    if schema.year_column and schema.month_column:
        y = F.coalesce(to_double(F.col(schema.year_column), dtypes[schema.year_column]), F.lit(0.0)).cast("long")
        m = F.coalesce(to_double(F.col(schema.month_column), dtypes[schema.month_column]), F.lit(1.0)).cast("long")
        return parse_timestamp(F.format_string("%d-%d-01", y, m), "yyyy-M-dd")
    return F.lit(None).cast("timestamp_ntz")


def wall_time(text):
    """A date text without the zone that may follow its time of day."""
    return F.when(F.substring(text, -1, 1).isin("Z", "z", "C", "T") | F.substring(text, -6, 6).rlike("[+-]"),
                  F.regexp_replace(text, _ZONED, "$1")).otherwise(text)


def _date_only():
    return [f for f in DATE_FORMATS if ":" not in f]


def clean(raw: DataFrame, schema: RoleSchema, date_format: str | None = None,
          materialize_how: str = "table") -> CleanResult:
    """C1-C14 on a frame whose columns are already normalised."""
    spark: SparkSession = raw.sparkSession
    compiled_projections(spark)
    original_columns = list(raw.columns)
    df = normalize_columns(raw)
    target = schema.target_column
    # Whole-row de-duplication on the values as read (nulls compare equal).
    # Grouping keeps each row's multiplicity, so the input row count comes
    # out of the same pass instead of a separate scan.
    dedup = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("__dup"))

    # Trim text, blank tokens -> null; remember which columns changed.
    dtypes = dict(dedup.dtypes)
    string_cols = [c for c in df.columns if dtypes[c] == "string"]
    proj = []
    changed = []
    for c in df.columns:
        if c in string_cols:
            t = strip_ws(F.col(c))
            changed.append(F.coalesce(has_edge_ws(F.col(c)), F.lit(False)).alias(f"__chg_{c}"))
            proj.append(F.when(t.isin(BLANK_TOKENS), F.lit(None)).otherwise(t).alias(c))
        else:
            proj.append(F.col(c))
    trimmed = dedup.select(*proj, *changed, "__dup")
    flag_cols = [f"__chg_{c}" for c in string_cols] + ["__dup"]

    # C4: numeric coercion of target, sales columns and the extra numeric names.
    numeric = [c for c in dict.fromkeys([target, *schema.sales_columns, *EXTRA_NUMERIC])
               if c and c in trimmed.columns]
    coerced = trimmed.select(*[
        (to_double(F.col(c), dtypes.get(c)) if c in numeric else F.col(c)).alias(c) for c in trimmed.columns])
    data_cols = [c for c in coerced.columns if c not in flag_cols]

    # Analysis date.
    with_date = coerced.withColumn("analysis_date", analysis_date_expr(coerced, schema, date_format, probe=df))

    # Every count the summary needs, in the same pass that writes the table:
    # an Observation collects the aggregates while the rows stream to Parquet.
    date_ok = F.col("analysis_date").isNotNull()
    tgt_ok = F.col(target).isNotNull() if target in with_date.columns else F.lit(True)
    valid = date_ok & tgt_ok
    cols = [c for c in with_date.columns if c not in flag_cols]
    aggs = [F.count(F.lit(1)).alias("__rows"),
            F.count(F.when(~date_ok, 1)).alias("__bad_dates"),
            F.count(F.when(date_ok & ~tgt_ok, 1)).alias("__bad_targets")]
    aggs += [F.count(F.when(valid & F.col(c).isNull(), 1)).alias(f"__null_{c}") for c in cols]
    aggs += [F.max(F.col(f)).alias(f) for f in flag_cols if f != "__dup"]
    aggs.append(F.sum("__dup").alias("__raw_rows"))
    if materialize_how == "table":
        obs = Observation("shelfcast_clean")
        staged = materialize(with_date.observe(obs, *aggs).select(*cols), materialize_how)
        row = obs.get
    else:
        staged = materialize(with_date, materialize_how)
        row = staged.agg(*aggs).first().asDict()
        staged = staged.select(*cols)
    original_rows = row["__raw_rows"] or 0
    trimmed_columns = [c for c in string_cols if row[f"__chg_{c}"]]

    dedup_rows = row["__rows"]
    bad_dates = row["__bad_dates"]
    bad_targets = row["__bad_targets"]
    kept = dedup_rows - bad_dates - bad_targets
    if kept == 0:
        raise ValueError("The uploaded file did not contain enough valid date and target values "
                         "to build a forecasting timeline.")
    cleaned = staged.where(valid)
    missing_before = {c: row[f"__null_{c}"] for c in cols if row[f"__null_{c}"] > 0}

    # Fill values.
    sdt = dict(cleaned.dtypes)
    fill_num, fill_cat, fill_other = {}, {}, {}
    gaps = [c for c in cols if c not in ("analysis_date", target) and c in missing_before]
    number_cols = [c for c in gaps if _is_numeric(cleaned.schema[c].dataType)]
    mode_cols = [c for c in gaps if c not in number_cols]
    for c, med in exact_medians(cleaned, number_cols).items():
        fill_num[c] = 0.0 if med is None else float(med)
    found = modes(cleaned, mode_cols)
    for c in mode_cols:
        if sdt[c] == "string":
            fill_cat[c] = found.get(c, "Unknown") or "Unknown"
        elif c in found:
            fill_other[c] = found[c]
    fills = []
    for c in cols:
        if c in fill_num:
            # a whole-number column with gaps takes a fractional median, so it is widened
            kind = sdt[c] if sdt[c] in ("float", "double") or sdt[c].startswith("decimal") else "double"
            fills.append(F.coalesce(F.col(c).cast(kind), F.lit(fill_num[c]).cast(kind)).alias(c))
        elif c in fill_cat:
            fills.append(F.coalesce(F.col(c), F.lit(fill_cat[c])).alias(c))
        elif c in fill_other:
            fills.append(F.coalesce(F.col(c), F.lit(fill_other[c]).cast(sdt[c])).alias(c))
        else:
            fills.append(F.col(c))
    final = cleaned.select(*fills)
    left = final.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in missing_before]).first()
    missing_after = {c: left[c] for c in missing_before if left[c]}

    stats = {
        "original_rows": int(original_rows),
        "rows_after_cleaning": int(kept),
        "duplicates_removed": int(original_rows - dedup_rows),
        "invalid_dates_removed": int(bad_dates),
        "target_values_removed": int(bad_targets),
        "trimmed_text_columns": trimmed_columns,
        "missing_values_before": {k: int(v) for k, v in missing_before.items()},
        "missing_values_after": {k: int(v) for k, v in missing_after.items()},
        "filled_numeric_columns": {k: round(v, 4) for k, v in fill_num.items()},
        "filled_categorical_columns": {**fill_cat, **{k: str(v) for k, v in fill_other.items()}},
        "original_columns": original_columns,
        "normalized_columns": list(cols),
    }
    stats["cleaning_applied"] = bool(stats["duplicates_removed"] or bad_dates or bad_targets
                                     or fill_num or fill_cat or fill_other or trimmed_columns)
    return CleanResult(final, summary_frame(spark, stats), missing_frame(spark, stats), schema, stats)


SUMMARY_SCHEMA = T.StructType([
    T.StructField("original_rows", T.LongType()),
    T.StructField("rows_after_cleaning", T.LongType()),
    T.StructField("duplicates_removed", T.LongType()),
    T.StructField("invalid_dates_removed", T.LongType()),
    T.StructField("target_values_removed", T.LongType()),
    T.StructField("trimmed_text_columns", T.ArrayType(T.StringType())),
    T.StructField("missing_values_before", T.MapType(T.StringType(), T.LongType())),
    T.StructField("missing_values_after", T.MapType(T.StringType(), T.LongType())),
    T.StructField("filled_numeric_columns", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("filled_categorical_columns", T.MapType(T.StringType(), T.StringType())),
    T.StructField("cleaning_applied", T.BooleanType()),
    T.StructField("original_columns", T.ArrayType(T.StringType())),
    T.StructField("normalized_columns", T.ArrayType(T.StringType())),
])


def summary_frame(spark: SparkSession, stats: dict) -> DataFrame:
    """C14 as a one-row DataFrame."""
    return spark.createDataFrame([tuple(stats[f.name] for f in SUMMARY_SCHEMA.fields)], SUMMARY_SCHEMA)


def missing_frame(spark: SparkSession, stats: dict) -> DataFrame:
    """C11 as rows (stage, column_name, missing); only positive counts."""
    rows = [("before", c, n) for c, n in stats["missing_values_before"].items()]
    rows += [("after", c, n) for c, n in stats["missing_values_after"].items()]
    return spark.createDataFrame(rows, "stage string, column_name string, missing long")


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """S3: drop columns without a single non-null value (one aggregate)."""
    if not df.columns:
        return df
    counts = df.agg(*[F.count(F.col(f"`{c.replace('`', '``')}`")) for c in df.columns]).first()
    return df.select(*[F.col(f"`{c.replace('`', '``')}`") for c, n in zip(df.columns, counts) if n])


def require_rows(df: DataFrame) -> DataFrame:
    """Error on an input without rows or columns."""
    if not df.columns or df.isEmpty():
        raise ValueError("Uploaded file did not contain usable tabular data.")
    return df
