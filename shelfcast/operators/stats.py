"""Exact order statistics of many columns at once, without gathering a column into one task.

``exact_medians`` takes a bracket around the median ranks of every column from one
``percentile_approx`` aggregate (rank error <= n/accuracy), and counts the values of all
brackets in one grouped pass; the value at a rank is then found by running counts over
blocks of a bracket and inside the one block that holds the rank.  Equal values collapse
in the map-side count, so a value holding a third of all rows is one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfcast.session import materialize

_ACCURACY = 100_000
#: Blocks into which a bracket is cut; no task sorts more than one block of one column.
_BLOCKS = 1024


def _value(col: str):
    v = F.col(f"`{col}`").cast("double")
    return F.when(~F.isnan(v), v)


def _blocks(lo: float, hi: float, v):
    """A non-decreasing map of the values of a bracket to 0 .. _BLOCKS - 1."""
    share = F.nanvl((v - F.lit(lo)) / F.lit((hi - lo) or 1.0), F.lit(0.0))
    return F.least(F.lit(_BLOCKS - 1), F.greatest(F.lit(0), F.floor(F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)) * _BLOCKS))).cast("int")


def _ranks(n: int) -> list[int]:
    return [(n + 1) // 2] if n % 2 else [n // 2, n // 2 + 1]


def _found(df: DataFrame, sizes: dict, brackets: dict) -> dict:
    """{column: values at its median ranks} for the columns whose bracket holds them."""
    cells = []
    for c, (lo, hi) in brackets.items():
        v = _value(c)
        inside = v.between(F.lit(lo), F.lit(hi))
        # values below the bracket count as one row without a value; those above it are not needed
        cell = F.struct(F.lit(c).alias("c"), F.when(inside, _blocks(lo, hi, v)).otherwise(F.lit(-1)).alias("block"), F.when(inside, v).alias("v"))
        cells.append(F.when(v <= F.lit(hi), cell))
    counted = materialize(df.select(F.explode(F.array(*cells)).alias("x")).where("x IS NOT NULL")
                          .groupBy("x.c", "x.block", "x.v").agg(F.count(F.lit(1)).alias("n")), "table")
    wanted = F.create_map(*[x for c in brackets for x in (F.lit(c), F.array(*map(F.lit, _ranks(sizes[c]))))])[F.col("c")]
    before = Window.partitionBy("c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (counted.groupBy("c", "block").agg(F.sum("n").alias("m"))
              .withColumn("before", F.coalesce(F.sum("m").over(before), F.lit(0))).withColumn("rank", F.explode(wanted))
              .where("block >= 0 AND rank > before AND rank <= before + m").select("c", "block", "rank", "before"))
    inside = Window.partitionBy("c", "block", "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = (counted.join(blocks, ["c", "block"]).withColumn("upto", F.col("before") + F.sum("n").over(inside))
            .where("rank <= upto AND rank > upto - n").select("c", "rank", "v").collect())
    got = {}
    for r in sorted(rows, key=lambda r: r["rank"]):
        got.setdefault(r["c"], []).append(r["v"])
    return {c: v for c, v in got.items() if len(v) == len(_ranks(sizes[c]))}


def exact_medians(df: DataFrame, cols: list[str]) -> dict:
    """{column: exact (interpolating) median of its non-null values, None where it has none}: three jobs."""
    if not cols:
        return {}
    eps = 2.0 / _ACCURACY
    marks = F.array(F.lit(max(0.0, 0.5 - eps)), F.lit(0.5 + eps))
    row = df.agg(*[F.count(_value(c)).alias(f"n{i}") for i, c in enumerate(cols)],
                 *[F.percentile_approx(_value(c), marks, _ACCURACY).alias(f"b{i}") for i, c in enumerate(cols)]).first()
    sizes = {c: row[f"n{i}"] for i, c in enumerate(cols)}
    out = {c: None for c in cols}
    brackets = {c: tuple(row[f"b{i}"]) for i, c in enumerate(cols) if sizes[c]}
    while brackets:
        for c, v in _found(df, sizes, brackets).items():
            out[c] = v[0] if len(v) == 1 else (v[0] + v[1]) / 2.0
            del brackets[c]
        # beyond the error bound, or for ranks at its edge: everything is the bracket
        brackets = {c: (float("-inf"), float("inf")) for c in brackets}
    return out


def exact_median(df: DataFrame, col: str) -> float | None:
    """Exact (interpolating) median of the non-null values; None when there are none."""
    return exact_medians(df, [col])[col]


def modes(df: DataFrame, cols: list[str]) -> dict:
    """Most frequent non-null value per column, ties -> smallest value (as text).

    One shuffle for all columns: unpivot to (column, value), count, reduce.
    """
    if not cols:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
    counted = (df.select(F.inline(pairs)).where(F.col("v").isNotNull())
               .groupBy("c", "v").count())
    best = counted.groupBy("c").agg(F.min_by("v", F.struct(-F.col("count"), F.col("v"))).alias("mode"))
    return {r["c"]: r["mode"] for r in best.collect()}
