"""Least squares per series in column expressions: normal equations from an array, solved by elimination.

A matrix is a flat array in row order; a series is one row, and its array is as long as it has months.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def window_equations(values: Column, w: Column, ridge: float) -> Column:
    """Normal equations [A | b] of y_t = c_1 y_(t-w) + ... + c_w y_(t-1) + c_0 over all windows of ``values``.

    A is the Gram matrix of the w lags and a constant, with ``ridge`` added to the lags' diagonal,
    so it can be solved also where a series has fewer windows than unknowns.
    """
    width = w + 2
    ends = F.sequence(w, F.size(values) - 1)

    def term(t: Column, i: Column) -> Column:
        return F.when(i == w, F.lit(1.0)).otherwise(F.get(values, F.when(i < w, t - w + i).otherwise(t)))

    def cell(c: Column) -> Column:
        i, j = F.floor(c / width).cast("int"), c % width
        total = F.aggregate(ends, F.lit(0.0), lambda s, t: s + term(t, i) * term(t, j))
        return F.when((i == j) & (i < w), total + F.lit(ridge)).otherwise(total)

    return F.transform(F.sequence(F.lit(0), (w + 1) * width - 1), cell)


def solve(matrix: Column, n: Column) -> Column:
    """The solution of n equations [A | b] with a positive definite A, by Gauss-Jordan elimination."""
    width = n + 1

    def eliminate(m: Column, k: Column) -> Column:
        def cell(v: Column, c: Column) -> Column:
            i, j = F.floor(c / width).cast("int"), c % width
            scaled = F.get(m, k * width + j) / F.get(m, k * width + k)
            return F.when(i == k, scaled).otherwise(v - F.get(m, i * width + k) * scaled)
        return F.transform(m, cell)

    done = F.aggregate(F.sequence(F.lit(0), n - 1), matrix, eliminate)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.get(done, i * width - 1))


def feed_back(values: Column, coefficients: Column, w: Column, steps: Column) -> Column:
    """``values`` and ``steps`` more, each predicted from the w before it."""

    def step(acc: Column, _: Column) -> Column:
        dot = F.aggregate(F.sequence(F.lit(0), w - 1), F.get(coefficients, w),
                          lambda s, i: s + F.get(coefficients, i) * F.get(acc, F.size(acc) - w + i))
        return F.array_append(acc, dot)

    return F.aggregate(F.sequence(F.lit(1), steps), values, step)
