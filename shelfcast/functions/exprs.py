"""Scalar expressions shared by the operators.

Everything here returns a ``Column`` built from ``pyspark.sql.functions`` so
that it stays inside whole-stage codegen.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "NA_TOKENS", "BLANK_TOKENS", "normalize_column_name", "normalize_name_expr",
    "na_to_null", "strip_ws", "has_edge_ws", "WHITESPACE", "to_double", "parse_timestamp", "exact_sum", "round_half_up", "compact_number", "month_start", "fmt2", "float_text",
]

# Strings a CSV reader treats as missing at read time.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

# Strings that become missing after whitespace trimming.
BLANK_TOKENS = ["", "nan", "None"]

# Outside this window a nanosecond timestamp cannot be represented; parsed
# dates there count as invalid.
MIN_TS = "1677-09-21 00:12:44"
MAX_TS = "2262-04-11 23:47:16"


def normalize_column_name(name: str) -> str:
    """Lower-case, runs of characters outside [a-z0-9] become one '_', edges stripped."""
    return re.sub(r"[^a-z0-9]+", "_", str(name).strip().lower()).strip("_")


def normalize_name_expr(c: Column) -> Column:
    """Same rule as :func:`normalize_column_name`, as a Spark expression (for catalogs)."""
    # Python str.strip() removes Unicode whitespace; (?U) makes \s Unicode-aware.
    lowered = F.lower(F.regexp_replace(c, _WS_EDGES, ""))
    return F.regexp_replace(F.regexp_replace(lowered, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def na_to_null(c: Column, tokens=NA_TOKENS) -> Column:
    return F.when(c.isin(list(tokens)), F.lit(None)).otherwise(c)


# The characters Python's str.strip() treats as whitespace.
WHITESPACE = ["\t", "\n", "\x0b", "\x0c", "\r", "\x1c", "\x1d", "\x1e", "\x1f", " ", "\x85", "\xa0",
              "\u1680", "\u2000", "\u2001", "\u2002", "\u2003", "\u2004", "\u2005", "\u2006", "\u2007",
              "\u2008", "\u2009", "\u200a", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000"]


_WS_CLASS = "[" + "".join(f"\\x{{{ord(ch):x}}}" for ch in WHITESPACE) + "]"
_WS_EDGES = f"^{_WS_CLASS}+|{_WS_CLASS}+$"


def has_edge_ws(c: Column) -> Column:
    """True when the text starts or ends with whitespace."""
    return strip_ws(c) != c


def strip_ws(c: Column) -> Column:
    """Strip leading/trailing Unicode whitespace (Spark ``trim`` alone only removes spaces).

    Texts that begin and end with a printable ASCII character are left as they are.
    """
    plain = c.between("!", "\x7f") & F.substring(c, -1, 1).between("!", "\x7f")
    return F.when(plain, c).otherwise(F.trim(c, F.lit("".join(WHITESPACE))))


# What a cast to double may accept, and a little more; of other text the cast raises and drops an
# exception in the JVM, which costs more than all the rest of a row.
_MAYBE_NUMBER = r"(?i)^[\x00-\x20]*[+-]?(?:[0-9]+\.?[0-9]*(?:e[+-]?[0-9]+)?[df]?|\.[0-9]+(?:e[+-]?[0-9]+)?[df]?|0x.*|inf|infinity|nan)[\x00-\x20]*$"


#: Types whose values a cast to double takes over just as the way through their text does.
_TYPED_NUMBERS = ("double", "tinyint", "smallint", "int", "bigint")


def to_double(c: Column, dtype: str | None = None) -> Column:
    """Lenient numeric coercion: unparsable -> null, NaN -> null.

    ``try_cast`` alone accepts Java float suffixes ('1d', '2f'); those are
    rejected here so that only plain decimal/scientific text and inf parse.
    ``dtype``, where known, spares numbers the way through text and its patterns.
    """
    if dtype in _TYPED_NUMBERS:
        v = c.cast("double")
        return F.when(~F.isnan(v), v) if dtype == "double" else v
    s = F.trim(c.cast("string"))
    ok = s.rlike(_MAYBE_NUMBER) & ~s.rlike(r"(?i)^[+-]?[0-9.]+(e[+-]?[0-9]+)?[df]$")
    v = F.when(ok, s.try_cast("double"))
    return F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)


def parse_timestamp(c: Column, fmt: str | None = None) -> Column:
    """String/timestamp -> TIMESTAMP_NTZ; unparsable or out of the ns range -> null."""
    if fmt is None:
        ts = c  # a typed column: no way through text
    else:
        ts = F.try_to_timestamp(c.cast("string"), F.lit(fmt))
    ts = ts.cast("timestamp_ntz")
    in_range = ts.between(F.lit(MIN_TS).cast("timestamp_ntz"), F.lit(MAX_TS).cast("timestamp_ntz"))
    return F.when(in_range, ts)


def month_start(ts: Column) -> Column:
    return F.trunc(ts, "month")


def exact_sum(c: Column) -> Column:
    """A sum that does not depend on the order of the rows, for finite values of usual size.

    Digits up to the twelfth are added as DECIMAL; what a value has beyond them, and values too
    large for it, infinite or NaN, are added as DOUBLE, so nothing is dropped.
    """
    v = c.cast("double")
    part = v.try_cast("decimal(38,12)")
    rest = v - F.coalesce(part.cast("double"), F.lit(0.0))
    return F.when(F.count(v) > 0, F.coalesce(F.try_sum(part).cast("double"), F.lit(0.0)) + F.sum(rest))


def round_half_up(c: Column, digits: int = 2) -> Column:
    """Round through DECIMAL so ties are decided on the decimal value.

    Values from 1e15 on have no digits to round; they, infinities and NaN stay as they are.
    """
    return F.when(F.abs(c) < 1e15, F.round(c.try_cast("decimal(38,10)"), digits).cast("double")).otherwise(c.cast("double"))


def float_text(c: Column, scale: int = 4) -> Column:
    """Positional text of an already-rounded float, like Python's str(): 15000000.0, 12.5, 0.1234.

    (Casting a double to string in Spark switches to 1.5E7 from 1e7 upwards.)
    """
    t = F.regexp_replace(c.try_cast(f"decimal(38,{scale})").cast("string"), "0+$", "")
    return F.coalesce(F.when(t.endswith("."), F.concat(t, F.lit("0"))).otherwise(t), c.cast("string"))


def fmt2(c: Column) -> Column:
    """'%.2f' text, '-' when null/NaN (dashboard metric format)."""
    return F.when(c.isNull() | F.isnan(c), F.lit("-")).otherwise(F.format_string("%.2f", c))


def compact_number(c: Column) -> Column:
    """English compact notation with at most two fraction digits (1.23K, 4.5M, 7B, 1T).

    A value that rounds up to 1000 of its unit moves to the next unit
    (999,999 -> 1M).  What DECIMAL cannot hold (from 1e27 on, infinities, NaN) stays as
    the text of the number.
    """
    a = F.abs(c)
    units = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]

    def fmt(v: Column) -> Column:
        txt = F.round(v.try_cast("decimal(38,10)"), 2).cast("decimal(38,2)").cast("string")
        return F.regexp_replace(txt, r"\.?0+$", "")

    # Pick the unit from the rounded magnitude so that 999.999 -> "1K".
    expr = F.when(a.isNull(), F.lit(None))
    chain = None
    prev_limit = None
    for limit, suffix in units:
        cond = F.round((a / limit).try_cast("decimal(38,10)"), 2) >= 1
        val = F.concat(fmt(c / limit), F.lit(suffix))
        chain = F.when(cond, val) if chain is None else chain.when(cond, val)
        prev_limit = limit
    chain = chain.otherwise(fmt(c))
    return expr.when(a < 1e27, chain).otherwise(c.cast("string"))
