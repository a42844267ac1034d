"""Column-level cleaning expressions (all native, codegen-friendly).

Missing means null, NaN or ±inf: Spark keeps NaN and infinities as values,
so every statistic first folds them to null. Text is converted with
``try_cast`` so a bad value becomes null instead of failing an ANSI job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INF = float("inf")


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def fold_invalid(col: str | Column) -> Column:
    """NaN and ±inf → null; other values unchanged (double result)."""
    c = _c(col).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(INF)), F.lit(None).cast("double")).otherwise(c)


def to_numeric(col: str | Column, strip_commas: bool = True) -> Column:
    """Text or number → double. Trims, optionally strips thousands commas;
    unparseable text, NaN and ±inf become null."""
    s = F.trim(_c(col).cast("string"))
    if strip_commas:
        s = F.regexp_replace(s, ",", "")
    return fold_invalid(s.try_cast("double"))


def numeric_of(df: DataFrame, col: str) -> Column:
    """Numeric view of a column whatever its type: numbers fold invalid values,
    text goes through ``to_numeric`` without comma stripping (as a plain
    numeric coercion does)."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.NumericType):
        return fold_invalid(col)
    if isinstance(dt, T.BooleanType):
        return F.col(col).cast("double")
    return to_numeric(col, strip_commas=False)


def clean_time(col: str | Column, min_year: int = 1900, max_year: int = 2100) -> Column:
    """Timestamp (parsed from text if needed); years outside the range → null."""
    c = _c(col)
    t = F.coalesce(c.try_cast("timestamp"), F.try_to_timestamp(c.cast("string")))
    return F.when(F.year(t).between(min_year, max_year), t)


def clean_time_of(df: DataFrame, col: str, min_year: int = 1900, max_year: int = 2100) -> Column:
    """As ``clean_time`` but keeps a timestamp_ntz / timestamp column's type."""
    dt = df.schema[col].dataType
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        t = F.col(col)
        return F.when(F.year(t).between(min_year, max_year), t)
    return clean_time(col, min_year, max_year)


def normalize_text(col: str | Column) -> Column:
    """Text key for membership tests: trim, collapse whitespace, lower case.
    Null stays null."""
    return F.lower(F.regexp_replace(F.trim(_c(col).cast("string")), r"\s+", " "))


def normalize_values(values) -> list[str]:
    """The same normalisation for a Python list of chosen values."""
    import re
    return sorted({re.sub(r"\s+", " ", str(v).strip()).lower() for v in (values or [])})


def value_filter(c: Column, drop_neg: bool = False, drop_zero: bool = False) -> Column:
    cond = c.isNotNull()
    if drop_neg:
        cond = cond & (c >= 0)
    if drop_zero:
        cond = cond & (c != 0)
    return cond


def clean_values(df: DataFrame, col: str, drop_neg: bool = False, drop_zero: bool = False,
                 log10: bool = False, out: str = "v") -> DataFrame:
    """One measure: optional >=0 and !=0 filters, then log10 of the positive
    values. Adds ``out``; rows that fail are removed."""
    v = numeric_of(df, col)
    cond = value_filter(v, drop_neg, drop_zero)
    if log10:
        cond = cond & (v > 0)
        v = F.log10(v)
    return df.where(cond).withColumn(out, v)


def clean_pair_expr(x: Column, y: Column, drop_neg: bool = False, drop_zero: bool = False,
                    log10: bool = False) -> tuple[Column, Column, Column]:
    """Pair cleaning as expressions: (ok, x', y'). Both values must pass."""
    ok = value_filter(x, drop_neg, drop_zero) & value_filter(y, drop_neg, drop_zero)
    if log10:
        ok = ok & (x > 0) & (y > 0)
        x, y = F.log10(x), F.log10(y)
    return ok, x, y
