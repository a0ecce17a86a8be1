"""Row filters (FLT*).  Every predicate is a native Column expression, so it
reaches the Parquet scan as a pushed filter where the source allows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.common import c, is_datetime, is_numeric


def _lit_for(df: DataFrame, col: str, v) -> Column:
    """The value in the column's own type, so the comparison is exact and can be pushed down."""
    dt = df.schema[col].dataType
    if isinstance(dt, T.DecimalType):
        return F.lit(Decimal(str(v)))
    if isinstance(dt, T.IntegralType):
        number = Decimal(str(v))
        if number == number.to_integral_value() and abs(number) < 2 ** 63:
            whole = F.lit(int(number))
            return whole.cast(dt) if abs(number) < _LIMIT[type(dt)] else whole.cast("long")
        return F.lit(number if abs(number) < Decimal(10) ** 28 else float(v))
    if is_numeric(dt):
        return F.lit(float(v))
    if is_datetime(dt):
        return F.lit(v).cast("timestamp_ntz") if isinstance(dt, T.TimestampNTZType) else F.lit(v).cast(dt)
    return F.lit(str(v))


_LIMIT = {T.ByteType: 2 ** 7, T.ShortType: 2 ** 15, T.IntegerType: 2 ** 31, T.LongType: 2 ** 63}


def predicate(df: DataFrame, col: str, op: str, value=None) -> Column:
    """One condition of a filter.  ``!=`` keeps nulls (pandas); the others are null for
    null, which a filter drops: no wrapping, so the scan gets them as pushed filters."""
    x = c(col)
    op = op.lower()
    if op == "==":
        return x == _lit_for(df, col, value)
    if op == "!=":
        return ~x.eqNullSafe(_lit_for(df, col, value))
    floating = isinstance(df.schema[col].dataType, (T.FloatType, T.DoubleType))  # NaN is missing, though Spark ranks it above all
    if op in (">", ">=", "<", "<="):
        v = _lit_for(df, col, value)
        found = {">": x > v, ">=": x >= v, "<": x < v, "<=": x <= v}[op]
        return found & ~F.isnan(x) if floating and op in (">", ">=") else found
    if op == "between":
        lo, hi = value
        return x.between(_lit_for(df, col, lo), _lit_for(df, col, hi))
    if op in ("is null", "is_null"):
        return x.isNull() | F.isnan(x) if floating else x.isNull()
    if op in ("is not null", "not_null"):
        return x.isNotNull() & ~F.isnan(x) if floating else x.isNotNull()
    if op == "contains":
        return x.cast("string").rlike(str(value))
    if op in ("starts with", "startswith"):
        return x.cast("string").startswith(str(value))
    if op in ("ends with", "endswith"):
        return x.cast("string").endswith(str(value))
    if op == "in":
        vals = [v.strip() for v in str(value).split(",")]
        if isinstance(df.schema[col].dataType, T.IntegralType):  # a whole number is matched by its plain spelling only
            whole = [int(v) for v in vals if re.fullmatch(r"0|-?[1-9][0-9]{0,18}", v)]
            return x.isin([v for v in whole if -2 ** 63 <= v < 2 ** 63])
        return x.cast("string").isin(vals)
    raise ValueError(op)


def filter_rows(df: DataFrame, conditions: Sequence[tuple], combine: str = "AND") -> DataFrame:
    """Conditions ``(col, op, value)`` combined with AND or OR (the user's choice is honoured)."""
    preds = [predicate(df, *cond) for cond in conditions]
    if not preds:
        return df
    joined = reduce((lambda a, b: a & b) if combine.upper() == "AND" else (lambda a, b: a | b), preds)
    return df.where(joined)


def apply_filters(df: DataFrame, specs: Sequence[dict]) -> DataFrame:
    """Dashboard filter list applied in sequence; a missing column or empty value is skipped.

    ``{"column", "type": range|multiselect|date_range|text, "value"}``.
    """
    for spec in specs:
        col, kind, v = spec.get("column"), spec.get("type", "text"), spec.get("value")
        if col not in df.columns or v is None or (isinstance(v, (list, tuple, str)) and len(v) == 0):
            continue
        x = c(col)
        if kind == "range":
            df = df.where(x.between(F.lit(v[0]), F.lit(v[1])))
        elif kind == "multiselect":
            df = df.where(x.isin(list(v)))
        elif kind == "date_range":
            d = F.to_date(x)
            df = df.where((d >= F.to_date(F.lit(str(v[0])))) & (d <= F.to_date(F.lit(str(v[1])))))
        else:
            df = df.where(F.coalesce(F.lower(x.cast("string")).contains(str(v).lower()), F.lit(False)))
    return df


def filter_expr(df: DataFrame, expr: str) -> DataFrame:
    """SQL expression filter, e.g. ``"value > 100"``."""
    return df.where(F.expr(expr))


def top_values(df: DataFrame, col: str, n: int) -> DataFrame:
    """The ``n`` most frequent non-null values (ties by value) - at most n rows."""
    return (df.where(c(col).isNotNull()).groupBy(c(col).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
            .orderBy(F.col("__n").desc(), F.col("__v")).limit(n).select(F.col("__v")))


def keep_top(df: DataFrame, col: str, n: int) -> DataFrame:
    """Rows whose category is among the top ``n`` (left semi join; the key list has n rows)."""
    top = top_values(df, col, n)
    return df.join(F.broadcast(top), c(col) == F.col("__v"), "left_semi")
