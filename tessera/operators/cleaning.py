"""Cleaning (CLN*): missing values, duplicates, outliers, type conversion.

Statistics that parameterise a row-wise rewrite (mean, median, mode, bounds)
are one-row aggregates injected as scalar subqueries: Spark computes them
once, then the rewrite is a narrow projection with no join and no collect.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.common import as_list, c, is_numeric, nan_as_null, numeric_columns
from tessera.plans import ordered as O
from tessera.plans.quantiles import exact_quantiles


# -- CLN1 ------------------------------------------------------------------------------
@nan_as_null
def drop_missing(df: DataFrame, cols: Sequence[str] | str | None = None) -> DataFrame:
    """Drop rows with a null in any of ``cols`` (all columns when None)."""
    cols = as_list(cols) or df.columns
    return df.na.drop(how="any", subset=cols)


# -- CLN2-5 ----------------------------------------------------------------------------
def _fill(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({k: F.coalesce(c(k), v) for k, v in values.items()})


@nan_as_null
def fill_mean(df: DataFrame, cols: Sequence[str] | str | None = None) -> DataFrame:
    """Nulls -> column mean (numeric columns only)."""
    cols = [x for x in (as_list(cols) or numeric_columns(df)) if is_numeric(df.schema[x].dataType)]
    if not cols:
        return df
    stats = df.agg(*[F.avg(c(x)).alias(x) for x in cols])
    return _fill(df, {x: stats.select(c(x)).scalar() for x in cols})


def median_scalar(df: DataFrame, col: str) -> Column:
    """Exact median of ``col`` as a scalar-subquery column."""
    return exact_quantiles(df, col, [0.5]).select("q").scalar()


def quantile_scalar(df: DataFrame, col: str, p: float) -> Column:
    return exact_quantiles(df, col, [p]).select("q").scalar()


@nan_as_null
def fill_median(df: DataFrame, cols: Sequence[str] | str | None = None) -> DataFrame:
    """Nulls -> exact median (numeric columns only)."""
    cols = [x for x in (as_list(cols) or numeric_columns(df)) if is_numeric(df.schema[x].dataType)]
    return _fill(df, {x: median_scalar(df, x) for x in cols})


def mode_scalar(df: DataFrame, col: str) -> Column:
    """Most frequent non-null value; ties -> smallest value (pandas ``mode()[0]``).

    Counts come from a grouped aggregate (partial aggregation per task), so a
    high-cardinality column never builds one value map in a single task.
    """
    counts = df.where(c(col).isNotNull()).groupBy(c(col).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.min(F.struct((-F.col("n")).alias("nn"), F.col("v").alias("v"))).alias("m")) \
        .select("m.v").scalar()


@nan_as_null
def fill_mode(df: DataFrame, cols: Sequence[str] | str | None = None) -> DataFrame:
    cols = as_list(cols) or df.columns
    return _fill(df, {x: mode_scalar(df, x) for x in cols})


def parse_constant(value, dt: T.DataType):
    """Text constant parsed to the column type (numeric -> float)."""
    if isinstance(dt, T.NumericType):
        return F.lit(float(value)).cast("double") if not isinstance(value, (int, float)) else F.lit(float(value))
    if isinstance(dt, T.BooleanType):
        return F.lit(str(value).strip().lower() in ("true", "1", "yes", "y", "t"))
    return F.lit(value).cast(dt)


@nan_as_null
def fill_constant(df: DataFrame, cols: Sequence[str] | str, value) -> DataFrame:
    cols = as_list(cols)
    return _fill(df, {x: parse_constant(value, df.schema[x].dataType) for x in cols})


# -- CLN6-8 (ordered; see plans.ordered) ------------------------------------------------
@nan_as_null
def fill_forward(df, cols, order_by, partition_by=None, **kw):
    return O.fill_forward(df, as_list(cols), order_by, partition_by, **kw)


@nan_as_null
def fill_backward(df, cols, order_by, partition_by=None, **kw):
    return O.fill_backward(df, as_list(cols), order_by, partition_by, **kw)


@nan_as_null
def fill_linear(df, cols, order_by, partition_by=None, **kw):
    return O.interpolate_linear(df, as_list(cols), order_by, partition_by, **kw)


# -- CLN10 ---------------------------------------------------------------------------
def drop_duplicates(df: DataFrame, subset: Sequence[str] | None = None, keep: str | bool = "first",
                    order_by: str | None = None) -> DataFrame:
    """pandas ``drop_duplicates(subset, keep)``.

    Whole-row duplicates: ``dropDuplicates`` (identical rows: first = last).
    With a subset, first/last is decided by ``order_by`` through a grouped
    min/max and an equi-join back (no window over a possibly hot key);
    ``keep=False`` keeps keys that occur exactly once.
    """
    keys = list(subset) if subset else df.columns
    full = set(keys) == set(df.columns)
    if keep is False or keep == "none":
        g = df.groupBy(*[c(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("__n")) \
            .where("__n = 1").drop("__n")
        return df.join(g, [c(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "left_semi")
    if full:
        return df.dropDuplicates()
    if order_by is None:
        raise ValueError("keep first/last on a subset needs a unique order_by column")
    pick = F.min if keep == "first" else F.max
    g = df.groupBy(*[c(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(pick(c(order_by)).alias("__o"))
    cond = [c(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [c(order_by) == F.col("__o")]
    return df.join(g, cond, "left_semi")


# -- CLN11-13: outlier bounds -----------------------------------------------------------
@nan_as_null
def outlier_bounds(df: DataFrame, col: str, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """One-row frame (lower, upper) for the method:

    * ``iqr``: Q1 - k IQR, Q3 + k IQR (k default 1.5)
    * ``zscore``: mean -/+ t std (n-1) (t default 3)
    * ``modified_z``: median -/+ t MAD / 0.6745 (t default 3.5); MAD = 0 falls back to IQR 1.5
    """
    x = c(col).cast("double")
    if method == "iqr":
        k = 1.5 if threshold is None else threshold
        q = exact_quantiles(df, col, [0.25, 0.75])
        return q.agg(F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
                     F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3")) \
            .select((F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower"),
                    (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper"))
    if method == "zscore":
        t = 3.0 if threshold is None else threshold
        return df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s")) \
            .select((F.col("m") - t * F.col("s")).alias("lower"), (F.col("m") + t * F.col("s")).alias("upper"))
    if method == "modified_z":
        t = 3.5 if threshold is None else threshold
        med = median_scalar(df, col)
        dev = df.select(F.abs(x - med).alias("__d"))
        mad = median_scalar(dev, "__d")
        iqr = outlier_bounds(df, col, "iqr", 1.5)
        one = df.sparkSession.range(1)
        return one.select(
            F.when(mad == 0, iqr.select("lower").scalar()).otherwise(med - t * mad / 0.6745).alias("lower"),
            F.when(mad == 0, iqr.select("upper").scalar()).otherwise(med + t * mad / 0.6745).alias("upper"))
    raise ValueError(method)


@nan_as_null
def outlier_flag(df: DataFrame, col: str, method: str = "iqr", threshold: float | None = None,
                 out: str | None = None) -> DataFrame:
    """Adds a boolean outlier flag (null values are not outliers)."""
    b = outlier_bounds(df, col, method, threshold)
    lo, hi = b.select("lower").scalar(), b.select("upper").scalar()
    x = c(col).cast("double")
    return df.withColumn(out or f"{col}_outlier", F.coalesce((x < lo) | (x > hi), F.lit(False)))


@nan_as_null
def outlier_rows(df: DataFrame, col: str, method: str = "iqr", threshold: float | None = None) -> DataFrame:
    """FLT16: rows flagged as outliers."""
    return outlier_flag(df, col, method, threshold, "__f").where("__f").drop("__f")


# -- CLN14-19: outlier actions --------------------------------------------------------------
@nan_as_null
def handle_outliers(df: DataFrame, col: str, method: str = "iqr", threshold: float | None = None,
                    action: str = "remove", keep_nulls: bool = True, cap_to: str = "bounds") -> DataFrame:
    """Apply an action to outliers of ``col``.

    remove | cap | null | median | mean (of non-outliers) | log.
    ``keep_nulls=False`` reproduces the ``between`` filter that drops null rows.
    ``cap_to='inliers'`` caps to the min/max of non-outliers instead of the bounds.
    """
    b = outlier_bounds(df, col, method, threshold)
    lo, hi = b.select("lower").scalar(), b.select("upper").scalar()
    x = c(col).cast("double")
    is_out = (x < lo) | (x > hi)
    if action == "remove":
        keep = x.between(lo, hi)
        return df.where(keep | x.isNull()) if keep_nulls else df.where(keep)
    if action == "cap":
        if cap_to == "inliers":
            inl = df.where(x.between(lo, hi)).agg(F.min(x).alias("a"), F.max(x).alias("b"))
            lo, hi = inl.select("a").scalar(), inl.select("b").scalar()
        return df.withColumn(col, F.when(x.isNull(), x).otherwise(F.least(F.greatest(x, lo), hi)))
    if action == "null":
        return df.withColumn(col, F.when(is_out, F.lit(None).cast("double")).otherwise(x))
    if action == "median":
        return df.withColumn(col, F.when(is_out, median_scalar(df, col)).otherwise(x))
    if action == "mean":
        m = df.where(x.between(lo, hi)).agg(F.avg(x)).scalar()
        return df.withColumn(col, F.when(is_out, m).otherwise(x))
    if action == "log":
        from tessera.operators.numeric import log_transform
        return log_transform(df, col)
    raise ValueError(action)


# -- CLN20 -------------------------------------------------------------------------------
# fixed values: text accepted as boolean true / false
TRUE_TEXT = ["true", "True", "TRUE", "1", "yes", "Yes", "YES"]
FALSE_TEXT = ["false", "False", "FALSE", "0", "no", "No", "NO"]


def to_boolean(col: Column) -> Column:
    s = col.cast("string")
    return F.when(s.isin(TRUE_TEXT), F.lit(True)).when(s.isin(FALSE_TEXT), F.lit(False))


def convert_type(df: DataFrame, col: str, to: str, fmt: str | None = None, out: str | None = None) -> DataFrame:
    """int | float | string | category | datetime | boolean | timedelta; bad values -> null."""
    x = c(col)
    if to == "int":
        e = x.cast("string").try_cast("double").try_cast("bigint") \
            if not is_numeric(df.schema[col].dataType) else x.try_cast("bigint")
    elif to == "float":
        e = x.cast("string").try_cast("double") if not is_numeric(df.schema[col].dataType) else x.cast("double")
    elif to in ("string", "category"):
        e = x.cast("string")
    elif to == "datetime":
        from tessera.operators.dates import parse_datetime_expr
        e = parse_datetime_expr(x, fmt)
    elif to == "boolean":
        e = x.cast("boolean") if isinstance(df.schema[col].dataType, (T.BooleanType, T.NumericType)) else to_boolean(x)
    elif to == "timedelta":
        if is_numeric(df.schema[col].dataType):
            e = F.make_dt_interval(secs=x.cast("decimal(38,6)"))
        else:
            e = x.cast("string").try_cast("interval day to second")
    else:
        raise ValueError(to)
    return df.withColumn(out or col, e)
