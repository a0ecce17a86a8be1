"""Preview and profiling (PRF*).

Rule: all scalar metrics of a table come from **one** aggregate pass; the
result is reshaped to a long frame with ``unpivot``.  Exact quantiles use the
distributed selection in ``plans.quantiles`` (one shuffle for all columns).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.common import as_list, c, datetime_columns, nan_as_null, numeric_columns
from tessera.plans.quantiles import quantile_long, quantile_map


# -- PRF1 ---------------------------------------------------------------------------
def preview(df: DataFrame, mode: str = "head", n: int = 5, order_by: Sequence[str] | str | None = None,
            cols: Sequence[str] | None = None, seed: int = 42) -> DataFrame:
    """head / tail / sample of ``n`` rows on chosen columns (order needs a key)."""
    from tessera.operators.sampling import sample_n

    out = df.select(*[c(x) for x in cols]) if cols else df
    keys = as_list(order_by)
    if mode == "head":
        return out.orderBy(*[c(k) for k in keys]).limit(n) if keys else out.limit(n)
    if mode == "tail":
        if not keys:
            raise ValueError("tail needs order_by")
        return out.orderBy(*[c(k).desc() for k in keys]).limit(n).orderBy(*[c(k) for k in keys])
    if mode == "sample":
        return sample_n(out, n, seed=seed)
    raise ValueError(mode)


# -- PRF2 ---------------------------------------------------------------------------
@nan_as_null
def shape_summary(df: DataFrame) -> DataFrame:
    """rows, columns, numeric columns, missing cells, missing % of cells."""
    cols = df.columns
    nnum = len(numeric_columns(df))
    missing = reduce(lambda a, b: a + b, [F.count_if(c(x).isNull()) for x in cols], F.lit(0).cast("long"))
    rows = F.count(F.lit(1))
    return df.agg(rows.alias("rows"), missing.alias("missing_cells")).select(
        "rows", F.lit(len(cols)).cast("long").alias("columns"), F.lit(nnum).cast("long").alias("numeric_columns"),
        "missing_cells",
        (F.try_divide(F.col("missing_cells") * 100.0, F.col("rows") * len(cols))).alias("missing_pct"))


# -- PRF3 ---------------------------------------------------------------------------
@nan_as_null
def column_info(df: DataFrame, approx: bool = False) -> DataFrame:
    """Per column: type, non-null, null, null %, distinct (exact or HLL)."""
    aggs = [F.count(F.lit(1)).alias("__n")]
    for x in df.columns:
        dist = F.approx_count_distinct(c(x)) if approx else F.count_distinct(c(x))
        aggs.append(F.struct(F.lit(x).alias("column_name"),
                             F.lit(df.schema[x].dataType.simpleString()).alias("dtype"),
                             F.count(c(x)).alias("non_null"),
                             F.count_if(c(x).isNull()).alias("nulls"),
                             dist.cast("long").alias("distinct")).alias(x))
    row = df.agg(*aggs)
    long = row.unpivot(["__n"], df.columns, "__c", "s").select("__n", "s.*")
    return long.select("column_name", "dtype", "non_null", "nulls",
                       F.try_divide(F.col("nulls") * 100.0, F.col("__n")).alias("null_pct"), "distinct")


# -- PRF4 / SRC11 -------------------------------------------------------------------
def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, T.NumericType):
        return "numeric"
    if isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "datetime"
    if isinstance(dt, T.StringType):
        return "categorical"
    return "other"


def type_counts(df: DataFrame) -> DataFrame:
    """Count of columns per kind, computed from the schema (no data pass)."""
    spark = df.sparkSession
    rows = [(f.name, kind_of(f.dataType)) for f in df.schema.fields]
    schema = "column_name string, kind string"
    return spark.createDataFrame(rows, schema).groupBy("kind").agg(F.count(F.lit(1)).alias("columns"))


# -- PRF5 ---------------------------------------------------------------------------
def sample_values(df: DataFrame, n: int = 3) -> DataFrame:
    """Type and the first ``n`` non-null values of every column (a take of n rows per column)."""
    spark = df.sparkSession
    parts = [df.where(c(x).isNotNull()).limit(n).agg(F.collect_list(c(x).cast("string")).alias("sample_values"))
             .select(F.lit(x).alias("column_name"), F.lit(df.schema[x].dataType.simpleString()).alias("dtype"),
                     "sample_values") for x in df.columns]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# -- PRF6 / PRF7 / PRF8 / PRF18 -------------------------------------------------------
def corrected_skew(g1, n):
    """pandas/DuckDB bias-corrected skewness from population g1 (n >= 3)."""
    return F.when(n >= 3, g1 * F.sqrt(n * (n - 1)) / (n - 2))


def corrected_kurtosis(g2, n):
    """pandas/DuckDB bias-corrected excess kurtosis from population g2 (n >= 4)."""
    return F.when(n >= 4, ((n + 1) * g2 + 6) * (n - 1) / ((n - 2) * (n - 3)))


def _moments_struct(x: str):
    col = c(x).cast("double")
    n = F.count(col).cast("double")
    return F.struct(
        F.lit(x).alias("column_name"),
        F.count(col).alias("count"),
        F.avg(col).alias("mean"),
        F.stddev_samp(col).alias("std"),
        F.min(col).alias("min"),
        F.max(col).alias("max"),
        F.count_if(col.isNull()).alias("missing"),
        F.skewness(col).alias("skew_pop"),
        F.kurtosis(col).alias("kurt_pop"),
        n.alias("n"),
    ).alias(x)


# Moment aggregates keep ~18 buffer fields per column; whole-stage codegen is
# dropped for an aggregate with more than spark.sql.codegen.maxFields (100)
# fields, so wide tables are summarised in chunks of columns (each chunk reads
# only its own columns) and the results are unioned.
_MOMENT_CHUNK = 4


def _moments_long(df: DataFrame, cols: list[str]) -> DataFrame:
    out = None
    for i in range(0, len(cols), _MOMENT_CHUNK):
        part = cols[i:i + _MOMENT_CHUNK]
        row = df.agg(F.count(F.lit(1)).alias("__rows"), *[_moments_struct(x) for x in part])
        long = row.unpivot(["__rows"], part, "__c", "s").select("__rows", "s.*")
        out = long if out is None else out.unionByName(long)
    return out


@nan_as_null
def summary_statistics(df: DataFrame, cols: Sequence[str] | None = None, biased: bool = False,
                       decimals: int | None = None) -> DataFrame:
    """count, mean, std(n-1), min, 25/50/75 %, max, median, range, missing, missing %,
    skew and kurtosis (bias-corrected like pandas unless ``biased``)."""
    cols = list(cols) if cols else numeric_columns(df)
    # the moments are one small row per column: fetching them gives the group sizes the
    # quantile step needs (no separate counting pass) and keeps the final join tiny
    m_rows = _moments_long(df, cols).collect()
    m = df.sparkSession.createDataFrame(m_rows, _moments_long(df, cols).schema)
    n = F.col("n")
    skew = F.col("skew_pop") if biased else corrected_skew(F.col("skew_pop"), n)
    kurt = F.col("kurt_pop") if biased else corrected_kurtosis(F.col("kurt_pop"), n)
    biggest = max([r["count"] for r in m_rows] or [0])
    qs = (quantile_long(df, cols, [0.25, 0.5, 0.75], max_group_rows=biggest)
          .groupBy(F.col("column").alias("column_name"))
          .agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(a)
                 for p, a in ((0.25, "q25"), (0.5, "q50"), (0.75, "q75"))]))
    out = m.join(qs, "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max",
        F.col("q50").alias("median"), (F.col("max") - F.col("min")).alias("range"), "missing",
        F.try_divide(F.col("missing") * 100.0, F.col("__rows")).alias("missing_pct"),
        skew.alias("skew"), kurt.alias("kurtosis"))
    if decimals is not None:
        out = out.select(*[F.round(c(f.name), decimals).alias(f.name) if isinstance(f.dataType, T.DoubleType)
                           else c(f.name) for f in out.schema.fields])
    return out


def skew_label(skew_col) -> "F.Column":
    """|s| < 0.5 symmetric, else right/left skewed."""
    return (F.when(skew_col.isNull(), F.lit(None))
            .when(F.abs(skew_col) < 0.5, "symmetric")
            .when(skew_col > 0, "right-skewed").otherwise("left-skewed"))


def skew_label_fine(skew_col) -> "F.Column":
    """Five-way label: highly / moderately left, symmetric, moderately / highly right."""
    return (F.when(skew_col.isNull(), F.lit(None))
            .when(skew_col < -1, "highly left-skewed")
            .when(skew_col < -0.5, "moderately left-skewed")
            .when(skew_col <= 0.5, "approximately symmetric")
            .when(skew_col <= 1, "moderately right-skewed")
            .otherwise("highly right-skewed"))


def kurtosis_label(k_col) -> "F.Column":
    """flat (< -0.5) / normal-like / peaked (> 0.5) for excess kurtosis."""
    return (F.when(k_col.isNull(), F.lit(None))
            .when(k_col < -0.5, "platykurtic (flat)")
            .when(k_col > 0.5, "leptokurtic (peaked)")
            .otherwise("mesokurtic (normal-like)"))


@nan_as_null
def shape_statistics(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Population skew and excess kurtosis with labels (PRF7, PRF18)."""
    cols = list(cols) if cols else numeric_columns(df)
    m = _moments_long(df, cols)
    return m.select("column_name", F.col("skew_pop").alias("skewness"), F.col("kurt_pop").alias("kurtosis"),
                    skew_label(F.col("skew_pop")).alias("skew_label"),
                    skew_label_fine(F.col("skew_pop")).alias("skew_detail"),
                    kurtosis_label(F.col("kurt_pop")).alias("kurtosis_label"))


@nan_as_null
def percentiles(df: DataFrame, cols: Sequence[str] | None = None,
                ps: Sequence[float] = (0.25, 0.5, 0.75, 0.95, 0.99)) -> DataFrame:
    """Exact linear-interpolated percentiles, long: (column_name, p, value)."""
    cols = list(cols) if cols else numeric_columns(df)
    return quantile_long(df, cols, ps).select(F.col("column").alias("column_name"), "p", F.col("q").alias("value"))


# -- PRF9 / PRF10 / PRF11 -------------------------------------------------------------
@nan_as_null
def missing_table(df: DataFrame) -> DataFrame:
    """Missing count and % per column, sorted by count desc (then name)."""
    cols = df.columns
    row = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(c(x).isNull()).alias(x) for x in cols])
    long = row.unpivot(["__n"], cols, "column_name", "missing")
    return (long.select("column_name", "missing",
                        F.try_divide(F.col("missing") * 100.0, F.col("__n")).alias("missing_pct"))
            .orderBy(F.col("missing").desc(), "column_name"))


@nan_as_null
def missing_matrix(df: DataFrame, n: int = 100, order_by: Sequence[str] | str | None = None) -> DataFrame:
    """0/1 missingness indicators of the first ``n`` rows by ``order_by``."""
    keys = as_list(order_by)
    out = df.orderBy(*[c(k) for k in keys]).limit(n) if keys else df.limit(n)
    return out.select(*[c(x).isNull().cast("int").alias(x) for x in df.columns])


@nan_as_null
def missing_correlation(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation between null indicators, every pair once (a < b)."""
    cols = list(cols) if cols else df.columns
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")
    ind = {x: c(x).isNull().cast("double") for x in cols}
    row = df.agg(*[F.corr(ind[a], ind[b]).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    stack = [F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"{i}").alias("correlation"))
             for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*stack)).alias("s")).select("s.*")


# -- PRF12 / PRF13 / PRF14 -----------------------------------------------------------
def duplicate_summary(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """rows, duplicate rows (first occurrence not counted), duplicate % (nulls equal)."""
    keys = list(subset) if subset else df.columns
    groups = df.groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("__c"))
    return groups.agg(F.sum("__c").alias("rows"), F.sum(F.col("__c") - 1).alias("duplicates")).select(
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
        F.coalesce("duplicates", F.lit(0)).cast("long").alias("duplicates"),
        F.try_divide(F.col("duplicates") * 100.0, F.col("rows")).alias("duplicate_pct"))


def duplicate_rows(df: DataFrame, subset: Sequence[str] | None = None,
                   order_by: Sequence[str] | str | None = None) -> DataFrame:
    """Rows that repeat an earlier row (pandas ``duplicated(keep='first')``).

    Whole-row duplicates are identical, so no order is needed: each group of
    ``c`` equal rows yields ``c - 1`` copies, computed after a partial
    aggregate (a hot duplicate group never sits in one task).  With a
    ``subset``, the first row per key is the one with the smallest ``order_by``
    value (minimum by aggregate, then an equi-join back).
    """
    keys = list(subset) if subset else df.columns
    if not subset or set(keys) == set(df.columns):
        g = df.groupBy(*[c(k) for k in df.columns]).agg(F.count(F.lit(1)).alias("__c")).where("__c > 1")
        # copies come in chunks, dealt out again: a row with very many copies has many tasks
        chunk = 10_000
        left = F.col("__c") - 1 - F.col("__k") * chunk
        g = g.withColumn("__k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__c") - 2) / chunk))))
        g = g.withColumn("__c", F.least(left, F.lit(chunk))).repartition(F.xxhash64(*[c(k) for k in df.columns], "__k"))
        return g.select(*[c(k) for k in df.columns],
                        F.explode(F.array_repeat(F.lit(0), F.col("__c").cast("int"))).alias("__i")).drop("__i")
    order = as_list(order_by)
    if len(order) != 1:
        raise ValueError("subset duplicates need one unique order_by column")
    o = order[0]
    firsts = df.groupBy(*[c(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min(c(o)).alias("__first"))
    j = df.join(firsts, [c(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], "inner")
    return j.where(c(o) > F.col("__first")).select(*[c(x) for x in df.columns])


def duplicate_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Value combinations appearing more than once, with counts, sorted desc.

    Like pandas ``groupby``, combinations with a null key are left out.
    """
    keys = list(cols) if cols else df.columns
    notnull = reduce(lambda a, b: a & b, [c(k).isNotNull() for k in keys])
    return (df.where(notnull).groupBy(*[c(k) for k in keys]).agg(F.count(F.lit(1)).alias("count"))
            .where("count > 1").orderBy(F.col("count").desc(), *[c(k) for k in keys]))


# -- PRF15 ----------------------------------------------------------------------------
@nan_as_null
def value_counts(df: DataFrame, col: str, n: int = 10) -> DataFrame:
    """Top-``n`` values with count and % of non-null rows, plus distinct and missing.

    Ties on the count are broken by value so the result is deterministic.
    """
    counts = df.groupBy(c(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    tot = counts.agg(F.sum(F.when(F.col("value").isNotNull(), F.col("count"))).alias("__nn"),
                     F.count(F.col("value")).alias("distinct"),
                     F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("count"))), F.lit(0)).alias("missing"))
    top = counts.where(F.col("value").isNotNull()).orderBy(F.col("count").desc(), F.col("value")).limit(n)
    return top.select("value", "count", (F.col("count") * 100.0 / tot.select("__nn").scalar()).alias("pct"),
                      tot.select("distinct").scalar().alias("distinct"),
                      tot.select(F.col("missing").cast("long")).scalar().alias("missing"))


# -- PRF16 ----------------------------------------------------------------------------
@nan_as_null
def outlier_summary(df: DataFrame, cols: Sequence[str] | None = None, k: float = 1.5) -> DataFrame:
    """Per numeric column: Q1, Q3, IQR, bounds, outlier count and % of non-null."""
    cols = list(cols) if cols else numeric_columns(df)
    qm = quantile_map(df, cols, [0.25, 0.75])  # bounded: two numbers per column
    aggs = []
    for x in cols:
        q1, q3 = qm[x]
        if q1 is None:
            lo = hi = None
        else:
            lo, hi = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        v = c(x).cast("double")
        flag = (v < F.lit(lo)) | (v > F.lit(hi)) if lo is not None else F.lit(False)
        aggs.append(F.struct(F.lit(x).alias("column_name"), F.lit(q1).cast("double").alias("q1"),
                             F.lit(q3).cast("double").alias("q3"),
                             F.lit(None if q1 is None else q3 - q1).cast("double").alias("iqr"),
                             F.lit(lo).cast("double").alias("lower_bound"), F.lit(hi).cast("double").alias("upper_bound"),
                             F.count_if(flag).alias("outliers"), F.count(v).alias("__nn")).alias(x))
    row = df.agg(*aggs)
    long = row.unpivot([], cols, "__c", "s").select("s.*")
    return long.select("column_name", "q1", "q3", "iqr", "lower_bound", "upper_bound", "outliers",
                       F.try_divide(F.col("outliers") * 100.0, F.col("__nn")).alias("outlier_pct"))


# -- PRF17 ----------------------------------------------------------------------------
def datetime_profile(df: DataFrame, col: str) -> DataFrame:
    """min, max, span in days, most common year / month name / weekday with count, %.

    Ties for "most common" go to the smallest value.  Each part is a one-row
    aggregate combined through scalar subqueries (no joins).
    """
    base = df.select(c(col).alias("__t")).where(F.col("__t").isNotNull())
    stats = base.agg(F.min("__t").alias("min"), F.max("__t").alias("max"), F.count(F.lit(1)).alias("__n"))

    def top(expr):
        g = base.groupBy(expr.alias("v")).agg(F.count(F.lit(1)).alias("cnt"))
        return g.agg(F.min(F.struct((-F.col("cnt")).alias("nc"), F.col("v").cast("string").alias("v"))).alias("m"))

    parts = {"year": F.year("__t"), "month": F.date_format("__t", "MMMM"), "weekday": F.date_format("__t", "EEEE")}
    cols = []
    for name, expr in parts.items():
        m = top(expr)
        cols += [m.select(F.col("m.v")).scalar().alias(f"top_{name}"),
                 m.select(-F.col("m.nc")).scalar().alias(f"top_{name}_count")]
    out = stats.select("*", *cols)
    span = F.timestamp_diff("SECOND", F.col("min"), F.col("max")) / 86400.0
    return out.select(F.lit(col).alias("column_name"), "min", "max", span.alias("span_days"),
                      "top_year", "top_year_count", (F.col("top_year_count") * 100.0 / F.col("__n")).alias("top_year_pct"),
                      "top_month", "top_month_count", (F.col("top_month_count") * 100.0 / F.col("__n")).alias("top_month_pct"),
                      "top_weekday", "top_weekday_count",
                      (F.col("top_weekday_count") * 100.0 / F.col("__n")).alias("top_weekday_pct"))
