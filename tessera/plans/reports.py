"""Reports (PRF19-23) as long frames ``(section, column_name, metric, value)``.

Every section is built from the profiling operators (one aggregate each) and
unioned; nothing is collected except the bounded lists that choose columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.common import numeric_columns, string_columns
from tessera.operators import profile as P

SCHEMA = "section string, column_name string, metric string, value string"


def _long(df: DataFrame, section: str, key: str | None, cols: Sequence[str]) -> DataFrame:
    keycol = F.col(key).cast("string") if key else F.lit(None).cast("string")
    items = [F.struct(F.lit(x).alias("metric"), F.col(f"`{x}`").cast("string").alias("value")) for x in cols]
    return df.select(F.lit(section).alias("section"), keycol.alias("column_name"),
                     F.explode(F.array(*items)).alias("s")).select("section", "column_name", "s.metric", "s.value")


def dataset_section(df: DataFrame) -> DataFrame:
    s = P.shape_summary(df)
    return _long(s, "dataset", None, ["rows", "columns", "numeric_columns", "missing_cells", "missing_pct"])


def columns_section(df: DataFrame, approx: bool = True) -> DataFrame:
    s = P.column_info(df, approx=approx)
    return _long(s, "columns", "column_name", ["dtype", "non_null", "nulls", "null_pct", "distinct"])


def numeric_section(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols) if cols else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], SCHEMA)
    s = P.summary_statistics(df, cols, decimals=3)
    return _long(s, "numeric", "column_name", ["count", "mean", "std", "min", "q25", "median", "q75", "max", "skew",
                                               "kurtosis"])


def categorical_section(df: DataFrame, cols: Sequence[str] | None = None, top: int = 10) -> DataFrame:
    cols = list(cols) if cols is not None else string_columns(df)
    out = df.sparkSession.createDataFrame([], SCHEMA)
    for x in cols:
        vc = P.value_counts(df, x, top)
        out = out.unionByName(vc.select(F.lit("categorical").alias("section"), F.lit(x).alias("column_name"),
                                        F.concat(F.lit("top:"), F.col("value").cast("string")).alias("metric"),
                                        F.col("count").cast("string").alias("value")))
    return out


def missing_section(df: DataFrame) -> DataFrame:
    m = P.missing_table(df)
    return _long(m, "missing", "column_name", ["missing", "missing_pct"])


SECTIONS = {"dataset": dataset_section, "columns": columns_section, "numeric": numeric_section,
            "categorical": categorical_section, "missing": missing_section}


def summary_report(df: DataFrame, sections: Sequence[str] = ("dataset", "columns", "numeric", "categorical", "missing")
                   ) -> DataFrame:
    out = df.sparkSession.createDataFrame([], SCHEMA)
    for s in sections:
        out = out.unionByName(SECTIONS[s](df))
    return out


def custom_report(df: DataFrame, sections: Sequence[str], options: dict | None = None) -> DataFrame:
    """Chosen sections with options: ``numeric_cols``, ``categorical_cols``, ``top``."""
    o = options or {}
    out = df.sparkSession.createDataFrame([], SCHEMA)
    for s in sections:
        if s == "numeric":
            part = numeric_section(df, o.get("numeric_cols"))
        elif s == "categorical":
            part = categorical_section(df, o.get("categorical_cols"), o.get("top", 10))
        elif s == "correlation":
            part = correlation_section(df, o.get("numeric_cols"), o.get("corr_threshold", 0.7))
        elif s == "outliers":
            part = outlier_section(df, o.get("numeric_cols"))
        else:
            part = SECTIONS[s](df)
        out = out.unionByName(part)
    return out


def correlation_section(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.7) -> DataFrame:
    from tessera.operators.stats import correlation_pairs
    cols = list(cols) if cols else numeric_columns(df)
    if len(cols) < 2:
        return df.sparkSession.createDataFrame([], SCHEMA)
    p = correlation_pairs(df, cols, "pearson", threshold)
    return p.select(F.lit("correlation").alias("section"), F.concat_ws(" ~ ", "column_a", "column_b").alias("column_name"),
                    F.lit("r").alias("metric"), F.round("correlation", 3).cast("string").alias("value"))


def outlier_section(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols) if cols else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], SCHEMA)
    o = P.outlier_summary(df, cols)
    return _long(o, "outliers", "column_name", ["q1", "q3", "iqr", "lower_bound", "upper_bound", "outliers", "outlier_pct"])


_DEPTH = {"basic": 3, "standard": 10, "comprehensive": None}


def eda_report(df: DataFrame, depth: str = "standard", max_categories: int = 10, corr_threshold: float = 0.7
               ) -> DataFrame:
    """Exploratory report; depth limits the columns per kind (basic 3, standard 10, comprehensive all)."""
    lim = _DEPTH[depth]
    nums = numeric_columns(df)[:lim] if lim else numeric_columns(df)
    cats = string_columns(df)[:lim] if lim else string_columns(df)
    parts = [dataset_section(df), missing_section(df), numeric_section(df, nums),
             categorical_section(df, cats, max_categories), correlation_section(df, nums, corr_threshold),
             outlier_section(df, nums)]
    if depth != "basic":
        parts.append(insights(df, nums, cats))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def insights(df: DataFrame, nums: Sequence[str] | None = None, cats: Sequence[str] | None = None) -> DataFrame:
    """Rule insights: >5% outliers, |r| >= 0.7 pairs, top-3 missing columns, high cardinality (> 20 distinct)."""
    nums = list(nums) if nums is not None else numeric_columns(df)
    cats = list(cats) if cats is not None else string_columns(df)
    spark = df.sparkSession
    out = spark.createDataFrame([], SCHEMA)
    if nums:
        o = P.outlier_summary(df, nums).where(F.col("outlier_pct") > 5)
        out = out.unionByName(o.select(F.lit("insight").alias("section"), "column_name",
                                       F.lit("many_outliers").alias("metric"),
                                       F.round("outlier_pct", 2).cast("string").alias("value")))
    if len(nums) >= 2:
        from tessera.operators.stats import correlation_pairs
        p = correlation_pairs(df, nums, "pearson", 0.7)
        out = out.unionByName(p.select(F.lit("insight").alias("section"),
                                       F.concat_ws(" ~ ", "column_a", "column_b").alias("column_name"),
                                       F.lit("strong_correlation").alias("metric"),
                                       F.round("correlation", 3).cast("string").alias("value")))
    m = P.missing_table(df).where(F.col("missing") > 0).limit(3)
    out = out.unionByName(m.select(F.lit("insight").alias("section"), "column_name", F.lit("top_missing").alias("metric"),
                                   F.col("missing").cast("string").alias("value")))
    if cats:
        ci = P.column_info(df.select(*[F.col(f"`{x}`") for x in cats]), approx=False).where(F.col("distinct") > 20)
        out = out.unionByName(ci.select(F.lit("insight").alias("section"), "column_name",
                                        F.lit("high_cardinality").alias("metric"), F.col("distinct").cast("string").alias("value")))
    return out


def digest(df: DataFrame, n_numeric: int = 3, n_categorical: int = 3) -> DataFrame:
    """Compact digest: shape, kind counts, stats of the first numeric columns, top values of the first text columns."""
    kinds = P.type_counts(df).select(F.lit("kinds").alias("section"), F.col("kind").alias("column_name"),
                                     F.lit("columns").alias("metric"), F.col("columns").cast("string").alias("value"))
    return (dataset_section(df).unionByName(kinds)
            .unionByName(numeric_section(df, numeric_columns(df)[:n_numeric]))
            .unionByName(categorical_section(df, string_columns(df)[:n_categorical], 5)))
