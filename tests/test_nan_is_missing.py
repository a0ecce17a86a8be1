"""Every operator on numbers gives the same on a frame with NaN as on the same frame with null."""

import math

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate as A
from tessera.operators import charts as CH
from tessera.operators import features as FE
from tessera.operators import filters as FL
from tessera.operators import ml as ML
from tessera.operators import numeric as N
from tessera.operators import stats as S
from tessera.operators import timeseries as TS
from tessera.operators import windows as W

OPS = {
    "group_agg": lambda d: A.group_agg(d, "g", "x"), "column_stat": lambda d: A.column_stat(d, ["x", "y"], "mean"),
    "metric": lambda d: A.metric(d, "x", "max"), "top_with_other": lambda d: A.top_with_other(d, "g", "x", 1),
    "pivot_mean": lambda d: A.pivot_mean(d, "g", "h", "x"), "hierarchy": lambda d: A.hierarchy_totals(d, ["g", "h"], "x"),
    "flows": lambda d: A.flows(d, "g", "h", "x", 5), "funnel": lambda d: A.funnel(d, "g", "x"),
    "profile": lambda d: A.category_profile(d, "g", ["x", "y"], 3), "surface": lambda d: A.surface_grid(d, "g", "h", "x"),
    "waterfall": lambda d: A.waterfall(d, "g", "x", 3), "gauge": lambda d: A.gauge(d, "x", 0, 50), "box": lambda d: A.box_stats(d, "x", "g"),
    "group_stats": lambda d: A.group_stats(d.select("i", "g", "x"), "g", "x", ["mean", "max"]).drop("x"),
    "pearson": lambda d: S.correlation(d, ["x", "y"]), "spearman": lambda d: S.correlation(d, ["x", "y"], "spearman"),
    "kendall": lambda d: S.correlation_test(d, "x", "y", "kendall"), "pairs": lambda d: S.correlation_pairs(d, ["x", "y"]),
    "t1": lambda d: S.ttest_1samp(d, "x", 3.0), "t2": lambda d: S.ttest_ind(d, "x", "h", "p", "q"), "tp": lambda d: S.ttest_paired(d, "x", "y"),
    "anova": lambda d: S.anova(d, "x", "g"), "anova_table": lambda d: S.anova_table(d, "x", "g"), "tukey": lambda d: S.tukey_hsd(d, "x", "g"),
    "histogram": lambda d: S.histogram(d, "x", 5), "kde": lambda d: S.kde(d, "x", 20), "qq": lambda d: S.qq(d, "x"),
    "fit": lambda d: S.fit_distribution(d, "x", "normal"), "shapiro": lambda d: S.shapiro(d, "x"),
    "summary": lambda d: S.distribution_summary(d, "x"), "linear": lambda d: S.linear_fit(d, "x", "y"),
    "trend": lambda d: S.trend(d, "x", "i"), "lowess": lambda d: S.lowess(d, "y", "x", 0.5, 5),
    "acf": lambda d: TS.acf(d, "x", "i", 5), "pacf": lambda d: TS.pacf(d, "x", "i", 3), "weekday": lambda d: TS.seasonality(d, "ts", "x"),
    "bar_error": lambda d: CH.bar_with_error(d, "g", "x"), "candlestick": lambda d: CH.candlestick(d, "ts", "x"),
    "ecdf": lambda d: W.ecdf(d, "x"), "monotonic": lambda d: W.is_monotonic(d, "x", "i"),
    "rolling": lambda d: W.rolling(d, "x", 3, ["mean", "median"], "i").select("i", "x_rolling_mean", "x_rolling_median"),
    "standardized": lambda d: FE.standardized(d, ["x"])[0].select("i", "__z0"), "distance": lambda d: FE.distance_to(d, ["x", "y"], out="o").select("i", "o"),
    "box_cox": lambda d: N.box_cox(d, "x", "o").select("i", "o"),
    "lof": lambda d: ML.local_outlier_factor(d, ["x", "y"], 5).select("i", "anomaly_score"),
    **{f"filter {op}": (lambda d, op=op, v=v: FL.filter_rows(d, [("x", op, v)]).select("i")) for op, v in (
        (">", 2), (">=", 2), ("<", 9), ("<=", 9), ("between", (2, 9)), ("is null", None), ("is not null", None), ("!=", 3.0))},
}


@pytest.fixture(scope="module")
def frames(spark):
    rows = [(i, "abc"[i % 3], "pq"[i * i % 5 % 2], float((i * 7) % 11 + 1), float((i * 5) % 13), f"2024-01-{i % 28 + 1:02d} 00:00:00") for i in range(40)]
    df = spark.createDataFrame(rows, "i int, g string, h string, x double, y double, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    hole = F.col("i").isin(0, 7, 8, 30)
    # ten rows lose x; one whole pivot cell, too
    hole = hole | ((F.col("g") == "a") & (F.col("h") == "q"))
    return [df.withColumn("x", F.when(hole, F.lit(v).cast("double")).otherwise(F.col("x"))).coalesce(1).cache() for v in (float("nan"), None)]


def rows_of(df):
    def plain(v):
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 8)
        return str(v)
    found = df.collect()
    assert not any(isinstance(v, float) and math.isnan(v) for r in found for v in r), "NaN in the result"
    return sorted([tuple(plain(v) for v in r) for r in found], key=str)


@pytest.mark.parametrize("name", OPS)
def test_nan_gives_what_null_gives(frames, name):
    with_nan, with_null = (rows_of(OPS[name](d)) for d in frames)
    assert with_nan == with_null and with_nan


def test_decomposition_refuses_missing_values_of_both_kinds(frames):
    for d in frames:
        with pytest.raises(ValueError):
            TS.seasonal_decompose(d, "x", "i", 4)


def test_whole_numbers_of_19_digits_in_a_list(spark):
    df = spark.createDataFrame([(1234567890123456789,), (2 ** 63 - 1,), (5,)], "n long")
    found = FL.filter_rows(df, [("n", "in", "1234567890123456789, 9223372036854775807, 9999999999999999999")])
    assert sorted(r[0] for r in found.collect()) == [1234567890123456789, 2 ** 63 - 1]


def test_box_cox_of_large_values_close_together(spark):
    df = spark.createDataFrame([(1e8 + i % 10,) for i in range(100)], "x double")
    small = spark.createDataFrame([(1.0 + i % 10,) for i in range(100)], "x double")
    assert -5 <= N.boxcox_lambda(df, "x") <= 5 and math.isfinite(N.boxcox_lambda(df, "x"))
    assert 0.5 < N.boxcox_lambda(small, "x") < 1.1
