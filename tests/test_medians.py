import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import windows as W
from tessera.plans import medians as M

values = st.lists(st.one_of(st.just(float("nan")), st.integers(-4, 4).map(float)), max_size=40)


@settings(max_examples=300, deadline=None)
@given(values, st.integers(1, 6))
def test_sliding_medians_equal_pandas(x, n):
    got = M.sliding_medians(np.array(x, float), n)
    assert np.allclose(got, pd.Series(x, dtype=float).rolling(n).median().to_numpy(), equal_nan=True)


@settings(max_examples=400, deadline=None)
@given(values, st.lists(st.integers(-4, 4).map(float), max_size=60), st.integers(0, 3))
def test_prefix_medians_need_only_the_middle(x, earlier, more):
    x, earlier = np.array(x, float), np.sort(np.array(earlier, float))
    c, m = int((~np.isnan(x)).sum()), len(earlier)
    low, high = max(0, (m - c) // 2 - 2 - more), min(m, (m + c) // 2 + 3 + more)
    got = M.prefix_medians(x, earlier[low:high], low, m)
    expect = pd.Series(np.concatenate((earlier, x)), dtype=float).expanding().median().to_numpy()[m:]
    assert np.allclose(got, expect, equal_nan=True)


@pytest.mark.parametrize("shape", ["rising", "falling", "hot", "noise"])
def test_expanding_median_of_one_long_series(spark, shape, monkeypatch):
    monkeypatch.setattr(M, "BLOCKS_PER_TASK", 2)
    rng = np.random.default_rng(1)
    n = 600
    x = {"rising": np.arange(n) * 1.5, "falling": -np.arange(n) * 1.0, "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 9, n)),
         "noise": rng.normal(0, 1, n)}[shape]
    x[::17] = np.nan
    df = spark.createDataFrame([(i, None if i % 34 == 0 else float(v)) for i, v in enumerate(x)], "i int, x double").repartition(4)
    expect = pd.Series(x).expanding().median().to_numpy()
    for size in (40, None):
        got = W.expanding_median(df, "x", "i", out="m", rows_per_block=size).orderBy("i").toPandas()["m"].to_numpy(float)
        assert np.allclose(got, expect, equal_nan=True)


def test_medians_of_empty_and_missing(spark):
    df = spark.createDataFrame([(i, None) for i in range(9)], "i int, x double")
    assert W.expanding_median(df, "x", "i", out="m", rows_per_block=3).where("m is not null").count() == 0
    assert W.expanding_median(df.where("false"), "x", "i", rows_per_block=3).count() == 0
    out = W.rolling(df.withColumn("x", F.col("i") * 1.0), "x", 3, ["median", "mean"], "i", rows_per_block=4)
    assert out.columns == ["i", "x", "x_rolling_median", "x_rolling_mean"]
    assert out.where("x_rolling_median is distinct from x_rolling_mean").count() == 0
