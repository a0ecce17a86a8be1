import math

import numpy as np
import pytest

from tessera.operators import stats as ST


def brute(x, y, frac, anchors):
    k = min(len(x), max(2, math.ceil(frac * len(x))))
    pts = sorted(set(np.quantile(x, [i / (anchors - 1) for i in range(anchors)])))
    fit = []
    for a in pts:
        h = max(np.sort(np.abs(x - a))[k - 1], 1e-12) * 1.0000001
        u = (x - a) / h
        w = np.where(np.abs(u) <= 1, (1 - np.minimum(np.abs(u), 1) ** 3) ** 3, 0)
        s0, s1, s2, t0, t1 = (float((w * v).sum()) for v in (np.ones_like(u), u, u * u, y, y * u))
        den = s0 * s2 - s1 * s1
        fit.append(t0 / s0 if den <= 1e-12 * s0 * max(s2, 1e-300) else (s2 * t0 - s1 * t1) / den)
    return np.interp(x, pts, fit)


@pytest.mark.parametrize("shape", ["even", "skewed", "hot", "whole", "few"])
@pytest.mark.parametrize("cells", [16, 2048])
def test_lowess_equals_all_pairs(spark, shape, cells):
    rng = np.random.default_rng(4)
    x = {"even": np.linspace(-3, 9, 700), "skewed": np.exp(rng.normal(0, 2, 700)) * 1e5, "whole": rng.integers(0, 12, 700) * 1.0,
         "hot": np.where(rng.random(700) < 0.4, 2.5, rng.normal(0, 3, 700)), "few": np.array([1.0, 1.0, 4.0])}[shape]
    y = np.sin(x / (1 + np.abs(x).mean())) * 50 + rng.normal(0, 1, len(x)) + 1000
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double").repartition(3)
    got = {(r["x"], r["y"]): r["lowess"] for r in ST.lowess(df, "x", "y", 0.2, 25, cells).collect()}
    assert len(got) == len(set(zip(x, y)))
    expect = brute(x, y, 0.2, 25)
    assert max(abs(got[float(a), float(b)] - e) for a, b, e in zip(x, y, expect)) < 1e-7


def test_lowess_of_no_rows_and_one_value(spark):
    df = spark.createDataFrame([(2.0, 5.0), (2.0, 7.0)], "x double, y double")
    assert [r["lowess"] for r in ST.lowess(df, "x", "y").collect()] == pytest.approx([6.0, 6.0])
    assert ST.lowess(df.where("false"), "x", "y").count() == 0
