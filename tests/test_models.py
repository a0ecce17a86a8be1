import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import special as S
from tessera.operators import features as FE
from tessera.operators import ml as ML
from tessera.operators import numeric as N
from tessera.operators import stats as ST


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(21)
    base = rng.normal(0, 1, (300, 2))
    X = np.c_[base[:, 0], base[:, 0] * 2 + base[:, 1] * 0.3, base[:, 1] - base[:, 0] * 0.5]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(X)], "id long, a double, b double, c double")
    rows, ev = FE.pca(df, ["a", "b", "c"], 2)
    Z = (X - X.mean(0)) / X.std(0)
    vals, vecs = np.linalg.eigh(np.cov(Z, rowvar=False))
    order = np.argsort(vals)[::-1]
    ratio = vals[order] / vals.sum()
    got = [r["explained_variance_ratio"] for r in ev.orderBy("component").collect()]
    assert got == pytest.approx(ratio[:2].tolist())
    v1 = vecs[:, order[0]]
    v1 = v1 if v1[np.argmax(np.abs(v1))] > 0 else -v1
    pc1 = [r["PC1"] for r in rows.orderBy("id").collect()]
    assert pc1 == pytest.approx((Z @ v1).tolist(), abs=1e-9)


def test_boxcox_lambda_matches_grid(spark):
    rng = np.random.default_rng(22)
    v = rng.lognormal(1.0, 0.4, 500)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    lam = N.boxcox_lambda(df, "v")

    def llf(l):
        y = np.log(v) if abs(l) < 1e-12 else (v ** l - 1) / l
        return (l - 1) * np.log(v).sum() - len(v) / 2 * np.log(y.var())
    grid = np.linspace(-2, 2, 40001)
    best = grid[np.argmax([llf(l) for l in grid])]
    assert lam == pytest.approx(best, abs=2e-3)


def test_isolation_forest_flags_far_points(spark):
    rng = np.random.default_rng(23)
    X = np.vstack([rng.normal(0, 1, (500, 2)), [[12, 12], [-11, 13], [14, -12]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "id long, a double, b double")
    out = {r["id"]: (r["anomaly"], r["anomaly_score"]) for r in ML.isolation_forest(df, ["a", "b"], key="id").collect()}
    assert all(out[i][0] == 1 for i in (500, 501, 502))
    assert sum(v[0] for v in out.values()) < 60
    assert min(out[i][1] for i in (500, 501, 502)) > max(out[i][1] for i in range(500)) - 0.05


def test_fill_model_linear_recovers_relation(spark):
    rows = [(i, float(i), None if i % 5 == 0 else 3.0 * i + 2.0, "a" if i % 2 else "b") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, x double, y double, g string")
    out = ML.fill_model(df, "y", ["x", "g"], "linear").orderBy("id").collect()
    assert [r["y"] for r in out] == pytest.approx([3.0 * i + 2.0 for i in range(60)], abs=1e-6)
    tree = ML.fill_model(df, "y", ["x"], "tree").where("id = 10").first()["y"]
    assert tree == pytest.approx(32.0, abs=15)


def test_kmeans_and_hierarchy_separate_blobs(spark):
    rng = np.random.default_rng(24)
    X = np.vstack([rng.normal(0, 0.2, (50, 2)), rng.normal(5, 0.2, (50, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(X)], "id long, a double, b double")
    for algo in ("kmeans", "hierarchical"):
        lab = {r["id"]: r[f"{algo}_cluster"] for r in ML.cluster(df, ["a", "b"], algo, k=2).collect()}
        assert len({lab[i] for i in range(50)}) == 1 and len({lab[i] for i in range(50, 100)}) == 1
        assert lab[0] != lab[99]


def test_qq_normal_theoretical_quantiles(spark):
    rng = np.random.default_rng(25)
    v = rng.normal(3, 2, 101)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    q = ST.qq(df, "v", "normal").orderBy("p").collect()
    ps = np.linspace(0.01, 0.99, 101)
    theo = [v.mean() + v.std(ddof=1) * S.norm_ppf(p) for p in ps]
    assert [r["theoretical"] for r in q] == pytest.approx(theo, abs=1e-7)
    assert [r["sample"] for r in q] == pytest.approx(sorted(v))


def test_distance_and_formula(spark):
    df = spark.createDataFrame([(1, 3.0, 4.0), (2, None, 0.0)], "id long, a double, b double")
    d = FE.distance_to(df, ["a", "b"], "euclidean", {"a": 0.0, "b": 0.0}, "e").orderBy("id").collect()
    assert [r["e"] for r in d] == [5.0, 0.0]
    c = FE.distance_to(df, ["a", "b"], "cosine", {"a": 1.0, "b": 0.0}, "c").orderBy("id").collect()
    assert c[0]["c"] == pytest.approx(0.4) and c[1]["c"] == 1.0
    f = FE.formula(df, "np.where(b > mean(b), np.sqrt(b), 0)", "f").orderBy("id").collect()
    assert [r["f"] for r in f] == [2.0, 0.0]
    with pytest.raises(ValueError):
        FE.formula(df, "system('x')", "f")


def test_isolation_forest_is_the_same_at_any_partitioning(spark):
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (600, 2)))] + [(900 + i, 3.0, 3.0) for i in range(300)] + [(2000, 40.0, -40.0)]
    df = spark.createDataFrame(rows, "id int, x double, y double")
    for key in ("id", None):
        one, two = ({r["id"]: r["anomaly_score"] for r in ML.isolation_forest(d, ["x", "y"], trees=20, sample_size=64, key=key).collect()}
                    for d in (df.coalesce(1), df.repartition(7, "x")))
        assert one == pytest.approx(two) and max(one, key=one.get) == 2000
        assert len({one[900 + i] for i in range(300)}) == 1
    assert ML.isolation_forest(df.where("false"), ["x", "y"], key="id").count() == 0
