import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import ml
from tessera.plans import neighbours as N


def cloud(kind, n=1200, seed=2):
    rng = np.random.default_rng(seed)
    if kind == "hot":  # two dense cells, a third of all rows at one point, far outliers
        x = np.concatenate([rng.normal(0, 0.01, (n // 3, 2)), np.tile([[0.5, 0.5]], (n // 3, 1)), rng.normal(5, 2, (n // 3, 2)), [[400, -300]]])
    elif kind == "grid":  # ties everywhere
        x = np.stack(np.meshgrid(np.arange(35.0), np.arange(35.0)), -1).reshape(-1, 2)
    else:
        x = rng.normal(0, 1, (n, 4)) * [1, 100, 0, 1]
        x[:, 3] = rng.integers(0, 2, n)
    return x


def brute_near(points, weights, queries, k):
    """Per query (point, distance, before), points ranked by distance, then coordinates."""
    order = np.lexsort(points.T[::-1])
    points, weights = points[order], weights[order]
    out = []
    for q in queries:
        d2 = np.zeros(len(points))
        for j in range(points.shape[1]):
            d2 += (q[j] - points[:, j]) ** 2
        rank, before, row = np.argsort(d2, kind="stable"), 0, []
        for i in rank:
            if before >= k:
                break
            row.append((tuple(points[i]), float(np.sqrt(d2[i])), before))
            before += weights[i]
        out.append(row)
    return out


@pytest.mark.parametrize("kind", ["hot", "grid", "mixed"])
@pytest.mark.parametrize("cell", [20, 4000])
def test_nearest_points_brute_force(spark, kind, cell, monkeypatch):
    monkeypatch.setattr(N, "VISITS_PER_TASK", 100)
    x = cloud(kind)
    df = spark.createDataFrame([(list(map(float, r)),) for r in x], "p array<double>").repartition(6)
    points = N.distinct_points(df, "p")
    rows = points.collect()
    p, w = np.array([r["p"] for r in rows]), np.array([r["m"] for r in rows])
    assert w.sum() == len(x) and [r["p"] for r in sorted(rows, key=lambda r: r["pid"])] == sorted(r["p"] for r in rows)
    coords = {r["pid"]: tuple(r["p"]) for r in rows}
    got = {}
    for r in N.nearest_points(points, None, 7, cell).collect():
        got.setdefault(r["qid"], []).append((coords[r["pid"]], r["dist"], r["before"]))
    expect = dict(zip(coords, brute_near(p, w, p, 7)))
    assert set(got) == set(expect)
    for q in expect:
        assert sorted(got[q], key=lambda t: t[2]) == expect[q]


def test_nearest_points_small_and_empty(spark):
    df = spark.createDataFrame([([1.0],), ([1.0],), ([3.0],)], "p array<double>")
    got = sorted(map(tuple, N.nearest_points(N.distinct_points(df, "p"), None, 9).select("m", "dist", "before").collect()))
    assert got == [(1, 0.0, 0), (1, 2.0, 1), (2, 0.0, 0), (2, 2.0, 1)] or got == [(1, 0.0, 0), (1, 2.0, 2), (2, 0.0, 0), (2, 2.0, 1)]
    none = N.distinct_points(df.where("false"), "p")
    assert N.nearest_points(none, None, 3).count() == 0


def brute_lof(x, k=20):
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    k = min(k, len(z) - 1)
    order = np.lexsort(z.T[::-1])
    z = z[order]
    d = np.sqrt(((z[:, None, :] - z[None, :, :]) ** 2).sum(-1))
    first = np.argsort(d, axis=1, kind="stable")
    with_self = first[:, :k]
    ex = np.array([[j for j in row if j != i][:k] for i, row in enumerate(first)])
    kd = np.take_along_axis(d, ex, 1)[:, -1]
    lrd = 1 / (np.maximum(np.take_along_axis(d, ex, 1), kd[ex]).mean(axis=1) + 1e-10)
    new = 1 / (np.maximum(np.take_along_axis(d, with_self, 1), kd[with_self]).mean(axis=1) + 1e-10)
    lof = lrd[with_self].mean(axis=1) / new
    out = np.empty(len(x))
    out[order] = lof
    return out


@pytest.mark.parametrize("kind,cell", [("hot", 25), ("mixed", 40), ("mixed", 5000)])
def test_local_outlier_factor_brute_force(spark, kind, cell):
    x = cloud(kind, 450)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "id int, " + ", ".join(f"x{j} double" for j in range(x.shape[1])))
    res = ml.local_outlier_factor(df.repartition(5), [f"x{j}" for j in range(x.shape[1])], scaled=False, out="lof", cell_points=cell)
    got = np.array([r["lof"] + 0.0 for r in res.orderBy("id").collect()])
    assert np.allclose(got, brute_lof(x), rtol=1e-6)
    scaled = ml.local_outlier_factor(df, ["x0", "x1"], cell_points=cell).agg(F.min("anomaly_score"), F.max("anomaly_score")).first()
    assert tuple(scaled) == (0.0, 1.0)


def test_local_outlier_factor_edges(spark):
    df = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.0), (4, 0.0)], "id int, x double")
    assert [r[0] for r in ml.local_outlier_factor(df, ["x"]).select("anomaly_score").collect()] == [-0.5] * 4
    assert ml.local_outlier_factor(df.where("false"), ["x"]).count() == 0
    assert ml.local_outlier_factor(df.where("id = 3"), ["x"]).count() == 1


def test_fill_neighbours_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = [(i, float(rng.integers(0, 30)) if i % 9 else None, ["a", "b", "c", None][rng.integers(0, 4)],
             None if i % 4 == 0 else float(rng.normal())) for i in range(500)] + [(900, 3.0, "unknown", None)]
    df = spark.createDataFrame(rows, "id int, x double, g string, y double")
    levels = sorted({g for _, _, g, y in rows if y is not None and g is not None})[1:]
    space = {i: (x or 0.0, *(float(g == v) for v in levels)) for i, x, g, _ in rows}
    groups = {}
    for i, _, _, y in rows:
        if y is not None:
            groups.setdefault(space[i], []).append(y)
    p = np.array(list(groups))
    near = brute_near(p, np.array([len(groups[tuple(q)]) for q in p]), [space[i] for i, *_ in rows], 5)
    expect = {}
    for (i, _, _, y), found in zip(rows, near):
        take = [(min(len(groups[q]), 5 - b), np.mean(groups[q])) for q, _, b in found]
        expect[i] = y if y is not None else sum(w * v for w, v in take) / sum(w for w, _ in take)
    for cell in (15, 5000):
        got = {r["id"]: r["y"] for r in ml.fill_neighbours(df, "y", ["x", "g"], cell_points=cell).collect()}
        assert got == pytest.approx(expect)
    none = ml.fill_model(df.withColumn("y", F.lit(None).cast("double")), "y", ["x", "g"], "neighbours")
    assert none.where("y is null").count() == len(rows)
    assert ml.fill_model(df, "y", ["x", "g"], "tree").where("y is null").count() == 0
