import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.functions import special as S
from tessera.operators import stats as ST
from tessera.operators import timeseries as TS


def test_published_distribution_values():
    assert S.t_two_sided(2.0, 10) == pytest.approx(0.0733880, abs=1e-6)
    assert S.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert S.chi2_sf(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert S.chi2_sf(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert S.f_sf(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert S.f_sf(3.492828, 2, 20) == pytest.approx(0.05, abs=1e-6)
    assert S.norm_ppf(0.975) == pytest.approx(1.959964, abs=1e-6)
    assert S.ptukey(3.577935, 3, 20) == pytest.approx(0.95, abs=2e-3)
    assert S.qtukey(0.95, 4, 10) == pytest.approx(4.327, abs=1e-2)
    n = 10 ** 8
    lam = 1.358099
    assert S.kolmogorov_sf(lam / (math.sqrt(n) + 0.12 + 0.11 / math.sqrt(n)), n) == pytest.approx(0.05, abs=1e-4)


def test_norm_ppf_column(spark):
    from tessera.functions import exprs as X
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.99]
    df = spark.createDataFrame([(p,) for p in ps], "p double")
    got = [r[0] for r in df.select(X.norm_ppf(F.col("p"))).collect()]
    assert got == pytest.approx([S.norm_ppf(p) for p in ps], abs=1e-8)
    cdf = [r[0] for r in df.select(X.norm_cdf(F.col("p") * 3 - 1.5)).collect()]
    assert cdf == pytest.approx([S.norm_cdf(p * 3 - 1.5) for p in ps], abs=2e-7)


def test_ttests_and_anova(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(10, 2, 40), rng.normal(11, 3, 55)
    rows = [("a", float(v)) for v in a] + [("b", float(v)) for v in b]
    df = spark.createDataFrame(rows, "g string, v double")
    r = ST.ttest_ind(df, "v", "g", "a", "b").first()
    se2 = a.var(ddof=1) / 40 + b.var(ddof=1) / 55
    t = (a.mean() - b.mean()) / math.sqrt(se2)
    dof = se2 ** 2 / ((a.var(ddof=1) / 40) ** 2 / 39 + (b.var(ddof=1) / 55) ** 2 / 54)
    assert r["statistic"] == pytest.approx(t) and r["dof"] == pytest.approx(dof)
    assert r["p_value"] == pytest.approx(S.t_two_sided(t, dof))
    f = ST.anova(df, "v", "g").first()
    grand = np.concatenate([a, b]).mean()
    ssb = 40 * (a.mean() - grand) ** 2 + 55 * (b.mean() - grand) ** 2
    ssw = 39 * a.var(ddof=1) + 54 * b.var(ddof=1)
    assert f["statistic"] == pytest.approx(ssb / (ssw / 93))
    # with two groups the ANOVA F equals the pooled t squared
    tp = ST.ttest_ind(df, "v", "g", "a", "b", equal_var=True).first()
    assert f["statistic"] == pytest.approx(tp["statistic"] ** 2)
    assert f["p_value"] == pytest.approx(tp["p_value"], rel=1e-6)


def test_chi2_yates(spark):
    rows = [(0, 0)] * 10 + [(0, 1)] * 20 + [(1, 0)] * 30 + [(1, 1)] * 40
    df = spark.createDataFrame(rows, "a int, b int")
    r = ST.chi2_stats(df, "a", "b").first()
    obs = np.array([[10, 20], [30, 40]], dtype=float)
    exp = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    adj = obs + np.sign(exp - obs) * np.minimum(0.5, np.abs(exp - obs))
    assert r["chi2"] == pytest.approx(((adj - exp) ** 2 / exp).sum())
    assert r["dof"] == 1 and r["cells"] == 4


def test_tukey_and_shapiro(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g, mu in (("x", 0), ("y", 0.2), ("z", 3)) for v in rng.normal(mu, 1, 30)]
    df = spark.createDataFrame(rows, "g string, v double")
    t = {(r["group_a"], r["group_b"]): r for r in ST.tukey_hsd(df, "v", "g").collect()}
    assert t[("x", "z")]["reject"] and not t[("x", "y")]["reject"]
    norm = spark.createDataFrame([(float(v),) for v in rng.normal(0, 1, 300)], "v double")
    expo = spark.createDataFrame([(float(v),) for v in rng.exponential(1, 300)], "v double")
    assert ST.shapiro(norm, "v").first()["p_value"] > 0.01
    w = ST.shapiro(expo, "v").first()
    assert w["p_value"] < 1e-4 and 0.5 < w["statistic"] < 1


def test_correlation_spearman_ties(spark):
    x = [1, 2, 2, 3, 4, 4, 4, 5]
    y = [2, 1, 4, 3, 6, 5, 5, 9]
    df = spark.createDataFrame(list(zip(map(float, x), map(float, y))), "x double, y double")
    got = {(r["column_a"], r["column_b"]): r["correlation"] for r in ST.correlation(df, ["x", "y"], "spearman").collect()}
    expect = pd.Series(x).rank().corr(pd.Series(y).rank())  # average ranks, then Pearson
    assert got[("x", "y")] == pytest.approx(expect)


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(4)
    v = np.round(rng.normal(0, 1, 500), 2)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    h = ST.histogram(df, "v", 12).orderBy("bin").collect()
    counts, edges = np.histogram(v, 12)
    assert [r["count"] for r in h] == counts.tolist()
    assert [r["lower"] for r in h] == pytest.approx(edges[:-1].tolist())


@pytest.mark.parametrize("points", [1, 50, 700])
def test_kde_is_the_direct_sum(spark, points):
    rng = np.random.default_rng(6)
    groups = {"normal": rng.normal(0, 1, 900), "outlier": np.append(rng.normal(5, 1e-3, 60), 1e6), "ties": np.repeat([1.0, 1.0, 4.0], 20),
              "large": 1e12 + rng.exponential(3, 200)}
    rows = [(g, float(x)) for g, v in groups.items() for x in v] + [("flat", 3.0)] * 4 + [("one", 2.0), ("flat", None), (None, 5.0), ("one", float("nan"))]
    got = ST.kde(spark.createDataFrame(rows, "g string, v double").repartition(5), "v", points, by="g").orderBy("g", "x").collect()
    assert len(got) == 6 * points
    for g, v in groups.items():
        h = v.std(ddof=1) * len(v) ** (-1 / 5)
        mine = [r for r in got if r["g"] == g]
        x = np.array([r["x"] for r in mine])
        assert x == pytest.approx(np.linspace(v.min(), v.max(), points), rel=1e-14)
        exact = np.exp(-0.5 * ((x[:, None] - v[None, :]) / h) ** 2).sum(axis=1) / (len(v) * h * math.sqrt(2 * math.pi))
        assert [r["density"] for r in mine] == pytest.approx(exact, abs=(1e-4 if g == "large" else 1e-9) / h)
    assert all(math.isnan(r["density"]) for r in got if r["g"] in ("flat", "one"))


def test_fits(spark):
    rng = np.random.default_rng(8)
    v = rng.gamma(3.0, 2.0, 2000)
    df = spark.createDataFrame([(float(x),) for x in v], "v double")
    g = ST.fit_distribution(df, "v", "gamma").first()
    assert g["params"][0] == pytest.approx(3.0, rel=0.1) and g["params"][1] == pytest.approx(2.0, rel=0.1)
    assert g["p_value"] > 0.01
    n = ST.fit_distribution(df, "v", "normal").first()
    assert n["params"] == pytest.approx([v.mean(), v.std()])
    w = ST.fit_distribution(df, "v", "weibull").first()
    assert w["status"] == "ok" and w["params"][0] > 1
    cmp_ = ST.compare_fits(df, "v", ["normal", "gamma", "exponential"]).where("best").first()
    assert cmp_["distribution"] == "gamma"


def _direct_like(dist, v, p):
    """Log-likelihood summed over the values themselves."""
    if dist == "t":
        nu, mu, s = p
        return (len(v) * (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(s))
                - (nu + 1) / 2 * np.log1p(((v - mu) / s) ** 2 / nu).sum())
    if dist == "weibull":
        return (math.log(p[0] / p[1]) + (p[0] - 1) * np.log(v / p[1]) - (v / p[1]) ** p[0]).sum()
    k, th = p
    return ((k - 1) * np.log(v) - v / th - math.lgamma(k) - k * math.log(th)).sum()


def _fit_samples():
    rng = np.random.default_rng(3)
    cauchy = 1e6 + rng.standard_t(1.0, 1500) * 0.01  # far from zero, heavy tails
    return {"t": [rng.standard_t(4.0, 3000) * 2 + 7, cauchy, np.round(rng.standard_t(3.0, 3000), 1)],
            "weibull": [rng.weibull(1.7, 3000) * 5, 1000 * rng.weibull(60.0, 800), rng.weibull(0.3, 800)],
            "gamma": [rng.gamma(0.7, 9.0, 2000)]}


@pytest.mark.parametrize("dist", ["t", "weibull", "gamma"])
def test_fits_are_at_the_top_of_the_likelihood(spark, dist):
    for v in _fit_samples()[dist]:
        df = spark.createDataFrame([(float(x),) for x in v] + [(None,), (math.nan,)], "v double")
        r = ST.fit_distributions(df, "v", [dist]).first()
        p = list(r["params"])
        top = _direct_like(dist, v, p)
        assert r["loglik"] == pytest.approx(top, rel=1e-10, abs=1e-6)
        for i in range(len(p)):
            for step in (1 - 1e-4, 1 + 1e-4):
                near = [q * step if j == i and not (dist == "t" and i == 1) else q for j, q in enumerate(p)]
                if dist == "t" and i == 1:
                    near[1] = p[1] + (step - 1) * p[2]
                assert _direct_like(dist, v, near) <= top + 1e-9 * abs(top)
        if dist == "weibull":  # the equations hold to rounding on the values themselves
            e, u = (v / v.max()) ** p[0], np.log(v)
            assert (e @ u) / e.sum() - 1 / p[0] - u.mean() == pytest.approx(0, abs=1e-10)


def test_fits_read_the_rows_once(spark):
    v = np.random.default_rng(5).gamma(2.0, 3.0, 4000)
    read = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame([(float(x),) for x in np.round(v, 2) + 0.01], "v double")

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    names = ["normal", "lognormal", "exponential", "uniform", "gamma", "weibull", "beta", "t"]
    whole = ST.fit_distributions(df.mapInArrow(count, "v double"), "v", names).collect()
    assert read.value == 4000 and [r["status"] for r in whole] == ["ok"] * 8
    blocks = ST.fit_distributions(df, "v", names, rows_per_block=100).collect()
    for a, b in zip(whole, blocks):
        assert a["ks"] == pytest.approx(b["ks"], rel=1e-9) and a["params"] == pytest.approx(b["params"], rel=1e-9)


def test_fits_without_data(spark):
    def status(values):
        df = spark.createDataFrame([(x,) for x in values], "v double")
        return {r["distribution"]: r["status"] for r in ST.fit_distributions(
            df, "v", ["normal", "lognormal", "exponential", "uniform", "gamma", "weibull", "beta", "t"]).collect()}
    assert set(status([]).values()) == {"no data"} == set(status([None, math.nan]).values())
    flat = status([3.0] * 5)
    assert flat.pop("exponential") == "ok" and set(flat.values()) == {"constant data"}
    mixed = status([-2.0, -1.0, 0.5, 1.0])
    assert [mixed[d] for d in ("lognormal", "gamma", "weibull")] == ["needs positive data"] * 3
    assert mixed["exponential"] == "needs a positive mean" and mixed["t"] == mixed["beta"] == "ok"


def test_trends_and_lowess(spark):
    x = np.arange(60, dtype=float)
    y = 2.0 + 0.5 * x - 0.01 * x ** 2
    df = spark.createDataFrame([(int(i), float(v)) for i, v in zip(x, y)], "t long, y double")
    poly = {r["power"]: r["coefficient"] for r in ST.trend(df, "y", "t", "polynomial", degree=2).collect()}
    assert [poly[0], poly[1], poly[2]] == pytest.approx([2.0, 0.5, -0.01], abs=1e-8)
    ex = ST.trend(df.withColumn("y", F.exp(F.col("t") * 0.1)), "y", "t", "exponential").first()
    assert ex["b"] == pytest.approx(0.1) and ex["model"] == "exponential"
    lw = ST.lowess(df, "t", "y", frac=0.3, anchors=60).orderBy("t").collect()
    k = int(math.ceil(0.3 * len(x)))

    def brute(x0):  # local linear fit with tricube weights over the k nearest points
        d = np.abs(x - x0)
        h = np.sort(d)[k - 1] * 1.0000001
        w = np.clip(1 - (d / h) ** 3, 0, None) ** 3
        A = np.vstack([np.ones_like(x), x]).T * np.sqrt(w)[:, None]
        beta = np.linalg.lstsq(A, y * np.sqrt(w), rcond=None)[0]
        return beta[0] + beta[1] * x0
    assert [r["lowess"] for r in lw] == pytest.approx([brute(v) for v in x], abs=1e-6)


def test_timeseries(spark):
    rng = np.random.default_rng(9)
    n = 400
    phi = 0.6
    e = rng.normal(0, 1, n)
    ar = np.zeros(n)
    for i in range(1, n):
        ar[i] = phi * ar[i - 1] + e[i]
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(ar)], "t long, y double")
    a = {r["lag"]: r["acf"] for r in TS.acf(df, "y", "t", 5).collect()}
    d = ar - ar.mean()
    assert a[1] == pytest.approx((d[1:] * d[:-1]).sum() / (d * d).sum())
    p = {r["lag"]: r["pacf"] for r in TS.pacf(df, "y", "t", 3).collect()}
    assert p[1] == pytest.approx(phi, abs=0.1) and abs(p[2]) < 0.15
    stat = TS.adf(df, "y", "t").first()
    assert stat["statistic"] < stat["crit_1pct"] and stat["p_value"] < 0.01
    walk = spark.createDataFrame([(i, float(v)) for i, v in enumerate(np.cumsum(e))], "t long, y double")
    assert TS.adf(walk, "y", "t", maxlag=4).first()["p_value"] > 0.05
    season = [(i, float(i * 0.1 + [3, -1, -2, 0][i % 4])) for i in range(40)]
    sd = TS.seasonal_decompose(spark.createDataFrame(season, "t long, y double"), "y", "t", 4).orderBy("index").collect()
    assert [r["seasonal"] for r in sd[:4]] == pytest.approx([3, -1, -2, 0], abs=1e-9)
    assert sd[0]["trend"] is None and sd[2]["trend"] == pytest.approx(0.2)


def _tau_b_brute(x, y):
    c = d = tx = ty = 0
    n = len(x)
    for i in range(n):
        for j in range(i + 1, n):
            sx, sy = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            if sx == 0 and sy == 0:
                continue
            if sx == 0:
                tx += 1
            elif sy == 0:
                ty += 1
            elif sx * sy > 0:
                c += 1
            else:
                d += 1
    return (c - d) / math.sqrt((c + d + tx) * (c + d + ty))


@pytest.mark.parametrize("blocks", [1, 4, 9])
def test_kendall_exact_any_block_count(spark, blocks):
    rng = np.random.default_rng(12)
    x = rng.integers(0, 15, 250).astype(float)
    y = (x * 0.5 + rng.integers(0, 6, 250)).astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    got = ST.kendall_tau(df, "x", "y", blocks=blocks).first()["tau"]
    assert got == pytest.approx(_tau_b_brute(x, y), abs=1e-12)


def test_inversions_brute():
    rng = np.random.default_rng(13)
    for n in (0, 1, 2, 17, 64, 100):
        a = rng.integers(0, 9, n)
        assert S.count_inversions(a) == sum(1 for i in range(n) for j in range(i + 1, n) if a[i] > a[j])


def test_dbscan_matches_brute_force(spark):
    from tessera.operators import ml as ML
    rng = np.random.default_rng(3)
    t = rng.uniform(0, np.pi, 60)
    a = np.c_[np.cos(t), np.sin(t)] + rng.normal(0, 0.05, (60, 2))
    b = np.c_[1 - np.cos(t), 0.5 - np.sin(t)] + rng.normal(0, 0.05, (60, 2))
    X = np.vstack([a, b, rng.uniform(-2, 3, (8, 2)), np.tile([[3.0, 3.0]], (20, 1))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(X)], "id long, x double, y double")
    Z = (X - X.mean(0)) / X.std(0)
    eps, ms = 0.3, 5
    nb = np.sqrt(((Z[:, None] - Z[None]) ** 2).sum(-1)) <= eps
    core = nb.sum(1) >= ms
    lab = -np.ones(len(Z), int)
    cur = 0
    for i in range(len(Z)):
        if core[i] and lab[i] < 0:
            stack, lab[i] = [i], cur
            while stack:
                p = stack.pop()
                for q in np.where(nb[p] & core)[0]:
                    if lab[q] < 0:
                        lab[q] = cur
                        stack.append(q)
            cur += 1
    first = {}
    for i in range(len(Z)):
        if core[i]:
            first.setdefault(lab[i], i)
    raw = [first[lab[i]] if core[i] else min([first[lab[q]] for q in np.where(nb[i] & core)[0]], default=-1)
           for i in range(len(Z))]
    order = sorted({r for r in raw if r >= 0})
    expect = [order.index(r) if r >= 0 else -1 for r in raw]
    got = {r["id"]: r["c"] for r in ML.dbscan(df, ["x", "y"], eps, ms, out="c", key="id").collect()}
    assert [got[i] for i in range(len(Z))] == expect


@pytest.mark.parametrize("dims", [1, 2, 3])
def test_links_of_dense_cells(spark, dims, monkeypatch):
    from tessera.operators import ml as ML
    rng = np.random.default_rng(dims)
    eps = 1.0
    side = eps / math.sqrt(dims)
    reach = math.ceil(math.sqrt(dims)) + 1
    offs = [o for o in itertools.product(range(-reach, reach + 1), repeat=dims)
            if sum(max(abs(v) - 1, 0) ** 2 for v in o) * side * side <= eps * eps]
    z = np.vstack([rng.uniform(0, side * 4, (60, dims)),  # some cells with few points: many pairs near the limit
                   np.repeat(rng.uniform(0, side, (1, dims)), 30, axis=0)])
    if dims == 1:
        z = np.vstack([z, [[10.25], [11.25], [20.0], [21.0 + 1e-15], [30.0], [np.nextafter(31.0, 32)]]])
    if dims == 2:  # an arc just outside the reach of a point and one just inside
        turn = rng.uniform(0, math.pi / 2, (400, 1))
        ring = np.hstack([np.cos(turn), np.sin(turn)])
        z = np.vstack([z, [[40.0, 40.0]], 40 + ring * (1 + 1e-7), [[60.0, 60.0]], 60 + ring * (1 - 1e-7)])
    g = np.floor(z / side).astype(int)
    want = set()
    for i in range(len(z)):
        d2 = np.zeros(len(z))
        for j in range(dims):
            d2 = d2 + (z[i, j] - z[:, j]) ** 2
        want |= {(tuple(map(int, g[i])), tuple(map(int, g[k]))) for k in np.where(d2 <= eps * eps)[0] if tuple(g[i]) < tuple(g[k])}
    gcols, zc = [f"__g{j}" for j in range(dims)], [f"__z{j}" for j in range(dims)]
    df = spark.createDataFrame([(*map(int, a), *map(float, b)) for a, b in zip(g, z)],
                               ", ".join([f"{x} long" for x in gcols] + [f"{x} double" for x in zc]))
    offsets = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offs])
    for finest in (ML._FINEST, 4):
        monkeypatch.setattr(ML, "_FINEST", finest)
        got = [(tuple(r["u"]), tuple(r["v"])) for r in ML._dense_links(df, gcols, zc, side, eps, offsets).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_dbscan_touching_dense_cells(spark):
    from tessera.operators import ml as ML
    # two strips of many points 1.5 apart and a bridge; standardised by the population's mean and deviation
    df = spark.range(60000).select("id", (F.col("id") % 2 * 1.5 + F.rand(1) * 0.2).alias("x"), (F.rand(2) * 0.2).alias("y"))
    sd = df.agg(F.stddev_pop("x")).first()[0]
    two = ML.dbscan(df, ["x", "y"], 0.8, 10, out="c").groupBy((F.col("id") % 2).alias("s"), "c").count().collect()
    assert sd > 0 and sorted((r["s"], r["c"], r["count"]) for r in two) in ([(0, 0, 30000), (1, 1, 30000)], [(0, 1, 30000), (1, 0, 30000)])


@pytest.mark.parametrize("blocks", [1, 4, 9])
def test_kendall_with_hot_values(spark, blocks):
    rng = np.random.default_rng(4)
    x = rng.choice([0.0, 1.0, 2.0, 3.0], 400, p=[0.7, 0.1, 0.1, 0.1])
    y = np.round(x + rng.normal(size=400), 1)
    s = sum(np.sign(x[i] - x[:i]) @ np.sign(y[i] - y[:i]) for i in range(len(x)))
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y)], "x double, y double")
    assert ST.kendall_tau(df, "x", "y", blocks=blocks).first()["s"] == s


@pytest.mark.parametrize("rows_per_block", [30, None])
@pytest.mark.parametrize("maxlag,autolag", [(None, "AIC"), (7, "AIC"), (4, None), (0, None)])
def test_unit_root_regression_over_blocks(spark, rows_per_block, maxlag, autolag):
    rng = np.random.default_rng(12)
    y = np.cumsum(rng.normal(0, 1, 300)) * 0.2 + rng.normal(0, 1, 300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "t long, y double").repartition(4)
    got = TS.adf(df, "y", "t", maxlag, autolag, rows_per_block=rows_per_block).first()
    top = math.ceil(12 * 3 ** 0.25) if maxlag is None else maxlag
    dy = np.diff(y)

    def fit(lags, skip):
        x = np.array([[1.0, y[t - 1], *(dy[t - 1 - k] for k in range(1, lags + 1))] for t in range(skip + 1, len(y))])
        z = dy[skip:]
        beta, ssr = np.linalg.lstsq(x, z, rcond=None)[0], None
        ssr = ((z - x @ beta) ** 2).sum()
        se = math.sqrt(ssr / (len(z) - len(beta)) * np.linalg.inv(x.T @ x)[1, 1])
        return beta[1] / se, len(z) * (math.log(2 * math.pi) + math.log(ssr / len(z)) + 1) + 2 * len(beta), len(z)

    used = min(range(top + 1), key=lambda k: fit(k, top)[1]) if autolag else top
    stat, _, n = fit(used, used)
    assert (got["lags"], got["nobs"]) == (used, n) and got["statistic"] == pytest.approx(stat, rel=1e-9)
