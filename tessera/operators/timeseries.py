"""Time-series analysis (STA22-27): decomposition, ACF/PACF, ADF, seasonality tables.

Lags come from the halo windows of ``plans.ordered``; all products and sums
needed by ACF / ADF are computed in one aggregate, then the small linear
algebra runs on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import special as S
from tessera.functions.common import as_list, c, nan_as_null
from tessera.plans import ordered as O

_I = "__i"


@nan_as_null
def seasonal_decompose(df: DataFrame, value: str, order_by, period: int, model: str = "additive", **kw) -> DataFrame:
    """Classical decomposition (centred moving average trend, mean seasonal pattern).

    Output: index, observed, trend, seasonal, resid.  Nulls and n < 2 * period are rejected.
    """
    x = c(value).cast("double")
    base = df.select(*[c(o) for o in as_list(order_by)], x.alias("observed"))
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("observed").isNull()).alias("nulls")).first()
    if stats["nulls"]:
        raise ValueError("seasonal decomposition needs a series without nulls")
    if stats["n"] < 2 * period:
        raise ValueError(f"need at least {2 * period} observations")
    h = period // 2
    width = 2 * h + 1
    d, w = O.with_halo(base, order_by, None, width, **kw)
    obs = F.col("observed")
    frame = w.rowsBetween(-(width - 1), 0)
    if period % 2 == 0:
        s = F.sum(obs).over(frame) - 0.5 * (F.lag(obs, width - 1).over(w) + obs)
    else:
        s = F.sum(obs).over(frame)
    full = F.count(obs).over(frame) == width
    tr = O.drop_halo(d.withColumn("__trend", F.when(full, s / period)).withColumn("__j", F.col(_I)))
    # the trailing window ending at j is centred on j - h
    trend = tr.select((F.col("__j") - h).alias("index"), F.col("__trend").alias("trend")).where(F.col("index") >= 0)
    idx = O.row_index(base, order_by, None, "index", **kw).select("index", "observed")
    j = idx.join(trend, "index", "left")
    detr = (F.col("observed") - F.col("trend")) if model == "additive" else (F.col("observed") / F.col("trend"))
    j = j.withColumn("__det", detr).withColumn("__pos", F.col("index") % period)
    means = j.groupBy("__pos").agg(F.avg("__det").alias("__sm"))
    centre = means.agg(F.avg("__sm")).scalar()
    adj = (F.col("__sm") - centre) if model == "additive" else (F.col("__sm") / centre)
    means = means.select("__pos", adj.alias("seasonal"))
    out = j.join(F.broadcast(means), "__pos")  # one row per position of the period
    resid = (F.col("__det") - F.col("seasonal")) if model == "additive" else (F.col("__det") / F.col("seasonal"))
    return out.select("index", "observed", "trend", "seasonal", resid.alias("resid"))


@nan_as_null
def component_summary(dec: DataFrame) -> DataFrame:
    """mean / std / min / max of each decomposition component."""
    parts = ["observed", "trend", "seasonal", "resid"]
    row = dec.agg(*[F.struct(F.lit(p).alias("component"), F.avg(p).alias("mean"), F.stddev_samp(p).alias("std"),
                             F.min(p).alias("min"), F.max(p).alias("max")).alias(p) for p in parts])
    return row.unpivot([], parts, "__c", "s").select("s.*")


@nan_as_null
def acf(df: DataFrame, value: str, order_by, lags: int = 50, **kw) -> DataFrame:
    """Autocorrelation for lags 0..L (statsmodels ``acf``, not adjusted) with the +/-1.96/sqrt(n) band."""
    x = c(value).cast("double")
    base = df.select(*[c(o) for o in as_list(order_by)], x.alias("__x")).where(F.col("__x").isNotNull())
    n_mean = base.agg(F.count(F.lit(1)).alias("n"), F.avg("__x").alias("m"))
    m = n_mean.select("m").scalar()
    d, w = O.with_halo(base, order_by, None, lags + 1, **kw)
    dev = F.col("__x") - m
    d = d.withColumns({f"__l{k}": F.lag(dev, k).over(w) for k in range(1, lags + 1)}).withColumn("__dev", dev)
    d = O.drop_halo(d)
    row = d.agg(F.sum(F.col("__dev") * F.col("__dev")).alias("c0"),
                *[F.sum(F.col("__dev") * F.col(f"__l{k}")).alias(f"c{k}") for k in range(1, lags + 1)])
    items = [F.struct(F.lit(k).alias("lag"), (F.col(f"c{k}") / F.col("c0")).alias("acf")) for k in range(0, lags + 1)]
    n = n_mean.select("n").scalar()
    return row.select(F.explode(F.array(*items)).alias("s")).select(
        "s.lag", "s.acf", (1.96 / F.sqrt(n.cast("double"))).alias("bound"))


@nan_as_null
def pacf(df: DataFrame, value: str, order_by, lags: int = 20, **kw) -> DataFrame:
    """Partial autocorrelation by Durbin-Levinson on adjusted autocovariances (Yule-Walker, 'ywadjusted')."""
    x = c(value).cast("double")
    base = df.select(*[c(o) for o in as_list(order_by)], x.alias("__x")).where(F.col("__x").isNotNull())
    st = base.agg(F.count(F.lit(1)).alias("n"), F.avg("__x").alias("m")).first()
    n, m = st["n"], st["m"]
    d, w = O.with_halo(base, order_by, None, lags + 1, **kw)
    dev = F.col("__x") - m
    d = O.drop_halo(d.withColumns({f"__l{k}": F.lag(dev, k).over(w) for k in range(1, lags + 1)}).withColumn("__dev", dev))
    r = d.agg(*[F.sum(F.col("__dev") * (F.col(f"__l{k}") if k else F.col("__dev"))).alias(f"c{k}")
                for k in range(0, lags + 1)]).first()
    gamma = np.array([r[f"c{k}"] / (n - k) for k in range(lags + 1)])
    rho = gamma / gamma[0]
    out = [1.0]
    phi_prev = np.array([])
    for k in range(1, lags + 1):
        if k == 1:
            phi_kk = rho[1]
            phi = np.array([phi_kk])
        else:
            num = rho[k] - np.dot(phi_prev, rho[1:k][::-1])
            den = 1 - np.dot(phi_prev, rho[1:k])
            phi_kk = num / den
            phi = np.concatenate([phi_prev - phi_kk * phi_prev[::-1], [phi_kk]])
        out.append(float(phi_kk))
        phi_prev = phi
    bound = 1.96 / math.sqrt(n)
    return df.sparkSession.createDataFrame([(k, v, bound) for k, v in enumerate(out)], "lag int, pacf double, bound double")


def _lag_products(base: DataFrame, value: str, order_by, lags: int, **kw) -> tuple[int, np.ndarray, np.ndarray]:
    """(n, G, first values): G = X'X over rows t > ``lags`` of [1, y_(t-1), dy_(t-1) .. dy_(t-lags), dy_t], and y_0 .. y_lags.

    One pass: a block with its halo is an array whose lagged differences are
    views of it, multiplied a bounded slice at a time; no lag column is made.
    """
    import pandas as pd
    p = lags + 3
    full, _ = O.with_halo(base, order_by, None, lags + 2, **kw)

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        y = pdf["y"].to_numpy(dtype="float64")
        dy = np.diff(y)
        g, n = np.zeros((p, p)), max(0, len(dy) - lags)
        step = max(1, (1 << 22) // p)
        for q in range(0, n, step):
            m = min(step, n - q)
            runs = np.lib.stride_tricks.sliding_window_view(dy[q:q + m + lags], lags + 1)  # ends at dy_t
            x = np.column_stack([np.ones(m), y[q + lags:q + lags + m], runs[:, :-1][:, ::-1], runs[:, -1]])
            g += x.T @ x
        ii, jj = np.triu_indices(p)
        out = pd.DataFrame({"i": ii, "j": jj, "v": g[ii, jj], "n": n})
        if pdf["__i"].iloc[0] == 0:
            first = y[:lags + 1]
            out = pd.concat([out, pd.DataFrame({"i": -1, "j": np.arange(len(first)), "v": first, "n": 0})])
        return out

    rows = (full.select("__b2", "__i", c(value).cast("double").alias("y")).groupBy("__b2")
            .applyInPandas(products, "i int, j int, v double, n long")
            .groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect())  # (lags + 3)^2 / 2 rows
    G, n = np.zeros((p, p)), 0
    first = sorted((r["j"], r["v"]) for r in rows if r["i"] < 0)
    for r in rows:
        if r["i"] >= 0:
            G[r["i"], r["j"]] = G[r["j"], r["i"]] = r["v"]
            n = r["n"]
    return int(n), G, np.array([v for _, v in first])


@nan_as_null
def adf(df: DataFrame, value: str, order_by, maxlag: int | None = None, autolag: str | None = "AIC",
        diff: int = 0, **kw) -> DataFrame:
    """Augmented Dickey-Fuller with a constant (statsmodels ``adfuller`` defaults).

    The cross-product matrix of [1, y_(t-1), dy_(t-1..maxlag)] and dy_t is
    summed in one pass over blocks; lag selection by AIC and the final OLS run
    on that small matrix, to which the rows that fewer lags leave at the
    beginning are added.  ``diff`` differences the series first.
    """
    x = c(value).cast("double")
    base = df.select(*[c(o) for o in as_list(order_by)], x.alias("__y")).where(F.col("__y").isNotNull())
    if diff:
        from tessera.operators.windows import difference
        for _ in range(diff):
            base = difference(base, "__y", 1, False, order_by, out="__y2", **kw).drop("__y") \
                .withColumnRenamed("__y2", "__y").where(F.col("__y").isNotNull())
    nobs = base.count()
    if maxlag is None:
        maxlag = int(math.ceil(12.0 * (nobs / 100.0) ** 0.25))
        maxlag = min(nobs // 2 - 2, maxlag)
    L = max(0, maxlag)
    count, gram, first = _lag_products(base, "__y", order_by, L, **kw)

    def moments(lags: int):
        """n, X'X, X'y, y'y of the regression with ``lags`` lags over rows t > ``lags``."""
        keep = [*range(lags + 2), L + 2]
        n, G = count, gram[np.ix_(keep, keep)]
        d = np.diff(first)
        for t in range(lags + 1, len(first)):
            row = np.array([1.0, first[t - 1], *d[t - 1 - lags:t - 1][::-1], d[t - 1]])
            n, G = n + 1, G + np.outer(row, row)
        p = lags + 2
        return n, G[:p, :p], G[:p, p], G[p, p]

    def ols(n, XtX, Xty, yy):
        beta = np.linalg.solve(XtX, Xty)
        ssr = float(yy - beta @ Xty)
        sigma2 = ssr / (n - len(beta))
        cov = sigma2 * np.linalg.inv(XtX)
        llf = -n / 2.0 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)
        return beta, cov, llf

    if autolag:
        best = None
        n, XtX, Xty, yy = moments(L)
        for k in range(0, L + 1):
            q = 2 + k
            beta, cov, llf = ols(n, XtX[:q, :q], Xty[:q], yy)
            aic = -2 * llf + 2 * len(beta)
            if best is None or aic < best[0]:
                best = (aic, k)
        usedlag = best[1]
    else:
        usedlag = L
    n, XtX, Xty, yy = moments(usedlag)
    q = 2 + usedlag
    beta, cov, _ = ols(n, XtX[:q, :q], Xty[:q], yy)
    stat = float(beta[1] / math.sqrt(cov[1, 1]))
    crit = S.adf_critical(n)
    row = (stat, S.adf_pvalue(stat), usedlag, n, crit["1%"], crit["5%"], crit["10%"])
    return df.sparkSession.createDataFrame([row], "statistic double, p_value double, lags int, nobs long, "
                                                  "crit_1pct double, crit_5pct double, crit_10pct double")


_CAL = {
    "weekday": (lambda t: F.weekday(t), list(range(7))),
    "month": (lambda t: F.month(t), list(range(1, 13))),
    "quarter": (lambda t: F.quarter(t), [1, 2, 3, 4]),
}


@nan_as_null
def seasonality(df: DataFrame, ts: str, value: str, period: str = "weekday") -> DataFrame:
    """mean, median, min, max, std, count per calendar unit in calendar order; absent units -> 0."""
    from tessera.plans.quantiles import exact_quantiles
    x = c(value).cast("double")
    base = df.where(c(ts).isNotNull() & x.isNotNull())
    if period == "year":
        key = F.year(c(ts))
        b = base.agg(F.min(key).alias("a"), F.max(key).alias("b"))
        spine = b.select(F.explode(F.sequence("a", "b")).alias("unit"))
    else:
        key = _CAL[period][0](c(ts))
        spine = df.sparkSession.createDataFrame([(u,) for u in _CAL[period][1]], "unit int")
    k = base.withColumn("unit", key.cast("int"))
    g = k.groupBy("unit").agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"),
                              F.stddev_samp(x).alias("std"), F.count(x).alias("count"))
    med = exact_quantiles(k, value, [0.5], "unit").select("unit", F.col("q").alias("median"))
    out = spine.join(g, "unit", "left").join(med, "unit", "left")
    return out.select("unit", *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in ("mean", "median", "min", "max", "std")],
                      F.coalesce("count", F.lit(0)).cast("long").alias("count"))


@nan_as_null
def seasonality_grid(df: DataFrame, ts: str, value: str, rows: str = "year", cols: str = "month") -> DataFrame:
    """Mean heatmap: year x month, month x weekday or isoweek x weekday (long form: row, col, mean)."""
    key = {"year": F.year, "month": F.month, "weekday": F.weekday, "week": F.weekofyear}
    x = c(value).cast("double")
    base = df.where(c(ts).isNotNull() & x.isNotNull())
    return base.groupBy(key[rows](c(ts)).cast("int").alias(rows), key[cols](c(ts)).cast("int").alias(cols)) \
        .agg(F.avg(x).alias("mean"))
