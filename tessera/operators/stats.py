"""Statistics (STA*): correlation, hypothesis tests, histograms, KDE, Q-Q,
distribution fits, normality, regression and trends.

Spark reduces the data (aggregates, grouped moments, ranks); the few numbers
that come back feed the scalar functions in ``functions.special``.  Tests
return one row ``(test, statistic, p_value, dof, n, alpha, reject, effect, label)``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import exprs as X
from tessera.functions import fits
from tessera.functions import special as S
from tessera.functions.common import MAX_CATEGORIES, bounded_rows, c, nan_as_null
from tessera.plans import ordered as O
from tessera.session import written

TEST_SCHEMA = ("test string, statistic double, p_value double, dof double, n long, alpha double, "
               "reject boolean, effect double, label string")


def _test_row(spark, test, stat, p, dof, n, alpha, effect=None, label=None, extra: dict | None = None) -> DataFrame:
    row = {"test": test, "statistic": _f(stat), "p_value": _f(p), "dof": _f(dof), "n": int(n) if n is not None else None,
           "alpha": float(alpha), "reject": (p < alpha) if p is not None and not math.isnan(p) else None,
           "effect": _f(effect), "label": label}
    schema = TEST_SCHEMA
    if extra:
        for k, v in extra.items():
            row[k] = _f(v) if not isinstance(v, str) else v
            schema += f", {k} {'string' if isinstance(v, str) else 'double'}"
    return spark.createDataFrame([row], schema)


def _f(v):
    return None if v is None else float(v)


# -- STA1-3 / STA10: correlation --------------------------------------------------------------------
@nan_as_null
def average_ranks(df: DataFrame, col: str, out: str, by: Sequence[str] = (), **kw) -> DataFrame:
    """Average rank (1-based, ties share the mean rank) of non-null values, per ``by`` group.

    Ranks come from value counts and a running sum over the *distinct* values
    (block prefix scan), joined back on the value: no global sort window.
    """
    by = list(by)
    keys = [f"__k{i}" for i in range(len(by))]
    x = c(col).cast("double")
    vc = df.where(x.isNotNull()).groupBy(*[c(b).alias(k) for b, k in zip(by, keys)], x.alias("__v")) \
        .agg(F.count(F.lit(1)).alias("__cnt"))
    cum = O.cumulative(vc, ["__cnt"], "sum", ["__v"], keys, {"__cnt": "__cum"}, **kw)
    ranks = cum.select(*keys, "__v", (F.col("__cum") - F.col("__cnt") + (F.col("__cnt") + 1) / 2.0).alias("__rank"))
    cond = [c(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)] + [x == F.col("__v")]
    return df.join(ranks, cond, "left").withColumn(out, F.col("__rank")).drop("__v", "__rank", *keys)


def _pairs(cols):
    return [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]


@nan_as_null
def correlation(df: DataFrame, cols: Sequence[str], method: str = "pearson") -> DataFrame:
    """Long correlation matrix (column_a, column_b, correlation) over pairwise-complete rows."""
    cols = list(cols)
    if method == "pearson":
        data, names = df, {x: x for x in cols}
    elif method == "spearman":
        has_nulls = df.agg(*[F.count_if(c(x).isNull()).alias(x) for x in cols]).first()
        if any(has_nulls[x] for x in cols):
            return _spearman_pairwise(df, cols)
        data = df
        for x in cols:
            data = average_ranks(data, x, f"__r_{x}")
        names = {x: f"__r_{x}" for x in cols}
    elif method == "kendall":
        rows = []
        for a, b in _pairs(cols):
            t = kendall_tau(df, a, b).first()["tau"]
            rows += [(a, b, t), (b, a, t)]
        rows += [(x, x, 1.0) for x in cols]
        return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")
    else:
        raise ValueError(f"method {method}: pearson | spearman | kendall")
    pairs = _pairs(cols)
    diag = df.sparkSession.createDataFrame([(x, x, 1.0) for x in cols], "column_a string, column_b string, correlation double")
    out = diag
    # a corr buffer has 6 fields: chunks of 15 pairs keep each aggregate under the codegen field limit
    for start in range(0, len(pairs), 15):
        chunk = pairs[start:start + 15]
        row = data.agg(*[F.corr(c(names[a]).cast("double"), c(names[b]).cast("double")).alias(f"p{i}")
                         for i, (a, b) in enumerate(chunk)])
        items = []
        for i, (a, b) in enumerate(chunk):
            items.append(F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), F.col(f"p{i}").alias("correlation")))
            items.append(F.struct(F.lit(b).alias("column_a"), F.lit(a).alias("column_b"), F.col(f"p{i}").alias("correlation")))
        out = out.unionByName(row.select(F.explode(F.array(*items)).alias("s")).select("s.*"))
    return out


def _spearman_pairwise(df, cols):
    out = None
    for a, b in _pairs(cols):
        d = df.where(c(a).isNotNull() & c(b).isNotNull())
        d = average_ranks(average_ranks(d, a, "__ra"), b, "__rb")
        r = d.agg(F.corr("__ra", "__rb").alias("r")).select(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"),
                                                             F.col("r").alias("correlation"))
        out = r if out is None else out.unionByName(r)
    sym = out.select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "correlation")
    diag = df.sparkSession.createDataFrame([(x, x, 1.0) for x in cols], "column_a string, column_b string, correlation double")
    return out.unionByName(sym).unionByName(diag)


@nan_as_null
def kendall_tau(df: DataFrame, a: str, b: str, blocks: int | None = None, **kw) -> DataFrame:
    """Kendall tau-b over pairwise-complete rows, exact, without enumerating pairs.

    Equal pairs are counted first, so values with many copies are single rows.
    x is cut into range blocks and y into range buckets.  Discordant pairs in
    different blocks *and* different buckets come from the (small) block x
    bucket count grid; pairs sharing a block, or sharing a bucket, are counted
    per group by a merge-sort inversion count in Arrow batches, and pairs that
    share both (a grid cell) are subtracted once.  Tie counts come from grouped
    counts.  Returns (tau, n, concordant_minus_discordant).
    """
    import pandas as pd
    x, y = c(a).cast("double"), c(b).cast("double")
    d = df.where(x.isNotNull() & y.isNotNull()).select(x.alias("__x"), y.alias("__y"))
    d = d.groupBy("__x", "__y").agg(F.count(F.lit(1)).alias("__w"))  # equal pairs travel once, with their count
    size = d.agg(F.sum("__w"), F.count(F.lit(1))).first()
    n, distinct = int(size[0] or 0), size[1]
    if n < 2:
        return df.sparkSession.createDataFrame([(None, n, None)], "tau double, n long, s double")
    nb = blocks or max(1, min(2048, -(-distinct // 1_000_000)))

    def ties(*keys):
        t = F.col("t")
        return d.groupBy(*keys).agg(F.sum("__w").alias("t")).agg(F.sum(t * (t - 1) / 2)).first()[0] or 0
    n1, n2, n3 = ties("__x"), ties("__y"), ties("__x", "__y")

    from pyspark.ml.feature import Bucketizer

    g, parts = d, {}
    for col, name in (("__x", "__bx"), ("__y", "__by")):
        at = [] if nb <= 1 else d.agg(F.percentile_approx(col, [i / nb for i in range(1, nb)], 10000)).first()[0]
        # a value that fills several ranges gets a range of its own
        edges = sorted({float(e) for e in at} | {math.nextafter(float(e), math.inf) for e in at if at.count(e) > 1})
        parts[name] = len(edges) + 1
        if not edges:
            g = g.withColumn(name, F.lit(0))
        else:  # range buckets assigned by binary search
            g = Bucketizer(splits=[float("-inf")] + edges + [float("inf")], inputCol=col,
                           outputCol=name + "_d").transform(g).withColumn(name, F.col(name + "_d").cast("int")) \
                .drop(name + "_d")
    # cross-cell discordant pairs on the dense grid of ranges (generated, not joined), kept in Spark:
    # D(i, j) = rows in cells (i' < i, j' > j); cross = sum cnt(i, j) * D(i, j)
    counts = g.groupBy("__bx", "__by").agg(F.sum("__w").alias("cnt"))
    dense = df.sparkSession.range(parts["__bx"]).select(F.col("id").cast("int").alias("__bx")) \
        .select("__bx", F.explode(F.sequence(F.lit(0), F.lit(parts["__by"] - 1))).alias("__by"))
    cells = dense.join(counts, ["__bx", "__by"], "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
    wx = Window.partitionBy("__by").orderBy("__bx").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__c", F.coalesce(F.sum("cnt").over(wx), F.lit(0)))
    wy = Window.partitionBy("__bx").orderBy(F.col("__by").desc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("__d", F.coalesce(F.sum("__c").over(wy), F.lit(0)))
    cross = cells.agg(F.sum(F.col("cnt") * F.col("__d"))).first()[0] or 0

    def per_group(keys):
        def fn(pdf: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"d": [S.weighted_discordant(pdf["__x"].to_numpy(), pdf["__y"].to_numpy(), pdf["__w"].to_numpy())]})
        # a group with a single x or a single y has no discordant pair
        live = g.groupBy(*keys).agg(F.min("__x").alias("x0"), F.max("__x").alias("x1"), F.min("__y").alias("y0"), F.max("__y").alias("y1"))
        live = live.where("x0 < x1 and y0 < y1").select(*keys)
        res = g.join(live, list(keys), "left_semi").groupBy(*keys).applyInPandas(fn, "d long")
        return res.agg(F.sum("d")).first()[0] or 0
    same_x = per_group(["__bx"])
    same_y = per_group(["__by"])
    same_cell = per_group(["__bx", "__by"])
    nd = cross + same_x + same_y - same_cell
    n0 = n * (n - 1) / 2
    s_ = n0 - n1 - n2 + n3 - 2 * nd
    den = math.sqrt((n0 - n1) * (n0 - n2))
    tau = s_ / den if den > 0 else None
    return df.sparkSession.createDataFrame([(tau, n, float(s_))], "tau double, n long, s double")


def strength_label(r: Column) -> Column:
    a = F.abs(r)
    return F.when(a >= 0.7, "strong").when(a >= 0.3, "moderate").otherwise("weak")


@nan_as_null
def correlation_pairs(df: DataFrame, cols: Sequence[str], method: str = "pearson", min_abs: float = 0.0) -> DataFrame:
    """Each pair once (column order), |r| >= min_abs, sorted by |r| desc, with strength and direction."""
    cols = list(cols)
    pos = F.create_map(*[y for i, x in enumerate(cols) for y in (F.lit(x), F.lit(i))])
    m = correlation(df, cols, method).where(pos[F.col("column_a")] < pos[F.col("column_b")])
    return (m.where(F.abs("correlation") >= min_abs)
            .withColumn("strength", strength_label(F.col("correlation")))
            .withColumn("direction", F.when(F.col("correlation") >= 0, "positive").otherwise("negative"))
            .orderBy(F.abs("correlation").desc(), "column_a", "column_b"))


@nan_as_null
def correlation_edges(df: DataFrame, cols: Sequence[str], threshold: float = 0.1, method: str = "pearson") -> DataFrame:
    """Correlation-network edges (src, dst, weight = |r|) with |r| > threshold."""
    p = correlation_pairs(df, cols, method)
    return p.where(F.abs("correlation") > threshold).select(
        F.col("column_a").alias("src"), F.col("column_b").alias("dst"), F.abs("correlation").alias("weight"))


def _tie_sums(d: DataFrame, x: Column) -> tuple[float, float, float]:
    """Over groups of t equal values: sums of t(t-1)/2, t(t-1)(t-2) and t(t-1)(2t+5)."""
    t = F.col("t").cast("double")
    row = d.groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("t")).where("t > 1").agg(
        F.sum(t * (t - 1) / 2), F.sum(t * (t - 1) * (t - 2)), F.sum(t * (t - 1) * (2 * t + 5))).first()
    return tuple(v or 0.0 for v in row)


@nan_as_null
def correlation_test(df: DataFrame, a: str, b: str, method: str = "pearson", alpha: float = 0.05) -> DataFrame:
    """r, p (t with n-2 dof), R^2, direction and strength label."""
    d = df.where(c(a).isNotNull() & c(b).isNotNull())
    if method == "kendall":
        k = kendall_tau(df, a, b).first()
        tau, n = k["tau"], k["n"]
        z = None
        if tau is not None:  # normal approximation with the variance corrected for ties
            (xt, x0, x1), (yt, y0, y1) = _tie_sums(d, c(a).cast("double")), _tie_sums(d, c(b).cast("double"))
            m = float(n) * (n - 1)
            var = (m * (2 * n + 5) - x1 - y1) / 18 + 2 * xt * yt / m + (x0 * y0 / (9 * m * (n - 2)) if n > 2 else 0.0)
            z = k["s"] / math.sqrt(var) if var > 0 else None
        p = 2 * S.norm_sf(abs(z)) if z is not None else None
        lab = None if tau is None else ("strong" if abs(tau) >= 0.7 else "moderate" if abs(tau) >= 0.3 else "weak") + \
            (" positive" if tau >= 0 else " negative")
        return _test_row(df.sparkSession, "kendall correlation", tau, p, None, n, alpha,
                         None if tau is None else tau * tau, lab, {"t": z})
    if method == "spearman":
        d = average_ranks(average_ranks(d, a, "__ra"), b, "__rb")
        xa, xb = F.col("__ra"), F.col("__rb")
    else:
        xa, xb = c(a).cast("double"), c(b).cast("double")
    r_row = d.agg(F.corr(xa, xb).alias("r"), F.count(F.lit(1)).alias("n")).first()
    r, n = r_row["r"], r_row["n"]
    if r is None or n < 3:
        p, t = None, None
    elif abs(r) >= 1:
        p, t = 0.0, float("inf")
    else:
        t = r * math.sqrt((n - 2) / (1 - r * r))
        p = S.t_two_sided(t, n - 2)
    lab = None if r is None else ("strong" if abs(r) >= 0.7 else "moderate" if abs(r) >= 0.3 else "weak") + \
        (" positive" if r >= 0 else " negative")
    return _test_row(df.sparkSession, f"{method} correlation", r, p, n - 2 if n else None, n, alpha,
                     None if r is None else r * r, lab, {"t": t})


# -- STA4-6: t-tests ----------------------------------------------------------------------------------
@nan_as_null
def ttest_1samp(df: DataFrame, col: str, mu: float, alpha: float = 0.05) -> DataFrame:
    x = c(col).cast("double")
    r = df.agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.stddev_samp(x).alias("s")).first()
    n, m, s = r["n"], r["m"], r["s"]
    t = (m - mu) / (s / math.sqrt(n)) if n and s else None
    p = S.t_two_sided(t, n - 1) if t is not None else None
    return _test_row(df.sparkSession, "one-sample t", t, p, n - 1, n, alpha, (m - mu) / s if s else None, None,
                     {"mean": m})


def _group_moments(df: DataFrame, value: str, group: str, groups: Sequence | None = None) -> list:
    x = c(value).cast("double")
    d = df.where(c(group).isNotNull() & x.isNotNull())
    if groups is not None:
        d = d.where(c(group).isin(list(groups)))
    g = d.groupBy(c(group).alias("g")).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.var_samp(x).alias("var"),
                                           F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"))
    return bounded_rows(g.orderBy("g"), MAX_CATEGORIES, "groups")


@nan_as_null
def ttest_ind(df: DataFrame, value: str, group: str, a, b, equal_var: bool = False, alpha: float = 0.05) -> DataFrame:
    """Welch (default) or pooled two-sample t-test between groups ``a`` and ``b``."""
    rows = {r["g"]: r for r in _group_moments(df, value, group, [a, b])}
    ra, rb = rows[a], rows[b]
    n1, n2, m1, m2, v1, v2 = ra["n"], rb["n"], ra["mean"], rb["mean"], ra["var"], rb["var"]
    if equal_var:
        dof = n1 + n2 - 2
        sp = ((n1 - 1) * v1 + (n2 - 1) * v2) / dof
        t = (m1 - m2) / math.sqrt(sp * (1 / n1 + 1 / n2))
    else:
        se2 = v1 / n1 + v2 / n2
        t = (m1 - m2) / math.sqrt(se2)
        dof = se2 ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1))
    p = S.t_two_sided(t, dof)
    d_eff = (m1 - m2) / math.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
    return _test_row(df.sparkSession, "pooled t" if equal_var else "Welch t", t, p, dof, n1 + n2, alpha, d_eff, None,
                     {"mean_a": m1, "mean_b": m2})


@nan_as_null
def ttest_paired(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    d = df.where(c(a).isNotNull() & c(b).isNotNull()).select((c(a).cast("double") - c(b).cast("double")).alias("__d"))
    r = d.agg(F.count("__d").alias("n"), F.avg("__d").alias("m"), F.stddev_samp("__d").alias("s")).first()
    n, m, s = r["n"], r["m"], r["s"]
    t = m / (s / math.sqrt(n)) if s else None
    p = S.t_two_sided(t, n - 1) if t is not None else None
    return _test_row(df.sparkSession, "paired t", t, p, n - 1, n, alpha, m / s if s else None, None, {"mean_diff": m})


# -- STA7-8: ANOVA and Tukey ---------------------------------------------------------------------------
@nan_as_null
def anova_table(df: DataFrame, value: str, group: str, groups: Sequence | None = None) -> DataFrame:
    """Per group: count, mean, std, min, max."""
    x = c(value).cast("double")
    d = df.where(c(group).isNotNull() & x.isNotNull())
    if groups is not None:
        d = d.where(c(group).isin(list(groups)))
    return d.groupBy(c(group)).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                                    F.min(x).alias("min"), F.max(x).alias("max"))


@nan_as_null
def anova_stats(df: DataFrame, value: str, group: str, groups: Sequence | None = None) -> DataFrame:
    """One-way ANOVA sums of squares and F as a one-row frame (all Spark-side)."""
    g = anova_table(df, value, group, groups)
    tot = g.agg(F.sum("count").alias("N"), F.count(F.lit(1)).alias("k"),
                (F.sum(F.col("count") * F.col("mean")) / F.sum("count")).alias("grand"))
    grand = tot.select("grand").scalar()
    ss = g.agg(F.sum(F.col("count") * (F.col("mean") - grand) * (F.col("mean") - grand)).alias("ssb"),
               F.sum((F.col("count") - 1) * F.coalesce(F.col("std") * F.col("std"), F.lit(0.0))).alias("ssw"))
    N, k = tot.select("N").scalar(), tot.select("k").scalar()
    return ss.select("ssb", "ssw", (k - 1).cast("double").alias("df_between"), (N - k).cast("double").alias("df_within"),
                     ((F.col("ssb") / (k - 1)) / (F.col("ssw") / (N - k))).alias("f"), N.alias("n"))


@nan_as_null
def anova(df: DataFrame, value: str, group: str, groups: Sequence | None = None, alpha: float = 0.05) -> DataFrame:
    r = anova_stats(df, value, group, groups).first()
    p = S.f_sf(r["f"], r["df_between"], r["df_within"]) if r["f"] is not None else None
    eta = r["ssb"] / (r["ssb"] + r["ssw"]) if r["ssb"] is not None else None
    return _test_row(df.sparkSession, "one-way ANOVA", r["f"], p, r["df_between"], r["n"], alpha, eta, None,
                     {"df_within": r["df_within"]})


@nan_as_null
def tukey_hsd(df: DataFrame, value: str, group: str, alpha: float = 0.05) -> DataFrame:
    """All pairs: mean difference, CI, adjusted p, reject (Tukey-Kramer)."""
    rows = _group_moments(df, value, group)
    k = len(rows)
    N = sum(r["n"] for r in rows)
    msw = sum((r["n"] - 1) * (r["var"] or 0.0) for r in rows) / (N - k)
    qcrit = S.qtukey(1 - alpha, k, N - k)
    out = []
    for i in range(k):
        for j in range(i + 1, k):
            a, b = rows[i], rows[j]
            diff = b["mean"] - a["mean"]
            se = math.sqrt(msw / 2 * (1 / a["n"] + 1 / b["n"]))
            q = abs(diff) / se
            p = 1 - S.ptukey(q, k, N - k)
            out.append((str(a["g"]), str(b["g"]), float(diff), float(diff - qcrit * se), float(diff + qcrit * se), float(p),
                        bool(p < alpha)))
    return df.sparkSession.createDataFrame(
        out, "group_a string, group_b string, meandiff double, lower double, upper double, p_adj double, reject boolean")


# -- STA9: chi-square -----------------------------------------------------------------------------------
@nan_as_null
def contingency(df: DataFrame, a: str, b: str, max_columns: int = 100_000) -> DataFrame:
    """Full grid of observed counts (zeros included) with expected counts.

    Built long, from grouped counts: every row total gets the list of column
    totals (the grid is the result), and the counts are joined on.  More than
    ``max_columns`` categories of ``b`` raise an error.
    """
    counts = df.where(c(a).isNotNull() & c(b).isNotNull()).groupBy(c(a).alias("__a"), c(b).alias("__b")).agg(
        F.count(F.lit(1)).alias("observed"))
    n = counts.agg(F.sum("observed")).scalar()
    rowt = counts.groupBy("__a").agg(F.sum("observed").alias("__rt"))
    few = df.where(c(b).isNotNull()).select(c(b)).distinct().limit(max_columns + 1).count()
    if few > max_columns:
        raise ValueError(f"{b}: more than {max_columns} categories")
    colt = counts.groupBy("__b").agg(F.sum("observed").alias("__ct")).agg(F.collect_list(F.struct("__b", "__ct"))).scalar()
    grid = rowt.select("__a", "__rt", F.inline(colt).alias("__b", "__ct"))
    g = grid.join(counts, ["__a", "__b"], "left")
    return g.select(F.col("__a").alias(a), F.col("__b").alias(b), F.coalesce("observed", F.lit(0)).alias("observed"),
                    (F.col("__rt") * F.col("__ct") / n).alias("expected"))


@nan_as_null
def chi2_stats(df: DataFrame, a: str, b: str) -> DataFrame:
    """chi2 (Yates-corrected for 2x2, like scipy), dof, n, cells with expected < 5, Cramer's V - one row.

    The contingency table (one row per category pair, bounded by the category
    caps) is cached and reduced twice: once for its shape, once for the sums.
    """
    t = contingency(df, a, b).cache()
    shape = t.agg(F.count_distinct(c(a)).alias("r"), F.count_distinct(c(b)).alias("k"),
                  F.sum("observed").alias("n")).first()
    r, k, n = shape["r"], shape["k"], shape["n"]
    diff = F.col("expected") - F.col("observed")
    adj = (F.col("observed") + F.signum(diff) * F.least(F.lit(0.5), F.abs(diff))) if (r == 2 and k == 2) \
        else F.col("observed")
    res = t.agg(F.sum((adj - F.col("expected")) * (adj - F.col("expected")) / F.col("expected")).alias("chi2"),
                F.count_if(F.col("expected") < 5).alias("small_expected"), F.count(F.lit(1)).alias("cells")).first()
    t.unpersist()
    chi = res["chi2"]
    v = math.sqrt(chi / (n * min(r - 1, k - 1))) if chi is not None and n and min(r, k) > 1 else None
    label = None if v is None else ("negligible" if v < 0.1 else "small" if v < 0.3 else "medium" if v < 0.5 else "large")
    return df.sparkSession.createDataFrame(
        [(chi, float((r - 1) * (k - 1)), n, res["small_expected"], res["cells"], v, label)],
        "chi2 double, dof double, n long, small_expected long, cells long, cramers_v double, effect_label string")


@nan_as_null
def chi2_test(df: DataFrame, a: str, b: str, alpha: float = 0.05) -> DataFrame:
    r = chi2_stats(df, a, b).first()
    p = S.chi2_sf(r["chi2"], r["dof"]) if r["dof"] else None
    return _test_row(df.sparkSession, "chi-square independence", r["chi2"], p, r["dof"], r["n"], alpha,
                     r["cramers_v"], r["effect_label"], {"small_expected": float(r["small_expected"])})


# -- STA11-13: histogram, KDE, Q-Q --------------------------------------------------------------------
@nan_as_null
def histogram(df: DataFrame, col: str, bins: int = 10, by: str | None = None, norm: str = "count") -> DataFrame:
    """numpy-style histogram: ``bins`` equal bins over [min, max], last bin closed, empty bins kept.

    norm: count | percent | probability | density.
    """
    x = c(col).cast("double")
    base = df.where(x.isNotNull()) if by is None else df.where(x.isNotNull() & c(by).isNotNull())
    from tessera.functions.common import scalar_values
    v = scalar_values(base.agg(F.min(x).alias("a"), F.max(x).alias("b")))  # two numbers
    if v.get("a") is None:
        return df.sparkSession.createDataFrame([], T.StructType(
            ([df.schema[by]] if by else []) + [T.StructField("bin", T.IntegerType()), T.StructField("count", T.LongType()),
                                               T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType()),
                                               T.StructField("value", T.DoubleType())]))
    a, b = F.lit(float(v["a"])), F.lit(float(v["b"]))
    w = F.lit((float(v["b"]) - float(v["a"])) / bins)
    edges = F.array(*[a + w * i for i in range(bins)], b)
    raw = F.floor((x - a) / w).cast("int")
    k0 = F.least(F.greatest(F.coalesce(raw, F.lit(0)), F.lit(0)), F.lit(bins - 1))
    lo_e = F.element_at(edges, k0 + 1)
    hi_e = F.element_at(edges, k0 + 2)
    k = F.when((x < lo_e) & (k0 > 0), k0 - 1).when((x >= hi_e) & (k0 < bins - 1), k0 + 1).otherwise(k0)
    keys = [c(by)] if by else []
    g = base.groupBy(*keys, k.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine_src = base.select(*keys).distinct() if by else df.sparkSession.range(1).select()
    spine = spine_src.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    h = spine.join(g, ([by] if by else []) + ["bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)).cast("long"))
    h = h.withColumn("lower", a + w * F.col("bin")).withColumn(
        "upper", F.when(F.col("bin") == bins - 1, b).otherwise(a + w * (F.col("bin") + 1)))
    tot = F.sum("count").over(Window.partitionBy(*keys)) if by else base.agg(F.count(F.lit(1))).scalar()
    if norm == "percent":
        h = h.withColumn("value", F.col("count") * 100.0 / tot)
    elif norm == "probability":
        h = h.withColumn("value", F.col("count") / tot)
    elif norm == "density":
        h = h.withColumn("value", F.col("count") / (tot * w))
    else:
        h = h.withColumn("value", F.col("count").cast("double"))
    return h


#: Gaussian sums: boxes half a bandwidth wide, kernels expanded to this many terms about the box's centre and cut off
#: beyond this many bandwidths.  One value's kernel (1 at its peak) is off by less than 1e-11.
_KDE_TERMS, _KDE_REACH = 12, 8.5


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients (by rising power) of the probabilists' Hermite polynomials of degree 0 to ``terms`` - 1."""
    he = [[1], [0, 1]]
    for k in range(1, terms - 1):
        shifted = [0, *he[k]]
        he.append([x - k * y for x, y in zip(shifted, he[k - 1] + [0, 0])])
    return he[:terms]


@nan_as_null
def kde(df: DataFrame, col: str, points: int = 1000, by: str | None = None) -> DataFrame:
    """Gaussian KDE (Scott bandwidth, like scipy) on ``points`` grid points between min and max, per group.

    One aggregate gives n, std, min and max per group.  Values fall into boxes
    half a bandwidth wide, and one grouped aggregate sums the powers of their
    distance to the box's centre; a box then adds its expansion to the grid
    points in reach, which every grid point gets from a few dozen boxes
    whatever the number of rows.  The error is below 1e-11 of a kernel's peak.
    A group without spread has NaN densities.
    """
    x = c(col).cast("double")
    keys = [by] if by else []
    base = df.where(x.isNotNull())
    if by:
        base = base.where(c(by).isNotNull())
    gnames = keys or ["__g"]
    base = base.select(*([c(by)] if by else [F.lit(0).alias("__g")]), x.alias("__x"))
    st = base.groupBy(*gnames).agg(F.count("__x").alias("__n"), F.stddev_samp("__x").alias("__sd"),
                                    F.min("__x").alias("__a"), F.max("__x").alias("__b"))
    a, b, h, n = F.col("__a"), F.col("__b"), F.col("__h"), F.col("__n")
    st = st.withColumn("__h", F.col("__sd") * F.pow(n, -0.2))
    step = (b - a) / F.lit(max(points - 1, 1))
    box = F.floor((F.col("__x") - a) * 2 / h)
    # one row of statistics per group; AQE broadcasts it when small
    d = base.join(st.where((h > 0) & (h < float("inf"))).select(*gnames, "__a", "__h"), gnames).withColumn("__box", box)
    d = d.withColumn("__u", (F.col("__x") - a) / h - (F.col("__box") + 0.5) / 2)
    power, sums = F.lit(1.0), []
    for k in range(_KDE_TERMS):
        sums.append((F.sum(power) / math.factorial(k)).alias(f"__m{k}"))
        power = power * F.col("__u")
    boxes = d.groupBy(*gnames, "__box").agg(*sums)
    he = _hermite(_KDE_TERMS)
    terms = []  # the expansion as a polynomial of the distance in bandwidths
    for i in range(_KDE_TERMS):
        parts = [F.col(f"__m{k}") * float(he[k][i]) for k in range(i, _KDE_TERMS) if he[k][i]]
        terms.append(reduce(lambda p, q: p + q, parts).alias(f"__c{i}"))
    boxes = boxes.select(*gnames, ((F.col("__box") + 0.5) / 2).alias("__centre"), *terms).join(st, gnames)
    place = F.col("__centre") * h / step  # of the box's centre on the grid
    reach = F.lit(_KDE_REACH) * h / step
    first, last = F.greatest(F.ceil(place - reach), F.lit(0)), F.least(F.floor(place + reach), F.lit(points - 1))
    near = boxes.where(first <= last).select("*", F.explode(F.sequence(first, last)).alias("__i"))
    t = F.col("__i") * step / h - F.col("__centre")
    near = near.withColumn("__t", t)
    value = F.col(f"__c{_KDE_TERMS - 1}")
    for i in range(_KDE_TERMS - 2, -1, -1):
        value = value * F.col("__t") + F.col(f"__c{i}")
    sums = near.groupBy(*gnames, "__i").agg(F.sum(value * F.exp(F.col("__t") * F.col("__t") * -0.5)).alias("__s"))
    grid = st.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(points - 1).cast("long"))).alias("__i"))
    at = F.when(F.col("__i") == points - 1, b).otherwise(a + F.col("__i") * step) if points > 1 else a
    density = F.when((h > 0) & (h < float("inf")), F.coalesce("__s", F.lit(0.0)) / (n * h * math.sqrt(2 * math.pi))).otherwise(F.lit(float("nan")))
    return grid.join(sums, [*gnames, "__i"], "left").select(*keys, at.alias("x"), density.alias("density"))


def _ppf(dist: str, p: Column, params: dict) -> Column:
    if dist == "normal":
        return params["loc"] + params["scale"] * X.norm_ppf(p)
    if dist == "uniform":
        return params["loc"] + params["scale"] * p
    if dist == "exponential":
        return params["loc"] - params["scale"] * F.ln(1 - p)
    if dist == "lognormal":
        return F.exp(params["mu"] + params["sigma"] * X.norm_ppf(p))
    raise ValueError(dist)


@nan_as_null
def qq(df: DataFrame, col: str, dist: str = "normal", **kw) -> DataFrame:
    """Sorted sample vs theoretical quantiles at p = linspace(0.01, 0.99, n), fitted location/scale."""
    x = c(col).cast("double")
    base = df.where(x.isNotNull()).select(x.alias("sample"))
    s = base.agg(F.count("sample").alias("n"), F.avg("sample").alias("m"), F.stddev_samp("sample").alias("sd"),
                 F.min("sample").alias("a"), F.max("sample").alias("b"),
                 F.avg(F.ln(F.when(F.col("sample") > 0, F.col("sample")))).alias("lm"),
                 F.stddev_samp(F.ln(F.when(F.col("sample") > 0, F.col("sample")))).alias("ls"))
    n = s.select("n").scalar()
    params = {"loc": s.select("m").scalar(), "scale": s.select("sd").scalar()}
    if dist == "uniform":
        params = {"loc": s.select("a").scalar(), "scale": s.select(F.col("b") - F.col("a")).scalar()}
    elif dist == "exponential":
        params = {"loc": F.lit(0.0), "scale": s.select("m").scalar()}
    elif dist == "lognormal":
        params = {"mu": s.select("lm").scalar(), "sigma": s.select("ls").scalar()}
    d = O.row_index(base, ["sample"], None, "__r", **kw)
    p = F.when(n > 1, 0.01 + 0.98 * F.col("__r") / (n - 1)).otherwise(F.lit(0.5))
    return d.select(p.alias("p"), _ppf(dist, p, params).alias("theoretical"), "sample")


# -- STA14-16: fits and normality --------------------------------------------------------------------------
#: Boxes a unit of asinh((x - centre) / scale), and a unit of ln x divided by its spread.
_BOXES, _LOG_BOXES = 32, 8
_EDGE = 1e-9


def _box_sums(z: Column, weight: Column) -> list[Column]:
    power, out = weight, []
    for j in range(fits.DEGREE):
        out.append(F.sum(power).alias(f"z{j}"))
        power = power * z
    return out


def _linear_points(vc: DataFrame, centre: float, scale: float):
    """Weighted points for functions of x that are smooth at the width ``scale`` around ``centre``: box widths grow outwards."""
    k = F.floor(F.asinh((F.col("__x") - centre) / scale) * _BOXES)
    lo, hi = F.sinh(k / _BOXES) * scale + centre, F.sinh((k + 1) / _BOXES) * scale + centre
    d = vc.select("__c", k.alias("k"), ((lo + hi) / 2).alias("at"), ((hi - lo) / 2).alias("half"), "__x")
    return _points(d.groupBy("k", "at", "half").agg(*_box_sums((F.col("__x") - F.col("at")) / F.col("half"), F.col("__c"))))


def _log_points(vc: DataFrame, width: float):
    """Weighted points for functions of ln x that are smooth at ``width``."""
    k = F.floor(F.ln("__x") / width)
    d = vc.select("__c", k.alias("k"), (k * width + width / 2).alias("at"), F.lit(width / 2).alias("half"), F.ln("__x").alias("__u"))
    return _points(d.groupBy("k", "at", "half").agg(*_box_sums((F.col("__u") - F.col("at")) / F.col("half"), F.col("__c"))))


def _points(boxes: DataFrame):
    rows = boxes.drop("k").toPandas()
    return fits.box_points(rows["at"], rows["half"], rows[[f"z{j}" for j in range(fits.DEGREE)]])


def _fit_sums(vc: DataFrame) -> dict | None:
    """What the estimates need, from two aggregates over the value counts; None without values."""
    x, w = F.col("__x"), F.col("__c")
    lx = F.ln(F.when(x > 0, x))
    m = vc.agg(F.sum(w).alias("n"), (F.sum(w * x) / F.sum(w)).alias("m"), F.min(x).alias("a"), F.max(x).alias("b"),
               F.coalesce(F.sum(F.when(x > 0, w)), F.lit(0)).alias("npos"),
               (F.sum(w * lx) / F.sum(F.when(x > 0, w))).alias("ml"),
               F.percentile_approx(x, [0.25, 0.5, 0.75], 1000).alias("q")).first().asDict()
    if not m["n"]:
        return None
    span = (m["b"] - m["a"]) or 1.0
    z = F.least(F.greatest((x - m["a"]) / span, F.lit(_EDGE)), F.lit(1 - _EDGE))
    m |= vc.agg(F.sum(w * (x - m["m"]) ** 2).alias("ss"), F.sum(w * (lx - F.lit(m["ml"])) ** 2).alias("sl"),
                F.sum(w * F.ln(z)).alias("l1"), F.sum(w * F.ln(1 - z)).alias("l2"), F.sum(w * z).alias("mz")).first().asDict()
    m["sd"] = math.sqrt(m["ss"] / m["n"])
    m["sl"] = None if m["sl"] is None else math.sqrt(m["sl"] / m["npos"])
    return m


def _fit_params(vc: DataFrame, dist: str, m) -> tuple[list[float], str]:
    n = m["n"]
    if dist in ("lognormal", "gamma", "weibull") and m["npos"] < n:
        return [], "needs positive data"
    if dist == "exponential":
        return ([m["m"]], "ok") if m["m"] > 0 else ([], "needs a positive mean")
    if m["b"] <= m["a"]:
        return [], "constant data"
    if dist == "normal":
        return [m["m"], m["sd"]], "ok"
    if dist == "lognormal":
        return [m["ml"], m["sl"]], "ok"
    if dist == "uniform":
        return [m["a"], m["b"] - m["a"]], "ok"
    if dist == "gamma":
        return fits.gamma_params(m["m"], m["ml"]), "ok"
    if dist == "beta":
        span = m["b"] - m["a"]
        return [*fits.beta_params(m["mz"] / n, (m["sd"] / span) ** 2, m["l1"] / n, m["l2"] / n), m["a"], span], "ok"
    if dist == "weibull":
        width = m["sl"] / _LOG_BOXES
        while True:  # the boxes must be narrow for the shape that they give
            shape, scale = fits.weibull_params(*_log_points(vc, width), m["ml"])
            if shape * width <= 0.5:
                return [shape, scale], "ok"
            width = 0.2 / shape
    if dist == "t":
        width = min(m["sd"], (m["q"][2] - m["q"][0]) or m["sd"])
        centre = m["q"][1]
        while True:  # the boxes must be narrow for the centre that they give
            nu, mu, sigma = fits.t_params(*_linear_points(vc, centre, width), m["m"], m["sd"])
            if sigma * math.sqrt(nu) >= width / 4 and abs(mu - centre) <= 4 * width:
                return [nu, mu, sigma], "ok"
            centre, width = mu, min(width, sigma * math.sqrt(nu))
    raise ValueError(dist)


def _logpdf(dist: str, x: Column, p: list[float]) -> Column:
    if dist == "normal":
        mu, s = p
        return -0.5 * math.log(2 * math.pi) - math.log(s) - 0.5 * ((x - mu) / s) ** 2
    if dist == "lognormal":
        mu, s = p
        return -F.ln(x) - math.log(s) - 0.5 * math.log(2 * math.pi) - 0.5 * ((F.ln(x) - mu) / s) ** 2
    if dist == "exponential":
        return -math.log(p[0]) - x / p[0]
    if dist == "uniform":
        return F.when((x >= p[0]) & (x <= p[0] + p[1]), F.lit(-math.log(p[1]))).otherwise(F.lit(float("-inf")))
    if dist == "gamma":
        k, th = p
        return (k - 1) * F.ln(x) - x / th - math.lgamma(k) - k * math.log(th)
    if dist == "weibull":
        k, lam = p
        return math.log(k / lam) + (k - 1) * F.ln(x / lam) - F.pow(x / lam, k)
    if dist == "beta":
        al, be, loc, sc = p
        z = F.least(F.greatest((x - loc) / sc, F.lit(1e-12)), F.lit(1 - 1e-12))
        return ((al - 1) * F.ln(z) + (be - 1) * F.ln(1 - z) - (math.lgamma(al) + math.lgamma(be) - math.lgamma(al + be))
                - math.log(sc))
    if dist == "t":
        nu, mu, s = p
        return (math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2) - 0.5 * math.log(nu * math.pi) - math.log(s)
                - (nu + 1) / 2 * F.ln(1 + ((x - mu) / s) ** 2 / nu))
    raise ValueError(dist)


def _cdf_column(dist: str, x: Column, p: list[float]) -> Column | None:
    if dist == "normal":
        return X.norm_cdf((x - p[0]) / p[1])
    if dist == "lognormal":
        return F.when(x > 0, X.norm_cdf((F.ln(x) - p[0]) / p[1])).otherwise(0.0)
    if dist == "exponential":
        return F.when(x > 0, 1 - F.exp(-x / p[0])).otherwise(0.0)
    if dist == "uniform":
        return F.least(F.greatest((x - p[0]) / p[1], F.lit(0.0)), F.lit(1.0))
    if dist == "weibull":
        return F.when(x > 0, 1 - F.exp(-F.pow(x / p[1], p[0]))).otherwise(0.0)
    return None


def _cdf_udf(dist: str, p: list[float]):
    from tessera.functions.udfs import cdf_udf
    return cdf_udf(dist, p)


_FIT_SCHEMA = ("distribution string, params array<double>, ks double, p_value double, aic double, bic double, "
               "loglik double, status string")


@nan_as_null
def fit_distributions(df: DataFrame, col: str, dists: Sequence[str], **kw) -> DataFrame:
    """One row per distribution: (distribution, params, ks, p_value, aic, bic, loglik, status).

    The rows are read once, into a written table of values and their counts.
    Two aggregates over that table give the moments, one more the boxes of a
    Weibull or t fit (``functions.fits``), and one ranked pass every
    Kolmogorov-Smirnov distance and log-likelihood at once.  ``status`` says
    why a distribution has no fit (no data, constant data, values that are
    not positive).
    """
    x = c(col).cast("double")
    vc = written(df.where(x.isNotNull()).groupBy(x.alias("__x")).agg(F.count(F.lit(1)).alias("__c")), "value-counts")
    m = _fit_sums(vc)
    fitted = {d: _fit_params(vc, d, m) if m else ([], "no data") for d in dists}
    good = [d for d in fitted if fitted[d][1] == "ok"]
    found = {}
    if good:
        n, xc, w = m["n"], F.col("__x"), F.col("__c")
        ranked = O.cumulative(vc, ["__c"], "sum", ["__x"], None, {"__c": "__cum"}, **kw)
        cdfs = {d: _cdf_column(d, xc, fitted[d][0]) for d in good}
        ranked = ranked.withColumns({f"__F{i}": cdfs[d] if cdfs[d] is not None else _cdf_udf(d, fitted[d][0])(xc)
                                     for i, d in enumerate(good)})
        aggs = []
        for i, d in enumerate(good):
            fx = F.col(f"__F{i}")
            aggs += [F.max(F.greatest(F.col("__cum") / n - fx, fx - (F.col("__cum") - w) / n)).alias(f"ks{i}"),
                     F.sum(w * _logpdf(d, xc, fitted[d][0])).alias(f"ll{i}")]
        found = ranked.agg(*aggs).first()
    rows = []
    for d in dists:
        params, status = fitted[d]
        if status != "ok":
            rows.append((d, None, None, None, None, None, None, status))
            continue
        ks, ll = found[f"ks{good.index(d)}"], found[f"ll{good.index(d)}"]
        count = len(params) - (2 if d == "beta" else 0)
        rows.append((d, [float(v) for v in params], float(ks), float(S.kolmogorov_sf(ks, n)), float(2 * count - 2 * ll),
                     float(count * math.log(n) - 2 * ll), float(ll), "ok"))
    return df.sparkSession.createDataFrame(rows, _FIT_SCHEMA)


def fit_distribution(df: DataFrame, col: str, dist: str = "normal", **kw) -> DataFrame:
    """``fit_distributions`` for one distribution."""
    return fit_distributions(df, col, [dist], **kw)


def compare_fits(df: DataFrame, col: str, dists: Sequence[str] = ("normal", "lognormal", "exponential", "gamma",
                                                                  "weibull", "beta")) -> DataFrame:
    """Fits of several distributions ranked by AIC; ``best`` marks the minimum."""
    out = fit_distributions(df, col, list(dists))
    best = out.where(F.col("status") == "ok").agg(F.min("aic")).scalar()
    return out.withColumn("best", F.coalesce(F.col("aic") == best, F.lit(False)))


@nan_as_null
def shapiro(df: DataFrame, col: str, alpha: float = 0.05, **kw) -> DataFrame:
    """Shapiro-Wilk W and p (Royston 1992); weights are columns of the value rank."""
    x = c(col).cast("double")
    base = df.where(x.isNotNull()).select(x.alias("__x"))
    n = base.count()
    if n < 3:
        return _test_row(df.sparkSession, "Shapiro-Wilk", None, None, None, n, alpha)
    d = O.row_index(base, ["__x"], None, "__r", **kw)
    mcol = X.norm_ppf((F.col("__r") + 1 - 0.375) / (n + 0.25))
    d = d.withColumn("__m", mcol)
    tails = d.agg(F.sum(F.col("__m") ** 2).alias("mm"), F.max("__m").alias("mn"),
                  F.max(F.when(F.col("__r") == n - 2, F.col("__m"))).alias("mn1"),
                  F.avg("__x").alias("mean")).first()
    a_n, a_n1, phi = S.shapiro_weights_tail(n, tails["mm"], tails["mn"], tails["mn1"])
    r = F.col("__r")
    a = (F.when(r == n - 1, a_n).when(r == 0, -a_n)
         .when((r == n - 2) & F.lit(n > 5), a_n1).when((r == 1) & F.lit(n > 5), -a_n1)
         .otherwise(F.col("__m") / math.sqrt(phi)))
    agg = d.agg(F.sum(a * F.col("__x")).alias("num"), F.sum((F.col("__x") - tails["mean"]) ** 2).alias("ss")).first()
    w = agg["num"] ** 2 / agg["ss"] if agg["ss"] else None
    p = S.shapiro_p(w, n) if w is not None else None
    return _test_row(df.sparkSession, "Shapiro-Wilk", w, p, None, n, alpha, None,
                     None if p is None else ("normal" if p >= alpha else "not normal"))


@nan_as_null
def distribution_summary(df: DataFrame, col: str) -> DataFrame:
    """mean, median, std, IQR, min, max, skew, kurtosis (bias-corrected) of non-null values."""
    from tessera.operators.profile import summary_statistics
    s = summary_statistics(df, [col])
    return s.select("mean", F.col("median"), "std", (F.col("q75") - F.col("q25")).alias("iqr"), "min", "max",
                    "skew", "kurtosis")


# -- STA17-21: regression and trends -------------------------------------------------------------------------
@nan_as_null
def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """slope, intercept, r, r2, n, stderr of slope, p (t test of slope)."""
    d = df.where(c(x).isNotNull() & c(y).isNotNull())
    xx, yy = c(x).cast("double"), c(y).cast("double")
    r = d.agg(F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"),
              F.corr(xx, yy).alias("r"), F.count(F.lit(1)).alias("n"), F.var_samp(xx).alias("vx"),
              F.var_samp(yy).alias("vy")).first()
    n, rr = r["n"], r["r"]
    if n > 2 and rr is not None and abs(rr) < 1:
        se = math.sqrt((1 - rr * rr) * r["vy"] / r["vx"] / (n - 2))
        p = S.t_two_sided(r["slope"] / se, n - 2)
    else:
        se, p = None, None
    return df.sparkSession.createDataFrame(
        [(r["slope"], r["intercept"], rr, None if rr is None else rr * rr, n, se, p)],
        "slope double, intercept double, r double, r2 double, n long, stderr double, p_value double")


@nan_as_null
def residuals(df: DataFrame, x: str, y: str) -> DataFrame:
    """Fitted values and residuals of y ~ x (slope/intercept as scalar subqueries)."""
    d = df.where(c(x).isNotNull() & c(y).isNotNull())
    xx, yy = c(x).cast("double"), c(y).cast("double")
    s = d.agg(F.regr_slope(yy, xx).alias("b"), F.regr_intercept(yy, xx).alias("a"))
    fitted = s.select("a").scalar() + s.select("b").scalar() * xx
    return df.withColumn("fitted", fitted).withColumn("residual", yy - F.col("fitted"))


@nan_as_null
def trend(df: DataFrame, value: str, order_by, kind: str = "linear", degree: int = 2, **kw) -> DataFrame:
    """Trend on row position: linear slope with labels, exponential (ln y; falls back to linear when y <= 0),
    or polynomial coefficients (lowest power first)."""
    d = O.row_index(df.where(c(value).isNotNull()), order_by, None, "__pos", **kw)
    pos = F.col("__pos").cast("double")
    y = c(value).cast("double")
    if kind == "linear":
        r = d.agg(F.regr_slope(y, pos).alias("slope"), F.regr_intercept(y, pos).alias("intercept"))
        change = F.abs("slope")  # units per step
        return r.select("slope", "intercept",
                        F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing")
                        .otherwise("flat").alias("direction"),
                        F.when(change > 0.1, "strong").when(change > 0.01, "moderate").otherwise("weak").alias("strength"))
    if kind == "exponential":
        positive = d.agg(F.min(y)).scalar() > 0
        r = d.agg(F.regr_slope(F.ln(y), pos).alias("b"), F.regr_intercept(F.ln(y), pos).alias("ln_a"),
                  F.regr_slope(y, pos).alias("ls"), F.regr_intercept(y, pos).alias("li"))
        return r.select(F.when(positive, "exponential").otherwise("linear").alias("model"),
                        F.when(positive, F.exp("ln_a")).otherwise(F.col("li")).alias("a"),
                        F.when(positive, F.col("b")).otherwise(F.col("ls")).alias("b"))
    if kind == "polynomial":
        n = d.count()
        t = (pos - (n - 1) / 2.0) / max((n - 1) / 2.0, 1.0)  # centred and scaled position
        sums = d.agg(*[F.sum(t ** k).alias(f"s{k}") for k in range(2 * degree + 1)],
                     *[F.sum(y * t ** k).alias(f"y{k}") for k in range(degree + 1)]).first()
        A = np.array([[sums[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
        bvec = np.array([sums[f"y{i}"] for i in range(degree + 1)])
        coef_t = np.linalg.solve(A, bvec)
        # convert from t = (pos - c) / s back to powers of pos
        cst, sc = (n - 1) / 2.0, max((n - 1) / 2.0, 1.0)
        poly = np.polynomial.Polynomial(coef_t)
        back = poly(np.polynomial.Polynomial([-cst / sc, 1 / sc]))
        coefs = list(back.coef) + [0.0] * (degree + 1 - len(back.coef))
        return df.sparkSession.createDataFrame([(i, float(v)) for i, v in enumerate(coefs)], "power int, coefficient double")
    raise ValueError(kind)


def _tricube_sums(lo, hi, counts, sx, sy, a: float, h: float) -> tuple[np.ndarray, np.ndarray]:
    """(weighted sums of the cells that lie wholly on one side of ``a`` inside the window, places of the cells it cuts).

    The sums are w, w u, w u^2, w y, w y u with u = (x - a) / h.  On either side
    the weight (1 - |u|^3)^3 is a polynomial of u, so a cell's sums follow from
    its moments ``sx``, ``sy`` of t = (x - middle) / half width by expanding
    u = (half t + middle - a) / h.
    """
    inside = (hi >= a - h) & (lo <= a + h) & (counts > 0)
    left, right = inside & (hi <= a) & (lo >= a - h), inside & (lo >= a) & (hi <= a + h)
    total = np.zeros(5)
    for side, cells in ((-1.0, left & ~right), (1.0, right)):
        at = np.flatnonzero(cells)
        middle, half = _middle(lo[at], hi[at])
        alpha, beta = half / h, (middle - a) / h
        power = np.zeros((_MOMENTS, len(at), _MOMENTS))  # of u, as coefficients of powers of t
        power[0, :, 0] = 1.0
        for m in range(1, _MOMENTS):
            power[m] = beta[:, None] * power[m - 1]
            power[m, :, 1:] += alpha[:, None] * power[m - 1, :, :-1]
        weight = {0: 1.0, 3: -3.0 * side, 6: 3.0, 9: -side}
        for k, (q, moments) in enumerate([(0, sx), (1, sx), (2, sx), (0, sy), (1, sy)]):
            total[k] += sum(w * (power[m + q] * moments[at]).sum() for m, w in weight.items())
    if total[0] < 1e-3 * counts[left | right].sum():  # all at the window's ends, where the polynomial cancels: row by row
        return np.zeros(5), np.flatnonzero(inside)
    return total, np.flatnonzero(inside & ~left & ~right)


#: Powers 0 to 11 of the distance: tricube weights (9) times a square.
_MOMENTS = 12


def _middle(lo, hi):
    """Middle and half width of a cell (1 for a single value)."""
    half = (hi - lo) / 2
    return lo + half, np.where(half > 0, half, 1.0)


def _in_cells(df: DataFrame, x: str, edges: Sequence[float], out: str) -> DataFrame:
    from pyspark.ml.feature import Bucketizer
    if len(edges) < 2:
        return df.withColumn(out, F.lit(0))
    d = Bucketizer(splits=[float("-inf"), *edges[1:], float("inf")], inputCol=x, outputCol=out).transform(df)
    return d.withColumn(out, F.col(out).cast("int"))


@nan_as_null
def lowess(df: DataFrame, x: str, y: str, frac: float = 0.1, anchors: int = 100, cells: int = 2048) -> DataFrame:
    """LOWESS (tricube weights, local linear fit) at anchor points, interpolated linearly to every row.

    Anchors are exact quantiles of x; an anchor's radius is the distance to its
    ``ceil(frac * n)``-th nearest row.  Rows are summarised once in ``cells``
    ranges of x (counts and moments, on the driver); an anchor looks at single
    rows only in the few ranges that its radius or its window's ends cut.
    """
    from tessera.plans.quantiles import quantile_values
    spark = df.sparkSession
    xx, yy = c(x).cast("double"), c(y).cast("double")
    base = df.where(xx.isNotNull() & yy.isNotNull()).select(xx.alias("__x"), yy.alias("__y"))
    n, first, last = base.agg(F.count(F.lit(1)), F.min("__x"), F.max("__x")).first()
    if not n:
        return base.select(F.col("__x").alias(x), F.col("__y").alias(y), F.lit(None).cast("double").alias("lowess"))
    k = max(2, int(math.ceil(frac * n)))
    pts = sorted({float(v) for v in quantile_values(base, "__x", [i / max(1, anchors - 1) for i in range(anchors)]) if v is not None})

    # ranges of x: a value that fills a whole one is a range of its own
    cuts = base.agg(F.percentile_approx("__x", [i / cells for i in range(1, cells)], 20 * cells)).first()[0]
    often = {v for v, w in zip(cuts, cuts[1:]) if v == w}
    edges = sorted({first, *cuts, *(math.nextafter(v, math.inf) for v in often if v < last)})
    lo, hi = np.array(edges), np.array([*(math.nextafter(e, -math.inf) for e in edges[1:]), last])
    d = _in_cells(base, "__x", edges, "__cell")
    middle, half = _middle(lo, hi)
    shape = F.broadcast(spark.createDataFrame([(i, float(m), float(w)) for i, (m, w) in enumerate(zip(middle, half))], "__cell int, __m double, __w double"))
    t = (F.col("__x") - F.col("__m")) / F.col("__w")
    powers, run = [], F.lit(1.0)
    for p in range(_MOMENTS):
        powers += [F.sum(run).alias(f"x{p}"), F.sum(run * F.col("__y")).alias(f"y{p}")]
        run = run * F.col("__t")
    moments = d.join(shape, "__cell").withColumn("__t", t).groupBy("__cell").agg(F.count(F.lit(1)).alias("n"), *powers)
    counts, sx, sy = np.zeros(len(edges), np.int64), np.zeros((len(edges), _MOMENTS)), np.zeros((len(edges), _MOMENTS))
    for r in moments.collect():  # one row per cell
        counts[r["__cell"]] = r["n"]
        sx[r["__cell"]], sy[r["__cell"]] = ([r[f"{v}{p}"] for p in range(_MOMENTS)] for v in "xy")

    # radius: cells surely nearer than the k-th row are counted, rows of the undecided ones are ranked
    near = [np.maximum(np.maximum(lo - a, a - hi), 0.0) for a in pts]
    far = [np.maximum(np.abs(lo - a), np.abs(hi - a)) for a in pts]
    undecided, need = [], []
    goal = min(k, n)
    for i in range(len(pts)):
        def bound(dist):
            order = np.argsort(dist, kind="stable")
            return dist[order[np.searchsorted(np.cumsum(counts[order]), goal)]]
        low, high = bound(near[i]), bound(far[i])
        sure = far[i] < low
        need.append((i, goal - int(counts[sure].sum())))
        undecided += [(int(cell), i, pts[i]) for cell in np.flatnonzero(~sure & (near[i] <= high) & (counts > 0))]
    asked = F.broadcast(spark.createDataFrame(undecided, "__cell int, __id int, __a double"))  # a few cells per anchor
    dist = d.join(asked, "__cell").groupBy("__id", F.abs(F.col("__x") - F.col("__a")).alias("__d")).agg(F.count(F.lit(1)).alias("__n"))
    upto = Window.partitionBy("__id").orderBy("__d").rowsBetween(Window.unboundedPreceding, 0)
    dist = dist.withColumn("__upto", F.sum("__n").over(upto)).join(F.broadcast(spark.createDataFrame(need, "__id int, __need long")), "__id")
    radius = {r["__id"]: max(r["__h"], 1e-12) * 1.0000001 for r in
              dist.where(F.col("__upto") >= F.col("__need")).groupBy("__id").agg(F.min("__d").alias("__h")).collect()}

    sums, cut = [], []
    for i, a in enumerate(pts):
        total, places = _tricube_sums(lo, hi, counts, sx, sy, a, radius[i])
        sums.append(total)
        cut += [(int(cell), i, a, radius[i]) for cell in places]
    if cut:
        j = d.join(F.broadcast(spark.createDataFrame(cut, "__cell int, __id int, __a double, __h double")), "__cell")
        u = (F.col("__x") - F.col("__a")) / F.col("__h")
        w = F.pow(1 - F.pow(F.least(F.abs(u), F.lit(1.0)), 3), 3)
        parts = j.withColumns({"__u": u, "__v": w}).groupBy("__id").agg(
            *[F.sum(F.expr(e)).alias(f"s{i}") for i, e in enumerate(("__v", "__v * __u", "__v * __u * __u", "__v * __y", "__v * __y * __u"))])
        for r in parts.collect():  # one row per anchor
            sums[r["__id"]] = sums[r["__id"]] + np.array(r[1:])
    fitted = []
    for a, (s0, s1, s2, t0, t1) in zip(pts, sums):
        den = s0 * s2 - s1 * s1
        fitted.append((a, float(t0 / s0 if den <= 1e-12 * s0 * max(s2, 1e-300) else (s2 * t0 - s1 * t1) / den)))
    if len(fitted) == 1:
        return base.select(F.col("__x").alias(x), F.col("__y").alias(y), F.lit(fitted[0][1]).alias("lowess"))
    steps = [(i, p, v, p1, v1) for i, ((p, v), (p1, v1)) in enumerate(zip(fitted, fitted[1:]))]
    lines = F.broadcast(spark.createDataFrame(steps, "__step int, __x0 double, __y0 double, __x1 double, __y1 double"))
    d = _in_cells(base, "__x", [p for p, _ in fitted[:-1]], "__step").join(lines, "__step")
    smooth = F.col("__y0") + (F.col("__y1") - F.col("__y0")) * (F.col("__x") - F.col("__x0")) / (F.col("__x1") - F.col("__x0"))
    return d.select(F.col("__x").alias(x), F.col("__y").alias(y), smooth.alias("lowess"))
