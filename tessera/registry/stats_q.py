"""Registry: statistics (STA*) and time series.  Test statistics are checked by
DuckDB; p-values (not expressible in DuckDB) are checked by pytest."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import stats as ST
from tessera.operators import timeseries as TS
from tessera.registry.base import fin, register, rsql, tbl

LI = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(cols, table):
    parts = [f"SELECT '{x}' AS column_a, '{x}' AS column_b, 1.0::DOUBLE AS correlation" for x in cols]
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}', '{b}', corr({a}, {b}) FROM {table}")
            parts.append(f"SELECT '{b}', '{a}', corr({a}, {b}) FROM {table}")
    return rsql(" UNION ALL ".join(parts), ["correlation"])


@register("correlation_pearson", _corr_sql(LI, "lineitem"))
def q_correlation_pearson(spark, sf):
    return fin(ST.correlation(tbl(spark, sf, "lineitem"), LI, "pearson"))




def _avg_rank(x):
    return f"(rank() OVER (ORDER BY {x}) + rank() OVER (ORDER BY {x}) + count(*) OVER (PARTITION BY {x}) - 1) / 2.0 AS {x}"


_SP = ["o_totalprice", "o_custkey", "o_orderdate_n"]
_SP_TABLE = ("(SELECT " + ", ".join(_avg_rank(x) for x in _SP) +
             " FROM (SELECT o_totalprice, o_custkey, epoch(o_orderdate) AS o_orderdate_n FROM orders))")


@register("correlation_spearman", _corr_sql(_SP, _SP_TABLE))
def q_correlation_spearman(spark, sf):
    o = tbl(spark, sf, "orders").select("o_totalprice", "o_custkey",
                                        F.col("o_orderdate").cast("timestamp").cast("double").alias("o_orderdate_n"))
    return fin(ST.correlation(o, _SP, "spearman"))


def _pairs_sql(cols, table, min_abs=0.0):
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}, {b}) AS correlation FROM {table}")
    inner = " UNION ALL ".join(parts)
    return rsql(f"""SELECT *, CASE WHEN abs(correlation) >= 0.7 THEN 'strong' WHEN abs(correlation) >= 0.3 THEN 'moderate'
  ELSE 'weak' END AS strength, CASE WHEN correlation >= 0 THEN 'positive' ELSE 'negative' END AS direction
  FROM ({inner}) WHERE abs(correlation) >= {min_abs}""", ["correlation"])


@register("correlation_pairs", _pairs_sql(LI + ["l_orderkey"], "lineitem"))
def q_correlation_pairs(spark, sf):
    return fin(ST.correlation_pairs(tbl(spark, sf, "lineitem"), LI + ["l_orderkey"]))


@register("correlation_edges", rsql("SELECT column_a AS src, column_b AS dst, abs(correlation) AS weight FROM (" +
                                    _pairs_sql(["o_totalprice", "o_custkey", "o_orderkey"], "orders") +
                                    ") WHERE abs(correlation) > 0.1", ["weight"]))
def q_correlation_edges(spark, sf):
    # edges of the correlation network between order attributes and the price
    o = tbl(spark, sf, "orders")
    return fin(ST.correlation_edges(o, ["o_totalprice", "o_custkey", "o_orderkey"], 0.1))


_TEST_COLS = ["test", "statistic", "dof", "n", "effect", "label"]


@register("correlation_test", rsql("""SELECT 'pearson correlation' AS test, corr(l_quantity, l_extendedprice) AS statistic,
  (count(*) - 2)::DOUBLE AS dof, count(*) AS n, power(corr(l_quantity, l_extendedprice), 2) AS effect,
  CASE WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.7 THEN 'strong' WHEN abs(corr(l_quantity, l_extendedprice)) >= 0.3
  THEN 'moderate' ELSE 'weak' END || CASE WHEN corr(l_quantity, l_extendedprice) >= 0 THEN ' positive' ELSE ' negative' END AS label,
  corr(l_quantity, l_extendedprice) * sqrt((count(*) - 2) / (1 - power(corr(l_quantity, l_extendedprice), 2))) AS t
  FROM lineitem""", ["statistic", "effect", "t"]))
def q_correlation_test(spark, sf):
    r = ST.correlation_test(tbl(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")
    return fin(r.select(*_TEST_COLS, "t"))


@register("ttest_one_sample", rsql("""SELECT 'one-sample t' AS test, (avg(value) - 50.0) / (stddev_samp(value) / sqrt(count(value))) AS statistic,
  (count(value) - 1)::DOUBLE AS dof, count(value) AS n, (avg(value) - 50.0) / stddev_samp(value) AS effect, NULL::VARCHAR AS label,
  avg(value) AS mean FROM events""", ["statistic", "effect", "mean"]))
def q_ttest_one_sample(spark, sf):
    return fin(ST.ttest_1samp(tbl(spark, sf, "events"), "value", 50.0).select(*_TEST_COLS, "mean"))


def _ttest_sql(pooled):
    stat = ("(m1 - m2) / sqrt((((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) * (1.0 / n1 + 1.0 / n2))" if pooled else
            "(m1 - m2) / sqrt(v1 / n1 + v2 / n2)")
    dof = ("(n1 + n2 - 2)::DOUBLE" if pooled else
           "power(v1 / n1 + v2 / n2, 2) / (power(v1 / n1, 2) / (n1 - 1) + power(v2 / n2, 2) / (n2 - 1))")
    name = "pooled t" if pooled else "Welch t"
    return rsql(f"""WITH g AS (SELECT
  count(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS n1, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS m1,
  var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS v1,
  count(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS n2, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS m2,
  var_samp(o_totalprice) FILTER (WHERE o_orderstatus = 'O') AS v2 FROM orders)
  SELECT '{name}' AS test, {stat} AS statistic, {dof} AS dof, n1 + n2 AS n,
  (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) AS effect, NULL::VARCHAR AS label,
  m1 AS mean_a, m2 AS mean_b FROM g""", ["statistic", "dof", "effect", "mean_a", "mean_b"], 4)


@register("ttest_welch", _ttest_sql(False))
def q_ttest_welch(spark, sf):
    r = ST.ttest_ind(tbl(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O")
    return fin(r.select(*_TEST_COLS, "mean_a", "mean_b"), 4)


@register("ttest_pooled", _ttest_sql(True))
def q_ttest_pooled(spark, sf):
    r = ST.ttest_ind(tbl(spark, sf, "orders"), "o_totalprice", "o_orderstatus", "F", "O", equal_var=True)
    return fin(r.select(*_TEST_COLS, "mean_a", "mean_b"), 4)


@register("ttest_paired", rsql("""SELECT 'paired t' AS test, avg(d) / (stddev_samp(d) / sqrt(count(d))) AS statistic,
  (count(d) - 1)::DOUBLE AS dof, count(d) AS n, avg(d) / stddev_samp(d) AS effect, NULL::VARCHAR AS label, avg(d) AS mean_diff
  FROM (SELECT l_extendedprice / l_quantity - l_extendedprice / (l_quantity + 1) AS d FROM lineitem)""",
                               ["statistic", "effect", "mean_diff"]))
def q_ttest_paired(spark, sf):
    li = tbl(spark, sf, "lineitem").select((F.col("l_extendedprice") / F.col("l_quantity")).alias("a"),
                                           (F.col("l_extendedprice") / (F.col("l_quantity") + 1)).alias("b"))
    return fin(ST.ttest_paired(li, "a", "b").select(*_TEST_COLS, "mean_diff"))


@register("anova_table", rsql("""SELECT o_orderpriority, count(o_totalprice) AS "count", avg(o_totalprice) AS mean,
  stddev_samp(o_totalprice) AS std, min(o_totalprice) AS "min", max(o_totalprice) AS "max" FROM orders
  WHERE o_orderpriority IS NOT NULL GROUP BY 1""", ["mean", "std", "min", "max"], 4))
def q_anova_table(spark, sf):
    return fin(ST.anova_table(tbl(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), 4)


@register("anova_f", rsql("""WITH g AS (SELECT o_orderpriority, count(o_totalprice) AS n, avg(o_totalprice) AS m,
  stddev_samp(o_totalprice) AS s FROM orders GROUP BY 1),
  t AS (SELECT sum(n) AS nn, count(*) AS k, sum(n * m) / sum(n) AS grand FROM g),
  ss AS (SELECT sum(n * (m - grand) * (m - grand)) AS ssb, sum((n - 1) * coalesce(s * s, 0.0)) AS ssw FROM g, t)
  SELECT ssb, ssw, (k - 1)::DOUBLE AS df_between, (nn - k)::DOUBLE AS df_within, (ssb / (k - 1)) / (ssw / (nn - k)) AS f,
  nn::BIGINT AS n FROM ss, t""", ["ssb", "ssw", "f"], 6, {"ssb": -3, "ssw": -3}))
def q_anova_f(spark, sf):
    # sums of squares are ~1e14: compared to the nearest thousand, F to 6 decimals
    return fin(ST.anova_stats(tbl(spark, sf, "orders"), "o_totalprice", "o_orderpriority"), 6, {"ssb": -3, "ssw": -3})


def _chi2_sql(table, a, b):
    return rsql(f"""WITH o AS (SELECT {a} AS a, {b} AS b, count(*) AS obs FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL GROUP BY 1, 2),
  ga AS (SELECT DISTINCT a FROM o), gb AS (SELECT DISTINCT b FROM o),
  grid AS (SELECT ga.a, gb.b, coalesce(o.obs, 0) AS obs FROM ga CROSS JOIN gb LEFT JOIN o ON o.a = ga.a AND o.b = gb.b),
  rt AS (SELECT a, sum(obs) AS rt FROM grid GROUP BY a), ct AS (SELECT b, sum(obs) AS ct FROM grid GROUP BY b),
  nn AS (SELECT sum(obs) AS n FROM grid), dims AS (SELECT count(DISTINCT a) AS r, count(DISTINCT b) AS k FROM grid),
  e AS (SELECT grid.obs, rt * ct / n AS ex, r, k, n FROM grid JOIN rt ON grid.a = rt.a JOIN ct ON grid.b = ct.b, nn, dims),
  adj AS (SELECT *, CASE WHEN r = 2 AND k = 2 THEN obs + sign(ex - obs) * least(0.5, abs(ex - obs)) ELSE obs END AS o2 FROM e),
  s AS (SELECT sum((o2 - ex) * (o2 - ex) / ex) AS chi2, ((any_value(r) - 1) * (any_value(k) - 1))::DOUBLE AS dof,
    any_value(n)::BIGINT AS n, count_if(ex < 5)::BIGINT AS small_expected, count(*)::BIGINT AS cells,
    any_value(r) AS r, any_value(k) AS k FROM adj)
  SELECT chi2, dof, n, small_expected, cells, sqrt(chi2 / (n * least(r - 1, k - 1))) AS cramers_v,
    CASE WHEN sqrt(chi2 / (n * least(r - 1, k - 1))) < 0.1 THEN 'negligible' WHEN sqrt(chi2 / (n * least(r - 1, k - 1))) < 0.3 THEN 'small'
    WHEN sqrt(chi2 / (n * least(r - 1, k - 1))) < 0.5 THEN 'medium' ELSE 'large' END AS effect_label FROM s""",
                ["chi2", "cramers_v"])


@register("chi2_yates_2x2", _chi2_sql("labels", "quality", "toxic"))
def q_chi2_yates_2x2(spark, sf):
    return fin(ST.chi2_stats(tbl(spark, sf, "labels"), "quality", "toxic"))


@register("chi2_rxc", _chi2_sql("customer", "c_mktsegment", "c_nationkey"))
def q_chi2_rxc(spark, sf):
    return fin(ST.chi2_stats(tbl(spark, sf, "customer"), "c_mktsegment", "c_nationkey"))


@register("contingency_expected", rsql("""WITH o AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS obs FROM lineitem GROUP BY 1, 2),
  ga AS (SELECT DISTINCT a FROM o), gb AS (SELECT DISTINCT b FROM o),
  grid AS (SELECT ga.a, gb.b, coalesce(o.obs, 0) AS obs FROM ga CROSS JOIN gb LEFT JOIN o ON o.a = ga.a AND o.b = gb.b)
  SELECT a AS l_returnflag, b AS l_linestatus, obs::BIGINT AS observed,
    sum(obs) OVER (PARTITION BY a) * sum(obs) OVER (PARTITION BY b) / sum(obs) OVER () AS expected FROM grid""", ["expected"]))
def q_contingency_expected(spark, sf):
    return fin(ST.contingency(tbl(spark, sf, "lineitem"), "l_returnflag", "l_linestatus"))


def _hist_sql(table, col, bins, norm="count", by=None):
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    val = {"count": "cnt::DOUBLE", "percent": f"cnt * 100.0 / sum(cnt) OVER ({part})",
           "probability": f"cnt / sum(cnt) OVER ({part})", "density": f"cnt / (sum(cnt) OVER ({part}) * w)"}[norm]
    filt = f"{col} IS NOT NULL" + (f" AND {by} IS NOT NULL" if by else "")
    return rsql(f"""WITH s AS (SELECT min({col}) AS a, max({col}) AS b, (max({col}) - min({col})) / {bins} AS w FROM {table} WHERE {filt}),
  x AS (SELECT {keys}{col} AS v, least(greatest(coalesce(floor(({col} - a) / w)::INTEGER, 0), 0), {bins - 1}) AS k0, a, b, w
        FROM {table}, s WHERE {filt}),
  y AS (SELECT {keys}CASE WHEN v < a + w * k0 AND k0 > 0 THEN k0 - 1
                     WHEN v >= CASE WHEN k0 + 1 = {bins} THEN b ELSE a + w * (k0 + 1) END AND k0 < {bins - 1} THEN k0 + 1
                     ELSE k0 END AS bin FROM x),
  g AS (SELECT {keys}bin, count(*) AS cnt FROM y GROUP BY ALL),
  sp AS (SELECT {keys}unnest(generate_series(0, {bins - 1}))::INTEGER AS bin FROM {"(SELECT DISTINCT " + by + " FROM " + table + " WHERE " + filt + ")" if by else "(SELECT 1)"}),
  j AS (SELECT sp.*, coalesce(g.cnt, 0)::BIGINT AS cnt FROM sp LEFT JOIN g USING ({by + ", " if by else ""}bin))
  SELECT {keys}bin, cnt AS "count", a + w * bin AS lower, CASE WHEN bin = {bins - 1} THEN b ELSE a + w * (bin + 1) END AS upper,
    {val} AS value FROM j, s""", ["lower", "upper", "value"])


@register("histogram", _hist_sql("lineitem", "l_extendedprice", 20))
def q_histogram(spark, sf):
    return fin(ST.histogram(tbl(spark, sf, "lineitem"), "l_extendedprice", 20))


@register("histogram_density", _hist_sql("events", "value", 30, "density"))
def q_histogram_density(spark, sf):
    return fin(ST.histogram(tbl(spark, sf, "events"), "value", 30, norm="density"))


@register("histogram_by_group_percent", _hist_sql("events", "value", 8, "percent", "event_type"))
def q_histogram_by_group_percent(spark, sf):
    return fin(ST.histogram(tbl(spark, sf, "events"), "value", 8, by="event_type", norm="percent"))


def _kde_sql(table, col, points=200):
    return rsql(f"""WITH d AS (SELECT {col}::DOUBLE AS x FROM {table} WHERE {col} IS NOT NULL AND NOT isnan({col}::DOUBLE)),
  st AS (SELECT count(*) AS n, stddev_samp(x) AS sd, min(x) AS a, max(x) AS b FROM d),
  grid AS (SELECT CASE WHEN j = {points - 1} THEN b ELSE j * ((b - a) / {float(points - 1)}) + a END AS gx
           FROM st, (SELECT unnest(generate_series(0, {points - 1})) AS j))
  SELECT gx AS x, sum(exp(-0.5 * power((gx - d.x) / (sd * power(n, -0.2)), 2))) / (n * (sd * power(n, -0.2)) * sqrt(2 * pi())) AS density
  FROM grid, d, st GROUP BY gx, n, sd""", ["x", "density"])


@register("kde", _kde_sql("events", "value"))
def q_kde(spark, sf):
    return fin(ST.kde(tbl(spark, sf, "events"), "value", 200))


def _horner_sql(cs, x):
    acc = repr(cs[0])
    for cf in cs[1:]:
        acc = f"(({acc}) * {x} + {cf!r})"
    return acc


def _norm_ppf_sql(p):
    """The same rational approximation as tessera.functions.exprs.norm_ppf, written in SQL."""
    from tessera.functions import exprs as X
    ql = f"sqrt(-2 * ln({p}))"
    qu = f"sqrt(-2 * ln(1 - {p}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    low = f"({_horner_sql(X._C, ql)} / ({_horner_sql(X._D, ql)} * {ql} + 1))"
    mid = f"({_horner_sql(X._A, r)} * {q} / ({_horner_sql(X._B, r)} * {r} + 1))"
    high = f"(-{_horner_sql(X._C, qu)} / ({_horner_sql(X._D, qu)} * {qu} + 1))"
    return f"CASE WHEN {p} < {X._PLOW!r} THEN {low} WHEN {p} > {1 - X._PLOW!r} THEN {high} ELSE {mid} END"


@register("qq_normal", rsql(f"""WITH b AS (SELECT c_acctbal AS sample, row_number() OVER (ORDER BY c_acctbal) - 1 AS r,
  count(*) OVER () AS n FROM customer WHERE c_acctbal IS NOT NULL),
  s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS sd FROM customer),
  pp AS (SELECT sample, CASE WHEN n > 1 THEN 0.01 + 0.98 * r / (n - 1) ELSE 0.5 END AS p FROM b)
  SELECT p, s.m + s.sd * ({_norm_ppf_sql('p')}) AS theoretical, sample FROM pp, s""", ["p", "theoretical", "sample"]))
def q_qq_normal(spark, sf):
    return fin(ST.qq(tbl(spark, sf, "customer"), "c_acctbal", "normal"))


@register("fit_distributions")
def q_fit_distributions(spark, sf):
    return fin(ST.compare_fits(tbl(spark, sf, "events"), "value", ["normal", "lognormal", "exponential", "gamma",
                                                                   "weibull", "uniform"]))


@register("shapiro_wilk")
def q_shapiro_wilk(spark, sf):
    return fin(ST.shapiro(tbl(spark, sf, "customer"), "c_acctbal"))


@register("tukey_hsd")
def q_tukey_hsd(spark, sf):
    return fin(ST.tukey_hsd(tbl(spark, sf, "orders"), "o_totalprice", "o_orderpriority"))


@register("distribution_summary", rsql("""SELECT avg(c_acctbal) AS mean, quantile_cont(c_acctbal, 0.5) AS median,
  stddev_samp(c_acctbal) AS std, quantile_cont(c_acctbal, 0.75) - quantile_cont(c_acctbal, 0.25) AS iqr,
  min(c_acctbal) AS "min", max(c_acctbal) AS "max", skewness(c_acctbal) AS skew, kurtosis(c_acctbal) AS kurtosis FROM customer""",
                                       ["mean", "median", "std", "iqr", "min", "max", "skew", "kurtosis"]))
def q_distribution_summary(spark, sf):
    return fin(ST.distribution_summary(tbl(spark, sf, "customer"), "c_acctbal"))


@register("linear_fit", rsql("""SELECT regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept,
  corr(l_quantity, l_extendedprice) AS r, power(corr(l_quantity, l_extendedprice), 2) AS r2, count(*) AS n FROM lineitem""",
                             ["slope", "intercept", "r", "r2"], 4))
def q_linear_fit(spark, sf):
    return fin(ST.linear_fit(tbl(spark, sf, "lineitem"), "l_quantity", "l_extendedprice").select(
        "slope", "intercept", "r", "r2", "n"), 4)


@register("residuals", rsql("""WITH s AS (SELECT regr_slope(o_totalprice, o_custkey) AS b, regr_intercept(o_totalprice, o_custkey) AS a FROM orders)
  SELECT o_orderkey, a + b * o_custkey AS fitted, o_totalprice - (a + b * o_custkey) AS residual FROM orders, s""",
                            ["fitted", "residual"], 3))
def q_residuals(spark, sf):
    return fin(ST.residuals(tbl(spark, sf, "orders"), "o_custkey", "o_totalprice").select("o_orderkey", "fitted", "residual"), 3)


@register("contingency_double_keys", rsql("""WITH d AS (SELECT l_linenumber * 1e7 AS a, l_returnflag AS b FROM lineitem WHERE l_linenumber <> 3 OR l_returnflag <> 'A'),
  r AS (SELECT a, count(*) AS rt FROM d GROUP BY 1), k AS (SELECT b, count(*) AS ct FROM d GROUP BY 1),
  g AS (SELECT a, b, count(*) AS o FROM d GROUP BY 1, 2)
  SELECT r.a, k.b, coalesce(g.o, 0)::BIGINT AS observed, rt * ct / (SELECT count(*) FROM d)::DOUBLE AS expected
  FROM r JOIN k ON true LEFT JOIN g ON g.a = r.a AND g.b = k.b""", ["a", "expected"], 4))
def q_contingency_double_keys(spark, sf):
    """Large double categories and an empty cell."""
    d = tbl(spark, sf, "lineitem").where("l_linenumber <> 3 or l_returnflag <> 'A'").select(
        (F.col("l_linenumber") * F.lit(1e7)).alias("a"), F.col("l_returnflag").alias("b"))
    return fin(ST.contingency(d, "a", "b"), 4)


@register("trend_linear", rsql("""WITH b AS (SELECT value, (row_number() OVER (ORDER BY ts) - 1)::DOUBLE AS pos FROM events)
  SELECT regr_slope(value, pos) AS slope, regr_intercept(value, pos) AS intercept,
  CASE WHEN regr_slope(value, pos) > 0 THEN 'increasing' WHEN regr_slope(value, pos) < 0 THEN 'decreasing' ELSE 'flat' END AS direction,
  CASE WHEN abs(regr_slope(value, pos)) > 0.1 THEN 'strong' WHEN abs(regr_slope(value, pos)) > 0.01 THEN 'moderate' ELSE 'weak' END
  AS strength FROM b""", ["slope", "intercept"], 8))
def q_trend_linear(spark, sf):
    return fin(ST.trend(tbl(spark, sf, "events"), "value", "ts", "linear"), 8)


@register("trend_linear_large_units", rsql("""WITH b AS (SELECT o_totalprice AS value,
  (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::DOUBLE AS pos FROM orders)
  SELECT regr_slope(value, pos) AS slope, regr_intercept(value, pos) AS intercept,
  CASE WHEN regr_slope(value, pos) > 0 THEN 'increasing' WHEN regr_slope(value, pos) < 0 THEN 'decreasing' ELSE 'flat' END AS direction,
  CASE WHEN abs(regr_slope(value, pos)) > 0.1 THEN 'strong' WHEN abs(regr_slope(value, pos)) > 0.01 THEN 'moderate' ELSE 'weak' END
  AS strength FROM b""", ["slope", "intercept"], 6))
def q_trend_linear_large_units(spark, sf):
    return fin(ST.trend(tbl(spark, sf, "orders"), "o_totalprice", ["o_orderdate", "o_orderkey"], "linear"), 6)


@register("trend_exponential", rsql("""WITH b AS (SELECT o_totalprice AS y, (row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1)::DOUBLE AS pos FROM orders)
  SELECT 'exponential' AS model, exp(regr_intercept(ln(y), pos)) AS a, regr_slope(ln(y), pos) AS b FROM b""", ["a", "b"], 8))
def q_trend_exponential(spark, sf):
    return fin(ST.trend(tbl(spark, sf, "orders"), "o_totalprice", ["o_orderdate", "o_orderkey"], "exponential"), 8)


@register("trend_polynomial")
def q_trend_polynomial(spark, sf):
    return fin(ST.trend(tbl(spark, sf, "events"), "value", "ts", "polynomial", degree=3), 12)


@register("lowess")
def q_lowess(spark, sf):
    return fin(ST.lowess(tbl(spark, sf, "orders"), "o_custkey", "o_totalprice", 0.1, anchors=30))


# ---- time series -------------------------------------------------------------------------------
@register("seasonal_decompose", rsql("""WITH b AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value AS observed FROM events),
  t AS (SELECT idx, observed, CASE WHEN count(observed) OVER w = 13 THEN (sum(observed) OVER w
        - 0.5 * (first_value(observed) OVER w + last_value(observed) OVER w)) / 12 END AS trend FROM b
        WINDOW w AS (ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
  s AS (SELECT idx % 12 AS pos, avg(observed - trend) AS sm FROM t GROUP BY 1),
  c AS (SELECT pos, sm - (SELECT avg(sm) FROM s) AS seasonal FROM s)
  SELECT idx AS "index", observed, trend, seasonal, observed - trend - seasonal AS resid FROM t JOIN c ON t.idx % 12 = c.pos""",
                                     ["trend", "seasonal", "resid"]))
def q_seasonal_decompose(spark, sf):
    return fin(TS.seasonal_decompose(tbl(spark, sf, "events"), "value", "event_id", 12))


@register("seasonal_decompose_multiplicative", rsql("""WITH b AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value AS observed FROM events),
  t AS (SELECT idx, observed, CASE WHEN count(observed) OVER w = 7 THEN sum(observed) OVER w / 7 END AS trend FROM b
        WINDOW w AS (ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)),
  s AS (SELECT idx % 7 AS pos, avg(observed / trend) AS sm FROM t GROUP BY 1),
  c AS (SELECT pos, sm / (SELECT avg(sm) FROM s) AS seasonal FROM s)
  SELECT idx AS "index", observed, trend, seasonal, observed / trend / seasonal AS resid FROM t JOIN c ON t.idx % 7 = c.pos""",
                                                    ["trend", "seasonal", "resid"]))
def q_seasonal_decompose_multiplicative(spark, sf):
    return fin(TS.seasonal_decompose(tbl(spark, sf, "events"), "value", "event_id", 7, "multiplicative"))


def _acf_sql(lags):
    lagcols = ", ".join(f"lag(d, {k}) OVER (ORDER BY event_id) AS l{k}" for k in range(1, lags + 1))
    rows = ["SELECT 0::INTEGER AS lag, sum(d * d) / sum(d * d) AS acf, 1.96 / sqrt(count(*)) AS bound FROM l"]
    rows += [f"SELECT {k}::INTEGER, sum(d * l{k}) / sum(d * d), 1.96 / sqrt(count(*)) FROM l" for k in range(1, lags + 1)]
    return rsql(f"""WITH b AS (SELECT event_id, value - (SELECT avg(value) FROM events) AS d FROM events),
  l AS (SELECT d, {lagcols} FROM b) """ + " UNION ALL ".join(rows), ["acf", "bound"])


@register("acf", _acf_sql(20))
def q_acf(spark, sf):
    return fin(TS.acf(tbl(spark, sf, "events"), "value", "event_id", 20))


def _pacf_sql(lags):
    lagcols = ", ".join(f"lag(d, {k}) OVER (ORDER BY event_id) AS l{k}" for k in range(1, lags + 1))
    gam = ", ".join([f"sum(d * d) / count(*) AS g0"] +
                    [f"sum(d * l{k}) / (count(*) - {k}) AS g{k}" for k in range(1, lags + 1)])
    rho = ", ".join(f"g{k} / g0" for k in range(1, lags + 1))
    return rsql(f"""WITH RECURSIVE b AS (SELECT event_id, value - (SELECT avg(value) FROM events) AS d FROM events),
  l AS (SELECT d, {lagcols} FROM b),
  g AS (SELECT {gam}, count(*) AS n FROM l),
  r AS (SELECT [{rho}] AS rho, n FROM g),
  dl AS (SELECT 1 AS k, [rho[1]] AS phi, rho[1] AS pkk, rho, n FROM r
         UNION ALL
         SELECT k + 1, list_concat(list_transform(phi, lambda x, j: x - p * phi[k + 1 - j]), [p]), p, rho, n
         FROM (SELECT *, (rho[k + 1] - list_sum(list_transform(phi, lambda x, j: x * rho[k + 1 - j])))
                         / (1 - list_sum(list_transform(phi, lambda x, j: x * rho[j]))) AS p FROM dl WHERE k < {lags}) AS s)
  SELECT 0::INTEGER AS lag, 1.0::DOUBLE AS pacf, 1.96 / sqrt((SELECT n FROM r)) AS bound
  UNION ALL SELECT k::INTEGER, pkk, 1.96 / sqrt(n) FROM dl""", ["pacf", "bound"])


@register("pacf", _pacf_sql(10))
def q_pacf(spark, sf):
    return fin(TS.pacf(tbl(spark, sf, "events"), "value", "event_id", 10))


@register("adf")
def q_adf(spark, sf):
    return fin(TS.adf(tbl(spark, sf, "events"), "value", "event_id"))


@register("seasonality_weekday", rsql("""WITH u AS (SELECT unnest(generate_series(0, 6))::INTEGER AS unit),
  g AS (SELECT (isodow(ts) - 1)::INTEGER AS unit, avg(value) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS mn,
        max(value) AS mx, stddev_samp(value) AS sd, count(value) AS cnt FROM events GROUP BY 1)
  SELECT u.unit, coalesce(mean, 0.0) AS mean, coalesce(median, 0.0) AS median, coalesce(mn, 0.0) AS "min",
    coalesce(mx, 0.0) AS "max", coalesce(sd, 0.0) AS std, coalesce(cnt, 0)::BIGINT AS "count" FROM u LEFT JOIN g USING (unit)""",
                                      ["mean", "median", "min", "max", "std"]))
def q_seasonality_weekday(spark, sf):
    return fin(TS.seasonality(tbl(spark, sf, "events"), "ts", "value", "weekday"))


@register("seasonality_month", rsql("""WITH u AS (SELECT unnest(generate_series(1, 12))::INTEGER AS unit),
  g AS (SELECT month(o_orderdate)::INTEGER AS unit, avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.5) AS median,
        min(o_totalprice) AS mn, max(o_totalprice) AS mx, stddev_samp(o_totalprice) AS sd, count(o_totalprice) AS cnt FROM orders GROUP BY 1)
  SELECT u.unit, coalesce(mean, 0.0) AS mean, coalesce(median, 0.0) AS median, coalesce(mn, 0.0) AS "min",
    coalesce(mx, 0.0) AS "max", coalesce(sd, 0.0) AS std, coalesce(cnt, 0)::BIGINT AS "count" FROM u LEFT JOIN g USING (unit)""",
                                    ["mean", "median", "min", "max", "std"], 4))
def q_seasonality_month(spark, sf):
    return fin(TS.seasonality(tbl(spark, sf, "orders"), "o_orderdate", "o_totalprice", "month"), 4)


@register("seasonality_quarter", rsql("""WITH u AS (SELECT unnest(generate_series(1, 4))::INTEGER AS unit),
  g AS (SELECT quarter(o_orderdate)::INTEGER AS unit, avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.5) AS median,
        min(o_totalprice) AS mn, max(o_totalprice) AS mx, stddev_samp(o_totalprice) AS sd, count(o_totalprice) AS cnt FROM orders GROUP BY 1)
  SELECT u.unit, coalesce(mean, 0.0) AS mean, coalesce(median, 0.0) AS median, coalesce(mn, 0.0) AS "min",
    coalesce(mx, 0.0) AS "max", coalesce(sd, 0.0) AS std, coalesce(cnt, 0)::BIGINT AS "count" FROM u LEFT JOIN g USING (unit)""",
                                    ["mean", "median", "min", "max", "std"], 4))
def q_seasonality_quarter(spark, sf):
    return fin(TS.seasonality(tbl(spark, sf, "orders"), "o_orderdate", "o_totalprice", "quarter"), 4)


@register("seasonality_year", rsql("""WITH u AS (SELECT unnest(generate_series((SELECT min(year(o_orderdate)) FROM orders), (SELECT max(year(o_orderdate)) FROM orders)))::INTEGER AS unit),
  g AS (SELECT year(o_orderdate)::INTEGER AS unit, avg(o_totalprice) AS mean, quantile_cont(o_totalprice, 0.5) AS median,
        min(o_totalprice) AS mn, max(o_totalprice) AS mx, stddev_samp(o_totalprice) AS sd, count(o_totalprice) AS cnt FROM orders GROUP BY 1)
  SELECT u.unit, coalesce(mean, 0.0) AS mean, coalesce(median, 0.0) AS median, coalesce(mn, 0.0) AS "min",
    coalesce(mx, 0.0) AS "max", coalesce(sd, 0.0) AS std, coalesce(cnt, 0)::BIGINT AS "count" FROM u LEFT JOIN g USING (unit)""",
                                    ["mean", "median", "min", "max", "std"], 4))
def q_seasonality_year(spark, sf):
    return fin(TS.seasonality(tbl(spark, sf, "orders"), "o_orderdate", "o_totalprice", "year"), 4)


@register("seasonality_grid", rsql("""SELECT year(o_orderdate)::INTEGER AS "year", month(o_orderdate)::INTEGER AS "month",
  avg(o_totalprice) AS mean FROM orders GROUP BY 1, 2""", ["mean"], 4))
def q_seasonality_grid(spark, sf):
    return fin(TS.seasonality_grid(tbl(spark, sf, "orders"), "o_orderdate", "o_totalprice", "year", "month"), 4)


@register("seasonality_grid_week", rsql("""SELECT weekofyear(ts)::INTEGER AS week, (isodow(ts) - 1)::INTEGER AS weekday,
  avg(value) AS mean FROM events GROUP BY 1, 2""", ["mean"]))
def q_seasonality_grid_week(spark, sf):
    return fin(TS.seasonality_grid(tbl(spark, sf, "events"), "ts", "value", "week", "weekday"))


@register("correlation_kendall", rsql("""WITH d AS (SELECT c_acctbal AS x, c_nationkey::DOUBLE AS y, c_custkey AS id FROM customer),
  p AS (SELECT sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM d AS a JOIN d AS b ON a.id < b.id)
  SELECT (count_if(sx * sy > 0) - count_if(sx * sy < 0)) / sqrt((count(*) - count_if(sx = 0)) * (count(*) - count_if(sy = 0))) AS tau,
    (SELECT count(*) FROM d) AS n, (count_if(sx * sy > 0) - count_if(sx * sy < 0))::DOUBLE AS s FROM p""", ["tau", "s"]))
def q_correlation_kendall(spark, sf):
    # the oracle enumerates all pairs (fine for the customer table); the Spark side never does
    return fin(ST.kendall_tau(tbl(spark, sf, "customer"), "c_acctbal", "c_nationkey", blocks=4))


@register("adf_differenced")
def q_adf_differenced(spark, sf):
    return fin(TS.adf(tbl(spark, sf, "events"), "value", "event_id", diff=1))


@register("decomposition_components", rsql("""WITH b AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS idx, value AS observed FROM events),
  t AS (SELECT idx, observed, CASE WHEN count(observed) OVER w = 13 THEN (sum(observed) OVER w
        - 0.5 * (first_value(observed) OVER w + last_value(observed) OVER w)) / 12 END AS trend FROM b
        WINDOW w AS (ORDER BY idx ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)),
  s AS (SELECT idx % 12 AS pos, avg(observed - trend) AS sm FROM t GROUP BY 1),
  c AS (SELECT pos, sm - (SELECT avg(sm) FROM s) AS seasonal FROM s),
  d AS (SELECT observed, trend, seasonal, observed - trend - seasonal AS resid FROM t JOIN c ON t.idx % 12 = c.pos)
  SELECT 'observed' AS component, avg(observed) AS mean, stddev_samp(observed) AS std, min(observed) AS "min", max(observed) AS "max" FROM d
  UNION ALL SELECT 'trend', avg(trend), stddev_samp(trend), min(trend), max(trend) FROM d
  UNION ALL SELECT 'seasonal', avg(seasonal), stddev_samp(seasonal), min(seasonal), max(seasonal) FROM d
  UNION ALL SELECT 'resid', avg(resid), stddev_samp(resid), min(resid), max(resid) FROM d""", ["mean", "std", "min", "max"], 5))
def q_decomposition_components(spark, sf):
    return fin(TS.component_summary(TS.seasonal_decompose(tbl(spark, sf, "events"), "value", "event_id", 12)), 5)



def _poly_sql(cs, u):
    return " + ".join(f"{cf!r} * power({u}, {i})" for i, cf in enumerate(cs))


def _shapiro_sql(table, col):
    from tessera.functions import special as SP
    ppf = _norm_ppf_sql("((r + 1 - 0.375) / (n + 0.25))")
    return rsql(f"""WITH b AS (SELECT {col} AS x, row_number() OVER (ORDER BY {col}) - 1 AS r, count(*) OVER () AS n
  FROM {table} WHERE {col} IS NOT NULL),
  m AS (SELECT x, r, n, {ppf} AS mi FROM b),
  t AS (SELECT sum(mi * mi) AS mm, max(mi) AS mn, max(CASE WHEN r = n - 2 THEN mi END) AS mn1, any_value(n) AS nn,
        avg(x) AS mean FROM m),
  w AS (SELECT *, mn / sqrt(mm) + ({_poly_sql(SP.SW_A_N, "1 / sqrt(nn)")}) AS an,
        mn1 / sqrt(mm) + ({_poly_sql(SP.SW_A_N1, "1 / sqrt(nn)")}) AS an1 FROM t),
  ph AS (SELECT *, (mm - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * an * an - 2 * an1 * an1) AS phi FROM w)
  SELECT 'Shapiro-Wilk' AS test, power(sum(CASE WHEN r = n - 1 THEN an WHEN r = 0 THEN -an WHEN r = n - 2 THEN an1
    WHEN r = 1 THEN -an1 ELSE mi / sqrt(phi) END * x), 2) / sum((x - mean) * (x - mean)) AS statistic, any_value(n) AS n
  FROM m, ph""", ["statistic"])


@register("shapiro_w_statistic", _shapiro_sql("customer", "c_acctbal"))
def q_shapiro_w_statistic(spark, sf):
    # the W statistic is checked by DuckDB; its p-value (normal tail) by pytest
    return fin(ST.shapiro(tbl(spark, sf, "customer"), "c_acctbal").select("test", "statistic", "n"))



def _erfc_sql(x):
    from tessera.functions import exprs as X
    z = f"abs({x})"
    t = f"(1.0 / (1.0 + 0.5 * {z}))"
    poly = repr(X._ERFC[-1])
    for cf in reversed(X._ERFC[:-1]):
        poly = f"(({poly}) * {t} + {cf!r})"
    ans = f"({t} * exp(-{z} * {z} + {poly}))"
    return f"(CASE WHEN {x} >= 0 THEN {ans} ELSE 2.0 - {ans} END)"


def _ncdf_sql(x):
    return f"(0.5 * {_erfc_sql(f'(-({x}) / sqrt(2.0))')})"


def _kolmogorov_sql(d, n):
    lam = f"((sqrt({n}) + 0.12 + 0.11 / sqrt({n})) * {d})"
    terms = " + ".join(f"{2.0 * (-1) ** (j - 1)!r} * exp({-2.0 * j * j!r} * {lam} * {lam})" for j in range(1, 41))
    return f"(CASE WHEN {lam} < 0.001 THEN 1.0 ELSE greatest(0.0, least(1.0, {terms})) END)"


def _fit_sql(dist):
    cdf = {"normal": _ncdf_sql("(x - p1) / p2"), "exponential": "CASE WHEN x > 0 THEN 1 - exp(-x / p1) ELSE 0.0 END",
           "uniform": "least(greatest((x - p1) / p2, 0.0), 1.0)",
           "lognormal": f"CASE WHEN x > 0 THEN {_ncdf_sql('(ln(x) - p1) / p2')} ELSE 0.0 END"}[dist]
    logpdf = {"normal": "-0.5 * ln(2 * pi()) - ln(p2) - 0.5 * power((x - p1) / p2, 2)",
              "exponential": "-ln(p1) - x / p1",
              "uniform": "CASE WHEN x >= p1 AND x <= p1 + p2 THEN -ln(p2) END",
              "lognormal": "-ln(x) - ln(p2) - 0.5 * ln(2 * pi()) - 0.5 * power((ln(x) - p1) / p2, 2)"}[dist]
    params = {"normal": "avg(x) AS p1, stddev_pop(x) AS p2", "exponential": "avg(x) AS p1, NULL::DOUBLE AS p2",
              "uniform": "min(x) AS p1, max(x) - min(x) AS p2", "lognormal": "avg(ln(x)) AS p1, stddev_pop(ln(x)) AS p2"}[dist]
    k = 1 if dist == "exponential" else 2
    return f"""SELECT '{dist}' AS distribution, p1, p2, ks, {_kolmogorov_sql('ks', 'n')} AS p_value,
    2 * {k} - 2 * ll AS aic, {k} * ln(n) - 2 * ll AS bic, ll AS loglik FROM (
    SELECT any_value(p1) AS p1, any_value(p2) AS p2, any_value(n) AS n,
      max(greatest((r + 1.0) / n - ({cdf}), ({cdf}) - r * 1.0 / n)) AS ks, sum({logpdf}) AS ll
    FROM (SELECT x, row_number() OVER (ORDER BY x) - 1 AS r FROM b), (SELECT {params}, count(*) AS n FROM b))"""


_FIT_DISTS = ["normal", "lognormal", "exponential", "uniform"]


@register("fit_closed_form", rsql("WITH b AS (SELECT value AS x FROM events WHERE value IS NOT NULL) " +
                                  " UNION ALL ".join(_fit_sql(d) for d in _FIT_DISTS),
                                  ["p1", "p2", "ks", "p_value", "aic", "bic", "loglik"], 5))
def q_fit_closed_form(spark, sf):
    out = ST.fit_distributions(tbl(spark, sf, "events"), "value", _FIT_DISTS).select(
        "distribution", F.col("params")[0].alias("p1"), F.try_element_at("params", F.lit(2)).alias("p2"),
        "ks", "p_value", "aic", "bic", "loglik")
    return fin(out, 5)


def _kendall_test_sql():
    tau = "(count_if(sx * sy > 0) - count_if(sx * sy < 0)) / sqrt((count(*) - count_if(sx = 0)) * (count(*) - count_if(sy = 0)))"
    return rsql(f"""WITH d AS (SELECT c_acctbal AS x, c_nationkey::DOUBLE AS y, c_custkey AS id FROM customer),
  p AS (SELECT sign(a.x - b.x) AS sx, sign(a.y - b.y) AS sy FROM d AS a JOIN d AS b ON a.id < b.id),
  k AS (SELECT {tau} AS tau, (SELECT count(*) FROM d) AS n FROM p),
  sm AS (SELECT count_if(sx * sy > 0) - count_if(sx * sy < 0) AS s FROM p),
  tx AS (SELECT coalesce(sum(t * (t - 1.0) / 2), 0) AS t2, coalesce(sum(t * (t - 1.0) * (t - 2)), 0) AS t0,
    coalesce(sum(t * (t - 1.0) * (2 * t + 5)), 0) AS t1 FROM (SELECT count(*) AS t FROM d GROUP BY x)),
  ty AS (SELECT coalesce(sum(t * (t - 1.0) / 2), 0) AS t2, coalesce(sum(t * (t - 1.0) * (t - 2)), 0) AS t0,
    coalesce(sum(t * (t - 1.0) * (2 * t + 5)), 0) AS t1 FROM (SELECT count(*) AS t FROM d GROUP BY y)),
  z AS (SELECT tau, n, s / sqrt((n * (n - 1.0) * (2 * n + 5) - tx.t1 - ty.t1) / 18 + 2 * tx.t2 * ty.t2 / (n * (n - 1.0))
    + tx.t0 * ty.t0 / (9 * n * (n - 1.0) * (n - 2))) AS z FROM k, sm, tx, ty),
  pv AS (SELECT *, {_erfc_sql('(abs(z) / sqrt(2.0))')} AS p FROM z)
  SELECT 'kendall correlation' AS test, tau AS statistic, p AS p_value, NULL::DOUBLE AS dof, n, 0.05 AS alpha,
    p < 0.05 AS reject, tau * tau AS effect,
    CASE WHEN abs(tau) >= 0.7 THEN 'strong' WHEN abs(tau) >= 0.3 THEN 'moderate' ELSE 'weak' END
      || CASE WHEN tau >= 0 THEN ' positive' ELSE ' negative' END AS label, z AS t FROM pv""",
                ["statistic", "p_value", "effect", "t", "alpha"])


@register("correlation_test_kendall", _kendall_test_sql())
def q_correlation_test_kendall(spark, sf):
    return fin(ST.correlation_test(tbl(spark, sf, "customer"), "c_acctbal", "c_nationkey", "kendall"))
