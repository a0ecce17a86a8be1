"""Registry: numeric transforms (NUM*), arithmetic (MTH*), interactions (FEA1, FEA4, COL10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import numeric as N
from tessera.registry.base import ORDERS_NULLS, fin, orders_nulls, register, rsql, tbl

ON = ORDERS_NULLS + " AS o"


@register("standardize", rsql("""SELECT c_custkey, coalesce((c_acctbal - (SELECT avg(c_acctbal) FROM customer))
  / (SELECT CASE WHEN stddev_pop(c_acctbal) = 0 THEN 1.0 ELSE stddev_pop(c_acctbal) END FROM customer), 0.0)
  AS c_acctbal FROM customer""", ["c_acctbal"]))
def q_standardize(spark, sf):
    return fin(N.standardize(tbl(spark, sf, "customer"), "c_acctbal").select("c_custkey", "c_acctbal"))


@register("min_max", rsql(f"""WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b, avg(o_totalprice) AS m
  FROM {ON}), r AS (SELECT a, m, CASE WHEN b = a THEN 1.0 ELSE b - a END AS rng FROM s)
  SELECT o_orderkey, coalesce((o_totalprice - r.a) / r.rng, (r.m - r.a) / r.rng) AS o_totalprice FROM {ON}, r""",
                          ["o_totalprice"]))
def q_min_max(spark, sf):
    return fin(N.min_max(orders_nulls(spark, sf), "o_totalprice").select("o_orderkey", "o_totalprice"))


@register("robust_scale", rsql(f"""WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1,
  quantile_cont(o_totalprice, 0.5) AS q2, quantile_cont(o_totalprice, 0.75) AS q3 FROM {ON})
  SELECT o_orderkey, coalesce((o_totalprice - q.q2) / CASE WHEN q.q3 = q.q1 THEN 1.0 ELSE q.q3 - q.q1 END, 0.0)
  AS o_totalprice FROM {ON}, q""", ["o_totalprice"]))
def q_robust_scale(spark, sf):
    return fin(N.robust_scale(orders_nulls(spark, sf), "o_totalprice").select("o_orderkey", "o_totalprice"))


_SHIFT_LE = "(SELECT CASE WHEN min(c_acctbal) <= 0 THEN abs(min(c_acctbal)) + 1 ELSE 0.0 END FROM customer)"
_SHIFT_LT = "(SELECT CASE WHEN min(c_acctbal) < 0 THEN abs(min(c_acctbal)) + 1 ELSE 0.0 END FROM customer)"


@register("log_transform", rsql(f"""SELECT c_custkey, CASE WHEN c_acctbal + {_SHIFT_LE} > 0
  THEN ln(c_acctbal + {_SHIFT_LE}) END AS c_acctbal FROM customer""", ["c_acctbal"]))
def q_log_transform(spark, sf):
    return fin(N.log_transform(tbl(spark, sf, "customer"), "c_acctbal").select("c_custkey", "c_acctbal"))


@register("sqrt_transform", rsql(f"""SELECT c_custkey, sqrt(c_acctbal + {_SHIFT_LT}) AS c_acctbal FROM customer""",
                                 ["c_acctbal"]))
def q_sqrt_transform(spark, sf):
    return fin(N.sqrt_transform(tbl(spark, sf, "customer"), "c_acctbal").select("c_custkey", "c_acctbal"))


@register("exp_transform", rsql("SELECT l_orderkey, l_linenumber, l_partkey, exp(l_discount) AS l_discount FROM lineitem",
                                ["l_discount"]))
def q_exp_transform(spark, sf):
    return fin(N.exp_transform(tbl(spark, sf, "lineitem"), "l_discount")
               .select("l_orderkey", "l_linenumber", "l_partkey", "l_discount"))


@register("power_transform", rsql("""SELECT l_orderkey, l_linenumber, l_partkey, pow(l_quantity, 2.0) AS sq,
  pow(l_quantity, 0.5) AS root FROM lineitem""", ["sq", "root"]))
def q_power_transform(spark, sf):
    li = tbl(spark, sf, "lineitem")
    d = N.power_transform(li, "l_quantity", 2, out="sq")
    d = N.power_transform(d, "l_quantity", 0.5, out="root")
    return fin(d.select("l_orderkey", "l_linenumber", "l_partkey", "sq", "root"))


@register("normalize_sum", rsql("""SELECT o_orderkey, o_totalprice / (SELECT sum(o_totalprice) FROM orders) * 1e6
  AS share_ppm FROM orders""", ["share_ppm"]))
def q_normalize_sum(spark, sf):
    d = N.normalize_sum(tbl(spark, sf, "orders"), "o_totalprice", out="share")
    return fin(d.select("o_orderkey", (F.col("share") * 1e6).alias("share_ppm")))


@register("bin_equal_width", rsql("""WITH s AS (SELECT min(l_extendedprice) AS a, max(l_extendedprice) AS b FROM lineitem),
  e AS (SELECT a - (b - a) * 0.001 AS e0, a, (b - a) / 10 AS st, b FROM s),
  x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice AS v,
    (CASE WHEN l_extendedprice > a + st * 1 THEN 1 ELSE 0 END + CASE WHEN l_extendedprice > a + st * 2 THEN 1 ELSE 0 END +
     CASE WHEN l_extendedprice > a + st * 3 THEN 1 ELSE 0 END + CASE WHEN l_extendedprice > a + st * 4 THEN 1 ELSE 0 END +
     CASE WHEN l_extendedprice > a + st * 5 THEN 1 ELSE 0 END + CASE WHEN l_extendedprice > a + st * 6 THEN 1 ELSE 0 END +
     CASE WHEN l_extendedprice > a + st * 7 THEN 1 ELSE 0 END + CASE WHEN l_extendedprice > a + st * 8 THEN 1 ELSE 0 END +
     CASE WHEN l_extendedprice > a + st * 9 THEN 1 ELSE 0 END)::INTEGER AS bin, e0, a, st, b FROM lineitem, e)
  SELECT l_orderkey, l_linenumber, l_partkey, bin AS price_bin,
    CASE WHEN bin = 0 THEN e0 ELSE a + st * bin END AS price_bin_lower,
    CASE WHEN bin = 9 THEN b ELSE a + st * (bin + 1) END AS price_bin_upper FROM x""",
                                  ["price_bin_lower", "price_bin_upper"]))
def q_bin_equal_width(spark, sf):
    d = N.bin_equal_width(tbl(spark, sf, "lineitem"), "l_extendedprice", 10, out="price_bin")
    return fin(d.select("l_orderkey", "l_linenumber", "l_partkey", "price_bin", "price_bin_lower", "price_bin_upper"))


@register("bin_quantile", rsql("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.0) AS e0, quantile_cont(o_totalprice, 0.25) AS e1,
  quantile_cont(o_totalprice, 0.5) AS e2, quantile_cont(o_totalprice, 0.75) AS e3, quantile_cont(o_totalprice, 1.0) AS e4
  FROM orders), x AS (SELECT o_orderkey, (CASE WHEN o_totalprice > e1 THEN 1 ELSE 0 END
  + CASE WHEN o_totalprice > e2 THEN 1 ELSE 0 END + CASE WHEN o_totalprice > e3 THEN 1 ELSE 0 END)::INTEGER AS b,
  e0, e1, e2, e3, e4 FROM orders, q)
  SELECT o_orderkey, b AS quartile, [e0, e1, e2, e3][b + 1] AS quartile_lower, [e1, e2, e3, e4][b + 1] AS quartile_upper FROM x""",
                               ["quartile_lower", "quartile_upper"]))
def q_bin_quantile(spark, sf):
    d = N.bin_quantile(tbl(spark, sf, "orders"), "o_totalprice", 4, out="quartile")
    return fin(d.select("o_orderkey", "quartile", "quartile_lower", "quartile_upper"))


@register("bin_kmeans")
def q_bin_kmeans(spark, sf):
    return N.bin_kmeans(tbl(spark, sf, "orders"), "o_totalprice", 4, out="cluster").select("o_orderkey", "cluster")


def _boxcox_sql(rounds=4, points=41):
    t = "CASE WHEN abs(g.lam) < 1e-12 THEN ln(y.y) ELSE (pow(y.y, g.lam) - 1) / g.lam END"
    ctes = [f"y AS (SELECT c_acctbal + {_SHIFT_LE} AS y FROM customer WHERE c_acctbal IS NOT NULL)",
            "st AS (SELECT count(*) AS n, sum(ln(y)) AS sl FROM y)",
            "r0 AS (SELECT -5.0::DOUBLE AS lo, 5.0::DOUBLE AS hi)"]
    for r in range(rounds):
        ctes.append(f"g{r} AS (SELECT lo + (hi - lo) * i / {float(points - 1)} AS lam FROM r{r}, "
                    f"(SELECT unnest(generate_series(0, {points - 1})) AS i))")
        ctes.append(f"""a{r} AS (SELECT g.lam, sum({t}) AS s, sum(({t}) * ({t})) AS q FROM g{r} AS g, y GROUP BY g.lam)""")
        ctes.append(f"""s{r} AS (SELECT lam, (lam - 1) * sl - n / 2.0 * ln(q / n - power(s / n, 2)) AS score FROM a{r}, st
          WHERE isfinite(s) AND isfinite(q) AND q / n - power(s / n, 2) > 0)""")
        ctes.append(f"b{r} AS (SELECT lam AS best FROM s{r} ORDER BY score DESC, lam DESC LIMIT 1)")
        ctes.append(f"r{r + 1} AS (SELECT best - (hi - lo) / {float(points - 1)} AS lo, "
                    f"best + (hi - lo) / {float(points - 1)} AS hi FROM b{r}, r{r})")
    last = f"b{rounds - 1}"
    return rsql("WITH " + ",\n  ".join(ctes) + f"""
  SELECT c_custkey, CASE WHEN abs(best) < 1e-12 THEN ln(c_acctbal + {_SHIFT_LE})
    ELSE (pow(c_acctbal + {_SHIFT_LE}, best) - 1) / best END AS bc FROM customer, {last}""", ["bc"])


@register("box_cox", _boxcox_sql())
def q_box_cox(spark, sf):
    return fin(N.box_cox(tbl(spark, sf, "customer"), "c_acctbal", out="bc").select("c_custkey", "bc"))


@register("cumulative_sum", rsql("""SELECT event_id, sum(value) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING
  AND CURRENT ROW) AS cum FROM events""", ["cum"], 4))
def q_cumulative_sum(spark, sf):
    return fin(N.cumulative(tbl(spark, sf, "events"), "value", "sum", "event_id", out="cum").select("event_id", "cum"), 4)


@register("cumulative_product_by_user", rsql("""SELECT event_id, user_id, product(1 + value / 1000) OVER (PARTITION BY user_id
  ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM events""", ["cum"]))
def q_cumulative_product_by_user(spark, sf):
    e = tbl(spark, sf, "events").withColumn("f", 1 + F.col("value") / 1000)
    return fin(N.cumulative(e, "f", "product", "ts", "user_id", out="cum").select("event_id", "user_id", "cum"))


@register("cumulative_max", """SELECT event_id, max(value) OVER (ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING
  AND CURRENT ROW) AS cum FROM events""")
def q_cumulative_max(spark, sf):
    return N.cumulative(tbl(spark, sf, "events"), "value", "max", "ts", out="cum").select("event_id", "cum")


@register("view_transform", rsql("""WITH s AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s, min(c_acctbal) AS a,
  max(c_acctbal) AS b FROM customer)
  SELECT c_custkey, c_acctbal * c_acctbal AS sq, (c_acctbal - m) / s AS z, (c_acctbal - a) / (b - a) AS mm,
    CASE WHEN a > 0 THEN ln(c_acctbal) END AS lg FROM customer, s""", ["sq", "z", "mm", "lg"]))
def q_view_transform(spark, sf):
    d = tbl(spark, sf, "customer")
    for how, out in (("square", "sq"), ("zscore", "z"), ("minmax", "mm"), ("log", "lg")):
        d = N.view_transform(d, "c_acctbal", how, out)
    return fin(d.select("c_custkey", "sq", "z", "mm", "lg"))


@register("transform_preview", rsql("""WITH s AS (SELECT min(c_acctbal) AS a, max(c_acctbal) AS b, avg(c_acctbal) AS m FROM customer),
  t AS (SELECT coalesce((c_acctbal - a) / CASE WHEN b = a THEN 1.0 ELSE b - a END, (m - a) / CASE WHEN b = a THEN 1.0 ELSE b - a END) AS v FROM customer, s)
  SELECT 'before' AS stage, count(c_acctbal) AS "count", avg(c_acctbal) AS mean, stddev_samp(c_acctbal) AS std,
    min(c_acctbal) AS "min", max(c_acctbal) AS "max", count_if(c_acctbal IS NULL)::BIGINT AS missing FROM customer
  UNION ALL SELECT 'after', count(v), avg(v), stddev_samp(v), min(v), max(v), count_if(v IS NULL)::BIGINT FROM t""",
                                    ["mean", "std", "min", "max"]))
def q_transform_preview(spark, sf):
    return fin(N.transform_preview(tbl(spark, sf, "customer"), "c_acctbal", N.min_max))


_L0 = "CASE WHEN l_linenumber = 1 THEN 0 ELSE l_tax END"


def _li_zero(spark, sf):
    li = tbl(spark, sf, "lineitem")
    return li.withColumn("l_tax", F.when(F.col("l_linenumber") == 1, F.lit(0.0)).otherwise(F.col("l_tax")))


@register("arith_ops", rsql(f"""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + {_L0} AS a_add,
  l_quantity - 3 AS a_sub, l_quantity * l_discount AS a_mul,
  CASE WHEN {_L0} = 0 THEN NULL ELSE l_discount / {_L0} END AS a_div,
  CASE WHEN l_quantity - 25 = 0 THEN NULL ELSE (((l_linenumber - 4) % (l_quantity - 25)) + (l_quantity - 25)) % (l_quantity - 25) END AS a_mod,
  ((l_quantity - 25) % 7 + 7) % 7 AS a_mod_const, pow(l_discount + 1, {_L0}) AS a_pow FROM lineitem""",
                            ["a_add", "a_sub", "a_mul", "a_div", "a_mod", "a_mod_const", "a_pow"]))
def q_arith_ops(spark, sf):
    d = _li_zero(spark, sf).withColumns({"q25": F.col("l_quantity") - 25, "ln4": F.col("l_linenumber") - 4,
                                         "d1": F.col("l_discount") + 1})
    d = N.arith(d, "add", "l_quantity", "l_tax", "a_add")
    d = N.arith(d, "subtract", "l_quantity", 3, "a_sub")
    d = N.arith(d, "multiply", "l_quantity", "l_discount", "a_mul")
    d = N.arith(d, "divide", "l_discount", "l_tax", "a_div")
    d = N.arith(d, "modulo", "ln4", "q25", "a_mod")
    d = N.arith(d, "modulo", "q25", 7, "a_mod_const")
    d = N.arith(d, "power", "d1", "l_tax", "a_pow")
    return fin(d.select("l_orderkey", "l_linenumber", "l_partkey", "a_add", "a_sub", "a_mul", "a_div", "a_mod",
                        "a_mod_const", "a_pow"))


@register("unary_ops", rsql("""SELECT c_custkey, abs(c_acctbal) AS u_abs, CASE WHEN c_acctbal > 0 THEN ln(c_acctbal) END AS u_log,
  exp(c_acctbal / 1000) AS u_exp, round_even(c_acctbal / 10, 0) AS u_round, floor(c_acctbal)::DOUBLE AS u_floor,
  ceil(c_acctbal)::DOUBLE AS u_ceil FROM customer""", ["u_abs", "u_log", "u_exp", "u_round", "u_floor", "u_ceil"]))
def q_unary_ops(spark, sf):
    d = tbl(spark, sf, "customer").withColumns({"k": F.col("c_acctbal") / 1000, "t": F.col("c_acctbal") / 10})
    for op, col, out in (("abs", "c_acctbal", "u_abs"), ("log", "c_acctbal", "u_log"), ("exp", "k", "u_exp"),
                         ("round", "t", "u_round"), ("floor", "c_acctbal", "u_floor"), ("ceil", "c_acctbal", "u_ceil")):
        d = N.unary(d, op, col, out)
    return fin(d.select("c_custkey", "u_abs", "u_log", "u_exp", "u_round", "u_floor", "u_ceil"))


@register("interaction_features", rsql(f"""SELECT l_orderkey, l_linenumber, l_partkey,
  l_quantity * l_extendedprice * l_discount AS f_prod, l_quantity + l_extendedprice + l_discount AS f_sum,
  l_extendedprice - l_quantity AS f_diff, CASE WHEN {_L0} = 0 THEN NULL ELSE l_discount / {_L0} END AS f_ratio
  FROM lineitem""", ["f_prod", "f_sum", "f_diff", "f_ratio"]))
def q_interaction_features(spark, sf):
    d = _li_zero(spark, sf)
    d = N.interaction(d, ["l_quantity", "l_extendedprice", "l_discount"], "product", "f_prod")
    d = N.interaction(d, ["l_quantity", "l_extendedprice", "l_discount"], "sum", "f_sum")
    d = N.interaction(d, ["l_extendedprice", "l_quantity"], "difference", "f_diff")
    d = N.interaction(d, ["l_discount", "l_tax"], "ratio", "f_ratio")
    return fin(d.select("l_orderkey", "l_linenumber", "l_partkey", "f_prod", "f_sum", "f_diff", "f_ratio"))


@register("ratio_zero_rules", rsql(f"""SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN {_L0} = 0 THEN NULL ELSE l_discount / {_L0} END AS r_null,
  l_discount / CASE WHEN {_L0} = 0 THEN 1e-6 ELSE {_L0} END AS r_replace,
  l_discount / ({_L0} + 1e-6) AS r_add FROM lineitem""", ["r_null", "r_replace", "r_add"], 3))
def q_ratio_zero_rules(spark, sf):
    d = _li_zero(spark, sf)
    d = N.ratio(d, "l_discount", "l_tax", "null", "r_null")
    d = N.ratio(d, "l_discount", "l_tax", "replace", "r_replace")
    d = N.ratio(d, "l_discount", "l_tax", "add", "r_add")
    return fin(d.select("l_orderkey", "l_linenumber", "l_partkey", "r_null", "r_replace", "r_add"), 3)


@register("merge_numeric", rsql(f"""SELECT o_orderkey, coalesce(o_totalprice, 0.0) + coalesce(o_custkey::DOUBLE, 0.0) AS m_sum,
  o_totalprice - o_custkey AS m_sub, coalesce(o_totalprice, 1.0) * coalesce(o_custkey::DOUBLE, 1.0) AS m_prod,
  CASE WHEN o_custkey = 0 THEN NULL ELSE o_totalprice / o_custkey END AS m_div FROM {ON}""",
                                ["m_sum", "m_sub", "m_prod", "m_div"]))
def q_merge_numeric(spark, sf):
    d = orders_nulls(spark, sf)
    for how in ("sum", "subtract", "product", "divide"):
        d = N.merge_numeric(d, ["o_totalprice", "o_custkey"], how, {"sum": "m_sum", "subtract": "m_sub",
                                                                  "product": "m_prod", "divide": "m_div"}[how])
    return fin(d.select("o_orderkey", "m_sum", "m_sub", "m_prod", "m_div"))


@register("box_cox_fixed_lambda", rsql(f"""SELECT c_custkey, (pow(c_acctbal + {_SHIFT_LE}, 0.5) - 1) / 0.5 AS bc FROM customer""",
                                       ["bc"]))
def q_box_cox_fixed_lambda(spark, sf):
    return fin(N.box_cox(tbl(spark, sf, "customer"), "c_acctbal", out="bc", lam=0.5).select("c_custkey", "bc"))
