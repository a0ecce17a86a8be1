"""Registry: feature engineering and models (FEA3, FEA5-12, CLN9)."""

from __future__ import annotations


from tessera.operators import features as FE
from tessera.operators import ml as ML
from tessera.registry.base import ORDERS_NULLS, fin, orders_nulls, register, rsql, tbl

ON = ORDERS_NULLS + " AS o"


@register("polynomial_full", rsql("""SELECT l_orderkey, l_linenumber, l_partkey,
  pow(coalesce(l_quantity, 0.0), 2.0) AS l_quantity_pow_2, coalesce(l_quantity, 0.0) * coalesce(l_discount, 0.0) AS l_quantity_l_discount,
  pow(coalesce(l_discount, 0.0), 2.0) AS l_discount_pow_2, pow(coalesce(l_quantity, 0.0), 3.0) AS l_quantity_pow_3,
  pow(coalesce(l_quantity, 0.0), 2.0) * coalesce(l_discount, 0.0) AS l_quantity_pow_2_l_discount,
  coalesce(l_quantity, 0.0) * pow(coalesce(l_discount, 0.0), 2.0) AS l_quantity_l_discount_pow_2,
  pow(coalesce(l_discount, 0.0), 3.0) AS l_discount_pow_3 FROM lineitem""",
                                  ["l_quantity_pow_2", "l_quantity_l_discount", "l_discount_pow_2", "l_quantity_pow_3",
                                   "l_quantity_pow_2_l_discount", "l_quantity_l_discount_pow_2", "l_discount_pow_3"]))
def q_polynomial_full(spark, sf):
    d = FE.polynomial(tbl(spark, sf, "lineitem"), ["l_quantity", "l_discount"], 3, "full")
    return fin(d.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity_pow_2", "l_quantity_l_discount",
                        "l_discount_pow_2", "l_quantity_pow_3", "l_quantity_pow_2_l_discount",
                        "l_quantity_l_discount_pow_2", "l_discount_pow_3"))


@register("polynomial_interactions", rsql(f"""SELECT o_orderkey, coalesce(o_totalprice, 0.0) * coalesce(o_custkey::DOUBLE, 0.0)
  AS o_totalprice_o_custkey FROM {ON}""", ["o_totalprice_o_custkey"], 2))
def q_polynomial_interactions(spark, sf):
    d = FE.polynomial(orders_nulls(spark, sf), ["o_totalprice", "o_custkey"], 2, "interaction_only")
    return fin(d.select("o_orderkey", "o_totalprice_o_custkey"), 2)


@register("distance_to_reference", rsql("""WITH r AS (SELECT avg(l_quantity) AS a, avg(l_extendedprice) AS b FROM lineitem),
  m AS (SELECT quantile_cont(l_quantity, 0.5) AS a, quantile_cont(l_extendedprice, 0.5) AS b FROM lineitem)
  SELECT l_orderkey, l_linenumber, l_partkey, sqrt(power(l_quantity - r.a, 2) + power(l_extendedprice - r.b, 2)) AS euclid,
    abs(l_quantity - m.a) + abs(l_extendedprice - m.b) AS manhattan,
    1 - (l_quantity * 10 + l_extendedprice * 1) / (sqrt(power(l_quantity, 2) + power(l_extendedprice, 2)) * sqrt(101.0)) AS cosine
  FROM lineitem, r, m""", ["euclid", "manhattan", "cosine"], 4))
def q_distance_to_reference(spark, sf):
    li = tbl(spark, sf, "lineitem")
    cols = ["l_quantity", "l_extendedprice"]
    d = FE.distance_to(li, cols, "euclidean", "mean", "euclid")
    d = FE.distance_to(d, cols, "manhattan", "median", "manhattan")
    d = FE.distance_to(d, cols, "cosine", {"l_quantity": 10, "l_extendedprice": 1}, "cosine")
    return fin(d.select("l_orderkey", "l_linenumber", "l_partkey", "euclid", "manhattan", "cosine"), 4)


@register("formula", rsql("""SELECT o_orderkey, CASE WHEN o_totalprice > (SELECT avg(o_totalprice) FROM orders)
  THEN ln(o_totalprice) ELSE (o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / (SELECT stddev_samp(o_totalprice) FROM orders) END
  AS f FROM orders""", ["f"]))
def q_formula(spark, sf):
    d = FE.formula(tbl(spark, sf, "orders"),
                   "np.where(o_totalprice > mean(o_totalprice), np.log(o_totalprice), "
                   "(o_totalprice - mean(o_totalprice)) / std(o_totalprice))", "f")
    return fin(d.select("o_orderkey", "f"))


@register("pca")
def q_pca(spark, sf):
    rows, ev = FE.pca(tbl(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 2)
    return fin(rows.select("l_orderkey", "l_linenumber", "PC1", "PC2"))


@register("pca_explained_variance")
def q_pca_explained_variance(spark, sf):
    _, ev = FE.pca(tbl(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], 3)
    return fin(ev)


@register("kmeans_clusters")
def q_kmeans_clusters(spark, sf):
    d = ML.cluster(tbl(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], "kmeans", k=4)
    return d.select("c_custkey", "kmeans_cluster")


@register("hierarchical_clusters")
def q_hierarchical_clusters(spark, sf):
    d = ML.cluster(tbl(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], "hierarchical", k=3)
    return d.select("c_custkey", "hierarchical_cluster")


@register("dbscan_clusters")
def q_dbscan_clusters(spark, sf):
    d = ML.dbscan(tbl(spark, sf, "customer"), ["c_acctbal", "c_nationkey"], eps=0.3, min_samples=5, key="c_custkey")
    return d.select("c_custkey", "dbscan_cluster")


@register("isolation_forest")
def q_isolation_forest(spark, sf):
    d = ML.isolation_forest(tbl(spark, sf, "events"), ["value", "user_id"], key="event_id")
    return fin(d.select("event_id", "anomaly_score", "anomaly"))


@register("fill_model_regression")
def q_fill_model_regression(spark, sf):
    d = ML.fill_model(orders_nulls(spark, sf), "o_totalprice", ["o_custkey", "o_orderstatus"], "linear")
    return fin(d.select("o_orderkey", "o_totalprice"))


_LOF_SQL = """WITH r AS (SELECT coalesce(c_acctbal, 0.0) AS a, coalesce(c_nationkey, 0)::DOUBLE AS b FROM customer),
  s AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM r),
  z AS (SELECT row_number() OVER () AS i, c_custkey, (coalesce(c_acctbal, 0.0) - ma) / sa AS x,
    (coalesce(c_nationkey, 0)::DOUBLE - mb) / sb AS y FROM customer, s),
  d AS (SELECT p.i, p.c_custkey, o.i AS j, sqrt(power(p.x - o.x, 2) + power(p.y - o.y, 2)) AS dist, o.x, o.y FROM z p, z o),
  n AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, x, y, i <> j) AS place FROM d QUALIFY place <= 21),
  k AS (SELECT i, max(dist) AS kd FROM n WHERE i <> j GROUP BY i),
  m AS (SELECT n.*, greatest(n.dist, k.kd) AS reach FROM n JOIN k ON k.i = n.j),
  l AS (SELECT i, 1 / (avg(reach) FILTER (i <> j) + 1e-10) AS lrd, 1 / (avg(reach) FILTER (place <= 20) + 1e-10) AS new FROM m GROUP BY i),
  f AS (SELECT m.i, any_value(m.c_custkey) AS c_custkey, avg(o.lrd) / any_value(l.new) AS lof
    FROM m JOIN l o ON o.i = m.j JOIN l ON l.i = m.i WHERE place <= 20 GROUP BY m.i)
  SELECT c_custkey, (lof - min(lof) OVER ()) / (max(lof) OVER () - min(lof) OVER ()) AS anomaly_score FROM f"""


@register("local_outlier_factor", rsql(_LOF_SQL, ["anomaly_score"], 5))
def q_local_outlier_factor(spark, sf):
    d = ML.local_outlier_factor(tbl(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return fin(d.select("c_custkey", "anomaly_score"), 5)


@register("fill_model_neighbours", rsql(f"""WITH o AS (SELECT * FROM {ON}),
  lv AS (SELECT list(DISTINCT o_orderstatus ORDER BY o_orderstatus)[2:] AS levels FROM o WHERE o_totalprice IS NOT NULL AND o_orderstatus IS NOT NULL),
  h AS (SELECT o_orderkey, o_totalprice AS y, coalesce(o_custkey, 0)::DOUBLE AS x,
    list_transform(levels, lambda v: CASE WHEN o_orderstatus = v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS c FROM o, lv),
  p AS (SELECT x, c, count(*) AS m, avg(y) AS y FROM h WHERE y IS NOT NULL GROUP BY x, c),
  q AS (SELECT DISTINCT x, c FROM h WHERE y IS NULL),
  d AS (SELECT q.x, q.c, p.m, p.y, coalesce(sum(p.m) OVER (PARTITION BY q.x, q.c ORDER BY
    power(q.x - p.x, 2) + coalesce(list_sum(list_transform(range(1, len(p.c) + 1), lambda i: power(q.c[i] - p.c[i], 2))), 0.0), p.x, p.c
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM q JOIN p ON true),
  f AS (SELECT x, c, sum(least(m, 5 - before) * y) / sum(least(m, 5 - before)) AS fill FROM d WHERE before < 5 GROUP BY x, c)
  SELECT o_orderkey, coalesce(h.y, f.fill) AS o_totalprice FROM h LEFT JOIN f ON h.x = f.x AND h.c = f.c""", ["o_totalprice"], 4))
def q_fill_model_neighbours(spark, sf):
    d = ML.fill_model(orders_nulls(spark, sf), "o_totalprice", ["o_custkey", "o_orderstatus"], "neighbours")
    return fin(d.select("o_orderkey", "o_totalprice"), 4)


@register("fill_model_tree")
def q_fill_model_tree(spark, sf):
    d = ML.fill_model(orders_nulls(spark, sf), "o_totalprice", ["o_custkey", "o_orderstatus"], "tree")
    return fin(d.select("o_orderkey", "o_totalprice"))


@register("fill_model_forest")
def q_fill_model_forest(spark, sf):
    d = ML.fill_model(orders_nulls(spark, sf), "o_totalprice", ["o_custkey", "o_orderstatus"], "forest")
    return fin(d.select("o_orderkey", "o_totalprice"))
