"""Registry: aggregation (AGG*), group statistics (FEA2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import aggregate as A
from tessera.registry.base import ORDERS_NULLS, fin, orders_nulls, register, rsql, tbl

ON = ORDERS_NULLS + " AS o"


@register("group_agg", rsql("""SELECT l_returnflag, avg(l_extendedprice) AS mean, quantile_cont(l_extendedprice, 0.5) AS median,
  sum(l_extendedprice) AS "sum", count(l_extendedprice) AS "count", stddev_samp(l_extendedprice) AS std,
  min(l_extendedprice) AS "min", max(l_extendedprice) AS "max" FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1""",
                            ["mean", "median", "sum", "std", "min", "max"], 4))
def q_group_agg(spark, sf):
    return fin(A.group_agg(tbl(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"), 4)


@register("group_compare_top", rsql("""SELECT c_nationkey, avg(c_acctbal) AS mean, quantile_cont(c_acctbal, 0.5) AS median,
  stddev_samp(c_acctbal) AS std FROM customer GROUP BY 1 ORDER BY mean DESC, c_nationkey LIMIT 10""",
                                    ["mean", "median", "std"]))
def q_group_compare_top(spark, sf):
    return fin(A.group_agg(tbl(spark, sf, "customer"), "c_nationkey", "c_acctbal", ["mean", "median", "std"], top=10))


@register("column_stat", rsql("""SELECT 'l_quantity' AS column_name, stddev_pop(l_quantity) AS value FROM lineitem
  UNION ALL SELECT 'l_extendedprice', stddev_pop(l_extendedprice) FROM lineitem
  UNION ALL SELECT 'l_discount', stddev_pop(l_discount) FROM lineitem""", ["value"]))
def q_column_stat(spark, sf):
    return fin(A.column_stat(tbl(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], "std"))


@register("column_stat_var_median", rsql("""SELECT 'var' AS stat, 'c_acctbal' AS column_name, var_pop(c_acctbal) AS value FROM customer
  UNION ALL SELECT 'median', 'c_acctbal', quantile_cont(c_acctbal, 0.5) FROM customer""", ["value"], 4))
def q_column_stat_var_median(spark, sf):
    c = tbl(spark, sf, "customer")
    a = A.column_stat(c, ["c_acctbal"], "var").withColumn("stat", F.lit("var"))
    b = A.column_stat(c, ["c_acctbal"], "median").withColumn("stat", F.lit("median"))
    return fin(a.unionByName(b), 4)


@register("metric_cards", rsql("""SELECT 'o_totalprice' AS column_name, 'mean' AS metric, avg(o_totalprice) AS value FROM orders
  UNION ALL SELECT 'o_totalprice', 'median', quantile_cont(o_totalprice, 0.5) FROM orders
  UNION ALL SELECT 'o_totalprice', 'count', count(o_totalprice)::DOUBLE FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'o_totalprice', 'first', arg_min(o_totalprice, o_orderkey) FROM orders
  UNION ALL SELECT 'o_totalprice', 'last', arg_max(o_totalprice, o_orderkey) FROM orders
  UNION ALL SELECT 'o_totalprice', 'at', o_totalprice FROM (SELECT o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) WHERE r = 100""",
                               ["value"], 4))
def q_metric_cards(spark, sf):
    o = tbl(spark, sf, "orders")
    parts = [A.metric(o, "o_totalprice", "mean"), A.metric(o, "o_totalprice", "median"),
             A.metric(o, "o_totalprice", "count", where="o_orderstatus = 'F'"),
             A.metric(o, "o_totalprice", "first", order_by="o_orderkey"),
             A.metric(o, "o_totalprice", "last", order_by="o_orderkey"),
             A.metric(o, "o_totalprice", "at", order_by="o_orderkey", index=100)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return fin(out.drop("formatted"), 4)


@register("metric_formatted", """SELECT 'l_quantity' AS column_name, 'sum' AS metric, format('{:,.2f}', sum(l_quantity)) AS formatted FROM lineitem
  UNION ALL SELECT 'l_discount', 'mean', format('{:.2f}', avg(l_discount) * 100) || '%' FROM lineitem""")
def q_metric_formatted(spark, sf):
    li = tbl(spark, sf, "lineitem")
    a = A.metric(li, "l_quantity", "sum", "number").select("column_name", "metric", "formatted")
    b = A.metric(li.withColumn("l_discount", F.col("l_discount") * 100), "l_discount", "mean", "percent") \
        .select("column_name", "metric", "formatted")
    return a.unionByName(b)


@register("metric_delta", rsql("""WITH x AS (SELECT arg_max(value, event_id) AS cur,
  (SELECT arg_max(value, event_id) FROM events WHERE event_id < (SELECT max(event_id) FROM events)) AS prev,
  arg_min(value, event_id) AS first FROM events)
  SELECT 'previous' AS kind, cur AS current, prev AS reference, cur - prev AS delta, (cur - prev) * 100.0 / abs(prev) AS delta_pct FROM x
  UNION ALL SELECT 'first', cur, first, cur - first, (cur - first) * 100.0 / abs(first) FROM x
  UNION ALL SELECT 'custom', cur, 100.0, cur - 100.0, (cur - 100.0) * 100.0 / 100.0 FROM x""",
                               ["current", "reference", "delta", "delta_pct"]))
def q_metric_delta(spark, sf):
    e = tbl(spark, sf, "events")
    a = A.metric_delta(e, "value", "previous", "event_id").withColumn("kind", F.lit("previous"))
    b = A.metric_delta(e, "value", "first", "event_id").withColumn("kind", F.lit("first"))
    d = A.metric_delta(e, "value", "custom", "event_id", reference=100.0).withColumn("kind", F.lit("custom"))
    return fin(a.unionByName(b).unionByName(d))


@register("metric_delta_period", rsql("""WITH g AS (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v FROM orders GROUP BY 1),
  x AS (SELECT (SELECT v FROM g ORDER BY p DESC LIMIT 1) AS cur,
    (SELECT v FROM g WHERE p = (SELECT max(p) FROM g) - INTERVAL 1 MONTH) AS ref)
  SELECT cur AS current, ref AS reference, cur - ref AS delta, (cur - ref) * 100.0 / abs(ref) AS delta_pct FROM x""",
                                      ["current", "reference", "delta", "delta_pct"], 4))
def q_metric_delta_period(spark, sf):
    return fin(A.metric_delta(tbl(spark, sf, "orders"), "o_totalprice", "period", "o_orderdate", period="MONTH"), 4)


@register("metric_delta_period_gap", rsql("""WITH o AS (SELECT * FROM orders WHERE month(o_orderdate) % 2 = 1),
  g AS (SELECT date_trunc('month', o_orderdate) AS p, sum(o_totalprice) AS v FROM o GROUP BY 1)
  SELECT (SELECT v FROM g ORDER BY p DESC LIMIT 1) AS current,
    (SELECT v FROM g WHERE p = (SELECT max(p) FROM g) - INTERVAL 1 MONTH) AS reference,
    NULL::DOUBLE AS delta, NULL::DOUBLE AS delta_pct""", ["current", "reference", "delta", "delta_pct"], 4))
def q_metric_delta_period_gap(spark, sf):
    """Every other month is empty: the previous calendar month has no value."""
    o = tbl(spark, sf, "orders").where(F.month("o_orderdate") % 2 == 1)
    return fin(A.metric_delta(o, "o_totalprice", "period", "o_orderdate", period="MONTH"), 4)


@register("mean_by_category", rsql("""SELECT o_orderpriority, avg(o_totalprice) AS mean FROM orders GROUP BY 1
  ORDER BY mean DESC LIMIT 10""", ["mean"]))
def q_mean_by_category(spark, sf):
    return fin(A.group_agg(tbl(spark, sf, "orders"), "o_orderpriority", "o_totalprice", ["mean"], top=10))


@register("sum_by_category_top", rsql("""SELECT p_brand, sum(p_retailprice) AS "sum" FROM part GROUP BY 1
  ORDER BY "sum" DESC, p_brand LIMIT 5""", ["sum"], 4))
def q_sum_by_category_top(spark, sf):
    return fin(A.group_agg(tbl(spark, sf, "part"), "p_brand", "p_retailprice", ["sum"], top=5), 4)


@register("top_with_other", rsql("""WITH g AS (SELECT p_brand AS category, sum(p_retailprice) AS total FROM part GROUP BY 1),
  t AS (SELECT category FROM g ORDER BY total DESC, category LIMIT 4)
  SELECT CASE WHEN category IN (SELECT category FROM t) THEN category ELSE 'Other' END AS category, sum(total) AS total
  FROM g GROUP BY 1""", ["total"], 4))
def q_top_with_other(spark, sf):
    return fin(A.top_with_other(tbl(spark, sf, "part"), "p_brand", "p_retailprice", 5), 4)


@register("top_without_other", rsql("""SELECT p_type AS category, sum(p_retailprice) AS total FROM part GROUP BY 1""", ["total"], 4))
def q_top_without_other(spark, sf):
    """As many categories as slices: no "Other" row."""
    return fin(A.top_with_other(tbl(spark, sf, "part"), "p_type", "p_retailprice", 6), 4)


@register("count_2way", """SELECT c_nationkey, c_mktsegment, count(*) AS "count" FROM customer WHERE c_nationkey IN (
  SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 5) GROUP BY 1, 2""")
def q_count_2way(spark, sf):
    return A.count_2way(tbl(spark, sf, "customer"), "c_nationkey", "c_mktsegment", 5)


_SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@register("pivot_mean", rsql("""WITH t AS (SELECT c_nationkey FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_nationkey LIMIT 8)
  SELECT c_nationkey, """ + ", ".join(f"""coalesce(avg(c_acctbal) FILTER (WHERE c_mktsegment = '{s}'), 0.0) AS "{s}" """ for s in _SEGS)
                             + """ FROM customer WHERE c_nationkey IN (SELECT c_nationkey FROM t) GROUP BY 1""", _SEGS))
def q_pivot_mean(spark, sf):
    return fin(A.pivot_mean(tbl(spark, sf, "customer"), "c_nationkey", "c_mktsegment", "c_acctbal", top_rows=8))


@register("pivot_mean_keep_missing", rsql("""SELECT l_returnflag, """ + ", ".join(
    f"""avg(l_quantity) FILTER (WHERE l_linestatus = '{s}') AS "{s}" """ for s in ["F", "O"])
    + """ FROM lineitem GROUP BY 1""", ["F", "O"]))
def q_pivot_mean_keep_missing(spark, sf):
    return fin(A.pivot_mean(tbl(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", "l_quantity", fill=None))


@register("crosstab_counts", """SELECT c_mktsegment, """ + ", ".join(
    f"""count(*) FILTER (WHERE c_nationkey = {n}) AS "{n}" """ for n in range(25)) + """ FROM customer GROUP BY 1""")
def q_crosstab_counts(spark, sf):
    return A.crosstab_wide(tbl(spark, sf, "customer"), "c_mktsegment", "c_nationkey")


@register("crosstab_proportions", rsql("""SELECT quality, toxic, count(*) AS "count",
  count(*) / sum(count(*)) OVER (PARTITION BY quality) AS share FROM labels GROUP BY 1, 2""", ["share"]))
def q_crosstab_proportions(spark, sf):
    return fin(A.crosstab(tbl(spark, sf, "labels"), "quality", "toxic", "index"))


@register("hierarchy_totals", rsql("""SELECT r_name, n_name, c_mktsegment, sum(c_acctbal) AS total,
  (3 - grouping(r_name) - grouping(n_name) - grouping(c_mktsegment))::INTEGER AS level
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  GROUP BY ROLLUP (r_name, n_name, c_mktsegment)""", ["total"], 4))
def q_hierarchy_totals(spark, sf):
    j = tbl(spark, sf, "customer").join(tbl(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")) \
        .join(tbl(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return fin(A.hierarchy_totals(j, ["r_name", "n_name", "c_mktsegment"], "c_acctbal"), 4)


@register("flows", rsql("""WITH b AS (SELECT c_mktsegment AS s, o_orderpriority AS t, o_totalprice AS v
  FROM orders JOIN customer ON o_custkey = c_custkey),
  ts AS (SELECT s FROM b GROUP BY 1 ORDER BY count(*) DESC, s LIMIT 3), tt AS (SELECT t FROM b GROUP BY 1 ORDER BY count(*) DESC, t LIMIT 3),
  g AS (SELECT s AS source, t AS target, sum(v) AS value FROM b WHERE s IN (SELECT s FROM ts) AND t IN (SELECT t FROM tt) GROUP BY 1, 2),
  n AS (SELECT node, (row_number() OVER (ORDER BY node) - 1)::INTEGER AS node_id FROM (SELECT source AS node FROM g UNION SELECT target FROM g))
  SELECT source, target, value, n1.node_id AS source_id, n2.node_id AS target_id FROM g
  JOIN n AS n1 ON g.source = n1.node JOIN n AS n2 ON g.target = n2.node""", ["value"], 2))
def q_flows(spark, sf):
    j = tbl(spark, sf, "orders").join(tbl(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return fin(A.flows(j, "c_mktsegment", "o_orderpriority", "o_totalprice", 3), 2)


@register("funnel", rsql("""WITH g AS (SELECT event_type AS stage, sum(value) AS value FROM events GROUP BY 1),
  p AS (SELECT *, (row_number() OVER (ORDER BY value DESC, stage) - 1)::INTEGER AS position FROM g)
  SELECT stage, value, position, value * 100.0 / (SELECT value FROM p WHERE position = 0) AS pct_of_first FROM p""",
                         ["value", "pct_of_first"], 4))
def q_funnel(spark, sf):
    return fin(A.funnel(tbl(spark, sf, "events"), "event_type", "value"), 4)


@register("funnel_ascending", rsql("""WITH g AS (SELECT event_type AS stage, sum(value) AS value FROM events GROUP BY 1),
  p AS (SELECT *, (row_number() OVER (ORDER BY value, stage) - 1)::INTEGER AS position FROM g)
  SELECT stage, value, position, value * 100.0 / (SELECT value FROM p WHERE position = 0) AS pct_of_first FROM p""",
                                   ["value", "pct_of_first"], 4))
def q_funnel_ascending(spark, sf):
    return fin(A.funnel(tbl(spark, sf, "events"), "event_type", "value", ascending=True), 4)


@register("funnel_user_order", rsql("""WITH g AS (SELECT event_type AS stage, count(*)::DOUBLE AS value FROM events GROUP BY 1),
  p AS (SELECT *, (row_number() OVER (ORDER BY CASE stage WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END,
    stage) - 1)::INTEGER AS position FROM g)
  SELECT stage, value, position, value * 100.0 / (SELECT value FROM p WHERE position = 0) AS pct_of_first FROM p""",
                                    ["value", "pct_of_first"]))
def q_funnel_user_order(spark, sf):
    e = tbl(spark, sf, "events").withColumn("one", F.lit(1.0))
    return fin(A.funnel(e, "event_type", "one", order=["view", "click", "purchase"]))


@register("category_profile", rsql("""SELECT o_orderpriority, avg(o_totalprice) AS o_totalprice, avg(o_custkey) AS o_custkey
  FROM orders WHERE o_orderpriority IN (SELECT o_orderpriority FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3)
  GROUP BY 1""", ["o_totalprice", "o_custkey"]))
def q_category_profile(spark, sf):
    return fin(A.category_profile(tbl(spark, sf, "orders"), "o_orderpriority", ["o_totalprice", "o_custkey"], 3))


@register("surface_grid", rsql("""WITH xs AS (SELECT DISTINCT l_linenumber AS x FROM lineitem), ys AS (SELECT DISTINCT l_returnflag AS y FROM lineitem),
  g AS (SELECT l_linenumber AS x, l_returnflag AS y, avg(l_quantity) AS z FROM lineitem GROUP BY 1, 2)
  SELECT xs.x AS l_linenumber, ys.y AS l_returnflag, coalesce(g.z, 0.0) AS l_quantity FROM xs JOIN ys ON true
  LEFT JOIN g ON g.x = xs.x AND g.y = ys.y""", ["l_quantity"]))
def q_surface_grid(spark, sf):
    return fin(A.surface_grid(tbl(spark, sf, "lineitem"), "l_linenumber", "l_returnflag", "l_quantity"))


@register("waterfall", rsql("""WITH g AS (SELECT CAST(c_nationkey AS VARCHAR) AS category, c_acctbal AS value FROM customer),
  t AS (SELECT * FROM g ORDER BY value DESC, category LIMIT 6)
  SELECT category, value, sum(value) OVER (ORDER BY value DESC, category ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
    false AS is_total FROM t UNION ALL SELECT 'Total', sum(value), sum(value), true FROM t""", ["value", "running"], 4))
def q_waterfall(spark, sf):
    return fin(A.waterfall(tbl(spark, sf, "customer"), "c_nationkey", "c_acctbal", 6), 4)


@register("gauge", rsql("""SELECT avg(l_discount) AS mean, CASE WHEN avg(l_discount) < 0.03 THEN 'low'
  WHEN avg(l_discount) < 0.07 THEN 'medium' ELSE 'high' END AS band FROM lineitem""", ["mean"]))
def q_gauge(spark, sf):
    return fin(A.gauge(tbl(spark, sf, "lineitem"), "l_discount", 0.03, 0.07))


def _box_sql(table, value, by=None, top=None):
    keys = f"{by}, " if by else ""
    grp = f"GROUP BY {by}" if by else ""
    filt = (f"WHERE {by} IN (SELECT {by} FROM {table} GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT {top})" if top else
            (f"WHERE {by} IS NOT NULL" if by else ""))
    join = f"JOIN q USING ({by})" if by else ", q"
    return rsql(f"""WITH b AS (SELECT * FROM {table} {filt}),
  q AS (SELECT {keys}quantile_cont({value}, 0.25) AS q1, quantile_cont({value}, 0.5) AS median,
    quantile_cont({value}, 0.75) AS q3 FROM b {grp})
  SELECT {keys}count({value}) AS "count", min({value}) AS "min", any_value(q1) AS q1, any_value(median) AS median,
    any_value(q3) AS q3, any_value(q3) - any_value(q1) AS iqr,
    min({value}) FILTER (WHERE {value} >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
    max({value}) FILTER (WHERE {value} <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
    count_if({value} < q1 - 1.5 * (q3 - q1) OR {value} > q3 + 1.5 * (q3 - q1))::BIGINT AS outliers, max({value}) AS "max"
  FROM b {join} {grp}""", ["min", "q1", "median", "q3", "iqr", "lower_whisker", "upper_whisker", "max"])


@register("box_stats", _box_sql("events", "value"))
def q_box_stats(spark, sf):
    return fin(A.box_stats(tbl(spark, sf, "events"), "value"))


@register("box_stats_grouped", _box_sql("events", "value", "event_type", 3))
def q_box_stats_grouped(spark, sf):
    return fin(A.box_stats(tbl(spark, sf, "events"), "value", "event_type", top=3))


@register("group_stats_join", rsql("""WITH g AS (SELECT l_returnflag, l_linestatus, avg(l_quantity) AS m,
  quantile_cont(l_quantity, 0.5) AS md, stddev_samp(l_quantity) AS s, count(l_quantity) AS n
  FROM lineitem GROUP BY 1, 2)
  SELECT l_orderkey, l_linenumber, l_partkey, l_returnflag, l_linestatus, m AS l_returnflag_l_linestatus_l_quantity_mean,
    md AS l_returnflag_l_linestatus_l_quantity_median, s AS l_returnflag_l_linestatus_l_quantity_std,
    n AS l_returnflag_l_linestatus_l_quantity_count
  FROM lineitem LEFT JOIN g USING (l_returnflag, l_linestatus)""",
                                   ["l_returnflag_l_linestatus_l_quantity_mean", "l_returnflag_l_linestatus_l_quantity_median",
                                    "l_returnflag_l_linestatus_l_quantity_std"]))
def q_group_stats_join(spark, sf):
    d = A.group_stats(tbl(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity",
                      ["mean", "median", "std", "count"])
    p = "l_returnflag_l_linestatus_l_quantity_"
    return fin(d.select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus",
                        *[p + a for a in ("mean", "median", "std", "count")]))


@register("group_stats_nulls", rsql(f"""WITH g AS (SELECT o_orderpriority, sum(o_totalprice) AS s, max(o_totalprice) AS mx
  FROM {ON} WHERE o_orderpriority IS NOT NULL GROUP BY 1)
  SELECT o_orderkey, o.o_orderpriority, s AS o_orderpriority_o_totalprice_sum, mx AS o_orderpriority_o_totalprice_max
  FROM {ON} LEFT JOIN g ON o.o_orderpriority = g.o_orderpriority""", ["o_orderpriority_o_totalprice_sum",
                                                                       "o_orderpriority_o_totalprice_max"], 4))
def q_group_stats_nulls(spark, sf):
    d = A.group_stats(orders_nulls(spark, sf), "o_orderpriority", "o_totalprice", ["sum", "max"])
    return fin(d.select("o_orderkey", "o_orderpriority", "o_orderpriority_o_totalprice_sum",
                        "o_orderpriority_o_totalprice_max"), 4)
