"""Registry: preview and profiling (PRF*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.registry.base import (EVENTS_OUTLIERS, ORDERS_DUPS, ORDERS_NULLS, events_outliers, fin,
                                   orders_dups, orders_nulls, register, rsql, tbl)

LI_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
          "l_discount", "l_tax"]
ORDERS_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


def _sql_summary(cols, table):
    parts = []
    for x in cols:
        parts.append(f"""SELECT '{x}' AS column_name, count({x})::BIGINT AS "count", avg({x}) AS mean,
  stddev_samp({x}) AS std, min({x})::DOUBLE AS "min", quantile_cont({x}, 0.25) AS q25,
  quantile_cont({x}, 0.5) AS q50, quantile_cont({x}, 0.75) AS q75, max({x})::DOUBLE AS "max",
  quantile_cont({x}, 0.5) AS median, (max({x}) - min({x}))::DOUBLE AS "range",
  count_if({x} IS NULL)::BIGINT AS missing, count_if({x} IS NULL) * 100.0 / count(*) AS missing_pct,
  skewness({x}) AS skew, kurtosis({x}) AS kurtosis FROM {table}""")
    return " UNION ALL ".join(parts)


_SUMMARY_DOUBLES = ["mean", "std", "min", "q25", "q50", "q75", "max", "median", "range", "missing_pct", "skew",
                    "kurtosis"]


@register("summary_statistics", rsql(_sql_summary(LI_NUM, "lineitem"), _SUMMARY_DOUBLES))
def q_summary_statistics(spark, sf):
    return fin(P.summary_statistics(tbl(spark, sf, "lineitem"), LI_NUM))


@register("summary_statistics_nulls",
          rsql(_sql_summary(["o_totalprice", "o_orderkey"], ORDERS_NULLS + " AS o"), _SUMMARY_DOUBLES))
def q_summary_statistics_nulls(spark, sf):
    return fin(P.summary_statistics(orders_nulls(spark, sf), ["o_totalprice", "o_orderkey"]))


@register("shape_summary", rsql(f"""SELECT count(*)::BIGINT AS "rows", 6::BIGINT AS "columns",
  3::BIGINT AS numeric_columns,
  ({' + '.join(f'count_if({x} IS NULL)' for x in ORDERS_COLS)})::BIGINT AS missing_cells,
  ({' + '.join(f'count_if({x} IS NULL)' for x in ORDERS_COLS)}) * 100.0 / (count(*) * 6) AS missing_pct
  FROM {ORDERS_NULLS} AS o""", ["missing_pct"]))
def q_shape_summary(spark, sf):
    return fin(P.shape_summary(orders_nulls(spark, sf)))


_CUST = [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
         ("c_mktsegment", "string")]


@register("column_info", rsql(" UNION ALL ".join(
    f"""SELECT '{x}' AS column_name, '{t}' AS dtype, count({x})::BIGINT AS non_null,
  count_if({x} IS NULL)::BIGINT AS nulls, count_if({x} IS NULL) * 100.0 / count(*) AS null_pct,
  count(DISTINCT {x})::BIGINT AS "distinct" FROM customer""" for x, t in _CUST), ["null_pct"]))
def q_column_info(spark, sf):
    return fin(P.column_info(tbl(spark, sf, "customer")))


_SHAPE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _label_sql(s, k):
    return f"""CASE WHEN abs({s}) < 0.5 THEN 'symmetric' WHEN {s} > 0 THEN 'right-skewed' ELSE 'left-skewed' END AS skew_label,
  CASE WHEN {s} < -1 THEN 'highly left-skewed' WHEN {s} < -0.5 THEN 'moderately left-skewed'
       WHEN {s} <= 0.5 THEN 'approximately symmetric' WHEN {s} <= 1 THEN 'moderately right-skewed'
       ELSE 'highly right-skewed' END AS skew_detail,
  CASE WHEN {k} < -0.5 THEN 'platykurtic (flat)' WHEN {k} > 0.5 THEN 'leptokurtic (peaked)'
       ELSE 'mesokurtic (normal-like)' END AS kurtosis_label"""


@register("shape_statistics", rsql(" UNION ALL ".join(
    f"""SELECT column_name, s AS skewness, k AS kurtosis, {_label_sql('s', 'k')} FROM (
  SELECT '{x}' AS column_name, skewness({x}) * (count({x}) - 2) / sqrt(count({x}) * (count({x}) - 1.0)) AS s,
  kurtosis_pop({x}) AS k FROM lineitem)""" for x in _SHAPE_COLS), ["skewness", "kurtosis"]))
def q_shape_statistics(spark, sf):
    return fin(P.shape_statistics(tbl(spark, sf, "lineitem"), _SHAPE_COLS))


_PS = [0.25, 0.5, 0.75, 0.95, 0.99]


@register("percentiles", rsql(" UNION ALL ".join(
    f"SELECT '{x}' AS column_name, {p}::DOUBLE AS p, quantile_cont({x}, {p}) AS value FROM lineitem"
    for x in ["l_extendedprice", "l_quantity", "l_partkey"] for p in _PS), ["p", "value"]))
def q_percentiles(spark, sf):
    return fin(P.percentiles(tbl(spark, sf, "lineitem"), ["l_extendedprice", "l_quantity", "l_partkey"], _PS))


@register("missing_table", rsql(" UNION ALL ".join(
    f"""SELECT '{x}' AS column_name, count_if({x} IS NULL)::BIGINT AS missing,
  count_if({x} IS NULL) * 100.0 / count(*) AS missing_pct FROM {ORDERS_NULLS} AS o""" for x in ORDERS_COLS),
    ["missing_pct"]))
def q_missing_table(spark, sf):
    return fin(P.missing_table(orders_nulls(spark, sf)))


@register("missing_correlation", rsql(f"""SELECT 'o_totalprice' AS column_a, 'o_orderpriority' AS column_b,
  corr(CASE WHEN o_totalprice IS NULL THEN 1.0 ELSE 0.0 END, CASE WHEN o_orderpriority IS NULL THEN 1.0 ELSE 0.0 END)
  AS correlation FROM {ORDERS_NULLS} AS o""", ["correlation"]))
def q_missing_correlation(spark, sf):
    return fin(P.missing_correlation(orders_nulls(spark, sf), ["o_totalprice", "o_orderpriority"]))


@register("duplicate_summary", rsql(f"""SELECT sum(c)::BIGINT AS "rows", sum(c - 1)::BIGINT AS duplicates,
  sum(c - 1) * 100.0 / sum(c) AS duplicate_pct FROM (SELECT count(*) AS c FROM {ORDERS_DUPS} AS o
  GROUP BY ALL_COLUMNS) AS g""".replace("ALL_COLUMNS", ", ".join(ORDERS_COLS)), ["duplicate_pct"]))
def q_duplicate_summary(spark, sf):
    return fin(P.duplicate_summary(orders_dups(spark, sf)))


@register("duplicate_rows", f"""SELECT {', '.join(ORDERS_COLS)} FROM (
  SELECT {', '.join(ORDERS_COLS)}, row_number() OVER (PARTITION BY {', '.join(ORDERS_COLS)}) AS rn
  FROM {ORDERS_DUPS} AS o) AS t WHERE rn > 1""")
def q_duplicate_rows(spark, sf):
    return fin(P.duplicate_rows(orders_dups(spark, sf)))


@register("duplicate_rows_subset", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice, l_orderkey, l_partkey) AS rn
  FROM lineitem) WHERE rn > 1""")
def q_duplicate_rows_subset(spark, sf):
    # order key for "first" must be unique per subset group: (l_extendedprice, l_orderkey, l_partkey) is
    li = tbl(spark, sf, "lineitem")
    key = F.struct("l_extendedprice", "l_orderkey", "l_partkey")
    li2 = li.withColumn("__o", key)
    return fin(P.duplicate_rows(li2, ["l_returnflag", "l_linestatus"], "__o").drop("__o"))


@register("duplicate_counts", """SELECT l_orderkey, l_linenumber, count(*)::BIGINT AS "count" FROM lineitem
  GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def q_duplicate_counts(spark, sf):
    return P.duplicate_counts(tbl(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


def _vc_sql(col, table, n):
    return rsql(f"""WITH c AS (SELECT {col} AS value, count(*) AS cnt FROM {table} GROUP BY 1),
  t AS (SELECT sum(cnt) FILTER (WHERE value IS NOT NULL) AS nn, count(value) AS d,
               coalesce(sum(cnt) FILTER (WHERE value IS NULL), 0) AS m FROM c)
  SELECT value, cnt::BIGINT AS "count", cnt * 100.0 / (SELECT nn FROM t) AS pct, (SELECT d FROM t)::BIGINT AS "distinct",
         (SELECT m FROM t)::BIGINT AS missing
  FROM c WHERE value IS NOT NULL ORDER BY cnt DESC, value LIMIT {n}""", ["pct"])


@register("value_counts", _vc_sql("o_orderpriority", ORDERS_NULLS + " AS o", 3))
def q_value_counts(spark, sf):
    return fin(P.value_counts(orders_nulls(spark, sf), "o_orderpriority", 3))


@register("value_counts_brand", _vc_sql("p_brand", "part", 10))
def q_value_counts_brand(spark, sf):
    return fin(P.value_counts(tbl(spark, sf, "part"), "p_brand", 10))


def _outlier_sql(cols, table, k=1.5):
    parts = []
    for x in cols:
        parts.append(f"""SELECT '{x}' AS column_name, q1, q3, q3 - q1 AS iqr, q1 - {k} * (q3 - q1) AS lower_bound,
  q3 + {k} * (q3 - q1) AS upper_bound,
  (SELECT count(*) FROM {table} WHERE {x} < q1 - {k} * (q3 - q1) OR {x} > q3 + {k} * (q3 - q1))::BIGINT AS outliers,
  (SELECT count(*) FROM {table} WHERE {x} < q1 - {k} * (q3 - q1) OR {x} > q3 + {k} * (q3 - q1)) * 100.0
    / (SELECT count({x}) FROM {table}) AS outlier_pct
  FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.75) AS q3 FROM {table}) AS b""")
    return rsql(" UNION ALL ".join(parts), ["q1", "q3", "iqr", "lower_bound", "upper_bound", "outlier_pct"])


@register("outlier_summary", _outlier_sql(["value", "user_id"], EVENTS_OUTLIERS + " AS e"))
def q_outlier_summary(spark, sf):
    return fin(P.outlier_summary(events_outliers(spark, sf), ["value", "user_id"]))


@register("datetime_profile", rsql("""WITH b AS (SELECT o_orderdate AS t FROM orders WHERE o_orderdate IS NOT NULL),
  y AS (SELECT CAST(year(t) AS VARCHAR) AS v, count(*) AS c FROM b GROUP BY 1 ORDER BY c DESC, v LIMIT 1),
  m AS (SELECT strftime(t, '%B') AS v, count(*) AS c FROM b GROUP BY 1 ORDER BY c DESC, v LIMIT 1),
  w AS (SELECT strftime(t, '%A') AS v, count(*) AS c FROM b GROUP BY 1 ORDER BY c DESC, v LIMIT 1)
  SELECT 'o_orderdate' AS column_name, min(t) AS "min", max(t) AS "max",
    date_diff('second', min(t), max(t)) / 86400.0 AS span_days,
    (SELECT v FROM y) AS top_year, (SELECT c FROM y)::BIGINT AS top_year_count,
    (SELECT c FROM y) * 100.0 / count(*) AS top_year_pct,
    (SELECT v FROM m) AS top_month, (SELECT c FROM m)::BIGINT AS top_month_count,
    (SELECT c FROM m) * 100.0 / count(*) AS top_month_pct,
    (SELECT v FROM w) AS top_weekday, (SELECT c FROM w)::BIGINT AS top_weekday_count,
    (SELECT c FROM w) * 100.0 / count(*) AS top_weekday_pct FROM b""",
                                    ["span_days", "top_year_pct", "top_month_pct", "top_weekday_pct"]))
def q_datetime_profile(spark, sf):
    return fin(P.datetime_profile(tbl(spark, sf, "orders"), "o_orderdate"))


@register("type_counts")
def q_type_counts(spark, sf):
    return P.type_counts(tbl(spark, sf, "lineitem"))


@register("sample_values")
def q_sample_values(spark, sf):
    return P.sample_values(tbl(spark, sf, "orders"))


@register("missing_matrix", f"""SELECT (o_orderkey IS NULL)::INTEGER AS o_orderkey, (o_custkey IS NULL)::INTEGER AS o_custkey,
  (o_orderstatus IS NULL)::INTEGER AS o_orderstatus, (o_totalprice IS NULL)::INTEGER AS o_totalprice,
  (o_orderdate IS NULL)::INTEGER AS o_orderdate, (o_orderpriority IS NULL)::INTEGER AS o_orderpriority
  FROM {ORDERS_NULLS} AS o ORDER BY o.o_orderkey LIMIT 100""")
def q_missing_matrix(spark, sf):
    return P.missing_matrix(orders_nulls(spark, sf), 100, "o_orderkey")
