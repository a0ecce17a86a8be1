"""Registry: cleaning (CLN*) and outlier rows (FLT16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cleaning as C
from tessera.registry.base import (EVENTS_NULLS, EVENTS_OUTLIERS, ORDERS_DUPS, ORDERS_NULLS, events_nulls,
                                   events_outliers, fin, orders_dups, orders_nulls, register, rsql, tbl)

ON = ORDERS_NULLS + " AS o"
EN = EVENTS_NULLS + " AS e"
EO = EVENTS_OUTLIERS + " AS e"


@register("drop_missing", f"SELECT * FROM {ON} WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL")
def q_drop_missing(spark, sf):
    return C.drop_missing(orders_nulls(spark, sf), ["o_totalprice", "o_orderpriority"])


@register("fill_mean", rsql(f"""SELECT o_orderkey, coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM {ON}))
  AS o_totalprice FROM {ON}""", ["o_totalprice"]))
def q_fill_mean(spark, sf):
    return fin(C.fill_mean(orders_nulls(spark, sf), ["o_totalprice"]).select("o_orderkey", "o_totalprice"))


@register("fill_median", rsql(f"""SELECT o_orderkey, coalesce(o_totalprice,
  (SELECT quantile_cont(o_totalprice, 0.5) FROM {ON})) AS o_totalprice FROM {ON}""", ["o_totalprice"]))
def q_fill_median(spark, sf):
    return fin(C.fill_median(orders_nulls(spark, sf), ["o_totalprice"]).select("o_orderkey", "o_totalprice"))


@register("fill_mode", f"""SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM (
  SELECT o_orderpriority AS v, count(*) AS n FROM {ON} WHERE o_orderpriority IS NOT NULL GROUP BY 1)
  ORDER BY n DESC, v LIMIT 1)) AS o_orderpriority FROM {ON}""")
def q_fill_mode(spark, sf):
    return C.fill_mode(orders_nulls(spark, sf), ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@register("fill_mode_numeric", rsql(f"""SELECT o_orderkey, coalesce(o_totalprice, (SELECT v FROM (
  SELECT o_totalprice AS v, count(*) AS n FROM {ON} WHERE o_totalprice IS NOT NULL GROUP BY 1)
  ORDER BY n DESC, v LIMIT 1)) AS o_totalprice FROM {ON}""", ["o_totalprice"]))
def q_fill_mode_numeric(spark, sf):
    return fin(C.fill_mode(orders_nulls(spark, sf), ["o_totalprice"]).select("o_orderkey", "o_totalprice"))


@register("fill_constant", f"""SELECT o_orderkey, coalesce(o_totalprice, 0.0) AS o_totalprice,
  coalesce(o_orderpriority, 'UNKNOWN') AS o_orderpriority FROM {ON}""")
def q_fill_constant(spark, sf):
    d = C.fill_constant(orders_nulls(spark, sf), ["o_totalprice"], "0")
    return C.fill_constant(d, ["o_orderpriority"], "UNKNOWN").select("o_orderkey", "o_totalprice", "o_orderpriority")


@register("fill_forward", f"""SELECT event_id, last_value(value IGNORE NULLS) OVER (ORDER BY event_id
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {EN}""")
def q_fill_forward(spark, sf):
    return C.fill_forward(events_nulls(spark, sf), ["value"], "event_id").select("event_id", "value")


@register("fill_backward", f"""SELECT event_id, first_value(value IGNORE NULLS) OVER (ORDER BY event_id
  ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS value FROM {EN}""")
def q_fill_backward(spark, sf):
    return C.fill_backward(events_nulls(spark, sf), ["value"], "event_id").select("event_id", "value")


@register("fill_forward_by_user", f"""SELECT event_id, user_id, last_value(value IGNORE NULLS) OVER (
  PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value FROM {EN}""")
def q_fill_forward_by_user(spark, sf):
    return C.fill_forward(events_nulls(spark, sf), ["value"], "ts", "user_id").select("event_id", "user_id", "value")


@register("fill_linear", rsql(f"""WITH b AS (SELECT event_id, value, row_number() OVER (ORDER BY event_id) - 1 AS i
  FROM {EN}), c AS (SELECT *,
  last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
  last_value(value IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni,
  first_value(value IGNORE NULLS) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv FROM b)
  SELECT event_id, CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv
  ELSE pv + (nv - pv) * (i - pi)::DOUBLE / (ni - pi)::DOUBLE END AS value FROM c""", ["value"]))
def q_fill_linear(spark, sf):
    return fin(C.fill_linear(events_nulls(spark, sf), ["value"], "event_id").select("event_id", "value"))


@register("drop_duplicates", f"SELECT DISTINCT * FROM {ORDERS_DUPS} AS o")
def q_drop_duplicates(spark, sf):
    return C.drop_duplicates(orders_dups(spark, sf))


@register("drop_duplicates_keep_last", """SELECT * FROM orders WHERE o_orderkey IN (
  SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)""")
def q_drop_duplicates_keep_last(spark, sf):
    return C.drop_duplicates(tbl(spark, sf, "orders"), ["o_custkey"], "last", "o_orderkey")


@register("drop_duplicates_keep_none", """SELECT * FROM orders WHERE o_custkey IN (
  SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) = 1)""")
def q_drop_duplicates_keep_none(spark, sf):
    return C.drop_duplicates(tbl(spark, sf, "orders"), ["o_custkey"], False)


_IQR = f"(SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM {EO})"
_IQR_B = f"(SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM {_IQR} AS q)"
_Z_B = f"(SELECT avg(value) - 3.0 * stddev_samp(value) AS lo, avg(value) + 3.0 * stddev_samp(value) AS hi FROM {EO})"
_MED = f"(SELECT quantile_cont(value, 0.5) FROM {EO})"
_MAD = f"(SELECT quantile_cont(abs(value - {_MED}), 0.5) FROM {EO})"
_MZ_B = f"""(SELECT CASE WHEN {_MAD} = 0 THEN (SELECT lo FROM {_IQR_B} AS b) ELSE {_MED} - 3.5 * {_MAD} / 0.6745 END AS lo,
  CASE WHEN {_MAD} = 0 THEN (SELECT hi FROM {_IQR_B} AS b) ELSE {_MED} + 3.5 * {_MAD} / 0.6745 END AS hi)"""


@register("outlier_bounds_iqr", rsql(f"SELECT lo AS lower, hi AS upper FROM {_IQR_B} AS b", ["lower", "upper"]))
def q_outlier_bounds_iqr(spark, sf):
    return fin(C.outlier_bounds(events_outliers(spark, sf), "value", "iqr"))


@register("outlier_bounds_zscore", rsql(f"SELECT lo AS lower, hi AS upper FROM {_Z_B} AS b", ["lower", "upper"]))
def q_outlier_bounds_zscore(spark, sf):
    return fin(C.outlier_bounds(events_outliers(spark, sf), "value", "zscore"))


@register("outlier_bounds_modified_z", rsql(f"SELECT lo AS lower, hi AS upper FROM {_MZ_B} AS b",
                                           ["lower", "upper"]))
def q_outlier_bounds_modified_z(spark, sf):
    return fin(C.outlier_bounds(events_outliers(spark, sf), "value", "modified_z"))


@register("outlier_rows_modified_z", f"""SELECT e.* FROM {EO}, {_MZ_B} AS b WHERE e.value < b.lo OR e.value > b.hi""")
def q_outlier_rows_modified_z(spark, sf):
    return C.outlier_rows(events_outliers(spark, sf), "value", "modified_z")


@register("outliers_remove", f"""SELECT event_id, value FROM {EO}, {_IQR_B} AS b
  WHERE (e.value >= b.lo AND e.value <= b.hi) OR e.value IS NULL""")
def q_outliers_remove(spark, sf):
    return C.handle_outliers(events_outliers(spark, sf), "value", "iqr", action="remove").select("event_id", "value")


@register("outliers_cap", rsql(f"""SELECT event_id, least(greatest(value, b.lo), b.hi) AS value FROM {EO}, {_IQR_B} AS b""",
                               ["value"]))
def q_outliers_cap(spark, sf):
    return fin(C.handle_outliers(events_outliers(spark, sf), "value", "iqr", action="cap").select("event_id", "value"))


@register("outliers_cap_inliers_zscore", rsql(f"""WITH b AS {_Z_B}, i AS (SELECT min(value) AS a, max(value) AS z
  FROM {EO}, b WHERE value >= b.lo AND value <= b.hi)
  SELECT event_id, least(greatest(value, i.a), i.z) AS value FROM {EO}, i""", ["value"]))
def q_outliers_cap_inliers_zscore(spark, sf):
    return fin(C.handle_outliers(events_outliers(spark, sf), "value", "zscore", action="cap", cap_to="inliers")
               .select("event_id", "value"))


@register("outliers_null", rsql(f"""SELECT event_id, CASE WHEN value < b.lo OR value > b.hi THEN NULL ELSE value END
  AS value FROM {EO}, {_IQR_B} AS b""", ["value"]))
def q_outliers_null(spark, sf):
    return fin(C.handle_outliers(events_outliers(spark, sf), "value", "iqr", action="null").select("event_id", "value"))


@register("outliers_median", rsql(f"""SELECT event_id, CASE WHEN value < b.lo OR value > b.hi THEN {_MED} ELSE value END
  AS value FROM {EO}, {_IQR_B} AS b""", ["value"]))
def q_outliers_median(spark, sf):
    return fin(C.handle_outliers(events_outliers(spark, sf), "value", "iqr", action="median").select("event_id", "value"))


@register("outliers_mean", rsql(f"""WITH b AS {_IQR_B}, m AS (SELECT avg(value) AS m FROM {EO}, b
  WHERE value >= b.lo AND value <= b.hi)
  SELECT event_id, CASE WHEN value < b.lo OR value > b.hi THEN m.m ELSE value END AS value FROM {EO}, b, m""",
                                ["value"]))
def q_outliers_mean(spark, sf):
    return fin(C.handle_outliers(events_outliers(spark, sf), "value", "iqr", action="mean").select("event_id", "value"))


_TEXT_DATE = "CASE WHEN o_orderkey % 13 = 0 THEN 'bad' ELSE strftime(o_orderdate, '%d/%m/%Y') END"


def _orders_text_dates(spark, sf):
    o = tbl(spark, sf, "orders")
    return o.select("o_orderkey", "o_orderstatus", "o_totalprice",
                    F.when(F.col("o_orderkey") % 13 == 0, F.lit("bad"))
                    .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("d"),
                    F.col("o_totalprice").cast("string").alias("price_text"))


@register("convert_type", f"""SELECT o_orderkey, try_strptime({_TEXT_DATE}, '%d/%m/%Y') AS d,
  trunc(TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE))::BIGINT AS price_int,
  TRY_CAST(CAST(o_totalprice AS VARCHAR) AS DOUBLE) AS price_float,
  CASE WHEN b IN ('true', 'True', 'TRUE', '1', 'yes', 'Yes', 'YES') THEN true
       WHEN b IN ('false', 'False', 'FALSE', '0', 'no', 'No', 'NO') THEN false END AS status_bool
  FROM (SELECT *, ['true', 'YES', 'f', 'No', 'tRUE', '0', 'on', ' yes', 'y', 'False'][(o_orderkey % 10 + 1)::INTEGER] AS b FROM orders)""")
def q_convert_type(spark, sf):
    d = _orders_text_dates(spark, sf)
    d = C.convert_type(d, "d", "datetime", "%d/%m/%Y")
    d = C.convert_type(d, "price_text", "int", out="price_int")
    d = C.convert_type(d, "price_text", "float", out="price_float")
    texts = F.array(*[F.lit(v) for v in ("true", "YES", "f", "No", "tRUE", "0", "on", " yes", "y", "False")])
    d = d.withColumn("b", F.get(texts, (F.col("o_orderkey") % 10).cast("int")))
    d = C.convert_type(d, "b", "boolean", out="status_bool")
    return d.select("o_orderkey", "d", "price_int", "price_float", "status_bool")


@register("outliers_log", rsql(f"""SELECT event_id, ln(value + (SELECT CASE WHEN min(value) <= 0 THEN abs(min(value)) + 1 ELSE 0.0 END
  FROM {EO})) AS value FROM {EO}""", ["value"]))
def q_outliers_log(spark, sf):
    return fin(C.handle_outliers(events_outliers(spark, sf), "value", "iqr", action="log").select("event_id", "value"))


@register("drop_missing_any_column", f"SELECT * FROM {ON} WHERE o_totalprice IS NOT NULL AND o_orderpriority IS NOT NULL")
def q_drop_missing_any_column(spark, sf):
    return C.drop_missing(orders_nulls(spark, sf))


@register("outlier_flag_zscore", f"""SELECT event_id, coalesce(value < b.lo OR value > b.hi, false) AS value_outlier
  FROM {EO}, {_Z_B} AS b""")
def q_outlier_flag_zscore(spark, sf):
    return C.outlier_flag(events_outliers(spark, sf), "value", "zscore").select("event_id", "value_outlier")
