"""Registry: rolling / expanding / ordered operators (WIN*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import windows as W
from tessera.registry.base import EVENTS_NULLS, events_nulls, fin, register, rsql, tbl

EN = EVENTS_NULLS + " AS e"
_STATS = ["mean", "min", "max", "std", "sum", "count", "median"]


def _rolling_sql(table, n, order, part=None, key="event_id"):
    pb = f"PARTITION BY {part} " if part else ""
    w = f"({pb}ORDER BY {order} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    cnt = f"count(value) OVER {w}"
    keys = f"{key}, {part}" if part else key
    return rsql(f"""SELECT {keys}, CASE WHEN {cnt} = {n} THEN avg(value) OVER {w} END AS r_mean,
  CASE WHEN {cnt} = {n} THEN min(value) OVER {w} END AS r_min, CASE WHEN {cnt} = {n} THEN max(value) OVER {w} END AS r_max,
  CASE WHEN {cnt} = {n} THEN stddev_samp(value) OVER {w} END AS r_std, CASE WHEN {cnt} = {n} THEN sum(value) OVER {w} END AS r_sum,
  CASE WHEN row_number() OVER ({pb}ORDER BY {order}) >= {n} THEN {cnt} END AS r_count,
  CASE WHEN {cnt} = {n} THEN median(value) OVER {w} END AS r_median FROM {table}""",
                ["r_mean", "r_min", "r_max", "r_std", "r_sum", "r_median"])


@register("rolling_stats", _rolling_sql(EN, 5, "event_id"))
def q_rolling_stats(spark, sf):
    d = W.rolling(events_nulls(spark, sf), "value", 5, _STATS, "event_id", out={s: f"r_{s}" for s in _STATS})
    return fin(d.select("event_id", *[f"r_{s}" for s in _STATS]))


@register("rolling_stats_by_user", _rolling_sql("events", 4, "ts", "user_id"))
def q_rolling_stats_by_user(spark, sf):
    d = W.rolling(tbl(spark, sf, "events"), "value", 4, _STATS, "ts", "user_id", out={s: f"r_{s}" for s in _STATS})
    return fin(d.select("event_id", "user_id", *[f"r_{s}" for s in _STATS]))


@register("moving_averages", rsql("""SELECT event_id,
  CASE WHEN count(value) OVER (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
    THEN avg(value) OVER (ORDER BY ts ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS sma_7,
  CASE WHEN count(value) OVER (ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) = 30
    THEN avg(value) OVER (ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW) END AS sma_30 FROM events""",
                                  ["sma_7", "sma_30"]))
def q_moving_averages(spark, sf):
    return fin(W.moving_averages(tbl(spark, sf, "events"), "value", 7, 30, "ts").select("event_id", "sma_7", "sma_30"))


@register("rolling_volatility", rsql("""SELECT o_orderkey, CASE WHEN count(o_totalprice) OVER w = 20
  THEN stddev_samp(o_totalprice) OVER w END AS vol FROM orders
  WINDOW w AS (ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", ["vol"], 4))
def q_rolling_volatility(spark, sf):
    d = W.rolling(tbl(spark, sf, "orders"), "o_totalprice", 20, ["std"], ["o_orderdate", "o_orderkey"], out={"std": "vol"})
    return fin(d.select("o_orderkey", "vol"), 4)


@register("expanding_stats", rsql(f"""SELECT event_id, avg(value) OVER w AS e_mean, sum(value) OVER w AS e_sum,
  min(value) OVER w AS e_min, max(value) OVER w AS e_max, count(value) OVER w AS e_count,
  stddev_samp(value) OVER w AS e_std FROM {EN} WINDOW w AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
                                  ["e_mean", "e_sum", "e_min", "e_max", "e_std"], 4))
def q_expanding_stats(spark, sf):
    st = ["mean", "sum", "min", "max", "count", "std"]
    d = W.expanding(events_nulls(spark, sf), "value", st, "event_id", out={s: f"e_{s}" for s in st})
    return fin(d.select("event_id", *[f"e_{s}" for s in st]), 4)


@register("expanding_median", rsql("""SELECT event_id, user_id, median(value) OVER (PARTITION BY user_id ORDER BY ts
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e_median FROM events""", ["e_median"]))
def q_expanding_median(spark, sf):
    d = W.expanding_median(tbl(spark, sf, "events"), "value", "ts", "user_id", out="e_median")
    return fin(d.select("event_id", "user_id", "e_median"))


def _ema_sql(span, table="events", order="event_id", key="event_id"):
    a = 2.0 / (span + 1.0)
    return f"""WITH RECURSIVE b AS (SELECT {key} AS k, value, row_number() OVER (ORDER BY {order}) AS rn FROM {table}),
  r AS (SELECT rn, k, value AS y FROM b WHERE rn = 1
        UNION ALL SELECT b.rn, b.k, (1 - {a!r}) * r.y + {a!r} * b.value FROM r JOIN b ON b.rn = r.rn + 1)"""


@register("ema", rsql(_ema_sql(10) + " SELECT k AS event_id, y AS ema FROM r", ["ema"]))
def q_ema(spark, sf):
    return fin(W.ema(tbl(spark, sf, "events").select("event_id", "value"), "value", 10, "event_id", out="ema").select("event_id", "ema"))


@register("crossover_sma", """WITH m AS (SELECT event_id,
  CASE WHEN count(value) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) = 5
    THEN avg(value) OVER (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) END AS s,
  CASE WHEN count(value) OVER (ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20
    THEN avg(value) OVER (ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END AS l FROM events),
  g AS (SELECT event_id, CASE WHEN s > l THEN 1 WHEN s < l THEN -1 ELSE 0 END AS signal FROM m),
  c AS (SELECT event_id, signal, coalesce(signal - lag(signal) OVER (ORDER BY event_id), 0) AS signal_change FROM g)
  SELECT event_id, signal, signal_change, CASE WHEN signal_change = 2 THEN 'buy' WHEN signal_change = -2 THEN 'sell' END AS action FROM c""")
def q_crossover_sma(spark, sf):
    d = W.crossover(tbl(spark, sf, "events"), "value", 5, 20, "sma", "event_id")
    return d.select("event_id", "signal", "signal_change", "action")


def _ema2_sql():
    a5, a20 = 2.0 / 6.0, 2.0 / 21.0
    return f"""WITH RECURSIVE b AS (SELECT event_id AS k, value, row_number() OVER (ORDER BY event_id) AS rn FROM events),
  r AS (SELECT rn, k, value AS y5, value AS y20 FROM b WHERE rn = 1
        UNION ALL SELECT b.rn, b.k, (1 - {a5!r}) * r.y5 + {a5!r} * b.value, (1 - {a20!r}) * r.y20 + {a20!r} * b.value
        FROM r JOIN b ON b.rn = r.rn + 1),
  g AS (SELECT k AS event_id, rn, CASE WHEN y5 > y20 THEN 1 WHEN y5 < y20 THEN -1 ELSE 0 END AS signal FROM r),
  c AS (SELECT event_id, signal, coalesce(signal - lag(signal) OVER (ORDER BY rn), 0) AS signal_change FROM g)
  SELECT event_id, signal, signal_change, CASE WHEN signal_change = 2 THEN 'buy' WHEN signal_change = -2 THEN 'sell' END AS action FROM c"""


@register("crossover_ema", _ema2_sql())
def q_crossover_ema(spark, sf):
    d = W.crossover(tbl(spark, sf, "events").select("event_id", "value"), "value", 5, 20, "ema", "event_id")
    return d.select("event_id", "signal", "signal_change", "action")


@register("difference", rsql("""SELECT event_id, value - lag(value, 2) OVER (ORDER BY event_id) AS lag2,
  value - 2 * lag(value, 1) OVER (ORDER BY event_id) + lag(value, 2) OVER (ORDER BY event_id) AS twice FROM events""",
                             ["lag2", "twice"]))
def q_difference(spark, sf):
    d = W.difference(tbl(spark, sf, "events"), "value", 2, False, "event_id", out="lag2")
    d = W.difference(d, "value", 2, True, "event_id", out="twice")
    return fin(d.select("event_id", "lag2", "twice"))


@register("difference_by_user", rsql("""SELECT event_id, value - lag(value, 1) OVER (PARTITION BY user_id ORDER BY ts) AS d1
  FROM events""", ["d1"]))
def q_difference_by_user(spark, sf):
    d = W.difference(tbl(spark, sf, "events"), "value", 1, False, "ts", "user_id", out="d1")
    return fin(d.select("event_id", "d1"))


@register("change_summary", rsql("""SELECT arg_min(value, ts) AS first, arg_max(value, ts) AS last,
  arg_max(value, ts) - arg_min(value, ts) AS change, (arg_max(value, ts) - arg_min(value, ts)) * 100.0 / arg_min(value, ts) AS pct_change,
  min(value) AS "min", max(value) AS "max", max(value) - min(value) AS "range", avg(value) AS mean FROM events""",
                                 ["first", "last", "change", "pct_change", "min", "max", "range", "mean"]))
def q_change_summary(spark, sf):
    return fin(W.change_summary(tbl(spark, sf, "events"), "value", "ts"))


@register("ecdf", rsql("""SELECT l_extendedprice AS value, row_number() OVER (ORDER BY l_extendedprice) / count(*) OVER () AS ecdf
  FROM lineitem""", ["value", "ecdf"]))
def q_ecdf(spark, sf):
    return fin(W.ecdf(tbl(spark, sf, "lineitem"), "l_extendedprice"))


@register("ecdf_by_group", rsql("""SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value)
  / count(*) OVER (PARTITION BY event_type) AS ecdf FROM events""", ["value", "ecdf"]))
def q_ecdf_by_group(spark, sf):
    return fin(W.ecdf(tbl(spark, sf, "events"), "value", "event_type"))


@register("is_monotonic", """SELECT 'ts' AS col, bool_and(coalesce(ts >= p, true)) AS increasing, bool_and(coalesce(ts <= p, true)) AS decreasing
  FROM (SELECT ts, lag(ts) OVER (ORDER BY event_id) AS p FROM events)
  UNION ALL SELECT 'value', bool_and(coalesce(value >= p, true)), bool_and(coalesce(value <= p, true))
  FROM (SELECT value, lag(value) OVER (ORDER BY event_id) AS p FROM events)""")
def q_is_monotonic(spark, sf):
    e = tbl(spark, sf, "events")
    a = W.is_monotonic(e, "ts", "event_id").withColumn("col", F.lit("ts"))
    b = W.is_monotonic(e, "value", "event_id").withColumn("col", F.lit("value"))
    return a.unionByName(b)


# ---- small blocks, null series keys, tied first order keys: the block path of every size --------------
_NK = f"""(SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id % 5 END AS k, event_id % 40 AS t, value FROM {EN})"""
_BLOCK = 700


def _null_keys(spark, sf):
    e = events_nulls(spark, sf)
    return e.select("event_id", F.when(F.col("user_id") % 3 != 0, F.col("user_id") % 5).alias("k"),
                    (F.col("event_id") % 40).alias("t"), "value")


_NW = "PARTITION BY k ORDER BY t, event_id"


@register("blocks_running", rsql(f"""SELECT event_id, k, (row_number() OVER ({_NW}) - 1)::BIGINT AS pos,
  CASE WHEN value IS NOT NULL THEN sum(value) OVER ({_NW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS total,
  last_value(value IGNORE NULLS) OVER ({_NW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM {_NK}""",
                                 ["total", "filled"], 4))
def q_blocks_running(spark, sf):
    from tessera.plans import ordered as O
    d = _null_keys(spark, sf)
    d = O.row_index(d, ["t", "event_id"], "k", "pos", _BLOCK)
    d = O.cumulative(d, "value", "sum", ["t", "event_id"], "k", {"value": "total"}, _BLOCK)
    d = O.fill_forward(d.withColumn("filled", F.col("value")), "filled", ["t", "event_id"], "k", _BLOCK)
    return fin(d.select("event_id", "k", "pos", "total", "filled"), 4)


@register("blocks_windows", rsql(f"""SELECT event_id, k,
  CASE WHEN count(value) OVER ({_NW} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) = 7
    THEN avg(value) OVER ({_NW} ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) END AS r_mean,
  CASE WHEN count(value) OVER ({_NW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) > 1
    THEN stddev_samp(value) OVER ({_NW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS e_std,
  max(value) OVER ({_NW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e_max FROM {_NK}""", ["r_mean", "e_std", "e_max"], 5))
def q_blocks_windows(spark, sf):
    d = _null_keys(spark, sf)
    d = W.rolling(d, "value", 7, ["mean"], ["t", "event_id"], "k", {"mean": "r_mean"}, rows_per_block=_BLOCK)
    d = W.expanding(d, "value", ["std", "max"], ["t", "event_id"], "k", {"std": "e_std", "max": "e_max"}, _BLOCK)
    return fin(d.select("event_id", "k", "r_mean", "e_std", "e_max"), 5)


@register("quantiles_small_brackets", rsql(f"""SELECT k, p, quantile_cont(value, p) AS q FROM {_NK},
  (SELECT unnest([0.1, 0.5, 0.9]) AS p) GROUP BY k, p""".replace("quantile_cont(value, p)", """CASE p WHEN 0.1 THEN quantile_cont(value, 0.1)
  WHEN 0.5 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.9) END""").replace("[0.1, 0.5, 0.9]", "[0.1::DOUBLE, 0.5::DOUBLE, 0.9::DOUBLE]"),
                                           ["q"]))
def q_quantiles_small_brackets(spark, sf):
    from tessera.plans.quantiles import exact_quantiles
    return fin(exact_quantiles(_null_keys(spark, sf), "value", [0.1, 0.5, 0.9], "k", max_bracket_rows=300))
