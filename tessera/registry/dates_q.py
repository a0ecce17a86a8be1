"""Registry: date and time (DAT*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import dates as D
from tessera.registry.base import fin, register, rsql, tbl

_TEXT = "CASE WHEN o_orderkey % 13 = 0 THEN 'bad' ELSE strftime(o_orderdate, '{fmt}') END"


def _text_dates(spark, sf, fmt):
    o = tbl(spark, sf, "orders")
    return o.select("o_orderkey", F.when(F.col("o_orderkey") % 13 == 0, F.lit("bad"))
                    .otherwise(F.date_format("o_orderdate", fmt)).alias("d"))


@register("parse_datetime", f"SELECT o_orderkey, try_strptime({_TEXT.format(fmt='%d/%m/%Y')}, '%d/%m/%Y') AS d FROM orders")
def q_parse_datetime(spark, sf):
    return D.parse_datetime(_text_dates(spark, sf, "dd/MM/yyyy"), "d", "%d/%m/%Y")


@register("parse_datetime_auto", f"""SELECT o_orderkey, try_strptime({_TEXT.format(fmt='%Y/%m/%d %H:%M:%S')},
  '%Y/%m/%d %H:%M:%S') AS d FROM orders""")
def q_parse_datetime_auto(spark, sf):
    return D.parse_datetime(_text_dates(spark, sf, "yyyy/MM/dd HH:mm:ss"), "d")


def _feat_sql(key, ts, table, p):
    return f"""SELECT {key}, year({ts})::INTEGER AS {p}_year, month({ts})::INTEGER AS {p}_month, day({ts})::INTEGER AS {p}_day,
  hour({ts})::INTEGER AS {p}_hour, minute({ts})::INTEGER AS {p}_minute, second({ts})::INTEGER AS {p}_second,
  (isodow({ts}) - 1)::INTEGER AS {p}_dayofweek, quarter({ts})::INTEGER AS {p}_quarter, weekofyear({ts})::INTEGER AS {p}_weekofyear,
  isodow({ts}) >= 6 AS {p}_is_weekend, {ts}::DATE = last_day({ts}) AS {p}_is_month_end, day({ts}) = 1 AS {p}_is_month_start
  FROM {table}"""


_FEAT_SQL = _feat_sql("event_id", "ts", "events", "ts")


@register("date_features", _FEAT_SQL)
def q_date_features(spark, sf):
    d = D.date_features(tbl(spark, sf, "events"), "ts")
    return d.select("event_id", *[f"ts_{f}" for f in D.FEATURES])


@register("date_features_orders", _feat_sql("o_orderkey", "o_orderdate", "orders", "d"))
def q_date_features_orders(spark, sf):
    d = D.date_features(tbl(spark, sf, "orders").withColumnRenamed("o_orderdate", "d"), "d")
    return d.select("o_orderkey", *[f"d_{f}" for f in D.FEATURES]).toDF(
        "o_orderkey", *[f"d_{f}" for f in D.FEATURES])


@register("time_diff", rsql("""SELECT l_orderkey, l_linenumber, l_partkey,
  date_diff('microsecond', o_orderdate, l_shipdate) / 86400000000.0 AS ship_days,
  date_diff('microsecond', o_orderdate, l_shipdate) / 3600000000.0 AS ship_hours
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey""", ["ship_days", "ship_hours"]))
def q_time_diff(spark, sf):
    j = tbl(spark, sf, "lineitem").join(tbl(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    j = D.time_diff(j, "l_shipdate", "o_orderdate", "days", "ship_days")
    j = D.time_diff(j, "l_shipdate", "o_orderdate", "hours", "ship_hours")
    return fin(j.select("l_orderkey", "l_linenumber", "l_partkey", "ship_days", "ship_hours"))


@register("time_diff_events", rsql("""SELECT event_id, date_diff('microsecond', date_trunc('day', ts), ts) / 60000000.0
  AS minutes_since_midnight FROM events""", ["minutes_since_midnight"]))
def q_time_diff_events(spark, sf):
    e = tbl(spark, sf, "events").withColumn("midnight", D.trunc_ntz("DAY", F.col("ts")))
    return fin(D.time_diff(e, "ts", "midnight", "minutes", "minutes_since_midnight").select("event_id", "minutes_since_midnight"))


@register("period_keys", """SELECT o_orderkey, strftime(o_orderdate, '%A') AS day_name, strftime(o_orderdate, '%B') AS month_name,
  'Q' || quarter(o_orderdate)::VARCHAR AS quarter_label, year(o_orderdate)::VARCHAR AS period_year FROM orders""")
def q_period_keys(spark, sf):
    d = tbl(spark, sf, "orders")
    for p in ("day_name", "month_name", "quarter_label", "period_year"):
        d = D.period_key(d, "o_orderdate", p, p)
    return d.select("o_orderkey", "day_name", "month_name", "quarter_label", "period_year")


def _resample_sql(freq_trunc, step, value, table, ts, agg="avg", week=False):
    key = f"date_trunc('week', {ts}) + INTERVAL 6 DAY" if week else f"date_trunc('{freq_trunc}', {ts})"
    return rsql(f"""WITH g AS (SELECT ({key})::TIMESTAMP AS period, {agg}({value}) AS {value} FROM {table} GROUP BY 1),
  s AS (SELECT unnest(generate_series((SELECT min(period) FROM g), (SELECT max(period) FROM g), INTERVAL {step})) AS period)
  SELECT s.period, g.{value} FROM s LEFT JOIN g ON s.period = g.period""", [value])


@register("resample_daily", _resample_sql("day", "1 DAY", "value", "events", "ts"))
def q_resample_daily(spark, sf):
    return fin(D.resample(tbl(spark, sf, "events"), "ts", "value", "D"))


@register("resample_weekly", _resample_sql("week", "7 DAY", "o_totalprice", "orders", "o_orderdate", "sum", True))
def q_resample_weekly(spark, sf):
    return fin(D.resample(tbl(spark, sf, "orders"), "o_orderdate", "o_totalprice", "W", "sum"))


@register("resample_monthly", _resample_sql("month", "1 MONTH", "o_totalprice", "orders", "o_orderdate"))
def q_resample_monthly(spark, sf):
    return fin(D.resample(tbl(spark, sf, "orders"), "o_orderdate", "o_totalprice", "MS"))


@register("resample_quarterly", _resample_sql("quarter", "3 MONTH", "l_quantity", "lineitem", "l_shipdate", "sum"))
def q_resample_quarterly(spark, sf):
    return fin(D.resample(tbl(spark, sf, "lineitem"), "l_shipdate", "l_quantity", "QS", "sum"))


@register("resample_yearly", _resample_sql("year", "1 YEAR", "o_totalprice", "orders", "o_orderdate", "sum"))
def q_resample_yearly(spark, sf):
    return fin(D.resample(tbl(spark, sf, "orders"), "o_orderdate", "o_totalprice", "YS", "sum"))


@register("infer_period", """WITH d AS (SELECT DISTINCT o_orderdate AS t FROM orders),
  g AS (SELECT date_diff('second', lag(t) OVER (ORDER BY t), t) AS gap FROM d),
  m AS (SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1 ORDER BY n DESC, gap LIMIT 1)
  SELECT gap AS gap_seconds, CASE WHEN gap = 86400 THEN 'D' WHEN gap = 604800 THEN 'W'
    WHEN gap BETWEEN 28 * 86400 AND 31 * 86400 THEN 'M' WHEN gap BETWEEN 89 * 86400 AND 92 * 86400 THEN 'Q'
    WHEN gap BETWEEN 365 * 86400 AND 366 * 86400 THEN 'Y' END AS frequency,
    (CASE WHEN gap = 86400 THEN 365 WHEN gap = 604800 THEN 52 WHEN gap BETWEEN 28 * 86400 AND 31 * 86400 THEN 12
    WHEN gap BETWEEN 89 * 86400 AND 92 * 86400 THEN 4 WHEN gap BETWEEN 365 * 86400 AND 366 * 86400 THEN 1
    WHEN (SELECT count(*) FROM d) >= 365 THEN 365 WHEN (SELECT count(*) FROM d) >= 52 THEN 52
    WHEN (SELECT count(*) FROM d) >= 12 THEN 12 WHEN (SELECT count(*) FROM d) >= 4 THEN 4 ELSE 2 END)::INTEGER AS seasonal_period FROM m""")
def q_infer_period(spark, sf):
    d = tbl(spark, sf, "orders").select("o_orderdate").distinct()
    return D.infer_period(d, "o_orderdate")


@register("infer_period_irregular", """WITH d AS (SELECT ts AS t FROM events),
  g AS (SELECT date_diff('second', lag(t) OVER (ORDER BY t), t) AS gap FROM d),
  m AS (SELECT gap, count(*) AS n FROM g WHERE gap IS NOT NULL GROUP BY 1 ORDER BY n DESC, gap LIMIT 1)
  SELECT gap AS gap_seconds, CASE WHEN gap = 86400 THEN 'D' WHEN gap = 604800 THEN 'W'
    WHEN gap BETWEEN 28 * 86400 AND 31 * 86400 THEN 'M' WHEN gap BETWEEN 89 * 86400 AND 92 * 86400 THEN 'Q'
    WHEN gap BETWEEN 365 * 86400 AND 366 * 86400 THEN 'Y' END AS frequency,
    (CASE WHEN gap = 86400 THEN 365 WHEN gap = 604800 THEN 52 WHEN gap BETWEEN 28 * 86400 AND 31 * 86400 THEN 12
    WHEN gap BETWEEN 89 * 86400 AND 92 * 86400 THEN 4 WHEN gap BETWEEN 365 * 86400 AND 366 * 86400 THEN 1
    WHEN (SELECT count(*) FROM d) >= 365 THEN 365 WHEN (SELECT count(*) FROM d) >= 52 THEN 52
    WHEN (SELECT count(*) FROM d) >= 12 THEN 12 WHEN (SELECT count(*) FROM d) >= 4 THEN 4 ELSE 2 END)::INTEGER AS seasonal_period FROM m""")
def q_infer_period_irregular(spark, sf):
    return D.infer_period(tbl(spark, sf, "events").select("ts"), "ts")


@register("detect_datetime", rsql("""WITH s AS (SELECT strftime(o_orderdate, '%Y-%m-%d') AS s FROM orders
  ORDER BY o_orderkey LIMIT 100) SELECT 'd' AS column_name, greatest(
  avg(regexp_matches(s, '^\\d{4}[-/]\\d{1,2}[-/]\\d{1,2}$')::DOUBLE), avg(regexp_matches(s, '^\\d{1,2}[-/]\\d{1,2}[-/]\\d{4}$')::DOUBLE),
  avg(regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}:\\d{2}:\\d{2}')::DOUBLE), avg(regexp_matches(s, '^\\d{4}-\\d{2}-\\d{2}$')::DOUBLE),
  avg(regexp_matches(s, '^\\d{2}/\\d{2}/\\d{4}$')::DOUBLE), avg(regexp_matches(s, '^\\d{2}-\\d{2}-\\d{4}$')::DOUBLE)) AS best_share,
  best_share > 0.7 AS is_datetime FROM s""", ["best_share"]))
def q_detect_datetime(spark, sf):
    o = tbl(spark, sf, "orders").orderBy("o_orderkey").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return fin(D.detect_datetime(o, "d"))
