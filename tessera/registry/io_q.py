"""Registry: sources, sinks, schema tools, pipelines, reports and chart-data frames.

Round-trip queries write a frame derived from the given tables under the
session's checkpoint folder and read it back with the library readers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import charts as CH
from tessera.operators import cleaning as C
from tessera.operators import numeric as N
from tessera.plans import reports as R
from tessera.plans.dashboard import run_dashboard
from tessera.plans.pipeline import Pipeline
from tessera.registry.base import fin, register, rsql, tbl
from tessera.session import scratch_path
from tessera.sinks import writers as W
from tessera.sources import readers as RD
from tessera.sources import types as TY


@register("csv_roundtrip_locale", rsql("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders",
                                       ["o_totalprice"]))
def q_csv_roundtrip_locale(spark, sf):
    """Semicolon CSV with decimal comma and thousands dot, read back and converted."""
    o = tbl(spark, sf, "orders")
    txt = o.select(F.col("o_orderkey").cast("string").alias("o_orderkey"), F.col("o_custkey").cast("string").alias("o_custkey"),
                   F.regexp_replace(F.regexp_replace(F.format_number("o_totalprice", 2), ",", "#"), "\\.", ",")
                   .alias("p"), "o_orderpriority")
    txt = txt.withColumn("o_totalprice", F.regexp_replace("p", "#", ".")).drop("p")
    path = scratch_path(spark, "csv")
    W.write_csv(txt, path, sep=";", encoding="latin1")
    back = RD.read_csv(spark, path, sep=";", encoding="latin1", decimal=",", thousands=".")
    return fin(back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), F.col("o_custkey").cast("long").alias("o_custkey"),
                           "o_totalprice", "o_orderpriority"))


@register("tsv_sniffed_roundtrip", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_tsv_sniffed_roundtrip(spark, sf):
    c = tbl(spark, sf, "customer")
    path = scratch_path(spark, "tsv")
    W.write_csv(c, path, sep="\t")
    back = RD.read_delimited(spark, path)
    return back.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name",
                       F.col("c_nationkey").cast("int").alias("c_nationkey"), F.col("c_acctbal").cast("double").alias("c_acctbal"),
                       "c_mktsegment")


@register("json_roundtrip", "SELECT r_regionkey, r_name FROM region")
def q_json_roundtrip(spark, sf):
    r = tbl(spark, sf, "region")
    path = scratch_path(spark, "json")
    W.write_json(r, path, lines=True)
    back = RD.read_json(spark, path, lines=True)
    return back.select(F.col("r_regionkey").cast("int").alias("r_regionkey"), "r_name")


@register("json_split_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_json_split_roundtrip(spark, sf):
    n = tbl(spark, sf, "nation")
    path = scratch_path(spark, "json-split")
    W.write_json(n, path, orient="split", lines=False)
    back = RD.read_json(spark, path, orient="split")
    return back.select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "n_name",
                       F.col("n_regionkey").cast("int").alias("n_regionkey"))


def _orient_roundtrip(spark, sf, orient):
    n = tbl(spark, sf, "nation")
    path = scratch_path(spark, f"json-{orient}")
    W.write_json(n, path, orient=orient, lines=False)
    back = RD.read_json(spark, path, orient=orient, lines=orient == "records")
    return back.select(F.col("n_nationkey").cast("double").cast("int").alias("n_nationkey"), "n_name",
                       F.col("n_regionkey").cast("double").cast("int").alias("n_regionkey"))


@register("json_records_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_json_records(spark, sf):
    return _orient_roundtrip(spark, sf, "records")


@register("json_columns_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_json_columns(spark, sf):
    return _orient_roundtrip(spark, sf, "columns")


@register("json_index_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_json_index(spark, sf):
    return _orient_roundtrip(spark, sf, "index")


@register("json_table_roundtrip", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_json_table(spark, sf):
    return _orient_roundtrip(spark, sf, "table")


@register("json_split_brackets", "SELECT s_suppkey, 'a]b\"[' || s_name AS s_name, s_acctbal FROM supplier")
def q_json_split_brackets(spark, sf):
    """Brackets and quotes inside text, and a number column, survive the split orient."""
    s = tbl(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit('a]b"['), "s_name").alias("s_name"), "s_acctbal")
    path = scratch_path(spark, "json-brackets")
    W.write_json(s, path, orient="split", lines=False)
    back = RD.read_json(spark, path, orient="split")
    return back.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", F.col("s_acctbal").cast("double").alias("s_acctbal"))


@register("snapshot_roundtrip", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def q_snapshot_roundtrip(spark, sf):
    s = tbl(spark, sf, "supplier")
    root = scratch_path(spark, "projects")
    W.save_snapshot(s, root, "suppliers", [{"description": "loaded", "type": "load"}])
    back, meta = W.load_snapshot(spark, root, "suppliers")
    return back


@register("narrow_types", """SELECT l_linenumber::TINYINT AS l_linenumber, l_quantity::TINYINT AS l_quantity,
  (l_linenumber * 1000)::SMALLINT AS line_k, l_extendedprice, l_discount, l_tax FROM lineitem""")
def q_narrow_types(spark, sf):
    # columns whose value ranges do not depend on the scale factor
    li = tbl(spark, sf, "lineitem").select("l_linenumber", "l_quantity",
                                           (F.col("l_linenumber") * 1000).cast("long").alias("line_k"),
                                           "l_extendedprice", "l_discount", "l_tax")
    return TY.narrow_types(li)


@register("column_kinds")
def q_column_kinds(spark, sf):
    return TY.column_kinds(tbl(spark, sf, "orders"))


@register("date_candidates", """WITH f AS (SELECT min(strftime(o_orderdate, '%Y-%m-%d')) AS d, min(o_orderstatus) AS st, min(o_orderpriority) AS pr FROM orders)
  SELECT 'o_orderdate' AS column_name, 'type' AS reason UNION ALL
  SELECT 'd_text', 'values' FROM f WHERE regexp_matches(d, '\\d{4}-\\d{2}-\\d{2}') UNION ALL
  SELECT 'o_orderstatus', 'values' FROM f WHERE regexp_matches(st, '\\d{4}-\\d{2}-\\d{2}') UNION ALL
  SELECT 'o_orderpriority', 'values' FROM f WHERE regexp_matches(pr, '\\d{2}/\\d{2}/\\d{4}')""")
def q_date_candidates(spark, sf):
    o = tbl(spark, sf, "orders").withColumn("d_text", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return TY.date_candidates(o)


@register("load_metadata")
def q_load_metadata(spark, sf):
    return RD.load_metadata(tbl(spark, sf, "lineitem"))


@register("pipeline_replay", rsql("""WITH f AS (SELECT o_orderkey, o_custkey, coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM orders)) AS o_totalprice
  FROM orders) SELECT o_orderkey, o_custkey, o_totalprice FROM f WHERE o_totalprice > 100000""", ["o_totalprice"]))
def q_pipeline_replay(spark, sf):
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    p = (Pipeline(o).step(C.fill_mean, cols=["o_totalprice"])
         .step(lambda d: d.where("o_totalprice > 100000"), "keep large orders")
         .step(N.log_transform, col="o_totalprice"))
    return fin(p.revert(2).result())


@register("pipeline_reset", "SELECT o_orderkey, o_totalprice FROM orders")
def q_pipeline_reset(spark, sf):
    """Back to the source, then no step is left to replay."""
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return Pipeline(o).step(N.log_transform, col="o_totalprice").reset().result()


@register("pipeline_row_counts", """SELECT -1 AS step, 'source' AS description, count(*) AS "rows" FROM orders UNION ALL
  SELECT 0, 'large', count(*) FROM orders WHERE o_totalprice > 100000 UNION ALL
  SELECT 1, 'large and urgent', count(*) FROM orders WHERE o_totalprice > 100000 AND o_orderpriority = '1-URGENT'""")
def q_pipeline_row_counts(spark, sf):
    p = Pipeline(tbl(spark, sf, "orders")).step(lambda d: d.where("o_totalprice > 100000"), "large")
    return p.step(lambda d: d.where("o_orderpriority = '1-URGENT'"), "large and urgent").row_counts()


@register("processed_roundtrip", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def q_processed_roundtrip(spark, sf):
    path = W.save_processed(tbl(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"), scratch_path(spark, "processed"))
    return W.load_processed(spark, path)


@register("pipeline_history")
def q_pipeline_history(spark, sf):
    o = tbl(spark, sf, "orders")
    p = Pipeline(o).step(C.drop_missing, cols=["o_totalprice"]).step(N.standardize, col="o_totalprice")
    return p.history()


@register("summary_report")
def q_summary_report(spark, sf):
    return R.summary_report(tbl(spark, sf, "orders"))


@register("custom_report")
def q_custom_report(spark, sf):
    return R.custom_report(tbl(spark, sf, "lineitem"), ["dataset", "numeric", "correlation", "outliers"],
                           {"numeric_cols": ["l_quantity", "l_extendedprice", "l_discount"]})


@register("eda_report")
def q_eda_report(spark, sf):
    return R.eda_report(tbl(spark, sf, "customer"), "standard")


@register("insights")
def q_insights(spark, sf):
    return R.insights(tbl(spark, sf, "lineitem"))


@register("digest")
def q_digest(spark, sf):
    return R.digest(tbl(spark, sf, "orders"))


@register("chart_line", rsql("""SELECT event_type, avg(value) AS value, date_trunc('day', ts) AS day FROM events GROUP BY 1, 3""",
                             ["value"]))
def q_chart_line(spark, sf):
    from tessera.operators.dates import trunc_ntz
    daily = tbl(spark, sf, "events").groupBy("event_type", trunc_ntz("DAY", F.col("ts")).alias("day")).agg(
        F.avg("value").alias("value"))
    return fin(CH.line_data(daily, "day", ["value"], "event_type"))


@register("chart_scatter", "SELECT l_quantity, l_extendedprice, l_discount FROM lineitem")
def q_chart_scatter(spark, sf):
    return CH.scatter_data(tbl(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@register("chart_scatter_capped")
def q_chart_scatter_capped(spark, sf):
    return CH.scatter_data(tbl(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], cap=10_000)


@register("chart_animation", rsql("""SELECT year(o_orderdate)::INTEGER AS yr, o_orderpriority, avg(o_totalprice) AS o_totalprice
  FROM orders GROUP BY 1, 2""", ["o_totalprice"], 4))
def q_chart_animation(spark, sf):
    o = tbl(spark, sf, "orders").withColumn("yr", F.year("o_orderdate"))
    return fin(CH.animation_frames(o, "yr", "o_orderpriority", "o_totalprice"), 4)


@register("chart_bar_error", rsql("""SELECT p_type, avg(p_retailprice) AS mean, stddev_samp(p_retailprice) AS error FROM part
  GROUP BY 1""", ["mean", "error"]))
def q_chart_bar_error(spark, sf):
    return fin(CH.bar_with_error(tbl(spark, sf, "part"), "p_type", "p_retailprice"))


@register("chart_candlestick", rsql("""SELECT date_trunc('day', ts) AS period, arg_min(value, ts) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, ts) AS close FROM events GROUP BY 1""", ["open", "high", "low", "close"]))
def q_chart_candlestick(spark, sf):
    return fin(CH.candlestick(tbl(spark, sf, "events"), "ts", "value", "DAY"))


@register("chart_timeline", """SELECT user_id, event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS "end" FROM events""")
def q_chart_timeline(spark, sf):
    return CH.timeline(tbl(spark, sf, "events"), "ts", "user_id", "event_type")


def _geo(spark, sf):
    c = tbl(spark, sf, "customer")
    return c.select("c_custkey", "c_nationkey", ((F.col("c_acctbal") / 50.0)).alias("lat"),
                    (F.col("c_custkey") % 400 - 200).cast("double").alias("lon"), "c_acctbal")


@register("chart_map_points", rsql("""SELECT c_acctbal / 50.0 AS lat, (c_custkey % 400 - 200)::DOUBLE AS lon, c_acctbal FROM customer
  WHERE c_acctbal / 50.0 BETWEEN -90 AND 90 AND (c_custkey % 400 - 200) BETWEEN -180 AND 180""", ["lat", "lon"]))
def q_chart_map_points(spark, sf):
    return fin(CH.map_points(_geo(spark, sf), "lat", "lon", "c_acctbal"))


@register("chart_density_grid", """SELECT round(c_acctbal / 50.0, -1) AS lat_cell, round((c_custkey % 400 - 200)::DOUBLE, -1) AS lon_cell,
  count(*) AS "count" FROM customer WHERE c_acctbal / 50.0 BETWEEN -90 AND 90 AND (c_custkey % 400 - 200) BETWEEN -180 AND 180
  GROUP BY 1, 2""")
def q_chart_density_grid(spark, sf):
    return CH.density_grid(_geo(spark, sf), "lat", "lon", -1)


@register("chart_choropleth", rsql("""SELECT n_name, sum(c_acctbal) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1""", ["value"], 4))
def q_chart_choropleth(spark, sf):
    j = tbl(spark, sf, "customer").join(tbl(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return fin(CH.choropleth(j, "n_name", "c_acctbal"), 4)


@register("chart_violin")
def q_chart_violin(spark, sf):
    box, dens = CH.violin(tbl(spark, sf, "events"), "value", "event_type", 50)
    return fin(dens)


@register("dashboard_table", """SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders WHERE o_totalprice BETWEEN 50000 AND 150000
  AND o_orderpriority IN ('1-URGENT') ORDER BY o_totalprice DESC, o_orderkey LIMIT 25""")
def q_dashboard_table(spark, sf):
    spec = {"filters": [{"column": "o_totalprice", "type": "range", "value": (50000, 150000)},
                        {"column": "o_orderpriority", "type": "multiselect", "value": ["1-URGENT"]}],
            "metrics": [{"name": "avg_price", "column": "o_totalprice", "agg": "mean", "format": "currency"}],
            "charts": [{"name": "by_status", "kind": "bar_error", "cat": "o_orderstatus", "value": "o_totalprice"}],
            "tables": [{"name": "top", "columns": ["o_orderkey", "o_totalprice", "o_orderpriority"], "max_rows": 25,
                        "order_by": [F.col("o_totalprice").desc(), "o_orderkey"]}]}
    return run_dashboard(tbl(spark, sf, "orders"), spec)["top"]


@register("normalise_types", "SELECT c_custkey, c_name, c_nationkey::BIGINT AS c_nationkey, c_acctbal, c_mktsegment FROM customer")
def q_normalise_types(spark, sf):
    return TY.normalise_types(tbl(spark, sf, "customer"))


@register("geo_columns")
def q_geo_columns(spark, sf):
    c = tbl(spark, sf, "customer")
    return TY.geo_columns(c.select((F.col("c_acctbal") / 200.0).alias("latitude"),
                                   (F.col("c_custkey") % 360 - 180).alias("lon"), "c_custkey"))


@register("detect_sniffed_delimiter")
def q_detect_sniffed_delimiter(spark, sf):
    p = tbl(spark, sf, "part")
    path = scratch_path(spark, "pipe")
    W.write_csv(p, path, sep="|")
    return spark.createDataFrame([(RD.sniff_delimiter(spark, path),)], "delimiter string")


_KIND_SQL = """CASE WHEN data_type = 'BOOLEAN' THEN 'boolean'
  WHEN data_type IN ('TINYINT', 'SMALLINT', 'INTEGER', 'BIGINT', 'FLOAT', 'DOUBLE') OR data_type LIKE 'DECIMAL%' THEN 'numeric'
  WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'datetime' WHEN data_type = 'VARCHAR' THEN 'categorical'
  ELSE 'other' END"""
_SPARK_TYPE_SQL = """CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
  WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' WHEN 'BOOLEAN' THEN 'boolean' ELSE lower(data_type) END"""


@register("column_kinds_catalog", f"""SELECT column_name, {_SPARK_TYPE_SQL} AS dtype, {_KIND_SQL} AS kind
  FROM information_schema.columns WHERE table_name = 'orders'""")
def q_column_kinds_catalog(spark, sf):
    return TY.column_kinds(tbl(spark, sf, "orders"))


@register("type_counts_catalog", f"""SELECT {_KIND_SQL} AS kind, count(*) AS "columns"
  FROM information_schema.columns WHERE table_name = 'lineitem' GROUP BY 1""")
def q_type_counts_catalog(spark, sf):
    from tessera.operators import profile as P
    return P.type_counts(tbl(spark, sf, "lineitem"))
