"""Registry: filters (FLT*), sampling (SMP*, SRC5), columns (COL*), joins/sets/sorts (JON*, SET1, SRT*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import columns as CO
from tessera.operators import filters as FL
from tessera.operators import joins as J
from tessera.operators import profile as P
from tessera.operators import sampling as S
from tessera.registry.base import ORDERS_NULLS, fin, orders_nulls, register, rsql, tbl

ON = ORDERS_NULLS + " AS o"


@register("filter_compare", f"""SELECT * FROM {ON} WHERE (o_totalprice > 200000.0 AND o_orderpriority = '1-URGENT')
  OR (o_orderdate <= TIMESTAMP '1995-03-01' AND o_orderpriority IS DISTINCT FROM '5-LOW')
  OR (o_orderpriority IS DISTINCT FROM '3-MEDIUM' AND o_totalprice < 1000.0)""")
def q_filter_compare(spark, sf):
    d = orders_nulls(spark, sf)
    a = FL.filter_rows(d, [("o_totalprice", ">", 200000), ("o_orderpriority", "==", "1-URGENT")], "AND")
    b = FL.filter_rows(d, [("o_orderdate", "<=", "1995-03-01"), ("o_orderpriority", "!=", "5-LOW")], "AND")
    cnd = [("o_orderpriority", "!=", "3-MEDIUM"), ("o_totalprice", "<", 1000)]
    e = FL.filter_rows(d, cnd, "AND")
    return a.unionByName(b).unionByName(e).distinct()


@register("filter_bigint_exact", """SELECT o_orderkey, 9007199254740992 + o_orderkey % 4 AS big FROM orders
  WHERE 9007199254740992 + o_orderkey % 4 = 9007199254740993""")
def q_filter_bigint_exact(spark, sf):
    """Neighbouring whole numbers beyond 2^53 are told apart."""
    o = tbl(spark, sf, "orders").select("o_orderkey", (F.lit(2 ** 53) + F.col("o_orderkey") % 4).alias("big"))
    return FL.filter_rows(o, [("big", "==", 2 ** 53 + 1)])


@register("filter_not_equal_keeps_nulls", f"SELECT * FROM {ON} WHERE o_orderpriority IS DISTINCT FROM '2-HIGH'")
def q_filter_not_equal_keeps_nulls(spark, sf):
    return FL.filter_rows(orders_nulls(spark, sf), [("o_orderpriority", "!=", "2-HIGH")])


@register("filter_between_or", f"""SELECT * FROM {ON} WHERE (o_totalprice BETWEEN 1000.0 AND 5000.0)
  OR o_orderpriority IS NULL OR o_orderdate BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-31'""")
def q_filter_between_or(spark, sf):
    return FL.filter_rows(orders_nulls(spark, sf), [("o_totalprice", "between", (1000, 5000)),
                                                    ("o_orderpriority", "is null", None),
                                                    ("o_orderdate", "between", ("1998-01-01", "1998-01-31"))], "OR")


@register("filter_text", """SELECT * FROM part WHERE (regexp_matches(p_name, 'red|blue') AND starts_with(p_brand, 'Brand#1'))
  OR (ends_with(p_type, 'ALL') AND CAST(p_size AS VARCHAR) IN ('1', '2', '3'))""")
def q_filter_text(spark, sf):
    d = tbl(spark, sf, "part")
    a = FL.filter_rows(d, [("p_name", "contains", "red|blue"), ("p_brand", "starts with", "Brand#1")])
    b = FL.filter_rows(d, [("p_type", "ends with", "ALL"), ("p_size", "in", "1, 2,3")])
    return a.unionByName(b).distinct()


@register("filter_not_null", f"SELECT * FROM {ON} WHERE o_totalprice IS NOT NULL")
def q_filter_not_null(spark, sf):
    return FL.filter_rows(orders_nulls(spark, sf), [("o_totalprice", "is not null", None)])


@register("apply_filters", """SELECT * FROM orders WHERE o_totalprice BETWEEN 10000 AND 300000
  AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate::DATE >= DATE '1996-01-01'
  AND o_orderdate::DATE <= DATE '1997-12-31' AND contains(lower(o_orderstatus), 'o')""")
def q_apply_filters(spark, sf):
    specs = [{"column": "o_totalprice", "type": "range", "value": (10000, 300000)},
             {"column": "o_orderpriority", "type": "multiselect", "value": ["1-URGENT", "2-HIGH"]},
             {"column": "o_orderdate", "type": "date_range", "value": ("1996-01-01", "1997-12-31")},
             {"column": "o_orderstatus", "type": "text", "value": "O"},
             {"column": "missing_column", "type": "text", "value": "x"},
             {"column": "o_custkey", "type": "multiselect", "value": []}]
    return FL.apply_filters(tbl(spark, sf, "orders"), specs)


@register("filter_expr", "SELECT * FROM events WHERE value > 100 AND event_type <> 'view'")
def q_filter_expr(spark, sf):
    return FL.filter_expr(tbl(spark, sf, "events"), "value > 100 AND event_type <> 'view'")


@register("keep_top_categories", """SELECT * FROM part WHERE p_brand IN (SELECT p_brand FROM part
  GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5)""")
def q_keep_top_categories(spark, sf):
    return FL.keep_top(tbl(spark, sf, "part"), "p_brand", 5)


@register("sample_random_n")
def q_sample_random_n(spark, sf):
    return S.sample_n(tbl(spark, sf, "orders"), 500, seed=7, key="o_orderkey")


@register("sample_fraction")
def q_sample_fraction(spark, sf):
    return S.sample_frac(tbl(spark, sf, "lineitem"), 0.05, seed=7)


@register("sample_stratified_counts", """SELECT o_orderpriority, floor(count(*) * 0.1)::BIGINT AS "rows" FROM orders
  WHERE o_orderpriority IS NOT NULL GROUP BY 1 HAVING floor(count(*) * 0.1) > 0""")
def q_sample_stratified_counts(spark, sf):
    s = S.sample_stratified(tbl(spark, sf, "orders"), "o_orderpriority", 0.1, key="o_orderkey", seed=3)
    return S.stratum_counts(s, ["o_orderpriority"])


@register("sample_systematic", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn
  FROM events) WHERE rn % 7 = 0""")
def q_sample_systematic(spark, sf):
    return S.sample_systematic(tbl(spark, sf, "events"), 7, "event_id")


@register("first_last_n", """(SELECT *, 'first' AS part FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 10)
  UNION ALL (SELECT *, 'last' AS part FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10)""")
def q_first_last_n(spark, sf):
    o = tbl(spark, sf, "orders")
    return S.first_n(o, 10, ["o_orderdate", "o_orderkey"]).withColumn("part", F.lit("first")).unionByName(
        S.last_n(o, 10, ["o_orderdate", "o_orderkey"]).withColumn("part", F.lit("last")))


@register("preview_head_tail", """(SELECT event_id, value, 'head' AS mode FROM events ORDER BY ts LIMIT 5)
  UNION ALL (SELECT event_id, value, 'tail' AS mode FROM events ORDER BY ts DESC LIMIT 5)""")
def q_preview_head_tail(spark, sf):
    e = tbl(spark, sf, "events")
    h = P.preview(e, "head", 5, "ts", ["event_id", "value", "ts"]).withColumn("mode", F.lit("head"))
    t = P.preview(e, "tail", 5, "ts", ["event_id", "value", "ts"]).withColumn("mode", F.lit("tail"))
    return h.unionByName(t).drop("ts")


# ---- columns ---------------------------------------------------------------------------------
@register("rename_columns", """SELECT c_custkey AS customer_id, c_name AS "Name", c_nationkey, c_acctbal, c_mktsegment FROM customer""")
def q_rename_columns(spark, sf):
    return CO.rename(tbl(spark, sf, "customer"), {"c_custkey": "customer_id", "c_name": "Name"})


@register("bulk_rename", """SELECT c_custkey AS "x_C_CUSTKEY", c_name AS "x_C_NAME", c_nationkey AS "x_C_NATIONKEY",
  c_acctbal AS "cAcctbal", c_mktsegment AS "cMktsegment" FROM customer""")
def q_bulk_rename(spark, sf):
    d = CO.bulk_rename(tbl(spark, sf, "customer"), "case", "camel", ["c_acctbal", "c_mktsegment"])
    d = CO.bulk_rename(d, "case", "upper", ["c_custkey", "c_name", "c_nationkey"])
    return CO.bulk_rename(d, "prefix", "x_", ["C_CUSTKEY", "C_NAME", "C_NATIONKEY"])


@register("keep_drop_columns", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  l_discount, l_tax FROM lineitem""")
def q_keep_drop_columns(spark, sf):
    d = CO.keep_columns(tbl(spark, sf, "lineitem"), "kind", "numeric")
    d = CO.drop_columns(d, "contains", "SHIPDATE", case=False)
    return d


@register("reorder_columns", "SELECT c_mktsegment, c_acctbal, c_custkey, c_name, c_nationkey FROM customer")
def q_reorder_columns(spark, sf):
    return CO.reorder(tbl(spark, sf, "customer"), "front", ["c_mktsegment", "c_acctbal"])


@register("split_delimiter", """SELECT p_partkey, split_part(p_name, ' ', 1) AS name_0,
  CASE WHEN len(string_split(p_name, ' ')) >= 2 THEN string_split(p_name, ' ')[2] END AS name_1,
  string_split(p_brand, '#') AS brand_parts FROM part""")
def q_split_delimiter(spark, sf):
    d = CO.split_column(tbl(spark, sf, "part"), "p_name", "delimiter", " ", prefix="name_")
    d = CO.split_column(d, "p_brand", "array", "#", prefix="brand_parts")
    return d.select("p_partkey", "name_0", "name_1", "brand_parts")


@register("split_positions_regex", r"""SELECT c_custkey, substring(c_name, 1, 8) AS nm_0, substring(c_name, 9, 3) AS nm_1,
  substring(c_name, 12) AS nm_2, CASE WHEN regexp_matches(c_name, '([A-Za-z]+)#(\d+)') THEN regexp_extract(c_name, '([A-Za-z]+)#(\d+)', 0) END AS rx_0,
  CASE WHEN regexp_matches(c_name, '([A-Za-z]+)#(\d+)') THEN regexp_extract(c_name, '([A-Za-z]+)#(\d+)', 1) END AS rx_1,
  CASE WHEN regexp_matches(c_name, '([A-Za-z]+)#(\d+)') THEN regexp_extract(c_name, '([A-Za-z]+)#(\d+)', 2) END AS rx_2
  FROM customer""")
def q_split_positions_regex(spark, sf):
    d = CO.split_column(tbl(spark, sf, "customer"), "c_name", "positions", [8, 11], prefix="nm_")
    d = CO.split_column(d, "c_name", "regex", r"([A-Za-z]+)#(\d+)", prefix="rx_")
    return d.select("c_custkey", "nm_0", "nm_1", "nm_2", "rx_0", "rx_1", "rx_2")


@register("merge_columns", f"""SELECT o_orderkey, concat_ws(' | ', o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)) AS merged,
  concat_ws('-', o_orderstatus, coalesce(o_orderpriority, '')) AS merged_empty FROM {ON}""")
def q_merge_columns(spark, sf):
    d = CO.merge_columns(orders_nulls(spark, sf), ["o_orderstatus", "o_orderpriority", "o_custkey"], " | ", "merged")
    d = CO.merge_columns(d, ["o_orderstatus", "o_orderpriority"], "-", "merged_empty", null_as="")
    return d.select("o_orderkey", "merged", "merged_empty")


@register("join_words", r"""WITH w AS (SELECT p_partkey, list_filter(regexp_split_to_array(concat_ws(' ', p_name, p_type, p_name), '\s+'),
  lambda x: x <> '') AS ws FROM part)
  SELECT p_partkey, array_to_string(ws, ' ') AS joined,
  array_to_string(list_filter(ws, lambda x, i: list_position(ws, x) = i), '') AS joined_dedup FROM w""")
def q_join_words(spark, sf):
    d = CO.join_words(tbl(spark, sf, "part"), ["p_name", "p_type", "p_name"], True, False, "joined")
    d = CO.join_words(d, ["p_name", "p_type", "p_name"], False, True, "joined_dedup")
    return d.select("p_partkey", "joined", "joined_dedup")


# ---- joins / sets / sorts ------------------------------------------------------------------------
@register("lookup_map", """SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def q_lookup_map(spark, sf):
    d = J.lookup(tbl(spark, sf, "customer"), tbl(spark, sf, "nation"), "c_nationkey", "n_name", "nation",
                 mapping_key="n_nationkey")
    return d.select("c_custkey", "nation")


@register("semi_join_keep", """SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def q_semi_join_keep(spark, sf):
    keys = tbl(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.semi_keep(tbl(spark, sf, "orders"), keys, "o_custkey")


@register("union_all", """SELECT o_orderkey, o_totalprice, 'urgent' AS src FROM orders WHERE o_orderpriority = '1-URGENT'
  UNION ALL SELECT o_orderkey, o_totalprice, 'low' AS src FROM orders WHERE o_orderpriority = '5-LOW'""")
def q_union_all(spark, sf):
    o = tbl(spark, sf, "orders")
    a = o.where("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_totalprice", F.lit("urgent").alias("src"))
    b = o.where("o_orderpriority = '5-LOW'").select("o_orderkey", "o_totalprice", F.lit("low").alias("src"))
    return J.union_all(a, b)


@register("sort_abs_top", rsql("""SELECT c_custkey, c_acctbal FROM customer ORDER BY abs(c_acctbal) DESC, c_custkey LIMIT 20""",
                               ["c_acctbal"]))
def q_sort_abs_top(spark, sf):
    d = J.sort_by(tbl(spark, sf, "customer"), ["c_acctbal", "c_custkey"], [False, True], absolute=True).limit(20)
    return fin(d.select("c_custkey", "c_acctbal"))


@register("sort_value_order", """SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY CASE o_orderpriority
  WHEN '3-MEDIUM' THEN 0 WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey) AS position FROM orders""")
def q_sort_value_order(spark, sf):
    # the whole table in the user's value order; the position column makes the order checkable
    o = tbl(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    srt = J.sort_by(o, ["o_orderpriority"], True, value_order=["3-MEDIUM", "1-URGENT"], then_by=["o_orderkey"])
    from tessera.plans.ordered import sorted_codes
    return sorted_codes(srt.withColumn("__r", F.coalesce(F.create_map(F.lit("3-MEDIUM"), F.lit(0), F.lit("1-URGENT"),
                                                                      F.lit(1))[F.col("o_orderpriority")], F.lit(2))),
                        ["__r", "o_orderkey"], "position").select("o_orderkey", "o_orderpriority",
                                                                  (F.col("position") + 1).alias("position"))


@register("top_k", """(SELECT *, 'top' AS side FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 10)
  UNION ALL (SELECT *, 'bottom' AS side FROM lineitem ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey LIMIT 10)""")
def q_top_k(spark, sf):
    li = tbl(spark, sf, "lineitem")
    tie = ["l_orderkey", "l_linenumber", "l_partkey"]
    t = J.top_k(li, "l_extendedprice", 10, True, tie)
    b = J.top_k(li, "l_extendedprice", 10, False, tie)
    return t.withColumn("side", F.lit("top")).unionByName(b.withColumn("side", F.lit("bottom")))


@register("preview_sample")
def q_preview_sample(spark, sf):
    return P.preview(tbl(spark, sf, "orders"), "sample", 5, cols=["o_orderkey", "o_totalprice"])


@register("sample_chunks")
def q_sample_chunks(spark, sf):
    return S.sample_chunks(tbl(spark, sf, "lineitem"), 0.5, seed=11)


@register("sample_on_load")
def q_sample_on_load(spark, sf):
    return S.sample_on_load(tbl(spark, sf, "lineitem"), 1000, seed=5, key=["l_orderkey", "l_linenumber", "l_partkey"])
