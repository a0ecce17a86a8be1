"""Registry: categorical encoders (CAT*) and text features (TXT*)."""

from __future__ import annotations

from tessera.operators import category as K
from tessera.operators import text as X
from tessera.registry.base import ORDERS_NULLS, fin, orders_nulls, register, rsql, tbl

ON = ORDERS_NULLS + " AS o"
PRIOS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _one_hot_sql():
    cols = ", ".join(f"coalesce(o_orderpriority = '{v}', false) AS \"o_orderpriority_{v}\"" for v in PRIOS)
    return f"SELECT o_orderkey, {cols} FROM {ON}"


@register("one_hot", _one_hot_sql())
def q_one_hot(spark, sf):
    d = K.one_hot(orders_nulls(spark, sf), "o_orderpriority", keep=False)
    return d.select("o_orderkey", *[f"`o_orderpriority_{v}`" for v in PRIOS])


@register("label_encode", """WITH f AS (SELECT o_orderpriority AS v, min(o_orderkey) AS first FROM orders
  WHERE o_orderpriority IS NOT NULL GROUP BY 1), c AS (SELECT v, (row_number() OVER (ORDER BY first, v) - 1)::BIGINT AS code FROM f)
  SELECT o_orderkey, c.code AS o_orderpriority FROM orders LEFT JOIN c ON orders.o_orderpriority = c.v""")
def q_label_encode(spark, sf):
    return K.label_encode(tbl(spark, sf, "orders"), "o_orderpriority", "o_orderkey").select("o_orderkey", "o_orderpriority")


@register("frequency_encode", rsql(f"""WITH g AS (SELECT o_orderpriority AS v, count(*) AS n FROM {ON}
  WHERE o_orderpriority IS NOT NULL GROUP BY 1)
  SELECT o_orderkey, g.n / (SELECT sum(n) FROM g) AS o_orderpriority FROM {ON} LEFT JOIN g ON o.o_orderpriority = g.v""",
                                   ["o_orderpriority"]))
def q_frequency_encode(spark, sf):
    return fin(K.frequency_encode(orders_nulls(spark, sf), "o_orderpriority").select("o_orderkey", "o_orderpriority"))


@register("count_encode", f"""WITH g AS (SELECT o_orderpriority AS v, count(*) AS n FROM {ON}
  WHERE o_orderpriority IS NOT NULL GROUP BY 1)
  SELECT o_orderkey, g.n AS o_orderpriority FROM {ON} LEFT JOIN g ON o.o_orderpriority = g.v""")
def q_count_encode(spark, sf):
    return K.count_encode(orders_nulls(spark, sf), "o_orderpriority").select("o_orderkey", "o_orderpriority")


@register("target_encode", rsql(f"""WITH g AS (SELECT o_orderpriority AS v, avg(o_totalprice) AS m FROM {ON}
  WHERE o_orderpriority IS NOT NULL GROUP BY 1)
  SELECT o_orderkey, g.m AS o_orderpriority FROM {ON} LEFT JOIN g ON o.o_orderpriority = g.v""", ["o_orderpriority"]))
def q_target_encode(spark, sf):
    return fin(K.target_encode(orders_nulls(spark, sf), "o_orderpriority", "o_totalprice")
               .select("o_orderkey", "o_orderpriority"))


@register("binary_encode", """WITH c AS (SELECT v, (row_number() OVER (ORDER BY v) - 1)::BIGINT AS code FROM
  (SELECT DISTINCT p_brand AS v FROM part WHERE p_brand IS NOT NULL)),
  j AS (SELECT p_partkey, coalesce(c.code, -1) AS code FROM part LEFT JOIN c ON part.p_brand = c.v)
  SELECT p_partkey, ((code >> 0) & 1)::INTEGER AS p_brand_bin_0, ((code >> 1) & 1)::INTEGER AS p_brand_bin_1,
    ((code >> 2) & 1)::INTEGER AS p_brand_bin_2, ((code >> 3) & 1)::INTEGER AS p_brand_bin_3,
    ((code >> 4) & 1)::INTEGER AS p_brand_bin_4 FROM j""")
def q_binary_encode(spark, sf):
    d = K.binary_encode(tbl(spark, sf, "part"), "p_brand")
    return d.select("p_partkey", *[f"p_brand_bin_{i}" for i in range(5)])


@register("ordinal_encode", f"""SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 0 WHEN '4-NOT SPECIFIED' THEN 1
  WHEN '3-MEDIUM' THEN 2 WHEN '2-HIGH' THEN 3 WHEN '1-URGENT' THEN 4 END AS o_orderpriority FROM {ON}""")
def q_ordinal_encode(spark, sf):
    d = K.ordinal_encode(orders_nulls(spark, sf), "o_orderpriority", list(reversed(PRIOS)))
    return d.select("o_orderkey", "o_orderpriority")


@register("clean_string", r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text),
  '[^\p{L}\p{N}_\s]', '', 'g'), '\d', '', 'g'), '\s+', ' ', 'g')) AS text FROM documents""")
def q_clean_string(spark, sf):
    return K.clean_string(tbl(spark, sf, "documents"), "text", ["lower", "punct", "digits", "spaces"]).select("doc_id", "text")


@register("clean_html", r"""SELECT page_id, trim(regexp_replace(regexp_replace(html, '<.*?>', '', 'g'), '\s+', ' ', 'g'))
  AS html FROM pages""")
def q_clean_html(spark, sf):
    return K.clean_string(tbl(spark, sf, "pages"), "html", ["html", "spaces"]).select("page_id", "html")


@register("text_features", r"""SELECT doc_id, length(text)::INTEGER AS n_len, len(regexp_extract_all(text, '\S+'))::INTEGER AS n_words,
  length(regexp_replace(text, '[^\p{L}]', '', 'g'))::INTEGER AS n_alpha, contains(text, 'the') AS has_the,
  contains(lower(text), 'the') AS has_the_ci FROM documents""")
def q_text_features(spark, sf):
    d = tbl(spark, sf, "documents")
    d = X.text_length(d, "text", "n_len")
    d = X.word_count(d, "text", "n_words")
    d = X.alpha_count(d, "text", "n_alpha")
    d = X.contains_text(d, "text", "the", True, "has_the")
    d = X.contains_text(d, "text", "The", False, "has_the_ci")
    return d.select("doc_id", "n_len", "n_words", "n_alpha", "has_the", "has_the_ci")


@register("text_patterns", r"""SELECT page_id, CASE WHEN regexp_matches(url, '[a-z]+\.example\.[a-z]+')
  THEN regexp_extract(url, '[a-z]+\.example\.[a-z]+', 0) END AS host,
  len(regexp_extract_all(html, '<p>'))::INTEGER AS n_par FROM pages""")
def q_text_patterns(spark, sf):
    d = tbl(spark, sf, "pages")
    d = X.extract_pattern(d, "url", r"[a-z]+\.example\.[a-z]+", "host")
    d = X.count_pattern(d, "html", "<p>", "n_par")
    return d.select("page_id", "host", "n_par")


_POS = ", ".join(f"'{w}'" for w in X.POSITIVE_WORDS)
_NEG = ", ".join(f"'{w}'" for w in X.NEGATIVE_WORDS)


@register("sentiment", rf"""WITH w AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws
  FROM conversations), c AS (SELECT conv_id, turn, len(list_filter(ws, lambda x: list_contains([{_POS}], x))) AS p,
  len(list_filter(ws, lambda x: list_contains([{_NEG}], x))) AS n FROM w)
  SELECT conv_id, turn, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment FROM c""")
def q_sentiment(spark, sf):
    return X.sentiment(tbl(spark, sf, "conversations"), "text", "sentiment").select("conv_id", "turn", "sentiment")


@register("sentiment_documents", rf"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+') AS ws
  FROM documents), c AS (SELECT doc_id, len(list_filter(ws, lambda x: list_contains([{_POS}], x))) AS p,
  len(list_filter(ws, lambda x: list_contains([{_NEG}], x))) AS n FROM w)
  SELECT doc_id, CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment FROM c""")
def q_sentiment_documents(spark, sf):
    return X.sentiment(tbl(spark, sf, "documents"), "text", "sentiment").select("doc_id", "sentiment")
