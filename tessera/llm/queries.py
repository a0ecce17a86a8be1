"""One query per operator, with production parameters over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import (collocations, exact_dedup, extract, hard_negatives, line_dedup, lm, packing, pieces, quality, sharding,
                         simhash, substring, warc)
from tessera.llm.common import Query, table
from tessera.session import scratch_path


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is (never copied into the repository)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, radius=2).select(
        "doc_id", "fingerprint", "component_id")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"),
                                  capacity=2048, end_id=1)


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=8)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_main_text(table(spark, sf_dir, "pages"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), removed_col="removed")
    return out.select("doc_id", "text", "removed", F.size("removed").alias("n_removed"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"), min_bytes=0)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_and_check(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"), support=100, longest=5, top=2000)


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_packing, op3_sharding, op4_quality_rules, op5_html_extraction, op6_substring_dedup,
    op7_warc, op8_lm_scoring, op9_exact_dedup, op10_sentencepiece, op11_line_dedup, op12_hard_negatives, op13_collocations)}


def _op4_sql() -> str:
    word = "[^\\x20\\x09-\\x0D]+"
    stops = ", ".join("'" + w.replace("'", "''") + "'" for w in quality.stop_forms())
    rules = {r.name: r.bound for r in quality.RULES}
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, regexp_extract_all(t, '{word}') AS ws FROM d),
g AS (SELECT rid, unnest(range(1, len(ws) - 6)) AS p, ws FROM w WHERE len(ws) >= 8),
k AS (SELECT rid, p, list_aggregate(ws[p:p + 7], 'string_agg', ' ') AS gram FROM g),
hit AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, gram) AS n FROM k) WHERE n > 1),
cov AS (SELECT rid, sum(least(8, nxt - p)) AS n FROM
  (SELECT rid, p, coalesce(lead(p) OVER (PARTITION BY rid ORDER BY p), p + 8) AS nxt FROM hit) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words,
  coalesce(length(array_to_string(ws, '')), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
  len(regexp_extract_all(t, '!'))::BIGINT AS n_exclaim,
  len(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]')))::BIGINT AS n_lines,
  len(list_distinct(list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\\x20\\x09-\\x0D]'))))::BIGINT AS n_uniq,
  len(list_filter(ws, lambda s: s IN ({stops})))::BIGINT AS n_stop,
  coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (rid)),
v AS (SELECT *, n_lines - n_uniq AS n_dup_lines, greatest(n_words, 1) AS n,
  (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND word_chars / n >= {rules['word_length_low']}::DOUBLE AND word_chars / n <= {rules['word_length_high']}::DOUBLE
   AND n_symbols / n <= {rules['symbols']}::DOUBLE AND n_exclaim / n <= {rules['exclamations']}::DOUBLE
   AND n_dup_lines / greatest(n_lines, 1) <= {rules['duplicate_lines']}::DOUBLE
   AND n_stop / n >= {rules['stop_words']}::DOUBLE) AS kept
FROM v"""


ORACLE_SQL: dict[str, str] = {
    "op4_quality_rules": _op4_sql(),
    "op7_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS h,
  min(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(h, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31) + 1)::INT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS NOT DISTINCT FROM first_id THEN NULL ELSE first_id END AS refers_to
FROM d""",
    "op9_exact_dedup": """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op11_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
r AS (SELECT key, max(doc_id) AS last FROM (SELECT DISTINCT doc_id, key FROM k WHERE length(key) >= 20) GROUP BY key HAVING count(*) >= 3),
m AS (SELECT rid, doc_id, line, i, r.key IS NOT NULL AND k.doc_id IS DISTINCT FROM r.last AS gone FROM k LEFT JOIN r USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid""",
    "op12_hard_negatives": """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE label IS NOT NULL AND vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
  list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i]))::BIGINT AS score
  FROM (SELECT * FROM e WHERE vec_id % 100 = 0) a, e b WHERE a.vec_id <> b.vec_id),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, (row_number() OVER w)::INTEGER AS rank, s.vec_id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) QUALIFY rank <= 10""",
    "op13_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
t AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w, range(1, 6) AS s(size) WHERE len(ws) >= size),
f AS (SELECT lang, array_to_string(ws[i:i + size - 1], ' ') AS phrase, any_value(size) AS size, count(*) AS a FROM g GROUP BY 1, 2 HAVING count(*) >= 100),
c AS (SELECT lang, phrase, a, size, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
cov AS (SELECT lang, array_to_string(ws[i:i + k - 1], ' ') AS phrase, max(a) AS cover FROM
  (SELECT lang, a, ws, k, unnest(range(1, size - k + 2)) AS i FROM c, range(2, 5) AS s(k) WHERE k < size) GROUP BY 1, 2),
o AS (SELECT c.* FROM c LEFT JOIN cov USING (lang, phrase) WHERE cover IS NULL OR 100 * cover < 100 * a),
x AS (SELECT o.lang, o.phrase, o.a, k, l.a AS l, r.a AS r, t.n, (1000::HUGEINT * o.a * t.n) // (l.a::HUGEINT * r.a) AS score
  FROM o JOIN range(1, 5) AS s(k) ON k < o.size JOIN t USING (lang)
  JOIN f l ON l.lang = o.lang AND l.phrase = array_to_string(o.ws[:k], ' ')
  JOIN f r ON r.lang = o.lang AND r.phrase = array_to_string(o.ws[k + 1:], ' ')),
b AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM b QUALIFY rank <= 2000""",
}
