from collections import Counter

import duckdb
import pytest

import __spark_entry__ as E
import corpus_pipeline
from pyspark.sql import functions as F
from tests.llm.edge import empty, frame, got
from tests.llm.test_filter_dedup import brute_components, brute_fp, brute_substring
from tests.llm.test_pack_shard_archive import COLS, check_packing
from tessera.llm import quality
from tessera.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


def brute_pipeline(spark, docs):
    """Each stage by plain Python over (id, text)."""
    kept = {r["doc_id"] for r in quality.quality_report(docs).where("kept").collect()}  # the rules have their own brute force
    data = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in kept]
    best = {}
    for i, t in data:
        best[t] = max(best.get(t, i), i)
    data = sorted((i, t) for t, i in best.items())
    yield data
    label = brute_components([brute_fp(t) for _, t in data], 2)
    low = {}
    for (i, _), c in zip(data, label):
        low[c] = min(low.get(c, i), i)
    data = [(i, t) for (i, t), c in zip(data, label) if low[c] == i]
    yield data
    data = list(brute_substring(data))
    yield data


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    exact, near, cut = brute_pipeline(spark, docs)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "SimHash near-dedup", "substring dedup", "packing"]
    at = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES[:4], (None, exact, near, cut)):
        at = stage(spark, at, SF).cache()
        assert at.columns == docs.columns
        if want is not None:
            assert Counter(got(at, "doc_id", "text")) == Counter(want)
    assert at.where("n_chars <> length(text)").count() == 0
    check_packing(got(corpus_pipeline.run(spark, SF), *COLS), cut, 2048)


def test_stages_with_awkward_rows(spark):
    at = frame(spark).withColumn("n_chars", F.col("doc_id"))
    for _, stage in corpus_pipeline.STAGES[:4]:
        at = stage(spark, at, SF)
        assert at.columns == [*frame(spark).columns, "n_chars"]
        at = spark.createDataFrame(at.collect(), at.schema)
    assert set(COLS) <= set(corpus_pipeline.STAGES[4][1](spark, at, SF).columns)
    nothing = empty(spark)
    for _, stage in corpus_pipeline.STAGES[:3]:
        nothing = stage(spark, nothing, SF)
        assert nothing.count() == 0


def test_registered():
    q = E.queries()
    assert "pipeline" in q and sum(k.startswith("op") and k[2].isdigit() for k in q) == 13
    assert set(ORACLE_SQL) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_twins(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    rel = con.execute(ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    df = QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[c] for c in names) for r in df.collect()) == Counter(rel.fetchall())
