import duckdb
import pytest

import __spark_entry__ as E

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and "median" in df.columns


def test_every_sql_has_a_query():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 200


SUBSET = ["summary_statistics", "fill_linear", "rolling_stats", "group_stats_join", "chi2_rxc", "histogram",
          "seasonal_decompose", "ecdf", "label_encode", "sentiment", "resample_weekly", "box_stats_grouped",
          "correlation_spearman", "sample_systematic", "hierarchy_totals", "acf"]


@pytest.mark.parametrize("name", SUBSET)
def test_oracle_subset_sf0001(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    sdf = E.queries()[name](spark, sf)
    cols = sorted(sdf.columns)
    def key(t):
        return tuple((v is None, 0 if v is None else v) for v in t)
    a = sorted((tuple(r[c] for c in cols) for r in sdf.collect()), key=key)
    rel = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    b = sorted((tuple(r[names.index(c)] for c in cols) for r in rel.fetchall()), key=key)
    assert sorted(names) == cols
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y) if all(isinstance(v, (int, float)) or v is None for v in x) else x == y
