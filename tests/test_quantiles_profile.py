import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import profile as P
from tessera.plans.quantiles import exact_quantiles, quantile_values


def test_tiny_nulls_statistics(tiny_nulls):
    r = {row["column_name"]: row for row in P.summary_statistics(tiny_nulls, ["x"]).collect()}["x"]
    assert r["count"] == 5 and r["missing"] == 1
    assert r["skew"] == pytest.approx(1.002556, abs=1e-6)
    assert r["kurtosis"] == pytest.approx(-0.430514, abs=1e-6)
    assert (r["q25"], r["median"], r["q75"]) == (2.5, 2.5, 7.0)
    pop = {row["column_name"]: row for row in P.shape_statistics(tiny_nulls, ["x"]).collect()}["x"]
    assert pop["skewness"] == pytest.approx(0.672535, abs=1e-6)
    assert pop["kurtosis"] == pytest.approx(-1.107628, abs=1e-6)


@pytest.mark.parametrize("max_rows", [2_000_000, 50, 7])
def test_exact_quantiles_match_numpy(spark, max_rows):
    rng = np.random.default_rng(3)
    vals = np.round(rng.gamma(2.0, 10.0, 700), 1)  # many ties
    groups = rng.integers(0, 3, 700)
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)], "g int, v double")
    ps = [0.0, 0.1, 0.25, 0.5, 0.9, 0.99, 1.0]
    got = {(r["g"], r["p"]): r["q"] for r in
           exact_quantiles(df, "v", ps, "g", max_bracket_rows=max_rows, grid=20, accuracy=100).collect()}
    for g in range(3):
        sub = vals[groups == g]
        for p in ps:
            assert got[(g, p)] == pytest.approx(float(np.quantile(sub, p)), rel=1e-12)


def test_quantiles_skip_nulls_and_hot_value(spark):
    rows = [(None,)] * 5 + [(5.0,)] * 400 + [(float(i),) for i in range(200)]
    df = spark.createDataFrame(rows, "v double")
    arr = np.array([5.0] * 400 + list(range(200)), dtype=float)
    got = quantile_values(df, "v", [0.1, 0.5, 0.8], max_bracket_rows=30, grid=10, accuracy=50)
    assert got == pytest.approx([np.quantile(arr, p) for p in (0.1, 0.5, 0.8)])


def test_value_counts_ties_and_missing(tiny_nulls):
    rows = P.value_counts(tiny_nulls, "c", 5).collect()
    assert [(r["value"], r["count"]) for r in rows] == [("b", 3), ("a", 2)]
    assert rows[0]["missing"] == 1 and rows[0]["distinct"] == 2
    assert rows[0]["pct"] == pytest.approx(60.0)


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (2, None), (3, "c")], "k int, v string")
    s = P.duplicate_summary(df).first()
    assert (s["rows"], s["duplicates"]) == (5, 2)
    assert P.duplicate_rows(df).count() == 2
    assert P.duplicate_counts(df).collect()[0]["count"] == 2  # the null-key combination is left out


def test_missing_and_shape(tiny_nulls):
    m = {r["column_name"]: r["missing"] for r in P.missing_table(tiny_nulls).collect()}
    assert m == {"id": 0, "x": 1, "c": 1}
    s = P.shape_summary(tiny_nulls).first()
    assert s["missing_cells"] == 2 and s["numeric_columns"] == 2


def test_empty_and_one_row(spark):
    empty = spark.createDataFrame([], "id int, x double, c string")
    r = P.summary_statistics(empty, ["x"]).first()
    assert r["count"] == 0 and r["median"] is None
    one = spark.createDataFrame([(1, 3.0, "a")], "id int, x double, c string")
    r = P.summary_statistics(one, ["x"]).first()
    assert r["median"] == 3.0 and r["std"] is None and r["skew"] is None


def test_hot_values_need_one_sketch(spark, monkeypatch):
    """Values with more rows than a bracket may hold are counted, not narrowed again and again; columns share the passes."""
    from tessera.plans import quantiles as Q

    calls, plain = [], F.percentile_approx
    monkeypatch.setattr(Q.F, "percentile_approx", lambda *a: calls.append(a) or plain(*a))
    df = spark.range(900).select((F.col("id") % 3).alias("g"), (F.col("id") % 4).cast("double").alias("a"), (F.col("id") * 7 % 900).cast("double").alias("b"))
    got = {(r["column"], r["p"]): r["q"] for r in Q.quantile_long(df, ["a", "b"], [0.25, 0.5], max_bracket_rows=20).collect()}
    assert got == {("a", 0.25): 0.75, ("a", 0.5): 1.5, ("b", 0.25): 224.75, ("b", 0.5): 449.5}
    assert len(calls) == 2
    by = {(r["g"], r["q"]) for r in exact_quantiles(df, "a", [0.5], "g", max_bracket_rows=20).collect()}
    assert by == {(0, 1.5), (1, 1.5), (2, 1.5)} and len(calls) == 3
