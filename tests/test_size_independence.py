"""Ordered operators, quantiles and filters give the same answer at every block or bracket size."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import filters as FL
from tessera.operators import windows as W
from tessera.plans import ordered as O
from tessera.plans.quantiles import exact_quantiles

SIZES = [1, 3, 1000, None]


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(3)
    rows = []
    for key in ("a", None, "b"):
        for t in range(17):
            v = float(rng.integers(0, 9)) if rng.random() > 0.25 else None
            rows.append((key, t // 6, t, v))
    rows += [("c", 0, t, None) for t in range(4)] + [("c", 0, 9, 5.0)]
    return pd.DataFrame(rows, columns=["k", "t", "u", "v"]).sample(frac=1, random_state=1)


def frame(spark, pdf):
    rows = [(r.k if isinstance(r.k, str) else None, int(r.t), int(r.u), None if pd.isna(r.v) else float(r.v)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "k string, t int, u int, v double").repartition(3)


def back(df, cols):
    out = df.toPandas()
    out["k"] = out["k"].where(out["k"].notna(), "~")
    return out.sort_values(["k", "t", "u"]).reset_index(drop=True)[cols].astype("float64")


def by_key(pdf, fn):
    p = pdf.copy()
    p["k"] = p["k"].where(p["k"].notna(), "~")
    p = p.sort_values(["k", "t", "u"]).reset_index(drop=True)
    p["v"] = p["v"].astype("float64")
    return p.groupby("k", group_keys=False)["v"].apply(fn).reset_index(drop=True)


CASES = {
    "index": (lambda d, s: O.row_index(d, ["t", "u"], "k", "o", s), lambda v: pd.Series(range(len(v)), index=v.index, dtype=float)),
    "cumsum": (lambda d, s: O.cumulative(d, "v", "sum", ["t", "u"], "k", {"v": "o"}, s), lambda v: v.cumsum()),
    "ffill": (lambda d, s: O.fill_forward(d.withColumn("o", F.col("v")), "o", ["t", "u"], "k", s), lambda v: v.ffill()),
    "bfill": (lambda d, s: O.fill_backward(d.withColumn("o", F.col("v")), "o", ["t", "u"], "k", s), lambda v: v.bfill()),
    "interpolate": (lambda d, s: O.interpolate_linear(d.withColumn("o", F.col("v")), "o", ["t", "u"], "k", s), lambda v: v.interpolate()),
    "rolling": (lambda d, s: W.rolling(d, "v", 3, ["sum"], ["t", "u"], "k", {"sum": "o"}, rows_per_block=s), lambda v: v.rolling(3).sum()),
    "expanding": (lambda d, s: W.expanding(d, "v", ["std"], ["t", "u"], "k", {"std": "o"}, s), lambda v: v.expanding().std()),
    "rolling median": (lambda d, s: W.rolling(d, "v", 4, ["median"], ["t", "u"], "k", {"median": "o"}, rows_per_block=s), lambda v: v.rolling(4).median()),
    "expanding median": (lambda d, s: W.expanding_median(d, "v", ["t", "u"], "k", "o", s), lambda v: v.expanding().median()),
    "ema": (lambda d, s: W.ema(d, "v", 4, ["t", "u"], "k", "o", s), lambda v: v.ewm(span=4, adjust=False).mean()),
}


@pytest.mark.parametrize("name", CASES)
def test_ordered_operators_match_pandas_at_every_block_size(spark, series, name):
    op, want = CASES[name]
    expected = by_key(series, want)
    for size in SIZES if name in ("index", "ema") else [3, None]:
        got = back(op(frame(spark, series), size), ["o"])["o"]
        pd.testing.assert_series_equal(got, expected, check_names=False, rtol=1e-9, obj=f"{name} at {size}")


def test_large_values_do_not_cancel(spark):
    x = [1e9 + v for v in (0, 1, 2, 0, 1, 2, 1, 1)]
    d = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "t int, v double")
    want = pd.Series(x).expanding().std()
    for size in (3, None):
        got = W.expanding(d, "v", ["std"], "t", rows_per_block=size).orderBy("t").toPandas()["v_expanding_std"]
        assert np.allclose(got.to_numpy(float), want.to_numpy(), rtol=1e-6, equal_nan=True)


def test_one_value_of_the_order_key_is_split(spark):
    d = spark.range(1000).select(F.lit(7).alias("t"), F.col("id").alias("u"))
    blocks, n = O.add_blocks(d, ["t", "u"], 100)
    biggest = blocks.groupBy("__blk").count().agg(F.max("count")).first()[0]
    assert n >= 9 and biggest <= 150
    assert [r[0] for r in O.row_index(d, ["t", "u"], out="o", rows_per_block=100).orderBy("u").select("o").collect()] == list(range(1000))
    blocks, _ = O.add_blocks(d, ["t"], 100)  # no second key: ties have no order, rows are spread
    assert blocks.groupBy("__blk").count().agg(F.max("count")).first()[0] <= 200


def test_block_count_is_not_bounded(spark):
    blocks, n = O.add_blocks(spark.range(9000).withColumnRenamed("id", "t"), ["t"], 3)
    assert blocks.select("__blk").distinct().count() > 2500


@pytest.mark.parametrize("bound", [5, 50, 2_000_000])
def test_quantiles_with_null_groups(spark, bound):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["x", "y", "~"], 400), "v": np.round(rng.normal(size=400), 2)})
    d = spark.createDataFrame([(None if g == "~" else g, float(v)) for g, v in pdf.itertuples(index=False)], "g string, v double")
    got = {(r["g"] or "~", r["p"]): r["q"] for r in exact_quantiles(d, "v", [0.1, 0.5, 0.99], "g", max_bracket_rows=bound).collect()}
    want = pdf.groupby("g")["v"].quantile([0.1, 0.5, 0.99])
    assert set(got) == set(want.index) and all(got[k] == pytest.approx(want[k]) for k in got)
    one = [r["q"] for r in exact_quantiles(d, "v", [0.5], max_bracket_rows=bound).collect()]
    assert one == [pytest.approx(pdf["v"].median())]


def test_filters_are_pushed_down_and_exact(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(2 ** 53, "ab", 1.5), (2 ** 53 + 1, "b", 2.0), (None, None, None)], "id long, s string, x double").write.parquet(path)
    d = spark.read.parquet(path)
    assert [r["id"] for r in FL.filter_rows(d, [("id", "==", 2 ** 53 + 1)]).collect()] == [2 ** 53 + 1]
    assert FL.filter_rows(d, [("id", ">", 2.5)]).count() == 2
    for cond in (("x", ">", 1), ("id", "==", 3), ("id", "between", (1, 5)), ("s", "in", "ab, c"), ("s", "starts with", "a"), ("id", "in", "1,2")):
        plan = FL.filter_rows(d, [cond])._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert pushed.replace("IsNotNull", "").strip("() ,a-z") != "" or "(" in pushed.replace("IsNotNull(", ""), (cond, pushed)


def test_nan_is_missing(spark):
    from tessera.operators import cleaning as C
    from tessera.operators import profile as P
    d = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, 3.0), (4, None)], "id int, x double")
    row = P.summary_statistics(d, ["x"]).first()
    assert (row["count"], row["mean"], row["max"], row["missing"], row["median"]) == (2, 2.0, 3.0, 2, 2.0)
    assert {r["column_name"]: r["missing"] for r in P.missing_table(d).collect()}["x"] == 2
    assert [r["x"] for r in C.fill_mean(d, "x").orderBy("id").collect()] == [1.0, 2.0, 3.0, 2.0]
    assert C.drop_missing(d).count() == 2
    assert [r["x"] for r in C.fill_forward(d, ["x"], "id").orderBy("id").collect()] == [1.0, 1.0, 3.0, 3.0]


def test_many_short_series_need_no_carry(spark):
    """2,000 series of ten rows and one long one: only the long one is cut and summarised."""
    rows = [(k, t, float((k * 7 + t * 3) % 11)) for k in range(2000) for t in range(10)] + [(-1, t, float(t % 13)) for t in range(1500)]
    df = spark.createDataFrame(rows, "k int, t int, v double").repartition(4)
    d, nb = O.add_blocks(df, ["t"], 500, ["k"])
    carries = O.carried(d).groupBy("k", O._BLK).count().count()
    assert nb == 3 and carries < 0.01 * len(rows)
    assert O.add_blocks(df.where("k >= 0"), ["t"], 500, ["k"])[1] == 1
    pdf = pd.DataFrame(rows, columns=["k", "t", "v"])
    got = O.cumulative(df, "v", "sum", ["t"], "k", {"v": "o"}, 500).toPandas().sort_values(["k", "t"])["o"].to_numpy()
    assert np.allclose(got, pdf.sort_values(["k", "t"]).groupby("k")["v"].cumsum().to_numpy())


@pytest.mark.parametrize("n", [0, 1, 137, 700, 1000, 5000])
def test_exact_samples_of_any_size(spark, n):
    from tessera.operators import sampling as SM
    df = spark.createDataFrame([(i if i < 600 else 600, "same" if i >= 600 else "x") for i in range(1000)], "i int, s string").repartition(5)
    out = SM.sample_n(df, n, 7)
    rows = sorted(map(tuple, out.collect()))
    assert len(rows) == min(n, 1000) and out.columns == df.columns
    assert rows == sorted(map(tuple, SM.sample_n(df.coalesce(1), n, 7).collect()))
    by_key = SM.sample_n(df, n, 7, key="s").collect()
    assert len(by_key) == min(n, 1000)
