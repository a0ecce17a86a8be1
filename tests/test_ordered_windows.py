import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.operators import cleaning as C
from tessera.operators import windows as W
from tessera.plans import ordered as O


def _col(df, name, key="id"):
    return [r[name] for r in df.orderBy(key).collect()]


def _num(df, name, key="id"):
    return [np.nan if v is None else v for v in _col(df, name, key)]


def test_rolling_nulls_fixture(rolling_nulls):
    d = W.rolling(rolling_nulls, "x", 3, ["sum", "count"], "id", out={"sum": "s", "count": "n"})
    assert _col(d, "s") == [None, None, None, None, None, None, 15.0]
    assert _col(d, "n") == [None, None, 2, 2, 2, 2, 3]
    i = C.fill_linear(rolling_nulls, "x", "id")
    assert _col(i, "x") == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]


@pytest.mark.parametrize("rpb", [1_000_000, 7, 3])
def test_partition_independence(spark, rpb):
    rng = np.random.default_rng(11)
    n = 200
    vals = [None if rng.random() < 0.2 else float(rng.integers(-50, 50)) for _ in range(n)]
    grp = rng.integers(0, 3, n)
    pdf = pd.DataFrame({"id": np.arange(n), "g": grp, "x": vals})
    df = spark.createDataFrame([(int(i), int(g), v) for i, g, v in zip(pdf["id"], pdf["g"], vals)],
                               "id long, g long, x double").repartition(7)
    s = pdf.sort_values("id")
    ff = O.fill_forward(df, ["x"], "id", rows_per_block=rpb)
    assert _num(ff, "x") == pytest.approx(s["x"].ffill().tolist(), nan_ok=True)
    bf = O.fill_backward(df, ["x"], "id", rows_per_block=rpb)
    assert _num(bf, "x") == pytest.approx(s["x"].bfill().tolist(), nan_ok=True)
    cs = O.cumulative(df, ["x"], "sum", "id", rows_per_block=rpb, out={"x": "c"})
    exp = s["x"].cumsum()
    exp[s["x"].isna()] = np.nan
    assert _num(cs, "c") == pytest.approx(exp.tolist(), nan_ok=True)
    ri = O.row_index(df, "id", "g", "r", rows_per_block=rpb)
    expect = s.groupby("g").cumcount().tolist()
    assert _col(ri, "r") == expect
    ro = W.rolling(df, "x", 4, ["mean", "median"], "id", "g", out={"mean": "m", "median": "md"}, rows_per_block=rpb)
    gm = s.groupby("g")["x"].rolling(4).mean().reset_index(level=0, drop=True).sort_index()
    gmd = s.groupby("g")["x"].rolling(4).median().reset_index(level=0, drop=True).sort_index()
    got = _num(ro, "m")
    assert got == pytest.approx(gm.tolist(), nan_ok=True)
    got = _num(ro, "md")
    assert got == pytest.approx(gmd.tolist(), nan_ok=True)
    li = O.interpolate_linear(df, ["x"], "id", rows_per_block=rpb)
    exp_i = s["x"].interpolate()
    assert _num(li, "x") == pytest.approx(exp_i.tolist(), nan_ok=True)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3, allow_nan=False), min_size=1, max_size=40), st.integers(2, 9))
def test_prefix_scan_any_block_size(spark, xs, rpb):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "id int, x double")
    a = _col(O.cumulative(df, ["x"], "sum", "id", out={"x": "c"}, rows_per_block=rpb), "c")
    assert a == pytest.approx(np.cumsum(xs).tolist(), rel=1e-9, abs=1e-6)
    ff = O.fill_forward(df, ["x"], "id", rows_per_block=rpb)
    assert _col(ff, "x") == pytest.approx(xs)


def test_ema_and_expanding(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(10, 3, 300)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "id int, x double")
    for rpb in (1_000_000, 37):
        e = W.ema(df, "x", 12, "id", out="e", rows_per_block=rpb)
        assert _col(e, "e") == pytest.approx(pd.Series(x).ewm(span=12, adjust=False).mean().tolist(), rel=1e-10)
        ex = W.expanding(df, "x", ["mean", "std"], "id", out={"mean": "m", "std": "s"}, rows_per_block=rpb)
        assert _col(ex, "m") == pytest.approx(pd.Series(x).expanding().mean().tolist(), rel=1e-9)
        assert _col(ex, "s")[1:] == pytest.approx(pd.Series(x).expanding().std().tolist()[1:], rel=1e-7)
    md = W.expanding_median(df, "x", "id", out="md")
    assert _col(md, "md") == pytest.approx(pd.Series(x).expanding().median().tolist())


def test_difference_and_monotonic(spark):
    df = spark.createDataFrame([(i, float(i * i)) for i in range(10)], "id int, x double")
    d = W.difference(df, "x", 2, True, "id", out="d2", rows_per_block=3)
    assert _col(d, "d2")[2:] == [2.0] * 8
    m = W.is_monotonic(df, "x", "id").first()
    assert m["increasing"] and not m["decreasing"]


def test_ecdf_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "v double")
    got = sorted((r["value"], r["ecdf"]) for r in W.ecdf(df, "v").collect())
    assert got == [(1.0, 0.25), (2.0, 0.5), (2.0, 0.75), (3.0, 1.0)]


@pytest.mark.parametrize("block", [3, 1000])
def test_ema_crossover_reads_rows_as_a_stream(spark, block):
    """No group of rows is held by a Python worker, and both averages and the row before come from one ordered pass."""
    import pandas as pd

    x = [None, 5.0, 5.0, 5.0, 7.0, None, 1.0, 2.0, 9.0, 9.5, 3.0, None]
    rows = [(k, i, v if k != "b" else 4.0) for k in ("a", None, "b") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "k string, i int, v double")
    d = W.crossover(df, "v", 2, 4, "ema", "i", "k", rows_per_block=block)
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
    got = {(r["k"], r["i"]): r for r in d.collect()}
    for key in ("a", None, "b"):
        s = pd.Series([v for k, _, v in rows if k == key], dtype=float)
        a, b = (s.ewm(span=n, adjust=False).mean() for n in (2, 4))
        signal = (a > b).astype(int) - (a < b).astype(int)
        change = signal.diff().fillna(0).astype(int)
        for i in range(len(x)):
            r = got[key, i]
            assert (r["ema_2"], r["ema_4"]) == (pytest.approx(a[i]) if a[i] == a[i] else None, pytest.approx(b[i]) if b[i] == b[i] else None)
            assert (r["signal"], r["signal_change"]) == (signal[i], change[i])


def test_blocks_of_tied_keys_take_one_pass_per_key(spark, monkeypatch):
    """Values of the first key that fill several blocks are split together, and the plan does not grow with them."""
    calls, plain = [], F.percentile_approx
    monkeypatch.setattr(O.F, "percentile_approx", lambda *a: calls.append(a) or plain(*a))
    df = spark.range(2000).select((F.col("id") % 40).alias("t"), "id")
    d, n = O.add_blocks(df, ["t", "id"], 10)
    assert len(calls) <= 3 and len(d._jdf.queryExecution().optimizedPlan().toString()) < 5000
    rows = d.orderBy("t", "id").collect()
    blocks = [r["__blk"] for r in rows]
    assert blocks == sorted(blocks) and max(blocks) < n
    assert max(np.bincount(blocks)) <= 30
