import datetime as dt

import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregate as A
from tessera.operators import charts as CH
from tessera.plans import reports as R
from tessera.plans.dashboard import run_dashboard


@pytest.fixture(scope="module")
def ev(spark):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=7 * i), i % 3, ["a", "b", "c"][i % 3], float((i * 37) % 101))
            for i in range(120)]
    return spark.createDataFrame(rows, "id long, ts timestamp_ntz, u long, k string, v double")


def test_candlestick_and_timeline(ev):
    c = {r["period"]: r for r in CH.candlestick(ev, "ts", "v", "DAY").collect()}
    day0 = [r for r in ev.collect() if r["ts"].date() == dt.date(2024, 1, 1)]
    r0 = c[dt.datetime(2024, 1, 1)]
    assert (r0["open"], r0["close"]) == (day0[0]["v"], day0[-1]["v"])
    assert r0["high"] == max(x["v"] for x in day0) and r0["low"] == min(x["v"] for x in day0)
    t = CH.timeline(ev, "ts", "u").orderBy("u", "ts").collect()
    same = [r for r in t if r["u"] == 0]
    assert same[0]["end"] == same[1]["ts"] and same[-1]["end"] is None


def test_caps_and_grids(ev):
    assert CH.scatter_data(ev, ["v", "u"], cap=50).count() == 50
    assert CH.line_data(ev, "ts", ["v"], "k", cap=None).count() == 120
    g = A.surface_grid(ev.withColumn("d", F.col("id") % 4), "k", "d", "v").collect()
    assert len(g) == 12 and all(r["v"] is not None for r in g)


def test_dashboard_and_reports(ev):
    spec = {"filters": [{"column": "k", "type": "multiselect", "value": ["a", "b"]}],
            "metrics": [{"name": "m", "column": "v", "agg": "max", "format": "number"}],
            "charts": [{"name": "c", "kind": "choropleth", "region": "k", "value": "v"}],
            "tables": [{"name": "t", "columns": ["id", "v"], "max_rows": 5, "order_by": ["id"]}]}
    out = run_dashboard(ev, spec)
    assert {r["k"] for r in out["c"].collect()} == {"a", "b"}
    assert out["t"].count() == 5
    rep = R.summary_report(ev)
    assert {r["section"] for r in rep.collect()} == {"dataset", "columns", "numeric", "categorical", "missing"}
    eda = R.eda_report(ev, "basic")
    assert eda.where("section = 'numeric'").select("column_name").distinct().count() == 3


def test_top_with_other_and_waterfall(ev):
    t = {r["category"]: r["total"] for r in A.top_with_other(ev, "k", "v", 2).collect()}
    assert set(t) == {"Other", max(("a", "b", "c"), key=lambda k: sum(r["v"] for r in ev.collect() if r["k"] == k))}
    assert sum(t.values()) == pytest.approx(sum(r["v"] for r in ev.collect()))
    w = A.waterfall(ev, "k", "v", 2).collect()
    assert w[-1]["is_total"] and w[-1]["value"] == pytest.approx(sum(r["value"] for r in w[:-1]))
