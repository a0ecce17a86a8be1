"""Dashboard spec runner (CHD10): filters applied once, then every component
is evaluated against the same (cached) filtered frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tessera.operators import aggregate as A
from tessera.operators import charts as CH
from tessera.operators.filters import apply_filters


def run_dashboard(df: DataFrame, spec: dict) -> dict[str, DataFrame]:
    """spec = {"filters": [...], "metrics": [{name, column, agg, format}], "charts": [{name, kind, ...}],
    "tables": [{name, columns, max_rows, order_by}]} -> {name: DataFrame}."""
    base = apply_filters(df, spec.get("filters", [])).cache()
    out: dict[str, DataFrame] = {}
    for m in spec.get("metrics", []):
        out[m["name"]] = A.metric(base, m["column"], m.get("agg", "mean"), m.get("format", "number"))
    for ch in spec.get("charts", []):
        params = {k: v for k, v in ch.items() if k not in ("name", "kind")}
        out[ch["name"]] = CH.chart_data(base, ch["kind"], **params)
    for t in spec.get("tables", []):
        cols = t.get("columns") or base.columns
        tb = base.select(*cols)
        if t.get("order_by"):
            tb = tb.orderBy(*t["order_by"])
        out[t["name"]] = tb.limit(t.get("max_rows", 100))
    return out
