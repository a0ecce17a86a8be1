"""Distributed Gram matrices: each Arrow batch contributes X'X, Spark sums the
entries by (i, j).  Output size is p^2 regardless of the row count."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cross_products(df: DataFrame, cols: Sequence[str]) -> tuple[int, np.ndarray]:
    """(n, G) with G = X'X over rows where every column is non-null."""
    cols = list(cols)
    p = len(cols)
    data = df.select(*[F.col(f"`{x}`").cast("double").alias(f"c{i}") for i, x in enumerate(cols)]).dropna()

    def batches(it):
        import pandas as pd
        for pdf in it:
            x = pdf.to_numpy(dtype="float64")
            if len(x) == 0:
                continue
            g = x.T @ x
            ii, jj = np.triu_indices(p)
            yield pd.DataFrame({"i": ii.astype("int32"), "j": jj.astype("int32"), "v": g[ii, jj],
                                "n": np.full(len(ii), len(x), dtype="int64")})

    parts = data.mapInPandas(batches, "i int, j int, v double, n long")
    rows = parts.groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()  # p(p+1)/2 rows
    G = np.zeros((p, p))
    n = 0
    for r in rows:
        G[r["i"], r["j"]] = G[r["j"], r["i"]] = r["v"]
        if r["i"] == 0 and r["j"] == 0:
            n = r["n"]
    return int(n), G
