"""Feature engineering (FEA3, FEA5, FEA11, FEA12).

Polynomial terms, distances and formulas are column expressions; PCA reduces
the data to a p x p Gram matrix (Arrow batches summed by Spark), solves the
small eigenproblem on the driver and projects with column arithmetic.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.common import c, nan_as_null
from tessera.plans.linalg import cross_products
from tessera.plans.quantiles import exact_quantiles


@nan_as_null
def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2, mode: str = "full") -> DataFrame:
    """Degree-2..d terms (no bias, nulls -> 0), named like ``a_pow_2``, ``a_b``, ``a_pow_2_b``.

    ``mode='full'`` = all monomials; ``'interaction_only'`` = products of distinct columns.
    """
    cols = list(cols)
    xs = {x: F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in cols}
    new = {}
    for d in range(2, degree + 1):
        combos = (itertools.combinations_with_replacement(range(len(cols)), d) if mode == "full"
                  else itertools.combinations(range(len(cols)), d))
        for combo in combos:
            counts = {}
            for i in combo:
                counts[i] = counts.get(i, 0) + 1
            name = "_".join(cols[i] if p == 1 else f"{cols[i]}_pow_{p}" for i, p in sorted(counts.items()))
            e = None
            for i, p in sorted(counts.items()):
                term = xs[cols[i]] if p == 1 else F.pow(xs[cols[i]], F.lit(float(p)))
                e = term if e is None else e * term
            new[name] = e
    return df.withColumns(new)


@nan_as_null
def standardized(df: DataFrame, cols: Sequence[str], fill: float | None = 0.0) -> tuple[DataFrame, list[str]]:
    """(x - mean) / population std per column (sklearn ``StandardScaler``); nulls -> ``fill`` afterwards."""
    from tessera.functions.common import scalar_values
    v = scalar_values(df.agg(*[F.avg(c(x).cast("double")).alias(f"m{i}") for i, x in enumerate(cols)],
                             *[F.stddev_pop(c(x).cast("double")).alias(f"s{i}") for i, x in enumerate(cols)]))
    out = {}
    names = []
    for i, x in enumerate(cols):
        m = F.lit(v.get(f"m{i}")).cast("double")
        sd = v.get(f"s{i}")
        s = F.lit(1.0 if not sd else float(sd))
        z = (c(x).cast("double") - m) / s
        out[f"__z{i}"] = F.coalesce(z, F.lit(fill)) if fill is not None else z
        names.append(f"__z{i}")
    return df.withColumns(out), names


@nan_as_null
def pca(df: DataFrame, cols: Sequence[str], k: int = 2, prefix: str = "PC") -> tuple[DataFrame, DataFrame]:
    """PCA on standardised columns (nulls -> 0).  Returns (rows with PC1..PCk, explained variance ratios).

    Signs: the largest-magnitude loading of each component is positive.
    """
    cols = list(cols)
    d, z = standardized(df, cols)
    n, G = cross_products(d, z)
    cov = G / max(n - 1, 1)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = vals[order], vecs[:, order]
    for j in range(vecs.shape[1]):
        if vecs[np.argmax(np.abs(vecs[:, j])), j] < 0:
            vecs[:, j] = -vecs[:, j]
    ratio = vals / vals.sum()
    proj = {}
    for j in range(k):
        e = None
        for i, zc in enumerate(z):
            term = F.col(zc) * float(vecs[i, j])
            e = term if e is None else e + term
        proj[f"{prefix}{j + 1}"] = e
    out = d.withColumns(proj).drop(*z)
    ev = df.sparkSession.createDataFrame([(f"{prefix}{j + 1}", float(vals[j]), float(ratio[j])) for j in range(k)],
                                         "component string, explained_variance double, explained_variance_ratio double")
    return out, ev


@nan_as_null
def distance_to(df: DataFrame, cols: Sequence[str], metric: str = "euclidean", reference="mean",
                out: str | None = None) -> DataFrame:
    """Distance of every row to a reference point (mean | median | min | max | dict of values).

    Nulls count as 0; cosine distance of a zero vector is 1.
    """
    cols = list(cols)
    if isinstance(reference, dict):
        ref = {x: F.lit(float(reference[x])) for x in cols}
    elif reference == "median":
        ref = {x: exact_quantiles(df, x, [0.5]).select("q").scalar() for x in cols}
    else:
        fn = {"mean": F.avg, "min": F.min, "max": F.max}[reference]
        st = df.agg(*[fn(c(x).cast("double")).alias(f"r{i}") for i, x in enumerate(cols)])
        ref = {x: st.select(f"r{i}").scalar() for i, x in enumerate(cols)}
    xs = {x: F.coalesce(c(x).cast("double"), F.lit(0.0)) for x in cols}
    rs = {x: F.coalesce(ref[x], F.lit(0.0)) for x in cols}
    if metric == "euclidean":
        e = F.sqrt(sum(((xs[x] - rs[x]) ** 2 for x in cols[1:]), (xs[cols[0]] - rs[cols[0]]) ** 2))
    elif metric == "manhattan":
        e = sum((F.abs(xs[x] - rs[x]) for x in cols[1:]), F.abs(xs[cols[0]] - rs[cols[0]]))
    elif metric == "cosine":
        dot = sum((xs[x] * rs[x] for x in cols[1:]), xs[cols[0]] * rs[cols[0]])
        nx = F.sqrt(sum((xs[x] ** 2 for x in cols[1:]), xs[cols[0]] ** 2))
        nr = F.sqrt(sum((rs[x] ** 2 for x in cols[1:]), rs[cols[0]] ** 2))
        e = F.when((nx == 0) | (nr == 0), F.lit(1.0)).otherwise(1 - dot / (nx * nr))
    else:
        raise ValueError(metric)
    return df.withColumn(out or f"{metric}_distance", e)


# -- FEA12 -----------------------------------------------------------------------------------
_ALLOWED = {"abs", "sqrt", "ln", "log", "log10", "exp", "pow", "power", "round", "floor", "ceil", "if", "coalesce",
            "greatest", "least", "sin", "cos", "tan", "mean", "std", "min", "max", "sum", "median", "and", "or", "not",
            "null", "true", "false", "is", "case", "when", "then", "else", "end"}
_NP = {"np.where": "if", "np.log": "ln", "np.log10": "log10", "np.sqrt": "sqrt", "np.exp": "exp", "np.abs": "abs",
       "np.power": "pow", "np.round": "round", "np.floor": "floor", "np.ceil": "ceil", "np.sin": "sin",
       "np.cos": "cos", "np.tan": "tan", "np.maximum": "greatest", "np.minimum": "least"}


@nan_as_null
def formula(df: DataFrame, expr: str, out: str) -> DataFrame:
    """User formula over columns as a SQL expression; ``np.*`` names map to SQL functions and
    ``mean(col)`` / ``std(col)`` / ``min|max|sum|median(col)`` become whole-column scalars."""
    text = expr
    for k, v in _NP.items():
        text = text.replace(k + "(", v + "(")
    aggs = {}

    def agg_sub(m):
        fn, col = m.group(1).lower(), m.group(2).strip().strip("`")
        if col not in df.columns:
            return m.group(0)
        key = f"__agg{len(aggs)}"
        aggs[key] = (fn, col)
        return key
    text = re.sub(r"\b(mean|std|median)\(\s*`?([A-Za-z_][\w ]*)`?\s*\)", agg_sub, text)
    for word in re.findall(r"\b([A-Za-z_]\w*)\s*\(", text):
        if word.lower() not in _ALLOWED:
            raise ValueError(f"function {word} is not allowed in a formula")
    e = F.expr(text)
    scal = {}
    for key, (fn, col) in aggs.items():
        if fn == "median":
            scal[key] = exact_quantiles(df, col, [0.5]).select("q").scalar()
        else:
            f = {"mean": F.avg, "std": F.stddev_samp}[fn]
            scal[key] = df.agg(f(c(col).cast("double"))).scalar()
    d = df.withColumns(scal) if scal else df
    return d.withColumn(out, e).drop(*scal.keys())
