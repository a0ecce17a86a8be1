"""Numeric transforms (NUM*) and arithmetic (MTH*).

Scalars (mean, std, min, max, quantiles, shift) are one-row aggregates: used
once or twice they stay scalar subqueries (the plan stays lazy); where a plan
references them many times (bin edges) the few numbers are fetched once and
inlined as literals.  Either way each transform is a narrow projection that
whole-stage codegen compiles.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.common import as_list, c, nan_as_null, nan_to_null, scalar_values
from tessera.plans import ordered as O
from tessera.plans.quantiles import exact_quantiles, quantile_values


def _x(col: str) -> Column:
    return c(col).cast("double")


# -- NUM1-3 scalers ----------------------------------------------------------------------
@nan_as_null
def standardize(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(x - mean) / population std; std 0 -> 1; null -> 0 (the mean of the result)."""
    s = df.agg(F.avg(_x(col)).alias("m"), F.stddev_pop(_x(col)).alias("s"))
    m, sd = s.select("m").scalar(), s.select(F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).scalar()
    return df.withColumn(out or col, F.coalesce((_x(col) - m) / sd, F.lit(0.0)))


@nan_as_null
def min_max(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(x - min) / (max - min) in [0, 1]; constant column -> 0; null -> mean of the result."""
    v = scalar_values(df.agg(F.min(_x(col)).alias("a"), F.max(_x(col)).alias("b"), F.avg(_x(col)).alias("m")))
    if v.get("a") is None:
        return df.withColumn(out or col, F.lit(None).cast("double"))
    a, rng = v["a"], (1.0 if v["b"] == v["a"] else v["b"] - v["a"])
    return df.withColumn(out or col, F.coalesce((_x(col) - F.lit(a)) / F.lit(rng), F.lit((v["m"] - a) / rng)))


@nan_as_null
def robust_scale(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(x - median) / IQR; IQR 0 -> 1; null -> 0 (median of the result)."""
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75]).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q1"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("q2"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q3"))
    med = q.select("q2").scalar()
    iqr = q.select(F.when(F.col("q3") == F.col("q1"), 1.0).otherwise(F.col("q3") - F.col("q1"))).scalar()
    return df.withColumn(out or col, F.coalesce((_x(col) - med) / iqr, F.lit(0.0)))


# -- NUM4-6 ---------------------------------------------------------------------------
def shift_for(df: DataFrame, col: str, strict: bool) -> Column:
    """|min| + 1 when min <= 0 (strict, log/Box-Cox) or min < 0 (sqrt), else 0."""
    mn = df.agg(F.min(_x(col))).scalar()
    cond = (mn <= 0) if strict else (mn < 0)
    return F.when(cond, F.abs(mn) + 1).otherwise(F.lit(0.0))


@nan_as_null
def log_transform(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, F.ln(_x(col) + shift_for(df, col, True)))


@nan_as_null
def sqrt_transform(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, nan_to_null(F.sqrt(_x(col) + shift_for(df, col, False))))


def exp_transform(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, F.exp(_x(col)))


def power_transform(df: DataFrame, col: str, p: float, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, nan_to_null(F.pow(_x(col), F.lit(float(p)))))


@nan_as_null
def normalize_sum(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    tot = df.agg(F.sum(_x(col))).scalar()
    return df.withColumn(out or col, F.try_divide(_x(col), tot))


def _boxcox_llf_aggs(y: Column, lams: Sequence[float]) -> list[Column]:
    aggs = [F.count(y).alias("n"), F.sum(F.ln(y)).alias("sl")]
    for i, lam in enumerate(lams):
        t = F.ln(y) if abs(lam) < 1e-12 else (F.pow(y, F.lit(lam)) - 1) / lam
        aggs.append(F.var_pop(t).alias(f"v{i}"))  # merged about the mean: large values do not cancel
    return aggs


def boxcox_lambda(df: DataFrame, col: str, lo: float = -5.0, hi: float = 5.0, rounds: int = 4,
                  points: int = 41) -> float:
    """MLE lambda of Box-Cox (after the shift rule), to about 1e-3.

    Each round evaluates the profile log-likelihood
    ``(lam - 1) sum(ln y) - n/2 ln(var_pop(T_lam(y)))`` on a grid of lambdas in
    one aggregate pass, then zooms in around the best grid point.
    """
    y = _x(col) + shift_for(df, col, True)
    base = df.select(y.alias("__y")).where(F.col("__y").isNotNull())
    yc = F.col("__y")
    best = 1.0
    for _ in range(rounds):
        lams = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
        r = base.agg(*_boxcox_llf_aggs(yc, lams)).first()
        n, sl = r["n"], r["sl"]
        if not n:
            return float("nan")
        scores = []
        for i, lam in enumerate(lams):
            var = r[f"v{i}"]
            if var is None or not math.isfinite(var) or var <= 0:
                continue
            scores.append(((lam - 1) * sl - n / 2 * math.log(var), lam))
        if not scores:
            break
        best = max(scores)[1]
        step = (hi - lo) / (points - 1)
        lo, hi = best - step, best + step
    return best


@nan_as_null
def box_cox(df: DataFrame, col: str, out: str | None = None, lam: float | None = None) -> DataFrame:
    lam = boxcox_lambda(df, col) if lam is None else lam
    y = _x(col) + shift_for(df, col, True)
    e = F.ln(y) if abs(lam) < 1e-12 else (F.pow(y, F.lit(lam)) - 1) / lam
    return df.withColumn(out or col, e)


# -- NUM7-9 binning --------------------------------------------------------------------
def _bin_from_edges(x: Column, edges: list[Column]) -> Column:
    """0-based bin of right-closed intervals; x equal to the first edge -> bin 0."""
    idx = F.lit(0)
    for e in edges[1:-1]:
        idx = idx + F.when(x > e, 1).otherwise(0)
    return F.when(x.isNull(), F.lit(None)).otherwise(idx).cast("int")


@nan_as_null
def bin_equal_width(df: DataFrame, col: str, n: int, out: str | None = None) -> DataFrame:
    """pandas ``cut(x, n)``: equal-width right-closed bins, left edge widened by 0.1% of the range.

    Adds ``out`` (bin index), ``out_lower`` and ``out_upper``.  min and max
    are fetched once (two numbers) so every edge is a folded literal.
    """
    out = out or f"{col}_bin"
    v = scalar_values(df.agg(F.min(_x(col)).alias("a"), F.max(_x(col)).alias("b")))
    a, b = v.get("a"), v.get("b")
    if a is None:
        return df.withColumns({out: F.lit(None).cast("int"), f"{out}_lower": F.lit(None).cast("double"),
                               f"{out}_upper": F.lit(None).cast("double")})
    step = (b - a) / n
    edges = [a + step * i for i in range(n)] + [b]
    edges[0] = a - (b - a) * 0.001
    lits = [F.lit(float(e)) for e in edges]
    x = _x(col)
    idx = _bin_from_edges(x, lits)
    return df.withColumns({out: idx, f"{out}_lower": F.element_at(F.array(*lits[:-1]), idx + 1),
                           f"{out}_upper": F.element_at(F.array(*lits[1:]), idx + 1)})


@nan_as_null
def bin_quantile(df: DataFrame, col: str, n: int, out: str | None = None) -> DataFrame:
    """pandas ``qcut(x, n, duplicates='drop')`` on exact quantile edges."""
    out = out or f"{col}_bin"
    ps = [i / n for i in range(n + 1)]
    vals = quantile_values(df, col, ps)  # bounded: n + 1 numbers
    edges = sorted({v for v in vals if v is not None})
    x = _x(col)
    if len(edges) < 2:
        return df.withColumns({out: F.when(x.isNotNull(), F.lit(0)), f"{out}_lower": F.lit(None).cast("double"),
                               f"{out}_upper": F.lit(None).cast("double")})
    lits = [F.lit(float(e)) for e in edges]
    idx = _bin_from_edges(x, lits)
    return df.withColumns({out: idx,
                           f"{out}_lower": F.element_at(F.array(*lits[:-1]), idx + 1),
                           f"{out}_upper": F.element_at(F.array(*lits[1:]), idx + 1)})


def bin_kmeans(df: DataFrame, col: str, k: int, out: str | None = None, seed: int = 0) -> DataFrame:
    """1-D k-means bins (``pyspark.ml``), relabelled by centre order; aligned by row, not position."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    out = out or f"{col}_bin"
    va = VectorAssembler(inputCols=[col], outputCol="__vec", handleInvalid="keep")
    data = va.transform(df.withColumn(col, _x(col)))
    train = data.where(c(col).isNotNull())
    model = KMeans(k=k, seed=seed, featuresCol="__vec", predictionCol="__cl").fit(train)
    centres = [float(v[0]) for v in model.clusterCenters()]  # k numbers
    order = sorted(range(len(centres)), key=lambda i: centres[i])
    relabel = F.create_map(*[x for new, old in enumerate(order) for x in (F.lit(old), F.lit(new))])
    scored = model.transform(data.where(c(col).isNotNull()))
    scored = scored.withColumn(out, relabel[F.col("__cl")]).drop("__vec", "__cl")
    return scored.unionByName(data.where(c(col).isNull()).drop("__vec").withColumn(out, F.lit(None).cast("int")))


# -- NUM13 ------------------------------------------------------------------------------
@nan_as_null
def cumulative(df: DataFrame, col: str, how: str, order_by, partition_by=None, out: str | None = None,
               **kw) -> DataFrame:
    return O.cumulative(df, [col], how, order_by, partition_by, {col: out or col}, **kw)


# -- NUM14 view-time transforms ------------------------------------------------------------
def view_transform(df: DataFrame, col: str, how: str, out: str | None = None) -> DataFrame:
    """square | zscore (n-1 std) | minmax | log (only if min > 0) | sqrt (only if min >= 0)."""
    x = _x(col)
    s = df.agg(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"), F.min(x).alias("a"), F.max(x).alias("b"))
    if how == "square":
        e = x * x
    elif how == "zscore":
        e = (x - s.select("m").scalar()) / s.select("s").scalar()
    elif how == "minmax":
        e = F.try_divide(x - s.select("a").scalar(), s.select(F.col("b") - F.col("a")).scalar())
    elif how == "log":
        e = F.when(s.select("a").scalar() > 0, F.ln(x))
    elif how == "sqrt":
        e = F.when(s.select("a").scalar() >= 0, F.sqrt(x))
    else:
        raise ValueError(how)
    return df.withColumn(out or f"{col}_{how}", e)


# -- NUM15 -----------------------------------------------------------------------------
def transform_preview(df: DataFrame, col: str, fn, **kw) -> DataFrame:
    """Describe before and after a transform: (stage, count, mean, std, min, max, missing)."""
    after = fn(df, col, out="__after", **kw)

    def desc(frame, name, stage):
        x = c(name).cast("double")
        return frame.agg(F.lit(stage).alias("stage"), F.count(x).alias("count"), F.avg(x).alias("mean"),
                         F.stddev_samp(x).alias("std"), F.min(x).alias("min"), F.max(x).alias("max"),
                         F.count_if(x.isNull()).alias("missing"))
    return desc(df, col, "before").unionByName(desc(after, "__after", "after"))


# -- MTH1-12, FEA1, FEA4 -----------------------------------------------------------------
def _operand(v) -> Column:
    return c(v).cast("double") if isinstance(v, str) else F.lit(float(v))


def py_mod(a: Column, b: Column) -> Column:
    """Python modulo: result takes the sign of the divisor; 0 divisor -> null."""
    return F.try_mod(F.try_mod(a, b) + b, b)


def arith(df: DataFrame, op: str, a: str, b, out: str) -> DataFrame:
    """add | subtract | multiply | divide | modulo | power with a column or constant."""
    if op == "divide" and not isinstance(b, str) and float(b) == 0:
        raise ValueError("division by a constant zero")
    x, y = _operand(a), _operand(b)
    e = {"add": lambda: x + y, "subtract": lambda: x - y, "multiply": lambda: x * y,
         "divide": lambda: F.try_divide(x, F.when(y != 0, y)), "modulo": lambda: py_mod(x, F.when(y != 0, y)),
         "power": lambda: nan_to_null(F.pow(x, y))}[op]()
    return df.withColumn(out, e)


def unary(df: DataFrame, op: str, a: str, out: str) -> DataFrame:
    """abs | log (null when <= 0) | exp | round (half to even) | floor | ceil | sqrt."""
    x = _operand(a)
    e = {"abs": lambda: F.abs(x), "log": lambda: F.ln(x), "exp": lambda: F.exp(x), "round": lambda: F.rint(x),
         "floor": lambda: F.floor(x).cast("double"), "ceil": lambda: F.ceil(x).cast("double"),
         "sqrt": lambda: nan_to_null(F.sqrt(x))}[op]()
    return df.withColumn(out, e)


def interaction(df: DataFrame, cols: Sequence[str], op: str, out: str) -> DataFrame:
    """product / sum over n columns; difference / ratio of two (0 divisor -> null)."""
    xs = [_operand(x) for x in cols]
    if op == "product":
        e = xs[0]
        for x in xs[1:]:
            e = e * x
    elif op == "sum":
        e = xs[0]
        for x in xs[1:]:
            e = e + x
    elif op == "difference":
        e = xs[0] - xs[1]
    elif op == "ratio":
        e = F.try_divide(xs[0], F.when(xs[1] != 0, xs[1]))
    else:
        raise ValueError(op)
    return df.withColumn(out, e)


def ratio(df: DataFrame, num: str, den: str, zero: str = "null", out: str | None = None) -> DataFrame:
    """num / den with a zero rule: null | replace (0 -> 1e-6) | add (den + 1e-6)."""
    x, y = _operand(num), _operand(den)
    if zero == "null":
        e = F.try_divide(x, F.when(y != 0, y))
    elif zero == "replace":
        e = x / F.when(y == 0, F.lit(1e-6)).otherwise(y)
    elif zero == "add":
        e = F.try_divide(x, y + F.lit(1e-6))
    else:
        raise ValueError(zero)
    return df.withColumn(out or f"{num}_{den}_ratio", e)


def merge_numeric(df: DataFrame, cols: Sequence[str], how: str, out: str) -> DataFrame:
    """COL10: sum (null = 0), subtract chain, product (null = 1), divide chain (0 -> null)."""
    xs = [_operand(x) for x in cols]
    if how == "sum":
        e = xs[0]
        e = F.coalesce(xs[0], F.lit(0.0))
        for x in xs[1:]:
            e = e + F.coalesce(x, F.lit(0.0))
    elif how == "subtract":
        e = xs[0]
        for x in xs[1:]:
            e = e - x
    elif how == "product":
        e = F.coalesce(xs[0], F.lit(1.0))
        for x in xs[1:]:
            e = e * F.coalesce(x, F.lit(1.0))
    elif how == "divide":
        e = xs[0]
        for x in xs[1:]:
            e = F.try_divide(e, F.when(x != 0, x))
    else:
        raise ValueError(how)
    return df.withColumn(out, e)
