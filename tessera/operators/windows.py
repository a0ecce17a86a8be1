"""Rolling, expanding and ordered operators (WIN*).

Built on ``plans.ordered``: windows are partitioned by (series, block), never
by the whole table, and row-count frames get their preceding rows from a halo.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.common import as_list, c, join_null_safe, nan_as_null
from tessera.plans import medians as M
from tessera.plans import ordered as O

_I = "__i"


def _rolling_expr(x: Column, stat: str, n: int, w: Window) -> Column:
    frame = w.rowsBetween(-(n - 1), 0)
    full = F.count(x).over(frame) == n
    if stat == "count":
        return F.when(F.col(_I) >= n - 1, F.count(x).over(frame))
    agg = {"mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "sum": F.sum}[stat]
    return F.when(full, agg(x).over(frame))


@nan_as_null
def rolling(df: DataFrame, col: str, n: int, stats: Sequence[str] = ("mean",), order_by=None, partition_by=None,
            out: dict[str, str] | None = None, **kw) -> DataFrame:
    """pandas ``rolling(n).<stat>()`` by order: null until the frame holds n non-null values
    (count: null until n rows exist).  Stats: mean min max std var sum count median."""
    out = out or {s: f"{col}_rolling_{s}" for s in stats}
    d, w = O.with_halo(df, order_by, partition_by, n, **kw)
    x = c(col).cast("double")
    d = d.withColumns({out[s]: _rolling_expr(x, s, n, w) for s in stats if s != "median"})
    if "median" in stats:
        d = M.rolling_median(d, col, n, as_list(partition_by), out["median"])
    return O.drop_halo(d).select(*[c(x) for x in df.columns if x not in out.values()], *[c(out[s]) for s in stats])


@nan_as_null
def moving_averages(df: DataFrame, col: str, short: int, long: int, order_by, partition_by=None, **kw) -> DataFrame:
    """Short and long simple moving averages (sorted by ``order_by`` first)."""
    d, w = O.with_halo(df, order_by, partition_by, max(short, long), **kw)  # one halo for both
    x = c(col).cast("double")
    return O.drop_halo(d.withColumns({f"sma_{n}": _rolling_expr(x, "mean", n, w) for n in (short, long)}))


@nan_as_null
def expanding(df: DataFrame, col: str, stats: Sequence[str] = ("mean",), order_by=None, partition_by=None,
              out: dict[str, str] | None = None, rows_per_block: int | None = None) -> DataFrame:
    """pandas ``expanding().<stat>()``: mean sum min max count std var (median: ``expanding_median``)."""
    order_by, parts = as_list(order_by), as_list(partition_by)
    out = out or {s: f"{col}_expanding_{s}" for s in stats}
    x = c(col).cast("double")
    d, nb = O.add_blocks(df, order_by, rows_per_block, parts)
    extra = []
    y = x
    if {"std", "var"} & set(stats):  # squares are taken about the series mean, so large values do not cancel
        means = df.groupBy(*[c(p) for p in parts]).agg(F.avg(x).alias("__mu"))
        d = join_null_safe(d, means, parts, "left", broadcast=not parts)
        y = x - F.col("__mu")
        extra.append("__mu")
    w = Window.partitionBy(*[c(p) for p in parts], O._BLK).orderBy(*[c(o) for o in order_by]) \
        .rowsBetween(Window.unboundedPreceding, 0)
    sums = {"n": (F.count, x), "s": (F.sum, x), "t": (F.sum, y), "q": (F.sum, y * y), "mn": (F.min, x), "mx": (F.max, x)}
    merge = {"n": F.sum, "s": F.sum, "t": F.sum, "q": F.sum, "mn": F.min, "mx": F.max}
    d = d.withColumns({f"__{k}": f(v).over(w) for k, (f, v) in sums.items()})
    extra += [f"__{k}" for k in sums]
    col_of = {k: F.col(f"__{k}") for k in sums}
    if nb > 1:
        summ = O.carried(d).groupBy(*[c(p) for p in parts], O._BLK).agg(*[f(v).alias(f"__b{k}") for k, (f, v) in sums.items()])
        carry = O._carry(summ, parts, {f"__c{k}": merge[k](f"__b{k}") for k in sums})
        d = O._join_carry(d, carry, parts, nb)
        extra += [f"__c{k}" for k in sums]
        for k in sums:
            if k in ("mn", "mx"):
                col_of[k] = (F.least if k == "mn" else F.greatest)(f"__{k}", f"__c{k}")
            else:
                col_of[k] = F.coalesce(f"__{k}", F.lit(0)) + F.coalesce(f"__c{k}", F.lit(0))
    n, s, t, q = (col_of[k] for k in "nstq")
    var = F.when(n >= 2, F.greatest(q - t * t / n, F.lit(0.0)) / (n - 1))
    exprs = {"mean": F.when(n >= 1, s / n), "sum": F.when(n >= 1, s), "min": col_of["mn"], "max": col_of["mx"], "count": n,
             "var": var, "std": F.sqrt(var)}
    d = d.withColumns({out[st]: exprs[st] for st in stats})
    return d.drop(O._BLK, *extra)


@nan_as_null
def expanding_median(df: DataFrame, col: str, order_by, partition_by=None, out: str | None = None,
                     rows_per_block: int | None = None) -> DataFrame:
    """pandas ``expanding().median()``: the median of the series' values up to each row (null before the first).

    Long series are cut into blocks that need only the middle ranks of what
    lies before them (``plans.medians``): no series has to fit into a task.
    """
    return M.expanding_median(df, col, as_list(order_by), as_list(partition_by), out or f"{col}_expanding_median", rows_per_block)


@nan_as_null
def ema(df: DataFrame, col: str, span: float, order_by, partition_by=None, out: str | None = None,
        rows_per_block: int | None = None) -> DataFrame:
    """pandas ``ewm(span, adjust=False).mean()``: y0 = x0, y = (1-a) y + a x with a = 2 / (span + 1).

    Nulls follow pandas (``ignore_na=False``): a null repeats the last value
    and lets its weight decay; leading nulls stay null.  Blocks are read in
    order as a stream of Arrow batches: behind its first value a block maps the
    running value y to A y + B, so the blocks of long series are chained by
    their summaries and run from the right state.
    """
    out = out or f"{col}_ema_{span:g}"
    return _emas(df, col, {out: span}, order_by, partition_by, rows_per_block)


def _emas(df: DataFrame, col: str, spans: dict[str, float], order_by, partition_by=None, rows_per_block: int | None = None,
          previous: dict[str, str] | None = None) -> DataFrame:
    """``df`` with the EMAs ``spans`` (name: span) in one pass; ``previous`` (name: new name) also gives the
    values at the row before, and ``__has_prev`` (false at the first row of a series)."""
    order_by, parts = as_list(order_by), as_list(partition_by)
    alphas, previous = [2.0 / (s + 1.0) for s in spans.values()], previous or {}
    d, nb = O.add_blocks(df, order_by, rows_per_block, parts)
    keys = [*parts, O._BLK]
    # rows come out of the window sorted by its keys; __new marks the first of every (series, block)
    first = F.row_number().over(Window.partitionBy(*[c(k) for k in keys]).orderBy(*[c(o) for o in order_by])) == 1
    d = d.withColumn("__x", c(col).cast("double"))
    carries = [f"__{v}{k}" for k in range(len(alphas)) for v in ("y", "w")]
    if nb > 1:
        d = join_null_safe(d, _ema_carries(d, parts, first, alphas), keys, "left", broadcast=not parts)
    else:
        d = d.withColumns({"__seen": F.lit(False), **{k: F.lit(None).cast("double") for k in carries}})
    d = d.withColumn("__new", first)

    def run(batches):
        states = [(None, 1.0)] * len(alphas)
        for b in batches:
            x, new = (b.column(k).to_numpy(zero_copy_only=False) for k in ("__x", "__new"))
            starts = np.flatnonzero(new)
            values = [np.empty(len(x)) for _ in alphas]
            before = [np.empty(len(x)) for _ in alphas] if previous else []
            has = np.ones(len(x), bool)
            for i, j in zip(*_segments(starts, len(x))):
                if new[i]:
                    carry = [b.column(k)[i].as_py() for k in carries]
                    states = [(y, 1.0 if w is None else w) for y, w in zip(carry[::2], carry[1::2])]
                    has[i] = bool(b.column("__seen")[i].as_py())
                for k, alpha in enumerate(alphas):
                    y, weight = states[k]
                    values[k][i:j] = _ewm_from(y, weight, x[i:j], alpha)
                    if previous:
                        before[k][i] = np.nan if y is None else y
                        before[k][i + 1:j] = values[k][i:j - 1]
                    states[k] = _ewm_after(y, weight, x[i:j], values[k][i:j], alpha)
            cols = [b.column(k) for k in kept] + [pa.array(v, from_pandas=True) for v in values]
            if previous:
                cols += [pa.array(v, from_pandas=True) for v in before] + [pa.array(has)]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    added = [*spans, *((*(previous[k] for k in spans), "__has_prev") if previous else ())]
    kept = df.columns
    names = [*kept, *added]
    fields = [T.StructField(k, T.BooleanType() if k == "__has_prev" else T.DoubleType()) for k in added]
    return d.mapInArrow(run, T.StructType([*df.schema.fields, *fields]))


def _segments(starts: np.ndarray, n: int):
    """Bounds of the runs of rows of one block in a batch of ``n`` rows."""
    if not n:
        return [], []
    cuts = starts[starts > 0].tolist()
    return [0, *cuts], [*cuts, n]


def _ema_carries(d: DataFrame, parts: list[str], first: Column, alphas: list[float]) -> DataFrame:
    """Per block of a long series: whether rows come before it, and the state (value, weight) of every EMA before it."""
    from tessera.session import written

    keys = [*parts, O._BLK]
    key_fields = [d.schema[k] for k in keys]
    maps = [f"__{v}{k}" for k in range(len(alphas)) for v in ("a", "b")]

    def summarise(batches):
        own, state = None, None

        def row():
            n, lead, x0, tail, ends = state
            cols = [pa.array([n]), pa.array([lead]), pa.array([x0], pa.float64()), pa.array([tail])]
            cols += [pa.array([v], pa.float64()) for e in ends for v in (e[1][0] - e[0][0], e[0][0])]
            return pa.RecordBatch.from_arrays([*own.columns, *cols], names=[*keys, "__n", "__lead", "__x0", "__tail", *maps])

        for b in batches:
            x, new = (b.column(k).to_numpy(zero_copy_only=False) for k in ("__x", "__new"))
            for i, j in zip(*_segments(np.flatnonzero(new), len(x))):
                if new[i]:
                    if own is not None:
                        yield row()
                    own = b.select(keys).slice(i, 1)
                    state = (0, 0, float("nan"), 0, [[(0.0, 1.0), (1.0, 1.0)] for _ in alphas])
                n, lead, x0, tail, ends = state
                part = x[i:j]
                some = np.flatnonzero(~np.isnan(part))
                if n == lead and not len(some):  # nothing but nulls so far
                    state = (n + len(part), lead + len(part), x0, tail, ends)
                    continue
                if n == lead:
                    lead, x0 = lead + int(some[0]), float(part[some[0]])
                    rest = part[some[0] + 1:]
                else:
                    rest = part
                ends = [[_ewm_after(y, w, rest, _ewm_from(y, w, rest, alpha), alpha) for y, w in e] for e, alpha in zip(ends, alphas)]
                tail = len(part) - 1 - int(some[-1]) if len(some) else tail + len(part)
                state = (n + len(part), lead, x0, tail, ends)
        if own is not None:
            yield row()

    longs = [T.StructField(k, T.LongType()) for k in ("__n", "__lead")]
    schema = T.StructType([*key_fields, *longs, T.StructField("__x0", T.DoubleType()), T.StructField("__tail", T.LongType()),
                           *(T.StructField(k, T.DoubleType()) for k in maps)])
    summ = O.carried(d).withColumn("__new", first).select(*[c(k) for k in keys], "__x", "__new").mapInArrow(summarise, schema)

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(O._BLK)
        states, seen, rows = [(None, 1.0)] * len(alphas), 0, []
        for r in pdf.itertuples(index=False):
            r = dict(zip(pdf.columns, r))
            rows.append([seen > 0, *(v for y, w in states for v in (np.nan if y is None else y, w))])
            seen += r["__n"]
            for k, alpha in enumerate(alphas):
                y, weight = states[k]
                if r["__lead"] == r["__n"]:  # nothing but nulls: only the weight decays
                    states[k] = (y, weight * (1 - alpha) ** r["__n"])
                else:
                    y = r[f"__a{k}"] * _ewm_first(y, weight * (1 - alpha) ** r["__lead"], r["__x0"], alpha) + r[f"__b{k}"]
                    states[k] = (y, (1 - alpha) ** r["__tail"])
        names = ["__seen", *(f"__{v}{k}" for k in range(len(alphas)) for v in ("y", "w"))]
        return pd.concat([pdf[keys].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = T.StructType([*key_fields, T.StructField("__seen", T.BooleanType()),
                           *(T.StructField(f"__{v}{k}", T.DoubleType()) for k in range(len(alphas)) for v in ("y", "w"))])
    # a row per block: small
    by_series = summ.withColumn("__series", F.lit(0)).groupBy("__series", *[c(p) for p in parts])
    return written(by_series.applyInPandas(lambda pdf: chain(pdf.drop(columns="__series")), schema), "ema-carries")


def _ewm_first(y: float | None, weight: float, x: float, alpha: float) -> float:
    """The running value after the next non-null ``x``: the old value has ``weight`` left."""
    if y is None or y == x:
        return x
    old = weight * (1 - alpha)
    return (old * y + alpha * x) / (old + alpha)


def _ewm_after(y: float | None, weight: float, x, values, alpha: float):
    """The state (value, its weight) after a run ``x`` that gave ``values``."""
    some = np.flatnonzero(~np.isnan(x))
    if not len(some):
        return y, weight * (1 - alpha) ** len(x)
    return float(values[-1]), (1 - alpha) ** int(len(x) - 1 - some[-1])


def _ewm_from(y: float | None, weight: float, x, alpha: float):
    """The block's values from the state (y, its weight) before it."""
    some = np.flatnonzero(~np.isnan(x))
    lead = int(some[0]) if len(some) else len(x)
    head = np.full(lead, np.nan if y is None else y)
    if lead == len(x):
        return head
    part = x[lead:].copy()
    part[0] = _ewm_first(y, weight * (1 - alpha) ** lead, float(x[lead]), alpha)
    return np.concatenate([head, pd.Series(part).ewm(alpha=alpha, adjust=False).mean().to_numpy()])


@nan_as_null
def crossover(df: DataFrame, col: str, short: int, long: int, kind: str = "sma", order_by=None,
              partition_by=None, **kw) -> DataFrame:
    """Signal +1 (short above long) / -1 (below) / 0, and buy/sell where it changes by +/-2."""
    def signal(s, l_):
        return F.when(F.col(s) > F.col(l_), 1).when(F.col(s) < F.col(l_), -1).otherwise(0)

    def acted(d: DataFrame) -> DataFrame:
        return d.withColumn("action", F.when(F.col("signal_change") == 2, "buy").when(F.col("signal_change") == -2, "sell"))

    if kind != "sma":  # the row before is at hand where the averages are made
        s, l_ = f"ema_{short}", f"ema_{long}"
        d = _emas(df, col, {s: short, l_: long}, order_by, partition_by, previous={s: "__s", l_: "__l"}, **kw)
        change = F.when(F.col("__has_prev"), F.col("signal") - signal("__s", "__l")).otherwise(0)
        return acted(d.withColumn("signal", signal(s, l_)).withColumn("signal_change", change)).drop("__s", "__l", "__has_prev")
    d = moving_averages(df, col, short, long, order_by, partition_by, **kw).withColumn("signal", signal(f"sma_{short}", f"sma_{long}"))
    h, w = O.with_halo(d, order_by, partition_by, 2, **kw)
    ch = F.coalesce(F.col("signal") - F.lag("signal").over(w), F.lit(0))
    return O.drop_halo(acted(h.withColumn("signal_change", ch)))


@nan_as_null
def difference(df: DataFrame, col: str, k: int = 1, repeat: bool = False, order_by=None, partition_by=None,
               out: str | None = None, **kw) -> DataFrame:
    """``x - lag(x, k)`` (pandas ``diff(k)``), or k-fold differencing when ``repeat``."""
    out = out or f"{col}_diff_{k}"
    d, w = O.with_halo(df, order_by, partition_by, k + 1, **kw)
    x = c(col).cast("double")
    if not repeat:
        e = x - F.lag(x, k).over(w)
    else:
        from math import comb
        e = None
        for j in range(k + 1):
            term = F.lag(x, j).over(w) * float((-1) ** j * comb(k, j)) if j else x
            e = term if e is None else e + term
    return O.drop_halo(d.withColumn(out, e))


@nan_as_null
def change_summary(df: DataFrame, col: str, order_by: str) -> DataFrame:
    """First, last, change, % change, min, max, range, mean in time order (one aggregate)."""
    x, o = c(col).cast("double"), c(order_by)
    nn = df.where(x.isNotNull())
    r = nn.agg(F.min_by(x, o).alias("first"), F.max_by(x, o).alias("last"), F.min(x).alias("min"),
               F.max(x).alias("max"), F.avg(x).alias("mean"))
    return r.select("first", "last", (F.col("last") - F.col("first")).alias("change"),
                    F.try_divide((F.col("last") - F.col("first")) * 100.0, F.col("first")).alias("pct_change"),
                    "min", "max", (F.col("max") - F.col("min")).alias("range"), "mean")


@nan_as_null
def ecdf(df: DataFrame, col: str, by=None, **kw) -> DataFrame:
    """(value, ecdf = i / n) over sorted non-null values, per group; ties get increasing steps."""
    by = as_list(by)
    base = df.select(*[c(b) for b in by], c(col).cast("double").alias("value")).where(F.col("value").isNotNull())
    for b in by:
        base = base.where(c(b).isNotNull())
    d = O.row_index(base, ["value"], by, "__r", **kw)
    n = base.groupBy(*[c(b) for b in by]).agg(F.count(F.lit(1)).alias("__n")) if by else None
    if by:
        d = d.join(n, by)
        return d.select(*[c(b) for b in by], "value", ((F.col("__r") + 1) / F.col("__n")).alias("ecdf"))
    total = base.agg(F.count(F.lit(1))).scalar()
    return d.select("value", ((F.col("__r") + 1) / total).alias("ecdf"))


@nan_as_null
def is_monotonic(df: DataFrame, col: str, order_by, partition_by=None, **kw) -> DataFrame:
    """Non-decreasing / non-increasing in order (a null makes both false)."""
    d, w = O.with_halo(df, order_by, partition_by, 2, **kw)
    x = c(col)
    prev = F.lag(x).over(w)
    d = O.drop_halo(d.withColumns({"__up": F.coalesce(x >= prev, x.isNotNull() & prev.isNull() & (F.col(_I) == 0)),
                                   "__down": F.coalesce(x <= prev, x.isNotNull() & prev.isNull() & (F.col(_I) == 0))}))
    return d.agg(F.coalesce(F.bool_and("__up"), F.lit(True)).alias("increasing"),
                 F.coalesce(F.bool_and("__down"), F.lit(True)).alias("decreasing"))
