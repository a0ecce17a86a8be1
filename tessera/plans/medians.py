"""Rolling and expanding medians in blocks.

Rolling: a block with its halo is one pass over a sorted window.

Expanding: the values before a block matter only through the middle of their
sorted order - a block of c values moves the median by at most c / 2 ranks.
One range sort ranks all values of the long series; counts per (rank range,
block) tell which ranks before each block are its middle, and the ranges serve
just these.  A block then takes its own values out of the sorted list of both,
last row first, and the median moves by one place at a time.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.common import c, join_null_safe
from tessera.plans import ordered as O
from tessera.session import written

#: Blocks whose requests to one rank range are served by one task.
BLOCKS_PER_TASK = 16
_BLOCK = "__mb"


def sliding_medians(x: np.ndarray, n: int) -> np.ndarray:
    """The median of each value and the n - 1 before it; NaN where one of them is missing."""
    out = np.full(len(x), np.nan)
    window: list[float] = []
    missing = 0
    for i, v in enumerate(x.tolist()):
        if v != v:
            missing += 1
        else:
            bisect.insort(window, v)
        if i >= n:
            old = float(x[i - n])
            if old != old:
                missing -= 1
            else:
                del window[bisect.bisect_left(window, old)]
        if i >= n - 1 and not missing:
            out[i] = window[n // 2] if n % 2 else (window[n // 2 - 1] + window[n // 2]) / 2
    return out


def prefix_medians(x: np.ndarray, middle: np.ndarray, below: int, before: int) -> np.ndarray:
    """The median of ``before`` earlier values and x[:i + 1] for every i; missing values are skipped.

    ``middle`` are the earlier values (sorted) without the ``below`` smallest
    and some largest: enough that no median leaves them.  NaN where there is
    no value yet.
    """
    own = np.flatnonzero(~np.isnan(x))
    out = np.full(len(x), np.nan)
    total = before + len(own)
    if not total:
        return out
    values = np.concatenate((middle, x[own]))
    order = np.argsort(values, kind="stable")
    place = np.empty(len(values), np.int64)  # of each value in the sorted list
    place[order] = np.arange(len(values))
    s = values[order].tolist()
    prev, following = list(range(-1, len(s) - 1)), list(range(1, len(s) + 1))
    spot = place[len(middle):].tolist()
    at = rank = (total - 1) // 2 - below  # the lower median and its rank among the values still listed
    medians = []
    for k in range(len(own) - 1, -1, -1):
        medians.append(s[at] if total % 2 else (s[at] + s[following[at]]) / 2)
        gone = spot[k]
        if gone < at:
            rank -= 1
        elif gone == at:
            if following[at] < len(s):
                at = following[at]
            else:
                at, rank = prev[at], rank - 1
        p, f = prev[gone], following[gone]
        if p >= 0:
            following[p] = f
        if f < len(s):
            prev[f] = p
        total -= 1
        goal = (total - 1) // 2 - below
        while rank > goal and at >= 0 and prev[at] >= 0:
            at, rank = prev[at], rank - 1
        while rank < goal and following[at] < len(s):
            at, rank = following[at], rank + 1
    start = np.nan
    if before:
        start = s[at] if before % 2 else (s[at] + s[following[at]]) / 2
    steps = np.array([start, *reversed(medians)])
    return steps[np.cumsum(~np.isnan(x))]


def _per_block(rows: DataFrame, work, keys: Sequence[str], out: str) -> DataFrame:
    """Apply ``work`` (values of a block in order -> results, rows to return) to narrow rows (keys, block, index, x, halo)."""
    names = [*keys, O._I]

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by(O._I)
        x = table.column("__x").to_numpy(zero_copy_only=False).astype(float)
        wanted = pa.array(~table.column("__halo").to_numpy(zero_copy_only=False).astype(bool))
        res = work(x)
        made = pa.array(res, mask=np.isnan(res))
        return pa.table([*(table.column(n) for n in names), made], names=[*names, out]).filter(wanted)

    schema = T.StructType([*(rows.schema[n] for n in names), T.StructField(out, T.DoubleType())])
    return rows.groupBy(*[c(k) for k in keys], _BLOCK).applyInArrow(run, schema)


def rolling_median(d: DataFrame, col: str, n: int, parts: Sequence[str], out: str) -> DataFrame:
    """Adds the rolling median to the frame of ``ordered.with_halo`` (rows of the halo: null)."""
    x = c(col).cast("double")
    rows = d.select(*[c(p) for p in parts], F.col("__b2").alias(_BLOCK), O._I, "__halo", x.alias("__x"))
    found = _per_block(rows, lambda v: sliding_medians(v, n), parts, out)
    return join_null_safe(d, found, [*parts, O._I], "left")


def expanding_median(df: DataFrame, col: str, order_by: Sequence[str], parts: Sequence[str], out: str,
                     rows_per_block: int | None = None) -> DataFrame:
    """Adds the median of all values up to each row of its series, in order; null before the first value."""
    size = rows_per_block or O.ROWS_PER_BLOCK
    d = O.row_index(df, order_by, parts, O._I, rows_per_block).withColumn(_BLOCK, F.floor(F.col(O._I) / size))
    keys = [f"__s{i}" for i in range(len(parts))]
    narrow = d.select(*[c(p).alias(k) for p, k in zip(parts, keys)], _BLOCK, O._I, F.lit(False).alias("__halo"),
                      F.nanvl(c(col).cast("double"), F.lit(None).cast("double")).alias("__x"))
    narrow = written(narrow, "median-rows")
    middles = _middles(narrow, keys, size)
    names = [*keys, O._I]

    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, served: pa.Table) -> pa.Table:
        rows = rows.sort_by(O._I)
        x = rows.column("__x").to_numpy(zero_copy_only=False).astype(float)
        served = served.sort_by("__range")
        middle = np.concatenate([np.zeros(0), *(np.asarray(v.as_py(), float) for v in served.column("__xs"))])
        below, before = (int(served.column(k)[0].as_py()) if len(served) else 0 for k in ("__below", "__before"))
        res = prefix_medians(x, middle, below, before)
        return pa.table([*(rows.column(n) for n in names), pa.array(res, mask=np.isnan(res))], names=[*names, out])

    schema = T.StructType([*(narrow.schema[n] for n in names), T.StructField(out, T.DoubleType())])
    found = narrow.groupBy(*keys, _BLOCK).cogroup(middles.groupBy(*keys, _BLOCK)).applyInArrow(run, schema)
    found = found.withColumnsRenamed(dict(zip(keys, parts)))
    return join_null_safe(d, found, [*parts, O._I], "left").drop(O._I, _BLOCK)


def _middles(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, block, range, xs, below, before: the middle of the values before each block but a series' first."""
    values = rows.where("__x is not null").select(*keys, _BLOCK, O._I, "__x")
    if keys:  # only series of several blocks
        long = rows.where(F.col(_BLOCK) > 0).select(*keys).distinct()
        values = join_null_safe(values, long.withColumn("__long", F.lit(True)), keys)
    elif rows.where(F.col(_BLOCK) > 0).isEmpty():
        values = values.where("false")
    values = O.sorted_codes(values.drop("__long"), [*keys, "__x", O._I], "__code")
    values = written(values.withColumn("__range", F.floor(F.col("__code") / size)), "median-values")

    # how many earlier values of the series each block finds in each range
    counts = values.groupBy(*keys, "__range", _BLOCK).agg(F.count(F.lit(1)).alias("__n"))
    ranges = counts.select(*keys, "__range").distinct()
    blocks = rows.groupBy(*keys, _BLOCK).agg(F.count("__x").alias("__c")).where(F.col(_BLOCK) >= 0)
    ends = ranges.groupBy(*keys).agg(F.min("__range").alias("__a"), F.max("__range").alias("__z"))
    grid = join_null_safe(blocks, ends, keys, broadcast=not keys)  # without series: one row
    grid = grid.where("__a is not null").withColumn("__range", F.explode(F.sequence("__a", "__z"))).drop("__a", "__z")
    grid = join_null_safe(grid, counts, [*keys, "__range", _BLOCK], "left").fillna(0, ["__n"])
    earlier = Window.partitionBy(*keys, "__range").orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumn("__p", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).where(F.col(_BLOCK) > 0)
    lower = Window.partitionBy(*keys, _BLOCK).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    grid = grid.withColumns({"__first": F.coalesce(F.sum("__p").over(lower), F.lit(0)),
                             "__before": F.sum("__p").over(Window.partitionBy(*keys, _BLOCK))})
    grid = grid.withColumns({"__lo": F.expr("greatest(0, (__before - __c) div 2 - 2)"), "__hi": F.expr("least(__before, (__before + __c) div 2 + 3)")})
    asks = grid.withColumns({"__from": F.greatest(F.col("__lo") - F.col("__first"), F.lit(0)),
                             "__to": F.least(F.col("__hi") - F.col("__first"), F.col("__p"))}).where("__from < __to")
    asks = asks.select(*keys, "__range", _BLOCK, "__from", "__to", F.col("__lo").alias("__below"), "__before",
                       F.floor(F.col(_BLOCK) / BLOCKS_PER_TASK).alias("__task"))
    asks = written(asks, "median-asks")
    tasks = asks.select(*keys, "__range", (F.col("__task") + 0).alias("__task")).distinct()
    served = join_null_safe(values, tasks, [*keys, "__range"])
    group = [*keys, "__range", "__task"]

    def serve(key: tuple[pa.Scalar, ...], found: pa.Table, asked: pa.Table) -> pa.Table:
        found = found.sort_by("__code")
        x, block = found.column("__x").to_numpy(), found.column(_BLOCK).to_numpy()
        xs = [x[block < b][a:z] for b, a, z in zip(*(asked.column(k).to_pylist() for k in (_BLOCK, "__from", "__to")))]
        return pa.table([*(asked.column(k) for k in (*keys, _BLOCK, "__range")), pa.array(xs, pa.list_(pa.float64())),
                         asked.column("__below"), asked.column("__before")], names=[*keys, _BLOCK, "__range", "__xs", "__below", "__before"])

    schema = T.StructType([*(asks.schema[k] for k in (*keys, _BLOCK, "__range")), T.StructField("__xs", T.ArrayType(T.DoubleType())),
                           asks.schema["__below"], asks.schema["__before"]])
    return served.groupBy(*group).cogroup(asks.groupBy(*group)).applyInArrow(serve, schema)
