"""Ordered scans without a single-partition window.

``Window.orderBy`` with no ``partitionBy`` sends every row to one task.  Here
a series (the whole table, or each ``partition_by`` group) is cut into
*blocks*: contiguous ranges of the order keys whose bounds come from
``percentile_approx`` passes (a first key value that fills several blocks is
split by the next key).  The block id is a pure function of the row, so every
plan that re-derives it sees the same layout - nothing is materialised and a
lost executor recomputes the same blocks.

Each operator then runs in three steps:

1. a window partitioned by ``(partition_by, block)`` computes the local result;
2. a grouped aggregate summarises every block (a handful of values each);
3. a window over the *summaries* (one row per block) turns them into a
   carry-in per block, joined back on ``(partition_by, block)``.

Row-count windows (rolling, lag) use the row index to cut equal-sized blocks
and copy the last ``n - 1`` rows of each block into the next one (a halo), so
every window frame is complete inside one block.

The order key must be unique within a series (ties make order undefined, as
in pandas where the input order decides).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.common import as_list, c, join_null_safe

ROWS_PER_BLOCK = 1_000_000
#: Series longer than a block that are told apart by a broadcast list; with more of them all rows are cut by ranges.
MOST_LONG_SERIES = 100_000
_BLK = "__blk"
_I = "__i"


def _key_double(df: DataFrame, key: str) -> Column:
    dt = df.schema[key].dataType
    if isinstance(dt, T.TimestampNTZType):
        return c(key).cast("timestamp").cast("double")
    if isinstance(dt, T.DateType):
        return c(key).cast("timestamp").cast("double")
    if isinstance(dt, (T.TimestampType, T.NumericType)):
        return c(key).cast("double")
    raise TypeError(f"order key {key} must be numeric, date or timestamp")


def add_blocks(df: DataFrame, order_by: Sequence[str], rows_per_block: int | None = None, parts: Sequence[str] = ()
               ) -> tuple[DataFrame, int]:
    """Tag rows with ``__blk``: ranges of the order keys of about ``rows_per_block`` rows.

    Only series longer than that are cut; the rows of every shorter one share
    the block -1, which needs no carry (``carried``).  Ranges come from a
    quantile sketch of the first key; a value of it that alone fills several
    blocks is split by ranges of the next key, and so on.  Returns the frame
    and the number of blocks (1 means no carry is needed).
    """
    rpb = rows_per_block or ROWS_PER_BLOCK
    rows = df.count()
    if rows <= rpb:
        return df.withColumn(_BLK, F.lit(0)), 1
    if parts:
        long = df.groupBy(*[c(p) for p in parts]).agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__rows") > rpb)
        series, rows = long.agg(F.count(F.lit(1)), F.coalesce(F.sum("__rows"), F.lit(0))).first()
        if not series:
            return df.withColumn(_BLK, F.lit(0)), 1
        if series <= MOST_LONG_SERIES:
            marked = join_null_safe(df, long.withColumn("__long", F.lit(True)).drop("__rows"), parts, "left", broadcast=True)
            d, n = _cut(marked, marked.where("__long"), order_by, math.ceil(rows / rpb))
            return d.withColumn(_BLK, F.when(F.col("__long"), F.col(_BLK)).otherwise(F.lit(-1))).drop("__long"), max(2, n)
    return _cut(df, df, order_by, math.ceil(rows / rpb))


def carried(d: DataFrame) -> DataFrame:
    """The rows whose blocks take part in a carry."""
    return d.where(F.col(_BLK) >= 0)


def _cut(df: DataFrame, sample: DataFrame, order_by: Sequence[str], nblocks: int) -> tuple[DataFrame, int]:
    """``df`` with the block of every row, by ranges that hold equal numbers of rows of ``sample``."""
    if nblocks == 1:
        return df.withColumn(_BLK, F.lit(0)), 1
    if not _has_double(df, order_by[0]):
        raise TypeError(f"order key {order_by[0]} must be numeric, date or timestamp")
    keys = [_key_double(df, k) for k in order_by if _has_double(df, k)]
    plain = [f.name for f in df.schema.fields if isinstance(f.dataType, T.AtomicType) and f.name != "__long"]
    keys.append(F.xxhash64(*[c(p) for p in plain]).cast("double"))  # rows that tie on every key have no order: spread them
    names = [f"__kd{i}" for i in range(len(keys))]
    ranges, n = _split(sample.select(*[k.alias(x) for x, k in zip(names, keys)]), names, nblocks)
    return _with_block(df.withColumns(dict(zip(names, keys))), ranges, names, _BLK).drop(*names), n


def _has_double(df: DataFrame, key: str) -> bool:
    return isinstance(df.schema[key].dataType, (T.NumericType, T.TimestampNTZType, T.TimestampType, T.DateType))


def _split(df: DataFrame, names: list[str], nblocks: int):
    """(ranges of the first key, number of blocks); a range is [from, block, deeper ranges or None].

    One pass per key: the values that fill several blocks are split by the next key, all of them together.
    """
    ranges: list = []
    todo = [((), nblocks, ranges)]  # values of the keys before, blocks wanted, the ranges to fill
    for level, name in enumerate(names):
        most = max(n for _, n, _ in todo)
        grid = max(1024, most) if not level else max(256, 4 * most)
        asked = df.sparkSession.createDataFrame([(i, n, *values) for i, (values, n, _) in enumerate(todo)],
                                                ", ".join(["__id int", "__n int", *(f"__v{k} double" for k in range(level))]))
        same = [F.col(names[k]) == F.col(f"__v{k}") for k in range(level)]
        rows = df.join(F.broadcast(asked), same) if level else df.crossJoin(F.broadcast(asked))
        sketch = rows.groupBy("__id", "__n").agg(F.percentile_approx(name, F.lit(np.arange(1, grid) / grid), 20 * grid).alias("__g"))
        places = F.transform(F.sequence(F.lit(1), F.col("__n") - 1), lambda j: F.element_at(
            "__g", F.least(F.greatest(F.round(j * grid / F.col("__n")).cast("int"), F.lit(1)), F.lit(grid - 1))))
        found = {r["__id"]: r["at"] or [] for r in sketch.where("__n > 1").select("__id", places.alias("at")).collect()}  # a number per block
        deeper = []
        for i, (values, _, own) in enumerate(todo):
            at = [float(v) for v in found.get(i, ())]
            own.append([None, 0, None])
            for v in sorted(set(at)):
                share = at.count(v)
                own.append([v, 0, [] if share > 1 and level + 1 < len(names) else None])
                if own[-1][2] is not None:
                    deeper.append(((*values, v), share, own[-1][2]))
                    own.append([math.nextafter(v, math.inf), 0, None])
            for k in range(len(own) - 1, 1, -1):  # the range above a split value and one that starts at the very next number are one
                if own[k][0] == own[k - 1][0]:
                    del own[k - 1]
        todo = deeper
        if not todo:
            break
    return ranges, _number(ranges, 0)


def _number(ranges, first: int) -> int:
    """Numbers the blocks in order from ``first``; returns the next number."""
    for r in ranges:
        r[1] = first
        first = _number(r[2], first) if r[2] else first + 1
    return first


def _place(ranges, keys: list[np.ndarray]) -> np.ndarray:
    """The block of every row: of the last range that starts at or below its key (missing keys: the first range)."""
    at = np.searchsorted(np.array([r[0] for r in ranges[1:]], float), keys[0], side="right")
    at[np.isnan(keys[0])] = 0
    out = np.array([r[1] for r in ranges], np.int32)[at]
    for k in np.unique(at):
        if ranges[k][2]:
            own = at == k
            out[own] = _place(ranges[k][2], [x[own] for x in keys[1:]])
    return out


def _with_block(df: DataFrame, ranges, keys: list[str], out: str) -> DataFrame:
    """Adds the block id by binary search."""
    if not any(r[2] for r in ranges):
        from pyspark.ml.feature import Bucketizer

        if len(ranges) == 1:
            return df.withColumn(out, F.lit(0))
        splits, tmp = [float("-inf"), *(r[0] for r in ranges[1:]), float("inf")], f"{out}_p"
        df = Bucketizer(splits=splits, inputCol=keys[0], outputCol=tmp, handleInvalid="keep").transform(df)
        place = F.when(c(keys[0]).isNull() | F.isnan(c(keys[0])), F.lit(0)).otherwise(c(tmp).cast("int"))
        return df.withColumn(out, place).drop(tmp)

    @F.pandas_udf("int")
    def block(*cols: pd.Series) -> pd.Series:
        return pd.Series(_place(ranges, [x.to_numpy(float, na_value=np.nan) for x in cols]))

    return df.withColumn(out, block(*[c(k) for k in keys]))


def _order_cols(order_by):
    return [c(o) for o in order_by]


def _carry(summary: DataFrame, parts: list[str], aggs: dict[str, Column]) -> DataFrame:
    """Carry-in per block: window over the block summaries of each series."""
    w = Window.partitionBy(*[c(p) for p in parts]).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
    return summary.select(*[c(p) for p in parts], _BLK, *[e.over(w).alias(k) for k, e in aggs.items()])


def _join_carry(d: DataFrame, carry: DataFrame, parts: list[str], nblocks: int) -> DataFrame:
    # without series there is one row per block: bounded by the block count, safe to broadcast
    return join_null_safe(d, carry, [*parts, _BLK], "left", broadcast=not parts)


# ------------------------------------------------------------------------------------------
def row_index(df: DataFrame, order_by, partition_by=None, out: str = _I, rows_per_block: int | None = None
              ) -> DataFrame:
    """0-based position of each row within its series, by ``order_by``."""
    order_by, parts = as_list(order_by), as_list(partition_by)
    d, nb = add_blocks(df, order_by, rows_per_block, parts)
    w = Window.partitionBy(*[c(p) for p in parts], _BLK).orderBy(*_order_cols(order_by))
    d = d.withColumn("__rn", F.row_number().over(w) - 1)
    if nb > 1:
        summ = carried(d).groupBy(*[c(p) for p in parts], _BLK).agg(F.count(F.lit(1)).alias("__cnt"))
        carry = _carry(summ, parts, {"__off": F.sum("__cnt")})
        d = _join_carry(d, carry, parts, nb).withColumn(out, (F.coalesce("__off", F.lit(0)) + F.col("__rn")).cast("long"))
        d = d.drop("__off")
    else:
        d = d.withColumn(out, F.col("__rn").cast("long"))
    return d.drop("__rn", _BLK)


# ------------------------------------------------------------------------------------------
def cumulative(df: DataFrame, cols, how: str, order_by, partition_by=None, out: dict | None = None,
               rows_per_block: int | None = None) -> DataFrame:
    """Running sum / product / min / max; nulls stay null and are skipped."""
    order_by, parts, cols = as_list(order_by), as_list(partition_by), as_list(cols)
    agg = {"sum": F.sum, "product": F.product, "min": F.min, "max": F.max}[how]
    out = out or {x: x for x in cols}
    d, nb = add_blocks(df, order_by, rows_per_block, parts)
    w = Window.partitionBy(*[c(p) for p in parts], _BLK).orderBy(*_order_cols(order_by)) \
        .rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"__l{i}": agg(c(x)).over(w) for i, x in enumerate(cols)})
    if nb > 1:
        summ = carried(d).groupBy(*[c(p) for p in parts], _BLK).agg(*[agg(c(x)).alias(f"__s{i}") for i, x in enumerate(cols)])
        carry = _carry(summ, parts, {f"__c{i}": agg(f"__s{i}") for i in range(len(cols))})
        d = _join_carry(d, carry, parts, nb)
    else:
        d = d.withColumns({f"__c{i}": F.lit(None).cast("double") for i in range(len(cols))})
    res = {}
    for i, x in enumerate(cols):
        loc, car = F.col(f"__l{i}"), F.col(f"__c{i}")
        if how == "sum":
            comb = F.coalesce(loc, F.lit(0)) + F.coalesce(car, F.lit(0))
        elif how == "product":
            comb = F.coalesce(loc, F.lit(1)) * F.coalesce(car, F.lit(1))
        elif how == "min":
            comb = F.least(loc, car)
        else:
            comb = F.greatest(loc, car)
        res[out[x]] = F.when(c(x).isNull(), F.lit(None)).otherwise(comb)
    d = d.withColumns(res)
    return d.drop(_BLK, *[f"__l{i}" for i in range(len(cols))], *[f"__c{i}" for i in range(len(cols))])


def _fill(d: DataFrame, nb: int, values: dict[str, Column], order_by, parts, forward: bool) -> DataFrame:
    """Fill ``values`` (name -> column whose null means 'missing') forward/backward."""
    order = F.struct(*_order_cols(order_by))
    if forward:
        w = Window.partitionBy(*[c(p) for p in parts], _BLK).orderBy(*_order_cols(order_by)) \
            .rowsBetween(Window.unboundedPreceding, 0)
        local = {k: F.last(v, ignorenulls=True).over(w) for k, v in values.items()}
    else:
        # reversed running frame: Spark evaluates "current row .. unbounded following" frames
        # quadratically, "unbounded preceding .. current row" frames in one pass
        w = Window.partitionBy(*[c(p) for p in parts], _BLK).orderBy(*[c(o).desc() for o in order_by]) \
            .rowsBetween(Window.unboundedPreceding, 0)
        local = {k: F.last(v, ignorenulls=True).over(w) for k, v in values.items()}
    names = list(values)
    tmp = {f"__v{i}": values[k] for i, k in enumerate(names)}
    d = d.withColumns(tmp)
    d = d.withColumns({f"__l{i}": local[k] for i, k in enumerate(names)})
    if nb > 1:
        pick = F.max_by if forward else F.min_by
        summ = carried(d).groupBy(*[c(p) for p in parts], _BLK).agg(
            *[pick(F.col(f"__v{i}"), F.when(F.col(f"__v{i}").isNotNull(), order)).alias(f"__s{i}")
              for i in range(len(names))])
        if forward:
            wc = Window.partitionBy(*[c(p) for p in parts]).orderBy(_BLK).rowsBetween(Window.unboundedPreceding, -1)
            cexpr = {f"__c{i}": F.last(f"__s{i}", ignorenulls=True).over(wc) for i in range(len(names))}
        else:
            wc = Window.partitionBy(*[c(p) for p in parts]).orderBy(F.col(_BLK).desc()) \
                .rowsBetween(Window.unboundedPreceding, -1)
            cexpr = {f"__c{i}": F.last(f"__s{i}", ignorenulls=True).over(wc) for i in range(len(names))}
        carry = summ.select(*[c(p) for p in parts], _BLK, *[e.alias(k) for k, e in cexpr.items()])
        d = _join_carry(d, carry, parts, nb)
        d = d.withColumns({k: F.coalesce(F.col(f"__l{i}"), F.col(f"__c{i}")) for i, k in enumerate(names)})
        d = d.drop(*[f"__c{i}" for i in range(len(names))])
    else:
        d = d.withColumns({k: F.col(f"__l{i}") for i, k in enumerate(names)})
    return d.drop(*tmp.keys(), *[f"__l{i}" for i in range(len(names))])


def fill_forward(df: DataFrame, cols, order_by, partition_by=None, rows_per_block: int | None = None) -> DataFrame:
    order_by, parts, cols = as_list(order_by), as_list(partition_by), as_list(cols)
    d, nb = add_blocks(df, order_by, rows_per_block, parts)
    return _fill(d, nb, {x: c(x) for x in cols}, order_by, parts, True).drop(_BLK)


def fill_backward(df: DataFrame, cols, order_by, partition_by=None, rows_per_block: int | None = None) -> DataFrame:
    order_by, parts, cols = as_list(order_by), as_list(partition_by), as_list(cols)
    d, nb = add_blocks(df, order_by, rows_per_block, parts)
    return _fill(d, nb, {x: c(x) for x in cols}, order_by, parts, False).drop(_BLK)


def interpolate_linear(df: DataFrame, cols, order_by, partition_by=None, rows_per_block: int | None = None
                       ) -> DataFrame:
    """Linear interpolation by position; leading nulls stay null, trailing take the last value."""
    order_by, parts, cols = as_list(order_by), as_list(partition_by), as_list(cols)
    d = row_index(df, order_by, parts, _I, rows_per_block)
    d, nb = add_blocks(d, [_I], rows_per_block, parts)
    vals = {f"__p{i}": F.when(c(x).isNotNull(), F.struct(c(x).cast("double").alias("v"), F.col(_I).alias("i")))
            for i, x in enumerate(cols)}
    d = _fill(d, nb, vals, [_I], parts, True)
    vals_n = {f"__n{i}": F.when(c(x).isNotNull(), F.struct(c(x).cast("double").alias("v"), F.col(_I).alias("i")))
              for i, x in enumerate(cols)}
    d = _fill(d, nb, vals_n, [_I], parts, False)
    res = {}
    for i, x in enumerate(cols):
        p, n = F.col(f"__p{i}"), F.col(f"__n{i}")
        interp = p["v"] + (n["v"] - p["v"]) * (F.col(_I) - p["i"]).cast("double") / (n["i"] - p["i"]).cast("double")
        res[x] = (F.when(c(x).isNotNull(), c(x).cast("double"))
                  .when(p.isNull(), F.lit(None).cast("double"))
                  .when(n.isNull(), p["v"])
                  .otherwise(interp))
    d = d.withColumns(res)
    return d.drop(_BLK, _I, *vals.keys(), *vals_n.keys())


# ------------------------------------------------------------------------------------------
def with_halo(df: DataFrame, order_by, partition_by, n: int, rows_per_block: int | None = None
              ) -> tuple[DataFrame, Window]:
    """Frame with row index ``__i``, equal blocks ``__b2`` and an ``__halo`` flag.

    Every block also holds copies of the previous ``n - 1`` rows of its
    series, so windows of up to ``n`` rows ending at a non-halo row are exact.
    Returns the frame and the window spec (partitioned by series and block,
    ordered by ``__i``); drop rows with ``__halo`` after computing.
    """
    order_by, parts = as_list(order_by), as_list(partition_by)
    rpb = rows_per_block or ROWS_PER_BLOCK
    size = max(rpb, 2 * n)
    d = row_index(df, order_by, parts, _I, rows_per_block)
    d = d.withColumn("__b2", F.floor(F.col(_I) / size)).withColumn("__halo", F.lit(False))
    if n > 1:  # rows at the end of a block are emitted twice, in one pass
        own = F.struct(F.col("__b2").alias("b"), F.lit(False).alias("h"))
        next_ = F.struct((F.col("__b2") + 1).alias("b"), F.lit(True).alias("h"))
        copies = F.when((F.col(_I) % size) >= size - (n - 1), F.array(own, next_)).otherwise(F.array(own))
        d = d.drop("__halo").withColumn("__c", F.explode(copies))
        d = d.withColumn("__b2", F.col("__c.b")).withColumn("__halo", F.col("__c.h")).drop("__c")
    w = Window.partitionBy(*[c(p) for p in parts], "__b2").orderBy(_I)
    return d, w


def drop_halo(d: DataFrame) -> DataFrame:
    return d.where(~F.col("__halo")).drop("__halo", "__b2", _I)


def sorted_codes(df: DataFrame, order_cols: Sequence[str], out: str = "__code") -> DataFrame:
    """Attach 0-based positions after a global sort on any sortable columns.

    The sort is a range-partitioned shuffle, written once with each row's
    partition and place; positions are the places plus the sizes of the
    partitions before, so no single task sees all rows.
    """
    from tessera.session import scratch_path

    spark, place, part = df.sparkSession, "__place", "__part"
    path = scratch_path(spark, "sorted")
    df.orderBy(*[c(o) for o in order_cols]).withColumn(place, F.monotonically_increasing_id()).write.parquet(path)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField(place, T.LongType())])).parquet(path)
    rows = rows.withColumn(part, F.shiftright(F.col(place), 33))
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition of the sort
    sizes = rows.groupBy(F.col(part).alias("__p")).agg(F.count(F.lit(1)).alias("__n"))
    sizes = sizes.select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    joined = rows.join(F.broadcast(sizes), F.col(part) == F.col("__p"))
    code = F.col("__off") + F.col(place).bitwiseAND((1 << 33) - 1)
    return joined.withColumn(out, code).select(*[c(x) for x in df.columns], c(out))
