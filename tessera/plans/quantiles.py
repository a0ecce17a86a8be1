"""Exact, distributed quantiles with linear interpolation.

``percentile`` keeps a value->count map per group and merges it in one task,
so a global median of a high-cardinality column ends up in one reducer.  This
module computes the same numbers (pandas ``quantile`` / DuckDB
``quantile_cont``) without that bottleneck, in two passes over the rows:

1. ``percentile_approx`` (bounded sketch memory) gives a bracket ``[lo, hi]``
   around every wanted quantile, ``1 / grid`` of the rows on either side;
2. one grouped count: rows inside a bracket are counted per distinct value,
   rows between two brackets only in all.  Partial aggregation collapses hot
   values, so a value that fills a bracket costs one row.

Running sums over the counts of a bracket then locate the exact order
statistics.  A target that the sketch missed (it is then between two brackets)
is seen by its rank and the passes are repeated with wider brackets, at last
the whole range.  Columns of a table are done together, without a row per
value and target.

Groups of at most ``max_bracket_rows`` rows are counted by value as a whole; if
all are so small (checked by a first aggregate), the built-in exact
``percentile`` is used directly: its value map is then bounded by that size.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tessera.functions.common import as_list, c, join_null_safe
from tessera.session import written

_G = "__g"
_V = "__v"
#: Brackets whose ends are compared one by one in generated code; more are a filter of an array.
_FEW = 16


def _slot(v: Column, los: Sequence[Column | None], his: Sequence[Column | None]) -> tuple[Column, Column]:
    """(number of bracket ends passed, whether ``v`` is inside a bracket); a bound of None is open."""
    def passed(test, ends, open_):
        some = [e for e in ends if e is not None]
        if len(some) > _FEW:
            n = F.size(F.filter(F.array(*some), lambda e: test(v, e)))
        else:
            n = reduce(lambda x, y: x + y, [F.coalesce(test(v, e), F.lit(open_ == 1)).cast("int") for e in some], F.lit(0))
        return n + F.lit(open_ * (len(ends) - len(some)))
    begun, ended = passed(lambda x, e: x >= e, los, 1), passed(lambda x, e: x > e, his, 0)
    return begun + ended, begun > ended


def _located(counted: DataFrame, keys: list[str], ps: Sequence[float]) -> DataFrame:
    """[keys, _pi, _p, _vlo, _vhi, _frac] from counts per (keys, slot, value); a null value: the target is between brackets."""
    by_key = Window.partitionBy(*keys)
    slots = counted.groupBy(*keys, "_slot").agg(F.sum("_c").alias("_sc"))
    slots = slots.select(*keys, "_slot", F.sum("_sc").over(by_key).alias("_n"), F.coalesce(
        F.sum("_sc").over(by_key.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_slot").orderBy(_V).rowsBetween(Window.unboundedPreceding, 0)
    j = join_null_safe(counted, slots, [*keys, "_slot"]).withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    items = []
    for i, p in enumerate(ps):
        pos = (F.col("_n") - 1).cast("double") * F.lit(float(p))
        for role, k in ((0, F.floor(pos)), (1, F.ceil(pos))):
            items.append(F.struct(F.lit(i).alias("_pi"), F.lit(float(p)).alias("_p"), F.lit(role).alias("_role"),
                                  k.cast("long").alias("_k"), (pos - F.floor(pos)).alias("_frac")))
    first = F.col("_upto") - F.col("_c")
    hits = j.where(F.col("_c") > 0).select(*keys, _V, F.explode(F.filter(
        F.array(*items), lambda t: (t["_k"] >= first) & (t["_k"] < F.col("_upto")))).alias("_t"))
    return hits.groupBy(*keys, F.col("_t._pi").alias("_pi"), F.col("_t._p").alias("_p")).agg(
        F.max(F.when(F.col("_t._role") == 0, F.col(_V))).alias("_vlo"), F.max(F.when(F.col("_t._role") == 1, F.col(_V))).alias("_vhi"),
        F.max("_t._frac").alias("_frac"))


def _shares(ps: Sequence[float], margin: float) -> list[float]:
    """Ends of the brackets as shares of the rows."""
    return [max(0.0, p - margin) for p in ps] + [min(1.0, p + margin) for p in ps]


def _ends(ps: Sequence[float], margin: float, values) -> tuple[list, list]:
    """Lower and upper ends: the values at ``_shares``, None where a bracket reaches the first or last row."""
    k = len(ps)
    return ([None if p - margin <= 0 else values[i] for i, p in enumerate(ps)],
            [None if p + margin >= 1 else values[k + i] for i, p in enumerate(ps)])


def _missed(located: DataFrame) -> DataFrame:
    return located.where(F.col("_vlo").isNull() | F.col("_vhi").isNull())


def _interpolated() -> Column:
    return F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_frac")


def _of_columns(df: DataFrame, cols: Sequence[str], ps: Sequence[float], rows: int, grid: int, accuracy: int) -> dict[str, list]:
    """Exact quantiles of whole columns (None: no values), of which the longest has ``rows``."""
    names = [f"_x{i}" for i in range(len(cols))]
    base = df.select(*[c(x).cast("double").alias(n) for x, n in zip(cols, names)])
    out, left, margin = {x: [None] * len(ps) for x in cols}, list(range(len(cols))), 1 / grid + 2 / accuracy + 2 / rows
    while left:
        shares = [F.lit(s) for s in _shares(ps, margin)]
        if margin < 1:
            ends = base.agg(*[F.percentile_approx(names[i], F.array(*shares), accuracy).alias(names[i]) for i in left]).first()
        parts = []  # a small scan and count per column: all in one projection would be too long a method to compile
        for i in left:
            v = F.col(names[i])
            los, his = _ends(ps, margin, [F.lit(e) for e in ends[names[i]] or [None] * len(shares)] if margin < 1 else ())
            slot, inside = _slot(v, los, his)
            part = base.where(v.isNotNull()).select(slot.alias("_slot"), F.when(inside, v).alias(_V))
            parts.append(part.groupBy("_slot", _V).agg(F.count(F.lit(1)).alias("_c")).select(F.lit(i).alias("_i"), "_slot", _V, "_c"))
        counted = reduce(DataFrame.unionByName, parts)
        counted = written(counted, "quantile-counts")
        again = set()
        for r in _located(counted, ["_i"], ps).withColumn("_q", _interpolated()).collect():  # columns x ps rows
            if r["_vlo"] is None or r["_vhi"] is None:
                again.add(r["_i"])
            out[cols[r["_i"]]][r["_pi"]] = r["_q"]
        left, margin = sorted(again), margin * 8
    return out


def _of_groups(base: DataFrame, by: list[str], ps: Sequence[float], stats: DataFrame, most: int, grid: int, accuracy: int) -> DataFrame:
    """[by, _pi, _p, _vlo, _vhi, _frac]; groups above ``most`` rows (at most rows / ``most`` of them) have brackets."""
    big = written(stats.where(F.col("_n") > most).drop("_n"), "quantile-groups")
    margin, k = 1 / grid + 2 / accuracy + 2 / most, len(ps)
    marked = join_null_safe(base, big.withColumn("_big", F.lit(True)), by, "left", broadcast=True)
    while True:
        rows = marked
        los = his = [None] * k
        if margin < 1:
            sketch = marked.where("_big").groupBy(*by).agg(F.percentile_approx(_V, F.array(*[F.lit(s) for s in _shares(ps, margin)]), accuracy).alias("_e"))
            lo, hi = _ends(ps, margin, [F.col("_e")[i] for i in range(2 * k)])
            los = [None if e is None else F.col(f"_lo{i}") for i, e in enumerate(lo)]
            his = [None if e is None else F.col(f"_hi{i}") for i, e in enumerate(hi)]
            ends = sketch.select(*[c(b) for b in by], *[e.alias(f"_{n}{i}") for n, es in (("lo", lo), ("hi", hi)) for i, e in enumerate(es) if e is not None])
            rows = join_null_safe(marked, written(ends, "quantile-brackets"), by, "left", broadcast=True)
        slot, inside = _slot(F.col(_V), los, his)
        counted = rows.select(*[c(b) for b in by], slot.alias("_slot"), F.when(inside, F.col(_V)).alias(_V))
        counted = written(counted.groupBy(*[c(b) for b in by], "_slot", _V).agg(F.count(F.lit(1)).alias("_c")), "quantile-counts")
        located = written(_located(counted, by, ps), "quantiles")
        if margin >= 1 or _missed(located).isEmpty():
            return located
        margin *= 8


def exact_quantiles(df: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] | str = (),
                    max_bracket_rows: int = 2_000_000, grid: int = 4000, accuracy: int = 2500,
                    max_group_rows: int | None = None) -> DataFrame:
    """Exact quantiles of ``value`` per group -> DataFrame[by..., p, q].

    Nulls are skipped; groups with no non-null value are absent.  A caller that
    already knows the largest group size passes ``max_group_rows`` and saves
    the counting pass.
    """
    by = as_list(by)
    ps = [float(p) for p in ps]
    base = df.select(*[c(b) for b in by], F.col(value).cast("double").alias(_V)).where(F.col(_V).isNotNull())
    stats = base.groupBy(*[c(b) for b in by]).agg(F.count(F.lit(1)).alias("_n"))
    biggest = max_group_rows if max_group_rows is not None else stats.agg(F.max("_n")).first()[0]
    if biggest is None or biggest <= max_bracket_rows:
        # every group is small enough for the exact percentile aggregate: its value map per
        # group is bounded by max_bracket_rows, and partial aggregation runs per task
        keys = [c(b) for b in by] or [F.lit(0).alias(_G)]
        pct = base.groupBy(*keys).agg(F.percentile(_V, F.array(*[F.lit(p) for p in ps])).alias("_qs"))
        items = F.array(*[F.struct(F.lit(p).alias("p"), F.col("_qs")[i].alias("q")) for i, p in enumerate(ps)])
        return pct.select(*[c(b) for b in by], F.explode(items).alias("_t")).select(*[c(b) for b in by], "_t.p", "_t.q")
    if not by:
        values = _of_columns(base, [_V], ps, biggest, grid, accuracy)[_V]
        return df.sparkSession.createDataFrame(list(zip(ps, values)), "p double, q double")
    located = _of_groups(base, by, ps, stats, max_bracket_rows, grid, accuracy)
    return located.select(*[c(b) for b in by], F.col("_p").alias("p"), _interpolated().alias("q"))


def quantile_long(df: DataFrame, cols: Sequence[str], ps: Sequence[float], by: Sequence[str] | str = (),
                  max_bracket_rows: int = 2_000_000, grid: int = 4000, accuracy: int = 2500,
                  max_group_rows: int | None = None) -> DataFrame:
    """Exact quantiles of several columns -> [by..., column, p, q]; whole columns share each pass over the table."""
    by = as_list(by)
    cols = list(cols)
    if not cols:
        raise ValueError("no columns")
    if not by and max_group_rows is None:
        # group sizes are the per-column non-null counts: one pass over the wide frame
        max_group_rows = max(df.agg(*[F.count(c(x)).alias(f"n{i}") for i, x in enumerate(cols)]).first())
    if not by and max_group_rows > max_bracket_rows:
        ps = [float(p) for p in ps]
        values = _of_columns(df, cols, ps, max_group_rows, grid, accuracy)
        rows = [(x, p, v) for x in cols for p, v in zip(ps, values[x]) if v is not None]
        return df.sparkSession.createDataFrame(rows, "column string, p double, q double")
    long = df.select(*[c(b) for b in by], *[F.col(x).cast("double").alias(x) for x in cols]) \
        .unpivot([c(b) for b in by] if by else [], cols, "column", "value")
    return exact_quantiles(long, "value", ps, by + ["column"], max_bracket_rows, grid, accuracy, max_group_rows)


def quantile_values(df: DataFrame, col: str, ps: Sequence[float], **kw) -> list[float | None]:
    """Global exact quantiles of one column as Python floats (bounded: len(ps))."""
    rows = {r["p"]: r["q"] for r in exact_quantiles(df, col, ps, **kw).collect()}
    return [rows.get(float(p)) for p in ps]


def quantile_map(df: DataFrame, cols: Sequence[str], ps: Sequence[float], **kw) -> dict[str, list]:
    """Global exact quantiles of several columns: {col: [q for p in ps]} (bounded)."""
    cols = list(cols)
    if not cols:
        return {}
    rows = quantile_long(df, cols, ps, **kw).collect()
    out = {x: [None] * len(ps) for x in cols}
    idx = {float(p): i for i, p in enumerate(ps)}
    for r in rows:
        out[r["column"]][idx[r["p"]]] = r["q"]
    return out
