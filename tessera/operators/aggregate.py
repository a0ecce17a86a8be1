"""Grouped, pivoted and hierarchical aggregates (AGG*, FEA2).

Grouped aggregates use Spark's partial (map-side) aggregation, so a hot key is
combined inside each task before the shuffle.  Ranking happens on the grouped
result (one row per group), top-n lists are take-ordered limits, and values
that become columns (pivots) come from a bounded, checked category list.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.common import MAX_CATEGORIES, as_list, bounded_rows, c, nan_as_null
from tessera.plans.quantiles import exact_quantiles

_AGG = {
    "mean": lambda x: F.avg(x), "sum": lambda x: F.sum(x), "count": lambda x: F.count(x),
    "std": lambda x: F.stddev_samp(x), "var": lambda x: F.var_samp(x), "min": lambda x: F.min(x),
    "max": lambda x: F.max(x), "std_pop": lambda x: F.stddev_pop(x), "var_pop": lambda x: F.var_pop(x),
    "nunique": lambda x: F.count_distinct(x),
}


def _not_null_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    for k in keys:
        df = df.where(c(k).isNotNull())
    return df


@nan_as_null
def grouped(df: DataFrame, keys, value: str, aggs: Sequence[str], names: dict[str, str] | None = None,
            drop_null_keys: bool = True) -> DataFrame:
    """groupBy(keys).agg(...) with exact medians; columns named by ``names`` or the agg name."""
    keys = as_list(keys)
    names = names or {a: a for a in aggs}
    base = _not_null_keys(df, keys) if drop_null_keys else df
    x = c(value).cast("double")
    plain = [a for a in aggs if a != "median"]
    g = base.groupBy(*[c(k) for k in keys]).agg(
        *([_AGG[a](x if a not in ("count", "nunique") else c(value)).alias(names[a]) for a in plain] or
          [F.count(F.lit(1)).alias("__n")]))
    if "median" in aggs:
        med = exact_quantiles(base, value, [0.5], keys).select(*[c(k) for k in keys], F.col("q").alias(names["median"]))
        g = g.join(med, keys, "left")
    return g.drop("__n") if not plain else g


# -- AGG1 / AGG2 / AGG7 / AGG8 ------------------------------------------------------------------
@nan_as_null
def group_agg(df: DataFrame, keys, value: str, aggs: Sequence[str] = ("mean", "median", "sum", "count", "std", "min", "max"),
              top: int | None = None, sort_by: str | None = None) -> DataFrame:
    """Group analysis sorted by ``sort_by`` (default the first aggregate) descending; optional top-n."""
    g = grouped(df, keys, value, aggs)
    key = sort_by or aggs[0]
    g = g.orderBy(F.col(key).desc_nulls_last(), *[c(k) for k in as_list(keys)])
    return g.limit(top) if top else g


# -- AGG3 --------------------------------------------------------------------------------------
@nan_as_null
def column_stat(df: DataFrame, cols: Sequence[str], stat: str) -> DataFrame:
    """mean | median | min | max | sum | std | var over columns; std/var are population (numpy)."""
    cols = list(cols)
    if stat == "median":
        from tessera.plans.quantiles import quantile_long
        return quantile_long(df, cols, [0.5]).select(F.col("column").alias("column_name"), F.col("q").alias("value"))
    fn = {"mean": F.avg, "min": F.min, "max": F.max, "sum": F.sum, "std": F.stddev_pop, "var": F.var_pop}[stat]
    row = df.agg(*[fn(c(x).cast("double")).alias(x) for x in cols])
    return row.unpivot([], cols, "column_name", "value")


# -- AGG4 / AGG5 ---------------------------------------------------------------------------------
def format_value(x: Column, fmt: str) -> Column:
    if fmt == "percent":
        return F.concat(F.format_number(x, 2), F.lit("%"))
    if fmt == "currency":
        return F.concat(F.lit("$"), F.format_number(x, 2))
    return F.format_number(x, 2)


@nan_as_null
def metric(df: DataFrame, col: str, agg: str = "mean", fmt: str = "number", where: str | Column | None = None,
           order_by: str | None = None, index: int | None = None) -> DataFrame:
    """Metric card: mean | median | sum | min | max | count | first | last | at (row ``index`` by order)."""
    base = df.where(F.expr(where) if isinstance(where, str) else where) if where is not None else df
    x = c(col).cast("double")
    if agg == "median":
        v = exact_quantiles(base, col, [0.5]).select("q").scalar()
        row = df.sparkSession.range(1).select(v.alias("value"))
    elif agg in ("first", "last"):
        pick = F.min_by if agg == "first" else F.max_by
        row = base.agg(pick(x, c(order_by)).alias("value"))
    elif agg == "at":
        from tessera.plans.ordered import row_index
        row = row_index(base, order_by, None, "__r").where(F.col("__r") == index).select(x.alias("value"))
    elif agg == "count":
        row = base.agg(F.count(x).cast("double").alias("value"))
    else:
        row = base.agg(_AGG[agg](x).alias("value"))
    return row.select(F.lit(col).alias("column_name"), F.lit(agg).alias("metric"), "value",
                      format_value(F.col("value"), fmt).alias("formatted"))


# -- AGG6 ----------------------------------------------------------------------------------------
@nan_as_null
def metric_delta(df: DataFrame, col: str, kind: str = "previous", order_by: str | None = None,
                 reference: float | None = None, period: str | None = None, agg: str = "sum") -> DataFrame:
    """Current value vs a reference: previous row | first row | custom value | previous calendar period.

    Returns (current, reference, delta, delta_pct).
    """
    x = c(col).cast("double")
    if kind == "period":
        from tessera.operators.dates import trunc_ntz
        g = df.groupBy(trunc_ntz(period, c(order_by)).alias("__p")).agg(_AGG[agg](x).alias("__v"))
        last_p = g.agg(F.max("__p")).scalar()
        cur = g.where(F.col("__p") == last_p).agg(F.max("__v")).scalar()
        # the calendar period before the last one; null when it has no rows
        step = F.expr({"DAY": "INTERVAL 1 DAY", "WEEK": "INTERVAL 7 DAYS", "MONTH": "INTERVAL 1 MONTH",
                       "QUARTER": "INTERVAL 3 MONTHS", "YEAR": "INTERVAL 1 YEAR"}[period.upper()])
        ref = g.where(F.col("__p") == last_p - step).agg(F.max("__v")).scalar()
    else:
        o = c(order_by)
        cur = df.agg(F.max_by(x, o)).scalar()
        if kind == "previous":
            last_o = df.agg(F.max(o)).scalar()
            ref = df.where(o < last_o).agg(F.max_by(x, o)).scalar()
        elif kind == "first":
            ref = df.agg(F.min_by(x, o)).scalar()
        elif kind == "custom":
            ref = F.lit(float(reference))
        else:
            raise ValueError(kind)
    one = df.sparkSession.range(1)
    return one.select(cur.alias("current"), ref.alias("reference"), (cur - ref).alias("delta"),
                      F.try_divide((cur - ref) * 100.0, F.abs(ref)).alias("delta_pct"))


# -- AGG9 ---------------------------------------------------------------------------------------
@nan_as_null
def top_with_other(df: DataFrame, name: str, value: str, k: int) -> DataFrame:
    """Sum by category; with more than k categories the top k-1 plus one "Other" row with the rest."""
    g = _not_null_keys(df, [name]).groupBy(c(name).alias("category")).agg(F.sum(c(value)).alias("total"))
    if g.limit(k + 1).count() <= k:
        return g
    top = g.orderBy(F.col("total").desc(), "category").limit(k - 1).select(F.col("category").alias("__t"))
    j = g.join(F.broadcast(top), F.col("category") == F.col("__t"), "left")
    lab = F.when(F.col("__t").isNotNull(), F.col("category")).otherwise(F.lit("Other"))
    return j.groupBy(lab.alias("category")).agg(F.sum("total").alias("total"))


# -- AGG10-13 -------------------------------------------------------------------------------------
def _top_keys(df: DataFrame, col: str, n: int) -> DataFrame:
    return (_not_null_keys(df, [col]).groupBy(c(col).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
            .orderBy(F.col("__n").desc(), "__v").limit(n).select("__v"))


@nan_as_null
def count_2way(df: DataFrame, a: str, b: str, n: int) -> DataFrame:
    """Counts by two categories, restricted to the top-n values of ``a``."""
    base = _not_null_keys(df, [a, b]).join(F.broadcast(_top_keys(df, a, n)), c(a) == F.col("__v"), "left_semi")
    return base.groupBy(c(a), c(b)).agg(F.count(F.lit(1)).alias("count"))


def _values(df: DataFrame, col: str, limit: int) -> list:
    rows = bounded_rows(_not_null_keys(df, [col]).select(c(col).alias("v")).distinct().orderBy("v"), limit, col)
    return [r["v"] for r in rows]


@nan_as_null
def pivot_mean(df: DataFrame, row: str, col: str, value: str, top_rows: int | None = None, top_cols: int | None = None,
               fill: float | None = 0.0, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Mean of ``value`` by row x column category; missing cells -> ``fill`` (None keeps null)."""
    base = _not_null_keys(df, [row, col])
    if top_rows:
        base = base.join(F.broadcast(_top_keys(df, row, top_rows)), c(row) == F.col("__v"), "left_semi")
    if top_cols:
        cols = [r["__v"] for r in _top_keys(df, col, top_cols).collect()]  # top_cols values
        base = base.where(c(col).isin(cols))
        cols = sorted(cols)
    else:
        cols = _values(base, col, max_categories)
    p = base.groupBy(c(row)).pivot(col, cols).agg(F.avg(c(value).cast("double")))
    return p.na.fill(fill, subset=[str(v) for v in cols]) if fill is not None else p


@nan_as_null
def crosstab(df: DataFrame, a: str, b: str, normalise: str | None = None) -> DataFrame:
    """Long cross-tab (a, b, count[, share]); ``normalise='index'`` adds row proportions."""
    g = _not_null_keys(df, [a, b]).groupBy(c(a), c(b)).agg(F.count(F.lit(1)).alias("count"))
    if normalise == "index":
        g = g.withColumn("share", F.col("count") / F.sum("count").over(Window.partitionBy(c(a))))
    elif normalise == "all":
        tot = g.agg(F.sum("count")).scalar()
        g = g.withColumn("share", F.col("count") / tot)
    return g


@nan_as_null
def crosstab_wide(df: DataFrame, a: str, b: str, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Wide cross-tab of counts (missing combinations -> 0)."""
    base = _not_null_keys(df, [a, b])
    cols = _values(base, b, max_categories)
    return base.groupBy(c(a)).pivot(b, cols).count().na.fill(0, subset=[str(v) for v in cols])


# -- AGG14-21 --------------------------------------------------------------------------------------
@nan_as_null
def hierarchy_totals(df: DataFrame, path: Sequence[str], value: str) -> DataFrame:
    """Totals at every level of a category path (sunburst/treemap): rollup + level."""
    path = list(path)
    level = sum((1 - F.grouping(c(p))) for p in path[1:]) + (1 - F.grouping(c(path[0])))
    base = _not_null_keys(df, path)
    return base.rollup(*[c(p) for p in path]).agg(F.sum(c(value)).alias("total"), level.cast("int").alias("level"))


@nan_as_null
def flows(df: DataFrame, src: str, dst: str, value: str, n: int) -> DataFrame:
    """Flow totals source -> target among the n most frequent sources and targets (by rows), with node ids."""
    base = _not_null_keys(df, [src, dst])

    def top(col):
        return (_not_null_keys(df, [col]).groupBy(c(col).alias("__v")).agg(F.count(F.lit(1)).alias("__s"))
                .orderBy(F.col("__s").desc(), "__v").limit(n).select("__v"))
    top_src, top_dst = top(src), top(dst)
    base = base.join(F.broadcast(top_src), c(src) == F.col("__v"), "left_semi")
    base = base.join(F.broadcast(top_dst), c(dst) == F.col("__v"), "left_semi")
    g = base.groupBy(c(src).alias("source"), c(dst).alias("target")).agg(F.sum(c(value)).alias("value"))
    nodes = g.select(F.col("source").cast("string").alias("node")).union(
        g.select(F.col("target").cast("string").alias("node"))).distinct()
    # at most 2n nodes: a single-partition window over them is bounded
    nodes = nodes.withColumn("node_id", (F.row_number().over(Window.orderBy("node")) - 1).cast("int"))
    s = nodes.select(F.col("node").alias("__s"), F.col("node_id").alias("source_id"))
    t = nodes.select(F.col("node").alias("__t"), F.col("node_id").alias("target_id"))
    return (g.join(F.broadcast(s), F.col("source").cast("string") == F.col("__s"))
            .join(F.broadcast(t), F.col("target").cast("string") == F.col("__t")).drop("__s", "__t"))


@nan_as_null
def funnel(df: DataFrame, stage: str, value: str, order: Sequence[str] | None = None, ascending: bool = False) -> DataFrame:
    """Sum per stage with % of the first stage, ordered by value (descending or ascending) or by a
    user order; stages the user did not list follow at the end by name."""
    g = _not_null_keys(df, [stage]).groupBy(c(stage).alias("stage")).agg(F.sum(c(value)).alias("value"))
    if order:
        rank = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])[F.col("stage")]
        by = [rank.asc_nulls_last(), F.col("stage")]
    else:
        by = [F.col("value").asc() if ascending else F.col("value").desc(), F.col("stage")]
    g = g.withColumn("position", (F.row_number().over(Window.orderBy(*by)) - 1).cast("int"))  # one row per stage
    first = g.where(F.col("position") == g.agg(F.min("position")).scalar()).agg(F.max("value")).scalar()
    return g.withColumn("pct_of_first", F.col("value") * 100.0 / first)


@nan_as_null
def category_profile(df: DataFrame, cat: str, cols: Sequence[str], n: int) -> DataFrame:
    """Mean of several columns for the top-n categories (by count)."""
    base = _not_null_keys(df, [cat]).join(F.broadcast(_top_keys(df, cat, n)), c(cat) == F.col("__v"), "left_semi")
    return base.groupBy(c(cat)).agg(*[F.avg(c(x).cast("double")).alias(x) for x in cols])


@nan_as_null
def surface_grid(df: DataFrame, x: str, y: str, z: str, max_categories: int = MAX_CATEGORIES) -> DataFrame:
    """Mean z on the full (x, y) grid; absent cells -> 0.

    The grid is the result itself: every x gets the list of y values (one
    array, at most ``max_categories`` long), and the grouped means are joined on.
    """
    means = _not_null_keys(df, [x, y]).groupBy(c(x), c(y)).agg(F.avg(c(z).cast("double")).alias("__z"))
    ys = _values(means, y, max_categories)
    ytype = means.schema[y].dataType
    grid = means.select(c(x)).distinct().withColumn(y, F.explode(F.array(*[F.lit(v).cast(ytype) for v in ys])))
    return grid.join(means, [x, y], "left").select(c(x), c(y), F.coalesce("__z", F.lit(0.0)).alias(z))


@nan_as_null
def waterfall(df: DataFrame, cat: str, value: str, n: int) -> DataFrame:
    """The n rows with the largest values, running sum in that order, plus a Total row."""
    g = df.where(c(value).isNotNull()).select(c(cat).cast("string").alias("category"), c(value).alias("value"))
    top = g.orderBy(F.col("value").desc(), "category").limit(n)
    w = Window.orderBy(F.col("value").desc(), "category").rowsBetween(Window.unboundedPreceding, 0)
    top = top.withColumn("running", F.sum("value").over(w)).withColumn("is_total", F.lit(False))
    tot = top.agg(F.lit("Total").alias("category"), F.sum("value").alias("value"), F.sum("value").alias("running"),
                  F.lit(True).alias("is_total"))
    return top.unionByName(tot)


@nan_as_null
def gauge(df: DataFrame, col: str, low: float, high: float) -> DataFrame:
    """Mean with a band label: low (< low), medium, high (>= high)."""
    m = F.avg(c(col).cast("double"))
    return df.agg(m.alias("mean")).select(
        "mean", F.when(F.col("mean") < low, "low").when(F.col("mean") < high, "medium").otherwise("high").alias("band"))


@nan_as_null
def box_stats(df: DataFrame, value: str, by: str | None = None, top: int | None = None) -> DataFrame:
    """Q1, median, Q3, IQR, whiskers (extreme points within 1.5 IQR), outlier count, min, max, count."""
    keys = as_list(by)
    base = _not_null_keys(df, keys)
    if top and keys:
        base = base.join(F.broadcast(_top_keys(df, keys[0], top)), c(keys[0]) == F.col("__v"), "left_semi")
    q = exact_quantiles(base, value, [0.25, 0.5, 0.75], keys)
    qs = q.groupBy(*[c(k) for k in keys]).agg(*[F.max(F.when(F.col("p") == p, F.col("q"))).alias(a)
                                                for p, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    if keys:
        j = base.join(qs, keys)
    else:
        j = base.select("*", *[qs.select(a).scalar().alias(a) for a in ("q1", "median", "q3")])
    x = c(value).cast("double")
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    return j.groupBy(*[c(k) for k in keys]).agg(
        F.count(x).alias("count"), F.min(x).alias("min"), F.first("q1").alias("q1"), F.first("median").alias("median"),
        F.first("q3").alias("q3"), (F.first("q3") - F.first("q1")).alias("iqr"),
        F.min(F.when(x >= lo, x)).alias("lower_whisker"), F.max(F.when(x <= hi, x)).alias("upper_whisker"),
        F.count_if((x < lo) | (x > hi)).alias("outliers"), F.max(x).alias("max"))


# -- FEA2 -----------------------------------------------------------------------------------------
@nan_as_null
def group_stats(df: DataFrame, keys, value: str, aggs: Sequence[str] = ("mean",)) -> DataFrame:
    """Group statistics joined back to every row as ``{keys}_{value}_{agg}``; null keys -> null.

    A grouped aggregate plus an equi-join (broadcast by AQE when the group
    table is small), not a window: a hot key is pre-aggregated per task.
    """
    keys = as_list(keys)
    prefix = "_".join(keys)
    names = {a: f"{prefix}_{value}_{a}" for a in aggs}
    g = grouped(df, keys, value, aggs, names)
    return df.join(g, keys, "left")
