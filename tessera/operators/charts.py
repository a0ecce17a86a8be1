"""Chart-data frames (CHD1-9): the bounded numbers behind each chart type.

Drawing is not done here.  Every row is kept unless the caller names a
``cap``: then a larger frame gives a seeded hash sample of exactly ``cap`` rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.common import as_list, c, nan_as_null


def _cap(df: DataFrame, cap: int | None, seed: int = 42) -> DataFrame:
    if not cap:
        return df
    return df.withColumn("__h", F.xxhash64(F.lit(seed), *[c(x) for x in df.columns])).orderBy("__h").limit(cap).drop("__h")


@nan_as_null
def line_data(df: DataFrame, x: str, ys: Sequence[str], group: str | None = None, cap: int | None = None) -> DataFrame:
    """Ordered (x, y..., group) points for line / area / multi-series charts."""
    cols = [c(x), *[c(y) for y in ys]] + ([c(group)] if group else [])
    out = _cap(df.select(*cols), cap)
    return out.orderBy(*([c(group)] if group else []), c(x))


@nan_as_null
def scatter_data(df: DataFrame, cols: Sequence[str], cap: int | None = None) -> DataFrame:
    """Projected columns without nulls (scatter, bubble, 3-D, pair plot, parallel coordinates)."""
    return _cap(df.select(*[c(x) for x in cols]).na.drop(), cap)


@nan_as_null
def animation_frames(df: DataFrame, frame: str, x: str, y: str, group: str | None = None) -> DataFrame:
    """Mean y per (frame, x[, group]) - one row per animated point."""
    keys = [c(frame), c(x)] + ([c(group)] if group else [])
    return df.groupBy(*keys).agg(F.avg(c(y)).alias(y))


@nan_as_null
def bar_with_error(df: DataFrame, cat: str, value: str) -> DataFrame:
    return df.where(c(cat).isNotNull()).groupBy(c(cat)).agg(F.avg(c(value)).alias("mean"),
                                                             F.stddev_samp(c(value)).alias("error"))


@nan_as_null
def candlestick(df: DataFrame, ts: str, value: str, period: str = "DAY") -> DataFrame:
    """Open / high / low / close per period (first and last by time)."""
    from tessera.operators.dates import trunc_ntz
    x = c(value)
    return df.where(x.isNotNull()).groupBy(trunc_ntz(period, c(ts)).alias("period")).agg(
        F.min_by(x, c(ts)).alias("open"), F.max(x).alias("high"), F.min(x).alias("low"), F.max_by(x, c(ts)).alias("close"))


@nan_as_null
def timeline(df: DataFrame, start: str, group: str | None = None, label: str | None = None) -> DataFrame:
    """Event rows with end = the next start in the same group (the last event has none).

    The successor is found by an equi-join on (group, row index + 1), so no
    window spans a whole group.
    """
    from tessera.plans import ordered as O
    keys = as_list(group)
    idx = O.row_index(df, [start], keys, "__i")
    nxt = idx.select(*[c(g) for g in keys], (F.col("__i") - 1).alias("__i"), c(start).alias("end"))
    res = idx.join(nxt, keys + ["__i"], "left").drop("__i")
    cols = ([c(group)] if group else []) + ([c(label)] if label else []) + [c(start), F.col("end")]
    return res.select(*cols)


@nan_as_null
def map_points(df: DataFrame, lat: str, lon: str, size: str | None = None) -> DataFrame:
    """Rows with valid coordinates (|lat| <= 90, |lon| <= 180)."""
    cols = [c(lat), c(lon)] + ([c(size)] if size else [])
    return df.select(*cols).where(c(lat).between(-90, 90) & c(lon).between(-180, 180))


@nan_as_null
def density_grid(df: DataFrame, lat: str, lon: str, decimals: int = 1) -> DataFrame:
    """Point counts on a rounded lat/lon grid."""
    v = map_points(df, lat, lon)
    return v.groupBy(F.round(c(lat), decimals).alias("lat_cell"), F.round(c(lon), decimals).alias("lon_cell")) \
        .agg(F.count(F.lit(1)).alias("count"))


@nan_as_null
def choropleth(df: DataFrame, region: str, value: str, agg: str = "sum") -> DataFrame:
    fn = {"sum": F.sum, "mean": F.avg, "count": F.count, "max": F.max, "min": F.min}[agg]
    return df.where(c(region).isNotNull()).groupBy(c(region)).agg(fn(c(value)).alias("value"))


@nan_as_null
def violin(df: DataFrame, value: str, by: str, points: int = 100) -> tuple[DataFrame, DataFrame]:
    """Box statistics and a KDE per group."""
    from tessera.operators.aggregate import box_stats
    from tessera.operators.stats import kde
    return box_stats(df, value, by), kde(df, value, points, by)


@nan_as_null
def chart_data(df: DataFrame, kind: str, **cols) -> DataFrame:
    fns = {"line": line_data, "scatter": scatter_data, "animation": animation_frames, "bar_error": bar_with_error,
           "candlestick": candlestick, "timeline": timeline, "map": map_points, "density": density_grid,
           "choropleth": choropleth}
    return fns[kind](df, **cols)
