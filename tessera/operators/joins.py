"""Joins, unions and sorts (JON*, SET1, SRT*).

Lookup tables are attached with plain left joins: AQE turns them into
broadcast joins when the built side is small at run time and keeps a
shuffle join (with skew splitting) otherwise.  Explicit ``broadcast`` is used
only where the side is bounded by construction (top-n lists).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.common import as_list, c


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, out: str | None = None,
           mapping_key: str | None = None) -> DataFrame:
    """Value-map lookup (pandas ``.map``): left join on ``key``; unmatched -> null."""
    mk = mapping_key or key
    m = mapping.select(c(mk).alias("__k"), c(value).alias("__val"))
    return df.join(m, c(key) == F.col("__k"), "left").withColumn(out or value, F.col("__val")).drop("__k", "__val")


def semi_keep(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    return df.join(keys, as_list(on), "left_semi")


def union_all(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def sort_by(df: DataFrame, cols, ascending: bool | Sequence[bool] = True, absolute: bool = False,
            value_order: Sequence | None = None, then_by: Sequence[str] = ()) -> DataFrame:
    """Sort by columns; by |x|; or by a user order of values (unknown values last).

    ``then_by`` adds ascending tie-break columns so the order is total.
    """
    cols = as_list(cols)
    asc = ascending if isinstance(ascending, (list, tuple)) else [ascending] * len(cols)
    keys = []
    for x, a in zip(cols, asc):
        e = F.abs(c(x)) if absolute else c(x)
        if value_order is not None:
            m = F.create_map(*[y for i, v in enumerate(value_order) for y in (F.lit(v), F.lit(i))])
            e = F.coalesce(m[c(x)], F.lit(len(value_order)))
        keys.append(e.asc_nulls_last() if a else e.desc_nulls_last())
    return df.orderBy(*keys, *[c(t) for t in then_by])


def top_k(df: DataFrame, col: str, k: int, largest: bool = True, then_by: Sequence[str] = ()) -> DataFrame:
    """Top / bottom k rows by value (a distributed take-ordered: per-task top-k, then merge)."""
    key = c(col).desc_nulls_last() if largest else c(col).asc_nulls_last()
    return df.orderBy(key, *[c(t) for t in then_by]).limit(k)
