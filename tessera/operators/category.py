"""Categorical encoders (CAT1-7) and string cleaning (CAT8).

Encoders build a value -> code table with a grouped aggregate (partial
aggregation per task) and attach it with a left join; Spark broadcasts the
table when AQE sees it is small and falls back to a shuffle join when a column
has very many distinct values.  One-hot is the only encoder that turns values
into *columns*; its category list is guarded by ``max_categories``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.common import MAX_CATEGORIES, as_list, bounded_rows, c
from tessera.plans.ordered import sorted_codes


def categories(df: DataFrame, col: str, max_categories: int = MAX_CATEGORIES) -> list:
    """Sorted distinct non-null values; raises above ``max_categories``."""
    rows = bounded_rows(df.where(c(col).isNotNull()).select(c(col).alias("v")).distinct().orderBy("v"),
                        max_categories, f"categories of {col}")
    return [r["v"] for r in rows]


def one_hot(df: DataFrame, col: str, keep: bool = True, max_categories: int = MAX_CATEGORIES,
            prefix: str | None = None) -> DataFrame:
    """``col_value`` boolean columns (sorted values); null -> all false."""
    prefix = col if prefix is None else prefix
    cats = categories(df, col, max_categories)
    name = (lambda v: f"{prefix}_{v}") if prefix else (lambda v: f"{v}")
    out = df.withColumns({name(v): F.coalesce(c(col) == F.lit(v), F.lit(False)) for v in cats})
    return out if keep else out.drop(col)


def _attach(df: DataFrame, table: DataFrame, col: str, value: Column, out: str) -> DataFrame:
    t = table.select(F.col("__v"), value.alias("__code"))
    j = df.join(t, c(col) == F.col("__v"), "left")
    return j.withColumn(out, F.col("__code")).drop("__v", "__code")


def label_encode(df: DataFrame, col: str, order_by: str, out: str | None = None) -> DataFrame:
    """Codes 0.. in order of first appearance (by ``order_by``); null stays null."""
    firsts = df.where(c(col).isNotNull()).groupBy(c(col).alias("__v")).agg(F.min(c(order_by)).alias("__first"))
    try:  # numeric / temporal order key: block row index (no Python rows)
        from tessera.plans.ordered import row_index
        codes = row_index(firsts, ["__first", "__v"], None, "__code")
    except TypeError:  # other sortable keys: distributed sort + per-partition offsets
        codes = sorted_codes(firsts, ["__first", "__v"])
    return _attach(df, codes, col, F.col("__code"), out or col)


def frequency_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Share of non-null rows holding the value."""
    g = df.where(c(col).isNotNull()).groupBy(c(col).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    tot = g.agg(F.sum("__n")).scalar()
    return _attach(df, g, col, F.col("__n") / tot, out or col)


def count_encode(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    g = df.where(c(col).isNotNull()).groupBy(c(col).alias("__v")).agg(F.count(F.lit(1)).alias("__n"))
    return _attach(df, g, col, F.col("__n"), out or col)


def target_encode(df: DataFrame, col: str, target: str, out: str | None = None) -> DataFrame:
    """Group mean of ``target`` per value (no smoothing); null key -> null."""
    g = df.where(c(col).isNotNull()).groupBy(c(col).alias("__v")).agg(F.avg(c(target).cast("double")).alias("__m"))
    return _attach(df, g, col, F.col("__m"), out or col)


def binary_encode(df: DataFrame, col: str, prefix: str | None = None) -> DataFrame:
    """Bits (LSB first) of the sorted category code; null code -1 -> all bits 1.

    Width = bit length of the largest code, from one scalar aggregate.
    """
    prefix = prefix or f"{col}_bin"
    vals = df.where(c(col).isNotNull()).select(c(col).alias("__v")).distinct()
    codes = sorted_codes(vals, ["__v"])
    ncodes = vals.count()
    width = max(1, (ncodes - 1).bit_length()) if ncodes > 0 else 1
    j = df.join(codes, c(col) == F.col("__v"), "left").withColumn("__code", F.coalesce("__code", F.lit(-1)))
    j = j.withColumns({f"{prefix}_{i}": F.shiftright(F.col("__code"), i).bitwiseAND(1).cast("int")
                       for i in range(width)})
    return j.drop("__v", "__code")


def ordinal_encode(df: DataFrame, col: str, order: Sequence[str], out: str | None = None) -> DataFrame:
    """User order -> 0..k-1; unknown or null -> null."""
    m = F.create_map(*[x for i, v in enumerate(order) for x in (F.lit(v), F.lit(i))])
    return df.withColumn(out or col, m[c(col)])


# -- CAT8 ------------------------------------------------------------------------------
def clean_string_expr(col: Column, ops: Sequence[str]) -> Column:
    """Apply, in order: lower, punct (drop what is not a letter, digit, ``_`` or space), digits, spaces (collapse + trim), html."""
    e = col
    for op in ops:
        if op == "lower":
            e = F.lower(e)
        elif op == "punct":
            e = F.regexp_replace(e, r"(?U)[^\p{L}\p{N}_\s]", "")
        elif op == "digits":
            e = F.regexp_replace(e, r"(?U)\d", "")
        elif op == "spaces":
            e = F.trim(F.regexp_replace(e, r"(?U)\s+", " "))
        elif op == "html":
            e = F.regexp_replace(e, r"<.*?>", "")
        else:
            raise ValueError(op)
    return e


def clean_string(df: DataFrame, col: str, ops: Sequence[str], out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, clean_string_expr(c(col), as_list(ops)))
