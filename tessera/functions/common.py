"""Small helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CATEGORIES = 1000  # category lists that become columns or literals


def as_list(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def q(name: str) -> str:
    """Back-quote a column name for SQL expressions."""
    return "`" + name.replace("`", "``") + "`"


def c(name: str) -> Column:
    return F.col(q(name))


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def is_datetime(dt: T.DataType) -> bool:
    return isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    ex = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in ex]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def datetime_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_datetime(f.dataType)]


def nan_to_null(col: Column) -> Column:
    return F.when(F.isnan(col), F.lit(None).cast("double")).otherwise(col)


def with_nulls(df: DataFrame) -> DataFrame:
    """``df`` with NaN in float and double columns turned into null (pandas has one missing value)."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({x: nan_to_null(c(x)).cast(df.schema[x].dataType) for x in floats}) if floats else df


def nan_as_null(fn):
    """Let an operator on a frame treat NaN as missing."""
    @wraps(fn)
    def run(df: DataFrame, *args, **kw):
        return fn(with_nulls(df), *args, **kw)
    return run


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collect at most ``limit`` rows; raise if there are more.

    Used only for frames whose size is bounded by construction (category
    lists, per-block summaries); the guard proves the bound at run time.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than {limit} rows; raise the cap or pre-filter")
    return rows


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Join on equal keys where null equals null; the keys appear once, from ``left``."""
    tmp = {k: f"__r{i}_{k}" for i, k in enumerate(keys)}
    right = right.withColumnsRenamed(tmp)
    cond = F.lit(True)
    for k, t in tmp.items():
        cond = cond & c(k).eqNullSafe(c(t))
    return left.join(F.broadcast(right) if broadcast else right, cond, how).drop(*tmp.values())


def scalar_values(agg_row_df: DataFrame) -> dict:
    """The single row of a global aggregate as Python values (a handful of numbers).

    Used where a plan references the same scalars many times (bin edges,
    per-column scaling): literals let Catalyst fold them, whereas many
    scalar-subquery references may each run the aggregate.
    """
    row = agg_row_df.first()
    return row.asDict() if row is not None else {}
