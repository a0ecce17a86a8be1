"""Schema tools (SRC7, SRC9-12): type narrowing, date / geo column candidates,
column kinds and type normalisation.  Each decision is one aggregate pass."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.common import c
from tessera.operators.profile import kind_of

_INT_LADDER = [("tinyint", -128, 127), ("smallint", -32768, 32767), ("int", -2 ** 31, 2 ** 31 - 1),
               ("bigint", -2 ** 63, 2 ** 63 - 1)]
_FLOAT32_MAX = 3.4028235e38


def narrow_types(df: DataFrame) -> DataFrame:
    """Smallest integer type holding min..max; whole-number floats become integers; other floats that
    fit stay double (float32 loses precision for decimal data, so it is not used)."""
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    if not nums:
        return df
    aggs = []
    for x in nums:
        v = c(x).cast("double")
        aggs += [F.min(v).alias(f"{x}__min"), F.max(v).alias(f"{x}__max"),
                 F.coalesce(F.bool_and(v == F.floor(v)), F.lit(True)).alias(f"{x}__whole")]
    r = df.agg(*aggs).first()
    casts = {}
    for x in nums:
        lo, hi, whole = r[f"{x}__min"], r[f"{x}__max"], r[f"{x}__whole"]
        if lo is None or not whole:
            continue
        for name, a, b in _INT_LADDER:
            if lo >= a and hi <= b:
                casts[x] = c(x).cast(name)
                break
    return df.withColumns(casts)


def column_kinds(df: DataFrame) -> DataFrame:
    """(column_name, dtype, kind) from the schema; kind = numeric | categorical | datetime | boolean | other."""
    return df.sparkSession.createDataFrame(
        [(f.name, f.dataType.simpleString(), kind_of(f.dataType)) for f in df.schema.fields],
        "column_name string, dtype string, kind string")


_DATE_NAME = re.compile(r"date|time|year|month|day", re.I)


# fixed values: date spellings looked for in the first value of a text column
DATE_VALUE = r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{4}/\d{2}/\d{2}"


def date_candidates(df: DataFrame, order_by: str | None = None) -> DataFrame:
    """Columns that are datetime typed, have a date-like name, or whose first non-null text value has a date in it.

    The first value is the one with the smallest ``order_by`` (default: the smallest value itself, so that it is defined).
    """
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    first = df.agg(*[F.min_by(c(x), F.when(c(x).isNotNull(), c(order_by or x))).alias(x) for x in texts]).first() if texts else {}
    rows = []
    for f in df.schema.fields:
        typed = isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))
        named = bool(_DATE_NAME.search(f.name))
        dated = f.name in texts and bool(re.search(DATE_VALUE, first[f.name] or ""))
        if typed or named or dated:
            rows.append((f.name, "type" if typed else ("name" if named else "values")))
    return df.sparkSession.createDataFrame(rows, "column_name string, reason string")


_LAT = re.compile(r"^(lat|latitude)$|lat", re.I)
_LON = re.compile(r"^(lon|lng|long|longitude)$|lon|lng", re.I)


def geo_columns(df: DataFrame) -> DataFrame:
    """Latitude / longitude candidates by name, confirmed by range (+-90 / +-180)."""
    nums = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    cands = [(x, "lat") for x in nums if _LAT.search(x)] + [(x, "lon") for x in nums if _LON.search(x) and not _LAT.search(x)]
    rows = []
    if cands:
        r = df.agg(*[F.min(c(x)).alias(f"{x}__a") for x, _ in cands], *[F.max(c(x)).alias(f"{x}__b") for x, _ in cands]).first()
        for x, kind in cands:
            lim = 90 if kind == "lat" else 180
            lo, hi = r[f"{x}__a"], r[f"{x}__b"]
            rows.append((x, kind, lo is not None and lo >= -lim and hi <= lim))
    return df.sparkSession.createDataFrame(rows, "column_name string, kind string, in_range boolean")


def normalise_types(df: DataFrame) -> DataFrame:
    """Extension types to plain ones: integers -> bigint, floats -> double, booleans kept, text kept (nulls kept)."""
    casts = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            casts[f.name] = c(f.name).cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            casts[f.name] = c(f.name).cast("double")
    return df.withColumns(casts)
