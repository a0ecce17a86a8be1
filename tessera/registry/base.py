"""Registry plumbing: each query is a Spark callable plus (optionally) a DuckDB
SQL twin over the same parquet tables.  Doubles are rounded in both engines so
last-bit differences from summation order do not matter."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEC = 6
# Decimal data puts many exact results on rounding ties (x.xxxxxx5) where the
# two engines may land one ulp apart.  Adding 1e-4 of a rounding unit (away
# from zero) before rounding moves the boundary off the decimal ties, with the
# same floating-point operations in both engines.
NUDGE_UNITS = 1e-4


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise KeyError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, fn, sql)
        return fn
    return deco


def tbl(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    from tessera.session import ship_package
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fin(df: DataFrame, d: int = DEC, overrides: dict[str, int] | None = None) -> DataFrame:
    """Round every double column (and turn -0.0 into 0.0); ``overrides`` sets decimals per column."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            scale = float(10.0 ** (overrides or {}).get(f.name, d))
            sc = F.col(f"`{f.name}`").cast("double") * F.lit(scale)
            cols.append((F.round(sc + F.signum(sc) * F.lit(NUDGE_UNITS), 0) / scale + F.lit(0.0)).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def rsql(inner: str, cols: list[str], d: int = DEC, overrides: dict[str, int] | None = None) -> str:
    """Wrap SQL so the listed double columns are rounded like ``fin``."""
    if not cols:
        return inner

    def one(x):
        sc = float(10.0 ** (overrides or {}).get(x, d))
        return (f'round("{x}"::DOUBLE * {sc!r}::DOUBLE + sign("{x}"::DOUBLE * {sc!r}::DOUBLE)::DOUBLE * {NUDGE_UNITS}::DOUBLE)'
                f' / {sc!r}::DOUBLE + 0.0 AS "{x}"')
    rep = ", ".join(one(x) for x in cols)
    return f"SELECT * REPLACE ({rep}) FROM ({inner}) AS _q"


# ---- injected test cases (same expression in both engines) -------------------------
def orders_nulls(spark, sf):
    o = tbl(spark, sf, "orders")
    return o.withColumns({
        "o_totalprice": F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")),
        "o_orderpriority": F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")),
    })


ORDERS_NULLS = """(SELECT o_orderkey, o_custkey, o_orderstatus,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice, o_orderdate,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority FROM orders)"""


def orders_dups(spark, sf):
    o = tbl(spark, sf, "orders")
    return o.unionByName(o.where(F.col("o_orderkey") % 50 == 0))


ORDERS_DUPS = "(SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 50 = 0)"


def events_nulls(spark, sf):
    e = tbl(spark, sf, "events")
    mx = e.agg(F.max("event_id")).scalar()
    cond = (F.col("event_id") < 5) | (F.col("event_id") > mx - 5) | (F.col("event_id") % 13 == 0) | \
           (F.col("event_id") % 17 == 1)
    return e.withColumn("value", F.when(cond, F.lit(None)).otherwise(F.col("value")))


EVENTS_NULLS = """(SELECT event_id, ts, user_id, event_type,
  CASE WHEN event_id < 5 OR event_id > (SELECT max(event_id) FROM events) - 5
         OR event_id % 13 = 0 OR event_id % 17 = 1 THEN NULL ELSE value END AS value, props FROM events)"""


def events_outliers(spark, sf):
    e = tbl(spark, sf, "events")
    return e.withColumn("value", F.col("value") * F.when(F.col("event_id") % 97 == 0, 50).otherwise(1))


EVENTS_OUTLIERS = """(SELECT event_id, ts, user_id, event_type,
  value * CASE WHEN event_id % 97 = 0 THEN 50 ELSE 1 END AS value, props FROM events)"""
