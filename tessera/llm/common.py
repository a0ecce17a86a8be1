"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.registry.base import tbl
from tessera.session import scratch_path

#: ASCII white space: the separators of words (space, tab, LF, VT, FF, CR).
SPACE_CLASS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, with the session prepared for this library."""
    return tbl(spark, sf_dir, name)


def keep(spark: SparkSession, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: cuts the
    lineage with committed files that every executor (and a retry) can read."""
    path = scratch_path(spark, name)
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def private(name: str) -> str:
    """A column name that cannot clash with a caller's."""
    return f"__{name}_{uuid.uuid4().hex[:8]}"


def words_of(text: Column) -> Column:
    """The maximal runs of characters that are not ASCII white space (null text: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE_CLASS), "")


def slots_for(rows: int, per_slot: int, least: int = 1) -> int:
    """How many buckets hold ``rows`` at about ``per_slot`` each: grows with the input."""
    return max(least, -(-rows // per_slot))


def dense_rank_within(df: DataFrame, group: str, order: list[Column], salt: Column, buckets: int, out: str) -> DataFrame:
    """Number the rows of each ``group`` 0, 1, 2 ... without one task per group.

    Rows are ordered by (bucket, order): ``salt`` spreads the rows of a group
    over ``buckets`` buckets, a window numbers them inside (group, bucket), and
    the counts of the earlier buckets - one row per (group, bucket) - are added.
    """
    from pyspark.sql import Window

    b, n, base = private("bucket"), private("n"), private("base")
    df = df.withColumn(b, F.pmod(salt, F.lit(buckets)).cast("int"))
    counts = df.groupBy(group, b).agg(F.count(F.lit(1)).alias(n))
    before = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col(group).alias(f"{group}{b}"), F.col(b).alias(f"{b}c"),
                           F.coalesce(F.sum(n).over(before), F.lit(0)).alias(base))
    inside = Window.partitionBy(group, b).orderBy(*order)
    ranked = df.withColumn(n, F.row_number().over(inside) - 1)
    joined = ranked.join(counts, (F.col(group).eqNullSafe(F.col(f"{group}{b}"))) & (F.col(b) == F.col(f"{b}c")))
    return joined.withColumn(out, (F.col(n) + F.col(base)).cast("long")).drop(b, n, base, f"{group}{b}", f"{b}c")


def slices(batch, column: int, max_bytes: int = 8 << 20):
    """An Arrow batch in slices of at most ``max_bytes`` of the given text column (one row at least): bounds a worker's memory."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // max_bytes
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


Query = Callable[[SparkSession, str], DataFrame]
