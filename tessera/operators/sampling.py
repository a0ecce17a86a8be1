"""Sampling (SRC5, SMP1-4).  Exact-size samples order rows by a seeded hash and
keep those below an exact threshold; strata use the block row index of
``plans.ordered`` so a hot stratum is never one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.common import as_list, c
from tessera.plans import ordered as O


def _hash(df: DataFrame, key, seed: int):
    cols = [c(k) for k in as_list(key)] or [c(x) for x in df.columns]
    return F.xxhash64(F.lit(int(seed)), *cols)


def sample_frac(df: DataFrame, frac: float, seed: int = 42) -> DataFrame:
    return df.sample(withReplacement=False, fraction=float(frac), seed=seed)


def sample_n(df: DataFrame, n: int, seed: int = 42, key=None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows: the n smallest seeded hashes.

    The n-th smallest hash is found from counts of hash prefixes (65,536 at a
    time), so the sample is a filter whatever its size; of rows that tie on
    the whole hash, the first by their values complete it.
    """
    d = df.withColumn("__h", _hash(df, key, seed))
    below, last, need = F.lit(False), F.lit(True), int(n)
    for shift in (48, 32, 16, 0):
        prefix = F.shiftright("__h", shift) if shift == 48 else F.shiftright("__h", shift).bitwiseAND(0xFFFF)
        counts = d.where(last).groupBy(prefix.alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()
        upto = 0
        for r in counts:
            if upto + r["n"] > need:
                break
            upto += r["n"]
        else:
            return d.where(below | last).drop("__h")
        below, last, need = below | (last & (prefix < r["p"])), last & (prefix == r["p"]), need - upto
        if not need:
            return d.where(below).drop("__h")
    plain = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    tied = O.sorted_codes(d.where(last), plain, "__place").where(F.col("__place") < need).drop("__place")
    return d.where(below).unionByName(tied).drop("__h")


def sample_stratified(df: DataFrame, by, frac: float, key=None, seed: int = 42, **kw) -> DataFrame:
    """floor(count * frac) rows of every stratum (null stratum dropped; empty strata vanish)."""
    by = as_list(by)
    base = df
    for b in by:
        base = base.where(c(b).isNotNull())
    base = base.withColumn("__h", _hash(df, key, seed))
    counts = base.groupBy(*[c(b) for b in by]).agg(F.floor(F.count(F.lit(1)) * float(frac)).alias("__k"))
    idx = O.row_index(base, ["__h"], by, "__r", **kw)
    return idx.join(counts, by).where(F.col("__r") < F.col("__k")).drop("__h", "__r", "__k")


def sample_systematic(df: DataFrame, k: int, order_by, **kw) -> DataFrame:
    """Every k-th row from the first, by ``order_by``."""
    return O.row_index(df, order_by, None, "__r", **kw).where(F.col("__r") % k == 0).drop("__r")


def first_n(df: DataFrame, n: int, order_by) -> DataFrame:
    return df.orderBy(*[c(o) for o in as_list(order_by)]).limit(n)


def last_n(df: DataFrame, n: int, order_by) -> DataFrame:
    keys = as_list(order_by)
    return df.orderBy(*[c(o).desc() for o in keys]).limit(n)


def stratum_counts(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*[c(b) for b in by]).agg(F.count(F.lit(1)).alias("rows"))


def sample_chunks(df: DataFrame, fraction: float, seed: int = 42, chunk_rows: int = 10_000) -> DataFrame:
    """SRC5 workflow variant: keep whole chunks of ``chunk_rows`` consecutive file rows with probability
    ``fraction``.

    A chunk is (file, row position // chunk_rows) from the Parquet row index;
    the decision is a seeded hash of the chunk, so a chunk is kept or dropped
    as a unit and a re-run or retried task makes the same choice.
    """
    chunk = F.concat_ws(":", F.col("_metadata.file_path"),
                        F.floor(F.col("_metadata.row_index") / chunk_rows).cast("string"))
    keep = (F.abs(F.xxhash64(F.lit(int(seed)), chunk)) % 1_000_000) < int(round(fraction * 1_000_000))
    return df.where(keep)


def sample_on_load(df: DataFrame, n: int, seed: int = 42, key=None) -> DataFrame:
    """SRC5: an exact-size sample of ``n`` rows taken while loading (seeded hash order)."""
    return sample_n(df, n, seed, key)
