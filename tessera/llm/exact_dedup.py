"""Exact deduplication by content sort.

Rows are range-partitioned by sampled splitters over a bounded content key
(the first characters and a 64-bit hash of the normalised text), every range
is sorted by content with Spark's external sort, and each row is compared in
full with its neighbour.  A content with more rows or bytes than one sort group
may hold is spread by row over several ranges, and the winners of those ranges
are merged by the SHA-256 of the text: no group sits in one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep

#: Characters of the text inside the range key: bounds the size of a splitter.
PREFIX = 64
#: Rows and bytes of one content that are sorted as one group.  On a table of more than MOST_HOT times as much a group
#: may hold 1 / MOST_HOT of it, so that never more than 2 * MOST_HOT contents (16 bytes each) are spread.
GROUP_ROWS = 512
GROUP_BYTES = 4 << 20
MOST_HOT = 100_000


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 normalise: Callable[[Column], Column] | None = None, keep_largest: bool = True) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised forms are identical (default: no
    change); null counts as empty.  The row with the largest id stays (or the
    smallest with ``keep_largest=False``); null ids rank below every other, so
    a null stays only where the whole group has no id.  Of repeated rows with
    the winning id exactly one is kept.  Empty table: empty result.  Other
    columns of the input are not read.
    """
    spark = df.sparkSession
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), (normalise(text) if normalise else text).alias("text"))
    src = src.withColumn("hash", F.xxhash64("text"))

    sizes = src.groupBy("hash").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("text").cast("long")).alias("bytes"))
    sizes = keep(spark, sizes, "exact-sizes")
    rows, size = sizes.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    parts = F.ceil(F.greatest(F.col("rows") / max(GROUP_ROWS, rows // MOST_HOT), F.col("bytes") / max(GROUP_BYTES, size // MOST_HOT)))
    hot = sizes.select("hash", parts.alias("parts")).where("parts > 1")
    src = src.join(F.broadcast(hot), "hash", "left")  # bounded: see MOST_HOT
    src = src.select("doc_id", "text", "hash", F.substring("text", 1, PREFIX).alias("prefix"), F.col("parts").isNotNull().alias("hot"),
                     F.when(F.col("parts").isNull(), F.lit(0)).otherwise(  # by row, so equal ids are spread, too
                         F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.col("parts"))).alias("part"))

    ranges = src.repartitionByRange("prefix", "hash", "part")
    first_id = F.col("doc_id").desc_nulls_last() if keep_largest else F.col("doc_id").asc_nulls_last()
    by_content = Window.partitionBy("prefix", "hash", "part").orderBy("text", first_id)
    rows = ranges.withColumn("starts", ~F.coalesce(F.lag("text").over(by_content) == F.col("text"), F.lit(False)))
    rows = rows.withColumn("run", F.sum(F.col("starts").cast("int")).over(
        by_content.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("sha", F.unhex(F.sha2("text", 256))).drop("text")
    in_run = Window.partitionBy("prefix", "hash", "part", "run")
    best = F.max("doc_id") if keep_largest else F.min("doc_id")
    rows = rows.select("doc_id", "sha", "hot", "part", "starts", best.over(in_run).alias("best"),
                       F.count(F.lit(1)).over(in_run).alias("size"))
    rows = keep(spark, rows, "exact-runs")

    # of the parts whose winner has the winning id, one keeps it
    place = F.struct("best", "part") if keep_largest else F.struct(F.col("best").isNull().alias("none"), "best", "part")
    merged = (rows.where("hot and starts").groupBy("sha")
              .agg((F.max if keep_largest else F.min)(place).alias("first"), F.sum("size").alias("all_size")))
    merged = merged.select("sha", "all_size", F.col("first.best").alias("all_best"), F.col("first.part").alias("all_part"))
    rows = rows.join(F.broadcast(merged), "sha", "left")  # one row per hot content: bounded as above
    rows = rows.withColumn("win", F.when(F.col("all_size").isNull(), F.col("best")).otherwise(F.col("all_best")))
    rows = rows.withColumn("kept", F.col("starts") & F.col("doc_id").eqNullSafe(F.col("win"))
                           & (F.col("all_size").isNull() | (F.col("part") == F.col("all_part"))))
    return rows.select("doc_id", F.col("win").alias("keep_id"),
                       F.coalesce("all_size", "size").cast("long").alias("group_size"),
                       "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``df`` with one row per content, all columns unchanged (ids and ties as in ``exact_groups``).

    Contents are compared as ``exact_groups`` does (null as empty, normalised):
    of rows with the winning id and equal normalised content one stays.
    """
    groups = exact_groups(df, id_col, text_col, **options)
    won = groups.where("kept").select(F.col("doc_id").alias("__win_id"), F.unhex("text_sha256").alias("__win_sha"))
    normalise = options.get("normalise")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.withColumn("__own_sha", F.unhex(F.sha2(normalise(text) if normalise else text, 256)))
    kept = rows.join(won, F.col(f"`{id_col}`").eqNullSafe(F.col("__win_id")) & (F.col("__own_sha") == F.col("__win_sha")), "left_semi")
    if not groups.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        kept = kept.dropDuplicates([id_col, "__own_sha"])  # repeated rows with the winning id and content
    return kept.drop("__own_sha")
