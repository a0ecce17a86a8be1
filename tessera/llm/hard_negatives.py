"""Hard-negative mining by exact integer scores of anchor and candidate tiles.

Candidates and anchors are dealt to the cells of a grid (candidate group x
anchor block), so a cell is bounded however many there are of either.  A cell
multiplies int64 tiles by Strassen's recursion (zero padding to even sizes,
exact integer sums) and keeps small heaps per anchor: the best of the same
label in a first pass, the best inside each positive's score window in a
second.  Heaps of all cells merge by rank, so no anchor meets all candidates
in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import keep, slots_for

#: Rows of a candidate group (bounds; in between the table is cut into GROUPS groups) and of an anchor block.
GROUP_ROWS = (2048, 32768)
GROUPS = 64
BLOCK_ROWS = 8192
#: Rows of one product of tiles, and the size below which Strassen's recursion multiplies directly.
TILE_ANCHORS, TILE_ROWS, LEAF = 256, 2048, 16


def _even(x: np.ndarray) -> np.ndarray:
    """``x`` with a zero row and column where its sizes are odd."""
    out = np.zeros((x.shape[0] + (x.shape[0] & 1), x.shape[1] + (x.shape[1] & 1)), x.dtype)
    out[:x.shape[0], :x.shape[1]] = x
    return out if out.shape != x.shape else x


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """The exact product of two integer matrices (int64, or Python integers in object arrays).

    Sizes that are not even are padded with zeros; below ``leaf`` in any
    direction the product is taken directly.  Callers see to it that no
    intermediate leaves the type's range (``fits_int64``).
    """
    m, k, n = a.shape[0], a.shape[1], b.shape[1]
    if min(m, k, n) <= leaf:
        return a @ b
    a, b = _even(a), _even(b)
    i, j, l = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :l], b[:j, l:], b[j:, :l], b[j:, l:]
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    out = np.empty((2 * i, 2 * l), p1.dtype)
    out[:i, :l] = p1 + p4 - p5 + p7
    out[:i, l:] = p3 + p5
    out[i:, :l] = p2 + p4
    out[i:, l:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def fits_int64(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> bool:
    """Whether every sum of ``strassen(a, b)`` stays inside 64 bits: each level at most doubles the
    entries of both factors and adds four products."""
    levels, size = 0, min(a.shape[0], a.shape[1], b.shape[1])
    while size > leaf:
        levels, size = levels + 1, (size + 1) // 2
    top = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    return top[0] * top[1] * a.shape[1] * 16 ** levels < 1 << 63


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of the rows of ``a`` with the rows of ``b``; past 64 bits exact Python integers."""
    if fits_int64(a, b):
        return strassen(a, np.ascontiguousarray(b.T))
    a, b = (np.array(x.tolist(), object).reshape(x.shape) for x in (a, b.T))
    return strassen(a, b)


def _rows(table: pa.Table, width: int):
    """(ids, labels, zero-padded vectors) of a table of rows sorted by label and id."""
    table = table.combine_chunks().sort_by([("label", "ascending"), ("vec_id", "ascending")])
    lists = table.column("v").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy().astype(np.int64)
    flat, sizes = lists.flatten().to_numpy(), np.diff(ends)
    v = np.zeros((len(table), width), np.int64)
    row = np.repeat(np.arange(len(table)), sizes)
    v[row, np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return table, table.column("vec_id").to_numpy(), table.column("label").to_numpy(), v


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(score) > 4 * k and score.dtype != object:
        least = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= least)
        return at[np.lexsort((ids[at], -score[at]))][:k]
    return np.array(sorted(range(len(score)), key=lambda i: (-int(score[i]), int(ids[i])))[:k], np.int64)


def _long(x) -> int:
    return int(min(max(int(x), -(1 << 63)), (1 << 63) - 1))


def _tiles(rows, anchors):
    """(places of an anchor tile, places of a candidate tile, scores) of a cell."""
    for a in range(0, len(anchors), TILE_ANCHORS):
        for c in range(0, len(rows), TILE_ROWS):
            yield a, c, scores(anchors[a:a + TILE_ANCHORS], rows[c:c + TILE_ROWS])


def _positives(width: int, k: int):
    """A cell's heap of each anchor: the k best rows of its label, without rows of its id."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            _, ids, labels, v = _rows(left, width)
            table, a_ids, a_labels, a_v = _rows(right, width)
            keys = table.column("anchor").to_numpy()
            for a, c, s in _tiles(v, a_v):
                tile_labels = labels[c:c + TILE_ROWS]
                for i, row in enumerate(s, a):
                    lo, hi = np.searchsorted(tile_labels, a_labels[i], "left"), np.searchsorted(tile_labels, a_labels[i], "right")
                    other = np.arange(lo, hi)[ids[c + lo:c + hi] != a_ids[i]]
                    for p in other[_best(row[other], ids[c + other], k)]:
                        out.append((int(keys[i]), int(a_ids[i]), _long(row[p]), int(ids[c + p])))
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4)],
                        names=["anchor", "anchor_id", "score", "vec_id"])
    return work


def _negatives(width: int, k: int, low: int, high: int):
    """A cell's heap of each anchor and positive: the k best rows of another label inside the positive's window
    low * positive <= 100 * negative <= high * positive."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if len(left) and len(right):
            _, ids, labels, v = _rows(left, width)
            table, _, a_labels, a_v = _rows(right, width)
            keys, positives = table.column("anchor").to_numpy(), table.column("positives").to_pylist()
            for a, c, s in _tiles(v, a_v):
                tile_labels = labels[c:c + TILE_ROWS]
                for i, row in enumerate(s, a):
                    lo, hi = np.searchsorted(tile_labels, a_labels[i], "left"), np.searchsorted(tile_labels, a_labels[i], "right")
                    other = np.concatenate((np.arange(lo), np.arange(hi, len(row))))
                    x = row[other]
                    for place, top in enumerate(positives[i]):
                        # the smallest and the largest whole score inside the window
                        least, most = -(-low * top // 100), high * top // 100
                        if least > most:
                            continue
                        least, most = (least, most) if x.dtype == object else (_long(least), _long(most))
                        inside = np.flatnonzero((x >= least) & (x <= most))
                        for p in other[inside[_best(x[inside], ids[c + other[inside]], k)]]:
                            out.append((int(keys[i]), place, _long(row[p]), int(ids[c + p])))
        return pa.table([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 4)],
                        names=["anchor", "place", "score", "vec_id"])
    return work


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
              scale: float = 256.0) -> DataFrame:
    """vec_id, label, v: rows that take part, each component x as floor(scale * x) in 64 bits."""
    v = F.col(f"`{vector_col}`")
    whole = v.isNotNull() & F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return df.where(whole).where(sound).select(
        F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{label_col}`").cast("long").alias("label"),
        F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v"))


def mine(df: DataFrame, anchors, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
         positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, group_rows: tuple[int, int] = GROUP_ROWS,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per anchor, positive and hard negative: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the id and label columns.  A row's score is
    its integer inner product with the anchor (``quantised``); higher scores
    come first, ties by smaller id.  An anchor's positives are its first
    ``positives`` rows of the same label with another id; a positive's
    negatives the first ``negatives`` rows of other labels whose score is
    ``low`` to ``high`` hundredths of the positive's.

    Rows with a null id, label or vector, or with a null, NaN or infinite
    component take no part.  Shorter vectors are padded with zeros (an empty
    vector scores 0 with every row).  Repeated rows are rows of their own; of
    equal anchor rows one is an anchor, and rows of one id with different
    labels or vectors are anchors each.  Components are saturated at 64 bits
    after scaling, sums are exact, and a score past 64 bits is returned as the
    nearest 64-bit number.  No anchors, or an empty table: empty result.
    """
    spark = df.sparkSession
    rows = quantised(df, id_col, vector_col, label_col)
    rows = keep(spark, rows.withColumn("row", F.monotonically_increasing_id()), "mining-rows")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = max(1, width or 0)
    own = rows.where(anchors).groupBy("vec_id", "label", "v").agg(F.min("row").alias("anchor"))
    own = keep(spark, own, "mining-anchors")
    groups = slots_for(n, min(max(-(-n // GROUPS), group_rows[0]), group_rows[1]))
    blocks = slots_for(own.count(), block_rows)

    # the grid: a candidate goes to one group and every block, an anchor to one block and every group
    spread = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    cells = rows.select("vec_id", "label", "v", spread("row", groups).alias("g"),
                        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")).groupBy("g", "b")

    def over_grid(side: DataFrame, work, schema: str) -> DataFrame:
        dealt = side.withColumn("b", spread("anchor", blocks)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return cells.cogroup(dealt.groupBy("g", "b")).applyInArrow(work, schema)

    heaps = over_grid(own, _positives(width, positives), "anchor long, anchor_id long, score long, vec_id long")
    first = Window.partitionBy("anchor").orderBy(F.desc("score"), "vec_id")
    tops = heaps.withColumn("place", F.row_number().over(first) - 1).where(F.col("place") < positives)
    tops = keep(spark, tops, "mining-positives")
    lists = tops.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "score"))), lambda s: s["score"]).alias("positives"))
    heaps = over_grid(own.join(lists, "anchor"), _negatives(width, negatives, low, high), "anchor long, place long, score long, vec_id long")
    inside = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    ranked = heaps.withColumn("rank", F.row_number().over(inside)).where(F.col("rank") <= negatives)
    named = tops.select("anchor", "place", "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return ranked.join(named, ["anchor", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
