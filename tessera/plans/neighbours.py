"""Exact k nearest neighbours without comparing all pairs.

1. Splitters of a bounded sample cut the space into cells of about
   ``CELL_POINTS`` points (a k-d tree: dense regions get more cells; cells with
   fewer than k points are merged with their neighbour).
2. A query searches its own cell, which bounds the distance of its k-th
   neighbour.
3. It then visits only the cells that the ball of that radius touches, and the
   finds merge by rank.

The driver holds the splitters (at most ``MOST_CELLS``) and one box and weight
per cell.  Cells with many visits are searched in several tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.session import written

#: Points of a cell, about (more on tables of more than MOST_CELLS cells of this size).
CELL_POINTS = 1024
MOST_CELLS = 16_384
#: Points of the sample for each cell.
SAMPLE_PER_CELL = 16
#: Queries that search one cell in one task, and the numbers of a block of distances.
VISITS_PER_TASK = 65_536
BLOCK = 1 << 20


# -- the cells ------------------------------------------------------------------------------------
class Cells:
    """A k-d tree: inner nodes split ``x[dim] < value``; leaves are numbered cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.dim, self.value, self.child, self.cell = [], [], [], []
        self._grow(sample, cells)
        self.box: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _node(self, dim=-1, value=0.0, child=(-1, -1)) -> int:
        self.dim.append(dim)
        self.value.append(value)
        self.child.append(child)
        self.cell.append(-1)
        return len(self.dim) - 1

    def _grow(self, x: np.ndarray, cells: int) -> int:
        me = self._node()
        cut = _cut(x) if cells > 1 else None
        if cut is None:
            return me
        self.dim[me], self.value[me] = cut
        low = x[:, cut[0]] < cut[1]
        left = min(cells - 1, max(1, round(cells * low.mean())))
        self.child[me] = (self._grow(x[low], left), self._grow(x[~low], cells - left))
        return me

    def number(self, weight: dict[int, int], least: int) -> None:
        """Number the leaves; a node whose leaves would hold less than ``least`` becomes a leaf itself."""
        total = {}
        for node in reversed(range(len(self.dim))):  # children come after their parent
            a, b = self.child[node]
            total[node] = weight.get(node, 0) if self.dim[node] < 0 else total[a] + total[b]
            if self.dim[node] >= 0 and min(total[a], total[b]) < least:
                self.dim[node] = -1
        self.cell = [-1] * len(self.dim)
        open_, n = [0], 0
        while open_:
            node = open_.pop()
            if self.dim[node] < 0:
                self.cell[node], n = n, n + 1
            else:
                open_ += self.child[node]

    def leaves_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf node of each point."""
        out, open_ = np.zeros(len(x), np.int64), [(0, np.arange(len(x)))]
        while open_:
            node, at = open_.pop()
            if self.dim[node] < 0 or not len(at):
                out[at] = node
                continue
            low = x[at, self.dim[node]] < self.value[node]
            open_ += [(self.child[node][0], at[low]), (self.child[node][1], at[~low])]
        return out

    def set_boxes(self, boxes: dict[int, tuple[np.ndarray, np.ndarray]]) -> None:
        """The box of every node from those of the cells' points (cells without points have none)."""
        for node in reversed(range(len(self.dim))):
            if self.cell[node] >= 0 and self.cell[node] in boxes:
                self.box[node] = boxes[self.cell[node]]
            elif self.dim[node] >= 0:
                own = [self.box[k] for k in self.child[node] if k in self.box]
                if own:
                    self.box[node] = (np.min([b[0] for b in own], axis=0), np.max([b[1] for b in own], axis=0))

    def touched(self, x: np.ndarray, r2: np.ndarray):
        """(cell, places of the queries whose ball touches its box)."""
        open_ = [(0, np.arange(len(x)))]
        while open_:
            node, at = open_.pop()
            if node not in self.box:
                continue
            low, high = self.box[node]
            gap = np.zeros(len(at))
            for j in range(x.shape[1]):  # the same sums as between points: never above a point's distance
                v = x[at, j]
                gap += np.maximum(np.maximum(low[j] - v, v - high[j]), 0.0) ** 2
            at = at[gap <= r2[at]]
            if not len(at):
                continue
            if self.dim[node] < 0:
                yield self.cell[node], at
            else:
                open_ += [(k, at) for k in self.child[node]]


def _cut(x: np.ndarray):
    """(dimension, value) that halves the points best in the widest dimension that splits them; None if all are equal."""
    if len(x) < 2:
        return None
    spread = x.max(axis=0) - x.min(axis=0)
    for j in np.argsort(-spread, kind="stable"):
        if spread[j] <= 0:
            return None
        v = np.sort(x[:, j])
        mid = v[len(v) // 2]
        return int(j), float(mid if mid > v[0] else v[v > v[0]][0])
    return None


# -- searching one cell ---------------------------------------------------------------------------
def _matrix(column) -> np.ndarray:
    """A list column of equally long lists as rows of numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def nearest(points: np.ndarray, weights: np.ndarray, queries: np.ndarray, r2: np.ndarray, k: int):
    """(query, point, squared distance) of the nearest points, ties by place, up to a weight of ``k`` within the radius."""
    out = []
    step = max(1, BLOCK // max(1, len(points)))
    for a in range(0, len(queries), step):
        q = queries[a:a + step]
        d2 = np.zeros((len(q), len(points)))
        for j in range(points.shape[1]):
            d2 += (q[:, j, None] - points[None, :, j]) ** 2
        most = r2[a:a + step].copy()
        if len(points) > k:
            most = np.minimum(most, np.partition(d2, k - 1, axis=1)[:, k - 1])
        row, col = np.nonzero(d2 <= most[:, None])
        found = d2[row, col]
        order = np.lexsort((col, found, row))
        row, col, found = row[order], col[order], found[order]
        w = weights[col]
        before = np.cumsum(w) - w
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        before -= np.repeat(before[starts], np.diff(np.append(starts, len(row))))
        near = before < k
        out.append((row[near] + a, col[near], found[near]))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]


def _search(k: int):
    """Visits of one cell (part): each query's nearest points there and the radius they bound."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        qid, cell = right.column("qid"), right.column("cell")
        left = left.sort_by("pid") if len(left) else left
        pid, weights = left.column("pid").to_numpy(), left.column("m").to_numpy()
        r2 = right.column("r2").to_numpy().copy()
        if len(left) and len(right):
            row, col, d2 = nearest(_matrix(left.column("p")), weights, _matrix(right.column("q")), r2, k)
        else:
            row, col, d2 = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        offsets = pa.array(np.searchsorted(row, np.arange(len(right) + 1)).astype(np.int32))
        total = np.bincount(row, weights=weights[col] if len(col) else None, minlength=len(right))
        full = np.flatnonzero(total >= k)
        r2[full] = d2[np.asarray(offsets)[full + 1] - 1]
        lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (pid[col], d2, weights[col])]
        return pa.table([qid, cell, right.column("q"), pa.array(r2), *lists], names=["qid", "cell", "q", "r2", "pid", "d2", "m"])
    return work


_FOUND = "qid long, cell int, q array<double>, r2 double, pid array<long>, d2 array<double>, m array<long>"


def _visit(points: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """Search ``visits`` (cell, qid, q, r2) among the points of their cells; cells with many visits in several parts."""
    load = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VISITS_PER_TASK).cast("int").alias("parts"))
    load = F.broadcast(load)  # one row per cell: at most MOST_CELLS
    visits = visits.join(load, "cell").withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).drop("parts")
    points = points.join(load, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return points.groupBy("cell", "part").cogroup(visits.groupBy("cell", "part")).applyInArrow(_search(k), _FOUND)


def _with_cell(df: DataFrame, column: str, cells: Cells, number: bool) -> DataFrame:
    """Adds the cell (or, before numbering, the leaf node) of each row's point."""
    place = df.columns.index(column)

    def work(batches):
        for b in batches:
            at = cells.leaves_of(_matrix(b.column(place)))
            at = np.array(cells.cell, np.int64)[at] if number else at
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32))], names=[*b.schema.names, "cell"])

    return df.mapInArrow(work, T.StructType([*df.schema.fields, T.StructField("cell", T.IntegerType())]))


# -- the join -------------------------------------------------------------------------------------
def distinct_points(rows: DataFrame, column: str, **sums) -> DataFrame:
    """pid, p, m (and further aggregates): the different points of ``column`` (an array of doubles without null),
    how many rows each has, numbered in the order of their coordinates.  Written once."""
    points = rows.groupBy(F.col(column).alias("p")).agg(F.count(F.lit(1)).alias("m"), *[e.alias(x) for x, e in sums.items()])
    return written(points.orderBy("p").withColumn("pid", F.monotonically_increasing_id()), "points")


def nearest_points(points: DataFrame, queries: DataFrame | None, k: int, cell_points: int = CELL_POINTS) -> DataFrame:
    """qid, pid, m, dist, before: every query's nearest points until they hold ``k`` rows.

    ``points`` (pid, p, m) come from ``distinct_points``; ``queries`` (qid, q)
    have different ids, None asks for the neighbours of the points themselves
    (each is its own first).  Points rank by distance, ties by their
    coordinates; ``before`` is how many rows the nearer points have.  Fewer
    than ``k`` rows in all: all of them.  No points or no queries: empty.
    """
    points = points.select("pid", "p", "m")
    queries = points.select(F.col("pid").alias("qid"), F.col("p").alias("q")) if queries is None else queries
    n, dims = points.agg(F.count(F.lit(1)), F.max(F.size("p"))).first()
    cells = max(1, min(MOST_CELLS, -(-n // cell_points)))
    share = min(1.0, cells * SAMPLE_PER_CELL / max(1, n))
    sample = points.where(F.pmod(F.xxhash64("p"), F.lit(1 << 30)) < int(share * (1 << 30))).select("p").toArrow() if cells > 1 else None
    x = _matrix(sample.column(0)) if sample is not None else np.zeros((0, 0))  # about MOST_CELLS * SAMPLE_PER_CELL points at most
    tree = Cells(x, cells)
    leaves = _with_cell(points, "p", tree, False) if cells > 1 else points.withColumn("cell", F.lit(0))
    tree.number({r["cell"]: r["w"] for r in leaves.groupBy("cell").agg(F.sum("m").alias("w")).collect()}, k)  # one row per leaf

    points = written(_with_cell(points, "p", tree, True), "cells")
    corners = [f(F.element_at("p", j + 1)).alias(f"{name}{j}") for name, f in (("lo", F.min), ("hi", F.max)) for j in range(dims or 0)]
    boxes = points.groupBy("cell").agg(F.count(F.lit(1)), *corners).collect()  # one row per cell
    tree.set_boxes({r[0]: (np.array(r[2:2 + dims], float), np.array(r[2 + dims:], float)) for r in boxes})

    own = _with_cell(queries.select("qid", "q"), "q", tree, True).withColumn("r2", F.lit(float("inf")))
    found = written(_visit(points, own, k), "neighbours")
    schema = T.StructType([T.StructField("cell", T.IntegerType()), *(found.schema[c] for c in ("qid", "q", "r2"))])

    def balls(batches):
        for b in batches:
            q, own_cell, r2 = _matrix(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy()
            for cell, at in tree.touched(q, r2):
                at = at[own_cell[at] != cell]
                if len(at):
                    rows = pa.array(at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), cell, np.int32)), *(b.column(j).take(rows) for j in (0, 1, 3))],
                                                     names=["cell", "qid", "q", "r2"])

    visits = written(found.select("qid", "q", "cell", "r2").mapInArrow(balls, schema), "visits")
    more = _visit(points, visits, k)
    lists = found.select("qid", "pid", "d2", "m").unionByName(more.select("qid", "pid", "d2", "m"))
    rows = lists.select("qid", F.explode(F.arrays_zip("d2", "pid", "m")).alias("x")).select("qid", "x.d2", "x.pid", "x.m")
    nearer = Window.partitionBy("qid").orderBy("d2", "pid").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("m").over(nearer), F.lit(0)))
    return rows.where(F.col("before") < k).select("qid", "pid", "m", F.sqrt("d2").alias("dist"), "before")
