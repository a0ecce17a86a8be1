"""Clustering, anomaly flags and model-based imputation (FEA6-9, CLN9).

k-means and the divisive hierarchy use ``pyspark.ml``; the isolation forest
grows one tree per task and scores every row in Arrow batches; neighbours of
the local outlier factor and of imputation come from an exact spatial join.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.common import MAX_CATEGORIES, as_list, bounded_rows, c, with_nulls
from tessera.operators.features import standardized
from tessera.session import written


def _vectors(df: DataFrame, cols: Sequence[str]):
    from pyspark.ml.feature import VectorAssembler
    d, z = standardized(df, list(cols))
    return VectorAssembler(inputCols=z, outputCol="__vec").transform(d), z


def cluster(df: DataFrame, cols: Sequence[str], algorithm: str = "kmeans", k: int = 3, seed: int = 42,
            out: str | None = None, **params) -> DataFrame:
    """kmeans | hierarchical (divisive, BisectingKMeans) | dbscan labels on standardised columns."""
    out = out or f"{algorithm}_cluster"
    if algorithm == "dbscan":
        return dbscan(df, cols, params.get("eps", 0.5), params.get("min_samples", 5), out)
    from pyspark.ml.clustering import BisectingKMeans, KMeans
    if algorithm == "kmeans":
        v, z = _vectors(df, cols)
    else:
        # BisectingKMeans splits a cluster by scaling its centre by (1 +/- noise); a centre at the
        # origin (standardised data) cannot split, so the data is translated (distances unchanged)
        from pyspark.ml.feature import VectorAssembler
        d0, z = standardized(df, list(cols))
        d0 = d0.withColumns({x: F.col(x) + 10.0 for x in z})
        v = VectorAssembler(inputCols=z, outputCol="__vec").transform(d0)
    est = (KMeans(k=k, seed=seed, featuresCol="__vec", predictionCol=out) if algorithm == "kmeans"
           else BisectingKMeans(k=k, seed=seed, featuresCol="__vec", predictionCol=out))
    model = est.fit(v)
    return model.transform(v).drop("__vec", *z)


# -- isolation forest ---------------------------------------------------------------------------
def _c_factor(n: float) -> float:
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + 0.5772156649015329) - 2.0 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int):
    """Array-encoded isolation tree: (feature, threshold, left, right, size) per node."""
    nodes = []

    def build(idx, depth):
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, len(idx)])
        if depth >= limit or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.where(hi > lo)[0]
        if len(cand) == 0:
            return me
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        left = idx[sub[:, f] < t]
        right = idx[sub[:, f] >= t]
        nodes[me][0], nodes[me][1] = f, t
        nodes[me][2] = build(left, depth + 1)
        nodes[me][3] = build(right, depth + 1)
        return me
    build(np.arange(len(x)), 0)
    return np.array(nodes, dtype="float64")


def _path_lengths(tree: np.ndarray, x: np.ndarray) -> np.ndarray:
    node = np.zeros(len(x), dtype=np.int64)
    depth = np.zeros(len(x))
    active = np.ones(len(x), dtype=bool)
    while active.any():
        f = tree[node, 0].astype(np.int64)
        leaf = f < 0
        done = active & leaf
        if done.any():
            sizes = tree[node[done], 4]
            depth[done] += np.array([_c_factor(s) for s in sizes])
            active &= ~leaf
        if not active.any():
            break
        idx = np.where(active)[0]
        go_left = x[idx, f[idx]] < tree[node[idx], 1]
        node[idx] = np.where(go_left, tree[node[idx], 2], tree[node[idx], 3]).astype(np.int64)
        depth[idx] += 1
    return depth


def _forest(d: DataFrame, z: Sequence[str], identity: Sequence, trees: int, sample_size: int, seed: int) -> list[np.ndarray]:
    """Trees grown one per task, each on the ``sample_size`` rows with the smallest hash of (tree, identity).

    Candidates are the rows whose own hash is below a threshold (about twice
    what all trees need, or every row of a small table), so the samples are
    the same however the rows lie in partitions.
    """
    n = d.count()
    share = min(1.0, 2.0 * trees * sample_size / max(1, n))
    pool = d.withColumn("__h", F.xxhash64(F.lit(seed), *identity))
    pool = pool.where(F.pmod("__h", F.lit(1 << 30)) < math.ceil(share * (1 << 30))).select("__h", *z)
    pool = written(pool, "forest-pool")  # at most about 2 * trees * sample_size rows
    drawn = pool.withColumn("__tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("__t", F.xxhash64("__tree", "__h"))
    first = Window.partitionBy("__tree").orderBy("__t", *z)
    drawn = drawn.withColumn("__place", F.row_number().over(first)).where(F.col("__place") <= sample_size)
    limit = int(math.ceil(math.log2(max(min(sample_size, n), 2))))

    def grow(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("__place")
        x = np.column_stack([table.column(name).to_numpy() for name in z])
        tree = _grow(x, np.random.default_rng([seed, key[0].as_py()]), limit)
        return pa.table({"__tree": pa.array([key[0].as_py()], pa.int32()), "nodes": pa.array([tree.ravel().tolist()], pa.list_(pa.float64()))})

    grown = drawn.groupBy("__tree").applyInArrow(grow, "__tree int, nodes array<double>").orderBy("__tree").collect()
    return [np.array(r["nodes"]).reshape(-1, 5) for r in grown]  # trees * 2 * sample_size nodes at most


def isolation_forest(df: DataFrame, cols: Sequence[str], trees: int = 100, sample_size: int = 256, seed: int = 42,
                     key=None, out: str = "anomaly") -> DataFrame:
    """Adds ``{out}_score`` (2^(-E[h]/c(psi))) and ``out`` = 1 when the score exceeds 0.5, else 0.

    Each tree draws its own ``sample_size`` rows by a hash of the row's ``key``
    (without key: of its values and its number among equal rows), so the same
    rows train it at any partitioning.  Missing values count as the mean; an
    empty table gives no rows.
    """
    cols = list(cols)
    d, z = standardized(df, cols)
    if key is None:
        raw = [f"__v{i}" for i in range(len(cols))]
        same = d.groupBy(*[c(x).alias(v) for x, v in zip(cols, raw)], *z).agg(F.count(F.lit(1)).alias("__n"))
        rows = same.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n"))))
        identity = [*raw, "__copy"]
    else:
        rows, identity = d, [c(k) for k in as_list(key)]
    forest = _forest(rows, z, identity, trees, sample_size, seed)
    psi = int(forest[0][0, 4]) if forest else 0
    cn = _c_factor(psi)
    bc = df.sparkSession.sparkContext.broadcast(forest)  # bounded by trees * sample_size
    schema = T.StructType(d.schema.fields + [T.StructField(f"{out}_score", T.DoubleType()),
                                             T.StructField(out, T.IntegerType())])
    zcols = list(z)

    def score(it):
        trees_ = bc.value
        for pdf in it:
            x = pdf[zcols].to_numpy(dtype="float64")
            h = np.mean([_path_lengths(t, x) for t in trees_], axis=0) if len(x) else np.array([])
            s = np.power(2.0, -h / cn) if cn > 0 else np.zeros(len(x))
            pdf[f"{out}_score"] = s
            pdf[out] = (s > 0.5).astype("int32")
            yield pdf

    return d.mapInPandas(score, schema).drop(*z)


# -- DBSCAN -------------------------------------------------------------------------------------
#: From this many parts of a cell's side on, every point is a box: doubles tell no smaller parts apart.
_FINEST = 1 << 40


def _dense_links(points: DataFrame, gcols: list[str], zc: list[str], side: float, eps: float, offsets) -> DataFrame:
    """(u, v): pairs of neighbouring cells that hold a point each within ``eps`` of the other.

    A search for a close pair that goes down both cells at once.  A box is the
    bounding box of a part of a cell's points and one of them; a pair of boxes
    farther apart than ``eps`` is dropped, and a pair of cells is linked by
    two points or two whole boxes within ``eps``.  What is left undecided is
    halved on every axis, with the points of undecided boxes only, until
    nothing is left; boxes of equal points decide themselves.
    """
    reach, parts = eps * eps, len(zc)
    up = [f"__p{i}" for i in range(parts)]
    at = [f"__f{i}" for i in range(parts)]
    links, undecided, level = [], None, 1
    live = points.select(*gcols, *zc)
    while True:
        cell = live.select("*", *[F.floor((F.col(z) / side - F.col(g)) * level).cast("long").alias(f)
                                  for z, g, f in zip(zc, gcols, at)])
        boxes = cell.groupBy(*gcols, *at, *(zc if level >= _FINEST else [])).agg(*[F.min(z).alias(f"lo{z}") for z in zc], *[F.max(z).alias(f"hi{z}") for z in zc],
                                              F.min(F.struct(*zc)).alias("one"))
        boxes = written(boxes.select("*", *[F.shiftright(f, 1).alias(p) for f, p in zip(at, up)]), "dbscan-boxes")
        left, right = (boxes.select(*[F.col(x).alias(side_ + x) for x in boxes.columns]) for side_ in ("a", "b"))
        if undecided is None:
            left = left.withColumn("__o", F.explode(offsets))
            near = [F.col(f"a{g}") + F.col("__o")[i] == F.col(f"b{g}") for i, g in enumerate(gcols)]
            first = F.struct(*[F.col(f"a{g}") for g in gcols]) < F.struct(*[F.col(f"b{g}") for g in gcols])
            pairs = left.join(right, near).where(first)
        else:
            pairs = undecided.join(left, [f"a{x}" for x in gcols + up]).join(right, [f"b{x}" for x in gcols + up])
        apart, across, found = F.lit(0.0), F.lit(0.0), F.lit(0.0)
        for z in zc:
            lo_a, hi_a, lo_b, hi_b = (F.col(x + z) for x in ("alo", "ahi", "blo", "bhi"))
            apart = apart + F.greatest(lo_b - hi_a, lo_a - hi_b, F.lit(0.0)) ** 2
            across = across + F.greatest(hi_b - lo_a, hi_a - lo_b) ** 2
            found = found + (F.col("aone")[z] - F.col("bone")[z]) ** 2
        cells = [f"a{g}" for g in gcols] + [f"b{g}" for g in gcols]
        pairs = written(pairs.where(apart <= reach).select(*cells, *[f"a{f}" for f in at], *[f"b{f}" for f in at],
                                                           ((across <= reach) | (found <= reach)).alias("sure")), "dbscan-frontier")
        linked = pairs.where("sure").select(*cells).distinct()
        links.append(linked)
        undecided = written(pairs.where("not sure").join(linked, cells, "left_anti").select(
            *cells, *[F.col(s_ + f).alias(s_ + p) for s_ in ("a", "b") for f, p in zip(at, up)]), "dbscan-undecided")
        if undecided.isEmpty():
            break
        open_boxes = undecided.select(*[F.col(f"a{x}").alias(x) for x in gcols + up]).union(
            undecided.select(*[F.col(f"b{x}").alias(x) for x in gcols + up])).distinct()
        inside = cell.select(*gcols, *zc, *[F.col(f).alias(p) for f, p in zip(at, up)])
        live = written(inside.join(open_boxes, gcols + up, "left_semi").select(*gcols, *zc).distinct(), "dbscan-live")
        level *= 2
    return reduce(DataFrame.union, links).select(F.struct(*[F.col(f"a{g}").alias(g) for g in gcols]).alias("u"),
                                                 F.struct(*[F.col(f"b{g}").alias(g) for g in gcols]).alias("v"))


def dbscan(df: DataFrame, cols: Sequence[str], eps: float = 0.5, min_samples: int = 5, out: str = "dbscan_cluster",
           key: str | None = None) -> DataFrame:
    """DBSCAN on standardised columns (label -1 = noise), grid based, without all-pairs in dense regions.

    Cells have side eps / sqrt(d), so points sharing a cell are neighbours:
    a cell with >= ``min_samples`` points makes all of them core with no pair
    work.  Neighbour counts are enumerated only for points of *sparse* cells
    (fewer than ``min_samples`` points), which bounds the pairs by
    ``min_samples x (neighbour cells) x n``.  Core cells are graph nodes; two
    neighbouring core cells are linked when some core pair is within eps:
    enumerated when one side is sparse, found by ``_dense_links`` when both
    are dense.  Components come from min-label propagation over the cell
    graph (checkpointed) until a round changes nothing; border points take the
    smallest adjacent core label; clusters are numbered by their smallest
    point key.  Without ``key`` the rows are written with a row number first,
    so a lost executor cannot renumber them.  Supports up to 4 dimensions.
    """
    import itertools
    import math as _m

    cols = list(cols)
    d_ = len(cols)
    if d_ > 4:
        raise ValueError("dbscan grid search supports up to 4 dimensions")
    d, z = standardized(df, cols)
    if key is None:
        d = written(d.withColumn("__id", F.monotonically_increasing_id()), "dbscan-rows")
        key = "__id"
    side = eps / _m.sqrt(d_)
    reach = int(_m.ceil(_m.sqrt(d_))) + 1
    offs = [o for o in itertools.product(range(-reach, reach + 1), repeat=d_)
            if sum(max(abs(v) - 1, 0) ** 2 for v in o) * side * side <= eps * eps]
    gcols = [f"__g{i}" for i in range(d_)]
    pts = d.select(F.col(key).alias("__pid"), *[F.col(x).alias(f"__z{i}") for i, x in enumerate(z)],
                   *[F.floor(F.col(x) / side).cast("long").alias(g) for x, g in zip(z, gcols)])
    zc = [f"__z{i}" for i in range(d_)]
    cnt = pts.groupBy(*gcols).agg(F.count(F.lit(1)).alias("__cnt"))
    pts = pts.join(cnt, gcols)
    off_arr = F.array(*[F.array(*[F.lit(v) for v in o]) for o in offs])

    def neighbours(left, right, lname, rname):
        """Pairs (left point, right point) in offset cells with distance <= eps."""
        ex = left.select(F.col("__pid").alias(lname), *[F.col(c_).alias(f"{lname}{c_}") for c_ in zc],
                         *[F.col(g).alias(f"{lname}{g}") for g in gcols], F.explode(off_arr).alias("__o"))
        ex = ex.select("*", *[(F.col(f"{lname}{g}") + F.col("__o")[i]).alias(g) for i, g in enumerate(gcols)])
        r = right.select(F.col("__pid").alias(rname), *[F.col(c_).alias(f"{rname}{c_}") for c_ in zc], *gcols)
        j = ex.join(r, gcols)
        dist2 = sum(((F.col(f"{lname}{c_}") - F.col(f"{rname}{c_}")) ** 2 for c_ in zc), F.lit(0.0))
        return j.where(dist2 <= eps * eps)

    sparse = pts.where(F.col("__cnt") < min_samples)
    sp_pairs = written(neighbours(sparse, pts, "a", "b").select(
        "a", "b", *[F.col(f"a{g}").alias(f"ca{i}") for i, g in enumerate(gcols)],
        *[F.col(g).alias(f"cb{i}") for i, g in enumerate(gcols)]), "dbscan-pairs")
    sp_core = sp_pairs.groupBy("a").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= min_samples) \
        .select(F.col("a").alias("__pid"))
    core = pts.where(F.col("__cnt") >= min_samples).select("__pid").unionByName(sp_core)
    core_pts = pts.join(core, "__pid", "left_semi")
    cell_id = F.struct(*[F.col(g) for g in gcols])
    core_cells = core_pts.select(*gcols, "__cnt").distinct()

    # edges from pairs with at least one sparse side (core-core only)
    core_ids = core.select(F.col("__pid").alias("__c"))
    e1 = sp_pairs.join(core_ids.withColumnRenamed("__c", "a"), "a", "left_semi") \
        .join(core_ids.withColumnRenamed("__c", "b"), "b", "left_semi") \
        .select(F.struct(*[F.col(f"ca{i}").alias(g) for i, g in enumerate(gcols)]).alias("u"),
                F.struct(*[F.col(f"cb{i}").alias(g) for i, g in enumerate(gcols)]).alias("v"))
    e2 = _dense_links(pts.where(F.col("__cnt") >= min_samples).select(*gcols, *zc), gcols, zc, side, eps, off_arr)
    edges = e1.unionByName(e2).where(F.col("u") != F.col("v")).distinct()
    edges = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))

    from tessera.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    labels = core_cells.select(cell_id.alias("u"), cell_id.alias("__lab")).checkpoint()
    edges = edges.checkpoint()
    while True:
        prop = edges.join(labels.withColumnRenamed("u", "v").withColumnRenamed("__lab", "__vl"), "v") \
            .groupBy("u").agg(F.min("__vl").alias("__m"))
        new = labels.join(prop, "u", "left").select("u", F.least("__lab", F.coalesce("__m", "__lab")).alias("__lab"))
        # pointer jumping: a node takes its label's label, halving label chains each round
        jump = new.select(F.col("u").alias("__lab"), F.col("__lab").alias("__ll"))
        new = new.join(jump, "__lab", "left").select("u", F.least("__lab", F.coalesce("__ll", "__lab")).alias("__lab"))
        new = new.checkpoint()
        changed = new.join(labels.withColumnRenamed("__lab", "__old"), "u").where(F.col("__lab") != F.col("__old")).count()
        labels = new
        if changed == 0:
            break
    core_lab = core_pts.select("__pid", cell_id.alias("u")).join(labels, "u").select("__pid", "__lab")
    border = sp_pairs.join(core_lab.withColumnRenamed("__pid", "b").withColumnRenamed("__lab", "__bl"), "b") \
        .groupBy(F.col("a").alias("__pid")).agg(F.min("__bl").alias("__bl"))
    lab = pts.select("__pid").join(core_lab, "__pid", "left").join(border, "__pid", "left") \
        .select("__pid", F.coalesce("__lab", "__bl").alias("__raw"))
    firsts = lab.where(F.col("__raw").isNotNull()).groupBy("__raw").agg(F.min("__pid").alias("__first"))
    try:  # numeric point keys: block row index
        from tessera.plans.ordered import row_index
        ids = row_index(firsts, ["__first"], None, "__cl")
    except TypeError:
        from tessera.plans.ordered import sorted_codes
        ids = sorted_codes(firsts, ["__first"], "__cl")
    lab = lab.join(ids.select("__raw", "__cl"), "__raw", "left").select(
        "__pid", F.coalesce(F.col("__cl").cast("int"), F.lit(-1)).alias(out))
    res = d.join(lab, d[key] == lab["__pid"], "left").drop("__pid", *z)
    res = res.drop("__id") if key == "__id" else res
    return res


# -- FEA10 --------------------------------------------------------------------------------------
def local_outlier_factor(df: DataFrame, cols: Sequence[str], neighbours: int = 20, out: str = "anomaly_score",
                         scaled: bool = True, cell_points: int | None = None) -> DataFrame:
    """Adds the local outlier factor of each row on standardised columns (missing values count as 0 beforehand).

    Densities are those of the table (a row is no neighbour of itself); the
    factor compares a row, scored like a new one, with its ``neighbours``
    nearest rows, itself included.  Rows at equal distance rank by their
    coordinates, so rows with equal values get equal factors whatever the
    partitioning.  ``scaled``: min-max scaled to 0..1 (all equal: factor - 1.5).
    A table of one row has no factor (null).
    Neighbours come from an exact spatial join (``plans.neighbours``).
    """
    from tessera.plans import neighbours as N

    cols = list(cols)
    filled = with_nulls(df).withColumns({f"__f{i}": F.coalesce(c(x).cast("double"), F.lit(0.0)) for i, x in enumerate(cols)})
    d, z = standardized(filled, [f"__f{i}" for i in range(len(cols))])
    point = F.array(*[F.col(x) + 0.0 for x in z])
    points = N.distinct_points(d.select(point.alias("p")), "p")
    rows = points.agg(F.sum("m")).first()[0] or 0
    k = max(1, min(neighbours, rows - 1))
    near = written(N.nearest_points(points, None, k + 1, cell_points or N.CELL_POINTS), "lof")

    # a point is its own first neighbour: without it the others move up by one row
    is_self = F.col("qid") == F.col("pid")
    others = F.greatest(F.least(F.when(is_self, F.col("m") - 1).otherwise(F.col("m")),
                                F.when(is_self, F.lit(k)).otherwise(k + 1 - F.col("before"))), F.lit(0))
    near = near.withColumns({"__ex": others, "__in": F.greatest(F.least(F.col("m"), k - F.col("before")), F.lit(0))})
    reach = near.groupBy(F.col("qid").alias("pid")).agg(F.max(F.when(F.col("__ex") > 0, F.col("dist"))).alias("__kd"))
    near = near.join(reach, "pid").withColumn("__r", F.greatest("dist", F.coalesce("__kd", F.lit(0.0))))

    def density(w):
        return F.lit(1.0) / (F.try_divide(F.sum(F.col(w) * F.col("__r")), F.sum(w)) + 1e-10)
    own = written(near.groupBy("qid").agg(density("__ex").alias("__lrd"), density("__in").alias("__new")), "densities")
    lrd = own.select(F.col("qid").alias("pid"), "__lrd")
    lof = near.join(lrd, "pid").groupBy("qid").agg((F.sum(F.col("__in") * F.col("__lrd")) / F.sum("__in")).alias("__mean"))
    lof = lof.join(own, "qid").join(points.select(F.col("pid").alias("qid"), F.col("p").alias("__p")), "qid")
    lof = written(lof.select("__p", (F.col("__mean") / F.col("__new")).alias("__lof")), "factors")
    value = F.col("__lof")
    if scaled:
        low, high = lof.agg(F.min("__lof"), F.max("__lof")).first()
        value = (value - low) / (high - low) if low is not None and high > low else value - 1.5
    res = d.withColumn("__q", point).join(lof, F.col("__q") == F.col("__p"), "left").withColumn(out, value)
    return res.drop("__q", "__p", "__lof", *z, *[f"__f{i}" for i in range(len(cols))])


# -- CLN9 ---------------------------------------------------------------------------------------
def fill_model(df: DataFrame, target: str, predictors: Sequence[str], model: str = "linear", seed: int = 42,
               out: str | None = None) -> DataFrame:
    """Impute nulls of ``target`` with a model trained on rows where it is known.

    linear | tree (depth 5) | forest (100 trees, depth 5) | neighbours (the mean
    of the 5 nearest, ``fill_neighbours``); string predictors are one-hot
    encoded (first level dropped), numeric predictor nulls count as 0.
    """
    if model == "neighbours":
        return fill_neighbours(df, target, predictors, out=out)
    df = with_nulls(df)
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
    from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression, RandomForestRegressor

    out = out or target
    num = [p for p in predictors if isinstance(df.schema[p].dataType, T.NumericType)]
    cat = [p for p in predictors if p not in num]
    d = df.withColumns({f"__n_{p}": F.coalesce(c(p).cast("double"), F.lit(0.0)) for p in num})
    stages = []
    for p in cat:
        stages.append(StringIndexer(inputCol=p, outputCol=f"__i_{p}", handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCol=f"__i_{p}", outputCol=f"__o_{p}", dropLast=True))
    stages.append(VectorAssembler(inputCols=[f"__n_{p}" for p in num] + [f"__o_{p}" for p in cat], outputCol="__f"))
    label = c(target).cast("double")
    d = d.withColumn("__y", label)
    reg = {"linear": LinearRegression(featuresCol="__f", labelCol="__y", predictionCol="__pred"),
           "tree": DecisionTreeRegressor(featuresCol="__f", labelCol="__y", predictionCol="__pred", maxDepth=5, seed=seed),
           "forest": RandomForestRegressor(featuresCol="__f", labelCol="__y", predictionCol="__pred", numTrees=100,
                                           maxDepth=5, seed=seed)}[model]
    fitted = Pipeline(stages=stages + [reg]).fit(d.where(F.col("__y").isNotNull()))
    scored = fitted.transform(d)
    res = scored.withColumn(out, F.coalesce(F.col("__y"), F.col("__pred")))
    drop = [x for x in res.columns if x.startswith("__")]
    return res.drop(*drop)


def fill_neighbours(df: DataFrame, target: str, predictors: Sequence[str], neighbours: int = 5, out: str | None = None,
                    cell_points: int | None = None) -> DataFrame:
    """Impute nulls of ``target`` with the mean of the ``neighbours`` nearest rows that have it.

    Distances are Euclidean over the numeric predictors (unscaled, missing: 0)
    and the one-hot columns of the others (levels of rows that have the target,
    the first dropped; a missing or unknown level has none).  Rows at equal
    distance rank by their predictors; of rows with equal predictors that only
    partly fit, each counts alike.  No row with a target: nulls stay.
    """
    from tessera.plans import neighbours as N

    out, df = out or target, with_nulls(df)
    num = [p for p in predictors if isinstance(df.schema[p].dataType, T.NumericType)]
    known = df.where(c(target).isNotNull())
    axes = [F.coalesce(c(p).cast("double"), F.lit(0.0)) + 0.0 for p in num]
    for p in (p for p in predictors if p not in num):
        levels = bounded_rows(known.select(c(p).cast("string").alias("v")).where("v is not null").distinct().orderBy("v"), MAX_CATEGORIES, p)
        axes += [F.coalesce((c(p).cast("string") == r["v"]).cast("double"), F.lit(0.0)) for r in levels[1:]]
    d = df.withColumn("__p", F.array(*axes))
    points = N.distinct_points(d.where(c(target).isNotNull()).select("__p", c(target).cast("double").alias("__y")), "__p", y=F.avg("__y"))
    queries = d.where(c(target).isNull()).select(F.col("__p").alias("q")).distinct().orderBy("q")
    queries = written(queries.withColumn("qid", F.monotonically_increasing_id()).select("qid", "q"), "queries")
    near = N.nearest_points(points, queries, neighbours, cell_points or N.CELL_POINTS)
    w = F.least(F.col("m"), neighbours - F.col("before"))
    mean = near.join(points.select("pid", "y"), "pid").groupBy("qid").agg((F.sum(w * F.col("y")) / F.sum(w)).alias("__fill"))
    mean = mean.join(queries, "qid").select(F.col("q").alias("__q"), "__fill")
    res = d.join(mean, F.col("__p") == F.col("__q"), "left")
    return res.withColumn(out, F.coalesce(c(target).cast("double"), F.col("__fill"))).drop("__p", "__q", "__fill")
