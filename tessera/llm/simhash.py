"""SimHash near-duplicate detection with BK-trees.

Fingerprints are 64-bit SimHashes of word shingles.  Two fingerprints within
``radius`` bits agree on at least one of ``radius + 1`` bit blocks and so on
the first bits of that block.  Every distinct fingerprint is routed to the
shard of the first bits of each of its blocks, as many bits as leave about
``SHARD`` members in a shard; a shard builds a BK-tree (children keyed by
their integer Hamming distance to the parent) and searches it for all its
members, following only the edges within the radius of the distance to the
node.  A shard above ``MAX_TREE`` members is divided again by the blocks of
its remaining bits, taken whole - the same argument makes that exact - so no tree grows
with the corpus.  A shard reports a spanning forest of its links, never all
pairs, and components are joined as tables.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, slots_for
from tessera.llm.components import components

#: Distinct fingerprints in one BK-tree: on average, and at most.
SHARD, MAX_TREE = 4096, 16384
#: Shingle hashes whose bits are counted together (bounds the memory of a batch).
HASH_BLOCK = 1 << 17


def shingle_hashes(words: list[bytes], size: int, seed: int = 42) -> Iterator[int]:
    """XXH64 of every space-joined shingle, repeats included; a shorter text is one shingle, no word gives none."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return iter(())
    if len(words) < size:
        return iter((digest(b" ".join(words), seed),))
    return (digest(b" ".join(s), seed) for s in zip(*(words[k:] for k in range(size))))


class _Majority:
    """Counts the bits of the hashes of many documents, a bounded block at a time."""

    def __init__(self, docs: int):
        self.ones = np.zeros((docs, 64), np.int64)
        self.total = np.zeros(docs, np.int64)
        self.clear()

    def clear(self):
        self.parts, self.owner, self.held = [], [], 0

    def add(self, doc: int, hashes: Iterator[int]):
        while True:
            part = np.fromiter(_take(hashes, HASH_BLOCK - self.held), np.uint64)
            if not len(part):
                return
            self.parts.append(part)
            self.owner.append(doc)
            self.held += len(part)
            if self.held < HASH_BLOCK:
                return
            self.flush()

    def flush(self):
        if self.parts:
            sizes = np.array([len(p) for p in self.parts])
            bits = np.unpackbits(np.concatenate(self.parts).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            np.add.at(self.ones, self.owner, sums)
            np.add.at(self.total, self.owner, sizes)
        self.clear()

    def fingerprints(self) -> np.ndarray:
        self.flush()
        bits = (2 * self.ones > self.total[:, None]).astype(np.uint8)
        return np.packbits(bits, axis=1, bitorder="little").view(np.int64).ravel()


def _take(it: Iterator[int], n: int) -> Iterator[int]:
    for _, x in zip(range(n), it):
        yield x


def _sha(text_col: str):
    """The text's SHA-256 (null for a null text)."""
    return F.unhex(F.sha2(F.col(f"`{text_col}`").cast("string"), 256))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, sha: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long); null and wordless texts have fingerprint zero. ``sha`` adds the text's SHA-256."""
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"),
                    *([_sha(text_col).alias("sha")] if sha else []))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            texts = b.column(1)
            count = _Majority(len(texts))
            for i, t in enumerate(texts):
                t = t.as_py()
                if t:
                    count.add(i, shingle_hashes(t.lower().split(), shingle))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count.fingerprints()), *b.columns[2:]],
                                             names=["doc_id", "fp", *(["sha"] if sha else [])])

    return src.mapInArrow(work, f"doc_id {id_type}, fp long" + (", sha binary" if sha else ""))


# ---- BK-trees --------------------------------------------------------------------------
def bk_tree(values: np.ndarray) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """(order of the nodes, children as (distance, node)): a BK-tree of distinct fingerprints, built level by level."""
    children: list[list[tuple[int, int]]] = [[] for _ in range(len(values))]
    todo = [np.arange(len(values))]
    while todo:
        members = todo.pop()
        node, rest = members[0], members[1:]
        if not len(rest):
            continue
        d = np.bitwise_count(values[rest] ^ values[node])
        order = np.argsort(d, kind="stable")
        rest, d = rest[order], d[order]
        cuts = np.flatnonzero(np.diff(d)) + 1
        for group, dist in zip(np.split(rest, cuts), d[np.concatenate(([0], cuts))]):
            children[node].append((int(dist), int(group[0])))
            todo.append(group)
    return values, children


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest (pairs of places) of the links within ``radius``: every member searches the shard's tree."""
    values, children = bk_tree(values)
    label = np.arange(len(values))
    links = []
    todo = [(0, np.arange(len(values)))]
    while todo:
        node, seekers = todo.pop()
        d = np.bitwise_count(values[seekers] ^ values[node]).astype(np.int64)
        near = label[seekers[d <= radius]]
        if len(near) and (near != near[0]).any():
            old = np.unique(near)
            links += [(int(old[0]), int(x)) for x in old[1:]]
            label[np.isin(label, old)] = old[0]
        for dist, child in children[node]:
            go = seekers[np.abs(d - dist) <= radius]
            if len(go):
                todo.append((child, go))
    return links


def _tree_links(radius: int):
    def work(frames):
        for f in frames:
            a, b = [], []
            for fps in f["fps"]:
                v = np.asarray(fps, np.int64)
                links = spanning_links(v.view(np.uint64), radius)
                a += [v[i] for i, _ in links]
                b += [v[j] for _, j in links]
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return work


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _block_masks(fixed: int, parts: int, bits: int) -> list[int]:
    """The first ``bits`` of each of ``parts`` runs of near equal length of the bits outside ``fixed``, each with the fixed bits."""
    free = [i for i in range(64) if not fixed >> i & 1]
    cuts = [len(free) * k // parts for k in range(parts + 1)]
    return [fixed | sum(1 << i for i in free[cuts[k]:min(cuts[k] + bits, cuts[k + 1])]) for k in range(parts)]


def fingerprint_links(fps: DataFrame, radius: int = 2, max_tree: int = MAX_TREE, shard: int = SHARD) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) that connect all fingerprints within ``radius`` bits."""
    spark = fps.sparkSession
    shard = min(shard, max_tree)
    links = None
    masks = {1: 0}  # shard family -> its fixed bits
    rows = fps.select("fp", F.lit(1).alias("family"))
    total = rows.count()  # fingerprints at this level
    while True:
        bits = max(0, math.ceil(math.log2(max(1, total) / shard))) if links is None else 64  # a large shard is divided by whole blocks
        parts = radius + 1 if bits else 1  # without bits one tree holds all
        children = {f: [(f * (radius + 2) + k, m) for k, m in enumerate(_block_masks(fixed, parts, bits), 1)]
                    for f, fixed in masks.items()}
        masks = {f: m for c in children.values() for f, m in c}
        pick = F.create_map(*[x for f, c in children.items() for x in (
            F.lit(f), F.array(*[F.struct(F.lit(g).alias("family"), F.lit(_signed(m)).cast("long").alias("mask")) for g, m in c]))])
        rows = rows.select("fp", F.explode(F.element_at(pick, F.col("family"))).alias("s"))
        rows = rows.select("fp", F.col("s.family").alias("family"), F.col("fp").bitwiseAND(F.col("s.mask")).alias("block"))
        sizes = keep(spark, rows.groupBy("family", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-shards")
        tasks = slots_for(parts * total, 8 * shard)
        grown = rows.join(sizes.where(F.col("n") <= max_tree), ["family", "block"])
        trees = grown.repartition(tasks, "family", "block").groupBy("family", "block").agg(F.collect_list("fp").alias("fps"))
        found = keep(spark, trees.select("fps").mapInPandas(_tree_links(radius), "a long, b long"), "simhash-links")
        links = found if links is None else links.union(found)
        big = sizes.where(F.col("n") > max_tree)
        if big.isEmpty():
            return links
        masks = {r[0]: masks[r[0]] for r in big.select("family").distinct().collect()}  # at most (radius + 1) ** level families
        rows = keep(spark, rows.join(big.select("family", "block"), ["family", "block"], "left_semi"), "simhash-rows")
        total = rows.count()


def _grouped(df: DataFrame, id_col: str, text_col: str, shingle: int, radius: int, max_tree: int, sha: bool = False) -> DataFrame:
    """One row per input row: doc_id, fp, component_id; with ``sha`` also sha and best, the component's first (no id, id, sha)."""
    spark = df.sparkSession
    prints = keep(spark, fingerprints(df, id_col, text_col, shingle, sha), "simhash-prints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "sha") if sha else None
    classes = keep(spark, prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), *([F.min(row).alias("best")] if sha else [])), "simhash-classes")
    roots = components(fingerprint_links(classes, radius, max_tree))
    classes = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = classes.groupBy("root").agg(F.min("rep").alias("component_id"), *([F.min("best").alias("best")] if sha else []))
    return prints.join(classes.select("fp", "root").join(lowest, "root").drop("root"), "fp")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2,
                    max_tree: int = MAX_TREE) -> DataFrame:
    """One row per input row: doc_id, fp (signed long), fingerprint (hex), component_id.

    component_id is the smallest id reachable over links of at most ``radius``
    differing bits, the row's own included (null ids are passed over; null
    only where a whole component has no id).  Null, empty and wordless texts
    have fingerprint zero and link like any other; repeated rows share a
    component.  Empty table: empty result.
    """
    return _grouped(df, id_col, text_col, shingle, radius, max_tree).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2,
                           max_tree: int = MAX_TREE) -> DataFrame:
    """``df`` with one document of each component (the one with the smallest id), all columns unchanged.

    A row is told by its id and text: a null id ranks last, so a row without
    id stays only where its component has no id at all; among equal ids the
    smallest SHA-256 of the text stays (a null text first).  A repeated row
    (equal id and text) stays once.
    """
    near = keep(df.sparkSession, _grouped(df, id_col, text_col, shingle, radius, max_tree, sha=True).select("doc_id", "sha", "best"), "simhash-groups")
    wins = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & F.col("sha").eqNullSafe(F.col("best.sha"))
    losers = near.where(~wins).select(F.col("doc_id").alias("__lost"), F.col("sha").alias("__lost_sha")).distinct()
    kept = df.join(losers, F.col(f"`{id_col}`").eqNullSafe(F.col("__lost")) & _sha(text_col).eqNullSafe(F.col("__lost_sha")), "left_anti")
    if near.groupBy("doc_id", "sha").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return kept
    return kept.dropDuplicates([id_col, text_col])
