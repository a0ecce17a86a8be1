"""Line deduplication with a once-seen and a twice-seen Bloom filter.

Every document's distinct line digests are written once (narrow).  Batches of
them send 4-byte codes to the segments of the two filters: a code met for the
second time enters the twice-seen filter.  Lines whose digest the twice-seen
filter holds are *suspected repeats*; only they shuffle, by their full digest,
to be confirmed by exact counts and to choose the document that keeps the
line.  False alarms of the filters cost a shuffled digest and change nothing.

The filter's size is known before it is built.  Up to ``BROADCAST_BYTES`` it is
sent to the tasks that hold the digests; a larger one stays in its segments
and the digests, packed, are tested there.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bloom
from tessera.llm.common import keep, slices

#: A twice-seen filter of more bytes is not broadcast.
BROADCAST_BYTES = 64 << 20
#: Digests held at once by a task that builds or tests filters.
BATCH_DIGESTS = 1 << 18
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """A line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(SPACES)), UPPER, LOWER)


def _document_digests(df: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """doc, keys: the distinct SHA-256 digests of a document's eligible lines."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    keys = F.filter(F.transform(F.split(text, "\n", -1), line_key), lambda k: F.char_length(k) >= min_chars)
    keys = F.transform(F.array_distinct(keys), lambda k: F.unhex(F.sha2(k, 256)))
    return df.select(F.col(f"`{id_col}`").alias("doc"), keys.alias("keys")).where(F.size("keys") > 0)


def _digests(batches):
    """(doc ids as an Arrow array, digests as rows of 32 bytes) of bounded batches, one entry per digest."""
    for b in batches:
        lists = b.column(1)
        ends = lists.offsets.to_numpy()
        flat = lists.flatten()
        values = np.frombuffer(flat.buffers()[2], np.uint8) if len(flat) else np.zeros(0, np.uint8)
        start = flat.offset
        owner = np.repeat(np.arange(len(b)), np.diff(ends))
        for a in range(0, len(flat), BATCH_DIGESTS):
            z = min(a + BATCH_DIGESTS, len(flat))
            yield b.column(0).take(pa.array(owner[a:z])), values[(start + a) * 32:(start + z) * 32].reshape(-1, 32)


def _codes(digests: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(digests[:, :8]).view(">u8").ravel().astype(np.uint64)


def _binary(rows: np.ndarray) -> pa.Array:
    """Rows of 32 bytes as an Arrow binary array."""
    at = np.arange(0, 32 * len(rows) + 1, 32, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(rows))])


def _by_segment(codes: np.ndarray, power: int):
    """(segment, places of its codes) of every segment that has codes."""
    seg = bloom.segment_of(codes, power)
    order = np.argsort(seg, kind="stable")
    cuts = np.flatnonzero(np.diff(seg[order])) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(seg[part[0]]), part


def _filter_parts(power: int):
    """Per batch and segment: the distinct codes, and which of them the batch holds more than once."""
    def work(batches):
        for _, digests in _digests(batches):
            codes, n = np.unique(_codes(digests), return_counts=True)
            rows = [(s, codes[p].tobytes(), (n[p] > 1).tobytes()) for s, p in _by_segment(codes, power)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))],
                                             names=["segment", "codes", "repeated"])
    return work


def _twice_seen(power: int):
    """The twice-seen filter of one segment, from the parts of all batches."""
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        two = bloom.TwoFilters(power)
        for codes, repeated in zip(table.column("codes"), table.column("repeated")):
            two.add(np.frombuffer(codes.as_py(), np.uint64), np.frombuffer(repeated.as_py(), bool))
        return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()),
                         "bits": pa.array([np.packbits(two.twice, bitorder="little").tobytes()], pa.binary())})
    return work


def _suspects_near(digests: DataFrame, power: int) -> DataFrame:
    """Suspected repeats (key, doc), tested where the digests are: the filter is broadcast (2 ** power segments)."""
    parts = digests.mapInArrow(_filter_parts(power), "segment int, codes binary, repeated binary")
    filters = parts.groupBy("segment").applyInArrow(_twice_seen(power), "segment int, bits binary")
    whole = np.zeros((1 << power, bloom.SEGMENT_BYTES), np.uint8)
    for r in filters.toLocalIterator():  # 2 ** power rows of fixed size, at most BROADCAST_BYTES in all
        whole[r["segment"]] = np.frombuffer(r["bits"], np.uint8)
    twice = digests.sparkSession.sparkContext.broadcast(whole.ravel())

    def test(batches):
        for docs, found in _digests(batches):
            hit = np.flatnonzero(bloom.contains(twice.value, power, _codes(found)))
            yield pa.RecordBatch.from_arrays([_binary(found[hit]), docs.take(pa.array(hit))], names=["key", "doc"])

    return digests.mapInArrow(test, T.StructType([T.StructField("key", T.BinaryType()), digests.schema["doc"]]))


def _suspects_far(digests: DataFrame, power: int) -> DataFrame:
    """Suspected repeats (key, doc), tested in the segments of a filter too large to broadcast.

    A digest that a batch holds twice is suspected there and then: its lines
    go on by themselves (segment -1) and one entry per batch reaches the
    segment, so a line of a third of all documents is no hot group.
    """
    doc_type = digests.schema["doc"]
    packed = T.StructType([T.StructField("segment", T.IntegerType()), T.StructField("keys", T.ArrayType(T.BinaryType())),
                           T.StructField("docs", T.ArrayType(doc_type.dataType)), T.StructField("repeated", T.BinaryType())])

    def deal(batches):
        for docs, found in _digests(batches):
            codes = _codes(found)
            _, first, inverse, n = np.unique(codes, return_index=True, return_inverse=True, return_counts=True)
            rows = [(s, first[p], n[p] > 1) for s, p in _by_segment(codes[first], power)]
            again = np.flatnonzero(n[inverse] > 1)
            if len(again):
                rows.append((-1, again, np.ones(len(again), bool)))
            for s, at, rep in rows:
                one = [0, len(at)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([s], pa.int32()), pa.ListArray.from_arrays(one, _binary(found[at])),
                     pa.ListArray.from_arrays(one, docs.take(pa.array(at))), pa.array([rep.tobytes()], pa.binary())],
                    names=["segment", "keys", "docs", "repeated"])

    def test(table: pa.Table) -> pa.Table:
        two = bloom.TwoFilters(power)
        rows = []
        for k in range(len(table)):
            keys, docs = (table.column(x)[k].values for x in ("keys", "docs"))
            found = np.frombuffer(keys.buffers()[2], np.uint8)[keys.offset * 32:(keys.offset + len(keys)) * 32].reshape(-1, 32)
            repeated = np.frombuffer(table.column("repeated")[k].as_py(), bool)
            two.add(_codes(found), repeated)
            rows.append((found[~repeated], docs.filter(pa.array(~repeated))))
        out = [(found[hit], docs.filter(pa.array(hit))) for found, docs in rows for hit in [two.seen_twice(_codes(found))]]
        return pa.table({"key": pa.chunked_array([_binary(f) for f, _ in out], pa.binary()),
                         "doc": pa.chunked_array([d for _, d in out], table.schema.field("docs").type.value_type)})

    parts = keep(digests.sparkSession, digests.mapInArrow(deal, packed), "line-parts")
    own = parts.where("segment < 0").select(F.explode(F.arrays_zip("keys", "docs")).alias("x")).select("x.keys", "x.docs").toDF("key", "doc")
    out = T.StructType([T.StructField("key", T.BinaryType()), doc_type])
    return own.unionByName(parts.where("segment >= 0").groupBy("segment").applyInArrow(test, out))


def repeated_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
                   broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """doc, drop: the digests of the lines that each document loses (documents that lose none are absent)."""
    spark = df.sparkSession
    digests = keep(spark, _document_digests(df, id_col, text_col, min_chars), "line-digests")
    total = digests.agg(F.sum(F.size("keys"))).first()[0] or 0
    power = bloom.segments_for(total)
    near = (bloom.SEGMENT_BYTES << power) <= broadcast_bytes
    suspects = keep(spark, (_suspects_near if near else _suspects_far)(digests, power), "line-suspects")

    # exact confirmation: documents per digest; map-side counts make a frequent line one row per task
    lines = suspects.distinct()
    found = lines.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("last")).where(F.col("n_docs") >= min_docs)
    found = keep(spark, found, "line-repeats")
    # a line with more than a thousandth of all suspected entries is hot: fewer than a thousand lines can be
    entries = suspects.count()
    hot = found.where(F.col("n_docs") * 1000 > entries).withColumnsRenamed({"key": "hot_key", "last": "hot_last"}).drop("n_docs")
    marked = suspects.join(F.broadcast(hot), F.col("key") == F.col("hot_key"), "left")
    of_hot = marked.where(F.col("hot_key").isNotNull() & ~F.col("doc").eqNullSafe(F.col("hot_last"))).select("doc", "key")
    rest = marked.where(F.col("hot_key").isNull()).select("doc", "key").join(found.drop("n_docs"), "key")
    losers = of_hot.unionByName(rest.where(~F.col("doc").eqNullSafe(F.col("last"))).select("doc", "key"))
    return losers.groupBy("doc").agg(F.collect_set("key").alias("drop"))


def _cut(text: str, drop: set[bytes]) -> tuple[str, int]:
    """The text without the lines whose digest is in ``drop``, and how many went."""
    lines = text.encode().split(b"\n")
    kept = [x for x in lines if hashlib.sha256(x.strip(SPACES.encode()).lower()).digest() not in drop]
    return b"\n".join(kept).decode(), len(lines) - len(kept)


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3,
                broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with the repeated lines cut from the text, and n_lines, n_dropped (long) added.

    A line's key is the line without ASCII white space at its ends, A-Z
    lower-cased.  Keys of at least ``min_chars`` code points that at least
    ``min_docs`` documents hold lose all their lines except those in the
    document with the largest id among them.  A null or empty text is one
    empty line and becomes the empty text.  A document is what has one id:
    rows with the same id count once and lose the same lines (repeated rows
    all stay); rows without id are one document that ranks below all others.
    Empty table: empty result.  Other columns pass through unchanged (an input
    column n_lines or n_dropped is replaced).
    """
    drops = repeated_lines(df, id_col, text_col, min_chars, min_docs, broadcast_bytes)
    drops = keep(df.sparkSession, drops, "line-drops").withColumnsRenamed({"doc": "__line_doc", "drop": "__line_drop"})
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = df.drop("n_lines", "n_dropped").withColumn(text_col, text)
    rows = rows.join(drops, F.col(f"`{id_col}`").eqNullSafe(F.col("__line_doc")), "left").drop("__line_doc")
    rows = rows.withColumn("n_lines", F.size(F.split(F.col(f"`{text_col}`"), "\n", -1)).cast("long"))
    place, names = rows.columns.index(text_col), [c for c in rows.columns if c != "__line_drop"]

    def cut(batches):
        for whole in batches:
            for b in slices(whole, place):
                texts = b.column(place)
                drop = b.column(b.schema.get_field_index("__line_drop"))
                found = [(i, *_cut(texts[int(i)].as_py(), set(drop[int(i)].as_py()))) for i in np.flatnonzero(drop.is_valid())]
                n = np.zeros(len(b), np.int64)
                if found:
                    at, new, gone = zip(*found)
                    n[list(at)] = gone
                    mask = np.zeros(len(b), bool)
                    mask[list(at)] = True
                    texts = pc.replace_with_mask(texts, pa.array(mask), pa.array(new, texts.type))
                columns = [texts if c == text_col else b.column(b.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(n)], names=[*names, "n_dropped"])

    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField("n_dropped", T.LongType())])
    return rows.mapInArrow(cut, schema)
