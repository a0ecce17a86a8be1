"""Packing documents into fixed-length training sequences by minimum bin slack.

A document is cut into full windows and one remainder.  Remainders are packed
by length only: a table of counts per length (at most ``capacity`` - 1 rows)
goes to the driver, where a bitset subset-sum finds, for each window, the
multiset of remaining lengths that fills it closest to capacity; the multiset
is backtracked with counts and repeated as often as the counts allow.  The
plan has a bounded number of rows and documents are matched to it by their
rank within their length, so no step sees all documents at once.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dense_rank_within, keep, slices, slots_for

CAPACITY = 2048
END_ID = 1
#: Words whose ids a worker remembers (bounds its memory; results do not depend on it).
MEMORY = 600_000
# Fixed value: how the word tokenizer splits a text.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters up to here are their own NFC form and have a one-letter lower case.
LAST_PLAIN = 0x12F
PLAIN = chr(LAST_PLAIN)
#: Trailing signs that form a word of their own after letters.
PUNCTUATION = ".,;:!?#*$%&|<>()-"
#: Documents of one length numbered by one task.
RANK_ROWS = 10_000


class ChunkEncoder:
    """Ids of whole texts by a public tokenizer, one white-space separated chunk at a time.

    A word tokenizer drops white space and never joins what it separates, so
    the ids of a text are the ids of its chunks in order, and every distinct
    chunk of a batch is encoded once.  A chunk of plain letters with trailing
    punctuation is two of the tokenizer's words, whose ids are asked from its
    model directly and remembered.  A tokenizer of another kind (see
    ``word_level``) gets whole texts.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.chunked = word_level(json.loads(self.tokenizer.to_str()))
        self.words: dict[str, bytes] = {}
        self.codes = [struct.pack("<I", i) for i in range(self.tokenizer.get_vocab_size())]
        spell = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.spelling = {c: spell(chr(c))[0][0] for c in range(0xA1, LAST_PLAIN + 1)}

    def word(self, lower: str) -> bytes:
        """Ids of a lower-case run of plain letters or of punctuation."""
        got = self.words.get(lower)
        if got is None:
            found = self.tokenizer.model.tokenize(lower if lower.isascii() else lower.translate(self.spelling))
            code = self.codes
            got = self.words[lower] = b"".join([code[t.id] for t in found])
        return got

    def chunks(self, chunks: list[str]) -> list[bytes]:
        """Ids of each chunk as little-endian 32-bit bytes."""
        words, word = self.words, self.word
        if len(words) > MEMORY:
            words.clear()
        out: list[bytes] = []
        other: list[int] = []
        for c in chunks:
            head = c.rstrip(PUNCTUATION)
            if head.isalpha() and (head.isascii() or max(head) <= PLAIN):
                low = head.lower()
                ids = words.get(low) or word(low)
                out.append(ids + word(c[len(head):]) if len(head) < len(c) else ids)
            else:
                other.append(len(out))
                out.append(b"")
        for i, e in zip(other, self.tokenizer.encode_batch_fast([chunks[i] for i in other], add_special_tokens=False)):
            out[i] = np.asarray(e.ids, "<u4").tobytes()
        return out

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text (null: none) as little-endian 32-bit bytes."""
        texts = texts.fill_null("")
        if not self.chunked:
            for t in texts:
                yield np.asarray(self.tokenizer.encode(t.as_py(), add_special_tokens=False).ids, "<u4").tobytes()
            return
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        ids = pa.array(self.chunks(coded.dictionary.to_pylist()), pa.binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int32)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        bounds = at[split.offsets.to_numpy() - split.offsets[0].as_py()]
        view = memoryview(data) if data is not None else memoryview(b"")
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield bytes(view[a:b])


def word_level(config: dict) -> bool:
    """Whether the tokenizer is the word kind: NFC, white space to spaces, lower case; words of letters, single
    digits or other signs; byte spelling; no prefix, no unknown token."""
    normal = config.get("normalizer") or {}
    kinds = [n.get("type") for n in normal.get("normalizers", [])]
    split = (config.get("pre_tokenizer") or {}).get("pretokenizers") or [{}, {}]
    return (kinds == ["NFC", "Replace", "Lowercase"] and normal["normalizers"][1]["pattern"] == {"Regex": r"\s+"}
            and split[0].get("pattern") == {"Regex": WORD_PATTERN} and split[0].get("behavior") == "Removed"
            and split[0].get("invert") is True and split[-1].get("type") == "ByteLevel"
            and not split[-1].get("add_prefix_space") and not split[-1].get("use_regex") and len(split) == 2)


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Every document cut into windows of ``capacity`` ids and a remainder: doc_id, start, length, ids_crc32, doc_tokens (and ids)."""
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()
    end = np.asarray([end_id], "<u4").tobytes()
    step = 4 * capacity

    def work(batches):
        enc = encoder(tokenizer)
        for b in (part for batch in batches for part in slices(batch, 1)):
            owner, start, length, crc, total, ids = [], [], [], [], [], []
            for i, data in enumerate(enc.encode(b.column(1))):
                data += end
                for s in range(0, len(data), step):
                    part = data[s:s + step]
                    owner.append(i)
                    start.append(s // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    total.append(len(data) // 4)
                    if with_ids:
                        ids.append(np.frombuffer(part, "<u4").astype(np.int32))
            cols = [b.column(0).take(pa.array(owner, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            if with_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"][:len(cols)])

    return src.mapInArrow(work, f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long"
                          + (", ids array<int>" if with_ids else ""))


# ---- minimum bin slack over counts per length ---------------------------------------------
def best_fill(lengths: list[int], counts: dict[int, int], room: int) -> dict[int, int]:
    """How often each length is used in the multiset of available lengths whose sum is the largest at most ``room``.

    Bit s of ``reach`` says that a sum s can be made of the lengths so far (a
    length with many copies is added in doubling bundles, so every count up to
    its bound can be made); the layers are kept and traced back from the best sum.
    """
    layers, reach, mask = [], 1, (1 << (room + 1)) - 1
    for length in lengths:
        left, bundle = min(counts[length], room // length), 1
        while left:
            take = min(bundle, left)
            layers.append((length, take, reach))
            reach |= reach << (length * take) & mask
            left -= take
            bundle *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    used: dict[int, int] = {}
    for length, take, before in reversed(layers):
        if not before >> at & 1:
            at -= length * take
            used[length] = used.get(length, 0) + take
    return used


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """(number of windows, length -> copies in each): every copy of every length is placed.

    Each window starts with the longest remaining length, so a pattern is
    repeated until one of its lengths has too few copies left.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    out = []
    while left:
        lengths = sorted(left, reverse=True)
        longest = lengths[0]
        left[longest] -= 1
        used = best_fill([x for x in lengths if left[x]], left, capacity - longest) if capacity > longest else {}
        left[longest] += 1
        used[longest] = used.get(longest, 0) + 1
        times = min(left[k] // n for k, n in used.items())
        out.append((times, used))
        for k, n in used.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, start, length, ids_crc32, ...; length at most ``capacity``).

    Full windows are sequences of their own; remainders follow the plan.  Null
    and repeated ids are packed like any other piece; identical pieces are
    interchangeable.  Empty table: empty result.
    """
    spark = pieces.sparkSession
    counts = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count(F.lit(1))).collect()}  # at most ``capacity`` rows
    rows, sequence = [], 0
    placed = dict.fromkeys(counts, 0)
    for times, used in ([(counts[capacity], {capacity: 1})] if capacity in counts else []) + plan(
            {k: v for k, v in counts.items() if k < capacity}, capacity):
        offset = 0
        for length, copies in sorted(used.items(), reverse=True):
            rows.append((length, placed[length], placed[length] + times * copies, copies, sequence, offset))
            placed[length] += times * copies
            offset += length * copies
        sequence += times
    schema = "p_length long, first long, last long, copies long, sequence long, at long"
    runs = spark.createDataFrame(rows, schema) if rows else spark.createDataFrame([], schema)
    buckets = slots_for(sum(counts.values()), RANK_ROWS)
    ranked = dense_rank_within(pieces, "length", [F.col("doc_id").asc_nulls_last(), F.col("start"), F.col("ids_crc32")],
                               F.xxhash64("doc_id", "ids_crc32"), buckets, "rank")
    joined = ranked.join(F.broadcast(runs), (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first"))
                         & (F.col("rank") < F.col("last")))
    k = F.col("rank") - F.col("first")
    return joined.select(*[F.col(f"`{c}`") for c in pieces.columns],
                         (F.col("sequence") + F.floor(k / F.col("copies"))).cast("long").alias("sequence_id"),
                         (F.col("at") + F.pmod(k, F.col("copies")) * F.col("length")).cast("long").alias("offset"))


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece.

    A null text is empty and has the end id only.
    """
    pieces = keep(df.sparkSession, token_pieces(df, tokenizer, id_col, text_col, capacity, end_id), "token-pieces")
    return pack(pieces, capacity)


def sequences(df: DataFrame, placed: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              capacity: int = CAPACITY, end_id: int = END_ID, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves (padded, except at a power of two)."""
    ids = token_pieces(df, tokenizer, id_col, text_col, capacity, end_id, with_ids=True)
    key = ["doc_id", "start", "length", "ids_crc32"]
    # repeated rows have equal pieces: any of them may fill any of their places
    n = F.row_number().over(_per(key))
    both = (ids.select(*key, "ids", n.alias("copy")).alias("i")
            .join(placed.select(*key, "sequence_id", "offset", n.alias("copy")).alias("p"),
                  F.expr(" and ".join(f"i.{c} <=> p.{c}" for c in [*key, "copy"]))))
    seq = both.groupBy("p.sequence_id").agg(F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("p.offset", "i.ids"))), lambda x: x["ids"])).alias("ids"))
    size = F.size("ids")
    full = F.when(F.bit_count(size) == 1, F.col("ids")).otherwise(
        F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(capacity) - size)))
    return seq.select("sequence_id", full.alias("ids"))


def _per(key: list[str]):
    from pyspark.sql import Window

    return Window.partitionBy(*key).orderBy(key[-1])
