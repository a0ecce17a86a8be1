"""SentencePiece encoding and decoding with a max-plus scan over chunks.

Encoding is a path through the lattice of pieces: a node is (end, piece) and
an edge joins pieces that may follow each other.  For a byte-pair model an edge
has weight 0 where merging the two pieces' text gives the two pieces back and
minus infinity otherwise; the one path of weight 0 through the whole text is
the model's own segmentation.  A text above ``CHUNK`` characters is cut into
chunks: each yields the max-plus transfer matrix between the states at its two
boundaries (the piece that reaches over the boundary and by how much), matrices
are multiplied in groups until one per text is left, the best path's states are
handed back down the groups, and every chunk traces its own pieces.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.llm.common import keep, slices

SPACE = "▁"
#: Characters of a chunk; a longer text is scanned in chunks.
CHUNK = 32_768
#: Matrices multiplied by one task of the scan.
GROUP = 64
#: Runs of characters whose ids a worker remembers (bounds its memory; results do not depend on it).
MEMORY = 400_000
#: Beginnings of runs up to this length are remembered too.
PREFIX = 7
#: State at a cut that no piece reaches over.
CLEAN = ""
#: Marks the cuts between segments while a batch is split; a text that has it is split one by one.
CUT = "\U0010ffff"

_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n")


class PieceModel:
    """Vocabulary of a byte-pair SentencePiece model with byte fallback, and the lattice over it."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelling = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(self.spelling)) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.spelling[i]: i for i in plain}
        self.codes = {p: struct.pack("<I", i) for p, i in self.ids.items()}
        self.scores = {self.spelling[i]: sp.get_score(i) for i in plain}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in self.byte_ids):
            raise ValueError("the model has no byte pieces")
        self.bytes_of = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        self.raw = [self.bytes_of.get(i, p.replace(SPACE, " ").encode("utf-8")) for i, p in enumerate(self.spelling)]
        self.longest = max(map(len, self.ids))
        # two characters that no piece joins: merges never cross a cut between them
        self.joined = {p[i:i + 2] for p in self.ids for i in range(len(p) - 1)}
        self.by_segment = not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids)
        self.runs: dict[str, bytes] = {}
        self.prefixes: dict[str, str] = {}
        self.pairs: dict[str, dict[str, bool]] = {}

    # ---- the lattice -----------------------------------------------------------------
    def merge(self, text: str) -> list[str]:
        """Byte-pair merges of a short text: best score first, the leftmost of equals."""
        parts = list(text)
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, before: str, piece: str) -> bool:
        """Whether the edge between the two pieces has weight 0 (an empty ``before`` starts a path)."""
        if before and before[-1] + piece[0] not in self.joined:
            before = ""
        near = self.pairs.get(before)
        if near is None:
            if len(self.pairs) > MEMORY // 4:
                self.pairs.clear()
            near = self.pairs[before] = {}
        got = near.get(piece)
        if got is None:
            got = near[piece] = self.merge(before + piece) == ([before, piece] if before else [piece])
        return got

    def paths(self, text: str, start: int, before: str, stop: int, last: dict[int, str] | None = None) -> dict[int, str]:
        """For every place up to ``stop`` that the path from ``start`` (after piece ``before``) can reach: its last piece.

        A place is reached by at most one piece: the last piece of a prefix's own segmentation.
        ``last`` may hold the places up to some end already.
        """
        last = last or {start: before}
        known, longest, pairs, follows = self.ids, self.longest, self.pairs, self.follows
        for end in range(max(last) + 1, stop + 1):
            for from_ in range(max(start, end - longest), end):
                piece = text[from_:end]
                if (piece in known or from_ == end - 1) and from_ in last:
                    before = last[from_]
                    near = pairs.get(before)
                    ok = near.get(piece) if near is not None else None
                    if ok if ok is not None else follows(before, piece):
                        last[end] = piece
                        break
        return last

    def trace(self, last: dict[int, str], start: int, end: int) -> list[str]:
        out = []
        while end > start:
            out.append(last[end])
            end -= len(out[-1])
        return out[::-1]

    # ---- whole texts -------------------------------------------------------------------
    def packed(self, parts: list[str]) -> bytes:
        """Ids of pieces as little-endian 32-bit bytes; a character without a piece is its bytes."""
        code = self.codes
        return b"".join([code[p] if p in code else self.byte_codes(p) for p in parts])

    def byte_codes(self, text: str) -> bytes:
        return struct.pack(f"<{len(raw := text.encode('utf-8'))}I", *[self.byte_ids[b] for b in raw])

    def run(self, text: str) -> bytes:
        """Ids of a run whose neighbours are all joined by some piece."""
        got = self.runs.get(text)
        if got is None:
            if len(self.runs) > MEMORY:
                self.runs.clear()
            if len(self.prefixes) > MEMORY:
                self.prefixes.clear()
            last, n = {0: ""}, len(text)
            for end in range(1, min(n, PREFIX) + 1):  # runs share beginnings
                piece = self.prefixes.get(text[:end])
                if piece is None:
                    break
                last[end] = piece
            have = len(last)
            last = self.paths(text, 0, "", n, last)
            for end in range(have, min(n, PREFIX) + 1):
                if end in last:
                    self.prefixes[text[:end]] = last[end]
            got = self.runs[text] = self.packed(self.trace(last, 0, n))
        return got

    def segment(self, text: str) -> bytes:
        joined = self.joined
        cuts = [i for i in range(1, len(text)) if text[i - 1:i + 1] not in joined]
        if not cuts:
            return self.run(text)
        return b"".join([self.run(text[a:b]) for a, b in zip([0, *cuts], [*cuts, len(text)])])

    def encode(self, prepared: str) -> bytes:
        """Ids of a whole prepared text."""
        parts = _SEGMENT.findall(prepared) if self.by_segment else [prepared] if prepared else []
        return b"".join(map(self.segment, parts))

    def encode_all(self, texts: pa.Array) -> pa.ListArray:
        """Ids of every text (null: none); the distinct segments of the batch are encoded once."""
        texts = texts.fill_null("")
        if not self.by_segment or pc.any(pc.match_substring(texts, CUT)).as_py():
            data = [self.encode(prepared(t)) for t in texts.to_pylist()]
            at = np.cumsum([0, *(len(d) for d in data)])
            return _ids_list(at, b"".join(data))
        cut = pc.replace_substring(texts, " ", CUT + SPACE)
        run = SPACE + CUT + SPACE  # the spaces of a run stay together
        while pc.any(pc.match_substring(cut, run)).as_py():
            cut = pc.replace_substring(cut, run, SPACE + SPACE)
        cut = pc.replace_substring(cut, "\n", CUT + "\n" + CUT)
        first = pc.if_else(pc.equal(texts, ""), "", pc.if_else(pc.starts_with(texts, " "), SPACE + CUT, SPACE))
        cut = pc.binary_join_element_wise(first, cut, "")
        cut = pc.replace_substring(cut, SPACE + CUT + CUT + SPACE, SPACE + SPACE)
        split = pc.split_pattern(cut, CUT)
        coded = split.flatten().dictionary_encode()
        ids = pa.array([self.segment(p) if p else b"" for p in coded.dictionary.to_pylist()], pa.binary()).take(coded.indices)
        _, offsets, data = ids.buffers()
        at = np.frombuffer(offsets, np.int32)[:len(ids) + 1] if len(ids) else np.zeros(1, np.int32)
        return _ids_list(at[split.offsets.to_numpy() - split.offsets[0].as_py()], data)

    def decode_all(self, ids: pa.ListArray) -> list[str | None]:
        """Texts of lists of ids (null: null): pieces joined, byte pieces as UTF-8, the leading space dropped."""
        data = pa.array(self.raw, pa.binary()).take(ids.flatten().cast(pa.int64()))
        _, offsets, buffer = data.buffers()
        at = np.frombuffer(offsets, np.int32)[:len(data) + 1] if len(data) else np.zeros(1, np.int32)
        bounds = at[ids.offsets.to_numpy() - ids.offsets[0].as_py()].tolist()
        view = memoryview(buffer) if buffer is not None else memoryview(b"")
        texts = [bytes(view[a:b]).decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        texts = [t[1:] if t[:1] == " " else t for t in texts]
        return [t if ok else None for t, ok in zip(texts, ids.is_valid().to_pylist())]

    # ---- chunks --------------------------------------------------------------------------
    def clean(self, left: str, right: str) -> bool:
        """Whether no piece reaches over the cut between two texts."""
        return not left or not right or left[-1] + right[0] not in self.joined

    def cut_states(self, left: str, right: str) -> list[str]:
        """States at a cut: pieces that begin before it and end at or behind it, as "overhang:piece"."""
        if self.clean(left, right):
            return [CLEAN]
        out = []
        for back in range(1, min(self.longest, len(left)) + 1):
            for over in range(0, min(self.longest - back, len(right)) + 1):
                piece = left[len(left) - back:] + right[:over]
                if (len(piece) == 1 or piece in self.ids) and self.follows("", piece):
                    out.append(f"{over}:{piece}")
        return out

    def inner_cuts(self, body: str) -> tuple[int, int] | None:
        """The first and the last place inside a chunk that no piece reaches over."""
        at = [i for i in range(1, min(len(body), 4 * self.longest)) if body[i - 1:i + 1] not in self.joined]
        first = at[0] if at else next((i for i in range(1, len(body)) if body[i - 1:i + 1] not in self.joined), None)
        if first is None:
            return None
        return first, next(i for i in range(len(body) - 1, 0, -1) if body[i - 1:i + 1] not in self.joined)

    def _enter(self, text: str, entry: str, stop: int) -> tuple[int, dict[int, str]]:
        over, before = (int(entry.split(":", 1)[0]), entry.split(":", 1)[1]) if entry else (0, "")
        return over, self.paths(text, over, before, stop)

    def _leave(self, last: dict[int, str], first: int, size: int, closed: bool) -> list[str]:
        """Exit states that the paths reach (``size``: the place of the cut)."""
        if closed:
            return [CLEAN] if size in last else []
        return [f"{end - size}:{piece}" for end, piece in last.items() if end > first and end >= size > end - len(piece)]

    def transfer(self, left: str, body: str, right: str) -> dict[tuple[str, str], float]:
        """The chunk's max-plus matrix: (entry state, exit state) -> weight; absent entries are minus infinity.

        Between two inner cuts every path runs through, so only the ends of the chunk are searched.
        """
        size, closed, cuts = len(body), self.clean(body, right), self.inner_cuts(body)
        text = body + right[:self.longest]
        entries = self.cut_states(left, body)
        if cuts is None:
            out = {}
            for e in entries:
                first, last = self._enter(text, e, min(len(text), size + self.longest - 1))
                out |= {(e, x): 0.0 for x in self._leave(last, first, size, closed)}
            return out
        a, b = cuts
        inside = [e for e in entries if a in self._enter(body[:a], e, a)[1]]
        tail = text[b:]
        exits = self._leave(self.paths(tail, 0, "", min(len(tail), size - b + self.longest - 1)), 0, size - b, closed)
        return {(e, x): 0.0 for e in inside for x in exits}

    def chunk_ids(self, left: str, body: str, right: str, entry: str, leave: str) -> bytes:
        """Ids of the chunk's own pieces (those that begin in it) between two states."""
        text, over = body + right[:self.longest], int(leave.split(":", 1)[0]) if leave else 0
        end, cuts = len(body) + over, self.inner_cuts(body)
        if cuts is None:
            first, last = self._enter(text, entry, end)
            return self.packed(self.trace(last, first, end))
        a, b = cuts
        first, last = self._enter(body[:a], entry, a)
        tail = text[b:end]
        return (self.packed(self.trace(last, first, a)) + self.encode(body[a:b])
                + self.packed(self.trace(self.paths(tail, 0, "", len(tail)), 0, len(tail))))


def product(x: dict, y: dict) -> dict:
    """Max-plus product of two transfer matrices."""
    by_entry: dict[str, list] = {}
    for (a, b), w in y.items():
        by_entry.setdefault(a, []).append((b, w))
    out: dict = {}
    for (a, m), w in x.items():
        for b, v in by_entry.get(m, ()):
            if w + v > out.get((a, b), float("-inf")):
                out[a, b] = w + v
    return out


def best_states(matrices: list[dict], entry: str, leave: str) -> list[str]:
    """States at the inner cuts of the best path from ``entry`` to ``leave`` through the matrices."""
    best, back = {entry: 0.0}, []
    for m in matrices:
        now: dict[str, float] = {}
        came: dict[str, str] = {}
        for (a, b), w in m.items():
            if a in best and best[a] + w > now.get(b, float("-inf")):
                now[b], came[b] = best[a] + w, a
        best = now
        back.append(came)
    out = [leave]
    for came in reversed(back):
        out.append(came[out[-1]])
    return out[::-1]


_MODELS: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def prepared(text: str) -> str:
    """A text as the model sees it: a space in front, spaces visible."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def _ids_list(bounds: np.ndarray, data) -> pa.ListArray:
    """Lists of ids from byte bounds into little-endian 32-bit ids."""
    flat = np.frombuffer(data, "<u4") if data is not None else np.zeros(0, "<u4")
    return pa.ListArray.from_arrays(pa.array((np.asarray(bounds) // 4).astype(np.int32)), pa.array(flat[:int(bounds[-1]) // 4].astype(np.int32)))


def _matrix(frame: pd.DataFrame) -> list[dict]:
    return [dict(zip(zip(a, b), w)) for a, b, w in zip(frame["enter"], frame["leave"], frame["weight"])]


_MATRIX = "enter array<string>, leave array<string>, weight array<double>"


def _columns(m: dict) -> dict:
    return {"enter": [a for a, _ in m], "leave": [b for _, b in m], "weight": list(m.values())}


def _long_texts(src: DataFrame, path: str, chunk: int, id_type: str) -> DataFrame:
    """(doc_id, ids) of texts above ``chunk`` characters, by the scan."""
    spark = src.sparkSession
    if chunk < model(path).longest:
        raise ValueError("a chunk has to be at least as long as the longest piece")

    def cut(batches):
        m = model(path)
        row = TaskContext.get().partitionId() * (1 << 32)
        for b in batches:
            for doc, t in zip(b.column(0), b.column(1)):
                t = prepared(t.as_py())
                for i, a in enumerate(range(0, len(t), chunk)):
                    left, body, right = t[max(0, a - m.longest):a], t[a:a + chunk], t[a + chunk:a + chunk + m.longest]
                    x = _columns(m.transfer(left, body, right))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row]), pa.array([doc.as_py()], b.column(0).type), pa.array([i], pa.int64()),
                         *(pa.array([v], pa.string()) for v in (left, body, right)), pa.array([x["enter"]], pa.list_(pa.string())),
                         pa.array([x["leave"]], pa.list_(pa.string())), pa.array([x["weight"]], pa.list_(pa.float64()))],
                        names=["row", "doc_id", "i", "left", "body", "right", "enter", "leave", "weight"])
                row += 1

    chunks = keep(spark, src.mapInArrow(cut, f"row long, doc_id {id_type}, i long, left string, body string, right string, {_MATRIX}"), "piece-chunks")

    def multiply(frame):
        frame = frame.sort_values("i")
        got = None
        for m in _matrix(frame):
            got = m if got is None else product(got, m)
        return pd.DataFrame([{"row": frame["row"].iloc[0], "i": frame["i"].iloc[0] // GROUP, **_columns(got)}])

    levels = [chunks.select("row", "i", "enter", "leave", "weight")]
    while not levels[-1].where("i > 0").isEmpty():
        up = levels[-1].groupBy("row", F.floor(F.col("i") / GROUP).alias("g")).applyInPandas(multiply, f"row long, i long, {_MATRIX}")
        levels.append(keep(spark, up, "piece-products"))

    # the whole text begins and ends at a cut that no piece reaches over
    states = levels[-1].select("row", "i", F.lit(CLEAN).alias("s_in"), F.lit(CLEAN).alias("s_out"))

    def hand_down(frame):
        frame = frame.sort_values("i")
        s = best_states(_matrix(frame), frame["s_in"].iloc[0], frame["s_out"].iloc[0])
        return pd.DataFrame({"row": frame["row"], "i": frame["i"], "s_in": s[:-1], "s_out": s[1:]})

    for lower in reversed(levels[:-1]):
        both = lower.withColumn("g", F.floor(F.col("i") / GROUP)).join(states.withColumnRenamed("i", "g"), ["row", "g"])
        states = keep(spark, both.groupBy("row", "g").applyInPandas(hand_down, "row long, i long, s_in string, s_out string"), "piece-states")

    def trace(batches):
        m = model(path)
        for b in batches:
            data = [m.chunk_ids(*x) for x in zip(*(b.column(k).to_pylist() for k in range(3, 8)))]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(3)), _ids_list(np.cumsum([0, *map(len, data)]), b"".join(data))],
                                             names=["row", "doc_id", "i", "ids"])

    traced = chunks.join(states, ["row", "i"]).select("row", "doc_id", "i", "left", "body", "right", "s_in", "s_out").mapInArrow(
        trace, f"row long, doc_id {id_type}, i long, ids array<int>")
    return traced.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.flatten(F.transform(
        F.sort_array(F.collect_list(F.struct("i", "ids"))), lambda x: x["ids"])).alias("ids")).drop("row")


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK,
           decoded_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, ids (array of int), and with ``decoded_col`` the text decoded from the ids.

    Null and empty texts have no ids; a text gets the ids of the model's own
    encoder; null ids and repeated rows pass through; empty table: empty result.
    """
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def whole(batches):
        m = model(path)
        for b in (part for batch in batches for part in slices(batch, 1)):
            cols, names = [b.column(0), m.encode_all(b.column(1))], ["doc_id", "ids"]
            if decoded_col:
                cols, names = [*cols, pa.array(m.decode_all(cols[1]), pa.string())], [*names, decoded_col]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = f"doc_id {id_type}, ids array<int>" + (f", `{decoded_col}` string" if decoded_col else "")
    short = src.where(F.length("text") < chunk).mapInArrow(whole, schema)
    long = _long_texts(src.where(F.length("text") >= chunk), path, chunk, id_type).select("doc_id", "ids")
    return short.union(decode(long, path, "ids", decoded_col) if decoded_col else long)


def decode(df: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """``df`` with the text of its ids in ``out_col`` (null ids: null)."""
    names = [c for c in df.columns if c != out_col]
    at = df.columns.index(ids_col)
    kept = [k for k, c in enumerate(df.columns) if c != out_col]
    schema = StructType([*(df.schema.fields[k] for k in kept), StructField(out_col, StringType())])

    def work(batches):
        m = model(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in kept), pa.array(m.decode_all(b.column(at)), pa.string())],
                                             names=[*names, out_col])

    return df.mapInArrow(work, schema)


def encode_and_check(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """doc_id, ids, n_ids, decoded_crc32: the ids and a checksum of the text decoded from them."""
    got = encode(df, path, id_col, text_col, chunk, decoded_col="decoded")
    return got.select("doc_id", "ids", F.size("ids").alias("n_ids"), F.crc32("decoded").cast("long").alias("decoded_crc32"))
