"""Substring deduplication by hashing paragraphs, lines, sentences and runs of short sentences.

A unit is a line, a sentence of a line, a run of consecutive short sentences
(across lines) that reaches ``min_words`` words, or a paragraph that has short
lines.  Units of at least ``min_words`` words are normalised and hashed;
digests are grouped over the whole corpus, the earliest ranked occurrence
(smallest id, then smallest offset) stays.  The others of a text are joined
where they touch or overlap, and a joined run of at least ``min_run`` words is
removed: a sentence that two texts share by chance stays, a shared passage of
many such sentences goes.  Spans are kept in the offsets of the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tessera.llm.common import keep, private

#: Pieces of text with fewer words are units only together with those beside them.
MIN_WORDS = 8
#: Repeated units that touch are removed from this many words on: single sentences repeat by chance.
MIN_RUN = 20
#: A paragraph is a unit with this many times the least words.
PARAGRAPH = 3

_SENTENCE_END = re.compile(r"[.!?]+[ \t\r\x0b\f]+")
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")


def _short_runs(run: list[tuple[int, int, int, bool, bool]], min_words: int):
    """(first, last) of every shortest run of consecutive short sentences that reaches ``min_words`` words, from each
    sentence forwards and backwards: together they cover the whole run, whatever stands around it."""
    spans, first, held = set(), 0, 0
    for last, x in enumerate(run):
        held += x[2]
        while held - run[first][2] >= min_words:
            held -= run[first][2]
            first += 1
        if held >= min_words:
            spans.add((first, last))
    last, held = -1, 0
    for first, x in enumerate(run):
        while held < min_words and last + 1 < len(run):
            last += 1
            held += run[last][2]
        if held < min_words:
            break
        spans.add((first, last))
        held -= x[2]
    return sorted(spans)


def _spans(text: str, min_words: int):
    """(start, end) of every unit, in any order."""
    run: list[tuple[int, int, int, bool, bool]] = []  # short sentences: start, end, words, first of its line, last of its line

    def runs():
        for i, j in _short_runs(run, min_words):
            yield run[i][0], min(run[j][1] + (run[i][3] and run[j][4]), len(text))
        run.clear()

    at = 0
    for line in text.split("\n"):
        end = at + len(line)
        cuts = [0, *(m.end() for m in _SENTENCE_END.finditer(line)), len(line)]
        if len(line.split()) >= min_words:
            yield at, min(end + 1, len(text))
        for s, e in zip(cuts, cuts[1:]):
            n = len(line[s:e].split())
            if n >= min_words:
                yield from runs()
                if len(cuts) > 2:
                    yield at + s, at + e
            elif n:
                run.append((at + s, at + e, n, s == 0, e == len(line)))
        at = end + 1
    yield from runs()
    at = 0
    for end in [*(m.end() for m in _BLANK_LINE.finditer(text)), len(text)]:
        sizes = [len(x.split()) for x in text[at:end].split("\n")]
        if sum(sizes) >= PARAGRAPH * min_words and any(0 < n < min_words for n in sizes):
            yield at, end
        at = end


def unit_spans(text: str, min_words: int = MIN_WORDS):
    """(start, end, normalised bytes) of every unit, by start.

    Lines and sentences need ``min_words`` words.  A line's span includes its
    line end and a sentence's the white space after it; a line of one sentence
    is one unit.  Sentences with fewer words are units together with those
    beside them; such a run includes its last line end where it starts with a
    line.  A paragraph (up to a blank line, ``PARAGRAPH`` times ``min_words``
    words) is a unit where it has a shorter line.  A unit that overlaps the
    text's first equal one is left out, so that one stays whole.
    """
    first_end: dict[bytes, int] = {}
    for s, e in sorted(_spans(text, min_words), key=lambda x: (x[0], -x[1])):
        key = " ".join(text[s:e].split()).lower().encode("utf-8", "surrogatepass")
        if key not in first_end:
            first_end[key] = e
        elif s < first_end[key]:
            continue
        yield s, e, key


def units(df: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """doc_id, th (hash of the text), start, len, h1, h2 (128-bit digest of the unit), again (an earlier unit of the text is equal)."""
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(F.col(f"`{text_col}`")).alias("th"),
                    F.col(f"`{text_col}`").cast("string").alias("text"))
    id_type = src.schema["doc_id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            owner, start, length, digests, again = [], [], [], [], []
            for i, t in enumerate(b.column(2)):
                t = t.as_py()
                if not t:
                    continue
                seen = set()
                for s, e, key in unit_spans(t, min_words):
                    d = blake2b(key, digest_size=16).digest()
                    owner.append(i)
                    start.append(s)
                    length.append(e - s)
                    digests.append(d)
                    again.append(d in seen)
                    seen.add(d)
            pick = pa.array(owner, pa.int32())
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pick), b.column(1).take(pick), pa.array(start, pa.int32()), pa.array(length, pa.int32()),
                 pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(again, pa.bool_())],
                names=["doc_id", "th", "start", "len", "h1", "h2", "again"])

    return src.mapInArrow(work, f"doc_id {id_type}, th long, start int, len int, h1 long, h2 long, again boolean")


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, th, start, len, keep_id: every occurrence but the first, in original offsets, and the id that keeps the unit."""
    u = keep(df.sparkSession, units(df, id_col, text_col, min_words), "substring-units")
    first = (u.where(~F.col("again")).groupBy("h1", "h2")
             .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    elsewhere = u.where(~F.col("again")).join(first, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keep_id")))
    inside = u.where("again").withColumn("keep_id", F.col("doc_id"))
    cols = ["doc_id", "th", "start", "len", "keep_id"]
    return elsewhere.select(*cols).union(inside.select(*cols))


#: A span as one long: start * SPAN + length.
SPAN = 1 << 32


def _cutter(min_run: int):
    def cut(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        """Each text without the runs of its spans that have ``min_run`` words, and those runs."""
        for texts, spans in parts:
            out, removed = [], []
            for t, s in zip(texts, spans):
                union: list[list[int]] = []
                if t is not None and s is not None:
                    for a, n in sorted(divmod(int(x), SPAN) for x in s):
                        if union and a <= union[-1][1]:
                            union[-1][1] = max(union[-1][1], a + n)
                        else:
                            union.append([a, a + n])
                    union = [[a, e] for a, e in union if len(t[a:e].split()) >= min_run]
                if union:
                    starts, ends = [0, *(e for _, e in union)], [*(a for a, _ in union), len(t)]
                    t = "".join(t[a:b] for a, b in zip(starts, ends))
                out.append(t)
                removed.append([a * SPAN + e - a for a, e in union])
            yield pd.DataFrame({"text": out, "removed": removed})

    return pandas_udf(cut, "text string, removed array<long>")


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                   removed_col: str | None = None, min_run: int = MIN_RUN) -> DataFrame:
    """``df`` with runs of repeated units (``min_run`` words or more) cut out of the text, other columns unchanged.

    ``removed_col`` adds the removed spans (array of start, length in
    characters of the original text, merged and in order).  Null and empty
    texts stay as they are.  Rows with equal id and text are one document and
    give equal results.  Null ids rank after every other; rows with equal ids
    rank equal and do not lose units to each other.  A text that is cut to
    nothing becomes empty.  Empty table: empty result.
    """
    k = {n: private(n) for n in ("hash", "id", "hash2", "spans", "cut")}
    spans = repeated_spans(df, id_col, text_col, min_words)
    per_doc = (spans.groupBy(F.col("doc_id").alias(k["id"]), F.col("th").alias(k["hash2"]))
               .agg(F.collect_set(F.col("start") * F.lit(SPAN) + F.col("len")).alias(k["spans"])))
    src = df.withColumn(k["hash"], F.xxhash64(F.col(f"`{text_col}`")))
    src = src.join(per_doc, F.col(f"`{id_col}`").eqNullSafe(F.col(k["id"])) & (F.col(k["hash"]) == F.col(k["hash2"])), "left")
    src = src.withColumn(k["cut"], _cutter(min_run)(F.col(f"`{text_col}`").cast("string"), F.col(k["spans"])))
    out = [F.col(f"{k['cut']}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in df.columns]
    if removed_col:
        out.append(F.transform(F.col(f"{k['cut']}.removed"), lambda x: F.struct(
            F.floor(x / SPAN).cast("int").alias("start"), F.pmod(x, F.lit(SPAN)).cast("int").alias("length"))).alias(removed_col))
    return src.select(*out)
