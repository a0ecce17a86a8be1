"""Phrase collocation mining by SON partitioning.

Shards - runs of texts of one language, bounded by a task's memory - are mined
completely at a support lowered in proportion to their share of the language's
words: a phrase that reaches the support over all reaches it in proportion in
at least one shard.  The union of what the shards propose is then counted
exactly over all texts, in ranges of a 64-bit phrase code, and at last by the
phrases themselves.  This is done for words and pairs first, then for three to
five words over the pairs that passed, so that shards whose share is too small
to lower the support any further still prune.

Tasks learn which phrases are wanted from Bloom filters of bounded size;
the owners of the ranges hold the exact sets, so a false alarm costs one count.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.common import bounded_rows
from tessera.llm import bloom
from tessera.llm.common import keep, slices

#: Words of a shard at most (bounds a task's memory).
SHARD_WORDS = 6_000_000
#: First bits of a code that name a segment of a broadcast filter, at most: 64 segments of 512 KB.
FILTER_POWER = 6
#: Codes of one range of the exact counts, about.
RANGE_CODES = 1 << 20
LONGEST = 5
#: Phrases a task counts before it sends them on.
PHRASES_HELD = 1_000_000
#: Languages at most (their totals go to every task); more raise an error.
MOST_LANGS = 100_000

_CLEAN = bytes(10 if b in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if b == 9 else b for b in range(256))


def _tokens(batches):
    """(lang, words as numbers, -1 between pieces, the numbers' words as an Arrow array, their codes) per slice of a batch and language."""
    import xxhash

    for whole in batches:
        for b in slices(whole, 1, 8 << 20):
            langs = b.column(0).dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = b.column(1).filter(pc.equal(langs.indices, k)).to_numpy(zero_copy_only=False)
                blob = b"\n".join(texts).lower().translate(_CLEAN).replace(b"\n", b" \n ")
                coded = pc.split_pattern(pa.array([blob], pa.binary()), b" ").flatten().dictionary_encode()
                words = coded.dictionary.to_numpy(zero_copy_only=False)
                number = np.arange(len(words), dtype=np.int32)
                number[words == b""], number[words == b"\n"] = -2, -1
                tokens = number[coded.indices.to_numpy()]
                seed = xxhash.xxh64_intdigest(lang.encode())
                codes = np.fromiter((xxhash.xxh64_intdigest(w, seed) or 1 for w in words), np.uint64, len(words))
                yield lang, tokens[tokens != -2], coded.dictionary, codes


def _shards(batches, shard_words: int):
    """(lang, word codes of a shard with 0 between pieces) of bounded runs of texts."""
    held: dict[str, list] = {}
    for lang, tokens, _, codes in _tokens(batches):
        held.setdefault(lang, []).append(np.append(np.where(tokens >= 0, codes[tokens], np.uint64(0)), np.uint64(0)))
        if sum(map(len, held[lang])) >= shard_words:
            yield lang, np.concatenate(held.pop(lang))
        elif sum(len(x) for parts in held.values() for x in parts) >= 2 * shard_words:  # many languages in one task
            for name in list(held):
                yield name, np.concatenate(held.pop(name))
    for name in list(held):
        yield name, np.concatenate(held.pop(name))


def _longer(codes: np.ndarray, words: np.ndarray, size: int) -> np.ndarray:
    """Codes of the phrases of ``size`` words that start at each place, from those one word shorter (0: none)."""
    left, last = codes[:len(words) - size + 1], words[size - 1:]
    with np.errstate(over="ignore"):
        out = bloom.mix(left * np.uint64(0x9E3779B97F4A7C15) + last)
    out[out == 0] = 1
    out[(left == 0) | (last == 0)] = 0
    return out


def _counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found, n = np.unique(codes[codes != 0], return_counts=True)
    return found, n.astype(np.int64)


def _holds(sorted_codes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_codes, codes)
    at[at == len(sorted_codes)] = 0
    return sorted_codes[at] == codes if len(sorted_codes) else np.zeros(len(codes), bool)


def _levels(words: np.ndarray, sizes: range, passed):
    """(size, codes at each place) for the sizes, longest runs built from what passed at the size before.

    Sizes of 3 and more start from pairs that ``passed`` (a test of codes); the
    caller sends back which codes go on.
    """
    codes = words
    for size in range(2, sizes.start):
        codes = _longer(codes, words, size)
        if size == 2 and passed is not None:
            pairs = np.zeros(len(codes), bool)
            some = np.flatnonzero(codes)
            pairs[some] = passed(codes[some])
            codes = np.where(pairs, codes, np.uint64(0))
    first = codes
    for size in sizes:
        if size > 1:
            codes = _longer(codes, words, size)
            if size > 2 and passed is not None:  # the phrase's last pair passed, too
                codes[first[size - 2:size - 2 + len(codes)] == 0] = 0
        going = yield size, codes
        if going is not None:
            codes = np.where((codes != 0) & _holds(going, codes), codes, np.uint64(0))


def _ranges(codes: np.ndarray, power: int, *columns):
    """One row per range of sorted codes: range, codes, further columns."""
    part = bloom.segment_of(codes, power)
    cuts = np.flatnonzero(np.diff(part)) + 1
    bounds = [0, *cuts.tolist(), len(codes)]
    rows = [(a, z) for a, z in zip(bounds, bounds[1:]) if z > a]
    lists = [pa.array([x[a:z].tobytes() for a, z in rows], pa.binary()) for x in (codes, *columns)]
    return pa.RecordBatch.from_arrays([pa.array([int(part[a]) for a, _ in rows], pa.int32()), *lists],
                                      names=["part", "codes", "counts"][:1 + len(lists)])


class _Filter:
    """A broadcast Bloom filter of codes (bounded size), with its number of segment bits."""

    def __init__(self, spark: SparkSession, codes: DataFrame, total: int, power: int):
        """From rows (part, codes) in ranges of ``power`` first bits, ``total`` codes in all."""
        self.power = segments = bloom.segments_for(total, min(FILTER_POWER, power))

        def build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
            own = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint64)
            return pa.table({"segment": pa.array([key[0].as_py()], pa.int32()),
                             "bits": pa.array([bloom.segment_filter(own, segments).tobytes()], pa.binary())})

        whole = np.zeros((1 << segments, bloom.SEGMENT_BYTES), np.uint8)
        parts = codes.select(F.shiftright("part", power - segments).alias("segment"), "codes")
        for r in parts.groupBy("segment").applyInArrow(build, "segment int, bits binary").toLocalIterator():
            whole[r["segment"]] = np.frombuffer(r["bits"], np.uint8)  # at most 64 rows of 512 KB
        self.bits = spark.sparkContext.broadcast(whole.ravel())

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        return bloom.contains(self.bits.value, self.power, codes)

    def __getstate__(self):
        return self.power, self.bits

    def __setstate__(self, state):
        self.power, self.bits = state


def _propose(totals: dict[str, int], support: int, sizes: range, power: int, shard_words: int, passed):
    """Local mining: the phrases that reach ``support`` in proportion in their shard."""
    def work(batches):
        for lang, words in _shards(batches, shard_words):
            own = int(np.count_nonzero(words))
            levels, going, found = _levels(words, sizes, passed), None, []
            try:
                while True:
                    _, codes = levels.send(going)
                    local, n = _counted(codes)
                    going = local[n * totals.get(lang, 0) >= support * own]  # a language without words has no total
                    found.append(going)
            except StopIteration:
                pass
            codes = np.unique(np.concatenate(found))
            if len(codes):
                yield _ranges(codes, power)
    return work


def _count(sizes: range, power: int, shard_words: int, passed, wanted):
    """Counts of a shard's phrases that the filter of candidates holds."""
    def work(batches):
        for _, words in _shards(batches, shard_words):
            levels, going, found = _levels(words, sizes, passed), None, []
            try:
                while True:
                    _, codes = levels.send(going)
                    local, n = _counted(codes)
                    hit = wanted(local)
                    going = local[hit]
                    found.append((going, n[hit]))
            except StopIteration:
                pass
            codes = np.concatenate([c for c, _ in found])
            order = np.argsort(codes, kind="stable")
            if len(codes):
                yield _ranges(codes[order], power, np.concatenate([n for _, n in found])[order])
    return work


def _union(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The distinct codes of a range."""
    codes = np.unique(np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint64))
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "codes": pa.array([codes.tobytes()], pa.binary()),
                     "size": pa.array([len(codes)], pa.int64())})


def _exact(support: int):
    """The candidates of a range with their exact total at or above the support."""
    def work(counts: pa.Table, candidates: pa.Table) -> pa.Table:
        wanted = np.frombuffer(b"".join(candidates.column("codes").to_pylist()), np.uint64)
        total = np.zeros(len(wanted), np.int64)
        for codes, n in zip(counts.column("codes"), counts.column("counts")):
            codes, n = np.frombuffer(codes.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)
            own = _holds(wanted, codes)
            np.add.at(total, np.searchsorted(wanted, codes[own]), n[own])
        good = wanted[total >= support]
        return pa.table({"part": pa.array([candidates.column("part")[0].as_py()] if len(candidates) else [], pa.int32()),
                         "codes": pa.array([good.tobytes()] if len(candidates) else [], pa.binary()),
                         "size": pa.array([len(good)] if len(candidates) else [], pa.int64())})
    return work


def _phrases(support_filters, longest: int, power: int):
    """Per task, language and range: the phrases that the filters hold, their words and counts."""
    def found(lang, tokens, words, codes):
        one = np.where(tokens >= 0, codes[tokens], np.uint64(0))
        level = one
        for size in range(1, longest + 1):
            level = _longer(level, one, size) if size > 1 else one
            some = np.flatnonzero(level)
            hit = np.zeros(len(some), bool)
            for f in support_filters:
                hit |= f(level[some])
            at = some[hit]
            if not len(at):
                return
            going = np.zeros_like(level)
            going[at] = level[at]
            level = going
            own, first, n = np.unique(level[at], return_index=True, return_counts=True)
            spelled = [words.take(pa.array(tokens[at[first] + i])) for i in range(size)]
            yield pa.table({"part": bloom.segment_of(own, power).astype(np.int32), "lang": pa.array([lang] * len(own)).dictionary_encode().cast(pa.string()),
                            "phrase": pc.binary_join_element_wise(*spelled, b" ") if size > 1 else spelled[0],
                            "words": np.full(len(own), size, np.int32), "count": n.astype(np.int64)})

    def packed(held):
        total = pa.concat_tables(held).group_by(["part", "lang", "phrase", "words"]).aggregate([("count", "sum")])
        total = total.sort_by([("lang", "ascending"), ("part", "ascending")]).combine_chunks()
        part = total.column("part").to_numpy()
        lang = pc.index_in(total.column("lang"), pc.unique(total.column("lang"))).to_numpy()
        ends = np.append(np.flatnonzero(np.diff(part) | np.diff(lang)) + 1, len(part)).astype(np.int32)
        offsets, last = pa.array(np.append(np.int32(0), ends)), pa.array(ends - 1)
        lists = [pa.ListArray.from_arrays(offsets, pa.concat_arrays(total.column(c).chunks)) for c in ("phrase", "words", "count_sum")]
        return pa.table([total.column("part").take(last), total.column("lang").take(last), *lists],
                        names=["part", "lang", "phrase", "words", "count"]).to_batches()

    def work(batches):
        held, entries = [], 0
        for slice_ in _tokens(batches):
            for table in found(*slice_):
                held.append(table)
                entries += len(table)
            if entries > PHRASES_HELD:
                yield from packed(held)
                held, entries = [], 0
        if held:
            yield from packed(held)
    return work


def _spelled(support: int):
    """The phrases of a range, by themselves (no longer by code), with their exact totals."""
    def work(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        sizes = pc.list_value_length(table.column("phrase"))
        lang = table.column("lang").combine_chunks().take(pa.array(np.repeat(np.arange(len(table)), sizes.to_numpy())))
        flat = pa.table({"lang": lang, **{c: pc.list_flatten(table.column(c)) for c in ("phrase", "words", "count")}})
        total = flat.group_by(["lang", "phrase", "words"]).aggregate([("count", "sum")])
        total = total.filter(pc.greater_equal(total.column("count_sum"), support))
        return pa.table({"lang": total.column("lang"), "phrase": total.column("phrase").cast(pa.string()),
                         "words": total.column("words"), "f": total.column("count_sum")})
    return work


def frequent_phrases(df: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = 100, longest: int = LONGEST,
                     shard_words: int = SHARD_WORDS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of every phrase of 1 to ``longest`` words that occurs ``support`` times or more
    in its language, and (lang, n) the words of every language (that has words)."""
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))

    def sizes_of(batches):
        for lang, tokens, _, _ in _tokens(batches):
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([int((tokens >= 0).sum())])], names=["lang", "n"])

    totals = docs.mapInArrow(sizes_of, "lang string, n long").groupBy("lang").agg(F.sum("n").alias("n")).where("n > 0")
    totals = keep(spark, totals, "phrase-totals")
    by_lang = {r["lang"]: r["n"] for r in bounded_rows(totals, MOST_LANGS, "languages")}
    words = sum(by_lang.values())
    # whole shards to a task where the input's own partitions are smaller (never more partitions than it has)
    docs = docs.coalesce(max(1, -(-words // shard_words)) if words > 8 * shard_words else 8)
    power = max(FILTER_POWER, int(np.ceil(np.log2(max(1, words / RANGE_CODES)))))

    filters, passed = [], None
    for sizes in (range(1, min(2, longest) + 1), range(3, longest + 1)):
        if not len(sizes):
            continue
        own = docs.mapInArrow(_propose(by_lang, support, sizes, power, shard_words, passed), "part int, codes binary")
        union = keep(spark, own.groupBy("part").applyInArrow(_union, "part int, codes binary, size long"), "phrase-candidates")
        wanted = _Filter(spark, union, union.agg(F.sum("size")).first()[0] or 0, power)
        counts = docs.mapInArrow(_count(sizes, power, shard_words, passed, wanted), "part int, codes binary, counts binary")
        found = counts.groupBy("part").cogroup(union.groupBy("part")).applyInArrow(_exact(support), "part int, codes binary, size long")
        found = keep(spark, found, "phrase-codes")
        passed = _Filter(spark, found, found.agg(F.sum("size")).first()[0] or 0, power)
        filters.append(passed)

    spelled = docs.mapInArrow(_phrases(filters, longest, power),
                              "part int, lang string, phrase array<binary>, words array<int>, count array<long>")
    spelled = spelled.groupBy("part").applyInArrow(_spelled(support), "lang string, phrase string, words int, f long")
    return keep(spark, spelled, "phrases"), totals


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = 100, longest: int = LONGEST,
                 top: int = 2000, shard_words: int = SHARD_WORDS) -> DataFrame:
    """The best collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Texts (null: empty) are lower-cased in A-Z, cut into pieces at
    ``[.,;:!?\\x0A-\\x0D]`` and into words at spaces and tabs; everything is
    counted per language (null: ``und``, together with rows that say so).
    Candidates are phrases of 2 to ``longest`` words that occur ``support``
    times or more (a).  The cut with the lowest floor(1000 a n / (l r)) - ties:
    the earliest cut - gives l, r and the score, exact past 64 bits.  A
    candidate inside a longer one that occurs as often is dropped.  The first
    ``top`` of a language by score, a (both descending) and phrase (bytes)
    are returned.  Repeated rows count each; ids are not read; an empty table
    or texts without words give no rows.
    """
    f, totals = frequent_phrases(df, text_col, lang_col, support, longest, shard_words)
    spark = df.sparkSession
    split = F.split(F.col("phrase"), " ")
    cand = f.where("words > 1").select("lang", "phrase", F.col("f").alias("a"), "words", split.alias("w"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda k: F.transform(
        F.sequence(F.lit(1), F.col("words") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))))
    covers = cand.where("words > 2").select("lang", F.explode(inner).alias("phrase"), "a")
    covers = covers.groupBy("lang", "phrase").agg(F.max("a").alias("cover"))
    cand = cand.join(covers, ["lang", "phrase"], "left").where("cover is null or 100 * cover < 100 * a").drop("cover")

    cuts = cand.select("lang", "phrase", "a", F.posexplode(F.transform(F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
        F.array_join(F.slice("w", F.lit(1), k), " ").alias("left"), F.array_join(F.slice("w", k + 1, F.col("words")), " ").alias("right")))
        ).alias("k", "cut"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.col("cut.left").alias("left"), F.col("cut.right").alias("right"))
    counts = f.select("lang", "phrase", "f")
    cuts = cuts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"])
    cuts = cuts.join(F.broadcast(totals), "lang")  # at most MOST_LANGS rows
    exact = lambda c: F.col(c).cast("decimal(18,0)")
    cuts = cuts.withColumn("num", exact("a") * exact("n") * F.lit(1000).cast("decimal(4,0)")).withColumn("den", exact("l") * exact("r"))
    cuts = cuts.withColumn("score", F.expr("num div den"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = best.select("lang", "phrase", "a", "n", "b.l", "b.r", "b.score")
    best = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
