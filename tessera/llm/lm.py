"""Language-model scores by deleted interpolation of word bigrams.

P(word | word before) mixes the maximum-likelihood estimates of orders 2, 1 and
0 with weights that depend on the frequency bucket of the context.  The weights
are learned by expectation-maximisation on counts held out from the training
texts (``WEIGHT_FOLD``); scores then use the counts of all training texts.
Every word of the training texts is a class of its own, and every pair of words
is counted; words outside the classes (``CLASS_SHARE``) share class 0, within
which a word's maximum-likelihood estimate is mixed with the uniform one over
the known words and one unknown word.

Texts are read once into batches of bounded size: a batch is one row with its
distinct words, their counts, and its texts as numbers of those words.  A batch
sends each distinct word once to the ``part`` of the word; there the counts of
all batches are summed and the word gets a number of the corpus, and the batch
gets numbers and counts back.  Pairs of numbers make one exact 64-bit key, and
the batch's distinct pairs go to parts of their own in the same way.  Parts
have a bounded size on average.  The batches are kept bucketed, so they are
not moved for that.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import keep, slots_for
from tessera.session import scratch_path

#: Tokens gathered into one batch (bounds a worker's memory).
BATCH_TOKENS = 1_500_000
#: Tokens scored together.
SLICE = 250_000
#: Distinct words and pairs of batches whose counts are summed in one place (on average, at most).
PART_WORDS, PART_PAIRS = 500_000, 2_000_000
#: Folds of the training texts: counts are held out from the last one to learn the weights.
FOLDS = 5
HELD_OUT_FOLD, WEIGHT_FOLD = 1, 4
ROUNDS = 60
#: A word with more than this share of the training tokens is a class: with 0 every word of the training texts.
CLASS_SHARE = 0
#: Numbers that no word has: of the words outside the classes, and of the start of a text.
OTHER, START = 0, 1
#: Least weight of an estimate.
FLOOR = 1e-6


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5 (null id: the empty text)."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS)).cast("int")


def _batches(batches):
    """One row per batch of texts: distinct words, joined by spaces (the empty word is the end of a text), their counts a and h
    in the counted folds and the weight fold, and per text its id, fold, size and word numbers."""
    place = TaskContext.get().partitionId() * (1 << 32)
    numbers: dict[bytes, int] = {}
    texts, ids, folds, held, made = [], [], [], 0, 0

    def flush():
        flat = np.concatenate(texts)
        sizes = np.array([len(t) for t in texts], np.int32)
        fold = np.repeat(np.array(folds, np.int32), sizes)
        count = [np.bincount(flat[k], minlength=len(numbers)).astype(np.int32)
                 for k in ((fold != HELD_OUT_FOLD) & (fold != WEIGHT_FOLD), fold == WEIGHT_FOLD)]
        row = [[place + made], [b" ".join(numbers)], [len(numbers)], *([c] for c in count), [ids], [np.array(folds, np.int32)], [sizes], [flat]]
        types = [pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(id_type),
                 pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types)],
                                          names=["batch", "words", "distinct", "a", "h", "ids", "folds", "sizes", "tokens"])

    for b in batches:
        id_type = b.schema.field(0).type
        for i, fold, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            text = text.as_py()
            words = text.lower().split() if text else []
            words.append(b"")
            texts.append(np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int32))
            ids.append(i)
            folds.append(fold)
            held += len(words)
            if held >= BATCH_TOKENS:
                yield flush()
                made, held = made + 1, 0
                numbers, texts, ids, folds = {}, [], [], []
    if texts:
        yield flush()


# ---- pairs of classes -----------------------------------------------------------------------
def _lists(column: pa.Array) -> list[np.ndarray]:
    """The lists of a list column as arrays."""
    flat, at = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a - at[0]:b - at[0]] for a, b in zip(at[:-1], at[1:])]


def _one_batch(table: pa.Table, *names: str) -> list[np.ndarray]:
    """The packed longs of a one-row table's columns, then the lists folds, sizes and tokens."""
    return [*(_unpack(table[n][0].as_py()) for n in names), *(_lists(table[n].combine_chunks())[0] for n in ("folds", "sizes", "tokens"))]


def _pack(x: np.ndarray) -> bytes:
    """Longs as bytes: how many bytes a long takes, then the lowest byte of all, the next byte of all ..."""
    x = np.ascontiguousarray(x).view(np.uint64)
    width = (int(x.max(initial=0)).bit_length() + 7) // 8
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :max(width, 1)].T.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(max(data[0], 1), -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :len(planes)] = planes.T
    return out.view(np.int64).ravel()


def _word_parts(words: bytes, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of the words of a batch by part, where each part begins in it and the end)."""
    part = np.array([zlib.crc32(w) % parts for w in words.split(b" ")], np.int64)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1))


def _batch_words(parts: int):
    """Per batch and part: the batch's distinct words and their counts."""
    def work(batches):
        for b in batches:
            for batch, words, a, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), *(_lists(b.column(k)) for k in (2, 3))):
                order, at = _word_parts(words, parts)
                each = words.split(b" ")
                used = [(p, order[i:j]) for p, (i, j) in enumerate(zip(at[:-1], at[1:])) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in used], pa.int32()), pa.array([batch] * len(used), pa.int64()),
                     pa.array([b" ".join([each[k] for k in x]) for _, x in used], pa.binary()),
                     *(pa.array([_pack(c[x].astype(np.int64)) for _, x in used], pa.binary()) for c in (a, h))],
                    names=["part", "batch", "words", "a", "h"])

    return work


#: What ``_sum_words`` tells: to every batch the numbers and counts of its words; in a row without batch, of the part's
#: distinct words, how many are known from training, how many are classes and the largest number, and of those outside
#: the classes how many are known and, by the count ``other_a``, the sum of h and how many.
WORD_SUMS = ("batch long, part int, number binary, a binary, h binary, known long, classes long, top long, other_known long, "
             "other_a array<long>, other_h array<long>, other_types array<long>")


def _sum_words(parts: int, least: float):
    """The words of one part: their numbers and corpus counts (``WORD_SUMS``); a word seen more than ``least`` times is a class."""
    def work(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        lists = pc.split_pattern(table["words"].combine_chunks(), " ")
        ends = np.cumsum(pc.list_value_length(lists).to_numpy())[:-1]
        coded = lists.flatten().dictionary_encode()
        del lists
        word, size = coded.indices.to_numpy(), len(coded.dictionary)
        a, h = (np.bincount(word, weights=np.concatenate([_unpack(x) for x in table[c].to_pylist()]), minlength=size).astype(np.int64)
                for c in ("a", "h"))  # exact below 2 ** 53
        is_class = (a + h > least) | (pc.binary_length(coded.dictionary).to_numpy() == 0)
        number = np.where(is_class, (np.arange(size) + START + 1) * parts + part, OTHER)
        other_a, kind = np.unique(a[~is_class], return_inverse=True)
        sums = {"batch": [*table["batch"].to_pylist(), None], "part": [part] * (len(table) + 1)}
        for name, x in (("number", number), ("a", a), ("h", h)):
            sums[name] = [*(_pack(y) for y in np.split(x[word], ends)), None]
        totals = {"known": int((a + h > 0).sum()), "classes": int(is_class.sum()), "top": int(number.max()),
                  "other_known": int(((a + h > 0) & ~is_class).sum()), "other_a": other_a.tolist(),
                  "other_h": np.bincount(kind, weights=h[~is_class], minlength=len(other_a)).astype(np.int64).tolist(),
                  "other_types": np.bincount(kind, minlength=len(other_a)).tolist()}
        types = [pa.int64(), pa.int32(), *[pa.binary()] * 3, *[pa.int64()] * 4, *[pa.list_(pa.int64())] * 3]
        sums |= {n: [None] * len(table) + [x] for n, x in totals.items()}
        return pa.table([pa.array(x, t) for x, t in zip(sums.values(), types)], names=list(sums))

    return work


def _numbered(parts: int):
    """For every word of a batch and then the start of a text: its number in the corpus and its counts."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        order, _ = _word_parts(left["words"][0].as_py(), parts)
        answers = right["part"].to_pylist()
        columns = {}
        for name, start in (("number", START), ("a", 0), ("h", 0)):
            by_part = dict(zip(answers, right[name].to_pylist()))
            x = np.full(len(order) + 1, start, np.int64)
            x[order] = np.concatenate([_unpack(by_part[p]) for p in sorted(by_part)])
            columns[name] = pa.array([_pack(x)], pa.binary())
        return pa.table({"batch": left["batch"], **columns})

    return work


def _before(sizes: np.ndarray, tokens: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """(word before every token, place of each text's first token); the start of a text is the word ``start``."""
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    before = np.concatenate(([0], tokens[:-1]))
    before[starts] = start
    return before, starts


def _keys(number: np.ndarray, before: np.ndarray, tokens: np.ndarray, base: int) -> np.ndarray:
    """A key of every pair (number before, number), unique in the corpus: numbers are below ``base`` <= 2 ** 32."""
    number = number.astype(np.uint64)
    return number[before] * np.uint64(base) + number[tokens]


def _parts(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(order of sorted keys by part, where each part begins in it and the end)."""
    part = (keys * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))


def _batch_pairs(base: int, parts: int):
    """Per batch and part: the batch's distinct pairs as differences of sorted keys, and their counts."""
    def work(batches):
        for b in batches:
            for batch, number, folds, sizes, tokens in zip(b.column(0).to_pylist(), map(_unpack, b.column(1).to_pylist()),
                                                           *(_lists(b.column(k)) for k in (2, 3, 4))):
                before, _ = _before(sizes, tokens, len(number) - 1)
                keys, pair = np.unique(_keys(number, before, tokens, base), return_inverse=True)
                fold = np.repeat(folds, sizes)
                counts = [np.bincount(pair[k], minlength=len(keys)) for k in ((fold != HELD_OUT_FOLD) & (fold != WEIGHT_FOLD), fold == WEIGHT_FOLD)]
                order, at = _parts(keys, parts)
                used = [(p, order[i:j]) for p, (i, j) in enumerate(zip(at[:-1], at[1:])) if j > i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p for p, _ in used], pa.int32()), pa.array([batch] * len(used), pa.int64()),
                     pa.array([_pack(np.diff(keys[x], prepend=np.uint64(0))) for _, x in used], pa.binary()),
                     *(pa.array([_pack(c[x]) for _, x in used], pa.binary()) for c in counts)],
                    names=["part", "batch", "keys", "a", "h"])

    return work


def _sum_pairs(table: pa.Table) -> pa.Table:
    """The pairs of one part: every batch gets the corpus counts of its pairs, in the order in which it sent them."""
    keys = [np.cumsum(_unpack(k).view(np.uint64), dtype=np.uint64) for k in table["keys"].to_pylist()]
    ends = np.cumsum([len(k) for k in keys])[:-1]
    distinct, pair = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    sums = []
    for name in ("a", "h"):
        own = np.concatenate([_unpack(x) for x in table[name].to_pylist()])
        total = np.bincount(pair, weights=own, minlength=len(distinct)).astype(np.int64)  # exact below 2 ** 53
        sums.append(pa.array([_pack(x) for x in np.split(total[pair], ends)], pa.binary()))
    return pa.table({"batch": table["batch"], "part": table["part"], "a": sums[0], "h": sums[1]})


def _pair_counts(keys: np.ndarray, parts: int, answers: pa.Table) -> list[np.ndarray]:
    """The corpus counts a and h of a batch's sorted distinct pairs, from the answers of the parts."""
    order, _ = _parts(keys, parts)
    out = []
    for name in ("a", "h"):
        by_part = dict(zip(answers["part"].to_pylist(), answers[name].to_pylist()))
        x = np.empty(len(keys), np.int64)
        x[order] = np.concatenate([_unpack(by_part[p]) for p in sorted(by_part)])
        out.append(x)
    return out


def buckets_of(context: np.ndarray) -> np.ndarray:
    """The frequency bucket of a context (0: never seen; k: seen 2^(k-1) to 2^k - 1 times)."""
    return np.ceil(np.log2(1 + context)).astype(np.int64)


def _events(base: int, parts: int, tokens_a: int, other_a: int, texts_a: int):
    """Per batch: the tokens of its weight fold as (bucket, estimates of orders 2 and 1, how many)."""
    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        number, a, folds, sizes, tokens = _one_batch(left, "number", "a")
        before, _ = _before(sizes, tokens, len(number) - 1)
        keys, pair = np.unique(_keys(number, before, tokens, base), return_inverse=True)
        seen = np.where(number == OTHER, other_a, a)
        seen[-1] = texts_a
        held = np.repeat(folds, sizes) == WEIGHT_FOLD
        both = _pair_counts(keys, parts, right)[0][pair[held]]
        context, word = seen[before[held]], seen[tokens[held]]
        rows = pa.table({"bucket": buckets_of(context), "order2": both / np.maximum(context, 1), "order1": word / max(tokens_a, 1)})
        out = rows.group_by(["bucket", "order2", "order1"]).aggregate([([], "count_all")])
        return pa.table([out[x].cast(t) for x, t in (("bucket", pa.int32()), ("order2", pa.float64()), ("order1", pa.float64()),
                                                     ("count_all", pa.int64()))], names=["bucket", "order2", "order1", "n"])

    return work


def em_step(w: np.ndarray, new: np.ndarray) -> np.ndarray:
    """The next weights (bucket x estimate), given the share of the held-out counts that fell to each."""
    total = new.sum(axis=1, keepdims=True)
    w = np.where(total > 0, np.maximum(new / np.maximum(total, 1e-300), FLOOR), w)
    return w / w.sum(axis=1, keepdims=True)


def learn_weights(events: DataFrame, order0: float) -> tuple[np.ndarray, np.ndarray]:
    """(Mixture weights of orders 2, 1 and 0 of every bucket, buckets with events) that maximise the likelihood of
    the held-out events: as ``em``, with the sums of a round taken over all events by Spark."""
    seen = np.array(sorted(r[0] for r in events.select("bucket").distinct().collect()), np.int64)  # at most 64 buckets
    w = np.full((int(seen.max(initial=0)) + 1, 3), 1 / 3)
    for _ in range(ROUNDS if len(seen) else 0):
        part = [F.get(F.array(*[F.lit(float(x)) for x in w[:, j]]), F.col("bucket")) * e
                for j, e in enumerate((F.col("order2"), F.col("order1"), F.lit(order0)))]
        rows = events.select("bucket", "n", *[p.alias(f"p{j}") for j, p in enumerate(part)])
        share = F.col("n") / F.greatest(F.col("p0") + F.col("p1") + F.col("p2"), F.lit(1e-300))
        new = np.zeros_like(w)
        for r in rows.groupBy("bucket").agg(*[F.sum(F.col(f"p{j}") * share) for j in range(3)]).collect():
            new[r[0]] = r[1:]
        w = em_step(w, new)
    return w, seen


def em(estimates: np.ndarray, bucket: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Mixture weights (bucket x estimate) that maximise the likelihood of the held-out counts."""
    buckets, k = int(bucket.max(initial=0)) + 1, estimates.shape[1]
    w = np.full((buckets, k), 1.0 / k)
    for _ in range(ROUNDS):
        part = w[bucket] * estimates
        part *= (held / np.maximum(part.sum(axis=1), 1e-300))[:, None]
        new = np.stack([np.bincount(bucket, weights=part[:, j], minlength=buckets) for j in range(k)], axis=1)
        w = em_step(w, new)
    return w


def pair_estimates(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From counts (class before x class): maximum-likelihood estimates of orders 2, 1 and 0 of every
    cell, and the frequency bucket of every context."""
    context = counts.sum(axis=1, keepdims=True)
    unigram = counts.sum(axis=0) / max(counts.sum(), 1)
    p = np.stack([counts / np.maximum(context, 1), np.broadcast_to(unigram, counts.shape),
                  np.full(counts.shape, 1.0 / (counts.shape[1] - 1))], axis=2)  # no token is the start
    return p, buckets_of(context[:, 0])


def fill_weights(w: np.ndarray, seen: np.ndarray, top: int) -> np.ndarray:
    """Weights of the buckets 0 to ``top``: one without held-out events takes those of the nearest lower bucket that has some."""
    filled = np.full((max(top, len(w) - 1) + 1, 3), np.nan)
    filled[seen] = w[seen]
    filled[0] = np.where(np.isnan(filled[0]), (FLOOR, 0.5, 0.5 - FLOOR), filled[0])
    for k in range(1, len(filled)):
        if np.isnan(filled[k]).any():
            filled[k] = filled[k - 1]
    return filled


def class_model(a: np.ndarray, h: np.ndarray) -> np.ndarray:
    """log10 P(class | class before) as a table, for few classes: weights learned from held-out counts ``h`` against
    counts ``a``, then used with all counts.  The last class is the start of a text."""
    p, bucket = pair_estimates(a)
    cells = np.flatnonzero(h)
    seen = bucket[cells // len(a)]
    w = em(p.reshape(-1, 3)[cells], seen, h.ravel()[cells])
    q, bucket = pair_estimates(a + h)
    return np.log10((q * fill_weights(w, np.unique(seen), int(bucket.max()))[bucket][:, None, :]).sum(axis=2))


def _scores(base: int, parts: int, weights: np.ndarray, weight: float, total: int, distinct: int, classes: int,
            other_total: int, other_distinct: int, texts: int):
    """doc_id, held_out, tokens, known tokens, base score and score of every text of a batch, given the counts of its pairs."""
    floor = np.log10(total + 0.5 * (distinct + 1))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        number, a, h, folds, sizes, tokens = _one_batch(left, "number", "a", "h")
        before, starts = _before(sizes, tokens, len(number) - 1)
        keys, pair = np.unique(_keys(number, before, tokens, base), return_inverse=True)
        both = sum(_pair_counts(keys, parts, right)).astype(np.int64)
        del keys
        t = a + h
        known, per_word = t > 0, np.log10(t + 0.5) - floor
        word = np.where(number == OTHER, np.log10(weight * t / max(other_total, 1) + (1 - weight) / (other_distinct + 1)), 0.0)
        seen = np.where(number == OTHER, other_total, t)
        seen[-1] = texts
        mix = weights[buckets_of(seen)]
        order2, order1, order0 = mix[:, 0] / np.maximum(seen, 1), seen / max(total, 1), mix[:, 2] / (classes + 1)
        out = []
        ends = np.cumsum(sizes)
        cuts = [0, *(np.flatnonzero(np.diff(ends // SLICE)) + 1).tolist(), len(sizes)]
        for i, j in zip(cuts, cuts[1:]):  # some texts at a time: bounds what is held per token
            at = slice(starts[i], ends[j - 1])
            v, w = before[at], tokens[at]
            model = np.log10(order2[v] * both[pair[at]] + mix[v, 1] * order1[w] + order0[v]) + word[w]
            out.append([np.add.reduceat(x, starts[i:j] - starts[i]) for x in (known[w].astype(np.int64), per_word[w], model)])
        ids = left["ids"].combine_chunks().flatten()
        return pa.table([ids, pa.array(folds == HELD_OUT_FOLD), pa.array(sizes.astype(np.int64)),
                         *(pa.array(np.concatenate(x)) for x in zip(*out))],
                        names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return work


def _bucketed(df: DataFrame, buckets: int, name: str) -> DataFrame:
    """``df`` written in buckets of ``batch`` in the shared scratch folder and read back: joins on the batch do not move it."""
    spark, table = df.sparkSession, f"tessera_lm_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "batch").option("path", scratch_path(spark, name)).option("compression", "zstd").saveAsTable(table)
    out = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the files stay
    return out


def score_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts are lower-cased (A-Z), tokens are words and one end.  Null texts are
    empty (the end alone).  A null id counts as the empty text in the fold's
    checksum.  Repeated rows each count in the training and get a row each.
    Empty table: empty result.
    """
    spark = df.sparkSession
    src = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary").alias("text"))
    id_type = dict(src.dtypes)["doc_id"]
    texts = src.select("doc_id", fold_of(F.col("doc_id")).alias("fold"), "text")
    buckets = 2 * max(1, texts.rdd.getNumPartitions())
    batches = _bucketed(texts.mapInArrow(
        _batches, f"batch long, words binary, distinct long, a array<int>, h array<int>, ids array<{id_type}>, folds array<int>, "
                  "sizes array<int>, tokens array<int>"), buckets, "lm-batches")

    def total(c: str) -> Column:
        return F.sum(F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x))

    def texts_of(test) -> Column:
        return F.sum(F.size(F.filter("folds", test)))

    of = batches.agg(total("a").alias("a"), total("h").alias("h"), total("sizes").alias("tokens"), F.sum("distinct").alias("words"),
                     texts_of(lambda f: (f != HELD_OUT_FOLD) & (f != WEIGHT_FOLD)).alias("texts_a"),
                     texts_of(lambda f: f != HELD_OUT_FOLD).alias("texts")).first().asDict()
    of = {k: int(v or 0) for k, v in of.items()}
    tokens = of["a"] + of["h"]
    word_parts, parts = (slots_for(of[k], n) for k, n in (("words", PART_WORDS), ("tokens", PART_PAIRS)))

    words = keep(spark, batches.select("batch", "words", "a", "h").mapInArrow(
        _batch_words(word_parts), "part int, batch long, words binary, a binary, h binary").groupBy("part").applyInArrow(
        _sum_words(word_parts, tokens * CLASS_SHARE), WORD_SUMS), "lm-words")
    types = words.where("batch is null")
    known, classes, top, other_known = (int(x or 0) for x in types.agg(*map(F.sum, ("known", "classes")), F.max("top"), F.sum("other_known")).first())
    base = top + START + 1
    if base > 1 << 32:
        raise ValueError(f"{known} distinct words: a word's number takes more than 32 bits")
    # words outside the classes: how many have each count, and how often they occur in the weight fold
    by_count = (types.select(F.explode(F.arrays_zip("other_a", "other_h", "other_types")).alias("o")).groupBy(F.col("o.other_a").alias("a"))
                .agg(F.sum("o.other_h").alias("h"), F.sum("o.other_types").alias("types")).toPandas())
    n, held, kinds = (by_count[c].to_numpy(np.float64) for c in ("a", "h", "types"))
    estimates = np.stack([n / max((n * kinds).sum(), 1), np.full(len(n), 1.0 / (kinds[n > 0].sum() + 1))], axis=1)
    weight = float(em(estimates, np.zeros(len(n), np.int64), held)[0, 0]) if held.sum() else 0.5
    other_a, other_total = int((n * kinds).sum()), int((n * kinds).sum() + held.sum())
    if not other_total:  # no such word in training: the unknown word is all of class 0
        weight = 0.0

    def by_batch(df: DataFrame):
        return df.repartition(buckets, "batch").groupBy("batch")

    numbers = _bucketed(batches.select("batch", "words").groupBy("batch").cogroup(
        by_batch(words.where("batch is not null").select("batch", "part", "number", "a", "h"))).applyInArrow(
        _numbered(word_parts), "batch long, number binary, a binary, h binary"), buckets, "lm-numbers")
    both = batches.select("batch", "ids", "folds", "sizes", "tokens").join(numbers.hint("merge"), "batch")
    sums = keep(spark, both.select("batch", "number", "folds", "sizes", "tokens").mapInArrow(
        _batch_pairs(base, parts), "part int, batch long, keys binary, a binary, h binary").groupBy("part").applyInArrow(
        _sum_pairs, "batch long, part int, a binary, h binary"), "lm-pairs")

    def joined(work, schema: str) -> DataFrame:
        return both.groupBy("batch").cogroup(by_batch(sums)).applyInArrow(work, schema)

    events = keep(spark, joined(_events(base, parts, of["a"], other_a, of["texts_a"]), "bucket int, order2 double, order1 double, n long")
                  .groupBy("bucket", "order2", "order1").agg(F.sum("n").alias("n")), "lm-events")
    w, seen = learn_weights(events, 1.0 / (classes + 1))
    weights = fill_weights(w, seen, int(buckets_of(np.array(max(tokens, of["texts"])))))
    scored = joined(_scores(base, parts, weights, weight, tokens, known, classes, other_total, other_known, of["texts"]),
                    f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")
