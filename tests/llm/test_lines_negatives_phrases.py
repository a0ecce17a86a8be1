import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import bloom, collocations, exact_dedup, hard_negatives, line_dedup
from tests.llm.edge import empty, frame, got, rows


# ---- Bloom filters ----------------------------------------------------------------------------
@pytest.mark.parametrize("power", [0, 3])
def test_two_filters_hold_every_repeat(power):
    rng = np.random.default_rng(1)
    codes = rng.integers(1, 1 << 63, 30000).astype(np.uint64)
    own = codes[bloom.segment_of(codes, power) == 0]
    two = bloom.TwoFilters(power)
    two.add(own[:1000], np.arange(1000) < 10)
    two.add(own[500:2000], np.zeros(1500, bool))
    seen = two.seen_twice(own)
    assert seen[:10].all() and seen[500:1000].all()
    assert seen[10:500].sum() + seen[1000:].sum() <= 2
    whole = np.concatenate([bloom.segment_filter(codes[:20000][bloom.segment_of(codes[:20000], power) == k], power) for k in range(1 << power)])
    hit = bloom.contains(whole, power, codes)
    assert hit[:20000].all() and hit[20000:].sum() < 60


# ---- lines --------------------------------------------------------------------------------------
def brute_lines(data, min_chars=20, min_docs=3):
    def keys(text):
        return [re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\x0b\x0c\r")) for x in (text or "").split("\n")]
    docs = defaultdict(set)
    for i, t in data:
        for k in keys(t):
            if len(k) >= min_chars:
                docs[k].add(i)
    out = []
    for i, t in data:
        lines = (t or "").split("\n")
        gone = [len(docs.get(k, ())) >= min_docs and i != max(docs[k], key=lambda d: (d is not None, d or 0)) for k in keys(t)]
        text = "\n".join(x for x, g in zip(lines, gone) if not g)
        out.append((i, len(lines), sum(gone), text))
    return Counter(out)


def line_data():
    rng = random.Random(4)
    pool = [" ".join(rng.choice(["Übung", "delta", "krone", "alpha", "of", "the"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    data = rows() + [(100 + k, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice(pool).title() + rng.choice(["", "  ", "\r"])
                                         for _ in range(rng.randint(0, 12)))) for k in range(120)]
    hot = "A very frequent line of the corpus"
    data += [(1000 + k, f"{hot}\nown line number {k} of the document\n{hot.upper()} ") for k in range(200)]
    return data + [(None, hot + "\nabc"), (None, "x\n" + hot), (1005, hot), (1005, hot), (7, "\n\n"), (8, "é" * 19), (9, "é" * 20)] + [
        (2000 + k, "é" * 20) for k in range(3)]


@pytest.mark.parametrize("limit", [line_dedup.BROADCAST_BYTES, 0])
def test_line_dedup_brute_force(spark, limit):
    data = line_data()
    df = frame(spark, data=data).withColumn("n_lines", F.lit("clash")).repartition(5)
    out = line_dedup.dedup_lines(df, broadcast_bytes=limit)
    assert Counter(got(out, "doc_id", "n_lines", "n_dropped", "text")) == brute_lines(data)
    assert set(out.columns) == {*df.columns, "n_dropped"} and out.where("hash <> 'clash'").count() == 0
    assert line_dedup.dedup_lines(empty(spark), broadcast_bytes=limit).count() == 0


def test_line_dedup_full_filters_change_nothing(spark, monkeypatch):
    """Filters with false alarms for nearly everything: more is confirmed, the result is the same."""
    monkeypatch.setattr(bloom, "BITS_PER_CODE", 12 / 5000)
    monkeypatch.setattr(line_dedup, "BATCH_DIGESTS", 7)
    data = line_data()
    out = line_dedup.dedup_lines(frame(spark, data=data))
    assert Counter(got(out, "doc_id", "n_lines", "n_dropped", "text")) == brute_lines(data)


# ---- hard negatives ------------------------------------------------------------------------------
def brute_negatives(data, is_anchor, k=5, m=10):
    def score(a, b):
        return sum(x * y for x, y in zip(a, b))
    whole = [(i, l, [int(np.floor(256 * float(x))) for x in v]) for i, v, l in data
             if i is not None and l is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for i, l, v in whole:
        if not is_anchor(i):
            continue
        pos = sorted((-score(v, w), j) for j, lab, w in whole if lab == l and j != i)[:k]
        neg = sorted((-score(v, w), j) for j, lab, w in whole if lab != l)
        for ps, p in pos:
            inside = [(ns, j) for ns, j in neg if 30 * -ps <= 100 * -ns <= 90 * -ps][:m]
            out += [(i, p, r, j, -ps, -ns) for r, (ns, j) in enumerate(inside, 1)]
    return Counter(out)


SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())),
                       T.StructField("label", T.IntegerType()), T.StructField("v", T.StringType()), T.StructField("score", T.StringType())])


@pytest.mark.parametrize("groups,block", [((2048, 32768), 8192), ((40, 40), 3)])
def test_hard_negatives_brute_force(spark, groups, block):
    rng = np.random.default_rng(3)
    data = [(k, [float(x) for x in rng.integers(-3, 4, 10) / 8], int(rng.integers(0, 4))) for k in range(300)]
    data += [(400, None, 1), (401, [1.0] * 10, None), (402, [float("nan")] * 10, 1), (403, [float("inf"), 1.0], 1), (404, [None, 1.0], 1),
             (405, [], 2), (406, [1.0, 2.0], 2), (410, [2.0] * 10, 3), (None, [1.0] * 10, 1), (420, [0.1] * 10, 77)]
    df = spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA).repartition(4)
    out = hard_negatives.mine(df, F.col("vec_id") % 10 == 0, group_rows=groups, block_rows=block)
    expect = brute_negatives(data, lambda i: i % 10 == 0)
    assert len(expect) > 500 and Counter(got(out)) == expect
    assert hard_negatives.mine(df.where("false"), F.lit(True)).count() == 0
    assert hard_negatives.mine(df, F.col("vec_id") < 0).count() == 0


def test_hard_negatives_repeated_rows(spark):
    """Repeated rows are rows of their own; equal anchor rows are one anchor; a row of the anchor's id is no positive."""
    data = [(10, [1.0, 0.0], 1)] * 2 + [(11, [1.0, 0.0], 1)] * 2 + [(12, [0.5, 0.0], 2)] * 2
    df = spark.createDataFrame([(*r, "", "") for r in data], SCHEMA)
    res = got(hard_negatives.mine(df, F.col("vec_id") == 10), "anchor_id", "positive_id", "rank", "negative_id", "negative_score")
    assert res == sorted([(10, 11, r, 12, 256 * 128) for r in (1, 2)] * 2)


def test_strassen_is_exact_past_64_bits():
    rng = np.random.default_rng(5)
    for m, k, n in ((1, 1, 1), (37, 65, 41), (128, 64, 130), (70, 33, 64)):
        a, b = rng.integers(-500, 500, (m, k)), rng.integers(-500, 500, (n, k))
        assert (hard_negatives.scores(a, b) == a @ b.T).all()
    big = rng.integers(-(1 << 62), 1 << 62, (40, 34))
    assert (hard_negatives.scores(big, big) == big.astype(object) @ big.astype(object).T).all()


# ---- collocations ---------------------------------------------------------------------------------
def brute_phrases(data, support, top):
    f, n = Counter(), Counter()
    for lang, text in data:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang in n:
        cand = {p: a for (x, p), a in f.items() if x == lang and len(p) > 1 and a >= support}
        scored = []
        for p, a in cand.items():
            if any(len(q) > len(p) and b >= a and any(q[i:i + len(p)] == p for i in range(len(q))) for q, b in cand.items()):
                continue
            s, k = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p)))
            scored.append((-s, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
        out += [(lang, r, p.decode(), -a, left, right, n[lang], -s) for r, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)]
    return out


def phrase_data():
    rng = random.Random(8)
    chunks = ["New York", "in the end of", "a b c d e", "Übung macht", "x y x y x y", "the", "of", "salt and pepper", "1.5", "zz\x0bqq", "tab\there"]
    data = [(rng.choice(["en", "en", "en", "de", None]), rng.choice([" ", ", ", ".\n", "  "]).join(
        rng.choice([*chunks, f"w{rng.randint(0, 60)}"]) for _ in range(rng.randint(0, 40)))) for _ in range(400)]
    return data + [("und", "New York " * 30), (None, None), ("fr", ""), ("it", " ,.;\n"), ("en", None), ("pt", "uma vez " * 9)]


@pytest.mark.parametrize("shard_words", [collocations.SHARD_WORDS, 150])
def test_collocations_brute_force(spark, shard_words):
    data = phrase_data()
    df = spark.createDataFrame([(i, t, lang, "clash", "clash") for i, (lang, t) in enumerate(data)],
                               "doc_id long, text string, lang string, phrase string, part string").repartition(6)
    out = collocations.collocations(df, support=12, top=25, shard_words=shard_words)
    expect = brute_phrases(data, 12, 25)
    assert len(expect) > 50 and sorted(map(tuple, out.collect())) == sorted(expect)
    assert collocations.collocations(df.where("false")).count() == 0
    assert collocations.collocations(df.where("lang = 'it'"), support=1).count() == 0


# ---- exact dedup: groups bounded by rows and bytes --------------------------------------------------
def test_exact_groups_with_many_copies_and_no_ids(spark):
    data = [(k, "one") for k in range(5000)] + [(k, "two") for k in range(63)] + [(None, "one")] * 2600 + [(4999, "one")] * 40 + [(None, "three")] * 900
    df = frame(spark, data=data).repartition(7)
    for largest in (True, False):
        res = Counter(got(exact_dedup.exact_groups(df, keep_largest=largest)))
        best = {"one": 4999 if largest else 0, "two": 62 if largest else 0, "three": None}
        size = Counter(t for _, t in data)
        assert {(r[1], r[2], r[4]) for r in res} == {(best[t], size[t], hashlib.sha256(t.encode()).hexdigest()) for t in size}
        assert sorted((str(r[0]), n) for r, n in res.items() if r[3]) == sorted((str(b), 1) for b in best.values())
    assert exact_dedup.drop_exact_copies(df).count() == 3


def test_one_row_of_each_content_stays(spark):
    df = frame(spark, data=[(5, None), (5, ""), (6, "A b"), (6, "a b"), (7, "a B")])
    assert sorted(x[0] for x in got(exact_dedup.drop_exact_copies(df), "doc_id")) == [5, 6, 6, 7]
    assert sorted(x[0] for x in got(exact_dedup.drop_exact_copies(df, normalise=F.lower), "doc_id")) == [5, 7]
