import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.edge import empty, frame, got, rows
from tessera.llm import components, exact_dedup, quality, simhash, substring

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- quality rules ---------------------------------------------------------------------------
def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if grams[tuple(words[i:i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(inside),
            len(words) < 20 or 100 * len(inside) > 30 * len(words))


def test_quality_brute_force_and_edges(spark):
    rng = random.Random(5)
    data = rows() + [(100 + k, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for k in range(40)]
    data += [(200, "x " * 30), (201, "\n".join(["the same line of words here"] * 5)), (202, "a | b # c")]
    df = frame(spark, data=data)
    res = got(quality.quality_report(df), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter(res) == Counter((i, *brute_quality(t)) for i, t in data)
    kept = quality.quality_report(df).where("kept")
    assert kept.where("base_failed").count() == 0
    assert quality.filter_quality(df).columns == df.columns
    assert quality.filter_quality(df).count() == kept.count() > 0
    assert quality.quality_report(empty(spark)).count() == 0 and quality.filter_quality(empty(spark)).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    clean = "The plan of the day was set by the group and it is for all of us to read with care in the end of it."
    junk = ["| menu | of | the | page | home | news | sport | tech | more | help | login | terms | legal | privacy | jobs | x | y | z | w | v",
            "WIN!! NOW!! THE!! BIG!! OF!! ALL!! TIME!! PRIZE!! FOR!! YOU!! AND!! ME!! TO!! DAY!! IS!! THE!! DAY!! GO!! GO!! NOW!!",
            "same words of the text again and " * 10]
    df = frame(spark, data=[(1, clean), *enumerate(junk, 2)])
    assert got(quality.quality_report(df).where("kept"), "doc_id") == [(1,)]


# ---- exact dedup --------------------------------------------------------------------------------
def brute_exact(data, largest=True):
    groups = defaultdict(list)
    for i, t in data:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        real = [i for i in ids if i is not None]
        keep = (max(real) if largest else min(real)) if real else None
        once = False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not once, hashlib.sha256(t.encode()).hexdigest()))
            once |= i == keep
    return Counter(out)


@pytest.mark.parametrize("largest", [True, False])
def test_exact_groups(spark, largest):
    data = rows() + [(1000 + k, "hot text") for k in range(300)] + [(1000, "hot text")]
    df = frame(spark, data=data).repartition(5)
    assert Counter(got(exact_dedup.exact_groups(df, keep_largest=largest))) == brute_exact(data, largest)
    kept = exact_dedup.drop_exact_copies(df, keep_largest=largest)
    assert kept.columns == df.columns
    assert kept.count() == len({t or "" for _, t in data})
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_exact_normalised(spark):
    from pyspark.sql import functions as F
    df = frame(spark, data=[(1, "A b"), (2, "a B"), (3, "c")])
    assert got(exact_dedup.exact_groups(df, normalise=F.lower), "doc_id", "keep_id", "kept") == [(1, 2, False), (2, 2, True), (3, 3, True)]


# ---- SimHash -----------------------------------------------------------------------------------
def brute_fp(text, size=3):
    w = [x.lower() for x in WORD.findall(text or "".encode().decode())] if text else []
    w = [re.sub(r"[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text)] if text else []
    s = [" ".join(w[i:i + size]) for i in range(len(w) - size + 1)] if len(w) >= size else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(values, radius):
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= radius and label[i] != label[j]:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_simhash_brute_force(spark):
    rng = random.Random(9)
    base = ["w%d" % rng.randint(0, 400) for _ in range(300)]
    data = rows() + [(300 + k, " ".join([*base[:rng.randint(0, 4)], *base[4:]][:rng.randint(295, 300)])) for k in range(60)]
    fps = [brute_fp(t) for _, t in data]
    label = brute_components(fps, 2)
    low = {c: min((i for (i, _), x in zip(data, label) if x == c and i is not None), default=None) for c in set(label)}
    res = got(simhash.near_duplicates(frame(spark, data=data)), "doc_id", "fingerprint", "component_id")
    assert Counter(res) == Counter((i, f"{f:016x}", low[c]) for (i, _), f, c in zip(data, fps, label))
    kept = simhash.keep_one_per_component(frame(spark, data=data))
    assert sorted(x for (x,) in got(kept.where("doc_id is not null"), "doc_id")) == sorted(
        [i for i in {x for x in low.values() if x is not None}] + ([10] if 10 in low.values() and list(low.values()).count(10) > 1 else []))
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_one_row_of_each_component_stays_by_id_and_text(spark):
    rng = random.Random(12)
    text = [" ".join("k%d" % rng.randint(0, 10 ** 6) for _ in range(60)) for _ in range(12)]
    data = [(1, text[0]), (None, text[0]), (None, ""), (2, None), (2, ""), (None, text[1]), (None, text[1]), (None, text[2]),
            (10, text[3]), (11, text[3]), (9, text[4]), (10, text[4]), (12, text[5]), (12, text[6]), (13, text[7]), (13, text[7]),
            *[(None, t) for t in text[8:]], *[(20 + k, t) for k, t in enumerate(text[8:10])]]
    want = [(1, text[0]), (2, None), (None, text[1]), (None, text[2]), (10, text[3]), (9, text[4]), (12, text[5]), (12, text[6]),
            (13, text[7]), (20, text[8]), (21, text[9]), (None, text[10]), (None, text[11])]
    assert Counter(got(simhash.keep_one_per_component(frame(spark, data=data).repartition(3)), "doc_id", "text")) == Counter(want)
    # rows() too, against components of brute-force fingerprints
    data = rows()
    label = brute_components([brute_fp(t) for _, t in data], 2)
    def rank(r):
        return r[0] is None, r[0] or 0, r[1] is not None, hashlib.sha256((r[1] or "").encode()).digest()
    want = [min((r for r, x in zip(data, label) if x == c), key=rank) for c in set(label)]
    assert Counter(got(simhash.keep_one_per_component(frame(spark, data=data)), "doc_id", "text")) == Counter(want)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2 ** 64 - 1), min_size=1, max_size=12), st.integers(0, 10 ** 6), st.integers(0, 4))
def test_bk_tree_links_span_all_links(seeds, salt, radius):
    rng = random.Random(salt)
    values = sorted({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(6)})
    links = simhash.spanning_links(np.array(values, np.uint64), radius)
    assert len(links) < len(values)
    label = list(range(len(values)))
    for a, b in links:
        x, y = label[a], label[b]
        label = [min(x, y) if z in (x, y) else z for z in label]
    assert label == brute_components(values, radius)


def test_large_shards_are_divided_exactly(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    values = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for _ in range(250)} | {rng.getrandbits(64) for _ in range(50)})
    signed = [v - 2 ** 64 if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.fingerprint_links(fps, radius=2, max_tree=20)
    roots = dict(got(components.components(links)))
    label = brute_components(values, 2)
    groups = defaultdict(set)
    for v, c in zip(signed, label):
        groups[c].add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len(groups) == len({roots.get(v, v) for v in signed})


@pytest.mark.parametrize("shard", [64, 100_000])
def test_shards_of_every_size_find_all_links(spark, shard):
    rng = np.random.default_rng(8)
    values = rng.integers(0, 2 ** 64, 4000, dtype=np.uint64)
    for k in range(0, 2000, 2):  # a partner at 1 to 4 bits
        values[k + 1] = values[k] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 1 + k // 2 % 4, replace=False)))
    values = np.unique(values)
    near = [(i, i + 1 + int(j)) for i in range(len(values)) for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= 2)]
    fps = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    links = got(simhash.fingerprint_links(fps, radius=2, shard=shard))
    want = {frozenset((int(values[i].view(np.int64)), int(values[j].view(np.int64)))) for i, j in near}
    assert len(want) >= 500 and {frozenset(r) for r in links} == want


def test_components_long_chain(spark):
    edges = [(k, k + 1) for k in range(60)] + [(100, 101), (5, 5), (101, 100)]
    assert dict(got(components.components(spark.createDataFrame(edges, "a long, b long")))) == {
        **{k: 0 for k in range(61)}, 100: 100, 101: 100}


# ---- substring dedup ------------------------------------------------------------------------------
def brute_units(text, least):
    """(start, end, words) of every unit, found by trying all runs of sentences."""
    def words(a, b):
        return len(text[a:b].split())
    lines, at = [], 0
    for line in text.split("\n"):
        lines.append((at, at + len(line)))
        at += len(line) + 1
    pieces, spans = [], set()
    for a, b in lines:
        if words(a, b) >= least:
            spans.add((a, min(b + 1, len(text))))
        cuts = [a] + [k for k in range(a + 1, b) if text[k] not in " \t\r\v\f" and re.search(r"[.!?][ \t\r\v\f]+$", text[a:k])]
        if re.search(r"[.!?][ \t\r\v\f]+$", text[a:b]):
            cuts.append(b)
        cuts.append(b)
        for s, e in zip(cuts, cuts[1:]):
            if words(s, e):
                pieces.append((s, e, s == a, e == b))
                if words(s, e) >= least and len(cuts) > 2:
                    spans.add((s, e))
    for i in range(len(pieces)):
        for j in range(i + 1, len(pieces)):
            n = [words(*p[:2]) for p in pieces[i:j + 1]]
            if max(n) >= least:
                break
            if sum(n) >= least and min(sum(n[1:]), sum(n[:-1])) < least:
                spans.add((pieces[i][0], min(pieces[j][1] + (pieces[i][2] and pieces[j][3]), len(text))))
    at = 0
    for end in [m.end() for m in re.finditer(r"\n[^\S\n]*\n", text)] + [len(text)]:
        n = [len(x.split()) for x in text[at:end].split("\n")]
        if sum(n) >= 3 * least and any(0 < x < least for x in n):
            spans.add((at, end))
        at = end
    first, out = {}, []
    for a, b in sorted(spans, key=lambda x: (x[0], -x[1])):
        key = tuple(text[a:b].lower().split())
        if key not in first or a >= first[key]:
            out.append((a, b, key))
        first.setdefault(key, b)
    return out


def brute_substring(data, least=8, run=20):
    """Documents in rank order (null ids last); a unit stays at its first occurrence, and so do short runs of repeats."""
    first = {}
    units = {}
    for i, t in data:
        if t:
            units[(i, t)] = brute_units(t, least)
    for (i, t), found in units.items():
        for a, b, key in found:
            rank = (i is None, i or 0)
            if key not in first or rank < first[key]:
                first[key] = rank
    out = []
    for i, t in data:
        if not t:
            out.append((i, t))
            continue
        mark, seen = [0] * len(t), set()
        for a, b, key in units[(i, t)]:
            if first[key] != (i is None, i or 0) or key in seen:
                mark[a:b] = [1] * (b - a)
            seen.add(key)
        kept, k = [], 0
        while k < len(t):
            e = k
            while e < len(t) and mark[e] == mark[k]:
                e += 1
            if not mark[k] or len(t[k:e].split()) < run:
                kept.append(t[k:e])
            k = e
        out.append((i, "".join(kept)))
    return Counter(out)


def test_substring_brute_force(spark):
    rng = random.Random(4)
    sents = [" ".join(rng.choice(["alpha", "beta", "of", "the", "gamma"]) + str(rng.randint(0, 99)) for _ in range(rng.randint(3, 14))) + "."
             for _ in range(40)]
    data = rows() + [(500 + k, "".join(rng.choice(sents) + rng.choice([" ", "\n", "  \n"]) for _ in range(rng.randint(1, 12)))) for k in range(60)]
    df = frame(spark, data=data).repartition(4)
    out = substring.remove_repeats(df, removed_col="removed")
    assert out.columns == [*df.columns, "removed"]
    assert Counter(got(out, "doc_id", "text")) == brute_substring(data)
    by = defaultdict(list)
    for i, t in data:
        by[i].append(t)
    for i, text, spans in (tuple(r) for r in out.select("doc_id", "text", "removed").collect()):
        if i is not None and len(by[i]) == 1 and by[i][0]:
            src = by[i][0]
            gone = {k for s in spans for k in range(s["start"], s["start"] + s["length"])}
            assert "".join(c for k, c in enumerate(src) if k not in gone) == text
    assert substring.remove_repeats(empty(spark)).count() == 0


def test_substring_planted_passage_and_clean_text(spark):
    rng = random.Random(8)
    def text(n):
        return " ".join("q%d" % rng.randint(0, 10 ** 6) for _ in range(n)) + "."
    passage = " ".join(text(12) for _ in range(6))
    clean = [text(30) + "\n" + text(9) for _ in range(5)]
    data = [(k, f"{text(20)}\n{passage}\n{text(15)}") for k in range(4)] + [(10 + k, t) for k, t in enumerate(clean)]
    out = dict(got(substring.remove_repeats(frame(spark, data=data)), "doc_id", "text"))
    assert passage in out[0] and all(passage not in out[k] for k in (1, 2, 3))
    assert [out[10 + k] for k in range(5)] == clean


def test_repeats_of_few_words_stay(spark):
    rng = random.Random(3)
    def words(n):
        return " ".join("r%d" % rng.randint(0, 10 ** 6) for _ in range(n)) + "."
    chance, ten, passage = words(13), [words(10), words(10)], " ".join(words(9) for _ in range(7))
    data = [(k, f"{words(20)} {chance} {words(20)}\n{ten[0]}\n{words(12)}\n{ten[1]}\n{words(9)}\n{passage} {words(5)}") for k in range(3)]
    data += [(8, chance), (9, f"{words(9)}\n{ten[0]}\n{ten[1]}\n{words(9)}")]
    df = frame(spark, data=data)
    out = dict(got(substring.remove_repeats(df), "doc_id", "text"))
    assert out[0] == data[0][1] and out[8] == chance
    for k in (1, 2):
        assert chance in out[k] and ten[0] in out[k] and ten[1] in out[k]
        assert not set(passage.split()) & set(out[k].split())
    assert ten[0] not in out[9] and ten[1] not in out[9]  # twenty words together
    assert chance not in dict(got(substring.remove_repeats(df, min_run=0), "doc_id", "text"))[1]


def test_units_cover_lines_and_sentences():
    text = "One two three four five six seven eight. Nine ten.\nshort line\nA b c d e f g h"
    spans = [(a, b) for a, b, _ in substring.unit_spans(text)]
    assert spans == [(0, 51), (0, 41), (62, 77)]
    assert text[62:77] == "A b c d e f g h"


def test_substring_passages_of_short_lines_and_spliced_sentences(spark):
    rng = random.Random(21)
    def words(n):
        return " ".join("z%d" % rng.randint(0, 10 ** 6) for _ in range(n))
    lines = "\n".join(words(6) for _ in range(10))  # 60 words, no line of 8
    uneven = "\n".join(words(n) for n in (7, 1, 1, 5, 2, 7, 7, 1, 7, 6, 7, 1))
    short = " ".join(words(5) + "." for _ in range(11))  # 55 words, no sentence of 8
    paragraph = "\n".join(words(n) for n in (30, 3, 20))
    data = []
    for k in range(4):
        own = [words(20) + "." for _ in range(8)]
        data.append((k, f"{own[0]}\n{lines}\n{own[1]}\n{uneven}\n{own[2]} {short} {own[3]}\n\n{paragraph}\n\n{own[4]}"))
    data += [(10, f"{words(3)}\n{lines}\n{words(2)}"), (11, f"{words(30)} {words(3)}. {short} {words(2)}."), (12, paragraph)]
    data += [(20, "Eight words of one line and no more.  \n" + words(9)), (21, "a b c d\n" * 3)]
    out = dict(got(substring.remove_repeats(frame(spark, data=data)), "doc_id", "text"))
    assert out[0] == data[0][1] and out[20] == data[7][1] and out[21] == data[8][1]
    parts = {w for p in (lines, uneven, short, paragraph) for w in p.replace(".", "").split()}
    for i, t in data[1:7]:
        assert [w for w in out[i].split() if w.rstrip(".") in parts] == []
        assert out[i].split() == [w for w in t.split() if w.rstrip(".") not in parts]


def test_every_removed_sentence_stays_somewhere(spark):
    rng = random.Random(17)
    sents = [" ".join("y%d_%d" % (s, k) for k in range(rng.randint(1, 10))) + "." for s in range(12)]
    data = [(k, "".join(rng.choice(sents) + rng.choice([" ", "\n", "\n\n", "  \n"]) for _ in range(rng.randint(1, 25)))) for k in range(60)]
    out = got(substring.remove_repeats(frame(spark, data=data)), "doc_id", "text")
    assert {w for _, t in out for w in t.split()} == {w for _, t in data for w in t.split()}
    assert Counter(out) == brute_substring(data)
