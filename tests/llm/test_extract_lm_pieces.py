import itertools
import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from tests.llm.edge import empty, frame, got, rows
from tessera.llm import extract, lm, pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")


# ---- extraction -----------------------------------------------------------------------------------
PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header><a href="/">Site name</a> <form><input name=q><button>Search</button></form></header>
<nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies on this site. Please accept them all to go on.</p></div>
<!-- <p>hidden</p> --><div class="ad">Buy the best shoes of the year now, they are cheap.</div>
<article><h1>Fish &amp; chips</h1><p>The first   paragraph of the
article is <b>long enough</b> to be text.<br>It has two sentences.<p>Second one, with a <a href="x">link</a> in it &mdash; fine.
<ul><li>first point of the list</li><li>second point of the list</li></ul><blockquote>A quoted line.</blockquote></article>
<aside class="sidebar"><h3>Related</h3><a href="/c">Another story about fish that you may like to read.</a></aside>
<section id="comments"><h2>Comments</h2><div class="comment"><p>I liked the article very much, thank you for the text.</p></div></section>
<footer>&copy; 2024 Site. All rights reserved to the owners of it.</footer></body></html>"""


def test_article_is_kept_and_the_rest_goes():
    assert extract.main_text(PAGE) == "\n".join([
        "Fish & chips", "The first paragraph of the article is long enough to be text. It has two sentences.",
        "Second one, with a link in it — fine.", "first point of the list", "second point of the list", "A quoted line."])


def test_page_without_article_element():
    page = PAGE.replace("<article>", '<div class="post-content">').replace("</article>", "</div>")
    text = extract.main_text(page)
    assert text.startswith("Fish & chips\nThe first paragraph") and "cookies" not in text and "liked" not in text and "shoes" not in text


LONG = ["The %s paragraph has many words that a reader of the page would like to see in the text, and it goes on for a while so that "
        "nobody can take it for a label, a menu or any other small thing that stands beside the story of the page." % k for k in ("first", "second", "third")]
BODY = "".join(f"<p>{t}</p>" for t in LONG)


@pytest.mark.parametrize("open_, close", [
    ('<div class="container with-sidebar"><article>', "</article></div>"), ('<article class="post category-alert tag-search">', "</article>"),
    ('<div id="search-results" class="content">', "</div>"), ('<div class="has-comments no-sidebar"><main>', "</main></div>"),
    ('<div class="sidebar"><article>', "</article></div>"), ('<article class="search post">', "</article>"), ('<article class="comments-open">', "</article>")])
def test_names_that_only_hold_a_bad_word_do_not_lose_the_article(open_, close):
    assert extract.main_text(f"<body>{open_}{BODY}{close}</body>") == "\n".join(LONG)


OTHER = '<p>Buy the best shoes of the year now, they are cheap and they fit every foot that walks on the streets of the town.</p>'
LAYOUTS = {
    "whole page form": f'<form id="aspnetForm"><nav><a href="/">Home</a></nav><div id="content">{BODY}</div><footer>All rights reserved.</footer></form>',
    "article in a form": f"<form><fieldset><legend>Read</legend><article>{BODY}</article></fieldset></form>",
    "form in an article": f"<article>{BODY}<form><p>Leave your address here and we will write to you every week of the year.</p><input></form></article>",
    "fieldset beside the text": f"<main>{BODY}</main><fieldset><legend>Answer</legend><p>Please tell us what you think of this page today.</p></fieldset>",
    "unclosed quote in a link": f'<article><p>{LONG[0]}</p><p><a href="http://x.y>{LONG[1]}</a></p><p class="z">{LONG[2]}</p></article>'.replace(
        LONG[1] + "</a>", "</a>" + LONG[1]),
    "bracket inside a value": f'<article title="a > b">{BODY}</article>',
    "tags inside a value": f"<article><div data-x='<p class=\"y\">no</p>'></div>{BODY}</article>",
    "apostrophe outside a value": f"<article it's>{BODY}</article>",
    "upper case": f"<BODY><NAV><A HREF='/'>Home</A></NAV><ARTICLE>{BODY.replace('<p>', '<P>').replace('</p>', '</P>')}</ARTICLE></BODY>",
    "no end tags": "<article>" + "".join(f"<p>{t}" for t in LONG),
    "table layout": f"<table><tr><td><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul><td class=content>{BODY}<tr><td><a href=/c>Next</a></table>",
    "text in divs": '<div class="post">' + "".join(f"<div>{t}</div>" for t in LONG) + '</div><div class="sidebar"><a href="/a">One</a></div>',
    "breadcrumb and tags": f'<div class="breadcrumb"><a href=/>Home</a> / <a href=/x>News</a></div><article>{BODY}</article><div class="tags"><a href=/t>fish</a></div>',
    "advert inside the article": f'<article><p>{LONG[0]}</p><div class="ad">{OTHER}</div><p>{LONG[1]}</p><p>{LONG[2]}</p></article>',
    "dialog": f'<dialog open><p>We use cookies on this site, please accept them all to go on with it.</p></dialog><main>{BODY}</main>',
    "reader comments": f'<article>{BODY}</article><div id="comments"><div class="comment">{OTHER}</div><div class="comment">{OTHER}</div></div>',
    "role names": f'<div role="banner">{OTHER}</div><div role="main">{BODY}</div><div role="contentinfo">{OTHER}</div>',
    "scripts and styles": f"<article><style>p > a {{}}</style>{BODY}<script>if (a < b) write('<p>no</p>')</script></article>",
    "hidden in a comment": f"<article><!-- {OTHER} -->{BODY}</article>",
    "inline markup": "<article>" + BODY.replace("words", "<b>wo<i>rd</i>s</b>").replace("reader", "<a href=/r>reader</a>") + "</article>",
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    assert extract.main_text(f"<body>{LAYOUTS[name]}</body>") == "\n".join(LONG)


def test_a_sign_in_form_is_not_a_frame():
    form = "<form><p>Sign in with the name that you have chosen for yourself here.</p><label>Name</label><input><button>Go</button></form>"
    assert extract.main_text(f"<body>{form}</body>") == ""


def test_large_pages_take_linear_time():
    page = "".join(f"<div><p>{'word ' * (i % 30)}text.</p><h2>a {i}</h2></div>" for i in range(25000))
    odd = ["<div>" * 20000 + "x", "<p>" + "<span>" * 10000 + "<div>x</div>" * 10000, '<a href="x>' * 20000, "<p><b>x" * 10000]
    start = time.process_time()
    assert extract.main_text(page).count("\n") > 10000
    for h in odd:
        extract.main_text(h)
    assert time.process_time() - start < 30


def test_unclosed_quotes_leave_no_markup():
    assert extract.main_text('<article><p>Before <a href="http://x.y>link</a> more words</p><p class="x>Lost <b class="y">bold</b> end.</p></article>') \
        == "Before link more words\nLost bold end."


@pytest.mark.parametrize("name", ["ad", "sidebar-left", "related-posts", "comment-list", "article-sidebar", "cookie-notice", "post-comments", "share_buttons"])
def test_named_boilerplate_still_goes(name):
    extra = f'<div class="{name}"><p>{LONG[0].replace("first", "other")}</p><p>Buy the best shoes of the year now.</p></div>'
    for page in (f"<body><article class=post>{BODY}{extra}</article></body>", f"<body>{extra}<article>{BODY}</article>{extra}</body>"):
        assert extract.main_text(page) == "\n".join(LONG)


@pytest.mark.parametrize("html", [None, "", " ", "<", "<p", "</p></p>", "<script>x", "<!-- x", "<p>&#0;&bogus;", "<a href='x", "<head><p>x"])
def test_broken_markup_does_not_fail(html):
    assert isinstance(extract.main_text(html), str)


def test_given_pages_match_their_template(spark):
    from html import unescape
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    out = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract.extract_main_text(pages).collect()}
    for r in pages.collect():
        h = r["html"]
        inner = h[h.index("<article>") + 9:h.index("</article>")]
        parts = (" ".join(unescape(re.sub(r"<[^>]+>", " ", re.sub("</?b>", "", p))).split()) for p in re.split(r"</?p>|</?h1>", inner))
        want = "\n".join(p for p in parts if p)
        assert out[r["page_id"]] == (want, len(want))


def test_min_cut_is_minimal():
    rng = random.Random(6)
    for _ in range(80):
        n = rng.randint(1, 8)
        scores = [rng.randint(-9, 9) for _ in range(n)]
        edges = [(i, j, rng.randint(0, 6)) for i, j in itertools.combinations(range(n), 2) if rng.random() < 0.5]
        def cost(side):
            return sum(max(0, s) for s, k in zip(scores, side) if not k) + sum(max(0, -s) for s, k in zip(scores, side) if k) + sum(
                c for i, j, c in edges if side[i] != side[j])
        assert cost(extract.min_cut(scores, edges)) == min(cost(s) for s in itertools.product([False, True], repeat=n))


def test_extract_edges(spark):
    from pyspark.sql import functions as F
    df = frame(spark, "page_id", "html").withColumn("url", F.lit(None).cast("string"))
    out = got(extract.extract_main_text(df), "page_id", "n_chars")
    assert len(out) == len(rows()) and (None, 0) in out and (1, 0) in out
    assert extract.extract_main_text(df.limit(0)).count() == 0


# ---- language model ---------------------------------------------------------------------------------
def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")] + [""]


def fold(i):
    return zlib.crc32(str(i).encode() if i is not None else b"") % 5


def brute_scores(data):
    train = Counter(w for i, t in data if fold(i) != 1 for w in tokens(t))
    n, v = sum(train.values()), len(train)
    a = Counter(w for i, t in data if fold(i) not in (1, 4) for w in tokens(t))
    h = Counter(w for i, t in data if fold(i) == 4 for w in tokens(t))
    classes = sorted({w for w, c in train.items() if c > n * lm.CLASS_SHARE} | {""}, key=lambda w: w.encode())
    cls = {w: k for k, w in enumerate(classes, 1)}
    start = len(cls) + 1
    size = start + 1

    def pairs(folds):
        m = np.zeros((size, size))
        for i, t in data:
            if fold(i) in folds:
                before = start
                for w in tokens(t):
                    m[before, cls.get(w, 0)] += 1
                    before = cls.get(w, 0)
        return m

    table = lm.class_model(pairs({0, 2, 3}), pairs({4}))
    oa = sum(c for w, c in a.items() if w not in cls)
    seen = sum(1 for w in a if w not in cls)
    weight = 0.5
    held = [(a[w] / max(oa, 1), c) for w, c in h.items() if w not in cls]
    for _ in range(lm.ROUNDS if held else 0):
        weight = sum(c * weight * p / (weight * p + (1 - weight) / (seen + 1)) for p, c in held) / sum(c for _, c in held)
        weight = min(max(weight, lm.FLOOR), 1 - lm.FLOOR)
    ot = sum(c for w, c in train.items() if w not in cls)
    on = sum(1 for w in train if w not in cls)
    out = []
    for i, t in data:
        base = model = 0.0
        before = start
        for w in tokens(t):
            base += math.log10((train[w] + 0.5) / (n + 0.5 * (v + 1)))
            c = cls.get(w, 0)
            model += table[before, c]
            if not c:
                model += math.log10(weight * train[w] / max(ot, 1) + (1 - weight) / (on + 1))
            before = c
        out.append((i, fold(i) == 1, len(tokens(t)), sum(w in train for w in tokens(t)), n, base, model))
    return out


@pytest.mark.parametrize("repeats", [True, False])
def test_scores_brute_force(spark, repeats, monkeypatch):
    monkeypatch.setattr(lm, "CLASS_SHARE", 1 / 50)
    monkeypatch.setattr(lm, "BATCH_TOKENS", 700)
    data = rows() if repeats else [(k, t) for k, (_, t) in enumerate(rows())]
    res = got(lm.score_texts(frame(spark, data=data).repartition(3)))
    def key(r):
        return (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    want = brute_scores(data)
    for x, y in zip(sorted(res, key=key), sorted(want, key=key), strict=True):
        assert x[:5] == y[:5] and x[5:] == pytest.approx(y[5:], rel=1e-5, abs=1e-6)
    assert lm.score_texts(empty(spark)).count() == 0


def test_model_is_a_distribution_and_beats_the_base_on_held_out_texts(spark):
    from pyspark.sql import functions as F
    a = np.array([[5, 2, 1, 0], [3, 9, 2, 0], [0, 0, 0, 0], [4, 1, 0, 0]], float)
    p = 10 ** lm.class_model(a, a[::-1] * np.array([1, 1, 1, 0]))
    assert p[:, :3].sum(axis=1) == pytest.approx(np.ones(4), abs=1e-4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    base, score = lm.score_texts(docs).where("held_out").agg(F.sum("base_score"), F.sum("score")).first()
    assert score > base


def brute_bigrams(data):
    """Deleted interpolation of word bigrams, by dictionaries."""
    def counts(folds):
        pairs, words, context = Counter(), Counter(), Counter()
        for i, t in data:
            if fold(i) in folds:
                for v, w in zip([None, *tokens(t)], tokens(t)):
                    pairs[v, w] += 1
                    words[w] += 1
                    context[v] += 1
        return pairs, words, context

    def bucket(x):
        return math.ceil(math.log2(1 + x))

    def estimates(c, v, w):
        pairs, words, context = c
        return pairs[v, w] / max(context[v], 1), words[w] / max(sum(words.values()), 1), 1 / (vocabulary + 1)

    train, a, held = counts({0, 2, 3, 4}), counts({0, 2, 3}), counts({4})[0]
    vocabulary = len(train[1].keys() | {""})
    weights = {}
    for b in {bucket(a[2][v]) for v, _ in held}:
        events = [(estimates(a, v, w), n) for (v, w), n in held.items() if bucket(a[2][v]) == b]
        x = [1 / 3] * 3
        for _ in range(60):
            new = [sum(n * x[k] * p[k] / sum(y * q for y, q in zip(x, p)) for p, n in events) for k in range(3)]
            new = [max(y / sum(new), 1e-6) for y in new]
            x = [y / sum(new) for y in new]
        weights[b] = x
    weights.setdefault(0, [1e-6, 0.5, 0.5 - 1e-6])

    def mix(v):
        return weights[max(b for b in weights if b <= bucket(train[2][v]))]

    return [(i, sum(math.log10(sum(x * p for x, p in zip(mix(v), estimates(train, v, w if w in train[1] or not w else 0))))
                    for v, w in zip([None, *((x if x in train[1] else 0) for x in tokens(t))], tokens(t)))) for i, t in data]


@pytest.mark.parametrize("sizes", [(700, 500, 300), (10 ** 6, 10 ** 6, 10 ** 6)])
def test_scores_count_every_pair_of_words(spark, sizes, monkeypatch):
    for name, x in zip(("BATCH_TOKENS", "PART_PAIRS", "PART_WORDS"), sizes):
        monkeypatch.setattr(lm, name, x)
    data = [(k, t) for k, (_, t) in enumerate(rows())]
    data += [(100, "rareone raretwo " + data[7][1]), (101, "rareone raretwo the"), (102, "raretwo rareone the"), (103, "never seen")]
    res = got(lm.score_texts(frame(spark, data=data).repartition(3)), "doc_id", "score")
    for x, y in zip(res, sorted(brute_bigrams(data)), strict=True):
        assert x[0] == y[0] and x[1] == pytest.approx(y[1], rel=1e-5, abs=1e-6)
    assert abs(dict(res)[101] - dict(res)[102]) > 0.1  # words in another order


def test_packed_longs():
    for x in ([], [0], [0, 0, 0], [1, 300, 0], [2 ** 62, 5], [255, 256]):
        assert lm._unpack(lm._pack(np.array(x, np.int64))).tolist() == x


# ---- SentencePiece ---------------------------------------------------------------------------------------
def processor():
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def hard_texts():
    rng = random.Random(1)
    return ["", " ", "a  b", " a ", "a\nb", "x▁y", "<s> a </s>", "日本語 𝒳 😀\u0000", *[" " * n + "q" for n in range(1, 40)], "=-" * 300, "ab" * 700,
            *["".join(rng.choice("abcdeth .,é\n日▁") for _ in range(rng.randint(1, 200))) for _ in range(300)]]


def test_encode_equals_the_library():
    sp, m = processor(), pieces.PieceModel(MODEL)
    for t in hard_texts():
        ids = np.frombuffer(m.encode("▁" + t.replace(" ", "▁") if t else ""), "<u4").tolist()
        assert ids == sp.encode(t)
        assert m.decode_all(pa.array([ids], pa.list_(pa.int32()))) == [t.replace("▁", " ")] == [sp.decode(ids)]
    texts = hard_texts()
    assert m.encode_all(pa.array([*texts, None])).to_pylist() == [*(sp.encode(t) for t in texts), []]


def test_scan_equals_the_library(spark):
    sp = processor()
    data = [*enumerate(hard_texts()), (None, "of the " * 99), (3, "a" * 999), (3, "a" * 999), (1000, None), *rows()]
    df = frame(spark, data=data).repartition(4)
    for chunk in (16, 37, 512):
        out = pieces.encode(df, MODEL, chunk=chunk)
        res = Counter((i, tuple(ids)) for i, ids in (tuple(r) for r in out.collect()))
        assert res == Counter((i, tuple(sp.encode(t or ""))) for i, t in data)
    both = pieces.encode_and_check(df, MODEL)
    assert Counter(got(both, "doc_id", "decoded_crc32")) == Counter((i, zlib.crc32((t or "").replace("▁", " ").encode())) for i, t in data)
    assert pieces.encode(empty(spark), MODEL).count() == 0


def test_product_is_associative_and_agrees_with_the_best_path():
    rng = random.Random(3)
    for _ in range(50):
        ms = [{(a, b): float(rng.randint(-5, 5)) for a in "pqr" for b in "pqr" if rng.random() < 0.7} for _ in range(4)]
        x = pieces.product(pieces.product(ms[0], ms[1]), pieces.product(ms[2], ms[3]))
        y = pieces.product(ms[0], pieces.product(ms[1], pieces.product(ms[2], ms[3])))
        assert x == y
        for (a, b), w in x.items():
            s = pieces.best_states(ms, a, b)
            assert sum(m[u, v] for m, u, v in zip(ms, s, s[1:])) == w


def test_chunk_shorter_than_a_piece_is_refused(spark):
    with pytest.raises(ValueError):
        pieces.encode(frame(spark), MODEL, chunk=3)
