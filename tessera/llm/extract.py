"""Main-text extraction by minimum-cut labelling.

A page is split into blocks of text.  A linear classifier scores each block;
the score becomes the capacity to the content or to the boilerplate terminal,
and smoothness edges join blocks that follow each other or share a parent
element.  The minimum cut - found by max-flow - labels the blocks.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML elements by role.
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search
section select summary table tbody td tfoot th thead title tr ul""".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template svg math iframe object canvas textarea title head select button audio video".split())
#: An open element of the set is closed by a start tag of the key.
IMPLIED_END = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
               "option": {"option"}}
CLOSES_P = BLOCK_TAGS - {"body", "html", "head", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "option", "optgroup", "legend"}

#: A "p" is not ended across the first, list items, cells and options not across the second.
_KEEPS_P = frozenset("article section div li td th blockquote body main aside footer header nav".split())
_KEEPS_ITEMS = frozenset("ul ol menu dl table select".split())
_ENDED = frozenset({"p"}).union(*IMPLIED_END.values())

#: Words in class, id or role of an element that mark boilerplate, and those that mark content.
BAD_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments comentarios
kommentare commentaires consent cookie cookies copyright disqus footer gdpr header masthead menu modal nav navbar navigation newsletter
notice notices notification overlay pager pagination popup promo promoted promotion related replies reply respond share sharing sidebar
sidebars signup social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets complementary contentinfo search
form login alert disclaimer warning""".split())
GOOD_NAMES = frozenset("article articlebody content entry main mainbody maincontent post postbody posttext story text body".split())

#: Words that may stand beside a bad one in one name ("sidebar-left", "related-posts"); beside any other word
#: ("with-sidebar", "category-alert", "search-results") it says something else of the element.
NEUTRAL_NAMES = frozenset("""area articles bar block blocks bottom box button buttons col column container desktop global group icons inner item
items left link links list mobile outer page panel posts primary right row secondary section site slot stories sub title top unit wrap
wrapper""".split())

# Classifier weights: log-odds for content in thousandths (positive: content).
WEIGHTS = {
    "bias": -300,
    "word": 25,             # per word, up to 40
    "sentence": 500,        # ends like a sentence
    "link_share": -2500,    # share of the characters inside links
    "article": 2500,        # inside article or main
    "good_name": 1200,
    "boiler_tag": -9000,    # inside nav, aside, footer, dialog, menu, a page header, or a form that is no frame
    "bad_name": -5000,      # a long paragraph of an article that is also named as content outweighs it
    "list_item": -400,
    "heading": 300,
    "paragraph": 600,
}
SENTENCE_ENDS = ".!?…\"'”»)"
#: Words in sentences that a form must hold to be the frame of a page.
FRAME_WORDS = 50
#: Smoothness: capacity between following blocks, and between blocks with the same parent element.
ADJACENT, SAME_PARENT = 250, 450

#: A quote opens a value only after "="; it is not closed where the value holds a ">" and the next quote follows
#: a "=" itself (that one opens another value).  The tag then ends at its first ">", or with the page.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[(.*?)(?:\]\]>|$)|<[!?][^>]*(?:>|$)"
                    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"(?:[^\">]*\"|[^\"]*(?<!=)\")|=\s*'(?:[^'>]*'|[^']*(?<!=)')|=)*+)(?:>|\Z)"
                    r"|([^<]+|<)", re.S)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME_PART = re.compile(r"[a-z]+")


def _name_marks(attributes: str) -> tuple[bool, bool]:
    """(named as content, named as boilerplate): names are told apart by white space, and one marks boilerplate
    if it has such a word and otherwise only words for content or of ``NEUTRAL_NAMES``."""
    good = bad = False
    for m in _NAMES.finditer(attributes):
        names = [set(_NAME_PART.findall(x)) for x in (m[1] or m[2] or m[3] or "").lower().split()]
        marks = BAD_NAMES - {"header"} if any(n & GOOD_NAMES for n in names) else BAD_NAMES  # an article's own header is content
        marked = [bool(n & marks) and n <= BAD_NAMES | GOOD_NAMES | NEUTRAL_NAMES for n in names]
        bad |= any(marked)
        good |= any(n & GOOD_NAMES and not m for n, m in zip(names, marked))
    return good, bad


def blocks(html: str) -> list[tuple[str, dict]]:
    """(text, features) of every block of visible text, in page order; linear in the page."""
    out: list[tuple[str, dict]] = []
    # open elements: (tag, serial, good, bad, boiler, article, place of the innermost block element, form, fieldset,
    # places that a start tag may end)
    stack: list[tuple] = [("", 0, False, False, False, False, 0, 0, 0, {})]
    places: dict[str, list[int]] = {}  # tag -> places of its open elements
    serial = 0
    parts: list[str] = []
    linked = in_link = 0

    def close_block():
        nonlocal parts, linked
        text = " ".join(unescape("".join(parts)).split()) if parts else ""
        if text:
            inner = stack[-1]
            place = inner[6]
            out.append((text, {"tag": stack[place][0], "parent": stack[place - 1][1] if place else 0, "good": inner[2], "bad": inner[3],
                               "boiler": inner[4], "article": inner[5], "form": inner[7], "fieldset": inner[8],
                               "linked": min(linked, len(text))}))
        parts, linked = [], 0

    def close_at(k):
        """Close the open element at place ``k``, and what is open inside it."""
        nonlocal in_link
        if stack[-1][6] >= k:
            close_block()
        for e in stack[k:]:
            places[e[0]].pop()
            in_link -= e[0] == "a"
        del stack[k:]

    at, n = 0, len(html)
    lower = None
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        tag = m[3]
        if tag is None:
            text = m[5] or m[1]
            if text:
                parts.append(text)
                if in_link:
                    linked += len(text)
            continue
        tag = tag.lower()
        if m[2]:
            if tag in BLOCK_TAGS:
                close_block()
            if places.get(tag):
                close_at(places[tag][-1])
            continue
        if tag in RAW_TAGS and not m[4].endswith("/"):
            if tag in BLOCK_TAGS:
                close_block()
            if lower is None:
                lower = html.lower() if len(html.lower()) == n else html
            end = lower.find("</" + tag, at)
            gt = html.find(">", end) if end >= 0 else -1
            # an unclosed head or script hides the rest only if nothing else can: head ends at body
            if tag == "head":
                body = lower.find("<body", at)
                if end < 0 or 0 <= body < end:
                    at = body if body >= 0 else at
                    continue
            at = gt + 1 if gt >= 0 else n
            continue
        if tag in BLOCK_TAGS:
            close_block()
            ends = ({"p"} if tag in CLOSES_P else set(), IMPLIED_END.get(tag, ()))
            for tags in ends:
                open_ends = stack[-1][9]
                k = max((open_ends[t] for t in tags if t in open_ends), default=0)
                if k:
                    close_at(k)
        elif tag == "br":
            parts.append(" ")
        if tag in VOID_TAGS or m[4].endswith("/"):
            continue
        serial += 1
        top, place = stack[-1], len(stack)
        good, bad = _name_marks(m[4]) if m[4] and tag not in ("a", "html", "body") else (False, False)
        boiler = tag in ("nav", "aside", "footer", "dialog", "menu") or (tag == "header" and not top[5])
        article = tag in ("article", "main")
        outermost = article and not top[5]  # ends a form, a fieldset or a bad name around it
        form = 0 if outermost else top[7] or (serial if tag == "form" else 0)
        fieldset = 0 if outermost else top[8] or (serial if tag == "fieldset" else 0)
        open_ends = top[9]
        if tag in _ENDED or tag in _KEEPS_P or tag in _KEEPS_ITEMS:
            open_ends = {t: k for t, k in open_ends.items() if not (tag in _KEEPS_P if t == "p" else tag in _KEEPS_ITEMS)}
            if tag in _ENDED:
                open_ends[tag] = place
        # a bad name ends an outer good one
        stack.append((tag, serial, good or (top[2] and not bad), bad or (top[3] and not outermost), boiler or top[4], article or top[5],
                      place if tag in BLOCK_TAGS else top[6], form, fieldset, open_ends))
        places.setdefault(tag, []).append(place)
        in_link += tag == "a"
    close_block()
    return out


def mark_forms(found: list[tuple[str, dict]]):
    """Blocks inside a form or fieldset are boilerplate, unless it is the page's frame: it holds most of the words in the page's
    sentences outside other boilerplate, and at least ``FRAME_WORDS`` of them."""
    held: dict[int, int] = {}
    total = 0
    for text, f in found:
        words = text.count(" ") + 1
        if words >= 8 and text[-1] in SENTENCE_ENDS and not (f["boiler"] or f["bad"]) and f["linked"] * 2 < len(text):
            total += words
            for x in (f["form"], f["fieldset"]):
                held[x] = held.get(x, 0) + words
    frames = {0} | {x for x, words in held.items() if words >= FRAME_WORDS and 2 * words > total}
    for _, f in found:
        f["boiler"] |= not (f["form"] in frames and f["fieldset"] in frames)


def score(text: str, f: dict) -> int:
    """Log-odds of content in thousandths."""
    w = WEIGHTS
    s = w["bias"] + w["word"] * min(40, text.count(" ") + 1)
    if text[-1] in SENTENCE_ENDS:
        s += w["sentence"]
    s += w["link_share"] * f["linked"] // len(text)
    if f["article"]:
        s += w["article"]
    if f["good"]:
        s += w["good_name"]
    if f["boiler"]:
        s += w["boiler_tag"]
    if f["bad"]:
        s += w["bad_name"]
    tag = f["tag"]
    if tag == "li":
        s += w["list_item"]
    elif tag == "p":
        s += w["paragraph"]
    elif tag[:1] == "h" and tag[1:].isdigit():
        s += w["heading"]
    return s


def min_cut(scores: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes are on the source side of the smallest minimum cut.

    A node's positive score is its capacity from the source, a negative one
    its capacity to the sink; edges (i, j, capacity) go both ways.  A node
    whose terminal capacity outweighs all its edges has its side at once, and
    its edges become terminal capacities of its neighbours; flow is pushed
    among the others only, along shortest paths of one length at a time.
    """
    n = len(scores)
    score = list(scores)
    room: list[dict[int, int]] = [{} for _ in range(n)]
    for i, j, c in edges:
        room[i][j] = room[i].get(j, 0) + c
        room[j][i] = room[j].get(i, 0) + c
    weight = [sum(r.values()) for r in room]
    side: list[bool | None] = [None] * n
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i] is not None or -weight[i] < score[i] <= weight[i]:
            continue
        side[i] = score[i] > 0
        for j, c in room[i].items():
            if side[j] is None:
                score[j] += c if side[i] else -c
                weight[j] -= c
                del room[j][i]
                todo.append(j)
        room[i] = {}
    left = [i for i in range(n) if side[i] is None]
    feed = {i: score[i] for i in left if score[i] > 0}
    drain = {i: -score[i] for i in left if score[i] < 0}
    while True:
        level = dict.fromkeys(feed, 0)
        queue, far = deque(feed), n
        while queue:
            i = queue.popleft()
            if i in drain:
                far = min(far, level[i])
            if level[i] >= far:  # nearest sinks only
                continue
            for j, c in room[i].items():
                if c and j not in level:
                    level[j] = level[i] + 1
                    queue.append(j)
        if far == n:
            return [x if x is not None else i in level for i, x in enumerate(side)]
        _push_level(feed, drain, room, level, far)


def _push_level(feed: dict[int, int], drain: dict[int, int], room: list[dict[int, int]], level: dict[int, int], far: int):
    """Push flow from every node in ``feed`` to sinks at level ``far`` along rising levels until none is left."""
    untried: dict[int, list[int]] = {}
    for source in list(feed):
        path = [source]
        while path:
            i = path[-1]
            if level[i] == far and i in drain:
                push = min(feed[source], drain[i], *(room[a][b] for a, b in zip(path, path[1:])))
                first = len(path)
                for k in range(len(path) - 2, -1, -1):
                    a, b = path[k], path[k + 1]
                    room[a][b] -= push
                    room[b][a] += push
                    if not room[a][b]:
                        first = k + 1  # go on from before the first full edge
                feed[source] -= push
                drain[i] -= push
                if not drain[i]:
                    del drain[i]
                if not feed[source]:
                    del feed[source]
                    break
                del path[first:]
                continue
            if i not in untried:
                untried[i] = [j for j in room[i] if level.get(j, -1) == level[i] + 1] if level[i] < far else []
            nexts = untried[i]
            while nexts and not room[i][nexts[-1]]:
                nexts.pop()
            if nexts:
                path.append(nexts[-1])
            else:
                path.pop()
                if path:
                    untried[path[-1]].pop()


def main_text(html: str | None) -> str:
    """The page's content blocks, joined by line ends in page order."""
    if not html:
        return ""
    found = blocks(html)
    mark_forms(found)
    scores = [score(t, f) for t, f in found]
    edges, last = [], {}
    for i, (_, f) in enumerate(found):
        if i:
            edges.append((i - 1, i, ADJACENT))
        if f["parent"] in last:
            edges.append((last[f["parent"]], i, SAME_PARENT))
        last[f["parent"]] = i
    keep = min_cut(scores, edges)
    return "\n".join(t for (t, _), k in zip(found, keep) if k)


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    Null or empty html, and pages without content, give the empty text; a tag
    whose quote is never closed ends at its first ">" and is no text; null
    ids and urls and repeated rows pass through; empty table: empty result.
    """
    src = df.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"),
                    F.col(f"`{html_col}`").cast("string").alias("html"))
    types = {f.name: f.dataType.simpleString() for f in src.schema.fields}

    def work(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"])

    return src.mapInArrow(work, f"page_id {types['page_id']}, url {types['url']}, text string, n_chars long")
