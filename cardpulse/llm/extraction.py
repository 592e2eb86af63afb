"""Main-text extraction by a maximum-scoring subsequence.

A page is a sequence of words and tags. A word scores by its surroundings (link, list, navigation, article, what the names of its ancestors
say ...), a tag negatively; the weights are a logistic model's, learned from labelled pages and bounded. One linear scan finds the
contiguous run of the best total, the content region; blocks inside it whose own words score below zero (an advert between
paragraphs) are left out. A page is read once, each tag in constant time on average: an end tag without a start is known from a
count of open elements, and an end that was once searched in vain is not searched again.

Names mislead: those of ``body``, ``main`` and of whatever holds the main element or the page's article hide nothing, a name that tells of a state or
a neighbour (``has-sidebar``, ``header-fixed``, ``side-by-side``) counts for nothing, and if names would hide nearly all of a page's text they are not believed.
"""

from __future__ import annotations

import html as references
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import map_arrow

#: Surroundings, one bit each. ``off`` and ``on`` are single words as names, ``off_part`` and ``on_part`` words in compound names.
SURROUNDINGS = ("link", "item", "heading", "paragraph", "article", "navigation", "header", "footer", "aside", "form", "off", "off_part", "on", "on_part", "comment")
_BIT = {name: 1 << k for k, name in enumerate(SURROUNDINGS)}
#: What is not displayed never counts: a bit beyond the learned ones.
_HIDDEN = 1 << len(SURROUNDINGS)
_OFF = _BIT["off"] | _BIT["off_part"]
#: What is said in favour of a text ends where an element inside says something against its own.
_FOR = _BIT["article"] | _BIT["on"] | _BIT["on_part"]
_AGAINST = _OFF | _BIT["comment"] | _BIT["navigation"] | _BIT["footer"] | _BIT["aside"] | _BIT["form"]
#: Words in class, id and role names.
HINTS_OFF = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion promoted banner cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share sharing social sidebar side widget widgets related recommended recommendations trending popular nav navbar navigation menu menus breadcrumb breadcrumbs crumbs footer copyright legal disclaimer header masthead topbar toolbar login search pagination pager skip tags meta byline contentinfo complementary".split())
HINTS_ON = frozenset("article content post entry story main body text prose maincontent".split())
HINTS_COMMENT = frozenset("comment comments commentlist discussion disqus replies reply respond responses reviews feedback".split())
#: A name tells of what the element has beside it from one of the first on, and of a state of the page with one of the others.
_BESIDE = frozenset("has with without no by non hide show".split())
_STATE = frozenset("layout fixed sticky open opened closed off on enabled disabled active visible collapsed expanded test template".split())
_ELEMENTS = {"nav": "navigation", "menu": "navigation", "header": "header", "footer": "footer", "aside": "aside", "dialog": "aside", "form": "form", "button": "form", "select": "form", "fieldset": "form", "label": "form", "article": "article", "main": "article"}
#: Elements whose text is never content, skipped to their end tag; those of the second kind are passed over where they do not end.
_RAW = frozenset("script style noscript template textarea iframe".split())
_RAW_ENDED = frozenset("title svg object head select option".split())
_CONTAINERS = frozenset("div section article main header footer nav aside menu form fieldset dialog ul ol dl table blockquote figure details body center td button label".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd tr th pre hr figcaption address summary html caption tbody thead".split()) - {"label", "button"}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_VOID = frozenset("br hr img input meta link wbr source area base col embed".split())
#: Share of a page's words that an article must hold for its ancestors' names to say nothing, and a form for it to be the page's frame.
HOLDS, FRAMES = 1 / 3, 0.9
#: Names are not believed if without them a region has this many words at least, and so many times those of the region with them.
DISBELIEF, TIMES = 40, 8

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*)            # a comment, also an unclosed one
    |<[!?][^>]*>?                    # a declaration
    |<(/?)([a-zA-Z][^\s/>]*)([^>"']*+(?:"[^"]*"[^>"']*+|'[^']*'[^>"']*+)*+)>
    |<(/?)([a-zA-Z][^\s/>]*)([^>]*)>?  # stray quotes, or the page ends inside the tag
    """,
    re.VERBOSE | re.DOTALL,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"?|'([^']*)'?|([^\s"'>]+)))?""")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)", re.IGNORECASE)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _attributes(text: str) -> dict[str, str]:
    """Values by lower-cased name; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
    return out


def _said(name: str) -> str | None:
    """What a class, id or role name says: comment, off, off_part, on, on_part or nothing."""
    parts = [p.lower() for p in _PART.findall(name)]
    beside = next((k for k, p in enumerate(parts) if p in _BESIDE), len(parts))
    own, state = parts[:beside], not _STATE.isdisjoint(parts)
    single = "" if len(parts) == 1 else "_part"
    if not state and beside == len(parts):
        if not HINTS_COMMENT.isdisjoint(own):
            return "comment"
        if not HINTS_OFF.isdisjoint(own):
            return "off" + single
    return None if HINTS_ON.isdisjoint(own) else "on" + single


#: Of several names of an element the first of these counts.
_STRENGTH = ("comment", "off", "on", "off_part", "on_part")


def _hints(attributes: str, in_article: bool = False) -> int:
    """Bits that an element's names and visibility give to what it holds. The header of an article holds its title."""
    if not attributes or attributes.isspace():
        return 0
    own = _attributes(attributes)
    hidden = "hidden" in own or own.get("aria-hidden", "").strip().lower() == "true" or ("style" in own and _NOT_SHOWN.search(own["style"]))
    names = {n for a in ("class", "id", "role") if a in own for n in own[a].split()}
    said = {_said(n) for n in names if not (in_article and "header" in n.lower())}
    strongest = next((x for x in _STRENGTH if x in said), None)
    return (_HIDDEN if hidden else 0) | (_BIT[strongest] if strongest else 0)


#: A token: place, surroundings, words, text (None: a tag), block. A block is what stands between two block-level tags.
Token = tuple[int, int, int, str | None, int]


class _Elements:
    """The containers of a page, in order: ``up`` is the one around, ``kind`` its bits by element and ``hint`` by names, ``words`` those right inside."""

    def __init__(self):
        self.up, self.name, self.kind, self.hint, self.words = [0], [""], [0], [0], [0]

    def add(self, up: int, name: str, kind: int, hint: int) -> int:
        for column, value in zip((self.up, self.name, self.kind, self.hint, self.words), (up, name, kind, hint, 0), strict=True):
            column.append(value)
        return len(self.up) - 1

    def surroundings(self) -> list[int]:
        """The bits that each container gives to its text: its ancestors' and its own, less what is not believed."""
        n, total, inside = len(self.up), list(self.words), [False] * len(self.up)
        for e in range(n - 1, 0, -1):  # children come after their parents
            total[self.up[e]] += total[e]
        for e in range(1, n):
            inside[e] = inside[self.up[e]] or self.name[self.up[e]] == "article"
        mains = [e for e in range(1, n) if self.name[e] == "main"]
        articles = [e for e in range(1, n) if self.name[e] == "article" and not inside[e]]
        holders = mains[:2] or ([articles[0]] if len(articles) == 1 and total[articles[0]] >= HOLDS * total[0] else [])
        frames = set()
        for e in holders:
            while e:
                frames.add(e)
                e = self.up[e]
        out = [0] * n
        for e in range(1, n):
            kind, hint, name = self.kind[e], self.hint[e], self.name[e]
            if name in ("body", "main") or e in frames:
                kind, hint = kind & ~_BIT["form"], hint & ~_OFF
            if name == "form" and total[e] >= FRAMES * total[0]:
                kind &= ~_BIT["form"]
            if name == "header" and out[self.up[e]] & _BIT["article"]:
                kind &= ~_BIT["header"]
            around = out[self.up[e]]
            out[e] = (around & ~_FOR if (kind | hint) & _AGAINST else around) | kind | hint
        return out


def parse(page: str) -> list[Token]:
    """The runs of text, and the tags, of a page."""
    elements = _Elements()
    found: list[tuple[int, int, int, int, str | None, int]] = []
    stack: list[int] = [0]
    opened: Counter[str] = Counter()
    shut: Counter[str] = Counter()  # inline elements that are not displayed, by name
    vain: set[str] = set()
    own = block = at = 0
    size = len(page)

    def pop(name: str) -> None:
        while True:
            e = stack.pop()
            opened[elements.name[e]] -= 1
            if elements.name[e] == name:
                return

    while at < size:
        m = _TOKEN.search(page, at)
        end = m.start() if m else size
        if end > at:
            text = page[at:end]
            if "&" in text:
                text = references.unescape(text)
            words = len(text.split()) if len(text) > 8 or any(map(str.isalnum, text)) else 0  # marks between links are no words
            elements.words[stack[-1]] += words
            found.append((at, stack[-1], own, words, text, block))
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if name is None:
            continue
        name, closing, attributes = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name == "br":
            found.append((end, stack[-1], own, 0, " ", block))
            continue
        if name in _BLOCKS:
            block += 1
        if closing:
            if name in _CONTAINERS:
                if opened[name]:
                    pop(name)
                    own = 0
            elif shut[name] and opened[name]:
                pop(name)
                shut[name] = shut[name] if opened[name] else 0
            elif name == "a":
                own &= ~_BIT["link"]
            elif name in _BLOCKS:
                own = 0
        elif name in _RAW or name in _RAW_ENDED:
            close = m if attributes.endswith("/") and name != "head" else None
            if close is None and name not in vain:
                close = re.compile(r"</head\s*>|(?=<body[\s>])" if name == "head" else rf"</{name}\s*>", re.IGNORECASE).search(page, at)
            if close:
                at = max(at, close.end())
            elif name in _RAW:
                at = size
            else:
                vain.add(name)
        elif name in _CONTAINERS:
            article = bool(elements.kind[stack[-1]] & _BIT["article"]) or opened["article"] > 0
            kind = _BIT.get(_ELEMENTS.get(name, ""), 0) | (_BIT["item"] if name in ("ul", "ol", "dl") else 0)
            stack.append(elements.add(stack[-1], name, kind, _hints(attributes, article)))
            opened[name] += 1
            own = 0
        elif name not in _VOID:
            hint = _hints(attributes) if attributes else 0
            if name in _BLOCKS:
                own = hint | (_BIT["paragraph"] if name == "p" else _BIT["heading"] if name in _HEADINGS else 0)
            elif hint & _HIDDEN or shut[name]:  # inline and not displayed, or inside of one of the same name
                stack.append(elements.add(stack[-1], name, 0, hint & _HIDDEN))
                opened[name] += 1
                shut[name] += 1
            elif name == "a":
                own |= _BIT["link"]
        if name not in _VOID:
            found.append((end, stack[-1], own, 0, None, block))
    around = elements.surroundings()
    return [(place, (around[e] & ~_FOR if bits & _AGAINST else around[e]) | bits, words, text, number) for place, e, bits, words, text, number in found]


#: No single surrounding weighs more than this.
MOST = 6.0


class Scores:
    """Scores of words and tags by surroundings: a linear model with one weight per surrounding, one for the token being a tag, and a constant."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.word, self.tag = weights, {}, {}

    def of(self, bits: int, tag: bool) -> float:
        if bits & _HIDDEN:
            return -1.0
        have = self.tag if tag else self.word
        if bits not in have:
            have[bits] = float(self.weights[:-2] @ [(bits >> k) & 1 for k in range(len(SURROUNDINGS))] + self.weights[-1] + (self.weights[-2] if tag else 0.0))
            if tag:
                have[bits] = min(have[bits], -0.01)
        return have[bits]


#: How far a single run of text, and a tag, can count against a region; less so inside an element that holds content.
FLOORS = {False: (-2.0, -0.5), True: (-0.3, -0.05)}


def token_score(scores: Scores, bits: int, words: int, tag: bool) -> float:
    """A token's score in the scan. What counts against a region is bounded, so that a long advert between two paragraphs does not
    part them; it is left out of the text by its own score."""
    text_floor, tag_floor = FLOORS[bool(bits & _FOR)]
    return max(scores.of(bits, True), tag_floor) if tag else max(words * scores.of(bits, False), text_floor)


def best_run(scores: list[float]) -> tuple[int, int]:
    """[a, b) with the greatest sum, the earliest and then shortest of equals; (0, 0) if no sum is positive."""
    best, found, total, a = 0.0, (0, 0), 0.0, 0
    for k, s in enumerate(scores):
        if total <= 0:
            total, a = 0.0, k
        total += s
        if total > best:
            best, found = total, (a, k + 1)
    return found


def _kept(tokens: list[Token], scores: Scores, mask: int) -> tuple[int, list[str]]:
    """(words, blocks) of the best region, in page order, by surroundings limited to ``mask``."""
    a, b = best_run([token_score(scores, bits & mask, words, text is None) for _, bits, words, text, _ in tokens])
    out, block, parts, total = [], None, [], 0.0

    def close() -> None:
        text = " ".join("".join(parts).split())
        if text and total > 0:
            out.append(text)

    for _, bits, words, text, number in tokens[a:b]:
        if text is None or bits & _HIDDEN:
            continue
        if number != block:
            close()
            block, parts, total = number, [], 0.0
        parts.append(text)
        total += words * scores.of(bits & mask, False)
    close()
    return sum(len(t.split()) for t in out), out


def main_text(page: str | None, scores: Scores) -> str:
    """Blocks of the best region, in page order, joined by two line feeds; empty for a null or empty page, and for one without content."""
    if not page:
        return ""
    tokens = parse(page)
    words, out = _kept(tokens, scores, -1)
    if any(bits & _OFF for _, bits, _, _, _ in tokens):
        more, instead = _kept(tokens, scores, ~_OFF)
        if more >= max(DISBELIEF, TIMES * words):
            out = instead
    return "\n\n".join(out)


def labelled_pages(n: int = 160, seed: int = 5) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """(page, ranges of places that are content): layouts of common kinds with invented words, from a seed."""
    rng = random.Random(seed)

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice(("ba", "re", "to", "mi", "lun", "os", "ter", "va")) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(low, high)))

    def links(low: int, high: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{k}">{words(1, 3)}</a></li>' for k in range(rng.randint(low, high))) + "</ul>"

    off = (
        lambda: f"<header><h2>{words(1, 4)}</h2><p>{words(3, 9)}</p></header>",
        lambda: f"<nav>{links(3, 9)}</nav>",
        lambda: f"<nav><p>{words(2, 9)}</p>{words(1, 5)}</nav>",
        lambda: f'<div class="{rng.choice(("menu", "nav-bar", "breadcrumbs"))}">{links(2, 6)}</div>',
        lambda: f'<aside><h3>{words(1, 3)}</h3>{links(2, 5)}<p>{words(5, 30)}</p></aside>',
        lambda: f'<div class="{rng.choice(("sidebar", "widget", "related-posts"))}"><p>{words(4, 30)}</p>{links(1, 4)}</div>',
        lambda: f'<div class="{rng.choice(("ad", "ads", "advert", "promo-box", "sponsored"))}">{words(4, 25)}</div>',
        lambda: f'<div id="{rng.choice(("cookie-notice", "alert", "newsletter", "consent-banner"))}"><p>{words(6, 30)}</p><button>{words(1, 2)}</button></div>',
        lambda: f"<form><label>{words(1, 2)}</label><input><button>{words(1, 1)}</button><p>{words(3, 12)}</p></form>",
        lambda: f"<script>{words(3, 9)}</script>",
        lambda: f"<div>{links(3, 9)}</div>",
        lambda: f"<td>{links(3, 9)}</td>",
        lambda: f"<div>{' | '.join(f'<a href=/{k}>{words(1, 2)}</a>' for k in range(4))}</div>",
        lambda: f'<div class="{rng.choice(("widget-area", "site-header", "footer-widgets", "social-links", "page-banner"))}"><p>{words(3, 20)}</p>{links(1, 3)}</div>',
    )
    end = (
        lambda: f'<section class="comments"><h3>{words(1, 2)}</h3>' + "".join(f'<div class="comment"><p>{words(5, 30)}</p></div>' for _ in range(rng.randint(1, 4))) + "</section>",
        lambda: f'<div id="disqus"><ol><li><p>{words(5, 30)}</p></li></ol></div>',
        lambda: f"<footer><p>&copy; {words(3, 15)}</p>{links(0, 3)}</footer>",
        lambda: f'<div class="footer">{words(3, 15)}</div>',
    )
    shells = (("<article>", "</article>"), ("<main><article>", "</article></main>"), ("<main>", "</main>"), ('<div class="post-content">', "</div>"), ('<div id="content"><div>', "</div></div>"), ("<div>", "</div>"))
    misnamed = (('<div class="page-header-wrap"><div>', "</div></div>"), ('<div class="search-results-list">', "</div>"))
    for _ in range(n):
        parts: list[tuple[str, bool]] = [(f"<html><head><title>{words(2, 6)}</title></head><body>", False)]
        parts += [(rng.choice(off)(), False) for _ in range(rng.randint(1, 4))]
        open_, close = rng.choice(shells if rng.random() < 0.99 else misnamed)
        parts.append((open_, False))
        if rng.random() < 0.8:
            parts.append((f"<h1>{words(2, 9)}</h1>", True))
        for _ in range(rng.randint(1, 8)):
            kind = rng.random()
            text = words(3, 60)
            parts.append((f"<p>{text}</p>" if kind < 0.6 else f'<p>{text} <a href="/x">{words(1, 3)}</a> <b>{words(1, 3)}</b></p>' if kind < 0.8 else f"<h2>{words(1, 5)}</h2>" if kind < 0.87 else f"<ul><li>{words(3, 15)}</li><li>{words(3, 15)}</li></ul>" if kind < 0.94 else f"<blockquote>{text}</blockquote>", True))
            if rng.random() < 0.25:
                parts.append((rng.choice(off[1:])(), False))  # a header in an article holds its title
        if rng.random() < 0.3:
            parts.append((rng.choice(end[:2])(), False))
        parts.append((close, False))
        parts += [(rng.choice(off + end)(), False) for _ in range(rng.randint(0, 3))]
        parts.append((rng.choice(end)() + "</body></html>", False))
        page, ranges = "", []
        for text, content in parts:
            if content:
                ranges.append((len(page), len(page) + len(text)))
            page += text
        yield page, ranges


def learn(pages: Iterable[tuple[str, list[tuple[int, int]]]], steps: int = 400, decay: float = 1e-4) -> Scores:
    """Weights by logistic regression of whether a token is content; words weigh by their number, tags less than words."""
    rows: dict[tuple[int, bool, bool], float] = {}
    for page, ranges in pages:
        for place, bits, words, text, _ in parse(page):
            weight = float(words) if text is not None else 0.25
            if weight:
                key = (bits, text is None, any(a <= place < b for a, b in ranges))
                rows[key] = rows.get(key, 0.0) + weight
    rows = {k: v for k, v in rows.items() if not k[0] & _HIDDEN}
    x = np.array([[(bits >> k) & 1 for k in range(len(SURROUNDINGS))] + [tag, 1] for bits, tag, _ in rows], dtype=float)
    y, each = np.array([c for _, _, c in rows], dtype=float), np.array(list(rows.values()))
    each /= each.sum()
    w = np.zeros(x.shape[1])
    for _ in range(steps):  # Newton steps, damped
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        q = each * np.maximum(p * (1 - p), 1e-4)
        move = np.linalg.solve((x * q[:, None]).T @ x + decay * np.eye(len(w)), x.T @ (each * (p - y)) + decay * w)
        w -= np.clip(move, -1, 1)
        if np.abs(move).max() < 1e-6:
            break
    return Scores(np.clip(w, -MOST, MOST))


def extract(pages: DataFrame, scores: Scores | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Main text of each page: ``page_id``, ``url``, ``text`` (empty if there is none, also for a null page) and ``n_chars`` (code points).

    Navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts and reader comments are left out;
    character references are decoded, white space within a block becomes one space, and blocks are joined by two line
    feeds. One row for each row of ``pages``; ids and urls may be null or repeat; other columns are ignored; an empty table gives an empty
    result. A very long page is read whole, in time and memory proportional to its length (about ten times its size in a worker).
    """
    sent = pages.sparkSession.sparkContext.broadcast((scores or learn(labelled_pages())).weights)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Scores(sent.value)
        for batch in batches:
            texts = [main_text(p.as_py(), own) for p in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=schema)

    return map_arrow(pages.select(F.col(id_col).cast("long"), F.col(url_col).cast("string"), F.col(html_col).cast("string")), run, "page_id long, url string, text string, n_chars long")
