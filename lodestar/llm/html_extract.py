"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into flat blocks of text between block-level tags. Each block is
described by its word count and link density, those of the blocks before and
after it, the most words of a block near by, and by where it lies: in an article, in a heading, in a zone by its tag (menu, footer,
form, hidden), and in how far the names (class, id, role) of its own element and of those around it tell of one: wholly,
in part, or not. A decision tree, grown by Gini impurity on blocks drawn from the small labelled table
below, says which blocks are main text. Names in part, names that an article's sections bear as well (discussion, notice,
menu), and pages without an article, are decided by the words and links of a block and its neighbours; a very long block among
long ones outvotes any name. Hidden words within a block are no part of it.

A null html is empty; a page without main text gives an empty text. Markup may be
cut anywhere or left unclosed: an unclosed button, picture or the like ends where the next block
or its parent's end is. Scripts, styles and comments never make blocks. Every row gives one
row; repeated rows are treated each, whatever their id. Pages of any length and depth are read whole, in
linear time. An empty table gives an empty one; other columns play no part, whatever their names.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..runtime import shipped, table
from .scan import slices

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style)(?=[\s/>])[^>]*(?:/>|>.*?(?:</\1\s*>|\Z))|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*+>|[^<>]*+>)|<[!?/][^<>]*+>|<[!?/a-zA-Z][^<>]*+\Z",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden|itemprop)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)

#: Tags whose contents are no text, those whose contents are no markup either, tags that
#: hold or break blocks, those whose contents are no article, and of these the ones that may wrap a page.
_MUTE = set("audio button canvas iframe math noframes noscript object select svg template textarea title video".split())
_PLAIN = set("iframe noframes textarea title".split())
_BLOCK = set(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_HOLDERS = set("article aside body blockquote center dd details dialog div dl dt fieldset figure footer form head header html li main menu nav ol section table tbody td tfoot th thead tr ul".split())
_NO_ARTICLE = set("aside dialog fieldset footer form head menu nav".split())
_WRAPPERS = set("dialog fieldset form header".split())

#: Words of names that tell of a zone, words that tell of one only if they are all there
#: is, and words that tell nothing.
_ZONES = set(
    "ad ads adv advert adverts advertisement advertisements adsense banner banners sponsor sponsored sponsors promo promos promotion promoted "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toolbar topbar masthead footer colophon copyright header "
    "sidebar sidebars aside rail widget widgets related recommended recommendations popular trending tagcloud complementary contentinfo "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay dialog "
    "comment comments commentlist disqus discussion discussions reactions respond responses reply replies "
    "share sharing social newsletter subscribe subscription signup login signin".split()
)
_WEAK = set("follow foot form forms more response search shares tag tags teaser teasers toc".split())
#: Of the zones' names those that sections of an article bear as well, so that its words and links decide.
_SECTIONS = set(
    "alert dialog discussion discussions header menu menus notice notices overlay popular promotion promotions rail reactions related replies reply "
    "respond responses social subscription subscriptions trending".split()
)
_NEUTRAL = set(
    "area articles bar block body bottom box btn buttons center class col collapse column container content d desktop fixed footer full global group header "
    "holder hidden i icons id in inner item items js l large left links list lists lower m main mobile module nav news of on outer overview page pages panel "
    "post posts primary r region right row s secondary section sections site slot small static sticky sub subs text thread title top ui unit upper user view widget width wrap wrapper x y zone".split()
) - {"text", "of"}
_HEADERS = {"header", "masthead"}
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Za-z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Names that tell of a zone elsewhere: has-sidebar, no-sidebar.
_MODIFIER = re.compile(r"(?<![A-Za-z])(?:has|no|with|without|hide|show)[-_]+[\w-]+", re.IGNORECASE)


@dataclass
class Block:
    text: str
    words: int
    link_density: float
    zone: bool
    named: float
    article: bool
    heading: bool


def _named(value: str, in_article: bool) -> float:
    """How far a class, id or role names a zone: 1 wholly, 0.5 in part or weakly, 0 not."""
    zones = _ZONES - _HEADERS if in_article else _ZONES
    best = 0.0
    for name in _MODIFIER.sub(" ", value).split():
        words = {w.lower() for w in _WORD.findall(name)}
        if words & zones:
            sure = words <= zones | _WEAK | _NEUTRAL and not (in_article and words & zones <= _SECTIONS)
            best = max(best, 1.0 if sure else 0.5)
        elif words & _WEAK and words <= _WEAK | _NEUTRAL:
            best = max(best, 0.5)
    return best


def _zone(tag: str, attrs: str, in_article: bool) -> tuple[bool, float]:
    """Whether an element is a zone by its tag or hidden, and how far its names tell of one."""
    if tag in _NO_ARTICLE or tag == "header" and not in_article:
        return True, 0.0
    if not attrs or tag in ("html", "body"):
        return False, 0.0
    named = 0.0
    for m in _ATTRIBUTE.finditer(attrs):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and _HIDDEN.search(value):
            return True, 0.0
        if key in ("class", "id", "role"):
            if tag in ("article", "main") and {w.lower() for w in _WORD.findall(value)} & {"article", "main", "content", "post", "entry"}:
                continue
            named = max(named, _named(value, in_article))
    return False, named


class _Closers:
    """Where elements without text of their own end."""

    def __init__(self, page: str):
        self.page = page
        self.last: dict[str, int] = {}

    def closed(self, tag: str, at: int) -> bool:
        """Whether a closing tag follows."""
        if tag not in self.last:
            self.last[tag] = max([m.start() for m in re.finditer(rf"</{tag}\s*>", self.page, re.IGNORECASE)], default=-1)
        return self.last[tag] >= at

    def end(self, tag: str, at: int) -> int:
        """Where the element that opens before `at` ends: at its closing tag, if that comes before the end
        of what holds the element and before another of its kind; otherwise at the next block."""
        closed = self.closed(tag, at)
        if closed and tag in _PLAIN:
            return re.compile(rf"</{tag}\s*>", re.IGNORECASE).search(self.page, at).end()
        depth, block = 0, -1
        while m := _TOKEN.search(self.page, at):
            at, name = m.end(), (m[3] or "").lower()
            if name == tag and not m[2] and tag not in ("svg", "object"):
                break
            if name == tag and m[2]:
                return at
            if name in _BLOCK:
                block = m.start() if block < 0 else block
                if not closed:
                    break
                if name in _HOLDERS and not m[4].rstrip().endswith("/>"):
                    depth += -1 if m[2] else 1
                if depth < 0:
                    break
        else:
            at = len(self.page)
            return block if block >= 0 else at
        return block if block >= 0 else m.start()


def blocks(page: str) -> list[Block]:
    """The text blocks of a page, in order.

    A zone by name, or by a tag that may hold all, is the page's wrapper and no zone if it
    encloses main, or most of the page's words and the first article or, without articles, the
    first heading.
    """
    out: list[Block] = []
    open_: list[tuple[str, int, bool]] = []  # holder, number of the zone it opens or 0, is an article
    opened: Counter[str] = Counter()
    spans: list[list] = []  # zones: by tag, by name, may wrap, place and block of the start, of the end
    first_article = main = first_heading = -1
    articles = links = heading = 0
    text: list[str] = []
    linked: list[str] = []
    own_zone, own_named = False, 0.0  # of the paragraph or heading that is open
    closers = _Closers(page)

    def flush() -> None:
        nonlocal own_zone, own_named
        if text:
            own = " ".join(html.unescape("".join(text)).split())
            if own:
                n = own.count(" ") + 1
                k = len(html.unescape(" ".join(linked)).split())
                out.append(Block(own, n, min(1.0, k / n), own_zone, own_named, articles > 0, heading > 0))
            text.clear()
            linked.clear()
        own_zone, own_named = False, 0.0

    def close() -> str:
        nonlocal articles
        name, z, a = open_.pop()
        opened[name] -= 1
        articles -= a
        if z:
            spans[z - 1][5:] = at, len(out)
        return name

    def say(piece: str) -> None:
        text.append(piece)
        if links:
            linked.append(piece)

    at = 0
    while m := _TOKEN.search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            if m[1]:
                text.append(" ")
        elif tag in _MUTE:
            if not m[2]:
                text.append(" ")
                if not m[4].rstrip().endswith("/>"):
                    at = closers.end(tag, at)
        elif m[2]:
            if tag == "a":
                links = 0
            elif tag in _BLOCK:
                flush()
                if tag[0] == "h" and tag[1:].isdigit():
                    heading = 0
                if tag in _HOLDERS and opened[tag]:
                    links = 0
                    while close() != tag:
                        pass
        elif tag == "br":
            text.append(" ")
        elif tag not in _BLOCK and m[4].strip("> /") and _zone(tag, m[4], articles > 0)[0]:  # hidden words within a block
            at = closers.end(tag, at)
        elif tag == "a":
            links = 1
        elif tag in _BLOCK:
            flush()
            heading = int(tag[0] == "h" and tag[1:].isdigit())
            if tag == "h1" and first_heading < 0:
                first_heading = m.start()
            if tag not in _HOLDERS:
                own_zone, own_named = _zone(tag, m[4], articles > 0)
            elif not m[4].rstrip().endswith("/>"):
                if tag in ("li", "dd", "dt", "tr", "td", "th") and open_ and open_[-1][0] == tag:
                    close()
                a = tag in ("article", "main")
                zone, named = _zone(tag, m[4], articles > 0)
                if zone or named:
                    spans.append([zone, named, not zone or tag in _WRAPPERS, m.start(), len(out), len(page), -1])
                open_.append((tag, len(spans) if zone or named else 0, a))
                opened[tag] += 1
                if tag == "main":
                    main = m.start()
                if a and first_article < 0:
                    first_article = m.start()
                articles += a
    if at < len(page):
        say(page[at:])
    flush()
    before = [0, *accumulate(b.words for b in out)]
    steps: dict[tuple[bool, float], list[int]] = {}
    first = first_article if first_article >= 0 else first_heading
    for zone, named, may_wrap, start, lo, end, hi in spans:
        hi = len(out) if hi < 0 else hi
        if may_wrap and (start < main < end or start < first < end and 2 * (before[hi] - before[lo]) > before[-1]):
            continue
        step = steps.setdefault((zone, named), [0] * (len(out) + 1))
        step[lo] += 1
        step[hi] -= 1
    for (zone, named), step in steps.items():
        for block, n in zip(out, accumulate(step), strict=False):
            if n:
                block.zone |= zone
                block.named = max(block.named, named)
    return out


FEATURES = ("words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density", "zone", "named", "article", "heading", "words_before", "words_after")
#: How many blocks before and after one are looked at for the most words of one that is no list of links and no zone.
AROUND = 4
#: Link density from which a block is a list of links.
LINKED = 0.3

# The labelled table: kinds of block, one a line: how common it is, its features as above, then 1 for main text. A
# feature is a number, a span of numbers or *, any; DRAWS blocks of each kind are drawn for each unit of the first.
_LABELLED = """
20  *       *       *       *       *       *       1 *   * * *       *       0
20  1..90   *       *       *       *       *       0 1   * * *       *       0
20  *       *       *       *       *       *       0 1   0 * *       *       0
3   1..300  0.3..1  *       *       *       *       0 1   * * *       *       0
2   140..300 0..0.2 20..200 0..0.3  20..200 0..0.3  0 1   1 0 20..200 20..200 1
24  1..300  0..0.4  *       *       *       *       0 0   1 * *       *       1
2   1..80   0.5..1  8..200  0..0.3  8..200  0..0.3  0 0   1 0 8..200  8..200  1
2   10..80  0.5..1  *       *       *       *       0 0   1 0 *       *       1
2   1..6    0.8..1  1..6    0.8..1  *       *       0 0   1 * *       *       0
2   1..6    0.8..1  *       *       1..6    0.8..1  0 0   1 * *       *       0
2   1..6    0.8..1  0       0       *       *       0 0   1 0 *       *       0
6   12..300 0..0.4  *       *       *       *       0 0.5 1 0 *       *       1
3   1..11   0..0.4  20..200 0..0.3  12..200 0..0.3  0 0.5 1 * 12..200 12..200 1
2   1..11   *       0..14   *       *       *       0 0.5 1 0 *       *       0
2   1..11   *       *       *       0..11   *       0 0.5 1 * *       *       0
2   1..80   0.6..1  *       *       *       *       0 0.5 1 * *       *       0
12  16..300 0..0.4  *       *       *       *       0 0   0 0 *       *       1
2   8..15   0..0.4  16..200 0..0.3  *       *       0 0   0 0 16..200 *       1
2   8..15   0..0.4  *       *       18..200 0..0.3  0 0   0 0 *       18..200 1
2   1..7    0..0.4  16..200 0..0.3  16..200 0..0.3  0 0   0 0 16..200 16..200 1
6   1..15   0..0.2  1..200  0..0.2  1..200  0..0.2  0 0   0 0 22..200 22..200 1
3   6..15   0..0.2  0       0       0       0       0 0   0 0 0       0       1
2   1..7    *       0..12   *       *       *       0 0   0 0 0..18   *       0
2   1..7    *       *       *       0..12   *       0 0   0 0 *       0..18   0
2   8..15   *       0..14   *       0..14   *       0 0   0 0 0..15   1..15   0
2   1..15   *       0..14   0.7..1  0..14   *       0 0   0 0 *       *       0
2   1..15   *       0..14   *       0..14   0.7..1  0 0   0 0 *       *       0
2   1..25   0..0.4  *       *       16..200 0..0.3  0 0   0 1 *       16..200 1
2   1..25   0..0.4  *       *       4..15   0..0.3  0 0   0 1 *       *       1
2   1..25   *       *       *       0..3    *       0 0   0 1 *       *       0
2   1..25   *       *       *       1..15   0.6..1  0 0   0 1 *       *       0
2   1..25   0.6..1  *       *       0..15   *       0 0   0 1 *       *       0
2   1..80   0.6..1  0..12   *       *       *       0 0   0 0 *       *       0
2   1..80   0.6..1  *       *       0..12   *       0 0   0 0 *       *       0
2   1..80   0.6..1  *       0.6..1  *       *       0 0   0 0 *       *       0
2   1..80   0.6..1  *       *       *       0.6..1  0 0   0 0 *       *       0
2   1..80   0.6..1  25..200 0..0.3  25..200 0..0.3  0 0   0 0 25..200 25..200 1
6   25..300 0..0.4  *       *       *       *       0 0.5 0 0 *       *       1
2   1..20   0..0.4  25..200 0..0.3  25..200 0..0.3  0 0.5 0 0 25..200 25..200 1
2   1..20   *       0..18   *       *       *       0 0.5 0 0 *       *       0
2   1..20   *       *       *       0..18   *       0 0.5 0 0 *       *       0
2   1..20   0..0.4  *       *       25..200 0..0.3  0 0.5 0 1 *       25..200 1
2   1..20   *       *       *       0..8    *       0 0.5 0 1 *       *       0
2   1..80   0.6..1  *       *       *       *       0 0.5 0 * *       *       0
"""
DRAWS = 360
#: Least blocks of a leaf.
LEAF = 12
#: Spans of any value, by feature.
_ANY = ("1..200", "0..1", "0..200", "0..1", "0..200", "0..1", "0|1", "0|0.5|1", "0|1", "0|1", "0..200", "0..200")


def labelled(seed: int = 0) -> list[tuple[list[float], int]]:
    """Blocks drawn from the kinds of the table, and their labels."""
    rnd = random.Random(seed)
    out = []
    for line in _LABELLED.strip().splitlines():
        common, *kind, label = line.split()
        for _ in range(DRAWS * int(common)):
            row = []
            for f, span in enumerate(kind):
                span = _ANY[f] if span == "*" else span
                low, _, high = span.partition("..")
                if not high:
                    row.append(float(rnd.choice(low.split("|"))))
                elif "words" in FEATURES[f]:  # small numbers as often as large ones
                    row.append(float(int((float(low) + 1) * ((float(high) + 1.99) / (float(low) + 1)) ** rnd.random()) - 1))
                else:  # link densities are mostly none or all
                    row.append(min(float(high), max(float(low), rnd.choice((0.0, rnd.random(), 1.0)))))
            for f, near in ((10, 2), (11, 4)):  # a neighbour that is no list of links counts among the blocks around
                if row[near + 1] < LINKED:
                    row[f] = max(row[f], row[near]) if kind[f] == "*" else row[f]
            out.append((row, int(label)))
    return out


def grow(rows: list[tuple[list[float], int]], depth: int = 24):
    """A decision tree: nested (feature, threshold, low side, high side), or a label."""
    return _grow(np.array([x for x, _ in rows], float), np.array([y for _, y in rows], float), depth)


def _grow(x: np.ndarray, y: np.ndarray, depth: int):
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() >= len(y))
    best = (np.inf, 0, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        at = LEAF - 1 + np.flatnonzero(v[LEAF : len(v) - LEAF + 1] > v[LEAF - 1 : len(v) - LEAF]) if len(v) >= 2 * LEAF else order[:0]
        if not len(at):
            continue
        n, k = at + 1.0, ones[at]
        m, j = len(y) - n, ones[-1] - k
        gini = k * (n - k) / n + j * (m - j) / m
        i = int(gini.argmin())
        if gini[i] < best[0] - 1e-12:
            best = (gini[i], f, (v[at[i]] + v[at[i] + 1]) / 2)
    if best[0] == np.inf:
        return int(2 * y.sum() >= len(y))
    _, f, cut = best
    low = x[:, f] <= cut
    return f, float(cut), _grow(x[low], y[low], depth - 1), _grow(x[~low], y[~low], depth - 1)


@cache
def tree():
    return grow(labelled())


def classify(own: list[Block], node=None) -> list[int]:
    """1 for each block that is main text."""
    root = tree() if node is None else node
    none = Block("", 0, 0.0, False, 0.0, False, False)
    out = []
    plain = [0 if b.zone or b.named == 1 or b.link_density >= LINKED else b.words for b in own]
    for i, (p, b, n) in enumerate(zip([none, *own[:-1]], own, [*own[1:], none], strict=False)):
        around = max(plain[max(0, i - AROUND) : i], default=0), max(plain[i + 1 : i + 1 + AROUND], default=0)
        x = (b.words, b.link_density, p.words, p.link_density, n.words, n.link_density, float(b.zone), b.named, float(b.article), float(b.heading), *around)
        at = root
        while not isinstance(at, int):
            at = at[2] if x[at[0]] <= at[1] else at[3]
        out.append(at)
    return out


def main_text(page: str | None, node=None) -> str:
    own = blocks(page or "")
    return "\n\n".join(b.text for b, y in zip(own, classify(own, node), strict=True) if y)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars."""

    node = tree()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(p, node) for p in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return shipped(pages.select("page_id", "url", "html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op3_html_extract(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
