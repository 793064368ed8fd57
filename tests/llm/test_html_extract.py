from __future__ import annotations

import time

import pytest

from lodestar.llm import html_extract as he

LONG = "Some words of the story, told at length, with a <a href='/x'>link</a> and an &eacute;&amp;, over and over again, for the reader."
TEXT = "Some words of the story, told at length, with a link and an é&, over and over again, for the reader."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p", ""),
        (f"<html><head><title>T</title><script>var a='</p>';</script></head><body><nav><ul><li><a href=/>Home</a></ul></nav><article><h1>A title</h1><p>{LONG}<p>Yes.</article><footer>&copy; me</footer>", f"A title\n\n{TEXT}\n\nYes."),
        (f"<article><p>One.</p><p>{LONG}", f"One.\n\n{TEXT}"),
        (f"<article><p>{LONG}</p><div class='ad'>Buy this very fine thing today</div><p>a\n\tb</p></article>", f"{TEXT}\n\na b"),
        (f"<article><p>{LONG}</p><section id=comments><h2>Comments</h2><p>{LONG}</p></section></article>", TEXT),
        (f"<div class='cookie-notice'>{LONG}</div><header><h1>Site</h1></header><aside><p>{LONG}</p></aside><article><header><h1>Head</h1></header><p>{LONG}</p></article><form>Your name, please</form>", f"Head\n\n{TEXT}"),
        ("<nav><a>a</a></nav><footer>nothing here</footer>", ""),
        ("<article><p>x &lt;b&gt; y<br>z<!-- no --><style>p{}</style></p></article>", "x <b> y z"),
        (f"<div><p>{LONG} {LONG}</p><p>{LONG}</p></div>", f"{TEXT} {TEXT}\n\n{TEXT}"),
    ],
)
def test_pages(page, text):
    assert he.main_text(page) == text


def label(x, node):
    while not isinstance(node, int):
        node = node[2] if x[node[0]] <= node[1] else node[3]
    return node


def test_the_tree_holds_on_blocks_that_it_has_not_seen():
    for seed in (0, 1):
        rows = he.labelled(seed)
        right = sum(label(x, he.tree()) == y for x, y in rows)
        assert right / len(rows) >= 0.98


def test_the_tree_asks_for_words_and_links_of_neighbours():
    def asked(node):
        return set() if isinstance(node, int) else {he.FEATURES[node[0]]} | asked(node[2]) | asked(node[3])

    assert asked(he.tree()) >= {"words", "link_density", "prev_words", "prev_link_density", "next_words", "next_link_density"}


@pytest.mark.parametrize("piece", ["<a", '<p x="', "<!--", "<script>", "<", "<div>", "</div>", "&", "<p a='\">", "<svg><p>", "<button><p>", "<object>", "<title>", "<iframe><p>", "<div><svg></div>", "<textarea>x</textarea>"])
def test_hostile_pages_take_linear_time(piece):
    began = time.time()
    he.main_text(piece * 20_000)
    he.main_text(piece * 20_000 + "</svg></button></object>")
    assert time.time() - began < 5


def test_rows(spark):
    rows = [(1, "u", f"<article><p>{LONG}</article>", "clash"), (1, "u", f"<article><p>{LONG}</article>", "clash"), (2, None, None, ""), (None, "v", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted(he.extract(df).collect(), key=repr)
    assert sorted([(1, "u", TEXT, len(TEXT))] * 2 + [(2, None, "", 0), (None, "v", "", 0)], key=repr) == sorted([tuple(r) for r in got], key=repr)
    assert he.extract(df.limit(0)).collect() == []


@pytest.mark.parametrize("wrapper", ['div class="layout has-sidebar"', 'div id="page" class="no-sidebar"', 'main class="with-sidebar"', 'div class="more tags"', 'div id="search"'])
def test_wrappers_keep_their_article(wrapper):
    text = "This is the long main text of the page, with many words in it. " * 6
    side = '<div class="sidebar"><article><p>Read this other story now</p></article></div>'
    page = f"<body><{wrapper}><article><p>{text}</p></article>{side}</{wrapper.split()[0]}></body>"
    own = he.blocks(page)
    assert [(b.zone, b.named) for b in own] == [(False, 0.0), (False, 1.0)]
    assert he.classify(own) == [1, 0]


@pytest.mark.parametrize("name", ["class='more-text'", "id='form-of-government'", "class='search-for-meaning'", "class=story", "class='header-image-story'", "class='commentary'", "id=tags-and-how-to-use-them"])
@pytest.mark.parametrize("article", ["article", "div"])
def test_innocent_names_keep_their_text(name, article):
    page = f"<nav><a href=/>Home</a></nav><{article}><div {name}><p>{LONG} {LONG}</p><p>{LONG}</p><p>{LONG}</p></div></{article}><footer>&copy; me</footer>"
    assert he.main_text(page) == f"{TEXT} {TEXT}\n\n{TEXT}\n\n{TEXT}"


SECTION = "This part of the story has some thirty words or so, no links at all, and a heading above it, so that it should stay where it is, whatever it is called by those who wrote it."


@pytest.mark.parametrize("name", "discussion notice related responses popular promotion alert menu subscription social discussion-section menu-items reactions".split())
@pytest.mark.parametrize("by", ["id", "class"])
def test_sections_of_an_article_keep_their_text(name, by):
    page = f"<article><p>{LONG} {LONG}</p><section {by}={name}><h2>A heading</h2><p>{SECTION}</p></section><p>{LONG} {LONG}</p></article>"
    assert he.main_text(page) == f"{TEXT} {TEXT}\n\nA heading\n\n{SECTION}\n\n{TEXT} {TEXT}"
    links = "".join(f"<li><a href=/{i}>Read story {i}</a></li>" for i in range(6))
    page = f"<article><p>{LONG} {LONG}</p><div {by}={name}><ul>{links}</ul></div><p>{LONG} {LONG}</p></article>"
    assert he.main_text(page) == f"{TEXT} {TEXT}\n\n{TEXT} {TEXT}"


@pytest.mark.parametrize(
    "piece",
    [
        "<p class='advertisement'>{}</p>", "<p class='ad sponsored'>{}</p>", "<p class='cookie-notice'>{}</p>", "<p class='comment'>{}</p>", "<p hidden>{}</p>", "<h2 hidden>{}</h2>", "<p style='display:none'>{}</p>",
        "<p><span style='display:none'>{}</span></p>", "<div hidden><p>{}</p></div>", "<pre aria-hidden=true>{}</pre>", "<section id=comments><p>{}</p></section>", "<div class=share><p>{}</p></div>", "<div class=banner>{}</div>",
    ],
)
@pytest.mark.parametrize("article", ["article", "div"])
def test_adverts_and_hidden_elements_go(piece, article):
    own = piece.format("Buy this very fine thing today, while there are some left of it")
    assert he.main_text(f"<{article}><p>{LONG} {LONG}</p>{own}<p>{LONG} {LONG}</p></{article}>") == f"{TEXT} {TEXT}\n\n{TEXT} {TEXT}"


def test_hidden_words_within_a_paragraph():
    assert he.main_text(f"<article><p>{LONG} <span hidden>not <b>this</b></span><i style='visibility: hidden'>nor this</i> but this.</p></article>") == f"{TEXT} but this."


def test_dialogue_between_long_paragraphs():
    page = f"<nav><ul><li><a href=/>Home</a></li><li><a href=/b>Other</a></li></ul></nav><p>{LONG} {LONG}</p><p>Who is there?</p><p>Nobody, he said.</p><p>Then go.</p><p>{LONG} {LONG}</p><div>About us</div>"
    assert he.main_text(page) == f"{TEXT} {TEXT}\n\nWho is there?\n\nNobody, he said.\n\nThen go.\n\n{TEXT} {TEXT}"
    assert he.main_text("<p>A page of one short paragraph.</p>") == "A page of one short paragraph."


def test_names_are_outvoted():
    """Where names mislead the tree gives another answer than they do."""
    text = " ".join([TEXT] * 10)
    page = f"<article><p>{text}</p><div class=sponsors><p>{text}</p></div><section id=menu><p>{SECTION}</p></section><p>{text}</p></article>"
    own = he.blocks(page)
    assert [b.named for b in own] == [0, 1, 0.5, 0] and he.classify(own) == [1, 1, 1, 1]
    short = he.blocks(f"<article><p>{text}</p><section id=menu><p>Soup</p><p>Fish</p><p>Cake</p></section></article>")
    assert he.classify(short) == [1, 0, 0, 0]


@pytest.mark.parametrize("tag", ["button", "select", "object", "svg", "canvas", "audio", "video", "iframe", "noscript", "textarea", "title", "template"])
def test_unclosed_elements_end_with_their_parent(tag):
    page = f"<article><p>{LONG}</p><p>{LONG} <{tag} x=1>go</p><p>{LONG}</p><div><{tag}></div><p>{LONG}</p></article>"
    assert he.main_text(page) == "\n\n".join([TEXT] * 4)
    closed = f"<article><p>{LONG}</p><{tag}><div>go</div></{tag}><p>{LONG}</p></article>"
    assert he.main_text(closed) == f"{TEXT}\n\n{TEXT}"


@pytest.mark.parametrize("levels", [20_000])
def test_deep_pages(levels):
    began = time.time()
    assert he.main_text("<div>" * levels + f"<p>{LONG}</p>" + "</div>" * levels) == TEXT
    assert he.main_text("<div class=x>" * levels + f"<p>{LONG}</p>" + "</section>" * levels) == TEXT
    assert time.time() - began < 5


def page_of(rnd):
    """A page of one of several layouts, and its main text."""
    say = lambda a, b: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "of", "the", "é"]) for _ in range(rnd.randint(a, b))).capitalize() + "."
    body = [("p", say(25, 120)) for _ in range(rnd.randint(4, 12))]
    for _ in range(rnd.randint(0, 2)):  # short paragraphs and headings within
        body.insert(rnd.randint(1, len(body) - 1), (rnd.choice(["p", "h2"]), say(2, 9)))
    links = lambda n: "".join(f"<li><a href=/{i}>{say(1, 3)}</a>" for i in range(n))
    head = ("h1", say(4, 10))
    inner = "".join(f"<{t}>{x}</{t}>" for t, x in [head, *body])
    open_, close = rnd.choice([("<article>", "</article>"), ("<main>", "</main>"), ("<div class='story-body'>", "</div>"), ("<table><tr><td>", "</td></tr></table>"), ("<div id=content>", "</div>"), ("", "")])
    menu = rnd.choice(["<nav><ul>{}</ul></nav>", "<div class='main-menu'><ul>{}</ul></div>", "<ul>{}</ul>"]).format(links(rnd.randint(3, 9)))
    ad = rnd.choice(["", f"<div class=ad>{say(8, 25)}</div>", f"<aside>{say(10, 40)}</aside>", f"<div id='cookie-notice'>{say(10, 30)}<button>Accept</button></div>"])
    comments = rnd.choice(["", "<section id=comments><h2>Comments</h2>" + "".join(f"<div class=comment><p>{say(10, 60)}</p></div>" for _ in range(4)) + "</section>"])
    foot = rnd.choice([f"<footer>{say(3, 20)}</footer>", f"<div class=footer>{say(3, 20)}</div>", ""])
    page = f"<html><head><title>{say(2, 5)}</title></head><body><header>{say(1, 4)}</header>{menu}{ad}{open_}{inner}{close}{comments}{foot}</body></html>"
    return page, "\n\n".join(x for _, x in [head, *body])


def test_agreement_on_pages_of_many_layouts():
    import random

    rnd = random.Random(12)
    pages = [page_of(rnd) for _ in range(600)]
    same = sum(he.main_text(p) == t for p, t in pages)
    print(f"pages with just the main text: {same} of {len(pages)}")
    assert same / len(pages) >= 0.95


def test_the_given_pages(spark):
    """Each given page: what its article element holds, and nothing else."""
    import html
    import re

    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()
    for (page,) in rows:
        within = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.DOTALL)
        parts = re.split(r"</?(?:article|p|h1|table|tr|td)>", within[1]) if within else []
        parts = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>|<!--.*?-->", "", x))).split()) for x in parts]
        assert he.main_text(page) == "\n\n".join(x for x in parts if x)
