"""Blocks of pages against hand-made answers; the network's gradients; accuracy on pages it never saw."""

from __future__ import annotations

import re
import time
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest

from surveyspan.llm import block_lstm, html_extraction, training_pages
from surveyspan.llm.page_blocks import Paths, page_blocks
from surveyspan.llm.tools import share_package

PAGE = "page_id long, url string, html string, text string, n_chars long, label int"


@pytest.fixture(scope="module")
def network():
    return html_extraction.labeller()


def texts(network, *pages):
    return list(html_extraction.Extractor(network).texts(iter(pages)))


def blocks(page):
    return [b.text for b in page_blocks(page, Paths())]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("plain &amp; simple", ["plain & simple"]),
        ("<p>one<p>two<div>three</div>four", ["one", "two", "three", "four"]),
        ("<p>a<b>b</b>c <i>d</i>\n e<br>f&nbsp;&#x67;</p>", ["abc d e f g"]),
        ("<p>x<!-- no > text -->y</p><!--><p>z", ["xy", "z"]),
        ('<p title="a > b">t</p><p data-x=\'"\'>u</p><p a=">v', ["t", "u", "v"]),
        ('<script>var t="</p><p>no";</script><style>p{}</style><p>yes', ["yes"]),
        ("<title>no</title><body>yes<textarea>no</textarea><select><option>no</select>more", ["yes", "more"]),
        ("<svg><text>no</text></svg><noscript><p>no</p></noscript><p>yes</p>", ["yes"]),
        ("a < b and c <3 d </ e> f <? g ?> h", ["a < b and c <3 d f h"]),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e", ["a", "b", "c", "d", "e"]),
        ("<table><tr><td>a<td>b<tr><th>c<table><tr><td>d</table></table>e", ["a", "b", "c", "d", "e"]),
        ("<p>cut off <a hre", ["cut off"]),
        ("<p>cut off <!-- comment", ["cut off"]),
        ("<p>one<script>never closed <p>no", ["one"]),
        ("&lt;p&gt; &amp;copy; &eacute;&#233;&#0; 漢字   x\x1cy", ["<p> &copy; éé� 漢字 x y"]),
        ("<P CLASS=X>Upper</P><SCRIPT>no</SCRIPT>", ["Upper"]),
        ("<p>a<hr>b<dl><dt>c<dd>d<dt>e</dl>", ["a", "b", "c", "d", "e"]),
    ],
)
def test_blocks(page, want):
    assert blocks(page) == want


def test_paths_of_blocks():
    paths = Paths()
    found = page_blocks('<div class="Main-Text"><p><b>a</b><li><a href=x>bc d</a>e</li></div>f', paths)
    tags = {i: k[1:] for k, i in paths.children.items()}

    def path(node):
        return [] if node == 0 else [*path(paths.parents[node]), tags[node][0]]

    assert [(b.text, path(b.node), b.linked) for b in found] == [
        ("a", ["div", "p", "b"], 0), ("bc de", ["div", "li", "a"], 3), ("f", [], 0)
    ]
    again = page_blocks('<div class="Main-Text"><p>x</p></div>', paths)
    assert again[0].node == paths.parents[found[0].node]


class _Plain(HTMLParser):
    """All shown text of a page, by the standard library."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "title")
        self.out.append(" ")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "title")
        self.out.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.out.append(data)


def given_pages(sf_dir, spark):
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def test_blocks_hold_all_shown_text(spark, sf_dir):
    for r in given_pages(sf_dir, spark).collect():
        plain = _Plain()
        plain.feed(r["html"])
        plain.close()
        assert "".join(" ".join(blocks(r["html"])).split()) == "".join("".join(plain.out).split())


@pytest.mark.parametrize(
    "part",
    ["<div>", "<p><b>", "<b><p>", "</div>", "</b>", "<!--", "<!-- x ", "<a ", '<a href="', "<a x='", "<script>", "<title", "&", "&amp", "<", "</", "<li><i>",
     "<!x", "<table><tr><td>", "<hr><b>", "<svg>", '<p class="a b', "x ", "<p>x", '<div class="a">x', "<i>x<hr>", "=\"", "<a b=\"c\" '"],
)
def test_hostile_pages_take_linear_time(network, part):
    start = time.process_time()
    page = part * (400_000 // len(part))
    found = page_blocks(page, Paths())
    assert time.process_time() - start < 6
    assert len(found) <= len(page)


def test_one_huge_page(network):
    start = time.process_time()
    page = "<article><h1>Some title</h1>" + "<p>Some words of a long article, and more of them here.</p>" * 30_000 + "</article>"
    assert texts(network, page)[0].count("long article") == 30_000
    assert time.process_time() - start < 60


def test_gradients():
    paths = Paths()
    pages = [training_pages.labelled_page(s, paths) for s in (3, 4)]
    pages = [(b[:9], y[:9]) for b, y in pages]
    data = [block_lstm._sparse(b, y, paths) for b, y in pages]
    random = np.random.default_rng(0)
    net = block_lstm.Network.initial(random)
    for i, p in enumerate(net.parts()):
        setattr(net, ("path", "word", "w", "u", "b", "out", "bias")[i], p.astype(np.float64))

    def loss():
        vectors = net.path_vectors(paths, [])
        p = np.concatenate(net.probabilities([b for b, _ in pages], vectors))
        y = np.concatenate([np.array(y, float) for _, y in pages])
        return float(-np.mean(np.where(y == 1, np.log(p), np.log(1 - p))))

    found = block_lstm._gradients(net, data)
    for part, gradient in zip(net.parts(), found, strict=True):
        for _ in range(4):
            at = np.unravel_index(np.abs(gradient).argmax() if _ == 0 else random.integers(gradient.size), gradient.shape)
            old, step = part[at], 1e-3
            part[at] = old + step
            up = loss()
            part[at] = old - step
            down = loss()
            part[at] = old
            assert abs((up - down) / (2 * step) - gradient[at]) < 2e-4 + 0.02 * abs(gradient[at])


def test_accuracy_on_unseen_pages(network):
    paths = Paths()
    pages = [training_pages.labelled_page(10**6 + i, paths) for i in range(300)]
    found = network.probabilities([b for b, _ in pages], network.path_vectors(paths, []))
    right = np.concatenate([(p > 0.5) == np.array(y, bool) for p, (_, y) in zip(found, pages, strict=True)])
    assert right.mean() > 0.99


def article_of(page):
    """The given pages have one article element; its text by plain means."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(blocks(inside))


def test_given_pages(spark, sf_dir, network):
    rows = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/pages.parquet").collect()
    got = texts(network, *[r["html"] for r in rows])
    wrong = [r["page_id"] for r, t in zip(rows, got, strict=True) if t != article_of(r["html"])]
    assert len(wrong) <= 2, wrong


LONG = "The committee met on Tuesday and agreed on a plan for the harbour. Its members will meet again in May."
MORE = "Work on the quay starts next year, said the mayor, and should take three summers in all."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><head><title>A plan</title></head><body><header><a href=/>Daily</a></header><nav><a href=/a>Home</a></nav><main><h1>A plan</h1><p>{LONG}</p><p>{MORE}</p></main>"
        "<aside><h3>Related</h3><ul><li><a href=/b>Another story of the day</a></li></ul></aside><footer>© Daily</footer></body></html>",
        f'<body><div id="header"><h2><a href="/">Daily</a></h2></div><div class="sidebar"><p>Popular this week in town</p></div><div class="post-content"><h1>A plan</h1><p>{LONG}</p><p>{MORE}</p></div>'
        '<div id="comments"><h3>2 comments</h3><p>I never believed that they would do it, to be honest.</p><p>Me neither. Let us see.</p></div><div id="footer"><p>Imprint</p></div>',
        f'<div class="cookie-notice">We use cookies. <button>OK</button></div><article><h1>A plan</h1><p>{LONG}</p><div class="ad">Buy two lamps and get one free.</div><p>{MORE}</p></article>'
        '<section class="comments"><article><b>Jo</b><p>What a fine article this is!</p></article></section>',
        f'<nav><ul><li><a href="/x">News</a><li><a href="/y">Sport</a></ul></nav><article><h1>A plan</h1><p>{LONG}<p>{MORE}</article><form><label>E-mail</label><input><button>Subscribe</button></form><script>x("<p>")</script>',
    ],
)
def test_hand_made_pages(network, page):
    assert texts(network, page)[0] == f"A plan {LONG} {MORE}"


def test_odd_rows(spark, sf_dir, network):
    share_package(spark)
    whole = given_pages(sf_dir, spark).first()["html"]
    rows = [(1, "u", None), (2, None, ""), (None, "u", whole), (3, "u", whole), (3, "u", whole), (4, "u", " \n "), (5, "u", "<nav><a href=x>Home</a></nav>")]
    pages = spark.createDataFrame([(*r, "old", 7, 8) for r in rows], PAGE)
    got = html_extraction.extract_pages(pages, network)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    want = [(k, u, t, len(t)) for (k, u, _), t in zip(rows, texts(network, *[h for *_, h in rows]), strict=True)]
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)
    assert {r["page_id"]: r["text"] for r in got.collect() if r["page_id"] in (1, 2, 4, 5)} == dict.fromkeys((1, 2, 4, 5), "")
    assert html_extraction.extract_pages(pages.limit(0), network).count() == 0


def test_grouping_changes_nothing(network, sf_dir, spark, monkeypatch):
    pages = [r["html"] for r in given_pages(sf_dir, spark).collect()]
    want = texts(network, *pages)
    monkeypatch.setattr(html_extraction, "GROUP", 30)
    monkeypatch.setattr(html_extraction, "MOST_PATHS", 5)
    assert texts(network, *pages) == want
