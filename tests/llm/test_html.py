from __future__ import annotations

import random
from html.parser import HTMLParser

import numpy as np
import pytest

from bitquarry.llm.html import extract_main_text, main_text, text_range

LONG = "This paragraph is long enough to count as text of an article, as it has many words."


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<article><h1>T</h1><p>a  b\n c<br>d<p><b>e</b> &lt;f&gt; &#233;</article><footer>x</footer>", "T\na b c d\ne <f> é"),
        ("<nav>m</nav><article><p>a<aside>s</aside>b<div class='ad'>buy</div><form>q<input></form></article>", "a\nb"),
        ("<article><p>one</p><script>var t='</p>';</script><style>p{}</style><!-- c --><p>two</article>", "one\ntwo"),
        ("<article><p>kept to the end", "kept to the end"),
        ("<article><p>a < b and a<b></article>", "a < b and a"),
        ("<main><h1>h</h1><p>m</p><div id=comments>no</div></main><div class=sidebar>s</div>", "h\nm"),
        (f"<div class=menu><a>x</a></div><ul><li><a>{LONG}</a></ul><p>{LONG}</p><p>short</p><div class=cookie-banner>{LONG}</div>", f"{LONG}\nshort"),
        (f"<div class='layout has-sidebar'><article><p>{LONG}</article></div>", LONG),
        (f"<section class=comments><article><p>{LONG} {LONG}</article></section><article><p>{LONG}</article>", LONG),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


BOX = "<div class=newsletter><p>Join us</p><p>Every week</p><p>No spam</p><p>Sign up</p></div>"
LINKED = "<ul><li><a>one</a><li><a>two</a><li><a>three</a><li><a>four</a></ul>"
MENU = "<nav><p>a</p><p>b</p><p>c</p></nav>"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<p>{LONG}</p>{BOX}<p>{LONG} {LONG}</p>{BOX}<p>The end.</p>", f"{LONG}\n{LONG} {LONG}\nThe end."),
        (f"<p>{LONG}</p>{LINKED}<p>{LONG} {LONG}</p>", f"{LONG}\n{LONG} {LONG}"),
        (f"<p>site</p>{MENU}<h1>Title</h1><p>by me</p><p>today</p><p>here</p><p>now</p><p>{LONG}</p>{MENU}<p>c</p>", f"Title\nby me\ntoday\nhere\nnow\n{LONG}"),
        (f"<article><p>first</p></article><article><p>{LONG}</p></article>", f"first\n{LONG}"),
        (f"<article><h1>T</h1><p>first</p></article><article><h2><a>Other</a></h2><p>{LONG}</p></article><article class='post teaser'><p>{LONG}</article>", "T\nfirst"),
    ],
)
def test_no_part_of_the_text_is_left_out(page, text):
    assert main_text(page) == text


def test_elements_without_an_end_tag_end_with_a_block():
    for name in ("object", "select", "map", "canvas", "video", "audio", "svg", "datalist"):
        assert main_text(f"<article><p>one</p><{name}><option>no<p>two</p></article>") == "one\ntwo"
    assert main_text("<article><p>one</p><script>var a = '<p>no</p>'</article>") == "one"


def plain_range(lengths):
    """Surge and dive, window by window."""
    sums = [sum(lengths[i : i + 3]) for i in range(len(lengths))]
    begin = [i for i, s in enumerate(sums) if s >= 80] or [i for i, s in enumerate(sums) if s]
    if not begin:
        return 0, 0
    lo, hi = begin[0], begin[-1] + 1
    while lo and sums[lo - 1]:
        lo -= 1
    while hi < len(sums) and sums[hi]:
        hi += 1
    return lo, hi


def test_surge_and_dive():
    assert text_range(np.array([0, 5, 0, 0, 0, 40, 0, 60, 3, 0, 0, 0, 9])) == (3, 9)
    assert text_range(np.array([0, 0])) == (0, 0) and text_range(np.array([], np.int64)) == (0, 0)
    rng = random.Random(4)
    for _ in range(3000):
        lengths = [rng.choice([0, 0, 0, 1, 5, 30, 79, 80, 200]) for _ in range(rng.randrange(0, 25))]
        assert text_range(np.array(lengths, np.int64)) == plain_range(lengths), lengths


class Plain(HTMLParser):
    """Blocks of a well-formed page: [text, in an aside, article, characters of links]."""

    def __init__(self, page):
        super().__init__()
        self.open, self.blocks, self.text, self.linked, self.articles = [], [], "", 0, 0
        self.feed(page)
        self.cut()

    def cut(self):
        text = " ".join(self.text.split())
        if text:
            aside = any(n in ("nav", "footer", "header", "aside", "form") or c in ("ad", "newsletter", "sidebar") for n, c, _ in self.open)
            box = all(n in ("aside", "form") or c in ("ad", "newsletter") for n, c, _ in self.open if n in ("nav", "footer", "header", "aside", "form") or c in ("ad", "newsletter", "sidebar"))
            article = next((k for n, _, k in self.open if n == "article"), 0)
            self.blocks.append((text, aside, aside and box, article, self.linked))
        self.text, self.linked = "", 0

    def handle_starttag(self, name, attrs):
        if name != "a":
            self.cut()
        self.articles += name == "article"
        self.open.append((name, dict(attrs).get("class"), self.articles))

    def handle_endtag(self, name):
        if name != "a":
            self.cut()
        assert self.open.pop()[0] == name

    def handle_data(self, data):
        self.text += data
        self.linked += len(data) if any(n == "a" for n, _, _ in self.open) else 0


def plain_text(page):
    blocks = [b for b in Plain(page).blocks if not b[2]]
    marks = any(k and not aside for _, aside, _, k, _ in blocks)
    inside = sum(len(t) for t, aside, _, k, _ in blocks if k and not aside)
    outside = sum(len(t) for t, aside, _, k, linked in blocks if not k and not aside and linked <= 0.6 * len(t))
    trusted = marks and inside * 8 > outside
    length = [0 if aside or trusted and not k else len(t) for t, aside, _, k, _ in blocks]
    menu = [linked > 0.6 * len(t) and not k for t, _, _, k, linked in blocks]
    weight = [0 if m else n for n, m in zip(length, menu, strict=True)]
    lo, hi = plain_range(weight)
    chosen = list(range(lo, hi))
    if trusted:
        touched = {blocks[k][3] for k in chosen if weight[k]}
        chosen = [k for k, b in enumerate(blocks) if b[3] in touched or chosen and chosen[0] <= k <= chosen[-1]]
    out = []
    for n, k in enumerate(chosen):
        between = 0 < n < len(chosen) - 1 and weight[chosen[n - 1]] and weight[chosen[n + 1]]
        if weight[k] or length[k] and between:
            out.append(blocks[k][0])
    return "\n".join(out)


def test_pages_match_a_plain_version():
    rng = random.Random(9)
    text = lambda: " ".join("".join(rng.choice("abcdeß") for _ in range(rng.randrange(1, 9))) for _ in range(rng.choice([1, 2, 4, 12, 40])))
    block = lambda: rng.choice([f"<p>{text()}</p>", f"<h2>{text()}</h2>", f"<p><a href='x'>{text()}</a></p>", f"<p>{text()} <a>{text()}</a> {text()}</p>", f"<div class=ad>{text()}</div>", f"<aside><p>{text()}</p><p>{text()}</p></aside>", f"<form><p>{text()}</p></form>", f"<div><p>{text()}</p></div>", f"<ul><li><a>{text()}</a></li><li><a>{text()}</a></li></ul>"])
    some = lambda n: "".join(block() for _ in range(rng.randrange(n)))
    kinds = set()
    for _ in range(1500):
        parts = [f"<nav>{some(3)}</nav>" if rng.random() < 0.5 else "", some(4), f"<div class=sidebar>{some(4)}</div>" if rng.random() < 0.3 else ""]
        parts += [f"<article><h1>{text()} unlinked</h1>{some(9)}</article>" for _ in range(rng.choice([0, 0, 1, 1, 2]))] + [some(5), f"<footer>{text()}</footer>"]
        page = f"<html><body>{''.join(parts)}</body></html>"
        want = plain_text(page)
        kinds.add((bool(want), "<article" in page))
        assert main_text(page) == want, page
    assert len(kinds) >= 3


def test_marks_weigh_and_names_do_not_cut_an_article():
    assert main_text(f"<article><p>x</p></article><div><p>{LONG}</p><p>{LONG}</p></div>") == f"x\n{LONG}\n{LONG}"  # marks that hold next to nothing
    assert main_text(f"<p>{LONG}</p><article><p>{LONG}</p>{MENU}{MENU}<p>end</p></article>") == f"{LONG}\nend"
    assert main_text(f"<article><p class=legal>{LONG} {LONG} {LONG}</p><p class=notice>Closed today.</p></article>") == f"{LONG} {LONG} {LONG}"
    assert main_text(f"<p>{LONG}</p><p><a>a source</a></p><p>{LONG}</p>") == f"{LONG}\na source\n{LONG}"


def test_a_column_called_like_the_text_gives_way(spark):
    out = extract_main_text(spark.createDataFrame([(1, "old", f"<p>{LONG}</p>", "Z")], "page_id long, Text string, html string, line string"))
    assert out.columns == ["page_id", "text", "line"] and out.first()["text"] == LONG


def test_pages(spark):
    schema = "page_id long, url string, html string, n_chars int"
    rows = [(1, "u", "<article>a", 1), (1, "u", "<article>a", 1), (None, None, None, None), (2, "v", "<p>" + LONG * 5000, 3)]
    out = extract_main_text(spark.createDataFrame(rows, schema))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(((r["page_id"], r["text"]) for r in out.collect()), key=str) == sorted([(1, "a"), (1, "a"), (None, ""), (2, LONG * 5000)], key=str)
    assert extract_main_text(spark.createDataFrame([], schema)).collect() == []
