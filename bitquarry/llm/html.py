"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block of the page in page order. The length of a line is its text's, but 0
where it belongs to a menu, header, footer, sidebar, notice, advert, form, comment or other part that isn't the
article, or where it is little but links. The distribution is the sum of the lengths over windows of ``WINDOW``
lines. On every page the main text goes from the first run of lines whose sums rise over a threshold, the surge, to
the dive of the last, where the sums fall to nothing. Boxes within a text (adverts, forms, newsletters) have no line in
it. Marks of an article weigh: while marked lines hold more than a share of ``1 / MARKED`` of the text, others count
nothing, and a marked element that the surge or the dive falls into belongs to the text as a whole, so its title, its
byline and a short last line do. A single line of links between two lines of text is text, a row of them is a menu.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import prepare, table

WINDOW = 3
#: The sum over a window at which an unmarked page's text begins, and the share of links that makes a menu.
SURGE, LINKS = 80, 0.6
#: How many times as much as marked lines others may hold before the marks count for nothing.
MARKED = 8
#: Characters from which a text block within an article is text whatever its class is called: notices and adverts are shorter.
LONG = 3 * SURGE

# Elements by what they are for.
RAW = frozenset("script style noscript template iframe object svg math canvas audio video map title textarea select datalist".split())
#: Of these, what browsers read on to the end tag or the end of the page; the others end with a block where theirs is left out.
RAW_TEXT = frozenset("script style noscript template iframe title textarea".split())
ASIDE = frozenset("nav header footer aside form button dialog menu label fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Blocks that another block ends where their end tag is left out.
OPEN_ENDED = frozenset("p li dd dt td th tr option".split())
NAMES = re.compile(
    r"(?:^|[\s_-])(?:nav\w*|menu\w*|header|masthead|footer|side-?bar\w*|aside|ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|sign-up|login|share|sharing|social|related|recommend\w*|comments?|replies|respond|breadcrumbs?|pagination|pager|widgets?|toolbar|search|copyright|legal|skip-link|hidden)(?:$|[\s_-])",
    re.I,
)
#: Blocks that hold one piece of text.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt td figcaption".split())
#: Of these, what stands within a text: it ends none.
BOXES = frozenset("aside form button label fieldset".split())
BOX_NAMES = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|banner\w*|sponsor\w*|promo\w*|newsletter|subscribe|subscription|signup|sign-up|share|sharing|social|related|recommend\w*|widgets?)(?:$|[\s_-])", re.I)
#: What article elements are called that only lead to another page.
TEASER = re.compile(r"(?:^|[\s_-])(?:teasers?|cards?|previews?)(?:$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())

_TOKEN = re.compile(
    r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|(?P<text>[^<]+)|(?P<rest><(?:/?[a-zA-Z][^>]*(?:>|\Z))?)",
    re.S,
)
#: Class names that only speak of such a part.
_ABOUT = re.compile(r"\b(?:no|has|with|without|is|hide|show)-[\w-]+", re.I)
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACE = re.compile(r"\s+")


_BLOCK_TAG = re.compile(rf"</?(?:{'|'.join(sorted(BLOCK - {'option'}))})(?=[\s/>])", re.I)


class Line(NamedTuple):
    text: str
    article: int  # number of the outermost article element that it lies in; 0: none
    main: bool  # whether it lies in a main element
    aside: bool
    linked: int  # characters of its text that are links
    box: bool  # whether all asides that it lies in are boxes within a text
    teaser: bool  # whether its article is called a teaser or an aside
    named: bool  # whether it is an aside only as the text block itself is called so


def _is_aside(name: str, attrs: str) -> bool:
    if name in ASIDE:
        return True
    if not attrs.strip(" /") or name in ("body", "html", "article", "main"):
        return False
    by = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    if "hidden" in by or by.get("aria-hidden", "").lower() == "true" or by.get("role", "").lower() in ROLES:
        return True
    return bool(NAMES.search(_ABOUT.sub(" ", by.get("class", ""))) or NAMES.search(by.get("id", "")) or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", by.get("style", ""), re.I))


def _named(attrs: str) -> str:
    by = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)}
    return f"{_ABOUT.sub(' ', by.get('class', ''))} {by.get('id', '')}"


def page_lines(page: str) -> list[Line]:
    """The blocks of a page in page order, without markup, comments, scripts and styles; empty ones are left out."""
    out: list[Line] = []
    parts: list[str] = []
    linked = links = article = articles = depth = mains = 0
    teaser = False
    #: Of the open asides: the name, how many of that name are open in it, whether it holds comments and is a box.
    asides: list[tuple[str, int, bool, bool]] = []
    raw_until = 0
    unclosed: set[str] = set()  # names without an end tag from here on

    def flush() -> None:
        nonlocal linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            named = len(asides) == 1 and asides[0][0] in TEXT_BLOCKS
            out.append(Line(text, article, mains > 0, bool(asides), linked, bool(asides) and all(a[3] for a in asides), teaser and article > 0, named))
        parts.clear()
        linked = 0

    for m in _TOKEN.finditer(page):
        if m.start() < raw_until:
            continue
        text = m["text"]
        if text is None and m["name"] is None:
            if m["rest"] == "<":  # a bare sign
                parts.append("&lt;")
            continue
        if text is not None:
            parts.append(text)
            if links:
                linked += len(text)
            continue
        name, end = m["name"].lower(), bool(m["end"])
        if name in RAW and not end:
            if not m["attrs"].endswith("/") or name not in ("svg", "math"):
                close = None if name in unclosed else re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>|</{re.escape(name)}\Z", re.I).search(page, m.end())
                if not close:
                    unclosed.add(name)
                block = None if close or name in RAW_TEXT else _BLOCK_TAG.search(page, m.end())
                raw_until = close.end() if close else block.start() if block else len(page)
            continue
        if name in BLOCK:
            flush()
            if asides and asides[-1][0] in OPEN_ENDED and (name != asides[-1][0] or not end):
                asides.pop()
        elif name == "br":
            parts.append(" ")
        if name == "a":
            links = 0 if end else 1
        if end:
            if name == "article":
                depth = max(0, depth - 1)
                if not depth:
                    article = 0
            elif name == "main":
                mains = max(0, mains - 1)
            for k in range(len(asides) - 1, -1, -1):
                if asides[k][0] == name:
                    asides[k] = name, asides[k][1] - 1, *asides[k][2:]
                    if not asides[k][1]:
                        if name not in BLOCK:
                            flush()
                        del asides[k:]
                    break
        elif name not in VOID:
            if name == "article":
                depth += 1
                if depth == 1:
                    articles += 1
                    article = articles
                    called = _named(m["attrs"])
                    teaser = bool(TEASER.search(called) or NAMES.search(called))
                    if not any(a in ASIDE or held for a, _, held, _ in asides):
                        asides.clear()  # what holds the article is none, whatever it is called
            elif name == "main":
                mains += 1
            if asides and asides[-1][0] == name:
                asides[-1] = name, asides[-1][1] + 1, *asides[-1][2:]
            elif _is_aside(name, m["attrs"]):
                if name not in BLOCK:
                    flush()
                asides.append((name, 1, bool(re.search("comment|repl|respon", m["attrs"], re.I)), name in BOXES or (name not in ASIDE and bool(BOX_NAMES.search(_named(m["attrs"]))))))
    flush()
    return out


def text_range(lengths: np.ndarray, window: int = WINDOW, threshold: int = SURGE) -> tuple[int, int]:
    """The range of lines from the first line of the first run with a surge to the dive of the last one.

    A run goes on while the sums over the windows that begin in it are above 0, so up to ``window - 1`` empty lines
    in a row lie inside it. Short lines before a surge are its title, byline or date. Without a sum over the threshold
    all runs count; (0, 0) without text.
    """
    n = len(lengths)
    total = np.concatenate([[0], np.cumsum(lengths)])
    sums = total[np.minimum(np.arange(n) + window, n)] - total[:n]
    over = np.flatnonzero(sums >= threshold)
    if not len(over):
        over = np.flatnonzero(sums)
    if not len(over):
        return 0, 0
    nothing = np.flatnonzero(sums == 0)
    before, after = nothing[nothing < over[0]], nothing[nothing > over[-1]]
    return (int(before[-1]) + 1 if len(before) else 0), (int(after[0]) if len(after) else n)


def _articles(lines: list[Line]) -> set[int]:
    """The article elements with text that aren't teasers: by name, or a linked heading with few lines; all if each is."""
    found: dict[int, list[Line]] = {}
    for line in lines:
        if line.article and not line.aside:
            found.setdefault(line.article, []).append(line)
    for teaser in (lambda x: x[0].teaser, lambda x: len(x) <= WINDOW and _links(x[0])):
        found = {k: x for k, x in found.items() if not teaser(x)} or found
    return set(found)


def _links(line: Line) -> bool:
    return line.linked > LINKS * len(line.text)


def main_text(page: str | None) -> str:
    """The article of a page: its blocks joined by line feeds. Null and empty pages have none."""
    lines = page_lines(page or "")
    which = _articles(lines)
    if which:
        part = [x.article if x.article in which else 0 for x in lines]
    else:
        part = [int(x.main) for x in lines]
    marked = np.array([k > 0 for k in part], bool)
    aside = np.array([x.aside and not (x.named and x.article > 0 and len(x.text) >= LONG and not _links(x)) for x in lines], bool)
    if which:  # teasers
        aside |= np.array([x.article > 0 and x.article not in which for x in lines], bool)
    lengths = np.array([len(x.text) for x in lines], np.int64)
    lengths[aside] = 0
    links = np.array([_links(x) for x in lines], bool) & ~marked
    trusted = int(lengths[marked].sum()) * MARKED > int(lengths[~marked & ~links].sum())
    if trusted and marked.any():
        lengths[~marked] = 0
    weights = np.where(links, 0, lengths)
    shown = np.array([not (x.box and out) for x, out in zip(lines, aside, strict=True)], bool)  # boxes end no run
    at = np.flatnonzero(shown)
    lo, hi = text_range(weights[at])
    chosen = at[lo:hi]
    if trusted and len(chosen):
        touched = {part[k] for k in chosen.tolist() if weights[k]}
        chosen = np.array([k for k in at.tolist() if part[k] in touched or chosen[0] <= k <= chosen[-1]], np.int64)
    out = []
    for n, k in enumerate(chosen.tolist()):
        alone = lengths[k] and 0 < n < len(chosen) - 1 and weights[chosen[n - 1]] and weights[chosen[n + 1]]
        if weights[k] or alone:
            out.append(lines[k].text)
    return "\n".join(out)


def extract_main_text(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """``pages`` with the page column replaced by the main text, all other columns as they are; nothing is shuffled.

    Null and empty pages, and pages without an article, give the empty text. Repeated rows each give a row. Pages may
    be of any length. Of articles that are alike all count, in page order. A column that is already called ``text_col``
    gives way to the main text.
    """
    prepare(pages.sparkSession)
    pages = pages.select(*(c for c in pages.columns if c == html_col or c.lower() != text_col.lower()))
    at = pages.columns.index(html_col)
    names = [text_col if c == html_col else c for c in pages.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(p) for p in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else batch.column(k) for k in range(len(names))], names=names)

    clean = pages.withColumn(html_col, F.col(html_col).cast("string")).toDF(*names)
    return pages.withColumn(html_col, F.col(html_col).cast("string")).mapInArrow(run, clean.schema)


def op6_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""
    out = extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
