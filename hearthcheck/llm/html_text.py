"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at block-level tags. A block's features are its word count and link density, those of the
blocks before and after it, whether it is a heading, and whether an enclosing element says article or says furniture
(menus, headers and footers of the page, sidebars, notices, adverts, forms, reader comments). A class, id or role says so
as a whole token, or made of such words and those of ``NEUTRAL_NAMES``; on an outermost article, on main and on elements
that hold one of them such names say nothing. A CART tree trained on the small labelled table below decides which blocks
stay. Scripts, styles, comments, markup and the elements of the head never make blocks, whether the head is closed or not.

White space in a block, ``br`` included, becomes one space; character references are decoded; blocks are joined in page
order by one line feed. Null, empty and tag-only pages give an empty text. Pages are parsed in one pass over the whole
html, unclosed elements included; repeated rows are each parsed. Other columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthcheck.llm.common import rows_of, slices

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "article", "furniture")

# words, link density, then the same of the block before and after, heading, article, furniture, and the label (1: text)
LABELLED = (
    (120, 0.00, 80, 0.00, 95, 0.00, 0, 1, 0, 1), (45, 0.05, 120, 0.00, 60, 0.10, 0, 1, 0, 1), (6, 0.00, 0, 0.00, 80, 0.00, 1, 1, 0, 1),
    (1, 0.00, 90, 0.00, 70, 0.00, 0, 1, 0, 1), (3, 0.00, 2, 0.00, 4, 0.00, 0, 1, 0, 1), (9, 0.00, 1, 1.00, 12, 0.00, 1, 1, 0, 1),
    (2, 1.00, 60, 0.00, 80, 0.00, 0, 1, 0, 1), (30, 0.60, 50, 0.10, 40, 0.00, 0, 1, 0, 1), (12, 0.00, 6, 0.00, 0, 0.00, 0, 1, 0, 1),
    (8, 0.00, 0, 0.00, 0, 0.00, 0, 1, 0, 1), (400, 0.01, 9, 0.00, 11, 0.20, 0, 1, 0, 1), (15, 0.30, 30, 0.20, 20, 0.00, 0, 1, 0, 1),
    (5, 1.00, 9, 0.00, 40, 0.00, 1, 1, 0, 1), (25, 0.00, 8, 1.00, 7, 1.00, 0, 1, 0, 1), (4, 0.00, 50, 0.00, 3, 1.00, 0, 1, 0, 1),
    (40, 0.00, 30, 0.00, 15, 0.90, 0, 1, 0, 1), (50, 0.00, 20, 1.00, 30, 1.00, 0, 1, 0, 1), (3, 0.00, 40, 0.00, 25, 0.80, 1, 1, 0, 1),
    (1, 0.00, 2, 1.00, 20, 1.00, 0, 1, 0, 1), (5, 0.30, 3, 0.00, 2, 0.00, 0, 1, 0, 1), (12, 0.40, 4, 0.00, 6, 0.00, 0, 1, 0, 1),
    (2, 1.00, 60, 0.00, 5, 0.00, 0, 1, 0, 1), (4, 1.00, 30, 0.00, 8, 0.00, 0, 1, 0, 1), (10, 0.50, 8, 0.50, 9, 0.60, 0, 1, 0, 1),
    (60, 0.20, 5, 1.00, 4, 1.00, 0, 1, 0, 1), (2, 0.50, 3, 1.00, 3, 1.00, 0, 1, 0, 1), (7, 0.00, 6, 1.00, 8, 1.00, 1, 1, 0, 1),
    (4, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1), (9, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1), (1, 0.00, 0, 0.00, 0, 0.00, 0, 0, 0, 1),
    (54, 0.00, 150, 0.00, 2, 0.00, 0, 0, 0, 1), (65, 0.10, 80, 0.50, 5, 0.00, 0, 0, 0, 1), (15, 0.05, 115, 1.00, 0, 0.00, 1, 0, 0, 1),
    (40, 0.00, 3, 1.00, 2, 1.00, 0, 0, 0, 1), (30, 0.00, 2, 1.00, 0, 0.00, 0, 0, 0, 1), (100, 0.00, 90, 0.00, 3, 0.00, 0, 0, 0, 1),
    (20, 0.00, 1, 1.00, 1, 0.00, 0, 0, 0, 1), (12, 0.05, 4, 0.00, 4, 0.00, 0, 0, 0, 1), (80, 0.10, 2, 0.00, 0, 0.00, 0, 0, 0, 1),
    (3, 1.00, 40, 0.00, 2, 1.00, 0, 1, 0, 0), (2, 1.00, 3, 1.00, 50, 0.00, 0, 1, 0, 0), (1, 1.00, 12, 0.00, 1, 1.00, 0, 1, 0, 0),
    (3, 1.00, 2, 1.00, 4, 1.00, 0, 1, 0, 0), (2, 1.00, 3, 1.00, 2, 1.00, 0, 1, 0, 0), (5, 1.00, 4, 1.00, 6, 1.00, 0, 1, 0, 0),
    (6, 1.00, 5, 1.00, 3, 1.00, 0, 1, 0, 0), (1, 1.00, 1, 1.00, 1, 1.00, 0, 1, 0, 0), (8, 0.95, 7, 1.00, 9, 1.00, 0, 1, 0, 0),
    (40, 0.00, 30, 0.00, 50, 0.00, 0, 1, 1, 0), (90, 0.00, 60, 0.00, 80, 0.00, 0, 1, 1, 0), (3, 0.00, 40, 0.00, 4, 0.00, 1, 1, 1, 0),
    (12, 0.50, 20, 0.00, 5, 1.00, 0, 1, 1, 0), (1, 0.00, 9, 0.00, 0, 0.00, 0, 1, 1, 0), (150, 0.00, 90, 0.00, 3, 0.00, 0, 1, 1, 0),
    (1, 1.00, 1, 1.00, 1, 1.00, 0, 0, 1, 0), (2, 1.00, 0, 0.00, 3, 1.00, 0, 0, 1, 0), (30, 0.00, 10, 0.00, 20, 0.00, 0, 0, 1, 0),
    (7, 0.00, 1, 1.00, 9, 0.00, 0, 0, 1, 0), (80, 0.00, 5, 0.00, 60, 0.00, 0, 0, 1, 0), (4, 0.25, 70, 0.00, 0, 0.00, 0, 0, 1, 0),
    (200, 0.02, 90, 0.00, 90, 0.00, 0, 0, 1, 0), (10, 0.00, 0, 0.00, 6, 0.00, 1, 0, 1, 0), (15, 0.10, 100, 0.00, 0, 0.00, 0, 0, 1, 0),
    (60, 0.00, 40, 0.00, 70, 0.00, 0, 0, 0, 1), (35, 0.10, 90, 0.00, 12, 0.00, 0, 0, 0, 1), (110, 0.00, 0, 0.00, 50, 0.00, 0, 0, 0, 1),
    (25, 0.00, 6, 0.00, 30, 0.05, 0, 0, 0, 1), (18, 0.20, 45, 0.00, 60, 0.00, 0, 0, 0, 1), (14, 0.00, 60, 0.00, 0, 0.00, 0, 0, 0, 1),
    (7, 0.00, 50, 0.00, 70, 0.00, 0, 0, 0, 1), (5, 0.00, 2, 1.00, 60, 0.00, 1, 0, 0, 1), (8, 0.00, 0, 0.00, 90, 0.00, 1, 0, 0, 1),
    (6, 0.00, 80, 0.00, 100, 0.00, 1, 0, 0, 1), (3, 0.00, 40, 0.00, 55, 0.00, 0, 0, 0, 1), (4, 0.00, 30, 0.10, 25, 0.00, 1, 0, 0, 1),
    (2, 1.00, 3, 1.00, 2, 1.00, 0, 0, 0, 0), (1, 1.00, 2, 1.00, 40, 0.00, 0, 0, 0, 0), (4, 1.00, 80, 0.00, 3, 1.00, 0, 0, 0, 0),
    (9, 0.80, 6, 1.00, 5, 0.90, 0, 0, 0, 0), (12, 0.70, 3, 1.00, 9, 0.50, 0, 0, 0, 0), (30, 0.75, 20, 0.80, 15, 0.90, 0, 0, 0, 0),
    (3, 0.00, 2, 1.00, 4, 1.00, 0, 0, 0, 0), (5, 0.00, 1, 1.00, 2, 1.00, 1, 0, 0, 0), (2, 0.00, 1, 0.00, 3, 0.00, 0, 0, 0, 0),
    (4, 0.00, 3, 0.00, 5, 0.00, 0, 0, 0, 0), (6, 0.50, 4, 0.00, 2, 1.00, 0, 0, 0, 0), (7, 0.00, 3, 1.00, 0, 0.00, 0, 0, 0, 0),
)

# fixed values: elements of the HTML standard that start a block
BLOCK_TAGS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
HIDDEN_TAGS = frozenset("script style noscript template textarea svg math iframe object title".split())
FURNITURE_TAGS = frozenset("nav footer aside form dialog menu fieldset button select".split())
ARTICLE_TAGS = frozenset(["article", "main"])
FURNITURE_NAMES = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay popup promo promoted "
    "related replies reply respond share sharing sidebar signup social sponsor sponsored subscribe toolbar widget widgets "
    "alert complementary contentinfo dialog search".split()
)
# parts that say where a piece of furniture stands or what shape it has
NEUTRAL_NAMES = frozenset(
    "area bar block bottom box container content global inner item items left link links list main outer page primary right "
    "secondary section site sticky top wrap wrapper".split()
)
ARTICLE_NAMES = frozenset("article content entry post story main".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*)([^>]*)>")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[a-z]+")


def _flags(tag: str, attributes: str, article: bool, within: bool) -> tuple[bool, bool, bool]:
    """Whether an element says article, says furniture by its tag or by being hidden, and says furniture by its names."""
    furniture = tag in FURNITURE_TAGS or (tag == "header" and not article)
    own, named = tag in ARTICLE_TAGS, False
    if attributes:
        tokens = [set(_PARTS.findall(x)) for m in _NAMES.finditer(attributes) for x in (m[1] or m[2] or m[3] or "").lower().split()]
        said = FURNITURE_NAMES if article else FURNITURE_NAMES | {"header"}
        named = any(not said.isdisjoint(x) and x <= said | NEUTRAL_NAMES for x in tokens)
        named &= within or tag not in ARTICLE_TAGS
        furniture |= bool(_UNSEEN.search(attributes))
        own |= any(not ARTICLE_NAMES.isdisjoint(x) for x in tokens)
    inside = tag not in ("html", "body")
    return own, furniture and inside, named and inside


def blocks_of(html: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, words in links, heading, article, furniture) of the non-empty flat blocks, in page order."""
    out: list[tuple[str, int, int, bool, bool, bool, list | None]] = []
    texts: list[str] = []
    linked: list[str] = []
    open_tags: list[tuple[str, bool, bool, bool, list | None]] = []
    article = furniture = link = heading = within = False
    # the innermost element with names of furniture: [whether they count, the next one out]
    named: list | None = None

    def close_block() -> None:
        if texts:
            words = unescape("".join(texts)).split()
            if words:
                out.append((" ".join(words), len(words), len(unescape("".join(linked)).split()), heading, article, furniture, named))
            texts.clear()
            linked.clear()

    at, size = 0, len(html)
    while at < size:
        mark = html.find("<", at)
        piece = html[at:] if mark < 0 else html[at:mark]
        if piece:
            texts.append(piece)
            if link:
                linked.append(piece)
        if mark < 0:
            break
        if html.startswith("<!--", mark):
            stop = html.find("-->", mark + 4)
            at = size if stop < 0 else stop + 3
            continue
        if html[mark + 1 : mark + 2] in ("!", "?"):
            stop = html.find(">", mark)
            at = size if stop < 0 else stop + 1
            continue
        found = _TAG.match(html, mark) or _LOOSE_TAG.match(html, mark)
        if not found:
            texts.append("<")
            at = mark + 1
            continue
        at, closing, tag, attributes = found.end(), bool(found[1]), found[2].lower(), found[3]
        if tag in HIDDEN_TAGS:
            if not closing and not attributes.endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(html, at)
                end = html.find(">", stop.start()) if stop else -1
                at = size if end < 0 else end + 1
            if tag == "title":
                close_block()
            continue
        if tag == "head":
            close_block()
            continue
        if tag == "br":
            texts.append(" ")
            linked.append(" ")
        elif tag == "a":
            link = not closing
            texts.append("")
        if tag not in BLOCK_TAGS and tag not in ("button", "label"):
            continue
        close_block()
        link = False
        heading = not closing and tag in ("h1", "h2", "h3", "h4", "h5", "h6")
        if tag in VOID_TAGS or attributes.endswith("/"):
            continue
        if closing:
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == tag:
                    del open_tags[k:]
                    break
        elif tag not in ("p", "li", "dt", "dd", "td", "th", "tr", "option", "h1", "h2", "h3", "h4", "h5", "h6") or attributes:
            own, bad, names = _flags(tag, attributes, article, within)
            if tag in ARTICLE_TAGS and not within:
                holder = named
                while holder and holder[0]:
                    holder[0], holder = False, holder[1]
            within |= tag in ARTICLE_TAGS
            open_tags.append((tag, article or own, furniture or bad, within, [True, named] if names else named))
        article, furniture, within, named = open_tags[-1][1:] if open_tags else (False, False, False, None)
    close_block()
    return [(*block, bad or bool(names and names[0])) for *block, bad, names in out]


def features_of(blocks: list[tuple[str, int, int, bool, bool, bool]]) -> np.ndarray:
    own = np.array([(n, k / n, h, a, f) for _, n, k, h, a, f in blocks], float).reshape(-1, 5)
    edge = np.zeros((1, 2))
    before, after = np.vstack([edge, own[:-1, :2]]), np.vstack([own[1:, :2], edge])
    return np.hstack([own[:, :2], before[: len(own)], after[: len(own)], own[:, 2:]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple:
    """A CART tree by Gini impurity: (share of text,) at leaves, (feature, threshold, low side, high side) inside."""
    if depth == 0 or len(set(y.tolist())) < 2:
        return (float(y.mean()),)
    best = None
    for feature in range(x.shape[1]):
        values = np.unique(x[:, feature])
        for cut in (values[:-1] + values[1:]) / 2:
            low = x[:, feature] <= cut
            impurity = sum(len(part) * part.mean() * (1 - part.mean()) for part in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, feature, float(cut), low)
    if best is None:
        return (float(y.mean()),)
    _, feature, cut, low = best
    return (feature, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def decide(tree: tuple, x: np.ndarray) -> np.ndarray:
    """Which rows are text."""
    if len(tree) == 1:
        return np.full(len(x), tree[0] >= 0.5)
    feature, cut, low, high = tree
    return np.where(x[:, feature] <= cut, decide(low, x), decide(high, x))


def trained() -> tuple:
    table = np.array(LABELLED, float)
    return grow(table[:, :-1], table[:, -1])


def main_text(html: str, tree: tuple) -> str:
    blocks = blocks_of(html)
    if not blocks:
        return ""
    return "\n".join(b[0] for b, keep in zip(blocks, decide(tree, features_of(blocks))) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    tree = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            texts = [main_text(x or "", tree) for x in rows_of(batch, "html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return slim.mapInArrow(run, "page_id long, url string, text string, n_chars long")
