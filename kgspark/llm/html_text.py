"""Main-text extraction from flat text blocks, judged by a small decision tree.

A page is cut into blocks at block-level tags, in one scan that takes time in proportion to the page. A block is
described by its number of words and link density (share of its words inside links), those of the blocks
before and after it, whether it is a heading, whether it ends like a sentence, and where it stands: in an
article, in a frame (nav, footer, form and the like), in a container whose names hint at something else
(Kohlschuetter et al. 2010, with containers added). A decision tree, grown in numpy on the labelled table
below, keeps or drops each block. Each page is handled alone, so there is no shuffle.

A frame or hint says nothing if its container holds most of the page's unlinked words and no article stands
outside it: such names and forms wrap the main text. An article ends all frames and hints around it but
comments; its own names count only if they speak of comments.

Defined results: a null or empty html, or one without main text, gives an empty text. An unclosed comment,
script or style ends where the page ends; of any other unclosed element only the tag goes. White space of any
kind inside a block becomes one space; a line break tag counts as white space. Each row gives one row, repeated
or not. An empty table gives no rows. Columns other than page_id, url and html are not read.
"""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import pick, slices

_TAG = re.compile(r"</?([a-zA-Z][\w:-]*)")
#: The rest of a tag, with > inside quotes; and without regard to quotes.
_QUOTED, _PLAIN = re.compile(r"(?:[^>\"']|\"[^\"<]*\"|'[^'<]*')*+[^>]*>"), re.compile(r"[^>]*>")
#: Elements whose content is no text of the page.
_RAW = frozenset("script style noscript template svg textarea iframe object select button".split())
#: What shows that such an element was left open: the next one of its kind, or the page going on.
_ENDS = {
    t: re.compile(rf"</{t}\s*>" + (rf"|<(?:{t}|article|main|p|h[1-6])(?=[\s/>])" if t in ("button", "select", "textarea") else ""), re.I)
    for t in _RAW
}
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
_CONTAINER = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form head header main menu nav ol section table td tr ul".split())
_FRAME = frozenset("nav header footer aside form head menu dialog".split())
#: Blocks that hold no other blocks: a link that is opened in one ends with it.
_LEAF = frozenset("p pre h1 h2 h3 h4 h5 h6 summary caption legend option".split())


def _words(pattern: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?:{pattern})(?=$|[\s_-])", re.I)


#: Words of class, id and role that name what stands around an article (fixed values): reader comments; clear
#: names; names that wrap main text as well.
_TALK = _words(r"comments?(?![_-](?:open|closed|off|count))|respond|replies|disqus")
_CLEAR = _words(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|sidebar\w*|menu\w*|nav\w*|breadcrumbs?|footer|masthead|cookies?|consent|gdpr|popup|modal|"
    r"newsletter|subscribe|signup|login|share|sharing|social|related|recommended|pagination|pager|copyright|toolbar|skip"
)
_VAGUE = _words(r"tags?|search|widget\w*|alert|notices?|header|legal")
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())

COLUMNS = ("words", "links", "words_before", "links_before", "words_after", "links_after", "heading", "sentence", "article", "frame", "hint")

#: The labelled table: blocks as common page layouts have them; columns as in COLUMNS, then 1 for main text.
LABELLED = """
3 1.00 0 0.00 3 1.00 0 0 0 1 0
1 1.00 1 1.00 1 1.00 0 0 0 1 0
2 1.00 2 1.00 6 0.00 0 0 0 1 0
1 1.00 1 1.00 8 0.00 0 0 0 0 0
2 1.00 1 1.00 2 1.00 0 0 0 0 0
4 0.90 2 1.00 3 1.00 0 0 0 0 0
9 0.00 1 1.00 10 0.00 0 1 0 1 0
8 0.00 1 1.00 12 0.00 0 1 0 1 0
40 0.00 1 1.00 9 0.00 0 1 0 1 0
25 0.10 60 0.00 30 0.00 0 1 0 1 0
60 0.00 80 0.00 12 0.00 0 1 0 1 0
90 0.00 50 0.00 70 0.00 0 1 1 1 0
30 0.00 20 0.00 25 0.00 0 1 1 1 0
12 0.00 90 0.00 15 0.00 0 1 1 1 0
5 0.00 70 0.00 30 0.00 1 0 1 1 0
4 0.00 90 0.00 6 1.00 1 0 0 1 0
15 0.30 60 0.00 0 0.00 0 1 0 1 0
12 0.00 80 0.00 0 0.00 0 1 0 1 0
6 0.00 90 0.00 4 0.00 0 0 0 0 0
4 0.00 0 0.00 3 1.00 0 0 0 0 0
5 0.00 3 1.00 4 0.00 0 0 0 0 0
7 0.00 4 0.00 2 1.00 0 1 0 0 0
10 0.40 60 0.00 5 0.50 0 0 0 0 0
9 0.60 40 0.00 9 0.60 0 0 0 0 0
30 0.70 50 0.00 30 0.80 0 0 0 0 0
14 0.80 70 0.00 0 0.00 0 1 0 0 0
3 0.00 5 0.00 2 0.00 0 0 0 0 0
8 0.00 0 0.00 60 0.00 1 0 1 0 1
10 0.00 9 0.00 90 0.00 1 0 1 0 1
12 0.00 1 1.00 5 0.00 1 0 1 0 1
1 0.00 8 0.00 40 0.00 1 0 1 0 1
4 0.00 90 0.00 70 0.00 1 0 1 0 1
60 0.00 10 0.00 80 0.00 0 1 1 0 1
120 0.05 60 0.00 90 0.00 0 1 1 0 1
15 0.00 90 0.00 60 0.00 0 1 1 0 1
3 0.00 40 0.00 90 0.00 0 1 1 0 1
1 0.00 80 0.00 30 0.00 0 1 1 0 1
2 0.00 80 0.00 12 0.00 0 0 1 0 1
6 0.00 30 0.00 9 0.00 0 1 1 0 1
35 0.20 50 0.00 9 0.00 0 1 1 0 1
22 0.40 80 0.00 60 0.00 0 1 1 0 1
9 0.00 8 0.00 12 0.20 0 0 1 0 1
11 0.00 12 0.00 2 1.00 0 1 1 0 1
4 1.00 80 0.00 3 1.00 0 0 1 0 0
3 1.00 4 1.00 12 0.00 0 0 1 0 0
9 0.90 60 0.00 8 0.90 0 0 1 0 0
12 1.00 10 1.00 0 0.00 0 1 1 0 0
6 1.00 3 0.00 60 0.00 1 0 1 0 1
5 0.80 4 0.00 90 0.00 1 0 1 0 1
45 0.00 8 0.00 60 0.00 0 1 0 0 1
80 0.05 45 0.00 70 0.00 0 1 0 0 1
25 0.10 80 0.00 40 0.00 0 1 0 0 1
18 0.00 60 0.00 50 0.00 0 1 0 0 1
12 0.00 60 0.00 70 0.00 0 1 0 0 1
8 0.00 70 0.00 40 0.00 0 1 0 0 1
7 0.00 3 1.00 50 0.00 1 0 0 0 1
9 0.00 12 0.00 80 0.00 1 0 0 0 1
4 0.00 90 0.00 60 0.00 1 0 0 0 1
30 0.00 6 0.00 5 0.00 0 1 0 0 1
55 0.15 30 0.00 4 1.00 0 1 0 0 1
7 0.00 9 0.00 7 0.00 1 1 1 0 1
8 0.00 10 0.00 8 0.00 1 0 1 0 1
12 0.00 6 0.00 12 0.00 1 0 1 0 1
6 0.00 1 1.00 3 0.00 1 0 1 0 1
11 0.00 8 0.00 2 0.00 1 0 1 0 1
7 0.00 7 0.00 12 0.20 0 1 1 0 1
8 0.00 12 0.00 5 0.00 0 0 1 0 1
10 0.00 11 0.00 9 0.10 0 1 1 0 1
4 0.00 6 0.00 12 0.00 0 1 1 0 1
2 0.00 5 0.00 10 0.00 0 1 1 0 1
1 0.00 3 0.00 9 0.00 0 0 1 0 1
3 0.00 20 0.00 2 0.00 0 1 1 0 1
5 0.00 4 0.00 4 0.00 0 0 1 0 1
14 0.10 20 0.00 6 1.00 0 1 1 0 1
9 0.30 7 0.00 11 0.00 0 1 1 0 1
3 0.00 1 1.00 0 0.00 0 1 1 0 1
8 0.00 0 0.00 0 0.00 0 1 1 0 1
30 0.00 0 0.00 0 0.00 0 1 1 0 1
70 0.00 8 0.00 8 0.00 0 1 1 0 1
6 0.00 60 0.00 60 0.00 0 0 1 0 1
60 0.00 0 0.00 0 0.00 0 1 0 0 1
2 0.00 0 0.00 40 0.00 0 0 0 0 0
1 0.00 2 0.00 50 0.00 0 0 0 0 0
3 0.00 1 1.00 60 0.00 0 0 0 0 0
2 0.00 60 0.00 2 0.00 0 0 0 0 0
3 0.00 80 0.00 1 1.00 0 0 0 0 0
5 0.00 2 1.00 8 0.00 1 0 0 0 0
4 0.00 50 0.00 3 1.00 1 0 0 0 0
6 0.00 2 0.00 4 0.00 0 1 0 0 0
3 0.00 70 0.00 0 0.00 0 1 0 0 0
2 0.00 40 0.00 60 0.00 0 1 0 0 1
6 0.00 50 0.00 30 0.00 0 1 0 0 1
1 0.00 2 1.00 30 0.00 1 0 0 0 1
3 0.00 1 1.00 50 0.00 1 0 0 0 1
5 0.00 2 1.00 80 0.00 1 0 0 0 1
4 0.00 0 0.00 35 0.00 1 0 0 0 1
45 0.00 2 1.00 30 0.00 0 1 0 0 1
18 0.00 18 0.00 18 0.00 0 1 0 0 1
15 0.00 7 0.00 16 0.00 0 1 0 0 1
20 0.00 20 0.00 2 0.00 0 1 0 0 1
17 0.00 19 0.00 0 0.00 0 1 0 0 1
7 0.00 1 1.00 18 0.00 1 0 0 0 1
6 0.00 2 1.00 20 0.00 1 0 0 0 1
"""


class Tree:
    """A binary decision tree grown by Gini impurity until its leaves are pure or `depth` is reached."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, depth: int = 8):
        self.root = self._grow(rows, labels, depth)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int):
        if depth == 0 or y.min() == y.max():
            return bool(2 * y.sum() >= len(y))
        best = None
        for c in range(x.shape[1]):
            values = np.unique(x[:, c])
            for cut in (values[1:] + values[:-1]) / 2:
                left = x[:, c] <= cut
                score = sum(m.sum() * p * (1 - p) for m in (left, ~left) for p in (y[m].mean(),))
                if best is None or score < best[0] - 1e-12:
                    best = (score, c, cut)
        if best is None:
            return bool(2 * y.sum() >= len(y))
        _, c, cut = best
        left = x[:, c] <= cut
        return (c, float(cut), self._grow(x[left], y[left], depth - 1), self._grow(x[~left], y[~left], depth - 1))

    def __call__(self, row: tuple) -> bool:
        node = self.root
        while not isinstance(node, bool):
            c, cut, left, right = node
            node = left if row[c] <= cut else right
        return node


@functools.lru_cache(1)
def tree() -> Tree:
    """The tree of LABELLED, whose blocks have no hint, and of the same blocks where they stand in frames or hinted
    containers: none is main text in a frame or under a clear hint; under a vague one, long running text in an
    article still is."""
    table = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    table = np.insert(table, len(COLUMNS) - 1, 0, axis=1)
    at = COLUMNS.index
    framed, clear, vague = table.copy(), table.copy(), table.copy()
    framed[:, at("frame")], framed[:, -1] = 1, 0
    clear[:, at("hint")], clear[:, -1] = 2, 0
    vague[:, at("hint")] = 1
    vague[:, -1] *= (vague[:, at("words")] >= 25) & (vague[:, at("links")] <= 0.3) & (vague[:, at("article")] == 1)
    table = np.concatenate([table, framed, clear, vague])
    return Tree(table[:, :-1], table[:, -1], 12)


class _Place:
    """An open container. around: the nearest frame or hinted container that holds it, itself included."""

    __slots__ = ("tag", "article", "around")

    def __init__(self, tag: str, article: bool, around: _Around | None):
        self.tag, self.article, self.around = tag, article, around


class _Around:
    """A frame or hinted container: words are unlinked ones in it, own those of articles in it."""

    __slots__ = ("frame", "hint", "outer", "words", "own")

    def __init__(self, frame: bool, hint: int, outer: _Around | None):
        self.frame, self.hint, self.outer, self.words, self.own = frame, hint, outer, 0, 0


def _hint(attrs: str) -> int:
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attrs)) if "=" in attrs else ""
    return 0 if not names else 3 if _TALK.search(names) else 2 if _CLEAR.search(names) else 1 if _VAGUE.search(names) else 0


def _tokens(page: str) -> Iterator[tuple[str, bool, str, int, int]]:
    """(tag, closing, attributes, start, end) of each tag, in order; an empty tag for what is no text.

    Each failed search for an end is remembered, so that no part of the page is searched again for the same.
    """
    at, last, quoted, missing = 0, page.rfind(">"), True, set()
    while (lt := page.find("<", at)) >= 0:
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = len(page) if end < 0 else end + 3
            yield "", False, "", lt, at
            continue
        if lt > last:
            return
        m = _TAG.match(page, lt)
        if m is None:
            if page[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = page.find(">", lt) + 1
                yield "", False, "", lt, at
            else:
                at = lt + 1
            continue
        rest = _QUOTED.match(page, m.end()) if quoted else None
        if rest is None:
            quoted = False
            rest = _PLAIN.match(page, m.end())
        tag, closing, attrs, at = m[1].lower(), page[lt + 1] == "/", rest[0][:-1], rest.end()
        if tag in _RAW and not closing:
            if attrs.endswith("/") and tag == "svg":
                end = at
            elif tag in missing:
                end = -1
            else:
                close = _ENDS[tag].search(page, at)
                if close is None:
                    missing.add(tag)
                end = close.end() if close and close[0][1] == "/" else -1
            if end < 0 and tag in ("script", "style"):
                end = len(page)
            at = max(at, end)
            tag = ""
        yield tag, closing, attrs, lt, at


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool, int]]:
    """(text, words, linked words, heading, in an article, in a frame, hint) of each block with text, in page order."""
    found: list[tuple[str, int, int, bool, _Place]] = []
    stack = [_Place("", False, None)]
    opened: Counter = Counter()
    part: list[str] = []
    linked = depth = 0  # depth: of the stack where the open link began
    in_link = leaf = link_in_leaf = heading = False
    total = in_articles = 0

    def close() -> None:
        nonlocal part, linked, total, in_articles
        text = " ".join(html.unescape("".join(part)).split())
        if text:
            n, here = text.count(" ") + 1, stack[-1]
            own = n - min(n, linked)
            found.append((text, n, min(n, linked), heading, here))
            total += own
            in_articles += own * here.article
            a = here.around
            if a:
                a.words += own
                a.own += own * here.article
        part, linked = [], 0

    at = 0
    arounds: list[_Around] = []
    for tag, closing, attrs, start, end in _tokens(page):
        if start > at:
            run = page[at:start]
            part.append(run)
            if in_link:
                linked += len(run.split())
        at = end
        if tag == "" or tag == "br":
            part.append(" ")
        elif tag == "a":
            in_link = not closing and "href" in attrs.lower()
            link_in_leaf, depth = leaf, len(stack)
        elif tag in _BLOCK:
            close()
            if link_in_leaf:
                in_link = False
            leaf = tag in _LEAF and not closing
            heading = tag in _HEADING and not closing
            if tag not in _CONTAINER:
                continue
            if closing:
                if opened[tag]:
                    while (gone := stack.pop()).tag != tag:
                        opened[gone.tag] -= 1
                    opened[tag] -= 1
                    in_link = in_link and len(stack) >= depth
                continue
            here, hint = stack[-1], _hint(attrs)
            article, around = here.article, here.around
            if tag in ("body", "main"):
                article, around = tag == "main", None
            elif tag == "article":
                talk = around
                while talk and talk.hint != 3:
                    talk = talk.outer
                article, around = True, talk
            frame = tag in _FRAME and not (tag == "header" and article)
            if frame or hint and (tag not in ("body", "main", "article") or hint == 3 and tag == "article"):
                around = _Around(frame, hint, around)
                arounds.append(around)
            stack.append(_Place(tag, article, around))
            opened[tag] += 1
    if at < len(page):
        part.append(page[at:])
        if in_link:
            linked += len(page[at:].split())
    close()

    for a in reversed(arounds):  # outer ones come first
        if a.outer:
            a.outer.words += a.words
            a.outer.own += a.own
    state: dict[int, tuple[bool, int]] = {id(None): (False, 0)}
    for a in arounds:
        frame, hint = state[id(a.outer)]
        wraps = 2 * a.words > total and a.own == in_articles and a.hint != 3
        state[id(a)] = (frame, hint) if wraps else (frame or a.frame, max(hint, min(a.hint, 2)))
    return [(text, n, own, head, place.article, *state[id(place.around)]) for text, n, own, head, place in found]


def main_text(page: str | None) -> str:
    """The blocks that the tree keeps, joined by an empty line."""
    found, judge = blocks(page or ""), tree()
    kept = []
    edge = ("", 0, 0, False, False, False, 0)
    for i, (text, n, linked, heading, article, frame, hint) in enumerate(found):
        before, after = found[i - 1] if i else edge, found[i + 1] if i + 1 < len(found) else edge
        row = (n, linked / n, before[1], before[2] / max(1, before[1]), after[1], after[2] / max(1, after[1]), heading, text.endswith((".", "!", "?", ":", '"', "”", "»", "…")), article, frame, hint)
        if judge(row):
            kept.append(text)
    return "\n\n".join(kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "html"):
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([main_text(x) for x in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars for each row of pages."""
    rows = pick(pages, "page_id", "url", "html")
    kind = rows.schema["page_id"].dataType.simpleString()
    out = rows.mapInArrow(_extracted, f"page_id {kind}, url string, text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
