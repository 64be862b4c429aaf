"""Main text of web pages by line-block distribution.

A page is cut into lines at its block elements. Markup goes, character references are decoded, and elements that the
page itself names as menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles or reader comments
leave a cut. A line weighs the length of its text; lines made of links weigh nothing, nor do lines outside the article
if the page marks one. Weights are summed over sliding windows of ``WINDOW`` lines, and the page's own sums decide:

* text surges where the sum rises over ``QUIET`` percent of the page's highest sum and dives where it falls to that
  again (nothing, where an article is marked, as all its lines are wanted);
* short lines at a region's ends, under a quarter of its median line, are noise that the windows drew in, and go;
  headings and sentences stay, and where an article is marked nothing goes;
* a region is kept if its highest sum reaches ``SHARE`` percent of the page's, or a line of it a third of the median
  line of the highest region: a short paragraph after an advert stays, a line of imprint does not;
* what lies between two kept regions without a cut is kept as well, such as a short list between paragraphs.

A null or empty page gives an empty text, as does a page without text. Pages of any length are read whole, repeated
rows each by itself. An empty table gives an empty result. Columns to carry are held in a struct, so their names cannot
clash. Unclosed elements end with the page, or where an article begins. Of equal sums the first is the highest.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from marketlens.llm.words import slices

WINDOW = 3
SHARE = 25
QUIET = 5

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|svg|iframe|object|textarea|select|button|math|canvas|audio|video)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$|/)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SPACE = re.compile(r"\s+")

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never main text. A header inside an article is the article's own.
OUTSIDE = frozenset("head nav header footer aside form menu dialog search fieldset".split())
#: Words of class, id and role that mark such an element.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login paywall "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside complementary widget widgets footer contentinfo masthead header toolbar comment comments disqus reply replies respond related recommended recommendations "
    "share sharing social pagination pager search form dialog alert copyright".split()
)
_COMMENTS = frozenset("comment comments disqus reply replies respond".split())


#: Before a mark these tell of a layout with or without such an element: has-sidebar.
_LAYOUT = re.compile(r"\b(?:has|with|without|no)[-_]+[\w-]+", re.I)
_STOPS = (".", "!", "?", "\u2026", ":", "\u3002")
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def _marks(attributes: str) -> set[str]:
    words = " ".join(x or y or z for x, y, z in _NAMES.findall(attributes))
    return {w.lower() for w in _PART.findall(_LAYOUT.sub(" ", words))} & MARKS if words else set()


class _Lines:
    """Lines of one page: text (none at a cut), weight, whether they stand in an article, and whether they are headings."""

    def __init__(self) -> None:
        self.lines: list[tuple[str, int, bool, bool]] = []
        self.parts: list[str] = []
        self.linked = 0
        self.item = self.heading = False

    def flush(self, inside: bool) -> None:
        text = _SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        if text:
            menu = self.linked * 2 > len(text) and (self.item or not inside)
            self.lines.append((text, 0 if menu else len(text), inside, self.heading))
        self.parts, self.linked = [], 0

    def cut(self) -> None:
        self.lines += [("", 0, False, False)] * WINDOW


def page_lines(page: str) -> list[tuple[str, int, bool, bool]]:
    out, at, inside, links = _Lines(), 0, 0, 0
    skip, depth, comments = "", 0, False
    for token in _TOKEN.finditer(page):
        if not skip and token.start() > at:
            piece = page[at : token.start()]
            out.parts.append(piece)
            if links:
                out.linked += len(piece)
        at = token.end()
        if not (tag := (token[3] or "").lower()):
            continue
        closing, attributes = bool(token[2]), token[4] or ""
        own = tag in ("article", "main")
        if skip:
            fresh = own and not closing and not comments and not _marks(attributes)
            if not fresh and not (skip == "head" and tag == "body"):
                if tag == skip and not attributes.endswith("/"):
                    depth += -1 if closing else 1
                if depth:
                    continue
                skip = ""
                if not inside:
                    out.cut()
                continue
            skip = ""
            out.cut()
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
            continue
        if tag == "br":
            out.parts.append(" ")
            continue
        if tag in BLOCKS:
            out.flush(inside > 0)
            links = 0
            out.item = tag == "li" and not closing
            out.heading = tag in _HEADINGS and not closing
        if not closing and tag not in VOID and tag not in ("body", "html"):
            marks = _marks(attributes) if attributes else set()
            if inside:
                marks -= {"header"}
            if (tag in OUTSIDE and not (tag == "header" and inside)) or marks or (attributes and _HIDDEN.search(attributes)):
                if not attributes.endswith("/"):
                    out.flush(inside > 0)
                    skip, depth, comments = tag, 1, bool(marks & _COMMENTS)
                continue
        if own:
            inside = max(0, inside + (-1 if closing else 1))
            if not inside:
                out.cut()
    if not skip:
        out.parts.append(page[at:])
    out.flush(inside > 0)
    return out.lines


def regions(weights: list[int], least: float) -> list[tuple[int, int, int]]:
    """(surge, dive, highest sum): the runs of lines whose window sums are over ``least``."""
    sums, total = [0] * len(weights), 0
    for i in range(len(weights) - 1, -1, -1):
        total += weights[i] - (weights[i + WINDOW] if i + WINDOW < len(weights) else 0)
        sums[i] = total
    least = max(sums, default=0) * least / 100
    found, i = [], 0
    while i < len(sums):
        surge = i
        while i < len(sums) and sums[i] > least:
            i += 1
        if i > surge:
            found.append((surge, i, max(sums[surge:i])))
        i += 1
    return found


def _median(values: list[int]) -> float:
    return sorted(values)[len(values) // 2] if values else 0.0


def main_text(page: str | None) -> str:
    lines = page_lines(page or "")
    marked = any(inside and weight for _, weight, inside, _ in lines)
    weights = [weight if inside or not marked else 0 for _, weight, inside, _ in lines]
    found = regions(weights, 0 if marked else QUIET)
    if not found:
        return ""
    top = max(high for _, _, high in found)
    main = next((a, b) for a, b, high in found if high == top)
    typical = _median([w for w in weights[slice(*main)] if w])
    kept: list[tuple[int, int]] = []
    for a, b, high in found:
        if kept and a < kept[-1][1]:
            a = kept[-1][1]
        if 100 * high < SHARE * top and 3 * max(weights[a:b], default=0) < typical:
            continue
        noise = 0 if marked else _median([w for w in weights[a:b] if w]) / 4
        small = lambda i: not weights[i] or (weights[i] < noise and not lines[i][3] and not lines[i][0].endswith(_STOPS))
        while a < b and small(a):
            a += 1
        # the windows look ahead, so a marked region ends with its last line
        while not marked and b > a and small(b - 1):
            b -= 1
        # sentences that follow are too short to hold the sum up
        while not marked and b < len(weights) and not small(b):
            b += 1
        if kept and all(text for text, _, _, _ in lines[kept[-1][1] : a]) and not marked:
            kept[-1] = (kept[-1][0], b)
        elif b > a:
            kept.append((a, b))
    return "\n".join(text for a, b in kept for text, _, _, _ in lines[a:b] if text)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in slices(batch, "html"):
            texts = pa.array([main_text(page) for page in piece.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([piece.column("row"), texts], ["row", "text"])


def extracted(pages: DataFrame, carry: list[str]) -> DataFrame:
    """pages (html and the columns of ``carry``) -> row (a struct of these), text."""
    read = pages.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), "html")
    return read.mapInArrow(_extracted, StructType([read.schema["row"], StructField("text", StringType())]))
