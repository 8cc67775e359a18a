"""Main text of web pages by line-block distribution.

Markup is stripped into lines: one a block element, white space made single, and
character references decoded. A line weighs as many characters as it has outside links
(a paragraph of an article that is one link weighs all it has; an item of a list that is
one link weighs nothing). The weight of a sliding window of ``WINDOW`` lines gives the
distribution: text surges where a window gets weight and dives where a whole window has
none. The heaviest stretch between a surge and its dive is the page's text; what else
surges in the same container (on pages with an ``article`` or ``main`` element that has
weight: in those) belongs to it. All lines from the first surge to the last dive there
are the main text, with the page's ``h1`` before them, however short they are.

Page furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, reader comments) is no text: it is stripped with the markup where elements,
roles or class names say so, without a gap in the run of lines. Class names that can
also be a text's own ("share", "related", "tags") count only where at least half of the
element's characters stand in links.

Defined cases: null or empty html, or a page without main text, gives the empty
string. Unclosed and stray tags are read as browsers read them: an element ends at its
own end tag, that of an element around it, or at the end of the page; where a quote in a
tag is never closed, tags end at the next ``>``. Pages are read in one pass, in time
proportional to their length. Null ids and urls are kept. Repeated rows give repeated
results; extra columns are dropped; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from tidevec.llm.common import pick

WINDOW = 3

#: Elements whose content is not text.
RAW = frozenset("script style noscript template iframe object svg math canvas textarea title audio video head".split())
#: Elements that are page furniture.
FURNITURE = frozenset("nav footer aside dialog menu button select fieldset label form".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot "
    "th thead tr ul button select label".split()
)
#: Elements that hold a page's text as a whole.
CONTAINERS = frozenset("article body center details div html main section table td".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words of class names and ids that name furniture ...
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promos promotion banner cookie cookies consent gdpr notice notices "
    "popup modal overlay nav navbar navigation menu submenu breadcrumb breadcrumbs sidebar aside widget widgets footer masthead topbar toolbar "
    "comment comments commentlist disqus replies respond newsletter subscribe signup login pagination pager copyright".split()
)
#: ... those that a text can have too, so links decide ...
WEAK = frozenset("share sharing social related recommended recommendations search tags tag alert side header teaser more links".split())
#: ... and words that say nothing beside them.
NEUTRAL = frozenset(
    "a area bar block body bottom box btn button buttons center col column container content desktop fixed form global grid group heading home inner item "
    "items js label left link list main message mobile module outer page panel posts primary right row section secondary site slot small space sticky text "
    "title top unit wrap wrapper".split()
)
_ROLE = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog form".split())
_ATTR = re.compile(r"""(?<![a-zA-Z-])([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_STOP = re.compile(r"""[>"']""")


def _named(value: str, inside: bool) -> int:
    """2 if a class or id names furniture, 1 if it may, 0 if not. Layout classes like has-sidebar say what stands beside."""
    found = 0
    for token in value.split():
        if token.lower().startswith(("has-", "has_", "with-", "with_", "without-", "no-")):
            continue
        parts = {p.lower() for p in _PART.findall(token)}
        if parts <= NAMES | WEAK | NEUTRAL:
            if parts & NAMES:
                return 2
            if parts & WEAK:
                # in an article, a header is the text's own
                found = max(found, 0 if inside and parts & WEAK == {"header"} else 2 if "header" in parts else 1)
    return found


def _kind(name: str, attrs: str, inside: bool) -> int:
    """2: furniture, 1: furniture if it is mostly links, 0: text."""
    if name in FURNITURE or (name == "header" and not inside):
        return 2
    if not attrs or name in ("html", "body", "main"):
        return 0
    kind = 0
    for m in _ATTR.finditer(attrs):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id"):
            kind = max(kind, _named(value, inside))
        elif (
            (key == "role" and value.strip().lower() in _ROLE)
            or (key == "aria-hidden" and value.lower() == "true")
            or key == "hidden"
            or (key == "style" and "display:none" in value.replace(" ", "").lower())
        ):
            return 2
    return kind


@dataclass
class Line:
    text: str
    linked: int  # characters in links
    name: str  # of the block element
    region: bool  # in an article or main

    @property
    def weight(self) -> int:
        own = max(0, len(self.text) - self.linked)
        return len(self.text) if not own and self.region and self.name != "li" else own


@dataclass
class Page:
    lines: list[Line] = field(default_factory=list)
    containers: list[tuple[int, int]] = field(default_factory=list)  # the lines of each, from and to


class _Reader:
    """Reads a page into lines, with a stack of the open block elements."""

    def __init__(self, html: str):
        self.html, self.page = html, Page()
        self.open: list[tuple[str, int, int]] = []  # name, kind, first line
        self.count: Counter[str] = Counter()
        self.muted = self.region = self.links = self.linked = 0
        self.buf: list[str] = []
        self.sums = [(0, 0)]  # characters, and those in links, of the lines before each
        self.quotes = True  # whether quotes in tags are heeded

    def line(self) -> None:
        if self.buf:
            text = " ".join(unescape("".join(self.buf)).split())
            self.buf.clear()
            if text:
                name = self.open[-1][0] if self.open else "body"
                linked, (a, b) = min(self.linked, len(text)), self.sums[-1]
                self.page.lines.append(Line(text, linked, name, self.region > 0))
                self.sums.append((a + len(text), b + linked))
        self.linked = 0

    def text(self, piece: str) -> None:
        if not self.muted and piece:
            self.buf.append(piece)
            if self.links:
                self.linked += len(" ".join(unescape(piece).split()))

    def push(self, name: str, kind: int) -> None:
        self.open.append((name, kind, len(self.page.lines)))
        self.count[name] += 1
        self.muted += kind == 2
        self.region += name in ("article", "main")

    def pop(self) -> None:
        name, kind, first = self.open.pop()
        self.count[name] -= 1
        self.muted -= kind == 2
        self.region -= name in ("article", "main")
        lines = self.page.lines
        if kind == 1 and 2 * (self.sums[-1][1] - self.sums[first][1]) >= self.sums[-1][0] - self.sums[first][0]:
            del lines[first:], self.sums[first + 1 :]
        if name in CONTAINERS and len(lines) > first:
            self.page.containers.append((first, len(lines)))

    def tag_end(self, at: int) -> int:
        """The place of the > that ends the tag whose attributes begin here, or -1."""
        html, i = self.html, at
        while self.quotes:
            m = _STOP.search(html, i)
            if m is None:
                break
            if m[0] == ">":
                return m.start()
            i = html.find(m[0], m.end()) + 1
            if not i:
                break
        self.quotes = False
        return html.find(">", at)

    def skip_raw(self, name: str, at: int) -> int:
        """The place behind the end tag of an element whose content is not read."""
        m = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.html, at)
        if m is None and name == "head":
            m = re.compile(r"(?=<body[\s>])", re.I).search(self.html, at)
            return m.start() if m else len(self.html)
        end = self.html.find(">", m.end()) if m else -1
        return len(self.html) if end < 0 else end + 1

    def element(self, name: str, attrs: str, closing: bool) -> None:
        if name == "br":
            self.text(" ")
        elif name == "a":
            self.links = 0 if closing else 1
        elif closing:
            if self.count[name]:
                self.line()
                while self.open[-1][0] != name:
                    self.pop()
                self.pop()
        else:
            kind = 0 if name in VOID else _kind(name, attrs, self.region > 0)
            if name in BLOCK:
                self.line()
                if self.open and self.open[-1][0] in ("p", "li") and (self.open[-1][0] == "p" or name == "li"):
                    self.pop()
            if name not in VOID and (name in BLOCK or kind):
                if name not in BLOCK:
                    self.line()
                if not attrs.endswith("/") or name in BLOCK:
                    self.push(name, kind)

    def read(self) -> Page:
        html, at = self.html, 0
        while at < len(html):
            begin = html.find("<", at)
            if begin < 0:
                break
            self.text(html[at:begin])
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 4)
                at = len(html) if end < 0 else end + 3
                continue
            if html.startswith("<![CDATA[", begin):
                end = html.find("]]>", begin)
                at = len(html) if end < 0 else end + 3
                continue
            if html.startswith(("<!", "<?"), begin):
                end = html.find(">", begin)
                at = len(html) if end < 0 else end + 1
                continue
            closing = html.startswith("</", begin)
            m = _NAME.match(html, begin + 1 + closing)
            end = self.tag_end(m.end()) if m else -1
            if m is None or end < 0:
                self.text("<")  # no tag
                at = begin + 1
                if m is not None:  # nor is there another one
                    self.text(html[at:])
                    break
                continue
            at = end + 1
            name, attrs = m[0].lower(), html[m.end() : end]
            if name in RAW:
                if not closing and not attrs.endswith("/"):
                    self.line()
                    at = self.skip_raw(name, at)
                continue
            self.element(name, attrs, closing)
        else:
            begin = -1
        if begin < 0 and at < len(html):
            self.text(html[at:])
        self.line()
        while self.open:
            self.pop()
        return self.page


def read(html: str) -> Page:
    return _Reader(html).read()


def blocks(weights: list[int]) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch: from a line with weight to the first window of lines without any."""
    out: list[tuple[int, int]] = []
    window = 0  # the weight of the last WINDOW lines
    start = last = -1
    for i, w in enumerate([*weights, *[0] * WINDOW]):
        window += w - (weights[i - WINDOW] if i >= WINDOW else 0)
        if w:
            start, last = (i if start < 0 else start), i
        if start >= 0 and not window:
            out.append((start, last + 1))
            start = -1
    return out


def main_text(html: str | None) -> str:
    """The lines from the first surge to the last dive of the line-block distribution in the text's container."""
    page = read(html) if html else Page()
    lines = page.lines
    region = any(x.region and x.weight for x in lines)
    weights = [x.weight if x.region or not region else 0 for x in lines]
    found = blocks(weights)
    if not found:
        return ""
    first, last = found[0][0], found[-1][1]
    if not region:
        sums = [0]
        for w in weights:
            sums.append(sums[-1] + w)
        begin, end = max(found, key=lambda b: sums[b[1]] - sums[b[0]])
        around = [c for c in page.containers if c[0] <= begin and end <= c[1]]
        a, b = min(around, key=lambda c: c[1] - c[0], default=(0, len(lines)))
        own = [x for x in found if a <= x[0] and x[1] <= b] or [(begin, end)]
        first, last = own[0][0], own[-1][1]
    kept = [x for x in lines[first:last] if x.region or not region]
    title = [x for x in lines[:first] if x.name == "h1" and (x.region or not region)]
    return "\n".join(x.text for x in title + kept)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str | None = None) -> DataFrame:
    """id, (url, if its column is named), text and n_chars of every page."""
    carried = [id_col, url_col] if url_col else [id_col]
    rows = df.select(*[df[c] for c in carried], df[html_col].alias("_html"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carried)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                texts = [main_text(x) for x in part.column(len(carried)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(carried)], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*carried, "text", "n_chars"])

    return rows.mapInArrow(run, f"{kinds}, text string, n_chars bigint")


def oracle() -> str:
    """DuckDB SQL for pages whose text is one plain ``article``: its blocks, tags stripped and references decoded."""
    text = "regexp_replace(p, '<[^>]*>', '', 'g')"
    for reference, sign in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("#x27", "''"), ("amp", "&")):
        text = f"regexp_replace({text}, '&{reference};?', '{sign}', 'g')"
    blank = r"[ \t\n\r\f\v\x{a0}]+"
    return f"""
WITH a AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1) AS x FROM pages),
b AS (SELECT page_id, url, string_split(regexp_replace(regexp_replace(x, '<br>', ' ', 'g'), '</?(p|h1|h2|h3|li|ul|ol|div|blockquote)>', chr(1), 'g'), chr(1)) AS parts FROM a),
c AS (
  SELECT page_id, url, list_transform(parts, lambda p: trim(regexp_replace(
    {text}, '{blank}', ' ', 'g'))) AS lines FROM b
),
d AS (SELECT page_id, url, array_to_string(list_filter(lines, lambda l: l <> ''), chr(10)) AS text FROM c)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM d"""
