"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clusters."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import text_batches

# Elements of HTML by what they do to the text.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins",
    "kbd", "label", "mark", "q", "ruby", "rb", "rt", "rp", "s", "samp", "small", "span", "strike", "strong", "sub", "sup",
    "time", "tt", "u", "var", "wbr",
}
NEVER_TEXT = {
    "applet", "aside", "audio", "button", "canvas", "datalist", "dialog", "embed", "footer", "frameset", "head",
    "iframe", "input", "map", "menu", "nav", "noembed", "noframes", "noscript", "object", "option", "script",
    "select", "style", "svg", "template", "textarea", "title", "video",
}
INVISIBLE = {"script", "style"}
# Elements of formulas: part of the text around them, and no mark-up that a line has too much of.
FORMULA = {
    "math", "semantics", "annotation", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "mstyle", "mfrac", "msqrt", "mroot", "msub", "msup",
    "msubsup", "munder", "mover", "munderover", "mtable", "mtr", "mtd", "mpadded", "mphantom", "mfenced", "menclose", "merror", "mmultiscripts",
}
REGIONS = {"article", "main", "section", "div", "td", "body", "blockquote", "table", "tr", "tbody", "center", "li", "ul", "ol", "dl", "dd"}
# Regions that part a page into pieces; lists, tables and quotes are part of the piece around them.
SECTIONS = {"article", "main", "section", "div", "body", "center"}
MAIN_ROLES = {"main", "article"}
# Words in class, id or role that mark what surrounds an article.
CLUTTER = {
    "ad", "ads", "adbox", "adsense", "advert", "advertisement", "adverts", "advertising", "author-bio", "banner", "breadcrumb", "breadcrumbs", "comment",
    "comments", "commentlist", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disqus", "feedback", "footer", "footnav", "gdpr",
    "header", "login", "masthead", "menu", "menubar", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "pager",
    "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing",
    "sidebar", "sidenav", "signup", "site-header", "skip", "social", "sponsor", "sponsored", "subscribe", "toc", "toolbar", "widget",
}
# First parts of names that tell how a page is laid out, as in "no-sidebar".
LAYOUT = {"no", "has", "with", "without"}
# Last parts of names that only say what holds something, or where: "comment-list" holds comments, "comment-open" does not.
HOLDERS = {
    "area", "banner", "bar", "block", "bottom", "box", "boxes", "button", "buttons", "column", "container", "content", "dialog", "form", "group", "icons", "inner",
    "item", "items", "left", "link", "links", "list", "main", "outer", "overlay", "panel", "posts", "primary", "right", "row", "secondary", "section", "side",
    "slot", "stories", "top", "unit", "widget", "widgets", "wrap", "wrapper", "zone",
}
# The header of one of these belongs to it.
WORKS = {"article", "entry", "post", "story", "chapter", "section", "page", "content"}
# Elements whose id names a part of the page, and not a place to link to.
PARTS = {"div", "section", "ul", "ol", "dl", "table", "td", "center", "form"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
# Opening one of these closes an open one of the same set, up to the next region.
CLOSES = [{"p", *HEADINGS}, {"li"}, {"dt", "dd"}, {"tr"}, {"td", "th"}, {"option"}]
ENDS_PARAGRAPH = {
    "address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form",
    "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul", *HEADINGS,
}
# Characters that an article has at least.
ARTICLE = 200
NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _names_clutter(word: str) -> bool:
    """Whether a class, id or role is one of ``CLUTTER``, or something that holds it; what it says last decides."""
    if word.lower() in CLUTTER:
        return True
    parts = [p.lower() for p in NAME_PARTS.findall(word)]
    if len(parts) < 2 or parts[0] in LAYOUT:
        return bool(parts) and parts[0] in CLUTTER and len(parts) == 1
    while len(parts) > 1 and parts[-1] in HOLDERS and parts[-1] not in CLUTTER:
        parts.pop()
    if parts[-1] in ("header", "footer") and not WORKS.isdisjoint(parts[:-1]):
        return False
    return parts[-1] in CLUTTER or "-".join(parts) in CLUTTER or (len(parts) == 1 and parts[0] in ("comment", "related"))


def _is_hidden(attributes: list[tuple[str, str | None]]) -> bool:
    for name, value in attributes:
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _is_clutter(tag: str, attributes: list[tuple[str, str | None]]) -> bool:
    """An element that by its names surrounds an article. Ids count on parts of the page only."""
    return any(
        value and (name in ("class", "role") or (name == "id" and tag in PARTS)) and any(map(_names_clutter, value.split()))
        for name, value in attributes
    )


class _Lines(HTMLParser):
    """Turns parser events into lines, one per block: text, tags inside it, and the region and the clutter it stands in.

    Regions and pieces of clutter are numbered as they open and know the one around them. Text in clutter is held until the
    page has ended, when its share of the page is known.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int, int]] = []  # text, tags, nearest section, marked region, clutter
        self.clutter_in: list[int] = [0]  # for each piece of clutter, the one around it
        self.clutter_at: list[int] = [0]  # open ones
        self.sections: list[int] = [0]  # open regions that part the page, by number
        self.marked: list[tuple[int, int]] = []  # open regions that say they hold the main text, and the clutter they stand in
        self.open: list[tuple[str, bool, bool, int, bool]] = []  # element, hides its text, is clutter, section or 0, marked
        self.places: dict[str, list[int]] = {}  # where in ``open`` an element is open
        self.hidden = self.regions = self.tags = 0
        self.held: list[str] = []

    def flush(self) -> None:
        if self.held and (text := " ".join("".join(self.held).split())):
            self.lines.append((text, self.tags, self.sections[-1], self.marked[-1][0] if self.marked else 0, self.clutter_at[-1]))
        self.held, self.tags = [], 0

    def push(self, tag: str, hides: bool, clutter: bool = False, section: int = 0, marked: bool = False) -> None:
        if clutter:
            self.clutter_in.append(self.clutter_at[-1])
            self.clutter_at.append(len(self.clutter_in) - 1)
        if section:
            self.sections.append(section)
        if marked:
            self.marked.append((section, self.clutter_at[-1]))
        self.hidden += hides
        self.places.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, hides, clutter, section, marked))

    def pop(self) -> None:
        tag, hides, clutter, section, marked = self.open.pop()
        self.places[tag].pop()
        self.hidden -= hides
        if clutter:
            self.clutter_at.pop()
        if section:
            self.sections.pop()
        if marked:
            self.marked.pop()

    def close_from(self, k: int) -> None:
        self.flush()
        while len(self.open) > k:
            self.pop()

    def last(self, tags: set[str]) -> int:
        return max((at[-1] for t in tags if (at := self.places.get(t))), default=-1)

    def find(self, tags: set[str], within: set[str]) -> int | None:
        """The innermost open element of ``tags``, unless one of ``within`` is open inside it."""
        k = self.last(tags)
        return k if k >= 0 and k >= self.last(within) else None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in INLINE or tag == "br":
            self.tags += 1
            if tag == "br":
                self.held.append(" ")
            if tag in VOID or not attrs:
                return
            if _is_hidden(attrs) or _is_clutter(tag, attrs):  # other inline elements need no place: they neither hide nor part text
                self.flush()
                self.push(tag, True)
            return
        if tag in FORMULA:
            return
        if tag in INVISIBLE:  # does not part the text around it
            self.push(tag, True)
            return
        if tag in ENDS_PARAGRAPH and (k := self.find({"p"}, REGIONS)) is not None:
            self.close_from(k)
        for same in CLOSES[1:]:
            if tag in same and (k := self.find(same, {"ul", "ol", "dl", "table", "select", "div", "section", "article"})) is not None:
                self.close_from(k)
        if tag == "body" and (k := self.find({"head"}, set())) is not None:
            self.close_from(k)
        self.flush()
        self.tags += 1
        if tag in VOID:
            return
        hides = tag in NEVER_TEXT or _is_hidden(attrs)
        clutter = tag == "form" or (tag == "header" and not self.marked) or (tag not in ("html", "body", "article", "main") and bool(attrs) and _is_clutter(tag, attrs))
        role = dict(attrs).get("role")
        marked = (tag in MAIN_ROLES or (tag in REGIONS and role in MAIN_ROLES)) and not self.hidden
        section = 0
        if tag in SECTIONS or marked:
            self.regions += 1
            section = self.regions
        self.push(tag, hides, clutter and not hides, section, marked)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in INVISIBLE:
            if self.open and self.open[-1][0] == tag:
                self.pop()
            return
        if tag in FORMULA:
            return
        if tag in INLINE:
            self.tags += 1
            if self.open and self.open[-1][0] == tag:
                self.close_from(len(self.open) - 1)
            return
        if tag == "br":
            self.held.append(" ")
            return
        # an end tag reaches out of blocks and inline elements, but never out of another region than its own
        k = self.find({tag}, set() if tag in ("html", "body", "article", "main", "nav", "aside", "footer") else REGIONS | {"nav", "aside", "footer", "form"})
        if k is not None:
            self.close_from(k)
        else:
            self.flush()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.held.append(data)

    def shown(self) -> list[tuple[str, int, int, int]]:
        """Lines outside of clutter: text, tags, nearest section, marked region. What holds more than half of the page's text, and
        ``ARTICLE`` characters, is no clutter."""
        own = [0] * len(self.clutter_in)
        for text, _, _, _, clutter in self.lines:
            own[clutter] += len(text)
        total, away = sum(own), [False] * len(own)
        for k in range(len(own) - 1, 0, -1):  # what is inside opened later
            own[self.clutter_in[k]] += own[k]
        for k in range(1, len(own)):
            away[k] = away[self.clutter_in[k]] or 2 * own[k] <= total or own[k] < ARTICLE
        return [line[:4] for line in self.lines if not away[line[4]]]


def smoothed(ratios: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing; at the ends the weights of missing lines go to those that are there."""
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(ratios, kernel)[reach:-reach] / np.convolve(np.ones(len(ratios)), kernel)[reach:-reach]


def main_text(html: str | None) -> str:
    """The article of one page, blocks in page order joined by one space; empty if there is none.

    Lines outside of clutter get the ratio of their characters to their tags. Lines whose smoothed ratio is over half the
    spread of all ratios are content. If the page marks article or main regions that hold text, only their lines are
    looked at. All content is kept, and with it the other lines of a section whose own lines are content by half of their
    characters or more: short ones, and those of its lists, tables and quotes. Of other sections, such as teasers or lists
    of links, only content is kept. So on a page without marked regions the clusters alone tell the article from the rest;
    if all lines are alike, all are content. Elements whose names say that they surround an article are left out unless
    they hold over half of the page's text.
    """
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines = parser.shown()
    if any(marked for _, _, _, marked in lines):
        lines = [line for line in lines if line[3]]
    if not lines:
        return ""
    chars = np.array([len(text) for text, *_ in lines], float)
    ratios = smoothed(chars / np.maximum(1, [tags for _, tags, *_ in lines]))
    content = ratios >= 0.5 * ratios.std()
    balance: dict[int, float] = {}
    for (_, _, at, _), n, c in zip(lines, chars, content, strict=True):
        balance[at] = balance.get(at, 0.0) + (n if c else -n)
    return " ".join(text for (text, _, at, _), c in zip(lines, content, strict=True) if c or balance[at] >= 0)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the html, and text, n_chars (code points). Null and empty pages give an empty text.

    Columns named like the new ones are replaced; repeated rows stay repeated.
    """
    others = [c for c in pages.columns if c not in (html, "text", "n_chars")]
    source = pages.select(*others, F.col(html).alias("__html"))
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "__html"):
            found = [main_text(t) for t in texts]
            columns = [batch.column(c) for c in others] + [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "text", "n_chars"])

    return source.mapInArrow(run, ", ".join([*fields, "text string", "n_chars long"]))
