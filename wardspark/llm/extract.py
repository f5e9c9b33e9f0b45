"""Main text of web pages by tree scoring.

Each block of text passes points for its length and commas to the elements around it: whole
points to the nearest container, half to the next, then a third of a level's share. A container's
points are discounted by the share of its text that is link text. The best container is kept
(the whole article element if it lies in one). Of its siblings those stay that score a fifth of
it or are long prose; outside of articles also headings, paragraphs, lists, quotes, tables and loose
text of the parent that are not mostly links, and whatever else of that kind lies between kept ones.
Parts that are never main text by tag, role, class or id are left out.

Null and empty pages give an empty text, as do pages without text of their own; broken or cut
markup ends where the page ends; repeated rows give repeated results; an empty table gives no
rows; other columns stay beside the page's.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wardspark.llm import shared
from wardspark.llm.tokens import slices

#: Levels of elements around a block that get its points; what the next would get is too little to matter.
LEVELS = 24

_MARK = re.compile(r"""<(?:!--(?:.*?--!?>|.*\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+>|[^>]*(?:>|\Z)))""", re.DOTALL)
_ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TOKEN = re.compile(r"[a-z0-9]+")

_RAW = frozenset(("script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp", "noembed", "noframes", "svg", "math"))
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
_NEVER = frozenset((
    "head", "nav", "footer", "aside", "form", "button", "select", "option", "datalist", "dialog", "menu", "object", "canvas", "audio", "video", "map", "fieldset", "label",
))
_INLINE = frozenset((
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp",
    "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img", "picture", "source", "label", "button", "input", "select", "svg", "map",
))
_PARAGRAPH = frozenset(("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "li", "dt", "dd", "td", "th", "caption", "figcaption", "summary", "address"))
_ENDS_BEFORE = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    "tbody": ("thead", "tbody", "tfoot", "tr", "td", "th"), "body": ("head",),
}
_HOLDS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "tbody": ("table",)}
_ARTICLE = frozenset(("article", "main"))
_PROSE = _PARAGRAPH | frozenset(("ul", "ol", "dl", "blockquote", "figure", "table", "details", "hgroup"))
_ROLES = frozenset(("navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar", "tablist"))
# Words in a class or id that mark a part which is no main text.
_BOILERPLATE = frozenset((
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "consent",
    "cookie", "cookies", "disclaimer", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "notification", "overlay", "pager", "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets",
))
_ONLY_OUTSIDE = frozenset(("header", "top", "bottom"))


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is never main text; ``inside``: it lies in an article."""
    if tag in _NEVER:
        return True
    if tag == "header":
        return not inside
    if not attributes or tag in ("html", "body") or tag in _ARTICLE:
        return False
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name in ("class", "id"):
            words = set(_TOKEN.findall(value))
            if words & _BOILERPLATE or (not inside and words & _ONLY_OUTSIDE):
                return True
        elif name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            return True
    return False


class _Tree:
    """Containers of a page and its blocks of text, in page order."""

    def __init__(self) -> None:
        self.tag, self.parent, self.inside = [""], [0], [False]
        self.points, self.chars, self.linked = [0.0], [0], [0]
        self.blocks: list[tuple[int, str, int]] = []

    def add(self, tag: str, parent: int) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.inside.append(self.inside[parent] or tag in _ARTICLE)
        self.points.append(0.0)
        self.chars.append(0)
        self.linked.append(0)
        return len(self.tag) - 1

    def block(self, node: int, text: str, linked: int) -> None:
        self.blocks.append((node, text, linked))
        size = len(text)
        worth = (1 if size >= 25 else size / 25) + text.count(",") + text.count("、") + text.count("，") + min(3.0, size / 100)
        worth *= 1 - linked / max(1, size)
        self.chars[node] += size
        self.linked[node] += linked
        at = self.parent[node] if self.tag[node] in _PARAGRAPH else node
        for level in range(LEVELS):
            self.points[at] += worth / (1 if level == 0 else 2 if level == 1 else 3 * level)
            if not at:
                break
            at = self.parent[at]

    def score(self, node: int) -> float:
        return self.points[node] * (1 - self.linked[node] / max(1, self.chars[node]))

    def kept(self) -> list[str]:
        if not self.blocks:
            return []
        for i in range(len(self.tag) - 1, 0, -1):  # an element comes after those around it
            self.chars[self.parent[i]] += self.chars[i]
            self.linked[self.parent[i]] += self.linked[i]
        scores = [self.score(i) for i in range(len(self.tag))]
        best = max(range(1, len(scores)), key=lambda i: (scores[i], -i), default=0)
        at = best
        while at and self.tag[at] not in _ARTICLE:
            at = self.parent[at]
        if at:
            best = at
        while best and self.tag[best] in _PARAGRAPH:
            best = self.parent[best]
        keep = {best}
        up = self.parent[best]
        loose = False
        if best and self.tag[best] not in ("body", "html"):
            article = self.tag[best] in _ARTICLE
            loose = not article
            siblings = [i for i in range(1, len(scores)) if self.parent[i] == up and i != best and self.chars[i]]
            for i in siblings:
                density = self.linked[i] / self.chars[i]
                if article:
                    kept = scores[i] >= max(10.0, scores[best] / 5) or (self.tag[i] == "p" and self.chars[i] > 80 and density < 0.25)
                else:
                    kept = (scores[best] > 0 and scores[i] >= scores[best] / 5) or (self.tag[i] in _PROSE and density < 0.25)
                if kept:
                    keep.add(i)
            if loose:  # elements are numbered in page order
                first, last = min(keep), max(keep)
                keep.update(i for i in siblings if first < i < last and self.linked[i] < 0.25 * self.chars[i])
        within = [False] * len(scores)
        for i in range(len(scores)):
            within[i] = i in keep or (i > 0 and within[self.parent[i]])
        return [text for node, text, linked in self.blocks if within[node] or (loose and node == up and linked < 0.25 * len(text))]


def main_text(page: str | None) -> str:
    """The main text of a page; blocks are joined by one space."""
    if not page:
        return ""
    tree = _Tree()
    stack: list[tuple[str, int, bool]] = [("", 0, False)]  # open elements: tag, node of the tree, left out
    text: list[str] = []
    link = False
    linked = at = 0
    size = len(page)

    def flush() -> None:
        nonlocal linked
        if text:
            words = " ".join(html.unescape("".join(text)).split())
            if words:
                tree.block(stack[-1][1], words, min(linked, len(words)))
            text.clear()
        linked = 0

    while at < size:
        found = page.find("<", at)
        m = None
        while found >= 0 and not (m := _MARK.match(page, found)):
            found = page.find("<", found + 1)
        stop = found if found >= 0 else size
        if stop > at and not stack[-1][2]:
            text.append(page[at:stop])
            if link:
                linked += stop - at
        if m is None:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if attributes[-1:] != ">":  # the page ends within the tag
            break
        inline = tag in _INLINE
        if not inline:
            flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if stack[i][2] and not stack[i - 1][2]:
                        text.clear() if not inline else None
                    del stack[i:]
                    break
                if inline and stack[i][0] not in _INLINE:
                    break
            if tag == "a":
                link = False
            continue
        if tag in _RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.IGNORECASE).search(page, at)
            at = page.find(">", end.start()) + 1 or size if end else size
            continue
        if tag in _VOID:
            continue
        for other in _ENDS_BEFORE.get(tag, ()):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == other:
                    del stack[i:]
                    break
                if stack[i][0] in _HOLDS.get(tag, ()) or (tag == "p" and stack[i][0] not in _INLINE):
                    break
        if tag == "a":
            link = True
        _, node, out = stack[-1]
        attributes = attributes[:-1]
        if attributes.endswith("/") and tag not in _INLINE and tag not in _PARAGRAPH:
            attributes = attributes[:-1]
        out = out or _boilerplate(tag, attributes, tree.inside[node])
        stack.append((tag, node if inline or out else tree.add(tag, node), out))
    flush()
    return " ".join(tree.kept())


def extract_pages(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """``pages`` with text and n_chars instead of the html."""
    others = [c for c in pages.columns if c != html_column and c not in ("text", "n_chars")]
    raw = shared.free(pages, "_html")
    rows = pages.select(*others, F.col(html_column).alias(raw))
    made = rows.drop(raw).withColumn("text", F.lit("")).withColumn("n_chars", F.lit(0).cast("long")).schema
    schema = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, raw):
                texts = [main_text(p) for p in batch.column(raw).to_pylist()]
                columns = [batch.column(c) for c in others] + [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, made)
