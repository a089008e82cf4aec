"""A page's markup as elements: labels that stand before values, and the footer. Small helpers of Arrow passes."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa

_TOKEN = re.compile(r"<!--.*?-->|<(script|style)\b.*?</\1\s*>|<(?P<end>/?)(?P<tag>[a-z][a-z0-9]*)(?P<rest>[^>]*)>", re.IGNORECASE | re.DOTALL)
_NAMES = re.compile(r"""\b(?:class|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HREF = re.compile(r"""\bhref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"))
#: Open elements that a start tag ends, as HTML leaves their end tags out.
_ENDS = {
    "li": ("li", "p"), "p": ("p",), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"),
    "tr": ("tr", "td", "th", "p"), "div": ("p",), "section": ("p",), "article": ("p",), "table": ("p",), "dl": ("p",), "ul": ("p",), "ol": ("p",),
}
# Elements that hold a pair, and words in the class or id of labels, values and footers.
_LINES = frozenset(("li", "p", "div", "section"))
_BOXES = frozenset(("div", "li", "section", "article"))
_LABELS = frozenset(("span", "strong", "b", "div", "dt", "th"))
_HEADS = frozenset(("h2", "h3", "h4", "p", "div", "span", "strong", "b"))
_VALUES = frozenset(("span", "em", "strong", "b", "div", "dd", "td", "p", "li"))
_LABEL_NAMES = ("label", "title", "name", "head", "term", "key")
_VALUE_NAMES = ("value", "data", "body", "desc", "detail")
_FOOTER_NAMES = ("footer", "foot", "site-info", "company-info", "corp-info", "contact")
#: Elements that end a line.
_BLOCKS = frozenset(("p", "div", "section", "article", "li", "ul", "ol", "tr", "td", "th", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6"))
LABEL_LENGTH, REST_LENGTH = 60, 240


@dataclass(slots=True)
class Element:
    """An element: its class and id, its places among the page's texts (``end`` is one past), its texts and elements in order, a link's address."""

    tag: str
    names: str
    start: int
    end: int = 0
    parts: list[Element | int] = field(default_factory=list)
    href: str | None = None


class Page:
    """Elements in order of their start tags, and texts. Comments, scripts and styles are left out; open elements end with the page."""

    def __init__(self, html: str | None):
        self.texts: list[str] = []
        self.elements: list[Element] = []
        self.breaks: set[int] = set()  # texts before which a line is broken
        open_: list[Element] = [Element("", "", 0)]
        page, at = html or "", 0

        def close() -> None:
            open_.pop().end = len(self.texts)

        def add(s: str) -> None:
            s = " ".join((unescape(s) if "&" in s else s).split())
            if s:
                open_[-1].parts.append(len(self.texts))
                self.texts.append(s)

        for m in _TOKEN.finditer(page):
            add(page[at : m.start()])
            at = m.end()
            ends, tag, rest = m.group("end", "tag", "rest")
            tag = (tag or "").lower()
            if not tag or tag in _VOID:
                if tag == "br":
                    self.breaks.add(len(self.texts))
                continue
            if ends:
                if open_[-1].tag == tag:
                    close()
                elif any(e.tag == tag for e in reversed(open_)):
                    while open_[-1].tag != tag:
                        close()
                    close()
                continue
            while open_[-1].tag in _ENDS.get(tag, ()):
                close()
            names = " ".join(a or b or c for a, b, c in _NAMES.findall(rest)).lower() if "=" in rest else ""
            element = Element(tag, names, len(self.texts))
            if tag == "a" and (href := _HREF.search(rest)):
                element.href = unescape(href[1] or href[2] or href[3] or "")
            open_[-1].parts.append(element)
            self.elements.append(element)
            if rest.endswith("/") and tag != "a":
                element.end = element.start
            else:
                open_.append(element)
        add(page[at:])
        self.root = open_[0]
        while open_:
            close()

    def text(self, start: int, end: int) -> str:
        return " ".join(self.texts[start:end])

    def short(self, start: int, end: int, most: int) -> str:
        """The text if it is no longer than ``most``, else empty; long ones are not put together."""
        if end - start > most:
            return ""
        s = self.text(start, end)
        return s if len(s) <= most else ""


def slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """Batches in slices of so few pages that what is read out of one is small, however many pages a batch holds."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _cut(text: str) -> tuple[str, str] | None:
    """What stands before and after the first colon of a text, if a label's length is before it."""
    at = min((k for k in (text.find(":"), text.find("：")) if k >= 0), default=-1)
    return (text[:at].strip(), text[at + 1 :].strip()) if 0 < at <= LABEL_LENGTH else None


def _named(e: Element, words: tuple[str, ...]) -> bool:
    return any(w in e.names for w in words)


def _of_element(page: Page, e: Element) -> Iterator[tuple[int, str, str]]:
    """(kind, label, value) that an element's first parts make; kinds in order of their trust."""
    parts = e.parts
    first, second = (parts + [None, None])[:2]
    if isinstance(first, int):
        if e.tag in _LINES and (cut := _cut(page.texts[first])):
            yield 2, cut[0], f"{cut[1]} {page.text(first + 1, e.end)}".strip()
        return
    if not isinstance(first, Element):
        return
    if e.tag == "tr" and isinstance(second, Element) and {first.tag, second.tag} <= {"th", "td"}:
        yield 0, page.text(first.start, first.end), page.text(second.start, second.end)
    if e.tag not in _LINES | _BOXES:
        return
    label = page.short(first.start, first.end, LABEL_LENGTH)
    if not label:
        return
    value = second
    if isinstance(second, int) and page.texts[second] in (":", "："):
        value = parts[2] if len(parts) > 2 else None
    if e.tag in _LINES and first.tag in _LABELS and isinstance(value, Element) and value.tag in _VALUES:
        yield 3, label, page.text(value.start, value.end)
    if e.tag in _BOXES and first.tag in _HEADS and not _cut(label) and (e.tag != "li" or len(parts) == 2):
        yield 5, label, page.short(first.end, e.end, REST_LENGTH)


def _of_neighbours(page: Page, a: Element, b: Element) -> Iterator[tuple[int, str, str]]:
    """(kind, label, value) of an element and the one right after it."""
    if a.tag == "dt" and b.tag == "dd":
        yield 1, page.text(a.start, a.end), page.text(b.start, b.end)
    if _named(a, _LABEL_NAMES) and _named(b, _VALUE_NAMES) and a.tag in _LABELS and b.tag in _VALUES:
        yield 4, page.short(a.start, a.end, LABEL_LENGTH), page.text(b.start, b.end)


def pairs_of(page: Page) -> list[tuple[str, str]]:
    """The labels of a page with their values, each pair once: those of rows first, then of lists, lines, spans, names and boxes."""
    found: list[tuple[int, str, str]] = []
    for e in (page.root, *page.elements):
        found += _of_element(page, e)
        for a, b in zip(e.parts, e.parts[1:], strict=False):
            if isinstance(a, Element) and isinstance(b, Element):
                found += _of_neighbours(page, a, b)
    found.sort(key=lambda f: f[0])
    return list(dict.fromkeys((label, value) for _, label, value in found if label and value))


def pairs(html: str | None) -> list[tuple[str, str]]:
    return pairs_of(Page(html))


def links_of(page: Page) -> list[tuple[str, str]]:
    """(address as written, label) of a page's links in order."""
    return [(" ".join(e.href.split()), page.text(e.start, e.end)) for e in page.elements if e.href is not None]


def _footers(page: Page) -> Iterator[Element]:
    """Footer elements and blocks whose class or id names one, the outermost of each."""
    end = 0
    for e in page.elements:
        if e.start >= end and (e.tag == "footer" or (e.tag in ("div", "section") and _named(e, _FOOTER_NAMES))):
            yield e
            end = e.end


def footer(html: str | None) -> str:
    """The text of a page's footers."""
    page = Page(html)
    return " ".join(s for e in _footers(page) if (s := page.text(e.start, e.end)))


def footer_lines(page: Page) -> list[str]:
    """The texts of a page's footers, a line for each block and each part that a break ends."""
    lines: list[list[str]] = [[]]

    def walk(e: Element) -> None:
        for part in e.parts:
            if isinstance(part, int):
                if part in page.breaks:
                    lines.append([])
                lines[-1].append(page.texts[part])
            else:
                walk(part)
        if e.tag in _BLOCKS:
            lines.append([])

    for e in _footers(page):
        walk(e)
        lines.append([])
    return [" ".join(line) for line in lines if line]
