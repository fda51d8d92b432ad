"""A small page reader for use inside tasks.

It only turns one page into text and anchors; selecting, de-duplicating,
cutting and counting are column expressions over what it returns.  The standard
library parser is the definition of how broken markup is repaired: an end tag
closes up to the nearest open tag of its name, and is ignored without one.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import urljoin

# Tags without content, tags whose text is not page text, tags
# dropped from the main text, and how the main part of a page is recognised.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex "
    "keygen link menuitem meta nextid param source spacer track wbr".split()
)
NON_TEXT_TAGS = frozenset("script style template rt rp".split())
DROPPED_TAGS = frozenset("script style nav footer header noscript svg iframe".split())
MAIN_PART = re.compile(r"content|main|jobs|careers", re.IGNORECASE)


class Element:
    """One tag.  Flags are inherited when it opens, so no test walks upwards."""

    __slots__ = (
        "attrs", "dropped", "first_text", "last_text", "parent", "position", "subtree_end",
        "tag", "textless",
    )

    def __init__(self, tag, attrs, parent, position, first_text):
        self.tag, self.attrs, self.parent, self.position = tag, attrs, parent, position
        self.dropped = tag in DROPPED_TAGS or (parent is not None and parent.dropped)
        self.textless = tag in NON_TEXT_TAGS or (parent is not None and parent.textless)
        self.first_text = first_text
        self.last_text = self.subtree_end = None

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class Page(HTMLParser):
    """Elements in document order, each with its range of text pieces."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.elements: list[Element] = []
        self.texts: list[tuple[str, bool]] = []  # (stripped text, inside a dropped tag)
        self._open: list[Element] = []
        self._open_tags: Counter[str] = Counter()
        self._pending: list[str] = []
        self.feed(html)
        self.close()
        self._end_text()
        while self._open:
            self._pop()

    def _end_text(self) -> None:
        if self._pending:
            text = "".join(self._pending).strip()
            self._pending.clear()
            inside = self._open[-1] if self._open else None
            if text and not (inside and inside.textless):
                self.texts.append((text, bool(inside and inside.dropped)))

    def _pop(self) -> str:
        element = self._open.pop()
        element.last_text = len(self.texts)
        element.subtree_end = len(self.elements)
        self._open_tags[element.tag] -= 1
        return element.tag

    def handle_data(self, data: str) -> None:
        self._pending.append(data)

    def handle_starttag(self, tag: str, attrs) -> None:
        self._end_text()
        parent = self._open[-1] if self._open else None
        named = {name: value or "" for name, value in attrs}
        element = Element(tag, named, parent, len(self.elements), len(self.texts))
        self.elements.append(element)
        self._open.append(element)
        self._open_tags[tag] += 1
        if tag in VOID_TAGS:
            self._pop()

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        self._end_text()
        if self._open_tags[tag] > 0:
            while self._pop() != tag:
                pass

    def handle_comment(self, data: str) -> None:
        self._end_text()

    def handle_decl(self, decl: str) -> None:
        self._end_text()

    def handle_pi(self, data: str) -> None:
        self._end_text()

    def unknown_decl(self, data: str) -> None:
        self._end_text()

    def text_of(self, element: Element, separator: str) -> str:
        pieces = self.texts[element.first_text : element.last_text]
        return separator.join(text for text, _ in pieces)

    def below(self, element: Element) -> list[Element]:
        return self.elements[element.position + 1 : element.subtree_end]

    def first(self, test) -> Element | None:
        return next((e for e in self.elements if test(e)), None)


def main_text(page: Page) -> str:
    """Lines of the page's main part, without the dropped tags."""

    def div(attribute, matches):
        return lambda e: e.tag == "div" and not e.dropped and matches(e.attrs.get(attribute))

    part = (
        page.first(lambda e: e.tag == "main" and not e.dropped)
        or page.first(div("role", lambda v: v == "main"))
        or page.first(div("id", lambda v: v is not None and MAIN_PART.search(v)))
        or page.first(div("class", lambda v: v is not None and MAIN_PART.search(v)))
        or page.first(lambda e: e.tag == "body" and not e.dropped)
    )
    pieces = page.texts if part is None else page.texts[part.first_text : part.last_text]
    return "\n".join(text for text, dropped in pieces if not dropped)


def anchors(page: Page, page_url: str) -> list[dict]:
    """Every link with its text, raw target and absolute address."""
    found = []
    for element in page.elements:
        if element.tag == "a" and "href" in element.attrs:
            href = element.attrs["href"]
            try:
                address = urljoin(page_url, href)
            except ValueError:  # not an address at all
                continue
            found.append({"text": page.text_of(element, ""), "href": href, "url": address})
    return found


def listing(page: Page) -> dict:
    """Cards of a server-rendered listing and the text of its counter."""
    counter = page.first(
        lambda e: any(w in e.attrs.get("class", "") for w in ("total", "count", "result"))
    )
    cards = []
    places: dict[int, str] = {}  # by the element that holds a whole card
    container = page.first(lambda e: e.has_class("job-listing"))
    for element in page.below(container) if container else []:
        if element.tag != "a" or "href" not in element.attrs:
            continue
        holder = element.parent.parent
        if holder and holder.position not in places:
            meta = next(
                (e for e in page.below(holder) if "job-meta" in e.attrs.get("class", "")), None
            )
            places[holder.position] = page.text_of(meta, "") if meta else ""
        cards.append(
            {
                "title": page.text_of(element, ""),
                "href": element.attrs["href"],
                "place": places[holder.position] if holder else "",
            }
        )
    return {"cards": cards, "counter": page.text_of(counter, "") if counter else ""}
