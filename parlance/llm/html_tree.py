"""A small tolerant HTML reader: elements in page order, their digests and their text."""

import re
from collections import Counter
from hashlib import blake2b
from html import unescape

# A quoted value may hold any characters; a quote elsewhere in a tag is an ordinary one.
# Possessive repeats keep the search linear on broken markup.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/><]*)((?:[^<>=]++|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>",
    re.DOTALL,
)
ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed"))
INLINE = frozenset((
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s"
    " samp small span strike strong sub sup time tt u var wbr"
).split())
# Elements that end an open paragraph.
ENDS_PARAGRAPH = frozenset((
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul dd dt"
).split())
# Opening one of these ends an open one of those, within the given bounds.
ENDS_SAME = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th"), ("table",)),
    "tfoot": (("tbody", "thead", "tr", "td", "th"), ("table",)),
}
SCOPES = frozenset(("table", "td", "th", "caption", "button", "object", "html", "body"))


class Element:
    """An element with its children: elements and pieces of text."""

    __slots__ = ("tag", "attributes", "parent", "children", "digest", "has_text")

    def __init__(self, tag: str, attributes: str, parent: "Element | None"):
        self.tag, self.attributes, self.parent = tag, attributes, parent
        self.children: list = []
        self.digest = b""
        self.has_text = False

    def values(self) -> dict[str, str]:
        return {
            name.lower(): unescape(a or b or c)
            for name, a, b, c in ATTRIBUTE.findall(self.attributes)
        }


class Open:
    """The open elements, innermost last, with the number of each tag among them."""

    def __init__(self, page: Element):
        self.elements, self.counts = [page], Counter()

    @property
    def last(self) -> Element:
        return self.elements[-1]

    def add(self, element: Element) -> None:
        self.elements.append(element)
        self.counts[element.tag] += 1

    def _cut(self, at: int) -> None:
        for element in self.elements[at:]:
            self.counts[element.tag] -= 1
        del self.elements[at:]

    def end(self, tags, bounds) -> None:
        """Close the nearest open element of these tags, unless a bound comes first."""
        if any(self.counts[t] for t in tags):
            for at in range(len(self.elements) - 1, 0, -1):
                if self.elements[at].tag in tags:
                    return self._cut(at)
                if self.elements[at].tag in bounds:
                    return None
        return None

    def close(self, tag: str) -> None:
        """Close the nearest open element of this tag; an inline one not across a block."""
        if self.counts[tag]:
            for at in range(len(self.elements) - 1, 0, -1):
                if self.elements[at].tag == tag:
                    return self._cut(at)
                if tag in INLINE and self.elements[at].tag not in INLINE:
                    return None
        return None


def read(html: str) -> list[Element]:
    """All elements in page order; the first is the page itself. Never fails."""
    page = Element("", "", None)
    elements, open_, place = [page], Open(page), 0
    lowered = None
    while True:
        found = TOKEN.search(html, place)
        text = html[place : found.start()] if found else html[place:]
        if text:
            open_.last.children.append(unescape(text))
        if not found:
            break
        place = found.end()
        name = found.group(2)
        if not name:
            continue
        tag = name.lower()
        if found.group(1):
            open_.close(tag)
            continue
        if tag in ENDS_PARAGRAPH:
            open_.end(("p",), SCOPES)
        if tag in ENDS_SAME:
            open_.end(*ENDS_SAME[tag])
        element = Element(tag, found.group(3), open_.last)
        open_.last.children.append(element)
        elements.append(element)
        if tag in RAW:
            lowered = lowered if lowered is not None else html.lower()
            end = lowered.find("</" + tag, place)
            inner = html[place:end] if end >= 0 else html[place:]
            if tag in ("title", "textarea") and inner:
                element.children.append(unescape(inner))
            if end < 0:
                break
            close = html.find(">", end)
            place = close + 1 if close >= 0 else len(html)
        elif tag not in VOID and not found.group(3).endswith("/"):
            open_.add(element)
    return elements


def add_digests(elements: list[Element]) -> None:
    """Hash every element with all that is in it; children come after their parents."""
    for element in reversed(elements):
        digest = blake2b(digest_size=8)
        values = element.values() if element.attributes else {}
        digest.update(f"<{element.tag} {values.get('class', '')} {values.get('id', '')}>".encode("utf-8", "replace"))
        for child in element.children:
            if isinstance(child, Element):
                digest.update(child.digest)
                element.has_text |= child.has_text
            else:
                text = " ".join(child.split())
                if text:
                    digest.update(text.encode("utf-8", "replace"))
                    element.has_text = True
        element.digest = digest.digest()


def names_of(values: dict[str, str]) -> set[str]:
    """The words in an element's classes and id."""
    return {w.lower() for w in WORDS.findall(values.get("class", "") + " " + values.get("id", ""))}


def blocks(roots: list[Element], dropped: set[int]) -> list[str]:
    """The text of each block in page order, white space as one space, empty ones left out."""
    found: list[str] = []
    now: list[str] = []

    def flush() -> None:
        text = " ".join("".join(now).split())
        if text:
            found.append(text)
        now.clear()

    # None marks the end of a block.
    stack: list = list(reversed(roots))
    while stack:
        item = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            now.append(item)
        elif id(item) not in dropped:
            if item.tag in ("br", "td", "th", "img", "wbr"):
                now.append("" if item.tag == "wbr" else " ")
            elif item.tag not in INLINE:
                flush()
                stack.append(None)
            stack.extend(reversed(item.children))
    flush()
    return found
