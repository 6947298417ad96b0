"""From the text of an HTML page to its leaf blocks, each with the path of open elements around it.

One pass over the page, linear in its length whatever it holds: every search that can fail to the end of
the page is made at most once, and open elements are looked up by position, not by walking the stack.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

# Element names of HTML by their role.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
MUTED = frozenset("template svg select datalist noscript canvas object audio video".split())
# An element on the left ends an open one of its kind unless one of the right was opened since.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "table")),
    "dt": (("dt", "dd"), ("dl", "table")),
    "dd": (("dt", "dd"), ("dl", "table")),
    "tr": (("tr",), ("table",)),
    "td": (("td", "th"), ("table", "tr")),
    "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select",)),
}

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|=)*+)>")
_NAMING = re.compile(r"(?<![\w-])(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[^\W\d_a-zA-Z]+")
_RAW_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}
_COMMENT_END = re.compile(r"--!?>")

BUCKETS = 2048


def token(text: str) -> int:
    return zlib.crc32(text.encode()) % BUCKETS


def element_tokens(tag: str, attributes: str) -> tuple[int, ...]:
    """Hashed features of one element: its name and the words of its class, id, role and itemprop."""
    words = []
    for found in _NAMING.finditer(attributes):
        for part in _PARTS.findall(found[2] or found[3] or found[4] or ""):
            words.append(part.lower())
    return (token(f"<{tag}"), *sorted({token(f"@{w}") for w in words}))


@dataclass
class Paths:
    """Paths of open elements as a tree; node 0 is the page. Equal paths share a node."""

    parents: list[int] = field(default_factory=lambda: [0])
    tokens: list[tuple[int, ...]] = field(default_factory=lambda: [()])
    children: dict[tuple[int, str, str], int] = field(default_factory=dict)

    def child(self, node: int, tag: str, attributes: str) -> int:
        if attributes and not _NAMING.search(attributes):
            attributes = ""
        key = (node, tag, attributes)
        found = self.children.get(key)
        if found is None:
            found = self.children[key] = len(self.parents)
            self.parents.append(node)
            self.tokens.append(element_tokens(tag, attributes))
        return found


@dataclass
class Block:
    node: int
    text: str
    linked: int  # characters inside links, white space aside


def _markup(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest): ``("text", "", raw text)``, ``("open", tag, attributes)`` or ``("close", tag, "")``."""
    at, size = 0, len(page)
    while at < size:
        start = page.find("<", at)
        if start < 0:
            yield "text", "", page[at:]
            return
        if start > at:
            yield "text", "", page[at:start]
        closing = page.startswith("/", start + 1)
        initial = page[start + 1 + closing : start + 2 + closing]
        named = initial.isascii() and initial.isalpha()
        if page.startswith("<!--", start):
            if page.startswith(">", start + 4) or page.startswith("->", start + 4):
                at = page.index(">", start) + 1
                continue
            end = _COMMENT_END.search(page, start + 4)
            if not end:  # a comment that never ends takes the rest of the page
                return
            at = end.end()
        elif not named and (closing or initial in ("!", "?")):
            end = page.find(">", start)
            if end < 0:
                return
            at = end + 1
        elif not named:
            yield "text", "", "<"
            at = start + 1
        else:
            found = _TAG.match(page, start)
            if not found:
                return  # a tag that never ends takes the rest of the page
            name, at = found[2].lower(), found.end()
            if found[1]:
                yield "close", name, ""
                continue
            yield "open", name, found[3]
            if name in RAW:
                end = _RAW_ENDS[name].search(page, at)
                if not end:
                    return
                at = end.start()


class _Stack:
    """Open elements. ``places`` holds, per element name, where it stands in the stack."""

    def __init__(self) -> None:
        self.names, self.nodes, self.blocks = [""], [0], [0]
        self.places: dict[str, list[int]] = {}

    def last(self, *names: str) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def push(self, name: str, node: int) -> None:
        place = len(self.names)
        self.blocks.append(self.blocks[-1] if name in INLINE else place)
        self.names.append(name)
        self.nodes.append(node)
        self.places.setdefault(name, []).append(place)

    def cut(self, place: int) -> None:
        """Close everything from ``place`` on."""
        while len(self.names) > place:
            self.places[self.names.pop()].pop()
            self.nodes.pop()
            self.blocks.pop()


def page_blocks(page: str, paths: Paths) -> list[Block]:
    """The leaf blocks of a page in page order, character references decoded, white space folded."""
    stack, out = _Stack(), []
    pieces: list[str] = []
    node, linked, muted, started = 0, 0, 0, False

    def flush() -> None:
        nonlocal linked, started
        if started:
            out.append(Block(node, " ".join("".join(pieces).split()), linked))
        pieces.clear()
        linked, started = 0, False

    for kind, name, rest in _markup(page):
        if kind == "text":
            if muted:
                continue
            text = html.unescape(rest) if "&" in rest else rest
            if text and not text.isspace():
                if not started:
                    node, started = stack.nodes[-1], True
                if stack.places.get("a"):
                    linked += len("".join(text.split()))
            pieces.append(text)
        elif name == "br":
            pieces.append(" ")
        elif kind == "open":
            if name not in INLINE:
                flush()
                if stack.blocks[-1] and stack.names[stack.blocks[-1]] == "p":
                    stack.cut(stack.blocks[-1])
                if name in ENDS:
                    same, barrier = ENDS[name]
                    place = stack.last(*same)
                    if place > stack.last(*barrier):
                        stack.cut(place)
            if name not in VOID:
                stack.push(name, paths.child(stack.nodes[-1], name, rest))
                if name in MUTED and not muted:
                    muted = len(stack.names) - 1
        elif name in INLINE:
            place = stack.last(name)
            if place > stack.blocks[-1]:
                stack.cut(place)
        else:
            flush()
            place = stack.last(name)
            if place:
                stack.cut(place)
        if muted >= len(stack.names):
            muted = 0
    flush()
    return out
