"""Leaf blocks of an HTML page: text with the tags, classes and ids above it.

Time and memory grow with the page's length, whatever is unclosed or nested in it: tags are read by
`functions.markup`, blocks share the nodes above them, and a node shares its parent's feature names where it adds none.
"""

from __future__ import annotations

import re
from html import unescape

from lodestone.functions import markup

_ATTRIBUTE = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: Elements whose content is no text of the page.
SKIPPED = frozenset("script style noscript template textarea title svg math iframe object select option canvas audio video head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside a line of text: they neither begin nor end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: A new one of these ends an open one of the same kind without its end tag.
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_PARAGRAPH_ENDERS = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_STOPS = frozenset("ul ol table dl div section article aside nav main body html".split())
_SPACE = re.compile(r"\s+")


class Node:
    """An open element: its tag, the words of its class, id and role, and what stands above it."""

    __slots__ = ("above", "known", "tag", "words")

    def __init__(self, tag: str, words: tuple[str, ...], above: Node | None):
        self.tag, self.words, self.above = tag, words, above
        self.known: tuple[object, frozenset[str]] | None = None


_NO_NAMES: frozenset[str] = frozenset()


def names_above(node: Node | None, vocabulary: dict | None) -> frozenset[str]:
    """The feature names of a node and all above it; those in the vocabulary only, if there is one."""
    todo = []
    while node is not None and (node.known is None or node.known[0] is not vocabulary):
        todo.append(node)
        node = node.above
    names = node.known[1] if node is not None else _NO_NAMES
    for x in reversed(todo):
        own = {n for n in (f"in {x.tag}", *(f"word {w}" for w in x.words)) if vocabulary is None or n in vocabulary}
        if not own <= names:
            names |= own
        x.known = (vocabulary, names)
    return names


class Block:
    """One leaf block: its text, the innermost node around it, and characters inside links."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, text: str, node: Node | None, linked: int):
        self.text, self.node, self.linked = text, node, linked

    @property
    def tag(self) -> str:
        return self.node.tag if self.node else ""


def _words(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = []
    for _, a, b, c in _ATTRIBUTE.findall(attributes):
        found += re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", a or b or c).lower())
    return tuple(found)


class _Open:
    """The open elements, with a count of each tag: in all, and since the last element that ends a search (`_STOPS`)."""

    def __init__(self):
        self.nodes: list[Node] = []
        self.count: dict[str, int] = {}
        self.scopes: list[dict[str, int]] = [{}]

    @property
    def top(self) -> Node | None:
        return self.nodes[-1] if self.nodes else None

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        self.nodes.append(Node(tag, words, self.top))
        self.count[tag] = self.count.get(tag, 0) + 1
        if tag in _STOPS:
            self.scopes.append({})
        self.scopes[-1][tag] = self.scopes[-1].get(tag, 0) + 1

    def pop(self) -> str:
        tag = self.nodes.pop().tag
        self.count[tag] -= 1
        self.scopes[-1][tag] -= 1
        if tag in _STOPS:
            self.scopes.pop()
        return tag

    def close(self, tag: str) -> None:
        """End the innermost element of this tag, and what is open in it."""
        if self.count.get(tag):
            while self.pop() != tag:
                pass

    def close_any(self, tags: set[str]) -> None:
        """The same for any of these tags, if one is open since the last stop."""
        if any(self.scopes[-1].get(t) for t in tags):
            while self.pop() not in tags:
                pass


def leaf_blocks(html: str) -> list[Block]:
    """The blocks with text in page order. White space becomes one space; character references are decoded."""
    out: list[Block] = []
    opened = _Open()
    parts: list[str] = []
    links = linked = 0
    endless: set[str] = set()  # elements without a further end tag

    def end() -> None:
        nonlocal linked
        if parts:
            text = _SPACE.sub(" ", "".join(parts)).strip()
            if text:
                out.append(Block(text, opened.top, linked))
            parts.clear()
        linked = 0

    def read(raw: str) -> None:
        nonlocal linked
        text = unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            linked += len(text.strip())

    at, n = 0, len(html)
    reader = markup.tags(html)
    for tag in reader:
        if tag.start > at:
            read(html[at : tag.start])
        at, name = tag.stop, tag.name
        if not name:
            continue
        if tag.closing:
            if name == "a":
                links = 0
            elif name not in INLINE and name not in VOID:
                end()
                opened.close(name)
                links = 0
            continue
        if name in SKIPPED and name != "head":
            if not tag.closed:
                start, stop = markup.end_tag(html, name, at) if name not in endless else (-1, -1)
                if start >= 0:
                    at = n if stop < 0 else stop
                else:
                    endless.add(name)
                    at = n if name in ("script", "style") else at
                reader.send(at)
            continue
        if name in INLINE:
            links += name == "a" and not links
            continue
        end()
        if name in VOID or tag.closed:
            continue
        if name in _PARAGRAPH_ENDERS and opened.top and opened.top.tag == "p":
            opened.pop()
        if name in _CLOSES:
            opened.close_any(_CLOSES[name])
        opened.push(name, _words(tag.attributes))
    if at < n:
        read(html[at:])
    end()
    return out
