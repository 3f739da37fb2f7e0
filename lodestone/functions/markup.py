"""A tag reader for HTML whose time grows with the length of its input, whatever is unclosed in it.

Offsets are those of the text as it is: nothing is lower-cased or replaced before it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

_TIGHT = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_LOOSE = re.compile(r"<\s*(/?)\s*([^\s<>/!?]+)")
_EVENT = re.compile(r"""[>"']""")


@dataclass(slots=True)
class Tag:
    """A tag at start..stop; no name: a comment or declaration. attributes: what stands between name and end."""

    start: int
    stop: int
    name: str = ""
    closing: bool = False
    attributes: str = ""

    @property
    def closed(self) -> bool:
        return self.attributes.endswith("/")


class _Ends:
    """Ends of tags: the next > outside quotes. A quote that never closes is a character like others.

    Starts that lead to no end are remembered by the first quote that they reach, so a second look is cheap."""

    def __init__(self, html: str):
        self.html, self.last = html, html.rfind(">")
        self.dead: set[int] = set()
        self.seen = (0, -1)  # from the first place to the second one there is no event but at the second

    def _next(self, at: int) -> int:
        if not self.seen[0] <= at <= self.seen[1]:
            found = _EVENT.search(self.html, at)
            self.seen = (at, found.start() if found else len(self.html))
        return self.seen[1]

    def after(self, at: int) -> int:
        visited = []
        while at <= self.last:
            event = self._next(at)
            if event >= len(self.html) or event in self.dead:
                break
            if self.html[event] == ">":
                return event
            visited.append(event)
            close = self.html.find(self.html[event], event + 1)
            at = event + 1 if close < 0 else close + 1
        self.dead.update(visited)
        return -1


def tags(html: str, loose: bool = False, at: int = 0) -> Iterator[Tag]:
    """The tags in order. loose: white space may stand before a name. Send a place to go on from there."""
    ends, n, name = _Ends(html), len(html), _LOOSE if loose else _TIGHT
    while (start := html.find("<", at)) >= 0:
        if html.startswith("<!--", start):
            stop = html.find("-->", start + 4)
            tag = Tag(start, n if stop < 0 else stop + 3)
        elif html.startswith(("<!", "<?"), start):
            stop = html.find(">", start) if start < ends.last else -1
            if stop < 0:
                at = start + 1
                continue
            tag = Tag(start, stop + 1)
        else:
            found = name.match(html, start)
            stop = ends.after(found.end()) if found else -1
            if stop < 0:
                at = start + 1
                continue
            tag = Tag(start, stop + 1, ascii_lower(found[2]), bool(found[1]), html[found.end() : stop])
        place = yield tag
        at = tag.stop if place is None else place
        if place is not None:
            yield tag  # the answer to send()


_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def ascii_lower(text: str) -> str:
    """A-Z lower-cased; the length stays."""
    return text.translate(_LOWER)


@lru_cache(maxsize=256)
def _end_tag(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)", re.I | re.A)


def end_tag(html: str, name: str, at: int) -> tuple[int, int]:
    """Start and stop of the next end tag of an element; -1 if there is none, and for the stop if it is cut off."""
    found = _end_tag(name).search(html, at)
    if not found:
        return -1, -1
    return found.start(), html.find(">", found.end()) + 1 or -1
