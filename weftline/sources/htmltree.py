"""A tolerant HTML tree: void elements, implied end tags, unknown end tags ignored."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

_MARKUP = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(script|style)\b([^>]*)>(.*?)</\1\s*>|<(/?)([A-Za-z][\w:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'<>]+)))?")
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("#text a abbr b bdi bdo br cite code data del dfn em font i img ins kbd mark q s samp small span strike strong sub sup time tt u var wbr input label".split())
_CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}


class Element:
    """A node; its attributes are taken apart when they are first asked for. ``measure`` is free for what walks the tree."""

    __slots__ = ("tag", "_attributes", "children", "parent", "measure")

    def __init__(self, tag: str, attributes: dict[str, str] | str, parent: Element | None):
        self.tag, self._attributes, self.parent = tag, attributes, parent
        self.children: list[Element | str] = []

    @property
    def attributes(self) -> dict[str, str]:
        if isinstance(self._attributes, str):
            self._attributes = _attributes(self._attributes)
        return self._attributes

    @property
    def bare(self) -> bool:
        return not self._attributes

    def walk(self) -> Iterator[Element]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Element)]

    def first(self, *tags: str) -> Element | None:
        return next((n for n in self.walk() if n.tag in tags), None)

    def text(self) -> str:
        """All text, with a space where a block element or line break begins and ends; scripts and styles have none."""
        out: list[str] = []
        stack: list[tuple[str, Iterator[Element | str]]] = [("", iter(self.children))]
        while stack:
            gap, rest = stack[-1]
            for c in rest:
                if isinstance(c, str):
                    out.append(c)
                elif c.tag not in ("script", "style"):
                    space = " " if c.tag not in INLINE or c.tag == "br" else ""
                    out.append(space)
                    stack.append((space, iter(c.children)))
                    break
            else:
                out.append(gap)
                stack.pop()
        return "".join(out)


def parse(source: str) -> Element:
    root = node = Element("#root", {}, None)
    at = 0

    def add(piece: str) -> None:
        if piece:
            node.children.append(html.unescape(piece) if "&" in piece else piece)

    for m in _MARKUP.finditer(source):
        add(source[at : m.start()])
        at = m.end()
        raw, closing, name = m.group(1), m.group(4), m.group(5)
        if raw:
            leaf = Element(raw.lower(), m.group(2), node)
            leaf.children.append(m.group(3))
            node.children.append(leaf)
            continue
        if name is None:
            continue
        name = name.lower()
        if closing:
            up = node
            while up is not root and up.tag != name:
                up = up.parent
            if up is not root:
                node = up.parent
            continue
        up, stops = node, _STOPS.get(name, set())
        while name in _CLOSES and up is not root and up.tag not in stops:
            if up.tag in _CLOSES[name]:  # a row ends an open cell and the row before
                node = up.parent
            elif name == "p" and up.tag not in INLINE:
                break
            up = up.parent
        if name not in INLINE and name not in VOID:  # a block ends an open paragraph
            up = node
            while up is not root and up.tag in INLINE:
                up = up.parent
            if up is not root and up.tag == "p":
                node = up.parent
        new = Element(name, m.group(6).strip(), node)
        node.children.append(new)
        if name not in VOID and not m.group(6).rstrip().endswith("/"):
            node = new
    add(source[at:])
    return root


def _attributes(text: str) -> dict[str, str]:
    return {m.group(1).lower(): html.unescape(m.group(2) or m.group(3) or m.group(4) or "") for m in _ATTRIBUTE.finditer(text)}
