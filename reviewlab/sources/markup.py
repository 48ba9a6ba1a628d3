"""Elements of web pages: a scanner of tags with nesting.

Elements end at their own closing tag. Those whose closing tag may be left out (``li``, ``p``, table cells
and so on) also end where the next one of their kind or the end of what holds them comes. Attributes may be
in any order, in single, double or no quotes, and may hold ``>``. Comments, scripts and styles hold
no tags. Named and numeric character references are read in texts and attributes.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

# Elements without content, with raw content, and whose end may be left out, with what holds them.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title"])
HELD_BY = {"li": {"ul", "ol", "menu"}, "p": {"div", "li", "td", "body", "section", "article", "blockquote"},
           "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "tr": {"table", "tbody", "thead", "tfoot"},
           "td": {"tr", "table"}, "th": {"tr", "table"}}
ENDS_TOO = {"dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}}

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'<>]++)*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.S)


@dataclass(frozen=True)
class Element:
    """What to look for: a tag, attributes it has to have, and what to take, its text or an attribute.

    Python keywords and hyphens in attributes are written with underscores: ``class_``, ``ng_repeat``. A class is
    met by the whole value or by one of its words.
    """

    tag: str
    attrs: Mapping[str, str] = field(default_factory=dict)
    take: str | None = None

    def wanted(self) -> list[tuple[str, str]]:
        return [(n.strip("_").replace("_", "-"), value) for n, value in self.attrs.items()]


class Node:
    """An element that is open, or was read: its place, its parts, and what is in it."""

    __slots__ = ("tag", "raw", "texts", "children", "begin", "end", "_attrs")

    def __init__(self, tag: str, raw: str, begin: int):
        self.tag, self.raw, self.begin, self.end = tag, raw, begin, -1
        self.texts: list[str] = []
        self.children: list[Node] = []
        self._attrs: dict[str, str] | None = None

    @property
    def attrs(self) -> dict[str, str]:
        if self._attrs is None:
            self._attrs = {}
            for name, double, single, bare in ATTRIBUTE.findall(self.raw):
                self._attrs.setdefault(name.lower(), html.unescape(double or single or bare))
        return self._attrs

    def string(self) -> str | None:
        """The text, if there is nothing but text, or nothing but one element that has only text."""
        node = self
        while not node.texts and len(node.children) == 1:
            node = node.children[0]
        return html.unescape("".join(node.texts)) if node.texts and not node.children else None

    def meets(self, spec: Element) -> bool:
        if self.tag != spec.tag:
            return False
        return all(self.attrs.get(n) == value or (n == "class" and value in self.attrs.get(n, "").split()) for n, value in spec.wanted())


def read_nodes(page: str) -> list[Node]:
    """All elements in the order of their opening tags, each with the number of the one after its last descendant."""
    nodes: list[Node] = []
    stack: list[Node] = []
    open_tags: Counter[str] = Counter()
    at = 0

    def close_to(depth: int) -> None:
        for node in stack[depth:]:
            node.end = len(nodes)
            open_tags[node.tag] -= 1
        del stack[depth:]

    def add_text(text: str) -> None:
        if text and stack:
            stack[-1].texts.append(text)

    while True:
        match = TAG.search(page, at)
        if not match:
            add_text(page[at:])
            break
        add_text(page[at:match.start()])
        at = match.end()
        closing, tag, raw = match.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if open_tags[tag]:
                close_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            continue
        if tag in HELD_BY:
            same = ENDS_TOO.get(tag, {tag})
            if any(open_tags[t] for t in same):
                top = next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag in same or stack[i].tag in HELD_BY[tag])
                if stack[top].tag in same:
                    close_to(top)
        node = Node(tag, raw, len(nodes))
        nodes.append(node)
        if stack:
            stack[-1].children.append(node)
        if tag in VOID or raw.rstrip().endswith("/"):
            node.end = len(nodes)
            continue
        stack.append(node)
        open_tags[tag] += 1
        if tag in RAW:
            end = re.compile(f"</{tag}[\\s/>]", re.I).search(page, at)
            add_text(page[at:end.start() if end else len(page)])
            at = end.start() if end else len(page)
    close_to(0)
    return nodes


def first(nodes: list[Node], spec: Element) -> str | None:
    """What the first such element gives."""
    for node in nodes:
        if node.meets(spec):
            return node.string() if spec.take is None else node.attrs.get(spec.take)
    return None


def read_blocks(page: str, block: Element, fields: Mapping[str, Element], page_fields: Mapping[str, Element]) -> Iterator[list[str | None]]:
    """Page fields and block fields of every block, in page order; a block may lie within another."""
    nodes = read_nodes(page)
    shared = [first(nodes, spec) for spec in page_fields.values()]
    for node in nodes:
        if node.meets(block):
            own = nodes[node.begin + 1:node.end]
            # A field of the block's own tag and attributes is the block itself.
            yield shared + [first([node], s) if s.tag == block.tag and s.attrs == block.attrs else first(own, s) for s in fields.values()]
