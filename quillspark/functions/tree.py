"""The tree of one document, while it is in Python, and its rows."""

from __future__ import annotations

import sys

#: Levels of a tree. What is nested deeper is read into the last of them with a diagnostic, so
#: no document can exhaust the stack of a reader, walk or writer.
MAX_DEPTH = 400
sys.setrecursionlimit(max(sys.getrecursionlimit(), 12 * MAX_DEPTH + 1000))
WS = " \t\n\f\r"
SYNTHETIC = (0, 0)


class Node:
    """``kind`` is one of the 17 node types; ``data`` has what only some kinds have: code,
    description, number (text), ranges, alt_number, pub_number, caller, category, title,
    header, alignment, col, colspan. ``attributes`` is None without a list, else
    [(name, value, start, end), ...]."""

    __slots__ = ("kind", "marker", "start", "end", "content", "children", "attributes", "pipe", "data")

    def __init__(self, kind, marker=None, start=0, end=0, content=None, children=None, data=None):
        self.kind, self.marker, self.start, self.end, self.content = kind, marker, start, end, content
        self.children = [] if children is None else children
        self.attributes = self.pipe = None
        self.data = data or {}

    def __repr__(self):
        inside = repr(self.content) if self.kind == "text" else self.children
        return f"{self.kind}({self.marker}, {self.data or ''}{inside})"

    def add(self, child: Node) -> None:
        """Append with the rules for text: none that starts a container or follows a verse
        number keeps leading white space, and neighbouring runs are one."""
        if child.kind == "text":
            last = self.children[-1] if self.children else None
            if child.content[:1] in WS and (last is None or last.kind == "verse_start"):
                child.content = child.content.lstrip(WS)
                if not child.content:
                    return
            if last is not None and last.kind == "text":
                more = child.content.lstrip(WS) if last.content[-1:] and last.content[-1] in WS else child.content
                last.content += more
                if (last.start, last.end) == SYNTHETIC:
                    last.start, last.end = child.start, child.end
                elif (child.start, child.end) != SYNTHETIC:
                    last.end = child.end
                return
        self.children.append(child)

    def trim_end(self) -> None:
        if self.children and self.children[-1].kind == "text":
            last = self.children[-1]
            last.content = last.content.rstrip(WS)
            if not last.content:
                self.children.pop()


_NOTHING: dict = {}


def text(content: str, start: int = 0, end: int = 0) -> Node:
    """A run of text, which holds no others and no data."""
    node = Node.__new__(Node)
    node.kind, node.marker, node.start, node.end, node.content = "text", None, start, end, content
    node.children, node.attributes, node.pipe, node.data = (), None, None, _NOTHING
    return node


def collapse(value: str) -> str:
    """Every run of white space as one space."""
    for c in "\n\t\r\f":
        if c in value:
            value = value.replace(c, " ")
    while "  " in value:
        value = value.replace("  ", " ")
    return value


def walk(blocks, path=()):
    """(path, node) of every node in document order, parents first."""
    stack = [(path + (i,), n) for i, n in reversed(list(enumerate(blocks)))]
    while stack:
        p, n = stack.pop()
        yield p, n
        stack.extend((p + (i,), c) for i, c in reversed(list(enumerate(n.children))))
