"""The checks of one document while it is in Python: the same findings as of its node table.

A walk knows what the rules ask of the nodes before a node, so there is nothing to sort; only
findings leave it.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from .books import CATEGORY
from .parser import ByteOffsets, Document
from .style import Sheet, default_sheet
from .tree import Node

_NAME = re.compile("^[A-Za-z_][A-Za-z0-9._-]*$").search
_NUMBER = re.compile("[0-9]{1,18}").fullmatch
_SPEAKER = re.compile("^qt.*-[se]$").search
_FAR = 1 << 62


def findings(doc: Document, sheet: Sheet | None = None) -> list[tuple]:
    """(seq, code, message, start, end), places in bytes; seq is -1 for the document as a whole."""
    return Checks(doc, sheet or default_sheet()).run()


class Checks:
    """A verse number of a chapter repeats another if they share a number, and the segments of it
    where both have one. Segments stand at single numbers only, so what came before is two sets
    of disjoint intervals, all numbers and those without segment, and the pairs with one."""

    def __init__(self, doc: Document, sheet: Sheet):
        self.doc, self.styles, self.at = doc, sheet.styles, ByteOffsets(doc.source)
        self.found: list[tuple] = []
        self.note_only: dict[str, bool] = {}
        self.book = self.chapter = self.last = None
        self.chapter_seen = False
        self.numbers: set[int | None] = set()
        self.due = 1
        self.new_chapter()

    def new_chapter(self) -> None:
        self.every, self.whole, self.parts, self.before = [], [], set(), None

    def say(self, seq: int, code: str, message: str, start: int | None, end: int | None) -> None:
        self.found.append((seq, code, message, start, end))

    def of(self, node: Node, seq: int, code: str, message: str) -> None:
        self.found.append((seq, code, message, self.at(node.start), self.at(node.end)))

    def run(self) -> list[tuple]:
        blocks = self.doc.blocks
        if blocks and blocks[0].kind != "book":
            self.say(-1, "missing-id", "a document starts with \\id", 0, 0)
        elif len(blocks) == 1:
            end = len(self.doc.source) if self.doc.source.isascii() else len(self.doc.source.encode("utf-8", "surrogatepass"))
            self.say(-1, "empty-book", "nothing but an \\id line", end, end)
        seq = -1
        # (node, place among its siblings, para, note, in a cell, in a style)
        stack = [(b, i, None, None, False, 0, False) for i, b in reversed(list(enumerate(blocks)))]
        while stack:
            node, i, para, note, cell, depth, in_char = stack.pop()
            seq += 1
            kind = node.kind
            if kind == "text" or kind == "verse_end":
                continue
            if kind == "verse_start":
                self.verse(node, seq, para, depth)
            elif kind == "para":
                s = self.styles.get(node.marker)
                if not self.chapter_seen and s is not None and s.text == "versetext" and self.book is not None and CATEGORY.get(self.book) != "NonScripture":
                    self.of(node, seq, "verse-text-before-chapter", f"\\{node.marker} is verse text before the first \\c")
            elif kind == "chapter_start":
                self.chapter_start(node, seq)
            elif kind == "book":
                self.id(node, seq, i)
            elif kind == "row":
                self.due = 1
            elif kind == "cell":
                col, due = node.data["col"], self.due
                if col != due:
                    self.of(node, seq, "unexpected-table-column", f"column {col} where {due} was due")
                self.due = min(col + node.data["colspan"], 255)
            elif kind == "char" or kind == "note":
                parent = None if cell else para if kind == "note" else None if in_char else note if note is not None else para
                if parent is not None:
                    self.placed(node, seq, parent)
                if kind == "char" and node.marker == "w" and node.attributes is not None and not node.children:
                    self.of(node, seq, "empty-word", "\\w has attributes and no text")
            if node.attributes is not None and kind in ("char", "milestone", "periph"):
                self.attributes(node, seq)
            if not node.children:
                continue
            if kind == "para":
                para, note, cell, depth, in_char = node.marker, None, False, 0, False
            elif kind == "cell":
                para, note, cell, depth, in_char = None, None, True, 0, False
            elif kind == "char":
                depth, in_char = depth + 1, True
            elif kind == "note":
                note, in_char = node.marker, False
            elif kind in ("sidebar", "periph", "table", "row"):
                para = note = None
            k = len(node.children)
            for c in reversed(node.children):
                k -= 1
                stack.append((c, k, para, note, cell, depth, in_char))
        return self.found

    def id(self, node: Node, seq: int, i: int) -> None:
        code = node.data.get("code")
        if code is not None:
            if code not in CATEGORY:
                self.of(node, seq, "unlisted-book-code", f"{code} is not a listed book code")
            self.book = code
        if i > 0:
            self.of(node, seq, "id-not-first", "\\id is not the first marker")
        self.chapter = self.last = None
        self.numbers = set()
        self.new_chapter()

    def chapter_start(self, node: Node, seq: int) -> None:
        self.chapter_seen = True
        number = node.data.get("number")
        n = int(number) if number is not None and _NUMBER(number) else None
        if n in self.numbers:
            self.of(node, seq, "duplicate-chapter-number", f"chapter {number} again")
        elif self.last is not None and n is not None and n < self.last:
            self.of(node, seq, "chapter-out-of-order", f"chapter {number} after {self.last}")
        self.numbers.add(n)
        self.last = n
        self.chapter = number if number is not None else self.chapter
        self.new_chapter()

    def verse(self, node: Node, seq: int, para: str | None, depth: int) -> None:
        if not self.chapter_seen:
            self.of(node, seq, "verse-outside-chapter", "\\v before any \\c")
        if para is not None and para != "s5" and (s := self.styles.get(para)) is not None and s.text in ("title", "section"):
            self.of(node, seq, "verse-in-heading", "\\v in a title or heading")
        if depth:
            self.of(node, seq, "verse-in-character-style", "\\v in a character style")
        ranges = node.data.get("ranges")
        if not ranges:
            self.before = None
        elif self.chapter is not None:
            again, late = self.numbered(ranges)
            if again is not None:
                self.of(node, seq, "duplicate-verse-number", f"verse {again} again in chapter {self.chapter}")
            elif late:
                self.of(node, seq, "verse-out-of-order", f"verse {late} in chapter {self.chapter}")

    def numbered(self, ranges) -> tuple[str | None, str | None]:
        """What is repeated of a verse number, and its start and the end before where it goes back."""
        again, parts = None, []
        for r in ranges:
            a, x, b, y = r.start, r.start_part, r.end, r.end_part
            parts.append((a, a, x))
            if b > a + 1:
                parts.append((a + 1, b - 1, ""))
            if b != a or y != "" and y != x:
                parts.append((b, b, y))
        for lo, hi, part in parts:
            n = _covered(self.every, lo, hi) if not part else lo if (lo, part) in self.parts or _covered(self.whole, lo, lo) is not None else None
            if n is not None:
                again = f"{n}{part if lo == hi else ''}"
                break
        for lo, hi, part in parts:
            _cover(self.every, lo, hi)
            if part:
                self.parts.add((lo, part))
            else:
                _cover(self.whole, lo, hi)
        first, last = ranges[0], ranges[-1]
        start, before = (first.start, first.start_part), self.before
        self.before = last.end, last.start_part if last.start == last.end and last.end_part == "" else last.end_part
        late = before is not None and start < before
        return again, f"{start[0]}{start[1]} after {before[0]}{before[1]}" if late else None

    def placed(self, node: Node, seq: int, parent: str) -> None:
        s = self.styles.get(node.marker)
        if s is None or not s.parents or parent in s.parents:
            return
        only = self.note_only.get(node.marker)
        if only is None:
            only = self.note_only[node.marker] = all((p := self.styles.get(x)) is not None and p.kind == "note" for x in s.parents)
        if only:
            self.of(node, seq, "marker-not-allowed-here", f"\\{node.marker} can't stand under \\{parent}")
        else:
            self.of(node, seq, "marker-not-listed-here", f"\\{node.marker} doesn't list \\{parent}")

    def attributes(self, node: Node, seq: int) -> None:
        pairs, marker = node.attributes, node.marker
        style = self.styles.get(marker)
        pipe = self.at(node.pipe) if node.pipe is not None else None
        after = pipe + 1 if pipe is not None else None
        if not pairs:
            milestone = style.kind == "milestone" if style is not None else node.kind == "milestone"
            self.say(seq, "empty-milestone-attribute-list" if milestone else "empty-attribute-list", "no attribute after |", pipe, after)
            return
        if any(not p[0] for p in pairs):
            default = style.default_attribute if style is not None else "who" if marker is not None and _SPEAKER(marker) else None
            if default is None:
                self.say(seq, "no-default-attribute", f"\\{marker} has no default attribute", pipe, after)
            if len(pairs) > 1:
                self.say(seq, "default-attribute-with-others", "a value without a name stands beside others", pipe, after)
        names = set()
        for name, _, a, b in pairs:
            if name and not _NAME(name):
                self.say(seq, "malformed-attribute-name", f"{name} can't be an attribute name", self.at(a), self.at(b))
            if name in names:
                self.say(seq, "duplicate-attribute", f"{name or 'the default attribute'} is given again", self.at(a), self.at(b))
            names.add(name)


def _covered(spans: list[list[int]], lo: int, hi: int) -> int | None:
    """The least number from ``lo`` to ``hi`` in disjoint ordered intervals."""
    if not spans or spans[-1][1] < lo:
        return None
    i = bisect_right(spans, [lo, _FAR])
    if i and spans[i - 1][1] >= lo:
        return lo
    return spans[i][0] if i < len(spans) and spans[i][0] <= hi else None


def _cover(spans: list[list[int]], lo: int, hi: int) -> None:
    """Add an interval to disjoint ordered ones."""
    if not spans or spans[-1][1] < lo - 1:
        spans.append([lo, hi])
        return
    i = bisect_right(spans, [lo, _FAR])
    if i and spans[i - 1][1] >= lo - 1:
        i -= 1
        lo, hi = spans[i][0], max(hi, spans[i][1])
    j = i
    while j < len(spans) and spans[j][0] <= hi + 1:
        hi = max(hi, spans[j][1])
        j += 1
    spans[i:j] = [[lo, hi]]
