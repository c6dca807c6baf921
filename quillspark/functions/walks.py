"""What a walk through one document gives without a table of its nodes.

The same results as the operators of the same names have of node tables; only what was asked for
leaves Python, and nothing is sorted that stands in order already. A walk gives up the tree on its
way, so a document is walked once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from .parser import ByteOffsets, Document
from .tree import WS, Node

_NUMBER = re.compile("[0-9]{1,18}").fullmatch
_PUNCT = r""".?!,۔؟“”"'‘’،:;\(\)"""
_OPEN = r""""'”“‘’\("""
# White space as the engine's patterns have it.
_BEFORE_QUOTE = re.compile(f"((?:^|(?<=[ \t\n\x0b\f\r])))([{_OPEN}][{_PUNCT}]*)").sub
_AFTER = re.compile(f"(?<![{_PUNCT}\u0001])([{_PUNCT}]+)").sub


def scopes(doc: Document) -> Iterator[tuple]:
    """(seq, node, para, note, chars, block, direct) of every node, as the node table has them."""
    seq = -1
    stack = [(b, 1, None, None, (), None) for b in reversed(doc.blocks)]
    doc.blocks.clear()
    while stack:
        node, level, para, note, chars, block = stack.pop()
        seq += 1
        yield seq, node, para, note, chars, block, level == 2 and para is not None
        if not node.children:
            continue
        kind = node.kind
        if kind == "para":
            para, note, chars, block = node.marker, None, (), seq
        elif kind == "cell":
            para, note, chars, block = None, None, (), seq
        elif kind == "char":
            chars = (*chars, node.marker)
        elif kind == "note":
            note, block = node.marker, seq
        elif kind in ("sidebar", "periph", "table", "row"):
            para = note = None
        level += 1
        for c in reversed(node.children):
            stack.append((c, level, para, note, chars, block))
        node.children = ()


class Plain:
    """Text of runs in order: a new block puts the separator between, white space doesn't double,
    none is left at the end."""

    def __init__(self, separator: str = " "):
        self.separator, self.parts, self.block = separator, [], None

    def add(self, block: int | None, content: str) -> None:
        parts = self.parts
        if parts and block != self.block:
            self.trim()
            parts.append(self.separator)
        self.block = block
        if parts and parts[-1][-1] in WS:
            content = content.lstrip(WS)
        if content:
            parts.append(content)

    def trim(self) -> None:
        while self.parts:
            last = self.parts[-1].rstrip(WS)
            if last:
                self.parts[-1] = last
                return
            self.parts.pop()

    def __str__(self) -> str:
        self.trim()
        return "".join(self.parts)


def document_text(doc: Document) -> Iterator[tuple]:
    """The text without notes; nothing for a document without nodes."""
    if not doc.blocks:
        return
    out = Plain()
    for _, node, _, note, _, block, _ in scopes(doc):
        if node.kind == "text" and note is None:
            out.add(block, node.content)
    yield (str(out),)


def _first_book(blocks: list[Node]) -> str | None:
    for b in blocks:
        code = b.data.get("code") if b.kind == "book" else _first_book(b.children) if b.kind in ("sidebar", "periph") else None
        if code is not None:
            return code
    return None


def verse_text(doc: Document) -> Iterator[tuple]:
    """(seq, book, chapter, number, text) of every verse, notes left out."""
    book, chapter = _first_book(doc.blocks), None
    verse, out, ended = None, Plain(), True
    for seq, node, _, note, _, block, _ in scopes(doc):
        kind = node.kind
        if kind == "text":
            if not ended and note is None:
                out.add(block, node.content)
        elif kind == "verse_start":
            if verse is not None:
                yield (*verse, str(out))
            verse, out, ended = (seq, book, chapter, node.data.get("number")), Plain(), False
        elif kind == "verse_end":
            ended = ended or node.data.get("number") == verse[3]
        elif kind == "chapter_start":
            number = node.data.get("number")
            chapter = int(number) if number is not None and _NUMBER(number) else None
        elif kind in ("chapter_end", "periph"):
            chapter = None
    if verse is not None:
        yield (*verse, str(out))


def cut(text: str) -> list[str]:
    """Sections of a text, blanks included, as ``operators.text.cut`` makes them."""
    return _AFTER("\\1\u0001", _BEFORE_QUOTE("\\1\u0001\\2", text)).split("\u0001")


def sections(doc: Document, vernacular: frozenset[str]) -> Iterator[tuple]:
    """(ord, section) over texts directly in vernacular paragraphs."""
    at, ord_, acc = None, 0, []
    for _, node, para, _, _, block, direct in scopes(doc):
        if node.kind != "text" or not direct or para not in vernacular:
            continue
        if block != at:
            for s in acc:
                if s := s.strip(" "):
                    yield ord_, s
                    ord_ += 1
            at, acc = block, []
        cuts = cut(node.content)
        if acc:
            acc[-1] += cuts[0]
            acc += cuts[1:]
        else:
            acc = cuts
    for s in acc:
        if s := s.strip(" "):
            yield ord_, s
            ord_ += 1


def styled_text(doc: Document, marker: str) -> Iterator[tuple]:
    """(seq, text, attributes, book, chapter, span_start, span_end, noted) of each outermost
    character style ``marker``; a style of the same name inside is part of it."""
    at = ByteOffsets(doc.source)
    book = chapter = head = None
    out = Plain()
    for seq, node, _, note, chars, block, _ in scopes(doc):
        kind = node.kind
        if kind == "text":
            if head is not None and marker in chars:
                out.add(block, node.content)
        elif kind == "char":
            if node.marker == marker and marker not in chars:
                if head is not None:
                    yield (head[0], str(out), *head[1:])
                pairs = None if node.attributes is None else [{"name": n, "value": v, "start": at(a), "end": at(z)} for n, v, a, z in node.attributes]
                head, out = (seq, pairs, book, chapter, at(node.start), at(node.end), note is not None), Plain()
        elif kind == "book":
            code = node.data.get("code")
            book, chapter = code if code is not None else book, None
        elif kind == "chapter_start":
            chapter = node.data.get("number")
    if head is not None:
        yield (head[0], str(out), *head[1:])
