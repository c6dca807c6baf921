"""Repairs of markup for five kinds of diagnostics, and canonical form."""

from __future__ import annotations

import re
from dataclasses import dataclass

from .parser import Diagnostic, Document, parse
from .style import Sheet
from .tree import WS, walk
from .writers import to_markup

FIXABLE = ("unknown-marker", "character-style-not-closed", "missing-note-caller", "attribute-value-not-quoted", "empty-milestone-attribute-list")
PASSES = 16


@dataclass(frozen=True)
class Edit:
    start: int
    end: int
    text: str


@dataclass(frozen=True)
class Fix:
    code: str
    title: str
    edits: tuple[Edit, ...]


def _semantic(doc: Document) -> list[Diagnostic]:
    """The one fixable finding that is a check of the tree and not of the parser."""
    return [Diagnostic("empty-milestone-attribute-list", n.pipe, n.pipe + 1, "no attribute after |") for _, n in walk(doc.blocks) if n.kind == "milestone" and n.attributes == [] and n.pipe is not None]


def fix(doc: Document, d: Diagnostic) -> Fix | None:
    src, a, b = doc.source, d.start, d.end
    here = src[a:b]
    if d.code == "unknown-marker" and here.startswith("\\"):
        end = b + len(re.match(r"[ \t]*", src[b:])[0])
        return Fix(d.code, f"Delete {here}", (Edit(a, end, ""),))
    if d.code == "character-style-not-closed" and here.startswith("\\"):
        node = next((n for _, n in walk(doc.blocks) if n.kind == "char" and n.start == a), None)
        if node is None:
            return None
        end = max(b, node.children[-1].end if node.children else b)
        while end > b and src[end - 1] in WS:
            end -= 1
        return Fix(d.code, f"Close {here}", (Edit(end, end, here + "*"),))
    if d.code == "missing-note-caller" and here.startswith("\\"):
        return Fix(d.code, f"Give {here} the caller +", (Edit(b, b, " +" if src[b : b + 1] and src[b] in WS else " + "),))
    if d.code == "attribute-value-not-quoted" and here and '"' not in here:
        return Fix(d.code, f"Quote {here}", (Edit(a, b, f'"{here}"'),))
    if d.code == "empty-milestone-attribute-list" and here == "|":
        while a and src[a - 1] in " \t":
            a -= 1
        return Fix(d.code, "Delete the empty list", (Edit(a, b, ""),))
    return None


def fixes(doc: Document, only: tuple[str, ...] | None = None) -> list[Fix]:
    found = sorted([*doc.diagnostics, *_semantic(doc)], key=lambda d: d.start)
    return [f for d in found if (only is None or d.code in only) and (f := fix(doc, d))]


def apply(source: str, wanted: list[Fix]) -> tuple[str, list[int]]:
    """The text with fixes applied from the start on; one that overlaps or touches an earlier
    one waits. The numbers of those that were applied come with it."""
    order = sorted(range(len(wanted)), key=lambda i: (min(e.start for e in wanted[i].edits), i))
    covered, taken, edits = -1, [], []
    for i in order:
        start, end = min(e.start for e in wanted[i].edits), max(e.end for e in wanted[i].edits)
        if start <= covered or end > len(source):
            continue
        covered = end
        taken.append(i)
        edits += wanted[i].edits
    for e in sorted(edits, key=lambda e: -e.start):
        source = source[: e.start] + e.text + source[e.end :]
    return source, sorted(taken)


def fix_source(source: str, sheet: Sheet | None = None, only: tuple[str, ...] | None = None) -> tuple[str, int]:
    """Fix and read again until nothing is left to fix; the text and how many were applied."""
    count = 0
    for _ in range(PASSES):
        found = fixes(parse(source, sheet), only)
        if not found:
            break
        source, taken = apply(source, found)
        count += len(taken)
    return source, count


def format_source(source: str, sheet: Sheet | None = None, force: bool = False) -> str | None:
    """Canonical form; None for a text with errors, unless forced."""
    doc = parse(source, sheet)
    if not force and any(d.severity == "error" for d in doc.diagnostics):
        return None
    return to_markup(doc)
