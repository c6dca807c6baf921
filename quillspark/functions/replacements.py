"""Replacement rules for the text of a document, and transliteration by table."""

from __future__ import annotations

import re

from .parser import Document
from .tree import Node


def _quoted(text: str) -> tuple[str, str] | None:
    if text[:1] not in ("'", '"'):
        return None
    m = re.match(r"{0}((?:\\.|[^\\{0}])*){0}".format(text[0]), text, re.S)
    return (m[1], text[m.end() :]) if m else None


def parse_rule(line: str) -> tuple[re.Pattern, str] | None:
    """``"pattern" > "replacement"``; $1 and ${name} stand for groups, \\uXXXX for a character.
    Look-around and back-references are refused, as the rules know neither."""
    line = line.strip()
    if not line or line.startswith("#") or not (got := _quoted(line)):
        return None
    pattern, rest = got
    rest = rest.lstrip()
    if not rest.startswith(">") or not (got := _quoted(rest[1:].lstrip())):
        return None
    replacement = re.sub(r"\\u([0-9A-Fa-f]{4})", lambda m: chr(int(m[1], 16)), got[0])
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        return None
    try:
        return re.compile(pattern), replacement
    except re.error:
        return None


def _expand(m: re.Match, template: str) -> str:
    def group(k):
        key = k[1] or k[2]
        if k[0] == "$$":
            return "$"
        try:
            return m[int(key) if key.isdigit() else key] or ""
        except (IndexError, KeyError):
            return ""

    return re.sub(r"\$(?:\$|\{(\w+)\}|(\w+))", group, template)


class Replacements:
    """At each place the first rule that matches there, from left to right."""

    def __init__(self, rules: str):
        self.rules = [r for line in rules.splitlines() if (r := parse_rule(line))]

    def apply(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            for pattern, template in self.rules:
                m = pattern.match(text, i)
                if m and m.end() > i:
                    out.append(_expand(m, template))
                    i = m.end()
                    break
            else:
                out.append(text[i])
                i += 1
        return "".join(out)

    def apply_to(self, doc: Document) -> None:
        """Texts in vernacular paragraphs, styles and notes of a document, in place."""

        def visit(n: Node):
            if n.kind in ("para", "char", "note"):
                style = doc.sheet.get(n.marker)
                if style is None or not style.vernacular:
                    return
            if n.kind == "text":
                n.content = self.apply(n.content)
            for c in n.children:
                visit(c)

        for b in doc.blocks:
            visit(b)


class Transliterator:
    """Longest match of a table of spellings. An entry is a string, or a dict with any of
    default, initial, final and word for its place in a word."""

    def __init__(self, table: dict[str, str | dict[str, str]]):
        self.table, self.longest = table, max(map(len, table), default=0)

    def convert(self, text: str) -> str:
        out, i = [], 0
        while i < len(text):
            for n in range(min(self.longest, len(text) - i), 0, -1):
                entry = self.table.get(text[i : i + n])
                if entry is None:
                    continue
                if isinstance(entry, dict):
                    first = i == 0 or not text[i - 1].isalpha()
                    last = i + n == len(text) or not text[i + n].isalpha()
                    keys = ("word", "initial", "final") if first and last else ("initial",) if first else ("final",) if last else ()
                    entry = next((entry[k] for k in (*keys, "default") if k in entry), None)
                    if entry is None:
                        continue
                out.append(entry)
                i += n
                break
            else:
                out.append(text[i])
                i += 1
        return "".join(out)
