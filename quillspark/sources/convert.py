"""Other ways in: USFX books, old unclosed milestones, and synthetic word markup."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET

from pyspark.sql import Column
from pyspark.sql import functions as F

_PARAGRAPHS = frozenset("ili ip is li m mi ms mt mte nb p pc pi sp".split())
_STYLES = frozenset("add bk it k qs vp wj".split())
_RUNS = frozenset("fr ft fq fqa fl xo xt".split())


class UnsupportedElement(ValueError):
    """A USFX element that has no markup here; nothing is dropped without a word."""


class _Out:
    """A line of markup in the making: white space single, none before a closing marker."""

    def __init__(self, start: str = ""):
        self.value = start

    def text(self, raw: str | None) -> None:
        piece = re.sub(r"[ \t\r\n]+", " ", raw or "")
        self.value += piece.lstrip(" ") if not self.value or self.value[-1] == " " else piece

    def open(self, marker: str) -> None:
        self.value += f"\\{marker} "

    def close(self, marker: str) -> None:
        self.value = self.value.rstrip(" ") + f"\\{marker}*"

    def mark(self, marker: str, argument: str | None = None) -> None:
        self.value = self.value.rstrip(" ")
        self.value += (" " if self.value else "") + f"\\{marker}" + (f" {argument} " if argument is not None else "")


def _need(e: ET.Element, attribute: str) -> str:
    value = e.get(attribute)
    if value is None:
        raise UnsupportedElement(f"<{e.tag}> without {attribute}")
    return value


def _flat(e: ET.Element, put) -> None:
    put(e.text)
    for c in e:
        if c.tag != "ref":
            raise UnsupportedElement(f"<{c.tag}> in <{e.tag}>")
        _flat(c, put)
        put(c.tail)


def _note(out: _Out, e: ET.Element, usual: str) -> None:
    caller, lead = _need(e, "caller").strip(), e.text or ""
    if not caller:
        rest = lead.lstrip()
        if rest[:1] not in ("+", "-") or not rest:
            raise UnsupportedElement(f"<{e.tag}> with an empty caller")
        caller, lead = rest[0], rest[1:]
    out.open(f"{e.tag} {caller}")
    run = False

    def put(raw):
        nonlocal run
        if raw and raw.strip() and not run:
            out.open(usual)
            run = True
        if raw and run:
            out.text(raw)

    put(lead)
    for c in e:
        if c.tag == "ref":
            _flat(c, put)
        elif c.tag in _RUNS:
            out.open(c.tag)
            _flat(c, out.text)
            run = False
        else:
            raise UnsupportedElement(f"<{c.tag}> in <{e.tag}>")
        put(c.tail)
    out.close(e.tag)


def _inline(out: _Out, e: ET.Element) -> None:
    out.text(e.text)
    for c in e:
        if c.tag == "v":
            out.mark("v", _need(c, "id"))
        elif c.tag in ("f", "x"):
            _note(out, c, "ft" if c.tag == "f" else "xt")
        elif c.tag in _STYLES:
            out.open(c.tag)
            _inline(out, c)
            out.close(c.tag)
        elif c.tag == "ref":
            _inline(out, c)
        elif c.tag != "ve":
            raise UnsupportedElement(f"<{c.tag}> in <{e.tag}>")
        out.text(c.tail)


def usfx_book(book: ET.Element) -> str:
    """Markup of one <book>; raises on what it has no rule for."""
    lines = []
    for e in book:
        out = _Out()
        if e.tag == "id":
            out.mark("id", e.get("id") or _need(book, "id"))
            out.text(e.text)
        elif e.tag == "ide":
            out.mark("ide", _need(e, "charset"))
        elif e.tag in ("c", "cp"):
            out.mark(e.tag, _need(e, "id"))
        elif e.tag in ("h", "cl", "toc"):
            number = _need(e, "level") if e.tag == "toc" else ""
            if number == "4":
                continue
            if number not in ("", "1", "2", "3"):
                raise UnsupportedElement(f"<toc level={number}>")
            out.mark(e.tag + number)
            out.text(" ")
            out.text(e.text)
        elif e.tag == "b":
            out.mark("b")
        elif e.tag in ("d", "p", "q"):
            base = e.tag if e.tag != "p" else e.get("sfm") or "p"
            level = e.get("level") or ""
            if e.tag == "p" and base not in _PARAGRAPHS or level and not level.isdigit():
                raise UnsupportedElement(f"<{e.tag} sfm={base} level={level}>")
            out.mark(base + (level if e.tag != "d" else ""))
            out.text(" ")
            _inline(out, e)
        else:
            raise UnsupportedElement(f"<{e.tag}> in <book>")
        lines.append(out.value.rstrip(" ") + "\n")
    return "".join(lines)


def usfx_books(xml: str) -> dict[str, str]:
    return {_need(b, "id"): usfx_book(b) for b in ET.fromstring(xml).iter("book")}


def close_milestones(text: Column) -> Column:
    """\\* after alignment milestones that end with their line, as old tools wrote them."""
    return F.regexp_replace(text, r"(?m)(\\(?:zaln|k)-s \|[^\\\n]*)$", r"$1\\*")


def with_lemmas(text: Column, seed: int = 0) -> Column:
    """Words of a plain text as \\w with a lemma and a number that follow from the word."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    number = lambda w: F.format_string("H%04d", F.pmod(F.xxhash64(F.lower(w), F.lit(seed)), F.lit(8674)) + 1)
    return F.array_join(F.transform(words, lambda w: F.concat(F.lit("\\w "), w, F.lit('|lemma="'), F.lower(w), F.lit('" strong="'), number(w), F.lit('"\\w*'))), " ")
