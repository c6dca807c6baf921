"""A recovering parser for one document of backslash markup.

Tokens are read where the parser stands, so going back is standing elsewhere, and a run of text
is one match however many words it has. Blocks are read by one loop, inline content by another
that works on the container being filled; what ends a container is returned as a closer for its
owner to deal with. Nothing raises on any input: what can't be read leaves a diagnostic.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np

from .books import numbers, parse_numbers, show_numbers, well_formed
from .codes import CODES
from .style import Sheet, Style, default_sheet
from .tree import MAX_DEPTH, SYNTHETIC, WS, Node, collapse, text

(MARKER, MEND, ESCAPE, SLASH, WORD, SPACE, STAR, BREAK, PIPE, EQUAL, QUOTE, EOF) = range(12)
_TEXT = frozenset((WORD, SPACE, STAR, EQUAL, QUOTE))
_SPACES = re.compile("[ \\t\\n\\f\\r]+").match
_WORD = re.compile(r"""[^ \t\n\f\r\\*|="](?:(?!//)[^ \t\n\f\r\\*|="])*""").match
_MARKER = re.compile(r"\\(\+?)([A-Za-z0-9_-]+)(\*?)").match
_SINGLE = {"|": PIPE, "=": EQUAL, '"': QUOTE, "*": STAR}
_CELL = re.compile(r"t([ch])([cr]?)(\d*)(?:-(\d*))?(?:-(\d*))?$")


_TEXT_RUN = re.compile(r"(?:[^\\|/]+|/(?!/))+").match
#: A verse marker, its number and what parts it from text: the usual case, in one match.
_VERSE = re.compile(r"""\\v[ \t\n\f\r]+([1-9][^ \t\n\f\r\\*|="/]*)(?:[ \t\n\f\r]+(?![ \t\n\f\r]|\\v[ap])|\Z)""").match
_CHAPTER = re.compile(r"\+?[0-9]{1,18}").fullmatch
_BACKSLASH = re.compile(r"""\\(?:(\+?)([A-Za-z0-9_-]+)(\*?)|[\\|"]|\*|\+?)""")


def token(source: str, at: int) -> tuple:
    """(kind, start, end, name, plus, closing) of the token at an offset."""
    c = source[at : at + 1]
    if c == "\\":
        if m := _MARKER(source, at):
            plus, name, close = m.groups()
            return MARKER, at, m.end(), name, bool(plus), bool(close)
        after = source[at + 1 : at + 2]
        if after == "*":
            return MEND, at, at + 2, None, False, False
        if after and after in '\\|"':
            return ESCAPE, at, at + 2, None, False, False
        return SLASH, at, at + 1 + (after == "+"), None, False, False
    if not c:
        return EOF, at, at, None, False, False
    if c in WS:
        return SPACE, at, _SPACES(source, at).end(), None, False, False
    if c in _SINGLE:
        return _SINGLE[c], at, at + 1, None, False, False
    if c == "/" and source.startswith("//", at):
        return BREAK, at, at + 2, None, False, False
    return WORD, at, _WORD(source, at).end(), None, False, False


def tokens(source: str) -> list[tuple]:
    """All tokens; they tile the source, and the last is EOF."""
    out = [token(source, 0)]
    while out[-1][0] != EOF:
        out.append(token(source, out[-1][2]))
    return out


def cell_info(marker: str) -> tuple[bool, str, int, int] | None:
    """(header, alignment, column, columns) of a cell marker such as tc1, thr2 or tcc3-4."""
    m = _CELL.match(marker)
    if not m or not (m[2] or m[3]) or m[5] is not None and not m[4]:
        return None
    numbers = [x for x in (m[3], m[4]) if x is not None]
    if any(not x or int(x) > 255 for x in numbers) or m[5]:
        return None
    a, b = int(numbers[0]), int(numbers[-1])
    return m[1] == "h", {"c": "center", "r": "end"}.get(m[2], "start"), a, b - a + 1 if len(numbers) > 1 and b >= a else 1


def leading_zero(word: str) -> bool:
    return len(word) > 1 and word[0] == "0" and word[1] in "0123456789"


@dataclass
class Diagnostic:
    code: str
    start: int
    end: int
    message: str

    @property
    def severity(self) -> str:
        return CODES[self.code][0]


@dataclass
class Verse:
    number: tuple
    here: bool = True  # it started in the block being read
    shown: str | None = None


class Parser:
    def __init__(self, source: str, sheet: Sheet | None = None, ends: bool = True):
        self.src = source
        self.t = token(source, 0)
        self.before = 0  # end of the token before
        self.sheet = Sheet(dict((sheet or default_sheet()).styles))
        self.ends = ends
        self.found: list[Diagnostic] = []
        self.open: list[tuple[str, bool]] = []
        self.too_deep: list[str] = []  # markers that opened nothing
        self.notes = 0
        self.cell = self.title = self.line = False
        self.text_type = "other"
        self.verse: Verse | None = None
        self.chapter: str | None = None
        self.waiting: list[tuple[Verse, int]] = []
        self.suspended = 0
        v = self.sheet.styles.get("v")
        self.verses = v is not None and v.kind == "character"

    # -- tokens ---------------------------------------------------------

    @property
    def kind(self) -> int:
        return self.t[0]

    @property
    def span(self) -> tuple[int, int]:
        return self.t[1:3]

    @property
    def name(self) -> str:
        return self.t[3]

    def here(self) -> str:
        return self.src[self.t[1] : self.t[2]]

    def bump(self) -> tuple[int, int]:
        t = self.t
        if t[0] != EOF:
            self.before = t[2]
            self.t = token(self.src, t[2])
        return t[1], t[2]

    def place(self) -> tuple:
        return self.t, self.before

    def back(self, place: tuple) -> None:
        self.t, self.before = place

    def space(self) -> None:
        t = self.t
        if t[0] == SPACE:
            self.before = t[2]
            self.t = token(self.src, t[2])

    def word(self) -> str | None:
        if self.t[0] != WORD:
            return None
        w = self.here()
        self.bump()
        return w

    def newline(self) -> bool:
        return self.t[0] == SPACE and any(c in "\n\r" for c in self.here())

    def at(self, name: str, closing: bool = False) -> bool:
        t = self.t
        return t[0] == MARKER and t[3] == name and t[5] == closing

    def say(self, code: str, span: tuple[int, int], message: str) -> None:
        self.found.append(Diagnostic(code, span[0], span[1], message))

    def style(self, name: str) -> Style | None:
        return self.sheet.styles.get(name)

    def unknown(self, name: str, closing: bool, span) -> None:
        star = "*" if closing else ""
        custom = name.startswith("z")
        self.say("unknown-custom-marker" if custom else "unknown-marker", span, f"\\{name}{star} is not in the style sheet" + (" and was left out" if custom else ""))

    def is_open(self, name: str) -> bool:
        for style, note in reversed(self.open):
            if style == name:
                return True
            if note:
                return False
        return False

    # -- blocks ---------------------------------------------------------

    def parse(self) -> tuple[list[Node], list[Diagnostic]]:
        blocks: list[Node] = []
        self.blocks(blocks, None, None, lambda _: False)
        self.end_before_block(blocks)
        self.end_chapter(blocks)
        self.found.sort(key=lambda d: d.start)
        return blocks, self.found

    def blocks(self, out, pending, head, stop):
        """Read blocks into ``out`` until ``stop`` accepts a marker, which is returned (name,
        span) already consumed. ``head`` names the line that opens the list, if one does."""
        while True:
            if pending is None:
                what, value, span = self.block_start()
                if what == "eof":
                    return None
                if what == "milestone":
                    self.place_milestone(out, value, head)
                    continue
                if what == "implicit":
                    if not self.style("p"):
                        self.say("content-dropped", span, "content outside a paragraph was dropped: there is no \\p")
                        self.skip_to_paragraph()
                        continue
                    self.say("content-outside-paragraph", span, "content outside a paragraph; \\p was supplied")
                    value = "p"
                pending = (value, span)
            marker, span = pending
            pending = None
            if stop(marker):
                return marker, span
            if marker == "id":
                self.book(out, span)
            elif marker == "c":
                self.chapter_start(out, span)
            elif marker == "tr":
                pending = self.table(out, span)
            elif marker == "esb":
                pending = self.sidebar(out, span)
            elif marker == "periph":
                pending = self.periph(out, span, stop)
            elif marker == "usfm":
                self.version(out, span)
            else:
                if marker == "esbe":
                    self.say("unmatched-sidebar-end", span, "\\esbe without an open \\esb")
                pending = self.paragraph(out, marker, span)

    def block_start(self):
        while True:
            self.space()
            kind = self.kind
            if kind == EOF:
                return "eof", None, self.span
            if kind == MARKER:
                name, closing = self.name, self.t[5]
                style = self.style(name)
                if closing:
                    span = self.bump()
                    if style is None:
                        self.unknown(name, True, span)
                    elif style.kind == "paragraph":
                        self.say("paragraph-marker-closed", span, f"\\{name} is a paragraph marker; \\{name}* closes nothing")
                    else:
                        self.say("unmatched-closing-marker", span, f"\\{name}* has no \\{name} to close")
                elif style is None:
                    span = self.bump()
                    found = self.unknown_milestone(name, span)
                    if found is not None:
                        return "milestone", found, span
                    self.unknown(name, False, span)
                elif style.kind == "paragraph":
                    span = self.bump()
                    self.space()
                    return "marker", name, span
                elif style.kind == "milestone":
                    span = self.bump()
                    return "milestone", self.milestone(name, span), span
                else:
                    return "implicit", None, self.span
            elif kind == MEND:
                self.say("unmatched-milestone-end", self.bump(), "\\* without a milestone")
            else:
                return "implicit", None, self.span

    def skip_to_paragraph(self) -> None:
        while self.kind != EOF:
            t = self.t
            if t[0] == MARKER and not t[5] and (s := self.style(t[3])) and s.kind == "paragraph":
                return
            self.bump()

    def place_milestone(self, out, node: Node, head) -> None:
        last = out[-1] if out else None
        if last is not None and last.kind == "para" and last.marker != "usfm":
            last.end = node.end
            last.add(node)
            return
        line = {"table": "tr", "sidebar": "esbe", "periph": "periph"}.get(last.kind) if last is not None else head
        if line is None:
            out.append(node)
            return
        para = Node("para", "p", node.start, node.end)
        para.add(node)
        self.after_marker(out, para, line)

    def after_marker(self, out, para: Node, name: str) -> None:
        """Content on a line that holds none of its own goes to a paragraph after it."""
        if not self.style("p"):
            self.say("content-dropped", (para.start, para.end), f"content after \\{name} was dropped: there is no \\p")
            return
        self.say("content-outside-paragraph", (para.start, para.end), f"content after \\{name} is outside a paragraph; \\p was supplied")
        para.marker = "p"
        out.append(para)

    def sidebar(self, out, span):
        side = Node("sidebar", "esb", *span)
        self.suspended += 1
        head: list[Node] = []
        pending = self.paragraph(head, "esb", span)
        if head and head[-1].kind == "para":
            para = head.pop()
            side.data["category"] = self.category(para.children)
            if para.children:
                self.after_marker(side.children, para, "esb")
        pending = self.blocks(side.children, pending, "esb", lambda m: m in ("esbe", "esb", "c"))
        self.suspended -= 1
        if pending and pending[0] == "esbe":
            side.end = pending[1][1]
            out.append(side)
            pending = self.paragraph(out, "esbe", pending[1], "p" if self.style("p") else "esbe")
            if out[-1].kind == "para" and out[-1].marker == "esbe":
                para = out.pop()
                if para.children:
                    self.after_marker(out, para, "esbe")
            return pending
        self.say("sidebar-not-closed", span, "\\esb has no \\esbe" + (f" before \\{pending[0]}" if pending else ""))
        side.end = pending[1][0] if pending else self.before
        out.append(side)
        return pending

    def periph(self, out, span, outer):
        self.space()
        head = Node("char", "periph", *span)
        if self.tracking():
            self.end_before_block(out)
            self.end_chapter(out)
        self.title = True
        closer = self.inline(head)
        self.title = False
        runs = [n for n in head.children if n.kind == "text"]
        rest = [n for n in head.children if n.kind != "text"]
        real = [n for n in runs if (n.start, n.end) != SYNTHETIC]
        node = Node("periph", "periph", *span)
        title = collapse("".join(n.content for n in runs).strip(WS))
        if title:
            node.data["title"] = title
            node.data["title_span"] = (real[0].start, real[-1].end) if real else (span[1], span[1])
        node.attributes, node.pipe = head.attributes, head.pipe
        if rest:
            read = [n for n in rest if (n.start, n.end) != SYNTHETIC]
            para = Node("para", "p", *((read[0].start, read[-1].end) if read else span))
            for n in rest:
                para.add(n)
            self.after_marker(node.children, para, "periph")
        pending = self.block_closer(closer)
        after = None
        while True:
            pending = self.blocks(node.children, pending, "periph", lambda m: m in ("periph", "id") or outer(m))
            if pending is None or pending[0] != "id":
                break
            books: list[Node] = []
            at = pending[1]
            self.book(books, at)
            pending = None
            if books:
                after = books[0]
                break
        if self.tracking():
            self.end_before_block(node.children)
            self.end_chapter(node.children)
        node.end = at[0] if after is not None else pending[1][0] if pending else self.before
        out.append(node)
        if after is not None:
            out.append(after)
        return pending

    def category(self, children) -> str | None:
        """Take a leading \\cat out of a list of children."""
        if not (children and children[0].kind == "char" and children[0].marker == "cat"):
            return None
        cat = children.pop(0)
        if children and children[0].kind == "text":
            children[0].content = children[0].content.lstrip(WS)
            if not children[0].content:
                children.pop(0)
        return collapse("".join(n.content for n in cat.children if n.kind == "text"))

    def book(self, out, span) -> None:
        at = self.span
        code = self.word()
        if code is None:
            self.say("missing-book-code", span, "\\id needs a book code")
            return
        end = self.before
        self.space()
        description = ""
        if self.kind in _TEXT:
            run = self.text_run()
            end = run.start + len(self.src[run.start : run.end].rstrip(WS))
            description = run.content.rstrip(WS)
        if well_formed(code):
            out.append(Node("book", "id", span[0], end, data={"code": code, "description": description}))
        else:
            self.say("unknown-book-code", at, f"{code} is not a book code")

    def version(self, out, span) -> None:
        self.start_block()
        para = Node("para", "usfm", *span)
        self.space()
        if self.kind in _TEXT:
            run = self.text_run()
            run.content = run.content.rstrip(WS)
            if run.content:
                para.add(run)
        para.end = self.span[0]
        self.end_waiting(out)
        out.append(para)

    def number_after(self, name: str, code: str, unclosed: str) -> str | None:
        """The number list of \\ca or \\va, whose marker is the current token."""
        at = self.bump()
        self.space()
        where = self.span
        w = self.word()
        got = parse_numbers(w) if w is not None else None
        if got is None:
            self.say(code, where if w is not None else at, f"\\{name} needs a number")
        self.space()
        if self.at(name, closing=True):
            self.bump()
        else:
            self.say(unclosed, at, f"\\{name} has no \\{name}*")
        return show_numbers(got) if got else None

    def chapter_start(self, out, span) -> None:
        at = self.span
        w = self.word()
        if w is None:
            self.say("missing-chapter-number", span, "\\c needs a chapter number")
            return
        if not _CHAPTER(w):
            self.say("malformed-chapter-number", at, f"{w} is not a chapter number")
            return
        if leading_zero(w):
            self.say("number-has-leading-zero", at, f"chapter number {w} starts with zero")
        number = str(int(w))
        node = Node("chapter_start", "c", span[0], self.before, data={"number": number})
        self.space()
        while True:
            if self.at("ca"):
                if (alt := self.number_after("ca", "malformed-chapter-number", "alternate-chapter-not-closed")) is not None:
                    node.data["alt_number"] = alt
            elif self.at("cp"):
                self.bump()
                self.space()
                node.data["pub_number"] = self.word()
            else:
                break
            node.end = self.before
            self.space()
        if self.tracking():
            self.end_before_block(out)
            self.end_chapter(out)
            self.chapter = number
        out.append(node)

    def paragraph(self, out, marker, span, text_type_of=None):
        self.text_type = self.style(text_type_of or marker).text
        self.start_block()
        para = Node("para", marker, *span)
        closer = self.inline(para)
        para.end = self.closed_at(closer)
        self.end_waiting(out)
        if marker == "cp" and out and out[-1].kind == "chapter_start":
            self.fold_cp(out, para)
        else:
            out.append(para)
        return self.block_closer(closer)

    def fold_cp(self, out, para: Node) -> None:
        chapter, number = out[-1], None
        first = para.children[0] if para.children else None
        if first is not None and first.kind == "text":
            w = re.match(r"[^ \t\n\f\r]*", first.content)[0]
            if w and not re.search(r'[\\*|="]', w):
                number = w
                first.content = first.content[len(w) :].lstrip(WS)
                if not first.content:
                    para.children.pop(0)
        chapter.data["pub_number"] = number
        chapter.end = para.end
        if para.children:
            self.after_marker(out, para, "cp")

    def closed_at(self, closer) -> int:
        return closer[2][0] if closer[0] in ("para", "open", "cell") else self.before

    def block_closer(self, closer):
        if closer[0] == "para":
            return closer[1], closer[2]
        if closer[0] != "eof":
            self.say("internal", self.span, "a block was ended by an inline closer")
        return None

    def table(self, out, span):
        self.start_block()
        rows: list[Node] = []
        early = None
        while True:
            row, closer, before = self.row(span)
            if before is not None:
                if rows and rows[-1].children:
                    rows[-1].children[-1].children.append(self.verse_end(before))
                else:
                    early = before
            rows.append(row)
            if closer[0] != "para" or closer[1] != "tr":
                break
            span = closer[2]
        if early is not None:
            self.end_in_last(out, early)
        if out and out[-1].kind == "table":
            out[-1].end = rows[-1].end
            out[-1].children.extend(rows)
        else:
            out.append(Node("table", None, rows[0].start, rows[-1].end, children=rows))
        return self.block_closer(closer)

    def row(self, span):
        row = Node("row", "tr", *span)
        before, at = None, self.span
        info = cell_info(self.name) if self.kind == MARKER and not self.t[5] else None
        if info:
            self.bump()
            self.space()
        else:
            self.say("expected-table-cell", at, "\\tr without a cell; \\tc1 was supplied")
            info = (False, "start", 1, 1)
        while True:
            cell = Node("cell", None, at[0], data=dict(zip(("header", "alignment", "col", "colspan"), info)))
            self.cell = True
            closer = self.inline(cell)
            self.cell = False
            cell.end = self.closed_at(closer)
            if (verse := self.take_waiting(0)) is not None:
                if row.children:
                    row.children[-1].children.append(self.verse_end(verse))
                else:
                    before = verse
            row.children.append(cell)
            if closer[0] != "cell":
                row.end = self.closed_at(closer)
                return row, closer, before
            info, at = closer[1], closer[2]

    # -- where verses and chapters end ----------------------------------

    def tracking(self) -> bool:
        return self.ends and not self.suspended

    def start_block(self) -> None:
        if self.verse:
            self.verse.here = False

    @staticmethod
    def verse_end(verse: Verse) -> Node:
        shown = verse.shown if verse.shown is not None else show_numbers(verse.number)
        return Node("verse_end", data={"number": shown, "ranges": verse.number})

    def end_chapter(self, out) -> None:
        if self.chapter is not None:
            out.append(Node("chapter_end", data={"number": self.chapter}))
            self.chapter = None

    def begin_verse(self, ctx: Node, number, shown: str | None = None) -> None:
        if not self.tracking():
            return
        if self.verse:
            self.place_end(ctx, self.verse)
        self.verse = Verse(number, True, shown)

    def place_end(self, ctx: Node, verse: Verse) -> None:
        elsewhere = ctx.kind == "para" and self.text_type != "versetext" and not verse.here
        if elsewhere or not ctx.children:
            self.waiting.append((verse, len(self.open)))
            return
        last, blank = ctx.children[-1], False
        if last.kind == "text" and last.content[-1:] and last.content[-1] in WS:
            blank = True
            last.content = last.content.rstrip(WS)
            if not last.content:
                ctx.children.pop()
        ctx.children.append(self.verse_end(verse))
        if blank:
            ctx.children.append(text(" "))

    def take_waiting(self, depth: int) -> Verse | None:
        if self.waiting and self.waiting[-1][1] == depth:
            return self.waiting.pop()[0]
        return None

    def end_waiting(self, out) -> None:
        if (verse := self.take_waiting(0)) is not None:
            self.end_in_last(out, verse)

    def end_before_block(self, out) -> None:
        if not self.tracking():
            return
        for verse, _ in self.waiting:
            self.end_in_last(out, verse)
        self.waiting = []
        if self.verse:
            self.end_in_last(out, self.verse)
            self.verse = None

    def end_in_last(self, out, verse: Verse) -> None:
        """The last block that can hold the end of a verse gets it."""

        def starts(children):
            return any(n.kind == "verse_start" or n.kind == "char" and starts(n.children) for n in children)

        for block in reversed(out):
            if block.kind == "para" and block.children and (starts(block.children) or self.style(block.marker).text == "versetext"):
                block.children.append(self.verse_end(verse))
                return
            if block.kind == "table" and block.children and block.children[-1].children:
                block.children[-1].children[-1].children.append(self.verse_end(verse))
                return

    # -- inline ---------------------------------------------------------

    def inline(self, ctx: Node):
        """Fill ``ctx`` until something ends it; that is returned."""
        while True:
            kind = self.t[0]
            if kind in _TEXT:
                ctx.add(self.text_run())
            elif kind == MARKER:
                if self.t[3] == "v" and self.plain_verses(ctx):
                    continue
                closer = self.marker(ctx)
                if closer is not None:
                    if closer[0] in ("para", "cell", "eof"):
                        ctx.trim_end()
                    return closer
            elif kind == EOF:
                ctx.trim_end()
                return ("eof",)
            elif kind == ESCAPE:
                literal = self.here()[1:]
                ctx.add(text(literal, *self.bump()))
            elif kind == SLASH:
                raw = self.here()
                span = self.bump()
                self.say("stray-backslash", span, "a backslash that starts no marker is text")
                ctx.add(text(raw, *span))
            elif kind == MEND:
                self.say("unmatched-milestone-end", self.bump(), "\\* without a milestone")
            elif kind == BREAK:
                span = self.bump()
                ctx.add(Node("opt_break", None, *span))
            else:
                self.pipe(ctx)

    def pipe(self, ctx: Node) -> None:
        span = self.bump()
        if ctx.kind != "char" or ctx.attributes is not None:
            self.say("unexpected-pipe", span, "| is text " + ("after an attribute list" if ctx.kind == "char" else "outside a character style"))
            ctx.add(text("|", *span))
        elif not (ctx.marker == "fig" and self.old_figure(ctx, span)):
            ctx.attributes, ctx.pipe = self.attribute_list(), span[0]

    def marker(self, ctx: Node):
        _, _, _, name, plus, closing = self.t
        span = self.bump()
        if not closing:
            self.space()
            if self.cell and (info := cell_info(name)):
                return "cell", info, span
        style = self.style(name)
        if style is None:
            if not closing and (node := self.unknown_milestone(name, span)) is not None:
                ctx.add(node)
            else:
                self.unknown(name, closing, span)
            return None
        if closing and self.too_deep and self.too_deep[-1] == name:
            self.too_deep.pop()
            return None
        if not closing and len(self.open) >= MAX_DEPTH and style.kind in ("note", "character") and name != "v":
            if not self.too_deep:
                self.say("internal", span, f"\\{name} is nested more than {MAX_DEPTH} deep; its content is read in its place")
            self.too_deep.append(name)
            return None
        if closing:
            if style.kind == "paragraph":
                self.say("paragraph-marker-closed", span, f"\\{name} is a paragraph marker; \\{name}* closes nothing")
            elif style.kind != "milestone" and self.is_open(name):
                return "close", name
            else:
                self.say("unmatched-closing-marker", span, f"\\{name}* has no \\{name} to close")
            return None
        if style.kind == "paragraph":
            self.too_deep.clear()
            return "para", name, span
        if style.kind == "note":
            return self.note(ctx, name, span)
        if style.kind == "milestone":
            ctx.add(self.milestone(name, span))
            return None
        return self.verse_start(ctx, span) if name == "v" else self.char(ctx, name, span, plus)

    def plain_verses(self, ctx: Node) -> bool:
        """Read verses with a plain number, and their text, as long as one follows the other;
        what ``verse_start`` would have something to say about is left to it."""
        at, src, read = self.t[1], self.src, False
        if not self.verses or self.notes:
            return False
        while m := _VERSE(src, at):
            got = numbers(m[1])
            if got is None:
                break
            number, shown = got
            self.begin_verse(ctx, number, shown)
            children = ctx.children
            children.append(Node("verse_start", "v", at, m.end(1), None, None, {"number": shown, "ranges": number}))
            at, read = m.end(), True
            if run := _TEXT_RUN(src, at):
                start, at = at, run.end()
                children.append(text(collapse(run[0]).replace("~", "\u00a0"), start, at))
        if read:
            self.before = at
            self.t = token(src, at)
        return read

    def verse_start(self, ctx: Node, span):
        if self.notes:
            self.say("verse-in-note", span, "\\v can't stand in a note")
            self.word()
            self.space()
            return None
        at = self.span
        w = self.word()
        if w is None:
            self.say("missing-verse-number", span, "\\v needs a verse number")
            return None
        number = parse_numbers(w)
        if number is None:
            self.say("malformed-verse-number", at, f"{w} is not a verse number")
            self.space()
            return None
        if leading_zero(w):
            self.say("number-has-leading-zero", at, f"verse number {w} starts with zero")
        self.begin_verse(ctx, number)
        node = Node("verse_start", "v", span[0], self.before, data={"number": show_numbers(number), "ranges": number})
        formatted = None
        self.space()
        while True:
            if self.at("va"):
                if (alt := self.number_after("va", "malformed-verse-number", "alternate-verse-not-closed")) is not None:
                    node.data["alt_number"] = alt
                node.end = self.before
                self.space()
            elif self.at("vp") and self.style("vp"):
                at = self.bump()
                self.space()
                inner = Node("char", "vp", *at)
                self.open.append(("vp", False))
                closer = self.inline(inner)
                self.open.pop()
                inner.end = self.closed_at(closer)
                closed = closer == ("close", "vp")
                if not closed:
                    self.say("alternate-verse-not-closed", at, "\\vp has no \\vp*")
                if all(n.kind == "text" for n in inner.children):
                    if value := "".join(n.content for n in inner.children).rstrip(WS):
                        node.data["pub_number"] = value
                    node.end = inner.end
                else:
                    formatted = inner
                if not closed:
                    ctx.add(node)
                    if formatted is not None:
                        self.add_char(ctx, formatted)
                    return self.char(ctx, closer[1], closer[2], False) if closer[0] == "open" else closer
                self.space()
            else:
                break
        ctx.add(node)
        if formatted is not None:
            self.add_char(ctx, formatted)
        return None

    def char(self, ctx: Node, name: str, span, plus: bool):
        if plus and ctx.kind != "char":
            self.say("nested-marker-not-nested", span, f"\\+{name} is not inside a character style")
        if not plus and name not in ("ref", "fig") and ctx.kind == "char":
            if self.style(name).nest and ctx.marker != "xo" and self.closed_ahead(name):
                self.say("character-style-nested-without-plus", span, f"\\{name} is nested; read as \\+{name}")
            else:
                return "open", name, span
        while True:
            closer = self.char_body(ctx, name, span)
            if closer == ("close", name):
                return None
            if closer[0] != "open" or ctx.kind == "char":
                return closer
            name, span = closer[1], closer[2]

    def closed_ahead(self, name: str) -> bool:
        """Does \\name* come, before anything that would end this container?"""
        opened = {s for s, _ in self.open}
        plussed = 0
        for m in _BACKSLASH.finditer(self.src, self.t[2]):
            plus, cur, closing = m.groups()
            if cur is None:
                continue
            if closing:
                if cur in opened:
                    return False
                if cur == name:
                    if not plussed:
                        return True
                    plussed -= 1
            elif plus:
                plussed += cur == name
            elif cur == name or self.cell and cell_info(cur) or (s := self.style(cur)) and s.kind == "paragraph":
                return False
        return False

    def char_body(self, ctx: Node, name: str, span):
        inner = Node("char", name, *span)
        self.open.append((name, False))
        closer = self.inline(inner)
        self.open.pop()
        inner.end = self.closed_at(closer)
        self.add_char(ctx, inner)
        unclosed = "figure-not-closed" if name == "fig" else "character-style-not-closed"
        kind = closer[0]
        if kind == "close":
            if closer[1] != name and self.style(closer[1]).kind != "note":
                self.say(unclosed, span, f"\\{name} was closed by \\{closer[1]}*")
        elif kind == "open":
            if not self.notes:
                self.say("character-style-implicitly-closed", span, f"\\{name} ended where \\{closer[1]} opened")
        else:
            where = {"para": lambda: f"\\{closer[1]}", "cell": lambda: "the next cell", "eof": lambda: "the end"}[kind]()
            self.say(unclosed, span, f"\\{name} was still open at {where}")
        return closer

    def add_char(self, ctx: Node, node: Node) -> None:
        if (verse := self.take_waiting(len(self.open) + 1)) is not None:
            self.place_end(ctx, verse)
        last = ctx.children[-1] if ctx.children else None
        if node.marker not in ("va", "vp") or last is None or last.kind != "verse_start":
            ctx.add(node)
            return
        if node.marker == "vp":
            if not all(n.kind == "text" for n in node.children):
                ctx.add(node)
            elif value := "".join(n.content for n in node.children).rstrip(WS):
                last.data["pub_number"] = value
            return
        children = node.children
        got = None
        if children and children[0].kind == "text":
            w = re.match(r"[^ \t\n\f\r]*", children[0].content)[0]
            got = parse_numbers(w)
            children[0].content = children[0].content[len(w) :].lstrip(WS)
            if not children[0].content:
                children.pop(0)
        if got is None:
            self.say("malformed-verse-number", (node.start, node.end), "\\va needs a number")
        else:
            last.data["alt_number"] = show_numbers(got)
        for n in children:
            ctx.add(n)

    def note(self, ctx: Node, name: str, span):
        caller = None
        if self.kind == STAR:
            a, b = self.bump()
            if self.kind == WORD:
                b = self.bump()[1]
            caller = self.src[a:b]
        else:
            caller = self.word()
        if caller is None:
            self.say("missing-note-caller", span, f"\\{name} needs a caller; + was supplied")
            caller = "+"
        self.space()
        node = Node("note", name, *span, data={"caller": caller})
        self.open.append((name, True))
        self.notes += 1
        closer = self.inline(node)
        self.notes -= 1
        self.open.pop()
        node.data["category"] = self.category(node.children)
        node.end = self.closed_at(closer)
        ctx.add(node)
        if closer == ("close", name):
            return None
        self.say("note-not-closed", span, f"\\{name} has no \\{name}*")
        return closer

    # -- milestones -----------------------------------------------------

    def milestone(self, name: str, span) -> Node:
        back, said = self.place(), len(self.found)
        self.space()
        node = Node("milestone", name, span[0])
        if self.kind == PIPE:
            node.pipe = self.bump()[0]
            node.attributes = self.attribute_list()
        self.space()
        if self.kind == MEND:
            self.bump()
        else:
            if node.attributes is not None:
                there, rest = self.place(), self.found[said:]
                self.back(back)
                del self.found[said:]
                if (line := self.line_milestone(name, span)) is not None:
                    return line
                self.back(there)
                self.found += rest
            self.say("milestone-not-closed", span, f"milestone \\{name} has no \\*")
        node.end = self.before
        return node

    def unknown_milestone(self, name: str, span) -> Node | None:
        """A milestone whose marker is new, which then joins this document's sheet."""
        back, said = self.place(), len(self.found)
        self.space()
        node = Node("milestone", name, span[0])
        if self.kind == PIPE:
            node.pipe = self.bump()[0]
            node.attributes = self.attribute_list()
        self.space()
        if self.kind == MEND:
            self.bump()
            node.end = self.before
        else:
            self.back(back)
            del self.found[said:]
            node = self.line_milestone(name, span)
        if node is not None:
            self.register(name, span)
        return node

    def line_milestone(self, name: str, span) -> Node | None:
        """A start milestone that runs to the end of its line."""
        if not name.endswith("-s"):
            return None
        back, said = self.place(), len(self.found)
        self.space()
        if self.kind == PIPE:
            node = Node("milestone", name, span[0])
            node.pipe = self.bump()[0]
            self.line = True
            node.attributes = self.attribute_list()
            self.line = False
            if self.kind == EOF or self.newline():
                self.say("milestone-not-closed", span, f"milestone \\{name} has no \\*; it ends with its line")
                node.end = self.before
                return node
        self.back(back)
        del self.found[said:]
        return None

    def register(self, name: str, span) -> None:
        if self.style(name):
            return
        base = re.sub(r"(?:-e)*$", "", re.sub(r"(?:-s)*$", "", name)) if name[-2:] in ("-s", "-e") else None
        known = self.style(base) if base else None
        if known is None:
            custom = name.startswith("z")
            self.say("unknown-custom-milestone" if custom else "unknown-milestone", span, f"milestone \\{name} is not in the style sheet")
        self.sheet.styles[name] = Style(name, "milestone", known.text if known else "other")

    # -- text and attributes --------------------------------------------

    def text_run(self) -> Node:
        """All text from here to a backslash, a pipe or //."""
        start = self.t[1]
        end = _TEXT_RUN(self.src, start).end()
        self.before = end
        self.t = token(self.src, end)
        return text(collapse(self.src[start:end]).replace("~", "\u00a0"), start, end)

    def old_figure(self, fig: Node, pipe) -> bool:
        """USFM 2's seven fields; True if they were there and became attributes."""
        if any(n.kind != "text" for n in fig.children):
            return False
        back = self.place()
        fields, start, escaped = [], pipe[1], False
        while True:
            kind = self.kind
            if kind in (PIPE, MARKER):
                if kind == MARKER and self.here() != "\\fig*":
                    break
                fields.append((start, self.span[0], escaped))
                if kind == MARKER or len(fields) == 6:
                    break
                start, escaped = self.bump()[1], False
            elif kind in (MEND, SLASH, BREAK, EOF):
                break
            else:
                escaped |= kind == ESCAPE
                self.bump()
        if len(fields) != 6 or self.kind != MARKER or self.here() != "\\fig*":
            self.back(back)
            return False
        value = lambda f: collapse(self.value(*f).strip(WS))
        pairs = [("alt", collapse("".join(n.content for n in fig.children).strip(WS)), fig.start, pipe[0])]
        pairs += [(k, value(fields[i]), *fields[i][:2]) for k, i in (("src", 0), ("size", 1), ("loc", 2), ("copy", 3), ("ref", 5))]
        pairs = [p for p in pairs if p[1]]
        caption = value(fields[4]).replace("~", "\u00a0")
        fig.children = [text(caption, *fields[4][:2])] if caption else []
        if pairs:
            fig.attributes, fig.pipe = pairs, pipe[0]
        self.say("usfm2-figure", (fig.start, self.span[1]), "\\fig has the fields of USFM 2; read as caption and attributes")
        return True

    def value(self, start: int, end: int, escaped: bool) -> str:
        raw = self.src[start:end]
        return re.sub(r'\\(?=[\\|"])', "", raw) if escaped else raw

    def named(self) -> bool:
        return self.t[0] == WORD and self.src.startswith("=", self.t[2])

    def attribute_list(self) -> list[tuple]:
        pairs, said = [], False
        bounded = self.title or self.line
        while True:
            if self.newline():
                if self.title:
                    self.bump()
                    break
                if self.line:
                    break
                if not said:
                    said = True
                    self.say("newline-in-attributes", self.span, "line break in an attribute list")
            self.space()
            if self.named():
                name, span = self.here(), self.bump()
                self.bump()
                pairs.append((name, self.attribute_value(), *span))
            elif self.kind in (WORD, QUOTE, BREAK):
                start = self.span[0]
                while self.kind in (SPACE, WORD, QUOTE, BREAK) and not (bounded and self.newline()) and not self.named():
                    self.bump()
                pairs.append(("", self.src[start : self.span[0]], start, self.span[0]))
            else:
                break
        if self.title and pairs and pairs[-1][0] == "":
            _, v, a, _ = pairs[-1]
            v = v.rstrip(WS)
            pairs[-1] = ("", v, a, a + len(v))
        return pairs

    def attribute_value(self) -> str:
        if self.kind != QUOTE:
            span = self.span
            w = self.word()
            if w is None:
                self.say("missing-attribute-value", (span[0], span[0]), "= without a value")
                return ""
            self.say("attribute-value-not-quoted", span, "an attribute value needs double quotes")
            return w
        quote = self.bump()
        start, escaped = self.span[0], False
        while True:
            kind = self.kind
            if kind == QUOTE:
                end = self.bump()[0]
                return self.value(start, end, escaped)
            if kind in (EOF, MARKER, MEND, SLASH):
                self.say("unterminated-attribute-value", quote, 'an attribute value has no closing "')
                return self.value(start, self.span[0], escaped)
            escaped |= kind == ESCAPE
            self.bump()


@dataclass
class Document:
    blocks: list[Node]
    diagnostics: list[Diagnostic]
    sheet: Sheet
    source: str


def parse(source: str, sheet: Sheet | None = None, ends: bool = True) -> Document:
    """Positions in the tree are characters; ``ByteOffsets`` makes bytes of them."""
    p = Parser(source, sheet, ends)
    blocks, found = p.parse()
    return Document(blocks, found, p.sheet, source)


class ByteOffsets:
    """Byte offset of a character offset of one text; ``many`` maps a list of them at once."""

    def __init__(self, source: str):
        self.table = None
        if not source.isascii():
            points = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), "<u4")
            self.table = np.zeros(len(points) + 1, np.int64)
            np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=self.table[1:])

    def __call__(self, i: int) -> int:
        return i if self.table is None else int(self.table[i])

    def many(self, offsets: list[int]) -> list[int]:
        return offsets if self.table is None or not offsets else self.table[offsets].tolist()
