"""Reading USX, version 2 or 3, into the same tree.

Expat gives byte positions, so spans point into the XML. Ends of verses and chapters are
taken where the file states them and supplied by the parser's rules where it doesn't.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from xml.parsers import expat

from .books import parse_numbers, show_numbers, well_formed
from .parser import Diagnostic, Document, Verse, cell_info, leading_zero
from .style import Sheet, Style, default_sheet
from .tree import MAX_DEPTH, WS, Node, collapse, text

_INLINE = frozenset("verse char note figure ref optbreak".split())
_BLOCK = frozenset("book chapter para table row cell sidebar periph".split())


class Element:
    __slots__ = ("name", "attributes", "children", "start", "end", "value")

    def __init__(self, name, attributes, start, end=0, value=None):
        self.name, self.attributes, self.start, self.end, self.value = name, attributes, start, end, value
        self.children: list[Element] = []

    def get(self, name):
        return self.attributes.get(name)


def read_xml(source: str | bytes, each: Callable[[Element, list[Element]], bool] | None = None) -> tuple[Element | None, tuple[int, str] | None]:
    """The root element with byte spans, or the offset and message of the first error. Text is
    an element without a name; neighbouring pieces are one, comments and instructions none.
    Elements nested too deep are left out and their text is their parent's; then the offset and
    message of the first one come with the root. An element for which ``each``, called with it
    and those that hold it, is true is taken out when it ends."""
    data = source if isinstance(source, bytes) else source.encode()
    p = expat.ParserCreate(encoding="utf-8")
    p.ordered_attributes = True
    p.buffer_text = False
    stack: list[Element] = []
    root: list[Element] = []
    below, first_deep = 0, None

    def start(name, attributes):
        nonlocal below, first_deep
        if len(stack) >= MAX_DEPTH:
            below += 1
            first_deep = first_deep or (p.CurrentByteIndex, f"<{name}> is nested more than {MAX_DEPTH} deep; its text is read in its place")
            return
        e = Element(name.rpartition(":")[2], dict(zip(attributes[::2], attributes[1::2])), p.CurrentByteIndex)
        (stack[-1].children if stack else root).append(e)
        stack.append(e)

    def end(_):
        nonlocal below
        if below:
            below -= 1
            return
        e = stack.pop()
        at = p.CurrentByteIndex
        close = data.find(b">", at)
        e.end = close + 1 if close >= 0 else len(data)
        if each is not None and stack and each(e, stack):
            stack[-1].children.pop()

    def chars(value):
        if stack:
            last = stack[-1].children[-1] if stack[-1].children else None
            if last is not None and last.name is None:
                last.value += value
                last.end = p.CurrentByteIndex + len(value.encode())
            else:
                stack[-1].children.append(Element(None, {}, p.CurrentByteIndex, p.CurrentByteIndex + len(value.encode()), value))

    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, end, chars
    try:
        p.Parse(data, True)
    except expat.ExpatError as e:
        return None, (min(p.ErrorByteIndex, len(data)) if p.ErrorByteIndex >= 0 else 0, str(e))
    return root[0], first_deep


class Reader:
    def __init__(self, sheet: Sheet | None):
        self.sheet = Sheet(dict((sheet or default_sheet()).styles))
        self.found: list[Diagnostic] = []
        self.added: set[str] = set()
        self.book = None
        self.chapter: tuple[str, tuple[int, int]] | None = None
        self.verse: Verse | None = None
        self.spans: dict[int, tuple[int, int]] = {}
        self.eids = self.cell = False
        self.versetext = True
        self.waiting: list[tuple[Verse, int]] = []
        self.depth = self.suspended = 0
        self.implicit: Node | None = None

    def say(self, code, e, message) -> None:
        self.found.append(Diagnostic(code, e.start, e.end, message))

    # -- styles and attributes

    def unknown(self, marker: str, e) -> None:
        self.say("unknown-custom-marker" if marker.startswith("z") else "unknown-marker", e, f"\\{marker} is not in the style sheet; kept")

    def style(self, marker: str, kind: str, e) -> str:
        if marker in self.sheet.styles:
            if marker in self.added:
                self.unknown(marker, e)
            return marker
        kept = "other"
        if kind == "milestone":
            base = re.sub(r"(?:-e)*$", "", re.sub(r"(?:-s)*$", "", marker))
            known = self.sheet.get(base) if marker[-2:] in ("-s", "-e") else None
            if known is not None:
                kept = known.text
            else:
                self.say("unknown-custom-milestone" if marker.startswith("z") else "unknown-milestone", e, f"milestone \\{marker} is not in the style sheet")
        else:
            self.unknown(marker, e)
            self.added.add(marker)
        self.sheet.styles[marker] = Style(marker, kind, kept)
        return marker

    def element_style(self, e: Element, kind: str) -> str | None:
        marker = e.get("style")
        if marker is None:
            self.say("usx-unknown-element", e, f"<{e.name}> has no style" + ("; dropped" if kind == "milestone" else "; its content is read in its place"))
            return None
        return self.style(marker, kind, e)

    @staticmethod
    def pairs(e: Element, skip=(), rename=None):
        found = [((rename or {}).get(k, k), v, e.start, e.start) for k, v in e.attributes.items() if k not in skip and k not in ("status", "closed")]
        return found or None

    # -- references

    def verse_name(self, number) -> str:
        return f"{self.book or 'OTH'} {self.chapter[0] if self.chapter else 0}:{show_numbers(number)}"

    def chapter_name(self, number: str) -> str:
        return f"{self.book or 'OTH'} {number}"

    def check(self, e: Element, attribute: str, expected: str | None) -> None:
        written = e.get(attribute)
        if written is not None and written != expected:
            self.say("usx-reference-mismatch", e, f"{attribute} is {written}" + (f" where {expected} is due" if expected else " but no verse is open"))

    def check_vid(self, e: Element) -> None:
        self.check(e, "vid", self.verse_name(self.verse.number) if self.verse else None)

    # -- ends

    def start_block(self) -> None:
        if self.verse:
            self.verse.here = False

    def start_paragraph(self, marker: str) -> None:
        self.versetext = self.sheet.get(marker).text == "versetext"
        self.cell = False
        self.start_block()

    def no_end(self, span, what: str) -> None:
        if self.eids:
            self.found.append(Diagnostic("usx-verse-end-missing", *span, f"{what} has no eid; its end was supplied"))

    def begin_verse(self, box: Node, number, e) -> None:
        if not self.suspended and self.verse:
            old, self.verse = self.verse, None
            self.no_end(self.spans[id(old)], f"verse {self.verse_name(old.number)}")
            self.place_end(box, old)
        self.verse = Verse(number)
        self.spans[id(self.verse)] = (e.start, e.end)
        self._keep = getattr(self, "_keep", [])
        self._keep.append(self.verse)

    def place_end(self, box: Node, verse: Verse) -> None:
        elsewhere = not self.depth and not self.cell and not self.versetext and not verse.here
        if elsewhere or not box.children:
            self.waiting.append((verse, self.depth))
        else:
            self.push_end(box, verse)

    @staticmethod
    def end_node(verse: Verse) -> Node:
        return Node("verse_end", data={"number": show_numbers(verse.number), "ranges": verse.number})

    def push_end(self, box: Node, verse: Verse) -> None:
        last, blank = (box.children[-1] if box.children else None), False
        if last is not None and last.kind == "text" and last.content[-1:] and last.content[-1] in WS:
            blank = True
            last.content = last.content.rstrip(WS)
            if not last.content:
                box.children.pop()
        box.children.append(self.end_node(verse))
        if blank:
            box.children.append(text(" "))

    def take(self, depth: int) -> Verse | None:
        return self.waiting.pop()[0] if self.waiting and self.waiting[-1][1] == depth else None

    def end_in_last(self, out, verse: Verse) -> None:
        starts = lambda ns: any(n.kind == "verse_start" or n.kind == "char" and starts(n.children) for n in ns)
        for b in reversed(out):
            if b.kind == "para" and b.children and (starts(b.children) or self.sheet.get(b.marker).text == "versetext"):
                b.children.append(self.end_node(verse))
                return
            if b.kind == "table" and b.children and b.children[-1].children:
                b.children[-1].children[-1].children.append(self.end_node(verse))
                return

    def end_waiting(self, out) -> None:
        if (v := self.take(0)) is not None:
            self.end_in_last(out, v)

    def end_verse(self, out) -> None:
        if self.suspended:
            return
        for v, _ in self.waiting:
            self.end_in_last(out, v)
        self.waiting = []
        if self.verse:
            v, self.verse = self.verse, None
            self.no_end(self.spans[id(v)], f"verse {self.verse_name(v.number)}")
            self.end_in_last(out, v)

    def end_chapter(self, out) -> None:
        if self.suspended:
            return
        self.end_verse(out)
        if self.chapter:
            number, span = self.chapter
            self.no_end(span, f"chapter {self.chapter_name(number)}")
            self.chapter = None
            out.append(Node("chapter_end", data={"number": number}))

    # -- blocks

    def document(self, root: Element) -> list[Node]:
        if root.name != "usx":
            self.say("usx-unknown-element", root, f"the root is <{root.name}>; its content is read")
        out = self.list(root)
        self.end_chapter(out)
        v = root.get("version")
        if v is not None and self.sheet.get("usfm"):
            para = Node("para", "usfm", root.start, root.start, children=[text(v, root.start, root.start)])
            out.insert(1 if out and out[0].kind == "book" else 0, para)
        return out

    def list(self, parent: Element) -> list[Node]:
        out: list[Node] = []
        before, self.implicit = self.implicit, None
        self.blocks(parent, out)
        self.close(out)
        self.implicit = before
        return out

    def close(self, out) -> None:
        if self.implicit is not None:
            para, self.implicit = self.implicit, None
            trim(para)
            self.end_waiting(out)
            out.append(para)

    def blocks(self, parent: Element, out) -> None:
        for e in parent.children:
            name = e.name
            if name is None:
                if e.value.strip(WS):
                    self.outside(e, out)
            elif name in _INLINE:
                self.outside(e, out)
            elif name == "unmatched":
                self.unmatched(e)
            elif name in ("row", "cell"):
                self.say("usx-unknown-element", e, f"<{name}> outside a <table>; dropped")
            elif name in ("para", "sidebar"):
                marker = self.element_style(e, "paragraph")
                if marker is None:
                    self.blocks(e, out)
                    continue
                self.close(out)
                if name == "sidebar":
                    out.append(self.sidebar(e, marker))
                    continue
                if marker == "esbe":
                    self.say("unmatched-sidebar-end", e, "\\esbe without an open \\esb")
                self.check_vid(e)
                self.start_paragraph(marker)
                para = Node("para", marker, e.start, e.end)
                self.inlines(e, para, False)
                trim(para)
                self.end_waiting(out)
                out.append(para)
            elif name in ("book", "chapter", "table", "ms", "periph"):
                self.close(out)
                made = getattr(self, f"read_{name}")(e, out)
                if made is not None:
                    out.append(made)
            else:
                self.say("usx-unknown-element", e, f"<{name}> is not a USX element; its content is read in its place")
                self.blocks(e, out)

    def outside(self, e: Element, out) -> None:
        if self.implicit is None:
            if not self.sheet.get("p"):
                self.say("content-dropped", e, "content outside a paragraph was dropped: there is no \\p")
                return
            self.say("content-outside-paragraph", e, "content outside a paragraph; \\p was supplied")
            self.start_paragraph("p")
            self.implicit = Node("para", "p", e.start, e.end)
        self.implicit.end = e.end
        self.inline(e, self.implicit, False)

    def read_book(self, e: Element, out):
        code = e.get("code")
        if code is None:
            self.say("missing-book-code", e, "<book> has no code")
            return None
        if not well_formed(code):
            self.say("unknown-book-code", e, f"{code} is not a book code")
            return None
        self.book = code
        parts: list[str] = []

        def texts(x):
            for c in x.children:
                if c.name is None:
                    parts.append(c.value)
                else:
                    texts(c)

        texts(e)
        return Node("book", "id", e.start, e.end, data={"code": code, "description": collapse("".join(parts)).strip(WS)})

    def numbers(self, e: Element, code: str, what: str):
        alt = e.get("altnumber")
        got = parse_numbers(alt) if alt is not None else None
        if alt is not None and got is None:
            self.say(code, e, f"{alt} is not an alternate {what} number")
        return show_numbers(got) if got else None

    def read_chapter(self, e: Element, out):
        number = e.get("number")
        if number is not None:
            if not re.fullmatch(r"\+?[0-9]{1,18}", number):
                self.say("malformed-chapter-number", e, f"{number} is not a chapter number")
                return None
            if leading_zero(number):
                self.say("number-has-leading-zero", e, f"chapter number {number} starts with zero")
            data = {"number": str(int(number)), "alt_number": self.numbers(e, "malformed-chapter-number", "chapter"), "pub_number": e.get("pubnumber")}
            self.end_chapter(out)
            self.chapter = (data["number"], (e.start, e.end))
            self.check(e, "sid", self.chapter_name(data["number"]))
            return Node("chapter_start", "c", e.start, e.end, data=data)
        eid = e.get("eid")
        if eid is None:
            self.say("missing-chapter-number", e, "<chapter> has neither number nor eid")
            return None
        self.end_verse(out)
        if not self.chapter:
            self.say("usx-verse-end-mismatch", e, f"{eid} ends no open chapter")
            return None
        number, self.chapter = self.chapter[0], None
        if eid != self.chapter_name(number):
            self.say("usx-verse-end-mismatch", e, f"{eid} ends {self.chapter_name(number)}")
        return Node("chapter_end", data={"number": number})

    def read_table(self, e: Element, out):
        self.check_vid(e)
        self.start_block()
        table, early = Node("table", None, e.start, e.end), None
        for c in e.children:
            if c.name == "row":
                row, before = self.row(c)
                if before is not None:
                    if table.children and table.children[-1].children:
                        table.children[-1].children[-1].children.append(self.end_node(before))
                    else:
                        early = before
                table.children.append(row)
            elif c.name is not None or c.value.strip(WS):
                self.say("usx-unknown-element", c, "content of a <table> outside its rows; dropped")
        if early is not None:
            self.end_in_last(out, early)
        return table

    def row(self, e: Element):
        row, before, held = Node("row", "tr", e.start, e.end), None, []
        for c in e.children:
            if c.name == "cell":
                last = row.children[-1].data if row.children else None
                cell = self.read_cell(c, min(255, last["col"] + last["colspan"]) if last else 1, held)
                if (v := self.take(0)) is not None:
                    if row.children:
                        row.children[-1].children.append(self.end_node(v))
                    else:
                        before = v
                row.children.append(cell)
            elif c.name == "verse":
                if c.get("eid") is not None and row.children:
                    self.inline(c, row.children[-1], False)
                else:
                    held.append(c)
            elif c.name is not None or c.value.strip(WS):
                self.say("usx-unknown-element", c, "content of a <row> outside its cells; dropped")
        if row.children:
            self.cell = True
            for c in held:
                self.inline(c, row.children[-1], False)
            self.cell = False
        else:
            for c in held:
                self.say("usx-unknown-element", c, "a verse in a <row> without cells; dropped")
        return row, before

    def read_cell(self, e: Element, due: int, held: list) -> Node:
        style = e.get("style")
        info = _cell_style(style) if style is not None else None
        if style is None:
            self.say("usx-unknown-element", e, "<cell> has no style; read as the next \\tc")
        elif info is None:
            self.unknown(style, e)
        cell = Node("cell", None, e.start, e.end, data=dict(zip(("header", "alignment", "col", "colspan"), info or (False, "start", due, 1))))
        self.cell = True
        for c in held:
            self.inline(c, cell, False)
        held.clear()
        self.inlines(e, cell, False)
        self.cell = False
        trim(cell)
        return cell

    def sidebar(self, e: Element, marker: str) -> Node:
        verse, self.verse = self.verse, None
        self.suspended += 1
        children = self.list(e)
        self.suspended -= 1
        self.verse = verse
        self.start_block()
        return Node("sidebar", marker, e.start, e.end, children=children, data={"category": e.get("category")})

    def read_periph(self, e: Element, out):
        self.end_chapter(out)
        self.style("periph", "paragraph", e)
        node = Node("periph", "periph", e.start, e.end, data={"title": e.get("alt")})
        node.attributes = self.pairs(e, ("alt", "style"))
        node.children = self.list(e)
        self.end_chapter(node.children)
        return node

    def read_ms(self, e: Element, out=None):
        marker = self.element_style(e, "milestone")
        if marker is None:
            return None
        node = Node("milestone", marker, e.start, e.end)
        node.attributes = self.pairs(e, ("style",))
        return node

    def unmatched(self, e: Element) -> None:
        self.say("usx-unmatched", e, f"a closing {e.get('marker') or '?'} that closed nothing")

    # -- inline

    def inlines(self, parent: Element, box: Node, note: bool) -> None:
        for e in parent.children:
            self.inline(e, box, note)

    def inline(self, e: Element, box: Node, note: bool) -> None:
        name = e.name
        if name is None:
            if e.value.strip(WS) or not re.search("[\n\r]", e.value):
                if value := collapse(e.value):
                    box.add(text(value, e.start, e.end))
        elif name == "verse":
            self.read_verse(e, box, note)
        elif name in ("char", "figure", "ref"):
            marker = self.element_style(e, "character") if name == "char" else self.style({"figure": "fig"}.get(name, name), "character", e)
            if marker is None:
                self.inlines(e, box, note)
                return
            node = Node("char", marker, e.start, e.end)
            node.attributes = self.pairs(e, ("style",), {"file": "src"} if name == "figure" else None)
            self.depth += 1
            self.inlines(e, node, note)
            self.depth -= 1
            if (v := self.take(self.depth + 1)) is not None:
                self.place_end(box, v)
            box.add(node)
        elif name == "note":
            marker = self.element_style(e, "note")
            if marker is None:
                self.inlines(e, box, True)
                return
            caller = e.get("caller")
            if caller is None:
                self.say("missing-note-caller", e, "<note> has no caller; + was supplied")
            node = Node("note", marker, e.start, e.end, data={"caller": caller if caller is not None else "+", "category": e.get("category")})
            self.depth += 1
            self.inlines(e, node, True)
            self.depth -= 1
            box.add(node)
        elif name == "ms":
            if (node := self.read_ms(e)) is not None:
                box.add(node)
        elif name == "optbreak":
            box.add(Node("opt_break", None, e.start, e.end))
        elif name == "unmatched":
            self.unmatched(e)
        else:
            self.say("usx-unknown-element", e, f"<{name}> " + ("can't stand in inline content" if name in _BLOCK else "is not a USX element") + "; its content is read in its place")
            self.inlines(e, box, note)

    def read_verse(self, e: Element, box: Node, note: bool) -> None:
        number = e.get("number")
        if number is not None:
            if note:
                self.say("verse-in-note", e, f"verse {number} in a note; dropped")
                return
            got = parse_numbers(number)
            if got is None:
                self.say("malformed-verse-number", e, f"{number} is not a verse number")
                return
            if leading_zero(number):
                self.say("number-has-leading-zero", e, f"verse number {number} starts with zero")
            data = {"number": show_numbers(got), "ranges": got, "alt_number": self.numbers(e, "malformed-verse-number", "verse"), "pub_number": e.get("pubnumber")}
            self.check(e, "sid", self.verse_name(got))
            self.begin_verse(box, got, e)
            box.add(Node("verse_start", "v", e.start, e.end, data=data))
            return
        eid = e.get("eid")
        if eid is None:
            self.say("missing-verse-number", e, "<verse> has neither number nor eid")
        elif not self.verse:
            self.say("usx-verse-end-mismatch", e, f"{eid} ends no open verse")
        else:
            v, self.verse = self.verse, None
            if eid != self.verse_name(v.number):
                self.say("usx-verse-end-mismatch", e, f"{eid} ends {self.verse_name(v.number)}")
            self.push_end(box, v)


def _cell_style(style: str):
    return cell_info(style) if re.fullmatch(r"t[hc][rc]?\d+(?:-\d+)?", style) else None


def trim(box: Node) -> None:
    """No white space at the end of a paragraph, nor before the verse ends that close it."""
    box.trim_end()
    i = len(box.children)
    while i and box.children[i - 1].kind == "verse_end":
        i -= 1
    if 0 < i < len(box.children) and box.children[i - 1].kind == "text":
        last = box.children[i - 1]
        last.content = last.content.rstrip(WS)
        if not last.content:
            box.children.pop(i - 1)


def _elements(root: Element):
    stack = [root]
    while stack:
        e = stack.pop()
        yield e
        stack.extend(c for c in e.children if c.name)


def read_usx(source: str, sheet: Sheet | None = None, ends: bool = True) -> Document:
    """Never fails: XML that is not well formed gives an empty document and a diagnostic.
    Spans are bytes of the XML already, so ``source`` of the result is their plain ruler."""
    reader = Reader(sheet)
    root, error = read_xml(source.removeprefix("\ufeff"))
    blocks: list[Node] = []
    if root is None:
        reader.found.append(Diagnostic("usx-not-well-formed", error[0], error[0], f"not well-formed XML: {error[1]}"))
    else:

        if error is not None:
            reader.found.append(Diagnostic("internal", error[0], error[0], error[1]))
        reader.eids = any(e.name in ("verse", "chapter") and e.get("eid") is not None for e in _elements(root))
        blocks = reader.document(root)
    reader.found.sort(key=lambda d: d.start)
    return Document(blocks, reader.found, reader.sheet, "")
