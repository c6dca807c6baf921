"""Writers: trees of Python nodes to markup, JSON and XML text. One call per document."""

from __future__ import annotations

import json
import re

from .books import show_numbers
from .parser import ByteOffsets, Document
from .style import Sheet
from .tree import WS, Node

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9._-]*\Z")
_ALIGN = {"start": "", "center": "c", "end": "r"}


def version(blocks: list[Node]) -> str | None:
    for n in blocks:
        if n.kind == "para" and n.marker == "usfm":
            return "".join(c.content for c in n.children if c.kind == "text").strip(WS) or None
    return None


def cell_marker(data: dict) -> str:
    col, span = data["col"], data["colspan"]
    return "t" + ("h" if data["header"] else "c") + _ALIGN[data["alignment"]] + (f"{col}-{col + span - 1}" if span > 1 else str(col))


# -- markup -----------------------------------------------------------------


class MarkupWriter:
    """Canonical markup: one block a line, \\+ for nested styles, no closing markers for the
    usual run of styles in a note."""

    def __init__(self, sheet: Sheet):
        self.sheet, self.out, self.nested = sheet, [], False

    @staticmethod
    def text(value: str) -> str:
        return value.replace("\\", "\\\\").replace("|", "\\|").replace("\u00a0", "~")

    def attributes(self, pairs) -> str:
        out, gap = "|", False
        for name, value, *_ in pairs:
            out += " " if gap else ""
            gap = bool(name)
            out += f'{name}="' + value.replace("\\", "\\\\").replace('"', '\\"') + '"' if name else value
        return out

    def blocks(self, blocks: list[Node]) -> str:
        for n in blocks:
            self.block(n)
        return "".join(self.out)

    def block(self, n: Node) -> None:
        add, d = self.out.append, n.data
        if n.kind == "book":
            add(f"\\id {d['code']}" + (f" {self.text(d['description'])}" if d["description"] else "") + "\n")
        elif n.kind == "chapter_start":
            add(f"\\c {d['number']}\n")
            if d.get("alt_number"):
                add(f"\\ca {d['alt_number']}\\ca*\n")
            if d.get("pub_number"):
                add(f"\\cp {d['pub_number']}\n")
        elif n.kind == "para":
            add(f"\\{n.marker}")
            if n.children:
                add(" ")
                self.inlines(n.children)
            add("\n")
        elif n.kind == "table":
            for row in n.children:
                add("\\tr")
                for cell in row.children:
                    add(f" \\{cell_marker(cell.data)}")
                    if cell.children:
                        add(" ")
                        self.inlines(cell.children)
                add("\n")
        elif n.kind == "milestone":
            self.inline(n)
            add("\n")
        elif n.kind == "sidebar":
            add("\\esb" + (f" \\cat {self.text(d['category'])}\\cat*" if d.get("category") is not None else "") + "\n")
            for c in n.children:
                self.block(c)
            add("\\esbe\n")
        elif n.kind == "periph":
            add("\\periph" + (f" {self.text(d['title'])}" if d.get("title") else "") + (self.attributes(n.attributes) if n.attributes is not None else "") + "\n")
            for c in n.children:
                self.block(c)

    def inlines(self, children: list[Node]) -> None:
        for c in children:
            self.inline(c)

    def inline(self, n: Node) -> None:
        add, d = self.out.append, n.data
        if n.kind == "text":
            add(self.text(n.content))
        elif n.kind == "verse_start":
            add(f"\\v {d['number']}")
            if d.get("alt_number"):
                add(f" \\va {d['alt_number']}\\va*")
            if d.get("pub_number"):
                add(f" \\vp {self.text(d['pub_number'])}\\vp*")
            add(" ")
        elif n.kind == "char":
            self.char(n, True)
        elif n.kind == "note":
            add(f"\\{n.marker} {d['caller']} ")
            if d.get("category") is not None:
                add(f"\\cat {self.text(d['category'])}\\cat*")
            before, self.nested = self.nested, False
            for c, open_end in zip(n.children, self.open_ends(n.children)):
                if open_end:
                    self.char(c, False)
                else:
                    self.inline(c)
            self.nested = before
            add(f"\\{n.marker}*")
        elif n.kind == "milestone":
            add(f"\\{n.marker}" + (" " + self.attributes(n.attributes) if n.attributes is not None else "") + "\\*")
        elif n.kind == "opt_break":
            add("//")

    def char(self, n: Node, close: bool) -> None:
        plus = "+" if self.nested else ""
        self.out.append(f"\\{plus}{n.marker} ")
        before, self.nested = self.nested, True
        self.inlines(n.children)
        self.nested = before
        if n.attributes is not None:
            self.out.append(self.attributes(n.attributes))
        if close:
            self.out.append(f"\\{plus}{n.marker}*")

    def open_ends(self, children: list[Node]) -> list[bool]:
        """Which note styles may go unclosed because what follows ends them anyway."""

        def note_text(n):
            s = self.sheet.get(n.marker) if n.kind == "char" else None
            return s is not None and s.kind == "character" and s.text == "notetext"

        out = [False] * len(children)
        for i in range(len(children) - 1, -1, -1):
            n = children[i]
            if not note_text(n) or n.attributes is not None:
                continue
            after = children[i + 1] if i + 1 < len(children) else None
            out[i] = after is None or note_text(after) and (n.marker == "xo" or not self.sheet.get(after.marker).nest or out[i + 1])
        return out


def to_markup(doc: Document) -> str:
    return MarkupWriter(doc.sheet).blocks(doc.blocks)


# -- JSON -------------------------------------------------------------------


def json_node(n: Node, at) -> dict:
    d = n.data
    out: dict = {"type": n.kind, "span": [at(n.start), at(n.end)]}
    if n.kind in ("para", "sidebar", "periph", "char", "note", "milestone"):
        out["style"] = n.marker
    if n.kind == "text":
        out["content"] = n.content
    for k in ("code", "description", "number", "alt_number", "pub_number", "caller", "category", "title", "header", "alignment", "colspan"):
        if d.get(k) is not None:
            out[k] = d[k]
    if n.kind == "cell":
        out["column"] = d["col"]
    if n.attributes is not None:
        out["attributes"] = [{"name": k, "value": v} for k, v, *_ in n.attributes]
    if n.kind in ("para", "table", "row", "cell", "sidebar", "periph", "char", "note"):
        out["children"] = [json_node(c, at) for c in n.children]
    return out


def to_json(doc: Document) -> str:
    """The tree with sorted keys; the document's span ends with its last block."""
    at = ByteOffsets(doc.source)
    top: dict = {"type": "document", "span": [0, max((at(b.end) for b in doc.blocks), default=0)], "children": [json_node(b, at) for b in doc.blocks]}
    if v := version(doc.blocks):
        top["usfm_version"] = v
    return json.dumps(top, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


# -- XML --------------------------------------------------------------------

_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_TEXT = {"&": "&amp;", "<": "&lt;", ">": "&gt;"}
_VALUE = _TEXT | {'"': "&quot;", "'": "&apos;", "\n": "&#xA;", "\r": "&#xD;", "\t": "&#9;"}
_VALUE_MAP = str.maketrans(_VALUE)


def allowed(text: str) -> str:
    """``text`` with the characters that XML forbids replaced; none of them is printable."""
    return text if text.isprintable() else _FORBIDDEN.sub("\ufffd", text)


def escape(text: str) -> str:
    return allowed(text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))


def escape_value(text: str) -> str:
    return text if text.isalnum() else allowed(text.translate(_VALUE_MAP))


def xml_text(element, indent: int | None = 0) -> str:
    """An element (name, [(attribute, value)], [child or text]) as text: children go on lines
    of their own unless one of them is text."""
    if isinstance(element, str):
        return escape(element)
    name, attributes, children = element
    pad = " " * indent if indent is not None else ""
    head = f"{pad}<{name}" + "".join(f' {k}="{escape_value(v)}"' for k, v in attributes)
    if not children:
        return head + " />"
    inner = None if indent is None or any(isinstance(c, str) for c in children) else indent + 2
    body = "".join(("\n" if inner is not None else "") + xml_text(c, inner) for c in children)
    return f"{head}>{body}" + (f"\n{pad}" if inner is not None else "") + f"</{name}>"


class UsxWriter:
    """Trees to USX elements. ``hooks`` maps a node kind to ``hook(writer, node) -> list of
    elements`` that takes the place of the standard form; ``standard`` gives that form."""

    def __init__(self, sheet: Sheet, vids: bool = True, hooks: dict | None = None):
        self.sheet, self.vids, self.hooks = sheet, vids, hooks or {}
        self.book = self.chapter = self.verse = None

    def document(self, blocks: list[Node]):
        kept = [b for b in blocks if not (b.kind == "para" and b.marker == "usfm")]
        return "usx", [("version", version(blocks) or "3.0")], self.all(kept)

    def all(self, nodes) -> list:
        return [e for n in nodes for e in (self.hooks[n.kind](self, n) if n.kind in self.hooks else self.standard(n))]

    def reference(self, number: str) -> str:
        return f"{self.book or 'OTH'} {self.chapter or 0}:{number}"

    def vid(self) -> list:
        return [("vid", self.reference(self.verse))] if self.vids and self.verse else []

    def pairs(self, have: list, n: Node, rename: dict | None = None) -> list:
        for name, value, *_ in n.attributes or ():
            name = (rename or {}).get(name, name) if name else self.sheet.default_attribute(n.marker)
            if name and _NAME.match(name) and all(k != name for k, _ in have):
                have.append((name, value))
        return have

    def standard(self, n: Node) -> list:
        d, kind = n.data, n.kind
        if kind == "text":
            return [n.content]
        if kind == "book":
            self.book = d["code"]
            return [("book", [("code", d["code"]), ("style", "id")], [d["description"]] if d["description"] else [])]
        if kind in ("chapter_start", "verse_start"):
            name, style = ("chapter", "c") if kind == "chapter_start" else ("verse", "v")
            if name == "chapter":
                self.chapter = d["number"]
                sid = f"{self.book or 'OTH'} {d['number']}"
            else:
                self.verse = d["number"]
                sid = self.reference(d["number"])
            extra = [(k, d[v]) for k, v in (("altnumber", "alt_number"), ("pubnumber", "pub_number")) if d.get(v) is not None]
            return [(name, [("number", d["number"]), ("style", style), *extra, ("sid", sid)], [])]
        if kind == "chapter_end":
            self.chapter = None
            return [("chapter", [("eid", f"{self.book or 'OTH'} {d['number']}")], [])]
        if kind == "verse_end":
            self.verse = None
            return [("verse", [("eid", self.reference(d["number"]))], [])]
        if kind == "para":
            head = [("style", n.marker), *self.vid()]
            return [("para", head, self.all(n.children))]
        if kind == "table":
            head = self.vid()
            return [("table", head, self.all(n.children))]
        if kind == "row":
            return [("row", [("style", "tr")], self.all(n.children))]
        if kind == "cell":
            return [("cell", [("style", cell_marker(d)), ("align", d["alignment"])], self.all(n.children))]
        if kind == "sidebar":
            head = [("style", n.marker)] + ([("category", d["category"])] if d.get("category") is not None else [])
            verse, self.verse = self.verse, None
            inside = self.all(n.children)
            self.verse = verse
            return [("sidebar", head, inside)]
        if kind == "periph":
            return [("periph", self.pairs([("alt", d["title"])] if d.get("title") else [], n), self.all(n.children))]
        if kind == "note":
            head = [("caller", d["caller"]), ("style", n.marker)] + ([("category", d["category"])] if d.get("category") is not None else [])
            return [("note", head, self.all(n.children))]
        if kind == "milestone":
            return [("ms", self.pairs([("style", n.marker)], n), [])]
        if kind == "opt_break":
            return [("optbreak", [], [])]
        name = {"ref": "ref", "fig": "figure"}.get(n.marker, "char")
        head = [] if name == "ref" else [("style", n.marker)]
        return [(name, self.pairs(head, n, {"src": "file"} if name == "figure" else None), self.all(n.children))]


def to_usx(doc: Document, vids: bool = True, hooks: dict | None = None) -> str:
    return xml_text(UsxWriter(doc.sheet, vids, hooks).document(doc.blocks)) + "\n"


def to_sile(doc: Document) -> str:
    """The USX tree under a root named sile without attributes."""
    _, _, children = UsxWriter(doc.sheet).document(doc.blocks)
    return xml_text(("sile", [], children)) + "\n"


def normalised(n: Node, sheet: Sheet) -> Node:
    """What a tree looks like after USX: default attributes named, those that can't be written
    and empty lists gone, forbidden characters replaced."""
    out = Node(n.kind, n.marker, n.start, n.end, allowed(n.content) if n.content is not None else None, [normalised(c, sheet) for c in n.children], dict(n.data))
    if n.attributes:
        pairs: list = []
        for name, value, a, b in n.attributes:
            name = name or sheet.default_attribute(n.marker)
            if name and _NAME.match(name) and name not in ("style",) and all(k != name for k, *_ in pairs):
                pairs.append((name, allowed(value), a, b))
        out.attributes = pairs or None
    return out


def same(a: list[Node], b: list[Node]) -> bool:
    """Equal trees but for spans."""

    def facts(data: dict) -> dict:
        return {k: show_numbers(v) if k == "ranges" else v for k, v in data.items() if v is not None and k != "title_span"}

    stack = [(a, b)]
    while stack:
        xs, ys = stack.pop()
        if len(xs) != len(ys):
            return False
        for x, y in zip(xs, ys):
            if x.kind != y.kind or x.marker != y.marker or x.content != y.content or x.data != y.data and facts(x.data) != facts(y.data):
                return False
            if x.attributes != y.attributes and (x.attributes is None or y.attributes is None or [p[:2] for p in x.attributes] != [p[:2] for p in y.attributes]):
                return False
            if x.children or y.children:
                stack.append((x.children, y.children))
    return True
