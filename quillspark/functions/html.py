"""Trees to HTML, alone or two side by side."""

from __future__ import annotations

import re

from .parser import Document
from .style import Sheet
from .tree import Node
from .writers import _NAME, cell_marker

_FORBIDDEN = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_HEADINGS = {"s": "h1"} | {f"{m}{k}": f"h{k}" for m in ("s", "mt") for k in range(1, 7)}
_PUNCT = r""".?!,۔؟“”"'‘’،:;\(\)"""
_OPEN = r""""'”“‘’\("""


def escape(text: str, quote: bool = False) -> str:
    text = text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    text = text.replace('"', "&quot;") if quote else text
    return text if text.isprintable() else _FORBIDDEN.sub("\ufffd", text)


def sections(text: str) -> list[str]:
    """The pieces of a text, as the column expression in operators.text cuts it."""
    a = re.sub(f"((?:^|(?<=\\s)))([{_OPEN}][{_PUNCT}]*)", "\\1\u0001\\2", text)
    return re.sub(f"(?<![{_PUNCT}\u0001])([{_PUNCT}]+)", "\\1\u0001", a).split("\u0001")


class HtmlWriter:
    """``hooks`` maps a node kind to ``hook(writer, node) -> str``, used wherever such a node
    stands, inside others as well; ``standard`` gives the usual form."""

    def __init__(self, sheet: Sheet, hooks: dict | None = None):
        self.sheet, self.hooks = sheet, hooks or {}
        self.notes = self.other_notes = self.flags = 0
        self.chapter: str | None = None

    def all(self, nodes: list[Node]) -> str:
        return "".join(self.node(n) for n in nodes)

    def node(self, n: Node) -> str:
        hook = self.hooks.get(n.kind)
        return hook(self, n) if hook else self.standard(n)

    def standard(self, n: Node) -> str:
        return getattr(self, f"_{n.kind}")(n)

    def tag(self, n: Node) -> str:
        return _HEADINGS.get(n.marker, "p")

    def _book(self, n):
        return f'<div class="id" data-code="{n.data["code"]}">{escape(n.data["description"])}</div>'

    def _chapter_start(self, n):
        self.chapter = n.data.get("pub_number") or n.data["number"]
        return ""

    def _chapter_end(self, n):
        return ""

    def _para(self, n):
        style = self.sheet.get(n.marker)
        number = None
        if style is not None and style.text == "versetext":
            number, self.chapter = self.chapter, None
        tag, inside = self.tag(n), ""
        if n.children or number is not None:
            lead = f'<span class="c">{escape(number)}</span>' if number is not None else ""
            inside = f"\n  {lead}{self.all(n.children)}\n"
        return f'<{tag} class="{n.marker}">{inside}</{tag}>\n'

    def _table(self, n):
        return f"<table>\n  <tbody>\n{self.all(n.children)}  </tbody>\n</table>\n"

    def _row(self, n):
        return f"  <tr>\n{self.all(n.children)}  </tr>\n"

    def _cell(self, n):
        span = n.data["colspan"]
        wide = f' colspan="{span}"' if span > 1 else ""
        return f'    <td style="{cell_marker(n.data)}" align="{n.data["alignment"]}"{wide}>{self.all(n.children)}</td>\n'

    def _sidebar(self, n):
        c = n.data.get("category")
        kind = f' data-category="{escape(c, True)}"' if c is not None else ""
        return f'<aside class="{n.marker}"{kind}>\n{self.all(n.children)}</aside>\n'

    def _periph(self, n):
        ids = "".join(f' id="{escape(v, True)}"' for k, v, *_ in n.attributes or () if k in ("", "id"))
        title = f"<h1>{escape(n.data['title'])}</h1>\n" if n.data.get("title") else ""
        return f'<section class="{n.marker}"{ids}>\n{title}{self.all(n.children)}</section>\n'

    def _milestone(self, n):
        data = "".join(f' data-{k}="{escape(v, True)}"' for k, v, *_ in n.attributes or () if _NAME.match(k))
        return f'<span class="ms {n.marker}"{data}></span>'

    def _text(self, n):
        return escape(n.content)

    def _verse_start(self, n):
        return f'<span class="v start">{n.data["number"]}</span>'

    def _verse_end(self, n):
        return f'<span class="v end">{n.data["number"]}</span>'

    def _opt_break(self, n):
        return "<wbr>"

    def _char(self, n):
        if n.marker != "flag":
            return f'<span class="{n.marker}">{self.all(n.children)}</span>'
        at, self.flags = self.flags, self.flags + 1
        return f'<button popovertarget="id-{at}" class="flag"></button><span popover id="id-{at}" class="flag-content">{self.all(n.children)}</span>'

    def _note(self, n):
        caller = n.data["caller"]
        if caller == "+":
            self.notes += 1
            key, shown = str(self.notes), str(self.notes)
        else:
            self.other_notes += 1
            key, shown = f"c{self.other_notes}", "" if caller == "-" else caller
        return f'<button class="note {n.marker}-trigger" popovertarget="note-{key}">{escape(shown)}</button><span id="note-{key}" class="{n.marker}" popover>{self.all(n.children)}</span>'


def to_html(doc: Document, hooks: dict | None = None) -> str:
    return HtmlWriter(doc.sheet, hooks).all(doc.blocks)


def side(doc: Document, name: str) -> str:
    """One side of a page of two: a paragraph is opened anew for each of its sections."""
    w, out = HtmlWriter(doc.sheet), [f'<section class="{name}">']
    for b in doc.blocks:
        style = doc.sheet.get(b.marker) if b.kind == "para" else None
        if style is None or not style.vernacular:
            out.append(w.node(b))
            continue
        tag = w.tag(b)
        parts = [""]
        for c in b.children:
            if c.kind == "text":
                first, *rest = sections(c.content)
                parts[-1] += escape(first)
                parts += [escape(x) for x in rest]
            else:
                parts[-1] += w.node(c)
        body = "".join(f'<{tag} class="{b.marker}">{p}</{tag}>' for p in parts if p.strip())
        out.append(f'<div class="para-start">{b.marker}</div>{body}<div class="para-end">{b.marker}</div>')
    return "".join(out) + "</section>"


def diglot(left: Document, right: Document) -> str:
    return side(left, "left") + "\n" + side(right, "right")
