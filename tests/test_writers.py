"""Round trips, the USX reader's codes, HTML, fixes, replacements."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quillspark.functions import fixes, html, writers
from quillspark.functions.codes import CODES
from quillspark.functions.parser import parse
from quillspark.functions.replacements import Replacements, Transliterator
from quillspark.functions.usx import read_usx

from .test_parser import BODY, PIECES

documents = st.lists(st.sampled_from(PIECES), max_size=18).map("".join)


@settings(max_examples=300, deadline=None)
@given(documents)
def test_markup_round_trip(source):
    doc = parse(source)
    out = writers.to_markup(doc)
    again = parse(out)
    assert writers.same(doc.blocks, again.blocks)
    assert writers.to_markup(again) == out


@settings(max_examples=300, deadline=None)
@given(documents)
def test_usx_round_trip(source):
    doc = parse(source)
    back = read_usx(writers.to_usx(doc))
    plain = lambda blocks: [b for b in blocks if not (b.kind == "para" and b.marker == "usfm")]
    assert writers.same(plain([writers.normalised(b, doc.sheet) for b in doc.blocks]), plain(back.blocks))
    assert not [d for d in back.diagnostics if d.code.startswith("usx-")]


def test_version_2_files_read_like_version_3():
    import re

    source = BODY + "a \\v 2 b\n\\q1 c\n\\v 3 d\n\\c 2\n\\p\n\\v 1 e"
    full = writers.to_usx(parse(source), vids=False)
    old = re.sub(r'<(?:verse|chapter) eid="[^"]*" />|\s+sid="[^"]*"', "", full)
    assert writers.same(read_usx(full).blocks, read_usx(old).blocks)


USX = {
    "usx-not-well-formed": "<usx><para style='p'>",
    "usx-unknown-element": "<usx><odd/></usx>",
    "usx-unmatched": "<usx><para style='p'><unmatched marker='nd*'/></para></usx>",
    "usx-verse-end-mismatch": "<usx><book code='GEN' style='id'/><chapter number='1'/><para style='p'><verse number='1'/>x<verse eid='GEN 1:2'/></para></usx>",
    "usx-reference-mismatch": "<usx><book code='GEN' style='id'/><chapter number='1' sid='GEN 2'/></usx>",
    "usx-verse-end-missing": "<usx><book code='GEN' style='id'/><chapter number='1'/><para style='p'><verse number='1'/>x</para><chapter eid='GEN 1'/></usx>",
    "content-outside-paragraph": "<usx>text</usx>",
    "missing-note-caller": "<usx><para style='p'><note style='f'>x</note></para></usx>",
    "verse-in-note": "<usx><para style='p'><note style='f' caller='+'><verse number='1'/></note></para></usx>",
    "unknown-marker": "<usx><para style='qqq'>x</para></usx>",
}


@pytest.mark.parametrize("code", USX)
def test_usx_code(code):
    assert code in [d.code for d in read_usx(USX[code]).diagnostics]


def test_every_usx_code_has_a_case():
    assert {c for c, (_, o) in CODES.items() if o == "usx"} <= set(USX)


def test_usx_white_space():
    got = read_usx("<usx>\n  <para style='p'>\n    a  <char style='nd'>b</char> <char style='nd'>c</char>\n  </para>\n</usx>").blocks[0].children
    assert [c.content if c.kind == "text" else c.marker for c in got] == ["a ", "nd", " ", "nd"]


def test_usx_text():
    out = writers.to_usx(parse('\\id GEN a & "b"\n\\usfm 3.1\n\\c 1\n\\p\n\\v 1 x\\w y|z\\w*'))
    assert out.startswith('<usx version="3.1">\n  <book code="GEN" style="id">a &amp; "b"</book>\n')
    assert '<char style="w" lemma="z">y</char><verse eid="GEN 1:1" />' in out
    assert writers.to_sile(parse("\\id GEN\n")) == '<sile>\n  <book code="GEN" style="id" />\n</sile>\n'
    assert writers.escape_value("\t\"'\x01") == "&#9;&quot;&apos;\ufffd"
    hooked = writers.to_usx(parse(BODY + "x"), hooks={"verse_start": lambda w, n: [("mark", [("at", w.reference(n.data["number"]))], [])]})
    assert '<mark at="GEN 1:1" />' in hooked


def test_json():
    out = json.loads(writers.to_json(parse(BODY + 'é\\w a|lemma="b"\\w*')))
    assert list(out) == sorted(out) and out["type"] == "document"
    text, word = out["children"][2]["children"][1:3]
    assert text["content"] == "é" and text["span"][1] - text["span"][0] == 2 and word["attributes"] == [{"name": "lemma", "value": "b"}]
    assert "alt_number" not in out["children"][1]


def test_html():
    out = html.to_html(parse(BODY + "a<b\\f + \\ft n\\f*\\f - \\ft m\\f*\\x c \\xt r\\x*\n\\tr \\thr1-2 q"))
    assert '<span class="c">1</span><span class="v start">1</span>a&lt;b' in out
    assert [x in out for x in ('id="note-1"', 'id="note-c1"', 'id="note-c2"', 'colspan="2"')] == [True] * 4
    pair = html.diglot(parse(BODY + 'One. "Two" three.'), parse(BODY + "x"))
    assert pair.count('<p class="p">') == 5 and '<section class="right">' in pair
    assert html.sections('One. "Two" three.')[0] == "One."


FIXES = [
    ("unknown-marker", BODY + "a \\qqq b", BODY + "a b"),
    ("character-style-not-closed", BODY + "a \\nd b \n\\p c", BODY + "a \\nd b\\nd* \n\\p c"),
    ("missing-note-caller", BODY + "a\\f \\ft b\\f*", BODY + "a\\f + \\ft b\\f*"),
    ("attribute-value-not-quoted", BODY + "\\w a|lemma=b\\w*", BODY + '\\w a|lemma="b"\\w*'),
    ("empty-milestone-attribute-list", BODY + "\\qt-s |\\*x", BODY + "\\qt-s\\*x"),
]


@pytest.mark.parametrize(("code", "source", "fixed"), FIXES)
def test_fix(code, source, fixed):
    out, count = fixes.fix_source(source)
    assert (out, count) == (fixed, 1)
    assert code not in {d.code for d in parse(out).diagnostics}
    assert fixes.fix_source(source, only=("internal",)) == (source, 0)


def test_fixes_that_touch_wait():
    two = [fixes.Fix("a", "", (fixes.Edit(0, 2, "x"),)), fixes.Fix("b", "", (fixes.Edit(2, 3, "y"),)), fixes.Fix("c", "", (fixes.Edit(4, 4, "z"),))]
    assert fixes.apply("abcde", two) == ("xcdze", [0, 2])
    assert fixes.format_source("\\id GEN\n\\c 1\n\\p  a") == "\\id GEN\n\\c 1\n\\p a\n"
    assert fixes.format_source("\\p |") is None and fixes.format_source("\\p |", force=True)


def test_replacements():
    r = Replacements("# c\n\"(a)(b)\" > \"${2}${1}\"\n\"a\" > 'A'\n\"x+\" > \"\\u0041$$\"\nbad\n\"(?=a)b\" > \"no\"")
    assert r.apply("abaxxc") == "baAA$c" and len(r.rules) == 3
    doc = parse("\\id GEN a\n\\rem a\n\\c 1\n\\p a\\f + \\ft a\\f*")
    r.apply_to(doc)
    out = writers.to_markup(doc)
    assert "\\p A\\f" in out and "\\id GEN a" in out
    t = Transliterator({"sh": "š", "s": {"default": "s", "final": "ς", "initial": "S"}, "h": "h"})
    assert t.convert("shs ses sas") == "šς Seς Saς"
