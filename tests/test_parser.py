"""The parser: one case for each of its codes, and the rules for text and verse ends."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from quillspark.functions.codes import CODES
from quillspark.functions.parser import ByteOffsets, cell_info, parse, tokens
from quillspark.functions.style import StyleError, base, default_sheet, level, read_sheet

BODY = "\\id GEN\n\\c 1\n\\p\n\\v 1 "

CASES = {
    "unknown-marker": BODY + "a \\qqq b",
    "unknown-custom-marker": BODY + "a \\zmine b",
    "unknown-milestone": BODY + 'a \\mm-s |x="y"\\*',
    "unknown-custom-milestone": BODY + 'a \\zz-s |x="y"\\*',
    "unmatched-closing-marker": BODY + "a \\nd* b",
    "paragraph-marker-closed": BODY + "a \\p* b",
    "unmatched-milestone-end": BODY + "a \\* b",
    "milestone-not-closed": BODY + "\\qt-s said",
    "stray-backslash": BODY + "a \\ b",
    "nested-marker-not-nested": BODY + "a \\+nd b\\+nd*",
    "character-style-not-closed": BODY + "a \\nd b\n\\p c",
    "character-style-implicitly-closed": BODY + "a \\nd b \\bk c\\bk*".replace("\\bk*", ""),
    "character-style-nested-without-plus": BODY + "a \\bk b \\nd c\\nd* d\\bk*",
    "figure-not-closed": BODY + 'a \\fig b|src="c"\n\\p',
    "usfm2-figure": BODY + "\\fig a|b.jpg|col|x|y|cap|1.1\\fig*",
    "note-not-closed": BODY + "a\\f + \\ft b\n\\p",
    "missing-note-caller": BODY + "a\\f \\ft b\\f*",
    "missing-verse-number": "\\id GEN\n\\c 1\n\\p\n\\v \\nd x\\nd*",
    "malformed-verse-number": "\\id GEN\n\\c 1\n\\p\n\\v one x",
    "verse-in-note": BODY + "a\\f + \\ft b \\v 2 c\\f*",
    "missing-chapter-number": "\\id GEN\n\\c\n\\p x",
    "malformed-chapter-number": "\\id GEN\n\\c one\n\\p x",
    "alternate-chapter-not-closed": "\\id GEN\n\\c 1\n\\ca 2\n\\p x",
    "alternate-verse-not-closed": "\\id GEN\n\\c 1\n\\p\n\\v 1 \\va 2 x",
    "missing-book-code": "\\id\n\\c 1",
    "unknown-book-code": "\\id genesis\n\\c 1",
    "sidebar-not-closed": "\\id GEN\n\\c 1\n\\esb\n\\p x",
    "unmatched-sidebar-end": "\\id GEN\n\\c 1\n\\p x\n\\esbe",
    "content-outside-paragraph": "\\id GEN\n\\c 1\n\\nd x\\nd*",
    "expected-table-cell": "\\id GEN\n\\c 1\n\\tr x",
    "unexpected-pipe": BODY + "a | b",
    "unterminated-attribute-value": BODY + '\\w a|lemma="b\\w*',
    "newline-in-attributes": BODY + '\\w a|lemma="b"\nstrong="c"\\w*',
    "attribute-value-not-quoted": BODY + "\\w a|lemma=b\\w*",
    "missing-attribute-value": BODY + "\\w a|lemma=\\w*",
    "number-has-leading-zero": "\\id GEN\n\\c 01\n\\p x",
}


def codes(source, sheet=None):
    return [d.code for d in parse(source, sheet).diagnostics]


@pytest.mark.parametrize("code", CASES)
def test_code(code):
    assert code in codes(CASES[code])


def test_every_parser_code_has_a_case():
    own = {c for c, (_, origin) in CODES.items() if origin == "parser"}
    assert own - set(CASES) == {"content-dropped", "internal"}
    assert "content-dropped" in codes("\\id GEN\n\\c 1\nx", read_sheet("\\Marker id\n\\StyleType Paragraph\n\\Marker c\n\\StyleType Paragraph\n"))
    assert len(CODES) == 66


def test_clean_text_has_no_diagnostics():
    assert codes(BODY + 'In \\nd Lord\\nd* \\w x|lemma="y"\\w*\\f + \\fr 1.1 \\ft n\\f* end\n\\q1 line\n\\v 2-3a more') == []


def kinds(nodes):
    return [(n.kind, n.marker or n.content or n.data.get("number")) for n in nodes]


def test_text_rules():
    doc = parse(BODY + "  a \t\n b~c // d \\\\ \\| \\\"  \n\\p  x ")
    para = doc.blocks[2]
    assert [c.content for c in para.children if c.kind == "text"] == ["a b\u00a0c ", ' d \\ | "']
    assert doc.blocks[3].children[0].content == "x"
    assert parse("\\id GEN\n\\c 1\n\\p a\u3000 b").blocks[2].children[0].content == "a\u3000 b"


def end_of(source):
    """The path of the first verse end."""
    from quillspark.functions.tree import walk

    return next(p for p, n in walk(parse(source).blocks) if n.kind == "verse_end")


def test_verse_ends():
    assert end_of(BODY + "a \\v 2 b") == (2, 2)
    two = parse(BODY + "a \\v 2 b").blocks[2].children
    assert kinds(two) == [("verse_start", "v"), ("text", "a"), ("verse_end", "1"), ("text", " "), ("verse_start", "v"), ("text", "b"), ("verse_end", "2")]
    assert end_of(BODY + "a\n\\p\n\\v 2 b") == (2, 2)
    assert end_of(BODY + "a\n\\s head\n\\p\n\\v 2 b") == (2, 2)
    assert end_of(BODY + "a\n\\esb\n\\p side\n\\esbe\n\\p b") == (4, 1)
    assert end_of(BODY + "a\n\\lit \\v 2 b") == (2, 2)
    assert end_of(BODY + "a \\nd \\v 2 b\\nd*") == (2, 2)
    table = parse("\\id GEN\n\\c 1\n\\tr \\tc1 \\v 1 a \\tc2 \\v 2 b").blocks[2]
    assert kinds(table.children[0].children[0].children)[-1] == ("verse_end", "1")
    assert kinds(parse(BODY + "a\n\\c 2\n\\p b").blocks)[3] == ("chapter_end", "1")
    assert not [n for n in parse(BODY + "a", ends=False).blocks if n.kind == "chapter_end"]


def test_periph_is_a_scope():
    doc = parse(BODY + 'a\n\\periph Title|id="x"\n\\p b\n\\id EXO\n\\c 1\n\\p c')
    assert [b.kind for b in doc.blocks] == ["book", "chapter_start", "para", "chapter_end", "periph", "book", "chapter_start", "para", "chapter_end"]
    division = doc.blocks[4]
    assert division.data["title"] == "Title" and [a[:2] for a in division.attributes] == [("id", "x")]


def test_sidebar_category_and_tables_meet():
    side = parse("\\id GEN\n\\c 1\n\\esb \\cat A  B\\cat*\n\\p x\n\\esbe").blocks[2]
    assert side.data["category"] == "A B" and [c.marker for c in side.children] == ["p"]
    assert [b.kind for b in parse("\\id GEN\n\\c 1\n\\tr \\tc1 a\\c\n\\tr \\tc1 b").blocks].count("table") == 1


def test_published_numbers():
    doc = parse("\\id GEN\n\\c 1 \\ca 2\\ca* \\cp B\n\\p\n\\v 1 \\va 3-4\\va* \\vp 1b\\vp* x")
    assert doc.blocks[1].data["alt_number"] == "2" and doc.blocks[1].data["pub_number"] == "B"
    verse = doc.blocks[2].children[0].data
    assert verse["alt_number"] == "3-4" and verse["pub_number"] == "1b"


@pytest.mark.parametrize(("marker", "info"), [("tc1", (False, "start", 1, 1)), ("thr2", (True, "end", 2, 1)), ("tcc3-5", (False, "center", 3, 3)), ("tc5-3", (False, "start", 5, 1)), ("tc", None), ("tc1-", None), ("tx1", None), ("tc300", None), ("p", None)])
def test_cell_markers(marker, info):
    assert cell_info(marker) == info


PIECES = ["\\p ", "\\v 1 ", "\\v 2\n", "\\c 1\n", "\\nd ", "\\nd*", "\\f + ", "\\f*", "|", '"', "=", "*", "\\*", "\\", "\\+bk ", "\\bk*", "\\tr ", "\\tc1 ", "\\tc2-3 ", "\\esb ", "\\esbe ", '\\periph T|id="x"\n', "\\id GEN a\n", '\\zz-s |a="b"\\*', "\\qt-s ", "word ", "~", "//", "\n", "\\va 3\\va*", "\\vp x\\vp*", "\\cp A\n", "\\cat c\\cat*", "\\fig |a|b|c|d|e|f\\fig*", "é𝄞", "\\usfm 3.0\n", "\\lit "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=25).map("".join))
def test_any_text_parses_and_tokens_tile_it(source):
    assert "".join(source[t[1] : t[2]] for t in tokens(source)) == source
    doc = parse(source)
    at = ByteOffsets(source)
    for d in doc.diagnostics:
        assert 0 <= d.start <= d.end <= len(source)
        assert len(source[: d.start].encode()) == at(d.start)


def test_sheets():
    sheet = default_sheet()
    assert sheet.get("w").default_attribute == "lemma" and sheet.get("fig").default_attribute is None and sheet.get("qt-e").kind == "milestone"
    mine = sheet.with_text("\ufeff\\Marker zgrk\n\\StyleType Character\n#!\\Attributes a ?b\n\\Marker p\n\\TextType Other\n\\Marker zm-s\n\\StyleType Milestone\n")
    assert mine.get("zgrk").default_attribute == "a" and mine.get("p").text == "other" and mine.get("p").parents == sheet.get("p").parents
    assert mine.get("zm-e").kind == "milestone" and "zgrk" not in sheet.styles
    for bad in ("\\Marker x\n\\Name y\n", "\\Marker x\n\\StyleType Odd\n", "\\Marker x\n\\StyleType Note\n\\TextProperties odd\n"):
        with pytest.raises(StyleError):
            read_sheet(bad)
    assert (base("qt2-s"), level("qt2-s"), level("qt")) == ("qt", 2, None)
