"""Nesting without bound in readers, node columns and writers."""

import pytest
from quillspark.functions import html, usx, writers
from quillspark.functions.parser import ByteOffsets, parse
from quillspark.functions.tree import MAX_DEPTH
from quillspark.sources.markup import NodeColumns


@pytest.mark.parametrize("levels", [50, 1000, 100_000])
def test_deep_styles(levels):
    doc = parse("\\id GEN\n\\c 1\n\\p\n\\v 1 a \\nd b " + "\\+nd x " * levels + "\\+nd*" * levels + "\\nd* end\n\\p after")
    assert [d.code for d in doc.diagnostics] == (["internal"] if levels >= MAX_DEPTH else [])
    for write in (writers.to_markup, writers.to_usx, writers.to_json, writers.to_sile, html.to_html):
        out = write(doc)
        assert out.count("x") >= levels and "after" in out
    columns = NodeColumns()
    columns.add(doc)
    assert max(n["depth"] for n in columns.array()[0].as_py()) <= MAX_DEPTH + 3


@pytest.mark.parametrize("levels", [50, 1000, 100_000])
def test_deep_xml(levels):
    xml = '<usx version="3.0"><book code="GEN" style="id"/><chapter number="1" style="c"/><para style="p">' + '<char style="nd">x' * levels + "</char>" * levels + "</para></usx>"
    doc = usx.read_usx(xml)
    assert [d.code for d in doc.diagnostics] == (["internal"] if levels >= MAX_DEPTH else [])
    assert writers.to_usx(doc).count("x") >= levels and writers.same(doc.blocks, doc.blocks)


def test_byte_offsets():
    text = "aé漢😀z"
    at = ByteOffsets(text)
    want = [len(text[:i].encode()) for i in range(len(text) + 1)]
    assert [at(i) for i in range(len(text) + 1)] == want == at.many(list(range(len(text) + 1)))
    assert ByteOffsets("abc").many([0, 3]) == [0, 3]
