"""Flat node rows and checks in the walk against the tables of whole documents."""

import random

from quillspark.operators import checks
from quillspark.sources import markup

from .test_parser import PIECES

_MORE = ["\\c 2\n\\p ", "\\v 2-3 ", "\\v 3a ", "\\v 3b-5 ", "\\v 1,4 ", "\\id EXO b\n", "\\w x|\\w*", '\\w a|lemma="x" lemma="y" 1z="q"\\w*', "\\s h \\v 7 ", "\\tr \\tc2 a \\tcr5-6 b\n", "\\w |x\\w*"]


def _texts(n: int) -> list[tuple[str, str]]:
    rnd = random.Random(7)
    return [(f"d{k}", "".join(rnd.choice(PIECES + _MORE) for _ in range(rnd.randrange(60)))) for k in range(n)] + [("e", ""), ("i", "\\id GEN x")]


def test_rows_of_large_documents_come_in_parts(spark, monkeypatch):
    # ROWS nodes a batch, whatever a document holds; a batch had 64 documents, a row a whole one
    docs = spark.createDataFrame([("a", "\\id GEN\n\\c 1\n\\p " + "\\v 1 \\bd x\\bd* y\n" * 9000), *_texts(40)], "doc_id string, text string")
    rows = markup.node_rows(docs)
    assert "nodes" not in rows.columns
    assert rows.count() > 30000
    want = markup.nodes(markup.parsed(docs))
    assert rows.columns == want.columns
    assert rows.exceptAll(want).isEmpty() and want.exceptAll(rows).isEmpty()


def test_parts_hold_their_number_of_nodes():
    from quillspark.functions.parser import parse

    columns, parts = markup.NodeColumns(), []
    for _ in columns.adding(parse("\\id GEN\n\\c 1\n\\p " + "\\v 1 \\bd x\\bd* y\n" * 500), 100):
        parts.append(len(columns.rows))
        columns.clear()
    assert len(parts) > 20 and max(parts) <= 100


def test_checks_in_the_walk_find_what_the_tables_find(spark):
    docs = spark.createDataFrame(_texts(300), "doc_id string, text string").repartition(4).localCheckpoint()
    parsed = markup.parsed(docs)
    of_tables = checks.analyze(markup.nodes(parsed), parsed.select("doc_id", "length"))
    columns = ["doc_id", "span_start", "span_end", "severity", "code", "message", "seq", "pass"]
    a, b = ({tuple(r): n for r, n in _counted(t.select(columns).collect()).items()} for t in (of_tables, checks.of_documents(docs)))
    assert a == b and len({r[4] for r in a}) > 15


def _counted(rows) -> dict:
    out: dict = {}
    for r in rows:
        out[r] = out.get(r, 0) + 1
    return out


def test_walks_give_what_the_tables_give(spark):
    from quillspark.operators import index, references, text

    more = ["Word. \"Quote\" ", " ", " “a” ", "\\p \\k Term \\k* is\n", '\\p \\w x\\+w y\\+w*|lemma="z"\\w* ', "\\xt GEN 1:1\\xt* "]
    rnd = random.Random(11)
    docs = [(f"d{k}", "\\id GEN\n\\c 1\n\\p " * (k % 3 > 0) + "".join(rnd.choice(PIECES + _MORE + more) for _ in range(rnd.randrange(60)))) for k in range(200)] + [("e", "")]
    docs = spark.createDataFrame(docs, "doc_id string, text string").repartition(4).localCheckpoint()
    nodes = markup.nodes(markup.parsed(docs)).localCheckpoint()
    for of_tables, of_walks in (
        (index.verse_text(nodes), index.verse_text_of(docs)), (text.document_text(nodes), text.document_text_of(docs)), (text.document_sections(nodes), text.document_sections_of(docs)),
        *((references.styled_text(nodes, m), references.styled_text_of(docs, m)) for m in ("k", "w", "xt")),
    ):
        a, b = (sorted(map(str, t.select(of_walks.columns).collect())) for t in (of_tables, of_walks))
        assert a == b and a


def test_plain_verses_are_read_as_one_by_one(monkeypatch):
    from quillspark.functions import parser
    from quillspark.functions.writers import same

    rnd = random.Random(3)
    more = ["\\v 3", "\\v 4 \\va 5\\va* ", "\\v 5\n \\vp q\\vp*", "\\v 01 x", "\\v 7a-9b y", "\\v 8/ ", "\\v 9// x ", " \t ", "\\+v 3 ", "\\v  12   z", "\\v 6*x ", "\\v 5,7 w", "\\v* "]
    texts = ["".join(rnd.choice(PIECES + more) for _ in range(rnd.randrange(30))) for _ in range(2000)]
    fast = [parser.parse(t) for t in texts]
    monkeypatch.setattr(parser.Parser, "plain_verses", lambda self, ctx: False)
    for t, a in zip(texts, fast):
        b = parser.parse(t)
        assert same(a.blocks, b.blocks) and a.diagnostics == b.diagnostics, t


def test_texts_are_made_in_parts():
    import pyarrow as pa

    from quillspark.plans import render

    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(40)]), pa.array(["x" * 400_000] * 39 + [None])], names=["doc_id", "text"])
    parts = list(render._in_parts(lambda t: t + "y", "value")(iter([batch])))
    assert len(parts) > 5 and [i for p in parts for i in p.column(0).to_pylist()] == [str(k) for k in range(40)]
    assert [len(v) for p in parts for v in p.column(1).to_pylist()] == [400_001] * 39 + [1]


def test_interlinear_files_are_read_verse_by_verse(monkeypatch):
    from quillspark.functions.interlinear import ProjectError, read_interlinear
    from quillspark.functions.usx import read_xml
    from quillspark.operators import glosses

    item = lambda v, w: f'<item><string>GEN 1:{v}</string><VerseData Hash="h"><Cluster><Range Index="0" Length="1"/><Lexeme Id="Word:{w}"/></Cluster></VerseData></item>'
    xml = "<InterlinearData><Verses>" + "".join(item(v, "a") for v in range(50)) + item(3, "b") + item(60, "c") + "</Verses></InterlinearData>"
    top, _ = read_xml(xml, lambda e, above: e.name == "item")
    assert top.children[0].children == []
    monkeypatch.setattr(glosses, "ROWS", 8)
    parts = glosses._verse_batches("f", xml.encode())
    assert len(parts) > 5  # one batch had a file's verses, and all its elements before
    rows = sorted((r["ord"], r["reference"], r["clusters"][0]["lexemes"][0]["id"]) for p in parts for r in p.to_pylist())
    assert rows == [(i, v.reference, v.clusters[0].lexemes[0][0]) for i, v in enumerate(read_interlinear(xml)[1])] and rows[3][2] == "Word:b" and len(rows) == 51
    for bad in (xml[:-5], xml.replace("InterlinearData", "Other"), xml.replace('Length="1"', 'Length="x"')):
        try:
            assert not glosses._verse_batches("f", bad.encode())
        except ProjectError:
            pass
