"""Converters, the command surface, hover, and independence from the corpus operators."""

import subprocess
import sys
from pathlib import Path

import pytest
from quillspark import cli
from quillspark.functions.parser import parse
from quillspark.functions.style import sheet_table
from quillspark.operators import index
from quillspark.sources import convert, markup

from .test_parser import BODY

USFX = """<usfx><book id="TIT"><id id="TIT">Titus</id><h>Titus</h><toc level="1">Letter</toc><toc level="4">x</toc><c id="1"/><p sfm="mt" level="1">T</p>
<p><v id="1"/>Paul,<f caller="+"><fr>1:1 </fr>a note<ref tgt="x"> here</ref></f> a <bk>book</bk><ve/></p><q level="2">line</q><b/></book></usfx>"""


def test_usfx():
    text = convert.usfx_books(USFX)["TIT"]
    assert text == "\\id TIT Titus\n\\h Titus\n\\toc1 Letter\n\\c 1\n\\mt1 T\n\\p \\v 1 Paul,\\f + \\fr 1:1 \\ft a note here\\f* a \\bk book\\bk*\n\\q2 line\n\\b\n"
    assert not parse(text).diagnostics
    with pytest.raises(convert.UnsupportedElement):
        convert.usfx_books('<usfx><book id="TIT"><odd/></book></usfx>')


def test_column_converters(spark):
    df = spark.createDataFrame([('\\zaln-s | x-strong="H1"\n\\w a\\w*\n\\zaln-e\\*',)], "t string")
    assert df.select(convert.close_milestones(df.t)).first()[0].startswith('\\zaln-s | x-strong="H1"\\*\n')
    words = spark.createDataFrame([("The end",)], "t string")
    out = words.select(convert.with_lemmas(words.t)).first()[0]
    assert out.startswith('\\w The|lemma="the" strong="H') and not parse(BODY + out).diagnostics


def test_hover(spark):
    docs = spark.createDataFrame([("a", BODY + "x \\nd y\\nd*"), ("b", "\\id GEN Title\n\\ip x")], "doc_id string, text string")
    nodes = markup.nodes(markup.parsed(docs))
    text = BODY + "x \\nd y\\nd*"
    asked = spark.createDataFrame([("a", text.index("x")), ("a", text.index("nd")), ("b", 1), ("b", 18)], "doc_id string, offset long")
    rows = {(r.doc_id, r.offset): r for r in index.hover(index.locate(nodes, asked), nodes, sheet_table(spark)).collect()}
    assert rows["a", text.index("x")].label == "GEN 1:1"
    assert rows["a", text.index("nd")].label == "\\nd" and "p" in rows["a", text.index("nd")].parents
    assert rows["b", 1].label == "GEN — Title" and rows["b", 18].label == "\\ip"


def test_commands(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "a.usfm").write_text(BODY + "a | b")
    (tmp_path / "usfm.toml").write_text('[lint.rules]\nunexpected-pipe = "warning"\n')
    monkeypatch.chdir(tmp_path)
    assert cli.find_lint(tmp_path / "x" / "y") == tmp_path / "usfm.toml"
    assert cli.main(["parse", f"{tmp_path}/a.usfm", "-f", "usfm", "--strict"], spark) == 0
    assert "warning[unexpected-pipe]" in capsys.readouterr().out
    assert cli.main(["parse", f"{tmp_path}/a.usfm", "--deny-warnings", "-o", f"{tmp_path}/out"], spark) == 1
    assert cli.main(["format", f"{tmp_path}/a.usfm", "--check"], spark) == 1
    (tmp_path / "b.usfm").write_text(BODY + "\\f x\\f*")
    assert cli.main(["fix", f"{tmp_path}/b.usfm", "--code", "missing-note-caller"], spark) == 0
    assert cli.main(["fix", f"{tmp_path}/b.usfm", "-o", f"{tmp_path}/fixed"], spark) == 0
    assert list((tmp_path / "fixed").rglob("part-*"))


def test_entry_works_without_corpus_operators(tmp_path):
    """The rest imports and lists its queries when the subpackage is taken away."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import sys
sys.path.insert(0, {str(root)!r})
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name == "quillspark.llm" or name.startswith("quillspark.llm."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert e.queries() and set(e.oracle_sql()) <= set(e.queries())
assert not any(q.startswith("op") or q == "pipeline" for q in e.queries())
"""
    subprocess.run([sys.executable, "-c", code], check=True, cwd=tmp_path)


def test_appended_documents(spark):
    docs = spark.createDataFrame([("b", "\\id EXO\n\\c 1\n\\p\n\\v 1 second"), ("a", BODY + "first")], "doc_id string, text string")
    groups = spark.createDataFrame([("a", "g", 1), ("b", "g", 2)], "doc_id string, group string, ord int")
    nodes = markup.appended(markup.nodes(markup.parsed(docs)), groups)
    assert [r.path[0] for r in nodes.where("depth = 1").orderBy("seq").collect()] == list(range(8))
    got = index.verse_text(nodes.drop("file")).orderBy("seq").collect()
    assert [(r.doc_id, r.text) for r in got] == [("g", "first"), ("g", "second")]
