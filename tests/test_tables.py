"""Node tables, checks, index, text, references, glosses, projects, streams in Spark."""

import pytest
from quillspark.functions import interlinear
from quillspark.functions.citations import BookNames, CitationFormat, parse_citations, parse_link
from quillspark.functions.codes import CODES
from quillspark.operators import checks, diagnostics, glosses, index, references, text
from quillspark.plans import render
from quillspark.sources import markup
from quillspark.sources.project import Project, file_number
from quillspark.streaming import watch

from .test_parser import BODY

CHECKS = {
    "unlisted-book-code": "\\id ZZZ\n\\c 1\n\\p",
    "missing-id": "\\c 1\n\\p x",
    "id-not-first": "\\id GEN\n\\c 1\n\\id EXO\n\\c 1\n\\p",
    "empty-book": "\\id GEN a",
    "verse-text-before-chapter": "\\id GEN\n\\p x",
    "verse-outside-chapter": "\\id GEN\n\\ip \\v 1 x",
    "verse-in-heading": "\\id GEN\n\\c 1\n\\s \\v 1 x",
    "verse-in-character-style": BODY + "\\nd \\v 2 x\\nd*",
    "marker-not-allowed-here": BODY + "\\fq x\\fq*",
    "marker-not-listed-here": "\\id GEN\n\\c 1\n\\cl x\\f + \\ft y\\f*",
    "unexpected-table-column": "\\id GEN\n\\c 1\n\\tr \\tc1 a \\tc3 b",
    "empty-word": BODY + '\\w|lemma="x"\\w*',
    "empty-attribute-list": BODY + "\\w x|\\w*",
    "empty-milestone-attribute-list": BODY + "\\qt-s |\\*",
    "no-default-attribute": BODY + "\\nd x|y\\nd*",
    "default-attribute-with-others": BODY + '\\w x|y strong="z"\\w*',
    "malformed-attribute-name": BODY + '\\w x|1y="z"\\w*',
    "duplicate-attribute": BODY + '\\w x|lemma="y" lemma="z"\\w*',
    "duplicate-chapter-number": "\\id GEN\n\\c 1\n\\p\n\\c 1\n\\p",
    "chapter-out-of-order": "\\id GEN\n\\c 2\n\\p\n\\c 1\n\\p",
    "duplicate-verse-number": "\\id GEN\n\\c 1\n\\p\n\\v 2-4 x\n\\v 3a y",
    "verse-out-of-order": "\\id GEN\n\\c 1\n\\p\n\\v 3 x\n\\v 2 y",
    "clean": BODY + "x\n\\v 2a y\n\\v 2b z\n\\v 3-4 q\n\\c 2\n\\p\n\\v 1 r",
}


@pytest.fixture(scope="module")
def found(spark):
    docs = spark.createDataFrame(list(CHECKS.items()), "doc_id string, text string")
    parsed = markup.parsed(docs)
    rows = checks.analyze(markup.nodes(parsed), parsed.select("doc_id", "length")).collect()
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out


@pytest.mark.parametrize("code", [c for c in CHECKS if c != "clean"])
def test_check(found, code):
    hits = [r for r in found[code] if r.code == code]
    assert len(hits) == 1 and hits[0].severity == CODES[code][0]
    assert 0 <= hits[0].span_start <= hits[0].span_end


def test_checks_are_complete_and_quiet(found):
    assert {c for c, (_, o) in CODES.items() if o == "semantic"} == set(CHECKS) - {"clean"}
    assert "clean" not in found
    assert [r.message for r in found["duplicate-verse-number"]] == ["verse 3a again in chapter 1"]


@pytest.fixture(scope="module")
def nodes(spark):
    source = "\\id GEN\n\\h é\n\\c 1\n\\p\n\\v 1 One \\nd Lord\\nd*\\f + \\ft note\\f* said.\n\\v 2 Two\n\\q1 more\n\\c 2\n\\p\n\\v 1-2 Next \\xt Exo 3:4; 5:6\\xt* and \\xt x|link-href=\"LEV 1:1\"\\xt*\n\\p \\k Holy  One\\k* \\w grace|\\w* \\w Holy one\\w*"
    docs = spark.createDataFrame([("a", source), ("b", None), ("c", "")], "doc_id string, text string")
    return markup.nodes(markup.parsed(docs)).cache()


def test_index(nodes):
    got = index.verse_text(nodes).orderBy("seq").collect()
    assert [(r.book, r.chapter, r.number, r.text) for r in got] == [("GEN", 1, "1", "One Lord said."), ("GEN", 1, "2", "Two more"), ("GEN", 2, "1-2", "Next Exo 3:4; 5:6 and x Holy One grace Holy one")]
    assert [(r.number, r.start, r.end) for r in index.chapters(nodes).orderBy("chapter_no").collect()] == [(1, 2, 5), (2, 6, 9)]
    assert index.find_verse(index.verses(nodes), 2, 2).count() == 1


def test_locate_and_symbols(spark, nodes):
    at = nodes.where("content like 'Two%'").first().span_start
    rows = index.locate(nodes, spark.createDataFrame([("a", at), ("a", 10**6)], "doc_id string, offset long")).orderBy("offset").collect()
    assert (rows[0].kind, rows[0].book, rows[0].chapter, rows[0].verse) == ("text", "GEN", "1", "2") and rows[1].seq is None
    names = [(r.kind, r.name) for r in index.symbols(nodes).orderBy("seq").collect()]
    assert names == [("book", "GEN"), ("chapter", "1"), ("verse", "1"), ("verse", "2"), ("chapter", "2"), ("verse", "1-2")]
    assert index.same_tree(nodes, nodes).count() == 0 and index.descendants(nodes, [3]).count() > 3
    offer = index.completions(index.locate(nodes, spark.createDataFrame([("a", at)], "doc_id string, offset long")).selectExpr("doc_id", "offset", "'p' as marker"), checks.placement_table(spark))
    assert offer.where("completion = 'nd'").count() == 1 and offer.where("completion = 'fq'").count() == 0


def test_text(nodes):
    rows = {r.doc_id: r.text for r in text.document_text(nodes, notes=True).collect()}
    assert rows["a"].startswith("é One Lord note said. Two more Next")
    assert text.document_text(nodes, drop_chars=["nd"]).where("text like '%Lord%'").count() == 0


def test_sections_run_on_between_texts(spark):
    docs = spark.createDataFrame([("a", BODY + 'One "two" \\nd x\\nd* three. Four\n\\p Five')], "doc_id string, text string")
    got = [r.section for r in text.document_sections(markup.nodes(markup.parsed(docs))).orderBy("ord").collect()]
    assert got == ["One", '"two"', "three.", "Four", "Five"]


def test_references(nodes):
    rows = references.cross_references(nodes).orderBy("seq", "ord").collect()
    assert [(r.linked, r.book, r.chapter, r.verse) for r in rows] == [(False, "GEN", 5, 6), (True, "LEV", 1, 1)]  # Exo is no code, so 3:4 follows a word
    names = BookNames()
    names.add("Exo", "EXO")
    named = references.cross_references(nodes, names=names).where("not linked").collect()
    assert {r.book for r in named} == {"EXO"}
    entries = references.glossary(nodes)
    words = references.glossary_words(nodes, entries)
    assert {(r.term, r.entry_doc) for r in words.collect()} == {("grace", None), ("Holy one", "a")}
    assert references.unresolved(words).count() == 1


def test_citations():
    n = BookNames(codes=True)
    n.add("Café", "GEN")
    show = lambda t, f=None, b=None: [(c.book, c.start.chapter, c.start.verse, c.start.part, c.end and (c.end.chapter, c.end.verse), t[c.at[0] : c.at[1]]) for c in parse_citations(t, f, n, b)]
    assert show("Cafe\u0301 1:2-3") == [("GEN", 1, 2, None, (1, 3), "Cafe\u0301 1:2-3")]
    assert show("JUD 3, 5a") == [("JUD", 1, 3, None, None, "JUD 3"), ("JUD", 1, 5, "a", None, "5a")]
    assert show("MAT 5; 6:1—7:2") == [("MAT", 5, None, None, None, "MAT 5"), ("MAT", 6, 1, None, (7, 2), "6:1—7:2")]
    assert show("٣:٤", b="EXO") == [("EXO", 3, 4, None, None, "٣:٤")]
    assert show("the 12 tribes", b="EXO") == [] and show("GENx 1") == []
    assert show("MAT 1.2", CitationFormat(chapter_verse=(".", ":")))[0][:3] == ("MAT", 1, 2)
    assert parse_link("gen 1:1, 2") and parse_link("see gen 1:1") is None


def test_diagnostic_algebra(spark):
    docs = spark.createDataFrame([("a", BODY + "é\n𝄞 | b | c"), ("b", BODY + "x")], "doc_id string, text string")
    out = diagnostics.located(render.diagnosed(docs), docs)
    assert [(r.line, r.column) for r in diagnostics.ordered(out).collect()] == [(5, 3), (5, 7)]
    utf16 = docs.where("doc_id = 'a'").join(out.select("doc_id", "span_start"), "doc_id").select(diagnostics.utf16_column(docs.text, out.span_start).alias("u"), diagnostics.line_count(docs.text).alias("n")).orderBy("u").collect()
    assert [(r.u, r.n) for r in utf16] == [(4, 5), (8, 5)]
    assert [r.doc_id for r in diagnostics.accepted(docs, out).collect()] == ["b"]
    rules = diagnostics.read_lint('[lint.rules]\nunexpected-pipe = "info"')
    assert {r.severity for r in diagnostics.apply_lint(out, rules).collect()} == {"info"}
    assert diagnostics.apply_lint(out, {"unexpected-pipe": "off"}).count() == 0
    assert diagnostics.as_text(out).first().value.startswith("a:5:") and '"code":"unexpected-pipe"' in diagnostics.as_json(out).first().value
    assert diagnostics.worst(out).first().worst == 3
    for bad in ("[x]", '[lint.rules]\nno-such = "off"', '[lint.rules]\nunexpected-pipe = "loud"'):
        with pytest.raises(ValueError):
            diagnostics.read_lint(bad)


def test_render(spark, tmp_path):
    docs = spark.createDataFrame([("a", BODY + "x"), ("b", "")], "doc_id string, text string")
    usx = render.render(docs, "usx").withColumnRenamed("value", "text")
    assert {r.doc_id: r.value for r in render.render(usx, "usfm", source="usx").collect()}["a"].endswith("\\v 1 x\n")
    assert render.render(docs, "html", rules='"x" > "y"').where("value like '%</span>y%'").count() == 1
    with pytest.raises(ValueError):
        render.render(docs, "prompt")
    assert render.fixed(spark.createDataFrame([("a", BODY + "\\f x\\f*")], "doc_id string, text string")).count() == 1
    assert render.formatted(docs).where("value is not null").count() == 2
    render.write(render.render(docs, "json"), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").glob("doc_id=*"))) == 2
    weave = spark.createDataFrame([("a", 0, "x", "y")], "doc_id string, ord long, left string, right string")
    assert render.prompts(weave).first().value == '<lang dialect="a">x</lang>\n<lang dialect="b">y</lang>\n\n'
    assert render.render_pairs(spark.createDataFrame([("a", BODY + "x", BODY + "y")], "doc_id string, left string, right string")).first().value.count("<section") == 2
    joined = markup.combined(spark.createDataFrame([("g", 2, "\\p b"), ("g", 1, "\\id GEN")], "g string, n int, text string"), "g", "n")
    assert joined.first().text == "\\id GEN\n\\p b"


XML = """<InterlinearData GlossLanguage="en" BookId="GEN"><Verses>
<item><string>GEN 1:1</string><VerseData/></item>
<item><string>GEN 1:1</string><VerseData Hash="x"><Cluster><Range Index="0" Length="3"/><Lexeme Id="Word:wug" GlossId="s1"/></Cluster>
<Cluster><Range Index="4" Length="3"/><Lexeme Id="Stem:da"/><Lexeme Id="Suffix:x"/></Cluster><Cluster><Range Index="9" Length="1"/><Lexeme Id="Word:zip"/></Cluster></VerseData></item></Verses></InterlinearData>"""
LEXICON = """<Lexicon><Entries><item><Lexeme Type="Word" Form="wug"/><Entry><Sense Id="s0"><Gloss Language="fr">w-fr</Gloss></Sense><Sense Id="s1"><Gloss Language="en">bird</Gloss></Sense></Entry></item>
<item><Lexeme Type="Stem" Form="da"/><Entry><Sense Id="s1"><Gloss Language="EN">give</Gloss></Sense></Entry></item></Entries>
<Analyses><item><string>dax</string><ArrayOfLexeme><Lexeme Type="Stem" Form="da"/></ArrayOfLexeme></item></Analyses></Lexicon>"""


def test_project(spark, tmp_path):
    (tmp_path / "Settings.xml").write_text('<ScriptureText><Name>X</Name><Encoding>65001</Encoding><BooksPresent>11</BooksPresent><ChapterVerseSeparator>.</ChapterVerseSeparator><Naming PrePart="" PostPart="X.SFM" BookNameForm="41MAT"/></ScriptureText>')
    (tmp_path / "BookNames.xml").write_text('<BookNames><book code="GEN" abbr="Gn" short="" long="Genesis"/><book code="bad" abbr="x"/></BookNames>')
    (tmp_path / "01GENX.SFM").write_text("\ufeff\\id GEN\n\\c 1\n\\p\n\\v 1 Wug dax", encoding="utf-8")
    (tmp_path / "custom.sty").write_text("\\Marker zq\n\\StyleType Paragraph\n")
    (tmp_path / "frtbak.sty").write_text("\\Marker zf\n\\StyleType Paragraph\n")
    (tmp_path / "Interlinear_en").mkdir()
    (tmp_path / "Interlinear_en" / "Interlinear_en_GEN.xml").write_text(XML)
    (tmp_path / "Lexicon.xml").write_text(LEXICON)
    p = Project.open(str(tmp_path))
    assert p.settings.books() == ["GEN", "EXO"] and p.names == [("GEN", "Gn", None, "Genesis")] and p.languages() == ["en"]
    assert p.read_book("GEN").startswith("\\id GEN") and p.settings.citation_format().chapter_verse == (".", ":")
    assert "zf" in p.sheet_for("FRT").styles and "zf" not in p.sheet_for("GEN").styles and "zq" in p.sheet_for("GEN").styles
    docs = p.documents(spark)
    assert [(r.doc_id, r.error) for r in docs.collect()] == [("GEN", None)]
    head, verses = p.interlinear("en", "GEN")
    assert head["BookId"] == "GEN" and len(verses) == 1 and verses[0].approved == "x" and verses[0].place == (1, 1)
    table = glosses.verse_table(spark, verses)
    texts = index.verse_text(markup.nodes(markup.parsed(docs))).selectExpr("chapter", "cast(number as long) verse", "text")
    got = {(r.kind, r.cluster, r.start, r.reason) for r in glosses.anchored(table, texts).collect()}
    assert got == {("word", 0, 0, None), ("parse", 1, 1, None), ("dropped", 2, None, "form-mismatch")}
    lexicon = p.lexicon()
    entries, gl = glosses.lexicon_tables(spark, lexicon)
    lexemes = [("Word:wug", "s1"), ("Word:wug", None), ("Stem:da", None), ("Word:none", None), ("Stem:da", "s9"), ("Word:wug", "s0")]
    rows = glosses.glossed(spark.createDataFrame(lexemes, "id string, sense string"), entries, gl, "en").collect()
    assert {(r.id, r.sense): r.gloss for r in rows} == {x: lexicon.gloss(x, "en") for x in lexemes}
    assert lexicon.gloss(("Word:wug", "s1"), "EN") == "bird" and lexicon.analyses == {"dax": [("Stem", "da", 1)]}
    assert [file_number(c) for c in ("GEN", "MAT", "FRT", "LAO", "TST")] == ["01", "41", "A0", "C3", None]
    with pytest.raises(interlinear.ProjectError):
        interlinear.read_lexicon("<Other/>")


def test_anchoring_reserves_words_for_later_clusters():
    c = lambda i, form, kind="Word": interlinear.Cluster(i, len(form), [(f"{kind}:{form}", None)])
    got = interlinear.anchor("wug dax wug", [c(0, "wug"), c(8, "wug"), c(4, "dax wug", "Phrase"), interlinear.Cluster(0, 0, [("bad", None)])])
    assert [w[0] for w in got["words"]] == [0, 2] and got["phrases"] == [(1, 3, 2, False)] and got["dropped"] == [(3, "unparseable")]
    assert interlinear.lexeme_key("Word:a:b:2") == ("Word", "a:b", 2) and interlinear.lexeme_key("nope") is None


def test_watch_replaces_results(spark, tmp_path):
    src, out, check = (tmp_path / n for n in ("src", "out", "check"))
    src.mkdir()
    (src / "a@1.usfm").write_text(BODY + "x | y")
    (src / "b.usfm").write_text(BODY + "|")

    def run():
        watch.watch(watch.versions(spark, f"file://{src}"), render.diagnosed, str(out), str(check)).awaitTermination()
        return {(r.doc_id, r.code) for r in watch.current(spark, str(out)).collect()}

    assert run() == {("a", "unexpected-pipe"), ("b", "unexpected-pipe")}
    (src / "a@2.usfm").write_text(BODY + "x")
    assert run() == {("a", None), ("b", "unexpected-pipe")}
