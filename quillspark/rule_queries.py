"""Registered queries over rules that the plain queries don't reach, with their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import html, replacements, writers
from .functions.citations import BookNames
from .functions.codes import code_table
from .functions.parser import parse
from .operators import checks, diagnostics, glosses, index, references, text
from .plans import render
from .queries import _LINES, _stored_nodes, _table, _term_documents, order_documents, verse_documents
from .sources import markup



def _id() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


def _values(rows) -> str:
    """Rows as a VALUES list of SQL."""
    show = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


def _chosen(key, options: list) -> Column:
    """The option whose number is ``key``."""
    out = F.when(key == 0, options[0])
    for k, o in enumerate(options[1:], 1):
        out = out.when(key == k, o)
    return out


# -- parser ----------------------------------------------------------------

_PIECES = [
    ("\\c 2 \\ca 3\\ca*\n\\cp B\n\\p\n\\v 1 \\va 7\\va* \\vp 1b\\vp* t", [("chapter_start", "c", "3|B", ""), ("verse_start", "v", "7|1b", "")]),
    ("\\esb \\cat People\\cat*\n\\p side\n\\esbe\n\\p after", [("sidebar", "esb", "People", "")]),
    ('\\periph Title Page|id="title"\n\\p inside', [("periph", "periph", "Title Page", "id=title")]),
    ('\\p a \\qt-s |sid="q1" who="Al"\\* b \\qt-e |eid="q1"\\*', [("milestone", "qt-s", "", "sid=q1;who=Al"), ("milestone", "qt-e", "", "eid=q1")]),
    ("\\p \\bd a \\+nd b\\+nd* c\\bd*", [("char", "bd", "", ""), ("char", "nd", "", "")]),
    ("\\p a \\f + \\cat X\\cat* \\fr 1:1 \\ft note\\f* b", [("note", "f", "+|X", ""), ("char", "fr", "", ""), ("char", "ft", "", "")]),
    ('\\p a \\fig cap|src="a.jpg" size="col"\\fig*', [("char", "fig", "", "src=a.jpg;size=col")]),
    ("\\p a \\fig desc|f.jpg|col|loc|copy|cap|1.1\\fig* b", [("char", "fig", "", "alt=desc;src=f.jpg;size=col;loc=loc;copy=copy;ref=1.1")]),
    ("\\p x \\zms\\* y", [("milestone", "zms", "", "")]),
    ("\\usfm 3.1\n\\p x", [("para", "usfm", "", "")]),
    ("\\tr \\th1 H\\thr2 R\n\\tr \\tc1-2 a", [("table", "", "", ""), ("row", "tr", "", ""), ("row", "tr", "", ""), ("cell", "", "start|1|1|true", ""), ("cell", "", "end|2|1|true", ""), ("cell", "", "start|1|2|false", "")]),
]


def constructs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the parser makes of one construct after the whole text of each document."""
    piece = _chosen(F.col("doc_id").cast("long") % len(_PIECES), [F.lit(p) for p, _ in _PIECES])
    docs = verse_documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit("\n"), piece).alias("text"))
    fields = ("kind", "marker", "number", "alt_number", "pub_number", "caller", "category", "title", "alignment", "col", "colspan", "header", "attributes")
    nodes = markup.node_rows(docs, fields=fields)
    own = nodes.where("kind in ('sidebar', 'periph', 'milestone', 'char', 'note', 'table', 'row', 'cell') or marker = 'usfm' or alt_number is not null")
    detail = F.concat_ws("|", "alt_number", "pub_number", "caller", "category", "title", "alignment", "col", "colspan", F.col("header").cast("string"))
    pairs = F.array_join(F.transform("attributes", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ";")
    rows = own.select(_id(), "kind", F.coalesce("marker", F.lit("")).alias("marker"), detail.alias("detail"), F.coalesce(pairs, F.lit("")).alias("pairs"))
    return rows.groupBy("doc_id", "kind", "marker", "detail", "pairs").agg(F.count(F.lit(1)).alias("n"))


CONSTRUCTS = f"""
SELECT doc_id, kind, marker, detail, pairs, count(*)::BIGINT AS n FROM documents
JOIN (VALUES {_values((k, *r) for k, (_, rows) in enumerate(_PIECES) for r in rows)}) AS x(k, kind, marker, detail, pairs) ON doc_id % {len(_PIECES)} = k GROUP BY ALL
"""

# -- checks ----------------------------------------------------------------

#: (before the verses, after them, [(code, severity)]) around the whole text.
_FAULTS = [
    ("\\id QQQ x\n\\c 1\n\\p\n", "", [("unlisted-book-code", "warning")]),
    ("\\c 1\n\\p\n", "", [("missing-id", "error")]),
    ("\\id XXA x\n\\c 1\n\\p\n", "\n\\id GEN y", [("id-not-first", "error")]),
    ("\\id GEN x\n\\p intro\n\\c 1\n\\p\n", "", [("verse-text-before-chapter", "error")]),
    ("\\id XXA x\n\\c 1\n\\p\n", "\n\\s a \\v 9000000 b", [("verse-in-heading", "error")]),
    ("\\id XXA x\n\\c 1\n\\p\n", "\n\\p \\bd \\v 9000000 x\\bd*", [("verse-in-character-style", "warning")]),
    ("\\id XXA x\n\\c 1\n\\p\n", "\n\\p \\ft x\\ft*", [("marker-not-allowed-here", "error")]),
    ("\\id XXA x\n\\c 1\n\\p\n", "\n\\s \\va x\\va*", [("marker-not-listed-here", "info")]),
    ("\\id XXA x\n\\c 1\n\\p\n", "\n\\p x \\qt-s |\\* y", [("empty-milestone-attribute-list", "warning")]),
    ("\\id XXA x\n\\p\n", "", [("verse-outside-chapter", "error")]),
]


def faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the checks in whole texts with one fault each; every twelfth is an \\id only."""
    docs = _table(spark, sf_dir, "documents")
    lines = F.array_join(F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("\\v "), i + 1, F.lit(" "), x)), "\n")
    k = F.col("doc_id") % 12
    options = [F.concat(F.lit(a), lines, F.lit(b)) for a, b, _ in _FAULTS] + [F.lit("\\id XXA x"), F.concat(F.lit("\\id XXA x\n\\c 1\n\\p\n"), lines)]
    given = docs.select(F.col("doc_id").cast("string").alias("doc_id"), _chosen(k, options).alias("text"))
    found = checks.of_documents(given)
    return found.groupBy(_id(), "code", "severity").agg(F.count(F.lit(1)).alias("n"))


FAULTS = f"""
WITH l AS (SELECT doc_id, len(string_split(text, chr(10))) AS lines FROM documents)
SELECT doc_id, code, severity, CASE WHEN code = 'verse-outside-chapter' THEN lines ELSE 1 END::BIGINT AS n FROM l
JOIN (VALUES {_values([(k, c, s) for k, (_, _, found) in enumerate(_FAULTS) for c, s in found] + [(10, "empty-book", "error")])}) AS x(k, code, severity) ON doc_id % 12 = k
"""

# -- diagnostics -----------------------------------------------------------


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Worst diagnostic of each document before and after lint levels, whether it is accepted at
    each threshold afterwards, and where the codes come from."""
    docs = verse_documents(spark, sf_dir).select("doc_id", F.concat("text", F.lit("\n\\p x \\zms\\* y")).alias("text"))
    parsed = markup.stored(markup.parsed(docs, fields=()))
    found = markup.parser_diagnostics(parsed).join(F.broadcast(code_table(spark).select("code", "origin")), "code")
    after = diagnostics.apply_lint(found, diagnostics.read_lint('[lint.rules]\nunexpected-pipe = "warning"\nunknown-custom-milestone = "off"'))
    out = docs.select("doc_id").join(diagnostics.worst(found).select("doc_id", F.col("worst").alias("before"), "n"), "doc_id", "left")
    out = out.join(diagnostics.worst(after).select("doc_id", F.col("worst").alias("after")), "doc_id", "left")
    for level in ("error", "warning"):
        out = out.join(diagnostics.accepted(docs, after, level).select("doc_id", F.lit(True).alias(f"at_{level}")), "doc_id", "left")
    parsers = found.where("origin = 'parser'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("of_parser"))
    return out.join(parsers, "doc_id", "left").select(_id(), F.col("before").cast("long").alias("before"), "n", F.coalesce("after", F.lit(0)).cast("long").alias("after"), F.coalesce("at_error", F.lit(False)).alias("at_error"), F.coalesce("at_warning", F.lit(False)).alias("at_warning"), "of_parser")


POLICY = """
WITH p AS (SELECT doc_id, length(text) - length(replace(text, '|', '')) AS k FROM documents)
SELECT doc_id, CASE WHEN k > 0 THEN 3 ELSE 1 END::BIGINT AS before, (k + 1)::BIGINT AS n, CASE WHEN k > 0 THEN 2 ELSE 0 END::BIGINT AS after, true AS at_error, k = 0 AS at_warning, (k + 1)::BIGINT AS of_parser FROM p
"""


def reported(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics as lines of text and of JSON, numbered in their order."""
    docs = verse_documents(spark, sf_dir).select(F.concat("doc_id", F.lit('"x')).alias("doc_id"), "text")
    found = markup.stored(diagnostics.located(markup.parser_diagnostics(markup.parsed(docs, fields=())), docs))
    both = diagnostics.as_text(found).withColumnRenamed("value", "as_text").join(diagnostics.as_json(found).withColumnRenamed("value", "as_json"), ["doc_id", "span_start", "pass", "seq"])
    return both.select(F.expr("cast(split(doc_id, '\"')[0] as bigint)").alias("doc_id"), "as_text", "as_json")


REPORTED = f"""
WITH l AS ({_LINES}), p AS (SELECT doc_id, n, '\\v ' || n || ' ' || line AS s FROM l),
b AS (SELECT *, 24 + coalesce(sum(strlen(s) + 1) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM p),
c AS (SELECT doc_id, n, s, pos, unnest(range(1, length(s) + 1)) AS k FROM b WHERE s LIKE '%|%'),
f AS (SELECT doc_id, n + 3 AS line, k, (pos + strlen(substr(s, 1, k - 1)))::BIGINT AS a FROM c WHERE substr(s, k, 1) = '|')
SELECT doc_id, doc_id || '"x:' || line || ':' || k || ': error[unexpected-pipe]: | is text outside a character style' AS as_text,
  '{{"file":"' || doc_id || '\\"x","line":' || line || ',"column":' || k || ',"severity":"error","code":"unexpected-pipe","message":"| is text outside a character style","start":' || a || ',"end":' || (a + 1) || '}}' AS as_json FROM f
"""


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, column, UTF-16 column and number of lines at the middle of every text."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("\U0001f600"), "text").alias("text"))
    t = F.col("text")
    at = F.octet_length(F.expr("substring(text, 1, cast(length(text) div 2 as int))"))
    return docs.select("doc_id", diagnostics.line(t, at).cast("long").alias("line"), diagnostics.column(t, at).cast("long").alias("col"), diagnostics.utf16_column(t, at).cast("long").alias("col16"), diagnostics.line_count(t).cast("long").alias("lines"))


PLACES = """
WITH t AS (SELECT doc_id, chr(128512) || text AS t FROM documents), p AS (SELECT doc_id, t, substr(t, 1, length(t) // 2) AS p FROM t),
l AS (SELECT *, list_extract(string_split(p, chr(10)), -1) AS tail FROM p)
SELECT doc_id, len(string_split(p, chr(10)))::BIGINT AS line, (length(tail) + 1)::BIGINT AS col,
  (length(tail) + 1 + CASE WHEN tail LIKE chr(128512) || '%' THEN 1 ELSE 0 END)::BIGINT AS col16,
  (length(t) - length(replace(t, chr(10), '')) + CASE WHEN t LIKE '%' || chr(10) THEN 0 ELSE 1 END)::BIGINT AS lines FROM l
"""

# -- writers ---------------------------------------------------------------


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document as markup, XML for exchange and typesetting, and HTML."""
    forms = (writers.to_markup, writers.to_usx, writers.to_sile, html.to_html)

    def digests(t: str) -> str:
        doc = parse(t)
        return " ".join(hashlib.sha256(f(doc).encode()).hexdigest() for f in forms)

    got = render.per_text(verse_documents(spark, sf_dir), digests)
    parts = F.split("value", " ")
    return got.select(_id(), *(parts[k].alias(c) for k, c in enumerate(("usfm", "usx", "sile", "html"))))


_ESCAPED = "replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
_GAP = "CASE WHEN t <> '' AND NOT last THEN ' ' ELSE '' END"
_XML = "E'\\n  <book code=\"XXA\" style=\"id\">wrapped</book>\\n  <chapter number=\"1\" style=\"c\" sid=\"XXA 1\" />\\n  <para style=\"p\">' || x || E'</para>\\n  <chapter eid=\"XXA 1\" />\\n'"
WRITTEN = f"""
WITH l AS ({_LINES}), v AS (SELECT doc_id, n, trim(regexp_replace(line, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS t, n = max(n) OVER (PARTITION BY doc_id) AS last FROM l),
d AS (SELECT doc_id, string_agg('\\v ' || n || ' ' || replace(t, '|', '\\|') || {_GAP}, '' ORDER BY n) AS m,
  string_agg('<verse number="' || n || '" style="v" sid="XXA 1:' || n || '" />' || {_ESCAPED} || '<verse eid="XXA 1:' || n || '" />' || {_GAP}, '' ORDER BY n) AS x,
  string_agg('<span class="v start">' || n || '</span>' || {_ESCAPED} || '<span class="v end">' || n || '</span>' || {_GAP}, '' ORDER BY n) AS h FROM v GROUP BY 1)
SELECT doc_id, sha256(E'\\\\id XXA wrapped\\n\\\\c 1\\n\\\\p ' || m || E'\\n') AS usfm, sha256('<usx version="3.0">' || {_XML} || E'</usx>\\n') AS usx, sha256('<sile>' || {_XML} || E'</sile>\\n') AS sile,
  sha256(E'<div class="id" data-code="XXA">wrapped</div><p class="p">\\n  <span class="c">1</span>' || h || E'\\n</p>\\n') AS html FROM d
"""

# -- text ------------------------------------------------------------------


def paragraph_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of documents whose lines are paragraphs, with a note that belongs to none."""
    lines = F.transform(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), lambda x: F.concat(F.lit("\\p "), x, F.lit("\\f + \\ft A note. More.\\f*")))
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("\\id XXA x\n\\c 1\n"), F.array_join(lines, "\n")).alias("text"))
    return text.document_sections_of(docs).select(_id(), "ord", "section")


def _paragraph_sections_sql() -> str:
    from .queries import _CUT

    cut = _CUT.format(t="t")
    return f"""
WITH l AS ({_LINES}), t AS (SELECT doc_id, n, trim(regexp_replace(line, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS t FROM l),
s AS (SELECT doc_id, n, list_filter(list_transform({cut}, lambda x: trim(x)), lambda x: x <> '') AS s FROM t WHERE t <> ''),
u AS (SELECT doc_id, n, unnest(range(0, len(s))) AS k, unnest(s) AS section FROM s)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n, k) - 1)::BIGINT AS ord, section FROM u
"""


TRANSLITERATION = {"sh": "ʃ", "a": {"initial": "A", "final": "ɐ", "default": "a"}, "e": "ɛ", "ee": "i"}


def transliterated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names in another spelling, longest match first."""
    t = replacements.Transliterator(TRANSLITERATION)
    part = _table(spark, sf_dir, "part")
    got = render.per_text(part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")), t.convert)
    return got.select(F.col("doc_id").cast("long").alias("p_partkey"), "value")


TRANSLITERATED = """
WITH w AS (SELECT p_partkey, regexp_replace(regexp_replace(p_name, '\\ba\\b', 'a', 'g'), '\\ba(\\w)', 'A\\1', 'g') AS t FROM part),
f AS (SELECT p_partkey, regexp_replace(t, '(\\w)a\\b', '\\1ɐ', 'g') AS t FROM w)
SELECT p_partkey, replace(replace(replace(t, 'sh', 'ʃ'), 'ee', 'i'), 'e', 'ɛ') AS value FROM f
"""

# -- index -----------------------------------------------------------------


def chapter_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of the order documents: number, blocks, and the chapter found for its second
    block, which is the paragraph, and for the verses in it."""
    nodes = _stored_nodes(order_documents(spark, sf_dir), index.CHAPTER_FIELDS)
    found = index.chapters(nodes)
    paras = nodes.where("kind = 'para'").select("doc_id", "path")
    held = index.chapter_holding(nodes, paras).select("doc_id", (F.col("path")[0] - 1).alias("start"), F.col("number").alias("held"))
    inside = index.verse_nodes(nodes).groupBy("doc_id", "verse_seq").agg(F.count(F.lit(1)).alias("k"))
    verse = index.verses(nodes).join(inside.withColumnRenamed("verse_seq", "seq"), ["doc_id", "seq"]).select("doc_id", (F.col("start")[0] - 1).alias("start"), "k")
    verses = verse.groupBy("doc_id", "start").agg(F.count(F.lit(1)).alias("verses"), F.sum("k").alias("verse_nodes"))
    out = found.join(held, ["doc_id", "start"]).join(verses, ["doc_id", "start"])
    return out.select(_id(), F.col("chapter_no").cast("long").alias("chapter_no"), "number", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "held", "verses", "verse_nodes")


_ORDERED = "SELECT l_suppkey AS doc_id, l_orderkey % 40 + 1 AS c, l_linenumber AS v1, l_partkey % 5 + 1 AS v2, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k FROM lineitem"
CHAPTER_TABLE = f"""
SELECT doc_id, k::BIGINT AS chapter_no, c::BIGINT AS number, (3 * k - 2)::BIGINT AS start, (3 * k)::BIGINT AS "end", c::BIGINT AS held, 2::BIGINT AS verses, 4::BIGINT AS verse_nodes FROM ({_ORDERED})
"""


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first chapter 7 of each document, and the first verse 3 in a chapter 7."""
    nodes = _stored_nodes(order_documents(spark, sf_dir), index.CHAPTER_FIELDS)
    chapter = index.find_chapter(index.chapters(nodes), 7).select("doc_id", "chapter_no")
    verse = index.find_verse(index.verses(nodes), 7, 3).select("doc_id", (F.col("start")[0] - 1).cast("long").alias("verse_block"))
    return chapter.join(verse, "doc_id", "full").select(_id(), F.col("chapter_no").cast("long").alias("chapter_no"), "verse_block")


LOOKED_UP = f"""
WITH r AS ({_ORDERED}) SELECT doc_id, min(k) FILTER (c = 7)::BIGINT AS chapter_no, min(3 * k - 2) FILTER (c = 7 AND (v1 = 3 OR v2 = 3))::BIGINT AS verse_block FROM r GROUP BY 1 HAVING count(*) FILTER (c = 7) > 0
"""


def cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of every block of the order documents: what stands beside and below it."""
    nodes = _stored_nodes(order_documents(spark, sf_dir), index.TREE_FIELDS)
    kinds = nodes.select("doc_id", "seq", "kind", "depth")
    of = lambda c: kinds.select("doc_id", F.col("seq").alias(c), F.col("kind").alias(f"{c}_kind"))
    rows = index.neighbours(nodes).join(kinds, ["doc_id", "seq"]).where("depth = 1 or depth = 2")
    for c in ("parent", "previous", "next", "first_child", "last_child"):
        rows = rows.join(of(c), ["doc_id", c], "left")
    named = [F.coalesce(f"{c}_kind", F.lit("-")).alias(c) for c in ("parent", "previous", "next", "first_child", "last_child")]
    return rows.select("kind", *named).groupBy("kind", "parent", "previous", "next", "first_child", "last_child").agg(F.count(F.lit(1)).alias("n"))


CURSOR = """
WITH d AS (SELECT count(*) AS c, count(DISTINCT l_suppkey) AS d FROM lineitem)
SELECT kind, parent, previous, "next", first_child, last_child, n::BIGINT AS n FROM (
  SELECT 'book' AS kind, '-' AS parent, '-' AS previous, 'chapter_start' AS "next", '-' AS first_child, '-' AS last_child, d AS n FROM d
  UNION ALL SELECT 'chapter_start', '-', 'book', 'para', '-', '-', d FROM d UNION ALL SELECT 'chapter_start', '-', 'chapter_end', 'para', '-', '-', c - d FROM d
  UNION ALL SELECT 'para', '-', 'chapter_start', 'chapter_end', 'verse_start', 'verse_end', c FROM d
  UNION ALL SELECT 'chapter_end', '-', 'para', 'chapter_start', '-', '-', c - d FROM d UNION ALL SELECT 'chapter_end', '-', 'para', '-', '-', '-', d FROM d
  UNION ALL SELECT 'verse_start', 'para', '-', 'text', '-', '-', c FROM d UNION ALL SELECT 'verse_start', 'para', 'text', 'text', '-', '-', c FROM d
  UNION ALL SELECT 'text', 'para', 'verse_start', 'verse_end', '-', '-', 2 * c FROM d UNION ALL SELECT 'text', 'para', 'verse_end', 'verse_start', '-', '-', c FROM d
  UNION ALL SELECT 'verse_end', 'para', 'text', 'text', '-', '-', c FROM d UNION ALL SELECT 'verse_end', 'para', 'text', '-', '-', '-', c FROM d)
WHERE n > 0
"""


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that a document states, in every third of them."""
    docs = verse_documents(spark, sf_dir)
    line = F.when(F.col("doc_id").cast("long") % 3 == 0, F.concat(F.lit("\n\\usfm  3."), F.col("doc_id").cast("long") % 7, F.lit(" \n\\p x"))).otherwise("")
    nodes = markup.node_rows(docs.select("doc_id", F.concat("text", line).alias("text")), fields=("seq", "path", "depth", "kind", "marker", "content"))
    return index.usfm_versions(markup.stored(nodes)).select(_id(), "version")


VERSIONS = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '3.' || (doc_id % 7) END AS version FROM documents"

# -- references ------------------------------------------------------------


def citation_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations whose book has other accents, other digits, a number of its own, or a link."""
    k, c, v = F.col("o_orderkey") % 4, F.col("o_orderkey") % 50 + 1, F.col("o_orderkey") % 30 + 1
    arabic = lambda n: F.translate(n.cast("string"), "0123456789", "٠١٢٣٤٥٦٧٨٩")
    forms = [F.concat(F.lit("Ge\u0301nesis "), c, F.lit(":"), v), F.concat(F.lit("GEN "), arabic(c), F.lit(":"), arabic(v)), F.concat(F.lit("1 Samuel "), c, F.lit(":"), v, F.lit("a")), F.concat(F.lit('here|link-href="EXO '), c, F.lit(":"), v, F.lit('"'))]
    xt = F.concat(F.lit("\\xt "), _chosen(k, forms), F.lit("\\xt*"))
    docs = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", xt.alias("x")))).alias("xs"))
    docs = docs.select(F.col("o_custkey").cast("string").alias("doc_id"), F.concat(F.lit("\\id EXO\n\\c 1\n\\p "), F.array_join(F.transform("xs", lambda x: x["x"]), " ")).alias("text"))
    names = BookNames(codes=True)
    names.add("G\u00e9nesis", "GEN")
    names.add("1 Samuel", "1SA")
    found = references.citations(references.styled_text_of(docs, "xt"), names=names)
    return found.groupBy(_id(), "book", "chapter", "verse", F.coalesce("part", F.lit("")).alias("part"), "linked").agg(F.count(F.lit(1)).alias("n"))


CITATION_FORMS = """
SELECT o_custkey AS doc_id, ['GEN', 'GEN', '1SA', 'EXO'][o_orderkey % 4 + 1] AS book, o_orderkey % 50 + 1 AS chapter, o_orderkey % 30 + 1 AS verse,
  CASE WHEN o_orderkey % 4 = 2 THEN 'a' ELSE '' END AS part, o_orderkey % 4 = 3 AS linked, count(*)::BIGINT AS n FROM orders GROUP BY ALL
"""


def unresolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words without an entry in the glossaries."""
    entry_docs, word_docs = _term_documents(spark, sf_dir)
    words = references.unresolved(references.resolved(references.styled_text_of(word_docs, "w"), references.entries(references.styled_text_of(entry_docs, "k"))))
    return words.groupBy(_id(), "normal").agg(F.count(F.lit(1)).alias("n"))


UNRESOLVED = """
SELECT p_size::BIGINT AS doc_id, lower(trim(p_type)) AS normal, count(*)::BIGINT AS n FROM part
WHERE p_partkey % 3 = 2 AND lower(trim(p_type)) NOT IN (SELECT lower(trim(p_name)) FROM part) GROUP BY ALL
"""

# -- interlinear -----------------------------------------------------------


def _interlinear_documents(spark, sf_dir) -> DataFrame:
    """One interlinear file a brand: for each part a verse whose two words have a cluster each,
    three places too far right, and a cluster for a word that isn't there."""
    part = _table(spark, sf_dir, "part")
    a, b = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    cluster = lambda at, w, s: F.concat(F.lit('<Cluster><Range Index="'), at, F.lit('" Length="'), F.length(w), F.lit('"/><Lexeme Id="Word:'), w, F.lit('" GlossId="'), s, F.lit('"/></Cluster>'))
    item = F.concat(F.lit("<item><string>GEN "), F.col("p_size"), F.lit(":"), F.col("p_partkey"), F.lit('</string><VerseData Hash="h">'), cluster(F.lit(3), a, F.lit("s1")), cluster(F.length(a) + 4, b, F.lit("")), cluster(F.lit(90), F.lit("qqq"), F.lit("s2")), F.lit("</VerseData></item>"))
    docs = part.groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", item.alias("i")))).alias("xs"))
    return docs.select(F.col("p_brand").alias("doc_id"), F.concat(F.lit('<InterlinearData GlossLanguage="en" BookId="GEN"><Verses>'), F.array_join(F.transform("xs", lambda x: x["i"]), ""), F.lit("</Verses></InterlinearData>")).alias("text"))


def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which word of its verse each cluster glosses."""
    verses = glosses.read_verses(_interlinear_documents(spark, sf_dir))
    texts = _table(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("chapter"), F.col("p_partkey").alias("verse"), F.col("p_name").alias("text"))
    return glosses.anchored(verses, texts).select("chapter", "verse", "kind", F.col("cluster").cast("long").alias("cluster"), F.col("start").cast("long").alias("start"), "ambiguous")


ANCHORED = """
SELECT p_size::BIGINT AS chapter, p_partkey AS verse, kind, cluster::BIGINT AS cluster, start::BIGINT AS start, ambiguous FROM part
JOIN (VALUES ('word', 0, 0, false), ('word', 1, 1, false), ('dropped', 2, NULL, NULL)) AS x(kind, cluster, start, ambiguous) ON true
"""


def glossed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glosses of the words of part names from lexicon files, one a first letter: by the sense
    that is named, else by the entry."""
    words = _table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("w")).distinct()
    sense = lambda n, lang: F.concat(F.lit('<Sense Id="'), "w", F.lit(f'-{n}"><Gloss Language="{lang}">'), F.upper("w"), F.lit(f"{n}</Gloss></Sense>"))
    item = F.concat(F.lit('<item><Lexeme Type="Word" Form="'), "w", F.lit('" Homograph="1"/><Entry>'), sense(1, "fr"), sense(2, "en"), sense(3, "en"), F.lit("</Entry></item>"))
    files = words.groupBy(F.substring("w", 1, 1).alias("doc_id")).agg(F.array_join(F.sort_array(F.collect_list(item)), "").alias("i"))
    files = files.select("doc_id", F.concat(F.lit("<Lexicon><Entries>"), "i", F.lit("</Entries></Lexicon>")).alias("text"))
    entries, senses = glosses.read_lexicons(files)
    asked = words.select(F.concat(F.lit("Word:"), "w").alias("id"), F.explode(F.array(F.lit(None).cast("string"), F.concat("w", F.lit("-3")), F.concat("w", F.lit("-1")))).alias("sense"))
    return glosses.glossed(asked, entries, senses, "en").select("id", F.coalesce("sense", F.lit("")).alias("sense"), "gloss")


GLOSSED = """
WITH w AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS w FROM part)
SELECT 'Word:' || w AS id, CASE s WHEN 0 THEN '' ELSE w || '-' || s END AS sense, CASE s WHEN 0 THEN upper(w) || '2' WHEN 3 THEN upper(w) || '3' END AS gloss FROM w, (VALUES (0), (3), (1)) AS x(s)
"""

REPLACED = """
SELECT p_partkey, array_to_string(list_transform(regexp_extract_all(p_name, '[aeiou][a-z]|[aeiou]| |[^aeiou ]'),
  lambda x: CASE WHEN length(x) = 2 THEN x[2] || x[1] WHEN x IN ('a', 'e', 'i', 'o', 'u') THEN '_' WHEN x = ' ' THEN '.' ELSE x END), '') AS value FROM part
"""

QUERIES = {
    "n_constructs": (constructs, CONSTRUCTS),
    "c1_c11_faults": (faults, FAULTS),
    "d2_d9_policy": (policy, POLICY),
    "k9_reported": (reported, REPORTED),
    "d7_d8_places": (places, PLACES),
    "k1_k7_written": (written, WRITTEN),
    "t3_paragraph_sections": (paragraph_sections, _paragraph_sections_sql()),
    "t9_transliterated": (transliterated, TRANSLITERATED),
    "x1_x6_chapters": (chapter_table, CHAPTER_TABLE),
    "x4_looked_up": (looked_up, LOOKED_UP),
    "x8_versions": (versions, VERSIONS),
    "u3_cursor": (cursor, CURSOR),
    "r2_r7_forms": (citation_forms, CITATION_FORMS),
    "g6_unresolved": (unresolved, UNRESOLVED),
    "i_anchored": (anchored, ANCHORED),
    "l_glossed": (glossed, GLOSSED),
}
