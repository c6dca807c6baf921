"""Registered queries over synthesised markup, with SQL for each where SQL can say it.

The given tables hold no markup, so documents are wrapped into it: lines become verses, order
lines chapters and verses, part names glossary terms, and so on. The SQL states the result
from the tables directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import replacements, usx, writers
from .functions.citations import BookNames
from .functions.parser import parse
from .operators import checks, diagnostics, index, references, text
from .plans import render
from .sources import markup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sections(markup.dealt(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def verse_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document is a verse of chapter 1."""
    docs = _table(spark, sf_dir, "documents")
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.lit("\\v "), i + 1, F.lit(" "), x))
    return docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("\\id XXA wrapped\n\\c 1\n\\p\n"), F.array_join(lines, "\n")).alias("text"))


def _stored_nodes(docs: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Nodes for a plan of several branches: parsed once."""
    return markup.stored(markup.node_rows(docs, fields=fields))


def verse_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = index.verse_text_of(verse_documents(spark, sf_dir))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "book", "chapter", "number", "text")


_LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents"
# A second pipe in one style doesn't occur here: every pipe stands outside a style and is text.
VERSE_TEXT = f"""
SELECT doc_id, 'XXA' AS book, 1::BIGINT AS chapter, n::VARCHAR AS number,
       trim(regexp_replace(line, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS text FROM ({_LINES})
"""


def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = text.document_text_of(verse_documents(spark, sf_dir))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("digest"))


DOCUMENT_TEXT = """
WITH t AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, length(t)::BIGINT AS n_chars, sha256(t) AS digest FROM t
"""


def pipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics by document and code: every pipe in running text is one."""
    found = markup.parser_diagnostics(markup.parsed(verse_documents(spark, sf_dir), fields=()))
    return found.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "code", "severity").agg(F.count(F.lit(1)).alias("n"))


PIPES = "SELECT doc_id, 'unexpected-pipe' AS code, 'error' AS severity, (length(text) - length(replace(text, '|', '')))::BIGINT AS n FROM documents WHERE text LIKE '%|%'"


def located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and column of every diagnostic of the wrapped documents."""
    docs = verse_documents(spark, sf_dir)
    found = diagnostics.located(markup.parser_diagnostics(markup.parsed(docs, fields=())), docs)
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("line").cast("long").alias("line"), F.col("column").cast("long").alias("column"), "code")


LOCATED = f"""
WITH l AS ({_LINES}), p AS (SELECT doc_id, n, line, '\\v ' || n || ' ' || line AS s FROM l),
c AS (SELECT doc_id, n, s, unnest(range(1, length(s) + 1)) AS k FROM p WHERE s LIKE '%|%')
SELECT doc_id, (n + 3)::BIGINT AS line, k::BIGINT AS "column", 'unexpected-pipe' AS code FROM c WHERE substr(s, k, 1) = '|'
"""


def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per supplier: chapters are orders, verses line numbers, in a total order
    in which both go back and repeat."""
    items = _table(spark, sf_dir, "lineitem")
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    rows = items.select("l_suppkey", F.struct(*order).alias("o")).groupBy("l_suppkey").agg(F.sort_array(F.collect_list("o")).alias("os"))
    lines = F.transform("os", lambda o: F.concat(F.lit("\\c "), o["l_orderkey"] % 40 + 1, F.lit("\n\\p\n\\v "), o["l_linenumber"], F.lit(" x \\v "), o["l_partkey"] % 5 + 1, F.lit(" y")))
    return rows.select(F.col("l_suppkey").cast("string").alias("doc_id"), F.concat(F.lit("\\id XXA\n"), F.array_join(lines, "\n")).alias("text"))


def order_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by document and code of chapters and verses out of order."""
    found = checks.of_documents(order_documents(spark, sf_dir))
    return found.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "code").agg(F.count(F.lit(1)).alias("n"))


ORDER_CHECKS = """
WITH r AS (SELECT l_suppkey AS doc_id, l_orderkey % 40 + 1 AS c, l_linenumber AS v1, l_partkey % 5 + 1 AS v2,
   row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) AS k FROM lineitem),
w AS (SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY k) AS nth, lag(c) OVER (PARTITION BY doc_id ORDER BY k) AS before FROM r),
f AS (SELECT doc_id, CASE WHEN nth > 1 THEN 'duplicate-chapter-number' WHEN c < before THEN 'chapter-out-of-order' END AS code FROM w
  UNION ALL SELECT doc_id, CASE WHEN v2 = v1 THEN 'duplicate-verse-number' WHEN v2 < v1 THEN 'verse-out-of-order' END FROM w)
SELECT doc_id, code, count(*)::BIGINT AS n FROM f WHERE code IS NOT NULL GROUP BY 1, 2
"""


def range_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chapter per order with verse numbers that are ranges and segments."""
    items = _table(spark, sf_dir, "lineitem")
    part = F.element_at(F.array(F.lit(""), F.lit("a"), F.lit("b")), (F.col("l_partkey") % 3 + 1).cast("int"))
    lo, width = F.col("l_linenumber").cast("long"), F.col("l_suppkey") % 3
    number = F.when(width > 0, F.concat(lo, F.lit("-"), lo + width)).otherwise(F.concat(lo, part))
    rows = items.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", number.alias("number")).alias("o")).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("o")).alias("os"))
    return rows.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.concat(F.lit("\\id XXA\n\\c 1\n\\p\n"), F.array_join(F.transform("os", lambda o: F.concat(F.lit("\\v "), o["number"], F.lit(" x"))), "\n")).alias("text"))


def range_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.of_documents(range_documents(spark, sf_dir)).where("code = 'duplicate-verse-number'")
    return found.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))


RANGE_CHECKS = """
WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber::BIGINT AS lo, l_linenumber + l_suppkey % 3 AS hi,
   CASE WHEN l_suppkey % 3 > 0 THEN '' ELSE ['', 'a', 'b'][l_partkey % 3 + 1] END AS part,
   row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem)
SELECT p.doc_id, count(*)::BIGINT AS n FROM r p WHERE EXISTS (SELECT 1 FROM r q WHERE q.doc_id = p.doc_id AND q.k < p.k AND q.lo <= p.hi AND q.hi >= p.lo AND (p.part = '' OR q.part = '' OR p.part = q.part)) GROUP BY 1
"""


def fault_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, each with a word that has an attribute fault by the id of its document."""
    docs = verse_documents(spark, sf_dir)
    k = F.col("doc_id").cast("long") % 7
    body = (
        F.when(k == 0, '\\w|lemma="x"\\w*').when(k == 1, "\\w a|\\w*").when(k == 2, '\\w a|x lemma="y"\\w*').when(k == 3, '\\w a|lemma="x" lemma="y"\\w*')
        .when(k == 4, '\\w a|1x="y"\\w*').when(k == 5, "\\nd a|x\\nd*").otherwise('\\w a|lemma="x"\\w*')
    )
    return docs.select("doc_id", F.concat("text", F.lit("\n\\p "), body).alias("text"))


def attribute_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.of_documents(fault_documents(spark, sf_dir))
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "code", "severity")


ATTRIBUTE_CHECKS = """
SELECT doc_id, code, 'error' AS severity FROM documents JOIN (VALUES (0, 'empty-word'), (1, 'empty-attribute-list'), (2, 'default-attribute-with-others'),
  (3, 'duplicate-attribute'), (4, 'malformed-attribute-name'), (5, 'no-default-attribute')) AS c(k, code) ON doc_id % 7 = k
"""


def table_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table row for each region, whose cells are nations in the column of their key."""
    nations = _table(spark, sf_dir, "nation")
    rows = nations.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("ns"))
    cells = F.array_join(F.transform("ns", lambda n: F.concat(F.lit("\\tc"), n["n_nationkey"] + 1, F.lit(" "), n["n_name"])), " ")
    return rows.select(F.col("n_regionkey").cast("string").alias("doc_id"), F.concat(F.lit("\\id XXA\n\\c 1\n\\tr "), cells).alias("text"))


def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = checks.of_documents(table_documents(spark, sf_dir)).where("code = 'unexpected-table-column'")
    return found.select(F.col("doc_id").cast("long").alias("region"), "message")


TABLE_COLUMNS = """
WITH n AS (SELECT n_regionkey, n_nationkey + 1 AS col, coalesce(lag(n_nationkey + 2) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), 1) AS due FROM nation)
SELECT n_regionkey::BIGINT AS region, 'column ' || col || ' where ' || due || ' was due' AS message FROM n WHERE col <> due
"""


def woven(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document of an even id with the one after it, section by section."""
    docs = _table(spark, sf_dir, "documents")
    side = lambda k: text.sections(docs.where(F.col("doc_id") % 2 == k).select(F.expr("doc_id div 2").alias("doc_id"), "text"))
    out = text.woven(side(0), side(1))
    return out.select(F.col("doc_id").alias("pair"), "ord", F.trim("left").alias("left"), F.trim("right").alias("right"))


_CUT = "string_split(regexp_replace(regexp_replace({t}, '(^|\\s)([\"''”“‘’(][.?!,۔؟“”\"''‘’،:;()]*)', '\\1' || chr(1) || '\\2', 'g'), '([^.?!,۔؟“”\"''‘’،:;()' || chr(1) || ']|^)([.?!,۔؟“”\"''‘’،:;()]+)', '\\1\\2' || chr(1), 'g'), chr(1))"
_SECTIONS = "SELECT {id} AS doc_id, unnest(range(0, len(s))) AS ord, unnest(s) AS section FROM (SELECT *, list_filter(" + _CUT.format(t="text") + ", lambda x: trim(x) <> '') AS s FROM {of})"
SECTIONS = _SECTIONS.format(id="doc_id", of="documents")
WOVEN = "WITH s AS (SELECT doc_id % 2 AS side, " + _SECTIONS.format(id="doc_id % 2 AS side, doc_id // 2", of="documents").removeprefix("SELECT doc_id % 2 AS side, ") + ") SELECT a.doc_id AS pair, a.ord, trim(a.section) AS left, trim(b.section) AS right FROM s a JOIN s b ON a.doc_id = b.doc_id AND a.ord = b.ord WHERE a.side = 0 AND b.side = 1"


def _term_documents(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Glossary documents of part names (one a brand) and word lists of supplier documents."""
    part = _table(spark, sf_dir, "part")
    entry = F.concat(F.lit("\\p \\k "), "p_name", F.lit("\\k* is"))
    g = part.select("p_brand", "p_partkey", entry.alias("e")).groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "e"))).alias("es"))
    glossary = g.select(F.col("p_brand").alias("doc_id"), F.concat(F.lit("\\id GLO\n"), F.array_join(F.transform("es", lambda x: x["e"]), "\n")).alias("text"))
    size = part.groupBy("p_size").agg(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name", "p_type"))).alias("ps"))
    odd = lambda x: F.when(x["p_partkey"] % 3 == 0, F.concat(F.lit("\\w "), F.upper(x["p_name"]), F.lit("\\w*"))).when(x["p_partkey"] % 3 == 1, F.concat(F.lit("\\w x|lemma=\""), x["p_name"], F.lit("\"\\w*"))).otherwise(F.concat(F.lit("\\w "), x["p_type"], F.lit("\\w*")))
    words = size.select(F.col("p_size").cast("string").alias("doc_id"), F.concat(F.lit("\\id GEN\n\\c 1\n\\p "), F.array_join(F.transform("ps", odd), "\n")).alias("text"))
    return glossary, words


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document with the entry that resolves them, and how often."""
    entries_docs, word_docs = _term_documents(spark, sf_dir)
    entries = references.entries(references.styled_text_of(entries_docs, "k"))
    words = references.resolved(references.styled_text_of(word_docs, "w"), entries)
    return words.groupBy(F.col("doc_id").cast("long").alias("doc"), "normal", "entry_doc").agg(F.count(F.lit(1)).alias("n"))


GLOSSARY = """
WITH e AS (SELECT lower(trim(p_name)) AS normal, p_brand, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_brand, p_partkey) AS k FROM part),
w AS (SELECT p_size::BIGINT AS doc, lower(trim(CASE WHEN p_partkey % 3 < 2 THEN p_name ELSE p_type END)) AS normal FROM part)
SELECT w.doc, w.normal, e.p_brand AS entry_doc, count(*)::BIGINT AS n FROM w LEFT JOIN e ON e.normal = w.normal AND e.k = 1 GROUP BY 1, 2, 3
"""


def glossary_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries that repeat an earlier term."""
    entries = references.entries(references.styled_text_of(_term_documents(spark, sf_dir)[0], "k"))
    return entries.where("nth > 1").groupBy("normal").agg(F.count(F.lit(1)).alias("n"))


GLOSSARY_REPEATS = "SELECT lower(trim(p_name)) AS normal, (count(*) - 1)::BIGINT AS n FROM part GROUP BY 1 HAVING count(*) > 1"


def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two references of each order in one cross reference, the second without a book."""
    orders = _table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    xt = F.concat(F.lit("\\xt Genesis "), k % 50 + 1, F.lit(":"), k % 30 + 1, F.lit("-"), k % 30 + 3, F.lit("; "), k % 7 + 1, F.lit(":"), k % 11 + 1, F.lit("\\xt*"))
    docs = orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderkey", xt.alias("x")))).alias("xs"))
    docs = docs.select(F.col("o_custkey").cast("string").alias("doc_id"), F.concat(F.lit("\\id EXO\n\\c 1\n\\p "), F.array_join(F.transform("xs", lambda x: x["x"]), " ")).alias("text"))
    names = BookNames(codes=True)
    names.add("Genesis", "GEN")
    found = references.citations(references.styled_text_of(docs, "xt"), names=names)
    return found.groupBy(F.col("doc_id").cast("long").alias("doc"), "book", "chapter", "verse", F.coalesce("end_verse", F.lit(0)).alias("end_verse")).agg(F.count(F.lit(1)).alias("n"))


CITATIONS = """
WITH c AS (SELECT o_custkey AS doc, o_orderkey % 50 + 1 AS chapter, o_orderkey % 30 + 1 AS verse, o_orderkey % 30 + 3 AS end_verse FROM orders
  UNION ALL SELECT o_custkey, o_orderkey % 7 + 1, o_orderkey % 11 + 1, 0 FROM orders)
SELECT doc, 'GEN' AS book, chapter, verse, end_verse, count(*)::BIGINT AS n FROM c GROUP BY 1, 3, 4, 5
"""


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each wrapped document through markup and USX and back: are the trees the same?"""

    def check(t: str) -> str:
        doc = parse(t)
        out = writers.to_markup(doc)
        again = parse(out)
        same = writers.same(doc.blocks, again.blocks) and writers.to_markup(again) == out
        back = usx.read_usx(writers.to_usx(doc))
        plain = lambda bs: [b for b in bs if b.marker != "usfm"]
        return f"{same} {writers.same(plain([writers.normalised(b, doc.sheet) for b in doc.blocks]), plain(back.blocks))}"

    got = render.per_text(verse_documents(spark, sf_dir), check)
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("value").alias("same"))


ROUND_TRIP = "SELECT doc_id, 'True True' AS same FROM documents"


def usx_verses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every verse, read from the USX of the document."""
    xml = render.render(verse_documents(spark, sf_dir), "usx").withColumnRenamed("value", "text")
    out = index.verse_text_of(xml, reader=usx.read_usx)
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "book", "chapter", "number", "text")


def html_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length and digest of the HTML of every wrapped document."""
    got = render.render(verse_documents(spark, sf_dir), "html")
    return got.select(F.col("doc_id").cast("long").alias("doc_id"), F.length("value").cast("long").alias("n"), F.sha2("value", 256).alias("digest"))


HTML_PAGES = None  # tested on its own


def json_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each node type stands in the JSON of the wrapped documents."""
    got = render.render(verse_documents(spark, sf_dir), "json")
    types = F.regexp_extract_all("value", F.lit('"type":"([a-z_]+)"'), 1)
    return got.select(F.explode(types).alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


JSON_TYPES = f"""
WITH l AS ({_LINES}), v AS (SELECT count(*) AS n, count(*) FILTER (trim(regexp_replace(line, '[ \\t\\n\\f\\r]+', ' ', 'g')) <> '') AS full_, count(DISTINCT doc_id) AS docs FROM l),
e AS (SELECT count(*) AS n FROM l a JOIN (SELECT doc_id, max(n) AS last FROM l GROUP BY 1) m ON a.doc_id = m.doc_id AND a.n < m.last WHERE trim(regexp_replace(line, '[ \\t\\n\\f\\r]+', ' ', 'g')) <> '')
SELECT type, n::BIGINT AS n FROM (
  SELECT 'document' AS type, docs AS n FROM v UNION ALL SELECT 'book', docs FROM v UNION ALL SELECT 'chapter_start', docs FROM v UNION ALL SELECT 'chapter_end', docs FROM v
  UNION ALL SELECT 'para', docs FROM v UNION ALL SELECT 'verse_start', n FROM v UNION ALL SELECT 'verse_end', n FROM v UNION ALL SELECT 'text', v.full_ + e.n FROM v, e)
"""


#: What stands after the whole text before and after all repairs.
_REPAIRS = [
    ("a \\qqq b", "a b"),
    ("a\\f \\ft b\\f*", "a\\f + \\ft b\\f*"),
    ("a \\bd b", "a \\bd b\\bd*"),
    ("\\w a|lemma=b\\w* \\qqq c", '\\w a|lemma="b"\\w* c'),
    ("x \\qt-s |\\* y", "x \\qt-s\\* y"),
]


def fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with one or two faults each, after all repairs."""
    docs = verse_documents(spark, sf_dir)
    body = F.element_at(F.array(*(F.lit(a) for a, _ in _REPAIRS)), (F.col("doc_id").cast("long") % len(_REPAIRS) + 1).cast("int"))
    given = docs.select("doc_id", F.concat("text", F.lit("\n\\p "), body).alias("text"))
    return render.fixed(given).select(F.col("doc_id").cast("long").alias("doc_id"), F.length("value").cast("long").alias("n"), F.sha2("value", 256).alias("digest"), F.substring_index("value", "\n", -1).alias("last_line"))


FIXED = f"""
WITH l AS ({_LINES}), d AS (SELECT doc_id, '\\id XXA wrapped' || chr(10) || '\\c 1' || chr(10) || '\\p' || chr(10) || string_agg('\\v ' || n || ' ' || line, chr(10) ORDER BY n) AS t FROM l GROUP BY 1),
f AS (SELECT doc_id, '\\p ' || [{", ".join("'" + b + "'" for _, b in _REPAIRS)}][doc_id % {len(_REPAIRS)} + 1] AS last_line, t || chr(10) || last_line AS v FROM d)
SELECT doc_id, length(v)::BIGINT AS n, sha256(v) AS digest, last_line FROM f
"""


def replaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules over the text of part names: at each place the first rule that matches."""
    part = _table(spark, sf_dir, "part")
    rules = replacements.Replacements('"([aeiou])([a-z])" > "${2}${1}"\n"[aeiou]" > "_"\n" " > "."')
    got = render.per_text(part.select(F.col("p_partkey").alias("doc_id"), F.col("p_name").alias("text")), rules.apply)
    return got.select(F.col("doc_id").cast("long").alias("p_partkey"), "value")



def outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters of the order documents in the outline, with their span in bytes."""
    rows = index.symbols(_stored_nodes(order_documents(spark, sf_dir), index.SYMBOL_FIELDS)).where("kind = 'chapter'")
    return rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.count(F.lit(1)).alias("chapters"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.min(F.col("end") - F.col("start")).alias("least"))


OUTLINE = """
WITH r AS (SELECT l_suppkey AS doc_id, length('\\c ' || (l_orderkey % 40 + 1) || chr(10) || '\\p' || chr(10) || '\\v ' || l_linenumber || ' x \\v ' || (l_partkey % 5 + 1) || ' y') AS n,
   row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_extendedprice DESC) AS from_last FROM lineitem),
s AS (SELECT doc_id, CASE WHEN from_last = 1 THEN n ELSE n + 1 END AS n FROM r)
SELECT doc_id, count(*)::BIGINT AS chapters, sum(n)::BIGINT AS bytes, min(n)::BIGINT AS least FROM s GROUP BY 1
"""


def found_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands inside every verse number of the order documents, and its reference."""
    nodes = _stored_nodes(order_documents(spark, sf_dir), index.LOCATE_FIELDS)
    starts = nodes.where("kind = 'verse_start'").select("doc_id", (F.col("span_start") + 1).alias("offset"))
    got = index.locate(nodes, starts)
    return got.groupBy(F.col("doc_id").cast("long").alias("doc_id"), "kind", "book", "verse").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("chapter").cast("long")).alias("chapters"))


FOUND_AT = """
WITH r AS (SELECT l_suppkey AS doc_id, l_orderkey % 40 + 1 AS c, unnest([l_linenumber::BIGINT, l_partkey % 5 + 1]) AS v FROM lineitem)
SELECT doc_id, 'verse_start' AS kind, 'XXA' AS book, v::VARCHAR AS verse, count(*)::BIGINT AS n, sum(c)::BIGINT AS chapters FROM r GROUP BY 1, v
"""

_QUERIES = {
    "t2_sections": (sections, SECTIONS),
    "x7_verse_text": (verse_text, VERSE_TEXT),
    "t1_document_text": (document_text, DOCUMENT_TEXT),
    "n_pipes": (pipes, PIPES),
    "d6_located": (located, LOCATED),
    "c14_c17_order": (order_checks, ORDER_CHECKS),
    "c16_ranges": (range_checks, RANGE_CHECKS),
    "c9_c13_attributes": (attribute_checks, ATTRIBUTE_CHECKS),
    "c8_columns": (table_columns, TABLE_COLUMNS),
    "t6_woven": (woven, WOVEN),
    "g_glossary": (glossary, GLOSSARY),
    "g3_repeats": (glossary_repeats, GLOSSARY_REPEATS),
    "r_citations": (citations, CITATIONS),
    "k_round_trip": (round_trip, ROUND_TRIP),
    "s2_usx_verses": (usx_verses, VERSE_TEXT),
    "k3_json_types": (json_types, JSON_TYPES),
    "k4_html": (html_pages, HTML_PAGES),
    "e_fixed": (fixed, FIXED),
    "t4_replaced": (replaced, None),  # its SQL stands beside the rules
    "q2_outline": (outline, OUTLINE),
    "q1_located": (found_at, FOUND_AT),
}


def _all() -> dict:
    from . import rule_queries

    return _QUERIES | rule_queries.QUERIES | {"t4_replaced": (replaced, rule_queries.REPLACED)}


def queries() -> dict:
    return {k: q for k, (q, _) in _all().items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for k, (_, s) in _all().items() if s}
