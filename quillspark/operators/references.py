"""Cross references and glossary links of documents."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import walks
from ..functions.citations import BookNames, CitationFormat, parse_citations, parse_link
from ..functions.style import Sheet
from ..sources import markup
from .text import plain

_CITATION = pa.schema(
    [("doc_id", pa.string()), ("seq", pa.int32()), ("ord", pa.int32()), ("linked", pa.bool_()), ("book", pa.string()), ("chapter", pa.int64()), ("verse", pa.int64()), ("part", pa.string())]
    + [("end_chapter", pa.int64()), ("end_verse", pa.int64()), ("end_part", pa.string()), ("at_start", pa.int32()), ("at_end", pa.int32())]
)
_STYLED = pa.schema(
    [("seq", pa.int32()), ("text", pa.string()), ("attributes", pa.list_(markup.ATTRIBUTE)), ("book", pa.string()), ("chapter", pa.string()), ("span_start", pa.int64()), ("span_end", pa.int64()), ("noted", pa.bool_())]
)


def styled_text_of(docs: DataFrame, marker: str, sheet: Sheet | None = None) -> DataFrame:
    """``styled_text`` of (doc_id, text) in one pass without a shuffle."""
    return markup.walked(docs, lambda doc: walks.styled_text(doc, marker), _STYLED, sheet)


#: The columns of the node table that this module reads.
FIELDS = ("seq", "kind", "marker", "content", "code", "number", "attributes", "note", "chars", "block", "span_start", "span_end")


def styled_text(nodes: DataFrame, marker: str) -> DataFrame:
    """(doc_id, seq, text, attributes, book, chapter, span_start, span_end, noted) of each
    outermost character style ``marker``; a style of the same name inside is part of it. One
    pass: such styles don't nest, so a text belongs to the last one begun before it."""
    own = (F.col("kind") == "char") & (F.col("marker") == marker) & ~F.array_contains("chars", marker)
    inside = (F.col("kind") == "text") & F.array_contains("chars", marker)
    rows = nodes.select(*(c for c in nodes.columns if c in ("doc_id", *FIELDS)), own.alias("own"), inside.alias("inside")).where("own or inside or kind in ('book', 'chapter_start')")
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = F.when(F.col("kind") == "book", F.struct(F.lit(None).cast("string").alias("n"))).when(F.col("kind") == "chapter_start", F.struct(F.col("number").alias("n")))
    rows = rows.select("*", F.last("code", ignorenulls=True).over(w).alias("book"), F.last(begun, ignorenulls=True).over(w)["n"].alias("chapter"), F.last(F.when(F.col("own"), F.col("seq")), ignorenulls=True).over(w).alias("of"))
    kept = ("attributes", "book", "chapter", "span_start", "span_end")
    head = F.first(F.when(F.col("own"), F.struct(*kept, F.col("note").isNotNull().alias("noted"))), ignorenulls=True)
    text = plain(F.sort_array(F.collect_list(F.when(F.col("inside"), F.struct("seq", "block", "content")))))
    out = rows.where("own or inside").groupBy("doc_id", F.col("of").alias("seq")).agg(head.alias("h"), text.alias("text"))
    return out.where("h is not null").select("doc_id", "seq", "text", *(f"h.{k}" for k in kept), "h.noted")


def _named(attribute: str) -> Column:
    hits = F.filter("attributes", lambda a: (a["name"] == "") | (a["name"] == attribute))
    return F.when(F.size(hits) > 0, hits[0]["value"])


def cross_references(nodes: DataFrame, form: CitationFormat | None = None, names: BookNames | None = None) -> DataFrame:
    """Citations of every \\xt: doc_id, seq, ord, linked, then the citation. A link target that
    parses takes the place of the text."""
    return citations(styled_text(nodes, "xt"), form, names)


def citations(styled: DataFrame, form: CitationFormat | None = None, names: BookNames | None = None) -> DataFrame:
    """``cross_references`` of rows of ``styled_text``."""
    rows = styled.select("doc_id", "seq", "book", "text", _named("link-href").alias("href"))

    def run(batches):
        out: list[tuple] = []

        def taken():
            part = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _CITATION)], schema=_CITATION)
            out.clear()
            return part

        for b in batches:
            for i, s, book, text, href in zip(*(c.to_pylist() for c in b.columns)):
                link = parse_link(href) if href is not None else None
                found = link if link is not None else parse_citations(text, form, names, book)
                for k, c in enumerate(found):
                    e = c.end
                    out.append((i, s, k, link is not None, c.book, c.start.chapter, c.start.verse, c.start.part, e and e.chapter, e and e.verse, e and e.part, c.at[0], c.at[1]))
                if len(out) >= markup.ROWS:
                    yield taken()
        if out:
            yield taken()

    return rows.mapInArrow(run, ", ".join(f"{f.name} {markup._ddl(f.type)}" for f in _CITATION))


def normal_term(term: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(term, r"(?U)\s+", " ")))


def glossary(nodes: DataFrame) -> DataFrame:
    """Entries (\\k): doc_id, seq, term, normal, book, chapter, nth (1 is the entry that
    counts, more are repeats); documents are in the order of their ids."""
    return entries(styled_text(nodes, "k"))


def entries(styled: DataFrame) -> DataFrame:
    """``glossary`` of rows of ``styled_text``."""
    k = styled.select("doc_id", "seq", F.trim(F.regexp_replace("text", r"(?U)\s+", " ")).alias("term"), normal_term(F.col("text")).alias("normal"), "book", "chapter", "span_start", "span_end").where("normal <> ''")
    return k.withColumn("nth", F.row_number().over(Window.partitionBy("normal").orderBy("doc_id", "seq")))


def first_entries(entries: DataFrame) -> DataFrame:
    """(normal, entry_doc, entry_seq): the entry that counts for each term. A least value, so
    that a term with many entries is one row for each task before it is shuffled."""
    first = entries.groupBy("normal").agg(F.min(F.struct("doc_id", "seq")).alias("f"))
    return first.select("normal", F.col("f.doc_id").alias("entry_doc"), F.col("f.seq").alias("entry_seq"))


def glossary_words(nodes: DataFrame, entries: DataFrame) -> DataFrame:
    """Words (\\w) with their entry, null where unresolved. The lemma counts if it isn't blank,
    else the text. A plain equi-join, as a glossary can be large: the engine broadcasts it where
    it measures it as small, and splits a frequent word's partition where it doesn't."""
    return resolved(styled_text(nodes, "w"), entries)


def resolved(styled: DataFrame, entries: DataFrame) -> DataFrame:
    """``glossary_words`` of rows of ``styled_text``."""
    lemma = _named("lemma")
    w = styled.withColumn("term", F.when(F.trim(F.regexp_replace(lemma, r"(?U)\s+", " ")) != "", lemma).otherwise(F.col("text"))).select("doc_id", "seq", F.trim(F.regexp_replace("term", r"(?U)\s+", " ")).alias("term"), normal_term(F.col("term")).alias("normal"), "span_start", "span_end")
    return w.join(first_entries(entries), "normal", "left")


def unresolved(words: DataFrame) -> DataFrame:
    return words.where("entry_doc is null")
