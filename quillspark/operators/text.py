"""Plain text, sections, and pairs of documents, as expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import walks
from ..functions.style import Sheet, default_sheet, sheet_table
from ..sources import markup

#: The columns of the node table that texts and sections are made of.
FIELDS = ("seq", "kind", "content", "para", "note", "chars", "block", "direct")
_WS = " \t\n\f\r"
_PUNCT = r""".?!,۔؟“”"'‘’،:;\(\)"""
_OPEN = r""""'”“‘’\("""


def plain(parts: Column, separator: str = " ") -> Column:
    """Text of ordered structs (seq, block, content): a new block puts the separator between,
    white space doesn't double, none is left at the end."""
    start = F.struct(F.lit("").alias("out"), F.lit(None).cast("int").alias("block"))

    def step(acc, x):
        turn = (acc["out"] != "") & ~acc["block"].eqNullSafe(x["block"])
        out = F.when(turn, F.concat(F.rtrim(acc["out"], F.lit(_WS)), F.lit(separator))).otherwise(acc["out"])
        more = F.when(out.rlike("[ \t\n\f\r]$"), F.ltrim(x["content"], F.lit(_WS))).otherwise(x["content"])
        return F.struct(F.concat(out, more).alias("out"), x["block"].alias("block"))

    return F.rtrim(F.aggregate(parts, start, step)["out"], F.lit(_WS))


def document_text(nodes: DataFrame, notes: bool = False, keep_para: Column | None = None, drop_chars: list[str] | None = None, separator: str = " ") -> DataFrame:
    """(doc_id, text). ``keep_para`` is a condition over the style of the paragraph (marker as
    ``para``); ``drop_chars`` are character styles whose content is left out."""
    kept = F.col("kind") == "text"
    if not notes:
        kept &= F.col("note").isNull()
    if keep_para is not None:
        kept &= F.coalesce(keep_para, F.lit(False))
    if drop_chars:
        kept &= ~F.coalesce(F.arrays_overlap("chars", F.array(*map(F.lit, drop_chars))), F.lit(False))
    parts = F.sort_array(F.collect_list(F.when(kept, F.struct("seq", "block", "content"))))
    return nodes.groupBy("doc_id").agg(plain(parts, separator).alias("text"))


def document_text_of(docs: DataFrame, sheet: Sheet | None = None) -> DataFrame:
    """``document_text`` of (doc_id, text) in one pass without a shuffle."""
    return markup.walked(docs, walks.document_text, pa.schema([("text", pa.string())]), sheet)


def cut(text: Column) -> Column:
    """Sections of a text, blanks included: a cut after a run of punctuation, or before it
    when it opens a quotation or bracket at the start or after white space."""
    a = F.regexp_replace(text, f"(?<=^|\\s)([{_OPEN}][{_PUNCT}]*)", "\u0001$1")
    b = F.regexp_replace(a, f"(?<![{_PUNCT}\u0001])([{_PUNCT}]+)", "$1\u0001")
    return F.split(b, "\u0001")


def sections(docs: DataFrame) -> DataFrame:
    """(doc_id, ord, section) of (doc_id, text), without blank sections."""
    kept = F.filter(cut(F.col("text")), lambda x: F.trim(x) != "")
    return docs.select("doc_id", F.posexplode(kept).alias("ord", "section")).select("doc_id", F.col("ord").cast("long").alias("ord"), "section")


def document_sections(nodes: DataFrame, sheet: Sheet | None = None) -> DataFrame:
    """(doc_id, ord, section) over texts directly in vernacular paragraphs; a section runs on
    from one text to the next of a paragraph and ends with the paragraph."""
    vernacular = sheet_table(nodes.sparkSession, sheet).where("kind = 'paragraph' and vernacular").select(F.col("marker").alias("para"))
    rows = nodes.where("kind = 'text' and direct").join(F.broadcast(vernacular), "para", "left_semi")
    parts = rows.select("doc_id", "block", "seq", cut(F.col("content")).alias("cuts"))
    paras = parts.groupBy("doc_id", "block").agg(F.sort_array(F.collect_list(F.struct("seq", "cuts"))).alias("runs"))
    empty = F.array().cast("array<string>")

    def step(acc, run):
        cuts = run["cuts"]
        head = F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))
        seam = F.array(F.concat(F.element_at(acc, -1), cuts[0]))
        return F.when(F.size(acc) == 0, cuts).otherwise(F.concat(head, seam, F.slice(cuts, 2, F.greatest(F.size(cuts) - 1, F.lit(0)))))

    found = paras.select("doc_id", "block", F.posexplode(F.filter(F.transform(F.aggregate("runs", empty, step), lambda s: F.trim(s)), lambda s: s != "")).alias("k", "section"))
    w = Window.partitionBy("doc_id").orderBy("block", "k")
    return found.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("ord"), "section")


def document_sections_of(docs: DataFrame, sheet: Sheet | None = None) -> DataFrame:
    """``document_sections`` of (doc_id, text) in one pass without a shuffle."""
    kept = frozenset(s.marker for s in (sheet or default_sheet()).styles.values() if s.kind == "paragraph" and s.vernacular)
    return markup.walked(docs, lambda doc: walks.sections(doc, kept), pa.schema([("ord", pa.int64()), ("section", pa.string())]), sheet)


def woven(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sections of two documents side by side, to the end of the shorter: doc_id, ord, left, right."""
    return left.withColumnRenamed("section", "left").join(right.withColumnRenamed("section", "right"), ["doc_id", "ord"])
