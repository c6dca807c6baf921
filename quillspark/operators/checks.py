"""Checks of finished trees, as windows and joins over the node table.

Checks that look at one row, or at it and its neighbours, are one array of findings per row,
exploded once. Order checks run over chapters and verses only; repeated verse numbers are an
interval join inside a chapter, never an enumeration of a range.

Documents that are parsed anyway are checked while they are walked (``of_documents``), by the same
rules; ``analyze`` is for node tables that were joined, changed or read from elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import CODES
from ..functions.findings import findings
from ..functions.parser import ByteOffsets, Document, parse
from ..functions.style import Sheet, default_sheet, sheet_table
from ..sources.markup import ROWS, dealt

_NAME = "^[A-Za-z_][A-Za-z0-9._-]*$"


def placement_table(spark, sheet: Sheet | None = None) -> DataFrame:
    """(marker, listed array, note_only): a marker may stand under what it lists; one that
    lists nothing but notes stands nowhere else."""
    sheet = sheet or default_sheet()
    rows = []
    for s in sheet.styles.values():
        notes = bool(s.parents) and all((p := sheet.get(x)) is not None and p.kind == "note" for x in s.parents)
        rows.append((s.marker, list(s.parents), notes))
    return spark.createDataFrame(rows, "marker string, listed array<string>, note_only boolean")


def _find(condition: Column, code: str, message: Column, start: str | Column = "span_start", end: str | Column = "span_end") -> Column:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return F.when(condition, F.struct(F.lit(code).alias("code"), message.alias("message"), col(start).cast("bigint").alias("span_start"), col(end).cast("bigint").alias("span_end")))


def with_context(nodes: DataFrame) -> DataFrame:
    """Nodes with book (last one walked), book_seq, chapter_seen, chapter (number in this
    book), chapter_seq (instance)."""
    w = Window.partitionBy("doc_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_book, is_chapter = F.col("kind") == "book", F.col("kind") == "chapter_start"
    out = nodes.select(
        "*",
        F.last("code", ignorenulls=True).over(w).alias("book"),
        F.count_if(is_book).over(w).alias("book_seq"),
        (F.count_if(is_chapter).over(w) > 0).alias("chapter_seen"),
        F.count_if(is_chapter | is_book).over(w).alias("chapter_seq"),
    )
    b = Window.partitionBy("doc_id", "book_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("chapter", F.last(F.when(F.col("kind") == "chapter_start", F.col("number")), ignorenulls=True).over(b))


def _row_checks(nodes: DataFrame, lengths: DataFrame | None, sheet: Sheet | None) -> DataFrame:
    spark = nodes.sparkSession
    styles = sheet_table(spark, sheet).select("marker", F.col("kind").alias("style_kind"), "text_type", "default_attribute")
    paras = styles.select(F.col("marker").alias("para"), F.col("text_type").alias("para_text"))
    kind, marker, number = F.col("kind"), F.col("marker"), F.col("attributes")
    known = F.broadcast(placement_table(spark, sheet))  # a style sheet: some hundred rows
    rows = nodes.join(F.broadcast(styles), "marker", "left").join(F.broadcast(paras), "para", "left").join(known, "marker", "left")
    from ..functions.books import CATEGORY

    code = F.col("book")
    listed = F.col("code").isin(list(CATEGORY))
    scripture = code.isNotNull() & ~code.isin([c for c, k in CATEGORY.items() if k == "NonScripture"])
    parent = F.when(F.col("in_cell"), None).when(kind == "note", F.col("para")).when(F.col("in_char"), None).otherwise(F.coalesce("note", "para"))
    placed = kind.isin("char", "note") & parent.isNotNull() & (F.size("listed") > 0) & ~F.array_contains("listed", parent)
    has = number.isNotNull() & kind.isin("char", "milestone", "periph")
    bare = F.exists("attributes", lambda a: a["name"] == "")
    default = F.when(F.col("style_kind").isNotNull(), F.col("default_attribute")).when(marker.rlike("^qt.*-[se]$"), F.lit("who"))
    pipe, pipe_end = F.col("pipe_start"), F.col("pipe_start") + 1
    verse = kind == "verse_start"
    say = lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    single = [
        _find((kind == "book") & ~listed, "unlisted-book-code", say(F.col("code"), " is not a listed book code")),
        _find((kind == "book") & (F.element_at("path", -1) > 0), "id-not-first", F.lit("\\id is not the first marker")),
        _find((kind == "para") & (F.col("text_type") == "versetext") & ~F.col("chapter_seen") & scripture, "verse-text-before-chapter", say("\\", marker, " is verse text before the first \\c")),
        _find(verse & ~F.col("chapter_seen"), "verse-outside-chapter", F.lit("\\v before any \\c")),
        _find(verse & F.col("para_text").isin("title", "section") & (F.col("para") != "s5"), "verse-in-heading", F.lit("\\v in a title or heading")),
        _find(verse & (F.col("char_depth") > 0), "verse-in-character-style", F.lit("\\v in a character style")),
        _find(placed & F.col("note_only"), "marker-not-allowed-here", say("\\", marker, " can't stand under \\", parent)),
        _find(placed & ~F.col("note_only"), "marker-not-listed-here", say("\\", marker, " doesn't list \\", parent)),
        _find((kind == "char") & (marker == "w") & number.isNotNull() & (F.col("seq") == F.col("seq_end")), "empty-word", F.lit("\\w has attributes and no text")),
        _find(has & (F.size("attributes") == 0) & ~F.coalesce(F.col("style_kind") == "milestone", kind == "milestone"), "empty-attribute-list", F.lit("no attribute after |"), pipe, pipe_end),
        _find(has & (F.size("attributes") == 0) & F.coalesce(F.col("style_kind") == "milestone", kind == "milestone"), "empty-milestone-attribute-list", F.lit("no attribute after |"), pipe, pipe_end),
        _find(has & bare & default.isNull(), "no-default-attribute", say("\\", marker, " has no default attribute"), pipe, pipe_end),
        _find(has & bare & (F.size("attributes") > 1), "default-attribute-with-others", F.lit("a value without a name stands beside others"), pipe, pipe_end),
    ]
    pairs = F.when(has, F.col("attributes"))
    bad = F.transform(F.filter(pairs, lambda a: (a["name"] != "") & ~a["name"].rlike(_NAME)), lambda a: F.struct(F.lit("malformed-attribute-name").alias("code"), F.concat(a["name"], F.lit(" can't be an attribute name")).alias("message"), a["start"].alias("span_start"), a["end"].alias("span_end")))
    twice = F.transform(
        F.filter(F.transform(pairs, lambda a, i: F.struct(a.alias("a"), F.exists(F.slice("attributes", 1, i), lambda b: b["name"] == a["name"]).alias("again"))), lambda x: x["again"]),
        lambda x: F.struct(F.lit("duplicate-attribute").alias("code"), F.concat(F.when(x["a"]["name"] == "", F.lit("the default attribute")).otherwise(x["a"]["name"]), F.lit(" is given again")).alias("message"), x["a"]["start"].alias("span_start"), x["a"]["end"].alias("span_end")),
    )
    none = F.array().cast("array<struct<code:string,message:string,span_start:bigint,span_end:bigint>>")
    found = F.concat(F.array_compact(F.array(*single)), F.coalesce(bad, none), F.coalesce(twice, none))
    out = rows.select("doc_id", "seq", F.explode(found).alias("f")).select("doc_id", "seq", "f.*")
    top = nodes.where("depth = 1").groupBy("doc_id").agg(F.min_by("kind", "seq").alias("first"), F.count(F.lit(1)).alias("n"), F.max("span_end").alias("end"))
    if lengths is not None:
        top = top.join(lengths.select("doc_id", F.col("length").alias("doc_end")), "doc_id").withColumn("end", F.col("doc_end"))
    whole = F.array_compact(F.array(_find(F.col("first") != "book", "missing-id", F.lit("a document starts with \\id"), F.lit(0), F.lit(0)), _find((F.col("first") == "book") & (F.col("n") == 1), "empty-book", F.lit("nothing but an \\id line"), "end", "end")))
    return out.unionByName(top.select("doc_id", F.lit(-1).alias("seq"), F.explode(whole).alias("f")).select("doc_id", "seq", "f.*"))


def _columns(nodes: DataFrame) -> DataFrame:
    row = F.slice("path", 1, F.col("depth") - 1)
    cells = nodes.where("kind = 'cell'").withColumn("row", row)
    w = Window.partitionBy("doc_id", "row").orderBy("seq")
    expected = F.lag(F.least(F.col("col") + F.col("colspan"), F.lit(255)), 1, 1).over(w)
    bad = cells.withColumn("expected", expected).where("col <> expected")
    return bad.select("doc_id", "seq", F.lit("unexpected-table-column").alias("code"), F.concat(F.lit("column "), F.col("col"), F.lit(" where "), F.col("expected"), F.lit(" was due")).alias("message"), "span_start", "span_end")


def _chapters(nodes: DataFrame) -> DataFrame:
    chapters = nodes.where("kind = 'chapter_start'").withColumn("n", F.col("number").cast("bigint"))
    w = Window.partitionBy("doc_id", "book_seq").orderBy("seq")
    nth = F.row_number().over(Window.partitionBy("doc_id", "book_seq", "n").orderBy("seq"))
    found = chapters.withColumn("before", F.lag("n").over(w)).withColumn("nth", nth)
    code = F.when(F.col("nth") > 1, "duplicate-chapter-number").when(F.col("n") < F.col("before"), "chapter-out-of-order")
    message = F.when(F.col("nth") > 1, F.concat(F.lit("chapter "), "number", F.lit(" again"))).otherwise(F.concat(F.lit("chapter "), "number", F.lit(" after "), F.col("before")))
    return found.select("doc_id", "seq", code.alias("code"), message.alias("message"), "span_start", "span_end").where("code is not null")


def verse_parts(verses: DataFrame) -> DataFrame:
    """Parts (lo, hi, part, ord) of verse numbers: both ends, and the numbers between as one."""
    ranges = verses.select("doc_id", "chapter_seq", "seq", F.posexplode("ranges").alias("k", "r"))
    part = lambda lo, hi, seg, o: F.struct(lo.alias("lo"), hi.alias("hi"), F.when(seg != "", seg).alias("part"), F.lit(o).alias("o"))
    a, b, x, y = (F.col(f"r.{c}") for c in ("start", "end", "start_part", "end_part"))
    parts = F.array_compact(F.array(part(a, a, x, 0), F.when(b > a + 1, part(a + 1, b - 1, F.lit(""), 1)), F.when((b != a) | ((y != "") & (y != x)), part(b, b, y, 2))))
    return ranges.select("doc_id", "chapter_seq", "seq", "k", F.explode(parts).alias("p")).select("doc_id", "chapter_seq", "seq", (F.col("k") * 3 + F.col("p.o")).alias("ord"), "p.lo", "p.hi", "p.part")


def _verses(nodes: DataFrame) -> DataFrame:
    verses = nodes.where("kind = 'verse_start' and chapter is not null").withColumn("plain", (F.size("ranges") == 1) & (F.col("ranges")[0]["start"] == F.col("ranges")[0]["end"]) & (F.col("ranges")[0]["start_part"] == "") & (F.col("ranges")[0]["end_part"] == ""))
    here = ["doc_id", "chapter_seq"]
    w = Window.partitionBy(*here).orderBy("seq")
    first, last = F.col("ranges")[0], F.element_at("ranges", -1)
    start = F.struct(first["start"].alias("n"), first["start_part"].alias("p"))
    end = F.struct(last["end"].alias("n"), F.when((last["start"] == last["end"]) & (last["end_part"] == ""), last["start_part"]).otherwise(last["end_part"]).alias("p"))
    # Chapters of plain numbers only need no join: the second of a number repeats the first.
    simple = F.min("plain").over(Window.partitionBy(*here))
    verses = verses.withColumn("simple", simple).withColumn("start", start).withColumn("before", F.lag(end).over(w)).withColumn("nth", F.row_number().over(Window.partitionBy(*here, "number").orderBy("seq")))
    mixed = verse_parts(verses.where("not simple"))
    p, q = mixed.alias("p"), mixed.select("doc_id", "chapter_seq", F.col("seq").alias("q_seq"), F.col("lo").alias("q_lo"), F.col("hi").alias("q_hi"), F.col("part").alias("q_part")).alias("q")
    met = p.join(q, here).where("q_seq < seq and q_lo <= hi and q_hi >= lo and (part is null or q_part is null or part = q_part)")
    named = F.struct(F.col("ord"), F.greatest("lo", "q_lo").alias("n"), F.when(F.col("lo") == F.col("hi"), F.coalesce("part", F.lit(""))).otherwise("").alias("p"))
    repeated = met.groupBy("doc_id", "seq").agg(F.min(named).alias("k")).select("doc_id", "seq", F.concat(F.col("k.n"), F.col("k.p")).alias("again"))
    verses = verses.join(repeated, ["doc_id", "seq"], "left")
    again = F.when(F.col("simple") & (F.col("nth") > 1), F.col("number")).when(~F.col("simple"), F.col("again"))
    show = lambda c: F.concat(F.col(f"{c}.n"), F.col(f"{c}.p"))
    code = F.when(again.isNotNull(), "duplicate-verse-number").when(F.col("start") < F.col("before"), "verse-out-of-order")
    message = F.when(again.isNotNull(), F.concat(F.lit("verse "), again, F.lit(" again in chapter "), "chapter")).otherwise(F.concat(F.lit("verse "), show("start"), F.lit(" after "), show("before"), F.lit(" in chapter "), "chapter"))
    return verses.select("doc_id", "seq", code.alias("code"), message.alias("message"), "span_start", "span_end").where("code is not null")


def analyze(nodes: DataFrame, lengths: DataFrame | None = None, sheet: Sheet | None = None) -> DataFrame:
    """All findings: doc_id, span_start, span_end, severity, code, message, seq, pass (1)."""
    rows = with_context(nodes)
    found = _row_checks(rows, lengths, sheet).unionByName(_columns(nodes)).unionByName(_chapters(rows)).unionByName(_verses(rows))
    severity = F.create_map(*[F.lit(x) for c, (s, _) in CODES.items() for x in (c, s)])
    return found.withColumn("severity", severity[F.col("code")]).withColumn("pass", F.lit(1))


_FOUND = pa.schema([("doc_id", pa.string()), ("span_start", pa.int64()), ("span_end", pa.int64()), ("severity", pa.string()), ("code", pa.string()), ("message", pa.string()), ("seq", pa.int32()), ("pass", pa.int32())])


def of_documents(docs: DataFrame, sheet: Sheet | None = None, reader: Callable[..., Document] = parse, parser: bool = False) -> DataFrame:
    """All findings in (doc_id, text), as ``analyze`` has them of its nodes with the lengths, and
    with ``parser`` those of the parser (pass 0). One pass, in which only findings leave Python."""

    def run(batches):
        out: list[tuple] = []

        def taken():
            part = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), _FOUND)], schema=_FOUND)
            out.clear()
            return part

        for b in batches:
            texts = b.column(1)
            for i, ident in enumerate(b.column(0).cast(pa.string()).to_pylist()):
                doc = reader(texts[i].as_py() or "", sheet)
                out += [(ident, a, z, CODES[code][0], code, message, seq, 1) for seq, code, message, a, z in findings(doc, sheet)]
                if parser and doc.diagnostics:
                    at = ByteOffsets(doc.source)
                    out += [(ident, at(d.start), at(d.end), d.severity, d.code, d.message, k, 0) for k, d in enumerate(doc.diagnostics)]
                if len(out) >= ROWS:
                    yield taken()
        if out:
            yield taken()

    return dealt(docs.select("doc_id", "text")).mapInArrow(run, "doc_id string, span_start bigint, span_end bigint, severity string, code string, message string, seq int, pass int")
