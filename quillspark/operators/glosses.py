"""Interlinear verses and lexicons as tables: anchoring and gloss lookup."""

from __future__ import annotations

from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.interlinear import Cluster, Lexicon, ProjectError, Verse, anchor, read_lexicon, scan_interlinear
from ..plans.stored import materialize
from ..sources.markup import ROWS

CLUSTERS = "reference string, ord int, chapter long, verse long, approved boolean, clusters array<struct<index:int,length:int,excluded:boolean,lexemes:array<struct<id:string,sense:string>>>>"


def verse_table(spark, verses: list[Verse]) -> DataFrame:
    rows = [(v.reference, i, v.place and v.place[0], v.place and v.place[1], v.approved is not None, [(c.index, c.length, c.excluded, c.lexemes) for c in v.clusters]) for i, v in enumerate(verses)]
    return spark.createDataFrame(rows, CLUSTERS)


_CLUSTER = pa.struct([("index", pa.int32()), ("length", pa.int32()), ("excluded", pa.bool_()), ("lexemes", pa.list_(pa.struct([("id", pa.string()), ("sense", pa.string())])))])
_VERSE = pa.schema([("doc_id", pa.string()), ("reference", pa.string()), ("ord", pa.int32()), ("chapter", pa.int64()), ("verse", pa.int64()), ("approved", pa.bool_()), ("clusters", pa.list_(_CLUSTER))])
_SENSE = pa.schema([("doc_id", pa.string()), ("kind", pa.string()), ("form", pa.string()), ("homograph", pa.int32()), ("place", pa.int32()), ("sense_no", pa.int32()), ("sense", pa.string()), ("language", pa.string()), ("gloss", pa.string())])


def read_verses(files: DataFrame) -> DataFrame:
    """Interlinear files (doc_id, text) as rows of ``CLUSTERS`` with their doc_id. A file that
    can't be read has no rows; null texts neither."""

    def run(batches):
        for b in batches:
            texts = b.column(1)
            for i, ident in enumerate(b.column(0).to_pylist()):
                text = texts[i].as_buffer()
                try:
                    yield from _verse_batches(ident, text.to_pybytes() if text is not None else b"")
                except ProjectError:
                    continue

    return files.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "doc_id string, " + CLUSTERS)


def _verse_batches(ident: str | None, xml: bytes) -> list[pa.RecordBatch]:
    """The rows of a file, as Arrow batches while it is read: nothing may leave before its end,
    and of a verse given twice the last row stays with the place of the first."""
    parts: list[pa.RecordBatch] = []
    rows: list[tuple] = []
    places: dict[str, int] = {}
    last, n = array("q"), 0  # by place, the number of the row that counts

    def pack() -> None:
        parts.append(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _VERSE)], schema=_VERSE))
        rows.clear()

    def found(v: Verse) -> None:
        nonlocal n
        at = places.setdefault(v.reference, len(places))
        if at == len(last):
            last.append(n)
        else:
            last[at] = n
        n += 1
        clusters = [{"index": c.index, "length": c.length, "excluded": c.excluded, "lexemes": [{"id": x, "sense": y} for x, y in c.lexemes]} for c in v.clusters]
        place = v.place
        rows.append((ident, v.reference, at, place and place[0], place and place[1], v.approved is not None, clusters))
        if len(rows) >= ROWS:
            pack()

    scan_interlinear(xml, found)
    if rows:
        pack()
    if len(places) < n:
        kept = np.zeros(n, bool)
        kept[np.frombuffer(last, np.int64)] = True
        ends = np.cumsum([0, *(p.num_rows for p in parts)])
        parts = [p.filter(pa.array(kept[a:z])) for p, a, z in zip(parts, ends, ends[1:])]
    return parts


def read_lexicons(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """entries(kind, form, homograph, entry) and glosses(entry, sense_no, sense, language, gloss)
    of lexicon files (doc_id, text); ``entry`` is a hash of the file and the place in it."""

    def run(batches):
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    found = read_lexicon(t or "")
                except ProjectError:
                    continue
                for k, (key, senses) in enumerate(found.entries.items()):
                    base = dict(zip(("kind", "form", "homograph"), key)) | {"doc_id": i, "place": k}
                    rows.append(base)
                    rows += [base | {"sense_no": n, "sense": ident, "language": lang, "gloss": g} for n, (ident, gs) in enumerate(senses) for lang, g in gs]
            yield pa.RecordBatch.from_pylist(rows, schema=_SENSE)

    rows = files.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInArrow(run, "doc_id string, kind string, form string, homograph int, place int, sense_no int, sense string, language string, gloss string")
    rows = materialize(rows.withColumn("entry", F.xxhash64("doc_id", "place")), "lexicon")
    return rows.where("sense_no is null").select("kind", "form", "homograph", "entry"), rows.where("sense_no is not null").select("entry", "sense_no", "sense", "language", "gloss")


def anchored(verses: DataFrame, texts: DataFrame) -> DataFrame:
    """(chapter, verse, kind word|parse|phrase|dropped, cluster, start, stop, ambiguous,
    reason): clusters joined with (chapter, verse, text). An ordered greedy choice inside a
    verse, so one call a verse; verses stay in parallel."""
    rows = verses.join(texts, ["chapter", "verse"]).select("chapter", "verse", "text", "clusters")
    item = pa.struct([("kind", pa.string()), ("cluster", pa.int32()), ("start", pa.int32()), ("stop", pa.int32()), ("ambiguous", pa.bool_()), ("reason", pa.string())])

    def run(batches):
        for b in batches:
            out = []
            for c, v, text, clusters in zip(*(x.to_pylist() for x in b.columns)):
                got = anchor(text or "", [Cluster(k["index"], k["length"], [(x["id"], x["sense"]) for x in k["lexemes"]], k["excluded"]) for k in clusters])
                found = [{"kind": kind, "cluster": i, "start": w, "stop": w + 1, "ambiguous": amb, "reason": None} for w, gloss, parse, amb in got["words"] for kind, i in (("word", gloss), ("parse", parse)) if i is not None]
                found += [{"kind": "phrase", "cluster": i, "start": a, "stop": z, "ambiguous": amb, "reason": None} for a, z, i, amb in got["phrases"]]
                found += [{"kind": "dropped", "cluster": i, "start": None, "stop": None, "ambiguous": None, "reason": r} for i, r in got["dropped"]]
                out.append({"chapter": c, "verse": v, "found": found})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("chapter", pa.int64()), ("verse", pa.int64()), ("found", pa.list_(item))]))

    got = rows.mapInArrow(run, "chapter long, verse long, found array<struct<kind:string,cluster:int,start:int,stop:int,ambiguous:boolean,reason:string>>")
    return got.select("chapter", "verse", F.inline("found"))


def lexicon_tables(spark, lexicon: Lexicon) -> tuple[DataFrame, DataFrame]:
    """entries(kind, form, homograph, entry) and glosses(entry, sense_no, sense, language, gloss)."""
    entries, glosses = [], []
    for i, (key, senses) in enumerate(lexicon.entries.items()):
        entries.append((*key, i))
        glosses += [(i, k, ident, lang, t) for k, (ident, gs) in enumerate(senses) for lang, t in gs]
    return spark.createDataFrame(entries, "kind string, form string, homograph int, entry int"), spark.createDataFrame(glosses, "entry int, sense_no int, sense string, language string, gloss string")


def glossed(lexemes: DataFrame, entries: DataFrame, glosses: DataFrame, language: str) -> DataFrame:
    """``lexemes`` (id, sense) plus gloss. A chosen sense is looked up by its id, first holder
    first; only without one the entry's first sense with a gloss in the language counts."""
    ident = "^(\\w+):(.*?)(?::([0-9]+))?$"
    keyed = lexemes.withColumn("_row", F.monotonically_increasing_id()).withColumn("kind", F.regexp_extract("id", ident, 1)).withColumn("form", F.regexp_extract("id", ident, 2)).withColumn("homograph", F.coalesce(F.expr("try_cast(regexp_extract(id, '" + ident.replace("\\", "\\\\") + "', 3) as int)"), F.lit(1)))
    owner = glosses.where("sense is not null").withColumn("_k", F.row_number().over(Window.partitionBy("sense", F.lower("language")).orderBy("entry", "sense_no")))
    first_holder = glosses.where("sense is not null").groupBy("sense").agg(F.min(F.struct("entry", "sense_no")).alias("h"))
    chosen = owner.where("_k = 1").where(F.lower("language") == language.lower()).join(first_holder, "sense").where("entry = h.entry and sense_no = h.sense_no").select("sense", F.col("gloss").alias("by_sense"))
    usual = glosses.where(F.lower("language") == language.lower()).groupBy("entry").agg(F.min_by("gloss", "sense_no").alias("by_entry"))
    out = keyed.join(chosen, "sense", "left").join(entries, ["kind", "form", "homograph"], "left").join(usual, "entry", "left")
    return out.select(*lexemes.columns, F.when(F.coalesce("sense", F.lit("")) != "", F.col("by_sense")).otherwise(F.col("by_entry")).alias("gloss"))
