"""From documents to texts of a format: the whole path as one plan."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html, writers
from ..functions.fixes import fix_source, format_source
from ..functions.parser import parse
from ..functions.replacements import Replacements
from ..functions.style import Sheet
from ..functions.usx import read_usx
from ..operators import checks, diagnostics
from ..sources import markup

FORMATS = {"usfm": writers.to_markup, "usx": writers.to_usx, "json": writers.to_json, "html": html.to_html, "sile": writers.to_sile}
READERS = {"usfm": parse, "usx": read_usx}


def _in_parts(function, out: str):
    """Arrow batches of (doc_id, out) of batches of (doc_id, text), as many as their size asks
    for: a batch of the engine has ten thousand texts."""

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).cast(pa.string()), b.column(1)
            first, size, made = 0, 0, []
            for i in range(b.num_rows):
                t = texts[i].as_py() or ""
                made.append(function(t))
                size += len(t) + len(made[-1] or "")
                if size >= markup.CHARACTERS or i + 1 == b.num_rows:
                    yield pa.RecordBatch.from_arrays([ids[first : i + 1], pa.array(made, pa.string())], names=["doc_id", out])
                    first, size, made = i + 1, 0, []

    return run


def per_text(docs: DataFrame, function, out: str = "value") -> DataFrame:
    """(doc_id, out) of a function of one text, over Arrow batches."""
    return markup.dealt(docs.select("doc_id", "text")).mapInArrow(_in_parts(function, out), f"doc_id string, {out} string")


def render(docs: DataFrame, form: str, source: str = "usfm", sheet: Sheet | None = None, rules: str | None = None) -> DataFrame:
    """(doc_id, value): documents in ``source`` written as ``form``, after replacement rules."""
    if form not in FORMATS:
        raise ValueError(f"{form} needs a pair of documents" if form in ("prompt", "diglot") else f"unknown format {form}")
    write, read = FORMATS[form], READERS[source]
    replace = Replacements(rules) if rules else None

    def one(text: str) -> str:
        doc = read(text, sheet)
        if replace:
            replace.apply_to(doc)
        return write(doc)

    return per_text(docs, one)


def render_pairs(pairs: DataFrame) -> DataFrame:
    """(doc_id, value) of (doc_id, left, right): two columns of HTML."""

    def run(batches):
        for b in batches:
            out = [html.diglot(parse(x or ""), parse(y or "")) for x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(out, pa.string())], names=["doc_id", "value"])

    return pairs.select("doc_id", "left", "right").mapInArrow(run, "doc_id string, value string")


def prompts(woven: DataFrame) -> DataFrame:
    """(doc_id, value) of woven sections, each pair in its two dialects."""
    piece = F.concat(F.lit('<lang dialect="a">'), "left", F.lit('</lang>\n<lang dialect="b">'), "right", F.lit("</lang>\n\n"))
    parts = woven.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ord", piece.alias("p")))).alias("ps"))
    return parts.select("doc_id", F.array_join(F.transform("ps", lambda x: x["p"]), "").alias("value"))


def diagnosed(docs: DataFrame, sheet: Sheet | None = None, lint: dict[str, str] | None = None, source: str = "usfm") -> DataFrame:
    """Diagnostics of parser and checks together, after lint levels."""
    found = checks.of_documents(docs, sheet, READERS[source], parser=True)
    return diagnostics.apply_lint(found, lint or {})


def fixed(docs: DataFrame, sheet: Sheet | None = None, only: tuple[str, ...] | None = None) -> DataFrame:
    """(doc_id, value): texts after all fixes. The loop is inside the call for one document."""
    return per_text(docs, lambda t: fix_source(t, sheet, only)[0])


def formatted(docs: DataFrame, sheet: Sheet | None = None, force: bool = False) -> DataFrame:
    """(doc_id, value): canonical texts, null for documents with errors."""
    return per_text(docs, lambda t: format_source(t, sheet, force))


def write(rendered: DataFrame, path: str) -> None:
    """One text file a document, in a folder by doc_id."""
    rendered.repartition("doc_id").select("doc_id", "value").write.partitionBy("doc_id").mode("overwrite").text(path)
