"""Scans: documents of markup as node and diagnostic tables.

Parsing is one Arrow function over whole documents: every rule shares one cursor, so there is
nothing in it for the optimiser. What comes out is relational. A node row has its path, its
number ``seq`` in document order and the number ``seq_end`` of its last descendant, so that
ancestors are a range condition, and the scopes that a walk knows anyway (nearest paragraph,
note, cell, character styles) as columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.parser import ByteOffsets, Document, parse
from ..functions.style import Sheet
from ..plans.stored import materialize

RANGE = pa.struct([("start", pa.int64()), ("start_part", pa.string()), ("end", pa.int64()), ("end_part", pa.string())])
ATTRIBUTE = pa.struct([("name", pa.string()), ("value", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
NODE = pa.struct(
    [("seq", pa.int32()), ("seq_end", pa.int32()), ("path", pa.list_(pa.int32())), ("depth", pa.int32()), ("kind", pa.string()), ("marker", pa.string()), ("content", pa.string())]
    + [(k, pa.string()) for k in ("code", "description", "number")]
    + [("ranges", pa.list_(RANGE))]
    + [(k, pa.string()) for k in ("alt_number", "pub_number", "caller", "category", "title")]
    + [("attributes", pa.list_(ATTRIBUTE)), ("pipe_start", pa.int64()), ("header", pa.bool_()), ("alignment", pa.string()), ("col", pa.int32()), ("colspan", pa.int32()), ("span_start", pa.int64()), ("span_end", pa.int64())]
    + [("para", pa.string()), ("note", pa.string()), ("in_cell", pa.bool_()), ("in_char", pa.bool_()), ("char_depth", pa.int32()), ("chars", pa.list_(pa.string())), ("block", pa.int32()), ("direct", pa.bool_())]
)
FOUND = pa.struct([("span_start", pa.int64()), ("span_end", pa.int64()), ("severity", pa.string()), ("code", pa.string()), ("message", pa.string()), ("seq", pa.int32())])
_SQL = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean"}
_FIELDS = [f.name for f in NODE]


def _ddl(t: pa.DataType) -> str:
    if pa.types.is_list(t):
        return f"array<{_ddl(t.value_type)}>"
    if pa.types.is_struct(t):
        return "struct<" + ",".join(f"`{f.name}`:{_ddl(f.type)}" for f in t) + ">"
    return _SQL[t]


#: What a walk knows of every node, in the order of its row tuples; other fields are null on most
#: nodes and are kept by row number until the arrays are made.
_DENSE = ("seq", "path", "depth", "kind", "marker", "content", "para", "note", "in_cell", "in_char", "char_depth", "chars", "block", "direct")


class NodeColumns:
    """Nodes of many documents as the columns ``fields`` of the node table."""

    def __init__(self, fields: tuple[str, ...] = tuple(_FIELDS)):
        self.fields = [f for f in NODE if f.name in fields]
        self.names = [f.name for f in self.fields if f.name not in (*_DENSE, "seq_end", "span_start", "span_end")]
        self.offsets = [0]
        self.clear()

    def clear(self) -> None:
        self.rows: list[tuple] = []
        self.ends: list[int] = []
        self.spans: tuple[list, list] = ([], [])
        self.sparse: dict[str, dict[int, object]] = {f: {} for f in self.names}

    def add(self, doc: Document) -> None:
        for _ in self.adding(doc):
            pass
        self.offsets.append(len(self.rows))

    def adding(self, doc: Document, limit: int | None = None) -> Iterator[None]:
        """Add the nodes of a document, and stop at every ``limit`` rows for the caller to take
        ``array``; the tree is then given up on the way. Nodes not yet left stay for the next one."""
        at = ByteOffsets(doc.source)
        rows, ends, sparse = self.rows, self.ends, self.sparse
        starts, stops, above = [], [], []  # ``above``: [row, depth] of nodes not yet left
        seq = -1
        stack = [(b, [i], None, None, False, False, 0, [], None) for i, b in reversed(list(enumerate(doc.blocks)))]
        if limit is not None:
            doc.blocks.clear()
        while stack:
            node, path, para, note, cell, in_char, depth, chars, block = stack.pop()
            seq += 1
            level, kind = len(path), node.kind
            while above and above[-1][1] >= level:
                ends[above.pop()[0]] = seq - 1
            row = len(rows)
            if limit is not None and row >= limit:
                self.spans[0].extend(at.many(starts))
                self.spans[1].extend(at.many(stops))
                starts, stops = [], []
                kept = [r for r, _ in above]
                left = [rows[r] for r in kept], [ends[r] for r in kept], [[x[r] for r in kept] for x in self.spans], {f: {i: x[r] for i, r in enumerate(kept) if r in x} for f, x in sparse.items()}
                self.drop(kept)
                yield
                self.rows, self.ends, self.spans, self.sparse = left
                rows, ends, sparse = self.rows, self.ends, self.sparse
                for i, a in enumerate(above):
                    a[0] = i
                row = len(rows)
            rows.append((seq, path, level, kind, node.marker, node.content, para, note, cell, in_char, depth, chars, block, level == 2 and para is not None))
            ends.append(seq)
            starts.append(node.start)
            stops.append(node.end)
            if node.data:
                for k, v in node.data.items():
                    if k in sparse and v is not None:
                        sparse[k][row] = v
            if node.attributes is not None:
                if "attributes" in sparse:
                    sparse["attributes"][row] = [(n, v, at(a), at(b)) for n, v, a, b in node.attributes]
                if node.pipe is not None and "pipe_start" in sparse:
                    sparse["pipe_start"][row] = at(node.pipe)
            if not node.children:
                continue
            above.append([row, level])
            if kind == "para":
                para, note, cell, in_char, depth, chars, block = node.marker, None, False, False, 0, [], seq
            elif kind == "cell":
                para, note, cell, in_char, depth, chars, block = None, None, True, False, 0, [], seq
            elif kind == "char":
                in_char, depth, chars = True, depth + 1, [*chars, node.marker]
            elif kind == "note":
                note, in_char, block = node.marker, False, seq
            elif kind in ("sidebar", "periph", "table", "row"):
                para = note = None
            i = len(node.children)
            for c in reversed(node.children):
                i -= 1
                stack.append((c, [*path, i], para, note, cell, in_char, depth, chars, block))
            if limit is not None:
                node.children = ()
        for row, _ in above:
            ends[row] = seq
        self.spans[0].extend(at.many(starts))
        self.spans[1].extend(at.many(stops))

    def drop(self, gone: list[int]) -> None:
        """Take out the rows ``gone``, in their order."""
        if not gone:
            return
        out = set(gone)
        stay = [r for r in range(len(self.rows)) if r not in out]
        new = {r: i for i, r in enumerate(stay)}
        self.rows, self.ends = [self.rows[r] for r in stay], [self.ends[r] for r in stay]
        self.spans = tuple([x[r] for r in stay] for x in self.spans)
        self.sparse = {f: {new[r]: v for r, v in x.items() if r in new} for f, x in self.sparse.items()}

    def array(self) -> pa.Array:
        """The nodes added, a list for each document."""
        return pa.ListArray.from_arrays(pa.array(self.offsets, pa.int32()), self.struct())

    def struct(self) -> pa.StructArray:
        n = len(self.rows)
        dense = dict(zip(_DENSE, zip(*self.rows))) if n else {}
        dense |= {"seq_end": self.ends, "span_start": self.spans[0], "span_end": self.spans[1]}
        arrays = []
        for f in self.fields:
            some = self.sparse.get(f.name)
            if some is not None:
                if not some:
                    arrays.append(pa.nulls(n, f.type))
                    continue
                if f.name in ("ranges", "attributes"):
                    arrays.append(_lists(f.type, n, some))
                    continue
                values = [None] * n
                for i, v in some.items():
                    values[i] = v
            else:
                values = dense.get(f.name, ())
            if f.name in ("path", "chars"):
                offsets = np.zeros(n + 1, np.int32)
                np.cumsum([len(v) for v in values], out=offsets[1:])
                arrays.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(list(chain.from_iterable(values)), f.type.value_type)))
            else:
                arrays.append(pa.array(values, f.type))
        return pa.StructArray.from_arrays(arrays, fields=self.fields)


def _lists(kind: pa.DataType, n: int, some: dict[int, object]) -> pa.Array:
    """A column of ``n`` lists of structs, null but for the rows of ``some``."""
    sizes = np.zeros(n, np.int32)
    for i, v in some.items():
        sizes[i] = len(v)
    null = np.ones(n, bool)
    null[list(some)] = False
    flat = [x for i in sorted(some) for x in some[i]]
    fields = list(kind.value_type)
    parts = [pa.array([getattr(x, f.name) for x in flat] if kind.value_type == RANGE else [x[k] for x in flat], f.type) for k, f in enumerate(fields)]
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, fields=fields), mask=pa.array(null))


def diagnostic_rows(doc: Document) -> list[dict]:
    at = ByteOffsets(doc.source)
    return [{"span_start": at(d.start), "span_end": at(d.end), "severity": d.severity, "code": d.code, "message": d.message, "seq": i} for i, d in enumerate(doc.diagnostics)]


def dealt(docs: DataFrame) -> DataFrame:
    """``docs`` over all cores where its scan would leave some of them idle, as by the size of
    its plan; parsing takes far longer than this shuffle. Anything larger stays as it is."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return docs.repartition(2 * cores, "doc_id") if size < cores * split else docs


def parsed(docs: DataFrame, sheet: Sheet | None = None, ends: bool = True, reader: Callable[..., Document] = parse, fields: tuple[str, ...] | None = None, diagnostics: bool = True) -> DataFrame:
    """(doc_id, nodes, diagnostics, length) of (doc_id, text); filter documents before this,
    nothing can be pushed through it. Null texts are empty documents.

    ``fields`` are the columns of the node table to make (none: () ), and without
    ``diagnostics`` that list is empty: nothing is made that nobody reads. A plan with several
    branches reads a ``stored`` result, as each branch of this one would parse again.
    """
    wanted = tuple(_FIELDS) if fields is None else fields
    node = pa.struct([f for f in NODE if f.name in wanted]) if wanted else pa.struct([NODE.field("seq")])
    schema = pa.schema([("doc_id", pa.string()), ("nodes", pa.list_(node)), ("diagnostics", pa.list_(FOUND)), ("length", pa.int64())])

    def run(batches):
        for b in batches:
            ids, texts = b.column(0).cast(pa.string()), b.column(1)
            for lo in range(0, b.num_rows, 64):
                found, sizes, columns = [], [], NodeColumns(wanted or ("seq",))
                for t in texts[lo : lo + 64].to_pylist():
                    doc = reader(t or "", sheet, ends)
                    if wanted:
                        columns.add(doc)
                    else:
                        columns.offsets.append(0)
                    found.append(diagnostic_rows(doc) if diagnostics and doc.diagnostics else [])
                    sizes.append(len(t or "") if (t or "").isascii() else len(t.encode()))
                yield pa.RecordBatch.from_arrays([ids[lo : lo + 64], columns.array(), pa.array(found, pa.list_(FOUND)), pa.array(sizes, pa.int64())], schema=schema)

    return dealt(docs.select("doc_id", "text")).mapInArrow(run, ", ".join(f"{f.name} {_ddl(f.type)}" for f in schema))


#: Rows of nodes that are made at once, whatever the number and size of their documents.
ROWS = 8192
#: And characters of documents whose results are held.
CHARACTERS = 1 << 22


def node_rows(docs: DataFrame, sheet: Sheet | None = None, ends: bool = True, reader: Callable[..., Document] = parse, fields: tuple[str, ...] | None = None) -> DataFrame:
    """The node table of (doc_id, text): ``nodes(parsed(docs))`` without a row that holds a whole
    document, so that neither its makers nor its readers hold more than some thousand nodes.
    The rows of a document are in no order.
    """
    wanted = tuple(_FIELDS) if fields is None else fields
    schema = pa.schema([("doc_id", pa.string()), *(f for f in NODE if f.name in wanted)])

    def run(batches):
        columns, ids = NodeColumns(wanted), []

        def taken():
            part = columns.struct()
            names = pa.array(chain.from_iterable(repeat(i, n) for i, n in ids), pa.string())
            ids.clear()
            columns.clear()
            return pa.RecordBatch.from_arrays([names, *part.flatten()], schema=schema)

        for b in batches:
            texts = b.column(1)
            for i, ident in enumerate(b.column(0).cast(pa.string()).to_pylist()):
                before = len(columns.rows)
                for _ in columns.adding(reader(texts[i].as_py() or "", sheet, ends), ROWS):
                    ids.append((ident, len(columns.rows) - before))
                    yield taken()
                    before = 0
                ids.append((ident, len(columns.rows) - before))
                if len(columns.rows) >= ROWS:
                    yield taken()
        yield taken()

    return dealt(docs.select("doc_id", "text")).mapInArrow(run, ", ".join(f"{f.name} {_ddl(f.type)}" for f in schema))


def walked(docs: DataFrame, walk: Callable[[Document], Iterator[tuple]], schema: pa.Schema, sheet: Sheet | None = None, reader: Callable[..., Document] = parse) -> DataFrame:
    """(doc_id, and the columns ``schema``) of what ``walk`` gives of each of (doc_id, text)."""
    schema = pa.schema([pa.field("doc_id", pa.string()), *schema])

    def run(batches):
        rows: list[tuple] = []
        size = 0

        def taken():
            nonlocal size
            part = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
            rows.clear()
            size = 0
            return part

        for b in batches:
            texts = b.column(1)
            for i, ident in enumerate(b.column(0).cast(pa.string()).to_pylist()):
                text = texts[i].as_py() or ""
                size += len(text)
                for row in walk(reader(text, sheet, True)):
                    rows.append((ident, *row))
                    if len(rows) >= ROWS:
                        yield taken()
                if rows and size >= CHARACTERS:
                    yield taken()
        if rows:
            yield taken()

    return dealt(docs.select("doc_id", "text")).mapInArrow(run, ", ".join(f"{f.name} {_ddl(f.type)}" for f in schema))


def stored(rows: DataFrame) -> DataFrame:
    """``rows`` written once into the shared folder and read from there. A reader takes 4096 rows
    at once, whatever they hold, so nodes are stored as ``node_rows``, not as lists."""
    return materialize(rows, "parsed")


def nodes(parsed_docs: DataFrame) -> DataFrame:
    return parsed_docs.select("doc_id", F.inline("nodes"))


def parser_diagnostics(parsed_docs: DataFrame) -> DataFrame:
    """doc_id, span_start, span_end, severity, code, message, seq, pass (0)."""
    return parsed_docs.select("doc_id", F.inline("diagnostics")).withColumn("pass", F.lit(0))


def scan(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(doc_id, text) of whole files; a byte order mark is dropped. ``doc_id`` is the path."""
    files = spark.read.option("pathGlobFilter", glob).text(path, wholetext=True)
    return files.select(F.input_file_name().alias("doc_id"), F.regexp_replace("value", "^﻿", "").alias("text"))


def combined(docs: DataFrame, group: str, order: str) -> DataFrame:
    """Files of a group as one document, joined by line breaks in ``order``."""
    one = docs.groupBy(F.col(group).alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct(order, "text"))).alias("parts"))
    return one.select("doc_id", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))


def appended(nodes: DataFrame, groups: DataFrame) -> DataFrame:
    """Node tables of several documents as one each: ``groups`` is (doc_id, group, ord). Paths
    and node numbers move behind those of the documents before; spans stay those of the file,
    whose id is kept as ``file``. Markers are names, so styles need no translation."""
    size = nodes.groupBy("doc_id").agg(F.max(F.col("path")[0] + 1).alias("_b"), F.max(F.col("seq") + 1).alias("_n"))
    w = Window.partitionBy("group").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    moved = groups.join(size, "doc_id", "left").select("doc_id", "group", F.coalesce(F.sum("_b").over(w), F.lit(0)).cast("int").alias("_blocks"), F.coalesce(F.sum("_n").over(w), F.lit(0)).cast("int").alias("_nodes"))
    rows = nodes.join(moved, "doc_id")
    path = F.concat(F.array(F.col("path")[0] + F.col("_blocks")), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))))
    new = {"doc_id": F.col("group"), "path": path, "seq": F.col("seq") + F.col("_nodes"), "seq_end": F.col("seq_end") + F.col("_nodes"), "block": F.col("block") + F.col("_nodes")}
    return rows.select(*(new.get(c, F.col(c)).alias(c) for c in nodes.columns), F.col("doc_id").alias("file"))
