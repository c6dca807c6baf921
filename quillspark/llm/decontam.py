"""Benchmark decontamination by Wu-Manber search over words (op 4).

A pattern is a window of consecutive benchmark words, so words serve as the alphabet: the
shift table is keyed by the block of two words that ends a search window, the suffix bucket
by the same block where the shift is zero, and a direct comparison of word tuples confirms.
Most blocks of ordinary text stand in no pattern, so the search skips nearly a whole window
at each step. Patterns of different lengths go into a few length classes, each with its own
tables, so that one short item doesn't shorten every skip.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table, utf8

WINDOW = 13
CONTAMINATED_SHARE = 20  # hit words * 20 >= words
#: Shared words that make a passage whatever the length of the document; windows of shorter
#: items are ordinary phrases and count by their share of the words only.
PASSAGE_WORDS = 8
#: Benchmark bytes in one set of tables, which take some 90 times as much in each worker; a
#: larger benchmark is searched in so many blocks.
BLOCK_BYTES = 4 << 20
_WORD = bytes(x if x >= 0x80 or chr(x) in "0123456789abcdefghijklmnopqrstuvwxyz" else x + 32 if 65 <= x <= 90 else 32 for x in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD).split() if text else []


class WuManber:
    """Tables over patterns ``{tuple of words: [pattern ids]}`` of at least ``m`` words each."""

    def __init__(self, patterns: dict[tuple, list[int]]):
        self.m = m = min(map(len, patterns))
        self.block = b = min(2, m)
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, list[tuple[tuple, list[int]]]] = defaultdict(list)
        for p, ids in patterns.items():
            for end in range(b, m + 1):
                key = p[end - b : end]
                self.shift[key] = min(self.shift.get(key, m), m - end)
            self.bucket[p[m - b : m]].append((p, ids))
        if b == 2:  # keyed by text rather than tuples: one join instead of a slice per step
            self.shift = {k[0] + b" " + k[1]: v for k, v in self.shift.items()}
            self.bucket = {k[0] + b" " + k[1]: v for k, v in self.bucket.items()}
        else:
            self.shift = {k[0]: v for k, v in self.shift.items()}
            self.bucket = {k[0]: v for k, v in self.bucket.items()}
        self.skip = m - b + 1

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int, list[int]]]:
        """(start, length, ids) of every occurrence."""
        at, n, m, get, skip, pair = self.m - 1, len(text), self.m, self.shift.get, self.skip, self.block == 2
        while at < n:
            key = text[at - 1] + b" " + text[at] if pair else text[at]
            step = get(key, skip)
            if step == 0:
                start = at - m + 1
                for p, ids in self.bucket[key]:
                    if text[start] == p[0] and tuple(text[start : start + len(p)]) == p:
                        yield start, len(p), ids
                step = 1
            at += step


class Search:
    """All length classes over the items of one block of the benchmark."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.names = [str(i) for i, _ in items]
        classes: dict[int, dict[tuple, list[int]]] = defaultdict(dict)
        for k, (_, text) in enumerate(items):
            w = words(text.encode() if isinstance(text, str) else text)
            for s in range(max(1, len(w) - window + 1)) if w else ():
                p = tuple(w[s : s + window])
                ids = classes[(1, 1, 2, 3, 3, 5, 5, 5, 8, 8, 8, 8, 12)[len(p)] if len(p) < 13 else 13].setdefault(p, [])
                if not ids or ids[-1] != k:
                    ids.append(k)
        self.tables = [WuManber(p) for p in classes.values()]

    def scan(self, text: bytes | None) -> tuple[int, np.ndarray | None, list[str], int]:
        """(words, which are hit or None, names of the items found, longest window found)."""
        w = words(text)
        cover, longest = None, 0
        found: set[int] = set()
        for t in self.tables:
            for start, length, ids in t.find(w):
                if cover is None:
                    cover = np.zeros(len(w), dtype=bool)
                cover[start : start + length] = True
                longest = max(longest, length)
                found.update(ids)
        return len(w), cover, sorted({self.names[i] for i in found}), longest


def verdict(n: int, hit: int, items: list[str]) -> tuple:
    return n, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0 and CONTAMINATED_SHARE * hit >= n


def blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple]]:
    """Benchmark items in blocks of bounded size, one partition at a time on the driver.
    Items without an id or text have no windows and are left out."""
    block, size = [], 0
    for r in benchmark.select("item_id", "text").where("item_id is not null and text is not null").toLocalIterator():
        block.append((r[0], r[1].encode()))
        size += len(block[-1][1])
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


_COLUMNS = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A null or empty text has no words and no hits. A benchmark of one block (the usual case)
    costs one pass over the documents and no shuffle; for a larger one every block makes a
    pass, and a document's hits of all blocks meet as ranges of words under its row number.
    """
    spark = docs.sparkSession
    parts = list(_limited(blocks(benchmark, block_bytes), 2))
    if len(parts) <= 1:
        shared = spark.sparkContext.broadcast(parts[0] if parts else [])

        def run(batches):
            search = Search(shared.value, window)
            for b in batches:
                rows = []
                for t in utf8(b.column(1)):
                    n, cover, items, _ = search.scan(t)
                    rows.append(verdict(n, 0 if cover is None else int(cover.sum()), items))
                yield _batch(b.column(0), rows)

        return docs.select("doc_id", "text").mapInArrow(run, _COLUMNS)
    del parts
    keyed = materialize(docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text"), "rows")
    return _by_row(keyed, benchmark, window, block_bytes).drop("_row", "longest")


_RANGES = pa.schema([("_row", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("hits", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest", pa.int64())])


def _by_row(keyed: DataFrame, benchmark: DataFrame, window: int, block_bytes: int) -> DataFrame:
    """``decontaminate`` of (_row, doc_id, text) block by block, with the row number and the
    longest window found. ``keyed`` is a written table, so that all blocks see the same numbers."""
    spark = keyed.sparkSession
    found = None
    for items in blocks(benchmark, block_bytes):
        shared = spark.sparkContext.broadcast(items)

        def ranges(batches, shared=shared):
            search = Search(shared.value, window)
            for b in batches:
                rows = []
                for k, i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                    n, cover, items, longest = search.scan(t)
                    rows.append({"_row": k, "doc_id": i, "n": n, "hits": [] if cover is None else np.nonzero(cover)[0].tolist(), "items": items, "longest": longest})
                yield pa.RecordBatch.from_pylist(rows, schema=_RANGES)

        part = keyed.mapInArrow(ranges, "_row long, doc_id long, n long, hits array<long>, items array<string>, longest long")
        found = part if found is None else found.unionByName(part)
    grouped = found.groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.first("n").alias("n_words"),
        F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.max("longest").alias("longest"),
    )
    hit = F.size("hits").cast("long")
    return grouped.select(
        "_row",
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((hit > 0) & (hit * CONTAMINATED_SHARE >= F.col("n_words"))).alias("contaminated"),
        "longest",
    )


def _limited(it, n):
    for _, x in zip(range(n), it):
        yield x


def _batch(ids, rows) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([ids.cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())))], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, passage: int = PASSAGE_WORDS) -> DataFrame:
    """``docs`` without the rows that hold benchmark text, all columns kept.

    A row goes if a window of at least ``passage`` words occurs in it, however long its text
    is, or if hit words are a twentieth of its words. Each row is judged by its own text, so
    null and repeated ids need no rule; rows without text stay, other columns don't matter.
    No shuffle and no join for a benchmark of one block; for a larger one rows are numbered,
    written and dropped by number, with the same result.
    """
    items = list(_limited(blocks(benchmark, block_bytes), 2))
    if len(items) > 1:
        plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # no name clashes with ours
        text = plain.columns[docs.columns.index("text")]
        keyed = materialize(plain.withColumn("_row", F.monotonically_increasing_id()), "rows")
        judged = _by_row(keyed.select("_row", F.lit(None).cast("long").alias("doc_id"), F.col(text).alias("text")), benchmark, window, block_bytes)
        bad = judged.where(F.col("contaminated") | (F.col("longest") >= passage)).select("_row")
        return keyed.join(bad, "_row", "left_anti").drop("_row").toDF(*docs.columns)
    shared = docs.sparkSession.sparkContext.broadcast(items[0] if items else [])
    at = docs.columns.index("text")

    def run(batches):
        search = Search(shared.value, window)
        for b in batches:
            keep = []
            for t in utf8(b.column(at)):
                n, cover, _, longest = search.scan(t)
                keep.append(cover is None or longest < passage and CONTAMINATED_SHARE * int(cover.sum()) < n)
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op4_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_ITEM_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_ITEM_WORDS} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, least(len(ws), {WINDOW}) AS n, array_to_string(list_slice(ws, s, s + least(len(ws), {WINDOW}) - 1), ' ') AS g
      FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - {WINDOW - 1}, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
g AS (SELECT doc_id, n, s, array_to_string(list_slice(ws, s, s + n - 1), ' ') AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM p))),
m AS (SELECT doc_id, s, n, item_id FROM g JOIN p USING (n, g)),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS k FROM m) GROUP BY 1),
f AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item_id FROM m) GROUP BY 1)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND {CONTAMINATED_SHARE} * coalesce(n_hit, 0) >= len(d.ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)
"""
