"""Near duplicates by min-max hashing (op 8).

One pass gives each text its set of shingles as 64-bit hashes, and of every permutation both
the least and the greatest value: twice the signature for the same hashing, with less
variance. Bands of the signature make buckets. Texts with equal sets form a class, and only
one representative of each goes on. Candidates are tested on full sets:

1. each member with one pivot, the least member of the bucket that most of its buckets name;
   the links found give components, and a bucket belongs to the component of its pivot;
2. members of a bucket in another component ("outliers") with the head of that component;
3. outliers that fail there with all others of the component's buckets, without trying the
   pairs: if A and B are similar and B is far from the head P, then A and B must agree on many
   of the few places where A differs from P. So the differences are joined, A's by a prefix
   that must contain one such place, and only what meets is tested.

So each pair that shares a band is tested, joined by tested links, or proved too far apart,
in time and space that follow the members and not the pairs of a group of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.skew import LEAST, PARTS, join_one
from .common import materialize, table, utf8
from .components import components

BANDS, ROWS = 32, 5
PERMUTATIONS = BANDS * ROWS // 2
_U = np.uint64
_LOWER = bytes(x + 32 if 65 <= x <= 90 else x for x in range(256))
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True
_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=_U) * _U(2) + _U(1)
_BASE = _U(0x9E3779B97F4A7C15)
_BACK = _U(pow(0x9E3779B97F4A7C15, -1, 2**64))
_MULTIPLY = _random.integers(1, 2**63, PERMUTATIONS, dtype=_U) * _U(2) + _U(1)
_MIX = _random.integers(1, 2**63, (BANDS, ROWS), dtype=_U) * _U(2) + _U(1)
_powers: list[np.ndarray] = [np.ones(1, _U), np.ones(1, _U)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(14, int(n - 1).bit_length())
        for i, base in enumerate((_BASE, _BACK)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each word between ASCII white space, in order."""
    a = np.frombuffer(text, dtype=np.uint8)
    if not len(a):
        return np.zeros(0, _U)
    space = _IS_SPACE[a]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    up, down = _power(len(a) + 1)
    run = np.zeros(len(a) + 1, _U)
    np.cumsum(_BYTE[a] * up[: len(a)], out=run[1:])
    return mix((run[end] - run[start]) * down[start] + (end - start).astype(_U))


def shingles(text: bytes | None, k: int = 2) -> np.ndarray:
    """Sorted distinct hashes of ``k`` consecutive words, A-Z in lower case; the whole
    sequence if it is shorter; nothing for a text without words."""
    w = word_hashes(text.translate(_LOWER)) if text else np.zeros(0, _U)
    if not len(w):
        return w
    width = min(k, len(w))
    h = w[: len(w) - width + 1] * _U(1)
    for i in range(1, width):
        h = mix(h * _BASE + w[i : len(w) - width + 1 + i])
    if width < k:
        h = mix(h + _U(width))
    return np.unique(h)


def signature(s: np.ndarray) -> np.ndarray:
    """Minima and maxima of every permutation."""
    low, high = np.full(PERMUTATIONS, 2**64 - 1, _U), np.zeros(PERMUTATIONS, _U)
    for i in range(0, len(s), 4096):
        part = np.multiply.outer(_MULTIPLY, s[i : i + 4096])
        np.minimum(low, part.min(axis=1), out=low)
        np.maximum(high, part.max(axis=1), out=high)
    return np.concatenate((low, high))


def bands(s: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band, different between bands."""
    v = mix(signature(s)).reshape(ROWS, BANDS).T
    return mix((v * _MIX).sum(axis=1, dtype=_U) + np.arange(BANDS, dtype=_U)).view(np.int64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(mix(s * _BASE).sum(dtype=_U).view(np.int64)), int((mix(s + _BASE) * _BACK).sum(dtype=_U).view(np.int64))


def _signed(keyed: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for b in batches:
            n, d1, d2, keys = [], [], [], []
            for t in utf8(b.column(2)):
                s = shingles(t, k)
                n.append(len(s))
                x = digest(s)
                d1.append(x[0])
                d2.append(x[1])
                keys.append(bands(s) if len(s) else np.zeros(0, np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in (n, d1, d2)), arrays], names=["_row", "doc_id", "n", "d1", "d2", "bands"])

    return keyed.select("_row", "doc_id", "text").mapInArrow(run, "_row long, doc_id long, n long, d1 long, d2 long, bands array<long>")


def _sets(keyed: DataFrame, active: DataFrame, by: str, k: int, repeated: bool) -> DataFrame:
    """(node, items) of the classes in ``active`` (by, d1, d2, node), which grow with the corpus
    and so are never broadcast. Of the rows that ``by`` names those with the class's own set
    count, once."""

    def run(batches):
        for b in batches:
            nodes, d1, d2 = (b.column(c).to_pylist() for c in (1, 2, 3))
            at, found = [], []
            for i, t in enumerate(utf8(b.column(0))):
                s = shingles(t, k)
                if digest(s) == (d1[i], d2[i]):
                    at.append(nodes[i])
                    found.append(s.view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))], names=["node", "items"])

    got = keyed.select(by, "text").join(active, by).select("text", "node", "d1", "d2").mapInArrow(run, "node long, items array<long>")
    return got.dropDuplicates(["node"]) if repeated else got


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough; many may have the same b."""
    one = materialize(pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("sa")), "a"), "pairs")
    two = join_one(one, sets.select(F.col("node").alias("b"), F.col("items").alias("sb")), ["b"])
    both = F.size(F.array_intersect("sa", "sb"))
    return two.withColumn("both", both).where(100 * F.col("both") >= percent * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b").distinct()


def near_duplicates(docs: DataFrame, k: int = 2, percent: int = 80) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    Texts without words are linked with nothing. A null doc_id gets a null component and is
    kept. Each row is linked by its own text and named by ids: rows that share a doc_id get the
    components of their texts, which are named by the smallest doc_id in them. Links are exact
    for each pair that shares one of 32 bands of 5 values: two texts of similarity 0.8 miss
    all of them with a probability of 3 in a million.
    """
    named = _headed(docs.select(F.lit(None).cast("long").alias("_row"), "doc_id", "text"), "doc_id", k, percent)
    component = F.coalesce("head", "doc_id")
    return named.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def _headed(keyed: DataFrame, by: str, k: int, percent: int) -> DataFrame:
    """(_row, doc_id, n, head, head_row) of ``keyed`` (_row, doc_id, text): the first row of its
    component by doc_id, then _row; null for rows without words or a null ``by``, the column
    that names a row."""
    signed = materialize(_signed(keyed, k), "signed")
    usable = signed.where(f"n > 0 and {by} is not null")
    repeated = usable.groupBy(by).agg(F.count(F.lit(1)).alias("c")).where("c > 1").limit(1).count() > 0
    # Classes are numbered in the order of their first rows, so the least node has the first row.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")
    classes = usable.groupBy("d1", "d2").agg(F.min(place).alias("p"), F.min_by("bands", place).alias("bands")).select("d1", "d2", "p.*", "bands")
    order = ["none", "doc_id", "_row", "d1", "d2"]
    classes = materialize(classes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("node", F.monotonically_increasing_id()), "classes")
    bucketed = classes.select(F.explode("bands").alias("key"), F.col("node").alias("rep"))
    shared = materialize(bucketed.groupBy("key").agg(F.min("rep").alias("pivot"), F.max("rep").alias("top"), F.count(F.lit(1)).alias("c")).where("pivot <> top").select("key", "pivot", "c"), "buckets")
    limit = max(LEAST, (shared.agg(F.sum("c")).first()[0] or 0) / PARTS)
    hot = shared.where(F.col("c") > limit).select("key", F.ceil(F.col("c") / limit).cast("int").alias("_copies"))
    members = materialize(join_one(bucketed, shared.select("key", "pivot"), ["key"], hot=hot), "members")
    stars = materialize(members.where("rep <> pivot").groupBy("rep", "pivot").agg(F.count(F.lit(1)).alias("common")), "stars")
    heads = classes.select("d1", "d2", "node", F.col("doc_id").alias("head"), F.col("_row").alias("head_row"))
    if stars.limit(1).count():
        active = stars.select(F.col("rep").alias("node")).union(stars.select("pivot")).distinct()
        sets = materialize(_sets(keyed, classes.select(by, "d1", "d2", "node").join(active, "node", "left_semi"), by, k, repeated), "sets")
        first = stars.groupBy(F.col("rep").alias("a")).agg(F.max_by("pivot", F.struct("common", -F.col("pivot"))).alias("b"))
        labels = _merge(None, _linked(first, sets, percent))
        labels = _settle(members, labels, sets, percent)
        tops = join_one(labels, heads.select(F.col("node").alias("label"), F.col("head").alias("top"), F.col("head_row").alias("top_row")), ["label"]).select("node", "top", "top_row", F.lit(True).alias("moved"))
        heads = heads.join(tops, "node", "left")
        heads = materialize(heads.select("d1", "d2", F.when(F.col("moved"), F.col("top")).otherwise(F.col("head")).alias("head"), F.when(F.col("moved"), F.col("top_row")).otherwise(F.col("head_row")).alias("head_row")), "heads")
    # A text with a third of all rows as its copies is one class, and one row here.
    named = join_one(signed.drop("bands"), heads.select("d1", "d2", "head", "head_row"), ["d1", "d2"], "left")
    fits = (F.col("n") > 0) & F.col(by).isNotNull()
    return named.select("_row", "doc_id", "n", F.when(fits, F.col("head")).alias("head"), F.when(fits, F.col("head_row")).alias("head_row"))


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, all columns kept: the row with
    the smallest doc_id (null comes last; of equal ids, one).

    Rows are grouped by their own texts under numbers of their own, so rows that share a doc_id
    are not one document here, and rows without an id are deduplicated too. Rows without words
    all stay.
    """
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # no name clashes with ours
    ident, text = (plain.columns[docs.columns.index(c)] for c in ("doc_id", "text"))
    numbered = materialize(plain.withColumn("_row", F.monotonically_increasing_id()), "rows")
    keyed = numbered.select("_row", F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gone = _headed(keyed, "_row", k, percent).where("head_row <> _row").select("_row")
    return numbered.join(gone, "_row", "left_anti").drop("_row").toDF(*docs.columns)


def _label(df: DataFrame, labels: DataFrame, node: str, out: str) -> DataFrame:
    return df.join(labels.select(F.col("node").alias(node), F.col("label").alias(out)), node, "left").withColumn(out, F.coalesce(out, node))


def _merge(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """Labels after ``links`` joined components: only the labels' own graph is solved."""
    links = materialize(links, "links")
    if labels is None:
        return components(links)
    if links.limit(1).count() == 0:
        return labels
    graph = _label(_label(links, labels, "a", "la"), labels, "b", "lb").select(F.col("la").alias("a"), F.col("lb").alias("b"))
    tops = components(graph).select(F.col("node").alias("label"), F.col("label").alias("top"))
    moved = labels.join(tops, "label", "left").select("node", F.coalesce("top", "label").alias("label"))
    alone = tops.select(F.col("label").alias("node"), F.col("top").alias("label")).join(labels, "node", "left_anti")
    return materialize(moved.union(alone), "labels")


def _settle(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Labels after all pairs of one bucket and different components were decided."""
    named = _label(_label(members.select("rep", "pivot").distinct(), labels, "rep", "label"), labels, "pivot", "head")
    named = named.select("head", "rep", "label").distinct()
    mixed = named.groupBy("head").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y or x <> head").select("head")
    named = materialize(named.join(mixed, "head", "left_semi").where("rep <> head"), "mixed")
    if named.limit(1).count() == 0:
        return labels
    one = named.join(sets.select(F.col("node").alias("rep"), F.col("items").alias("s")), "rep")
    # A head may have most of all outliers, and each row of this join holds a copy of its set.
    two = join_one(materialize(one, "outliers"), sets.select(F.col("node").alias("head"), F.col("items").alias("p")), ["head"])
    # The head may not be of the bucket itself, but it is a member or pivot of some bucket.
    apart = two.select("head", "rep", "label", F.size("s").alias("n"), F.size("p").alias("m"), F.array_sort(F.array_except("s", "p")).alias("more"), F.array_sort(F.array_except("p", "s")).alias("less"))
    apart = materialize(apart.select("*", (F.size("more") + F.size("less")).alias("d")), "apart")
    close = 100 * (F.col("n") - F.size("more")) >= percent * (F.col("m") + F.size("more"))
    links = apart.where((F.col("label") != F.col("head")) & close).select(F.col("rep").alias("a"), F.col("head").alias("b"))
    failed = apart.where((F.col("label") != F.col("head")) & ~close)
    # B failed: it differs from P in more than (100 - p)/(100 + p) of both sizes, and a similar A
    # differs from B in no more than that part of theirs. So A and B share more than this many
    # of the places where A differs from P; whole numbers, as one less lets far more through.
    at_least = F.greatest(F.lit(1), F.expr(f"cast((cast(d as bigint) * {100 + percent} + (m - n) * {100 - percent}) div {2 * (100 + percent)} as int) + 1"))
    # Dealt by member, not by head: what follows groups by places of a head or by members.
    tried = join_one(apart, failed.select("head").distinct(), ["head"])
    rows = tried.repartition("head", "rep").select("head", "rep", "label", "d", "n", F.size("more").alias("e"), ((F.col("label") != F.col("head")) & ~close).alias("failed"), (F.col("d") - at_least + 1).alias("take"), "more", "less")
    # The order of places: what P lacks, from rare to common in this group (places that no two
    # members share, or none that failed, come first and meet nothing), then what P has.
    own = ["head", "rep", "label", "d", "n", "e", "failed", "take"]
    lacked = rows.select(*own, F.explode("more").alias("at"))
    often = lacked.groupBy("head", "at").agg(F.count(F.lit(1)).alias("c"), F.max("failed").alias("any")).where("c > 1 and any").select("head", "at", "c")
    member = Window.partitionBy("head", "rep")
    rank = F.row_number().over(member.orderBy("c", "at")) - F.count(F.lit(1)).over(member) + F.col("e") - 1
    lacked = lacked.join(often, ["head", "at"]).select(*own, "at", rank.cast("int").alias("i"))
    had = lambda df, items: df.select(*own, F.posexplode(items).alias("k", "at")).select(*own, "at", (F.col("e") + F.col("k")).alias("i"))
    few = had(rows.where("take > e"), F.expr("slice(less, 1, take - e)"))
    # The most places that can be shared if this is the first: what the pair's sizes ask for
    # must fit into it, or the pair meets again at its real first place, or never.
    left = F.when(F.col("i") < F.col("e"), F.expr("least(e - i, e2 - i2) + least(d - e, d2 - e2)")).otherwise(F.expr("least(d - i, d2 - i2)"))
    enough = left.cast("long") * (2 * (100 + percent)) >= (F.col("d") + F.col("d2")) * (100 + percent) - (F.col("n") + F.col("n2")) * (100 - percent)

    def meet(x: DataFrame, y: DataFrame) -> DataFrame:
        x = x.select("head", "at", F.col("rep").alias("a"), F.col("label").alias("la"), "d", "n", "e", "i")
        y = y.select("head", "at", F.col("rep").alias("b"), F.col("label").alias("lb"), F.col("d").alias("d2"), F.col("n").alias("n2"), F.col("e").alias("e2"), F.col("i").alias("i2"))
        return x.join(y, ["head", "at"]).where(F.col("la") != F.col("lb")).where(enough).select("head", "a", "b")

    met = meet(lacked.where("i < take"), lacked.where("failed")).union(meet(few, had(rows.where("failed"), F.col("less")))).distinct()
    places = F.concat("more", "less")
    # The differences from P say all about two sets: A and B differ where one of them differs.
    side = lambda c: apart.select("head", F.col("rep").alias(c), places.alias(f"p{c}"), F.col("n").alias(f"n{c}"))
    both = met.join(side("a"), ["head", "a"]).join(side("b"), ["head", "b"])
    differ = F.size("pa") + F.size("pb") - 2 * F.size(F.array_intersect("pa", "pb"))
    near = both.where(differ * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")
    return _merge(labels, links.union(near).distinct())


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
