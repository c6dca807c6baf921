"""Quality classifier: a generalised additive model with pairwise interactions (op 5).

Features of a text are cut into bins; boosting goes round the features in turn, each step a
shallow tree over the bins of one feature, whose leaves are added to that feature's lookup
table. Then the pairs whose residuals gain most get tables of two dimensions in the same way.
A score is the sum of one cell of each table, through the logistic function: scoring is a
vectorised look-up over a batch, with nothing to compare but bin edges.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, utf8

#: Labelled rows that the model is fitted on, at most; those with the smallest hash of doc_id.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3
FOLDS = 5
_COMMON = frozenset(b"the of and to a in is it that for was on with be by as this are at from der die und den von zu das mit sich auf des ist nicht dem im ein eine als la le et les en un du une que pour est qui par dans sur au pas avec de el y los se del las por no con su es para al lo".split())
_SPACE, _MARK = b" \t\n\r\x0b\x0c", b".,;:!?'\"()-"
FEATURES = ("log_bytes", "log_words", "word_length", "long_words", "upper", "digit", "symbol", "pipe", "hash_percent", "bang", "sentence", "comma", "other_bytes", "control", "distinct", "top_word", "common", "line_words", "dup_lines", "short_lines", "list_lines", "byte_entropy", "capital_words", "all_caps_words", "word_end_symbol")


def features(text: bytes | None) -> list[float]:
    """The features of one text; an empty or null one has zeros throughout."""
    if not text:
        return [0.0] * len(FEATURES)
    n = len(text)
    c = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words = text.split()
    k = max(1, len(words))
    counted = Counter(words)
    lower = sum(v for w, v in counted.items() if len(w) < 7 and w in _COMMON)
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    p = c[c > 0] / n
    joined = b" ".join(words)
    ends = np.frombuffer(joined, dtype=np.uint8)
    first = np.concatenate((ends[:1], ends[1:][ends[:-1] == 32])) if len(ends) else ends
    last = np.concatenate((ends[:-1][ends[1:] == 32], ends[-1:])) if len(ends) else ends
    caps = float(((first >= 65) & (first <= 90)).sum())
    odd = np.isin(last, _ODD).sum()
    upper = int(c[65:91].sum())
    letters = max(1, upper + int(c[97:123].sum()))
    loud = sum(v for w, v in counted.items() if len(w) > 1 and w.isupper())
    lengths = len(joined) - k + 1
    return [
        np.log1p(n), np.log1p(len(words)), lengths / k, sum(v for w, v in counted.items() if len(w) > 14) / k,
        upper / letters, c[48:58].sum() / n, (c[35] + c[36] + c[37] + c[38] + c[42] + c[60] + c[62]) / n, c[124] / k, (c[35] + c[37]) / n, c[33] / k,
        (c[46] + c[63]) / k, c[44] / k, c[128:].sum() / n, (c[:9].sum() + c[127]) / n,
        len(counted) / k, max(counted.values(), default=0) / k, lower / k, k / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)),
        sum(len(x) < 30 for x in lines) / max(1, len(lines)), sum(x[:1] in b"-*|" for x in lines) / max(1, len(lines)),
        float(-(p * np.log2(p)).sum()), caps / k, loud / k, odd / k,
    ]


_ODD = np.frombuffer(b"#$%&*|<>!@^~", dtype=np.uint8)


@dataclass
class AdditiveModel:
    """Bin edges and tables. ``pairs`` maps (i, j) to a table over coarse bins of both."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: dict[tuple[int, int], np.ndarray] = field(default_factory=dict)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for rows of features: one look-up a feature and pair."""
        z = np.full(len(x), self.intercept)
        for j, (e, t) in enumerate(zip(self.edges, self.tables)):
            z += t[np.searchsorted(e, x[:, j], side="right")]
        for (i, j), t in self.pairs.items():
            z += t[np.searchsorted(self.coarse[i], x[:, i], side="right"), np.searchsorted(self.coarse[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(column) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> np.ndarray:
    """Leaf values, by bin, of a tree of ``depth`` cuts over histograms of gradients."""
    out = np.full(len(g), g.sum() / (h.sum() + ridge))
    if depth == 0 or len(g) < 2:
        return out
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge)
    gain[(hl < 1) | (hr < 1)] = -1
    cut = int(np.argmax(gain)) + 1
    if gain[cut - 1] <= g.sum() ** 2 / (h.sum() + ridge) + 1e-12:
        return out
    out[:cut] = _tree(g[:cut], h[:cut], depth - 1, ridge)
    out[cut:] = _tree(g[cut:], h[cut:], depth - 1, ridge)
    return out


def _grid(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Best tree with one cut on one axis and a cut of its own on the other for each side."""
    best = (np.full(g.shape, g.sum() / (h.sum() + ridge)), 0.0)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for axis in (0, 1):
        a, b = (g, h) if axis == 0 else (g.T, h.T)
        for cut in range(1, len(a)):
            sides = [_tree(x.sum(axis=0), y.sum(axis=0), 1, ridge) for x, y in ((a[:cut], b[:cut]), (a[cut:], b[cut:]))]
            gain = sum(float((2 * v * x.sum(axis=0) - v**2 * (y.sum(axis=0))).sum()) for v, x, y in zip(sides, (a[:cut], a[cut:]), (b[:cut], b[cut:]))) - whole
            if gain > best[1]:
                out = np.vstack([np.repeat(sides[0][None], cut, 0), np.repeat(sides[1][None], len(a) - cut, 0)])
                best = (out if axis == 0 else out.T, gain)
    return best


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 150, rate: float = 0.1, pair_bins: int = 6, n_pairs: int = 6, pair_rounds: int = 40, ridge: float = 2.0) -> AdditiveModel:
    """Cyclic boosting of the logistic loss. With one class only (or no rows) the model is
    its intercept, smoothed by half a row of each class."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    f = x.shape[1]
    edges = [_edges(x[:, j], bins) for j in range(f)]
    coarse = [_edges(x[:, j], pair_bins) for j in range(f)]
    model = AdditiveModel(float(np.log(p / (1 - p))), edges, [np.zeros(len(e) + 1) for e in edges], coarse)
    if len(set(y.tolist())) < 2:
        return model
    at = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(edges)]
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for j in range(f):
            q = 1 / (1 + np.exp(-z))
            k = len(model.tables[j])
            step = rate * _tree(np.bincount(at[j], y - q, k), np.bincount(at[j], q * (1 - q), k), 2, ridge)
            model.tables[j] += step
            z += step[at[j]]
    low = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(coarse)]

    def cells(i: int, j: int, q: np.ndarray):
        w = len(coarse[j]) + 1
        shape, both = (len(coarse[i]) + 1, w), low[i] * w + low[j]
        return np.bincount(both, y - q, shape[0] * w).reshape(shape), np.bincount(both, q * (1 - q), shape[0] * w).reshape(shape), both

    q = 1 / (1 + np.exp(-z))
    gains = sorted(((_grid(*cells(i, j, q)[:2], ridge)[1], (i, j)) for i, j in combinations(range(f), 2)), reverse=True)[:n_pairs]
    for _, (i, j) in gains:
        model.pairs[i, j] = np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))
    for _ in range(pair_rounds):
        for (i, j), t in model.pairs.items():
            q = 1 / (1 + np.exp(-z))
            g, h, both = cells(i, j, q)
            step = rate * _grid(g, h, ridge)[0]
            t += step
            z += step.ravel()[both]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the sample; rows of the held-out fold and null ids, labels and
    texts are not used. A document with several labels gives a row for each."""
    usable = labels.where(f"{label} is not null and doc_id is not null").select("doc_id", F.col(label).cast("int").alias("_y"))
    usable = usable.where(F.crc32(F.col("doc_id").cast("string")) % FOLDS != 0)
    sample = usable.orderBy(F.xxhash64("doc_id"), "doc_id", "_y").limit(limit)

    def run(batches):
        for b in batches:
            x = [features(t) for t in utf8(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.list_(pa.float64()))], names=["_y", "x"])

    # At most ``limit`` rows of two numbers: the bound that makes the broadcast safe.
    picked = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("doc_id", "_y", "text")
    rows = picked.select("_y", "text").mapInArrow(run, "_y int, x array<double>").toPandas()
    if not len(rows):
        return np.zeros((0, len(FEATURES))), np.zeros(0)
    order = np.lexsort(np.vstack(rows.x).T)  # the same model whatever order the rows came in
    return np.vstack(rows.x)[order], rows._y.to_numpy(dtype=float)[order]


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = SAMPLE_ROWS) -> AdditiveModel:
    return fit(*training_rows(docs, labels, label, limit))


def score(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; null and empty texts get the score
    of a text without words. A null doc_id has a null ``held_out``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in utf8(b.column(1))]).reshape(b.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % FOLDS == 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows scored below ``threshold``; all columns, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([features(t) for t in utf8(b.column(at))]).reshape(b.num_rows, len(FEATURES))
            yield b.filter(pa.array(shared.value.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op5_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
