"""Quality rules by distribution divergence (op 2).

Each document is compared with reference profiles of languages: the shares of its characters
that fall into a few classes, and the shares of its words that are common words of the
language. The distance is Jensen-Shannon's (square root of the divergence to base 2, so 0 to
1). One pass over the text, no shuffle; documents too short for a histogram are not judged.

A text without any common word has all its words in one class, which is the greatest word
distance that a lack of common words can make. It differs by language (0.40 for en, 0.37 for
fr), so texts with fewer common words than the language has are limited to a part of it; those
with more of them (one word over and over) can be farther away and have a limit of their own.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, utf8

#: Shares of lower-case ASCII, upper-case ASCII, digits, white space, sentence punctuation,
#: symbols, and bytes outside ASCII, in ordinary prose. Rounded general figures.
CLASSES = ("lower", "upper", "digit", "space", "punct", "symbol", "other")
CHARACTERS = {
    "en": (0.785, 0.025, 0.005, 0.160, 0.022, 0.001, 0.002),
    "de": (0.780, 0.035, 0.005, 0.135, 0.020, 0.001, 0.024),
    "fr": (0.735, 0.025, 0.005, 0.160, 0.022, 0.001, 0.052),
    "es": (0.760, 0.025, 0.005, 0.160, 0.022, 0.001, 0.027),
}
#: Common words and their share of running text in parts of 10,000; the rest is one class. The
#: choice follows the most frequent words of the small tables, the shares are rounded.
WORDS = {
    "en": "the 640 of 350 and 270 to 230 a 190 in 170 is 120 that 105 it 90 for 85 was 80 on 70 with 65 be 60 by 58 as 56 this 52 are 50 at 45 from 42",
    "de": "der 480 die 340 und 260 in 190 den 150 von 140 zu 110 das 100 mit 90 sich 85 auf 80 des 75 für 70 ist 65 nicht 60 dem 55 im 52 ein 50 eine 45 als 42",
    "fr": "de 530 la 340 le 230 et 190 les 150 des 145 en 110 un 90 du 88 une 80 que 75 pour 65 est 60 qui 58 par 54 dans 52 sur 50 au 48 pas 44 avec 38",
    "es": "de 540 la 330 que 230 el 200 en 160 y 130 los 115 se 105 del 95 las 85 por 75 un 70 no 62 con 60 su 55 una 52 es 48 para 46 al 42 lo 38",
}
SYMBOLS = b"#*$%&|<>"
_CLASS = np.full(256, 6, dtype=np.int64)
for _i in range(128):
    _c = chr(_i)
    _CLASS[_i] = 0 if "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 2 if "0" <= _c <= "9" else 3 if _c in " \t\n\v\f\r" else 4 if _c in ".,;:!?'\"()-" else 5


@dataclass(frozen=True)
class DivergenceRules:
    """Limits; a document passes if it is near at least one language in both histograms."""

    min_words: int = 60
    min_bytes: int = 300
    max_character_distance: float = 0.32
    max_word_distance: float = 0.42
    max_word_part: float = 0.8  # of the distance of a text without common words, per language
    base_min_words: int = 10
    base_max_repeat_percent: int = 20
    languages: tuple[str, ...] = ("en", "de", "fr", "es")
    words: dict = field(default_factory=lambda: WORDS)
    characters: dict = field(default_factory=lambda: CHARACTERS)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance along the last axis of histograms that sum to 1 there."""
    m = (p + q) / 2
    m[m == 0] = 1
    part = lambda x: (x * np.log2(np.where(x > 0, x / m, 1))).sum(axis=-1)
    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def base_counts(text: bytes) -> tuple[list[bytes], int, int, int, int]:
    """Words of a text and its four base figures."""
    words = text.split()  # bytes split at exactly space, tab, LF, VT, FF and CR
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    n = len(words)
    chars = sum(map(len, words)) if text.isascii() else len(b"".join(words).decode("utf-8", "surrogatepass"))
    dup = 0
    if b"\n" in text:
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        dup = len(lines) - len(set(lines))
    repeat = 0
    if n > 5:
        ids: dict[bytes, int] = {}
        seq = np.array([ids.setdefault(w, len(ids)) for w in words], dtype=np.uint64)
        k = np.uint64(len(ids))
        if len(ids) <= 7131:  # five digits to base k fit 64 bits
            windows = seq[: n - 4]
            for i in range(1, 5):
                windows = windows * k + seq[i : n - 4 + i]
        else:
            rank = lambda x: np.unique(x, return_inverse=True)[1].astype(np.uint64)
            two = rank(seq[:-1] * k + seq[1:])
            four = rank(two[:-2] * np.uint64(n) + two[2:])
            windows = four[:-1] * k + seq[4:]
        order = np.sort(windows)
        if (order[1:] == order[:-1]).any():
            _, inverse, often = np.unique(windows, return_inverse=True, return_counts=True)
            edge = np.zeros(n + 1, dtype=np.int64)
            at = np.nonzero(often[inverse] > 1)[0]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 5, -1)
            repeat = int((np.cumsum(edge[:-1]) > 0).sum())
    return words, chars, symbols, dup, repeat


class Judge:
    """References as matrices, one row a language; ``distances`` gives (language, characters,
    words, within both limits) of the nearest one."""

    def __init__(self, rules: DivergenceRules):
        self.rules = rules
        listed = [rules.words[lang].split() for lang in rules.languages]
        width = max(len(x) // 2 for x in listed) + 1
        self.words = np.zeros((len(listed), width))
        self.cells: dict[bytes, list[int]] = {}
        for k, x in enumerate(listed):
            self.words[k, : len(x) // 2] = np.array(x[1::2], dtype=float) / 10_000
            self.words[k, -1] = 1 - self.words[k].sum()
            for i, w in enumerate(x[::2]):
                for form in {w, w.capitalize(), w.upper()}:
                    for mark in ("", ".", ",", ";", ":", "!", "?"):
                        self.cells.setdefault((form + mark).encode(), []).append(k * width + i)
        none = np.zeros_like(self.words)
        none[:, -1] = 1
        self.few_words = np.minimum(rules.max_word_distance, rules.max_word_part * js_distance(none, self.words))
        chars = np.array([rules.characters[lang] for lang in rules.languages], dtype=float)
        self.chars = chars / chars.sum(axis=1, keepdims=True)

    def distances(self, text: bytes, words: list[bytes]) -> tuple[str, float, float, bool]:
        chars = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256), minlength=7)
        counted = Counter(words)
        have = [0] * self.words.size
        for w in counted.keys() & self.cells.keys():
            for at in self.cells[w]:
                have[at] += counted[w]
        found = np.array(have, dtype=float).reshape(self.words.shape)
        found[:, -1] = len(words) - found.sum(axis=1)
        dc = js_distance(np.broadcast_to(chars / chars.sum(), self.chars.shape), self.chars)
        dw = js_distance(found / len(words), self.words)
        max_words = np.where(found[:, -1] > len(words) * self.words[:, -1], self.few_words, self.rules.max_word_distance)
        best = int(np.argmin(np.maximum(dc / self.rules.max_character_distance, dw / max_words)))
        return self.rules.languages[best], float(dc[best]), float(dw[best]), bool(dc[best] <= self.rules.max_character_distance and dw[best] <= max_words[best])

    def row(self, text: bytes | None) -> tuple:
        r = self.rules
        text = text or b""
        words, chars, symbols, dup, repeat = base_counts(text)
        n = len(words)
        failed = n < r.base_min_words or 100 * repeat > r.base_max_repeat_percent * n
        lang = dc = dw = None
        fits = True
        if n >= r.min_words and len(text) >= r.min_bytes:
            lang, dc, dw, fits = self.distances(text, words)
        return n, chars, symbols, dup, repeat, failed, not failed and fits, lang, dc, dw


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, nearest string, char_distance double, word_distance double"


def divergence_rules(docs: DataFrame, rules: DivergenceRules = DivergenceRules()) -> DataFrame:
    """One row per document with the base figures, the verdict and the two distances.

    Null and empty texts have no words: they fail the base rule. Texts under the guards
    (``min_words``, ``min_bytes``) get null distances and pass if the base rule passes. Columns
    other than doc_id and text are ignored.
    """

    def run(batches):
        judge = Judge(rules)
        for b in batches:
            rows = list(zip(*(judge.row(t) for t in utf8(b.column(1))))) or [()] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.string()] + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), *(pa.array(list(c), k) for c, k in zip(rows, kinds))], schema=OUT)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("nearest", pa.string()), ("char_distance", pa.float64()), ("word_distance", pa.float64())])


def fit_characters(texts: list[str]) -> tuple[float, ...]:
    """A character profile from trusted texts, for a language that has none here."""
    total = np.bincount(_CLASS, weights=np.bincount(np.frombuffer("".join(texts).encode(), dtype=np.uint8), minlength=256), minlength=7)
    return tuple(total / max(1, total.sum()))


def fit_words(texts: list[str], k: int = 20) -> str:
    """A common-word profile, in the form of ``WORDS``, from trusted texts."""
    c = Counter(w for t in texts for w in re.findall(r"\w+", t.lower()))
    n = max(1, sum(c.values()))
    return " ".join(f"{w} {max(1, round(10_000 * v / n))}" for w, v in c.most_common(k))


def op2_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence_rules(table(spark, sf_dir, "documents"))
