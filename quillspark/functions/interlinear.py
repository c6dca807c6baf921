"""Interlinear data and lexicons of a translation project, and the anchoring of glosses."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from .usx import Element, read_xml

MORPHEMES = frozenset(("Stem", "Prefix", "Suffix"))
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u05bd\u05bf\u05c1\u05c2\u05c4\u05c5\u05c7\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06dc\u06df-\u06e4\u06e7\u06e8\u06ea-\u06ed\u08d3-\u08ff\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f\u200c\u200d]")


class ProjectError(ValueError):
    """A project file that can't be read."""


def lexeme_key(ident: str | None) -> tuple[str, str, int] | None:
    """(kind, form, homograph) of Kind:form or Kind:form:2."""
    m = re.fullmatch(r"(\w+):(.*?)(?::([0-9]+))?", ident or "", re.S)
    return (m[1], m[2], int(m[3] or 1)) if m else None


@dataclass
class Cluster:
    index: int
    length: int
    lexemes: list[tuple[str | None, str | None]]  # (id, sense)
    excluded: bool = False

    @property
    def keys(self):
        return [lexeme_key(i) for i, _ in self.lexemes]

    @property
    def kind(self) -> str:
        keys = self.keys
        if None in keys:
            return "unparseable"
        if any(k[0] in MORPHEMES for k in keys):
            return "parse"
        if len(keys) == 1 and keys[0][0] in ("Word", "Phrase"):
            return keys[0][0].lower()
        return "other"

    @property
    def surface(self) -> str | None:
        kind = self.kind
        if kind in ("other", "unparseable"):
            return None
        return "".join(k[1] for k in self.keys) if kind == "parse" else self.keys[0][1]


@dataclass
class Verse:
    reference: str
    approved: str | None = None
    clusters: list[Cluster] = field(default_factory=list)
    punctuation: list[tuple[int, int, str | None, str | None]] = field(default_factory=list)

    @property
    def place(self) -> tuple[int, int] | None:
        m = re.match(r"\S+\s+([0-9]+)[^:]*:\s*([0-9]+)", self.reference)
        return (int(m[1]), int(m[2])) if m else None


def _child(e: Element, name: str) -> Element | None:
    return next((c for c in e.children if c.name == name), None)


def _all(e: Element, name: str) -> list[Element]:
    return [c for c in e.children if c.name == name]


def _text(e: Element | None) -> str:
    return next((c.value for c in e.children if c.name is None), "") if e is not None else ""


def root(xml: str | bytes, name: str, each: Callable[[Element, list[Element]], bool] | None = None) -> Element:
    e, error = read_xml(xml.removeprefix(b"\xef\xbb\xbf" if isinstance(xml, bytes) else "\ufeff"), each)
    if e is None:
        raise ProjectError(error[1])
    if e.name != name:
        raise ProjectError(f"expected <{name}>, found <{e.name}>")
    return e


def _range(e: Element, where: str) -> tuple[int, int]:
    r = _child(e, "Range")
    out = []
    for k in ("Index", "Length"):
        v = r.get(k) if r is not None else None
        if v is not None and not re.fullmatch(r"\s*\+?[0-9]+\s*", v):
            raise ProjectError(f"{where}: {k} is {v}")
        out.append(int(v) if v is not None else 0)
    return out[0], out[1]


def _verse(item: Element) -> Verse:
    verse = Verse(_text(_child(item, "string")).strip())
    data = _child(item, "VerseData")
    if data is not None:
        verse.approved = data.get("Hash")
        for e in data.children:
            if e.name == "Cluster":
                a, n = _range(e, verse.reference)
                flag = _text(_child(e, "Excluded")).strip().lower() if _child(e, "Excluded") is not None else "false"
                if flag not in ("true", "false", "1", "0"):
                    raise ProjectError(f"{verse.reference}: Excluded is {flag}")
                verse.clusters.append(Cluster(a, n, [(x.get("Id"), x.get("GlossId") or None) for x in _all(e, "Lexeme")], flag in ("true", "1")))
            elif e.name == "Punctuation":
                a, n = _range(e, verse.reference)
                before, after = _child(e, "BeforeText"), _child(e, "AfterText")
                verse.punctuation.append((a, n, _text(before) if before is not None else None, _text(after) if after is not None else None))
    return verse


def scan_interlinear(xml: str | bytes, found: Callable[[Verse], None]) -> dict:
    """GlossLanguage, BookId and ScrTextName; ``found`` is called with every verse in order, whose
    elements are given up then. A file may turn out to be unreadable after some verses."""
    error: ProjectError | None = None

    def each(e: Element, above: list[Element]) -> bool:
        nonlocal error
        if len(above) != 2 or e.name != "item" or above[1].name != "Verses":
            return False
        if error is None:
            try:
                found(_verse(e))
            except ProjectError as x:
                error = x
        return True

    top = root(xml, "InterlinearData", each)
    if error is not None:
        raise error
    return {k: top.get(k) for k in ("GlossLanguage", "BookId", "ScrTextName")}


def read_interlinear(xml: str) -> tuple[dict, list[Verse]]:
    """(GlossLanguage, BookId, ScrTextName) and verses; a verse given twice stands where it
    first stood with what it last held."""
    verses: dict[str, Verse] = {}
    head = scan_interlinear(xml, lambda v: verses.__setitem__(v.reference, v))
    return head, list(verses.values())


def words(text: str) -> list[tuple[int, int]]:
    out, start = [], None
    for i, c in enumerate(text):
        inside = c.isalnum() or bool(_MARKS.match(c))
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            out.append((start, i))
            start = None
    return out + ([(start, len(text))] if start is not None else [])


def _units(s: str) -> int:
    return len(s.encode("utf-16-le", "surrogatepass")) // 2


def anchor(text: str, clusters: list[Cluster]) -> dict:
    """Which word each cluster glosses: words [(word, gloss, parse, ambiguous)], phrases
    [(first, last + 1, cluster, ambiguous)], dropped [(cluster, reason)].

    Clusters go through the text in order. A later cluster of the same spelling keeps a word
    for itself; among several words the nearest wins, by the shift that most words of a unique
    spelling agree on, else by the place in the whole.
    """
    spans = words(text)
    folded = [text[a:b].lower() for a, b in spans]
    starts = [_units(text[:a]) for a, _ in spans]
    size, extent = max(1, _units(text)), max([1, *(c.index + c.length for c in clusters)])
    unique = Counter(folded)
    votes: Counter = Counter()
    for c in clusters:
        if c.kind == "word" and unique[(c.surface or "").lower()] == 1:
            votes[c.index - starts[folded.index(c.surface.lower())]] += 1
    shift = min((d for d, n in votes.items() if n == max(votes.values())), default=None)

    def nearest(options, at):
        far = (lambda w: abs(starts[w] + shift - at)) if shift is not None else (lambda w: abs(starts[w] / size - at / extent))
        return min(options, key=far)

    out: dict = {"words": [], "phrases": [], "dropped": []}
    groups: dict[tuple[int, int], list] = {}
    phrases = []
    for i, c in enumerate(clusters):
        kind = c.kind
        if kind in ("word", "parse"):
            g = groups.setdefault((c.index, c.length), [None, None])
            k = kind == "parse"
            if g[k] is not None:
                out["dropped"].append((i, "duplicate"))
            else:
                g[k] = i
        elif kind == "phrase":
            phrases.append(i)
        else:
            out["dropped"].append((i, "no-surface" if kind == "other" else "unparseable"))
    order = sorted(groups.items())
    surface = [(clusters[g[0] if g[0] is not None else g[1]].surface or "").lower() for _, g in order]
    cursor = 0
    for k, ((at, _), (gloss, parse)) in enumerate(order):
        options = [w for w in range(cursor, len(spans)) if folded[w] == surface[k]]
        if not options:
            out["dropped"] += [(i, "form-mismatch") for i in (gloss, parse) if i is not None]
            continue
        several = len(options) > 1
        options = options[: max(1, len(options) - surface[k + 1 :].count(surface[k]))]
        w = nearest(options, at)
        out["words"].append((w, gloss, parse, several))
        cursor = w + 1
    phrases.sort(key=lambda i: clusters[i].index)
    forms = [(clusters[i].surface or "").lower() for i in phrases]
    cursor = 0
    for k, i in enumerate(phrases):
        parts = forms[k].split()
        runs = [s for s in range(cursor, len(spans) + 1 - len(parts)) if folded[s : s + len(parts)] == parts] if parts else []
        if not runs:
            out["dropped"].append((i, "form-mismatch"))
            continue
        several = len(runs) > 1
        runs = runs[: max(1, len(runs) - forms[k + 1 :].count(forms[k]))]
        s = nearest(runs, clusters[i].index)
        out["phrases"].append((s, s + len(parts), i, several))
        cursor = s + 1
    out["words"].sort(key=lambda x: x[0])
    out["dropped"].sort(key=lambda x: x[0])
    return out


@dataclass
class Lexicon:
    """Entries by key (the last of a key counts), senses by id (the first of an id counts)."""

    entries: dict[tuple, list[tuple[str | None, list[tuple[str | None, str]]]]] = field(default_factory=dict)
    analyses: dict[str, list[tuple]] = field(default_factory=dict)

    @property
    def senses(self) -> dict[str, list]:
        out: dict[str, list] = {}
        for entry in self.entries.values():
            for ident, glosses in entry:
                if ident is not None:
                    out.setdefault(ident, glosses)
        return out

    @staticmethod
    def _in(glosses, language: str) -> str | None:
        return next((t for lang, t in glosses if lang is not None and lang.lower() == language.lower()), None)

    def gloss(self, lexeme: tuple[str | None, str | None], language: str) -> str | None:
        """The chosen sense's gloss; only where no sense was chosen, that of the entry's first
        sense that has one."""
        ident, sense = lexeme
        if sense:
            found = self.senses.get(sense)
            return self._in(found, language) if found is not None else None
        entry = self.entries.get(lexeme_key(ident) or ())
        return next((g for _, glosses in entry or () if (g := self._in(glosses, language)) is not None), None)


def read_lexicon(xml: str) -> Lexicon:
    top, out = root(xml, "Lexicon"), Lexicon()

    def key(e: Element | None):
        if e is None or e.get("Type") is None or e.get("Form") is None:
            raise ProjectError("an item has no <Lexeme> key")
        return e.get("Type"), e.get("Form"), int(e.get("Homograph") or 1)

    for item in (i for s in _all(top, "Entries") for i in _all(s, "item")):
        entry = _child(item, "Entry")
        out.entries[key(_child(item, "Lexeme"))] = [(s.get("Id"), [(g.get("Language"), _text(g)) for g in _all(s, "Gloss")]) for s in (_all(entry, "Sense") if entry is not None else [])]
    for item in (i for s in _all(top, "Analyses") for i in _all(s, "item")):
        word, lexemes = _child(item, "string"), _child(item, "ArrayOfLexeme")
        if word is None:
            raise ProjectError("an analysis has no word")
        if lexemes is not None and (found := [key(x) for x in _all(lexemes, "Lexeme")]):
            out.analyses[_text(word)] = found
    return out
