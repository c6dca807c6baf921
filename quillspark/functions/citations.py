"""Scripture references in running text: a scanner over one string."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field, replace

from .books import CATEGORY, SINGLE_CHAPTER

_MARKS = "‎‏؜"
_ZEROS = (0x30, 0x660, 0x6F0, 0x7C0, 0x966, 0x9E6, 0xA66, 0xAE6, 0xB66, 0xBE6, 0xC66, 0xCE6, 0xD66, 0xE50, 0xED0, 0xF20, 0x1040, 0x17E0, 0xFF10)
_DIGITS = {chr(z + i): i for z in _ZEROS for i in range(10)}
CHAPTER, VERSE, NOTHING = "chapter", "verse", "nothing"


@dataclass(frozen=True)
class CitationFormat:
    """Separators in the spellings a project allows."""

    chapter_verse: tuple[str, ...] = (":",)
    range: tuple[str, ...] = ("-",)
    chapter_range: tuple[str, ...] = ("—", "-")
    sequence: tuple[str, ...] = (",",)
    chapter_number: tuple[str, ...] = (";",)
    book_sequence: tuple[str, ...] = (";",)
    extra: tuple[str, ...] = ()


@dataclass(frozen=True)
class Place:
    chapter: int
    verse: int | None = None
    part: str | None = None


@dataclass(frozen=True)
class Citation:
    book: str
    start: Place
    end: Place | None
    at: tuple[int, int]  # characters


def _fold(text: str) -> str:
    return unicodedata.normalize("NFD", text).replace(" ", " ")


@dataclass
class BookNames:
    """Names, longest first, and codes; names match whatever their normal form."""

    names: list[tuple[str, str]] = field(default_factory=list)
    codes: bool = False
    any_case: bool = False

    def add(self, name: str, code: str) -> None:
        name = name.strip()
        if name and all(n != name for n, _ in self.names):
            size = len(name.encode())
            at = next((i for i, (n, _) in enumerate(self.names) if len(n.encode()) < size), len(self.names))
            self.names.insert(at, (name, code))

    def match(self, text: str, at: int) -> tuple[str, int] | None:
        """(code, length) of the name that starts at a character."""
        rest = text[at:]
        longest = max((len(_fold(n)) for n, _ in self.names), default=0)
        ends = None
        for name, code in self.names:
            if rest.startswith(name):
                return code, len(name)
            if ends is None:
                ends = _boundaries(rest, longest)
            want = _fold(name)
            if want in ends:
                return code, ends[want]
        if not self.codes:
            return None
        code = rest[:3]
        if self.any_case and code.isascii():
            code = code.upper()
        return (code, 3) if len(code) == 3 and code in CATEGORY else None


def _boundaries(text: str, longest: int) -> dict[str, int]:
    """Folded prefixes that end before a base character, with their length in the text."""
    out, i = {}, 0
    while i < len(text):
        j = i + 1
        while j < len(text) and unicodedata.category(text[j])[0] == "M":
            j += 1
        folded = _fold(text[:j])
        if len(folded) > longest:
            break
        out[folded] = j
        i = j
    return out


class _Scanner:
    def __init__(self, text, form: CitationFormat, names: BookNames, book):
        self.text, self.form, self.names, self.book = text, form, names, book
        self.chapter = None
        self.found: list[Citation] = []
        self.after = 0

    def blank(self, i: int) -> int:
        while i < len(self.text) and (self.text[i].isspace() or self.text[i] in _MARKS):
            i += 1
        return i

    def marks(self, i: int) -> int:
        while i < len(self.text) and self.text[i] in _MARKS:
            i += 1
        return i

    def sign(self, i: int, spellings) -> int | None:
        for s in spellings:
            if (s := s.strip()) and self.text.startswith(s, i):
                return len(s)
        return None

    def spaced(self, i: int, spellings) -> int | None:
        """A separator with white space round it."""
        j = i
        while j < len(self.text) and self.text[j].isspace():
            j += 1
        n = self.sign(j, spellings)
        if n is None:
            return None
        j += n
        while j < len(self.text) and self.text[j].isspace():
            j += 1
        return j - i

    def extra(self, i: int) -> int | None:
        sizes = [len(e) for e in (x.strip() for x in self.form.extra) if e and self.text.startswith(e, i) and not self.text[i + len(e) : i + len(e) + 1].isalnum()]
        return max(sizes, default=None)

    def number(self, i: int):
        """(value, part, next) or None: digits of one of 19 scripts and a small letter."""
        j, value = i, 0
        while j < len(self.text) and self.text[j] in _DIGITS:
            value = value * 10 + _DIGITS[self.text[j]]
            j += 1
        if j == i or value >= 1 << 63:
            return None
        c, after = self.text[j : j + 1], self.text[j + 1 : j + 2]
        if c.isascii() and c.islower() and not after.isalnum():
            return value, c, j + 1
        return None if c.isalpha() else (value, None, j)

    def verse_after(self, i: int):
        i = self.marks(i)
        n = self.sign(i, self.form.chapter_verse)
        return None if n is None else self.number(self.blank(i + n))

    def location(self, i: int, bare: str, chapter):
        first = self.number(i)
        if first is None:
            return None
        value, part, nxt = first
        if (v := self.verse_after(nxt)) is not None:
            start, nxt = Place(value, v[0], v[1]), v[2]
        elif bare == CHAPTER and part is None:
            start = Place(value)
        elif bare == VERSE and chapter is not None:
            start = Place(chapter, value, part)
        else:
            return None
        end = None
        j = self.marks(nxt)
        n = self.sign(j, self.form.range) or self.sign(j, self.form.chapter_range)
        second = self.number(self.marks(j + n)) if n else None
        if second is not None:
            value, part, after = second
            if (v := self.verse_after(after)) is not None:
                end, nxt = Place(value, v[0], v[1]), v[2]
            elif start.verse is not None:
                end, nxt = Place(start.chapter, value, part), after
            elif part is None:
                end, nxt = Place(value), after
        return start, end, nxt

    def follows_word(self, i: int) -> bool:
        before = self.text[self.after : i]
        strip = lambda s: s.rstrip(_MARKS + " \t\n\r\f\v       　")
        before = strip(before)
        again = True
        while again:
            again = False
            for e in (x.strip() for x in self.form.extra):
                if e and before.endswith(e) and not before[: -len(e)][-1:].isalnum():
                    before, again = strip(before[: -len(e)]), True
                    break
        return before[-1:].isalnum()

    def take(self, book, got, i) -> int:
        start, end, nxt = got
        self.after, self.book, self.chapter = nxt, book, (end or start).chapter
        self.found.append(Citation(book, start, end, (i, nxt)))
        return nxt

    def run(self) -> list[Citation]:
        i, bare, had_verse, text = 0, NOTHING, False, self.text
        while i < len(text):
            edge = not text[i - 1 : i].isalnum() if i else True
            if edge and (hit := self.names.match(text, i)) and not text[i + hit[1] : i + hit[1] + 1].isalpha():
                code, n = hit
                j = i + n
                if text.startswith(".", j):
                    j += 1
                j = self.blank(j)
                while (n := self.extra(j)) is not None:
                    j = self.blank(j + n)
                single = code in SINGLE_CHAPTER
                got = self.location(j, VERSE if single else CHAPTER, 1 if single else None)
                if got:
                    had_verse = got[0].verse is not None
                    bare, i = VERSE, self.take(code, got, i)
                    continue
            if edge and text[i] in _DIGITS and self.book and not (bare == NOTHING and self.follows_word(i)):
                single = self.book in SINGLE_CHAPTER
                meaning = CHAPTER if bare == VERSE and not had_verse else bare
                if single and meaning == CHAPTER:
                    meaning = VERSE
                got = self.location(i, meaning, 1 if single else self.chapter)
                if got:
                    had_verse = got[0].verse is not None
                    bare, i = VERSE, self.take(self.book, got, i)
                    continue
            if bare != NOTHING:
                if n := self.spaced(i, self.form.sequence):
                    i += n
                    continue
                if n := self.spaced(i, self.form.chapter_number) or self.spaced(i, self.form.book_sequence):
                    bare, had_verse = CHAPTER, False
                    i += n
                    continue
            if edge and (n := self.extra(i)) is not None:
                i += n
                continue
            if not (text[i].isspace() or text[i] in _MARKS):
                bare = NOTHING
            i += 1
        return self.found


def parse_citations(text: str, form: CitationFormat | None = None, names: BookNames | None = None, book: str | None = None) -> list[Citation]:
    """The references in a text, in order; what lies between is text. ``book`` is what a bare
    number belongs to before any name."""
    return _Scanner(text, form or CitationFormat(), names or BookNames(codes=True), book).run()


def parse_link(value: str) -> list[Citation] | None:
    """References of a link target; None if anything but separators stands between them."""
    found = parse_citations(value, CitationFormat(), BookNames(codes=True, any_case=True))
    at = 0
    for gap in [*((c.at[0], c.at[1]) for c in found), (len(value), len(value))]:
        if not re.fullmatch(rf"[\s,;{_MARKS}]*", value[at : gap[0]]):
            return None
        at = gap[1]
    return found or None


def widen(form: CitationFormat, declared: dict[str, str]) -> CitationFormat:
    """A format with declared spellings first and the standard one after, unless another role
    claims it. ``declared`` maps role names to a spelling (alternatives joined by |)."""
    claimed = {s for k, v in declared.items() for s in v.split("|") if s}
    out = {}
    for role in ("chapter_verse", "range", "chapter_range", "sequence", "chapter_number", "book_sequence"):
        own = tuple(s for s in declared.get(role, "").split("|") if s)
        out[role] = own + tuple(s for s in getattr(form, role) if s not in own and (s not in claimed or not own))
    return replace(form, **out)
