"""Folders of a translation project: settings, book names, sheets, books, interlinear files."""

from __future__ import annotations

from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.books import _DC, _NT, _OT, category, well_formed
from ..functions.citations import BookNames, CitationFormat
from ..functions.interlinear import Lexicon, ProjectError, Verse, _all, _text, read_interlinear, read_lexicon, root
from ..functions.style import Sheet, default_sheet, read_sheet

_UTF8 = "65001"
_three = lambda s: [s[i : i + 3] for i in range(0, len(s), 3)]
#: Books in the order of the flags of a project; a few codes are of older projects only.
_SHORT = _DC[: _DC.index("EZA")]
CANON = [*_three(_OT), *_three(_NT), *_three(_SHORT), *_three("JSAJSBTBSSSTDNTBLTXXAXXBXXCXXDXXEXXFXXGFRTBAKOTH3ESEZA5EZ6EZINTCNCGLOTDXNDX"), *_three(_DC[_DC.index("DAG") :])]
_ROLES = (("chapter_verse", "ChapterVerseSeparator"), ("range", "RangeIndicator"), ("chapter_range", "ChapterRangeSeparator"), ("sequence", "SequenceIndicator"), ("chapter_number", "ChapterNumberSeparator"), ("book_sequence", "BookSequenceSeparator"))


def file_number(code: str) -> str | None:
    """Two characters: 01 to 39, 41 to 99 and 100, then A0 and on."""
    if code not in CANON:
        return None
    i = CANON.index(code)
    n = i + 1 if i < 39 else i + 2
    return f"{n:02d}" if n <= 100 else f"{chr(65 + (n - 101) // 10)}{(n - 101) % 10}"


@dataclass
class Settings:
    values: dict[str, str]
    pre: str = ""
    post: str = ""
    form: str = ""

    @classmethod
    def read(cls, xml: str) -> Settings:
        top = root_any(xml)
        values = {e.name: _text(e) for e in top.children if e.name and e.name != "Naming"}
        naming = next((e for e in top.children if e.name == "Naming"), None)
        part = lambda k: (naming.get(k) if naming is not None else None) or ("" if naming is not None and naming.get(k) is not None else values.get("FileName" + k, ""))
        return cls(values, part("PrePart"), part("PostPart"), part("BookNameForm").strip())

    def books(self) -> list[str]:
        flags = self.values.get("BooksPresent", "")
        return [c for c, f in zip(CANON, flags) if f == "1"]

    def file_name(self, code: str) -> str | None:
        number = file_number(code)
        stem = {"": number and number + code, "41MAT": number and number + code, "MAT": code, "41": number}.get(self.form)
        return self.pre + stem + self.post if stem else None

    def citation_format(self) -> CitationFormat:
        own = {r: tuple(s for x in self.values.get(k, "").split("|") if (s := x.strip())) for r, k in _ROLES}
        standard = CitationFormat()
        out = {}
        for role, _ in _ROLES:
            claimed = {s for r, x in own.items() if r != role for s in x}
            usual = getattr(standard, role)
            out[role] = own[role] + tuple(s for s in usual if s not in claimed and s not in own[role]) if own[role] else usual
        return CitationFormat(**out, extra=tuple(s for x in self.values.get("ReferenceExtraMaterial", "").split("|") if (s := x.strip())))


def root_any(xml: str):
    from ..functions.usx import read_xml

    e, error = read_xml(xml.removeprefix("\ufeff"))
    if e is None:
        raise ProjectError(error[1])
    return e


def read_book_names(xml: str) -> list[tuple[str, str | None, str | None, str | None]]:
    """(code, abbreviation, short, long); empty names are None, bad codes left out."""
    return [(e.get("code"), e.get("abbr") or None, e.get("short") or None, e.get("long") or None) for e in _all(root(xml, "BookNames"), "book") if well_formed(e.get("code") or "")]


@dataclass
class Project:
    path: Path
    settings: Settings
    names: list[tuple] = field(default_factory=list)

    @classmethod
    def open(cls, path: str) -> Project:
        p = Path(path)
        names = p / "BookNames.xml"
        return cls(p, Settings.read(_read(p / "Settings.xml")), read_book_names(_read(names)) if names.is_file() else [])

    def read_book(self, code: str) -> str:
        encoding = self.settings.values.get("Encoding", "").strip()
        if encoding and encoding != _UTF8:
            raise ProjectError(f"code page {encoding} is not UTF-8")
        name = self.settings.file_name(code)
        if name is None:
            raise ProjectError(f"no file name for {code}")
        return _read(self.path / name)

    def documents(self, spark: SparkSession) -> DataFrame:
        """(doc_id, text, error) of the books that the settings list, read by Spark."""
        files = {self.settings.file_name(c): c for c in self.settings.books() if self.settings.file_name(c)}
        there = [n for n in files if (self.path / n).is_file()]
        if not there:
            return spark.createDataFrame([], "doc_id string, text string, error string")
        encoding = self.settings.values.get("Encoding", "").strip()
        bad = f"code page {encoding}" if encoding and encoding != _UTF8 else None
        rows = spark.read.text([str(self.path / n) for n in there], wholetext=True)
        name = F.element_at(F.split(F.input_file_name(), "/"), -1)
        codes = F.create_map(*[F.lit(x) for n in there for x in (n, files[n])])
        text = F.regexp_replace("value", "^\ufeff", "") if bad is None else F.lit(None).cast("string")
        return rows.select(codes[name].alias("doc_id"), text.alias("text"), F.lit(bad).cast("string").alias("error"))

    def sheets(self) -> tuple[Sheet, Sheet]:
        """For scripture and for peripheral books."""
        own = self.settings.values.get("StyleSheet", "")
        base = read_sheet(_read(self.path / own)) if own and (self.path / own).is_file() else default_sheet()
        main = base.with_text(_read(self.path / "custom.sty")) if (self.path / "custom.sty").is_file() else base
        front = main.with_text(_read(self.path / "frtbak.sty")) if (self.path / "frtbak.sty").is_file() else main
        return main, front

    def sheet_for(self, code: str) -> Sheet:
        return self.sheets()[category(code) == "NonScripture"]

    def book_names(self) -> BookNames:
        out = BookNames(codes=True)
        for code, *names in self.names:
            for n in names:
                if n:
                    out.add(n, code)
        return out

    def languages(self) -> list[str]:
        return sorted(d.name.removeprefix("Interlinear_") for d in self.path.iterdir() if d.is_dir() and d.name.startswith("Interlinear_") and d.name != "Interlinear_")

    def interlinear(self, language: str, code: str) -> tuple[dict, list[Verse]] | None:
        name = f"Interlinear_{language}_{code}.xml"
        for p in (self.path / f"Interlinear_{language}" / name, self.path / name):
            if p.is_file():
                return read_interlinear(_read(p))
        return None

    def lexicon(self) -> Lexicon | None:
        p = self.path / "Lexicon.xml"
        return read_lexicon(_read(p)) if p.is_file() else None


def _read(path: Path) -> str:
    return path.read_text(encoding="utf-8-sig")
