"""Style sheets: the default one, ``.sty`` text, overlays, and the table form of a sheet."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

from ._styles import PARENTS, STYLES

KINDS = {"P": "paragraph", "C": "character", "N": "note", "M": "milestone"}
TEXTS = {"o": "other", "c": "chapternumber", "n": "versenumber", "v": "versetext", "t": "title", "s": "section", "f": "notetext"}
#: Property bits; the three lowest are a level.
PROPERTIES = {"paragraph": 8, "publishable": 16, "chapter": 32, "verse": 64, "vernacular": 128, "book": 256, "poetic": 512, "note": 1024, "crossreference": 2048}
_FALLBACK = {"w": "lemma", "rb": "gloss", "xt": "link-href", "jmp": "link-href", "ref": "loc", "periph": "id", "tl": "lang", "wl": "lang", "vid": "ref"}


class StyleError(ValueError):
    """A style sheet that can't be read."""


@dataclass(frozen=True)
class Style:
    marker: str
    kind: str
    text: str = "other"
    properties: int = 0
    nest: bool = False
    parents: tuple[str, ...] = ()
    attributes: tuple[tuple[str, bool], ...] = ()  # (name, required)
    name: str | None = None
    description: str | None = None

    @property
    def vernacular(self) -> bool:
        return bool(self.properties & PROPERTIES["vernacular"])

    @property
    def publishable(self) -> bool:
        return bool(self.properties & PROPERTIES["publishable"])

    @property
    def default_attribute(self) -> str | None:
        if not self.attributes:
            return fallback_attribute(self.marker)
        return self.attributes[0][0] if sum(r for _, r in self.attributes) <= 1 else None


def fallback_attribute(marker: str) -> str | None:
    if marker.startswith("qt") and marker[-2:] in ("-s", "-e"):
        return "who"
    return _FALLBACK.get(marker)


@dataclass
class Sheet:
    """Styles by marker, in order of their first entry."""

    styles: dict[str, Style] = field(default_factory=dict)

    def get(self, marker: str) -> Style | None:
        return self.styles.get(marker)

    def default_attribute(self, marker: str) -> str | None:
        s = self.styles.get(marker)
        return s.default_attribute if s else fallback_attribute(marker)

    def with_text(self, text: str) -> Sheet:
        """This sheet amended and extended by the entries of a ``.sty`` text."""
        out = Sheet(dict(self.styles))
        for marker, entry in _entries(text):
            old = out.styles.get(marker)
            if old is not None:
                if "parents" not in entry:
                    entry.pop("nest", None)
                out.styles[marker] = replace(old, **entry)
                continue
            if "kind" not in entry:
                raise StyleError(f"\\Marker {marker} has no \\StyleType")
            new = Style(marker, **entry)
            if new.kind == "milestone" and marker.endswith("-s"):
                out.styles[marker[:-1] + "e"] = replace(new, marker=marker[:-1] + "e")
            out.styles[marker] = new
        return out


def _entries(text: str):
    marker, entry = "", {}
    for line in text.removeprefix("\ufeff").splitlines():
        line = re.sub(r"^(?:#!)+", "", line).strip()
        m = re.match(r"\\(\S+)(?:\s(.*))?$", line, re.S)
        if not m:
            continue
        key, value = m[1], (m[2] or "").strip()
        if key == "Marker":
            if marker:
                yield marker, entry
            marker, entry = value, {}
        elif key in ("Name", "Description") and value:
            entry[key.lower()] = value
        elif key == "StyleType":
            if value.lower() not in KINDS.values():
                raise StyleError(f"unknown style type {value}")
            entry["kind"] = value.lower()
        elif key == "TextType":
            if value.lower() not in TEXTS.values():
                raise StyleError(f"unknown text type {value}")
            entry["text"] = value.lower()
        elif key == "TextProperties":
            entry["properties"] = _properties(value)
        elif key == "OccursUnder":
            names = value.split()
            entry["nest"] = "NEST" in names
            if found := tuple(x for x in names if x != "NEST"):
                entry["parents"] = found
        elif key == "Attributes":
            if found := tuple((x.lstrip("?"), not x.startswith("?")) for x in value.split() if x.lstrip("?")):
                entry["attributes"] = found
    if marker:
        yield marker, entry


def _properties(value: str) -> int:
    bits = 0
    for word in value.lower().split():
        if m := re.fullmatch(r"level_([1-5])", word):
            bits |= int(m[1])
        elif word.startswith("non") and word[3:] in PROPERTIES:
            bits &= ~PROPERTIES[word[3:]]
        elif word in PROPERTIES:
            bits |= PROPERTIES[word]
        else:
            raise StyleError(f"unknown text property {word}")
    return bits


@lru_cache(maxsize=1)
def default_sheet() -> Sheet:
    lines = STYLES.split("\n")[1:-1]
    markers = [x.partition(":")[0] for x in lines]
    sets = [tuple(m for i, m in enumerate(markers) if int(x, 16) >> i & 1) for x in PARENTS.split("\n")[1:-1]]
    styles = {}
    for line in lines:
        marker, code, attributes = line.split(":")
        m = re.fullmatch(r"(.)(.)([0-9a-f]+)([+-])(\d+)", code)
        names = tuple((x.lstrip("?"), not x.startswith("?")) for x in attributes.split())
        styles[marker] = Style(marker, KINDS[m[1]], TEXTS[m[2]], int(m[3], 16), m[4] == "+", sets[int(m[5])], names)
    return Sheet(styles)


def read_sheet(text: str) -> Sheet:
    return Sheet().with_text(text)


def sheet_table(spark: SparkSession, sheet: Sheet | None = None) -> DataFrame:
    """styles(marker, kind, text_type, vernacular, publishable, level, nest, parents, attributes, default_attribute)."""
    rows = [(s.marker, s.kind, s.text, s.vernacular, s.publishable, s.properties & 7, s.nest, list(s.parents), [n for n, _ in s.attributes], s.default_attribute) for s in (sheet or default_sheet()).styles.values()]
    return spark.createDataFrame(rows, "marker string, kind string, text_type string, vernacular boolean, publishable boolean, level int, nest boolean, parents array<string>, attributes array<string>, default_attribute string")


def base(marker: str) -> str:
    """A marker without its level and milestone ending: qt2-s is qt."""
    return re.sub(r"\d+$", "", re.sub(r"(?:-[se])+$", "", marker))


def level(marker: str) -> int | None:
    m = re.search(r"(\d+)(?:-[se])*$", marker)
    return int(m[1]) if m else None
