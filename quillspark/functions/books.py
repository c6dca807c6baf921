"""Book codes, their categories, and chapter and verse numbers."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_OT = "GENEXOLEVNUMDEUJOSJDGRUT1SA2SA1KI2KI1CH2CHEZRNEHESTJOBPSAPROECCSNGISAJERLAMEZKDANHOSJOLAMOOBAJONMICNAMHABZEPHAGZECMAL"
_NT = "MATMRKLUKJHNACTROM1CO2COGALEPHPHPCOL1TH2TH1TI2TITITPHMHEBJAS1PE2PE1JN2JN3JNJUDREV"
_DC = "TOBJDTESGWISSIRBARLJES3YSUSBEL1MA2MA3MA4MA1ES2ESMANPS2ODAPSSEZA5EZ6EZDAGPS32BALBAJUBENO1MQ2MQ3MQREP4BALAO"
_NS = "XXAXXBXXCXXDXXEXXFXXGFRTBAKOTHINTCNCGLOTDXNDX"
CATEGORY = {codes[i : i + 3]: name for name, codes in (("OldTestament", _OT), ("NewTestament", _NT), ("Deuterocanon", _DC), ("NonScripture", _NS)) for i in range(0, len(codes), 3)}
SINGLE_CHAPTER = frozenset("OBA PHM 2JN 3JN JUD".split())
_FORM = re.compile(r"[A-Z][A-Z0-9]{2}|[0-9][A-Z][0-9]|[0-9]{2}[A-Z]")


def well_formed(code: str) -> bool:
    return bool(_FORM.fullmatch(code))


def category(code: str) -> str:
    return CATEGORY.get(code, "Other")


def book_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORY.items()), "code string, category string")


@dataclass(frozen=True)
class Range:
    start: int
    start_part: str = ""
    end: int = -1
    end_part: str = ""
    guard: str = ""
    trailing: str = ""

    def __str__(self) -> str:
        tail = self.end != self.start or self.end_part or self.guard
        return f"{self.start}{self.start_part}" + (f"{self.guard}-{self.end}{self.end_part}" if tail else "") + self.trailing


_RANGE = re.compile("([0-9]+)([^\\W\\d_])?([\u200e\u200f])?(?:(-)([0-9]+)([^\\W\\d_])?([\u200e\u200f])?)?(,|$)")


@lru_cache(maxsize=1 << 15)
def parse_numbers(text: str) -> tuple[Range, ...] | None:
    """``1``, ``1a``, ``2-3b``, ``1,3-5``; None unless the whole text is such a list."""
    out, at = [], 0
    while True:
        m = _RANGE.match(text, at)
        if not m or any(len(x) > 18 for x in (m[1], m[5] or "")):
            return None
        if m[4]:
            out.append(Range(int(m[1]), m[2] or "", int(m[5]), m[6] or "", m[3] or "", m[7] or ""))
        else:
            out.append(Range(int(m[1]), m[2] or "", int(m[1]), "", "", m[3] or ""))
        if m[8] != ",":
            return tuple(out) if m.end() == len(text) else None
        at = m.end()


@lru_cache(maxsize=1 << 15)
def numbers(text: str) -> tuple[tuple[Range, ...], str] | None:
    """A list of numbers and how it is shown."""
    found = parse_numbers(text)
    return (found, show_numbers(found)) if found is not None else None


@lru_cache(maxsize=1 << 15)
def show_numbers(ranges: tuple[Range, ...]) -> str:
    return ",".join(map(str, ranges))
