"""Diagnostic codes with severity and origin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ERROR, WARNING, INFO = "error", "warning", "info"
RANK = {"off": 0, INFO: 1, WARNING: 2, ERROR: 3}
_WARN = "unknown-custom-marker unknown-milestone nested-marker-not-nested character-style-not-closed usfm2-figure content-outside-paragraph"
_PARSER = "unknown-marker unmatched-closing-marker paragraph-marker-closed unmatched-milestone-end milestone-not-closed stray-backslash figure-not-closed note-not-closed missing-note-caller missing-verse-number malformed-verse-number verse-in-note missing-chapter-number malformed-chapter-number alternate-chapter-not-closed alternate-verse-not-closed missing-book-code unknown-book-code sidebar-not-closed unmatched-sidebar-end content-dropped expected-table-cell unexpected-pipe unterminated-attribute-value newline-in-attributes attribute-value-not-quoted missing-attribute-value number-has-leading-zero internal"
_SEMANTIC = {
    ERROR: "marker-not-allowed-here empty-attribute-list no-default-attribute default-attribute-with-others malformed-attribute-name duplicate-attribute missing-id id-not-first empty-book verse-text-before-chapter verse-outside-chapter verse-in-heading unexpected-table-column empty-word",
    WARNING: "unlisted-book-code empty-milestone-attribute-list verse-in-character-style duplicate-verse-number verse-out-of-order duplicate-chapter-number chapter-out-of-order",
    INFO: "marker-not-listed-here",
}
_USX = {ERROR: "usx-not-well-formed usx-unmatched usx-verse-end-mismatch", WARNING: "usx-unknown-element usx-reference-mismatch usx-verse-end-missing"}

#: code -> (severity, origin)
CODES: dict[str, tuple[str, str]] = {c: (ERROR, "parser") for c in _PARSER.split()}
CODES |= {c: (WARNING, "parser") for c in _WARN.split()}
CODES |= {c: (INFO, "parser") for c in ("character-style-implicitly-closed", "character-style-nested-without-plus", "unknown-custom-milestone")}
for _origin, _by in (("semantic", _SEMANTIC), ("usx", _USX)):
    for _severity, _names in _by.items():
        CODES |= {c: (_severity, _origin) for c in _names.split()}


def code_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, s, RANK[s], o) for c, (s, o) in CODES.items()], "code string, severity string, rank int, origin string")
