"""The algebra of diagnostics: union, order, lint levels, thresholds, lines and columns."""

from __future__ import annotations

import tomllib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import CODES, RANK

LEVELS = ("off", "info", "warning", "error")


def together(*parts: DataFrame) -> DataFrame:
    """Diagnostics of several passes with ``ord``: by position, parser before checks."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ordered(found: DataFrame) -> DataFrame:
    return found.orderBy("doc_id", "span_start", "pass", "seq", "code")


def rank(severity: Column | str = "severity") -> Column:
    s = F.col(severity) if isinstance(severity, str) else severity
    return F.when(s == "error", 3).when(s == "warning", 2).when(s == "info", 1).otherwise(0)


def read_lint(text: str) -> dict[str, str]:
    """[lint.rules] of a TOML text; unknown keys, codes and levels are errors."""
    data = tomllib.loads(text)
    if extra := set(data) - {"lint"}:
        raise ValueError(f"unknown key {sorted(extra)[0]}")
    lint = data.get("lint", {})
    if extra := set(lint) - {"rules"}:
        raise ValueError(f"unknown key lint.{sorted(extra)[0]}")
    for code, level in lint.get("rules", {}).items():
        if code not in CODES:
            raise ValueError(f"unknown code {code}")
        if level not in LEVELS:
            raise ValueError(f"unknown level {level}")
    return dict(lint.get("rules", {}))


def apply_lint(found: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Without codes that are off, others at their configured level."""
    if not rules:
        return found
    table = found.sparkSession.createDataFrame(list(rules.items()), "code string, level string")
    out = found.join(F.broadcast(table), "code", "left").where("level is null or level <> 'off'")
    return out.withColumn("severity", F.coalesce("level", "severity")).drop("level")


def at_least(found: DataFrame, threshold: str) -> DataFrame:
    return found.where(rank() >= RANK[threshold])


def worst(found: DataFrame) -> DataFrame:
    """(doc_id, worst rank, n) of documents that have diagnostics."""
    return found.groupBy("doc_id").agg(F.max(rank()).alias("worst"), F.count(F.lit(1)).alias("n"))


def accepted(docs: DataFrame, found: DataFrame, threshold: str = "error") -> DataFrame:
    """Documents without a diagnostic at ``threshold`` or above."""
    return docs.join(at_least(found, threshold).select("doc_id").distinct(), "doc_id", "left_anti")


def prefix(text: Column, offset: Column) -> Column:
    """The text before a byte offset, which is clamped to the text."""
    data = F.encode(text, "utf-8")
    return F.decode(F.substring(data, F.lit(1), F.greatest(F.lit(0), F.least(offset, F.octet_length(data))).cast("int")), "utf-8")


def line(text: Column, offset: Column) -> Column:
    p = prefix(text, offset)
    return F.length(p) - F.length(F.replace(p, F.lit("\n"))) + 1


def column(text: Column, offset: Column) -> Column:
    return F.length(F.substring_index(prefix(text, offset), "\n", -1)) + 1


def utf16_column(text: Column, offset: Column) -> Column:
    return (F.octet_length(F.encode(F.substring_index(prefix(text, offset), "\n", -1), "UTF-16LE")) / 2).cast("int") + 1


def line_count(text: Column) -> Column:
    n = F.length(text) - F.length(F.replace(text, F.lit("\n")))
    return n + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)


def located(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Diagnostics with 1-based line and column in characters."""
    at = found.join(docs.select("doc_id", "text"), "doc_id")
    return at.select(*found.columns, line(F.col("text"), F.col("span_start")).alias("line"), column(F.col("text"), F.col("span_start")).alias("column"))


def as_text(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "span_start", "pass", "seq", F.format_string("%s:%d:%d: %s[%s]: %s", "doc_id", "line", "column", "severity", "code", "message").alias("value"))


def as_json(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "span_start", "pass", "seq", F.to_json(F.struct(F.col("doc_id").alias("file"), "line", "column", "severity", "code", "message", F.col("span_start").alias("start"), F.col("span_end").alias("end"))).alias("value"))
