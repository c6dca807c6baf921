"""spark-submit entry points: parse, format and fix over files or folders.

    python -m quillspark.cli parse PATH -f usx -o OUT [--from usx] [-s SHEET | --custom-stylesheet SHEET]
    python -m quillspark.cli format PATH --check | -o OUT [--force]
    python -m quillspark.cli fix PATH -o OUT [--code CODE]

Diagnostics go to standard output as text or JSON lines. The exit code is 1 if a document is
refused (--strict: any error; --deny-warnings: any warning; format --check: not canonical).
"""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.fixes import FIXABLE
from .functions.style import Sheet, default_sheet, read_sheet
from .operators import diagnostics
from .plans import render
from .sources import markup


def find_lint(folder: Path) -> Path | None:
    """The nearest usfm.toml in a folder or one above it."""
    return next((p for d in (folder, *folder.parents) if (p := d / "usfm.toml").is_file()), None)


def sheet_of(args) -> Sheet:
    """--stylesheet replaces the default sheet, --custom-stylesheet amends it."""
    base = read_sheet(Path(args.stylesheet).read_text(encoding="utf-8-sig")) if args.stylesheet else default_sheet()
    return base.with_text(Path(args.custom_stylesheet).read_text(encoding="utf-8-sig")) if args.custom_stylesheet else base


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillspark")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("parse", "format", "fix"):
        c = sub.add_parser(name)
        c.add_argument("path")
        c.add_argument("-s", "--stylesheet")
        c.add_argument("--custom-stylesheet")
        c.add_argument("-o", "--output")
        c.add_argument("--config")
        c.add_argument("--no-config", action="store_true")
        c.add_argument("--diagnostics", choices=("text", "json"), default="text")
        if name == "parse":
            c.add_argument("--from", dest="source", choices=sorted(render.READERS), default="usfm")
            c.add_argument("-f", "--format", choices=sorted(render.FORMATS), default="usx")
            c.add_argument("-r", "--replace", action="append", default=[])
            c.add_argument("--strict", action="store_true")
            c.add_argument("--deny-warnings", action="store_true")
        if name == "format":
            c.add_argument("--check", action="store_true")
            c.add_argument("--force", action="store_true")
        if name == "fix":
            c.add_argument("--code", action="append", default=[], choices=FIXABLE)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    sheet = sheet_of(args)
    config = args.config or (None if args.no_config else find_lint(Path.cwd()))
    lint = diagnostics.read_lint(Path(config).read_text()) if config else {}
    docs = markup.scan(spark, args.path)
    refused = 0
    if args.command == "parse":
        found = render.diagnosed(docs, sheet, lint, args.source).cache()
        lines = diagnostics.as_json if args.diagnostics == "json" else diagnostics.as_text
        for r in diagnostics.ordered(lines(diagnostics.located(found, docs)).withColumn("code", F.lit(""))).toLocalIterator():
            print(r["value"])
        threshold = "warning" if args.deny_warnings else "error" if args.strict else None
        if threshold:
            kept = diagnostics.accepted(docs, found, threshold)
            refused = docs.count() - kept.count()
            docs = kept
        rules = "\n".join(Path(r).read_text(encoding="utf-8") for r in args.replace) or None
        out = render.render(docs, args.format, args.source, sheet, rules)
    elif args.command == "format":
        out = render.formatted(docs, sheet, args.force)
        if args.check:
            odd = out.join(docs, "doc_id").where("value is null or value <> text").select("doc_id").orderBy("doc_id")
            for r in odd.toLocalIterator():
                refused += 1
                print(r["doc_id"])
            return int(refused > 0)
        refused = out.where("value is null").count()
        out = out.where("value is not null")
    else:
        codes = tuple(args.code) or tuple(c for c in FIXABLE if lint.get(c) != "off")
        out = render.fixed(docs, sheet, codes)
    if args.output:
        render.write(out, args.output)
    else:
        for r in out.orderBy("doc_id").toLocalIterator():
            print(r["value"], end="")
    return int(refused > 0)


if __name__ == "__main__":
    sys.exit(main())
