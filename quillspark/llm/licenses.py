"""Licence scan by a trained paragraph classifier (op 6, native).

A softmax regression over word n-grams names the licence family of a paragraph, or "unknown";
a comparison with the family's templates confirms it. A paragraph is a line, and a line with its
neighbours, as notices are wrapped. Training is a few hundred sentences on the driver. The scan
itself is one pass of expressions: lines whose words can't add up to any
family, whatever their order, are unknown by the weights themselves and leave before anything is
exploded, the weights of the others' n-grams are summed, and shingles meet the template's.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

UNKNOWN = "unknown"
#: Short statements in common use, by family.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT license.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "SPDX-License-Identifier: MIT", "This project is available under the terms of the MIT License."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may not use this file except in compliance with the Apache License.", "Released under the Apache License, Version 2.0.", "SPDX-License-Identifier: Apache-2.0", "See the Apache License for the specific language governing permissions and limitations under the license."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and modify it under the terms of the GNU General Public License", "Released under the GNU GPL version 3 or any later version.", "SPDX-License-Identifier: GPL-3.0-or-later", "You should have received a copy of the GNU General Public License along with this program."],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted", "Released under the BSD license.", "Licensed under the 3-clause BSD License.", "SPDX-License-Identifier: BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse products"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "SPDX-License-Identifier: CC-BY-4.0"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "SPDX-License-Identifier: CC-BY-NC-4.0"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "SPDX-License-Identifier: CC-BY-SA-4.0"],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved worldwide.", "No part of this publication may be reproduced without prior written permission of the publisher."],
}
#: Sentences near the subject that name no licence, for the unknown class.
BACKGROUND = ["The driver must carry a licence at all times.", "He lost his license after the accident.", "Permission to enter was granted by the guard.", "The copyright debate went on for years.", "A public meeting about software was held.", "The source of the river is in the mountains.", "She works at the institute of technology.", "The new version of the program is faster.", "Free copies of the work are in the library.", "The terms of the contract were fair.", "An apache helicopter flew over the town.", "The commons were used by all people.", "Human rights are universal.", "The rights of the reserved seats were sold.", "Use of this road is permitted.", "A general of the army spoke in public.", "The name of the holder is written on the card.", "They may not use this file.", "A creative person needs free time.", "Modification of the plan was not permitted."]
_STOP = frozenset("a an the of to and or in is it this that for under by with be on as are at any you may not its all was no he his".split())


def tokens(text: str) -> list[str]:
    return [w for w in re.split("[^a-z0-9]+", text.lower()) if w]


def grams(words: list[str]) -> list[str]:
    """Distinct words that are no stop words, and pairs of neighbours."""
    return sorted({w for w in words if w not in _STOP} | {f"{a} {b}" for a, b in zip(words, words[1:])})


class LicenceModel:
    """Softmax regression by gradient descent on the templates, their pieces and background;
    ``temperature`` and ``cutoff`` are calibrated on pieces that were left out."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES, background: list[str] = BACKGROUND, epochs: int = 250, rate: float = 0.5, decay: float = 1e-3):
        rows: list[tuple[str, list[str]]] = []
        for family, texts in templates.items():
            for t in texts:
                w = tokens(t)
                rows.append((family, w))
                rows += [(family, [*tokens(b)[:k], *w]) for k, b in zip((3, 6), (background[len(w) % len(background)], background[len(t) % len(background)]))]
        rows += [(UNKNOWN, tokens(b)) for b in background for _ in range(2)]
        self.families = [*templates, UNKNOWN]
        seen = Counter(g for f, w in rows if f != UNKNOWN for g in grams(w))
        own = {g for t in templates.values() for x in t for g in grams(tokens(x))}
        self.vocabulary = sorted(g for g in seen if g in own)
        #: Word pairs of each template, and of all templates of a family.
        self.each = {f: [[" ".join(x) for x in zip(tokens(t), tokens(t)[1:])] for t in texts] for f, texts in templates.items()}
        self.templates = {f: sorted({" ".join(x) for t in texts for x in zip(tokens(t), tokens(t)[1:])}) for f, texts in templates.items()}
        at = {g: i for i, g in enumerate(self.vocabulary)}
        k = len(self.families)
        self.weights = [[0.0] * k for _ in self.vocabulary]
        self.bias = [0.0] * (k - 1) + [1.0]
        data = [(self.families.index(f), [at[g] for g in grams(w) if g in at]) for f, w in rows]
        train, held = [d for i, d in enumerate(data) if i % 4], data[::4]
        for epoch in range(epochs):
            step = rate / (1 + epoch / 50)
            for y, x in train:
                p = self.softmax(x)
                for c in range(k):
                    g = step * (p[c] - (c == y))
                    for i in x:
                        self.weights[i][c] -= g / max(1, len(x)) ** 0.5 + step * decay * self.weights[i][c]
                    self.bias[c] -= g * 0.1
        # Temperature by the held-out likelihood, then the least probability that is right.
        loss = lambda t: -sum(math.log(max(1e-12, self.softmax(x, t)[y])) for y, x in held)
        self.temperature = min((0.5, 0.7, 1.0, 1.4, 2.0, 2.8), key=loss)
        self.weights = [[round(v / self.temperature, 6) for v in w] for w in self.weights]
        self.bias = [round(b / self.temperature, 6) for b in self.bias]
        wrong = [max(p[:-1]) for y, x in held if (p := self.softmax(x)).index(max(p)) != y or y == k - 1]
        self.cutoff = round(min(0.8, max([0.5, *wrong])), 6)

    def softmax(self, x: list[int], t: float = 1.0) -> list[float]:
        z = [(b + sum(self.weights[i][c] for i in x)) / t for c, b in enumerate(self.bias)]
        top = max(z)
        e = [math.exp(v - top) for v in z]
        return [v / sum(e) for v in e]


def marks(m: LicenceModel) -> list[str]:
    """Words one of which every paragraph with a family holds. The other words of the
    vocabulary are too weak for that: all n-grams made of them alone, together, leave every
    family under the cutoff. Ordinary words are tried first for those."""
    families = range(len(m.families) - 1)
    room = [math.log(m.cutoff / (1 - m.cutoff)) - (m.bias[c] - m.bias[-1]) - 1e-6 for c in families]
    weighed = [(frozenset(g.split()), [max(0.0, w[c] - w[-1]) for c in families]) for g, w in zip(m.vocabulary, m.weights)]
    ordinary = {w for b in BACKGROUND for w in tokens(b)}
    most = {w: max(max(v) for g, v in weighed if w in g) for g, _ in weighed for w in g}
    weak: set[str] = set()
    for w in sorted(most, key=lambda w: (w not in _STOP, w not in ordinary, most[w], w)):
        inside = [v for g, v in weighed if g <= weak | {w}]
        if all(sum(v[c] for v in inside) <= room[c] for c in families):
            weak.add(w)
    return sorted(most.keys() - weak)


_model: LicenceModel | None = None


def model() -> LicenceModel:
    global _model
    if _model is None:
        _model = LicenceModel()
    return _model


def _literal(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A table from a constant of the plan; its size is that of the model."""
    return spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")).alias("r")).select("r.*")


def _pairs(w: Column) -> Column:
    n = F.greatest(F.size(w) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(w) > 1, pairs).otherwise(F.array().cast("array<string>"))


def _pieces(text: Column, m: LicenceModel) -> Column:
    """The lines of a text that hold a mark, as structs (line, wide, piece): each by itself, and
    wide, as notices are wrapped, with the line before it and two after it, up to blank ones."""
    begin: dict[str, list[str]] = {}
    for w in marks(m):
        begin.setdefault(w[0], []).append(w[1:])
    any_mark = "(?<![a-z0-9])(?:" + "|".join(f"{x}(?:{'|'.join(rest)})" for x, rest in begin.items()) + ")(?![a-z0-9])"
    lines = F.split(text, "\n")

    def near(i: Column, k: int) -> Column:
        line = F.get(lines, i + k)
        return F.when(F.trim(line) != "", line)

    def piece(x: Column, i: Column) -> Column:
        after = near(i, 1)
        wide = F.concat_ws(" ", near(i, -1), x, after, F.when(after.isNotNull(), near(i, 2)))
        one = lambda flag, t: F.struct(i.alias("line"), F.lit(flag).alias("wide"), t.alias("piece"))
        return F.when(F.lower(x).rlike(any_mark), F.array(one(False, x), one(True, wide)))

    return F.flatten(F.array_compact(F.transform(lines, piece)))


def paragraphs(docs: DataFrame, m: LicenceModel, confirm: float = 0.5) -> DataFrame:
    """(_row, doc_id, line, wide, family, probability, overlap, confirmed): a row for each piece
    of a document, and one with nulls for a document without any. ``family`` is null where the
    model names none; ``overlap`` is the part of a piece's word pairs that stand in templates of
    the family, or of one template's pairs that stand in it, if larger."""
    spark = docs.sparkSession
    pieces = docs.select("_row", "doc_id", F.explode_outer(_pieces(F.col("text"), m)).alias("x")).select("_row", "doc_id", "x.*")
    words = F.filter(F.split(F.lower("piece"), "[^a-z0-9]+"), lambda w: w != "")
    pieces = pieces.select("_row", "doc_id", "line", "wide", words.alias("w"))
    pieces = pieces.select("_row", "doc_id", "line", "wide", F.array_distinct("w").alias("w"), F.array_distinct(_pairs(F.col("w"))).alias("p"))
    # The grams that the model knows are few, so their weights are looked up and added in place:
    # nothing is shuffled but the verdicts.
    k = len(m.families)
    vocabulary = F.from_json(F.lit(json.dumps(m.vocabulary)), "array<string>")
    weights = F.from_json(F.lit(json.dumps(dict(zip(m.vocabulary, m.weights)))), "map<string,array<double>>")
    bias = F.from_json(F.lit(json.dumps(m.bias)), "array<double>")
    known = pieces.withColumn("known", F.array_intersect(F.concat("w", "p"), vocabulary)).drop("w")
    z = F.aggregate("known", bias, lambda s, g: F.zip_with(s, F.element_at(weights, g), lambda x, y: x + y))
    best = known.withColumn("z", F.when(F.col("line").isNotNull(), z)).withColumn("top", F.array_max("z"))
    best = best.withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top"))))
    best = best.withColumn("c", (F.array_position("z", F.col("top")) - 1).cast("int"))
    named = F.col("line").isNotNull() & (F.col("c") < k - 1) & (F.col("probability") >= m.cutoff)
    best = best.withColumn("c", F.when(named, F.col("c")))
    table_ = [{"c": c, "family": f, "t": m.templates[f], "each": m.each[f]} for c, f in enumerate(m.families[:-1])]
    out = best.join(F.broadcast(_literal(spark, table_, "c:int,family:string,t:array<string>,each:array<array<string>>")), "c", "left")
    inside = F.when(F.size("p") > 0, F.size(F.array_intersect("p", "t")) / F.size("p")).otherwise(0.0)
    covered = F.aggregate("each", F.lit(0.0), lambda s, e: F.greatest(s, F.when(F.size(e) > 0, F.size(F.array_intersect(e, F.col("p"))) / F.size(F.array_distinct(e))).otherwise(0.0)))
    out = out.withColumn("overlap", F.greatest(inside, covered))
    return out.select("_row", "doc_id", "line", "wide", "family", "probability", "overlap", (F.col("overlap") >= confirm).alias("confirmed"))


def scan(docs: DataFrame, m: LicenceModel | None = None) -> DataFrame:
    """One row per document: doc_id, families (sorted, comma-joined, null without any),
    n_paragraphs confirmed, n_unconfirmed (named by the model, not by a template).

    Lines count by themselves; a statement wrapped over lines counts once, if none of its lines
    was confirmed alone. Null and empty texts have none. Repeated rows are scanned on their own.
    """
    m = m or model()
    keyed = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", "text")
    one = F.struct(F.col("line").alias("at"), "family")
    alone, wide = ~F.col("wide"), F.col("wide")
    found = paragraphs(keyed, m).groupBy("_row").agg(
        F.first("doc_id").alias("doc_id"),
        F.sort_array(F.collect_list(F.when(alone & F.col("confirmed"), one))).alias("lines"),
        F.sort_array(F.collect_list(F.when(wide & F.col("confirmed"), one))).alias("wraps"),
        F.count_if(alone & F.col("family").isNotNull() & ~F.col("confirmed")).alias("n_unconfirmed"),
    )
    # Windows around a confirmed line say nothing new; of those that overlap one counts.
    new = F.filter("wraps", lambda x: ~F.exists("lines", lambda y: F.abs(x["at"] - y["at"]) <= 3))
    found = found.withColumn("wraps", new)
    first = F.filter("wraps", lambda x, i: (i == 0) | (x["at"] - F.get(F.col("wraps"), i - 1)["at"] > 3))
    names = F.array_sort(F.array_distinct(F.transform(F.concat("lines", "wraps"), lambda x: x["family"])))
    families = F.array_join(names, ",")
    return found.select("doc_id", F.when(families != "", families).alias("families"), (F.size("lines") + F.size(first)).cast("long").alias("n_paragraphs"), "n_unconfirmed")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))
