"""Mixing sources to target weights by iterative proportional fitting (op 9).

Documents are counted into cells of (source, language, topic); raking finds one factor for
each source, language and topic such that the cells' token weights meet all three target
marginals, with no probability above 1. A document of a cell is then taken with the cell's
calibrated probability, decided by a hash of its id, so that the sample is the same in every run.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.skew import join_one
from .common import materialize, table

MARGINS = ("source", "lang", "topic")
#: Cells that the driver rakes in memory; beyond this many the same steps run as joins.
DRIVER_CELLS = 200_000
_WORD = r"[^ \t\n\x0B\f\r]+"


@dataclass(frozen=True)
class MixTarget:
    """``shares`` gives wanted shares by margin and value; a margin without them gets its
    measured shares to the power ``temper`` (below 1: flatter). ``budget`` is the part of all
    tokens to take."""

    shares: dict = field(default_factory=dict)
    temper: dict = field(default_factory=lambda: {"source": 0.7, "lang": 0.8, "topic": 0.9})
    budget: float = 0.7
    rounds: int = 200
    tolerance: float = 1e-6
    seed: int = 9


def topic() -> Column:
    """A coarse topic by what a text mentions; the first that fits."""
    t = F.col("text")
    return (
        F.when(t.rlike("(?:[Ll]icen[cs]e|[Cc]opyright|[Rr]ights reserved)"), "legal")
        .when(t.contains("@") | t.contains("://"), "contact")
        .when(t.rlike("[0-9]{3}"), "data")
        .otherwise("prose")
    )


def described(docs: DataFrame) -> DataFrame:
    """doc_id, source, lang (empty for null), topic and tokens (words) of each row."""
    return docs.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic().alias("topic"), F.coalesce(F.expr("regexp_count(text, '" + _WORD.replace("\\", "\\\\") + "')"), F.lit(0)).cast("long").alias("tokens"))


def targets(measured: dict[str, float], margin: str, want: MixTarget) -> dict[str, float]:
    """Shares that sum to 1 over the values that have tokens."""
    asked = want.shares.get(margin)
    raw = {k: (asked.get(k, 0.0) if asked else v ** want.temper.get(margin, 1.0)) for k, v in measured.items() if v > 0}
    total = sum(raw.values())
    if not total:  # nothing wanted is there: leave the margin as it is
        raw, total = {k: v for k, v in measured.items() if v > 0}, sum(v for v in measured.values() if v > 0)
    return {k: v / total for k, v in raw.items()} if total else {}


def rake(cells: list[tuple[str, str, str, int]], want: MixTarget) -> dict[tuple[str, str, str], float]:
    """Probability of each cell (source, lang, topic, tokens).

    Each step gives one margin its wanted tokens, with probabilities of 1 at most: the cells of a
    value that reach 1 are taken whole and its others share what is left, so the cap is part of
    the fit and not put on after it. A value with fewer tokens than wanted is taken whole. Steps
    go round the margins until none is off by more than ``tolerance`` of the budget.
    """
    if not cells:
        return {}
    tokens = np.array([c[3] for c in cells], dtype=float)
    if not tokens.sum():
        return {tuple(c[:3]): min(1.0, want.budget) for c in cells}
    share = tokens / tokens.sum()
    values = [sorted({c[i] for c in cells}) for i in range(3)]
    at = [np.array([{v: k for k, v in enumerate(values[i])}[c[i]] for c in cells]) for i in range(3)]
    goals = []
    for i, m in enumerate(MARGINS):
        t = targets(dict(zip(values[i], np.bincount(at[i], share, len(values[i])))), m, want)
        goals.append(np.array([t.get(v, 0.0) for v in values[i]]) * min(1.0, want.budget))
    factor = np.full(len(cells), min(1.0, want.budget))
    for _ in range(want.rounds):
        worst = 0.0
        for i in range(3):
            n, capped = len(values[i]), np.zeros(len(cells), bool)
            taken = np.bincount(at[i], share * np.minimum(1, factor), n)
            worst = max(worst, float(np.abs(taken - goals[i]).max()))
            while True:  # the capped set grows, so this ends
                left = goals[i] - np.bincount(at[i], share * capped, n)
                free = np.bincount(at[i], np.where(capped, 0, share * factor), n)
                scale = np.where(free > 0, np.maximum(left, 0) / np.where(free > 0, free, 1), 1.0)
                more = ~capped & (share > 0) & (factor * scale[at[i]] > 1)
                if not more.any():
                    break
                capped |= more
            factor = np.where(capped, 1.0, factor * scale[at[i]])
        if worst <= want.tolerance * want.budget:
            break
    return dict(zip((tuple(c[:3]) for c in cells), np.minimum(1.0, factor).tolist()))


def _rake_tables(cells: DataFrame, want: MixTarget) -> DataFrame:
    """``rake`` as joins and sums, for cells that don't fit the driver; each step is written."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return cells.select(*MARGINS, F.lit(min(1.0, want.budget)).alias("probability"))
    budget = min(1.0, want.budget)
    now = materialize(cells.withColumn("w", F.col("tokens") / F.lit(float(total))).withColumn("factor", F.lit(budget)), "cells")
    goal = {}
    for m in MARGINS:
        have = now.groupBy(m).agg(F.sum("w").alias("have"))
        if asked := want.shares.get(m):
            raw = have.withColumn("raw", F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in asked.items() for x in kv]), F.col(m)), F.lit(0.0)))
        else:
            raw = have.withColumn("raw", F.when(F.col("have") > 0, F.pow("have", F.lit(want.temper.get(m, 1.0)))).otherwise(0.0))
        raw = raw.withColumn("raw", F.when(F.col("have") > 0, F.col("raw")).otherwise(0.0))
        s = raw.agg(F.sum("raw")).first()[0]
        if not s:  # nothing wanted is there: leave the margin as it is
            raw, s = raw.withColumn("raw", F.col("have")), 1.0
        goal[m] = materialize(raw.select(m, (F.col("raw") / s * budget).alias("goal")), "goal")
    for _ in range(want.rounds):
        worst = 0.0
        for m in MARGINS:
            off = now.groupBy(m).agg(F.sum(F.col("w") * F.least(F.lit(1.0), "factor")).alias("have")).join(goal[m], m)
            worst = max(worst, off.agg(F.max(F.abs(F.col("have") - F.col("goal")))).first()[0])
            now = now.withColumn("capped", F.lit(False))
            while True:
                sums = now.groupBy(m).agg(F.sum(F.when(F.col("capped"), F.col("w")).otherwise(0.0)).alias("whole"), F.sum(F.when(F.col("capped"), 0.0).otherwise(F.col("w") * F.col("factor"))).alias("free")).join(goal[m], m)
                scale = sums.select(m, F.when(F.col("free") > 0, F.greatest(F.lit(0.0), F.col("goal") - F.col("whole")) / F.col("free")).otherwise(1.0).alias("scale"))
                step = join_one(now, scale, [m]).withColumn("more", ~F.col("capped") & (F.col("w") > 0) & (F.col("factor") * F.col("scale") > 1))
                step = materialize(step, "cells")
                if not step.where("more").limit(1).count():
                    break
                now = step.withColumn("capped", F.col("capped") | F.col("more")).drop("more", "scale")
            now = step.withColumn("factor", F.when(F.col("capped"), 1.0).otherwise(F.col("factor") * F.col("scale"))).drop("capped", "more", "scale")
        if worst <= want.tolerance * want.budget:
            break
    return now.select(*MARGINS, F.least(F.lit(1.0), "factor").alias("probability"))


def probabilities(rows: DataFrame, want: MixTarget = MixTarget(), driver_cells: int = DRIVER_CELLS) -> tuple[DataFrame, bool]:
    """(source, lang, topic, probability) of every cell, and whether it was counted small."""
    spark = rows.sparkSession
    cells = materialize(rows.groupBy(*MARGINS).agg(F.sum("tokens").alias("tokens")), "cells")
    if cells.limit(driver_cells + 1).count() > driver_cells:
        return _rake_tables(cells, want), False
    found = rake(sorted((r["source"], r["lang"], r["topic"], r["tokens"]) for r in cells.toLocalIterator()), want)
    return spark.createDataFrame([(*k, p) for k, p in found.items()], "source string, lang string, topic string, probability double"), True


def margins(mixed: DataFrame, want: MixTarget = MixTarget()) -> DataFrame:
    """(margin, value, wanted, expected) of ``mix``: the wanted and the expected part of the
    tokens taken, for each value of each margin; they differ where a value has too few tokens."""
    spark = mixed.sparkSession
    out = None
    for m in MARGINS:
        got = mixed.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("probability")).alias("e"))
        shares = want.shares.get(m)
        raw = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("value")), F.lit(0.0)) if shares else F.pow(F.col("t") / F.col("all"), F.lit(want.temper.get(m, 1.0)))
        every = Window.partitionBy()  # one row a value of the margin
        got = got.where("t > 0").withColumn("all", F.sum("t").over(every)).withColumn("raw", raw)
        got = got.withColumn("raw", F.when(F.sum("raw").over(every) > 0, F.col("raw")).otherwise(F.col("t")))
        part = got.select(F.lit(m).alias("margin"), "value", (F.col("raw") / F.sum("raw").over(every)).alias("wanted"), (F.col("e") / F.sum("e").over(every)).alias("expected"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "margin string, value string, wanted double, expected double")


def draw(want: MixTarget) -> Column:
    """A number in [0, 1) for each doc_id, the same in every run."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(want.seed)), 11) / F.lit(float(1 << 53))


def mix(rows: DataFrame, want: MixTarget = MixTarget(), driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """``rows`` (with source, lang, topic, tokens and doc_id) plus probability and kept, which
    take the place of columns of these names.

    Empty input gives no rows; rows without tokens get the probability of their cell. Rows of
    one doc_id (null included) have the same fate within a cell.
    """
    rows = rows.drop("probability", "kept")
    cells, small = probabilities(rows, want, driver_cells)
    out = rows.join(F.broadcast(cells), list(MARGINS)) if small else join_one(rows, cells, list(MARGINS))
    return out.withColumn("kept", draw(want) < F.col("probability"))


def sample(docs: DataFrame, want: MixTarget = MixTarget(), driver_cells: int = DRIVER_CELLS) -> DataFrame:
    """The sampled rows of ``docs`` with all their columns, whatever the names of the others.
    Cells of a counted number are broadcast, so texts aren't shuffled; null sources and
    languages are a value of their own; rows of one doc_id in one cell share their fate."""
    cells, small = probabilities(described(docs), want, driver_cells)
    inside = F.struct(*docs.columns).alias("row")
    keyed = docs.select(inside, F.coalesce("source", F.lit("")).alias("source"), F.coalesce("lang", F.lit("")).alias("lang"), topic().alias("topic"), draw(want).alias("at"))
    out = keyed.join(F.broadcast(cells), list(MARGINS)) if small else join_one(keyed, cells, list(MARGINS))
    return out.where("at < probability").select("row.*")


def mixed_documents(docs: DataFrame, want: MixTarget = MixTarget()) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, tokens, probability, kept."""
    return mix(materialize(described(docs), "described"), want).select("doc_id", "source", "lang", "topic", "tokens", "probability", "kept")


def op9_raking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_documents(table(spark, sf_dir, "documents"))
