"""Connected components of a graph held in tables, by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.skew import hot_keys, join_one
from .common import materialize


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every end of ``edges`` (a, b); label is the least node it reaches.

    Every round hooks each node under its least neighbour, if that is smaller, follows these
    hooks to their roots (in as many steps as the depth has bits) and goes on with the graph
    of the roots. A root either has taken a neighbour in, or all its neighbours went to smaller
    roots, so that it goes itself in the next round: two rounds halve the nodes at least,
    whatever the graph. The centre of a star is a hot key, whose edges are dealt over copies of
    its row. Only one number, how many labels changed or edges are left, comes to
    the driver.
    """
    left = _halves(edges)
    rounds: list[DataFrame] = []
    while left.limit(1).count():
        both = left.union(left.select("b", "a"))
        roots = _followed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")))
        rounds.append(roots)
        ends = join_one(left, roots.select(F.col("node").alias("a"), F.col("label").alias("x")), ["a"])
        named = join_one(ends, roots.select(F.col("node").alias("b"), F.col("label").alias("y")), ["b"], hot=hot_keys(left, ["b"]))
        left = _halves(named.select(F.col("x").alias("a"), F.col("y").alias("b")))
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("label"))
    labels = rounds.pop()
    while rounds:  # backwards, as each round has far fewer nodes than the one before
        tops = labels.select(F.col("node").alias("label"), F.col("label").alias("top"))
        labels = materialize(join_one(rounds.pop(), tops, ["label"], "left").select("node", F.coalesce("top", "label").alias("label")), "labels")
    return labels


def _halves(edges: DataFrame) -> DataFrame:
    """Each edge once, from its smaller to its greater end."""
    return materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")


def _followed(hooks: DataFrame) -> DataFrame:
    """The root of every node of a forest whose roots are their own labels."""
    hooks = materialize(hooks, "labels")
    while True:
        up = hooks.select(F.col("node").alias("label"), F.col("label").alias("up"))
        step = materialize(join_one(hooks.select("node", "label"), up, ["label"]).select("node", F.col("up").alias("label"), (F.col("up") < F.col("label")).alias("changed")), "labels")
        hooks = step.select("node", "label")
        if step.where("changed").limit(1).count() == 0:
            return hooks
