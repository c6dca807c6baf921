"""Joins of many rows with one row a key, where one key may hold most of the many."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys above this part of all rows are split; so there can be no more of them than this.
PARTS = 1000
#: Rows of one key that a task takes in any case.
LEAST = 500


def hot_keys(rows: DataFrame, keys: list[str], parts: int = PARTS, least: int = LEAST) -> DataFrame:
    """(keys, _copies) of the keys that hold more than ``1/parts`` of ``rows`` and more than
    ``least``: fewer than ``parts`` rows whatever the input, so they may be broadcast. Copies
    are as many as leave that part to each."""
    limit = max(least, rows.count() / parts)
    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
    return hot.select(*keys, F.ceil(F.col("_n") / limit).cast("int").alias("_copies"))


def join_one(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner", parts: int = PARTS, least: int = LEAST, hot: DataFrame | None = None) -> DataFrame:
    """``many.join(one, keys, how)`` for a ``one`` with at most one row a key: the rows of a
    hot key are dealt over copies of its one row. ``many`` is read three times, so it is
    a written table or cheap to make; null keys meet nothing and stay (inner joins drop them).
    ``hot`` may be given where the keys are counted anyway."""
    if hot is None:
        hot = hot_keys(many.where(" and ".join(f"`{k}` is not null" for k in keys)), keys, parts, least)
    hot = F.broadcast(hot)
    others = [c for c in many.columns if c not in keys]
    deal = F.when(F.col("_copies").isNotNull(), F.pmod(F.xxhash64(*others), F.col("_copies"))).otherwise(0)
    left = many.join(hot, keys, "left").withColumn("_salt", deal.cast("int")).drop("_copies")
    right = one.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_copies", F.lit(1)) - 1))).drop("_copies")
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
