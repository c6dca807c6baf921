"""Contiguous shards of equal bytes from global prefix sums (op 1, native).

The rows are range-partitioned once; each partition contributes one total, the running sum
of those few totals gives every partition its place in the global order, and a window inside
the partition gives every row its own. Cutting that line at equal targets needs no second
look at the data, no global sort in one task and no collected rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, table

N_SHARDS = 24
ROW_BYTES = 8


def balanced_shards(df: DataFrame, n_shards: int, size: Column, order_by: list[str], partitions: int | None = None) -> DataFrame:
    """``df`` plus ``size`` long, ``shard`` int and ``slot`` long.

    Rows stand on a line in the order of ``order_by`` (nulls first; rows equal in all of it
    keep the order of the input splits). A row goes to the shard in whose stretch of
    total/n_shards bytes its middle lies, so shards are contiguous and differ from the target
    by less than one row at each end; ``slot`` counts from 0 inside a shard without gaps.
    Empty input gives no rows; input columns called size, shard or slot are replaced.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    taken = [c for c in df.columns if c.lower() not in ("size", "shard", "slot", "_rid", "_pid")]
    rows = df.select(*taken, size.cast("long").alias("size")).withColumn("_rid", F.monotonically_increasing_id())
    placed = materialize(rows.repartitionByRange(n, *order_by, "_rid").withColumn("_pid", F.spark_partition_id()), "shards")
    # One row for each partition: the global order of at most a few hundred thousand totals.
    every = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_rows = Window.partitionBy()
    totals = placed.groupBy("_pid").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_count"))
    totals = totals.select(
        "_pid",
        (F.sum("_bytes").over(every) - F.col("_bytes")).alias("_before"),
        (F.sum("_count").over(every) - F.col("_count")).alias("_first"),
        F.sum("_bytes").over(all_rows).alias("_total"),
    )
    own = Window.partitionBy("_pid").orderBy(*order_by, "_rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = placed.select("*", F.sum("size").over(own).alias("_run"), F.row_number().over(own).cast("long").alias("_nth")).join(F.broadcast(totals), "_pid")
    twice = (F.col("_before") + F.col("_run")) * 2 - F.col("size")
    shard = F.when(F.col("_total") > 0, F.least(F.expr("0L + " + str(n_shards - 1)), F.floor(twice.cast("decimal(38,0)") * n_shards / (2 * F.col("_total")).cast("decimal(38,0)")).cast("long"))).otherwise(F.lit(0)).cast("int")
    line = line.select(*taken, "size", shard.alias("shard"), (F.col("_first") + F.col("_nth") - 1).alias("_row"))
    starts = line.groupBy("shard").agg(F.min("_row").alias("_start"))
    return line.join(F.broadcast(starts), "shard").select(*taken, "size", "shard", (F.col("_row") - F.col("_start")).alias("slot"))


def shard_documents(docs: DataFrame, n_shards: int = N_SHARDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    A null text counts as an empty one (size 8, checksum 0).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select("doc_id", F.crc32(text).alias("text_crc32"), (F.octet_length(text) + ROW_BYTES).alias("size"))
    out = balanced_shards(slim, n_shards, F.col("size"), ["doc_id", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
