"""Watching a folder: new versions of documents are read again and their results replaced.

The file source sees new files, not edits in place, so a version of a document is a file of
its own, ``name@version.ext``; the latest version of each batch counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def versions(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """A stream of (doc_id, version, text)."""
    files = spark.readStream.option("wholetext", True).option("pathGlobFilter", glob).format("text").load(path)
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    got = files.select(F.regexp_extract(name, r"^(.*?)(?:@(\d+))?(?:\.[^.]*)?$", 1).alias("doc_id"), F.coalesce(F.expr(r"try_cast(regexp_extract(element_at(split(_metadata.file_path, '/'), -1), '@(\\d+)', 1) as bigint)"), F.lit(0)).alias("version"), F.regexp_replace("value", "^\ufeff", "").alias("text"))
    return got


def latest(batch: DataFrame) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.desc("version"))
    return batch.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def watch(stream: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, trigger: dict | None = None):
    """Start: each batch's documents are processed and stored below ``out`` by batch; a batch
    that fails is retried by the engine, as nothing of it was committed. ``current`` reads the
    latest result of each document."""

    def each(batch: DataFrame, number: int) -> None:
        docs = latest(batch)
        versions_ = docs.select("doc_id", "version")
        result = process(docs.select("doc_id", "text")).join(versions_, "doc_id", "right").withColumn("batch", F.lit(number))
        result.write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def current(spark: SparkSession, out: str) -> DataFrame:
    """The rows of each document's latest version; a document whose latest version gave no
    rows has one row with nulls, so that earlier rows don't come back."""
    rows = spark.read.parquet(f"{out}/batch=*")
    newest = rows.groupBy("doc_id").agg(F.max(F.struct("version", "batch")).alias("n"))
    return rows.join(newest, "doc_id").where("version = n.version and batch = n.batch").drop("n")
