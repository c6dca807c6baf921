"""From raw documents to shards: five stages, each written before the next one reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import decontam, gam, minhash, mixing, sharding
from quillspark.llm.common import materialize, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier accepts; a null or empty text is scored as one without
    words. Trained on at most ``gam.SAMPLE_ROWS`` labelled rows of these documents."""
    return gam.keep_good(docs, gam.train(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near duplicates: five-word shingles,
    similarity 0.8. Rows without words stay; rows of one id are judged by their own texts."""
    return minhash.one_of_each(docs, k=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a passage of the benchmark; those without text stay."""
    return decontam.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens follow the target marginals of source, language and topic; null
    sources and languages are values of their own, rows without words share their cell's fate."""
    return mixing.sample(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Balanced contiguous shards: doc_id, size, text_crc32, law, shard, slot, grown_shard. A
    null text has size 8; rows with equal ids stand side by side."""
    return sharding.shard_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shards", shards)]
ORACLE_SQL = None  # a trained classifier and hashing: tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written before the next one reads it.
    Columns beyond doc_id, text, source and lang pass through, whatever their names."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
