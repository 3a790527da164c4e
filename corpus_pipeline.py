"""A corpus from raw documents to shuffled shards.

Each stage gets the documents that the one before it kept and returns documents with the same
columns; the last one adds shard and slot.

Defined cases, in every stage: null and empty texts count as empty, are never near duplicates or
contaminated, and have no words to mix; the classifier and the mix decide whether they stay. Very
long texts are read whole. Rows with null ids pass like any other. Of repeated rows and near
duplicates one stays; equal hashes and scores are ordered by further fixed keys, so reruns agree. An
empty table gives an empty table. Extra columns pass, whatever their names; where one is named shard
or slot, the last stage's column gets underscores before its name.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from gleaner.llm import decontamination, mixing, ngram_join, quality, queries, sharding
from gleaner.llm.common import shared_dir, table
from gleaner.storage import remove, remove_at_end, temporary


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the byte-level classifier rejects."""
    return quality.accept(docs, queries.quality_model(spark, docs, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates."""
    return ngram_join.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a window of a benchmark item."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources reach their weights."""
    return mixing.mix(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shuffle the corpus into shards of equal row counts."""
    return sharding.external_shuffle(docs, queries.SHARDS)


STAGES = [
    ("quality classifier", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources", mix_sources),
    ("sharding", shard),
]

#: The classifier, the draws and the shuffle have no SQL; tests hold the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; each one's output is written as Parquet and read again.

    What a stage wrote goes when the next one has been written, the last table with the session.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        path = f"{base}/{name.replace(' ', '-')}"
        with temporary():
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    remove_at_end(spark, base)
    return STAGES[-1][1](spark, docs, sf_dir)
