"""A corpus pipeline over the table `documents`: each stage reads what the one before wrote.

Documents in no learned language go; of near copies one stays; documents with benchmark passages go; sources are
mixed to target weights (rows may go, or come twice); the rest is dealt into shards of near equal bytes.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from waymark.llm import decontaminate, language_id, mixing, ngram_join, sharding
from waymark.llm.common import shared_dir, table

#: A mixing stage takes words; SQL can't express language ID and the n-gram join, so the stages are tested against brute force.
ORACLE_SQL = None


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in a language that the labelled rows teach."""
    return language_id.recognised(docs, language_id.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id."""
    return ngram_join.one_of_each(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without benchmark passages."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixture(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows with their shard, slot and size."""
    return sharding.sharded(docs)


STAGES = [
    ("language_id", languages),
    ("ngram_jaccard_join", near_copies),
    ("decontamination", benchmark),
    ("mixing", mix),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/waymark/stage-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
