"""Corpus pipeline: toxic documents go, near-duplicates go, contaminated documents go, sources are mixed, and rows are sharded."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from varistrata.llm import decontam, mixing, neardup, sharding, toxicity
from varistrata.llm.common import bounded_batches, delete_folder, shared_folder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go. Texts that are null or have no word stay; repeated rows stay or go together."""
    bounded_batches(spark)
    return toxicity.keep_clean(docs, toxicity.model(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (shingles of five words, similarity 0.8). Rows without key, and null, empty or blank texts, stay."""
    bounded_batches(spark)
    return neardup.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with an item of the benchmark go. Rows without key, and null or empty texts, stay."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """No document is lost: each is used once or more, a source twice at most. Null is a source; rows without tokens are used as often as their source, whole. Rows are written block by block, in the order of their places."""
    return mixing.mix(docs, mixing.fit(docs, repeat_limit=mixing.REPEAT_LIMIT))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows with `shard` and `grown_shard` (with one shard more); columns of those names are replaced. A null key is replaced by the text."""
    return sharding.with_shards(docs, [1.0] * sharding.SHARDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: Trained scores and sketches have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each but the last is written to the shared folder and read again. What a stage has read is deleted once its own rows are written."""
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        out.write.parquet(f"{folder}/{i}-{name}")
        docs = spark.read.parquet(f"{folder}/{i}-{name}")
        if before:
            delete_folder(spark, before)
        before = f"{folder}/{i}-{name}"
    return docs
