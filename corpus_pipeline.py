"""A corpus pipeline: ``documents`` to training tokens.

Five stages, each a function (spark, docs, sf_dir) -> DataFrame that works on all
rows the stage before kept.  Their results are written as Parquet and read again.

1. quality_rules: texts that the base rules or the certified cutoffs reject go.
2. exact_dedup: of equal texts the row with the largest id stays.
3. near_dedup: of each class of near duplicates the row with the smallest id stays.
4. mix: sources mixed to their targets; one row per pass that takes a document
   (a document can come twice), sorted by the curriculum's position.
5. byte_bpe: token ids of each row, with digests of the ids and of the bytes
   they decode to.

Rows with null text fail the base rules.  Empty inputs give empty outputs.  Extra
columns of ``documents`` are carried through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm import bytebpe, dartminhash, exact_dedup, mixing, quality
from tablewright.llm.common import documents, staged


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return dartminhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.curriculum(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bytebpe.encode_documents(docs)


STAGES = [("quality_rules", quality_rules), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies),
          ("mix", mix_sources), ("byte_bpe", encode)]

#: Certified cutoffs and byte-level merges are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
