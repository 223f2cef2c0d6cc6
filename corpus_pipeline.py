"""From raw documents to a tokenized training mix: five stages, each written as Parquet and read as the next one's input.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of `documents`, the last adds `pieces`.
Null texts count as empty throughout. The quality classifier keeps documents without labels by their score alone; of
near-duplicates the least id stays; passages go from all documents but the earliest; the mix repeats or leaves out
blocks of words so that sources meet their targets, and a document that is taken twice is in it twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from meterline.llm import chaining, cotraining, mixing, pieces, simhash
from meterline.llm.common import load, stored


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cotraining.kept(docs, load(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.representatives(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return chaining.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.taken_texts(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.with_pieces(docs)


STAGES = [
    ("quality_classifier", classify_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
