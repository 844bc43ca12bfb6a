"""The corpus pipeline: five stages from the documents table to token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import bpe, jaccard, lines, mixing, quality
from marginalia.llm.common import documents, written
from marginalia.llm.queries import MIXTURE


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the certified cutoffs don't reject.

    Null and empty texts are judged as empty ones, a null lang is a stratum; a corpus without labels of both kinds stays whole.
    """
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line equals or nearly equals.

    Null and empty texts stay; rows that repeat id and text are cut alike; without an id a row comes first.
    """
    return lines.dedupe_lines(docs)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates. The least id stays; rows without an id and texts without a word are in no group."""
    return jaccard.keep_one_per_group(docs)


def mixing_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document in as many copies as its source and language are to have; none is dropped. Null values count as ''; a null text has one token."""
    return mixing.mixed(docs, MIXTURE, floor=1.0)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, checked by decoding them. A null text has null tokens, an empty one none; rows without an id are encoded, too."""
    return bpe.encode(docs, verify=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("mixing", mixing_to_targets),
    ("bpe", bpe_encoding),
]
#: Chosen-path joins, Newton iterations and merge rounds are beyond SQL; tests hold run() against its operators one by one, and those against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, each stage over all that the one before it kept."""
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, name)
    return docs
