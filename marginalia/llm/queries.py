"""The corpus operators' queries over their whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import bpe, images, jaccard, lines, mixing, quality, sharding, substring, toxicity, urls
from marginalia.llm.common import documents

#: Token weights that the mixture aims at: sources flattened a little, languages a little more.
MIXTURE = {"source": 0.9, "lang": 0.85}


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_spans(documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    stems, ordinary = toxicity.learn_lexicon(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.toxic_documents(docs, stems=stems, ordinary=toxicity.ORDINARY.union(ordinary))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), urls.rules_table(spark))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(documents(spark, sf_dir), MIXTURE).select("doc_id", "tokens", "rate", "copies")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.repeated_lines(documents(spark, sf_dir)).select("doc_id", "line_no", "kept_doc_id", "kept_line_no")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(documents(spark, sf_dir), verify=True)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard_classes(documents(spark, sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return images.image_copies(images.render(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept").select("doc_id", "lang", "score", "threshold")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_substring_dedup, op2_toxicity, op3_url_filters, op4_sharding, op5_mixing, op6_line_dedup, op7_bpe, op8_ngram_jaccard_join, op9_media_columns, op10_quality_rules)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_substring_dedup": substring.ORACLE, "op3_url_filters": urls.ORACLE, "op6_line_dedup": lines.ORACLE}
