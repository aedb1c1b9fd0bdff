"""From raw documents to packed training sequences.

``STAGES`` are (name, function) in order; each function takes (spark, docs, sf_dir) and returns a DataFrame, which is
written and read again before the next one. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from flowloom.llm import language_id, mixing, near_dup, packing, quality_rules, tokens
from flowloom.session import ship_package, write_table

#: Below this mean probability no language of the network is a likely one; four languages share 1.
LEAST_LANGUAGE_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and those with proven cutoffs."""
    ship_package(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    counted = write_table(quality_rules.count_texts(docs), "text-counts")
    return quality_rules.keep_documents(docs, quality_rules.fit_cutoffs(counted, labels))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the network learns from them."""
    ship_package(spark)
    return language_id.keep_documents(docs, language_id.fit(docs), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest doc_id."""
    ship_package(spark)
    return near_dup.deduplicate(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the weights of their sources draw them; the budget is the tokens there are."""
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of at most 2048 tokens."""
    ship_package(spark)
    pieces = packing.cut_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), tokens.SPACED)
    return packing.pack(write_table(pieces, "pieces"))


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("mixing", mixture),
    ("packing", packed),
]
#: Learned thresholds and a trained network have no SQL; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
