"""The registered queries of this folder: each applies its operator to the whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, ship_package, write_table
from . import (
    code_search,
    decontamination,
    language_id,
    license_scan,
    mixing,
    near_dup,
    packing,
    periodic_runs,
    quality_rules,
    revisits,
    token_files,
    toxicity,
    whitening,
)
from .tokens import SPACED, WORDS


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_dup.find_components(_table(spark, folder, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    found = license_scan.scan(documents, license_scan.fit(documents))
    return found.withColumn("families", F.array_join("families", ","))


def op3_language_id(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    network = language_id.fit(documents.filter(~language_id.held_out()))
    found = language_id.identify(documents, network)
    return found.select("doc_id", F.coalesce(language_id.held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op4_token_files(spark: SparkSession, folder: str) -> DataFrame:
    out = scratch_path(spark, "token-files")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(_table(spark, folder, "documents"), out, tokenizer, WORDS)
    return token_files.read_documents(spark, out)


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    pieces = packing.cut_documents(_table(spark, folder, "documents"), tokenizer, SPACED)
    return packing.pack(write_table(pieces, "pieces")).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


def op6_mixing(spark: SparkSession, folder: str) -> DataFrame:
    draws, quotas = mixing.mixture(_table(spark, folder, "documents"))
    return draws.join(quotas.select("source_key", "quota"), "source_key").select(
        "doc_id", "source_key", "pass_no", "block_no", "n_tokens", "tokens_before", "quota"
    )


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = _table(spark, folder, "documents")
    machine = toxicity.fit(documents, _table(spark, folder, "labels").filter(~toxicity.held_out()))
    return toxicity.score(documents, machine).select(
        "doc_id",
        F.coalesce(toxicity.held_out(), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op8_revisits(spark: SparkSession, folder: str) -> DataFrame:
    return revisits.resolve(revisits.captures_of_pages(_table(spark, folder, "pages")))


def op9_code_search(spark: SparkSession, folder: str) -> DataFrame:
    vectors = _table(spark, folder, "embeddings")
    codes = write_table(vectors.select(F.col("vec_id").alias("id"), code_search.code("embedding").alias("code")), "codes")
    return code_search.search(codes, codes.filter("id % 100 = 0"))


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    counted = write_table(quality_rules.count_texts(_table(spark, folder, "documents")), "text-counts")
    cutoffs = quality_rules.fit_cutoffs(counted, _table(spark, folder, "labels"))
    return quality_rules.judge(counted, cutoffs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic_runs.find_periodic_runs(_table(spark, folder, "documents")).select(
        "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"
    )


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(_table(spark, folder, "embeddings"))


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontamination.find_contamination(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ","), 256).alias("items_sha256"),
        "contaminated",
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_token_files": op4_token_files,
    "op5_packing": op5_packing,
    "op6_mixing": op6_mixing,
    "op7_toxicity": op7_toxicity,
    "op8_revisits": op8_revisits,
    "op9_code_search": op9_code_search,
    "op10_quality_rules": op10_quality_rules,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_whitening": op12_whitening,
    "op13_decontamination": op13_decontamination,
}
