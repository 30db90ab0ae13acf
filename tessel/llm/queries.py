"""The queries of this subpackage and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontamination, fingerprints, language, lexical, licences, lm, near_duplicates, oracle, prefix_trie, secrets, sharding, suffix_dedup


#: The tokenizer file of op4; any byte-level BPE file of the tokenizers library can be given to bpe.encode().
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op1(_table(spark, sf_dir, "conversations"))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.op2(_table(spark, sf_dir, "documents"))


def op3_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.op3(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.op4(_table(spark, sf_dir, "documents"), VOCABULARY)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op5(_table(spark, sf_dir, "documents"))


def language_id_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.op5_pages(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "documents"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.op6(_table(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op7(_table(spark, sf_dir, "documents"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op8(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.op9(_table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op10(_table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.op11(_table(spark, sf_dir, "documents"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.op12(_table(spark, sf_dir, "conversations"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.op13(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_formatting,
        op2_near_duplicates,
        op3_document_fingerprints,
        op4_bpe,
        op5_language_id,
        language_id_of_pages,
        op6_licence_scan,
        op7_secret_scan,
        op8_benchmark_decontamination,
        op9_sharding,
        op10_lm_scoring,
        op11_suffix_dedup,
        op12_prefix_trie,
        op13_lexical_search,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op1_chat_formatting": oracle.CHAT,
    "op7_secret_scan": oracle.SECRETS,
    "op8_benchmark_decontamination": oracle.DECONTAMINATION,
    "op11_suffix_dedup": oracle.SUFFIXES,
    "op12_prefix_trie": oracle.TRIE,
    "op13_lexical_search": oracle.RANKED,
}
