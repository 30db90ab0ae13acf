"""A training-data pipeline over documents: each stage works on all that the one before it kept.

Cases, the same in all stages: null texts are empty and null ids, languages and sources are values of their own; empty texts and texts without
letters go in the first stage; very long texts are worked through whole, a slice of rows at a time; repeated rows are rows of one class, of which one
stays; of documents of equal text the least id stays, null first; an empty table gives an empty result with the columns of documents;
extra columns are kept by all stages but the last, also where a stage's own columns have their names, and left out by the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import arrow, bpe, decontamination, language, near_duplicates, secrets
from tessel.llm.queries import VOCABULARY
from tessel.sources.shared import keep

#: Bytes of an Arrow batch in the stages: an executor's memory beside its heap follows the batches of all its tasks, over all stages.
BATCH_BYTES = 2 << 20


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told, as they have no letters or too little evidence, go."""
    arrow.bound_batches(spark, BATCH_BYTES)
    return language.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    arrow.bound_batches(spark, BATCH_BYTES)
    return near_duplicates.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    arrow.bound_batches(spark, BATCH_BYTES)
    return decontamination.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live-looking credentials are replaced in the texts."""
    arrow.bound_batches(spark, BATCH_BYTES)
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The number of tokens, and digests of ids and of the text decoded from them, of each document that is left."""
    arrow.bound_batches(spark, BATCH_BYTES)
    return bpe.op4(docs, VOCABULARY)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("secret_scan", redact_secrets),
    ("bpe", tokenize),
]

#: Classes of near duplicates, ownership of secrets and byte-pair merges are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = keep(docs)
    return docs
