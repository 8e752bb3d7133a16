"""A corpus pipeline: quality, rules, near-duplicates, benchmarks, tokens.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return
the columns of docs. run() writes each stage's result as Parquet into the shared folder
and reads it again as the next one's docs.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codeloom.llm import bpe, decontam, quality_classifier, quality_rules, simhash
from codeloom.llm.common import checkpoint_folder, table


def _tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on docs and the labels, scores 0.3 or more."""
    return quality_classifier.keep(docs, quality_classifier.train(docs, table(spark, sf_dir, "labels")))


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the cascade keep."""
    return quality_rules.keep(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each near-duplicate component."""
    return simhash.deduplicate(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item's words."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.round_trip(docs, _tokenizer())


STAGES = [
    ("quality classifier", quality_classifier_stage),
    ("quality rules", quality_rules_stage),
    ("near-duplicates", near_dedup_stage),
    ("benchmark decontamination", decontamination_stage),
    ("byte-level BPE", tokens_stage),
]

#: Fitted weights, fingerprints and merges have no SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
