"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage
before it kept; what it returns is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents, and any
others that docs has, as they are.

Defined results, of every stage: an empty table gives an empty one; no row is
lost for a null in any column.

* quality: null and empty texts are scored as the empty text; rows with a null
  id are scored like others; of repeated rows all stay or all go; without
  labels of both kinds all rows stay.
* near_dedup: documents without words have no near duplicates, and stay; of
  rows that share an id one stays; rows with a null id stay.
* secrets: a null text stays null; ``n_chars`` follows a text that is changed.
* packing: a null or empty text is its end token alone; repeated rows are packed
  each; a null id stays null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import minhash, packing, quality, secrets
from factloom.plans.scratch import Scratch


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the ranking learned from the labels accepts, under its score's quantile those it rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates on five-word shingles."""
    return minhash.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret span replaced by a mark of its kind."""
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens, with their token ids.

    The workers of the stages before are still there, so that this one keeps less at hand.
    """
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), store=packing.LEAN).withColumnRenamed("id", "doc_id")


STAGES = [("quality", good_quality), ("near_dedup", near_dedup), ("secrets", without_secrets), ("packing", packed)]

#: SQL has no logistic fit and no tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
