"""From raw documents to packed training sequences, in five stages.

Quality rules, then near-duplicates, repeated passages, secrets, and packing: what is rejected is not
compared, what is compared away is not searched, and only what is left is tokenized. Each
stage takes (spark, docs, sf_dir), works on all rows its predecessor kept and is written as Parquet and read again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwise.llm import passages, quality_rules, secrets, simhash
from shelfwise.llm.common import table
from shelfwise.llm.queries import packed
from shelfwise.session import ensure_checkpoint_dir


def _sized(docs: DataFrame) -> DataFrame:
    """``n_chars`` again after a text was changed."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; trusted are those labelled as good."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.keep(docs, trusted, quality_rules.SMOOTH)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies: five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one_similar(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds; documents that hold nothing else go."""
    return _sized(passages.remove_repeats(docs))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret masked."""
    return _sized(secrets.redact(docs))


def into_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of a document stands in the training sequences."""
    return packed(docs)


STAGES = [
    ("quality_rules", good_quality),
    ("simhash_near_dedup", one_of_near_duplicates),
    ("substring_dedup", without_repeats),
    ("secret_scans", without_secrets),
    ("best_fit_packing", into_sequences),
]

#: SQL cannot express the hashes and the tokenizer; tests compare each stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
