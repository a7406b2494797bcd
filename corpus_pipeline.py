"""The corpus pipeline: documents that are good, distinct and free of long repeats, packed into windows.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm import packing, puquality, rules, simhash, suffixdedup
from siftwell.llm.common import numbered, staged, table
from siftwell.llm.queries import TOKENIZER


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. A null text counts as empty; equal rows share their fate."""
    return puquality.accepted(docs, puquality.fit(docs, table(spark, sf_dir, "labels")))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and empty texts among them; equal rows share their fate."""
    return rules.passing(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest doc_id stays.

    Of rows that repeat a doc_id each is a document of its own, in the order of their texts; rows
    without doc_id come after all others. Null and empty texts are one group.
    """
    docs, key = numbered(docs)
    groups = simhash.near_duplicates(docs.select(F.col(key).alias("doc_id"), "text"))
    first = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(key))
    return docs.join(first, key, "left_semi").drop(key)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose what an earlier text has in at least 100 bytes on end; null and empty texts stay as they are.

    Earlier: of smaller doc_id, and of rows that repeat one or have none, as in near_dedup.
    """
    out = suffixdedup.deduplicated(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the texts' ids in sequences of at most 4096. Rows that repeat a doc_id, or have none, count each.

    Workers share their executor's memory with what earlier stages have left, so they keep fewer words.
    """
    return packing.pack_documents(docs, public_tokenizers.path(TOKENIZER), word_store=300_000)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", pack),
]

#: Learning, components and packing are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
