"""The corpus pipeline: documents pass quality rules, near-dedup, decontamination, PII masking and packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read as the next one's docs.
All but the last return the columns of documents. What a stage decides holds for all later ones.

Defined results: a null or blank text has no words and goes with the first stage; very long texts are read whole by each stage; of
rows that are near copies, repeat each other or share an id and a text one stays, that of the least id (a row with a null id only
where no other is in its group); extra columns, whatever their names, are carried to the last stage, which returns the columns of
packing; empty tables give no rows, and a stage whose side table (labels, benchmark) is empty keeps all that its fixed rules keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kinetia.llm import decontaminate, packing, pii, quality_rules, simhash
from kinetia.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base test or the learned decision list rejects go."""
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least doc_id stays, one row whatever repeats."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind in brackets."""
    return pii.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, as pieces of token sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_dedup),
    ("decontamination", decontamination),
    ("pii", private_data),
    ("packing", pack),
]

#: Learned rules, fingerprints, the latent space and the tokenizer are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
