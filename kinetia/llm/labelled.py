"""The bounded sample of labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetia.llm.common import crc_mod, few


def held_out():
    return crc_mod(F.col("doc_id"), 3) == 1


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most so many labelled rows that aren't held out. Which ones goes by a hash of the id, half of the room to each label where both have enough.

    Rows with a null id or a label other than 0 and 1 are left out; ids that repeat in labels have the larger label, and ids that
    repeat in docs the first of their texts, in order of characters.
    """
    marks = labels.select("doc_id", F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    marks = marks.groupBy("doc_id").agg(F.max("label").alias("label"))
    marks = marks.withColumn("place", F.xxhash64("doc_id"))
    by = [few(marks.where(F.col("label") == k), rows // 2, "place", "doc_id").select("doc_id", "label") for k in (0, 1)]
    # at most `rows` pairs of numbers, so the broadcast is bounded
    held = docs.select("doc_id", "text").join(F.broadcast(by[0].union(by[1])), "doc_id")
    return held.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
