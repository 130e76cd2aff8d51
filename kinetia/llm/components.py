"""Connected components as Spark joins: alternating large-star and small-star steps.

Each step joins the links with one row for each node, so a node with very many links is only a skewed join side that
Spark may split; no group is gathered and no side is broadcast. Links are stored in the shared folder after each step, and
the last step's files are deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetia.llm.common import forget, stored


def _both(links: DataFrame) -> DataFrame:
    return links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the node's least neighbour, itself included."""
    both = _both(links)
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node is linked, with its smaller neighbours, to the least of these. links: u > v."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    moved = links.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(links: DataFrame) -> tuple:
    r = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return r["n"], r["h"]


def components(links: DataFrame, name: str = "links") -> DataFrame:
    """links: (u, v) of one ordered type. Returns (node, root): each linked node with the least node that it reaches."""
    links = links.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = stored(links, name)
    before = _state(links)
    while before[0]:
        large = stored(_large(links), name)
        old, links = links, stored(_small(large), name)
        forget(old), forget(large)
        after = _state(links)
        if after == before:
            break
        before = after
    found = links.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return found.union(found.select(F.col("root").alias("node"), "root").distinct())
