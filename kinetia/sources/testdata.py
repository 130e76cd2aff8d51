"""The driver's tables seen as the engine's: events as frames, line items as boxes, orders as truth and predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """video_id, idx, t, y (null where the event is an error), kind, conf."""
    e = table(spark, d, "events")
    seconds = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)") / 1e6
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return e.select(F.col("user_id").alias("video_id"), idx.cast("long").alias("idx"), seconds.alias("t"), F.when(F.col("event_type") != "error", F.col("value") / 100).alias("y"), F.col("event_type").alias("kind"), (F.col("value") / 500).alias("conf"))


FRAMES = """f AS (SELECT user_id AS video_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS idx,
  (epoch_us(ts) - 1704067200000000) / 1e6 AS t, CASE WHEN event_type <> 'error' THEN value / 100 END AS y, event_type AS kind, value / 500 AS conf FROM events)"""


def boxes(spark: SparkSession, d: str, first: bool = False) -> DataFrame:
    """frame, pos (numbers from 0, line numbers repeat), cx, cy, w, h, conf. With first, only each frame's first box; the others are then dropped before rows are shuffled, as far
    as a task sees them together."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    li = table(spark, d, "lineitem").withColumn("_n", n)
    li, pos = li.where("_n = 1") if first else li, F.col("_n") - 1
    return li.select(F.col("l_orderkey").alias("frame"), pos.cast("long").alias("pos"), (F.col("l_partkey") % 200).cast("double").alias("cx"), (F.col("l_suppkey") % 100).cast("double").alias("cy"), (F.col("l_quantity") * 4).alias("w"), (F.col("l_extendedprice") / 1000).alias("h"), (F.col("l_discount") * 10).alias("conf"))


BOXES = """b AS (SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos, CAST(l_partkey % 200 AS DOUBLE) AS cx, CAST(l_suppkey % 100 AS DOUBLE) AS cy,
  l_quantity * 4 AS w, l_extendedprice / 1000 AS h, l_discount * 10 AS conf FROM lineitem)"""


def exact(column: str) -> F.Column:
    return F.col(column).cast("decimal(12,2)")


def truth(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("video_id"), pos.alias("pos"), (F.col("o_totalprice") / 1e5).alias("gt"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Sums of line items by order; orders that are pending have none, so counts differ."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum(exact("l_extendedprice") * (1 - exact("l_discount"))).cast("double").alias("x"))  # exact sums have no order
    o = table(spark, d, "orders").where("o_orderstatus != 'P'").join(li, F.col("l_orderkey") == F.col("o_orderkey"))
    pos = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    return o.select(F.col("o_custkey").alias("video_id"), pos.alias("pos"), (F.col("x") / 1e5).alias("pred"))


PAIRS = """g AS (SELECT o_custkey AS video_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, o_totalprice / 1e5 AS gt FROM orders),
l AS (SELECT l_orderkey, CAST(sum(CAST(l_extendedprice AS DECIMAL(12, 2)) * (1 - CAST(l_discount AS DECIMAL(12, 2)))) AS DOUBLE) AS x FROM lineitem GROUP BY 1),
p AS (SELECT o_custkey AS video_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS pos, x / 1e5 AS pred FROM orders JOIN l ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P'),
pairs AS (SELECT video_id, g.pos, gt, pred FROM g JOIN p USING (video_id, pos))"""


def videos(spark: SparkSession, d: str) -> DataFrame:
    """video_id, status, bar_only and base_status (null: no baseline) of each customer."""
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(k.alias("video_id"), F.when(k % 5 == 0, "NO_PLATE_DETECTED").otherwise("OK").alias("status"), (k % 10 == 0).alias("bar_only"), F.when(k % 13 == 0, F.lit(None)).when(k % 35 == 0, "NO_CLEAN_SEGMENT").when(k % 5 == 0, "NO_PLATE_DETECTED").otherwise("OK").alias("base_status"))


VIDEOS = """vids AS (SELECT c_custkey AS video_id, CASE WHEN c_custkey % 5 = 0 THEN 'NO_PLATE_DETECTED' ELSE 'OK' END AS status, c_custkey % 10 = 0 AS bar_only,
  CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 35 = 0 THEN 'NO_CLEAN_SEGMENT' WHEN c_custkey % 5 = 0 THEN 'NO_PLATE_DETECTED' ELSE 'OK' END AS base_status FROM customer)"""


def shots(spark: SparkSession, d: str) -> DataFrame:
    """Boxes as those of 100 videos: video_id, frame_idx and the columns of boxes."""
    return boxes(spark, d).withColumn("video_id", F.col("frame") % 100).withColumn("frame_idx", F.floor(F.col("frame") / 100))


SHOTS = f"""{BOXES}, s AS (SELECT *, frame % 100 AS video_id, CAST(floor(frame / 100) AS BIGINT) AS frame_idx FROM b)"""
