"""The engine's plans: detections to repetitions, and repetitions against the truth."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetia.operators import folds, matching, metrics


@dataclass(frozen=True)
class Params:
    exercise: str = "squat"
    diameter: float = 0.45
    calibrate_conf: float = 0.45
    track_conf: float = 0.40
    samples: int = 20
    every: int = 1  #: keyframe stride


def best_boxes(detections: DataFrame) -> DataFrame:
    """Each frame's candidate of the largest area, the first of equals."""
    c = F.transform("candidates", lambda x, i: F.struct((x["w"] * x["h"]).alias("area"), (-i).alias("i"), x["cx"].alias("cx"), x["cy"].alias("cy"), x["h"].alias("h"), x["conf"].alias("conf")))
    return detections.withColumn("b", F.array_max(c)).select("video_id", "frame_idx", "pts_s", F.col("b.cy").alias("cy"), F.col("b.h").alias("h"), F.col("b.conf").alias("conf"))


def calibrate(boxes: DataFrame, params: Params) -> DataFrame:
    """video_id, mpp, locked_at: the scale from the first samples, and the frame that locks it. Videos with too few have none."""
    held = boxes.where((F.col("conf") > params.calibrate_conf) & (F.col("h") > 10))
    n = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_idx"))
    lock = held.withColumn("_n", n).where(F.col("_n") == params.samples).select("video_id", F.col("frame_idx").alias("locked_at"))
    return metrics.scale_lock(held, "video_id", "frame_idx", "h", params.samples, params.diameter).join(lock, "video_id").select("video_id", "mpp", "cv", "locked_at")


def track(boxes: DataFrame, scale: DataFrame, params: Params) -> DataFrame:
    """The filtered trajectory (y up, metres) of the frames after the lock; frames without a trusted keyframe are predicted."""
    seen = (F.pmod("frame_idx", F.lit(params.every)) == 0) & (F.col("conf") > params.track_conf)
    points = boxes.join(scale, "video_id").where("frame_idx > locked_at").select("video_id", F.col("frame_idx").cast("long").alias("idx"), F.col("pts_s").alias("t"), F.when(seen, -F.col("cy") * F.col("mpp")).alias("z"))
    path = folds.physical_filter(points, "video_id", "idx", "t", "z")
    return path.join(points.select("video_id", "idx", "t"), ["video_id", "idx"])


def analyze(detections: DataFrame, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """(trajectory, repetitions) of detections. One key, video_id, is kept throughout."""
    boxes = best_boxes(detections)
    path = track(boxes, calibrate(boxes, params), params)
    return path, segment(path, params)


def segment(path: DataFrame, params: Params = Params()) -> DataFrame:
    """Repetitions of trajectories (video_id, idx, t, y, v); indices are places in them."""
    placed = matching.numbered(path, "video_id", "idx").withColumn("pos", F.col("pos").cast("long"))
    return folds.repetitions(placed, "video_id", "pos", params.exercise)


PAIRINGS = {"truncate": matching.pair_truncate, "equal_count": matching.pair_equal_count, "best": matching.pair_greedy}


def evaluate(pred: DataFrame, truth: DataFrame, pairing: str = "truncate", by_video: bool = False) -> DataFrame:
    """Agreement of (video_id, pos, pred) with (video_id, pos, gt)."""
    return metrics.agreement(PAIRINGS[pairing](truth, pred, "video_id"), *(["video_id"] if by_video else []))
