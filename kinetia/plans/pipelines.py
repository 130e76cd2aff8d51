"""The five older pipelines by name, run side by side over one table of detections.

A pipeline is a way to get (y, v) from a target's detections; how repetitions are found in them is the same for all. The table is read once: it is persisted on the executors' disks
(lost parts are computed again from it), dealt by video. A video's rows then stay together in each pipeline, up to its repetitions: signals are neither stored nor, but for what a
filter in Python returns, shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinetia.operators import folds, metrics, peaks, splines, windows


@dataclass(frozen=True)
class Setup:
    fps: float = 30.0
    scale: float = 0.002  #: metres a pixel
    reach: float = 400.0  #: pixels that a target may be off its anchor
    lost_s: float = 0.5  #: a target that is lost for longer ends what it was in
    least_rows: int = 30


def speed(df: DataFrame, setup: Setup) -> DataFrame:
    """v: upward metres a second, from y in pixels downwards."""
    return windows.gradient(df, "video_id", "idx", "y").withColumn("v", -F.col("gradient") * setup.fps * setup.scale).drop("gradient")


def smoothed(df: DataFrame, column: str, window: int, degree: int) -> DataFrame:
    return peaks.savgol(df, "video_id", "idx", column, window, degree, 0, "_s").withColumn(column, F.col("_s")).drop("_s")


def dealt(rows: DataFrame) -> DataFrame:
    """rows by video, in as many parts as the session's shuffles have. With a number Spark keeps them so, and joins by video find their other side's rows there; parts that it has
    put together would be dealt anew for a join."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video_id")


def filled(points: DataFrame) -> DataFrame:
    """points with y, their cy: gaps on the line between their neighbours, edges held."""
    return windows.interpolate(points, "video_id", "idx", "cy").withColumnRenamed("cy_filled", "y")


def heights(points: DataFrame) -> DataFrame:
    return points.select("video_id", "idx", "y")


def baseline_sg(points: DataFrame, setup: Setup) -> DataFrame:
    return smoothed(speed(heights(points), setup), "v", 15, 3)


def kalman_sg(points: DataFrame, setup: Setup) -> DataFrame:
    v = folds.kalman_scalar(speed(heights(points), setup), "video_id", "idx", "v", keep="y").withColumnRenamed("filtered", "v")
    return smoothed(v, "v", 11, 2)


def spline(points: DataFrame, setup: Setup, degree: int, noise: float) -> DataFrame:
    fit = splines.smoothing_spline(heights(points).withColumn("_t", F.col("idx") / setup.fps), "video_id", "_t", "y", degree, noise, null_keys=False)
    return fit.select("video_id", "idx", "y", (-F.col("slope") * setup.scale).alias("v"))


def subpixel_spline(points: DataFrame, setup: Setup) -> DataFrame:
    return spline(points, setup, 3, 0.5)


def global_smoothing(points: DataFrame, setup: Setup) -> DataFrame:
    return spline(points, setup, 4, 0.2)


def associated(points: DataFrame, setup: Setup) -> DataFrame:
    return folds.associate(points, "video_id", "idx", setup.reach, timeout_frames=int(setup.lost_s * setup.fps))


def associator(points: DataFrame, setup: Setup) -> DataFrame:
    """The target's height, held while it is lost; smoothed twice, as its detections are before anything is made of them."""
    held = associated(points, setup).select("video_id", "idx", F.when(F.col("valid"), F.col("cy")).alias("cy"))
    even = heights(filled(held))
    for _ in range(2):
        even = smoothed(windows.median3(even, "video_id", "idx", "y").select("video_id", "idx", F.col("median3").alias("y")), "y", 5, 2)
    return smoothed(speed(even, setup), "v", 9, 2)


#: from points that are filled
PIPELINES: dict[str, Callable[[DataFrame, Setup], DataFrame]] = {
    "baseline_sg": baseline_sg,
    "subpixel_spline": subpixel_spline,
    "kalman_sg": kalman_sg,
    "global_smoothing": global_smoothing,
    "associator": associator,
}


def known(pipelines: tuple[str, ...]) -> list[str]:
    unknown = set(pipelines) - set(PIPELINES)
    if unknown or not pipelines:
        raise ValueError(f"no such pipelines: {sorted(unknown)}")
    return list(dict.fromkeys(pipelines))


def signals(points: DataFrame, setup: Setup = Setup(), pipelines: tuple[str, ...] = tuple(PIPELINES)) -> DataFrame:
    """(pipeline, video_id, idx, y, v) of each pipeline's signal."""
    parts = [PIPELINES[name](filled(points), setup).select(F.lit(name).alias("pipeline"), "video_id", "idx", "y", "v") for name in known(pipelines)]
    return reduce(DataFrame.unionByName, parts)


def run(points: DataFrame, setup: Setup = Setup(), pipelines: tuple[str, ...] = tuple(PIPELINES)) -> DataFrame:
    """(pipeline, video_id, start, end, duration_s, rom_cm, mcv, pv): repetitions of each (pipeline, video). points: (video_id, idx, cx, cy), idx from 0 without gaps, pixels, null where
    nothing was found; dealt by video they are not shuffled as they are. Videos of fewer than least_rows rows or without a detection, and rows with a null video_id, have none.
    Repetitions of the associator that touch a loss longer than lost_s, from which the target came back, are dropped. points, filled, stay persisted on disk until the caller
    unpersists them (spark.catalog.clearCache())."""
    names = known(pipelines)
    points = filled(points.where("video_id is not null").select("video_id", "idx", "cx", "cy"))
    points.persist(StorageLevel.DISK_ONLY)
    parts = []
    for name in names:
        rows = PIPELINES[name](points, setup).where("y is not null and v is not null")
        found = peaks.peak_first(rows, "video_id", "idx", "y", "v", setup.fps, setup.scale, setup.least_rows)
        if name == "associator":
            last = points.groupBy("video_id").agg(F.max("idx").alias("last"))
            lost = windows.runs(associated(points, setup), "video_id", "idx", F.col("state") == "LOST").where(F.col("n") > int(setup.lost_s * setup.fps))
            lost = lost.join(last, "video_id").where("end < last").select(F.col("video_id").alias("_video"), F.col("start").alias("_start"), F.col("end").alias("_end"))
            found = found.join(lost, (F.col("video_id") == F.col("_video")) & (F.col("start") <= F.col("_end")) & (F.col("end") >= F.col("_start")), "left_anti")
        parts.append(found.select(F.lit(name).alias("pipeline"), *found.columns))
    return reduce(DataFrame.unionByName, parts)


def compare(reps: DataFrame, truth: DataFrame) -> DataFrame:
    """Agreement by (pipeline, video_id) of mean speeds with truth (video_id, pos, gt), paired in order and cut at the shorter."""
    own = Window.partitionBy("pipeline", "video_id").orderBy("start")
    pred = reps.select("pipeline", "video_id", (F.row_number().over(own) - 1).alias("pos"), F.col("mcv").alias("pred"))
    return metrics.agreement(pred.join(truth, ["video_id", "pos"]), "pipeline", "video_id")


def ranking(reps: DataFrame, truth: DataFrame) -> DataFrame:
    """One row a pipeline, over the pairs of all videos, with best: it has the least rmse (of equals the first by name). Pipelines are few."""
    own = Window.partitionBy("pipeline", "video_id").orderBy("start")
    pred = reps.select("pipeline", "video_id", (F.row_number().over(own) - 1).alias("pos"), F.col("mcv").alias("pred"))
    table = metrics.agreement(pred.join(truth, ["video_id", "pos"]), "pipeline")
    least = table.agg(F.min_by("pipeline", F.struct("rmse", "pipeline")).alias("_best"))
    return table.crossJoin(F.broadcast(least)).withColumn("best", F.col("pipeline") == F.col("_best")).drop("_best")  # one row
