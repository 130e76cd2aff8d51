"""Writers of results. Rounding is done here only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items() if c in df.columns})


def result_json(reps: DataFrame, path: str) -> None:
    """One JSON row for each video with its repetitions in order. Repetitions of a video are few."""
    fields = ["start_idx", "end_idx", "start_time", "end_time", "duration_s", "rom_m", "mcv_mps", "pcv_mps"]
    df = rounded(reps, {"duration_s": 3, "rom_m": 4, "mcv_mps": 3, "pcv_mps": 3})
    df.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("reps")).withColumn("status", F.when(F.size("reps") > 0, "OK").otherwise("NO_CLEAN_SEGMENT")).write.json(path)


def trajectory_csv(points: DataFrame, path: str) -> None:
    rounded(points, {"t_s": 5, "y_m": 5, "v_mps": 5}).select("video_id", "idx", "t_s", "y_m", "v_mps").repartition("video_id").sortWithinPartitions("video_id", "idx").write.partitionBy("video_id").csv(path, header=True)


def manifest(points: DataFrame, revision: str | None = None, scales: DataFrame | None = None) -> DataFrame:
    """One row a video: numbers of points and of those without a position, the revision of the code, and, with scales (video_id, mpp, fps), these."""
    df = points.groupBy("video_id").agg(F.count("*").alias("n_traj"), F.count_if(F.col("y_m").isNull()).alias("n_nodet")).withColumn("git_sha", F.lit(revision).cast("string"))
    return df if scales is None else df.join(scales.select("video_id", "mpp", "fps"), "video_id", "left")


def table_json(df: DataFrame, path: str) -> None:
    """Coverage, benchmark, golden and calibration reports."""
    df.write.json(path)


def per_rep_csv(pairs: DataFrame, path: str, videos: DataFrame | None = None) -> None:
    """Pairs with their videos' columns, each file with the mark that spreadsheets look for in UTF-8."""
    df = pairs if videos is None else pairs.join(videos, "video_id", "left")
    first = df.columns[0]
    df.withColumnRenamed(first, "\ufeff" + first).write.csv(path, header=True)


def detection_json(frames: DataFrame, config: dict, path: str) -> None:
    """Raw detections (video_id, frame_idx, pts_s, candidates), one object a video, with the detector's settings. A video's frames are one row."""
    df = frames.groupBy("video_id").agg(F.sort_array(F.collect_list(F.struct("frame_idx", "pts_s", "candidates"))).alias("frames"))
    df.withColumn("config", F.create_map(*(F.lit(str(x)) for kv in sorted(config.items()) for x in kv))).write.json(path)


def markdown(report: DataFrame, most: int = 1000) -> str:
    """A report of a few rows as a table; more than most is refused, not cut."""
    rows = report.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(report.columns), line("---" for _ in report.columns), *map(line, rows)])


def as_strings(df: DataFrame) -> DataFrame:
    """All columns as strings, as the exchange format has them; what isn't a finite number is "null"."""
    text = lambda c, t: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), "null").otherwise(F.col(c).cast("string")) if t in ("double", "float") else F.col(c).cast("string")
    return df.select(*(F.coalesce(text(c, t), F.lit("null")).alias(c) for c, t in df.dtypes))


def bland_altman_points(pairs: DataFrame) -> DataFrame:
    """The data of a Bland-Altman plot: means and differences."""
    return pairs.select(((F.col("gt") + F.col("pred")) / 2).alias("mean"), (F.col("pred") - F.col("gt")).alias("diff"))
