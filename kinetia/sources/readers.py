"""Readers of the engine's files. All have explicit schemas, so no file is read twice to infer one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinetia import schemas


def stem(path) -> F.Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.mp4)?\.(?:csv|json|txt|mp4)$", 1)


def dataset_index(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of videos; one row for each true repetition: video_id, load_kg, hold_out, pos, gt."""
    rows = spark.read.schema(schemas.INDEX).json(path, multiLine=True)
    return rows.select("video_id", "load_kg", F.coalesce("hold_out", F.lit(False)).alias("hold_out"), F.posexplode("gt_reps_mcv").alias("pos", "gt")).where("gt > 0")


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """The wide CSV as video_id, load_kg, pos, gt; cells that aren't positive numbers are no repetitions."""
    wide = spark.read.schema(schemas.TRUTH).csv(path, header=True)
    reps = [f"rep{k}" for k in range(1, 9)]
    long = wide.unpivot(["filename", "load_kg"], reps, "rep", "cell").select(F.regexp_replace("filename", r"\.mp4$", "").alias("video_id"), "load_kg", F.substring("rep", 4, 2).cast("int").alias("rep"), F.expr("try_cast(cell AS double)").alias("gt")).where("gt > 0")
    from pyspark.sql import Window

    return long.withColumn("pos", F.row_number().over(Window.partitionBy("video_id").orderBy("rep")) - 1).drop("rep")


def trajectories(spark: SparkSession, path: str) -> DataFrame:
    """Trajectory CSVs, video_id from the file's name and pos, the place of each row in it, from its idx."""
    df = spark.read.schema(schemas.TRAJECTORY).csv(path, header=True).withColumn("video_id", stem(F.col("_metadata.file_path")))
    from pyspark.sql import Window

    return df.withColumn("pos", (F.col("idx") - F.min("idx").over(Window.partitionBy("video_id"))).cast("long"))


def results(spark: SparkSession, path: str) -> DataFrame:
    """Result JSONs, one row for each repetition (one with nulls for videos without any); numbers may be strings, and "null" is null."""
    df = spark.read.schema(schemas.RESULT_JSON).json(path, multiLine=True)
    number = lambda c: F.expr(f"try_cast({c} AS double)")
    rows = df.select(F.regexp_replace("video", r"\.mp4$", "").alias("video_id"), "status", number("fps").alias("fps"), number("mpp").alias("mpp"), F.posexplode_outer("reps").alias("pos", "r"))
    fields = [(x.split(":")[0], "bigint" if "idx" in x else "double") for x in schemas.REP_JSON.split(", ")]
    return rows.select("video_id", "status", "fps", "mpp", "pos", *(F.expr(f"try_cast(r.{n} AS {t})").alias(n) for n, t in fields))


def detections(spark: SparkSession, path: str) -> DataFrame:
    """Raw detection JSONs: video_id, frame_idx, pts_s, candidates."""
    frames = schemas.DETECTION.split("frame_idx")[1]
    schema = "video_id string, frames array<struct<frame_idx: int, pts_s: double, " + frames.split("pts_s double, ")[1].replace("candidates ", "candidates: ", 1) + ">>"
    return spark.read.schema(schema).json(path, multiLine=True).select("video_id", F.explode("frames").alias("f")).select("video_id", "f.*")


def intervals(spark: SparkSession, path: str) -> DataFrame:
    """A JSON map of videos to inclusive frame intervals: video_id, start, end."""
    text = spark.read.text(path, wholetext=True)
    parsed = text.select(F.explode(F.from_json("value", "map<string, array<array<int>>>")).alias("video_id", "spans"))
    return parsed.select("video_id", F.explode("spans").alias("s")).select("video_id", F.col("s")[0].alias("start"), F.col("s")[1].alias("end"))


def listing(spark: SparkSession, path: str, pattern: str = "*.mp4") -> DataFrame:
    """Files of a folder: path, video_id, length. Contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", stem(F.col("path")).alias("video_id"), "length")


def box_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label lines `class cx cy w h`, with whether all lie in 0..1."""
    parts = F.split(F.trim("value"), r"\s+")
    names = ("cx", "cy", "w", "h")
    df = spark.read.text(path).where("trim(value) != ''").select(stem(F.col("_metadata.file_path")).alias("frame"), parts[0].cast("int").alias("class"), *(F.try_element_at(parts, F.lit(k + 2)).try_cast("double").alias(n) for k, n in enumerate(names)))
    inside = F.lit(True)
    for n in names:
        inside = inside & F.coalesce(F.col(n).between(0, 1), F.lit(False))
    return df.withColumn("valid", inside)


def rep_pairs(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of a report; a report without any can't be calibrated from and fails."""
    df = spark.read.schema(schemas.REP_PAIRS).json(path, multiLine=True).select(F.explode("rep_pairs").alias("p")).select("p.*")
    if df.isEmpty():
        raise ValueError(f"no pairs in {path}")
    return df
