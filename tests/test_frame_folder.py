from pathlib import Path

import pytest
from pyspark.sql import functions as F

from kinetia.sources import frame_folder


def test_frames_are_written_by_split_and_found_again(spark, tmp_path):
    df = spark.range(40).select(F.when(F.col("id") % 5 == 0, "val").otherwise("train").alias("split"), F.format_string("v_%06d", "id").alias("name"), F.when(F.col("id") != 7, F.encode(F.col("id").cast("string"), "utf-8")).alias("image"), F.when(F.col("id") != 8, "0 0.5 0.5 0.1 0.1").alias("label"), F.lit(1).alias("other")).repartition(4)
    out = tmp_path / "set"
    frame_folder.write(df, str(out), ("plate", "bar"))
    assert len(list(out.glob("images/train/*.jpg"))) == 31 and len(list(out.glob("images/val/*.jpg"))) == 8 and len(list(out.glob("labels/*/*.txt"))) == 40
    assert (out / "images/val/v_000035.jpg").read_bytes() == b"35" and (out / "labels/train/v_000008.txt").read_text() == "" and not (out / "images/train/v_000007.jpg").exists()
    assert (out / "data.yaml").read_text().splitlines() == [f"path: {out}", "train: images/train  # 32", "val: images/val  # 8", "nc: 2", "names:", "  0: plate", "  1: bar"]
    assert [p.name for p in tmp_path.iterdir()] == ["set"]
    with pytest.raises(Exception, match="FileExists"):
        frame_folder.write(df, str(out))
    assert [p.name for p in tmp_path.iterdir()] == ["set"] and len(list(out.rglob("*.txt"))) == 40


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    rows = [("train", f"n{i}", b"x", "l") for i in range(30)] + [("train", "../out", b"x", "l")]
    df = spark.createDataFrame(rows, "split string, name string, image binary, label string").repartition(4)
    with pytest.raises(Exception, match="name"):
        frame_folder.write(df, str(tmp_path / "set"))
    assert list(tmp_path.iterdir()) == []
    frame_folder.write(df.limit(0), str(tmp_path / "empty"))
    assert [str(p.relative_to(tmp_path)) for p in Path(tmp_path).rglob("*") if p.is_file()] == ["empty/data.yaml"]
