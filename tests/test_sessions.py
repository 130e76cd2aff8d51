import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetia.plans import engine
from kinetia.streaming import sessions

ROW = "video_id string, t double, y double, v double"


def lifts(seed):
    rng, rows = np.random.default_rng(seed), []
    for k in ("a", "b", "c"):
        y = np.cumsum(np.sin(np.arange(300) / (15 + rng.integers(0, 8))) * 0.02)
        rows += [(k, i / 30, float(a), float(b)) for i, (a, b) in enumerate(zip(y, np.gradient(y) * 30))]
    return rows + [("short", i / 4, [0.0, 0.1, 0.4, 0.8, 0.9, 0.9, 0.9, 0.9, 0.9][i], [0.0, 0.5, 1.2, 1.0, 0.0, -0.3, -0.3, -0.3, -0.3][i]) for i in range(9)]


def streamed(spark, tmp_path, batches, schema, plan, name):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = plan(stream).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    return spark.table(name).collect()


@pytest.mark.parametrize("exercise", ["squat", "deadlift"])
def test_streams_of_both_lifts_agree_with_the_batch(spark, tmp_path, exercise):
    rows = lifts(5)
    cut = [[r for r in rows if k * 3.4 <= r[1] < (k + 1) * 3.4] for k in range(3)]
    got = {(r["video_id"], *(round(r[c], 6) for c in sessions.names(sessions.REP))) for r in streamed(spark, tmp_path, cut, ROW, lambda s: sessions.repetitions(s, exercise, timeout_ms=None), f"both_{exercise}")}
    df = spark.createDataFrame(rows, ROW).withColumn("idx", F.round(F.col("t") * 60).cast("long"))
    want = {(r["video_id"], *(round(r[c], 6) for c in sessions.names(sessions.REP))) for r in engine.segment(df, engine.Params(exercise)).collect()}
    assert len(want) >= 4 and got == want and "short" not in {k for k, *_ in got}


def test_sessions_are_begun_fed_and_ended(spark, tmp_path):
    wave = [r for r in lifts(5) if r[0] == "a"]
    at = lambda k, n, action, t=None, y=None, v=None: (k, n, action, t, y, v)
    fed = [at("a", i + 1, "frame", *r[1:]) for i, r in enumerate(wave)]
    first = [at("a", 0, "init"), *fed[:150], at("never", 0, "finalize"), at("few", 0, "init"), *(at("few", i, "frame", i / 30, 0.1, 0.0) for i in range(1, 5)), at("outside", 0, "frame", 0.0, 0.1, 0.0)]
    second = [*reversed(fed[150:]), at("a", 1000, "finalize"), at("a", 1001, "finalize"), at("few", 9, "finalize"), at("outside", 1, "finalize"), at("bare", 0, "init"), *(at("bare", i, "frame", i / 30) for i in range(1, 9)), at("bare", 9, "finalize")]
    got = streamed(spark, tmp_path, [first, second], "video_id string, seq long, action string, t double, y double, v double", lambda s: sessions.lifecycle(s, timeout_ms=None), "ended")
    ends = sorted((r["video_id"], r["status"], r["n_frames"]) for r in got if r["status"])
    assert ends == [("a", "NOT_INITIALIZED", 0), ("a", "OK", 300), ("bare", "NO_PLATE_DETECTED", 8), ("few", "TOO_FEW_FRAMES", 4), ("never", "NOT_INITIALIZED", 0), ("outside", "NOT_INITIALIZED", 0)]
    reps = [r for r in got if r["status"] is None]
    df = spark.createDataFrame(wave, ROW).withColumn("idx", F.round(F.col("t") * 30).cast("long"))
    assert sorted(round(r["start_time"], 6) for r in reps) == sorted(round(r["start_time"], 6) for r in engine.segment(df).collect())
    assert next(r["n_reps"] for r in got if r["status"] == "OK") == len(reps) > 0
