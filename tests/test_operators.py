"""Operators against plain Python on small and awkward inputs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetia.functions import columns as C
from kinetia.operators import folds, matching, metrics, peaks, windows
from kinetia.plans import engine
from kinetia.streaming import sessions


def series(spark, values, extra=False):
    rows = [(k, i, None if v is None else float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, i long, y double")


def test_greedy_pairs_match_brute_force(spark):
    rng = random.Random(1)
    sets = {f"v{k}": ([rng.randint(0, 9) / 2 for _ in range(rng.randint(0, 5))], [rng.randint(0, 9) / 2 for _ in range(rng.randint(0, 5))]) for k in range(30)}
    g = spark.createDataFrame([(k, i, x) for k, (a, _) in sets.items() for i, x in enumerate(a)], "k string, pos int, gt double")
    p = spark.createDataFrame([(k, i, x) for k, (_, b) in sets.items() for i, x in enumerate(b)], "k string, pos int, pred double")
    want = set()
    for k, (a, b) in sets.items():
        used = set()
        for i, x in enumerate(a):
            left = [(abs(y - x), j) for j, y in enumerate(b) if j not in used]
            if left:
                j = min(left)[1]
                used.add(j)
                want.add((k, i, x, b[j]))
    assert {tuple(r) for r in matching.pair_greedy(g, p, "k").collect()} == want


def test_gaps(spark):
    n = None
    df = series(spark, {"a": [0, 1, 2, n, n, 5, 6, *[n] * 11, 20], "b": [n, n], "c": [n, 3, n]})
    small = {(r["k"], r["i"]): r["y_filled"] for r in windows.interpolate(df, "k", "i", "y", max_gap=10).collect()}
    assert small["a", 3] == 3 and small["a", 4] == 4 and small["a", 10] is None and small["c", 0] is None
    whole = {(r["k"], r["i"]): r["y_filled"] for r in windows.interpolate(df, "k", "i", "y").collect()}
    assert whole["c", 0] == whole["c", 2] == 3 and whole["b", 0] is None and abs(whole["a", 12] - (6 + 14 * 6 / 12)) < 1e-9
    runs = series(spark, {"a": [*[1] * 40, n, *[1] * 40, n, n, *[1] * 45], "b": [1] * 30})
    got = windows.longest_run(runs, "k", "i", F.col("y").isNotNull(), 30).collect()
    assert [(r["k"], r["start"], r["end"] + 1) for r in got] == [("a", 83, 128)]


def test_interval_and_asof_joins(spark):
    rng = random.Random(2)
    points = [(rng.choice("ab"), rng.randint(0, 3000)) for _ in range(400)]
    spans = [(k, s, s + rng.randint(0, 700)) for k, s in ((rng.choice("abc"), rng.randint(0, 3000)) for _ in range(6))]
    left = spark.createDataFrame(points, "k string, t long").distinct()
    got = {tuple(r) for r in matching.outside(left, spark.createDataFrame(spans, "k string, start long, end long"), "k", "t").collect()}
    assert got == {p for p in points if not any(p[0] == k and a <= p[1] <= b for k, a, b in spans)}
    right = [(rng.choice("ab"), float(rng.randint(0, 3000))) for _ in range(60)]
    df = left.select("k", F.col("t").cast("double").alias("t"))
    rdf = spark.createDataFrame(right, "k string, t double")
    for after, forward in ((5.0, True), (0.0, False)):
        for r in matching.asof(df, rdf, "k", "t", after, forward).collect():
            times = [t for k, t in right if k == r["k"] and (t > r["t"] + after if forward else t <= r["t"])]
            assert r["found"] == (None if not times else min(times) if forward else max(times))


def test_set_of_repetitions(spark):
    """4 x (30 frames down, 30 up, 15 pause) at 30 fps, 0.0045 m a pixel."""
    y = []
    for _ in range(5):
        y += [*np.linspace(0, -120, 30), *np.linspace(-120, 0, 30), *[0] * 15]
    y = np.array(y) * 0.0045
    v = np.gradient(y) * 30
    rows = [("s", k, k / 30, float(a), float(b)) for k, (a, b) in enumerate(zip(y, v))]
    df = spark.createDataFrame(rows, "video_id string, idx long, t double, y double, v double")
    got = engine.segment(df).collect()
    assert len(got) == 4  # a repetition ends where the next descent begins; the last one is unfinished
    assert engine.segment(df.limit(0)).count() == 0 and engine.segment(df.where("idx < 9")).count() == 0
    assert all(abs(r["rom_m"] - 0.54) < 0.05 for r in got)


def test_stream_agrees_with_batch(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for k in ("a", "b", "c"):
        y = np.cumsum(np.sin(np.arange(400) / (15 + rng.integers(0, 8))) * 0.02)
        rows += [(k, i / 30, float(a), float(b)) for i, (a, b) in enumerate(zip(y, np.gradient(y) * 30))]
    df = spark.createDataFrame(rows, "video_id string, t double, y double, v double")
    for k in range(4):  # in order of time, some steps twice
        df.where(f"t >= {k * 3.4} and t < {(k + 1) * 3.4}").union(df.where(f"t = {k * 3.4}")).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    q = sessions.repetitions(stream, timeout_ms=None).writeStream.format("memory").queryName("reps").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r["video_id"], round(r["start_time"], 6), round(r["mcv_mps"], 6)) for r in spark.table("reps").collect()}
    batch = engine.segment(df.withColumn("idx", F.round(F.col("t") * 30).cast("long"))).collect()
    want = {(r["video_id"], round(r["start_time"], 6), round(r["mcv_mps"], 6)) for r in batch}
    assert got and got == want


def test_session_statuses(spark):
    df = spark.createDataFrame([("a", i / 30) for i in range(5)] + [("b", 0.0)] * 4, "video_id string, t double")
    assert {tuple(r) for r in sessions.statuses(df).collect()} == {("a", 5, "OK"), ("b", 4, "TOO_FEW_FRAMES")}


def test_filters(spark):
    line = [(k, i, i / 30, 0.3 * i / 30) for k in "ab" for i in range(120)]
    df = spark.createDataFrame(line, "k string, i long, t double, z double")
    last = folds.physical_filter(df, "k", "i", "t", "z").where("i = 119").collect()
    assert all(abs(r["v"] - 0.3) < 1e-3 and abs(r["y"] - 0.3 * 119 / 30) < 1e-4 for r in last)
    gaps = df.withColumn("z", F.when(F.col("i") % 3 == 0, F.col("z")))
    assert folds.fixed_step_filter(gaps, "k", "i", "z", 1 / 30).count() == 240
    assert folds.physical_filter(df.withColumn("t", F.lit(1.0)), "k", "i", "t", "z").count() == 240  # repeated times
    states = [r["state"] for r in folds.associate(spark.createDataFrame([("a", i, None if i in (7, 8, 12, 13, 14, 15) else 1.0, 2.0) for i in range(20)], "k string, i long, cx double, cy double"), "k", "i", timeout_frames=2).orderBy("i").collect()]
    assert states[:5] == ["ANCHORING"] * 4 + ["TRACKING"] and states[7:10] == ["LOST", "LOST", "RECOVERED"] and states[12:17] == ["LOST", "LOST", "LOST", "LOST", "DRIFTED"]


def test_bottom_triggers(spark):
    valley = [300.0] * 10 + list(np.linspace(300, 500, 30)) + [500.0] * 6 + list(np.linspace(500, 300, 30)) + [300.0] * 10
    shallow = [300.0] * 10 + list(np.linspace(300, 400, 30)) + list(np.linspace(400, 300, 30))
    got = folds.bottoms(series(spark, {"deep": valley, "twice": valley + valley, "shallow": shallow}), "k", "i", "y", 100.0).collect()
    assert sorted(r["k"] for r in got) == ["deep", "twice", "twice"] and all(r["bottom"] == 500 for r in got)


def test_agreement_edges(spark):
    pairs = spark.createDataFrame([("a", 1.0, 1.1), ("b", 1.0, 1.0), ("b", 2.0, 2.0), ("b", 3.0, 3.0)], "k string, gt double, pred double")
    got = {r["k"]: r for r in metrics.agreement(pairs, "k").collect()}
    assert got["a"]["pearson_r"] == 0 and got["a"]["icc_ref"] == 0 and got["a"]["loa_low"] == got["a"]["loa_high"]
    assert got["b"]["rmse"] == 0 and got["b"]["pearson_r"] == pytest.approx(1) and got["b"]["icc_2_1"] == pytest.approx(1)


def test_bootstrap_interval(spark):
    rng = np.random.default_rng(4)
    rows = [(f"v{k}", float(x), float(x - 0.1 * rng.normal())) for k in range(40) for x in rng.uniform(0.3, 1.2, 3)]
    r = metrics.cluster_bootstrap(spark.createDataFrame(rows, "k string, gt double, pred double"), "k", 500).first()
    x, y = np.array([p for _, _, p in rows]), np.array([g for _, g, _ in rows])
    slope = np.polyfit(x, y, 1)[0]
    assert r["low"] < slope < r["high"] and 0.03 < r["high"] - r["low"] < 0.4


def test_columns(spark):
    row = spark.range(1).select(
        C.anchor_score(F.lit(640.0), F.lit(360.0), F.lit(60.0), F.lit(60.0), F.lit(0.9), 1280, 720).alias("good"), C.anchor_score(F.lit(5.0), F.lit(360.0), F.lit(60.0), F.lit(60.0), F.lit(0.9), 1280, 720).alias("edge"),
        C.iou(C.corners(*(F.lit(x) for x in (0.0, 0.0, 2.0, 2.0))), C.corners(*(F.lit(x) for x in (1.0, 0.0, 2.0, 2.0)))).alias("iou"), C.plate_diameter(F.lit(" 20 KG ")).alias("plate"), C.plate_diameter(F.lit(None)).alias("none"),
        C.parse_name(F.lit("30kg_1.03_0.89.mp4"))[1].alias("reps"), C.parse_name(F.lit("other.mp4"))[1].alias("other"), C.load_band(F.lit(100)).alias("band"), C.gray(F.lit(255), F.lit(255), F.lit(255)).alias("gray"),
    ).first()
    assert row["good"] == pytest.approx(0.9) and row["edge"] == 0 and row["iou"] == pytest.approx(1 / 3) and row["plate"] == row["none"] == 0.45
    assert row["reps"] == [1.03, 0.89] and row["other"] is None and row["band"] == "heavy" and row["gray"] == 255


def test_detections_to_repetitions(spark):
    cy = [300 + 100 * math.sin(k / 12) for k in range(500)]
    rows = [("v", k, k / 30, [(640.0, c, 60.0, 60.0, 0.9), (10.0, 10.0, 5.0, 5.0, 0.99)]) for k, c in enumerate(cy)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, pts_s double, candidates array<struct<cx: double, cy: double, w: double, h: double, conf: double>>")
    path, reps = engine.analyze(df)
    assert path.count() == 480 and reps.count() >= 3


def test_null_keys_fold_as_a_group(spark):
    from kinetia.operators import folds

    big = 2**60 + 1
    rows = [(big, 0, 1.0), (None, 0, 3.0), (0, 0, 5.0), (None, 1, 4.0), (0, 1, 6.0), (big, 1, 2.0)]
    got = folds.decayed(spark.createDataFrame(rows, "k long, i long, v double"), "k", "i", "v").collect()
    assert {(r["k"], r["i"]): round(r["average"], 6) for r in got} == {(big, 0): 1.0, (big, 1): 1.7, (None, 0): 3.0, (None, 1): 3.7, (0, 0): 5.0, (0, 1): 5.7}


def test_registered_bootstrap_has_the_references_draws(spark, monkeypatch):
    from kinetia.plans import queries

    rng = random.Random(74)
    rows = [(f"v{k % 9}", float(x := rng.random()), x + rng.gauss(0, 0.2)) for k in range(90)]
    df = spark.createDataFrame(rows, "video_id string, gt double, pred double")
    monkeypatch.setattr(queries, "pairs", lambda *_: df)
    got, want = queries.slope_bootstrap(spark, "").first(), metrics.cluster_bootstrap(df, "video_id", draws=2000).first()
    assert list(got) == pytest.approx(list(want), abs=1e-5)


def test_published_rules(spark):
    """Values of the verdicts, scores and plates, away from the middle and on the limits."""
    f = lambda *x: [F.lit(v) for v in x]
    row = spark.range(1).select(
        C.anchor_score(*f(640.0, 100.0, 60.0, 60.0, 0.9), 1280, 720).alias("high"), C.anchor_score(*f(38.4, 360.0, 60.0, 60.0, 0.9), 1280, 720).alias("limit"),
        C.regrind_verdict(*f(50.0, 0.4, 0.8, 100.0)).alias("conf"), C.regrind_verdict(*f(50.0, 0.4, 0.4, 100.0)).alias("neither"), C.regrind_verdict(*f(20.0, 0.9, 0.1, 100.0)).alias("just"), C.regrind_verdict(*f(19.9, 0.9, 0.1, 100.0)).alias("below"),
        F.array(*(C.plate_diameter(F.lit(n)) for n in ("10kg", " 15 KG", "10 lb", "25LB", "35lb", "99kg"))).alias("plates"),
    ).first()
    assert row["high"] == pytest.approx(0.705) and row["limit"] == 0
    assert (row["conf"], row["neither"], row["just"], row["below"]) == ("snap", None, "snap", "micro")
    assert row["plates"] == [0.32, 0.38, 0.28, 0.4, 0.42, 0.45]


def test_second_descent_counts_only_after_the_top(spark):
    down = lambda a, b, n: list(np.linspace(a, b, n))
    # three radii down, 0.6 up, two down, 0.6 up: one trigger until the value has climbed 1.5 radii
    y = down(0, 300, 31) + down(298, 240, 12) + down(250, 440, 20) + down(438, 380, 12)
    got = folds.bottoms(series(spark, {"a": y, "b": y + down(380, 0, 40) + down(10, 300, 30) + down(298, 200, 10)}), "k", "i", "y", 100.0).collect()
    assert sorted(r["k"] for r in got) == ["a", "b", "b"] and min(r["at"] for r in got) == 30


def test_bottoms_at_a_tie_arm_and_fire(spark):
    y = [0.0, 0.15, *[0.12] * 4, 0.0, 0.15, *[0.12] * 4]  # exactly 1.5 radii of 0.1 down, 0.3 back, and up again
    assert 1.5 * 0.1 > 0.15 - 0.0
    back = [0.0, 0.25, *[0.25 - 0.03] * 4]
    got = sorted((r["k"], r["i"], r["bottom"]) for r in folds.bottoms(series(spark, {"a": y, "b": back}), "k", "i", "y", 0.1).collect())
    assert got == [("a", 5, 0.15), ("a", 11, 0.15), ("b", 5, 0.25)]


def test_association_of_lost_targets(spark):
    cx = [1.0] * 6 + [None, None, 5.0] + [None] * 4 + [9.0]
    rows = spark.createDataFrame([("a", i, x, None if x is None else 2.0) for i, x in enumerate(cx)], "k string, i long, cx double, cy double")
    got = [tuple(r)[2:] for r in folds.associate(rows, "k", "i", timeout_frames=2).orderBy("i").collect()]
    assert [g[0] for g in got] == ["ANCHORING"] * 4 + ["TRACKING"] * 2 + ["LOST", "LOST", "RECOVERED", "LOST", "LOST", "LOST", "LOST", "DRIFTED"]
    assert got[6] == ("LOST", False, 0, None, None, False) and got[7] == ("LOST", True, 1, None, 2.0, False) and got[13] == ("DRIFTED", True, 4, 9.0, 2.0, True)


def test_golden_without_repetitions_or_baseline(spark):
    base = spark.createDataFrame([("b", 0, 1.0), ("d", 0, 0.5)], "k string, pos int, gt double")
    pred = spark.createDataFrame([("d", 0, 0.504), ("e", 0, 1.0)], "k string, pos int, pred double")
    s = lambda **x: spark.createDataFrame(list(x.items()), "k string, status string")
    got = {r["k"]: r["pass"] for r in metrics.golden_check(base, pred, s(a="NO", b="OK", c="OK", d="OK"), s(a="NO", b="OK", c="NO", d="OK", e="OK"), "k").collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": None}


def test_nearest_of_long_keys_in_linear_time(spark):
    import time

    seconds = []
    for n in (16_000, 160_000):
        df = spark.range(n).select(F.lit("a").alias("k"), F.col("id").alias("i"), F.when(F.col("id") % 3 == 0, F.col("id").cast("double")).alias("y"))
        t = time.time()
        assert windows.interpolate(df, "k", "i", "y").where("y_filled is null").count() == 0
        seconds.append(time.time() - t)
    assert seconds[1] < 20 * seconds[0] + 5


def test_jumps_without_a_size_before(spark):
    df = spark.createDataFrame([("a", i, float(x), float(h)) for i, (x, h) in enumerate([(0, 0), (90, 10), (90, 10), (96, 20)])], "k string, i long, x double, h double")
    assert [r["jump"] for r in windows.jumps(df, "k", "i", "x", "h", F.lit(True)).orderBy("i").collect()] == [None, None, None, "POS+SCALE"]


def test_jumps_at_a_tie_fall_as_quotients_do(spark):
    pairs = [(0.7 / 500, 0.91 / 500), (0.7 / 500, 0.49 / 500), (2.8 / 500, 1.96 / 500)]  # three tenths: the quotient isn't above 0.3, the difference is above 0.3 * size
    assert all(abs(b - a) / a <= 0.3 < 0.3 + 1e-15 and abs(b - a) > 0.3 * a for a, b in pairs)
    rows = [(k, i, 43200.0 * pairs[k][0] * i, pairs[k][i]) for k in range(3) for i in (0, 1)]
    df = spark.createDataFrame(rows, "k long, i long, x double, h double")
    got = windows.jumps(df, "k", "i", "x", "h", F.lit(True), far=43200.0)
    want = {k: "POS" if 43200.0 * a / a > 43200.0 else None for k, (a, _) in enumerate(pairs)}
    assert {r["k"]: r["jump"] for r in got.where("i = 1").collect()} == want
    counts = {r["k"]: (r["total"], r["scale"]) for r in metrics.jump_summary(got, "k").collect()}
    assert counts == {k: (int(x is not None), 0) for k, x in want.items()}


def plain_peaks(y, distance, prominence):
    at, n = [], len(y)
    for i in range(1, n - 1):
        j = i
        while j < n - 1 and y[j + 1] == y[i]:
            j += 1
        if y[i] > y[i - 1] and j < n - 1 and y[j + 1] < y[i]:
            at.append((i + j) // 2)
    stays = dict.fromkeys(at, True)
    for i in sorted(at, key=lambda i: (y[i], i), reverse=True):
        if stays[i]:
            stays.update({j: False for j in at if j != i and abs(i - j) < distance})
    out = []
    for i in (i for i in at if stays[i]):
        a, b = i, i
        while a > 0 and y[a - 1] <= y[i]:
            a -= 1
        while b < n - 1 and y[b + 1] <= y[i]:
            b += 1
        p = y[i] - max(min(y[a : i + 1]), min(y[i : b + 1]))
        if p >= prominence:
            out.append((i, p))
    return out


def test_peaks_and_smoothing_against_plain_forms(spark):
    from kinetia.operators import peaks

    rng = random.Random(5)
    values = {f"v{k}": [rng.randint(0, 6) for _ in range(rng.randint(0, 40))] for k in range(40)}
    for distance, prominence in ((1, 0.0), (4, 2.0)):
        got = {(r["k"], r["i"], r["prominence"]) for r in peaks.peaks(series(spark, values), "k", "i", "y", distance, prominence).collect()}
        assert got == {(k, i, p) for k, y in values.items() for i, p in plain_peaks(y, distance, prominence)}
    y = [rng.random() for _ in range(30)]
    df = series(spark, {"a": y, "short": y[:6]})
    for deriv in (0, 1):
        got = {(r["k"], r["i"]): r["smooth"] for r in peaks.savgol(df, "k", "i", "y", 11, 3, deriv).collect()}
        for i in range(30):
            a = min(max(i - 5, 0), 19)
            fit = np.polynomial.Polynomial.fit(np.arange(a, a + 11), y[a : a + 11], 3)
            assert got["a", i] == pytest.approx((fit.deriv() if deriv else fit)(i), abs=1e-9)
        assert all(got["short", i] is None for i in range(6))


def test_older_segmentation(spark):
    from kinetia.operators import peaks

    y = []
    for _ in range(4):
        y += [*np.linspace(0, 120, 30, endpoint=False), *np.linspace(120, 0, 30, endpoint=False), *[0] * 15]
    gap = [None if 120 <= k < 200 else v for k, v in enumerate(y + y)]
    got = peaks.repetitions(series(spark, {"set": y[:-15], "gap": gap, "flat": [0.0] * 90}), "k", "i", "y", 30.0, 0.0045, 11).collect()
    assert [r["k"] for r in got].count("set") == 4 and all(abs(r[c] - 0.54) < 0.15 * 0.54 for r in got for c in ("mcv", "mcv_mid") if r["k"] == "set")
    assert not any(r["start"] < 200 < r["end"] and r["end"] >= 120 for r in got if r["k"] == "gap") and not any(r["k"] == "flat" for r in got)


def test_pending_tracks_and_fusion(spark):
    from kinetia.operators import tracks

    rows = [("v", f, 0, 100.0 + f, 50.0, 9.0, 9.0, 0.5) for f in range(8)] + [("v", f, 1, 300.0, 200.0 + 30 * f, 9.0, 9.0, 0.9) for f in (0, 1, 7)] + [("v", 8, 0, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "k string, frame_idx long, pos long, cx double, cy double, w double, h double, conf double")
    got = tracks.pending(df, "k", "frame_idx").collect()
    assert {(r["frame_idx"], r["pos"], r["track"]) for r in got} == {(f, 0, 0) for f in range(8)} | {(0, 1, 1), (1, 1, 1), (7, 1, 2)}
    assert [r["hits"] for r in sorted(got, key=lambda r: r["frame_idx"]) if r["track"] == 0] == list(range(1, 9))
    assert [r["pos"] for r in tracks.nearest_to_previous(df, "k", "frame_idx").orderBy("frame_idx").collect()] == [0] * 8 + [None]
    picked = tracks.moving_track(df.where("cx is not null").withColumn("track", F.col("pos")), "k", 3).first()
    assert (picked["track"], picked["hits"]) == (1, 3)


def test_valleys_merge_and_events(spark):
    from kinetia.operators import peaks

    y = [1.0] * 80
    y[20], y[30], y[60] = 0.5, 0.4, 0.7
    assert [(r["i"], round(r["depth"], 6)) for r in windows.valleys(series(spark, {"a": y}), "k", "i", "y").orderBy("i").collect()] == [(30, 0.6), (60, 0.3)]
    merged = folds.merge_peaks(series(spark, {"a": [1, 3, 2, 0, 0, 0, 5]}), "k", "i", "y", 3).orderBy("i").collect()
    assert [(r["i"], r["y"]) for r in merged] == [(1, 3.0), (6, 5.0)]  # 4 begins a group, which 6 joins and tops
    events = spark.createDataFrame([("a", 10, "b", 100.0), ("z", 5, "t", 1.0)], "k string, i long, kind string, value double")
    ends = spark.createDataFrame([("a", 40, 20.0), ("z", 40, 0.0)], "k string, i long, value double")
    got = peaks.trailing_event(events, ends, "k", "i", 30.0, 0.01, (0.25, 4.5), 0.5).where("kind = 't' and k = 'a'").collect()
    assert [(r["i"], r["value"]) for r in got] == [(40, 20.0)]


def test_readers_and_sinks_on_small_files(spark, tmp_path):
    import json

    from kinetia.sources import readers, sinks

    put = lambda name, x: (tmp_path / name).write_text(x if isinstance(x, str) else json.dumps(x)) and str(tmp_path / name)
    index = put("index.json", [{"video_id": "a", "load_kg": 30.0, "gt_reps_mcv": [0.9, 0.0], "session_id": 1}, {"video_id": "b", "load_kg": 50.0, "gt_reps_mcv": [0.5], "hold_out": True}])
    assert {tuple(r) for r in readers.dataset_index(spark, index).collect()} == {("a", 30.0, False, 0, 0.9), ("b", 50.0, True, 0, 0.5)}
    truth = put("truth.csv", "filename,load_kg,rep1,rep2,rep3,rep4,rep5,rep6,rep7,rep8\na.mp4,30,0.9,x,0.7,0.00,,,,\nb.mp4,50,,,,,,,,\n")
    assert {(r["video_id"], r["pos"], r["gt"]) for r in readers.ground_truth(spark, truth).collect()} == {("a", 0, 0.9), ("a", 1, 0.7)}
    (tmp_path / "t").mkdir()
    put("t/vid_1.csv", "idx,t_s,y_m,v_mps,det_h_px,det_conf\n20,0.1,1.0,0.5,60,0.9\n21,0.2,1.1,0.4,,\n")
    put("t/none.csv", "idx,t_s,y_m,v_mps,det_h_px,det_conf\n")
    assert [(r["video_id"], r["pos"], r["det_h_px"]) for r in readers.trajectories(spark, str(tmp_path / "t")).orderBy("pos").collect()] == [("vid_1", 0, 60.0), ("vid_1", 1, None)]
    result = put("r.json", {"video": "a.mp4", "status": "OK", "fps": "30", "mpp": "null", "reps": [{"start_idx": "1", "end_idx": 9, "start_time": 0.1, "end_time": 0.9, "duration_s": 0.8, "rom_m": 0.4, "mcv_mps": "0.5", "pcv_mps": "null"}]})
    r = readers.results(spark, result).first()
    assert (r["video_id"], r["mpp"], r["start_idx"], r["mcv_mps"], r["pcv_mps"]) == ("a", None, 1, 0.5, None)
    raw = put("d.json", {"video_id": "a", "frames": [{"frame_idx": 0, "pts_s": 0.0, "candidates": [{"cx": 1.0, "cy": 2.0, "w": 3.0, "h": 4.0, "conf": 0.5}]}, {"frame_idx": 1, "pts_s": 0.1, "candidates": []}]})
    found = readers.detections(spark, raw)
    assert [len(r["candidates"]) for r in found.orderBy("frame_idx").collect()] == [1, 0]
    spans = put("absent.json", {"a": [[0, 5], [9, 9]], "b": []})
    assert sorted(tuple(r) for r in readers.intervals(spark, spans).collect()) == [("a", 0, 5), ("a", 9, 9)]
    put("clip.mp4", "xx"), put("l.txt", "0 0.5 0.5 0.1 0.1\n0 1.5 0.5 0.1 x\n")
    assert [(r["video_id"], r["length"]) for r in readers.listing(spark, str(tmp_path)).collect()] == [("clip", 2)]
    assert sorted(r["valid"] for r in readers.box_labels(spark, str(tmp_path / "l.txt")).collect()) == [False, True]
    pairs = readers.rep_pairs(spark, put("p.json", {"rep_pairs": [{"video": "a", "gt": 1.0, "pred": 1.1, "error": 0.1}]}))
    assert pairs.count() == 1
    with pytest.raises(ValueError):
        readers.rep_pairs(spark, put("none.json", {"rep_pairs": []}))
    reps = readers.results(spark, result).withColumn("mcv_mps", F.lit(0.5004))
    sinks.result_json(reps, str(tmp_path / "out1"))
    assert json.loads(next((tmp_path / "out1").glob("*.json")).read_text())["reps"][0]["mcv_mps"] == 0.5
    points = readers.trajectories(spark, str(tmp_path / "t"))
    sinks.trajectory_csv(points, str(tmp_path / "out2"))
    assert spark.read.csv(str(tmp_path / "out2"), header=True).count() == 2 and sinks.manifest(points, "abc").first()["n_traj"] == 2
    sinks.per_rep_csv(pairs, str(tmp_path / "out3"))
    assert next((tmp_path / "out3").glob("*.csv")).read_bytes().startswith(b"\xef\xbb\xbf")
    assert sinks.bland_altman_points(pairs).first()["diff"] == pytest.approx(0.1)
    sinks.detection_json(found.withColumn("video_id", F.lit("a")), {"conf": 0.05}, str(tmp_path / "out4"))
    again = readers.detections(spark, str(tmp_path / "out4"))
    assert sorted(r["frame_idx"] for r in again.collect()) == [0, 1]
    assert sinks.markdown(pairs).splitlines()[:2] == ["| video | gt | pred | error |", "| --- | --- | --- | --- |"]
    assert [tuple(r) for r in sinks.as_strings(spark.createDataFrame([(1.5, float("nan"), None)], "a double, b double, c double")).collect()] == [("1.5", "null", "null")]


def test_short_series_take_shorter_windows(spark):
    """Quadratics come back whole; below the least window there is nothing, one row more than a window is needed for it."""
    rows = [(n, i, 1.0 + 2 * i - 0.5 * i * i) for n in range(1, 14) for i in range(n)]
    df = spark.createDataFrame(rows, "k long, i long, y double")
    got = peaks.savgol(df, "k", "i", "y", 11, 2, least=5).collect()
    assert {r["k"] for r in got if r["smooth"] is None} == {1, 2, 3, 4, 5}
    assert all(r["smooth"] == pytest.approx(r["y"]) for r in got if r["k"] > 5)
    line = spark.createDataFrame([(1, i, float(i * i)) for i in range(4)], "k long, i long, y double")
    assert [r["smooth"] for r in peaks.savgol(line, "k", "i", "y", 15, 3, least=3).orderBy("i").collect()] == pytest.approx([0.0, 1.0, 4.0, 9.0])


def test_roll_up_with_nulls(spark):
    rows = [("OK", True, 0.1, 2.0), ("OK", False, None, 0.0), (None, None, 0.3, None), ("NO", True, 0.2, 4.0)]
    got = {r["status"]: r for r in metrics.roll_up(spark.createDataFrame(rows, "status string, count_ok boolean, rmse double, ms double")).collect()}
    r = got[None]
    assert {k: v["n"] for k, v in got.items()} == {"OK": 2, None: 1, "NO": 1}
    assert (r["n_videos"], r["n_count_ok"], r["count_accuracy"], r["n_paired"], r["ms_mean"]) == (4, 2, 0.5, 3, 3.0)
    assert r["rmse_mean"] == pytest.approx(0.2) and r["rmse_median"] == pytest.approx(0.2)
