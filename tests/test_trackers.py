import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetia.operators import folds, matching, peaks, sampling, splines, trackers, tracks, windows


def boxes(spark, rows):
    """rows: (key, frame, pos, cx, cy, h, conf); a frame without boxes has None."""
    return spark.createDataFrame([(*r[:5], r[5], r[5], r[6]) for r in rows], "k string, f long, pos long, cx double, cy double, w double, h double, conf double")


def test_gated_filter_rejects_jumps_and_keeps_its_scale(spark):
    rows = []
    for n in range(1, 121):
        y = 200.0 + (12 * math.sin((n - 40) / 12) if n > 40 else 0)
        if n in (3, 4):
            rows.append(("a", n, 0, None, None, None, None))
        elif n == 75:
            rows.append(("a", n, 0, 101.0, y - 70, 50.0, 0.9))  # beyond 0.6 sizes of the prediction, within reach
        elif n == 90:
            rows.append(("a", n, 0, 400.0, y, 50.0, 0.9))
        else:
            rows += [("a", n, 0, 300.0, 20.0, 50.0, 0.99 if n > 1 else 0.2), ("a", n, 1, 100.0 + n % 2, y, 50.0 + n % 3, 0.9), ("a", n, 2, 100.0, y, 40.0, 0.1)]
    rows.append(("b", 1, 0, 5.0, 5.0, 9.0, 0.1))
    got = {(r["k"], r["f"]): r for r in trackers.gated_filter(boxes(spark, rows), "k", "f").collect()}
    src = {n: got["a", n]["src"] for n in range(1, 121)}
    assert src[1] == "anchor" and src[3] == "cal_static" and src[31] == "cal_lock" and src[32] == "kalman" and src[45] == "yolo+kalman"
    assert src[75] == "yolo_jump_reject" and src[90] == "yolo_miss" and got["b", 1]["src"] == "none"
    assert abs(got["a", 120]["mpp"] - 0.45 / 51) < 1e-9 and got["a", 30]["mpp"] is None
    assert got["a", 60]["size"] == 0.7 * 50 + 0.3 * got["a", 59]["size"] and got["a", 46]["v"] < 0  # down
    anchor = spark.createDataFrame([("a", 10, 300.0, 20.0, 50.0)], "k string, f long, cx double, cy double, h double")
    held = {r["f"]: r for r in trackers.gated_filter(boxes(spark, rows), "k", "f", anchor).where("k = 'a'").collect()}
    assert held[9]["src"] == "none" and held[10]["src"] == "anchor" and held[20]["y"] == 20.0


def test_displacements_move_the_filter_between_keyframes(spark):
    f = spark.createDataFrame([("a", n, n / 30, 100.0 if n % 15 == 1 else None) for n in range(61)] + [(None, 0, 0.0, 50.0), (None, 1, 0.1, None)], "k string, f long, t double, z double")
    steps = [("a", n, 2.0 + d) for n in range(2, 15) for d in (-3, -0.1, 0, 0.1, 40)] + [("a", n, 9.0) for n in range(17, 30) for _ in range(4)] + [("a", 40, None)] * 9
    got = {(r["k"], r["f"]): r for r in trackers.displaced_filter(f, spark.createDataFrame(steps, "k string, f long, d double"), "k", "f", "t", "z", "d", 0.01).collect()}
    assert ("a", 0) not in got and got["a", 1]["src"] == "start" and got[None, 1]["src"] == "predicted"
    assert got["a", 14]["src"] == "moved" and abs(got["a", 14]["y"] - 1.26) < 0.05  # 13 medians of 2 pixels
    assert got["a", 16]["src"] == "absolute" and {got["a", n]["src"] for n in range(17, 30)} == {"predicted"}


def test_watch_clusters_adopt_what_moves_far_off(spark):
    rows = []
    for n in range(400):
        rows += [("a", n, 0, 50.0, 30.0, 20.0, 0.9), ("a", n, 1, 500.0, 200.0 + 30 * (n % 12), 25.0 + n % 4, 0.8 if n >= 200 else 0.1)]
    rows += [("slow", n, 0, 9.0, 100.0 + 0.2 * n, 5.0, 0.9) for n in range(400)]
    got = [(r["k"], r["f"], r["hits"]) for r in trackers.watch_clusters(boxes(spark, rows), "k", "f").orderBy("f").collect()]
    assert got and got[0][0] == "a" and 203 <= got[0][1] <= 220 and got[0][2] >= 4 and all(k == "a" for k, *_ in got)
    assert trackers.watch_clusters(boxes(spark, rows).where("f < 200"), "k", "f").count() == 0


def test_watch_looks_only_at_what_a_frame_changes():
    rng, looked = random.Random(26), []

    class Counted(trackers.Watch):
        def moves(self, seen):
            looked.append(len(seen))
            return super().moves(seen)

    def plain(frames, keep, least, motion, away):
        clusters, target, out = [], 0.0, []
        for n, boxes in frames:
            for b in boxes:
                if b["conf"] >= 0.3:
                    hit = next((c for c in clusters if math.hypot(b["cx"] - c[0], b["cy"] - c[1]) < 60.0), None)
                    if hit is None:
                        clusters.append(hit := [b["cx"], b["cy"], []])
                    hit[:2] = 0.7 * b["cx"] + 0.3 * hit[0], 0.7 * b["cy"] + 0.3 * hit[1]
                    hit[2].append((n, b["cy"], b["h"]))
            clusters = [[x, y, [o for o in seen if o[0] >= n - keep]] for x, y, seen in clusters]
            clusters = [c for c in clusters if c[2]]
            for x, y, seen in clusters:
                if len(seen) >= least and np.std([o[1] for o in seen]) > motion and abs(seen[-1][1] - target) > away:
                    clusters, target = [], y
                    out.append((n, x, y, seen[-1][2], len(seen)))
                    break
        return out

    frames = [(n, [{"cx": rng.randrange(200) * 3.0, "cy": rng.randrange(100) * 3.0, "h": rng.random(), "conf": rng.randrange(11) / 10} for _ in range(rng.randrange(5))]) for n in range(3000)]
    watch, target, got = Counted(0.3, 60.0, 90, 4, 25.0, 60.0), 0.0, []
    for n, boxes in frames:
        if found := watch.see(n, boxes, target):
            target = found[1]
            got.append((n, *found))
    assert len(got) > 20 and got == plain(frames, 90, 4, 25.0, 60.0)
    assert 0 < len(looked) < 5 * len(frames)  # at most what the frame's boxes changed, and as many that expired, not all of some fifty clusters


def dense_basis(degree, cells, u):
    """Values of all even B-splines by the recursion over knots."""
    knots = np.arange(-degree, cells + degree + 1, dtype=float)
    b = ((u[:, None] >= knots[:-1]) & (u[:, None] < knots[1:])).astype(float)
    b[u >= cells] = 0
    b[u >= cells, degree + cells - 1] = 1
    for d in range(1, degree + 1):
        b = (u[:, None] - knots[: -d - 1]) / d * b[:, :-1] + (knots[d + 1 :] - u[:, None]) / d * b[:, 1:]
    return b


@pytest.mark.parametrize("degree", [3, 4])
def test_spline_agrees_with_a_dense_solve(spark, degree):
    rng = np.random.default_rng(5)
    t = np.sort(rng.uniform(3, 9, 140))
    y = 400 + 30 * np.sin(2 * t) + rng.normal(0, 0.6, 140)
    rows = [("a", float(a), float(b)) for a, b in zip(t, y)] + [("a", None, 1.0), ("a", 5.0, None), ("few", 1.0, 2.0), ("flat", 1.0, 2.0)] + [("flat", 1.0, 3.0)] * 9
    rows += [(None, float(k), 5.0 + k) for k in range(20)] + [("noisy", float(k), float(rng.normal(0, 100))) for k in range(60)]
    df = spark.createDataFrame(rows, "k string, t double, y double").withColumn("slope_in", F.lit(1))
    out = splines.smoothing_spline(df, "k", "t", "y", degree, 0.5, rows_a_knot=5.0).collect()
    assert len(out) == len(rows)
    mine = sorted((r for r in out if r["k"] == "a" and r["t"] is not None and r["y"] is not None), key=lambda r: r["t"])
    cells = math.ceil(140 / 5)
    u = (t - t[0]) / (t[-1] - t[0]) * cells
    b, z = dense_basis(degree, cells, u), y - y.mean()
    unit = (b.T @ b).diagonal().mean()
    d = np.diff(np.eye(b.shape[1]), 2, axis=0)
    fit = lambda p: np.linalg.solve(b.T @ b + d.T @ d * unit * 10.0**p + np.eye(b.shape[1]) * unit * 1e-12, b.T @ z)
    rss = lambda p: ((z - b @ fit(p)) ** 2).sum()
    low, high = -9.0, 9.0
    for _ in range(60):
        low, high = ((low + high) / 2, high) if rss((low + high) / 2) <= 70 else (low, (low + high) / 2)
    want = b @ fit(low) + y.mean()
    assert np.abs(np.array([r["spline"] for r in mine]) - want).max() < 1e-3
    assert mine[0]["fits"] and 69 < mine[0]["rss"] <= 70.0001 and rss(low + 0.1) > 70
    slopes, near = np.array([r["slope"] for r in mine]), 60 * np.cos(2 * t)
    assert np.abs(slopes - near)[5:-5].max() < 8
    at = {r["t"]: r for r in out if r["k"] is None}
    assert all(abs(r["slope"] - 1) < 1e-4 and abs(r["spline"] - 5 - r["t"]) < 1e-3 for r in at.values())
    assert all(r["spline"] is None and r["fits"] is None for r in out if r["k"] in ("few", "flat"))
    assert not next(r for r in out if r["k"] == "noisy")["fits"]
    assert [r["spline"] for r in out if r["t"] is None] == [None]


def test_banded_solve():
    rng = np.random.default_rng(1)
    for n, width in ((1, 4), (3, 4), (40, 4), (40, 5)):
        a = np.zeros((n, n))
        for k in range(1, width):
            i = np.arange(n - k)
            a[i, i + k] = a[i + k, i] = rng.normal(size=len(i))
        a += np.eye(n) * 20
        bands = np.array([[a[i, i + k] if i + k < n else 0.0 for k in range(width)] for i in range(n)])
        x = rng.normal(size=n)
        assert np.allclose(splines.banded_solve(bands, a @ x), x) and np.allclose(splines._times(bands, x), a @ x)


def series(spark, values):
    return spark.createDataFrame([(k, i, float(v)) for k, vs in values.items() for i, v in enumerate(vs)], "k string, i long, y double")


def test_peak_troughs_equal_brute_force(spark):
    rng = random.Random(8)
    values = {f"k{n}": [rng.randint(0, 30) for _ in range(rng.randint(1, 200))] for n in range(12)}
    df = series(spark, values)
    high = [(k, i) for k, vs in values.items() for i in range(len(vs)) if rng.random() < 0.2]
    low = [(k, i) for k, vs in values.items() for i in range(len(vs)) if rng.random() < 0.08]
    want = {}
    for k, p in high:
        vs = values[k]
        later = [t for kk, t in sorted(low) if kk == k and t > p + 3 and vs[t] < np.percentile(vs, 60)]
        end = later[0] if later else p + int(np.argmin(vs[p : p + 26]))
        want[k, p] = (end, "trough" if later else "lowest", vs[p], vs[end])
    a, b = (spark.createDataFrame(x, "k string, i long") for x in (high, low))
    got = {(r["k"], r["i"]): tuple(r)[2:] for r in peaks.peak_troughs(df, a, b, "k", "i", "y", 3, 25).collect()}
    assert got == want and {x[1] for x in want.values()} == {"trough", "lowest"}


def test_peak_troughs_of_one_long_key(spark):
    df = spark.range(160_000).select(F.lit("a").alias("k"), F.col("id").alias("i"), (F.sin(F.col("id") / 20) * 100).alias("y"))
    w = windows.by("k", "i")
    turns = df.withColumn("a", F.lag("y").over(w)).withColumn("b", F.lead("y").over(w))
    start = time.time()
    out = peaks.peak_troughs(df, turns.where("y > a and y > b"), turns.where("y < a and y < b"), "k", "i", "y", 4, 90)
    assert out.count() > 1200 and out.where("end - i between 60 and 66").count() >= out.count() - 1
    assert time.time() - start < 60


def test_peak_first_repetitions(spark):
    y = [300 + 80 * math.cos(2 * math.pi * n / 60) for n in range(300)]
    df = series(spark, {"a": y, "short": y[:29]}).withColumn("v", F.lead("y").over(windows.by("k", "i")))
    df = df.withColumn("v", (F.col("y") - F.coalesce("v", "y")) * 0.03)
    got = [(r["k"], r["start"], r["end"], round(r["rom_cm"], 3), r["mcv"] > 0) for r in peaks.peak_first(df, "k", "i", "y", "v", 30.0, 0.002).orderBy("start").collect()]
    assert got == [("a", s, s + 30, 32.0, True) for s in (60, 120, 180, 240)]


def test_traces_say_why(spark):
    v = [0, -0.2, -0.2, 0, 0.3, 0.3, 0, 0, 0, -0.2, 0, 0.3, 0, 0, 0, 0]
    y = list(np.cumsum(v))
    df = spark.createDataFrame([("a", i, i * 0.1, float(p), float(s)) for i, (p, s) in enumerate(zip(y, v))], "k string, i long, t double, y double, v double")
    got = folds.traced(df, "k", "i", min_s=0.25, min_rom=0.4).orderBy("start").collect()
    assert [(r["start"], r["end"], r["accepted"], r["short"], r["shallow"], r["reason"]) for r in got] == [(3, 6, True, False, False, ""), (10, 12, False, True, True, "dur 0.200<0.25; rom 0.3000<0.4")]


def test_fusion_goes_by_speed_and_wide_boxes(spark):
    rows = [(0, 100.0, 100.0, 20.0, 0.9), (1, 100.0, 110.0, 20.0, 0.5), (2, None, None, None, None), (3, 100.0, 116.0, 20.0, 0.5), (4, 100.0, 300.0, 20.0, 0.5), (5, 100.0, 300.0, 20.0, 0.9), (6, 126.0, 300.0, 20.0, 0.1)]
    df = spark.createDataFrame([("a", *r) for r in rows], "k string, i long, dx double, dy double, dh double, conf double")
    got = tracks.fuse(df, "k", "i").orderBy("i").collect()
    assert [r["state"] for r in got] == ["B", "A", None, "A", "C", "B", "C"]
    y1 = 0.6 * 110 + 0.4 * (100 + 7)
    assert abs(got[1]["speed"] - 7) < 1e-9 and abs(got[1]["cy"] - y1) < 1e-9 and abs(got[2]["speed"] - 4.2) < 1e-9
    assert abs(got[3]["cy"] - (0.6 * 116 + 0.4 * (y1 + 4.2 * 2))) < 1e-9 and got[5]["speed"] == 0 and got[6]["cx"] == 100.0


def test_repaired_rules(spark):
    videos = spark.createDataFrame([("a",)] * 10, "c string")
    assert {r["c"]: r["n"] for r in sampling.category_quotas(videos, "c", {"a": 4, "none": 6}, 100).collect()} == {"a": 100, "none": 5}
    assert {r["n"] for r in sampling.category_quotas(videos.limit(0), "c", {"a": 4}, 100).collect()} == {5}
    b = boxes(spark, [("a", 0, 0, 10.0, 10.0, 8.0, None), ("a", 0, 1, 10.0, 10.0, 8.0, 0.9)])
    assert [r["pos"] for r in matching.suppress(b, "f", 0.3).collect()] == [1]
    moved = spark.createDataFrame([("k", n, t, 10.0 * n if t and n < 50 else float(n) if not t and n >= 50 else 0.0, 0.5) for n in range(60) for t in (0, 1)], "k string, n long, track long, cy double, conf double")
    assert tracks.moving_track(moved, "k", 5, "n").first()["track"] == 1 and tracks.moving_track(moved, "k", 5, "n", window=9).first()["track"] == 0
    nan = spark.createDataFrame([(float("nan"), 0, 1.0), (float("nan"), 1, 3.0), (2.0, 0, 5.0), (None, 0, 7.0)], "k double, i long, y double")
    got = sorted((str(r["k"]), r["i"], round(r["average"], 6)) for r in folds.decayed(nan, "k", "i", "y").collect())
    assert got == [("2.0", 0, 5.0), ("None", 0, 7.0), ("nan", 0, 1.0), ("nan", 1, 2.4)]


def test_motion_scores_and_video_checks(spark):
    from kinetia.functions import columns as C

    df = spark.createDataFrame([("a", i, [float(i % 4), 2.0]) for i in range(40)] + [("b", 0, [1.0]), ("a", 40, None)], "k string, i long, v array<float>")
    assert {(r["i"], r["motion"]) for r in windows.motion_scores(df, "k", "i", "v", 5).collect()} == {(i, 0.5 if i % 4 else 1.5) for i in range(5, 40, 5)} | {(40, None)}
    meta = spark.createDataFrame([(25.0, 30), (0.0, 29), (float("nan"), None), (None, 900), (500.0, 31)], "fps double, n int")
    out = meta.select(C.usable_fps(F.col("fps")), C.video_error(F.col("n")), C.usable_fps(F.col("fps"), high=240.0)).collect()
    assert [tuple(r) for r in out] == [(25.0, None, 25.0), (30.0, "VIDEO_ERROR", 30.0), (30.0, "VIDEO_ERROR", 30.0), (30.0, None, 30.0), (500.0, None, 30.0)]
    times = spark.createDataFrame([(0.5, 3), (0.0, 3), (None, 6)], "pts double, i long").select(C.frame_time(F.col("pts"), F.col("i"), F.lit(30.0)))
    assert [r[0] for r in times.collect()] == [0.5, 0.1, 0.2]
