import math
from statistics import median

import numpy as np
import pytest

from pyspark.sql import functions as F

from kinetia.operators import folds, metrics, peaks, splines
from kinetia.plans import pipelines
from kinetia.sources import testdata
from tests.test_operators import plain_peaks

SETUP = pipelines.Setup(fps=30.0, scale=0.002)


def plain_savgol(y, window, degree):
    out, n = [], len(y)
    for i in range(n):
        a = min(max(i - window // 2, 0), n - window)
        out.append(np.polynomial.Polynomial.fit(np.arange(a, a + window), y[a : a + window], degree)(i))
    return np.array(out)


def plain_fill(y):
    at = [i for i, x in enumerate(y) if x is not None]
    return np.interp(np.arange(len(y)), at, [y[i] for i in at])


def plain_reps(y, v, fps=30.0, scale=0.002):
    apart, out = 20, []
    lows = [i for i, _ in plain_peaks(list(-y), 10, 0.0)]
    limit = np.percentile(y, 60)
    for p, _ in plain_peaks(list(y), apart, 12.0):
        later = [t for t in lows if t > p + 4 and y[t] < limit]
        t = later[0] if later else int(np.argmin(y[p : min(p + 90, len(y) - 1) + 1])) + p
        took, rom = (t - p) / fps, abs(y[t] - y[p]) * scale * 100
        if 0.2 <= took <= 7.5 and rom >= 8:
            up = v[p:t][v[p:t] > 0]
            out.append((p, t, up.mean() if len(up) else 0.0, v[p:t].max()))
    return out


def plain_kalman(v):
    x, p, out = 0.0, 1.0, []
    for z in v:
        p += 0.005
        k = p / (p + 0.05)
        x, p = x + k * (z - x), (1 - k) * p
        out.append(x)
    return np.array(out)


def plain_associator(points):
    """Heights and the rows of losses from which the target came back, of one that is first seen at row 0."""
    y, states, seen, anchor, lost = [], [], [], None, None
    for i, at in enumerate(points):
        if anchor is None:
            if at:
                seen.append(at)
            y.append(at and at[1]), states.append("A")
            if len(seen) == 5:
                anchor, seen = (median(a for a, _ in seen), median(b for _, b in seen)), []
        elif lost is None:
            if at and math.dist(at, anchor) < 400:
                anchor = tuple(0.7 * a + 0.3 * b for a, b in zip(at, anchor))
            elif not at:
                lost, held = i, anchor[1]
            y.append(at and at[1]), states.append("T" if at else "LOST")
        elif not at:
            y.append(held), states.append("LOST")
        else:
            y.append(at[1]), states.append("R")
            if i - lost <= 15:
                anchor = tuple(0.5 * a + 0.5 * b for a, b in zip(at, anchor))
            else:
                anchor, seen = None, [at]
            lost = None
    y, bad, run = plain_fill(y), set(), []
    for i, s in enumerate(states):
        if s == "LOST":
            run.append(i)
        else:
            bad |= set(run) if len(run) > 15 else set()
            run = []
    for _ in range(2):
        y = plain_savgol(np.array([sorted((y[max(i - 1, 0)], y[i], y[min(i + 1, len(y) - 1)]))[1] for i in range(len(y))]), 5, 2)
    return y, bad


def videos():
    rng, out = np.random.default_rng(7), {}
    for k in (1, 2, 3):
        points = [(200.0 + float(rng.normal()), 300 + 70 * math.sin(i / (9 + k)) + float(rng.normal())) for i in range(400)]
        for a, n in {1: [(50, 1), (120, 9)], 2: [(100, 3), (215, 30)], 3: [(380, 20)]}[k]:
            points[a : a + n] = [None] * n
        out[k] = points
    return out


def test_named_pipelines_agree_with_plain_ones(spark, tmp_path):
    held = videos()
    rows = [(k, i, *(p or (None, None))) for k, ps in held.items() for i, p in enumerate(ps)] + [(8, i, None, None) for i in range(40)] + [(9, i, 1.0, 50.0 * (i % 2)) for i in range(20)] + [(None, 0, 1.0, 1.0)]
    spark.createDataFrame(rows, "video_id long, idx long, cx double, cy double").write.parquet(f"{tmp_path}/p")
    points = spark.read.parquet(f"{tmp_path}/p")
    reps = pipelines.run(points, SETUP).persist()
    got = {}
    for r in reps.collect():
        got.setdefault((r["pipeline"], r["video_id"]), []).append((r["start"], r["end"], r["mcv"], r["pv"]))
    assert {k for _, k in got} == {1, 2, 3} and {p for p, _ in got} == set(pipelines.PIPELINES)
    for k, ps in held.items():
        y = plain_fill([p and p[1] for p in ps])
        v = -np.gradient(y) * 30 * 0.002
        own, bad = plain_associator(ps)
        want = {"baseline_sg": plain_reps(y, plain_savgol(v, 15, 3)), "kalman_sg": plain_reps(y, plain_savgol(plain_kalman(v), 11, 2))}
        whole = plain_reps(own, plain_savgol(-np.gradient(own) * 30 * 0.002, 9, 2))
        want["associator"] = [r for r in whole if not bad & set(range(r[0], r[1] + 1))]
        assert k != 2 or len(want["associator"]) < len(whole)
        for name, reps_ in want.items():
            assert len(reps_) > 2 and [tuple(pytest.approx(x, abs=1e-9) for x in r) for r in reps_] == sorted(got[name, k]), (name, k)
        for name in ("subpixel_spline", "global_smoothing"):  # the same places with other speeds
            assert [r[:2] for r in want["baseline_sg"]] == [r[:2] for r in sorted(got[name, k])]
            assert all(abs(a[2] - b[2]) < 0.1 for a, b in zip(want["baseline_sg"], sorted(got[name, k])))
    truth = spark.createDataFrame([(k, n, r[2]) for (p, k), rs in got.items() if p == "kalman_sg" for n, r in enumerate(sorted(rs))], "video_id long, pos int, gt double")
    ranks = {r["pipeline"]: r for r in pipelines.ranking(reps, truth).collect()}
    assert len(ranks) == 5 and [p for p, r in ranks.items() if r["best"]] == ["kalman_sg"] and ranks["kalman_sg"]["rmse"] < 1e-9 < ranks["baseline_sg"]["rmse"]
    assert pipelines.compare(reps, truth).count() == 15


def test_pipelines_read_the_table_once(spark, tmp_path):
    spark.createDataFrame([(1, i, 1.0, float(i % 9)) for i in range(60)], "video_id long, idx long, cx double, cy double").write.parquet(f"{tmp_path}/p")
    points = spark.read.parquet(f"{tmp_path}/p")
    reps = pipelines.run(points, SETUP)
    plan = reps._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan.split("InMemoryRelation")[0].lower() and plan.count("InMemoryRelation") > 2
    with pytest.raises(ValueError):
        pipelines.run(points, SETUP, ("none",))


def exchanges(df):
    """The shuffles of a plan that has run, without those of what is persisted."""
    out, inside = [], None
    for line in df._jdf.queryExecution().executedPlan().toString().split("\n"):
        depth = len(line) - len(line.lstrip(" :+-"))
        if inside is not None and depth > inside:
            continue
        inside = depth if "InMemoryRelation" in line else None
        if "== Initial Plan ==" in line:
            break
        if "Exchange hashpartitioning" in line:
            out.append(line)
    return out


@pytest.fixture
def no_broadcasts(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for c in names:
        spark.conf.set(c, "-1")
    yield
    for c in names:
        spark.conf.unset(c)


def test_signals_are_not_shuffled(spark, tmp_path, no_broadcasts):
    rows = [(k, i, *(p or (None, None))) for k, ps in videos().items() for i, p in enumerate(ps)]
    spark.createDataFrame(rows, "video_id long, idx long, cx double, cy double").write.parquet(f"{tmp_path}/p")
    reps = pipelines.run(pipelines.dealt(spark.read.parquet(f"{tmp_path}/p")), SETUP)
    assert len(reps.collect()) > 20
    # what the two filters return, losses, repetitions next to losses, and the coefficients of the two splines
    assert len(exchanges(reps)) <= 6


def test_folds_leave_dealt_rows_where_they_are(spark):
    df = spark.createDataFrame([(k, i, float(i % 5)) for k in range(9) for i in range(30)] + [(None, 0, 2.0)], "k long, i long, x double")
    out = folds.kalman_scalar(df.repartition(4, "k"), "k", "i", "x", keep="x")
    got = out.collect()
    assert len(exchanges(out)) == 1 and len(got) == 271 and all(r["x"] == r["i"] % 5 for r in got if r["k"] is not None)
    assert [r["filtered"] for r in sorted(got, key=lambda r: r["i"]) if r["k"] == 3] == pytest.approx(plain_kalman([float(i % 5) for i in range(30)]))


def test_splines_of_dealt_rows(spark, no_broadcasts):
    df = spark.createDataFrame([(k, float(i), 9 * math.sin(i / 5 + k)) for k in range(4) for i in range(60)] + [(None, float(i), 1.0 * i) for i in range(9)], "k long, t double, y double").repartition(4, "k").persist()
    at = lambda out: {(r["k"], r["t"]): (r["spline"], r["slope"], r["rss"], r["fits"]) for r in out.collect()}
    whole, own = splines.smoothing_spline(df, "k", "t", "y"), splines.smoothing_spline(df, "k", "t", "y", null_keys=False)
    want, got = at(whole), at(own)
    df.unpersist()
    assert got.keys() == {k for k in want if k[0] is not None} and len(want) == len(got) + 9
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    assert len(exchanges(own)) == 1 < len(exchanges(whole))


def test_repetitions_of_a_key_are_those_of_joins(spark):
    """peak_first takes them in one task; here peaks, troughs and speeds are joined with the signal."""
    rng, rows = np.random.default_rng(11), []
    for k in range(6):
        y = 300 + 70 * np.sin(np.arange(330) / (6 + 2 * k)) + rng.normal(0, 3, 330)
        y = np.round(y) if k % 2 else y  # flat tops and equal lows
        rows += [(k, i, None if k > 3 and i % 41 == 7 else float(y[i]), None if k == 2 and i % 7 else float(rng.normal())) for i in range(330)]
    rows += [(7, i, None, 1.0) for i in range(40)] + [(8, i, 5.0, 1.0) for i in range(40)] + [(9, i, 90.0 * (i % 20 > 9), 1.0) for i in range(29)] + [(None, i, 90.0 * (i % 20 > 9), 1.0) for i in range(99)]
    df = spark.createDataFrame(rows, "k long, i long, y double, v double")
    long = df.where("k != 9")  # 9 has too few rows
    high, low = peaks.peaks(long, "k", "i", "y", 20, 12.0), peaks.peaks(long.withColumn("d", -F.col("y")), "k", "i", "d", 10)
    pairs = peaks.peak_troughs(long, high, low, "k", "i", "y", 4, 90).withColumn("rom", F.abs(F.col("end_value") - F.col("peak_value")) * 0.002 * 100)
    spans = pairs.where("(end - i) / 30D between 0.2 and 7.5 and rom >= 8").select("k", F.col("i").alias("start"), (F.col("end") - 1).alias("end"), "rom", "found")
    v = metrics.rep_velocities(df, spans, "k", "i", "v").select("k", "start", "end", "mcv_pos", "pv")
    want = sorted(spans.join(v, ["k", "start", "end"]).select("k", "start", F.col("end") + 1, "rom", "mcv_pos", "pv", "found").collect())
    got = sorted(peaks.peak_first(df, "k", "i", "y", "v", 30.0, 0.002).select("k", "start", "end", "rom_cm", "mcv", "pv").collect())
    assert {r["found"] for r in want} == {"trough", "lowest"} and {r["k"] for r in want} == set(range(6))
    assert len(got) == len(want) and [tuple(r) for r in got] == [tuple(pytest.approx(x, abs=1e-12) if isinstance(x, float) else x for x in tuple(r)[:6]) for r in want]


def test_first_boxes_are_those_of_place_0(spark, tmp_path):
    rows = [(o, o * 7 % 5, o * 3 % 4, n % 2, float(n), 100.0 * n, 0.01 * n) for o in range(50) for n in range(6, 0, -1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    first, every = testdata.boxes(spark, str(tmp_path), first=True), testdata.boxes(spark, str(tmp_path))
    assert sorted(first.collect()) == sorted(every.where("pos = 0").collect()) and first.columns == every.columns and first.dtypes == every.dtypes
    assert "WindowGroupLimit" in first._jdf.queryExecution().executedPlan().toString()
