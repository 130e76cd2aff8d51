"""Agreement, calibration and coverage figures. All are sums that Spark pre-aggregates."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLDS = (0.05, 0.15, 0.25, 0.35, 0.45, 0.60, 0.75)


def agreement_columns(gt: str = "gt", pred: str = "pred") -> dict[str, Column]:
    """rmse, mae, bias, pearson_r, limits of agreement, and two intraclass correlations of pairs."""
    g, p = F.col(gt), F.col(pred)
    e, n = p - g, F.count("*")
    bias, sd = F.avg(e), F.coalesce(F.stddev_samp(e), F.lit(0.0))
    mean_g, mean_p = F.avg(g), F.avg(p)
    grand = (mean_g + mean_p) / 2
    column_squares = F.sum(((g + p) / 2) * ((g + p) / 2))
    within = F.sum(g * g) - n * mean_g * mean_g + F.sum(p * p) - n * mean_p * mean_p
    between = F.try_divide(column_squares / 2 - grand * grand * n, n - 1)
    mse = within / n
    # the standard two-way, absolute-agreement coefficient of single ratings
    rows = F.try_divide(2 * (column_squares - n * grand * grand), n - 1)
    columns = n * ((mean_g - grand) * (mean_g - grand) + (mean_p - grand) * (mean_p - grand))
    error = F.try_divide(F.sum(g * g) + F.sum(p * p) - 2 * n * grand * grand - rows * (n - 1) - columns, n - 1)
    return {
        "n": n,
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "bias": bias,
        "pearson_r": F.when(n <= 1, 0.0).otherwise(F.corr(g, p)),
        "loa_low": bias - 1.96 * sd,
        "loa_high": bias + 1.96 * sd,
        "icc_ref": F.when((n < 3) | (mse == 0), 0.0).otherwise(F.try_divide(between - mse, between + mse)),
        "icc_2_1": F.when(n < 3, 0.0).otherwise(F.try_divide(rows - error, rows + error + 2 * (columns - error) / n)),
    }


def agreement(pairs: DataFrame, *keys: str) -> DataFrame:
    return pairs.groupBy(*keys).agg(*(c.alias(name) for name, c in agreement_columns().items()))


def ols(pairs: DataFrame) -> DataFrame:
    """gt = slope * pred + intercept."""
    return pairs.agg(F.regr_slope("gt", "pred").alias("slope"), F.regr_intercept("gt", "pred").alias("intercept"), F.regr_r2("gt", "pred").alias("r2"), F.count("*").alias("n"))


def _sums() -> list[Column]:
    g, p = F.col("gt"), F.col("pred")
    return [c.alias(n) for n, c in {"n": F.count("*").cast("double"), "sp": F.sum(p), "sg": F.sum(g), "spp": F.sum(p * p), "spg": F.sum(p * g), "sgg": F.sum(g * g)}.items()]


def leave_one_out(pairs: DataFrame, key: str) -> DataFrame:
    """For each key the line fitted to all others, and its error on the key: totals less the key's own sums, so pairs are read once."""
    own = pairs.groupBy(key).agg(*_sums())
    total = own.agg(*(F.sum(c).alias(f"t_{c}") for c in ("n", "sp", "sg", "spp", "spg", "sgg")))
    df = own.crossJoin(F.broadcast(total))  # one row
    n, sp, sg, spp, spg = (F.col(f"t_{c}") - F.col(c) for c in ("n", "sp", "sg", "spp", "spg"))
    slope = F.try_divide(n * spg - sp * sg, n * spp - sp * sp)
    df = df.where(n >= 2).select(key, "n", *_NAMES, slope.alias("slope"), ((sg - slope * sp) / n).alias("intercept"))
    a, b, m = F.col("slope"), F.col("intercept"), F.col("n")
    sse = F.col("sgg") - 2 * a * F.col("spg") - 2 * b * F.col("sg") + a * a * F.col("spp") + 2 * a * b * F.col("sp") + m * b * b
    return df.select(key, m.cast("long").alias("n"), a, b, F.sqrt(F.greatest(sse, F.lit(0.0)) / m).alias("rmse"))


_NAMES = ("sp", "sg", "spp", "spg", "sgg")


def cluster_bootstrap(pairs: DataFrame, key: str, draws: int = 2000, seed: int = 42) -> DataFrame:
    """Percentile interval of the slope when keys are drawn with replacement. Each key draws its own Poisson(1) count for each
    replicate from a hash, so keys need not be numbered and no task sees them all. A md5 of `seed:key:block` has the draws of four replicates, 32 bits each. A
    partition adds its keys to one matrix of replicates and sends a row a replicate, whatever its number of keys. Keys count as text, a null one as empty."""
    names, limits, term, total = ["n", *_NAMES], [], math.exp(-1), 0.0
    for k in range(8):
        total += term
        limits.append(int(total * 2**32))
        term /= k + 1

    def replicates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((draws, len(names)))
        for batch in batches:
            own = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names])
            for text, row in zip(batch.column("_text").to_pylist(), own):
                bits = b"".join(hashlib.md5(f"{seed}:{text}:{block}".encode()).digest() for block in range((draws + 3) // 4))
                sums += np.searchsorted(limits, np.frombuffer(bits, ">u4")[:draws])[:, None] * row
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(draws)), *(pa.array(c) for c in sums.T)], ["draw", *names])

    own = pairs.groupBy(key).agg(*_sums()).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_text"), *(F.coalesce(c, F.lit(0.0)).alias(c) for c in names))
    parts = int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartition(parts, "_text")  # a row a key, which adaptive plans would take for too small to be dealt out
    s = own.mapInArrow(replicates, ", ".join(["draw long", *(f"{c} double" for c in names)])).groupBy("draw").agg(*(F.sum(c).alias(c) for c in names))
    slope = F.try_divide(F.col("n") * F.col("spg") - F.col("sp") * F.col("sg"), F.col("n") * F.col("spp") - F.col("sp") * F.col("sp"))
    return s.select(slope.alias("slope")).agg(F.percentile("slope", 0.025).alias("low"), F.percentile("slope", 0.975).alias("high"), F.avg("slope").alias("mean"))


def bias_report(pairs: DataFrame) -> DataFrame:
    e, n = F.col("pred") - F.col("gt"), F.count("*")
    se = F.stddev_samp(e) / F.sqrt(n)
    return pairs.agg(n.alias("n"), F.avg(e).alias("bias"), F.stddev_samp(e).alias("sd"), se.alias("se"), F.try_divide(F.avg(e), se).alias("t"), (F.avg(e) - 1.96 * se).alias("low"), (F.avg(e) + 1.96 * se).alias("high"), F.regr_slope("pred", "gt").alias("slope"))


def pooled(pairs: DataFrame, key: str) -> DataFrame:
    """One row over all pairs: keys, pairs, agreement and the standard error of the mean error."""
    e = F.col("pred") - F.col("gt")
    sums = {name: c for name, c in agreement_columns().items() if name != "n"}
    return pairs.agg(F.countDistinct(key).alias("n_keys"), F.count("*").alias("n"), *(c.alias(name) for name, c in sums.items()), (F.stddev_samp(e) / F.sqrt(F.count("*"))).alias("std_error"))


def roll_up(videos: DataFrame) -> DataFrame:
    """videos (status, count_ok, rmse, ms), nulls where there is no pair or time: a row a status (n), each with the totals: videos, right counts and their share, videos with pairs, mean
    and median of their errors, mean time of a frame (0 doesn't count). Statuses are aggregated first; the median alone reads the errors. A null status is one."""
    timed = F.when(F.col("ms") != 0, F.col("ms"))
    by = videos.groupBy("status").agg(F.count("*").alias("n"), F.count_if("count_ok").alias("ok"), F.count("rmse").alias("k"), F.sum("rmse").alias("s"), F.count(timed).alias("kt"), F.sum(timed).alias("st"))
    n, ok, k = F.sum("n"), F.sum("ok"), F.sum("k")
    total = by.agg(n.alias("n_videos"), ok.alias("n_count_ok"), F.try_divide(ok, n).alias("count_accuracy"), k.alias("n_paired"), F.try_divide(F.sum("s"), k).alias("rmse_mean"), F.try_divide(F.sum("st"), F.sum("kt")).alias("ms_mean"))
    one = total.crossJoin(F.broadcast(videos.agg(F.median("rmse").alias("rmse_median"))))  # one row each
    return by.select("status", "n").crossJoin(F.broadcast(one))


def bias_bands(pairs: DataFrame, edges: list[float]) -> DataFrame:
    """Bias by half-open bands of the truth."""
    band = F.lit(None).cast("string")
    for low, high in reversed(list(zip(edges, edges[1:]))):
        band = F.when((F.col("gt") >= low) & (F.col("gt") < high), f"{low}-{high}").otherwise(band)
    e = F.col("pred") - F.col("gt")
    return pairs.withColumn("band", band).where("band is not null").groupBy("band").agg(F.count("*").alias("n"), F.avg(e).alias("bias"), F.sqrt(F.avg(e * e)).alias("rmse"))


def counts(truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """(key, n_gt, n_pred) of all keys that either has."""
    n = truth.groupBy(key).agg(F.count("*").alias("n_gt")).join(pred.groupBy(key).agg(F.count("*").alias("n_pred")), key, "full")
    return n.select(key, *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n_gt", "n_pred")))


def count_check(videos: DataFrame, truth: DataFrame, pred: DataFrame, key: str) -> DataFrame:
    """videos (key, status, bar_only) with n_gt, n_pred, count_ok and false_reject. Counts may differ by one where both have repetitions; a video without
    predictions is right only if its status says that no plate was found and it shows a bare bar; with a plate that is a false rejection (null for others)."""
    n = videos.join(counts(truth, pred, key), key, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("n_gt", "n_pred")})
    both = (F.col("n_gt") > 0) & (F.col("n_pred") > 0)
    refused = (F.col("n_pred") == 0) & (F.col("status") == "NO_PLATE_DETECTED")
    ok = F.when(both, F.abs(F.col("n_pred") - F.col("n_gt")) <= 1).when(refused, F.col("bar_only")).otherwise(False)
    return n.withColumn("count_ok", ok).withColumn("false_reject", F.when(~both & refused, ~F.col("bar_only")))


def golden_check(base: DataFrame, pred: DataFrame, base_status: DataFrame, pred_status: DataFrame, key: str, tolerance: float = 0.005, both_ways: bool = False) -> DataFrame:
    """One row of each predicted video (key, status): compared (it has a baseline), status_match, n_base, n_pred, max_err over the pairs in order (0 without any)
    and pass: equal status, errors within tolerance and at most one repetition too few (both_ways: or too many). Without a baseline pass is null: skipped, not failed."""
    from kinetia.operators.matching import pair_truncate

    worst = pair_truncate(base, pred, key).groupBy(key).agg(F.max(F.abs(F.col("pred") - F.col("gt"))).alias("max_err"))
    n = counts(base, pred, key).withColumnRenamed("n_gt", "n_base")
    df = pred_status.select(key, "status").join(base_status.select(key, F.col("status").alias("_base")), key, "left").join(n, key, "left").join(worst, key, "left")
    df = df.withColumns({"n_base": F.coalesce("n_base", F.lit(0)), "n_pred": F.coalesce("n_pred", F.lit(0)), "max_err": F.coalesce("max_err", F.lit(0.0)), "compared": F.col("_base").isNotNull(), "status_match": F.col("status").eqNullSafe(F.col("_base"))})
    lacking = F.abs(F.col("n_pred") - F.col("n_base")) <= 1 if both_ways else F.col("n_pred") >= F.col("n_base") - 1
    return df.withColumn("pass", F.when(F.col("compared"), F.col("status_match") & (F.col("max_err") <= tolerance) & lacking)).drop("_base", "status")


def golden_totals(checked: DataFrame) -> DataFrame:
    return checked.agg(F.count_if(F.col("pass")).alias("n_pass"), F.count_if(~F.col("pass")).alias("n_fail"), F.count_if(~F.col("compared")).alias("n_skipped"), F.max("max_err").alias("max_err"))


def scale_lock(samples: DataFrame, key: str, order: str, value: str, first: int = 20, diameter: float = 0.45) -> DataFrame:
    """Metres per pixel from the median of the first samples inside the quartile fences, with their mean and coefficient of variation."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    early = samples.withColumn("_n", n).where(F.col("_n") <= first)
    q = early.groupBy(key).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    held = early.join(q, key).where(F.col(value).between(F.col("_q")[0] - 1.5 * iqr, F.col("_q")[1] + 1.5 * iqr))
    return held.groupBy(key).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.avg(value).alias("mean"), F.try_divide(F.stddev_pop(value), F.avg(value)).alias("cv")).withColumn("mpp", F.try_divide(F.lit(diameter), "median"))


def coverage(frames: DataFrame, missed_runs: DataFrame, key: str, detected: Column, present: Column) -> DataFrame:
    """Detection shares of all and of present frames, and the runs of missed ones: longest, of three or more, of five or more."""
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    base = frames.groupBy(key).agg(F.count("*").alias("total"), F.count_if(detected).alias("n_detected"), F.count_if(present).alias("n_present"), F.count_if(detected & present).alias("n_both"))
    gaps = missed_runs.groupBy(key).agg(F.max("n").alias("max_gap"), F.count_if(F.col("n") >= 3).alias("track_loss"), F.count_if(F.col("n") >= 5).alias("critical"))
    return base.join(gaps, key, "left").select(key, "total", "n_detected", "n_present", share(F.col("n_detected"), F.col("total")).alias("vdr"), share(F.col("n_both"), F.col("n_present")).alias("vdr_present"), *(F.coalesce(c, F.lit(0)).alias(c) for c in ("max_gap", "track_loss", "critical")))


def confidence_curve(frames: DataFrame, conf: str) -> DataFrame:
    """Share of frames at or above each threshold; frames without a detection count as 0. One pass."""
    c = F.coalesce(F.col(conf), F.lit(0.0))
    shares = frames.agg(*(F.avg(F.when(c >= t, 1.0).otherwise(0.0)).alias(str(t)) for t in THRESHOLDS))
    return shares.select(F.explode(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"`{t}`").alias("share")) for t in THRESHOLDS))).alias("x")).select("x.*")


def jump_summary(marked: DataFrame, key: str) -> DataFrame:
    """Counts of jumps; a jump of both kinds counts for either and for both."""
    j = F.col("jump")
    return marked.groupBy(key).agg(F.count(j).alias("total"), F.count_if(j.contains("POS")).alias("pos"), F.count_if(j.contains("SCALE")).alias("scale"), F.count_if(j == "POS+SCALE").alias("both"))


def velocity_diagnostics(df: DataFrame, key: str, value: str, up: float = 0.01, down: float = -0.01) -> DataFrame:
    """Range, mean and deviation of a value, how often it is above up and below down, and how often it misses."""
    v = F.col(value)
    return df.groupBy(key).agg(F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count_if(v > up).alias("n_up"), F.count_if(v < down).alias("n_down"), F.count_if(v.isNull()).alias("n_missing"))


def coverage_gate(covered: DataFrame, key: str) -> DataFrame:
    """covered: coverage() with n_jumps. jump_rate (of detected frames), and whether the video passes: present frames found, no critical gap, few jumps."""
    rate = F.when(F.col("n_detected") > 0, F.col("n_jumps") / F.col("n_detected")).otherwise(0.0)
    return covered.withColumn("jump_rate", rate).withColumn("pass_all", (F.col("vdr_present") >= 0.995) & (F.col("critical") == 0) & (F.col("jump_rate") <= 0.005))


def coverage_summary(gated: DataFrame) -> DataFrame:
    """Of a data set: means and extremes of the coverage, gaps, jumps, and how many videos are whole, kept and passed."""
    c = F.col
    return gated.agg(
        F.count("*").alias("n_videos"), F.avg("vdr").alias("vdr_mean"), F.min("vdr").alias("vdr_min"), F.avg("vdr_present").alias("vdr_present_mean"), F.min("vdr_present").alias("vdr_present_min"),
        F.max("max_gap").alias("max_gap_max"), F.avg("max_gap").alias("max_gap_mean"), F.sum("track_loss").alias("track_loss_total"), F.count_if(c("track_loss") > 0).alias("track_loss_videos"),
        F.sum("critical").alias("critical_total"), F.count_if(c("critical") > 0).alias("critical_videos"), F.sum("n_jumps").alias("jumps_total"), F.avg("jump_rate").alias("jump_rate_mean"), F.max("jump_rate").alias("jump_rate_max"),
        F.count_if(c("vdr") == 1).alias("full_coverage"), F.count_if(c("track_loss") == 0).alias("no_track_loss"), F.count_if("pass_all").alias("n_pass"),
    )


def detection_baseline(frames: DataFrame, key: str, position: str, least: float = 0.95) -> DataFrame:
    """Share of frames with a position, how many lack one, the positions' span, and whether the share is enough."""
    share = F.count(position) / F.count("*")
    return frames.groupBy(key).agg(share.alias("share"), F.count_if(F.col(position).isNull()).alias("n_missing"), (F.max(position) - F.min(position)).alias("span"), (share >= least).alias("pass"))


def mode_summary(rows: DataFrame, mode: str, *values: str) -> DataFrame:
    """Means of values by mode, nulls apart, and the numbers of rows."""
    return rows.groupBy(mode).agg(F.count("*").alias("n"), *(F.avg(v).alias(f"mean_{v}") for v in values))


def video_errors(by_video: DataFrame, limit: float = 2.0) -> DataFrame:
    """by_video (rmse, null without pairs): mean and median of the errors, how many there are, pass the limit or lack."""
    return by_video.agg(F.avg("rmse").alias("mean"), F.median("rmse").alias("median"), F.count("rmse").alias("n"), F.count_if(F.col("rmse") <= limit).alias("passed"), F.count_if(F.col("rmse").isNull()).alias("no_pred"))


def worst(by_video: DataFrame, key: str, k: int = 3) -> DataFrame:
    return by_video.where("rmse is not null").orderBy(F.desc("rmse"), key).limit(k)


def track_diagnostics(points: DataFrame, key: str) -> DataFrame:
    """points (source, ncc): each source's number of frames, the share of frames with one, and the mean of positive match scores."""
    n = F.count("*")
    named = points.groupBy(key, "source").agg(n.alias("n"), F.sum(F.when(F.col("ncc") > 0, F.col("ncc"))).alias("s"), F.count_if(F.col("ncc") > 0).alias("k"))
    return named.groupBy(key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))))).alias("sources"), (F.sum(F.when(F.col("source").isNotNull(), F.col("n"))) / F.sum("n")).alias("coverage"), F.try_divide(F.sum("s"), F.sum("k")).alias("mean_ncc"))


def stage_profile(times: DataFrame, stage: str, ms: str) -> DataFrame:
    return times.groupBy(stage).agg(F.count(ms).alias("n"), F.avg(ms).alias("mean"), F.stddev_pop(ms).alias("std"), F.min(ms).alias("low"), F.max(ms).alias("high"))


def plain_quartiles(samples: DataFrame, key: str, value: str) -> DataFrame:
    """Quartiles without interpolation: the sorted values at a quarter, half and three quarters of their number, rounded down. By ranks, so no key is gathered."""
    from pyspark.sql import Window

    w = Window.partitionBy(key)
    ranked = samples.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"), (F.row_number().over(w.orderBy(value)) - 1).alias("_r"), F.count("*").over(w).alias("_n"))
    at = lambda k: F.max(F.when(F.col("_r") == F.floor(F.col("_n") * k / 4), F.col("_v")))
    return ranked.groupBy(key).agg(at(1).alias("q1"), at(2).alias("median"), at(3).alias("q3"))


def state_shares(states: DataFrame, key: str) -> DataFrame:
    """Frames of an association that are tracked, lost and anchoring, and the share that is tracked."""
    s = F.col("state")
    n = {"n_tracking": F.count_if(s.isin("TRACKING", "RECOVERED")), "n_lost": F.count_if(s == "LOST"), "n_anchoring": F.count_if(s.isin("ANCHORING", "DRIFTED"))}
    return states.groupBy(key).agg(*(c.alias(k) for k, c in n.items()), (n["n_tracking"] / F.count("*")).alias("coverage"))


def rep_velocities(points: DataFrame, reps: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """reps (key, start, end) with the mean, the mean of positive, the middle and the largest velocity of their rows. An equi-join on buckets."""
    size = 256
    cut = reps.select(key, "start", "end", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor(F.col("end") / size))).alias("_b"))
    p = points.select(key, F.col(order).alias("_i"), F.col(value).alias("_v"), F.floor(F.col(order) / size).alias("_b"))
    inside = cut.join(p, [key, "_b"]).where(F.col("_i").between(F.col("start"), F.col("end")))
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    up = F.when(F.col("_v") > 0, F.col("_v"))
    return inside.groupBy(key, "start", "end").agg(F.avg("_v").alias("mcv"), F.coalesce(F.avg(up), F.lit(0.0)).alias("mcv_pos"), F.max(F.when(F.col("_i") == middle, F.col("_v"))).alias("mcv_mid"), F.max("_v").alias("pv"))


def percentiles(df: DataFrame, key: str, value: str, points: tuple[int, ...] = (10, 50, 90)) -> DataFrame:
    return df.groupBy(key).agg(*(F.percentile(value, p / 100).alias(f"p{p}") for p in points))
