"""Registered queries of audits, reports, samples and splits, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetia.operators import metrics, sampling
from kinetia.plans.queries import AGREE, ORACLES, RUNS, coverage_metrics, error_runs, jump_summary, pairs, query, rounded
from kinetia.sources.testdata import FRAMES, PAIRS, VIDEOS, frames, predictions, table, truth, videos

GATED = f"""WITH c AS ({ORACLES['coverage_metrics']}), j AS ({ORACLES['jump_summary']}), g AS (SELECT c.*, j.total AS n_jumps, CASE WHEN n_detected > 0 THEN j.total / n_detected ELSE 0 END AS jump_rate FROM c JOIN j USING (video_id)),
p AS (SELECT *, vdr_present >= 0.995 AND critical = 0 AND jump_rate <= 0.005 AS pass_all FROM g)"""


def gated(spark, d):
    # rounded as reports are, so that means of shares agree
    covered = coverage_metrics(spark, d).join(jump_summary(spark, d).select("video_id", F.col("total").alias("n_jumps")), "video_id")
    return metrics.coverage_gate(covered, "video_id")


@query(f"{GATED} SELECT video_id, n_jumps, round(jump_rate, 6) AS jump_rate, pass_all FROM p")
def coverage_gate(spark, d):
    return rounded(gated(spark, d).select("video_id", "n_jumps", "jump_rate", "pass_all"))


@query(f"""{GATED} SELECT count(*) AS n_videos, round(avg(vdr), 6) AS vdr_mean, min(vdr) AS vdr_min, round(avg(vdr_present), 6) AS vdr_present_mean, min(vdr_present) AS vdr_present_min, max(max_gap) AS max_gap_max, round(avg(max_gap), 6) AS max_gap_mean, CAST(sum(track_loss) AS BIGINT) AS track_loss_total, count(*) FILTER (track_loss > 0) AS track_loss_videos,
CAST(sum(critical) AS BIGINT) AS critical_total, count(*) FILTER (critical > 0) AS critical_videos, CAST(sum(n_jumps) AS BIGINT) AS jumps_total, round(avg(jump_rate), 6) AS jump_rate_mean, round(max(jump_rate), 6) AS jump_rate_max, count(*) FILTER (vdr = 1) AS full_coverage, count(*) FILTER (track_loss = 0) AS no_track_loss, count(*) FILTER (pass_all) AS n_pass FROM p""")
def coverage_summary(spark, d):
    return rounded(metrics.coverage_summary(gated(spark, d)))


BY_VIDEO = f"""WITH {PAIRS}, v AS (SELECT c_custkey AS video_id, m.rmse FROM customer LEFT JOIN (SELECT video_id, sqrt(avg((pred - gt) * (pred - gt))) AS rmse FROM pairs GROUP BY 1) m ON m.video_id = c_custkey)"""


def by_video(spark, d):
    return videos(spark, d).select("video_id").join(metrics.agreement(pairs(spark, d), "video_id").select("video_id", "rmse"), "video_id", "left")


@query(f"{BY_VIDEO} SELECT round(avg(rmse), 6) AS mean, round(median(rmse), 6) AS median, count(rmse) AS n, count(*) FILTER (rmse <= 2.0) AS passed, count(*) FILTER (rmse IS NULL) AS no_pred FROM v")
def video_errors(spark, d):
    return rounded(metrics.video_errors(by_video(spark, d)))


@query(f"{BY_VIDEO} SELECT video_id, round(rmse, 6) AS rmse FROM v WHERE rmse IS NOT NULL ORDER BY rmse DESC, video_id LIMIT 3")
def worst_videos(spark, d):
    return rounded(metrics.worst(by_video(spark, d), "video_id"))


@query(f"WITH {FRAMES} SELECT video_id, round(count(y) / count(*), 6) AS share, count(*) FILTER (y IS NULL) AS n_missing, round(max(y) - min(y), 6) AS span, count(y) / count(*) >= 0.75 AS pass FROM f GROUP BY 1")
def detection_baseline(spark, d):
    return rounded(metrics.detection_baseline(frames(spark, d), "video_id", "y", 0.75))


@query(f"WITH {FRAMES} SELECT kind, count(*) AS n, round(avg(y), 6) AS mean_y, round(avg(conf), 6) AS mean_conf FROM f GROUP BY 1")
def mode_summary(spark, d):
    return rounded(metrics.mode_summary(frames(spark, d), "kind", "y", "conf"))


@query(f"WITH {FRAMES} SELECT kind, count(conf) AS n, round(avg(conf), 6) AS mean, round(stddev_pop(conf), 6) AS std, round(min(conf), 6) AS low, round(max(conf), 6) AS high FROM f GROUP BY 1")
def stage_profile(spark, d):
    return rounded(metrics.stage_profile(frames(spark, d), "kind", "conf"))


@query(f"""WITH {FRAMES}, s AS (SELECT video_id, kind, count(*) AS n, sum(conf) FILTER (conf > 0) AS s, count(*) FILTER (conf > 0) AS k FROM f GROUP BY 1, 2), t AS (SELECT video_id, sum(n) FILTER (kind <> 'error') / sum(n) AS coverage, sum(s) / sum(k) AS ncc FROM s GROUP BY 1)
SELECT video_id, kind AS source, n, round(coverage, 6) AS coverage, round(ncc, 6) AS mean_ncc FROM s JOIN t USING (video_id) WHERE kind <> 'error'""")
def track_diagnostics(spark, d):
    points = frames(spark, d).select("video_id", F.when(F.col("kind") != "error", F.col("kind")).alias("source"), F.col("conf").alias("ncc"))
    return rounded(metrics.track_diagnostics(points, "video_id").select("video_id", F.explode("sources").alias("source", "n"), "coverage", "mean_ncc"))


@query(f"WITH {FRAMES}, r AS (SELECT video_id, list_sort(list(y)) AS v FROM f WHERE y IS NOT NULL GROUP BY 1) SELECT video_id, round(v[1 + len(v) // 4], 6) AS q1, round(v[1 + len(v) // 2], 6) AS median, round(v[1 + 3 * len(v) // 4], 6) AS q3 FROM r")
def plain_quartiles(spark, d):
    return rounded(metrics.plain_quartiles(frames(spark, d), "video_id", "y"))


@query(f"WITH {FRAMES} SELECT kind, round(quantile_cont(conf, 0.1), 6) AS p10, round(quantile_cont(conf, 0.5), 6) AS p50, round(quantile_cont(conf, 0.9), 6) AS p90 FROM f GROUP BY 1")
def brightness_percentiles(spark, d):
    return rounded(metrics.percentiles(frames(spark, d), "kind", "conf"))


@query("SELECT round(sum(n_chars / 1048576), 6) AS total_mb, count(*) FILTER (n_chars / 1048576 > 0.01) AS n_over, sum(n_chars / 1048576) > 1.0 AS over FROM documents")
def size_audit(spark, d):
    return rounded(sampling.size_audit(table(spark, d, "documents"), "n_chars", 0.01, 1.0))


# --- samples and splits


@query(f"""WITH {FRAMES}, v AS (SELECT DISTINCT video_id FROM f) SELECT video_id, CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', video_id, 42)), video_id) <= floor(count(*) OVER () * 0.85) THEN 'train' ELSE 'val' END AS split FROM v""")
def split_videos(spark, d):
    return sampling.split_videos(frames(spark, d), "video_id")


@query(f"""WITH {FRAMES} SELECT video_id, idx, CASE WHEN row_number() OVER (PARTITION BY video_id ORDER BY md5(concat_ws(':', video_id, idx, 42)), idx) <= floor(count(*) OVER (PARTITION BY video_id) * 0.85) THEN 'train' ELSE 'val' END AS split FROM f""")
def split_frames(spark, d):
    return sampling.split_frames(frames(spark, d), "video_id", "idx")


@query(f"""WITH {FRAMES}, v AS (SELECT video_id, count(*) AS size FROM f GROUP BY 1), n AS (SELECT video_id, greatest(1, CAST(round_even(size / (SELECT sum(size) FROM v) * 1500, 0) AS BIGINT)) AS n FROM v), s AS (SELECT sum(n) AS s FROM n),
o AS (SELECT video_id, n, s, row_number() OVER (ORDER BY n DESC, video_id) AS k, coalesce(sum(n - 1) OVER (ORDER BY n <= 1, n, video_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n, s)
SELECT video_id, CAST(n + CASE WHEN k = 1 THEN greatest(0, 1500 - 5 - s) ELSE 0 END - greatest(0, least(n - 1, greatest(0, s - 1505) - before)) AS BIGINT) AS n FROM o""")
def proportional_frames(spark, d):
    v = frames(spark, d).groupBy("video_id").agg(F.count("*").alias("size"))
    return sampling.proportional(v, "video_id", "size", 1500)


@query("""WITH n AS (SELECT category, frames * (SELECT count(*) FROM customer WHERE c_mktsegment = category) AS v FROM (VALUES ('BUILDING', 6), ('MACHINERY', 2), ('FURNITURE', 2), ('NOWHERE', 4)) x(category, frames))
SELECT category, CAST(greatest(5, trunc(v * (400.0::DOUBLE / (SELECT sum(v) FROM n)))) AS BIGINT) AS n FROM n""")
def category_quotas(spark, d):
    return sampling.category_quotas(table(spark, d, "customer").select(F.col("c_mktsegment").alias("category")), "category", {"BUILDING": 6, "MACHINERY": 2, "FURNITURE": 2, "NOWHERE": 4}, 400)


@query(f"""WITH {FRAMES}, u AS (SELECT video_id, idx, idx % 5 = 0 AS r, kind = 'purchase' AS b, count(*) OVER (PARTITION BY video_id) AS n FROM f)
SELECT video_id, idx, CASE WHEN NOT b THEN '' WHEN r THEN '_RB' ELSE '_BOTTOM' END AS tag FROM u WHERE (r OR b) AND idx >= 5 AND idx <= n - 5""")
def tagged_frames(spark, d):
    f = sampling.inner(frames(spark, d), "video_id", "idx")
    return sampling.flagged_union(sampling.every(f, "idx", 5), f.where("kind = 'purchase'"), ["video_id", "idx"])


@query(f"""WITH {FRAMES} SELECT video_id, idx, round(conf, 6) AS energy FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY conf, idx) AS k, count(*) OVER (PARTITION BY video_id) AS n FROM f WHERE kind = 'purchase') WHERE n <= 12 OR k <= 6""")
def quietest_frames(spark, d):
    f = frames(spark, d).where("kind = 'purchase'").select("video_id", "idx", F.col("conf").alias("energy"))
    return rounded(sampling.quietest(f, "video_id", "idx", "energy", 6))


@query(f"""WITH RECURSIVE {FRAMES}, m AS (SELECT video_id, median(conf) AS m FROM f GROUP BY 1), l AS (SELECT f.video_id, idx, conf, m, min(conf) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS a, min(conf) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS b, count(*) OVER (PARTITION BY f.video_id) AS n FROM f JOIN m USING (video_id) WHERE m <> 0 WINDOW w AS (PARTITION BY f.video_id ORDER BY idx)),
c AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS k FROM l WHERE idx >= 3 AND idx < n - 3 AND conf <= a AND conf <= b AND conf / m < 0.6),
t AS (SELECT video_id, idx, k, idx AS last, true AS kept FROM c WHERE k = 1 UNION ALL SELECT c.video_id, c.idx, c.k, CASE WHEN c.idx - last >= 3 THEN c.idx ELSE last END, c.idx - last >= 3 FROM t JOIN c ON c.video_id = t.video_id AND c.k = t.k + 1)
SELECT video_id, idx FROM t WHERE kept""")
def low_points(spark, d):
    return sampling.low_points(frames(spark, d), "video_id", "idx", "conf", 3)


@query(f"""WITH {RUNS}, p AS (SELECT unnest([1.0, 2.0, 3.0]::DOUBLE[]) AS value), n AS (SELECT value, video_id, count(*) AS n FROM r JOIN p ON r.n >= value GROUP BY 1, 2), b AS (SELECT video_id, count(*) AS base FROM r WHERE n >= 2 GROUP BY 1), k AS (SELECT value, video_id FROM n UNION SELECT value, video_id FROM b, p)
SELECT value, video_id, coalesce(n, 0) AS n, coalesce(base, 0) AS base, coalesce(n, 0) <> coalesce(base, 0) AS changed FROM k LEFT JOIN n USING (value, video_id) LEFT JOIN b USING (video_id)""")
def sensitivity_sweep(spark, d):
    runs = error_runs(spark, d)
    count = lambda v: runs.where(F.col("n") >= v).groupBy("video_id").agg(F.count("*").alias("n"))
    return sampling.sweep(count(2), "video_id", [1.0, 2.0, 3.0], count)


@query(f"WITH {PAIRS} SELECT a.policy, {AGREE} FROM (SELECT 'truncate' AS policy, video_id, gt, pred FROM pairs UNION ALL SELECT 'equal_count', video_id, gt, pred FROM pairs WHERE video_id IN (SELECT video_id FROM (SELECT video_id, count(*) AS n FROM g GROUP BY 1) JOIN (SELECT video_id, count(*) AS n FROM p GROUP BY 1) USING (video_id, n))) a GROUP BY 1")
def policies(spark, d):
    from kinetia.plans import engine
    from kinetia.sources.testdata import predictions, truth

    out = None
    for p in ("truncate", "equal_count"):
        part = engine.evaluate(predictions(spark, d), truth(spark, d), p).drop("icc_ref", "icc_2_1").withColumn("policy", F.lit(p))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query(f"""WITH {PAIRS}, e AS (SELECT *, pred - gt AS e FROM pairs) SELECT count(DISTINCT video_id) AS n_keys, count(*) AS n, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(avg(e), 6) AS bias, round(corr(gt, pred), 6) AS pearson_r, round(stddev_samp(e) / sqrt(count(*)), 6) AS std_error FROM e""")
def pooled_agreement(spark, d):
    return rounded(metrics.pooled(pairs(spark, d), "video_id").select("n_keys", "n", "rmse", "mae", "bias", "pearson_r", "std_error"))


@query(f"""WITH {PAIRS}, {VIDEOS}, c AS (SELECT v.*, coalesce((SELECT count(*) FROM g WHERE g.video_id = v.video_id), 0) AS a, coalesce((SELECT count(*) FROM p WHERE p.video_id = v.video_id), 0) AS b FROM vids v),
r AS (SELECT video_id, sqrt(avg((pred - gt) * (pred - gt))) AS rmse FROM pairs GROUP BY 1), x AS (SELECT status, CASE WHEN a > 0 AND b > 0 THEN abs(a - b) <= 1 WHEN b = 0 AND status = 'NO_PLATE_DETECTED' THEN bar_only ELSE false END AS ok, rmse, nullif(video_id % 7, 0) AS ms FROM c LEFT JOIN r USING (video_id)),
t AS (SELECT count(*) AS n_videos, count(*) FILTER (ok) AS n_count_ok, round(count(*) FILTER (ok) / count(*), 6) AS count_accuracy, count(rmse) AS n_paired, round(avg(rmse), 6) AS rmse_mean, round(avg(ms), 6) AS ms_mean, round(median(rmse), 6) AS rmse_median FROM x)
SELECT s.status, s.n, t.* FROM (SELECT status, count(*) AS n FROM x GROUP BY 1) s, t""")
def benchmark_roll_up(spark, d):
    v = metrics.count_check(videos(spark, d), truth(spark, d), predictions(spark, d), "video_id")
    v = v.join(metrics.agreement(pairs(spark, d), "video_id").select("video_id", "rmse"), "video_id", "left")
    return rounded(metrics.roll_up(v.withColumn("ms", (F.col("video_id") % 7).cast("double"))))
