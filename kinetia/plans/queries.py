"""Registered queries: operators over the driver's tables, each with the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinetia.functions import columns as C
from kinetia.operators import folds, matching, metrics, sampling, windows
from kinetia.plans import engine
from kinetia.sources.testdata import BOXES, FRAMES, PAIRS, VIDEOS, boxes, frames, predictions, table, truth, videos

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def halves_away(c: Column, digits: int) -> Column:
    """A double rounded as SQL's round does it, in binary: F.round goes by its decimal form, so ties would differ."""
    scaled = c * 10.0**digits
    near = F.signum(c) * F.floor(F.abs(scaled) + 0.5) / 10.0**digits
    return F.when(F.abs(scaled) < 2.0**52, near).otherwise(F.rint(scaled) / 10.0**digits)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums differ in their last place with their order, so doubles are compared rounded. Counts are longs."""
    return df.select(*(halves_away(F.col(c), digits).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return matching.pair_truncate(truth(spark, d), predictions(spark, d), "video_id")


# --- matching


@query(f"WITH {PAIRS} SELECT video_id, pos, round(gt, 10) AS gt, round(pred, 10) AS pred FROM pairs")
def pair_truncate(spark, d):
    return rounded(pairs(spark, d), 10)  # hundredths over 1e5: rounding at six places would meet ties


@query(f"""WITH {PAIRS}, n AS (SELECT video_id FROM (SELECT video_id, count(*) AS n FROM g GROUP BY 1) JOIN (SELECT video_id, count(*) AS n FROM p GROUP BY 1) USING (video_id, n))
SELECT video_id, pos, round(gt, 10) AS gt, round(pred, 10) AS pred FROM pairs WHERE video_id IN (SELECT video_id FROM n)""")
def pair_equal_count(spark, d):
    return rounded(matching.pair_equal_count(truth(spark, d), predictions(spark, d), "video_id"), 10)  # hundredths over 1e5: rounding at six places would meet ties


@query(f"""WITH RECURSIVE {PAIRS}, k AS (SELECT video_id, CAST(-1 AS BIGINT) AS pos, NULL::DOUBLE AS gt, NULL::DOUBLE AS pred, list(pred ORDER BY pos) AS free FROM p GROUP BY 1
UNION ALL SELECT video_id, pos, gt, free[hit], list_filter(free, lambda x, i: i <> hit) FROM (SELECT k.video_id, g.pos, g.gt, k.free, list_position(list_transform(k.free, lambda x: abs(x - g.gt)), list_min(list_transform(k.free, lambda x: abs(x - g.gt)))) AS hit
 FROM k JOIN g ON g.video_id = k.video_id AND g.pos = k.pos + 1 WHERE len(k.free) > 0))
SELECT video_id, pos, round(gt, 10) AS gt, round(pred, 10) AS pred FROM k WHERE pos >= 0""")
def pair_best_greedy(spark, d):
    return rounded(matching.pair_greedy(truth(spark, d), predictions(spark, d), "video_id"), 10)  # hundredths over 1e5: rounding at six places would meet ties


@query("""SELECT l_orderkey AS frame, l_linenumber AS pos, p_size AS size, coalesce(CASE p_size WHEN 10 THEN 0.4 WHEN 20 THEN 0.5 WHEN 30 THEN 0.6 END, 0.45)::DOUBLE AS diameter FROM lineitem LEFT JOIN part ON p_partkey = l_partkey""")
def spec_lookup_default(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_linenumber").alias("pos"), "l_partkey")
    # the join's size decides: Spark broadcasts part only below spark.sql.autoBroadcastJoinThreshold
    found = li.join(table(spark, d, "part").select("p_partkey", F.col("p_size").alias("size")), F.col("l_partkey") == F.col("p_partkey"), "left")
    return found.select("frame", "pos", "size", C.plate_diameter(F.col("size").cast("string"), {"10": 0.4, "20": 0.5, "30": 0.6}).alias("diameter"))


@query("SELECT c_custkey AS video_id, c_mktsegment AS segment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def blacklist_anti(spark, d):
    bad = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(bad, "c_custkey", "left_anti").select(F.col("c_custkey").alias("video_id"), F.col("c_mktsegment").alias("segment"))


@query("""WITH u AS (SELECT c_custkey AS id, 'files' AS s FROM customer UNION ALL SELECT DISTINCT o_custkey, 'truth' FROM orders UNION ALL SELECT DISTINCT user_id, 'index' FROM events)
SELECT id, CAST(max(CASE WHEN s = 'files' THEN 1 ELSE 0 END) AS BIGINT) AS in_files, CAST(max(CASE WHEN s = 'truth' THEN 1 ELSE 0 END) AS BIGINT) AS in_truth, CAST(max(CASE WHEN s = 'index' THEN 1 ELSE 0 END) AS BIGINT) AS in_index
FROM u GROUP BY id HAVING NOT (in_files = 1 AND in_truth = 1 AND in_index = 1)""")
def three_way_consistency(spark, d):
    ids = {"files": ("customer", "c_custkey"), "truth": ("orders", "o_custkey"), "index": ("events", "user_id")}
    return rounded(matching.differences({k: table(spark, d, t).select(F.col(c).alias("id")) for k, (t, c) in ids.items()}, "id"))


@query(f"WITH {BOXES} SELECT frame, pos, w, h FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY w * h DESC, pos) AS n FROM b) WHERE n = 1")
def max_area_box(spark, d):
    return matching.largest(boxes(spark, d), "frame")


@query(f"WITH {BOXES} SELECT frame, pos, round(conf, 6) AS conf, CAST(n AS BIGINT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, pos) AS n FROM b) WHERE n <= 3")
def topk_boxes(spark, d):
    return rounded(matching.top(boxes(spark, d), "frame", 3).select("frame", "pos", "conf", "n"))


@query(f"""WITH {FRAMES} SELECT video_id, idx, kind FROM (SELECT *, row_number() OVER (PARTITION BY video_id, kind ORDER BY idx) AS n FROM f)
WHERE n <= CASE kind WHEN 'error' THEN 8 WHEN 'view' THEN 4 WHEN 'click' THEN 6 ELSE 0 END""")
def quota_sample(spark, d):
    return matching.quota(frames(spark, d), "video_id", "kind", ["idx"], {"error": 8, "view": 4, "click": 6}).select("video_id", "idx", "kind")


@query(f"""WITH RECURSIVE {BOXES}, o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY conf DESC, pos) AS n FROM b),
k AS (SELECT frame, n, [{{'p': CAST(pos AS BIGINT), 'cx': cx, 'cy': cy, 'w': w, 'h': h}}] AS kept FROM o WHERE n = 1
UNION ALL SELECT o.frame, o.n, CASE WHEN len(list_filter(kept, lambda a: greatest(0.0, least(a.cx + a.w / 2, o.cx + o.w / 2) - greatest(a.cx - a.w / 2, o.cx - o.w / 2)) * greatest(0.0, least(a.cy + a.h / 2, o.cy + o.h / 2) - greatest(a.cy - a.h / 2, o.cy - o.h / 2))
 > 0.2 * (a.w * a.h + o.w * o.h - greatest(0.0, least(a.cx + a.w / 2, o.cx + o.w / 2) - greatest(a.cx - a.w / 2, o.cx - o.w / 2)) * greatest(0.0, least(a.cy + a.h / 2, o.cy + o.h / 2) - greatest(a.cy - a.h / 2, o.cy - o.h / 2))))) > 0 THEN kept
 ELSE list_append(kept, {{'p': CAST(o.pos AS BIGINT), 'cx': o.cx, 'cy': o.cy, 'w': o.w, 'h': o.h}}) END FROM k JOIN o ON o.frame = k.frame AND o.n = k.n + 1),
last AS (SELECT frame, max_by(kept, n) AS kept FROM k GROUP BY 1)
SELECT frame, x.p AS pos FROM (SELECT frame, unnest(kept) AS x FROM last)""")
def nms_keep(spark, d):
    return matching.suppress(boxes(spark, d), "frame", 0.2).select("frame", F.col("pos").cast("long").alias("pos"))


@query(f"WITH {BOXES} SELECT frame, pos, cx, cy FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY (cx - 100) * (cx - 100) + (cy - 50) * (cy - 50), pos DESC) AS n FROM b WHERE (cx - 100) * (cx - 100) + (cy - 50) * (cy - 50) <= 3600) WHERE n = 1")
def nearest_gated(spark, d):
    return matching.nearest(boxes(spark, d), "frame", 100.0, 50.0, 60.0)


def error_runs(spark, d):
    return windows.runs(frames(spark, d), "video_id", "idx", F.col("kind") == "error")


RUNS = f"""{FRAMES}, r AS (SELECT video_id, min(idx) AS "start", max(idx) AS "end", count(*) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY video_id ORDER BY idx) AS g FROM f WHERE kind = 'error') GROUP BY video_id, g)"""


@query(f"""WITH {RUNS} SELECT video_id, idx, kind FROM f WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.video_id = f.video_id AND r.n >= 2 AND f.idx BETWEEN r."start" - 1 AND r."end" + 1)""")
def interval_exclude(spark, d):
    spans = error_runs(spark, d).where("n >= 2").select("video_id", (F.col("start") - 1).alias("start"), (F.col("end") + 1).alias("end"))
    return matching.outside(frames(spark, d), spans, "video_id", "idx").select("video_id", "idx", "kind")


@query(f"""WITH {FRAMES} SELECT video_id, idx FROM f WHERE kind = 'signup' AND NOT EXISTS (SELECT 1 FROM f c WHERE c.video_id = f.video_id AND c.kind = 'purchase' AND abs(c.t - f.t) <= 9000)""")
def proximity_anti(spark, d):
    f = frames(spark, d)
    return matching.far_from(f.where("kind = 'signup'").select("video_id", "idx", "t"), f.where("kind = 'purchase'"), "video_id", "t", 9000.0).select("video_id", "idx")


@query(f"WITH {FRAMES} SELECT video_id, idx, round((SELECT min(c.t) FROM f c WHERE c.video_id = f.video_id AND c.kind = 'purchase' AND c.t > f.t + 60), 6) AS found FROM f WHERE kind = 'signup'")
def forward_asof(spark, d):
    f = frames(spark, d)
    return rounded(matching.asof(f.where("kind = 'signup'").select("video_id", "idx", "t"), f.where("kind = 'purchase'"), "video_id", "t", 60.0).select("video_id", "idx", "found"))


# --- windows

NEAR = f"""{FRAMES}, n AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN idx END) OVER b AS pi, min(CASE WHEN y IS NOT NULL THEN idx END) OVER a AS ni, last_value(y IGNORE NULLS) OVER b AS pv, first_value(y IGNORE NULLS) OVER a AS nv FROM f
WINDOW b AS (PARTITION BY video_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY video_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


@query(f"WITH {NEAR} SELECT video_id, idx, round(coalesce(y, pv + (nv - pv) * (idx - pi) / (ni - pi), pv, nv), 6) AS y FROM n")
def asof_prev_next_fill(spark, d):
    return rounded(windows.interpolate(frames(spark, d), "video_id", "idx", "y").select("video_id", "idx", F.col("y_filled").alias("y")))


@query(f"WITH {NEAR} SELECT video_id, idx, round(coalesce(y, CASE WHEN ni - pi - 1 <= 1 THEN pv + (nv - pv) * (idx - pi) / (ni - pi) END), 6) AS y FROM n")
def small_gap_interp(spark, d):
    return rounded(windows.interpolate(frames(spark, d), "video_id", "idx", "y", max_gap=1).select("video_id", "idx", F.col("y_filled").alias("y")))


@query(f"""WITH {FRAMES}, r AS (SELECT video_id, min(idx) AS "start", max(idx) AS "end", count(*) AS n FROM (SELECT *, idx - row_number() OVER (PARTITION BY video_id ORDER BY idx) AS g FROM f WHERE y IS NOT NULL) GROUP BY video_id, g)
SELECT video_id, "start", "end", n FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, "start") AS k FROM r WHERE n > 3) WHERE k = 1""")
def islands_longest(spark, d):
    return windows.longest_run(frames(spark, d), "video_id", "idx", F.col("y").isNotNull(), 3)


@query(f"""WITH {RUNS} SELECT video_id, "start", "end", n FROM r""")
def missed_islands(spark, d):
    return error_runs(spark, d)


@query(f"""WITH {RUNS}, w AS (SELECT video_id, idx AS "start", idx + 4 AS "end" FROM f WHERE idx % 5 = 0 AND kind <> 'error')
SELECT video_id, "start", "end" FROM w WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.video_id = w.video_id AND r.n >= 2 AND r."start" <= w."end" AND r."end" >= w."start")""")
def lost_run_filter(spark, d):
    f = frames(spark, d)
    w = f.where("idx % 5 = 0 and kind != 'error'").select("video_id", F.col("idx").alias("start"), (F.col("idx") + 4).alias("end"))
    lost = error_runs(spark, d).where("n >= 2")
    return matching.clear_of(w, lost, "video_id")


@query(f"WITH {FRAMES} SELECT video_id, idx, round(CASE WHEN lag(conf) OVER w IS NULL THEN lead(conf) OVER w - conf WHEN lead(conf) OVER w IS NULL THEN conf - lag(conf) OVER w ELSE (lead(conf) OVER w - lag(conf) OVER w) / 2 END, 6) AS gradient FROM f WINDOW w AS (PARTITION BY video_id ORDER BY idx)")
def gradient(spark, d):
    return rounded(windows.gradient(frames(spark, d), "video_id", "idx", "conf").select("video_id", "idx", "gradient"))


@query(f"WITH {FRAMES} SELECT video_id, idx, round(list_sort([coalesce(lag(conf) OVER w, conf), conf, coalesce(lead(conf) OVER w, conf)])[2], 6) AS median3 FROM f WINDOW w AS (PARTITION BY video_id ORDER BY idx)")
def median3(spark, d):
    return rounded(windows.median3(frames(spark, d), "video_id", "idx", "conf").select("video_id", "idx", "median3"))


@query(f"WITH {FRAMES} SELECT video_id, idx, round((-3 * lag(conf, 2) OVER w + 12 * lag(conf) OVER w + 17 * conf + 12 * lead(conf) OVER w - 3 * lead(conf, 2) OVER w) / 35, 6) AS smooth FROM f WINDOW w AS (PARTITION BY video_id ORDER BY idx)")
def sg5_interior(spark, d):
    return rounded(windows.smooth(frames(spark, d), "video_id", "idx", "conf", [x / 35 for x in (-3, 12, 17, 12, -3)]).select("video_id", "idx", "smooth"))


@query(f"WITH {FRAMES} SELECT video_id, idx, CASE WHEN p AND s THEN 'POS+SCALE' WHEN p THEN 'POS' WHEN s THEN 'SCALE' END AS jump FROM (SELECT *, coalesce(ok AND lok AND ls > 0 AND abs(t - lt) / ls > 0.5 * 86400, false) AS p, coalesce(ok AND lok AND ls > 0 AND abs(h - ls) / ls > 0.3, false) AS s FROM (SELECT *, y IS NOT NULL AS ok, coalesce(lag(y IS NOT NULL) OVER w, false) AS lok, lag(t) OVER w AS lt, lag(h) OVER w AS ls FROM (SELECT *, CASE WHEN idx % 7 = 0 THEN 0 ELSE conf END AS h FROM f) WINDOW w AS (PARTITION BY video_id ORDER BY idx)))")
def jump_detect(spark, d):
    f = frames(spark, d).withColumn("h", F.when(F.col("idx") % 7 == 0, 0.0).otherwise(F.col("conf")))  # each seventh has no size
    return windows.jumps(f, "video_id", "idx", "t", "h", F.col("y").isNotNull(), far=0.5 * 86400).select("video_id", "idx", "jump")  # sizes are days, times seconds


@query(f"WITH j AS ({ORACLES['jump_detect']}) SELECT video_id, count(jump) AS total, count(*) FILTER (jump LIKE '%POS%') AS pos, count(*) FILTER (jump LIKE '%SCALE%') AS scale, count(*) FILTER (jump = 'POS+SCALE') AS both FROM j GROUP BY 1")
def jump_summary(spark, d):
    return metrics.jump_summary(jump_detect(spark, d), "video_id")


@query(f"""WITH {FRAMES} SELECT video_id, idx, coalesce(n = 3 AND lo > 0.1, false) AS rises, coalesce(n = 3 AND hi < -0.1, false) AS falls FROM (SELECT video_id, idx, min(conf - 0.5) OVER w AS lo, max(conf - 0.5) OVER w AS hi, count(conf) OVER w AS n FROM f WINDOW w AS (PARTITION BY video_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING))""")
def sustained_lookahead(spark, d):
    df = windows.sustained(frames(spark, d).withColumn("x", F.col("conf") - 0.5), "video_id", "idx", "x", 3, 0.1)
    return df.select("video_id", "idx", *(F.coalesce(c, F.lit(False)).alias(c) for c in ("rises", "falls")))


@query(f"""WITH {BOXES} SELECT frame, pos, CAST(sum(fresh) OVER (PARTITION BY frame ORDER BY cx, pos) AS BIGINT) AS cluster FROM (SELECT *, CASE WHEN cx - lag(cx) OVER (PARTITION BY frame ORDER BY cx, pos) > 50 THEN 1 ELSE 0 END AS fresh FROM b)""")
def single_linkage_1d(spark, d):
    return windows.single_linkage(boxes(spark, d), "frame", "cx", 50.0, "pos").select("frame", "pos", "cluster")


@query(f"""WITH {FRAMES}, e AS (SELECT video_id, idx, kind, conf, lead(kind) OVER w AS k2, lead(idx) OVER w AS i2, lead(conf) OVER w AS c2 FROM f WHERE kind IN ('click', 'view') WINDOW w AS (PARTITION BY video_id ORDER BY idx)),
q AS (SELECT video_id, idx AS "start", i2 AS "end", abs(c2 - conf) AS rom FROM e WHERE kind = 'click' AND k2 = 'view')
SELECT video_id, "start", "end", round(rom, 6) AS rom FROM q JOIN (SELECT video_id, max(rom) AS most FROM q GROUP BY 1) USING (video_id) WHERE rom >= greatest(0.05, 0.45 * most)""")
def event_pairs_two_pass(spark, d):
    e = frames(spark, d).select("video_id", "idx", "kind", F.col("conf").alias("value"))
    found = windows.event_pairs(e, "video_id", "idx", "kind", "click", "view").withColumn("rom", F.abs(F.col("to_value") - F.col("from_value")))
    return rounded(windows.relative_gate(found, "video_id", "rom", 0.45, 0.05).select("video_id", "start", "end", "rom"))


@query(f"WITH {FRAMES} SELECT video_id, idx, was, kind FROM (SELECT *, lag(kind) OVER (PARTITION BY video_id ORDER BY idx) AS was FROM f) WHERE was IS NOT NULL AND kind <> was")
def transition_log(spark, d):
    return windows.transitions(frames(spark, d), "video_id", "idx", "kind").select("video_id", "idx", "was", "kind")


# --- metrics

AGREE = """count(*) AS n, round(sqrt(avg((pred - gt) * (pred - gt))), 6) AS rmse, round(avg(abs(pred - gt)), 6) AS mae, round(avg(pred - gt), 6) AS bias, round(CASE WHEN count(*) <= 1 THEN 0 ELSE corr(gt, pred) END, 6) AS pearson_r,
round(avg(pred - gt) - 1.96 * coalesce(stddev_samp(pred - gt), 0), 6) AS loa_low, round(avg(pred - gt) + 1.96 * coalesce(stddev_samp(pred - gt), 0), 6) AS loa_high"""


@query(f"WITH {PAIRS} SELECT {AGREE} FROM pairs")
def agreement_metrics(spark, d):
    return rounded(metrics.agreement(pairs(spark, d)).drop("icc_ref", "icc_2_1"))


@query(f"WITH {PAIRS} SELECT video_id, {AGREE} FROM pairs GROUP BY 1 HAVING count(*) >= 3")
def agreement_by_video(spark, d):
    return rounded(metrics.agreement(pairs(spark, d), "video_id").drop("icc_ref", "icc_2_1").where("n >= 3"))


@query(f"""WITH {PAIRS}, m AS (SELECT avg(gt) AS mg, avg(pred) AS mp, count(*) AS n FROM pairs),
s AS (SELECT sum((gt - mg) * (gt - mg) + (pred - mp) * (pred - mp)) / any_value(n) AS mse, (sum(((gt + pred) / 2) * ((gt + pred) / 2)) / 2 - any_value((mg + mp) / 2 * (mg + mp) / 2 * n)) / (any_value(n) - 1) AS msr,
 2 * sum(((gt + pred) / 2 - (mg + mp) / 2) * ((gt + pred) / 2 - (mg + mp) / 2)) / (any_value(n) - 1) AS r, any_value(n * ((mg - mp) * (mg - mp) / 2)) AS c, any_value(n) AS n,
 sum((gt - (mg + mp) / 2) * (gt - (mg + mp) / 2) + (pred - (mg + mp) / 2) * (pred - (mg + mp) / 2)) AS total FROM pairs, m)
SELECT round((msr - mse) / (msr + mse), 6) AS icc_ref, round((r - e) / (r + e + 2 * (c - e) / n), 6) AS icc_2_1 FROM (SELECT *, (total - r * (n - 1) - c) / (n - 1) AS e FROM s)""")
def icc(spark, d):
    return rounded(metrics.agreement(pairs(spark, d)).select("icc_ref", "icc_2_1"))


@query(f"WITH {PAIRS} SELECT round(regr_slope(gt, pred), 6) AS slope, round(regr_intercept(gt, pred), 6) AS intercept, round(regr_r2(gt, pred), 6) AS r2, count(*) AS n FROM pairs")
def ols_fit(spark, d):
    return rounded(metrics.ols(pairs(spark, d)))


@query(f"""WITH {PAIRS}, s AS (SELECT video_id, count(*) AS n, sum(pred) AS sp, sum(gt) AS sg, sum(pred * pred) AS spp, sum(pred * gt) AS spg FROM pairs GROUP BY 1), t AS (SELECT sum(n) AS n, sum(sp) AS sp, sum(sg) AS sg, sum(spp) AS spp, sum(spg) AS spg FROM s),
c AS (SELECT video_id, ((t.n - s.n) * (t.spg - s.spg) - (t.sp - s.sp) * (t.sg - s.sg)) / ((t.n - s.n) * (t.spp - s.spp) - (t.sp - s.sp) * (t.sp - s.sp)) AS slope, t.sg - s.sg AS rg, t.sp - s.sp AS rp, t.n - s.n AS rn FROM s, t)
SELECT video_id, count(*) AS n, round(any_value(slope), 5) AS slope, round(any_value((rg - slope * rp) / rn), 5) AS intercept, round(sqrt(avg((gt - slope * pred - (rg - slope * rp) / rn) * (gt - slope * pred - (rg - slope * rp) / rn))), 4) AS rmse FROM pairs JOIN c USING (video_id) GROUP BY 1""")
def lovo_cv(spark, d):
    df = metrics.leave_one_out(pairs(spark, d), "video_id")
    return df.select("video_id", "n", F.round("slope", 5).alias("slope"), F.round("intercept", 5).alias("intercept"), F.round("rmse", 4).alias("rmse"))


POISSON = [1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276]  # of 2^32, the shares of counts 0, at most 1, at most 2 and on


@query(f"""WITH {PAIRS}, o AS (SELECT video_id, count(*)::DOUBLE AS n, sum(pred) AS sp, sum(gt) AS sg, sum(pred * pred) AS spp, sum(pred * gt) AS spg FROM pairs GROUP BY 1),
h AS (SELECT o.*, b, md5('42:' || video_id || ':' || b) AS h FROM o, (SELECT unnest(range(500)) AS b)), u AS (SELECT n, sp, sg, spp, spg, b * 4 + j AS draw, ('0x' || substr(h, 8 * j + 1, 8))::BIGINT AS u FROM h, (SELECT unnest(range(4)) AS j)),
k AS (SELECT *, len(list_filter({POISSON}::BIGINT[], lambda x: u > x)) AS k FROM u), s AS (SELECT draw, sum(n * k) AS n, sum(sp * k) AS sp, sum(sg * k) AS sg, sum(spp * k) AS spp, sum(spg * k) AS spg FROM k GROUP BY 1),
a AS (SELECT (n * spg - sp * sg) / (n * spp - sp * sp) AS slope FROM s) SELECT round(quantile_cont(slope, 0.025), 6) AS low, round(quantile_cont(slope, 0.975), 6) AS high, round(avg(slope), 6) AS mean FROM a""")
def slope_bootstrap(spark, d):
    return rounded(metrics.cluster_bootstrap(pairs(spark, d), "video_id"))


@query(f"WITH {PAIRS} SELECT band, count(*) AS n, round(avg(pred - gt), 6) AS bias, round(sqrt(avg((pred - gt) * (pred - gt))), 6) AS rmse FROM (SELECT *, CASE WHEN gt >= 0 AND gt < 1 THEN '0.0-1.0' WHEN gt >= 1 AND gt < 2 THEN '1.0-2.0' WHEN gt >= 2 AND gt < 9 THEN '2.0-9.0' END AS band FROM pairs) WHERE band IS NOT NULL GROUP BY 1")
def bias_bands(spark, d):
    return rounded(metrics.bias_bands(pairs(spark, d), [0.0, 1.0, 2.0, 9.0]))


@query(f"""WITH {PAIRS}, e AS (SELECT pred - gt AS e, gt, pred FROM pairs) SELECT count(*) AS n, round(avg(e), 6) AS bias, round(stddev_samp(e), 6) AS sd, round(stddev_samp(e) / sqrt(count(*)), 6) AS se, round(avg(e) / (stddev_samp(e) / sqrt(count(*))), 6) AS t,
round(avg(e) - 1.96 * stddev_samp(e) / sqrt(count(*)), 6) AS low, round(avg(e) + 1.96 * stddev_samp(e) / sqrt(count(*)), 6) AS high, round(regr_slope(pred, gt), 6) AS slope FROM e""")
def bias_report(spark, d):
    return rounded(metrics.bias_report(pairs(spark, d)))


@query(f"""WITH {PAIRS}, {VIDEOS}, a AS (SELECT video_id, count(*) AS n_gt FROM g GROUP BY 1), c AS (SELECT video_id, count(*) AS n_pred FROM p GROUP BY 1), n AS (SELECT vids.*, coalesce(n_gt, 0) AS n_gt, coalesce(n_pred, 0) AS n_pred FROM vids LEFT JOIN a USING (video_id) LEFT JOIN c USING (video_id))
SELECT status, count_ok, false_reject, count(*) AS videos FROM (SELECT status, CASE WHEN n_gt > 0 AND n_pred > 0 THEN abs(n_pred - n_gt) <= 1 WHEN n_pred = 0 AND status = 'NO_PLATE_DETECTED' THEN bar_only ELSE false END AS count_ok,
 CASE WHEN n_pred = 0 AND status = 'NO_PLATE_DETECTED' THEN NOT bar_only END AS false_reject FROM n) GROUP BY 1, 2, 3""")
def status_rollup(spark, d):
    return metrics.count_check(videos(spark, d), truth(spark, d), predictions(spark, d), "video_id").groupBy("status", "count_ok", "false_reject").agg(F.count("*").alias("videos"))


@query(f"""WITH {PAIRS}, {VIDEOS}, a AS (SELECT video_id, count(*) AS n_gt FROM g GROUP BY 1), c AS (SELECT video_id, count(*) AS n_pred FROM p GROUP BY 1), w AS (SELECT video_id, max(abs(pred - gt)) AS e FROM pairs GROUP BY 1)
SELECT video_id, base_status IS NOT NULL AS compared, coalesce(n_gt, 0) AS n_base, coalesce(n_pred, 0) AS n_pred, round(coalesce(e, 0), 6) AS max_err, CASE WHEN base_status IS NOT NULL THEN status = base_status AND coalesce(e, 0) <= 1.0 AND coalesce(n_pred, 0) >= coalesce(n_gt, 0) - 1 END AS pass
FROM vids LEFT JOIN a USING (video_id) LEFT JOIN c USING (video_id) LEFT JOIN w USING (video_id)""")
def golden_pass(spark, d):
    v = videos(spark, d)
    base = v.where("base_status is not null").select("video_id", F.col("base_status").alias("status"))
    return rounded(metrics.golden_check(truth(spark, d), predictions(spark, d), base, v, "video_id", 1.0).select("video_id", "compared", "n_base", "n_pred", "max_err", "pass"))


@query(f"SELECT count(*) FILTER (pass) AS n_pass, count(*) FILTER (NOT pass) AS n_fail, count(*) FILTER (NOT compared) AS n_skipped, max(max_err) AS max_err FROM ({ORACLES['golden_pass']})")
def golden_totals(spark, d):
    return metrics.golden_totals(golden_pass(spark, d))


@query(f"""WITH {FRAMES}, s AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS n FROM f) WHERE n <= 20), q AS (SELECT video_id, quantile_cont(conf, 0.25) AS a, quantile_cont(conf, 0.75) AS b FROM s GROUP BY 1)
SELECT video_id, count(*) AS n, round(median(conf), 6) AS median, round(avg(conf), 6) AS mean, round(stddev_pop(conf) / avg(conf), 6) AS cv, round(0.45 / median(conf), 6) AS mpp FROM s JOIN q USING (video_id) WHERE conf BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) GROUP BY 1""")
def iqr_scale_lock(spark, d):
    return rounded(metrics.scale_lock(frames(spark, d), "video_id", "idx", "conf"))


@query(f"""WITH {RUNS}, c AS (SELECT video_id, max(n) AS max_gap, count(*) FILTER (n >= 3) AS track_loss, count(*) FILTER (n >= 5) AS critical FROM r GROUP BY 1)
SELECT video_id, total, n_detected, n_present, round(n_detected / total, 6) AS vdr, round(CASE WHEN n_present = 0 THEN 0 ELSE nb / n_present END, 6) AS vdr_present, coalesce(max_gap, 0) AS max_gap, coalesce(track_loss, 0) AS track_loss, coalesce(critical, 0) AS critical FROM
(SELECT video_id, count(*) AS total, count(*) FILTER (kind <> 'error') AS n_detected, count(*) FILTER (conf > 0.1) AS n_present, count(*) FILTER (kind <> 'error' AND conf > 0.1) AS nb FROM f GROUP BY 1) LEFT JOIN c USING (video_id)""")
def coverage_metrics(spark, d):
    return rounded(metrics.coverage(frames(spark, d), error_runs(spark, d), "video_id", F.col("kind") != "error", F.col("conf") > 0.1))


@query(f"WITH {FRAMES} SELECT threshold, round(avg(CASE WHEN coalesce(y / 5, 0) >= threshold THEN 1.0 ELSE 0.0 END), 6) AS share FROM f, (SELECT unnest([0.05, 0.15, 0.25, 0.35, 0.45, 0.6, 0.75]::DOUBLE[]) AS threshold) GROUP BY 1")
def conf_curve(spark, d):
    return rounded(metrics.confidence_curve(frames(spark, d).withColumn("c", F.col("y") / 5), "c"))


@query(f"WITH {FRAMES} SELECT video_id, round(min(y), 6) AS low, round(max(y), 6) AS high, round(avg(y), 6) AS mean, round(stddev_pop(y), 6) AS std, count(*) FILTER (y > 2.5) AS n_up, count(*) FILTER (y < 1) AS n_down, count(*) FILTER (y IS NULL) AS n_missing FROM f GROUP BY 1")
def velocity_diag(spark, d):
    return rounded(metrics.velocity_diagnostics(frames(spark, d), "video_id", "y", 2.5, 1.0))


SPEC = {"gym": {"min_distinct": 2}, "angle": {"required": {"F", "O", "X"}}, "lighting": {"required": {"F", "O", "P"}, "min_each": 60}, "load_band": {"required": {"light", "medium", "heavy"}}, "device": {"min_distinct": 9}}


@query("""WITH i AS (SELECT nullif(o_orderpriority, '') AS gym, o_orderstatus AS angle, o_totalprice / 2000 AS kg, CASE WHEN o_custkey % 2 = 0 THEN '20kg' END AS plate FROM orders), l AS (SELECT *, CASE WHEN kg <= 40 THEN 'light' WHEN kg >= 100 THEN 'heavy' ELSE 'medium' END AS band FROM i),
r AS (SELECT * FROM (VALUES ('angle', 'F', 1), ('angle', 'O', 1), ('angle', 'X', 1), ('lighting', 'F', 60), ('lighting', 'O', 60), ('lighting', 'P', 60), ('load_band', 'light', 1), ('load_band', 'medium', 1), ('load_band', 'heavy', 1)) t(dimension, v, least)),
c AS (SELECT dimension, v, least, (SELECT count(*) FROM l WHERE CASE WHEN dimension = 'load_band' THEN band ELSE angle END = v) AS n FROM r),
d AS (SELECT 'gym' AS dimension, count(DISTINCT gym) AS n_distinct, 2 AS need FROM l UNION ALL SELECT 'angle', count(DISTINCT angle), 0 FROM l UNION ALL SELECT 'lighting', count(DISTINCT angle), 0 FROM l UNION ALL SELECT 'load_band', count(DISTINCT band), 0 FROM l UNION ALL SELECT 'device', count(DISTINCT gym), 9 FROM l)
SELECT dimension, any_value(n_distinct) AS n_distinct, count(*) FILTER (n = 0) AS n_missing, count(*) FILTER (n > 0 AND n < least) AS n_thin, count(*) FILTER (n < least) = 0 AND any_value(n_distinct) >= any_value(need) AS covered FROM d LEFT JOIN c USING (dimension) GROUP BY 1
UNION ALL SELECT 'small_plate', count(*) FILTER (band = 'light' AND plate NOT IN ('20kg', '25kg', '45lb')), 0, 0, count(*) FILTER (band = 'light') = 0 OR count(*) FILTER (band = 'light' AND plate NOT IN ('20kg', '25kg', '45lb')) > 0 FROM l""")
def holdout_coverage_audit(spark, d):
    s = F.col("o_orderstatus")
    index = table(spark, d, "orders").select(F.col("o_orderpriority").alias("gym"), s.alias("angle"), s.alias("lighting"), F.col("o_orderpriority").alias("device"), (F.col("o_totalprice") / 2000).alias("load_kg"), F.when(F.col("o_custkey") % 2 == 0, "20kg").alias("outer_plate"))
    return sampling.distribution_audit(index, SPEC)


# --- columns and sets


@query("SELECT p_partkey AS id, CASE WHEN p_size * 3 <= 40 THEN 'light' WHEN p_size * 3 >= 100 THEN 'heavy' ELSE 'medium' END AS band FROM part")
def load_bands(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.load_band(F.col("p_size") * 3).alias("band"))


@query("""SELECT id, CAST(regexp_extract(name, '^(\\d+(?:\\.\\d+)?)kg((?:_\\d+\\.\\d+)+)\\.mp4$', 1) AS DOUBLE) AS load_kg, CAST(len(string_split(substring(regexp_extract(name, '^(\\d+(?:\\.\\d+)?)kg((?:_\\d+\\.\\d+)+)\\.mp4$', 2), 2), '_')) AS BIGINT) AS n_reps
FROM (SELECT p_partkey AS id, concat(p_size, 'kg_0.', p_partkey % 10, '5_1.', p_partkey % 7, '0.mp4') AS name FROM part)""")
def parse_name_regex(spark, d):
    name = F.concat(F.col("p_size"), F.lit("kg_0."), F.col("p_partkey") % 10, F.lit("5_1."), F.col("p_partkey") % 7, F.lit("0.mp4"))
    load, reps = C.parse_name(name)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), load.alias("load_kg"), F.size(reps).cast("long").alias("n_reps"))


@query("SELECT event_id AS id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT c_custkey AS id, left(sha256(c_name), 16) AS sha, left(md5(c_name), 8) AS md5 FROM customer")
def hash_ids(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), C.short_hash(F.col("c_name")).alias("sha"), C.short_hash(F.col("c_name"), "md5").alias("md5"))


@query(f"WITH {BOXES} SELECT frame, pos, round(CASE WHEN least(w, h) <= 0 THEN 999 ELSE greatest(w, h) / least(w, h) END, 6) AS ratio, round(CASE WHEN h >= 2 THEN 0.45 / h END, 6) AS mpp, round(least(640 / h, 640 / w), 6) AS scale FROM b")
def box_geometry(spark, d):
    w, h = F.col("w"), F.col("h")
    return rounded(boxes(spark, d).select("frame", F.col("pos"), C.ratio(w, h).alias("ratio"), C.metres_per_pixel(0.45, h).alias("mpp"), C.letterbox(h, w, 640)["scale"].alias("scale")))


@query(f"WITH {FRAMES} SELECT DISTINCT video_id, idx FROM (SELECT video_id, idx FROM f WHERE idx % 5 = 0 UNION ALL SELECT video_id, idx FROM f WHERE kind = 'purchase')")
def union_distinct_frames(spark, d):
    f = frames(spark, d)
    return sampling.every(f, "idx", 5).select("video_id", "idx").union(f.where("kind = 'purchase'").select("video_id", "idx")).distinct()


@query("SELECT p_partkey AS id FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 45")
def set_difference(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id")).subtract(table(spark, d, "lineitem").where("l_quantity > 45").select("l_partkey"))


# --- folds

VELOCITY = f"""{FRAMES}, v AS (SELECT video_id, idx, t / 3600 AS t, conf AS y, coalesce(conf - lag(conf) OVER (PARTITION BY video_id ORDER BY idx), 0) AS v, count(*) OVER (PARTITION BY video_id) AS n FROM f)"""


def motion(spark, d):
    f = frames(spark, d)
    v = F.coalesce(F.col("conf") - F.lag("conf").over(windows.by("video_id", "idx")), F.lit(0.0))
    return f.select("video_id", F.col("idx").alias("pos"), (F.col("t") / 3600).alias("t"), F.col("conf").alias("y"), v.alias("v"))


WAVES = f"""{FRAMES.replace("f AS", "f0 AS", 1)}, f AS (SELECT video_id, idx, t, sin(idx / 2.5) * 0.4 + conf / 20 AS y FROM f0)"""


def waves(spark, d):
    """Up and down in about 16 rows, so that three rows in a row rise and fall."""
    f = frames(spark, d).withColumn("y", F.sin(F.col("idx") / 2.5) * 0.4 + F.col("conf") / 20)
    v = F.coalesce(F.col("y") - F.lag("y").over(windows.by("video_id", "idx")), F.lit(0.0))
    return f.select("video_id", F.col("idx").alias("pos"), (F.col("t") / 3600).alias("t"), "y", v.alias("v"))


def _fsm(step: str, first: str) -> str:
    """A state machine as a recursive query; s: 0 idle, 1 down, 2 up."""
    return f"""WITH RECURSIVE {VELOCITY}, w AS (SELECT *, coalesce(min(v) OVER a > 0.02, false) AND count(*) OVER a = {{c}} AS rises, coalesce(max(v) OVER a < -0.02, false) AND count(*) OVER a = {{c}} AS falls, lead(v) OVER (PARTITION BY video_id ORDER BY idx) AS vn,
 lag(t) OVER (PARTITION BY video_id ORDER BY idx) AS tl, lag(y) OVER (PARTITION BY video_id ORDER BY idx) AS yl FROM v WINDOW a AS (PARTITION BY video_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND {{c}} FOLLOWING)),
k AS (SELECT video_id, idx, 0 AS s, CAST(NULL AS BIGINT) AS b, CAST(NULL AS DOUBLE) AS bt, CAST(NULL AS DOUBLE) AS b_y, CAST(NULL AS BIGINT) AS e, CAST(NULL AS DOUBLE) AS et, CAST(NULL AS DOUBLE) AS ey FROM w WHERE idx = 0 AND n >= 10
UNION ALL SELECT w.video_id, w.idx, {step}, {first}, CASE WHEN s = 2 AND ({{end}}) THEN w.idx END, w.t, w.y FROM k JOIN w ON w.video_id = k.video_id AND w.idx = k.idx + 1 WHERE w.idx < w.n - {{last}})
SELECT video_id, b AS start_idx, e AS end_idx, round(et - bt, 6) AS duration_s, round(abs(ey - b_y), 6) AS rom_m, round(abs(ey - b_y) / (et - bt), 6) AS mcv_mps, round((SELECT max(p.v) FROM v p WHERE p.video_id = k.video_id AND p.idx BETWEEN b AND e), 6) AS pcv_mps FROM k WHERE e IS NOT NULL AND et - bt >= 0.2 AND abs(ey - b_y) >= 0.12"""


DEADLIFT = _fsm("CASE WHEN s = 0 AND w.v > 0.08 AND w.vn > 0.08 THEN 2 WHEN s = 2 AND ({end}) THEN 0 ELSE s END", "CASE WHEN s = 0 AND w.v > 0.08 AND w.vn > 0.08 THEN w.idx - 1 ELSE b END, CASE WHEN s = 0 AND w.v > 0.08 AND w.vn > 0.08 THEN w.tl ELSE bt END, CASE WHEN s = 0 AND w.v > 0.08 AND w.vn > 0.08 THEN w.yl ELSE b_y END")
SQUAT = _fsm("CASE WHEN s = 0 AND w.v < -0.08 THEN 1 WHEN s = 1 AND w.v >= -0.02 AND w.rises THEN 2 WHEN s = 2 AND ({end}) THEN 0 ELSE s END", "CASE WHEN s = 1 AND w.v >= -0.02 AND w.rises THEN w.idx ELSE b END, CASE WHEN s = 1 AND w.v >= -0.02 AND w.rises THEN w.t ELSE bt END, CASE WHEN s = 1 AND w.v >= -0.02 AND w.rises THEN w.y ELSE b_y END")
REPS = ("video_id", "start_idx", "end_idx", "duration_s", "rom_m", "mcv_mps", "pcv_mps")


@query(DEADLIFT.format(end="w.v < 0.02 AND w.vn < 0.02", c=3, last=4))
def fsm_deadlift(spark, d):
    return rounded(folds.repetitions(motion(spark, d), "video_id", "pos", "deadlift").select(*REPS))


@query(SQUAT.format(end="w.v <= 0.02 AND w.falls", c=1, last=2))
def fsm_ssc(spark, d):
    return rounded(folds.repetitions(motion(spark, d), "video_id", "pos", confirm=1).select(*REPS))


@query(SQUAT.format(end="w.v <= 0.02 AND w.falls", c=3, last=4).replace(FRAMES, WAVES).replace("conf - lag(conf)", "y - lag(y)").replace("conf AS y", "y"))
def fsm_ssc_confirmed(spark, d):
    return rounded(folds.repetitions(waves(spark, d), "video_id", "pos").select(*REPS))


@query(f"""WITH RECURSIVE {FRAMES}, k AS (SELECT video_id, idx, CASE WHEN y IS NULL THEN 0.0::DOUBLE ELSE 1.005::DOUBLE / 1.055::DOUBLE * y END AS x, CASE WHEN y IS NULL THEN 1.005::DOUBLE ELSE (1 - 1.005::DOUBLE / 1.055::DOUBLE) * 1.005::DOUBLE END AS p FROM f WHERE idx = 0
UNION ALL SELECT f.video_id, f.idx, CASE WHEN f.y IS NULL THEN x ELSE x + (p + 0.005::DOUBLE) / (p + 0.055::DOUBLE) * (f.y - x) END, CASE WHEN f.y IS NULL THEN p + 0.005::DOUBLE ELSE (1 - (p + 0.005::DOUBLE) / (p + 0.055::DOUBLE)) * (p + 0.005::DOUBLE) END FROM k JOIN f ON f.video_id = k.video_id AND f.idx = k.idx + 1)
SELECT video_id, idx, round(x, 6) AS filtered FROM k""")
def kalman_scalar(spark, d):
    return rounded(folds.kalman_scalar(frames(spark, d), "video_id", "idx", "y"))


@query(f"""WITH RECURSIVE {FRAMES}, k AS (SELECT f.video_id, f.idx, f.t / 3600 AS t, y, 0.0::DOUBLE AS v, 0.0::DOUBLE AS a, 0.001::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p02, 0.1::DOUBLE AS p11, 0.0::DOUBLE AS p12, 1.0::DOUBLE AS p22 FROM f JOIN (SELECT video_id, min(idx) AS idx FROM f WHERE y IS NOT NULL GROUP BY 1) USING (video_id, idx)
UNION ALL SELECT video_id, idx, t, CASE WHEN z IS NULL THEN y ELSE y + p00 / s * (z - y) END, CASE WHEN z IS NULL THEN v ELSE v + p01 / s * (z - y) END, CASE WHEN z IS NULL THEN a ELSE a + p02 / s * (z - y) END,
 CASE WHEN z IS NULL THEN p00 ELSE p00 - p00 / s * p00 END, CASE WHEN z IS NULL THEN p01 ELSE p01 - p00 / s * p01 END, CASE WHEN z IS NULL THEN p02 ELSE p02 - p00 / s * p02 END, CASE WHEN z IS NULL THEN p11 ELSE p11 - p01 / s * p01 END, CASE WHEN z IS NULL THEN p12 ELSE p12 - p01 / s * p02 END, CASE WHEN z IS NULL THEN p22 ELSE p22 - p02 / s * p02 END
 FROM (SELECT *, p00 + 0.0004::DOUBLE AS s FROM (SELECT video_id, idx, t, z, y + v * d + a * e AS y, v + a * d AS v, a, m00 + d * m01 + e * m02 + 25.0 * e * e AS p00, m01 + d * m02 + 25.0 * e * d AS p01, m02 + 25.0 * e AS p02, m11 + d * m12 + 25.0 * d * d AS p11, m12 + 25.0 * d AS p12, p22 + 25.0::DOUBLE AS p22
 FROM (SELECT *, p00 + d * p01 + e * p02 AS m00, p01 + d * p11 + e * p12 AS m01, p02 + d * p12 + e * p22 AS m02, p11 + d * p12 AS m11, p12 + d * p22 AS m12 FROM (SELECT *, d * d / 2 AS e FROM
 (SELECT k.video_id, f.idx, f.t / 3600 AS t, f.y AS z, k.y, k.v, k.a, p00, p01, p02, p11, p12, p22, CASE WHEN f.t / 3600 - k.t > 0 THEN f.t / 3600 - k.t ELSE 1.0::DOUBLE / 60 END AS d FROM k JOIN f ON f.video_id = k.video_id AND f.idx = k.idx + 1))))))
SELECT video_id, idx, round(y, 4) AS y, round(v, 4) AS v, round(a, 4) AS a FROM k""")
def kalman_ca(spark, d):
    return rounded(folds.physical_filter(frames(spark, d).withColumn("t", F.col("t") / 3600), "video_id", "idx", "t", "y"), 4)  # states of thousands


@query(f"""WITH RECURSIVE {FRAMES}, k AS (SELECT f.video_id, f.idx, f.t / 3600 AS t, y, 0.0::DOUBLE AS v, 0.0::DOUBLE AS a, 10.0::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p02, 10.0::DOUBLE AS p11, 0.0::DOUBLE AS p12, 10.0::DOUBLE AS p22 FROM f JOIN (SELECT video_id, min(idx) AS idx FROM f WHERE y IS NOT NULL GROUP BY 1) USING (video_id, idx)
UNION ALL SELECT video_id, idx, t, CASE WHEN z IS NULL THEN y ELSE y + p00 / s * (z - y) END, CASE WHEN z IS NULL THEN v ELSE v + p01 / s * (z - y) END, CASE WHEN z IS NULL THEN a ELSE a + p02 / s * (z - y) END,
 CASE WHEN z IS NULL THEN p00 ELSE p00 - p00 / s * p00 END, CASE WHEN z IS NULL THEN p01 ELSE p01 - p00 / s * p01 END, CASE WHEN z IS NULL THEN p02 ELSE p02 - p00 / s * p02 END, CASE WHEN z IS NULL THEN p11 ELSE p11 - p01 / s * p01 END, CASE WHEN z IS NULL THEN p12 ELSE p12 - p01 / s * p02 END, CASE WHEN z IS NULL THEN p22 ELSE p22 - p02 / s * p02 END
 FROM (SELECT *, p00 + 4.0::DOUBLE AS s FROM (SELECT video_id, idx, t, z, y + v * d + a * e AS y, v + a * d AS v, a, m00 + d * m01 + e * m02 + 0.01::DOUBLE AS p00, m01 + d * m02 + 0.0::DOUBLE AS p01, m02 + 0.0::DOUBLE AS p02, m11 + d * m12 + 0.01::DOUBLE AS p11, m12 + 0.0::DOUBLE AS p12, p22 + 0.01::DOUBLE AS p22
 FROM (SELECT *, p00 + d * p01 + e * p02 AS m00, p01 + d * p11 + e * p12 AS m01, p02 + d * p12 + e * p22 AS m02, p11 + d * p12 AS m11, p12 + d * p22 AS m12 FROM (SELECT *, d * d / 2 AS e FROM
 (SELECT k.video_id, f.idx, f.t / 3600 AS t, f.y AS z, k.y, k.v, k.a, p00, p01, p02, p11, p12, p22, 1.0::DOUBLE / 120 AS d FROM k JOIN f ON f.video_id = k.video_id AND f.idx = k.idx + 1))))))
SELECT video_id, idx, round(y, 6) AS y, round(v, 6) AS v, round(a, 6) AS a FROM k""")
def kalman_fixed_dt(spark, d):
    return rounded(folds.fixed_step_filter(frames(spark, d), "video_id", "idx", "y"))


ASSOCIATE = f"""WITH RECURSIVE {FRAMES}, d AS (SELECT video_id, idx, y * 100 AS x, conf * 100 AS c FROM f), k AS (SELECT video_id, idx, CASE WHEN x IS NULL THEN 'INIT' ELSE 'ANCHORING' END AS s, CASE WHEN x IS NULL THEN []::DOUBLE[] ELSE [x] END AS xs, CASE WHEN x IS NULL THEN []::DOUBLE[] ELSE [c] END AS cs, NULL::DOUBLE AS ax, NULL::DOUBLE AS ac, NULL::BIGINT AS lost, NULL::DOUBLE AS held,
 CASE WHEN x IS NULL THEN 'INIT' ELSE 'ANCHORING' END AS state, x IS NOT NULL AS valid, 0::BIGINT AS gap, x AS cx, CASE WHEN x IS NOT NULL THEN c END AS cy, x IS NOT NULL AS is_anchor FROM d WHERE idx = 0
UNION ALL SELECT video_id, i, s2, CASE WHEN s2 = 'ANCHORING' THEN xs2 ELSE []::DOUBLE[] END, CASE WHEN s2 = 'ANCHORING' THEN cs2 ELSE []::DOUBLE[] END,
 CASE WHEN s = 'ANCHORING' AND s2 = 'TRACKING' THEN list_median(xs2) WHEN s = 'TRACKING' AND there AND sqrt((x - ax) * (x - ax) + (c - ac) * (c - ac)) < 400 THEN 0.7::DOUBLE * x + 0.3::DOUBLE * ax WHEN s = 'LOST' AND there AND g <= 1 THEN 0.5 * x + 0.5 * ax ELSE ax END,
 CASE WHEN s = 'ANCHORING' AND s2 = 'TRACKING' THEN list_median(cs2) WHEN s = 'TRACKING' AND there AND sqrt((x - ax) * (x - ax) + (c - ac) * (c - ac)) < 400 THEN 0.7::DOUBLE * c + 0.3::DOUBLE * ac WHEN s = 'LOST' AND there AND g <= 1 THEN 0.5 * c + 0.5 * ac ELSE ac END,
 CASE WHEN s = 'TRACKING' AND NOT there THEN i ELSE lost END, CASE WHEN s = 'TRACKING' AND NOT there THEN ac ELSE held END,
 CASE WHEN s <> 'LOST' OR NOT there THEN s2 WHEN g <= 1 THEN 'RECOVERED' ELSE 'DRIFTED' END, there OR s = 'LOST', CASE WHEN s = 'LOST' THEN g ELSE 0 END, x, CASE WHEN there THEN c WHEN s = 'LOST' THEN held END, there AND (s IN ('INIT', 'ANCHORING') OR (s = 'LOST' AND g > 1))
 FROM (SELECT *, CASE s WHEN 'INIT' THEN CASE WHEN there THEN 'ANCHORING' ELSE 'INIT' END WHEN 'ANCHORING' THEN CASE WHEN len(xs2) >= 5 THEN 'TRACKING' ELSE 'ANCHORING' END WHEN 'TRACKING' THEN CASE WHEN there THEN 'TRACKING' ELSE 'LOST' END ELSE CASE WHEN NOT there THEN 'LOST' WHEN g <= 1 THEN 'TRACKING' ELSE 'ANCHORING' END END AS s2
 FROM (SELECT k.video_id, d.idx AS i, d.x, d.c, d.x IS NOT NULL AS there, d.idx - k.lost AS g, s, ax, ac, lost, held, CASE WHEN d.x IS NULL THEN xs WHEN s IN ('INIT', 'ANCHORING') THEN list_append(xs, d.x) ELSE [d.x] END AS xs2, CASE WHEN d.x IS NULL THEN cs WHEN s IN ('INIT', 'ANCHORING') THEN list_append(cs, d.c) ELSE [d.c] END AS cs2
 FROM k JOIN d ON d.video_id = k.video_id AND d.idx = k.idx + 1)))
SELECT video_id, idx, state, valid, gap, round(cx, 6) AS cx, round(cy, 6) AS cy, is_anchor FROM k"""


@query(ASSOCIATE)
def associator_states(spark, d):
    f = frames(spark, d).select("video_id", "idx", (F.col("y") * 100).alias("cx"), (F.col("conf") * 100).alias("cy"))
    return rounded(folds.associate(f, "video_id", "idx", timeout_frames=1))


@query(ASSOCIATE.replace("g <= 1 ", "g <= 15 ").replace("g > 1)", "g > 15)").replace("SELECT video_id, idx, y * 100 AS x", "SELECT video_id, idx, CASE WHEN idx % 40 < 12 OR idx % 40 > 12 + video_id * 7 % 25 THEN conf * 1000 END AS x"))
def associator_gaps(spark, d):
    """The published timeout of 15 frames, on targets that are away for 1 to 25 frames of 40 and whose places jump."""
    away = F.when((F.col("idx") % 40 < 12) | (F.col("idx") % 40 > 12 + F.col("video_id") * 7 % 25), F.col("conf") * 1000)
    f = frames(spark, d).select("video_id", "idx", away.alias("cx"), (F.col("conf") * 100).alias("cy"))
    return rounded(folds.associate(f, "video_id", "idx"))


@query(f"SELECT video_id, count(*) FILTER (state IN ('TRACKING', 'RECOVERED')) AS n_tracking, count(*) FILTER (state = 'LOST') AS n_lost, count(*) FILTER (state IN ('ANCHORING', 'DRIFTED')) AS n_anchoring, round(count(*) FILTER (state IN ('TRACKING', 'RECOVERED')) / count(*), 6) AS coverage FROM ({ASSOCIATE}) GROUP BY 1")
def state_shares(spark, d):
    return rounded(metrics.state_shares(associator_states(spark, d), "video_id"))


@query(f"""WITH RECURSIVE {FRAMES}, k AS (SELECT video_id, idx, false AS up, conf AS top, conf AS low, idx AS "at", false AS armed, 0 AS run, conf AS high, false AS fired FROM f WHERE idx = 0
UNION ALL SELECT video_id, i, CASE WHEN up THEN NOT climbed ELSE fires END, CASE WHEN up AND climbed THEN h2 ELSE top END, CASE WHEN up AND climbed THEN h2 WHEN NOT up AND x > low THEN x ELSE low END, CASE WHEN (up AND climbed) OR (NOT up AND x > low) THEN i ELSE "at" END,
 CASE WHEN up OR fires THEN false WHEN x > low THEN armed OR x - top >= 0.15::DOUBLE ELSE armed END, CASE WHEN up OR fires OR x > low THEN 0 ELSE r2 END, CASE WHEN up THEN h2 WHEN fires THEN x ELSE high END, fires
 FROM (SELECT *, up AND low - h2 >= 0.15::DOUBLE AS climbed, NOT up AND x <= low AND armed AND r2 >= 4 AS fires FROM (SELECT k.video_id, f.idx AS i, f.conf AS x, up, top, low, "at", armed, high, least(high, f.conf) AS h2, CASE WHEN armed AND low - f.conf >= 0.03::DOUBLE THEN run + 1 ELSE 0 END AS r2 FROM k JOIN f ON f.video_id = k.video_id AND f.idx = k.idx + 1)))
SELECT video_id, idx, round(low, 6) AS bottom, "at" FROM k WHERE fired""")
def regrind_trigger(spark, d):
    return rounded(folds.bottoms(frames(spark, d), "video_id", "idx", "conf", 0.1))


@query(f"""WITH RECURSIVE {FRAMES}, k AS (SELECT video_id, idx, t AS last, true AS kept, t FROM f WHERE idx = 0 UNION ALL SELECT f.video_id, f.idx, CASE WHEN f.t - last > 3600 THEN f.t ELSE last END, f.t - last > 3600, f.t FROM k JOIN f ON f.video_id = k.video_id AND f.idx = k.idx + 1)
SELECT video_id, idx, round(t, 6) AS t FROM k WHERE kept""")
def thin_steps(spark, d):
    return rounded(folds.thin(frames(spark, d), "video_id", "idx", "t", 3600.0))


@query(f"""WITH RECURSIVE {FRAMES}, k AS (SELECT video_id, idx, y AS x FROM f WHERE idx = 0 UNION ALL SELECT f.video_id, f.idx, CASE WHEN f.y IS NULL THEN x * 0.6::DOUBLE WHEN x IS NULL THEN f.y ELSE 0.7::DOUBLE * f.y + (1 - 0.7::DOUBLE) * x END FROM k JOIN f ON f.video_id = k.video_id AND f.idx = k.idx + 1)
SELECT video_id, idx, round(x, 6) AS average FROM k""")
def decayed_average(spark, d):
    return rounded(folds.decayed(frames(spark, d), "video_id", "idx", "y"))


@query(f"WITH {PAIRS} SELECT {AGREE} FROM pairs WHERE video_id IN (SELECT video_id FROM (SELECT video_id, count(*) AS n FROM g GROUP BY 1) JOIN (SELECT video_id, count(*) AS n FROM p GROUP BY 1) USING (video_id, n))")
def evaluate_equal_count(spark, d):
    return rounded(engine.evaluate(predictions(spark, d), truth(spark, d), "equal_count").drop("icc_ref", "icc_2_1"))
