"""Registered queries of gates, peaks, tracks and clusters, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinetia.functions import columns as C
from kinetia.operators import matching, metrics, peaks, tracks, windows
from kinetia.plans.queries import NEAR, ORACLES, RUNS, WAVES, error_runs, query, rounded, waves
from kinetia.sources.testdata import BOXES, FRAMES, SHOTS, boxes, frames, shots, table

RATIO = "CASE WHEN least(w, h) <= 0 THEN 999 ELSE greatest(w, h) / least(w, h) END"


@query(f"""WITH {BOXES} SELECT frame, pos, round(CASE WHEN cx > 6 AND cx < 194 AND cy > 3 AND cy < 97 AND h / 100 BETWEEN 0.03 AND 0.15 AND {RATIO} <= 1.6 THEN conf * (0.4 + 0.6 * greatest(0, 1 - (abs(cx - 100) / 100 + abs(cy - 50) / 50) / 2)) ELSE 0 END, 6) AS anchor,
round(conf * (0.4 + 0.6 * CASE WHEN h * 5 > 80 AND h * 5 < 350 AND w > 50 AND w < 400 THEN 1.0 ELSE 0.2 END) * (0.5 + 0.5 * greatest(0, 1 - (abs(cx - 100) / 100 + abs(cy - 50) / 50) / 2)), 6) AS candidate,
{RATIO} <= 1.4 AND conf >= 0.35 AS is_round, w * h BETWEEN 0.001 * 20000 AND 0.3 * 20000 AND h / greatest(w, 1e-6) BETWEEN 0.2 AND 3.5 AS boots FROM b""")
def box_scores(spark, d):
    x, y, w, h, conf = (F.col(c) for c in ("cx", "cy", "w", "h", "conf"))
    return rounded(boxes(spark, d).select("frame", "pos", C.anchor_score(x, y, w, h, conf, 200, 100).alias("anchor"), C.candidate_score(x, y, w, h * 5, conf, 200, 100).alias("candidate"), C.round_gate(w, h, conf).alias("is_round"), C.boot_gate(w, h, 20000.0).alias("boots")))


@query(f"WITH {BOXES} SELECT frame, pos, CASE WHEN cy / 100 < 0.5 AND conf < 0.5 THEN NULL WHEN w / 20 < 0.2 * h THEN 'micro' ELSE 'snap' END AS verdict FROM b")
def regrind_verdicts(spark, d):
    return boxes(spark, d).select("frame", "pos", C.regrind_verdict(F.col("w") / 20, F.col("cy") / 100, F.col("conf"), F.col("h")).alias("verdict"))


NAMES = ("10kg", " 15 KG ", "20kg", "25 kg", "10LB", "25lb", "35 lb", "45lb", "5kg", None)


@query("SELECT p_partkey AS id, CASE p_partkey % 10 WHEN 0 THEN 0.32 WHEN 1 THEN 0.38 WHEN 2 THEN 0.45 WHEN 3 THEN 0.45 WHEN 4 THEN 0.28 WHEN 5 THEN 0.4 WHEN 6 THEN 0.42 ELSE 0.45 END::DOUBLE AS diameter FROM part")
def plate_sizes(spark, d):
    name = F.get(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 10).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), C.plate_diameter(name).alias("diameter"))


@query(f"""WITH {BOXES}, l AS (SELECT *, least(640 / h, 640 / w) AS scale FROM b), m AS (SELECT *, trunc(h * scale) AS nh, trunc(w * scale) AS nw FROM l), o AS (SELECT *, trunc((640 - nh) / 2) AS dy, trunc((640 - nw) / 2) AS dx FROM m)
SELECT frame, pos, CAST(nh AS BIGINT) AS nh, CAST(nw AS BIGINT) AS nw, CAST(dy AS BIGINT) AS dy, CAST(dx AS BIGINT) AS dx, round((cx * 20 / 7 - dx) / scale, 6) AS x, round((cy * 20 / 7 - dy) / scale, 6) AS y, round(cy, 6) AS turned_x, round(200 - cx, 6) AS turned_y FROM o""")
def letterbox_back(spark, d):
    b = C.letterbox(F.col("h"), F.col("w"), 640)
    x, y = C.unrotate(F.col("cx"), F.col("cy"), F.lit(200.0))
    return rounded(boxes(spark, d).select("frame", "pos", *(b[c].alias(c) for c in ("nh", "nw", "dy", "dx")), C.unletterbox(F.col("cx") * 20 / 7, b["dx"], b["scale"]).alias("x"), C.unletterbox(F.col("cy") * 20 / 7, b["dy"], b["scale"]).alias("y"), x.alias("turned_x"), y.alias("turned_y")))


@query(f"""WITH {BOXES} SELECT frame, pos, round((greatest(0, least(83.3, cx - w / 2 - 30)) + greatest(0, least(83.3, cx + w / 2 - 30))) / 166.6, 6) AS x, round((greatest(0, least(61.7, cy - h / 2 - 20)) + greatest(0, least(61.7, cy + h / 2 - 20))) / 123.4, 6) AS y,
round((greatest(0, least(83.3, cx + w / 2 - 30)) - greatest(0, least(83.3, cx - w / 2 - 30))) / 83.3, 6) AS w, round((greatest(0, least(61.7, cy + h / 2 - 20)) - greatest(0, least(61.7, cy - h / 2 - 20))) / 61.7, 6) AS h FROM b""")
def crop_labels(spark, d):
    found = C.in_crop(*(F.col(c) for c in ("cx", "cy", "w", "h")), F.lit(30.0), F.lit(20.0), F.lit(83.3), F.lit(61.7))
    return rounded(boxes(spark, d).select("frame", "pos", *(c.alias(n) for c, n in zip(found, ("x", "y", "w", "h")))))


@query(f"""WITH {BOXES} SELECT frame, pos, CASE WHEN pos = 0 THEN 'no_detection' WHEN conf < 0.15 THEN 'occlusion' WHEN pos >= 4 THEN 'multi_plate' WHEN cy > 65 THEN 'bottom' WHEN w < 80 THEN 'low_light' ELSE 'normal' END AS kind,
CASE WHEN w < 80 THEN 'dark' WHEN w > 140 THEN 'bright' WHEN h * 50 < 3000 THEN 'low_contrast' ELSE 'normal' END AS light, NOT (h / 17 BETWEEN 0.05 AND 2.5) AS clipped, round(greatest(0.05, least(2.5, h / 17)), 6) AS speed FROM b""")
def frame_classes(spark, d):
    clipped, speed = C.plausible_speed(F.col("h") / 17)
    return rounded(boxes(spark, d).select("frame", "pos", C.frame_class(F.col("pos") > 0, F.col("conf"), F.when(F.col("pos") >= 4, 2).otherwise(1), F.col("cy"), F.lit(100.0), F.col("w")).alias("kind"), C.brightness_class(F.col("w"), F.col("h") * 50).alias("light"), clipped.alias("clipped"), speed.alias("speed")))


@query("SELECT c_custkey AS id, regexp_replace(concat(c_name, ' (', c_mktsegment, ')/é'), '[^A-Za-z0-9_.-]', '_', 'g') AS name FROM customer")
def safe_names(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), C.safe_id(F.concat("c_name", F.lit(" ("), "c_mktsegment", F.lit(")/é"))).alias("name"))


@query(f"WITH {FRAMES} SELECT video_id, idx, round(CASE WHEN t - lag(t) OVER w > 0 THEN t - lag(t) OVER w ELSE 1.0 / 60 END, 6) AS dt FROM f WINDOW w AS (PARTITION BY video_id ORDER BY idx)")
def step_times(spark, d):
    return rounded(frames(spark, d).select("video_id", "idx", C.step_seconds(F.col("t"), F.lag("t").over(windows.by("video_id", "idx"))).alias("dt")))


# --- windows


@query(f"WITH {NEAR} SELECT video_id, idx, round(CASE WHEN idx - pi <= 1 THEN pv END, 6) AS held FROM n")
def hold_bridge(spark, d):
    return rounded(windows.hold_bridge(frames(spark, d), "video_id", "idx", "y", 1).select("video_id", "idx", "held"))


@query(f"""WITH {FRAMES}, s AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY video_id) AS n, lag(conf, 4) OVER w AS a4, lag(conf, 3) OVER w AS a3, lag(conf, 2) OVER w AS a2, lag(conf) OVER w AS a1, lead(conf) OVER w AS b1, lead(conf, 2) OVER w AS b2, lead(conf, 3) OVER w AS b3, lead(conf, 4) OVER w AS b4 FROM f WINDOW w AS (PARTITION BY video_id ORDER BY idx))
SELECT video_id, idx, round(CASE WHEN n < 5 THEN NULL WHEN i = 1 THEN (31 * conf + 9 * b1 - 3 * b2 - 5 * b3 + 3 * b4) / 35 WHEN i = 2 THEN (9 * a1 + 13 * conf + 12 * b1 + 6 * b2 - 5 * b3) / 35 WHEN i = n - 1 THEN (9 * b1 + 13 * conf + 12 * a1 + 6 * a2 - 5 * a3) / 35 WHEN i = n THEN (31 * conf + 9 * a1 - 3 * a2 - 5 * a3 + 3 * a4) / 35 ELSE (-3 * a2 + 12 * a1 + 17 * conf + 12 * b1 - 3 * b2) / 35 END, 6) AS smooth,
round(CASE WHEN n < 5 THEN NULL WHEN i = 1 THEN (-54 * conf + 13 * b1 + 40 * b2 + 27 * b3 - 26 * b4) / 70 WHEN i = 2 THEN (-34 * a1 + 3 * conf + 20 * b1 + 17 * b2 - 6 * b3) / 70 WHEN i = n - 1 THEN (34 * b1 - 3 * conf - 20 * a1 - 17 * a2 + 6 * a3) / 70 WHEN i = n THEN (54 * conf - 13 * a1 - 40 * a2 - 27 * a3 + 26 * a4) / 70 ELSE (-2 * a2 - a1 + b1 + 2 * b2) / 10 END, 6) AS slope FROM s""")
def savgol_edges(spark, d):
    df = peaks.savgol(frames(spark, d), "video_id", "idx", "conf", 5, 2)
    return rounded(peaks.savgol(df, "video_id", "idx", "conf", 5, 2, 1, "slope").select("video_id", "idx", "smooth", "slope"))


@query(f"""WITH {FRAMES}, s AS (SELECT video_id, idx, conf + idx * 1e-7 AS y FROM f), m AS (SELECT * FROM (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM s WINDOW w AS (PARTITION BY video_id ORDER BY idx)) WHERE y > a AND y > b),
e AS (SELECT m.video_id, m.idx, m.y, coalesce((SELECT max(s.idx) FROM s WHERE s.video_id = m.video_id AND s.idx < m.idx AND s.y > m.y), -1) AS lo, coalesce((SELECT min(s.idx) FROM s WHERE s.video_id = m.video_id AND s.idx > m.idx AND s.y > m.y), 1000000) AS hi FROM m)
SELECT e.video_id, e.idx, round(any_value(e.y), 6) AS height, round(any_value(e.y) - greatest(min(s.y) FILTER (s.idx <= e.idx), min(s.y) FILTER (s.idx >= e.idx)), 6) AS prominence FROM e JOIN s ON s.video_id = e.video_id AND s.idx > e.lo AND s.idx < e.hi GROUP BY 1, 2
HAVING any_value(e.y) - greatest(min(s.y) FILTER (s.idx <= e.idx), min(s.y) FILTER (s.idx >= e.idx)) >= 0.3""")
def peaks_prominent(spark, d):
    f = frames(spark, d).select("video_id", "idx", (F.col("conf") + F.col("idx") * 1e-7).alias("y"))
    return rounded(peaks.peaks(f, "video_id", "idx", "y", 1, 0.3))


@query(f"""WITH {FRAMES}, v AS (SELECT video_id, idx, conf, min(conf) OVER (w ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS low, least(max(conf) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), max(conf) OVER (w ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING)) - conf AS depth, count(*) OVER (PARTITION BY video_id) AS n FROM f WINDOW w AS (PARTITION BY video_id ORDER BY idx))
SELECT video_id, idx, round(depth, 6) AS depth FROM v WHERE conf <= low + 1e-9 AND depth > 0.12 AND idx >= 3 AND idx < n - 3""")
def valley_finder(spark, d):
    return rounded(windows.valleys(frames(spark, d), "video_id", "idx", "conf", 3, 9, 0.12, 0))


@query(f"""WITH {FRAMES}, r AS (SELECT video_id, coalesce(max(y) - min(y), 0) AS a, coalesce(max(conf) - min(conf), 0) AS b, coalesce(max(t / 1e6) - min(t / 1e6), 0) AS c FROM f GROUP BY 1)
SELECT video_id, CASE WHEN a >= b AND a >= c THEN 'y' WHEN b >= c THEN 'conf' ELSE 'u' END AS signal, round(greatest(a, b, c), 6) AS span FROM r""")
def moving_signal(spark, d):
    return rounded(windows.moving_signal(frames(spark, d).withColumn("u", F.col("t") / 1e6), "video_id", ["y", "conf", "u"]))


def tens(spark, d):
    """Each ten rows as a repetition."""
    f = frames(spark, d)
    return f.where("idx % 10 = 0").select("video_id", F.col("idx").alias("start"), (F.col("idx") + 9).alias("end"))


TENS = f"""{FRAMES}, r AS (SELECT video_id, idx AS "start", idx + 9 AS "end" FROM f WHERE idx % 10 = 0), j AS (SELECT r.*, f.idx AS i, f.conf - 0.6 AS v FROM r JOIN f ON f.video_id = r.video_id AND f.idx BETWEEN "start" AND "end")"""


@query(f"""WITH {TENS}, m AS (SELECT video_id, "start", "end", min(CASE WHEN v > 0 THEN i END) AS a, max(CASE WHEN v > 0 THEN i END) AS z FROM j GROUP BY 1, 2, 3)
SELECT video_id, "start", "end", least(coalesce(a, coalesce(z, "start")), coalesce(z, "start")) AS new_start, coalesce(z, "start") AS new_end FROM m""")
def trim_ends(spark, d):
    p = frames(spark, d).select("video_id", "idx", (F.col("conf") - 0.6).alias("v"))
    return windows.trim_ends(p, tens(spark, d), "video_id", "idx")


@query(f"""WITH {TENS} SELECT video_id, "start", "end", round(avg(v), 10) AS mcv, round(coalesce(avg(v) FILTER (v > 0), 0), 10) AS mcv_pos, round(max(CASE WHEN i = floor(("start" + "end") / 2) THEN v END), 10) AS mcv_mid, round(max(v), 10) AS pv FROM j GROUP BY 1, 2, 3""")
def rep_velocities(spark, d):
    p = frames(spark, d).select("video_id", "idx", (F.col("conf") - 0.6).alias("v"))
    return rounded(metrics.rep_velocities(p, tens(spark, d), "video_id", "idx", "v"), 10)  # means of few values of six digits: ties at six


@query(f"""WITH {RUNS}, l AS (SELECT video_id, max(idx) - 1 AS last FROM f GROUP BY 1) SELECT DISTINCT video_id, idx FROM (SELECT video_id, unnest(range(greatest("start" - 2, 0), least("end" + 2, last) + 1)) AS idx FROM r JOIN l USING (video_id))""")
def expanded_runs(spark, d):
    last = frames(spark, d).groupBy("video_id").agg((F.max("idx") - 1).alias("last"))
    return matching.expand(error_runs(spark, d).select("video_id", (F.col("start") - 2).alias("start"), (F.col("end") + 2).alias("end")), "video_id", last)


@query(f"WITH {FRAMES}, j AS ({ORACLES['jump_detect']}) SELECT f.video_id, f.idx, f.kind, j.jump FROM f LEFT JOIN (SELECT * FROM j WHERE jump IS NOT NULL) j ON j.video_id = f.video_id AND j.idx = f.idx WHERE f.kind <> 'view'")
def jump_lookup(spark, d):
    from kinetia.plans.queries import jump_detect

    return frames(spark, d).where("kind != 'view'").select("video_id", "idx", "kind").join(jump_detect(spark, d).where("jump is not null"), ["video_id", "idx"], "left")


# --- tracks and clusters


@query(f"""WITH RECURSIVE {SHOTS}, g AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) AS k FROM (SELECT video_id, frame_idx, list({{'pos': pos, 'cx': cx, 'cy': cy, 'a': w * h}} ORDER BY pos) AS bs FROM s GROUP BY 1, 2)),
c AS (SELECT video_id, frame_idx, k, bs[list_position(list_transform(bs, lambda b: b.a), list_max(list_transform(bs, lambda b: b.a)))] AS b FROM g WHERE k = 1
UNION ALL SELECT g.video_id, g.frame_idx, g.k, g.bs[list_position(list_transform(g.bs, lambda x: (x.cx - c.b.cx) * (x.cx - c.b.cx) + (x.cy - c.b.cy) * (x.cy - c.b.cy)), list_min(list_transform(g.bs, lambda x: (x.cx - c.b.cx) * (x.cx - c.b.cx) + (x.cy - c.b.cy) * (x.cy - c.b.cy))))] FROM c JOIN g ON g.video_id = c.video_id AND g.k = c.k + 1)
SELECT video_id, frame_idx, CAST(b.pos AS BIGINT) AS pos FROM c""")
def nearest_to_previous(spark, d):
    return tracks.nearest_to_previous(shots(spark, d), "video_id", "frame_idx")


SEEDS = f"""WITH RECURSIVE {BOXES}, k AS (SELECT frame, pos, [{{'x': cx, 'y': cy}}] AS seeds, 0::BIGINT AS cluster FROM b WHERE pos = 0
UNION ALL SELECT frame, pos, CASE WHEN hit IS NULL THEN list_append(seeds, {{'x': cx, 'y': cy}}) ELSE seeds END, CASE WHEN hit IS NULL THEN len(seeds) ELSE hit - 1 END FROM (SELECT b.frame, b.pos, b.cx, b.cy, k.seeds, list_position(list_transform(k.seeds, lambda q: sqrt((b.cx - q.x) * (b.cx - q.x) + (b.cy - q.y) * (b.cy - q.y)) < 60), true) AS hit FROM k JOIN b ON b.frame = k.frame AND b.pos = k.pos + 1))"""


@query(f"{SEEDS} SELECT frame, pos, CAST(cluster AS BIGINT) AS cluster FROM k")
def seed_clusters(spark, d):
    return tracks.seed_clusters(boxes(spark, d), "frame", "pos", 60.0)


@query(f"""{SEEDS} SELECT frame, CAST(cluster AS BIGINT) AS cluster, count(*) AS n, round(avg(cx), 10) AS cx, round(avg(cy), 10) AS cy, round(avg(w), 10) AS w, round(avg(h), 10) AS h, round(avg(conf), 10) AS score, max_by(pos, conf - pos * 1e-9) AS best, count(DISTINCT pos) AS n_frames FROM k JOIN b USING (frame, pos) GROUP BY 1, 2 HAVING count(*) >= 3""")
def cluster_consensus(spark, d):
    c = tracks.seed_clusters(boxes(spark, d), "frame", "pos", 60.0).join(boxes(spark, d), ["frame", "pos"])
    found = tracks.consensus(c.withColumnRenamed("frame", "video").withColumn("frame", F.col("pos")), "video")
    return rounded(found.withColumnRenamed("video", "frame"), 10)  # means of few values of six digits: ties at six


@query(f"""WITH c AS ({ORACLES['single_linkage_1d']}), {BOXES}, s AS (SELECT frame, cluster, count(*) * stddev_pop(cx + cy * 0.013 + h / 703) AS score, count(*) AS n FROM c JOIN b USING (frame, pos) GROUP BY 1, 2)
SELECT frame, cluster, round(score, 6) AS score, n FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY score DESC, cluster) AS k FROM s) WHERE k = 1""")
def liveliest_cluster(spark, d):
    c = windows.single_linkage(boxes(spark, d), "frame", "cx", 50.0, "pos")
    return rounded(tracks.liveliest_cluster(c.withColumn("x", F.col("cx") + F.col("cy") * 0.013 + F.col("h") / 703), "frame", "x"))


@query(f"""WITH {SHOTS}, m AS (SELECT video_id, pos AS track, count(*) AS hits, stddev_pop(cy) AS motion, max_by(conf, frame_idx) AS conf FROM s GROUP BY 1, 2 HAVING count(*) >= 5)
SELECT video_id, track, round(motion, 6) AS motion, hits FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY motion DESC, conf DESC, track) AS k FROM m) WHERE k = 1""")
def moving_track(spark, d):
    return rounded(tracks.moving_track(shots(spark, d).withColumn("track", F.col("pos")), "video_id"))


@query(f"""WITH {BOXES} SELECT frame, pos, round(dist, 6) AS dist, n FROM (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY dist, pos) AS n FROM (SELECT *, sqrt((cx - 100) * (cx - 100) + (cy - 46) * (cy - 46)) AS dist FROM b) WHERE dist < 60) WHERE n <= 2""")
def near_prediction(spark, d):
    b = boxes(spark, d).select("*", *(F.lit(v).alias(k) for k, v in (("x", 100.0), ("y", 40.0), ("speed", 2.0), ("missed", 2))))
    return rounded(matching.near_prediction(b, "frame", "x", "y", "speed", "missed", 60.0).select("frame", "pos", "dist", "n"))


@query(f"""WITH RECURSIVE {FRAMES}, d AS (SELECT video_id, idx, y * 100 AS dx, conf * 100 AS dy, 100 + t % 60 AS dh, conf FROM f),
k AS (SELECT video_id, idx, CASE WHEN dx IS NOT NULL THEN 'B' END AS state, dx AS x, CASE WHEN dx IS NOT NULL THEN dy END AS y, CASE WHEN dx IS NOT NULL THEN dh END AS size, 0.0::DOUBLE AS v, 0::BIGINT AS missed FROM d WHERE idx = 0
UNION ALL SELECT video_id, i, s2, CASE s2 WHEN 'A' THEN 0.6::DOUBLE * dx + 0.4::DOUBLE * (x + v1 * (missed + 1)) WHEN 'B' THEN dx ELSE x END, CASE s2 WHEN 'A' THEN 0.6::DOUBLE * dy + 0.4::DOUBLE * (y + v1 * (missed + 1)) WHEN 'B' THEN dy ELSE y END, CASE WHEN s2 IN ('A', 'B') THEN dh ELSE size END,
 CASE WHEN s2 = 'B' THEN 0 WHEN dx IS NULL AND x IS NOT NULL THEN v1 * 0.6::DOUBLE ELSE v1 END, CASE WHEN dx IS NULL AND x IS NOT NULL THEN missed + 1 ELSE 0 END
 FROM (SELECT *, CASE WHEN dx IS NULL THEN NULL WHEN x IS NULL THEN 'B' WHEN inter / greatest(1.4 * size * size + 1.4 * dh * dh - inter, 1e-6) > 0.2 THEN 'A' WHEN conf > 0.65 THEN 'B' ELSE 'C' END AS s2 FROM
 (SELECT d.video_id, d.idx AS i, dx, dy, dh, conf, x, y, size, missed, CASE WHEN dx IS NOT NULL AND x IS NOT NULL AND missed = 0 THEN 0.7::DOUBLE * (dy - y) + 0.3::DOUBLE * v ELSE v END AS v1,
  greatest(0, least(x + 0.7 * size, dx + 0.7 * dh) - greatest(x - 0.7 * size, dx - 0.7 * dh)) * greatest(0, least(y + size / 2, dy + dh / 2) - greatest(y - size / 2, dy - dh / 2)) AS inter FROM k JOIN d ON d.video_id = k.video_id AND d.idx = k.idx + 1)))
SELECT video_id, idx, state, round(x, 6) AS cx, round(y, 6) AS cy, round(v, 6) AS speed FROM k""")
def fused_boxes(spark, d):
    f = frames(spark, d).select("video_id", "idx", (F.col("y") * 100).alias("dx"), (F.col("conf") * 100).alias("dy"), (100 + F.col("t") % 60).alias("dh"), "conf")
    return rounded(tracks.fuse(f, "video_id", "idx"))


@query(f"""WITH {FRAMES.replace("f AS", "f0 AS", 1)}, f AS (SELECT video_id, idx, 4 + y AS y FROM f0), c AS (SELECT video_id, idx, y, count(y) OVER w AS n, max(y) OVER w - min(y) OVER w AS span, min(CASE WHEN y IS NOT NULL THEN idx END) OVER w AS first FROM f WINDOW w AS (PARTITION BY video_id ORDER BY idx)),
l AS (SELECT video_id, min(idx) AS idx FROM c WHERE y IS NOT NULL AND n >= 10 AND (span > 0.5 * y OR idx - first >= 15) GROUP BY 1)
SELECT l.video_id, l.idx, round(0.45 / median(f.y), 6) AS mpp FROM l JOIN f ON f.video_id = l.video_id AND f.idx <= l.idx GROUP BY 1, 2""")
def static_scale(spark, d):
    """Sizes above 4, so that some videos lock by the range of their sizes, others after 15 frames."""
    return rounded(tracks.static_scale(frames(spark, d).withColumn("y", F.col("y") + 4), "video_id", "idx", "y"))


@query(f"""WITH RECURSIVE {WAVES}, c AS (SELECT video_id, idx, y, min(y) OVER (w ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS low, least(max(y) OVER (w ROWS BETWEEN 60 PRECEDING AND CURRENT ROW), max(y) OVER (w ROWS BETWEEN CURRENT ROW AND 59 FOLLOWING)) - y AS depth, count(*) OVER (PARTITION BY video_id) AS n FROM f WINDOW w AS (PARTITION BY video_id ORDER BY idx)),
e AS (SELECT video_id, idx, depth, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS k, count(*) OVER (PARTITION BY video_id) AS m FROM c WHERE y <= low + 1e-9 AND depth > 0.12 AND idx >= 8 AND idx < n - 8),
g AS (SELECT video_id, k, m, idx AS i, depth AS v, NULL::BIGINT AS done, NULL::DOUBLE AS top FROM e WHERE k = 1
UNION ALL SELECT e.video_id, e.k, e.m, CASE WHEN e.idx - g.i <= 20 AND e.depth <= g.v THEN g.i ELSE e.idx END, CASE WHEN e.idx - g.i <= 20 AND e.depth <= g.v THEN g.v ELSE e.depth END, CASE WHEN e.idx - g.i > 20 THEN g.i END, CASE WHEN e.idx - g.i > 20 THEN g.v END FROM g JOIN e ON e.video_id = g.video_id AND e.k = g.k + 1)
SELECT video_id, done AS idx, round(top, 6) AS depth FROM g WHERE done IS NOT NULL UNION ALL SELECT video_id, i, round(v, 6) FROM g WHERE k = m""")
def valleys_apart(spark, d):
    """The published sides, depth and spacing, on waves whose valleys are nearer than that."""
    w = waves(spark, d).withColumnRenamed("pos", "idx")
    return rounded(windows.valleys(w, "video_id", "idx", "y"))


@query(f"""WITH {FRAMES}, x AS (SELECT *, idx % 40 AS i, video_id * 1000 + idx // 40 AS part, count(*) OVER (PARTITION BY video_id, idx // 40) AS n FROM f WHERE idx % 40 < 1 + (video_id + idx // 40) % 17), w AS (SELECT *, CASE WHEN n > 11 THEN 11 ELSE n - 1 - n % 2 END AS win FROM x),
a AS (SELECT *, greatest(0, least(i - win // 2, n - win)) AS lo FROM w WHERE win >= 5), s AS (SELECT a.part, a.i, any_value(a.i - a.lo - a.win // 2)::DOUBLE AS u, (a.win // 2)::DOUBLE AS h, sum(b.conf) AS s0, sum((b.i - a.lo - a.win // 2) * b.conf) AS s1, sum((b.i - a.lo - a.win // 2) * (b.i - a.lo - a.win // 2) * b.conf) AS s2 FROM a JOIN a b ON b.part = a.part AND b.i >= a.lo AND b.i < a.lo + a.win GROUP BY a.part, a.i, a.win),
q AS (SELECT *, 2 * h + 1 AS m0, h * (h + 1) * (2 * h + 1) / 3 AS m2, h * (h + 1) * (2 * h + 1) * (3 * h * h + 3 * h - 1) / 15 AS m4 FROM s)
SELECT w.part, w.i, round((m4 * s0 - m2 * s2) / (m0 * m4 - m2 * m2) + s1 / m2 * u + (m0 * s2 - m2 * s0) / (m0 * m4 - m2 * m2) * u * u, 6) AS smooth FROM w LEFT JOIN q USING (part, i)""")
def savgol_short(spark, d):
    """Series of 1 to 17 rows under a window of 11, which shrinks with them down to 5."""
    f = frames(spark, d).select((F.col("video_id") * 1000 + F.floor(F.col("idx") / 40)).alias("part"), (F.col("idx") % 40).alias("i"), "conf", ((F.col("video_id") + F.floor(F.col("idx") / 40)) % 17).alias("most"))
    return rounded(peaks.savgol(f.where("i < 1 + most"), "part", "i", "conf", 11, 2, least=5).select("part", "i", "smooth"))
