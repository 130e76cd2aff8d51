"""Registered queries of whole trackers, pairings of peaks, splines, traces and scores of frames, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinetia.functions import columns as C
from kinetia.operators import folds, hybrid, peaks, splines, trackers, tracks, windows
from kinetia.plans import pipelines
from kinetia.plans.queries import query, rounded
from kinetia.sources.testdata import FRAMES, SHOTS, boxes, frames, shots, table

MOVED = """y + v * d + a * e AS y1, v + a * d AS v1, a AS a1, m00 + d * m01 + e * m02 + n00 AS q00, m01 + d * m02 + n01 AS q01, m02 + n02 AS q02, m11 + d * m12 + n11 AS q11, m12 + n12 AS q12, p22 + n22 AS q22"""
HALF = "*, d * d / 2 AS e, p00 + d * p01 + d * d / 2 * p02 AS m00, p01 + d * p11 + d * d / 2 * p12 AS m01, p02 + d * p12 + d * d / 2 * p22 AS m02, p11 + d * p12 AS m11, p12 + d * p22 AS m12"
STILL = ", ".join(f"0.0::DOUBLE AS {x}" for x in ("y", "v", "a", "p00", "p01", "p02", "p11", "p12", "p22"))


def corrected(when: str, z: str, r: str) -> str:
    """Columns of the state after a prediction (y1, v1, a1, q..), corrected by z where ``when`` holds."""
    s = f"(q00 + {r})"
    gains = {"y": ("y1", "q00"), "v": ("v1", "q01"), "a": ("a1", "q02")}
    out = [f"CASE WHEN {when} THEN {x} + {q} / {s} * ({z} - y1) ELSE {x} END AS {n}" for n, (x, q) in gains.items()]
    for i, j in ("00", "01", "02", "11", "12", "22"):
        out.append(f"CASE WHEN {when} THEN q{i}{j} - q0{i} / {s} * q0{j} ELSE q{i}{j} END AS p{i}{j}")
    return ", ".join(out)


def numbered(spark, d):
    """Boxes of videos whose frames are numbered from 1."""
    return shots(spark, d).withColumn("k", F.dense_rank().over(Window.partitionBy("video_id").orderBy("frame_idx")).cast("long"))


NUMBERED = f"""{SHOTS}, nb AS (SELECT *, dense_rank() OVER (PARTITION BY video_id ORDER BY frame_idx) AS k FROM s)"""


@query(f"""WITH RECURSIVE {NUMBERED}, g AS (SELECT video_id, k, list({{'cx': cx, 'cy': cy, 'h': h, 'conf': conf}} ORDER BY pos) AS bs FROM nb GROUP BY 1, 2),
r AS (SELECT video_id, 0::BIGINT AS n, 'none' AS phase, NULL::DOUBLE AS cx, NULL::DOUBLE AS cy, NULL::DOUBLE AS size, []::DOUBLE[] AS hs, NULL::BIGINT AS first, NULL::DOUBLE AS mpp, {STILL}, 'none' AS src FROM (SELECT DISTINCT video_id FROM g)
UNION ALL SELECT video_id, n, CASE WHEN phase = 'none' AND b IS NOT NULL THEN 'static' WHEN lock THEN 'track' ELSE phase END, ncx, ncy, CASE WHEN begun THEN b.h WHEN ok THEN 0.7 * b.h + 0.3 * size ELSE size END, hs2, CASE WHEN phase = 'none' AND b IS NOT NULL THEN n ELSE first END,
 CASE WHEN lock THEN 0.45 / list_aggregate(hs2, 'median') ELSE mpp END, CASE WHEN lock THEN ncy ELSE y END, CASE WHEN lock THEN 0 ELSE v END, CASE WHEN lock THEN 0 ELSE a END,
 CASE WHEN lock THEN 10 ELSE p00 END, CASE WHEN lock THEN 0 ELSE p01 END, CASE WHEN lock THEN 0 ELSE p02 END, CASE WHEN lock THEN 10 ELSE p11 END, CASE WHEN lock THEN 0 ELSE p12 END, CASE WHEN lock THEN 10 ELSE p22 END,
 CASE WHEN phase = 'none' THEN CASE WHEN b IS NULL THEN 'none' ELSE 'anchor' END WHEN lock THEN 'cal_lock' WHEN phase = 'static' THEN 'cal_static' WHEN n % 15 <> 0 THEN 'kalman' WHEN b IS NULL THEN CASE WHEN len(bs) > 0 THEN 'yolo_miss' ELSE 'yolo_empty' END WHEN ok THEN 'yolo+kalman' ELSE 'yolo_jump_reject' END
 FROM (SELECT video_id, n, phase, bs, b, size, hs2, first, mpp, lock, ok, begun, CASE WHEN begun OR ok THEN b.cx ELSE cx END AS ncx, CASE WHEN begun OR ok THEN b.cy ELSE cy END AS ncy, {corrected('ok', 'b.cy', '4.0')}
 FROM (SELECT *, phase IN ('none', 'static') AND b IS NOT NULL AS begun, coalesce(phase = 'static' AND len(hs2) >= 3 AND n - first >= 30 AND list_aggregate(hs2, 'median') > 2, false) AS lock, coalesce(phase = 'track' AND n % 15 = 0 AND b IS NOT NULL AND abs(b.cy - y1) <= 0.6 * size, false) AS ok
 FROM (SELECT video_id, n, phase, cx, cy, size, first, mpp, bs, b, hs2, {MOVED}
 FROM (SELECT {HALF}, 0.01::DOUBLE AS n00, 0.0::DOUBLE AS n01, 0.0::DOUBLE AS n02, 0.01::DOUBLE AS n11, 0.0::DOUBLE AS n12, 0.01::DOUBLE AS n22, CASE WHEN phase = 'none' AND b IS NOT NULL THEN [b.h] WHEN phase = 'static' AND b IS NOT NULL THEN list_append(hs, b.h) WHEN phase = 'track' THEN []::DOUBLE[] ELSE hs END AS hs2
 FROM (SELECT *, 1.0::DOUBLE / 30 AS d, CASE WHEN list_min(ds) < CASE phase WHEN 'none' THEN 1e9 WHEN 'static' THEN 60 ELSE 120 END THEN fs[list_position(ds, list_min(ds))] END AS b
 FROM (SELECT *, list_transform(fs, lambda q: CASE WHEN phase = 'none' THEN -q.conf ELSE sqrt((q.cx - cx) * (q.cx - cx) + (q.cy - cy) * (q.cy - cy)) END) AS ds
 FROM (SELECT r.* EXCLUDE (n, src), g.k AS n, g.bs, list_filter(g.bs, lambda q: q.conf >= 0.3) AS fs FROM r JOIN g ON g.video_id = r.video_id AND g.k = r.n + 1))))))))
SELECT video_id, n AS k, src, round(CASE WHEN src = 'none' THEN NULL WHEN phase = 'track' THEN y ELSE cy END, 6) AS y, round(CASE WHEN src = 'none' THEN NULL WHEN phase = 'track' THEN 0.0 - v ELSE 0 END, 6) AS v, round(mpp, 6) AS mpp, round(size, 6) AS size FROM r WHERE n > 0""")
def gated_filter(spark, d):
    return rounded(trackers.gated_filter(numbered(spark, d), "video_id", "k"))


@query(f"""WITH RECURSIVE {NUMBERED}, g AS (SELECT video_id, k, max(frame_idx) / 30.0::DOUBLE AS t, CASE WHEN k % 15 = 1 THEN max(CASE WHEN pos = 0 THEN cy END) END AS z, CASE WHEN count(*) >= 5 THEN median((h - 50) / 50) END AS dm FROM nb GROUP BY 1, 2),
r AS (SELECT video_id, k, t, 'start' AS src, z AS place, z * 0.01::DOUBLE AS y, 0.0::DOUBLE AS v, 0.0::DOUBLE AS a, 0.001::DOUBLE AS p00, 0.0::DOUBLE AS p01, 0.0::DOUBLE AS p02, 0.1::DOUBLE AS p11, 0.0::DOUBLE AS p12, 1.0::DOUBLE AS p22 FROM g WHERE k = 1
UNION ALL SELECT video_id, k, t, CASE WHEN z IS NOT NULL THEN 'absolute' WHEN dm IS NOT NULL THEN 'moved' ELSE 'predicted' END, place, {corrected('z IS NOT NULL OR dm IS NOT NULL', 'place * 0.01::DOUBLE', '0.0004::DOUBLE')}
 FROM (SELECT video_id, k, t, z, dm, CASE WHEN z IS NOT NULL THEN z WHEN dm IS NOT NULL THEN place + dm ELSE place END AS place, {MOVED}
 FROM (SELECT *, 25.0 * e * e AS n00, 25.0 * e * d AS n01, 25.0 * e AS n02, 25.0 * d * d AS n11, 25.0 * d AS n12, 25.0::DOUBLE AS n22
 FROM (SELECT {HALF} FROM (SELECT g.video_id, g.k, g.t, g.z, g.dm, r.place, y, v, a, p00, p01, p02, p11, p12, p22, CASE WHEN g.t - r.t > 0 THEN g.t - r.t ELSE 1.0::DOUBLE / 60 END AS d FROM r JOIN g ON g.video_id = r.video_id AND g.k = r.k + 1)))))
SELECT video_id, k, src, round(y, 6) AS y, round(v, 6) AS v FROM r""")
def displaced_filter(spark, d):
    b = numbered(spark, d)
    f = b.where("pos = 0").select("video_id", "k", (F.col("frame_idx") / 30.0).alias("t"), F.when(F.col("k") % 15 == 1, F.col("cy")).alias("place"))
    return rounded(trackers.displaced_filter(f, b.select("video_id", "k", ((F.col("h") - 50) / 50).alias("step")), "video_id", "k", "t", "place", "step", 0.01))


@query(f"""WITH RECURSIVE {NUMBERED}, q AS (SELECT video_id, k, cx * 3 AS cx, cy * 3 AS cy, h, conf, row_number() OVER w AS n, lead(k) OVER w IS DISTINCT FROM k AS final FROM nb WINDOW w AS (PARTITION BY video_id ORDER BY k, pos)),
r AS (SELECT video_id, 0::BIGINT AS n, 0::BIGINT AS k, []::STRUCT(x DOUBLE, y DOUBLE, o STRUCT(f BIGINT, y DOUBLE, h DOUBLE)[])[] AS cl, 0.0::DOUBLE AS target, NULL::STRUCT(x DOUBLE, y DOUBLE, o STRUCT(f BIGINT, y DOUBLE, h DOUBLE)[]) AS ad FROM (SELECT DISTINCT video_id FROM q)
UNION ALL SELECT video_id, n, k, CASE WHEN ad IS NULL THEN c2 ELSE [] END, CASE WHEN ad IS NULL THEN target ELSE ad.y END, ad
 FROM (SELECT *, CASE WHEN final THEN list_filter(c2, lambda c: len(c.o) >= 4 AND list_aggregate(list_transform(c.o, lambda p: p.y), 'stddev_pop') > 40 AND abs(c.o[-1].y - target) > 60)[1] END AS ad
 FROM (SELECT *, CASE WHEN final THEN list_filter(list_transform(c1, lambda c: {{'x': c.x, 'y': c.y, 'o': list_filter(c.o, lambda p: p.f >= k - 90)}}), lambda c: len(c.o) > 0) ELSE c1 END AS c2
 FROM (SELECT *, CASE WHEN conf < 0.3 THEN cl WHEN hit IS NULL THEN list_append(cl, {{'x': 0.7::DOUBLE * cx + 0.3::DOUBLE * cx, 'y': 0.7::DOUBLE * cy + 0.3::DOUBLE * cy, 'o': [{{'f': k, 'y': cy, 'h': h}}]}})
  ELSE list_transform(cl, lambda c, i: CASE WHEN i = hit THEN {{'x': 0.7::DOUBLE * cx + 0.3::DOUBLE * c.x, 'y': 0.7::DOUBLE * cy + 0.3::DOUBLE * c.y, 'o': list_append(c.o, {{'f': k, 'y': cy, 'h': h}})}} ELSE c END) END AS c1
 FROM (SELECT r.video_id, q.n, q.k, q.cx, q.cy, q.h, q.conf, q.final, r.cl, r.target, list_position(list_transform(r.cl, lambda c: sqrt((q.cx - c.x) * (q.cx - c.x) + (q.cy - c.y) * (q.cy - c.y)) < 60), true) AS hit FROM r JOIN q ON q.video_id = r.video_id AND q.n = r.n + 1)))))
SELECT video_id, k, round(ad.x, 6) AS cx, round(ad.y, 6) AS cy, round(ad.o[-1].h, 6) AS h, len(ad.o) AS hits FROM r WHERE ad IS NOT NULL""")
def watch_clusters(spark, d):
    b = numbered(spark, d).withColumn("cx", F.col("cx") * 3).withColumn("cy", F.col("cy") * 3)
    return rounded(trackers.watch_clusters(b, "video_id", "k"))


TURNS = f"""{FRAMES}, z AS (SELECT video_id, idx, conf * 100 + idx * 1e-5 AS y FROM f), l AS (SELECT *, lag(y) OVER w AS a, lead(y) OVER w AS b FROM z WINDOW w AS (PARTITION BY video_id ORDER BY idx))"""


def turns(spark, d):
    return frames(spark, d).select("video_id", "idx", (F.col("conf") * 100 + F.col("idx") * 1e-5).alias("y"))


@query(f"""WITH {TURNS}, lim AS (SELECT video_id, quantile_cont(y, 0.6) AS q FROM z GROUP BY 1), p AS (SELECT * FROM l WHERE y > a AND y > b AND y > 10), t AS (SELECT l.* FROM l JOIN lim USING (video_id) WHERE l.y < a AND l.y < b AND l.y < q),
h AS (SELECT p.video_id, p.idx, p.y, (SELECT min(t.idx) FROM t WHERE t.video_id = p.video_id AND t.idx > p.idx + 4) AS hit, (SELECT arg_min(z.idx, z.y) FROM z WHERE z.video_id = p.video_id AND z.idx BETWEEN p.idx AND p.idx + 90) AS low FROM p)
SELECT h.video_id, h.idx, coalesce(hit, low) AS "end", CASE WHEN hit IS NULL THEN 'lowest' ELSE 'trough' END AS found, round(h.y, 6) AS peak_value, round(z.y, 6) AS end_value FROM h JOIN z ON z.video_id = h.video_id AND z.idx = coalesce(hit, low)""")
def peak_troughs(spark, d):
    z = turns(spark, d)
    w = windows.by("video_id", "idx")
    near = z.withColumn("a", F.lag("y").over(w)).withColumn("b", F.lead("y").over(w))
    return rounded(peaks.peak_troughs(z, near.where("y > a and y > b and y > 10"), near.where("y < a and y < b"), "video_id", "idx", "y", 4, 90))


@query(f"""WITH RECURSIVE {TURNS}, e AS (SELECT video_id, idx, y, row_number() OVER (PARTITION BY video_id ORDER BY idx) AS n, count(*) OVER (PARTITION BY video_id) AS m FROM l WHERE y > a AND y > b),
k AS (SELECT video_id, n, m, idx AS i, y AS v, NULL::BIGINT AS done, NULL::DOUBLE AS top FROM e WHERE n = 1
UNION ALL SELECT e.video_id, e.n, e.m, CASE WHEN e.idx - k.i < 10 AND e.y <= k.v THEN k.i ELSE e.idx END, CASE WHEN e.idx - k.i < 10 AND e.y <= k.v THEN k.v ELSE e.y END, CASE WHEN e.idx - k.i >= 10 THEN k.i END, CASE WHEN e.idx - k.i >= 10 THEN k.v END FROM k JOIN e ON e.video_id = k.video_id AND e.n = k.n + 1)
SELECT video_id, done AS idx, round(top, 6) AS y FROM k WHERE done IS NOT NULL UNION ALL SELECT video_id, i, round(v, 6) FROM k WHERE n = m""")
def near_peaks_merged(spark, d):
    w = windows.by("video_id", "idx")
    near = turns(spark, d).withColumn("a", F.lag("y").over(w)).withColumn("b", F.lead("y").over(w)).where("y > a and y > b")
    return rounded(folds.merge_peaks(near, "video_id", "idx", "y", 10))


@query()
def spline_velocity(spark, d):
    f = frames(spark, d).select("video_id", "idx", "y")
    return rounded(splines.smoothing_spline(f, "video_id", "idx", "y", 3, 0.05).select("video_id", "idx", "spline", "slope", "fits"))


WAVE = f"""{FRAMES}, wv AS (SELECT video_id, idx, idx / 30.0::DOUBLE AS t, 0.5 * conf - idx * 0.001 AS y, (CASE WHEN idx % 7 < 3 THEN -0.3 WHEN idx % 7 < 5 THEN 0.4 ELSE 0.0 END) * conf AS v FROM f)"""


@query(f"""WITH RECURSIVE {WAVE}, s AS (SELECT *, lead(v) OVER (PARTITION BY video_id ORDER BY idx) AS vn, count(*) OVER (PARTITION BY video_id) AS n FROM wv),
k AS (SELECT video_id, idx, 'IDLE' AS st, NULL::BIGINT AS b, NULL::DOUBLE AS bt, NULL::DOUBLE AS y0, false AS hit, NULL::DOUBLE AS t, NULL::DOUBLE AS y FROM s WHERE idx = 0
UNION ALL SELECT video_id, i, CASE WHEN down THEN 'DOWN' WHEN up THEN 'UP' WHEN fin THEN 'IDLE' ELSE st END, CASE WHEN up THEN i ELSE b END, CASE WHEN up THEN nt ELSE bt END, CASE WHEN up THEN ny ELSE y0 END, fin, nt, ny
 FROM (SELECT k.video_id, s.idx AS i, s.t AS nt, s.y AS ny, st, b, bt, y0, live AND st = 'IDLE' AND s.v < -0.08 AS down, live AND st = 'DOWN' AND s.v >= -0.02 AND s.vn > 0.02 AS up, live AND st = 'UP' AND s.v <= 0.02 AND s.vn < 0.02 AS fin
  FROM k JOIN (SELECT *, idx < n - 2 AS live FROM s) s ON s.video_id = k.video_id AND s.idx = k.idx + 1))
SELECT video_id, b AS "start", idx AS "end", round(t - bt, 6) AS duration_s, round(abs(y - y0), 6) AS rom, t - bt >= 0.05 AND abs(y - y0) >= 0.12 AS accepted, t - bt < 0.05 AS short, abs(y - y0) < 0.12 AS shallow FROM k WHERE hit""")
def traced_repetitions(spark, d):
    c = F.col("conf")
    f = frames(spark, d).select("video_id", "idx", (F.col("idx") / 30.0).alias("t"), (0.5 * c - F.col("idx") * 0.001).alias("y"), (F.when(F.col("idx") % 7 < 3, -0.3).when(F.col("idx") % 7 < 5, 0.4).otherwise(0.0) * c).alias("v"))
    return rounded(folds.traced(f, "video_id", "idx", min_s=0.05).select("video_id", "start", "end", "duration_s", "rom", "accepted", "short", "shallow"))


@query("""WITH e AS (SELECT label, vec_id, embedding AS v, lag(embedding) OVER w AS b, row_number() OVER w - 1 AS i FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id))
SELECT label, vec_id, round(list_avg(list_transform(range(1, len(v) + 1), lambda j: abs(CAST(v[j] AS DOUBLE) - CAST(b[j] AS DOUBLE)))), 6) AS motion FROM e WHERE b IS NOT NULL AND i % 15 = 0""")
def motion_scores(spark, d):
    out = rounded(windows.motion_scores(table(spark, d, "embeddings"), "label", "vec_id", "embedding").select("label", "vec_id", "motion"))
    return out.withColumn("label", F.col("label").cast("int"))


@query("""SELECT c_custkey AS video_id, CASE WHEN c_acctbal > 0 THEN round(c_acctbal, 6) ELSE 30.0 END AS fps, CASE WHEN c_custkey % 90 < 30 THEN 'VIDEO_ERROR' END AS status FROM customer""")
def video_checks(spark, d):
    meta = table(spark, d, "customer").select(F.col("c_custkey").alias("video_id"), F.col("c_acctbal").alias("fps"), (F.col("c_custkey") % 90).alias("n"))
    return rounded(meta.select("video_id", C.usable_fps(F.col("fps")).alias("fps"), C.video_error(F.col("n")).alias("status")))


@query()
def named_pipelines(spark, d):
    """The five pipelines over the heights of each frame's first box, weak ones counting as missing. A video is 400 frame numbers on end, so that videos keep their length as the table grows; frames are numbered anew, as those without a box have no row."""
    seen = F.col("conf") >= 0.1
    s = boxes(spark, d, first=True).select(F.floor(F.col("frame") / 400).alias("video_id"), "frame", F.when(seen, F.col("cx")).alias("cx"), F.when(seen, F.col("h")).alias("cy"))
    idx = F.row_number().over(windows.by("video_id", "frame")) - 1
    points = pipelines.dealt(s).select("video_id", idx.cast("long").alias("idx"), "cx", "cy")
    return rounded(pipelines.run(points, pipelines.Setup(scale=0.005)))


def hybrid_tracks(spark, d):
    """Boxes on a wave for the hybrid tracker: each frame's first box is the target's, the second one a bar that moves in each third video, others lie still. A video is 800
    frame numbers on end. In stretches of the wave the target is hidden, or its fit wanders off."""
    b = shots(spark, d).withColumn("video_id", F.floor(F.col("frame") / 800))
    b = b.withColumn("k", F.dense_rank().over(Window.partitionBy("video_id").orderBy("frame")).cast("long"))
    k, own, other = F.col("k"), F.col("pos") == 0, (F.col("pos") == 1) & (F.col("video_id") % 3 == 0)
    wave, hidden = 300 + 60 * F.sin(k / 25), ((k % 120).between(70, 95)) | ((k % 400).between(260, 330))
    cx = F.when(own, 320 + F.col("cx") % 5).when(other, 100 + F.col("cx") % 20).otherwise(560 + F.col("cx") % 3)
    cy = F.when(own, wave + F.col("cy") % 7 - 3).when(other, 430 + 90 * F.sin(k / 40)).otherwise(80 + F.col("cy") % 3)
    h, match = 45 + F.col("h") % 10, F.col("w") % 10 / 10
    seen = b.select("video_id", "k", "pos", cx.alias("cx"), cy.alias("cy"), h.alias("w"), h.alias("h"), F.when(own & hidden, 0.1).otherwise(0.2 + 0.8 * F.col("conf")).alias("conf"), match.alias("match"))
    off = F.when(k % 50 == 49, 100).otherwise(k % 30 / 3)
    fits = b.where(own).select("video_id", "k", F.lit(321.0).alias("fx"), (wave + off).alias("fy"), F.when(hidden, 0.1).otherwise(0.4 + 0.6 * F.col("conf")).alias("score"))
    return hybrid.hybrid(seen, fits, "video_id", "k", 640, 640)


@query()
def hybrid_tracker(spark, d):
    return rounded(hybrid_tracks(spark, d))


@query()
def hybrid_report(spark, d):
    return rounded(hybrid.report(hybrid_tracks(spark, d), "video_id"))


@query(f"""WITH RECURSIVE {NUMBERED}, g AS (SELECT video_id, k, list({{'pos': pos, 'x': cx, 'y': cy}} ORDER BY pos) AS bs FROM nb GROUP BY 1, 2), l AS (SELECT video_id, max(k) AS last FROM g GROUP BY 1),
r AS (SELECT g.video_id, k, last, 1::BIGINT AS i, []::STRUCT(id BIGINT, x DOUBLE, y DOUBLE, hits BIGINT, miss BIGINT)[] AS alive, bs AS free, 0::BIGINT AS next, NULL::BIGINT AS f, []::STRUCT(track BIGINT, pos BIGINT, hits BIGINT)[] AS o FROM g JOIN l USING (video_id) WHERE k = 1
UNION ALL SELECT video_id, CASE WHEN over THEN k + 1 ELSE k END, last, CASE WHEN over THEN 1 ELSE i + 1 END,
 CASE WHEN over THEN list_concat(list_filter(alive, lambda a: a.miss <= 5), list_transform(free, lambda b, j: {{'id': next + j - 1, 'x': b.x, 'y': b.y, 'hits': 1::BIGINT, 'miss': 0::BIGINT}}))
  ELSE list_transform(alive, lambda a, j: CASE WHEN j <> i THEN a WHEN hit IS NULL THEN {{'id': a.id, 'x': a.x, 'y': a.y, 'hits': a.hits, 'miss': a.miss + 1}} ELSE {{'id': a.id, 'x': free[hit].x, 'y': free[hit].y, 'hits': a.hits + 1, 'miss': 0::BIGINT}} END) END,
 CASE WHEN over THEN bs ELSE list_filter(free, lambda b, j: hit IS NULL OR j <> hit) END, CASE WHEN over THEN next + len(free) ELSE next END, k,
 CASE WHEN over THEN list_transform(free, lambda b, j: {{'track': next + j - 1, 'pos': b.pos, 'hits': 1::BIGINT}}) WHEN hit IS NULL THEN [] ELSE [{{'track': alive[i].id, 'pos': free[hit].pos, 'hits': alive[i].hits + 1}}] END
 FROM (SELECT *, CASE WHEN NOT over AND list_min(ds) < 40 THEN list_position(ds, list_min(ds)) END AS hit
 FROM (SELECT r.*, g.bs, i > len(alive) AS over, list_transform(free, lambda b: sqrt((b.x - alive[i].x) * (b.x - alive[i].x) + (b.y - alive[i].y) * (b.y - alive[i].y))) AS ds FROM r LEFT JOIN g ON g.video_id = r.video_id AND g.k = r.k + 1 WHERE r.k <= last)))
SELECT video_id, f AS k, u.track AS track, u.pos AS pos, u.hits AS hits FROM (SELECT video_id, f, unnest(o) AS u FROM r)""")
def pending_tracks(spark, d):
    return tracks.pending(numbered(spark, d), "video_id", "k")
