"""Queries on series, scenes and variants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as W
from ..operators import variants as V
from ..sources import tables
from ..sources.shared import large, settled
from .registry import register

DOT = "list_dot_product(list_transform({a}, lambda x: CAST(x AS DOUBLE)), list_transform({b}, lambda x: CAST(x AS DOUBLE)))"
COS = "list_cosine_similarity(list_transform({a}, lambda x: CAST(x AS DOUBLE)), list_transform({b}, lambda x: CAST(x AS DOUBLE)))"
register("w1_consecutive_distance", f"WITH l AS (SELECT *, lag(embedding) OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM fx_frames) SELECT video_id, frame_idx, CASE WHEN p IS NULL THEN 0e0 ELSE 1 - {COS.format(a='embedding', b='p')} END AS distance FROM l", "distance")(
    lambda s: W.consecutive_distance(s("fx_frames")).select("video_id", "frame_idx", "distance")
)
register("w1_consecutive_mad", "WITH l AS (SELECT *, lag(embedding) OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM fx_frames) SELECT video_id, frame_idx, CASE WHEN p IS NULL THEN 0e0 ELSE list_avg(list_transform(list_zip(embedding, p), lambda z: abs(CAST(z[1] AS DOUBLE)-CAST(z[2] AS DOUBLE)))) END AS distance FROM l", "distance")(
    lambda s: W.consecutive_distance(s("fx_frames"), "mad").select("video_id", "frame_idx", "distance")
)
register("w2_normalize_by_max", "SELECT video_id, frame_idx, CASE WHEN max(mad) OVER (PARTITION BY video_id) > 0 THEN mad/max(mad) OVER (PARTITION BY video_id) ELSE mad END AS mad FROM fx_series", "mad")(
    lambda s: W.normalize_by_max(s("fx_series"), "mad").select("video_id", "frame_idx", "mad")
)
FW = "fw AS (SELECT video_id, CAST(frame_time*2 AS INT) AS frame_idx, list_sort(list(tok)) AS words FROM fx_ocr GROUP BY 1, 2)"


def frame_words(s):
    return s("fx_ocr").groupBy("video_id", (F.col("frame_time") * 2).cast("int").alias("frame_idx")).agg(F.array_sort(F.collect_list("tok")).alias("words"))


JC = f"""{FW}, sm AS (SELECT *, lag(words) OVER (PARTITION BY video_id ORDER BY frame_idx) AS p FROM fw WHERE frame_idx % 3 = 0),
ch AS (SELECT video_id, frame_idx, CASE WHEN p IS NULL THEN 0e0 ELSE 1 - len(list_intersect(words, p))/len(list_distinct(list_concat(words, p))) END AS d FROM sm),
c2 AS (SELECT video_id, frame_idx, CASE WHEN d > 0.5e0 THEN d ELSE 0e0 END AS d FROM ch),
bk AS (SELECT fw.video_id, fw.frame_idx, coalesce(first_value(d IGNORE NULLS) OVER (PARTITION BY fw.video_id ORDER BY fw.frame_idx ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING), 0e0) AS signal FROM fw LEFT JOIN c2 ON c2.video_id=fw.video_id AND c2.frame_idx=fw.frame_idx),
jc AS (SELECT video_id, frame_idx, CASE WHEN max(signal) OVER (PARTITION BY video_id) > 0 THEN signal/max(signal) OVER (PARTITION BY video_id) ELSE signal END AS signal FROM bk)"""
register("w3_jaccard_change_signal", f"WITH {JC} SELECT * FROM jc", "signal")(lambda s: W.jaccard_change_signal(frame_words(s)))


def cuts(s):
    return s("fx_series").where(F.col("frame_idx") % 9 == 4).select("video_id", (F.col("t") + 0.1).alias("t"))


def grid(s):
    return s("fx_series").select("video_id", "frame_idx", F.col("t").alias("frame_time"))


BS = "bs AS (SELECT s.video_id, s.frame_idx, CASE WHEN EXISTS (SELECT 1 FROM fx_series c WHERE c.video_id=s.video_id AND c.frame_idx % 9 = 4 AND c.frame_idx = s.frame_idx) THEN 1e0 ELSE 0e0 END AS signal FROM fx_series s)"
register("w4_boundary_signal", f"WITH {BS} SELECT * FROM bs", "signal")(lambda s: W.boundary_signal(cuts(s), grid(s)))


def signal(s, c):
    return W.normalize_by_max(s("fx_series").select("video_id", "frame_idx", F.col(c).alias("signal")), "signal")


def fused(s):
    text = s("fx_series").select("video_id", "frame_idx", F.when(F.length("video_id") % 2 == 0, F.col("ssim")).otherwise(0.0).alias("signal"))
    return W.fuse_signals(W.boundary_signal(cuts(s), grid(s)), signal(s, "mad"), text).join(s("fx_series").select("video_id", "frame_idx", "t"), ["video_id", "frame_idx"])


FUSED = f"{BS}, ms AS (SELECT video_id, frame_idx, t, ssim, mad/max(mad) OVER (PARTITION BY video_id) AS b FROM fx_series), f3 AS (SELECT ms.video_id, ms.frame_idx, ms.t, bs.signal AS a, b, CASE WHEN length(ms.video_id) % 2 = 0 THEN ssim ELSE 0e0 END AS c FROM ms JOIN bs USING (video_id, frame_idx)), fu AS (SELECT video_id, frame_idx, t, CASE WHEN max(c) OVER (PARTITION BY video_id) > 0 THEN 0.35e0*a+0.45e0*b+0.2e0*c ELSE (0.35e0*a+0.45e0*b)/0.8e0 END AS signal FROM f3)"
register("w5_fuse_signals", f"WITH {FUSED} SELECT * FROM fu", "t signal")(fused)
OTSU = """sp AS (SELECT video_id, min(mad) AS lo, max(mad) AS hi, avg(mad)+stddev_pop(mad) AS fb FROM fx_series GROUP BY 1), cd AS (SELECT s.video_id, mad AS x, i, lo+(hi-lo)*i/49 AS cut, fb FROM fx_series s JOIN sp USING (video_id), (SELECT unnest(range(0, 50)) AS i) r),
st AS (SELECT video_id, i, any_value(cut) AS cut, any_value(fb) AS fb, round(count(*) FILTER (x<cut)/count(*)*(count(*) FILTER (x>=cut)/count(*))*power(avg(x) FILTER (x<cut)-avg(x) FILTER (x>=cut), 2), 12) AS v FROM cd GROUP BY 1, 2),
ot AS (SELECT video_id, CASE WHEN v > 0 THEN cut ELSE fb END AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY coalesce(v, -1) DESC, i) AS rn FROM st) WHERE rn = 1)"""
register("w6_otsu_threshold", f"WITH {OTSU} SELECT * FROM ot", "threshold")(lambda s: W.otsu_threshold(s("fx_series"), "mad"))
BOUNDS = "ht AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) <= 2 THEN 0 ELSE 1 END AS nw FROM {src} WHERE {col} >= {thr}), is1 AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY frame_idx) AS isl FROM ht), bd AS (SELECT video_id, frame_idx, t, {col} AS score FROM (SELECT *, row_number() OVER (PARTITION BY video_id, isl ORDER BY {col} DESC, frame_idx) AS rn FROM is1) WHERE rn = 1)"
register("w7_find_boundaries", f"WITH {BOUNDS.format(src='fx_series', col='mad', thr='0.8e0')} SELECT * FROM bd", "t score")(lambda s: W.find_boundaries(s("fx_series"), "mad", F.lit(0.8)))


def guarded(s):
    series = s("fx_series").select("video_id", "frame_idx", "t", F.col("mad").alias("signal"))
    return W.density_guard(series, W.otsu_threshold(series))


register(
    "w8_density_guard",
    f"""WITH {OTSU}, ss AS (SELECT video_id, max(t) AS last_t, min(t) AS first_t, max(t)-min(t) AS dur, avg(mad)+0.5e0*stddev_pop(mad) AS soft FROM fx_series GROUP BY 1),
ts AS (SELECT video_id, last_t, first_t, dur, threshold AS base, unnest([0, 1, 2, 3, 4]) AS k, unnest([threshold, threshold*0.75e0, threshold*0.5e0, threshold*0.25e0, soft]) AS thr FROM ss JOIN ot USING (video_id)),
ht AS (SELECT s.video_id, k, frame_idx, s.t, mad, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY s.video_id, k ORDER BY frame_idx) <= 2 THEN 0 ELSE 1 END AS nw FROM fx_series s JOIN ts USING (video_id) WHERE mad >= thr),
is1 AS (SELECT *, sum(nw) OVER (PARTITION BY video_id, k ORDER BY frame_idx) AS isl FROM ht), bd AS (SELECT video_id, k, frame_idx, t, mad AS score FROM (SELECT *, row_number() OVER (PARTITION BY video_id, k, isl ORDER BY mad DESC, frame_idx) AS rn FROM is1) WHERE rn = 1),
gp AS (SELECT video_id, k, count(*) AS n, max(gap) AS g, min(t) AS t0, max(t) AS t1 FROM (SELECT *, t - lag(t) OVER (PARTITION BY video_id, k ORDER BY t) AS gap FROM bd) GROUP BY 1, 2),
rw AS (SELECT ts.*, coalesce(n, 0) AS n, 4e0*dur/60 AS expected, greatest(coalesce(g, 0e0), coalesce(t0-first_t, dur), coalesce(last_t-t1, dur)) AS longest FROM ts LEFT JOIN gp USING (video_id, k)),
md AS (SELECT *, max(n) FILTER (k = 0) OVER (PARTITION BY video_id) AS n0, max(thr) FILTER (k = 4) OVER (PARTITION BY video_id) AS thr4 FROM rw),
mo AS (SELECT *, CASE WHEN n0+1 < 0.5e0*expected THEN 'density-forced' WHEN n0 < 3 AND dur > 60 AND thr4 < base THEN 'fallback' ELSE 'natural' END AS mode FROM md),
pk AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN longest <= 30 OR n >= 0.8e0*expected THEN k ELSE 10-k END) AS rn FROM mo WHERE CASE mode WHEN 'density-forced' THEN k IN (1, 2, 3) WHEN 'fallback' THEN k = 4 ELSE k = 0 END)
SELECT pk.video_id, pk.mode, pk.thr AS threshold, bd.frame_idx, bd.t, bd.score FROM pk LEFT JOIN bd ON bd.video_id=pk.video_id AND bd.k=pk.k WHERE rn = 1""",
    "threshold t score",
)(guarded)
BUILT = BOUNDS.format(src="fx_series", col="mad", thr="0.8e0") + ", en AS (SELECT video_id, min(frame_idx) AS f0, min(t) AS t0, max(frame_idx) AS f1, max(t) AS t1 FROM fx_series GROUP BY 1), stt AS (SELECT video_id, f0 AS frame_idx, t0 AS t FROM en UNION ALL SELECT video_id, frame_idx, t FROM bd), sc AS (SELECT video_id, CAST(row_number() OVER w - 1 AS INT) AS scene_id, frame_idx AS start_idx, t AS t_start, lead(frame_idx) OVER w AS ni, lead(t) OVER w AS nt FROM stt WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx, t)), bsn AS (SELECT video_id, scene_id, start_idx, coalesce(ni, f1) AS end_idx, t_start, coalesce(nt, t1) AS t_end, coalesce(nt, t1)-t_start AS duration, coalesce(ni, f1)-start_idx+1 AS n_frames FROM sc JOIN en USING (video_id))"


def built(s):
    return W.build_scenes(W.find_boundaries(s("fx_series"), "mad", F.lit(0.8)), s("fx_series"))


register("w9_build_scenes", f"WITH {BUILT} SELECT * FROM bsn", "t_start t_end duration")(built)


def frame_scenes(s):
    f = s("fx_frames")
    return f.groupBy("video_id", F.floor(F.col("frame_idx") / 12).cast("int").alias("scene_id")).agg(F.min("frame_idx").alias("start_idx"), F.max("frame_idx").alias("end_idx"), F.count(F.lit(1)).cast("int").alias("n_frames"))


register(
    "w10_centroid_keyframe",
    f"WITH sc AS (SELECT video_id, CAST(floor(frame_idx/12) AS INT) AS scene_id, min(frame_idx) AS start_idx, max(frame_idx) AS end_idx, CAST(count(*) AS INT) AS n_frames FROM fx_frames GROUP BY 1, 2), mg AS (SELECT *, CASE WHEN n_frames >= 3 AND greatest(1, floor(n_frames*0.1e0)) < floor(n_frames/2) THEN greatest(1, floor(n_frames*0.1e0)) ELSE 0 END AS m FROM sc), inn AS (SELECT g.video_id, g.scene_id, f.frame_idx, f.frame_time, list_transform(f.embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM mg g JOIN fx_frames f ON f.video_id=g.video_id AND f.frame_idx BETWEEN g.start_idx+m AND g.end_idx-m), dm AS (SELECT video_id, scene_id, d, avg(e[d]) AS x FROM inn, (SELECT unnest(range(1, 65)) AS d) r GROUP BY 1, 2, 3), mn AS (SELECT video_id, scene_id, list(x ORDER BY d) AS mean FROM dm GROUP BY 1, 2), bst AS (SELECT inn.video_id, inn.scene_id, frame_time, row_number() OVER (PARTITION BY inn.video_id, inn.scene_id ORDER BY round(list_cosine_similarity(e, mean), 12) DESC, frame_idx) AS rn FROM inn JOIN mn USING (video_id, scene_id)) SELECT sc.video_id, sc.scene_id, CASE WHEN n_frames >= 3 THEN b.frame_time ELSE (start_idx + floor(n_frames/2))*0.5e0 END AS t_keyframe FROM sc LEFT JOIN bst b ON b.video_id=sc.video_id AND b.scene_id=sc.scene_id AND b.rn=1",
    "t_keyframe",
)(lambda s: W.centroid_keyframe(frame_scenes(s), s("fx_frames")).select("video_id", "scene_id", "t_keyframe"))


def short_scenes(s):
    f = s("fx_frames")
    return f.select("video_id", F.col("frame_idx").alias("scene_id"), F.col("frame_time").alias("t_start"), (F.col("frame_time") + 0.5).alias("t_end"), "embedding", F.array(F.concat(F.lit("w"), (F.col("frame_idx") % 5).cast("string"))).alias("words"))


register(
    "w11_merge_similar_short",
    "WITH g AS (SELECT video_id, list([{'a': frame_time, 'e': frame_time+0.5e0, 'v': list_transform(embedding, lambda q: CAST(q AS DOUBLE)), 'w': [concat('w', frame_idx % 5)]}] ORDER BY frame_idx) AS l FROM fx_frames GROUP BY 1), "
    "f AS (SELECT video_id, list_reduce(l, lambda acc, x: CASE WHEN x[1].e - x[1].a < 2 AND list_cosine_similarity(acc[-1].v, x[1].v) > 0.1e0 THEN list_append(acc[:-2], {'a': acc[-1].a, 'e': x[1].e, 'v': acc[-1].v, 'w': list_distinct(list_concat(acc[-1].w, x[1].w))}) ELSE list_append(acc, x[1]) END) AS s FROM g), "
    "u AS (SELECT video_id, unnest(s) AS s, generate_subscripts(s, 1) - 1 AS i FROM f) SELECT video_id, CAST(i AS INT) AS scene_id, s.a AS t_start, s.e AS t_end, array_to_string(list_sort(s.w), ' ') AS words FROM u",
    "t_start t_end",
)(lambda s: W.merge_similar_short(short_scenes(s), 2.0, 0.1).select("video_id", "scene_id", "t_start", "t_end", F.array_join("words", " ").alias("words")))
register(
    "w12_force_split",
    f"WITH {BUILT}, lg AS (SELECT *, start_idx+greatest(1, CAST(floor((end_idx-start_idx)/10) AS INT)) AS lo, end_idx-greatest(1, CAST(floor((end_idx-start_idx)/10) AS INT)) AS hi FROM bsn WHERE duration > 10 AND end_idx-start_idx >= 4), pk AS (SELECT lg.video_id, lg.scene_id, s.frame_idx, s.t, row_number() OVER (PARTITION BY lg.video_id, lg.scene_id ORDER BY round(0.6e0*mad+0.4e0*ssim, 12) DESC, s.frame_idx) AS rn FROM lg JOIN fx_series s ON s.video_id=lg.video_id AND s.frame_idx BETWEEN lo AND hi), c AS (SELECT b.*, p.frame_idx AS ci, p.t AS ct FROM bsn b LEFT JOIN pk p ON p.video_id=b.video_id AND p.scene_id=b.scene_id AND p.rn=1), u AS (SELECT video_id, start_idx, coalesce(ci, end_idx) AS end_idx, t_start, coalesce(ct, t_end) AS t_end FROM c UNION ALL SELECT video_id, ci, end_idx, ct, t_end FROM c WHERE ci IS NOT NULL) SELECT video_id, start_idx, end_idx, t_start, t_end, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start_idx, end_idx)-1 AS INT) AS scene_id, t_end-t_start AS duration FROM u",
    "t_start t_end duration",
)(lambda s: W.force_split(built(s), s("fx_series").select("video_id", "frame_idx", "t", F.col("mad").alias("visual"), F.col("ssim").alias("text")), 10.0))
SWD = "mk AS (SELECT video_id, scene_id, t_keyframe AS at FROM fx_scenes UNION ALL SELECT video_id, scene_id, t_start FROM fx_scenes), fr AS (SELECT DISTINCT video_id, frame_time FROM fx_ocr), nr AS (SELECT * FROM (SELECT mk.*, fr.frame_time, row_number() OVER (PARTITION BY mk.video_id, mk.scene_id, mk.at ORDER BY abs(fr.frame_time-mk.at), fr.frame_time) AS rn FROM mk JOIN fr ON fr.video_id=mk.video_id AND fr.frame_time BETWEEN mk.at-1 AND mk.at+1) WHERE rn=1), sw AS (SELECT nr.video_id, nr.scene_id, list_sort(list(DISTINCT o.tok)) AS words FROM nr JOIN fx_ocr o ON o.video_id=nr.video_id AND o.frame_time=nr.frame_time GROUP BY 1, 2), sx AS (SELECT s.*, coalesce(words, []) AS words FROM fx_scenes s LEFT JOIN sw USING (video_id, scene_id))"
register("w13_scene_words", f"WITH {SWD} SELECT video_id, scene_id, array_to_string(words, ' ') AS words FROM sx")(lambda s: W.scene_words(s("fx_scenes"), s("fx_ocr")).select("video_id", "scene_id", F.array_join("words", " ").alias("words")))
register(
    "g14_scene_quality",
    f"WITH {SWD} SELECT video_id, count(*) AS n_scenes, avg(t_end-t_start) AS mean_duration, median(t_end-t_start) AS median_duration, min(t_end-t_start) AS min_duration, max(t_end-t_start) AS max_duration, stddev_pop(t_end-t_start) AS std_duration, avg(CASE WHEN len(words)>0 THEN 1e0 ELSE 0e0 END) AS with_words, avg(len(words)) AS mean_words FROM sx GROUP BY 1",
    "mean_duration median_duration min_duration max_duration std_duration with_words mean_words",
)(lambda s: tables.scene_quality(W.scene_words(s("fx_scenes"), s("fx_ocr"))))
NEW_WORDS = "CASE frame_idx % 11 WHEN 10 THEN 3 WHEN 5 THEN 1 ELSE 0 END"
BT = f"x AS (SELECT s.*, {NEW_WORDS} AS new_words, th.threshold FROM fx_series s, (SELECT unnest([0.9e0, 0.95e0]) AS threshold) th), o AS (SELECT *, sum(CASE WHEN ssim < threshold OR new_words >= 1 OR frame_idx = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id, threshold ORDER BY frame_idx) AS isl FROM x), g AS (SELECT video_id, threshold, isl, min(t) AS t_start, max(t) + 0.5e0 AS t_end, min(frame_idx) AS start_frame_idx, max(frame_idx) AS end_frame_idx FROM o GROUP BY 1,2,3), bt AS (SELECT video_id, threshold, CAST(row_number() OVER (PARTITION BY video_id, threshold ORDER BY t_start)-1 AS INT) AS scene_id, t_start, t_end, t_end - t_start AS duration, t_start AS t_vis, start_frame_idx, end_frame_idx FROM g WHERE t_end-t_start >= 3)"
THRESHOLDS = [0.9, 0.95]


def with_new_words(s):
    return s("fx_series").withColumn("new_words", F.expr(NEW_WORDS))


def by_threshold(s):
    return W.scenes_by_threshold(with_new_words(s), THRESHOLDS, interval=0.5)


register("w14_scenes_by_threshold", f"WITH {BT} SELECT * FROM bt", "threshold t_start t_end duration t_vis")(by_threshold)
register(
    "w14_threshold_stats",
    f"WITH {BT}, n AS (SELECT video_id, threshold, count(*) FILTER (ssim < threshold) AS n_ssim_boundaries, count(*) FILTER (new_words >= 1) AS n_ocr_boundaries FROM x GROUP BY 1, 2), p AS (SELECT video_id, threshold, count(*) AS n, avg(duration) AS m, median(duration) AS md FROM bt GROUP BY 1, 2) SELECT n.video_id, n.threshold, n_ssim_boundaries, n_ocr_boundaries, coalesce(n, 0) AS n_scenes, round(coalesce(m, 0) + 1e-9, 2) AS mean_duration, round(coalesce(md, 0), 2) AS median_duration, greatest(0, n_ssim_boundaries + n_ocr_boundaries - coalesce(n, 0)) AS n_filtered_short FROM n LEFT JOIN p USING (video_id, threshold)",
    "threshold mean_duration median_duration",
)(lambda s: W.threshold_stats(by_threshold(s), with_new_words(s), THRESHOLDS))
register("w15_uniform_scenes", "WITH d AS (SELECT video_id, max(t) AS duration FROM fx_series GROUP BY 1), x AS (SELECT video_id, duration, unnest(range(0, CAST(greatest(ceil(duration/10), 1) AS BIGINT))) AS i FROM d) SELECT video_id, CAST(i AS INT) AS scene_id, i*10e0 AS t_start, least((i+1)*10e0, duration) AS t_end FROM x WHERE least((i+1)*10e0, duration)-i*10e0 >= 1", "t_start t_end")(
    lambda s: W.uniform_scenes(s("fx_series").groupBy("video_id").agg(F.max("t").alias("duration")))
)
RUNS = "lw AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) = 1 THEN 0 ELSE 1 END AS nw FROM fx_series WHERE frame_idx > 0 AND mad < 0.5e0), li AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY frame_idx) AS isl FROM lw), rn AS (SELECT video_id, min(frame_idx)-1 AS start_frame, max(frame_idx) AS end_frame, (min(frame_idx)-1)/2e0 AS start_sec, max(frame_idx)/2e0 AS end_sec, (max(frame_idx)-min(frame_idx)+2)/2e0 AS duration_sec, max(frame_idx)-min(frame_idx)+2 AS n_frames FROM li GROUP BY video_id, isl)"
register("w16_freeze_runs", f"WITH {RUNS} SELECT * FROM rn", "start_sec end_sec duration_sec")(lambda s: W.freeze_runs(s("fx_series")))
register("w17_freeze_summary", f"WITH {RUNS} SELECT video_id, count(*) AS n_freezes, sum(duration_sec) AS total_sec, string_agg(printf('%.1f', start_sec), ', ' ORDER BY start_sec) AS starts FROM rn GROUP BY 1", "total_sec")(lambda s: W.freeze_summary(W.freeze_runs(s("fx_series"))))
register("w17_freezes_side_by_side", f"WITH {RUNS}, k AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_frame) AS k FROM rn) SELECT video_id, {', '.join(f'max(start_sec) FILTER (k={i}) AS k{i}' for i in range(1, 4))} FROM k WHERE k <= 3 GROUP BY 1", "k1 k2 k3")(
    lambda s: W.freezes_side_by_side(W.freeze_runs(s("fx_series")), 3).withColumnsRenamed({"1": "k1", "2": "k2", "3": "k3"})
)
TR = "tr AS (SELECT video_id, frame_idx, t, CASE WHEN b AND NOT lo THEN 'diverge' WHEN NOT b AND lo THEN 'resync' END AS event, coalesce((t+pt)/2, t) AS t_mid FROM (SELECT *, mad < 0.5e0 AS lo, lag(mad < 0.5e0, 1, TRUE) OVER w AS b, lag(t) OVER w AS pt FROM fx_series WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx)))"
register("w18_transitions", f"WITH {TR} SELECT * FROM tr WHERE event IS NOT NULL", "t t_mid")(lambda s: W.transitions(s("fx_series"), 0.5))
register("w19_mismatch_duration", f"WITH {TR}, ev AS (SELECT *, min(CASE WHEN event='resync' THEN t END) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS u FROM tr WHERE event IS NOT NULL) SELECT video_id, t AS t_start, u AS t_end, u-t AS duration FROM ev WHERE event='diverge'", "t_start t_end duration")(
    lambda s: W.mismatch_duration(W.transitions(s("fx_series"), 0.5))
)
register("w20_mad_split_stats", "SELECT video_id, count(*) FILTER (mad<0.5e0) AS n_below, avg(mad) FILTER (mad<0.5e0) AS mean_below, max(mad) FILTER (mad<0.5e0) AS max_below, count(*) FILTER (mad>=0.5e0) AS n_above, avg(mad) FILTER (mad>=0.5e0) AS mean_above, min(mad) FILTER (mad>=0.5e0) AS min_above FROM fx_series GROUP BY 1", "mean_below max_below mean_above min_above")(
    lambda s: W.mad_split_stats(s("fx_series"), 0.5)
)
register("w21_adaptive_dip_threshold", "WITH p AS (SELECT video_id, quantile_cont(ssim, 0.5) AS m, quantile_cont(ssim, 0.01) AS l FROM fx_series GROUP BY 1) SELECT video_id, CASE WHEN m >= 0.999e0 THEN 0.999e0 ELSE greatest(0.9e0, least(0.999e0, m-0.3e0*(m-l))) END AS threshold FROM p", "threshold")(
    lambda s: W.adaptive_dip_threshold(s("fx_series"))
)
DIPS = "dl AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video_id ORDER BY t) <= 2 THEN 0 ELSE 1 END AS nw FROM fx_series WHERE ssim < 0.95e0), di AS (SELECT *, sum(nw) OVER (PARTITION BY video_id ORDER BY t) AS isl FROM dl), dp AS (SELECT video_id, min(t) AS start, max(t) AS \"end\", max(t)-min(t) AS duration, min(ssim) AS min_ssim, avg(ssim) AS mean_ssim, avg(t) AS center, count(*) AS n_points FROM di GROUP BY video_id, isl HAVING max(t)-min(t) >= 0.5e0 OR count(*) >= 2)"
register("w22_dip_regions", f"WITH {DIPS} SELECT * FROM dp", 'start "end" duration min_ssim mean_ssim center')(lambda s: W.dip_regions(s("fx_series")))


def frames_of(s, k):
    f = s("fx_frames").where(F.col("video_id") == f"e{k}")
    return f.select(F.lit("p").alias("pair_id"), "frame_time", "embedding")


def all_pairs(s, shift):
    """Each recording against itself, some moments later."""
    f = s("fx_frames").select(F.col("video_id").alias("pair_id"), (F.col("frame_time") + shift).alias("frame_time"), "embedding")
    return f


PS = "SELECT a.video_id AS pair_id, a.frame_time AS t, {v} AS value FROM fx_frames a JOIN fx_frames b ON b.video_id=a.video_id AND b.frame_idx=a.frame_idx-2"
register("w27_paired_series", PS.format(v=COS.format(a="a.embedding", b="b.embedding")), "t value")(lambda s: W.paired_series(all_pairs(s, 0.0), all_pairs(s, 1.0)))
register(
    "w24_best_offset",
    f"WITH p AS (SELECT a.video_id AS pair_id, a.frame_time AS t_ref, b.frame_time+1-a.frame_time AS \"offset\", round({COS.format(a='a.embedding', b='b.embedding')}, 12) AS sim FROM fx_frames a JOIN fx_frames b ON b.video_id=a.video_id AND b.frame_time+1 BETWEEN a.frame_time-3 AND a.frame_time+3), r AS (SELECT *, row_number() OVER (PARTITION BY pair_id, t_ref ORDER BY sim DESC, abs(\"offset\"), \"offset\") AS rn FROM p) SELECT pair_id, t_ref, \"offset\", sim FROM r WHERE rn=1",
    't_ref "offset" sim',
)(lambda s: W.best_offset(all_pairs(s, 0.0), all_pairs(s, 1.0)))
register(
    "w25_check_expected_delay",
    f"WITH {DIPS}, es AS (SELECT video_id, t + 0.2e0 AS t_est, 2e0 AS expected FROM fx_series), m AS (SELECT es.*, dp.center, dp.duration AS dip_duration, row_number() OVER (PARTITION BY es.video_id, es.t_est ORDER BY abs(center-t_est), center) AS rn FROM es LEFT JOIN dp ON dp.video_id=es.video_id AND dp.center BETWEEN t_est-1 AND t_est+1) SELECT video_id, t_est, expected, center, dip_duration, CASE WHEN center IS NULL THEN 'NO_DIP' WHEN abs(dip_duration-expected) <= 1.5e0 THEN 'OK' ELSE 'CHECK' END AS tag FROM m WHERE rn=1",
    "t_est expected center dip_duration",
)(lambda s: W.check_expected_delay(W.dip_regions(s("fx_series")), s("fx_series").select("video_id", (F.col("t") + 0.2).alias("t_est"), F.lit(2.0).alias("expected"))))
register(
    "w26_rebase_timeline",
    "SELECT e.video_id, e.keyword_id AS event_id, e.t_narr AS t, e.t_narr - coalesce((SELECT sum(d.delay) FROM (SELECT video_id, delay_level*1e0 AS delay, 100e0*delay_level AS t_delay FROM fx_variants) d WHERE d.video_id=e.video_id AND d.t_delay < e.t_narr), 0) AS t_base FROM fx_align e",
    "t t_base",
)(lambda s: W.rebase_timeline(s("fx_align").select("video_id", F.col("keyword_id").alias("event_id"), F.col("t_narr").alias("t")), s("fx_variants").select("video_id", (F.col("delay_level") * 100.0).alias("t_delay"), F.col("delay_level").cast("double").alias("delay"))))

# --- variants ---------------------------------------------------------------------------------------------------------
register(
    "a17_plan_pairs",
    "WITH h AS (SELECT set_name, bool_or(delay_level=1) AS h1 FROM fx_variants GROUP BY 1) SELECT a.set_name, a.delay_level || 'v' || b.delay_level AS pair, a.video_id AS video_a, b.video_id AS video_b, CASE WHEN a.delay_level=0 THEN 'baseline' ELSE 'inter' END AS kind, CAST(b.delay_level-a.delay_level AS DOUBLE) AS expected_delay FROM fx_variants a JOIN fx_variants b ON a.set_name=b.set_name AND a.delay_level<b.delay_level JOIN h ON h.set_name=a.set_name WHERE a.delay_level IN (0,1) OR (a.delay_level=3 AND NOT h1)",
    "expected_delay",
)(lambda s: V.plan_pairs(s("fx_variants")))


def set_dips(s):
    """Dips of every recording: six recordings are the pairs of a set, and there are as many sets as the table gives."""
    n = F.substring("video_id", 2, 9).cast("int")
    pair = F.element_at(F.array(*map(F.lit, ["0v1", "0v3", "1v3", "1v5", "3v5", "0v5"])), (n % 6 + 1).cast("int"))
    d = W.dip_regions(s("fx_series"))
    return d.select(F.concat(F.lit("S"), F.floor(n / 6).cast("string")).alias("set_name"), pair.alias("pair"), F.when(pair.startswith("0"), "baseline").otherwise("inter").alias("kind"), "center", "duration")


SDIPS = DIPS + """, sd AS (SELECT 'S' || CAST(floor(n/6) AS INT) AS set_name, ['0v1','0v3','1v3','1v5','3v5','0v5'][n % 6 + 1] AS pair, CASE WHEN n % 6 IN (2, 3, 4) THEN 'inter' ELSE 'baseline' END AS kind, center, duration FROM (SELECT *, CAST(substring(video_id, 2) AS INT) AS n FROM dp)),
cl AS (SELECT *, sum(nw) OVER (PARTITION BY set_name ORDER BY center, pair, duration ROWS UNBOUNDED PRECEDING) AS cluster FROM (SELECT *, CASE WHEN center - lag(center) OVER (PARTITION BY set_name ORDER BY center, pair, duration) <= 3 THEN 0 ELSE 1 END AS nw FROM sd)),
iv AS (SELECT set_name, cluster, pair, last(duration ORDER BY center, duration) AS d FROM cl WHERE kind = 'inter' GROUP BY 1, 2, 3),
cc AS (SELECT set_name, cluster, avg(center) AS t, string_agg(DISTINCT pair, ',' ORDER BY pair) AS evidence, count(*) FILTER (kind='inter') AS n_inter, count(*) FILTER (kind='baseline') AS n_baseline FROM cl GROUP BY 1, 2),
cd AS (SELECT cc.set_name, CAST(cc.cluster AS BIGINT) AS cluster, t, evidence, n_inter, n_baseline, CASE WHEN n_inter >= 2 THEN 'high' WHEN n_inter >= 1 THEN 'medium' ELSE 'low' END AS confidence,
  round_even(coalesce(b.d/4, a.d/2), 1) AS delay_1, round_even(coalesce(c.d/2*3, a.d/2*3), 1) AS delay_3, round_even(coalesce(c.d/2*5, b.d/4*5), 1) AS delay_5
  FROM cc LEFT JOIN iv a ON a.set_name=cc.set_name AND a.cluster=cc.cluster AND a.pair='1v3' LEFT JOIN iv b ON b.set_name=cc.set_name AND b.cluster=cc.cluster AND b.pair='1v5' LEFT JOIN iv c ON c.set_name=cc.set_name AND c.cluster=cc.cluster AND c.pair='3v5')"""
register("a18_cluster_dips", f"WITH {SDIPS} SELECT * FROM cd", "t delay_1 delay_3 delay_5")(
    lambda s: V.cluster_dips(set_dips(s)).select("set_name", "cluster", "t", "evidence", "n_inter", "n_baseline", "confidence", *[F.col("delays")[k].alias(f"delay_{k}") for k in (1, 3, 5)])
)
register("a19_delay_summary", f"WITH {SDIPS} SELECT set_name, count(*) AS n_delays, string_agg(printf('%.1f', t + 1e-9), ', ' ORDER BY t) AS times, bool_and(confidence='high') AS all_high FROM cd GROUP BY 1")(lambda s: V.delay_summary(V.cluster_dips(set_dips(s))))

COMPARED = ["c1", "c2", "c3"]


def recordings(s):
    """A reference and three recordings of every conversation. A scene is what all frames of eight seconds show; each
    recording shows words of other lengths, a little later. Every third scene of the reference and every fourth of the
    last recording show words of their own, so that some scenes have no partner."""
    o = settled(s("fx_ocr").groupBy("video_id", F.floor(F.col("frame_time") / 8).cast("long").alias("scene_id")).agg(F.array_sort(F.collect_set("tok")).alias("w")), "recordings")
    out = None
    for k, label in enumerate(["ref", *COMPARED]):
        words = F.filter("w", lambda w: F.length(w) % 4 != k)
        own = {0: F.col("scene_id") % 3 == 1, 3: F.col("scene_id") % 4 == 2}.get(k)
        words = words if own is None else F.when(own, F.transform(words, lambda w: F.concat(w, F.lit("_"), F.lit(label)))).otherwise(words)
        rows = o.select(F.col("video_id").alias("set_name"), F.lit(label).alias("label"), "scene_id", (8.0 * F.col("scene_id") + 4 + 1.5 * k).alias("t"), words.alias("words"))
        out = rows if out is None else out.unionByName(rows)
    return settled(out, "recordings")


def reference(r):
    return r.where("label = 'ref'").drop("label")


def others(r):
    return r.where("label <> 'ref'")


def pairs_sql(name: str, left: str, right: str) -> str:
    """Scenes of two tables (set_name, label, id, t, w) with their score."""
    score = "round(CASE WHEN u = 0 THEN CASE WHEN abs(b_t-a_t) <= 5 THEN 0.5e0*n ELSE 0 END WHEN i/u < 0.1e0 THEN 0 ELSE i/u*n END, 12)"
    return f"""{name} AS (SELECT set_name, label, a_id, b_id, a_t, b_t, {score} AS score FROM (SELECT l.set_name, r.label, l.id AS a_id, r.id AS b_id, l.t AS a_t, r.t AS b_t, len(list_intersect(l.w, r.w)) AS i, len(list_distinct(list_concat(l.w, r.w))) AS u, exp(-0.5e0*power((r.t-l.t)/10e0, 2)) AS n FROM {left} l JOIN {right} r ON r.set_name = l.set_name AND abs(r.t-l.t) < 30) WHERE {score} > 0.05e0)"""


def greedy_sql(name: str, pairs: str, order: str) -> str:
    """Pairs one by one in an order, those whose ends are free."""
    return f"""{name} AS (SELECT set_name, label, m.a AS a_id, m.b AS b_id, m.at AS a_t, m.bt AS b_t, m.s AS score FROM (SELECT set_name, label, unnest(list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda q: q.a = x[1].a OR q.b = x[1].b)) > 0 THEN acc ELSE list_append(acc, x[1]) END)) AS m
  FROM (SELECT set_name, label, list([{{'a': a_id, 'b': b_id, 'at': a_t, 'bt': b_t, 's': score}}] ORDER BY {order}) AS l FROM {pairs} GROUP BY 1, 2)))"""


def recording_sql(k: int, label: str) -> str:
    own = {0: "id % 3 = 1", 3: "id % 4 = 2"}.get(k, "FALSE")
    return f"SELECT video_id AS set_name, '{label}' AS label, id, 8e0*id + 4 + 1.5e0*{k} AS t, CASE WHEN {own} THEN list_transform(list_filter(w, lambda x: length(x) % 4 <> {k}), lambda x: x || '_{label}') ELSE list_filter(w, lambda x: length(x) % 4 <> {k}) END AS w FROM o"


RECORDINGS = "o AS (SELECT video_id, CAST(floor(frame_time/8) AS BIGINT) AS id, list_sort(list(DISTINCT tok)) AS w FROM fx_ocr GROUP BY 1, 2), sc AS (" + " UNION ALL ".join(recording_sql(k, x) for k, x in enumerate(["ref", *COMPARED])) + "), rf AS (SELECT * FROM sc WHERE label = 'ref'), ot AS (SELECT * FROM sc WHERE label <> 'ref'), " + pairs_sql("fp", "rf", "ot")
MATCHED = RECORDINGS + ", " + greedy_sql("mt", "fp", "score DESC, a_id, b_id")
register("a13_fingerprint_pairs", f"WITH {RECORDINGS} SELECT * FROM fp", "a_t b_t score")(lambda s: (lambda r: V.fingerprint_pairs(reference(r), others(r)))(recordings(s)))
register("a13_scene_fingerprint_match", f"WITH {MATCHED} SELECT * FROM mt", "a_t b_t score")(lambda s: (lambda r: V.scene_matches(reference(r), others(r)))(recordings(s)))
IN_TURN = "a_id, score DESC, b_id"
LEFTOVERS = (
    MATCHED
    + ", f1 AS (SELECT * FROM ot WHERE NOT EXISTS (SELECT 1 FROM mt WHERE mt.set_name = ot.set_name AND mt.label = ot.label AND mt.b_id = ot.id)), h1 AS (SELECT * FROM f1 WHERE label = 'c1'), r1 AS (SELECT * FROM f1 WHERE label IN ('c2', 'c3')), "
    + pairs_sql("p1", "h1", "r1") + ", " + greedy_sql("g1", "p1", IN_TURN)
    + ", f2 AS (SELECT * FROM r1 WHERE NOT EXISTS (SELECT 1 FROM g1 WHERE g1.set_name = r1.set_name AND g1.label = r1.label AND g1.b_id = r1.id)), h2 AS (SELECT * FROM f2 WHERE label = 'c2'), r2 AS (SELECT * FROM f2 WHERE label = 'c3'), "
    + pairs_sql("p2", "h2", "r2") + ", " + greedy_sql("g2", "p2", IN_TURN)
    + ", h3 AS (SELECT * FROM r2 WHERE NOT EXISTS (SELECT 1 FROM g2 WHERE g2.set_name = r2.set_name AND g2.b_id = r2.id))"
    + ", lo AS (" + " UNION ALL ".join(f"SELECT set_name, label AS head_label, id AS head_id, label, id AS scene_id FROM {h}" for h in ("h1", "h2", "h3"))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT set_name, '{x}' AS head_label, a_id AS head_id, label, b_id AS scene_id FROM {g}" for x, g in (("c1", "g1"), ("c2", "g2"))) + ")"
)


def leftovers(s):
    r = recordings(s)
    matched = V.scene_matches(reference(r), others(r)).select("set_name", "label", F.col("b_id").alias("scene_id"))
    return V.group_leftovers(others(r).join(large(matched), ["set_name", "label", "scene_id"], "left_anti"), COMPARED)


register("a14_group_leftovers", f"WITH {LEFTOVERS} SELECT * FROM lo")(leftovers)

LV = ["ref", *COMPARED]
#: Content groups with the alignment of their scenes: gaps by time and scene, two of five scenes without an event, one without a track.
EVENT = "id % 5 NOT IN (0, 3)"
GROUPED = LEFTOVERS + f""", gr AS (SELECT g.*, sc.t, sc.w FROM (SELECT set_name, 'ref' AS head_label, id AS head_id, label, id AS scene_id FROM rf UNION ALL SELECT set_name, 'ref' AS head_label, a_id AS head_id, label, b_id AS scene_id FROM mt UNION ALL SELECT * FROM lo) g JOIN sc ON sc.set_name = g.set_name AND sc.label = g.label AND sc.id = g.scene_id),
al AS (SELECT set_name, label, id AS scene_id, (id*7 % 40 - 20)/8e0 + t % 3 AS delta_t, CASE WHEN id % 10 <> 1 THEN 'text' END AS match_track FROM sc WHERE {EVENT}),
gw AS (SELECT gr.*, delta_t, coalesce(match_track, '?') AS track FROM gr LEFT JOIN al USING (set_name, label, scene_id)),
ct AS (SELECT set_name, head_label, head_id, {", ".join(f"max(scene_id) FILTER (label='{x}') AS {x}_sid, round(max(t) FILTER (label='{x}'), 2) AS {x}_tvis, round(max(delta_t) FILTER (label='{x}'), 2) AS {x}_dt, coalesce(max(track) FILTER (label='{x}'), 'missing') AS {x}_track" for x in LV)},
  round(max(t) - min(t), 2) AS tvis_shift, round(coalesce(max(delta_t) - min(delta_t), 0), 2) AS dt_spread, count(*) AS n_videos,
  CASE WHEN len(flatten(list(w))) = 0 THEN '(no text)' ELSE array_to_string(list_sort(list_distinct(flatten(list(w))))[1:8], ' ') END AS content_words FROM gw GROUP BY 1, 2, 3)"""


def compared(s):
    r = recordings(s)
    i = F.col("scene_id")
    events = r.where(~(i % 5).isin(0, 3)).select("set_name", "label", "scene_id", F.lit(1).alias("event_id"), ((i * 7 % 40 - 20) / 8 + F.col("t") % 3).alias("delta_t"), F.when(i % 10 != 1, "text").alias("match_track"))
    later = events.select("set_name", "label", "scene_id", F.lit(2).alias("event_id"), F.lit(99.0).alias("delta_t"), F.lit("later").alias("match_track"))
    return V.comparison_table(V.content_groups(reference(r), others(r), COMPARED), events.unionByName(later), LV)


def pictures(table):
    """Delays of pictures of the compared recordings: none for some."""
    label = F.explode(F.array(*map(F.lit, COMPARED))).alias("label")
    rows = table.select("set_name", "head_label", "head_id", label)
    k = F.substring("label", 2, 1).cast("long")
    return rows.withColumn("visual_delay", F.when((F.col("head_id") + k) % 4 != 0, (F.col("head_id") * k % 9) / 4))


PICTURES = "vs AS (SELECT set_name, head_label, head_id, max(d) - min(d) AS visual_delay_spread FROM (SELECT set_name, head_label, head_id, CASE WHEN (head_id + k) % 4 <> 0 THEN (head_id*k % 9)/4e0 END AS d FROM ct, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY 1, 2, 3)"
NUMBERS = " ".join(f"{x}_{c}" for x in LV for c in ("tvis", "dt")) + " tvis_shift dt_spread"
register("a15_comparison_table", f"WITH {GROUPED} SELECT * FROM ct", NUMBERS)(compared)
TOLD = "set_name, CAST(rank AS INT) AS rank, head_label, head_id, tvis_shift"
register("a16_delay_points", f"WITH {GROUPED} SELECT {TOLD} FROM (SELECT *, row_number() OVER (PARTITION BY set_name ORDER BY tvis_shift DESC, head_label, head_id) AS rank FROM ct WHERE tvis_shift > 0.5e0) WHERE rank <= 10", "tvis_shift")(
    lambda s: V.delay_points(compared(s)).select("set_name", "rank", "head_label", "head_id", "tvis_shift")
)
register(
    "a16_delay_points_visual",
    f"WITH {GROUPED}, {PICTURES} SELECT {TOLD}, visual_delay_spread FROM (SELECT ct.*, visual_delay_spread, row_number() OVER (PARTITION BY ct.set_name ORDER BY visual_delay_spread DESC NULLS LAST, ct.head_label, ct.head_id) AS rank FROM ct LEFT JOIN vs USING (set_name, head_label, head_id) WHERE tvis_shift > 0.5e0 OR visual_delay_spread > 0.5e0) WHERE rank <= 10",
    "tvis_shift visual_delay_spread",
)(lambda s: (lambda t: V.delay_points(V.with_visual_spread(t, pictures(t))).select("set_name", "rank", "head_label", "head_id", "tvis_shift", "visual_delay_spread"))(compared(s)))


def variant_pairs(s):
    """Least gaps of each segment, once for every pair of variants of a set and either side of it."""
    n = F.substring("video_id", 2, 9).cast("int")
    d = s("fx_align").groupBy(n.alias("n"), F.col("segment_id").alias("keyword_id")).agg(F.min("delta_t").alias("delta_t"))
    v = s("fx_align").select(n.alias("n"), F.floor(n / 4).alias("set_")).distinct()
    p = v.withColumnRenamed("n", "na").join(v.withColumnRenamed("n", "nb"), "set_").where("na < nb").select(*[F.concat(F.lit("v"), F.col(x).cast("string")).alias(y) for x, y in (("na", "video_a"), ("nb", "video_b"))], "na", "nb")
    return [p.join(d, F.col(x) == d["n"]).select("video_a", "video_b", "keyword_id", "delta_t") for x in ("na", "nb")]


register(
    "j13_variant_diff",
    "WITH d AS (SELECT CAST(substring(video_id, 2) AS INT) AS n, segment_id AS keyword_id, min(delta_t) AS delta_t FROM fx_align GROUP BY 1, 2), v AS (SELECT DISTINCT n FROM d), p AS (SELECT a.n AS na, b.n AS nb FROM v a JOIN v b ON CAST(floor(a.n/4) AS INT) = CAST(floor(b.n/4) AS INT) AND a.n < b.n), l AS (SELECT na, nb, keyword_id, delta_t FROM p JOIN d ON n = na), r AS (SELECT na, nb, keyword_id, delta_t FROM p JOIN d ON n = nb) "
    "SELECT 'v' || na AS video_a, 'v' || nb AS video_b, keyword_id, l.delta_t AS dt_a, r.delta_t AS dt_b, r.delta_t-l.delta_t AS shift, CASE WHEN l.na IS NULL THEN 'b' WHEN r.na IS NULL THEN 'a' ELSE 'both' END AS side FROM l FULL JOIN r USING (na, nb, keyword_id)",
    "dt_a dt_b shift",
)(lambda s: V.variant_diff(*variant_pairs(s), keys=("video_a", "video_b", "keyword_id")))
