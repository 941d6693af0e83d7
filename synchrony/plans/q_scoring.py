"""Queries on scores and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import scoring as O
from .registry import register

#: The scored keywords in SQL: flag, scores, zone, importance, weight, priority.
SCORED = """WITH p AS (SELECT *, match_case IN ('A','D') OR (match_case IN ('E','G') AND coalesce(t_narr BETWEEN scene_t_start AND scene_t_end, FALSE)) AS visual_on_screen FROM fx_align),
q AS (SELECT *, delta_t <= 0 AND visual_on_screen AS seen, abs(delta_t) AS a, CASE WHEN abs(delta_t) <= 15 THEN 100e0 ELSE 100e0*exp(-0.5e0*power((abs(delta_t)-15)/30, 2)) END AS dw,
  CASE WHEN abs(delta_t) <= 1 THEN 100e0 WHEN abs(delta_t) <= 3 THEN 100e0-15e0*(abs(delta_t)-1) WHEN abs(delta_t) <= 5 THEN 70e0-35e0*(abs(delta_t)-3) ELSE 0e0 END AS pw,
  CASE WHEN abs(delta_t) <= 1 THEN 'Optimal' WHEN abs(delta_t) <= 3 THEN 'Suboptimal' WHEN abs(delta_t) <= 5 THEN 'Disruptive' ELSE 'Unacceptable' END AS gz FROM p),
s AS (SELECT *, CASE WHEN delta_t IS NOT NULL THEN CASE WHEN seen THEN dw ELSE 100e0*exp(-0.5e0*power(a/2.5e0, 2)) END END AS S_gaussian, CASE WHEN delta_t IS NOT NULL THEN CASE WHEN seen THEN dw ELSE pw END END AS S_piecewise,
  CASE WHEN delta_t IS NULL THEN 'No Match' WHEN seen THEN CASE WHEN dw >= 80 THEN 'Optimal' WHEN dw >= 60 THEN 'Suboptimal' WHEN dw >= 40 THEN 'Disruptive' ELSE 'Unacceptable' END ELSE gz END AS zone FROM q),
i AS (SELECT s.*, S_gaussian AS S_temporal, S_gaussian*(0.5e0+0.5e0*alpha) AS S_floored, coalesce(f.importance, 3) AS importance,
  CASE WHEN coalesce(f.backend, 'heuristic') = 'heuristic' THEN [0.8e0,0.9e0,1e0,1.1e0,1.2e0][coalesce(f.importance, 3)] ELSE [0.3e0,0.6e0,1e0,1.5e0,2e0][f.importance] END AS importance_weight
  FROM s LEFT JOIN fx_importance f USING (video_id, segment_id)),
k AS (SELECT *, S_temporal*importance_weight AS S_weighted, coalesce((100e0-S_temporal)*importance_weight*coalesce(alpha, 1e0), 0e0) AS priority, match_case <> 'F' AS m FROM i) """

WM = "coalesce(sum({v}*{w}) FILTER (m) / nullif(sum({w}) FILTER (m), 0), avg({v}) FILTER (m))"


def wm(v: str, w: str = "alpha") -> str:
    return WM.format(v=f"coalesce({v}, 0e0)", w=w)


def kw(src):
    return O.scored(src("fx_align"), src("fx_importance"))


def grade_sql(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'N/A' WHEN {x} >= 80 THEN 'Excellent' WHEN {x} >= 60 THEN 'Good' WHEN {x} >= 40 THEN 'Acceptable' WHEN {x} >= 20 THEN 'Poor' ELSE 'Unacceptable' END"


register("p2_matched_counts", "SELECT video_id, count(*) FILTER (match_case<>'F') AS n_matched, count(*) FILTER (match_case='F') AS n_unmatched, count(*) FILTER (groundability<>'LOW') AS n_groundable FROM fx_align GROUP BY 1")(
    lambda s: O.matched(s("fx_align")).select("video_id", F.lit("m").alias("k")).unionByName(O.unmatched(s("fx_align")).select("video_id", F.lit("u").alias("k"))).unionByName(O.groundable(s("fx_align")).select("video_id", F.lit("g").alias("k")))
    .groupBy("video_id").agg(*[F.count_if(F.col("k") == k).alias(n) for k, n in (("m", "n_matched"), ("u", "n_unmatched"), ("g", "n_groundable"))])
)
register("p6_visual_on_screen", SCORED + "SELECT video_id, match_case, visual_on_screen, count(*) AS n FROM p GROUP BY ALL")(
    lambda s: O.visual_on_screen(s("fx_align")).groupBy("video_id", "match_case", "visual_on_screen").agg(F.count(F.lit(1)).alias("n"))
)
register("p7_confidence_tier", "SELECT video_id, CASE WHEN alpha >= 0.8e0 THEN 'HIGH' ELSE 'MEDIUM' END AS confidence_tier, count(*) AS n FROM fx_align WHERE match_case<>'F' GROUP BY ALL")(
    lambda s: O.confidence_tier(O.matched(s("fx_align"))).groupBy("video_id", "confidence_tier").agg(F.count(F.lit(1)).alias("n"))
)
register("j10_attach_importance", SCORED + "SELECT video_id, importance, count(*) AS n, sum(importance_weight) AS w FROM k GROUP BY ALL", "w")(
    lambda s: kw(s).groupBy("video_id", "importance").agg(F.count(F.lit(1)).alias("n"), F.sum("importance_weight").alias("w"))
)
KW = ["video_id", "keyword_id", "segment_id", "delta_t", "match_case", "visual_on_screen", "S_gaussian", "S_piecewise", "S_temporal", "zone", "S_floored", "importance", "importance_weight", "S_weighted", "priority"]
register("g1_score_keywords", SCORED + f"SELECT {', '.join(KW)} FROM k", "delta_t S_gaussian S_piecewise S_temporal S_floored importance_weight S_weighted priority")(lambda s: kw(s).select(*KW))
register("g1_scores_without_flag", SCORED + "SELECT video_id, sum(CASE WHEN delta_t <= 0 AND match_case IN ('A','D') THEN dw ELSE 100e0*exp(-0.5e0*power(a/2.5e0, 2)) END) AS total FROM q GROUP BY 1", "total")(
    lambda s: O.score_keywords(s("fx_align"), use_flag=False).groupBy("video_id").agg(F.sum("S_gaussian").alias("total"))
)
register(
    "g2_score_segments",
    SCORED
    + f"""SELECT video_id, segment_id, count(*) AS n_keywords, count(*) FILTER (m) AS n_matched, count(*) FILTER (NOT m) AS n_unmatched, count(*) FILTER (m) / count(*) AS match_rate,
 {wm('S_temporal')} AS mean_S_temporal, median(S_temporal) FILTER (m) AS median_S_temporal, {wm('S_piecewise')} AS mean_S_piecewise, avg(delta_t) AS mean_delta_t, median(delta_t) AS median_delta_t,
 min(delta_t) AS min_delta_t, max(delta_t) AS max_delta_t, count(*) FILTER (zone='Optimal') AS n_Optimal, count(*) FILTER (zone='Suboptimal') AS n_Suboptimal, count(*) FILTER (zone='Disruptive') AS n_Disruptive,
 count(*) FILTER (zone='Unacceptable') AS n_Unacceptable, count(*) FILTER (m AND alpha >= 0.8e0) AS n_high_confidence, count(*) FILTER (m AND alpha < 0.8e0) AS n_medium_confidence,
 avg(S_temporal) FILTER (m AND alpha >= 0.8e0) AS mean_S_high_conf, max(importance) AS importance, max(importance_weight) AS importance_weight, avg(S_weighted) FILTER (m) AS mean_S_weighted,
 CASE WHEN count(*) FILTER (m) > 0 THEN max(priority) FILTER (m) ELSE 0e0 END AS max_priority FROM k GROUP BY 1, 2""",
    "match_rate mean_S_temporal median_S_temporal mean_S_piecewise mean_delta_t median_delta_t min_delta_t max_delta_t mean_S_high_conf importance_weight mean_S_weighted max_priority",
)(lambda s: O.score_segments(kw(s)))
register(
    "g3_video_results",
    SCORED
    + f"""SELECT video_id, count(*) AS n_total, count(*) FILTER (groundability<>'LOW') AS n_groundable, count(*) FILTER (m) AS n_matched, count(*) FILTER (m)/count(*) AS match_rate,
 {', '.join(f"{wm(f'S_{x}')} AS mean_S_{x}_weighted, avg(coalesce(S_{x}, 0e0)) FILTER (m) AS mean_S_{x}_unweighted" for x in ('gaussian', 'piecewise', 'temporal'))},
 median(S_temporal) FILTER (m) AS median_S_temporal, avg(delta_t) AS mean_delta_t, median(delta_t) AS median_delta_t, stddev_samp(delta_t) AS std_delta_t, min(delta_t) AS min_delta_t, max(delta_t) AS max_delta_t,
 100*avg(CAST(delta_t <= 0 AS DOUBLE)) FILTER (m) AS pct_negative_delta_t, 100*avg(CAST(a <= 1 AS DOUBLE)) FILTER (m) AS pct_within_1s, avg(alpha) FILTER (m) AS mean_alpha, 100*avg(CAST(alpha >= 0.8e0 AS DOUBLE)) FILTER (m) AS pct_high_confidence,
 {', '.join(f"100*avg(CAST(zone='{z}' AS DOUBLE)) FILTER (m) AS pct_{z}" for z in S.ZONES)},
 count(*) FILTER (m AND alpha >= 0.8e0) AS n_high, avg(S_temporal) FILTER (m AND alpha >= 0.8e0) AS high_mean_S, avg(delta_t) FILTER (m AND alpha >= 0.8e0) AS high_mean_delta_t,
 count(*) FILTER (m AND alpha < 0.8e0) AS n_medium, avg(S_temporal) FILTER (m AND alpha < 0.8e0) AS medium_mean_S, avg(delta_t) FILTER (m AND alpha < 0.8e0) AS medium_mean_delta_t FROM k GROUP BY 1""",
    "match_rate mean_S_gaussian_weighted mean_S_gaussian_unweighted mean_S_piecewise_weighted mean_S_piecewise_unweighted mean_S_temporal_weighted mean_S_temporal_unweighted median_S_temporal mean_delta_t median_delta_t std_delta_t min_delta_t max_delta_t pct_negative_delta_t pct_within_1s mean_alpha pct_high_confidence pct_Optimal pct_Suboptimal pct_Disruptive pct_Unacceptable high_mean_S high_mean_delta_t medium_mean_S medium_mean_delta_t",
)(lambda s: O.video_results(kw(s)))
OVERALL = SCORED + f", o AS (SELECT video_id, count(*) FILTER (m) AS n_matched, {wm('S_temporal', 'alpha*importance_weight')} AS overall_score, {wm('S_temporal')} AS overall_score_alpha_only, avg(coalesce(S_temporal, 0e0)) FILTER (m) AS overall_score_unweighted, {wm('S_piecewise', 'alpha*importance_weight')} AS overall_score_piecewise, count(*) FILTER (groundability<>'LOW') AS n_groundable FROM k GROUP BY 1) "
register("g4_overall_score", OVERALL + f"SELECT * EXCLUDE (n_groundable), {grade_sql('overall_score')} AS overall_grade, {grade_sql('overall_score_piecewise')} AS overall_grade_piecewise FROM o", "overall_score overall_score_alpha_only overall_score_unweighted overall_score_piecewise")(
    lambda s: O.overall_score(kw(s))
)
register("g5_coverage", OVERALL + "SELECT video_id, n_groundable, n_matched, n_matched / greatest(n_groundable, 1) AS coverage_rate, coalesce(overall_score, 0e0) * n_matched / greatest(n_groundable, 1) AS coverage_adjusted FROM o", "coverage_rate coverage_adjusted")(
    lambda s: O.coverage(kw(s))
)
register(
    "g6_lead_time",
    """SELECT video_id, count(*) AS n_visual_ahead, avg(l) AS mean_lead_s, median(l) AS median_lead_s, max(l) AS max_lead_s, 100*avg(CAST(l<=2 AS DOUBLE)) AS pct_within_2s, 100*avg(CAST(l<=5 AS DOUBLE)) AS pct_within_5s, 100*avg(CAST(l>10 AS DOUBLE)) AS pct_over_10s,
 count(*) FILTER (l<=1) AS n_0_1, count(*) FILTER (l>1 AND l<=3) AS n_1_3, count(*) FILTER (l>3 AND l<=5) AS n_3_5, count(*) FILTER (l>5 AND l<=10) AS n_5_10, count(*) FILTER (l>10) AS n_over_10 FROM (SELECT video_id, -delta_t AS l FROM fx_align WHERE match_case IN ('A','D')) GROUP BY 1""",
    "mean_lead_s median_lead_s max_lead_s pct_within_2s pct_within_5s pct_over_10s",
)(lambda s: O.lead_time(s("fx_align")))
register("g7_positive_lag", SCORED + "SELECT video_id, count(*) AS n, avg(delta_t) AS mean_delta_t, avg(S_temporal) AS mean_S_temporal FROM k WHERE match_case IN ('B','C') GROUP BY 1", "mean_delta_t mean_S_temporal")(lambda s: O.positive_lag(kw(s)))
register(
    "g8_segment_level",
    SCORED + f", g AS (SELECT video_id, segment_id, {wm('S_temporal')} AS st, {wm('S_piecewise')} AS sp, avg(S_weighted) FILTER (m) AS sw FROM k GROUP BY 1,2) SELECT video_id, count(*) AS n_total, count(st) AS n_with_matches, count(*) - count(st) AS n_without_matches, avg(st) AS mean_S_temporal, median(st) AS median_S_temporal, avg(sp) AS mean_S_piecewise, avg(sw) AS mean_S_weighted FROM g GROUP BY 1",
    "mean_S_temporal median_S_temporal mean_S_piecewise mean_S_weighted",
)(lambda s: O.segment_level(O.score_segments(kw(s))))
register(
    "g9_top_k_fixes",
    SCORED + "SELECT video_id, CAST(r AS INT) AS rank, keyword_id, segment_id, delta_t, S_temporal, priority FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY priority DESC, keyword_id, segment_id, delta_t NULLS LAST, match_case, alpha, t_narr) AS r FROM k) WHERE r <= 5",
    "delta_t S_temporal priority",
)(lambda s: O.top_k_fixes(kw(s)))
for column in ("match_case", "match_method", "zone", "importance", "groundability"):
    register(f"g10_distribution_{column}", SCORED + f"SELECT video_id, CAST({column} AS VARCHAR) AS value, count(*) AS n, count(*)/sum(count(*)) OVER (PARTITION BY video_id) AS share FROM k GROUP BY 1, 2", "share")(
        lambda s, column=column: O.distribution(kw(s), column)
    )


def bin_sql(c: str, edges) -> str:
    return " + ".join(f"CAST({c} >= {e!r}e0 AS INT)" for e in edges)


register("g11_histogram_score", SCORED + f"SELECT video_id, {bin_sql('S_temporal', S_EDGES)} AS bin, count(*) AS n FROM k WHERE S_temporal IS NOT NULL GROUP BY 1, 2" if (S_EDGES := O.SCORE_EDGES) else None)(lambda s: O.histogram(kw(s), "S_temporal", O.SCORE_EDGES))
register("g11_histogram_delta", SCORED + f"SELECT video_id, {bin_sql('delta_t', O.DELTA_EDGES)} AS bin, count(*) AS n FROM k WHERE delta_t IS NOT NULL GROUP BY 1, 2")(lambda s: O.histogram(kw(s), "delta_t", O.DELTA_EDGES))
register("g12_importance_impact", SCORED + "SELECT video_id, avg(S_weighted) AS weighted_mean, avg(S_temporal) AS unweighted_mean, avg(S_weighted) - avg(S_temporal) AS impact FROM k WHERE m GROUP BY 1", "weighted_mean unweighted_mean impact")(
    lambda s: O.importance_impact(kw(s))
)

#: Scene-first events out of aligned keywords: case F has no match, one in seven is not content.
EVENTS = """WITH e AS (SELECT video_id, segment_id, keyword_id AS scene_id, CAST(keyword_id % 3 AS INT) AS threshold, -delta_t AS delta_t, alpha, CASE WHEN keyword_id % 7 = 0 THEN 'non_content' WHEN match_case = 'F' THEN 'no_match' ELSE 'match' END AS match_type FROM fx_align),
f AS (SELECT *, CASE WHEN match_type = 'no_match' THEN 0e0 ELSE (CASE WHEN abs(delta_t) <= 1 THEN 100e0 WHEN abs(delta_t) <= 3 THEN 100e0-15e0*(abs(delta_t)-1) WHEN abs(delta_t) <= 5 THEN 70e0-35e0*(abs(delta_t)-3) ELSE 0e0 END)*(0.5e0+0.5e0*alpha) END AS S_event,
 CASE WHEN match_type = 'no_match' THEN 'Unacceptable' WHEN delta_t IS NULL THEN 'No Match' WHEN abs(delta_t) <= 1 THEN 'Optimal' WHEN abs(delta_t) <= 3 THEN 'Suboptimal' WHEN abs(delta_t) <= 5 THEN 'Disruptive' ELSE 'Unacceptable' END AS zone FROM e WHERE match_type <> 'non_content') """


def events(s):
    k = F.col("keyword_id")
    kind = F.when(k % 7 == 0, "non_content").when(F.col("match_case") == "F", "no_match").otherwise("match")
    return s("fx_align").select("video_id", "segment_id", k.alias("scene_id"), (k % 3).cast("int").alias("threshold"), (-F.col("delta_t")).alias("delta_t"), "alpha", kind.alias("match_type"))


register("g16_score_scenes", EVENTS + "SELECT video_id, zone, count(*) AS n, sum(S_event) AS total FROM f GROUP BY 1, 2", "total")(lambda s: O.score_scenes(events(s)).groupBy("video_id", "zone").agg(F.count(F.lit(1)).alias("n"), F.sum("S_event").alias("total")))
register(
    "g17_video_aggregates",
    EVENTS + f"SELECT video_id, threshold, count(*) AS n_events, count(*) FILTER (match_type<>'no_match') AS n_matched, avg(S_event) AS mean_score, median(S_event) AS median_score, avg(delta_t) AS mean_delta_t, stddev_samp(delta_t) AS std_delta_t, {', '.join(f'''count(*) FILTER (zone='{z}') AS n_{z}''' for z in S.ZONES)} FROM f GROUP BY 1, 2",
    "mean_score median_score mean_delta_t std_delta_t",
)(lambda s: O.video_aggregates(events(s)))
#: Scenes of the second generation: a matched one has a gap and an alpha; segments of fifteen seconds.
V21 = """e AS (SELECT video_id, keyword_id AS scene_id, min(t_narr) AS t_keyframe, min(delta_t) AS delta_t, min(alpha) AS alpha, CASE WHEN keyword_id % 7 = 0 THEN 'non_content' WHEN min(delta_t) IS NULL THEN 'no_match' ELSE 'match' END AS match_type FROM fx_align GROUP BY 1, 2),
sg AS (SELECT DISTINCT video_id, segment_id, 15e0*segment_id + 7.5e0 AS mid FROM fx_align), ns AS (SELECT * FROM (SELECT e.*, sg.segment_id, row_number() OVER (PARTITION BY e.video_id, scene_id ORDER BY abs(mid-t_keyframe), sg.segment_id) AS rn FROM e JOIN sg USING (video_id)) WHERE rn = 1),
sv AS (SELECT ns.video_id, ns.scene_id, ns.segment_id, delta_t, alpha, match_type, 100e0*exp(-0.5e0*power(delta_t/2.5e0, 2)) AS S_temporal, CASE WHEN delta_t IS NULL THEN 'No Match' WHEN abs(delta_t) <= 1 THEN 'Optimal' WHEN abs(delta_t) <= 3 THEN 'Suboptimal' WHEN abs(delta_t) <= 5 THEN 'Disruptive' ELSE 'Unacceptable' END AS zone, [0.3e0,0.6e0,1e0,1.5e0,2e0][coalesce(i.importance, 3)] AS importance_weight FROM ns LEFT JOIN fx_importance i ON i.video_id = ns.video_id AND i.segment_id = ns.segment_id),
pv AS (SELECT *, S_temporal*importance_weight AS S_weighted, CASE WHEN S_temporal IS NULL THEN 0e0 ELSE (100-S_temporal)*importance_weight*alpha END AS priority FROM sv)"""


def scenes_v21(s):
    k = F.col("keyword_id")
    e = s("fx_align").groupBy("video_id", k.alias("scene_id")).agg(F.min("t_narr").alias("t_keyframe"), F.min("delta_t").alias("delta_t"), F.min("alpha").alias("alpha"))
    return e.withColumn("match_type", F.when(F.col("scene_id") % 7 == 0, "non_content").when(F.col("delta_t").isNull(), "no_match").otherwise("match"))


def segments_v21(s):
    return s("fx_align").select("video_id", "segment_id", (15.0 * F.col("segment_id")).alias("start_time"), (15.0 * F.col("segment_id") + 15).alias("end_time")).distinct()


register("g18_score_scenes_v21", f"WITH {V21} SELECT * FROM pv", "delta_t alpha S_temporal importance_weight S_weighted priority")(
    lambda s: O.score_scenes_v21(scenes_v21(s), segments_v21(s), s("fx_importance")).select("video_id", "scene_id", "segment_id", "delta_t", "alpha", "match_type", "S_temporal", "zone", "importance_weight", "S_weighted", "priority")
)
PCT = ", ".join(f"100*avg(CASE WHEN zone='{z}' THEN 1e0 ELSE 0e0 END) FILTER (m) AS pct_{z}" for z in S.ZONES)
GRADE = "CASE WHEN {x} >= 80 THEN 'Excellent' WHEN {x} >= 60 THEN 'Good' WHEN {x} >= 40 THEN 'Acceptable' WHEN {x} >= 20 THEN 'Poor' WHEN {x} IS NOT NULL THEN 'Unacceptable' END"
register(
    "g18_scene_aggregates_v21",
    f"WITH {V21}, a AS (SELECT video_id, count(*) AS n_scenes, count(*) FILTER (match_type <> 'non_content') AS n_content_scenes, count(*) FILTER (m) AS n_matched, count(*) FILTER (NOT m) AS n_no_match, avg(S_temporal) FILTER (m) AS mean_S_temporal, median(S_temporal) FILTER (m) AS median_S_temporal, avg(alpha) FILTER (m) AS mean_alpha, 100*avg(CASE WHEN alpha >= 0.6e0 THEN 1e0 ELSE 0e0 END) FILTER (m) AS pct_high_confidence, avg(delta_t) AS mean_delta_t, stddev_samp(delta_t) AS sd_delta_t, min(delta_t) AS min_delta_t, max(delta_t) AS max_delta_t, {PCT}, coalesce(sum(S_temporal*alpha)/nullif(sum(alpha) FILTER (m), 0), avg(S_temporal)) AS overall_score FROM (SELECT *, delta_t IS NOT NULL AS m FROM pv) GROUP BY 1) SELECT *, {GRADE.format(x='overall_score')} AS overall_grade FROM a",
    "mean_S_temporal median_S_temporal mean_alpha pct_high_confidence mean_delta_t sd_delta_t min_delta_t max_delta_t pct_Optimal pct_Suboptimal pct_Disruptive pct_Unacceptable overall_score",
)(lambda s: O.scene_aggregates_v21(O.scores_v21(scenes_v21(s))))
register(
    "g18_keyword_aggregates_v21",
    "WITH k AS (SELECT video_id, groundability, delta_t, match_method AS method, 100e0*exp(-0.5e0*power(delta_t/2.5e0, 2)) AS S FROM fx_align) SELECT video_id, count(*) AS n_keywords_total, count(*) FILTER (groundability <> 'LOW') AS n_keywords_groundable, count(delta_t) AS n_keywords_grounded, count(*) FILTER (delta_t IS NULL) AS n_not_visual, avg(S) AS mean_S_temporal, median(S) AS median_S_temporal, (SELECT string_agg(method || '=' || n, ',' ORDER BY method) FROM (SELECT method, count(*) AS n FROM k x WHERE x.video_id = k.video_id GROUP BY 1)) AS methods FROM k GROUP BY 1",
    "mean_S_temporal median_S_temporal",
)(
    lambda s: O.keyword_aggregates_v21(O.scores_v21(s("fx_align")).withColumnRenamed("match_method", "method").withColumn("is_visual", F.col("delta_t").isNotNull()))
    .withColumn("methods", F.array_join(F.transform(F.map_entries("grounding_methods"), lambda e: F.concat_ws("=", e["key"], e["value"])), ","))
    .drop("grounding_methods")
)
register(
    "g19_weighted_median",
    "WITH p AS (SELECT video_id, delta_t, sum(alpha) AS w FROM fx_align WHERE delta_t IS NOT NULL GROUP BY 1, 2), c AS (SELECT *, sum(w) OVER (PARTITION BY video_id ORDER BY delta_t ROWS UNBOUNDED PRECEDING) AS cum, sum(w) OVER (PARTITION BY video_id) AS tot FROM p) SELECT video_id, min(delta_t) FILTER (cum >= tot/2) AS weighted_median FROM c GROUP BY 1",
    "weighted_median",
)(lambda s: O.weighted_median(s("fx_align"), "delta_t", "alpha"))
register(
    "g20_condition_stats",
    SCORED + f"SELECT video_id, avg(-delta_t) FILTER (visual_on_screen AND delta_t <= 0) AS mean_dwell, count(*) FILTER (delta_t < 0) AS n_before, count(*) FILTER (delta_t = 0) AS n_same, count(*) FILTER (delta_t > 0) AS n_after, {', '.join(f'''count(*) FILTER (m AND zone='{z}') AS n_{z}''' for z in S.ZONES)} FROM k GROUP BY 1",
    "mean_dwell",
)(lambda s: O.condition_stats(kw(s)))
register(
    "g21_scene_rollup",
    "WITH a AS (SELECT *, segment_id % 30 AS scene_id FROM fx_align), c AS (SELECT DISTINCT video_id, segment_id AS scene_id FROM fx_align), h AS (SELECT video_id, scene_id, count(*) AS n, string_agg(DISTINCT match_case, ',' ORDER BY match_case) AS cs, avg(delta_t) AS mean_delta_t FROM a WHERE match_case<>'F' GROUP BY 1,2) SELECT video_id, scene_id, coalesce(n, 0) AS n_keywords, coalesce(cs, '') AS cases, mean_delta_t FROM c LEFT JOIN h USING (video_id, scene_id)",
    "mean_delta_t",
)(lambda s: O.scene_rollup(s("fx_align").select("video_id", F.col("segment_id").alias("scene_id")).distinct(), s("fx_align").withColumn("scene_id", F.col("segment_id") % 30)))
register(
    "a8_segment_alignment",
    f"WITH g AS (SELECT video_id, segment_id, count(*) AS n_keywords, {', '.join(f'''count(*) FILTER (match_case='{c}') AS n_case_{c}''' for c in 'ABCDEFG')}, count(*) FILTER (match_case<>'F')/count(*) AS match_rate, sum(delta_t*alpha)/nullif(sum(alpha) FILTER (match_case<>'F'), 0) AS mean_delta_t, median(delta_t) AS median_delta_t, min(delta_t) AS min_delta_t, max(delta_t) AS max_delta_t FROM fx_align WHERE match_case = 'F' OR alpha < 0.65e0 GROUP BY 1,2), s AS (SELECT DISTINCT video_id, segment_id FROM fx_align) SELECT video_id, segment_id, coalesce(n_keywords, 0) AS n_keywords, {', '.join(f'coalesce(n_case_{c}, 0) AS n_case_{c}' for c in 'ABCDEFG')}, coalesce(match_rate, 0e0) AS match_rate, mean_delta_t, median_delta_t, min_delta_t, max_delta_t FROM s LEFT JOIN g USING (video_id, segment_id)",
    "match_rate mean_delta_t median_delta_t min_delta_t max_delta_t",
)(lambda s: O.segment_alignment(s("fx_align").select("video_id", "segment_id").distinct(), s("fx_align").where("match_case = 'F' or alpha < 0.65")))
register(
    "f10_f18_scalars",
    f"SELECT video_id, sum(100e0*exp(-0.5e0*power(delta_t/2.5e0,2))) AS bell, sum(1/(1+exp(-delta_t))) AS sig, sum(least(greatest((alpha-0.2e0)/0.6e0,0),1)) AS lin, sum(0.5e0+0.5e0*least(greatest((alpha-0.2e0)/0.6e0,0),1)) AS half, max({grade_sql('delta_t')}) AS grade, max(printf('%d:%02d', CAST(floor(t_narr/60) AS INT), CAST(floor(t_narr) AS INT) % 60)) AS shown, count(*) FILTER (delta_t <= 0 OR abs(delta_t) <= 1) AS n_report_optimal FROM fx_align GROUP BY 1",
    "bell sig lin half",
)(
    lambda s: s("fx_align").groupBy("video_id").agg(
        F.sum(100 * S.bell(F.col("delta_t"), 2.5)).alias("bell"), F.sum(S.sigmoid(F.col("delta_t"))).alias("sig"), F.sum(S.alpha_linear(F.col("alpha"), 0.2, 0.8)).alias("lin"), F.sum(S.alpha_half(F.col("alpha"), 0.2, 0.8)).alias("half"),
        F.max(S.grade(F.col("delta_t"))).alias("grade"), F.max(S.format_time(F.col("t_narr"))).alias("shown"), F.count_if(S.report_zone(F.col("delta_t")) == "Optimal").alias("n_report_optimal"),
    )
)
