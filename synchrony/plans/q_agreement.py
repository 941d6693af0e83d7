"""Queries on importance, agreement, the rater study and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import agreement as G
from ..operators import importance as I
from ..operators import scoring as O
from ..operators import study as E
from ..operators import text as T
from ..sources.shared import settled
from .q_scoring import OVERALL, SCORED, kw, wm
from .registry import register

FEAT = f"""kf AS (SELECT *, CASE WHEN length(keyword_text) >= 3 THEN keyword_text END AS tok FROM fx_keywords), k0 AS (SELECT video_id, tok, min(t_narr) AS t0 FROM kf GROUP BY 1, 2),
fm AS (SELECT k.video_id, k.segment_id, count(*) AS n_kw, count(*) FILTER (k.tok IS NOT NULL AND NOT (k0.t0 < k.t_narr AND k.t_narr-k0.t0 <= 60)) AS n_first FROM kf k LEFT JOIN k0 ON k0.video_id=k.video_id AND k0.tok=k.tok GROUP BY 1, 2),
sg AS (SELECT s.*, coalesce(n_kw, 0) AS n_kw, coalesce(n_first, 0) AS n_first, greatest(coalesce(end_time-start_time, 1e0), 0.1e0) AS sec FROM fx_segments s LEFT JOIN fm USING (video_id, segment_id)),
ft AS (SELECT video_id, segment_id, least(n_kw/sec/2, 1e0) AS kw_density, least(n_words/sec/4, 1e0) AS speech_rate, least(n_words/25, 1e0) AS word_count, CASE WHEN regexp_matches(lower(text), '{'|'.join(T.INSTRUCTIONAL_VERBS)}') THEN 0.5e0 ELSE 0e0 END AS instr_verb, CASE WHEN regexp_matches(lower(text), '{'|'.join(T.DISCOURSE_PATTERNS)}') THEN 1e0 ELSE 0e0 END AS discourse, CASE WHEN n_kw > 0 THEN least(n_first/n_kw, 1e0) ELSE 0e0 END AS first_mention FROM sg)"""


def features(s):
    return I.importance_features(s("fx_segments"), T.first_mention(s("fx_keywords")))


def settings_sql(rows) -> str:
    return "SELECT * FROM (VALUES " + ", ".join("('" + r[0] + "', " + ", ".join(f"{w!r}::DOUBLE" for w in r[1:]) + ")" for r in rows) + ") v(config, " + ", ".join(f"w{i}" for i in range(6)) + ")"


def swept(rows) -> str:
    total = " + ".join(f"w{i}*{f}" for i, f in enumerate(I.FEATURES))
    return f"""{FEAT}, cf AS ({settings_sql(rows)}), sc AS (SELECT video_id, segment_id, config, {total} AS score FROM ft, cf), qs AS (SELECT video_id, config, quantile_cont(score, [0.2, 0.4, 0.6, 0.8]) AS q FROM sc GROUP BY 1, 2),
im AS (SELECT sc.*, 1 + CAST(round(score, 9) > round(q[1], 9) AS INT) + CAST(round(score, 9) > round(q[2], 9) AS INT) + CAST(round(score, 9) > round(q[3], 9) AS INT) + CAST(round(score, 9) > round(q[4], 9) AS INT) AS importance FROM sc JOIN qs USING (video_id, config))"""


def rank_sql(x: str, keys: str) -> str:
    return f"rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1)/2"


PERT, ABL = I.perturbation_settings(), I.ablation_settings()
register("i1_importance_features", f"WITH {FEAT} SELECT * FROM ft", " ".join(I.FEATURES))(features)
register("i2_importance_score", f"WITH {FEAT} SELECT video_id, segment_id, " + "+".join(f"{w}e0*{f}" for f, w in I.WEIGHTS.items()) + " AS score FROM ft", "score")(lambda s: features(s).select("video_id", "segment_id", I.importance_score().alias("score")))
register("i3_percentile_bin", f"WITH {swept(PERT[:1])} SELECT video_id, segment_id, importance FROM im")(lambda s: I.percentile_bin(settled(features(s).select("video_id", "segment_id", I.importance_score().alias("score")), "importance-scores"), "score", ["video_id"]).select("video_id", "segment_id", "importance"))
register(
    "i4_merge_double_run",
    "WITH a AS (SELECT doc_id AS segment_id, CAST(1 + doc_id % 5 AS INT) AS r1 FROM documents), b AS (SELECT doc_id AS segment_id, CAST(1 + doc_id % 3 AS INT) AS r2 FROM labels) SELECT segment_id, CAST(round_even((r1+coalesce(r2, r1))/2, 0) AS INT) AS merged, abs(r1-coalesce(r2, r1)) <= 1 AS is_reliable, r1 AS run1_rating, coalesce(r2, r1) AS run2_rating FROM a LEFT JOIN b USING (segment_id)",
)(lambda s: I.merge_double_run(s("documents").select(F.col("doc_id").alias("segment_id"), (1 + F.col("doc_id") % 5).cast("int").alias("importance")), s("labels").select(F.col("doc_id").alias("segment_id"), (1 + F.col("doc_id") % 3).cast("int").alias("importance"))))
SOME_TIERS = "NOT (tier='t1' AND video_id IN ('v1','v2')) AND NOT (tier='t2' AND video_id='v2')"
register("i5_tier_fallback", f"WITH r AS (SELECT *, CASE tier WHEN 't1' THEN 0 WHEN 't2' THEN 1 ELSE 2 END AS k FROM fx_tiers WHERE {SOME_TIERS}), m AS (SELECT *, min(k) OVER (PARTITION BY video_id) AS b FROM r) SELECT video_id, segment_id, tier, importance FROM m WHERE k=b")(
    lambda s: I.tier_fallback(s("fx_tiers").where(SOME_TIERS), ["t1", "t2", "t3"])
)
register(
    "i6_weight_settings",
    f"WITH {swept(PERT)}, a AS (SELECT video_id, segment_id, config, score, importance FROM im), q AS (SELECT config, avg(score) AS mean_score, avg(importance) AS mean_importance, count(*) FILTER (importance = 5) AS n_top, count(*) AS n FROM a GROUP BY 1) SELECT * FROM q",
    "mean_score mean_importance",
)(lambda s: I.rated_by_config(settled(features(s), "importance-features"), PERT).groupBy("config").agg(F.avg("score").alias("mean_score"), F.avg("importance").alias("mean_importance"), F.count_if(F.col("importance") == 5).alias("n_top"), F.count(F.lit(1)).alias("n")))
SWEEP = "b AS (SELECT video_id, segment_id, importance AS base FROM im WHERE config='{first}'), bo AS (SELECT im.*, base FROM im JOIN b USING (video_id, segment_id)), rk AS (SELECT *, " + rank_sql("importance", "video_id, config") + " AS ra, " + rank_sql("base", "video_id, config") + " AS rb FROM bo), sw AS (SELECT video_id, config, avg(score) AS mean_score, stddev_samp(score) AS std_score, avg(importance) AS mean_importance, CASE WHEN count(*) > 2 THEN corr(ra, rb) ELSE 1e0 END AS rank_corr, 100*avg(CASE WHEN importance=base THEN 1e0 ELSE 0e0 END) AS pct_same, max(abs(importance-base)) AS max_change FROM rk GROUP BY 1, 2)"
register("i7_sensitivity_sweep", f"WITH {swept(PERT)}, {SWEEP.format(first='baseline')} SELECT * FROM sw", "mean_score std_score mean_importance rank_corr pct_same")(lambda s: I.sensitivity_sweep(features(s), PERT))
register("i7_ablation_sweep", f"WITH {swept(ABL)}, {SWEEP.format(first='full')} SELECT * FROM sw", "mean_score std_score mean_importance rank_corr pct_same")(lambda s: I.sensitivity_sweep(features(s), ABL))
register("i9_sensitivity_summary", f"WITH {swept(ABL)}, {SWEEP.format(first='full')} SELECT video_id, avg(rank_corr) AS mean_rank_corr, min(rank_corr) AS min_rank_corr, avg(mean_score) AS score_mean, stddev_samp(mean_score) AS score_std, max(mean_score)-min(mean_score) AS score_range, stddev_samp(mean_score)/nullif(avg(mean_score), 0) AS score_cv FROM sw GROUP BY 1", "mean_rank_corr min_rank_corr score_mean score_std score_range score_cv")(
    lambda s: I.sensitivity_summary(I.sensitivity_sweep(features(s), ABL))
)


def align_features(s):
    """Features of the aligned recordings' segments, from their keywords."""
    k = s("fx_align").groupBy("video_id", "segment_id").agg(F.count(F.lit(1)).alias("n"), F.avg("t_narr").alias("t"), F.avg("alpha").alias("a"))
    return k.select("video_id", "segment_id", (F.col("n") / 100).alias("kw_density"), (F.col("t") / 600).alias("speech_rate"), (F.col("segment_id") / 40).alias("word_count"), F.col("a").alias("instr_verb"), (F.col("segment_id") % 3 / 3).alias("discourse"), (F.col("segment_id") % 7 / 7).alias("first_mention"))


AF = "ft AS (SELECT video_id, segment_id, count(*)/100 AS kw_density, avg(t_narr)/600 AS speech_rate, segment_id/40 AS word_count, avg(alpha) AS instr_verb, (segment_id % 3)/3 AS discourse, (segment_id % 7)/7 AS first_mention FROM fx_align GROUP BY 1, 2)"
register(
    "i8_scoring_sensitivity",
    f"WITH {swept(ABL).replace(FEAT, AF)}, {SCORED[5:]}, j AS (SELECT k.video_id, config, S_temporal, alpha*[0.8e0,0.9e0,1e0,1.1e0,1.2e0][im.importance] AS w FROM k JOIN im ON im.video_id=k.video_id AND im.segment_id=k.segment_id WHERE m), ov AS (SELECT video_id, config, sum(S_temporal*w)/nullif(sum(w), 0) AS overall FROM j GROUP BY 1, 2) SELECT video_id, config, overall, overall - max(overall) FILTER (config='full') OVER (PARTITION BY video_id) AS delta FROM ov",
    "overall delta",
)(lambda s: I.scoring_sensitivity(kw(s), align_features(s), ABL))
register("i10_correlation_matrix", f"WITH {AF} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM ft" for i, a in enumerate(I.FEATURES) for b in I.FEATURES[i + 1 :]), "r")(lambda s: I.correlation_matrix(align_features(s)))

PAIRS = "pr AS (SELECT x.video_id, x.segment_id, x.tier AS tier_a, y.tier AS tier_b, x.importance AS a, y.importance AS b FROM fx_tiers x JOIN fx_tiers y ON x.video_id=y.video_id AND x.segment_id=y.segment_id AND x.tier<y.tier)"
KEYS = ["video_id", "tier_a", "tier_b"]
register("j12_rating_pairs", f"WITH {PAIRS} SELECT * FROM pr")(lambda s: G.rating_pairs(s("fx_tiers")))
register("i11_spearman", f"WITH {PAIRS}, r AS (SELECT *, {rank_sql('a', ', '.join(KEYS))} AS ra, {rank_sql('b', ', '.join(KEYS))} AS rb FROM pr) SELECT video_id, tier_a, tier_b, corr(ra, rb) AS spearman, count(*) AS n FROM r GROUP BY 1,2,3", "spearman")(lambda s: G.spearman(G.rating_pairs(s("fx_tiers")), KEYS))
register("i12_kendall_tau_b", f"WITH {PAIRS}, m AS (SELECT x.video_id, x.tier_a, x.tier_b, sign(x.a-y.a)*sign(x.b-y.b) AS s, CAST(x.a<>y.a AS INT) AS ta, CAST(x.b<>y.b AS INT) AS tb FROM pr x JOIN pr y USING (video_id, tier_a, tier_b)) SELECT video_id, tier_a, tier_b, sum(s)/nullif(sqrt(CAST(sum(ta) AS DOUBLE)*sum(tb)), 0) AS tau_b FROM m GROUP BY 1,2,3", "tau_b")(lambda s: G.kendall_tau_b(G.rating_pairs(s("fx_tiers")), KEYS))
register("i13_exact_and_near_agreement", f"WITH {PAIRS} SELECT video_id, tier_a, tier_b, 100*avg(CASE WHEN a=b THEN 1e0 ELSE 0e0 END) AS exact, 100*avg(CASE WHEN abs(a-b)<=1 THEN 1e0 ELSE 0e0 END) AS within_one, count(*) AS n FROM pr GROUP BY 1,2,3", "exact within_one")(lambda s: G.exact_and_near(G.rating_pairs(s("fx_tiers")), KEYS))


def tier_scores(s):
    return s("fx_tiers").groupBy("video_id", "tier").agg((F.avg("importance") * 20).alias("score"))


register(
    "i14_tier_score_table",
    "WITH t AS (SELECT video_id, tier, avg(importance)*20 AS score FROM fx_tiers GROUP BY 1, 2) SELECT video_id, max(score) FILTER (tier='t1') AS t1, max(score) FILTER (tier='t2') AS t2, max(score) FILTER (tier='t3') AS t3, avg(score) AS mean, stddev_samp(score) AS std, count(DISTINCT CASE WHEN score >= 80 THEN 4 WHEN score >= 60 THEN 3 WHEN score >= 40 THEN 2 WHEN score >= 20 THEN 1 ELSE 0 END) = 1 AS same_grade FROM t GROUP BY 1",
    "t1 t2 t3 mean std",
)(lambda s: G.tier_score_table(tier_scores(s), ["t1", "t2", "t3"]))
register("i15_rating_distribution", "SELECT video_id, tier, " + ", ".join(f"count(*) FILTER (importance={i}) AS n_{i}" for i in range(1, 6)) + " FROM fx_tiers GROUP BY 1, 2")(lambda s: G.rating_distribution(s("fx_tiers")))
register("i16_largest_disagreements", f"WITH {PAIRS} SELECT *, abs(a-b) AS gap FROM pr WHERE abs(a-b) >= 2 ORDER BY gap DESC, video_id, segment_id, tier_a, tier_b LIMIT 20")(lambda s: G.largest_disagreements(G.rating_pairs(s("fx_tiers"))))
register("i17_series_monotonic", OVERALL + ", v AS (SELECT f.set_name, f.delay_level, o.video_id, round(overall_score, 9) AS score FROM o JOIN fx_variants f USING (video_id)), w AS (SELECT *, coalesce(score <= lag(score) OVER (PARTITION BY set_name ORDER BY delay_level), TRUE) AS fl FROM v) SELECT set_name, bool_and(fl) AS monotonic, max(score)-min(score) AS spread, string_agg(video_id, ' > ' ORDER BY score DESC, video_id) AS ranking FROM w GROUP BY 1", "spread")(
    lambda s: G.series_monotonic(O.overall_score(kw(s)).join(s("fx_variants"), "video_id").select("set_name", "delay_level", "video_id", F.round("overall_score", 9).alias("score")))
)


def version(s, **options):
    rows = O.scored(s("fx_align"), s("fx_importance"), **options)
    return O.overall_score(rows).join(O.coverage(rows).select("video_id", "coverage_rate"), "video_id").select("video_id", F.col("overall_score").alias("score"), F.col("coverage_rate").alias("coverage"))


register("i18_version_compare", OVERALL + f", pw AS (SELECT video_id, overall_score, overall_score_piecewise FROM o) SELECT video_id, overall_score AS old_score, overall_score_piecewise AS new_score, overall_score_piecewise-overall_score AS score_delta, 0e0 AS coverage_delta FROM pw", "old_score new_score score_delta coverage_delta")(
    lambda s: G.version_compare(version(s), version(s, mode="piecewise"))
)


def scoreboard(s):
    return O.comparison_scoreboard(kw(s))


BOARD = SCORED + f", bd AS (SELECT video_id, {wm('S_temporal', 'alpha*importance_weight')} AS overall_score, 100*count(*) FILTER (m)/greatest(count(*) FILTER (groundability<>'LOW'), 1) AS coverage_pct, 100*count(*) FILTER (match_case='A')/greatest(count(*) FILTER (m), 1) AS case_a_pct, 100*count(*) FILTER (match_case IN ('B','C'))/greatest(count(*) FILTER (m), 1) AS late_pct, 100*count(*) FILTER (match_method='ocr_vocabulary_mismatch')/greatest(count(*) FILTER (match_case='F'), 1) AS mismatch_pct, median(-delta_t) FILTER (match_case IN ('A','D')) AS median_lead FROM k GROUP BY 1), sl AS (SELECT video_id, 100*count(*) FILTER (x)/count(*) AS segment_pct FROM (SELECT video_id, segment_id, bool_or(m) AS x FROM k GROUP BY 1, 2) GROUP BY 1), sb AS (SELECT bd.*, segment_pct FROM bd JOIN sl USING (video_id))"
register("i21_comparison_scoreboard", BOARD + " SELECT * FROM sb", "overall_score coverage_pct case_a_pct late_pct mismatch_pct median_lead segment_pct")(scoreboard)


def ext(c: str, f: str, k: str) -> str:
    return f"(SELECT {k} FROM sb ORDER BY {c} {f}, video_id {f} LIMIT 1)"


INS = [
    ("CASE WHEN max(overall_score)-min(overall_score) < 5 THEN 'similar_scores' WHEN max(overall_score)-min(overall_score) > 20 THEN 'wide_score_spread' ELSE 'score_spread' END", "TRUE", "max(overall_score)-min(overall_score)", ext("overall_score", "DESC", "video_id")),
    ("'coverage_varies'", "max(coverage_pct)-min(coverage_pct) > 10", "max(coverage_pct)-min(coverage_pct)", ext("coverage_pct", "DESC", "video_id")),
    ("'case_a_dominant'", "count(*) FILTER (case_a_pct>60) > 0", "count(*) FILTER (case_a_pct>60)", "NULL"),
    ("'case_a_rare'", "count(*) FILTER (case_a_pct<40) > 0", "count(*) FILTER (case_a_pct<40)", "NULL"),
    ("CASE WHEN max(late_pct) > 20 THEN 'late_visuals' ELSE 'few_late_visuals' END", "TRUE", "max(late_pct)", ext("late_pct", "DESC", "video_id")),
    ("'vocabulary_mismatch'", "avg(mismatch_pct) > 60", "avg(mismatch_pct)", "NULL"),
    ("'pacing_differs'", "count(*) FILTER (median_lead>5) > 0 AND count(*) FILTER (median_lead<2) > 0", "count(*) FILTER (median_lead>5)", "NULL"),
    ("'segment_coverage_gap'", "max(segment_pct)-min(segment_pct) > 15", "max(segment_pct)-min(segment_pct)", ext("segment_pct", "ASC", "video_id")),
]
register("i19_insights", BOARD + " " + " UNION ALL ".join(f"SELECT {n} AS finding, CAST({v} AS DOUBLE) AS value, {w} AS video_id FROM sb HAVING {t}" for n, t, v, w in INS), "value")(lambda s: G.insights(scoreboard(s)))
register(
    "i20_recommendations",
    SCORED + """, s AS (SELECT video_id, segment_id, count(*) AS n_keywords, count(*) FILTER (m) AS nm, max(importance) AS importance FROM k GROUP BY 1, 2), z AS (SELECT * FROM k)
SELECT video_id, 'important_unsupported' AS rule, segment_id AS subject, CAST(n_keywords AS DOUBLE) AS value FROM s WHERE nm=0 AND importance>=4
UNION ALL SELECT video_id, CASE WHEN delta_t>3 THEN 'late_visual' ELSE 'minor_lag' END, keyword_id, delta_t FROM z WHERE match_case IN ('B','C') AND delta_t>1
UNION ALL SELECT video_id, CASE match_method WHEN 'no_ocr_nearby' THEN 'visual_coverage' ELSE 'vocabulary_mismatch' END, NULL, CAST(count(*) AS DOUBLE) FROM z WHERE match_case='F' AND match_method IN ('no_ocr_nearby','ocr_vocabulary_mismatch') GROUP BY 1, match_method
UNION ALL SELECT video_id, 'pacing', NULL, 100*avg(CASE WHEN -delta_t>10 THEN 1e0 ELSE 0e0 END) FROM z WHERE match_case IN ('A','D') GROUP BY 1 HAVING 100*avg(CASE WHEN -delta_t>10 THEN 1e0 ELSE 0e0 END) > 20""".replace(", s AS (", ", sgm AS (").replace("FROM s WHERE nm", "FROM sgm WHERE nm"),
    "value",
)(lambda s: (lambda r: G.recommendations(r, O.score_segments(r)))(kw(s)))

# --- study ------------------------------------------------------------------------------------------------------------
LEVEL = "SELECT rater, rating, CAST([0, 1, 3, 5][CAST(substring(item, 2) AS INT) % 4 + 1] AS INT) AS delay_level, item FROM fx_ratings"


def levelled(s):
    return s("fx_ratings").withColumn("delay_level", F.element_at(F.array(*map(F.lit, [0, 1, 3, 5])), F.substring("item", 2, 9).cast("int") % 4 + 1))


register("e4_rater_stringency", f"SELECT rater, avg(rating) FILTER (delay_level=0) AS mean_low, avg(rating) FILTER (delay_level=5) AS mean_high, avg(rating) FILTER (delay_level=0)-avg(rating) FILTER (delay_level=5) AS \"drop\" FROM ({LEVEL}) GROUP BY 1", 'mean_low mean_high "drop"')(lambda s: G.rater_stringency(levelled(s)))
register("e5_fleiss_kappa", "WITH n AS (SELECT item, rating, count(*) AS n FROM fx_ratings GROUP BY 1, 2), i AS (SELECT item, sum(n) AS r, sum(n*n) AS q FROM n GROUP BY 1), p AS (SELECT avg((q-r)/(r*(r-1))) AS p FROM i WHERE r > 1), e AS (SELECT sum(power(c/t, 2)) AS e FROM (SELECT rating, count(*) AS c, (SELECT count(*) FROM fx_ratings) AS t FROM fx_ratings GROUP BY 1)) SELECT (p-e)/(1-e) AS kappa FROM p, e", "kappa")(
    lambda s: G.fleiss_kappa(s("fx_ratings"))
)
register(
    "e6_icc_2k",
    "WITH t AS (SELECT count(*) AS nk, sum(rating) AS total, sum(rating*rating) AS sq FROM fx_panel), i AS (SELECT count(*) AS n, sum(s*s) AS i2 FROM (SELECT item, sum(rating) AS s FROM fx_panel GROUP BY 1)), r AS (SELECT count(*) AS k, sum(s*s) AS r2 FROM (SELECT rater, sum(rating) AS s FROM fx_panel GROUP BY 1)), x AS (SELECT *, total*total/nk AS c FROM t, i, r), y AS (SELECT *, i2/k-c AS ssr, r2/n-c AS ssc FROM x), z AS (SELECT *, ssr/(n-1) AS msr, ssc/(k-1) AS msc, (sq-c-ssr-ssc)/((n-1)*(k-1)) AS mse FROM y) SELECT n AS n_items, k AS n_raters, (msr-mse)/nullif(msr+(msc-mse)/n, 0) AS icc_2k FROM z",
    "icc_2k",
)(lambda s: G.icc_2k(s("fx_panel")))


def kappa_sql(cost: str) -> str:
    return f"WITH {PAIRS}, n AS (SELECT tier_a, tier_b, a, b, count(*) AS n, sum(count(*)) OVER (PARTITION BY tier_a, tier_b) AS t FROM pr GROUP BY 1,2,3,4), pa AS (SELECT tier_a, tier_b, a, sum(n)/max(t) AS p FROM n GROUP BY 1,2,3), pb AS (SELECT tier_a, tier_b, b, sum(n)/max(t) AS q FROM n GROUP BY 1,2,3), o AS (SELECT tier_a, tier_b, sum(n/t*{cost}) AS seen FROM n GROUP BY 1,2), e AS (SELECT tier_a, tier_b, sum(p*q*{cost}) AS ch FROM pa JOIN pb USING (tier_a, tier_b) GROUP BY 1,2) SELECT tier_a, tier_b, 1-seen/nullif(ch, 0) AS kappa FROM o JOIN e USING (tier_a, tier_b)"


register("e7_cohen_kappa", kappa_sql("(CASE WHEN a<>b THEN 1e0 ELSE 0e0 END)"), "kappa")(lambda s: G.cohen_kappa(G.rating_pairs(s("fx_tiers")), ["tier_a", "tier_b"]))
register("e7_cohen_kappa_weighted", kappa_sql("power(a-b, 2)"), "kappa")(lambda s: G.cohen_kappa(G.rating_pairs(s("fx_tiers")), ["tier_a", "tier_b"], weighted=True))
SRO = f"pp AS (SELECT x.item, x.rater AS r1, y.rater AS r2, CAST(substring(x.item, 2) AS INT) % 4 AS fold, x.rating AS a, y.rating AS b FROM fx_ratings x JOIN fx_ratings y ON x.item=y.item AND x.rater<y.rater), rr AS (SELECT *, {rank_sql('a', 'fold')} AS ra, {rank_sql('b', 'fold')} AS rb FROM pp)"


def rater_pairs(s):
    r = s("fx_ratings")
    a, b = r.select("item", F.col("rater").alias("r1"), F.col("rating").alias("a")), r.select("item", F.col("rater").alias("r2"), F.col("rating").alias("b"))
    return a.join(b, "item").where("r1 < r2").withColumn("fold", F.substring("item", 2, 9).cast("int") % 4)


#: The strata of the study: fold, recording and how sure the raters were.
STRATA = ["fold", "video", "confidence"]
SURE = "CASE (CAST(substring(x.item, 2) AS BIGINT) + CAST(substring(x.rater, 2) AS BIGINT)) % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'very_high' END"
STRATIFIED = f"pq AS (SELECT x.item, x.rating AS a, y.rating AS b, CAST(CAST(substring(x.item, 2) AS BIGINT) % 4 AS VARCHAR) AS fold, CAST(CAST(substring(x.item, 2) AS BIGINT) % 10 AS VARCHAR) AS video, {SURE} AS confidence FROM fx_ratings x JOIN fx_ratings y ON x.item=y.item AND x.rater<y.rater), st AS (SELECT 'fold' AS stratum, fold AS value, a, b FROM pq UNION ALL SELECT 'video', video, a, b FROM pq UNION ALL SELECT 'confidence', confidence, a, b FROM pq), sr AS (SELECT *, {rank_sql('a', 'stratum, value')} AS ra, {rank_sql('b', 'stratum, value')} AS rb FROM st)"


def strata_pairs(s):
    r = s("fx_ratings")
    n = F.substring("item", 2, 19).cast("long")
    sure = F.element_at(F.array(*map(F.lit, ["low", "medium", "high", "very_high"])), ((n + F.substring("r1", 2, 19).cast("long")) % 4 + 1).cast("int"))
    a, b = r.select("item", F.col("rater").alias("r1"), F.col("rating").alias("a")), r.select("item", F.col("rater").alias("r2"), F.col("rating").alias("b"))
    return a.join(b, "item").where("r1 < r2").select("a", "b", (n % 4).cast("string").alias("fold"), (n % 10).cast("string").alias("video"), sure.alias("confidence"))


register("e8_srocc_by_strata", f"WITH {STRATIFIED} SELECT stratum, value, corr(ra, rb) AS spearman, count(*) AS n FROM sr GROUP BY 1, 2", "spearman")(lambda s: G.srocc_by_strata(strata_pairs(s), STRATA))
register("e8_srocc_by_fold", f"WITH {SRO} SELECT fold, corr(ra, rb) AS spearman, count(*) AS n FROM rr GROUP BY 1", "spearman")(lambda s: G.spearman(rater_pairs(s), ["fold"]))
register("e9_curation_robustness", "WITH r AS (SELECT *, CAST(substring(item, 2) AS INT) % 6 = 0 AS x FROM fx_ratings) SELECT avg(rating) AS mean_all, avg(rating) FILTER (NOT x) AS mean_kept, avg(rating) FILTER (x) AS mean_excluded, count(*) FILTER (x) AS n_excluded FROM r", "mean_all mean_kept mean_excluded")(
    lambda s: G.curation_robustness(s("fx_ratings"), s("fx_ratings").where(F.substring("item", 2, 9).cast("int") % 6 == 0))
)
PRIN = "CASE rating % 3 WHEN 0 THEN 'timing;labels' WHEN 1 THEN 'timing' ELSE 'pace ; labels' END"
register("e9_principle_concordance", f"WITH n AS (SELECT item, count(DISTINCT rater) AS n FROM fx_ratings GROUP BY 1), x AS (SELECT item, rater, trim(unnest(string_split({PRIN}, ';'))) AS principle FROM fx_ratings), p AS (SELECT item, principle, count(DISTINCT rater) AS c FROM x GROUP BY 1, 2) SELECT item, principle, c AS n, c/n.n AS share FROM p JOIN n USING (item)", "share")(
    lambda s: G.principle_concordance(s("fx_ratings").withColumn("principles", F.expr(PRIN)))
)
POSTS = """SELECT concat('{{"rater": "', rater, '", "session": 1, "video": "', item, '", "label": "L", "order": 2, "timestamp_utc": "2024-01-01T00:00:00Z", "moments": [{{"id": "m1", "rating": ', rating, '}}, {{"id": "m2", "rating": ', 6 - rating, ', "principles": "timing"}}]}}') AS json FROM fx_ratings"""


def posts(s):
    r = F.col("rating")
    text = F.concat(F.lit('{"rater": "'), "rater", F.lit('", "session": 1, "video": "'), "item", F.lit('", "label": "L", "order": 2, "timestamp_utc": "2024-01-01T00:00:00Z", "moments": [{"id": "m1", "rating": '), r, F.lit('}, {"id": "m2", "rating": '), 6 - r, F.lit(', "principles": "timing"}]}'))
    return s("fx_ratings").select(text.alias("json"))


register("e2_explode_submission", "SELECT rater, item AS video, 'm1' AS moment, CAST(rating AS INT) AS rating, '' AS principles FROM fx_ratings UNION ALL SELECT rater, item, 'm2', CAST(6-rating AS INT), 'timing' FROM fx_ratings")(
    lambda s: E.explode_submission(posts(s)).select("rater", "video", "moment", "rating", "principles")
)
register("e3_rater_progress", "SELECT rater, item AS video, min(ts) AS first_ts FROM fx_ratings GROUP BY 1, 2")(lambda s: E.rater_progress(s("fx_ratings").withColumnRenamed("item", "video")))


def study(s):
    """A manifest out of all suppliers: of every 23 keys, six topics at three delays, four fresh videos and an odd one."""
    k = F.col("s_suppkey")
    man, n = k % 23 < 18, k % 23
    return s("supplier").select(
        F.concat(F.lit("m"), k.cast("string")).alias("video_id"), F.when(man, "manipulated").when(n == 22, "odd").otherwise("fresh").alias("set"), F.when(man, F.floor(k / 23) * 6 + F.floor(n / 3)).alias("topic"),
        F.when(man, F.element_at(F.array(*map(F.lit, E.DELAYS)), (n % 3 + 1).cast("int"))).alias("delay"), F.when(k % 5 == 0, "TODO").otherwise("id").alias("external_id"),
    )


ST = "st AS (SELECT 'm' || s_suppkey AS video_id, CASE WHEN s_suppkey % 23 < 18 THEN 'manipulated' WHEN s_suppkey % 23 = 22 THEN 'odd' ELSE 'fresh' END AS \"set\", s_suppkey // 23 * 6 + s_suppkey % 23 // 3 AS topic, s_suppkey % 23 % 3 AS di, CASE WHEN s_suppkey % 5=0 THEN 'TODO' ELSE 'id' END AS external_id FROM supplier)"
MOM = "mo AS (SELECT video_id, \"set\", CAST(substring(video_id, 2) AS INT)*1e0 AS t_narr, CASE WHEN video_id='m4' THEN 2e0 END AS override_start, CASE WHEN video_id='m4' THEN 3e0 END AS override_end FROM st)"


def moments(s):
    m4 = F.col("video_id") == "m4"
    return study(s).select("video_id", "set", F.substring("video_id", 2, 9).cast("double").alias("t_narr"), F.when(m4, 2.0).alias("override_start"), F.when(m4, 3.0).alias("override_end"))


register("p8_viewing_window", f"WITH {ST}, {MOM}, w AS (SELECT *, coalesce(override_start, CASE \"set\" WHEN 'manipulated' THEN greatest(t_narr-5, 0) WHEN 'fresh' THEN greatest(t_narr-5, 0) END) AS ws, coalesce(override_end, CASE \"set\" WHEN 'manipulated' THEN t_narr+7 WHEN 'fresh' THEN t_narr+10 END) AS we FROM mo) SELECT video_id, ws AS window_start, we AS window_end, CASE WHEN ws IS NULL OR we IS NULL THEN 'unknown set' END AS error FROM w", "window_start window_end")(
    lambda s: E.viewing_window(moments(s)).select("video_id", "window_start", "window_end", "error")
)
register("p9_study_validation", f"WITH {ST} SELECT 'no_moments' AS issue, video_id AS id FROM st WHERE CAST(substring(video_id, 2) AS INT) % 8 = 0 UNION ALL SELECT 'unknown_set', video_id FROM st WHERE \"set\"='odd' UNION ALL SELECT 'placeholder', video_id FROM st WHERE external_id='TODO'")(
    lambda s: E.study_validation(study(s), moments(s).where(F.substring("video_id", 2, 9).cast("int") % 8 != 0))
)
register(
    "e1_assign_sessions",
    f"""WITH {ST}, rt AS (SELECT DISTINCT rater FROM fx_ratings), tp AS (SELECT DISTINCT topic FROM st WHERE "set" = 'manipulated'),
pr AS (SELECT rater, topic, row_number() OVER (PARTITION BY rater ORDER BY md5(concat_ws('|', 1, rater, topic)), topic) AS rn, count(*) OVER (PARTITION BY rater) AS m FROM rt CROSS JOIN tp),
pl AS (SELECT *, (rn-1)//greatest(m//3, 1) AS pattern, unnest([0, 1, 2]) AS session FROM pr), fi AS (SELECT rater, session, video_id FROM pl JOIN st ON st.topic = pl.topic AND st.di = (pattern+session) % 3 AND "set" = 'manipulated'),
fr AS (SELECT rater, (row_number() OVER (PARTITION BY rater ORDER BY md5(concat_ws('|', 1, rater, video_id)), video_id) - 1 + CAST('0x' || substr(md5(concat_ws('|', 1, rater)), 1, 8) AS BIGINT) % 3) % 3 AS session, video_id FROM st CROSS JOIN rt WHERE "set" = 'fresh'),
ps AS (SELECT *, row_number() OVER (PARTITION BY rater ORDER BY session, md5(concat_ws('|', 1, rater, video_id, session)), video_id) AS position FROM (SELECT * FROM fi UNION ALL SELECT * FROM fr) u)
SELECT rater, CAST(session AS INT) AS session, video_id, CAST(position AS INT) AS position, printf('Video_R%02d', position) AS label FROM ps""",
)(lambda s: E.assign_sessions(study(s).where("set <> 'odd'"), s("fx_ratings").select("rater").distinct()))
LABEL = "[" + ", ".join(f"'{x}'" for x in E.CONTENT_LABELS + E.NON_CONTENT_LABELS) + "]"
TEXT = "CASE WHEN scene_id % 4 = 0 THEN ' shown ' WHEN scene_id % 4 = 1 THEN '  ' END"
NOTE = "CASE WHEN scene_id % 9 < 3 THEN 'NON_CONTENT' ELSE 'terms' END"
register(
    "p5_content_flag",
    f"WITH x AS (SELECT video_id, scene_id, {LABEL}[scene_id % 13 + 1] AS label, (scene_id % 20)/20 AS confidence, {TEXT} AS ocr_text, {NOTE} AS concept_text FROM fx_scenes) SELECT video_id, scene_id, CASE WHEN trim(coalesce(ocr_text, '')) <> '' THEN TRUE WHEN concept_text = 'NON_CONTENT' THEN FALSE WHEN confidence < 0.55e0 THEN TRUE ELSE list_contains({LABEL}[1:6], label) END AS is_content, label || CASE WHEN confidence < 0.55e0 THEN ' (low_conf)' ELSE '' END AS frame_type FROM x",
)(
    lambda s: E.content_flag(
        s("fx_scenes").select("video_id", "scene_id", F.element_at(F.array(*map(F.lit, E.CONTENT_LABELS + E.NON_CONTENT_LABELS)), F.col("scene_id") % 13 + 1).alias("label"), (F.col("scene_id") % 20 / 20).alias("confidence"), F.expr(TEXT).alias("ocr_text"), F.expr(NOTE).alias("concept_text"))
    ).select("video_id", "scene_id", "is_content", "frame_type")
)
