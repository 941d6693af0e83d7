"""Scores of aligned keywords, and their roll-ups to segment, recording and comparison level.

``align`` tables have video_id, keyword_id, segment_id, t_narr, t_vis, delta_t, match_case, alpha, scene_t_start,
scene_t_end, groundability; case F is unmatched. Unmatched rows keep null scores and take part in no mean.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from .scans import quantiles
from .timejoin import nearest_segment

def is_matched() -> Column:
    return F.col("match_case") != "F"


def matched(align: DataFrame) -> DataFrame:
    return align.where(is_matched())


def unmatched(align: DataFrame) -> DataFrame:
    return align.where(~is_matched())


def groundable(keywords: DataFrame) -> DataFrame:
    return keywords.where(F.col("groundability") != "LOW")


def scorable(events: DataFrame) -> DataFrame:
    """Scene-first events that count: everything but non-content."""
    return events.where(F.coalesce(F.col("match_type"), F.lit("")) != "non_content")


def visual_on_screen(align: DataFrame) -> DataFrame:
    """Whether the matched visual is known to be on screen when the word is said."""
    inside = F.coalesce(F.col("t_narr").between(F.col("scene_t_start"), F.col("scene_t_end")), F.lit(False))
    return align.withColumn("visual_on_screen", F.col("match_case").isin("A", "D") | (F.col("match_case").isin("E", "G") & inside))


def confidence_tier(align: DataFrame) -> DataFrame:
    return align.withColumn("confidence_tier", F.when(F.col("alpha") >= 0.8, "HIGH").otherwise("MEDIUM"))


def score_keywords(align: DataFrame, tau: float = S.TAU, threshold: float = S.DWELL_THRESHOLD, dwell_tau: float = S.DWELL_TAU, floor: float = S.FLOOR, mode: str = "both", use_flag: bool = True) -> DataFrame:
    """One projection: both scores, the primary one, the zone and the floored score. ``use_flag=False`` scores without
    the on-screen flag of cases E and G."""
    out = visual_on_screen(align)
    on = F.col("visual_on_screen") if use_flag else F.col("match_case").isin("A", "D")
    d = F.col("delta_t")
    out = out.withColumn("S_gaussian", S.gaussian_score(d, on, tau, threshold, dwell_tau)).withColumn("S_piecewise", S.piecewise_score(d, on, threshold, dwell_tau))
    primary = F.col("S_piecewise" if mode == "piecewise" else "S_gaussian")
    return out.withColumns({"S_temporal": primary, "zone": S.zone(d, on, threshold, dwell_tau), "S_floored": S.floored(primary, F.col("alpha"), floor)})


def attach_importance(scored: DataFrame, importance: DataFrame) -> DataFrame:
    """Left join on the segment; segments without a rating count as 3. The rating table has a row per segment, far fewer
    than keywords: the planner broadcasts it when its size allows."""
    ratings = importance.groupBy("video_id", "segment_id").agg(F.max(F.struct("importance", "backend")).alias("r"))
    out = scored.join(ratings, ["video_id", "segment_id"], "left")
    out = out.withColumn("importance", F.coalesce("r.importance", F.lit(3)).cast("int")).withColumn("importance_weight", S.weight(F.col("importance"), F.col("r.backend"))).drop("r")
    s, w = F.col("S_temporal"), F.col("importance_weight")
    return out.withColumns({"S_weighted": s * w, "priority": S.priority(s, w, F.col("alpha"))})


def scored(align: DataFrame, importance: DataFrame, **options) -> DataFrame:
    return attach_importance(score_keywords(align, **options), importance)


# --- aggregates -------------------------------------------------------------------------------------------------------


def when_matched(c: Column | str) -> Column:
    return F.when(is_matched(), F.col(c) if isinstance(c, str) else c)


def weighted_mean(value: str, *weights: Column) -> Column:
    """Mean of matched rows by weights; plain mean if the weights add up to nothing. Null scores count as 0."""
    v = when_matched(F.coalesce(F.col(value), F.lit(0.0)))
    w = reduce(lambda a, b: a * b, weights)
    return F.coalesce(F.try_divide(F.sum(v * w), F.sum(when_matched(w))), F.avg(v))


def confidence() -> Column:
    return F.coalesce(F.col("alpha"), F.lit(1.0))


def combined_weight() -> Column:
    return confidence() * F.coalesce(F.col("importance_weight"), F.lit(1.0))


def count_matched() -> Column:
    return F.count_if(is_matched())


def score_segments(rows: DataFrame) -> DataFrame:
    """One row per segment, also for segments without a match."""
    m = when_matched
    high = is_matched() & (F.col("alpha") >= 0.8)
    some = count_matched() > 0
    return rows.groupBy("video_id", "segment_id").agg(
        F.count(F.lit(1)).alias("n_keywords"),
        count_matched().alias("n_matched"),
        F.count_if(~is_matched()).alias("n_unmatched"),
        (count_matched() / F.count(F.lit(1))).alias("match_rate"),
        weighted_mean("S_temporal", confidence()).alias("mean_S_temporal"),
        F.median(m("S_temporal")).alias("median_S_temporal"),
        weighted_mean("S_piecewise", confidence()).alias("mean_S_piecewise"),
        F.avg(m("delta_t")).alias("mean_delta_t"),
        F.median(m("delta_t")).alias("median_delta_t"),
        F.min(m("delta_t")).alias("min_delta_t"),
        F.max(m("delta_t")).alias("max_delta_t"),
        *[F.count_if(is_matched() & (F.col("zone") == z)).alias(f"n_{z}") for z in S.ZONES],
        F.count_if(high).alias("n_high_confidence"),
        F.count_if(is_matched() & (F.col("alpha") < 0.8)).alias("n_medium_confidence"),
        F.avg(F.when(high, F.col("S_temporal"))).alias("mean_S_high_conf"),
        F.when(some, F.mode(m("importance"), True)).otherwise(F.mode("importance", True)).alias("importance"),
        F.when(some, F.avg(m("importance_weight"))).otherwise(F.avg("importance_weight")).alias("importance_weight"),
        F.avg(m("S_weighted")).alias("mean_S_weighted"),
        F.when(some, F.max(m("priority"))).otherwise(F.lit(0.0)).alias("max_priority"),
    )


def video_results(rows: DataFrame) -> DataFrame:
    """Keyword-level metrics of each recording."""
    m = when_matched
    d, high = m("delta_t"), is_matched() & (F.col("alpha") >= 0.8)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    tier = lambda hit, c: F.avg(F.when(hit, F.col(c)))
    share = lambda test: 100 * F.avg(m(test.cast("double")))
    medium = is_matched() & (F.col("alpha") < 0.8)
    out = rows.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(F.col("groundability") != "LOW").alias("n_groundable"),
        count_matched().alias("n_matched"),
        (count_matched() / F.count(F.lit(1))).alias("match_rate"),
        *[weighted_mean(f"S_{k}", confidence()).alias(f"mean_S_{k}_weighted") for k in ("gaussian", "piecewise", "temporal")],
        *[F.avg(m(zero(f"S_{k}"))).alias(f"mean_S_{k}_unweighted") for k in ("gaussian", "piecewise", "temporal")],
        F.avg(d).alias("mean_delta_t"),
        F.stddev_samp(d).alias("std_delta_t"),
        F.min(d).alias("min_delta_t"),
        F.max(d).alias("max_delta_t"),
        share(F.col("delta_t") <= 0).alias("pct_negative_delta_t"),
        share(F.abs("delta_t") <= 1).alias("pct_within_1s"),
        F.avg(m(confidence())).alias("mean_alpha"),
        share(confidence() >= 0.8).alias("pct_high_confidence"),
        *[share(F.col("zone") == z).alias(f"pct_{z}") for z in S.ZONES],
        F.count_if(high).alias("n_high"),
        tier(high, "S_temporal").alias("high_mean_S"),
        tier(high, "delta_t").alias("high_mean_delta_t"),
        F.count_if(medium).alias("n_medium"),
        tier(medium, "S_temporal").alias("medium_mean_S"),
        tier(medium, "delta_t").alias("medium_mean_delta_t"),
    )
    return out.join(quantiles(rows, ["video_id"], median_S_temporal=(m("S_temporal"), 0.5), median_delta_t=(d, 0.5)), "video_id", "left")


def overall_score(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("video_id").agg(
        count_matched().alias("n_matched"),
        weighted_mean("S_temporal", combined_weight()).alias("overall_score"),
        weighted_mean("S_temporal", confidence()).alias("overall_score_alpha_only"),
        F.avg(when_matched(F.coalesce("S_temporal", F.lit(0.0)))).alias("overall_score_unweighted"),
        weighted_mean("S_piecewise", combined_weight()).alias("overall_score_piecewise"),
    )
    return out.withColumns({"overall_grade": S.grade(F.col("overall_score")), "overall_grade_piecewise": S.grade(F.col("overall_score_piecewise"))})


def coverage(rows: DataFrame) -> DataFrame:
    """Share of groundable keywords that found a visual, alone and times the overall score."""
    rate = F.col("n_matched") / F.greatest("n_groundable", F.lit(1))
    out = rows.groupBy("video_id").agg(F.count_if(F.col("groundability") != "LOW").alias("n_groundable"), count_matched().alias("n_matched"), weighted_mean("S_temporal", combined_weight()).alias("overall_score"))
    return out.select("video_id", "n_groundable", "n_matched", rate.alias("coverage_rate"), (F.coalesce("overall_score", F.lit(0.0)) * rate).alias("coverage_adjusted"))


def lead_time(rows: DataFrame) -> DataFrame:
    """How far ahead of the words the visuals of cases A and D stood."""
    lead = rows.where(F.col("match_case").isin("A", "D")).withColumn("lead", -F.col("delta_t"))
    share = lambda test: 100 * F.avg(test.cast("double"))
    cuts = [("n_0_1", None, 1), ("n_1_3", 1, 3), ("n_3_5", 3, 5), ("n_5_10", 5, 10), ("n_over_10", 10, None)]
    within = lambda lo, hi: (F.lit(True) if lo is None else F.col("lead") > lo) & (F.lit(True) if hi is None else F.col("lead") <= hi)
    return lead.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_visual_ahead"),
        F.avg("lead").alias("mean_lead_s"),
        F.median("lead").alias("median_lead_s"),
        F.max("lead").alias("max_lead_s"),
        share(F.col("lead") <= 2).alias("pct_within_2s"),
        share(F.col("lead") <= 5).alias("pct_within_5s"),
        share(F.col("lead") > 10).alias("pct_over_10s"),
        *[F.count_if(within(lo, hi)).alias(n) for n, lo, hi in cuts],
    )


def positive_lag(rows: DataFrame) -> DataFrame:
    late = rows.where(F.col("match_case").isin("B", "C"))
    return late.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.avg("delta_t").alias("mean_delta_t"), F.avg("S_temporal").alias("mean_S_temporal"))


def segment_level(segments: DataFrame) -> DataFrame:
    s = F.col("mean_S_temporal")
    return segments.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count(s).alias("n_with_matches"),
        F.count_if(s.isNull()).alias("n_without_matches"),
        F.avg(s).alias("mean_S_temporal"),
        F.median(s).alias("median_S_temporal"),
        F.avg(F.when(s.isNotNull(), F.col("mean_S_piecewise"))).alias("mean_S_piecewise"),
        F.avg(F.when(s.isNotNull(), F.col("mean_S_weighted"))).alias("mean_S_weighted"),
    )


def top_k_fixes(rows: DataFrame, k: int = 5) -> DataFrame:
    """The k worst keywords of each recording, ties by keyword and then every other column."""
    order = Window.partitionBy("video_id").orderBy(F.col("priority").desc(), "keyword_id", "segment_id", F.col("delta_t").asc_nulls_last(), "match_case", "alpha", "t_narr")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("video_id", "rank", "keyword_id", "segment_id", "delta_t", "S_temporal", "priority")


def distribution(rows: DataFrame, column: str, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    counts = rows.groupBy(*keys, F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*keys)))


#: Bin edges of the score and gap histograms.
SCORE_EDGES = (20.0, 40.0, 60.0, 80.0)
DELTA_EDGES = (-30.0, -10.0, -5.0, -1.0, 1.0, 3.0, 5.0, 10.0)


def histogram(rows: DataFrame, column: str, edges: tuple[float, ...]) -> DataFrame:
    """Counts between edges: bin i holds edges[i-1] <= x < edges[i]."""
    bins = F.lit(0)
    for e in edges:
        bins = bins + (F.col(column) >= e).cast("int")
    return rows.where(F.col(column).isNotNull()).groupBy("video_id", bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def importance_impact(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("video_id").agg(F.avg(when_matched("S_weighted")).alias("weighted_mean"), F.avg(when_matched("S_temporal")).alias("unweighted_mean"))
    return out.withColumn("impact", F.col("weighted_mean") - F.col("unweighted_mean"))


def scene_score(delta: Column, alpha: Column, kind: Column) -> Column:
    """First generation: symmetric score times half of one plus alpha; an event without a match scores 0."""
    return F.when(kind == "no_match", 0.0).otherwise(S.symmetric_score(delta) * (0.5 + 0.5 * alpha))


def score_scenes(events: DataFrame) -> DataFrame:
    """events: video_id, threshold, scene_id, delta_t, alpha, match_type."""
    out = scorable(events)
    zone = F.when(F.col("match_type") == "no_match", S.ZONES[3]).otherwise(S.symmetric_zone(F.col("delta_t")))
    return out.withColumns({"S_event": scene_score(F.col("delta_t"), F.col("alpha"), F.col("match_type")), "zone": zone})


def video_aggregates(events: DataFrame) -> DataFrame:
    return score_scenes(events).groupBy("video_id", "threshold").agg(
        F.count(F.lit(1)).alias("n_events"),
        F.count_if(F.col("match_type") != "no_match").alias("n_matched"),
        F.avg("S_event").alias("mean_score"),
        F.median("S_event").alias("median_score"),
        F.avg("delta_t").alias("mean_delta_t"),
        F.stddev_samp("delta_t").alias("std_delta_t"),
        *[F.count_if(F.col("zone") == z).alias(f"n_{z}") for z in S.ZONES],
    )


def scores_v21(rows: DataFrame, tau: float = S.TAU) -> DataFrame:
    """Second generation: + S_temporal (a bell of the gap, null without one) and zone, for scenes or keywords with delta_t."""
    return rows.withColumns({"S_temporal": F.when(F.col("delta_t").isNotNull(), 100 * S.bell(F.col("delta_t"), tau)), "zone": F.coalesce(S.symmetric_zone(F.col("delta_t")), F.lit("No Match"))})


def score_scenes_v21(events: DataFrame, segments: DataFrame, importance: DataFrame, tau: float = S.TAU) -> DataFrame:
    """One row per scene (video_id, scene_id, t_keyframe, delta_t, alpha): score, zone, the weight of the importance of the
    segment whose middle is nearest (3 where there is none), the weighted score, and the priority for mending, which is 0
    without a gap. segments: video_id, segment_id, start_time, end_time."""
    near = nearest_segment(scores_v21(events, tau), segments, "t_keyframe", "scene_id")
    rated = importance.groupBy("video_id", "segment_id").agg(F.min("importance").alias("i_"))
    out = near.join(rated, ["video_id", "segment_id"], "left").withColumn("importance_weight", S.weight(F.coalesce("i_", F.lit(3)), F.lit("llm")))
    w, s = F.col("importance_weight"), F.col("S_temporal")
    return out.withColumns({"S_weighted": s * w, "priority": F.when(s.isNotNull(), (100 - s) * w * F.col("alpha")).otherwise(0.0)}).drop("i_")


def scene_aggregates_v21(scenes: DataFrame) -> DataFrame:
    """Per recording, from scored scenes (match_type, delta_t, alpha, S_temporal, zone): scenes without a match count in the
    counts only; the overall score weighs by alpha, or not where all alphas are 0."""
    met = F.col("delta_t").isNotNull()
    of = lambda c: F.when(met, c)
    s, a, d = of(F.col("S_temporal")), of(F.col("alpha")), of(F.col("delta_t"))
    out = scenes.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_scenes"),
        F.count_if(F.col("match_type") != "non_content").alias("n_content_scenes"),
        F.count_if(met).alias("n_matched"),
        F.count_if(~met).alias("n_no_match"),
        F.avg(s).alias("mean_S_temporal"),
        F.median(s).alias("median_S_temporal"),
        F.avg(a).alias("mean_alpha"),
        (100 * F.avg(of((F.col("alpha") >= 0.6).cast("double")))).alias("pct_high_confidence"),
        F.avg(d).alias("mean_delta_t"),
        F.stddev_samp(d).alias("sd_delta_t"),
        F.min(d).alias("min_delta_t"),
        F.max(d).alias("max_delta_t"),
        *[(100 * F.avg(of((F.col("zone") == z).cast("double")))).alias(f"pct_{z}") for z in S.ZONES],
        F.sum(s * F.col("alpha")).alias("sa_"),
        F.sum(a).alias("a_"),
    )
    score = F.when(F.col("a_") > 0, F.col("sa_") / F.col("a_")).otherwise(F.col("mean_S_temporal"))
    return out.withColumn("overall_score", score).withColumn("overall_grade", S.grade(F.col("overall_score"))).drop("sa_", "a_")


def keyword_aggregates_v21(keywords: DataFrame) -> DataFrame:
    """Per recording, from grounded keywords (groundability, delta_t, is_visual, method, S_temporal): counts, mean and median
    score of those with a gap, and how many each method found."""
    met = F.col("delta_t").isNotNull()
    s = F.when(met, F.col("S_temporal"))
    counts = keywords.groupBy("video_id", "method").agg(F.count(F.lit(1)).alias("n")).groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("method", "n")))).alias("grounding_methods"))
    out = keywords.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("n_keywords_total"),
        F.count_if(F.col("groundability") != "LOW").alias("n_keywords_groundable"),
        F.count_if(met).alias("n_keywords_grounded"),
        F.count_if(~F.col("is_visual")).alias("n_not_visual"),
        F.avg(s).alias("mean_S_temporal"),
        F.median(s).alias("median_S_temporal"),
    )
    return out.join(counts, "video_id")


def weighted_median(rows: DataFrame, value: str, weight: str, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """First value whose cumulative weight reaches half. Equal values are summed first, so the window sees each once."""
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.sum(weight).alias("w_"))
    whole = Window.partitionBy(*keys)
    up = whole.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumn("cum_", F.sum("w_").over(up)).withColumn("all_", F.sum("w_").over(whole))
    return per.groupBy(*keys).agg(F.min(F.when(F.col("cum_") >= F.col("all_") / 2, F.col(value))).alias("weighted_median"))


def condition_stats(rows: DataFrame) -> DataFrame:
    dwelt = is_matched() & F.col("visual_on_screen") & (F.col("delta_t") <= 0)
    return rows.groupBy("video_id").agg(
        F.avg(F.when(dwelt, -F.col("delta_t"))).alias("mean_dwell"),
        F.count_if(is_matched() & (F.col("delta_t") < 0)).alias("n_before"),
        F.count_if(is_matched() & (F.col("delta_t") == 0)).alias("n_same"),
        F.count_if(is_matched() & (F.col("delta_t") > 0)).alias("n_after"),
        *[F.count_if(is_matched() & (F.col("zone") == z)).alias(f"n_{z}") for z in S.ZONES],
    )


def scene_rollup(scenes: DataFrame, align: DataFrame) -> DataFrame:
    """Matched keywords per scene, their cases and mean gap; scenes without any keep a row."""
    hits = matched(align).groupBy("video_id", "scene_id").agg(F.count(F.lit(1)).alias("n_"), F.array_sort(F.collect_set("match_case")).alias("cases_"), F.avg("delta_t").alias("mean_delta_t"))
    out = scenes.select("video_id", "scene_id").join(hits, ["video_id", "scene_id"], "left")
    return out.select("video_id", "scene_id", F.coalesce("n_", F.lit(0)).alias("n_keywords"), F.coalesce(F.array_join("cases_", ","), F.lit("")).alias("cases"), "mean_delta_t")


def segment_alignment(segments: DataFrame, align: DataFrame) -> DataFrame:
    """Counts per case, match rate and gap statistics of every segment, from a left join of segments."""
    cases = [F.count_if(F.col("match_case") == c).alias(f"n_case_{c}") for c in "ABCDEFG"]
    m = when_matched
    agg = align.groupBy("video_id", "segment_id").agg(
        F.count(F.lit(1)).alias("n_keywords"),
        *cases,
        (count_matched() / F.count(F.lit(1))).alias("match_rate"),
        F.try_divide(F.sum(m(F.col("delta_t") * confidence())), F.sum(m(confidence()))).alias("mean_delta_t"),
        F.median(m("delta_t")).alias("median_delta_t"),
        F.min(m("delta_t")).alias("min_delta_t"),
        F.max(m("delta_t")).alias("max_delta_t"),
    )
    out = segments.select("video_id", "segment_id").join(agg, ["video_id", "segment_id"], "left")
    return out.fillna(0, ["n_keywords", "match_rate", *[f"n_case_{c}" for c in "ABCDEFG"]])


def comparison_scoreboard(rows: DataFrame) -> DataFrame:
    """One wide row per recording, for comparing recordings: overall score, coverage, share of case A and of late visuals,
    share of unmatched keywords that were shown in other words, median lead and share of segments with a match."""
    late, n = F.count_if(F.col("match_case").isin("B", "C")), count_matched()
    share = lambda part, whole: 100 * part / F.greatest(whole, F.lit(1))
    base = rows.groupBy("video_id").agg(
        weighted_mean("S_temporal", combined_weight()).alias("overall_score"),
        share(n, F.count_if(F.col("groundability") != "LOW")).alias("coverage_pct"),
        share(F.count_if(F.col("match_case") == "A"), n).alias("case_a_pct"),
        share(late, n).alias("late_pct"),
        share(F.count_if(F.col("match_method") == "ocr_vocabulary_mismatch"), F.count_if(F.col("match_case") == "F")).alias("mismatch_pct"),
        F.median(F.when(F.col("match_case").isin("A", "D"), -F.col("delta_t"))).alias("median_lead"),
    )
    met = rows.groupBy("video_id", "segment_id").agg(F.max(is_matched()).alias("met")).groupBy("video_id").agg((100 * F.avg(F.col("met").cast("double"))).alias("segment_pct"))
    return base.join(met, "video_id")
