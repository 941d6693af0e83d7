"""Alignment of spoken keywords with what is shown: token pairs, the cases of the cascade, and scene-first tracks.

Tables: keywords (video_id, keyword_id, keyword_text, t_narr, ...), ocr (video_id, frame_time, tok), scenes (video_id,
scene_id, t_start, t_end, t_keyframe). Token matching happens once per recording on distinct tokens; every case then
joins that pair table on equal tokens and a bucket of time, so no keyword meets all frames that show its word. Frames are
packed by token and bucket (``shown``) before they are joined; ocr may be given packed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.tokens import indel_ratio_arrow, letters, letters_may_reach, may_reach, normalize_word, token_set_ratio
from ..sources.shared import large, settled
from .scans import SECONDS, least_after, least_before, previous, scan
from .scoring import weighted_median
from .timejoin import bucket_of, bucketed_range_join, buckets, nearest_frame, nearest_segment, scene_at

CASES = ("A", "B", "C", "E", "G", "F")
RESULT = ["video_id", "keyword_id", "t_narr", "t_vis", "delta_t", "match_case", "match_method", "alpha", "scene_id", "scene_t_start", "scene_t_end", "confidence", "sub_scene_onset", "gap_since_expired"]


def fuzzy_word_match(left: DataFrame, right: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Pairs of distinct tokens (part, tok) of a recording whose similarity is above the threshold. Tokens meet by length:
    the ratio cannot pass where the lengths or the characters differ too much. Equal tokens need no distance."""
    a, b = left.select("video_id", "part").distinct(), right.select("video_id", "tok").distinct()
    same = a.join(large(b), (a["video_id"] == b["video_id"]) & (a["part"] == b["tok"])).select(a["video_id"], "part", "tok", F.lit(1.0).alias("ratio"))
    n = F.length("part")
    low, high = F.floor(n * threshold / (2 - threshold)).cast("int"), F.ceil(n * (2 - threshold) / threshold).cast("int")
    spread = a.withColumns({"a_": letters(F.col("part")), "n_": n}).withColumn("len_", F.explode(F.sequence(F.greatest(low, F.lit(1)), high)))
    spelled = b.withColumns({"b_": letters(F.col("tok")), "len_": F.length("tok")})
    # one condition: of several, the planner puts the later ones first
    cheap = letters_may_reach(F.col("a_"), F.col("n_"), F.col("b_"), F.col("len_"), threshold) & (F.col("part") != F.col("tok"))
    near = spread.join(large(spelled), ["video_id", "len_"]).where(cheap & may_reach(F.col("part"), F.col("tok"), threshold))
    far = near.select("video_id", "part", "tok", indel_ratio_arrow("part", "tok").alias("ratio")).where(F.col("ratio") > threshold)
    return same.unionByName(far)


def exact_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    a, b = left.select("video_id", "part").distinct(), right.select("video_id", "tok").distinct()
    return a.join(large(b), (a["video_id"] == b["video_id"]) & (a["part"] == b["tok"])).select(a["video_id"], "part", "tok", F.lit(1.0).alias("ratio"))


def keyword_parts(keywords: DataFrame) -> DataFrame:
    """video_id, keyword_id, t_narr, part, needed (counts for a full match), single (enough for a partial one), n_needed."""
    raw = F.filter(F.split(F.lower(F.trim("keyword_text")), r"\s+"), lambda x: x != "")
    parts = F.array_distinct(F.transform(raw, normalize_word))
    many = F.size(raw) > 1
    rows = keywords.select("video_id", "keyword_id", "t_narr", parts.alias("parts"), many.alias("many"))
    least = F.when(F.col("many"), 2).otherwise(1)
    rows = rows.withColumn("n_needed", F.size(F.filter("parts", lambda x: F.length(x) >= least))).withColumn("part", F.explode("parts")).where(F.length("part") > 0)
    return rows.select("video_id", "keyword_id", "t_narr", "n_needed", "part", (F.length("part") >= least).alias("needed"), (F.length("part") >= 4).alias("single"))


def token_hits(keywords: DataFrame, ocr: DataFrame, threshold: float | None = 0.8) -> DataFrame:
    """Parts of keywords with the tokens that match them; a threshold of None compares exactly."""
    parts = keyword_parts(keywords)
    pairs = exact_pairs(parts, ocr) if threshold is None else fuzzy_word_match(parts, ocr, threshold)
    hits = parts.join(large(pairs.select("video_id", "part", "tok")), ["video_id", "part"])
    return hits.withColumn("single", F.col("single") & (F.length("tok") >= 3))


def multiword_match(keywords: DataFrame, tokens: DataFrame, threshold: float | None = 0.8) -> DataFrame:
    """video_id, keyword_id, matched: whether every word of the keyword (of two or more letters, if it has several) is among
    the tokens of its recording."""
    hits = token_hits(keywords, tokens, threshold)
    full = hits.groupBy("video_id", "keyword_id").agg((F.count_distinct(F.when(F.col("needed"), F.col("part"))) == F.max("n_needed")).alias("matched"))
    return keywords.select("video_id", "keyword_id").join(large(full), ["video_id", "keyword_id"], "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


#: Seconds of a recording in which the frames that show a token are packed into one row.
PACKED = 16.0


def shown(ocr: DataFrame) -> DataFrame:
    """video_id, tok, bucket_, frames: the frames of PACKED seconds that show a token, in one row. What is on screen stays
    there, so this is a fraction of the rows of ocr, which is what joins write to disk. A table that is packed stays."""
    if "frames" in ocr.columns:
        return ocr
    rows = ocr.where("frame_time is not null").withColumn("bucket_", bucket_of(F.col("frame_time"), PACKED))
    return rows.groupBy("video_id", "tok", "bucket_").agg(F.collect_set("frame_time").alias("frames"))


def frame_times(ocr: DataFrame) -> DataFrame:
    """video_id, frame_time: each frame once."""
    return (ocr.select("video_id", F.explode("frames").alias("frame_time")) if "frames" in ocr.columns else ocr.select("video_id", "frame_time")).distinct()


def frames_between(rows: DataFrame, packed: DataFrame, low: Column | str, high: Column | str, keys: tuple[str, ...] = ("video_id", "tok")) -> DataFrame:
    """Rows with ``frames``, those of their keys in a time range (both ends closed); a row for each bucket that has some."""
    lo, hi = (F.col(x) if isinstance(x, str) else x for x in (low, high))
    left = rows.withColumn("lo_", lo).withColumn("hi_", hi).withColumn("bucket_", F.explode(buckets(F.col("lo_"), F.col("hi_"), PACKED)))
    met = left.join(large(packed), [*keys, "bucket_"]).withColumn("frames", F.filter("frames", lambda x: x.between(F.col("lo_"), F.col("hi_"))))
    return met.where(F.size("frames") > 0).drop("lo_", "hi_", "bucket_")


def by_keyword(met: DataFrame) -> DataFrame:
    """Rows with frames, one for each frame, dealt by keyword while they are packed: what is grouped by keyword, or by keyword
    and frame, afterwards stays where it is."""
    return met.repartition("video_id", "keyword_id").withColumn("frame_time", F.explode("frames")).drop("frames")


def frame_matches(hits: DataFrame, ocr: DataFrame, low: Column, high: Column) -> DataFrame:
    """Frames in a time range of each keyword with a full or a partial match. hits may carry more columns."""
    met = frames_between(hits, shown(ocr), low, high)
    met = by_keyword(met.select("video_id", "keyword_id", "n_needed", "single", F.when(F.col("needed"), F.col("part")).alias("part"), "frames"))
    out = met.groupBy("video_id", "keyword_id", "frame_time").agg((F.count_distinct("part") == F.max("n_needed")).alias("full"), F.max("single").alias("partial"))
    return out.where("full or partial")


def case_a_d(keywords: DataFrame, ocr: DataFrame, scenes: DataFrame, hits: DataFrame) -> DataFrame:
    """The keyword stands somewhere in the scene that is on screen when it is said. Full match: all parts in the union of
    the scene's frames; else any content word. Seen first at the earliest matching frame, else at the scene's start. More
    than a second into the scene it is case D, and the time is its onset inside the scene."""
    k = settled(scene_at(keywords.select("video_id", "keyword_id", "t_narr"), scenes, "t_narr", "keyword_id").where("scene_id is not null"), "keyword-scenes")
    h = hits.select("video_id", "keyword_id", "n_needed", "single", F.when(F.col("needed"), F.col("part")).alias("part"), "tok").join(large(k.select("video_id", "keyword_id", "scene_t_start", "scene_t_end")), ["video_id", "keyword_id"])
    met = frames_between(h, shown(ocr), "scene_t_start", "scene_t_end")
    met = by_keyword(met.select("video_id", "keyword_id", "n_needed", "single", "part", "frames"))
    per_frame = met.groupBy("video_id", "keyword_id", "frame_time").agg(F.collect_set("part").alias("parts"), F.max("n_needed").alias("n_needed"), F.max("single").alias("single"))
    good = (F.size("parts") == F.col("n_needed")) | F.col("single")
    found = per_frame.groupBy("video_id", "keyword_id").agg(
        F.min(F.when(good, F.col("frame_time"))).alias("first"), F.size(F.array_distinct(F.flatten(F.collect_set("parts")))).alias("n_union"), F.max("n_needed").alias("n_needed"), F.max("single").alias("any")
    )
    found = found.withColumn("full", F.col("n_union") == F.col("n_needed")).where("full or any")
    out = k.join(large(found), ["video_id", "keyword_id"])
    t_vis = F.coalesce("first", "scene_t_start")
    case = F.when(t_vis <= F.col("scene_t_start") + 1, "A").otherwise("D")
    return _result(out, t_vis, t_vis - F.col("t_narr"), case, F.concat(F.lit("ocr_at_tnarr_"), _quality()), F.when(F.col("full"), 1.0).otherwise(0.8), F.when(F.col("full"), "HIGH").otherwise("MEDIUM"), onset=F.when(case == "D", t_vis))


def _quality() -> Column:
    return F.when(F.col("full"), "full").otherwise("partial")


def _result(rows: DataFrame, t_vis: Column, delta: Column, case: Column, method: Column, alpha: Column, confidence: Column, onset: Column | None = None, gap: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("double")
    return rows.select(
        "video_id", "keyword_id", "t_narr", t_vis.alias("t_vis"), delta.alias("delta_t"), case.alias("match_case"), method.alias("match_method"), alpha.cast("double").alias("alpha"),
        "scene_id", "scene_t_start", "scene_t_end", confidence.alias("confidence"), (none if onset is None else onset).alias("sub_scene_onset"), (none if gap is None else gap).alias("gap_since_expired"),
    )


def case_b_forward(keywords: DataFrame, ocr: DataFrame, scenes: DataFrame, hits: DataFrame, window: float = 10.0) -> DataFrame:
    """Shown later: the earliest frame after the word with a full match, else with a partial one; at the start of that
    frame's scene if the words there match fully."""
    t = F.col("t_narr")
    frames = frame_matches(hits, ocr, t + 1, t + window)
    first = frames.groupBy("video_id", "keyword_id").agg(F.min(F.struct(~F.col("full"), "frame_time")).alias("f"))
    first = first.select("video_id", "keyword_id", F.col("f.frame_time").alias("seen"), (~F.col("f.col1")).alias("full"))
    first = settled(keywords.select("video_id", "keyword_id", "t_narr").join(large(first), ["video_id", "keyword_id"]), "forward-frames")
    k = settled(scene_at(first, scenes, "seen", "keyword_id"), "forward-scenes")
    start = nearest_frame(k.select("video_id", "keyword_id", "scene_t_start"), frame_times(ocr), "scene_t_start", "keyword_id", 1.0).withColumnRenamed("frame_time", "start_frame").drop("scene_t_start")
    at_start = frames_between(hits.join(large(start), ["video_id", "keyword_id"]), shown(ocr), "start_frame", "start_frame")
    whole = at_start.groupBy("video_id", "keyword_id").agg((F.count_distinct(F.when(F.col("needed"), F.col("part"))) == F.max("n_needed")).alias("at_start"))
    out = k.join(large(whole), ["video_id", "keyword_id"], "left")
    t_vis = F.when(F.coalesce("at_start", F.lit(False)), F.col("scene_t_start")).otherwise(F.col("seen"))
    return _result(out, t_vis, t_vis - t, F.lit("B"), F.concat(F.lit("ocr_forward_"), _quality()), F.when(F.col("full"), 1.0).otherwise(0.8), F.when(F.col("full"), "HIGH").otherwise("MEDIUM"))


def case_c_backward(keywords: DataFrame, ocr: DataFrame, scenes: DataFrame, hits: DataFrame, window: float = 10.0) -> DataFrame:
    """Shown earlier and gone: the latest earlier frame with a full match, in a scene that ended before the word. Seen at
    that scene's start; the offset counts as the whole window, and the time since the scene's end is returned beside it."""
    t = F.col("t_narr")
    frames = frame_matches(hits, ocr, t - window, t - 1).where("full").join(large(keywords.select("video_id", "keyword_id", "t_narr")), ["video_id", "keyword_id"]).where(F.col("frame_time") < t - 1)
    last = settled(frames.groupBy("video_id", "keyword_id", "t_narr").agg(F.max("frame_time").alias("seen")), "backward-frames")
    out = scene_at(last, scenes, "seen", "keyword_id").where(F.col("scene_t_end") < t)
    return _result(out, F.col("scene_t_start"), F.lit(window), F.lit("C"), F.lit("ocr_backward_expired"), F.lit(0.8), F.lit("MEDIUM"), gap=t - F.col("scene_t_end"))


def case_e_concept(keywords: DataFrame, concepts: DataFrame, window: float = 10.0, least: float = 75.0, exact_only: bool = False) -> DataFrame:
    """A concept of a scene whose keyframe is near: part of each other counts 100, else the token-set ratio; the best
    score wins, of equal ones the first scene. concepts: scenes with one concept per row."""
    c = concepts.select("video_id", "scene_id", F.col("t_start").alias("scene_t_start"), F.col("t_end").alias("scene_t_end"), "t_keyframe", F.lower("concept").alias("concept"))
    k = keywords.select("video_id", "keyword_id", "t_narr", F.lower("keyword_text").alias("kw"))
    pairs = bucketed_range_join(k, c, F.col("t_narr") - window, F.col("t_narr") + window, "t_keyframe")
    inside = F.contains("concept", "kw") | F.contains("kw", "concept")
    pairs = pairs.withColumn("score", F.when(inside, 100.0).otherwise(F.lit(0.0)) if exact_only else token_set_ratio("kw", "concept")).where(F.col("score") >= least)
    best = pairs.groupBy("video_id", "keyword_id", "t_narr").agg(F.min(F.struct((-F.col("score")).alias("s"), "scene_id", "concept", "scene_t_start", "scene_t_end")).alias("b"))
    out = best.select("video_id", "keyword_id", "t_narr", (-F.col("b.s")).alias("score"), "b.scene_id", "b.scene_t_start", "b.scene_t_end")
    start = F.col("scene_t_start")
    return _result(out, start, start - F.col("t_narr"), F.lit("E"), F.when(F.col("score") >= 100, "concept_exact").otherwise("concept_fuzzy"), F.least(F.lit(0.9), 0.6 + 0.3 * F.col("score") / 100), F.when(F.col("score") >= 90, "HIGH").otherwise("MEDIUM"))


def case_g_vector(keywords: DataFrame, scenes: DataFrame, window: float = 10.0, sigma: float = 5.0, least: float = 0.55) -> DataFrame:
    """Keyword and keyframe vectors: the scene with the best similarity times nearness, if the similarity alone reaches
    the limit. keywords: embedding, groundability; scenes: embedding, has_words."""
    k = keywords.where(F.col("groundability") != "LOW").select("video_id", "keyword_id", "t_narr", F.col("embedding").alias("kv"))
    s = scenes.select("video_id", "scene_id", F.col("t_start").alias("scene_t_start"), F.col("t_end").alias("scene_t_end"), "t_keyframe", F.col("embedding").alias("sv"), "has_words")
    pairs = bucketed_range_join(k, s, F.col("t_narr") - window, F.col("t_narr") + window, "t_keyframe")
    pairs = pairs.withColumn("sim", S.sigmoid(S.dot(F.col("kv"), F.col("sv")))).withColumn("w", F.col("sim") * S.bell(F.col("t_keyframe") - F.col("t_narr"), sigma))
    best = pairs.groupBy("video_id", "keyword_id", "t_narr").agg(F.max_by(F.struct("scene_id", "scene_t_start", "scene_t_end", "sim", "has_words"), F.struct("w", -F.col("scene_id"))).alias("b"))
    out = best.select("video_id", "keyword_id", "t_narr", "b.*").where(F.col("sim") >= least)
    base = F.when(F.col("has_words"), 0.25).otherwise(0.4)
    alpha = F.greatest(F.lit(0.1), F.least(F.lit(0.5), base * F.least(F.lit(1.0), (F.col("sim") - least) / 0.05)))
    return _result(out, F.col("scene_t_start"), F.col("scene_t_start") - F.col("t_narr"), F.lit("G"), F.lit("vector"), alpha, F.lit("LOW"))


def no_match_reason(keywords: DataFrame, ocr: DataFrame, window: float = 10.0) -> DataFrame:
    """Why a keyword found nothing. keywords: groundability, t_narr."""
    frames = frame_times(ocr).groupBy("video_id", bucket_of(F.col("frame_time"), PACKED).alias("bucket_")).agg(F.collect_list("frame_time").alias("frames"))
    near = frames_between(keywords.select("video_id", "keyword_id", "t_narr"), frames, F.col("t_narr") - window, F.col("t_narr") + window, ("video_id",)).select("video_id", "keyword_id").distinct()
    rows = keywords.join(large(near.withColumn("near_", F.lit(True))), ["video_id", "keyword_id"], "left")
    reason = F.when(F.col("groundability") == "LOW", "low_groundability").when(F.col("t_narr").isNull(), "no_t_narr").when(F.col("near_").isNull(), "no_ocr_nearby").otherwise("ocr_vocabulary_mismatch")
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    return rows.select("video_id", "keyword_id", "t_narr", null("t_vis", "double"), null("delta_t", "double"), F.lit("F").alias("match_case"), reason.alias("match_method"), F.lit(0.0).alias("alpha"), null("scene_id", "int"), null("scene_t_start", "double"), null("scene_t_end", "double"), F.lit("NONE").alias("confidence"), null("sub_scene_onset", "double"), null("gap_since_expired", "double"))


def cascade(cases: list[DataFrame], keys: tuple[str, ...] = ("video_id", "keyword_id")) -> DataFrame:
    """The first case in order that has a row for each key. Each case has at most one, so one aggregation decides."""
    ranked = [c.select(*RESULT).withColumn("rank_", F.lit(i)) for i, c in enumerate(cases)]
    rows = ranked[0]
    for r in ranked[1:]:
        rows = rows.unionByName(r)
    rest = [c for c in [*RESULT, "rank_"] if c not in keys]
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "rank_").alias("b"))
    return best.select(*keys, "b.*").select(*RESULT)


def align_keywords(keywords: DataFrame, ocr: DataFrame, scenes: DataFrame, concepts: DataFrame | None = None, vectors: tuple[DataFrame, DataFrame] | None = None, threshold: float | None = 0.8) -> DataFrame:
    """The whole cascade A/D, B, C, E, G, F. Keywords of LOW groundability go straight to F."""
    able = keywords.where((F.col("groundability") != "LOW") & F.col("t_narr").isNotNull())
    ocr = ocr if "frames" in ocr.columns else settled(shown(ocr), "shown")
    hits = settled(token_hits(able, ocr, threshold), "token-hits")  # three cases read it
    cases = [case_a_d(able, ocr, scenes, hits), case_b_forward(able, ocr, scenes, hits), case_c_backward(able, ocr, scenes, hits)]
    if concepts is not None:
        cases.append(case_e_concept(able, concepts, exact_only=threshold is None))
    if vectors is not None:
        cases.append(case_g_vector(*vectors))
    return cascade([*cases, no_match_reason(keywords, ocr)])


# --- scene-first tracks: delta is narration minus visual --------------------------------------------------------------


def exact_word_match(scene_words: DataFrame, words: DataFrame, window: float = 30.0) -> DataFrame:
    """scene_words: video_id, scene_id, t_vis, tok; words: video_id, tok, t. Per token the nearest spoken one within the
    window, then the median offset and the matched tokens of each scene."""
    pairs = bucketed_range_join(scene_words, words.select("video_id", "tok", "t"), F.col("t_vis") - window, F.col("t_vis") + window, "t", window, ("video_id", "tok"))
    near = pairs.groupBy("video_id", "scene_id", "t_vis", "tok").agg(F.min(F.struct(F.abs(F.col("t") - F.col("t_vis")).alias("d"), "t")).alias("n"))
    return near.groupBy("video_id", "scene_id", "t_vis").agg(F.median(F.col("n.t") - F.col("t_vis")).alias("delta_narr_vis"), F.array_join(F.array_sort(F.collect_set("tok")), " ").alias("matched_words"))


def first_in_window(scene_words: DataFrame, words: DataFrame, window: float = 60.0) -> DataFrame:
    """Second generation: the earliest spoken word of the scene within the window."""
    pairs = bucketed_range_join(scene_words, words.select("video_id", "tok", "t"), F.col("t_vis") - window, F.col("t_vis") + window, "t", window, ("video_id", "tok"))
    best = pairs.groupBy("video_id", "scene_id", "t_vis").agg(F.min(F.struct("t", "tok")).alias("b"))
    return best.select("video_id", "scene_id", "t_vis", (F.col("b.t") - F.col("t_vis")).alias("delta_narr_vis"), F.col("b.tok").alias("matched_words"))


def scene_track_a(scene_words: DataFrame, words: DataFrame, window: float = 30.0, context: tuple[DataFrame, DataFrame, float] | None = None) -> DataFrame:
    """Track A with alpha 1. ``context`` (scene vectors, segment vectors, least cosine) also asks the nearest segment to
    be about the same thing."""
    out = exact_word_match(scene_words, words, window).withColumns({"match_track": F.lit("A"), "alpha": F.lit(1.0)})
    if context is None:
        return out
    scenes, segments, least = context
    near = nearest_segment(out.select("video_id", "scene_id", "t_vis"), segments, "t_vis", "scene_id").drop("t_vis")
    sims = near.join(scenes.select("video_id", "scene_id", F.col("embedding").alias("a_")), ["video_id", "scene_id"]).join(segments.select("video_id", "segment_id", F.col("embedding").alias("b_")), ["video_id", "segment_id"])
    good = sims.where(S.cosine(F.col("a_"), F.col("b_")) >= least).select("video_id", "scene_id")
    return out.join(good, ["video_id", "scene_id"], "left_semi")


#: Sigmas within which a scene looks for its segment, one after another.
REACHES = (6, 12, 24, 48)


def first_outside(scenes: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """video_id, scene_id, t_vis, segment_id: the first segment of those further away than ``reach``."""
    key = ["video_id", "scene_id", "t_vis"]
    place = F.struct("scene_id", "t_vis")
    middles = segments.select("video_id", F.col("t_mid").alias("at"), F.lit(1).alias("side"), F.lit(None).cast(scenes.select(place.alias("p")).schema["p"].dataType).alias("p"), "segment_id")

    def least(edge: Column, side: int, ask) -> DataFrame:
        points = scenes.select("video_id", edge.alias("at"), F.lit(side).alias("side"), place.alias("p"), F.lit(None).cast(segments.schema["segment_id"].dataType).alias("segment_id"))
        order = [F.col("at"), F.col("side"), F.col("p"), F.col("segment_id")]
        out = scan(points.unionByName(middles), F.floor(F.col("at") / SECONDS), order, least_=ask(F.col("segment_id"))).where("p is not null")
        return out.select("video_id", "p.*", F.col("least_").alias("segment_id"))

    # a point stands before the middles at its lower edge and behind those at its upper edge
    both = least(F.col("t_vis") - reach, 0, least_before).unionByName(least(F.col("t_vis") + reach, 2, least_after))
    return both.groupBy(*key).agg(F.min("segment_id").alias("segment_id")).where("segment_id is not null")


def vector_matches(scenes: DataFrame, segments: DataFrame, sigma: float = 15.0) -> DataFrame:
    """scenes: video_id, scene_id, t_vis, embedding; segments: video_id, segment_id, t_mid, embedding. Of each scene the
    segment with the best similarity times nearness: video_id, scene_id, t_vis, segment_id, t_mid, sim, w.

    A scene meets the segments within six sigma first, by buckets of time; if its best product there is no more than what
    nearness leaves outside, those within twice as many, up to 48 sigma. Beyond that nearness is 0 in doubles, so of all
    segments there only the first one can count, which a scan of least numbers finds; no scene meets a whole recording."""
    s = segments.select("video_id", "segment_id", "t_mid", F.col("embedding").alias("b_"), S.norm(F.col("embedding")).alias("nb_"))
    a = scenes.select("video_id", "scene_id", "t_vis", F.col("embedding").alias("a_"), S.norm(F.col("embedding")).alias("na_"))
    key = ["video_id", "scene_id", "t_vis"]

    def best_of(pairs: DataFrame) -> DataFrame:
        sim = F.coalesce(F.try_divide(S.dot(F.col("a_"), F.col("b_")), F.col("na_") * F.col("nb_")), F.lit(0.0))  # lengths are taken once a row, not once a pair
        pairs = pairs.withColumn("sim", sim).withColumn("w", F.col("sim") * S.bell(F.col("t_mid") - F.col("t_vis"), sigma))
        return pairs.groupBy(*key).agg(F.max_by(F.struct("segment_id", "t_mid", "sim", "w"), F.struct("w", -F.col("segment_id"))).alias("b"))

    rest, found = a, []
    for n in REACHES:
        near = settled(best_of(bucketed_range_join(rest, s, F.col("t_vis") - n * sigma, F.col("t_vis") + n * sigma, "t_mid", n * sigma / 6)), "vector-near")
        sure = near.where(F.col("b.w") > math.exp(-0.5 * n**2))
        found.append(sure)
        rest = settled(rest.join(large(sure.select("video_id", "scene_id")), ["video_id", "scene_id"], "left_anti"), "vector-rest")
        if rest.isEmpty():
            break
    else:
        far = best_of(rest.join(first_outside(rest, s, REACHES[-1] * sigma), key).join(s, ["video_id", "segment_id"]))
        both = near.join(rest.select(*key), key, "left_semi").unionByName(far)
        found.append(both.groupBy(*key).agg(F.max_by("b", F.struct("b.w", -F.col("b.segment_id"))).alias("b")))
    return reduce(DataFrame.unionByName, found).select("video_id", "scene_id", "t_vis", "b.*")


def scene_track_vector(scenes: DataFrame, segments: DataFrame, sigma: float = 15.0, least: float = 0.2, track: str = "vector", windows: DataFrame | None = None) -> DataFrame:
    """The segment of each scene by ``vector_matches``, accepted by its similarity; the same for image and text vectors. With
    ``windows`` (video_id, segment_id, window_id, t_center, embedding: runs of three words) the most similar run inside the
    chosen segment gives the time; a segment without runs keeps its middle."""
    return vector_track(vector_matches(scenes, segments, sigma), least, track, scenes, windows)


def vector_track(matches: DataFrame, least: float = 0.2, track: str = "vector", scenes: DataFrame | None = None, windows: DataFrame | None = None) -> DataFrame:
    """A track out of matches, which several tracks over the same vectors can share; windows need the scenes."""
    out, t = matches.where(F.col("sim") >= least), F.col("t_mid")
    if windows is not None:
        w = windows.select("video_id", "segment_id", "window_id", "t_center", F.col("embedding").alias("c_"))
        inside = out.select("video_id", "scene_id", "segment_id").join(large(scenes.select("video_id", "scene_id", F.col("embedding").alias("a_"))), ["video_id", "scene_id"]).join(large(w), ["video_id", "segment_id"])
        run = inside.groupBy("video_id", "scene_id").agg(F.max_by("t_center", F.struct(S.cosine(F.col("a_"), F.col("c_")), -F.col("window_id"))).alias("t_run"))
        out, t = out.join(large(run), ["video_id", "scene_id"], "left"), F.coalesce("t_run", "t_mid")
    return out.select("video_id", "scene_id", "t_vis", "segment_id", (t - F.col("t_vis")).alias("delta_narr_vis"), F.lit(track).alias("match_track"), S.alpha_half(F.col("sim"), least, 1.0).alias("alpha"))


def scene_cascade(scenes: DataFrame, tracks: list[DataFrame]) -> DataFrame:
    """scenes: video_id, scene_id, is_content. First track that has the scene; non-content scenes are skipped."""
    cols = ["video_id", "scene_id", "delta_narr_vis", "match_track", "alpha"]
    rows = None
    for i, t in enumerate(tracks):
        r = t.select(*cols).withColumn("rank_", F.lit(i))
        rows = r if rows is None else rows.unionByName(r)
    best = rows.groupBy("video_id", "scene_id").agg(F.min_by(F.struct("delta_narr_vis", "match_track", "alpha"), "rank_").alias("b"))
    out = scenes.join(large(best), ["video_id", "scene_id"], "left")
    kind = F.when(~F.col("is_content"), "non_content").when(F.col("b").isNull(), "no_match").otherwise("match")
    own = F.col("is_content")
    return out.select("video_id", "scene_id", kind.alias("match_type"), F.when(own, F.col("b.delta_narr_vis")).alias("delta_narr_vis"), F.when(own, F.col("b.match_track")).alias("match_track"), F.when(own, F.coalesce("b.alpha", F.lit(0.0))).alias("alpha"))


#: Of the grounding steps: weight of a confidence in a segment, and the confidence of each method.
CONFIDENCE_WEIGHTS = {"HIGH": 1.0, "MEDIUM": 0.7, "LOW": 0.4, "VERY_LOW": 0.2}
METHODS = {"ocr": "HIGH", "grounding_dino": "MEDIUM", "siglip_contextual": "LOW", "vlm_classification": "LOW"}


def keyword_grounding(
    keywords: DataFrame, hits: DataFrame, ocr: DataFrame, detections: DataFrame, vectors: DataFrame, asked: DataFrame, transient: DataFrame | None = None, least: float = 0.15, sigma: float = 15.0
) -> DataFrame:
    """Second generation, step by step until one finds the keyword; keywords (video_id, keyword_id, t_narr, groundability)
    of LOW groundability are skipped:

    1. the nearest frame within 60 s that shows every word of the keyword (``hits`` from ``token_hits``);
    2. within 30 s the detection with the highest confidence: detections (video_id, keyword_id, t, value, area);
    3. within 30 s the picture with the highest similarity times nearness (a bell of ``sigma``), if its similarity itself
       is above ``least``: vectors (video_id, keyword_id, t, value);
    4. for HIGH groundability only, the first picture within 30 s that was said to show it: asked (video_id, keyword_id, t,
       yes); such a finding is flagged for review.

    A null t_narr counts as 0 and leaves the gap null. Findings of steps 2 to 4 can be marked transient by a table
    (video_id, keyword_id, is_transient), as from a check of neighbouring frames; without it none is. Of equal ones the
    earliest counts."""
    able = keywords.where(F.col("groundability") != "LOW").select("video_id", "keyword_id", "groundability", F.coalesce("t_narr", F.lit(0.0)).alias("at_"))
    key = ["video_id", "keyword_id"]
    spoken = hits.drop("t_narr").join(large(able.select(*key, "at_")), key)
    shown = frame_matches(spoken, ocr, F.col("at_") - 60, F.col("at_") + 60).where("full").join(large(able.select(*key, "at_")), key)
    found = shown.groupBy(*key).agg(F.min(F.struct(F.abs(F.col("frame_time") - F.col("at_")).alias("d"), "frame_time")).alias("b"))
    rows = found.select(*key, F.col("b.frame_time").alias("t_vis"), F.lit(0).alias("step"), F.lit("ocr").alias("method"), F.lit(None).cast("double").alias("bbox_area"))

    def near(table: DataFrame) -> DataFrame:
        return able.join(large(table), key).where(F.abs(F.col("t") - F.col("at_")) <= 30)

    def step(best: DataFrame, number: int, method: str, area: Column) -> DataFrame:
        return best.select(*key, F.col("b.t").alias("t_vis"), F.lit(number).alias("step"), F.lit(method).alias("method"), area.cast("double").alias("bbox_area"))

    seen = near(detections).where("value > 0").groupBy(*key).agg(F.max(F.struct("value", (-F.col("t")).alias("m"), "t", "area")).alias("b"))
    weighted = F.col("value") * S.bell(F.col("t") - F.col("at_"), sigma)
    alike = near(vectors).groupBy(*key).agg(F.max(F.struct(F.round(weighted, 12).alias("w"), (-F.col("t")).alias("m"), "t", "value")).alias("b")).where(F.col("b.value") > least)
    said = near(asked.where("yes")).where("groundability = 'HIGH'").groupBy(*key).agg(F.min(F.struct("t")).alias("b"))
    none = F.lit(None)
    for more in (step(seen, 1, "grounding_dino", F.col("b.area")), step(alike, 2, "siglip_contextual", none), step(said, 3, "vlm_classification", none)):
        rows = rows.unionByName(more)
    best = rows.groupBy(*key).agg(F.min(F.struct("step", "t_vis", "method", "bbox_area")).alias("b"))
    out = keywords.select(*key, "t_narr", "groundability").join(large(best), key, "left")
    method = F.coalesce("b.method", F.when(F.col("groundability") == "LOW", "skipped_low_groundability").otherwise("not_found"))
    confidence = F.coalesce(*[F.when(F.col("b.method") == m, c) for m, c in METHODS.items()], F.lit("NONE"))
    passing = F.lit(False)
    if transient is not None:
        out = out.join(large(transient.select(*key, F.col("is_transient").alias("passing_")).groupBy(*key).agg(F.max("passing_").alias("passing_"))), key, "left")
        passing = F.coalesce("passing_", F.lit(False)) & F.coalesce(F.col("b.step") > 0, F.lit(False))
    return out.select(
        *key, "groundability", "t_narr", F.col("b.t_vis").alias("t_vis"), (F.col("b.t_vis") - F.col("t_narr")).alias("delta_t"), method.alias("method"), confidence.alias("confidence"),
        F.col("b.bbox_area").alias("bbox_area"), passing.alias("is_transient"), F.col("b.t_vis").isNotNull().alias("is_visual"), F.coalesce(F.col("b.step") == 3, F.lit(False)).alias("flag_for_review"),
    )


def grounding_by_segment(grounded: DataFrame) -> DataFrame:
    """Per segment, from grounded keywords with segment_id: counts, mean and deviation of gaps, and the gap at which the
    confidence of the smaller ones first holds half of all."""
    d, visual = F.col("delta_t"), F.col("is_visual")
    weight = F.coalesce(*[F.when(F.col("confidence") == c, w) for c, w in CONFIDENCE_WEIGHTS.items()], F.lit(0.5))
    keys = ("video_id", "segment_id")
    per = grounded.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_keywords"), F.count_if(F.col("groundability") != "LOW").alias("n_groundable"), F.count_if(visual).alias("n_grounded"), F.count_if(~visual).alias("n_not_visual"),
        F.avg(d).alias("delta_t_mean"), F.stddev_pop(d).alias("delta_t_std"),
    )
    middle = weighted_median(grounded.where(d.isNotNull()).withColumn("cw_", weight), "delta_t", "cw_", keys)
    return per.join(large(middle.withColumnRenamed("weighted_median", "delta_t_weighted_median")), list(keys), "left")


def monotonic_violations(align: DataFrame, slack: float = 10.0) -> DataFrame:
    """Events in visual order whose word comes more than the slack before that of the event before."""
    order = [F.col(c) for c in ("t_vis", "keyword_id", "segment_id", "t_narr", "alpha")]
    rows = scan(align, F.floor(F.col("t_vis") / SECONDS), order, before_=previous(F.struct("t_narr")))
    return rows.withColumn("violates", F.coalesce(F.col("t_narr") < F.col("before_.t_narr") - slack, F.lit(False))).drop("before_")
