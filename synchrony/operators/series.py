"""Ordered series: change signals, thresholds, boundaries, scenes, runs, dips and delays.

Series are keyed by video_id (or a pair) and ordered by frame_idx. Runs, events and shifts along a whole recording are scans
over buckets (``scans``); other windows are per recording.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.tokens import jaccard_distance
from ..sources.shared import large
from .scans import PLACES, SECONDS, previous, quantiles, scan, sum_before
from .timejoin import bucketed_range_join

KEY = ("video_id",)


def by(*order, keys=KEY):
    return Window.partitionBy(*keys).orderBy(*order)


def whole(keys=KEY):
    return Window.partitionBy(*keys)


def islands(rows: DataFrame, new: Callable[[Column], Column], order: str, keys=KEY, size: float = PLACES) -> DataFrame:
    """+ island: the place in the order at which the run of a row begins; ``new`` tells from the place of the row before
    whether a row opens one, as the first row does."""
    here = F.col(order)
    bucket = lambda: F.floor(here / size)
    rows = scan(rows, bucket(), [here], keys, before_=previous(here))
    opens = F.coalesce(new(F.col("before_")), F.lit(True))
    return scan(rows.withColumn("opens_", F.when(opens, here)), bucket(), [here], keys, island=previous(F.col("opens_"), current=True)).drop("before_", "opens_")


# --- signals ----------------------------------------------------------------------------------------------------------


def consecutive_distance(frames: DataFrame, metric: str = "cosine") -> DataFrame:
    """Distance of each frame's vector from the one before; 0 for the first."""
    before = F.lag("embedding").over(by("frame_idx"))
    rows = frames.withColumn("before_", before)
    value = 1 - S.cosine(F.col("embedding"), F.col("before_")) if metric == "cosine" else S.mean_abs_difference(F.col("embedding"), F.col("before_"))
    return rows.withColumn("distance", F.when(F.col("before_").isNull(), 0.0).otherwise(value)).drop("before_")


def normalize_by_max(series: DataFrame, column: str) -> DataFrame:
    top = F.max(column).over(whole())
    return series.withColumn(column, F.when(top > 0, F.col(column) / top).otherwise(F.col(column)))


def jaccard_change_signal(frames: DataFrame, step: int = 3, threshold: float = 0.5) -> DataFrame:
    """frames: video_id, frame_idx, words (array). Change of the word set between sampled frames, kept above the threshold,
    given to the sampled frame and the skipped ones before it, normalised."""
    sampled = frames.where(F.col("frame_idx") % step == 0)
    before = F.lag("words").over(by("frame_idx"))
    change = sampled.withColumn("p_", before).select("video_id", "frame_idx", F.when(F.col("p_").isNull(), 0.0).otherwise(jaccard_distance(F.col("words"), F.col("p_"))).alias("d_"))
    change = change.select("video_id", "frame_idx", F.when(F.col("d_") > threshold, F.col("d_")).otherwise(0.0).alias("d_"))
    rows = frames.select("video_id", "frame_idx").join(large(change), ["video_id", "frame_idx"], "left")
    ahead = by("frame_idx").rowsBetween(0, step - 1)
    rows = rows.withColumn("signal", F.coalesce(F.first("d_", ignorenulls=True).over(ahead), F.lit(0.0))).drop("d_")
    return normalize_by_max(rows, "signal")


def boundary_signal(cuts: DataFrame, frames: DataFrame, reach: float = 1.0) -> DataFrame:
    """1 at the frame nearest to each outside cut (video_id, t), else 0."""
    met = bucketed_range_join(cuts.select("video_id", "t"), frames.select("video_id", "frame_idx", "frame_time"), F.col("t") - reach, F.col("t") + reach, "frame_time", max(reach, 0.5))
    near = met.groupBy("video_id", "t").agg(F.min(F.struct(F.abs(F.col("frame_time") - F.col("t")), "frame_idx")).alias("n")).select("video_id", F.col("n.frame_idx").alias("frame_idx")).distinct()
    return frames.select("video_id", "frame_idx").join(near.withColumn("hit_", F.lit(1.0)), ["video_id", "frame_idx"], "left").select("video_id", "frame_idx", F.coalesce("hit_", F.lit(0.0)).alias("signal"))


def fuse_signals(cuts: DataFrame, visual: DataFrame, text: DataFrame, weights: tuple[float, float, float] = (0.35, 0.45, 0.20)) -> DataFrame:
    """Weighted sum of three signals (video_id, frame_idx, signal); without any text signal the other two share its
    weight."""
    a, b, c = weights
    rows = cuts.withColumnRenamed("signal", "a_").join(visual.withColumnRenamed("signal", "b_"), ["video_id", "frame_idx"]).join(text.withColumnRenamed("signal", "c_"), ["video_id", "frame_idx"])
    three = a * F.col("a_") + b * F.col("b_") + c * F.col("c_")
    two = (a * F.col("a_") + b * F.col("b_")) / (a + b)
    return rows.withColumn("signal", F.when(F.max("c_").over(whole()) > 0, three).otherwise(two)).drop("a_", "b_", "c_")


# --- thresholds and boundaries ----------------------------------------------------------------------------------------


def otsu_threshold(series: DataFrame, column: str = "signal", steps: int = 50, k: float = 1.0) -> DataFrame:
    """video_id, threshold: the candidate between minimum and maximum that separates best, the first of equal ones;
    mean + k deviations if none separates. Every row meets the fixed list of candidates, then partial sums shuffle."""
    x = F.col(column)
    span = series.groupBy("video_id").agg(F.min(x).alias("lo_"), F.max(x).alias("hi_"), F.avg(x).alias("avg_"), F.stddev_pop(x).alias("sd_"))
    rows = series.join(span, "video_id").withColumn("i_", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    cut = F.col("lo_") + (F.col("hi_") - F.col("lo_")) * F.col("i_") / (steps - 1)
    low = x < cut
    stats = rows.groupBy("video_id", "i_").agg(
        F.count_if(low).alias("n0"), F.count_if(~low).alias("n1"), F.avg(F.when(low, x)).alias("m0"), F.avg(F.when(~low, x)).alias("m1"), F.first(cut).alias("cut"), F.first(F.col("avg_") + k * F.col("sd_")).alias("fallback")
    )
    n = F.col("n0") + F.col("n1")
    between = F.round(F.col("n0") / n * F.col("n1") / n * F.pow(F.col("m0") - F.col("m1"), 2), 12)
    best = stats.withColumn("v", F.when((F.col("n0") > 0) & (F.col("n1") > 0), between)).groupBy("video_id").agg(F.max_by(F.struct("cut", "v"), F.struct(F.coalesce("v", F.lit(-1.0)), -F.col("i_"))).alias("b"), F.first("fallback").alias("fallback"))
    return best.select("video_id", F.when(F.coalesce("b.v", F.lit(0.0)) > 0, F.col("b.cut")).otherwise(F.col("fallback")).alias("threshold"))


def find_boundaries(series: DataFrame, column: str, threshold: Column, keys=KEY) -> DataFrame:
    """Rows at or above the threshold, grouped while at most two frames apart; the first peak of each group."""
    hot = series.where(F.col(column) >= threshold)
    rows = islands(hot, lambda before: F.col("frame_idx") - before > 2, "frame_idx", keys)
    peaks = rows.groupBy(*keys, "island").agg(F.max_by(F.struct("frame_idx", "t", column), F.struct(F.col(column), -F.col("frame_idx"))).alias("p"))
    return peaks.select(*keys, F.col("p.frame_idx").alias("frame_idx"), F.col("p.t").alias("t"), F.col(f"p.{column}").alias("score"))


FACTORS = (1.0, 0.75, 0.5, 0.25)


def density_guard(series: DataFrame, thresholds: DataFrame, column: str = "signal", per_minute: float = 4.0, longest: float = 30.0, k_fallback: float = 0.5) -> DataFrame:
    """Boundaries with a guard against too few: lower thresholds are tried, all at once, and the first good one is taken;
    recordings over a minute with under three boundaries may use mean plus k deviations. + mode."""
    stats = series.groupBy("video_id").agg(F.max("t").alias("last_"), (F.max("t") - F.min("t")).alias("dur_"), F.min("t").alias("first_"), (F.avg(column) + k_fallback * F.stddev_pop(column)).alias("soft_")).join(thresholds, "video_id")
    tries = stats.select("video_id", "first_", "last_", "dur_", F.col("threshold").alias("base_"), F.posexplode(F.array(*[F.col("threshold") * f for f in FACTORS], F.col("soft_"))).alias("try", "thr"))
    found = find_boundaries(series.select("video_id", "frame_idx", "t", column).join(tries.select("video_id", "try", "thr"), "video_id"), column, F.col("thr"), ("video_id", "try"))
    w = Window.partitionBy("video_id", "try").orderBy("t")
    gaps = found.withColumn("gap_", F.col("t") - F.lag("t").over(w)).groupBy("video_id", "try").agg(F.count(F.lit(1)).alias("n"), F.max("gap_").alias("g"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    rows = tries.join(gaps, ["video_id", "try"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("max_dur", F.greatest(F.coalesce("g", F.lit(0.0)), F.coalesce(F.col("t0") - F.col("first_"), F.col("dur_")), F.coalesce(F.col("last_") - F.col("t1"), F.col("dur_"))))
    expected = per_minute * F.col("dur_") / 60
    rows = rows.withColumn("ok", (F.col("max_dur") <= longest) | (F.col("n") >= 0.8 * expected)).withColumn("expected", expected)
    n0 = F.max(F.when(F.col("try") == 0, F.col("n"))).over(whole())
    few = n0 + 1 < 0.5 * F.col("expected")
    soft = ~few & (n0 < 3) & (F.col("dur_") > 60) & (F.max(F.when(F.col("try") == 4, F.col("thr"))).over(whole()) < F.col("base_"))
    rank = F.when(few, F.when(F.col("try").isin(1, 2, 3), F.when(F.col("ok"), F.col("try")).otherwise(10 - F.col("try"))).otherwise(99)).when(soft, F.when(F.col("try") == 4, 0).otherwise(99)).otherwise(F.when(F.col("try") == 0, 0).otherwise(99))
    mode = F.when(few, "density-forced").when(soft, "fallback").otherwise("natural")
    picked = rows.withColumns({"rank_": rank, "mode": mode}).groupBy("video_id").agg(F.min_by(F.struct("try", "mode", "thr"), F.struct("rank_", "try")).alias("p")).select("video_id", F.col("p.try").alias("try"), F.col("p.mode").alias("mode"), F.col("p.thr").alias("threshold"))
    return picked.join(found, ["video_id", "try"], "left").select("video_id", "mode", "threshold", "frame_idx", "t", "score")


def build_scenes(boundaries: DataFrame, frames: DataFrame) -> DataFrame:
    """Intervals between neighbouring boundaries, with the first and the last frame as ends."""
    ends = frames.groupBy("video_id").agg(F.min(F.struct("frame_idx", "t")).alias("a"), F.max(F.struct("frame_idx", "t")).alias("b"))
    starts = ends.select("video_id", F.col("a.frame_idx").alias("frame_idx"), F.col("a.t").alias("t")).unionByName(boundaries.where("frame_idx is not null").select("video_id", "frame_idx", "t"))
    w = by("frame_idx", "t")
    rows = starts.withColumn("scene_id", F.row_number().over(w) - 1).withColumn("e_", F.lead(F.struct("frame_idx", "t")).over(w)).join(ends.select("video_id", "b"), "video_id")
    end = F.coalesce("e_", "b")
    return rows.select("video_id", F.col("scene_id").cast("int").alias("scene_id"), F.col("frame_idx").alias("start_idx"), end["frame_idx"].alias("end_idx"), F.col("t").alias("t_start"), end["t"].alias("t_end"), (end["t"] - F.col("t")).alias("duration"), (end["frame_idx"] - F.col("frame_idx") + 1).alias("n_frames"))


def centroid_keyframe(scenes: DataFrame, frames: DataFrame) -> DataFrame:
    """Of the inner 80 % of a scene's frames the one most similar to their mean vector; the middle one of under three.
    The mean is taken dimension by dimension, so no vector list is gathered."""
    n = F.col("n_frames")
    margin = F.greatest(F.lit(1), F.floor(n * 0.1)).cast("int")
    inner = F.when(n >= 3, F.when(margin < F.floor(n / 2), margin).otherwise(0)).otherwise(0)
    s = scenes.withColumn("m_", inner).select("video_id", "scene_id", "start_idx", "end_idx", "n_frames", (F.col("start_idx") + F.col("m_")).alias("lo_i"), (F.col("end_idx") - F.col("m_")).alias("hi_i"))
    f = frames.select("video_id", "frame_idx", "frame_time", "embedding")
    met = bucketed_range_join(s, f, "lo_i", "hi_i", "frame_idx", 64.0)
    mean = met.select("video_id", "scene_id", F.posexplode("embedding").alias("d", "x")).groupBy("video_id", "scene_id", "d").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("video_id", "scene_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda p: p["x"]).alias("mean_"))
    best = met.join(mean, ["video_id", "scene_id"]).groupBy("video_id", "scene_id").agg(F.max_by("frame_time", F.struct(F.round(S.cosine(F.col("embedding"), F.col("mean_")), 12), -F.col("frame_idx"))).alias("t_keyframe"))
    short = s.where("n_frames < 3").withColumn("frame_idx", (F.col("start_idx") + F.floor(F.col("n_frames") / 2)).cast("int"))
    middle = short.join(f.select("video_id", "frame_idx", "frame_time"), ["video_id", "frame_idx"]).select("video_id", "scene_id", F.col("frame_time").alias("t_keyframe"))
    long = best.join(s.where("n_frames >= 3").select("video_id", "scene_id"), ["video_id", "scene_id"])
    return scenes.join(long.unionByName(middle), ["video_id", "scene_id"], "left")


MERGED = "video_id string, head long, t_start double, t_end double, words array<string>"


def merge_similar_short(scenes: DataFrame, shortest: float = 2.0, similarity: float = 0.85) -> DataFrame:
    """scenes: video_id, scene_id, t_start, t_end, embedding (of the keyframe), words. A short scene whose keyframe is
    similar to that of the running group's head is taken into it; a group keeps its head's picture, its last end and all
    words. Scenes of a recording come in order from a sorted partition, and a task holds the head of one group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        video, head, group = None, None, None

        def closed(rows: list) -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["video_id", "head", "t_start", "t_end", "words"])

        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                v = None if r["embedding"] is None else np.array(r["embedding"], float)
                near = False
                if group is not None and r["video_id"] == video and r["t_end"] - r["t_start"] < shortest and v is not None and head is not None and len(v) == len(head):
                    norm = np.sqrt((v * v).sum() * (head * head).sum())
                    near = bool(norm > 0 and (v * head).sum() / norm > similarity)
                if near:
                    group[3] = r["t_end"]
                    group[4].update(r["words"] or [])
                    continue
                if group is not None:
                    rows.append((*group[:4], sorted(group[4])))
                video, head = r["video_id"], v
                group = [video, r["scene_id"], r["t_start"], r["t_end"], set(r["words"] or [])]
            yield closed(rows)
        if group is not None:
            yield closed([(*group[:4], sorted(group[4]))])

    rows = scenes.select("video_id", F.col("scene_id").cast("long").alias("scene_id"), "t_start", "t_end", "embedding", "words")
    merged = rows.repartition("video_id").sortWithinPartitions("video_id", "scene_id").mapInArrow(run, MERGED)
    return merged.select("video_id", (F.row_number().over(by("head")) - 1).cast("int").alias("scene_id"), "t_start", "t_end", "words")


def force_split(scenes: DataFrame, series: DataFrame, longest: float = 30.0) -> DataFrame:
    """A scene over the limit is cut once, at the peak of 0.6 visual + 0.4 text in the middle of its frames; scenes of
    under five frames stay. series: video_id, frame_idx, t, visual, text."""
    n = F.col("end_idx") - F.col("start_idx")
    margin = F.greatest(F.lit(1), F.floor(n / 10)).cast("int")
    long = scenes.where((F.col("duration") > longest) & (n >= 4)).select("video_id", "scene_id", (F.col("start_idx") + margin).alias("lo_i"), (F.col("end_idx") - margin).alias("hi_i"))
    met = bucketed_range_join(long, series, "lo_i", "hi_i", "frame_idx", 64.0)
    texts = F.max("text").over(Window.partitionBy("video_id", "scene_id"))
    met = met.withColumn("peak_", F.round(F.when(texts > 0, 0.6 * F.col("visual") + 0.4 * F.col("text")).otherwise(F.col("visual")), 12))
    cut = met.groupBy("video_id", "scene_id").agg(F.max_by(F.struct("frame_idx", "t"), F.struct("peak_", -F.col("frame_idx"))).alias("c"))
    rows = scenes.select("video_id", "scene_id", "start_idx", "end_idx", "t_start", "t_end").join(cut, ["video_id", "scene_id"], "left")
    part = lambda a, b, s, e: F.struct(a.alias("start_idx"), b.alias("end_idx"), s.alias("t_start"), e.alias("t_end"))
    c = F.col
    both = F.array(part(c("start_idx"), c("c.frame_idx"), c("t_start"), c("c.t")), part(c("c.frame_idx"), c("end_idx"), c("c.t"), c("t_end")))
    one = F.array(part(c("start_idx"), c("end_idx"), c("t_start"), c("t_end")))
    rows = rows.select("video_id", F.explode(F.when(c("c").isNotNull(), both).otherwise(one)).alias("p")).select("video_id", "p.*")
    return rows.withColumn("scene_id", (F.row_number().over(by("start_idx", "end_idx")) - 1).cast("int")).withColumn("duration", c("t_end") - c("t_start"))


def scene_words(scenes: DataFrame, ocr: DataFrame) -> DataFrame:
    """Union of the words on the frames nearest to a scene's keyframe and to its start. ocr: video_id, frame_time, tok."""
    from .timejoin import nearest_frame

    marks = scenes.select("video_id", "scene_id", F.explode(F.array(F.struct(F.col("t_keyframe").alias("at"), F.lit(0).alias("k")), F.struct(F.col("t_start").alias("at"), F.lit(1).alias("k")))).alias("m")).select("video_id", F.concat_ws(":", "scene_id", "m.k").alias("mark"), "scene_id", "m.at")
    near = nearest_frame(marks, ocr, "at", "mark", 1.0)
    met = near.join(large(ocr), ["video_id", "frame_time"]).groupBy("video_id", "scene_id").agg(F.array_sort(F.collect_set("tok")).alias("words"))
    return scenes.join(large(met), ["video_id", "scene_id"], "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))


def scenes_by_threshold(series: DataFrame, thresholds: list[float], shortest: float = 3.0, new_words: int = 1, interval: float = 0.333) -> DataFrame:
    """series: video_id, frame_idx, t, ssim, new_words. One pass for all thresholds: a frame opens a scene if its
    similarity is below the threshold or it brings ``new_words`` new words; a scene lasts until one sampling interval
    after its last frame; scenes under the limit are dropped."""
    rows = series.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    keys = ("video_id", "threshold")
    w = Window.partitionBy(*keys).orderBy("frame_idx")
    opens = (F.col("ssim") < F.col("threshold")) | (F.col("new_words") >= new_words) | (F.row_number().over(w) == 1)
    rows = rows.withColumn("island", F.sum(F.coalesce(opens, F.lit(False)).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    per = rows.groupBy(*keys, "island").agg(F.min("t").alias("t_start"), (F.max("t") + interval).alias("t_end"), F.min("frame_idx").alias("start_frame_idx"), F.max("frame_idx").alias("end_frame_idx"))
    per = per.where(F.col("t_end") - F.col("t_start") >= shortest)
    number = (F.row_number().over(Window.partitionBy(*keys).orderBy("t_start")) - 1).cast("int").alias("scene_id")
    edges = [F.round(c, 4).alias(c) for c in ("t_start", "t_end")]
    return per.select(*keys, number, *edges, F.round(F.col("t_end") - F.col("t_start"), 4).alias("duration"), F.round("t_start", 4).alias("t_vis"), "start_frame_idx", "end_frame_idx")


def threshold_stats(scenes: DataFrame, series: DataFrame, thresholds: list[float], new_words: int = 1) -> DataFrame:
    """Per recording and threshold: scenes, their mean and median duration, frames that either sign would open a scene at,
    and how many of these gave none. Recordings without scenes are there with zeros."""
    d = F.col("duration")
    per = scenes.groupBy("video_id", "threshold").agg(F.count(F.lit(1)).alias("n_scenes"), F.round(F.avg(d) + 1e-9, 2).alias("mean_duration"), F.round(F.median(d), 2).alias("median_duration"))
    rows = series.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    signs = rows.groupBy("video_id", "threshold").agg(F.count_if(F.col("ssim") < F.col("threshold")).alias("n_ssim_boundaries"), F.count_if(F.col("new_words") >= new_words).alias("n_ocr_boundaries"))
    out = signs.join(per, ["video_id", "threshold"], "left").fillna(0, ["n_scenes", "mean_duration", "median_duration"])
    return out.withColumn("n_filtered_short", F.greatest(F.lit(0), F.col("n_ssim_boundaries") + F.col("n_ocr_boundaries") - F.col("n_scenes")))


def uniform_scenes(durations: DataFrame, length: float = 10.0, shortest: float = 1.0) -> DataFrame:
    """Tiles of equal length; a last piece under the limit is dropped."""
    n = F.greatest(F.ceil(F.col("duration") / length).cast("int"), F.lit(1))
    rows = durations.select("video_id", "duration", F.explode(F.sequence(F.lit(0), n - 1)).alias("scene_id"))
    rows = rows.select("video_id", "scene_id", (F.col("scene_id") * length).alias("t_start"), F.least((F.col("scene_id") + 1) * F.lit(length), F.col("duration")).alias("t_end"))
    return rows.where(F.col("t_end") - F.col("t_start") >= shortest)


# --- runs and events --------------------------------------------------------------------------------------------------


def freeze_runs(series: DataFrame, threshold: float = 0.5, shortest: float = 0.5, fps: float = 2.0) -> DataFrame:
    """Longest runs of differences under the threshold. A difference belongs to the pair that ends in its frame, so a run
    starts one frame earlier. series: frame_idx from 1 on holds the difference to the frame before."""
    low = series.where((F.col("frame_idx") > 0) & (F.col("mad") < threshold))
    rows = islands(low, lambda before: F.col("frame_idx") - before > 1, "frame_idx")
    runs = rows.groupBy("video_id", "island").agg((F.min("frame_idx") - 1).alias("start_frame"), F.max("frame_idx").alias("end_frame"))
    n = F.col("end_frame") - F.col("start_frame") + 1
    return runs.where(n >= int(shortest * fps)).select("video_id", "start_frame", "end_frame", (F.col("start_frame") / fps).alias("start_sec"), (F.col("end_frame") / fps).alias("end_sec"), (n / fps).alias("duration_sec"), n.alias("n_frames"))


def freeze_summary(runs: DataFrame) -> DataFrame:
    times = F.array_join(F.transform(F.array_sort(F.collect_list("start_sec")), lambda t: F.format_string("%.1f", t)), ", ")
    return runs.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_freezes"), F.sum("duration_sec").alias("total_sec"), times.alias("starts"))


def freezes_side_by_side(runs: DataFrame, most: int = 5) -> DataFrame:
    """The k-th freeze of every recording in one row per recording."""
    rows = runs.withColumn("k", F.row_number().over(by("start_frame"))).where(F.col("k") <= most)
    return rows.groupBy("video_id").pivot("k", list(range(1, most + 1))).agg(F.first("start_sec"))


def transitions(series: DataFrame, threshold: float, both_sides: bool = False) -> DataFrame:
    """diverge: the difference reaches the threshold after being below it; resync: the other way. The sample before the
    first counts as matching, unless both sides are asked for. + t_mid, the middle of the two samples."""
    rows = series.withColumn("low_", F.col("mad") < threshold)
    rows = scan(rows, F.floor(F.col("frame_idx") / PLACES), [F.col("frame_idx")], before_=previous(F.struct("low_", "t")))
    before = F.col("before_.low_") if both_sides else F.when(F.col("before_").isNull(), True).otherwise(F.col("before_.low_"))
    event = F.when(before & ~F.col("low_"), "diverge").when(~before & F.col("low_"), "resync")
    return rows.withColumn("event", event).where("event is not null").select("video_id", "frame_idx", "t", "event", F.coalesce((F.col("t") + F.col("before_.t")) / 2, F.col("t")).alias("t_mid"))


def mismatch_duration(events: DataFrame) -> DataFrame:
    """Each diverge with the next resync after it."""
    later = by("frame_idx").rowsBetween(1, Window.unboundedFollowing)
    rows = events.withColumn("until", F.min(F.when(F.col("event") == "resync", F.col("t"))).over(later)).where("event = 'diverge'")
    return rows.select("video_id", F.col("t").alias("t_start"), F.col("until").alias("t_end"), (F.col("until") - F.col("t")).alias("duration"))


def mad_split_stats(series: DataFrame, threshold: float) -> DataFrame:
    low, x = F.col("mad") < threshold, F.col("mad")
    return series.groupBy("video_id").agg(
        F.count_if(low).alias("n_below"), F.avg(F.when(low, x)).alias("mean_below"), F.max(F.when(low, x)).alias("max_below"), F.count_if(~low).alias("n_above"), F.avg(F.when(~low, x)).alias("mean_above"), F.min(F.when(~low, x)).alias("min_above")
    )


def adaptive_dip_threshold(series: DataFrame) -> DataFrame:
    """From the median and the first percentile of the similarity; 0.95 for recordings without a value."""
    p = quantiles(series, ["video_id"], med_=(F.col("ssim"), 0.5), low_=(F.col("ssim"), 0.01))
    med, low = F.col("med_"), F.col("low_")
    inner = F.greatest(F.lit(0.90), F.least(F.lit(0.999), med - 0.3 * (med - low)))
    out = series.select("video_id").distinct().join(p, "video_id", "left")
    return out.select("video_id", F.when(med.isNull(), 0.95).when(med >= 0.999, 0.999).otherwise(inner).alias("threshold"))


def dip_regions(series: DataFrame, threshold: Column | None = None, merge_gap: float = 2.0, shortest: float = 0.5) -> DataFrame:
    """Points under the threshold, chained while close in time; single short points are dropped."""
    low = series.where(F.col("ssim") < (F.lit(0.95) if threshold is None else threshold))
    rows = islands(low, lambda before: F.col("t") - before > merge_gap, "t", size=SECONDS)
    out = rows.groupBy("video_id", "island").agg(F.min("t").alias("start"), F.max("t").alias("end"), (F.max("t") - F.min("t")).alias("duration"), F.min("ssim").alias("min_ssim"), F.avg("ssim").alias("mean_ssim"), F.avg("t").alias("center"), F.count(F.lit(1)).alias("n_points"))
    return out.where((F.col("duration") >= shortest) | (F.col("n_points") >= 2)).drop("island")


def paired_series(reference: DataFrame, target: DataFrame, metric: str = "cosine") -> DataFrame:
    """Difference of two recordings' frames at the same times; reference and target carry pair_id, grid times are rounded
    to a tenth of a second."""
    grid = F.round(F.col("frame_time") * 10).cast("long")
    a = reference.select("pair_id", grid.alias("g"), F.col("frame_time").alias("t"), F.col("embedding").alias("a_"))
    b = target.select("pair_id", grid.alias("g"), F.col("embedding").alias("b_"))
    value = S.cosine(F.col("a_"), F.col("b_")) if metric == "cosine" else S.mean_abs_difference(F.col("a_"), F.col("b_"))
    return a.join(b, ["pair_id", "g"]).select("pair_id", "t", value.alias("value"))


def best_offset(reference: DataFrame, target: DataFrame, reach: float = 3.0) -> DataFrame:
    """For each reference frame (pair_id, frame_time, embedding) the target frame within reach that is most similar."""
    a = reference.select("pair_id", F.col("frame_time").alias("t_ref"), F.col("embedding").alias("a_"))
    b = target.select("pair_id", F.col("frame_time").alias("t_tgt"), F.col("embedding").alias("b_"))
    met = bucketed_range_join(a, b, F.col("t_ref") - reach, F.col("t_ref") + reach, "t_tgt", max(reach, 0.5), ("pair_id",))
    met = met.withColumn("sim", F.round(S.cosine(F.col("a_"), F.col("b_")), 12)).withColumn("offset", F.col("t_tgt") - F.col("t_ref"))
    best = met.groupBy("pair_id", "t_ref").agg(F.max_by(F.struct("offset", "sim"), F.struct("sim", -F.abs("offset"), -F.col("offset"))).alias("b"))
    return best.select("pair_id", "t_ref", "b.offset", "b.sim")


def check_expected_delay(dips: DataFrame, estimates: DataFrame, tolerance: float = 1.5, reach: float = 1.0) -> DataFrame:
    """estimates: video_id, t_est, expected. Each with the dip whose centre is nearest within reach, and whether the dip
    is about as long as expected."""
    met = bucketed_range_join(estimates, dips.select("video_id", "center", F.col("duration").alias("dip_duration")), F.col("t_est") - reach, F.col("t_est") + reach, "center", max(reach, 0.5))
    best = met.groupBy("video_id", "t_est").agg(F.min(F.struct(F.abs(F.col("center") - F.col("t_est")).alias("gap"), "center", "dip_duration")).alias("b"))
    rows = estimates.join(best, ["video_id", "t_est"], "left")
    tag = F.when(F.col("b").isNull(), "NO_DIP").when(F.abs(F.col("b.dip_duration") - F.col("expected")) <= tolerance, "OK").otherwise("CHECK")
    return rows.select("video_id", "t_est", "expected", F.col("b.center").alias("center"), F.col("b.dip_duration").alias("dip_duration"), tag.alias("tag"))


def rebase_timeline(events: DataFrame, delays: DataFrame) -> DataFrame:
    """events: video_id, event_id, t; delays: video_id, t_delay, delay. Time in the baseline: less all delays injected
    before. One running sum over the union of both, in which an event stands before the delays of its time."""
    e = events.select("video_id", F.col("t").alias("at"), F.lit(None).cast("double").alias("d"), F.col("event_id"), F.lit(0).alias("late_"))
    d = delays.select("video_id", F.col("t_delay").alias("at"), F.col("delay").cast("double").alias("d"), F.lit(None).cast(events.schema["event_id"].dataType).alias("event_id"), F.lit(1).alias("late_"))
    rows = scan(e.unionByName(d), F.floor(F.col("at") / SECONDS), [F.col("at"), F.col("late_")], sum_=sum_before(F.col("d")))
    return rows.where("late_ = 0").select("video_id", "event_id", F.col("at").alias("t"), (F.col("at") - F.col("sum_")).alias("t_base"))
