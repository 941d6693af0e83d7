"""Joins in time: points in intervals, nearest neighbours, overlaps. All are equi-joins on the recording and a bucket of
time, so no nested loop is planned and one long recording is spread over its buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import large, settled
from .scans import SECONDS, following, previous, scan


def bucket_of(t: Column, width: float) -> Column:
    return F.floor(t / width).cast("long")


def buckets(low: Column, high: Column, width: float) -> Column:
    """All buckets that an interval touches; null or reversed intervals touch none."""
    return F.when(low <= high, F.sequence(bucket_of(low, width), bucket_of(high, width)))


def bucketed_range_join(intervals: DataFrame, points: DataFrame, low: Column | str, high: Column | str, point: str, width: float = 8.0, keys: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """Pairs of an interval and a point inside it (both ends closed). The point's columns must differ from the
    interval's but for the keys; each point lies in one bucket, so no pair comes twice."""
    lo, hi = (F.col(x) if isinstance(x, str) else x for x in (low, high))
    left = intervals.withColumn("lo_", lo).withColumn("hi_", hi).withColumn("bucket_", F.explode(buckets(F.col("lo_"), F.col("hi_"), width)))
    right = points.withColumn("bucket_", bucket_of(F.col(point), width))
    return left.join(large(right), [*keys, "bucket_"]).where(F.col(point).between(F.col("lo_"), F.col("hi_"))).drop("lo_", "hi_", "bucket_")


def words_in_interval(words: DataFrame, segments: DataFrame, tolerance: float, width: float = 8.0) -> DataFrame:
    """words: video_id, word_id, word, t; segments: video_id, segment_id, start_time, end_time."""
    return bucketed_range_join(segments, words, F.col("start_time") - tolerance, F.col("end_time") + tolerance, "t", width)


def frames_in_scene(scenes: DataFrame, frames: DataFrame, width: float = 8.0) -> DataFrame:
    """A frame on a shared boundary belongs to both scenes."""
    return bucketed_range_join(scenes, frames, "t_start", "t_end", "frame_time", width)


def scene_at(points: DataFrame, scenes: DataFrame, point: str, id_column: str, width: float = 8.0) -> DataFrame:
    """The scene of each point: the first that contains it, else the one with the nearest midpoint (of equal ones the
    first). A point meets one row, which holds the scenes of its bucket of time, so points are neither multiplied nor
    grouped; those outside all scenes meet the two midpoints next to them only."""
    s = scenes.select("video_id", F.struct("scene_id", F.col("t_start").alias("scene_t_start"), F.col("t_end").alias("scene_t_end")).alias("s"))
    start, end, t = F.col("s.scene_t_start"), F.col("s.scene_t_end"), F.col(point).cast("double")
    spans = s.withColumn("bucket_", F.explode(buckets(start, end, width))).groupBy("video_id", "bucket_").agg(F.collect_list("s").alias("spans_"))
    met = points.withColumn("bucket_", bucket_of(t, width)).join(large(spans), ["video_id", "bucket_"], "left")
    here = F.array_min(F.filter("spans_", lambda x: t.between(x["scene_t_start"], x["scene_t_end"])))
    found = settled(met.select(*points.columns, here.alias("s_")), "points-in-scenes")
    outside = found.where("s_ is null").drop("s_")
    mids = s.select("video_id", ((start + end) / 2).alias("t_"), "s")
    outside = outside.withColumn("t_", t)
    near = nearest_middle(outside.select("video_id", "t_"), mids)
    rest = outside.join(large(near.withColumnRenamed("s", "s_")), ["video_id", "t_"], "left").select(*points.columns, "s_")
    return found.where("s_ is not null").unionByName(rest).select(*points.columns, "s_.*")


def nearest_middle(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points: video_id, t_; spans: video_id, t_ (middle), s -> video_id, t_, s of the nearest middle, the smaller s on a
    tie, once for each time that a recording's points have. The two neighbours in time order are found by a scan over the
    union of those times and the middles, so no point meets all spans and points of one time count once."""
    one = spans.where("t_ is not null").groupBy("video_id", "t_").agg(F.min("s").alias("s"))
    a = points.where("t_ is not null").select("video_id", "t_").distinct().select("video_id", "t_", F.lit(True).alias("asked_"), F.lit(None).cast(one.select(F.struct("t_", "s")).schema[0].dataType).alias("m_"))
    b = one.select("video_id", "t_", F.lit(False).alias("asked_"), F.struct("t_", "s").alias("m_"))
    u = scan(a.unionByName(b), F.floor(F.col("t_") / SECONDS), [F.col("t_"), F.col("asked_")], prev_=previous(F.col("m_"), current=True), next_=following(F.col("m_"), current=True))
    u = u.where("asked_")
    gap = lambda c: F.abs(F.col(f"{c}.t_") - F.col("t_"))
    take_prev = F.col("next_").isNull() | (F.col("prev_").isNotNull() & ((gap("prev_") < gap("next_")) | ((gap("prev_") == gap("next_")) & (F.col("prev_.s") < F.col("next_.s")))))
    return u.select("video_id", "t_", F.when(take_prev, F.col("prev_.s")).otherwise(F.col("next_.s")).alias("s")).where("s is not null")


def nearest_frame(points: DataFrame, frames: DataFrame, point: str, id_column: str, tolerance: float) -> DataFrame:
    """The frame nearest in time within the tolerance, the earlier one on a tie. Frames: video_id, frame_time."""
    reach = bucketed_range_join(points.select("video_id", id_column, point), frames.select("video_id", "frame_time").distinct(), F.col(point) - tolerance, F.col(point) + tolerance, "frame_time", max(tolerance, 0.5))
    best = reach.groupBy("video_id", id_column).agg(F.min(F.struct(F.abs(F.col("frame_time") - F.col(point)).alias("gap"), "frame_time")).alias("f"))
    return points.join(large(best), ["video_id", id_column], "left").select(*points.columns, F.col("f.frame_time").alias("frame_time"))


def nearest_segment(points: DataFrame, segments: DataFrame, point: str, id_column: str) -> DataFrame:
    """The segment with the nearest middle, the smaller segment_id on a tie."""
    p = points.withColumn("t_", F.col(point).cast("double"))
    middles = segments.select("video_id", ((F.col("start_time") + F.col("end_time")) / 2).alias("t_"), F.col("segment_id").cast("long").alias("s"))
    near = nearest_middle(p, middles).withColumnRenamed("s", "segment_id")
    return p.join(large(near), ["video_id", "t_"], "left").select(*points.columns, "segment_id")


def overlapping(a: DataFrame, b: DataFrame, a_span: tuple[str, str], b_span: tuple[str, str], how: str = "inner", width: float = 8.0) -> DataFrame:
    """Pairs of intervals that share more than a point. Each pair is kept in the bucket of the later start only."""
    left = a.withColumn("bucket_", F.explode(buckets(F.col(a_span[0]), F.col(a_span[1]), width)))
    right = b.withColumn("bucket_", F.explode(buckets(F.col(b_span[0]), F.col(b_span[1]), width)))
    meet = (F.col(a_span[0]) < F.col(b_span[1])) & (F.col(a_span[1]) > F.col(b_span[0]))
    pairs = left.join(large(right), ["video_id", "bucket_"]).where(meet & (F.col("bucket_") == bucket_of(F.greatest(a_span[0], b_span[0]), width))).drop("bucket_")
    if how == "inner":
        return pairs
    return pairs.select(*a.columns).distinct()


def lookup_first(left: DataFrame, lookup: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """Left join on a table whose first row per key (by the order) wins."""
    one = lookup.groupBy(*keys).agg(F.min_by(value, order).alias(value))
    return left.join(one, keys, "left")


def without_partner(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.join(large(b.select(*keys)), keys, "left_anti")
