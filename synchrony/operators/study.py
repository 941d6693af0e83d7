"""The rating study: viewing windows, manifest checks, balanced sessions, submissions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import large
from ..sources.tables import NON_CONTENT

# Seconds before and after the word, by set; injected delays; label lists of frames.
WINDOWS = {"manipulated": (5.0, 7.0), "fresh": (5.0, 10.0)}
DELAYS = (0.0, 1.5, 5.0)
SESSIONS = 3
CONTENT_LABELS = ["content slide", "diagram", "code editor", "whiteboard", "animation frame", "demonstration"]
NON_CONTENT_LABELS = ["title slide", "logo screen", "blank screen", "loading screen", "transition effect", "section divider", "talking head with no visual aids"]


def viewing_window(moments: DataFrame) -> DataFrame:
    """moments: t_narr, set, override_start, override_end. + window_start, window_end, error for an unknown set."""
    def edge(k: int, sign: int) -> Column:
        out = F.lit(None).cast("double")
        for name, w in WINDOWS.items():
            out = F.when(F.col("set") == name, F.col("t_narr") + sign * w[k]).otherwise(out)
        return out

    start = F.coalesce("override_start", F.greatest(edge(0, -1), F.when(edge(0, -1).isNotNull(), F.lit(0.0))))
    end = F.coalesce("override_end", edge(1, 1))
    return moments.withColumns({"window_start": start, "window_end": end, "error": F.when(start.isNull() | end.isNull(), "unknown set")})


def study_validation(videos: DataFrame, moments: DataFrame) -> DataFrame:
    """issue, id: recordings without moments, unknown sets, placeholders."""
    empty = videos.join(moments.select("video_id").distinct(), "video_id", "left_anti").select(F.lit("no_moments").alias("issue"), F.col("video_id").alias("id"))
    sets = videos.where(~F.col("set").isin(*WINDOWS)).select(F.lit("unknown_set").alias("issue"), F.col("video_id").alias("id"))
    todo = videos.where(F.upper("external_id").rlike("TODO|PLACEHOLDER|XXX")).select(F.lit("placeholder").alias("issue"), F.col("video_id").alias("id"))
    return empty.unionByName(sets).unionByName(todo)


def content_flag(scenes: DataFrame, least: float = 0.55) -> DataFrame:
    """scenes: label, confidence, ocr_text. + is_content, frame_type: a content label makes a scene content, a label that is
    not sure does too and is marked, any text on screen does; a description that is the mark of no content, where the
    table has one, makes it none unless there is text."""
    unsure = F.col("confidence") < least
    shown = F.coalesce(F.length(F.trim("ocr_text")) > 0, F.lit(False))
    marked = F.coalesce(F.upper(F.trim("concept_text")) == NON_CONTENT, F.lit(False)) if "concept_text" in scenes.columns else F.lit(False)
    flag = F.when(shown, True).when(marked, False).otherwise(F.coalesce(unsure, F.lit(False)) | F.coalesce(F.col("label").isin(CONTENT_LABELS), F.lit(True)))
    return scenes.withColumns({"is_content": flag, "frame_type": F.when(unsure, F.concat("label", F.lit(" (low_conf)"))).otherwise(F.col("label"))})


#: Parts that raters are dealt into.
PARTS = 64


def assign_sessions(videos: DataFrame, raters: DataFrame, seed: int = 1) -> DataFrame:
    """videos: video_id, set, topic, delay. Every rater sees each topic once per session, each session has every delay
    equally often; fresh videos are spread evenly. Orders come from a hash of seed, rater and id, so reruns agree and no
    rater's plan depends on another's. Labels say nothing about the video. The plan itself holds every rater with every topic
    and fresh video, so nothing of it is shuffled or sorted on disk: raters are dealt into parts, each part gets one row with
    the lists of topics and fresh videos, and a rater's plan is made from that row, one rater at a time in memory."""
    hashed = lambda *cols: F.md5(F.concat_ws("|", F.lit(str(seed)), "rater", *[c.cast("string") for c in cols]).cast("binary"))
    n = len(DELAYS)
    shown = F.array_position(F.array(*map(F.lit, DELAYS)), F.col("delay")).cast("int") - 1
    of_topic = F.collect_list(F.when(F.col("topic").isNotNull() & (shown >= 0), F.struct(shown.alias("delay"), "video_id")))
    topics = videos.where("set = 'manipulated'").groupBy("topic").agg(of_topic.alias("videos")).agg(F.collect_list(F.struct("topic", "videos")).alias("topics"))
    fresh = videos.where("set = 'fresh'").agg(F.collect_list(F.struct("video_id")).alias("fresh"))
    part = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
    lists = topics.withColumn("k_", part).join(large(fresh.withColumn("k_", part)), "k_").repartition(PARTS, "k_")
    dealt = raters.select("rater").distinct().withColumn("k_", F.pmod(F.xxhash64("rater"), F.lit(PARTS)).cast("int")).repartition(PARTS, "k_")
    share = F.greatest(F.floor(F.size("topics") / n), F.lit(1))
    by_topic = F.sort_array(F.transform("topics", lambda x: F.struct(hashed(x["topic"]).alias("h"), x["topic"].alias("topic"), x["videos"].alias("videos"))))
    # a video is seen in the session in which its topic has its delay
    place = lambda x, session: F.struct(session.cast("int").alias("session"), hashed(x["video_id"], session.cast("int")).alias("h"), x["video_id"].alias("video_id"))
    first = F.flatten(F.transform(by_topic, lambda x, i: F.transform(x["videos"], lambda v: place(v, F.pmod(v["delay"] - F.floor(i / share), F.lit(n))))))
    by_video = F.sort_array(F.transform("fresh", lambda x: F.struct(hashed(x["video_id"]).alias("h"), x["video_id"].alias("video_id"))))
    start = F.conv(F.substring(hashed(), 1, 8), 16, 10).cast("long") % SESSIONS
    second = F.transform(by_video, lambda x, i: place(x, (i + start) % SESSIONS))
    rows = dealt.join(large(lists), "k_").select("rater", F.posexplode(F.sort_array(F.concat(first, second))).alias("position", "v"))
    return rows.select("rater", "v.session", "v.video_id", (F.col("position") + 1).alias("position")).withColumn("label", F.format_string("Video_R%02d", F.col("position")))


SUBMISSION = "struct<rater:string,session:int,video:string,label:string,order:int,timestamp_utc:string,moments:array<struct<id:string,rating:int,confidence:int,principles:string,comment:string>>>"


def explode_submission(posts: DataFrame) -> DataFrame:
    """One row per rated moment of each posted form (column json); forms without moments keep one row."""
    rows = posts.withColumn("p", F.from_json("json", SUBMISSION)).select("p.*", F.explode_outer("p.moments").alias("m"))
    return rows.select("rater", "session", "video", "label", "order", F.col("timestamp_utc").try_cast("timestamp").alias("ts"), F.col("m.id").alias("moment"), F.col("m.rating").alias("rating"), F.col("m.confidence").alias("confidence"), F.coalesce("m.principles", F.lit("")).alias("principles"))


def rater_progress(rows: DataFrame) -> DataFrame:
    return rows.groupBy("rater", "video").agg(F.min("ts").alias("first_ts"))
