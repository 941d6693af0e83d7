"""Structured Streaming versions of series and rating operators; the batch operators give the same rows."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import scores as S
from ..operators.scoring import score_keywords
from ..operators.study import SUBMISSION

RUN = "video_id string, start_frame int, end_frame int"


class FreezeRuns(StatefulProcessor):
    """State per recording: first and last frame of the open run, and the timer that closes it. A timer that has been put
    off stays registered until the one in the state is told apart from it, so an old one is deleted when a new one is set."""

    def __init__(self, threshold: float, least: int, idle_ms: int):
        self.threshold, self.least, self.idle_ms = threshold, least, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "start int, end int, timer long")

    def rows(self, key, runs) -> pd.DataFrame:
        good = [(key[0], a, b) for a, b in runs if b - a + 1 >= self.least]
        return pd.DataFrame(good, columns=["video_id", "start_frame", "end_frame"])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        start, end, timer = self.open.get() if self.open.exists() else (-1, -1, -1)
        data = pd.concat(list(rows)).sort_values("frame_idx")
        done = []
        for i, mad in zip(data["frame_idx"].astype(int), data["mad"]):
            low = i > 0 and mad < self.threshold
            if start >= 0 and (not low or i != end + 1):
                done.append((start, end))
                start, end = -1, -1
            if low:
                start, end = (i - 1 if start < 0 else start), i
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = max(int(data["ts"].max().timestamp() * 1000), timerValues.getCurrentWatermarkInMs()) + self.idle_ms
        self.handle.registerTimer(timer)
        self.open.update((start, end, timer))
        yield self.rows(key, done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        start, end, _ = self.open.get() if self.open.exists() else (-1, -1, -1)
        self.open.clear()
        yield self.rows(key, [(start, end)] if start >= 0 else [])

    def close(self) -> None:
        pass


def stream_freeze_runs(frames: DataFrame, threshold: float = 0.5, shortest: float = 0.5, fps: float = 2.0, idle: str = "30 seconds", delay: str = "10 seconds") -> DataFrame:
    """frames: video_id, frame_idx, mad, ts. A run closes when the series goes on without it, or by a timer when its
    recording is idle past the watermark. Frames of one recording come in order up to the watermark; later ones are
    dropped. The query needs the RocksDB state store (``with_state_store``)."""
    processor = FreezeRuns(threshold, int(shortest * fps), int(pd.Timedelta(idle).total_seconds() * 1000))
    grouped = frames.withWatermark("ts", delay).groupBy("video_id")
    return grouped.transformWithStateInPandas(processor, RUN, "append", "eventTime")


class Transitions(StatefulProcessor):
    """State per recording: whether the last sample matched."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.low = handle.getValueState("low", "low boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (low,) = self.low.get() if self.low.exists() else (True,)
        out = []
        for r in pd.concat(list(rows)).sort_values("frame_idx").itertuples():
            now = bool(r.mad < self.threshold)
            if now != low:
                out.append((key[0], int(r.frame_idx), float(r.t), "resync" if now else "diverge"))
            low = now
        self.low.update((low,))
        yield pd.DataFrame(out, columns=["video_id", "frame_idx", "t", "event"])

    def close(self) -> None:
        pass


def stream_transitions(frames: DataFrame, threshold: float = 0.5, delay: str = "10 seconds") -> DataFrame:
    """frames: video_id, frame_idx, t, mad, ts -> diverge and resync events. The query needs the RocksDB state store."""
    grouped = frames.withWatermark("ts", delay).groupBy("video_id")
    return grouped.transformWithStateInPandas(Transitions(threshold), "video_id string, frame_idx int, t double, event string", "append", "eventTime")


#: The state store that processors with timers and named state need.
PROVIDER, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def with_state_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside use the RocksDB state store; the session's setting comes back."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def stream_rater_progress(posts: DataFrame, delay: str = "1 hour") -> DataFrame:
    """posts: json, ts (arrival). Forms posted again are dropped inside the watermark; then the first time per rater and
    video, in update mode."""
    rows = posts.withColumn("p", F.from_json("json", SUBMISSION)).select("ts", "json", F.col("p.rater").alias("rater"), F.col("p.video").alias("video"))
    once = rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["json"])
    return once.groupBy("rater", "video").agg(F.min("ts").alias("first_ts"))


def stream_keyword_score(align: DataFrame, importance: DataFrame) -> DataFrame:
    """Running overall score of each recording, from a stream of aligned keywords and a static table of ratings."""
    scored = score_keywords(align).where("match_case <> 'F'")
    rows = scored.join(importance.select("video_id", "segment_id", "importance", "backend"), ["video_id", "segment_id"], "left")
    w = F.coalesce("alpha", F.lit(1.0)) * S.weight(F.coalesce("importance", F.lit(3)), F.col("backend"))
    s = F.coalesce("S_temporal", F.lit(0.0))
    return rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_matched"), F.try_divide(F.sum(s * w), F.sum(w)).alias("overall_score"))


def stream_word_rate(words: DataFrame, width: str = "10 seconds", delay: str = "30 seconds") -> DataFrame:
    """words: video_id, ts -> words per second in tumbling windows."""
    seconds = pd.Timedelta(width).total_seconds()
    per = words.withWatermark("ts", delay).groupBy("video_id", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return per.select("video_id", F.col("w.start").alias("start"), "n", (F.col("n") / seconds).alias("rate"))
