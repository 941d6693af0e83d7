"""Streams over the tables, run to their end: each query replays a table as a file stream and returns its sink."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures
from ..sources.shared import shared_dir
from ..streaming import jobs
from .q_scoring import OVERALL
from .q_series import RUNS, TR
from .registry import REGISTRY, Query


def stream_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over all that is there and reads its sink: files in the shared folder, written batch by batch."""
    spark, path = stream.sparkSession, stream_dir(stream.sparkSession)
    write = "overwrite" if mode == "complete" else "append"

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode(write).parquet(f"{path}/out")

    with jobs.with_state_store(spark):
        q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    """A table as a stream, be it a file or a folder: a pattern as path takes both."""
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{folder}/[{name[0]}]{name[1:]}")


class Stream(Query):
    """A query that needs the session and the folder, not fixture frames."""

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        out = self.build(spark, sf_dir)
        return out.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) if kind == "double" else F.col(c) for c, kind in out.dtypes])


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference series as a stream of files, with an event time."""
    path = stream_dir(spark)
    s = fixtures.view(spark, sf_dir, "fx_series").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).select("video_id", "frame_idx", "t", "mad", "ts")
    s.write.parquet(path)
    return stream_of(spark, path)


def keyword_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    align = fixtures.over(spark, "fx_align", {"lineitem": stream_of(spark, f"{sf_dir}/lineitem.parquet")})
    return drained(jobs.stream_keyword_score(align, fixtures.view(spark, sf_dir, "fx_importance")), "complete")


def word_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = stream_of(spark, f"{sf_dir}/events.parquet").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("video_id"), F.col("ts").cast("timestamp").alias("ts"))
    out = drained(jobs.stream_word_rate(events, "1 day", "1 day"), "append")
    return out.select("video_id", F.col("start").cast("timestamp_ntz").alias("start"), "n", F.col("rate"))


def rater_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rating as a posted form, each posted again a minute later."""
    path = stream_dir(spark)
    r = fixtures.view(spark, sf_dir, "fx_ratings").withColumn("ts", F.col("ts").cast("timestamp"))
    posts = r.select(F.to_json(F.struct("rater", F.col("item").alias("video"))).alias("json"), F.explode(F.array("ts", F.col("ts") + F.expr("INTERVAL 1 MINUTE"))).alias("ts"))
    posts.write.parquet(path)
    out = drained(jobs.stream_rater_progress(stream_of(spark, path)), "update")
    return out.groupBy("rater", "video").agg(F.min("first_ts").cast("timestamp_ntz").alias("first_ts"))


REGISTRY["r3_stream_rater_progress"] = Stream(rater_progress, "SELECT rater, item AS video, CAST(min(ts) AS TIMESTAMP) AS first_ts FROM fx_ratings GROUP BY 1, 2")
#: A run that is still open at the end of the stream comes out only once its recording has been idle past the watermark.
REGISTRY["r1_stream_freeze_runs"] = Stream(
    lambda spark, d: drained(jobs.stream_freeze_runs(frames(spark, d)), "append"),
    f"WITH {RUNS}, ls AS (SELECT video_id, max(frame_idx) AS last_frame, max(t) AS last_t, (SELECT max(t) FROM fx_series) AS end_t FROM fx_series GROUP BY 1) SELECT video_id, start_frame, end_frame FROM rn JOIN ls USING (video_id) WHERE end_frame < last_frame OR last_t + 30 < end_t - 10",
)
REGISTRY["r2_stream_transitions"] = Stream(lambda spark, d: drained(jobs.stream_transitions(frames(spark, d)), "append"), f"WITH {TR} SELECT video_id, frame_idx, t, event FROM tr WHERE event IS NOT NULL", "t")
REGISTRY["r4_stream_keyword_score"] = Stream(keyword_score, OVERALL + "SELECT video_id, n_matched, overall_score FROM o", "overall_score")
REGISTRY["r5_stream_word_rate"] = Stream(
    word_rate,
    "WITH w AS (SELECT 'u' || user_id AS video_id, date_trunc('day', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2) SELECT video_id, CAST(start AS TIMESTAMP) AS start, n, n/86400 AS rate FROM w WHERE start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 DAY",
    "rate",
)
