"""Streams give the rows of the batch operators."""

import tempfile
import uuid

import pytest
from pyspark.sql import functions as F

from synchrony.operators import scoring, series
from synchrony.sources import fixtures
from synchrony.streaming import jobs

FOLDER = "/root/testdata/sf0.001"


def replay(spark, df, order, parts, build, mode="append"):
    """Feeds a table to a stream in order, a few files at a time, and returns the rows of its sink."""
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows = df.withColumn("part_", F.ntile(parts).over(__import__("pyspark").sql.Window.orderBy(order))).cache()
    schema = df.schema
    for i in range(1, parts + 1):
        rows.where(F.col("part_") == i).drop("part_").coalesce(1).write.mode("append").parquet(f"{path}/{i:03d}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    name = f"s{uuid.uuid4().hex[:8]}"
    with jobs.with_state_store(spark):
        q = build(stream).writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).collect()


@pytest.fixture(scope="module")
def frames(spark):
    s = fixtures.view(spark, FOLDER, "fx_series").where("video_id in ('u1', 'u2', 'u3')")
    return s.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t"))).select("video_id", "frame_idx", "t", "mad", "ts")


def test_freeze_runs(spark, frames):
    # one late row of another recording moves the watermark on, so that open runs close
    end = spark.createDataFrame([("end", 0, 0.0, 9.0)], "video_id string, frame_idx int, t double, mad double").withColumn("ts", F.timestamp_seconds(F.lit(1_700_100_000)))
    got = replay(spark, frames.unionByName(end), "ts", 6, jobs.stream_freeze_runs)
    want = series.freeze_runs(frames).select("video_id", "start_frame", "end_frame").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_late_and_idle_recordings(spark):
    """v is idle twice and late once; w goes on before its timer, which then counts from its last frame."""
    arrivals = [
        [("v", i, 0.1, 0.5 * i) for i in range(5)] + [("w", 1, 0.1, 1.0), ("w", 2, 0.1, 1.0)],
        [("w", 3, 0.1, 25.0), ("w", 4, 0.1, 25.0)],
        [("other", 0, 9.0, 50.0)],
        [("other", 1, 9.0, 51.0)],  # the watermark is at 40: v is idle since 2, w since 25
        [("w", 5, 0.1, 42.0)],
        [("other", 2, 9.0, 100.0)],
        [("other", 3, 9.0, 101.0)],
        [("v", 5, 0.1, 2.5)],  # late: dropped
        [("v", 300, 0.1, 150.0)],
        [("other", 4, 9.0, 1000.0)],
        [("other", 5, 9.0, 1001.0)],
    ]
    rows = [(v, i, mad, t, k) for k, part in enumerate(arrivals) for v, i, mad, t in part]
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, mad double, t double, k int").withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("t")))
    for k in range(len(arrivals)):
        df.where(F.col("k") == k).drop("k").coalesce(1).write.parquet(f"{path}/{k:03d}")
    stream = spark.readStream.schema(df.drop("k").schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    with jobs.with_state_store(spark):
        q = jobs.stream_freeze_runs(stream).writeStream.outputMode("append").format("memory").queryName("late_idle").option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted(map(tuple, spark.table("late_idle").collect())) == [("v", 0, 4), ("v", 299, 300), ("w", 0, 5)]
    assert spark.conf.get(jobs.PROVIDER) != jobs.ROCKS


def test_transitions(spark, frames):
    got = replay(spark, frames, "ts", 4, jobs.stream_transitions)
    want = series.transitions(frames, 0.5).select("video_id", "frame_idx", "t", "event").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_keyword_score(spark):
    align = fixtures.view(spark, FOLDER, "fx_align").where("video_id in ('v0', 'v1')")
    imp = fixtures.view(spark, FOLDER, "fx_importance").cache()
    got = {r.video_id: r for r in replay(spark, align, "t_narr", 3, lambda s: jobs.stream_keyword_score(s, imp), "complete")}
    want = {r.video_id: r for r in scoring.overall_score(scoring.scored(align, imp)).collect()}
    assert {v: r.n_matched for v, r in got.items()} == {v: r.n_matched for v, r in want.items()}
    for v in want:
        assert got[v].overall_score == pytest.approx(want[v].overall_score)


def test_rater_progress_drops_repeated_posts(spark):
    post = '{"rater": "a", "video": "x", "moments": []}'
    rows = spark.createDataFrame([(post, 10), (post, 11), ('{"rater": "b", "video": "x"}', 12)], "json string, s long").select("json", F.timestamp_seconds("s").alias("ts"))
    got = replay(spark, rows, "ts", 2, jobs.stream_rater_progress, "update")
    assert sorted({(r.rater, r.video) for r in got}) == [("a", "x"), ("b", "x")]


def test_word_rate(spark):
    rows = spark.range(100).select(F.lit("v").alias("video_id"), F.timestamp_seconds(F.col("id")).alias("ts"))
    got = replay(spark, rows, "ts", 5, jobs.stream_word_rate)
    assert got and all(r.n == 10 and r.rate == 1.0 for r in got)
