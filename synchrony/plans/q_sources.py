"""Reading and writing: tables are written to the shared folder and read back by the library's own readers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import fixtures, tables
from ..sources.shared import shared_dir
from .q_streams import Stream
from .registry import REGISTRY

SEGMENTS = "SELECT video_id, segment_id, text, start_time, end_time, CAST(n_words AS INT) AS n_words FROM fx_segments"
COUNTS = "SELECT video_id, count(*) AS n_keywords, count(*) FILTER (match_case <> 'F') AS n_matched, count(DISTINCT segment_id) AS n_segments FROM fx_align GROUP BY 1"


def place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}/{name}"


def read_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file holds many recordings, as those of words do."""
    path = place(spark, "segments")
    fixtures.view(spark, sf_dir, "fx_segments").write.option("header", True).option("escape", '"').csv(path)
    return tables.read_table(spark, "segments", path)


def write_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over one dataset; the second finds every recording done and changes nothing."""
    path = place(spark, "segments.parquet")
    segments = fixtures.view(spark, sf_dir, "fx_segments")
    tables.write_stage(segments, path)
    tables.write_stage(segments.withColumn("text", F.lit("again")), path, skip_done=True)
    return tables.read_table(spark, "segments", path)


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = fixtures.view(spark, sf_dir, "fx_align").groupBy("video_id").agg(F.count(F.lit(1)).alias("n_keywords"), F.count_if(F.col("match_case") != "F").alias("n_matched"), F.count_distinct("segment_id").alias("n_segments"))
    return tables.results_json(per, {"counts": ["n_keywords", "n_matched"], "coverage": ["n_segments"]})


def read_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "results")
    results(spark, sf_dir).write.partitionBy("video_id").text(path)
    return tables.read_results(spark, path, r"video_id=([^/]+)/[^/]+$").select("video_id", "counts.n_keywords", "counts.n_matched", "coverage.n_segments")


def read_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times that are missing stand as NaN in the files. A file holds many recordings, named by a column: a file of its own for
    each costs its opening and its listing, whatever it holds."""
    path = place(spark, "words")
    words = fixtures.view(spark, sf_dir, "fx_words").select("video_id", "word_id", "word", *[F.coalesce(F.col(c).cast("string"), F.lit("NaN")).alias(c) for c in ("start_time", "end_time")])
    words.write.option("header", True).option("escape", '"').csv(path)
    return tables.read_table(spark, "words", path).select("video_id", "word_id", "word", "start_time", "end_time", F.col("timestamp_reliable").isNull().alias("no_flag"))


def read_scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets stand as text in the files: words apart by spaces, concepts by bars; some columns are missing. A file holds many
    recordings, as those of words do."""
    path = place(spark, "scenes")
    concepts = fixtures.view(spark, sf_dir, "fx_concepts").groupBy("video_id", "scene_id").agg(F.array_sort(F.collect_list("concept")).alias("c"))
    rows = fixtures.view(spark, sf_dir, "fx_scenes").join(concepts, ["video_id", "scene_id"], "left")
    rows = rows.select("video_id", "scene_id", "t_start", "t_end", "t_keyframe", F.coalesce(F.array_join("c", " "), F.lit("nan")).alias("ocr_words"), F.coalesce(F.array_join("c", "|"), F.lit("nan")).alias("gemini_concepts"))
    rows.write.option("header", True).csv(path)
    out = tables.read_table(spark, "scenes", path)
    return out.select("video_id", "scene_id", "t_start", "t_end", "t_keyframe", "n_frames", *[F.array_join(F.array_sort(c), " ").alias(c) for c in ("ocr_words", "gemini_concepts")])


REGISTRY["s1_read_words"] = Stream(read_words, "SELECT video_id, word_id, word, start_time, end_time, TRUE AS no_flag FROM fx_words", "start_time end_time")
REGISTRY["s1_read_scenes"] = Stream(
    read_scenes,
    "WITH c AS (SELECT video_id, scene_id, string_agg(DISTINCT concept, ' ' ORDER BY concept) AS w FROM fx_concepts GROUP BY 1, 2) SELECT s.video_id, s.scene_id, s.t_start, s.t_end, s.t_keyframe, CAST(NULL AS INT) AS n_frames, coalesce(w, '') AS ocr_words, coalesce(w, '') AS gemini_concepts FROM fx_scenes s LEFT JOIN c USING (video_id, scene_id)",
    "t_start t_end t_keyframe",
)
REGISTRY["s1_read_table"] = Stream(read_csv, SEGMENTS, "start_time end_time")
REGISTRY["s2_read_results"] = Stream(read_results, COUNTS)
REGISTRY["s3_write_stage"] = Stream(write_stage, SEGMENTS, "start_time end_time")
REGISTRY["s4_results_json"] = Stream(results, f"WITH c AS ({COUNTS}) SELECT video_id, CAST(to_json({{'video_id': video_id, 'counts': {{'n_keywords': n_keywords, 'n_matched': n_matched}}, 'coverage': {{'n_segments': n_segments}}}}) AS VARCHAR) AS json FROM c")
