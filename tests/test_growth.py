"""Work that has to stay in proportion to the input: a text is searched, parsed and lowered once."""

import re

import pytest
from pyspark.sql import functions as F

from synchrony.functions import tokens as K
from synchrony.operators import text as T
from synchrony.operators import timejoin as J
from synchrony.plans import registry
from synchrony.sources import tables

FOLDER = "/root/testdata/sf0.001"
TEXTS = ["", " ", "As you can see, it rains", "nothing", "here we see", "here you can see it", "looking at it", "lookingat", "In the Diagrams", "in this diagram.", "basis you can seek", "use", "Musée", "xverifyx", "the formula says", "İ look at", None]


def column(spark, texts, value):
    rows = spark.createDataFrame(list(enumerate(texts)), "n int, text string")
    return [r[0] for r in rows.orderBy("n").select(value.alias("v")).collect()]


def plan(name, spark):
    return registry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()


def test_verbs_and_discourse_are_those_of_the_patterns(spark):
    verb, said = T.instructional_verb_score(F.col("text")), T.discourse_signal_score(F.col("text"))
    for score, patterns, value in ((verb, T.INSTRUCTIONAL_VERBS, 0.5), (said, T.DISCOURSE_PATTERNS, 1.0)):
        assert column(spark, TEXTS, score) == column(spark, TEXTS, F.when(F.lower("text").rlike("|".join(patterns)), value).otherwise(0.0))


def test_spelled_out_texts_are_found_by_their_pattern():
    assert T.spelled_out(r"\blook(?:ing)? at\b") == ["looking at", "look at"]
    assert all(re.search(p.lower(), x.lower()) for p in T.DISCOURSE_PATTERNS for x in T.spelled_out(p))


def test_no_pattern_of_all_verbs(spark):
    assert "|".join(T.INSTRUCTIONAL_VERBS[:2]) not in plan("t13_t14_verb_and_discourse", spark)


@pytest.mark.parametrize("marks", [tables.SPACES, tables.BULLETS, "\"'.: -"])
def test_strip_is_that_of_the_pattern(spark, marks):
    texts = [None, "", "a", " a b ", "　a ", "\x1c\x85a\xa0​", "--a-b--", "•*x'", "\"'.: -", " \n\t ", "é  ", "*•" * 9]
    inside = tables.SPACE if marks == tables.SPACES else marks
    assert column(spark, texts, tables.strip(F.col("text"), marks)) == column(spark, texts, F.regexp_replace("text", rf"\A[{inside}]+|[{inside}]+\z", ""))


def test_a_list_is_parsed_once(spark):
    assert plan("s8_parse_concepts", spark).count("from_json") == 1
    assert column(spark, ['x ["A ", "b"] y', "[1]", "[] []", "[", None, "a, bb"], tables.parse_concepts(F.col("text"))) == [["a", "b"], ["1"], ["[] []"], [], [], ["bb"]]


def test_ends_of_descriptions_need_no_pattern(spark):
    assert "regexp_replace" not in plan("s9_clean_description", spark)


def test_files_of_words_hold_many_recordings(spark):
    words = registry.queries()["s1_read_words"](spark, FOLDER)
    assert len(words.inputFiles()) < words.select("video_id").distinct().count() / 2


def test_points_are_read_once_by_the_search_for_their_scene(spark):
    points = spark.range(40).select(F.lit("v").alias("video_id"), F.col("id").alias("n"), (F.col("id") - 4 + 0 * F.rand(7)).alias("t"))
    scenes = spark.createDataFrame([("v", 0, 0.0, 8.0), ("v", 1, 8.0, 16.0), ("v", 2, 20.0, 30.0)], "video_id string, scene_id int, t_start double, t_end double")
    found = J.scene_at(points, scenes, "t", "n")
    assert "rand(" not in found._jdf.queryExecution().optimizedPlan().toString()
    want = {n: 0 if n - 4 <= 8 else 1 if n - 4 <= 18 else 2 for n in range(40)}
    assert {r["n"]: r["scene_id"] for r in found.collect()} == want


def test_token_sets_are_made_once(spark):
    assert "split(" not in plan("f1_f3_token_sets", spark)
    got = column(spark, [*TEXTS, " Cat cat CAT-x ! ΣΑΣ dog\tbee\x0bant", "nan", "NaN ", "---"], K.token_set(F.col("text")))
    assert got[-4:] == [["ant", "bee", "cat", "catx", "dog"], [], ["nan"], []] and got[len(TEXTS) - 1] == []


def test_candidates_read_segments_once_and_count_without_joins(spark):
    segments = spark.range(3).select(F.lit("v").alias("video_id"), F.col("id").alias("segment_id"), F.concat(F.lit("The red cat, of red cats"), F.when(F.rand(7) < 2, "")).alias("text"))
    found = T.keyword_candidates(segments, top=20)
    told = found._jdf.queryExecution().optimizedPlan().toString()
    assert "rand(" not in told and told.count("Join") == 1
    assert {r["keyword_text"] for r in found.collect()} == {"red", "cat", "red cat", "cats", "red cats"}


def test_percentile_bins_read_scores_that_are_written(spark):
    assert "instr" not in plan("i3_percentile_bin", spark) and "regexp" not in plan("i3_percentile_bin", spark)


def test_plans_of_raters_are_made_without_a_shuffle(spark):
    # the plan of all raters is the product of raters and videos; only their lists may be written to disk
    text = registry.queries()["e1_assign_sessions"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    top = text[: text.index("SortMergeJoin")]
    assert "Generate posexplode" in top and "Exchange" not in top and "Sort " not in top and "Window" not in text


def test_topics_without_all_delays_count_in_the_plan(spark):
    from hashlib import md5

    from synchrony.operators import study

    videos = [(f"m{t}{i}", "manipulated", t, d) for t in range(7) for i, d in enumerate((0.0, 1.5, 5.0)) if (t, i) != (3, 1)] + [("x", "manipulated", 5, 2.0), ("y", "manipulated", None, 1.5), ("f1", "fresh", None, None), ("f2", "fresh", None, None), ("f2", "fresh", None, None)]
    raters = ["a", "b", "c"]
    df = study.assign_sessions(spark.createDataFrame(videos, "video_id string, set string, topic long, delay double"), spark.createDataFrame([(r,) for r in raters], "rater string"))
    code = lambda *x: md5("|".join(str(y) for y in ("1", *x) if y is not None).encode()).hexdigest()
    want = []
    for r in raters:
        topics = sorted([*range(7), None], key=lambda t: (code(r, t), t))
        rows = [(s, v) for i, t in enumerate(topics) for s in range(3) for v, _, u, d in videos if t is not None and u == t and d == (0.0, 1.5, 5.0)[(i // 2 + s) % 3]]
        fresh = sorted((v for v, kind, *_ in videos if kind == "fresh"), key=lambda v: (code(r, v), v))
        rows += [((i + int(code(r)[:8], 16) % 3) % 3, v) for i, v in enumerate(fresh)]
        want += [(r, s, v, i + 1, f"Video_R{i + 1:02d}") for i, (s, v) in enumerate(sorted(rows, key=lambda x: (x[0], code(r, x[1], x[0]), x[1])))]
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.mark.parametrize("name", ["s1_read_table", "s1_read_scenes", "s3_write_stage"])
def test_files_hold_many_recordings(spark, name, monkeypatch):
    monkeypatch.setattr(tables, "STAGE_PARTS", 4, raising=False)  # there are twenty recordings
    rows = registry.queries()[name](spark, FOLDER)
    assert len(rows.inputFiles()) < rows.select("video_id").distinct().count() / 2


def test_a_stage_rewrites_the_recordings_that_it_brings(spark, tmp_path):
    out = str(tmp_path / "stage")
    rows = lambda *x: spark.createDataFrame(list(x), "video_id string, n int")
    found = lambda: sorted(map(tuple, spark.read.parquet(out).select("video_id", "n").collect()), key=str)
    many = [(f"v{i}", i) for i in range(200)]
    tables.write_stage(rows(*many, ("a", 1), ("a", 2), (None, 3)), out)
    tables.write_stage(rows(("a", 5), ("b", 6)), out)  # others in the same folder stay
    assert found() == sorted([*many, ("a", 5), ("b", 6), (None, 3)], key=str)
    tables.write_stage(rows(("a", 7), ("c", 8), (None, 9)), out, skip_done=True)
    assert found() == sorted([*many, ("a", 5), ("b", 6), ("c", 8), (None, 3)], key=str)
    tables.write_stage(rows(("a", 7)).limit(0), out)
    assert len(found()) == 204
    other = str(tmp_path / "other")
    rows(("a", 1)).write.partitionBy("video_id").parquet(other)
    with pytest.raises(ValueError):
        tables.write_stage(rows(("b", 1)), other, skip_done=True)


def test_a_recording_that_a_run_writes_is_in_one_file(spark, tmp_path):
    out = str(tmp_path / "stage")
    tables.write_stage(spark.range(400).selectExpr("concat('v', id % 20) as video_id", "id").repartition(7), out)
    files = spark.read.parquet(out).select("video_id", F.col("_metadata.file_path").alias("f")).distinct()
    assert files.count() == 20


@pytest.mark.parametrize("name", ["a1_case_a_d_phrases", "a2_case_b_forward", "a3_case_c_backward_phrases", "a12_keyword_grounding", "a7_cascade"])
def test_frames_are_shuffled_packed(spark, name):
    # a row for each keyword and frame, or token and frame, is not written to disk again
    text = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    dealt = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    assert dealt and not [x for x in dealt if "frame_time" in x and ("keyword_id" in x or "tok" in x)]


def test_packed_frames_are_those_of_the_table(spark):
    from synchrony.operators import align

    ocr = spark.createDataFrame([("v", t / 4, tok) for t in range(200) for tok in ("ab", "cd") if t % 3 or tok == "ab"] * 2 + [("v", None, "ab")], "video_id string, frame_time double, tok string")
    packed = align.shown(ocr)
    assert packed.count() == 8 and align.shown(packed) is packed
    back = packed.select("video_id", F.explode("frames").alias("frame_time"), "tok")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ocr.where("frame_time is not null").distinct().collect()))
    hits = spark.createDataFrame([("v", 1, "ab", 3.25, 33.0), ("v", 2, "cd", 16.0, 16.0), ("v", 3, "cd", 9.0, 8.0), ("w", 4, "ab", 0.0, 9.0)], "video_id string, keyword_id long, tok string, low double, high double")
    got = align.by_keyword(align.frames_between(hits, packed, "low", "high")).select("keyword_id", "frame_time").collect()
    assert sorted(map(tuple, got)) == [(1, t / 4) for t in range(13, 133)] + [(2, 16.0)]
    assert align.frame_times(packed).count() == align.frame_times(ocr.where("frame_time is not null")).count() == 200


def test_letters_spare_what_characters_would(spark):
    words = ["", "a", "abc", "abd", "aabb", "bbaa", "letter", "letters", "setter", "été", "x😀y", "x😁y", "😀", "a1p", "0px"]
    pairs = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    for threshold in (0.3, 0.8):
        cheap = K.letters_may_reach(K.letters(F.col("a")), F.length("a"), K.letters(F.col("b")), F.length("b"), threshold)
        rows = pairs.select("a", "b", cheap.alias("cheap"), K.may_reach(F.col("a"), F.col("b"), threshold).alias("may")).collect()
        assert not [r for r in rows if r.may and not r.cheap] and [r for r in rows if not r.cheap]


def test_letters_are_tried_first_and_distances_once(spark):
    text = registry.queries()["j8_fuzzy_word_match"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    join = next(line for line in text.splitlines() if "SortMergeJoin" in line and "translate" in line)
    assert "bit_count" in join and join.index("bit_count") < join.index("translate") and text.count("ArrowEvalPython") == 1
