import pytest
from pyspark.sql import functions as F

from synchrony.operators import agreement, align, importance, scoring, series, study, text, timejoin, variants
from synchrony.sources import tables


def test_scene_at_prefers_the_earlier_scene_on_a_boundary(spark):
    scenes = spark.createDataFrame([("v", 0, 0.0, 8.0), ("v", 1, 8.0, 16.0)], "video_id string, scene_id int, t_start double, t_end double")
    points = spark.createDataFrame([("v", 1, 8.0), ("v", 2, 8.1), ("v", 3, 99.0), ("v", 4, -5.0)], "video_id string, pid int, t double")
    got = {r.pid: r.scene_id for r in timejoin.scene_at(points, scenes, "t", "pid").collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 0}


def test_nearest_frame_takes_the_earlier_on_a_tie(spark):
    frames = spark.createDataFrame([("v", 1.0), ("v", 2.0)], "video_id string, frame_time double")
    points = spark.createDataFrame([("v", 1, 1.5), ("v", 2, 9.0)], "video_id string, pid int, t double")
    got = {r.pid: r.frame_time for r in timejoin.nearest_frame(points, frames, "t", "pid", 1.0).collect()}
    assert got == {1: 1.0, 2: None}


def test_recordings_are_independent(spark):
    words = spark.createDataFrame([("a", i, w, float(i), i + 0.5) for i, w in enumerate("one two. three four five.".split())] + [("b", 0, "x.", 0.0, 0.1)], "video_id string, word_id long, word string, start_time double, end_time double")
    both = text.resegment_sentences(words).where("video_id = 'a'").orderBy("segment_id").collect()
    alone = text.resegment_sentences(words.where("video_id = 'a'")).orderBy("segment_id").collect()
    assert both == alone and [r.text for r in both] == ["one two.", "three four five."]


def test_long_segments_are_cut_at_clauses():
    words = ["w"] * 30 + ["x,"] + ["y"] * 30
    cuts = text.cut_points(words, 40)
    assert cuts == [31]
    pieces = [b - a for a, b in zip([0, *text.cut_points(["w"] * 200, 40)], [*text.cut_points(["w"] * 200, 40), 200])]
    assert sum(pieces) == 200 and max(pieces) <= 40


def test_greedy_rounds_equal_one_by_one(spark):
    import random

    random.seed(1)
    rows = [("s", a, b, 0.0, 0.0, random.randint(1, 9) / 10) for a in range(12) for b in range(12) if random.random() < 0.5]
    left, right, want = set(), set(), set()
    for _, a, b, _, _, s in sorted(rows, key=lambda r: (-r[5], r[1], r[2])):
        if a not in left and b not in right:
            want.add((a, b))
            left.add(a)
            right.add(b)
    df = spark.createDataFrame(rows, "set_name string, a_id long, b_id long, a_t double, b_t double, score double")
    order = [F.col("score").desc(), F.col("a_id").asc(), F.col("b_id").asc()]
    assert {(r.a_id, r.b_id) for r in variants.greedy(df, ("set_name",), order).collect()} == want


def test_merge_similar_short_equals_a_fold(spark):
    import random

    random.seed(2)
    rows = []
    for i in range(40):
        rows.append(("v", i, float(i), i + random.choice([0.5, 1.0, 3.0]), [random.choice([0.0, 1.0]), random.choice([0.5, 1.0])], [f"w{i % 4}"]))
    def cos(a, b):
        n = (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
        return sum(x * y for x, y in zip(a, b)) / n if n else 0
    want = [list(rows[0][2:])]
    for r in rows[1:]:
        head = want[-1]
        if r[3] - r[2] < 2 and cos(head[2], r[4]) > 0.85:
            head[1], head[3] = r[3], sorted({*head[3], *r[5]})
        else:
            want.append(list(r[2:]))
    df = spark.createDataFrame(rows, "video_id string, scene_id int, t_start double, t_end double, embedding array<float>, words array<string>")
    got = [(r.t_start, r.t_end, r.words) for r in series.merge_similar_short(df).orderBy("scene_id").collect()]
    assert got == [(w[0], w[1], sorted(w[3])) for w in want]


def test_fuzzy_cascade_finds_misread_words(spark):
    keywords = spark.createDataFrame([("v", 1, "gradient descent", 5.0, "HIGH"), ("v", 2, "zebra", 5.0, "HIGH"), ("v", 3, "gradient", 5.0, "LOW")], "video_id string, keyword_id long, keyword_text string, t_narr double, groundability string")
    ocr = spark.createDataFrame([("v", 4.0, "gradlent"), ("v", 4.5, "descent")], "video_id string, frame_time double, tok string")
    scenes = spark.createDataFrame([("v", 0, 3.0, 9.0, 6.0)], "video_id string, scene_id int, t_start double, t_end double, t_keyframe double")
    got = {r.keyword_id: r for r in align.align_keywords(keywords, ocr, scenes).collect()}
    assert got[1].match_case == "A" and got[1].alpha == 1.0 and got[1].t_vis == 4.0
    assert got[2].match_case == "F" and got[2].match_method == "ocr_vocabulary_mismatch"
    assert got[3].match_method == "low_groundability"


def test_more_delay_lowers_the_score(spark):
    rows = [(f"d{d}", i, 0, 50.0, 50.0 + d + i / 10, float(d + i / 10), "B", 1.0, 40.0, 60.0, "HIGH") for d in (0, 1, 3, 5) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "video_id string, keyword_id long, segment_id long, t_narr double, t_vis double, delta_t double, match_case string, alpha double, scene_t_start double, scene_t_end double, groundability string")
    none = spark.createDataFrame([], "video_id string, segment_id long, importance int, backend string")
    got = [r.overall_score for r in scoring.overall_score(scoring.scored(df, none)).orderBy("video_id").collect()]
    assert got == sorted(got, reverse=True)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "video_id string, keyword_id long, segment_id long, t_narr double, t_vis double, delta_t double, match_case string, alpha double, scene_t_start double, scene_t_end double, groundability string")
    none = spark.createDataFrame([], "video_id string, segment_id long, importance int, backend string")
    assert scoring.video_results(scoring.scored(df, none)).count() == 0
    assert scoring.score_segments(scoring.scored(df, none)).count() == 0


def test_sessions_are_balanced(spark):
    videos = [(f"t{t}d{d}", "manipulated", t, d) for t in range(6) for d in study.DELAYS] + [(f"f{i}", "fresh", None, None) for i in range(5)]
    v = spark.createDataFrame(videos, "video_id string, set string, topic long, delay double")
    r = spark.createDataFrame([("r1",), ("r2",)], "rater string")
    got = study.assign_sessions(v, r).join(v, "video_id").collect()
    for rater in ("r1", "r2"):
        mine = [x for x in got if x.rater == rater]
        assert len(mine) == 23 and sorted(x.position for x in mine) == list(range(1, 24))
        for s in range(3):
            man = [x for x in mine if x.session == s and x.set == "manipulated"]
            assert sorted(x.delay for x in man) == sorted(study.DELAYS * 2) and len({x.topic for x in man}) == 6
            assert sum(x.session == s and x.set == "fresh" for x in mine) in (1, 2)
    assert study.assign_sessions(v, r).exceptAll(study.assign_sessions(v, r)).count() == 0


def test_perfect_agreement(spark):
    rows = [(f"i{i}", f"r{r}", 1 + i % 5) for i in range(20) for r in range(4)]
    df = spark.createDataFrame(rows, "item string, rater string, rating long")
    assert agreement.fleiss_kappa(df).first().kappa == pytest.approx(1)
    assert agreement.icc_2k(df).first().icc_2k == pytest.approx(1)


def test_weight_settings_sum_to_one():
    for name, *w in importance.perturbation_settings() + importance.ablation_settings():
        assert sum(w) == pytest.approx(1), name


def test_read_write_round_trip(spark, tmp_path):
    folder = tmp_path / "A0"
    folder.mkdir()
    (folder / "ocr.csv").write_text("frame_time,words,n_words,extra\n0.5,b a b,3,x\n1.0,nan,NaN,y\n")
    df = tables.read_table(spark, "ocr_frames", str(tmp_path / "*" / "ocr.csv"))
    rows = df.orderBy("frame_time").collect()
    assert [(r.video_id, r.words, r.n_words, r.mean_confidence) for r in rows] == [("A0", ["b", "a"], 3, None), ("A0", [], None, None)]
    out = str(tmp_path / "stage")
    tables.write_stage(df, out, skip_done=True)
    tables.write_stage(df.unionByName(df.withColumn("video_id", F.lit("B1"))), out, skip_done=True)
    assert spark.read.parquet(out).groupBy("video_id").count().orderBy("video_id").collect() == [("A0", 2), ("B1", 2)]
    (folder / "results.json").write_text('{"overall_score": 89.5, "coverage": {"coverage_rate": 0.5}}')
    r = tables.read_results(spark, str(tmp_path / "*" / "results.json")).first()
    assert (r.video_id, r.coverage.coverage_rate) == ("A0", 0.5)
    text_json = tables.results_json(spark.createDataFrame([("v", 1.0, 2)], "video_id string, score double, n int"), {"a": ["score"], "b": ["n"]}).first().json
    assert text_json == '{"video_id":"v","a":{"score":1.0},"b":{"n":2}}'
