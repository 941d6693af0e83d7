"""Joins of tables that grow with the input are not broadcast, and correlations of ratings that do not vary."""

import math

import pytest

from synchrony.operators import importance as I
from synchrony.operators import scans
from synchrony.plans import registry

FOLDER = "/root/testdata/sf0.001"
#: Queries whose exploded rows the driver had to collect and build a table of.
SENT = """a13_fingerprint_pairs a6_no_match_reason g14_scene_quality j5_frames_in_scene j7_first_in_window j8_fuzzy_word_match j3_nearest_frame w13_scene_words w3_jaccard_change_signal
t12_new_words_per_scene a12_keyword_grounding a12_grounding_by_segment a1_case_a_d a1_case_a_d_phrases a2_case_b_forward i6_weight_settings i7_ablation_sweep i7_sensitivity_sweep""".split()


@pytest.mark.parametrize("name", SENT)
def test_growing_tables_are_merged(spark, name):
    plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan or "Scan parquet" in plan and "Join" not in plan
    assert "BroadcastExchange" not in plan and "BroadcastNestedLoop" not in plan


#: Queries that write tables on their way: what is joined for those must not be sent to the driver either.
WRITING = """a14_group_leftovers a15_comparison_table a16_delay_points a16_delay_points_visual a6_no_match_reason j7_first_in_window j8_fuzzy_word_match j3_nearest_frame w13_scene_words w3_jaccard_change_signal
t12_new_words_per_scene a12_grounding_by_segment a12_keyword_grounding a12_keyword_grounding_phrases a1_case_a_d a1_case_a_d_phrases a2_case_b_forward""".split()


@pytest.mark.parametrize("name", WRITING)
def test_no_step_of_a_query_is_broadcast(spark, name):
    store, bus = spark._jsparkSession.sharedState().statusStore(), spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    before = {e.executionId() for e in executions(store)}
    registry.queries()[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
    bus.waitUntilEmpty()
    plans = [e.physicalPlanDescription() for e in executions(store) if e.executionId() not in before]
    assert plans and any("Join" in p for p in plans)
    assert [line.strip() for p in plans for line in p.splitlines() if "Broadcast" in line] == []


def executions(store):
    found = store.executionsList()
    return [found.apply(i) for i in range(found.size())]


def test_hints_are_for_one_engine():
    assert not any("MERGE" in sql for sql in registry.oracle_sql().values())


def test_sum_of_all_rows_of_a_key(spark):
    rows = spark.createDataFrame([("a", float(i), i) for i in range(10)] + [("b", 5.0, None), ("b", 50.0, 3), (None, 1.0, 4)], "video_id string, x double, n long")
    from pyspark.sql import functions as F

    out = scans.scan(rows, F.floor(F.col("x") / 3), [F.col("x")], total=scans.sum_of_all(F.col("n"))).collect()
    assert {(r.video_id, r.total) for r in out} == {("a", 45), ("b", 3), (None, 4)} and len(out) == 13


def test_ratings_that_do_not_vary_have_no_correlation(spark):
    features = spark.createDataFrame([("v", i, *[0.5] * 6) for i in range(4)] + [("w", i, *[i / 4] * 6) for i in range(4)] + [("u", 0, *[0.5] * 6)], "video_id string, segment_id long, " + ", ".join(f"{f} double" for f in I.FEATURES))
    sweep = I.sensitivity_sweep(features, I.ablation_settings())
    assert {(r.video_id, str(r.rank_corr)) for r in sweep.where("video_id <> 'w'").collect()} == {("v", "nan"), ("u", "1.0")}
    found = {r.video_id: r.mean_rank_corr for r in I.sensitivity_summary(sweep).collect()}
    assert math.isnan(found["v"]) and found["u"] == 1.0 and abs(found["w"] - 1) < 1e-9


def test_tracks_over_the_same_vectors_share_their_matches(spark, monkeypatch):
    from synchrony.operators import align

    calls, own = [], align.vector_matches
    monkeypatch.setattr(align, "vector_matches", lambda *x, **y: calls.append(1) or own(*x, **y))
    plan = registry.queries()["a11_scene_cascade"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert len(calls) == 1 and "BroadcastExchange" not in plan
