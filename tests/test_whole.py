"""Queries that take whole tables: rows beyond the old cuts are there, and equal the SQL at a size where cuts show."""

import pytest

from synchrony.plans import registry

from .oracle import assert_same

FOLDER = "/root/testdata/sf0.01"
QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


WHOLE = """a18_cluster_dips a19_delay_summary j13_variant_diff e1_assign_sessions e2_explode_submission e3_rater_progress e4_rater_stringency e5_fleiss_kappa e6_icc_2k e8_srocc_by_fold e8_srocc_by_strata
e9_curation_robustness e9_principle_concordance r3_stream_rater_progress a17_plan_pairs i17_series_monotonic s5_share_transcript s6_discover_variants w26_rebase_timeline""".split()


@pytest.mark.parametrize("name", WHOLE)
def test_whole_tables_match_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name], FOLDER)


def test_all_recordings_have_dips_and_pairs(spark):
    sets = {r[0] for r in QUERIES["a18_cluster_dips"](spark, FOLDER).select("set_name").distinct().collect()}
    assert any(int(x[1:]) >= 7 for x in sets)  # recordings from u42 on
    pairs = QUERIES["j13_variant_diff"](spark, FOLDER)
    assert pairs.select("video_a", "video_b").distinct().count() == 36 and pairs.select("keyword_id").distinct().count() == 40


def test_every_event_is_a_rating_and_every_recording_a_variant(spark):
    from synchrony.sources import fixtures

    r, n = fixtures.view(spark, FOLDER, "fx_ratings"), spark.read.parquet(f"{FOLDER}/events.parquet").count()
    assert r.count() == r.select("item", "rater").distinct().count() == n and r.select("rater").distinct().count() == 150
    assert QUERIES["e8_srocc_by_fold"](spark, FOLDER).count() == 4
    p = fixtures.view(spark, FOLDER, "fx_panel")
    assert p.count() == n == p.select("item").distinct().count() * p.select("rater").distinct().count()
    assert fixtures.view(spark, FOLDER, "fx_variants").count() == 24


def test_ratings_are_found_in_whole_texts(spark, tmp_path):
    assert_same(spark, QUERIES["s7_parse_rating_json"], ORACLES["s7_parse_rating_json"], FOLDER)
    late = "w " * 100 + '[{"segment_id": 5, "importance": 4, "reason": "late"}] ' + "w " * 100
    rows = [(7, late), (14, "plain"), (1, "w " * 100), (2, "broken [ list " + "w " * 100)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert_same(spark, QUERIES["s7_parse_rating_json"], ORACLES["s7_parse_rating_json"], str(tmp_path))
    found = {r.doc_id: (r.segment_id, r.importance, r.parsed) for r in QUERIES["s7_parse_rating_json"](spark, str(tmp_path)).collect()}
    assert found == {7: (5, 4, True), 14: (None, None, False), 1: (1, 1, True), 2: (None, None, False)}
