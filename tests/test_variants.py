"""Content groups over several recordings and delays per level, against plain loops."""

import math
import random

import pytest
from pyspark.sql import functions as F

from synchrony.operators import variants as V

SCENE = "set_name string, label string, scene_id long, t double, words array<string>"


def score(a, b, gap=20.0):
    """(t, words) of two scenes."""
    d = abs(a[0] - b[0])
    near = math.exp(-0.5 * (d / (gap / 2)) ** 2)
    if not a[1] and not b[1]:
        return round(0.5 * near if d <= 5 else 0.0, 12)
    same = len(set(a[1]) & set(b[1])) / len(set(a[1]) | set(b[1]))
    return 0.0 if same < 0.1 else round(same * near, 12)


def plain_groups(ref, comps):
    """One set. ref: id -> (t, words); comps: label -> id -> (t, words). Frozen sets of (label, id), with their head."""
    used, groups = set(), {("ref", i): {("ref", i)} for i in ref}
    pairs = [(-score(a, b), i, label, j) for i, a in ref.items() for label, scenes in comps.items() for j, b in scenes.items() if score(a, b) > 0.05]
    for _, i, label, j in sorted(pairs, key=lambda x: (x[0], x[1], x[3])):
        if (label, j) not in used and not any(x == label for x, _ in groups["ref", i]):
            groups["ref", i].add((label, j))
            used.add((label, j))
    for label, scenes in comps.items():
        for i, a in scenes.items():
            if (label, i) in used:
                continue
            used.add((label, i))
            own = groups.setdefault((label, i), {(label, i)})
            for other, theirs in comps.items():
                if other != label:
                    free = [(-score(a, b), j) for j, b in theirs.items() if (other, j) not in used and score(a, b) > 0.05]
                    if free:
                        own.add((other, min(free)[1]))
                        used.add((other, min(free)[1]))
    return {(head, frozenset(x)) for head, x in groups.items()}


def random_scenes(rng, n, step):
    return {i: (round(i * step + rng.random() * 5, 1), rng.sample("abcdefgh", rng.randint(0, 4))) for i in range(n)}


@pytest.mark.parametrize("rounds", [6, 1])
def test_content_groups_equal_the_plain_loops(spark, monkeypatch, rounds):
    rng = random.Random(3)
    monkeypatch.setattr(V.greedy, "__defaults__", (rounds,))
    sets = {f"s{k}": (random_scenes(rng, rng.randint(0, 25), 6), {x: random_scenes(rng, rng.randint(0, 25), 6) for x in ("c1", "c2", "c3")}) for k in range(6)}
    rows = [(name, label, i, t, w) for name, (ref, comps) in sets.items() for label, scenes in [("ref", ref), *comps.items()] for i, (t, w) in scenes.items()]
    scenes = spark.createDataFrame(rows, SCENE)
    found = V.content_groups(scenes.where("label = 'ref'").drop("label"), scenes.where("label <> 'ref'"), ["c1", "c2", "c3"]).collect()
    got = {}
    for r in found:
        got.setdefault((r.set_name, r.head_label, r.head_id), set()).add((r.label, r.scene_id))
    want = {(name, *head): set(x) for name, (ref, comps) in sets.items() for head, x in plain_groups(ref, comps)}
    assert got == want and len(found) == len(rows)
    assert any(len(x) == 3 and head[1] != "ref" for head, x in got.items())


def test_a_long_chain_ends_in_bounded_rounds(spark, monkeypatch):
    """Each pair waits for the one before it: one pair a round would take a hundred rounds."""
    n = 200
    rows = [("s", "c1", i // 2 + i % 2, i // 2, 2.0 * (i // 2 + i % 2), 2.0 * (i // 2) + 1, 1.0 - i / 1000) for i in range(n)]
    pairs = spark.createDataFrame(rows, "set_name string, label string, a_id long, b_id long, a_t double, b_t double, score double")
    calls = []
    monkeypatch.setattr(V, "settled", lambda df, label, real=V.settled: calls.append(label) or real(df, label))
    got = {(r.a_id, r.b_id) for r in V.greedy(pairs, ("set_name", "label"), [F.col("score").desc(), F.col("a_id").asc(), F.col("b_id").asc()]).collect()}
    used_a, used_b, want = set(), set(), set()
    for _, _, a, b, *_ in rows:
        if a not in used_a and b not in used_b:
            want.add((a, b)), used_a.add(a), used_b.add(b)
    assert got == want and len(calls) <= V.ROUNDS + 1


def test_scenes_beyond_the_gap_can_match(spark):
    """A perfect match counts up to 24 s at a gap of 20 s, not 25 s."""
    a = spark.createDataFrame([("s", 1, 0.0, ["x"])], "set_name string, scene_id long, t double, words array<string>")
    b = spark.createDataFrame([("s", "c", 1, 24.0, ["x"]), ("s", "c", 2, 25.0, ["x"]), ("s", "c", 3, 5.5, [])], SCENE)
    assert [r.b_id for r in V.fingerprint_pairs(a, b).collect()] == [1]


def clusters(spark, rows):
    dips = spark.createDataFrame(rows, "set_name string, pair string, kind string, center double, duration double")
    return [r.asDict() for r in V.cluster_dips(dips).orderBy("set_name", "cluster").collect()]


def test_delay_of_each_level(spark):
    i, b = "inter", "baseline"
    found = clusters(
        spark,
        [
            ("both", "1v3", i, 10.0, 2.5), ("both", "1v5", i, 11.0, 4.0), ("both", "1v3", i, 12.0, 3.0),
            ("all", "1v3", i, 10.0, 2.0), ("all", "1v5", i, 10.5, 6.0), ("all", "3v5", i, 11.0, 1.5),
            ("base", "0v1", b, 5.0, 1.0), ("base", "0v3", b, 6.0, 3.0), ("base", "0v5", b, 60.0, 5.0),
            ("twice", "1v3", i, 5.0, 2.5), ("twice", "1v3", i, 6.0, 2.5),
            ("mixed", "3v5", i, 5.0, 2.0), ("mixed", "0v5", b, 7.0, 5.0),
        ],
    )
    by = {}
    for r in found:
        by.setdefault(r["set_name"], []).append(r)
    assert by["both"][0]["delays"] == {1: 1.0, 3: 4.5, 5: 5.0} and by["both"][0]["confidence"] == "high"
    assert by["all"][0]["delays"] == {1: 1.5, 3: 2.2, 5: 3.8} and by["all"][0]["evidence"] == "1v3,1v5,3v5"
    assert [(r["confidence"], r["delays"], r["n_baseline"]) for r in by["base"]] == [("low", {}, 2), ("low", {}, 1)]
    assert by["twice"][0]["confidence"] == "high" and by["twice"][0]["delays"] == {1: 1.2, 3: 3.8}
    assert by["mixed"][0]["confidence"] == "medium" and by["mixed"][0]["delays"] == {3: 3.0, 5: 5.0}


def test_comparison_table_and_delay_points(spark):
    groups = spark.createDataFrame(
        [("s", "ref", 1, "ref", 1, 10.0, ["b", "a"]), ("s", "ref", 1, "c1", 4, 11.234, ["c"]), ("s", "c1", 7, "c1", 7, 50.0, []), ("s", "ref", 2, "ref", 2, 20.0, list("zyxwvutsr")), ("s", "ref", 2, "c1", 5, 20.25, ["a"])],
        "set_name string, head_label string, head_id long, label string, scene_id long, t double, words array<string>",
    )
    align = spark.createDataFrame([("s", "ref", 1, 2, 9.0, "late"), ("s", "ref", 1, 1, 0.5, "text"), ("s", "c1", 4, 1, -1.0, None), ("s", "c1", 7, 1, None, "vector")], "set_name string, label string, scene_id long, event_id long, delta_t double, match_track string")
    table = V.comparison_table(groups, align, ["ref", "c1"])
    rows = {(r.head_label, r.head_id): r for r in table.collect()}
    one, two, alone = rows["ref", 1], rows["ref", 2], rows["c1", 7]
    assert (one.ref_sid, one.ref_tvis, one.ref_dt, one.ref_track, one.c1_sid, one.c1_tvis, one.c1_dt, one.c1_track) == (1, 10.0, 0.5, "text", 4, 11.23, -1.0, "?")
    assert (one.content_words, one.tvis_shift, one.dt_spread, one.n_videos) == ("a b c", 1.23, 1.5, 2)
    assert (two.content_words, two.ref_track, two.dt_spread) == ("a r s t u v w x", "?", 0.0)
    assert (alone.content_words, alone.ref_sid, alone.ref_track, alone.c1_track, alone.tvis_shift, alone.n_videos) == ("(no text)", None, "missing", "vector", 0.0, 1)
    assert [r.head_id for r in V.delay_points(table).collect()] == [1]
    pictures = spark.createDataFrame([("s", "ref", 2, "c1", 0.0), ("s", "ref", 2, "c2", 3.0), ("s", "ref", 1, "c1", None)], "set_name string, head_label string, head_id long, label string, visual_delay double")
    points = V.delay_points(V.with_visual_spread(table, pictures)).orderBy("rank").collect()
    assert [(r.head_id, r.visual_delay_spread) for r in points] == [(2, 3.0), (1, None)]
