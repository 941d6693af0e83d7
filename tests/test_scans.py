"""Scans over buckets equal windows over whole recordings; the streamed merge equals a fold."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from synchrony.operators import align, scans, series, timejoin


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_scan_equals_windows(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, rng.randint(-40, 60)]), i, rng.choice([None, rng.randint(0, 9)])) for i in range(300)]
    df = spark.createDataFrame(rows, "video_id string, at int, i int, v int").cache()
    order = [F.col("at"), F.col("i")]
    w = Window.partitionBy("video_id").orderBy(*order)
    back, on = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    want = df.select("i", F.last("v", True).over(back).alias("p"), F.first("v", True).over(on).alias("f"), F.coalesce(F.sum("v").over(back), F.lit(0)).alias("s"), F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("c"))
    v = F.col("v")
    got = scans.scan(df, F.floor(F.col("at") / size), order, p=scans.previous(v), f=scans.following(v), s=scans.sum_before(v), c=scans.previous(v, current=True))
    assert set(got.columns) == {*df.columns, "p", "f", "s", "c"}
    assert sorted(map(tuple, got.select("i", "p", "f", "s", "c").collect())) == sorted(map(tuple, want.collect()))


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_runs_and_events_span_buckets(spark, monkeypatch):
    rng = random.Random(5)
    rows = [("v", i, i * 0.5, rng.choice([0.1, 0.9])) for i in range(400) if i % 37] + [("w", i, i * 0.5, 0.1) for i in range(50)]
    df = spark.createDataFrame(rows, "video_id string, frame_idx int, t double, mad double").cache()
    runs, events = sorted(map(tuple, series.freeze_runs(df).collect())), sorted(map(tuple, series.transitions(df, 0.5).collect()))
    monkeypatch.setattr(series, "PLACES", 8)
    monkeypatch.setattr(series.islands, "__defaults__", (series.KEY, 8))
    assert sorted(map(tuple, series.freeze_runs(df).collect())) == runs and sorted(map(tuple, series.transitions(df, 0.5).collect())) == events
    low = [f for v, f, _, m in rows if v == "v" and m < 0.5 and f > 0]
    want = []
    for f in low:
        if want and f == want[-1][1] + 1:
            want[-1][1] = f
        else:
            want.append([f - 1, f])
    assert [(r[1], r[2]) for r in runs if r[0] == "v"] == [(a, b) for a, b in want if b - a + 1 >= 1]


def test_timeline_and_order_span_buckets(spark, monkeypatch):
    rng = random.Random(6)
    events = [("v", i, rng.randint(0, 200) / 2) for i in range(200)]
    delays = [("v", rng.randint(0, 200) / 2, float(rng.randint(1, 4))) for _ in range(30)]
    e = spark.createDataFrame(events, "video_id string, event_id long, t double")
    d = spark.createDataFrame(delays, "video_id string, t_delay double, delay double")
    monkeypatch.setattr(series, "SECONDS", 8.0)
    got = {r.event_id: r.t_base for r in series.rebase_timeline(e, d).collect()}
    assert got == {i: t - sum(x for _, at, x in delays if at < t) for _, i, t in events}
    monkeypatch.setattr(align, "SECONDS", 8.0)
    rows = [("v", i, 0, float(rng.randint(0, 90)), float(i // 2), 1.0) for i in range(120)]
    a = spark.createDataFrame(rows, "video_id string, keyword_id long, segment_id long, t_narr double, t_vis double, alpha double")
    got = {r.keyword_id: r.violates for r in align.monotonic_violations(a).collect()}
    assert got == {r[1]: k > 0 and r[3] < rows[k - 1][3] - 10 for k, r in enumerate(rows)}


def test_nearest_middle_spans_buckets(spark, monkeypatch):
    rng = random.Random(7)
    segments = [("v", i, float(rng.randint(0, 400)), float(rng.randint(0, 400))) for i in range(25)]
    points = [("v", i, float(rng.randint(-50, 450))) for i in range(150)] + [("other", 0, 5.0)]
    s = spark.createDataFrame(segments, "video_id string, segment_id long, start_time double, end_time double")
    p = spark.createDataFrame(points, "video_id string, pid long, at double")
    monkeypatch.setattr(timejoin, "SECONDS", 8.0)
    got = {(r.video_id, r.pid): r.segment_id for r in timejoin.nearest_segment(p, s, "at", "pid").collect()}
    assert got == {(v, i): min((abs((a + b) / 2 - t), k) for _, k, a, b in segments)[1] if v == "v" else None for v, i, t in points}


def test_no_recording_is_one_window(spark):
    """Rows themselves meet in windows of a bucket only."""
    df = spark.createDataFrame([("v", 1, 0.5, 0.1)], "video_id string, frame_idx int, t double, mad double")
    for out in (series.freeze_runs(df), series.transitions(df, 0.5), series.dip_regions(df.select("video_id", "t", F.col("mad").alias("ssim")))):
        windows = [x for x in plan_of(out).splitlines() if "Window [" in x]
        assert windows and all("bucket__" in x or "_carried__" in x for x in windows), windows


def test_quantiles_equal_percentiles(spark):
    rng = random.Random(11)
    rows = [(rng.choice(["a", "b", "c"]), rng.choice([None, rng.randint(-300, 300) / 7, float(rng.randint(0, 4))])) for _ in range(500)] + [("d", 2.5), ("e", None)]
    df = spark.createDataFrame(rows, "video_id string, x double")
    got = scans.quantiles(df, ["video_id"], low=(F.col("x"), 0.01), middle=(F.col("x"), 0.5), high=(-F.col("x"), 0.8)).collect()
    want = df.groupBy("video_id").agg(F.percentile("x", 0.01).alias("low"), F.median("x").alias("middle"), F.percentile(-F.col("x"), 0.8).alias("high")).where("middle is not null").collect()
    assert {r.video_id: pytest.approx((r.low, r.middle, r.high)) for r in want} == {r.video_id: (r.low, r.middle, r.high) for r in got}


def test_scenes_far_from_every_segment(spark):
    """Best similarity times nearness, nearness being 0 in doubles far away; the first segment of equal ones."""
    import math

    rng = random.Random(13)
    vector = lambda: [rng.choice([-1.0, 0.5, 1.0]), rng.choice([-1.0, 0.2, 1.0])]
    segments = [("v", i, rng.choice([0.0, 50.0, 300.0, 700.0, 5000.0, 9000.0]) + i, vector()) for i in range(40)] + [("w", 3, 10_000.0, [1.0, 1.0]), ("w", 9, 0.0, [1.0, 0.0])]
    scenes = [("v", i, rng.choice([0.0, 150.0, 450.0, 1500.0, 3000.0, 20_000.0]) + 3 * i, vector()) for i in range(60)] + [("w", 0, 5000.0, [1.0, 0.0]), ("none", 0, 5.0, [1.0, 0.0])]
    a = spark.createDataFrame(scenes, "video_id string, scene_id long, t_vis double, embedding array<double>")
    b = spark.createDataFrame(segments, "video_id string, segment_id long, t_mid double, embedding array<double>")
    got = {(r.video_id, r.scene_id): r.segment_id for r in align.scene_track_vector(a, b).collect()}
    want = {}
    for v, i, t, x in scenes:
        best = None
        for w, k, m, y in segments:
            if w == v:
                sim = sum(p * q for p, q in zip(x, y)) / math.sqrt(sum(p * p for p in x) * sum(q * q for q in y))
                product = sim * math.exp(-0.5 * ((m - t) / 15) ** 2)
                if best is None or product > best[0]:
                    best = (product, k, sim)
        if best and best[2] >= 0.2:
            want[v, i] = best[1]
    assert got == want and len(want) > 10


def test_what_follows_is_not_worked_out_anew_for_every_row(spark):
    # a frame up to the end of a window costs the square of its rows
    df = spark.createDataFrame([("a", i, i % 3) for i in range(9)], "video_id string, at int, v int")
    out = scans.scan(df, F.floor(F.col("at") / 5), [F.col("at")], n=scans.following(F.col("v")), m=scans.least_after(F.col("v")))
    assert "unboundedfollowing" not in plan_of(out)
    assert {r["at"]: (r.n, r.m) for r in out.collect()} == {i: ((i + 1) % 3, min((j % 3 for j in range(i + 1, 9)))) if i < 8 else (None, None) for i in range(9)}


def test_points_of_one_time_are_sought_once(spark):
    points = spark.createDataFrame([("a", i, [1.0, 7.0, None][i % 3]) for i in range(30)], "video_id string, pid long, at double")
    segments = spark.createDataFrame([("a", 5, 0.0, 4.0), ("a", 6, 2.0, 4.0), ("a", 7, 4.0, 4.0), ("b", 1, 1.0, 1.0)], "video_id string, segment_id long, start_time double, end_time double")
    spans = segments.select("video_id", ((F.col("start_time") + F.col("end_time")) / 2).alias("t_"), F.col("segment_id").alias("s"))
    assert sorted(map(tuple, timejoin.nearest_middle(points.select("video_id", F.col("at").alias("t_")), spans).collect())) == [("a", 1.0, 5), ("a", 7.0, 7)]
    got = {r.pid: r.segment_id for r in timejoin.nearest_segment(points, segments, "at", "pid").collect()}
    assert got == {i: [5, 7, None][i % 3] for i in range(30)}
