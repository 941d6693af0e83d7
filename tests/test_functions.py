import random

import pytest
from pyspark.sql import functions as F

from synchrony.functions import scores as S
from synchrony.functions import tokens as K


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


@pytest.mark.parametrize(("gap", "score"), [(1, 92.3), (2, 72.6), (2.5, 60.7), (3, 48.7), (4, 27.8), (5, 13.5)])
def test_gaussian_constants(spark, gap, score):
    assert round(one(spark, S.gaussian_score(F.lit(float(gap)), F.lit(False)))[0], 1) == score


def test_piecewise_at_three_seconds(spark):
    assert one(spark, S.piecewise_score(F.lit(3.0), F.lit(False)))[0] == 70


def test_persistent_visual_decays_after_dwell(spark):
    full, less, gone = one(spark, *[S.gaussian_score(F.lit(d), F.lit(True)) for d in (-15.0, -45.0, -200.0)])
    assert full == 100 and 60 < less < 61 and gone < 1


def test_scores_fall_with_delay(spark):
    rows = spark.range(0, 60).select(S.gaussian_score(F.col("id") / 5.0 + 0.1, F.lit(True)).alias("s")).collect()
    assert all(a.s > b.s for a, b in zip(rows, rows[1:]))


def test_null_gap_has_no_score(spark):
    r = one(spark, S.gaussian_score(F.lit(None).cast("double"), F.lit(True)), S.zone(F.lit(None).cast("double"), F.lit(True)), S.grade(F.lit(None).cast("double")))
    assert list(r) == [None, "No Match", "N/A"]


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_indel_ratio_both_forms(spark):
    random.seed(3)
    word = lambda: "".join(random.choice("abcde") for _ in range(random.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(200)] + [("", ""), ("a", ""), ("", "b")]
    df = spark.createDataFrame(pairs, "a string, b string")
    rows = df.select("a", "b", K.indel_ratio(F.col("a"), F.col("b")).alias("x"), K.indel_ratio_arrow("a", "b").alias("y")).collect()
    for r in rows:
        want = 2 * lcs(r.a, r.b) / (len(r.a) + len(r.b)) if r.a or r.b else 1.0
        assert r.x == pytest.approx(want) and r.y == pytest.approx(want)


def test_token_set_ratio():
    assert K.set_ratio("hill climbing", "climbing hill") == 100
    assert K.set_ratio("a b", "c d") < 60
    assert K.set_ratio("", "x") == 0


def test_token_set_null_and_nan(spark):
    r = one(spark, K.token_set(F.lit(None).cast("string")), K.token_set(F.lit("nan")), K.token_set(F.lit("The k-NN, the map")))
    assert list(r) == [[], [], ["knn", "map", "the"]]


def test_token_sets_of_either_length(spark):
    text = F.lit("A to-do, the  AI of x nan")
    three, two, none, nan = one(spark, K.token_set(text), K.token_set(text, 2), K.token_set(F.lit(None).cast("string")), K.token_set(F.lit("NaN")))
    assert three == ["nan", "the", "todo"] and two == ["ai", "nan", "of", "the", "todo"] and none == nan == []


def test_unit_vectors(spark):
    long, zero, empty = one(spark, S.unit(F.array(F.lit(3.0), F.lit(-4.0))), S.unit(F.array(F.lit(0), F.lit(0))), S.unit(F.array().cast("array<double>")))
    assert long == pytest.approx([0.6, -0.8]) and zero == [0.0, 0.0] and empty == []


@pytest.mark.parametrize(("delta", "text"), [(2.0, "+2.0s"), (-0.4, "-0.4s"), (0.0, "+0.0s")])
def test_format_delta(spark, delta, text):
    assert one(spark, S.format_delta(F.lit(delta)))[0] == text
