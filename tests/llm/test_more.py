"""Brute force for scores and draws, splits at larger sizes, column names that clash in every stage."""

import collections
import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from synchrony.llm import mixing, sharding, toxicity
from synchrony.llm.common import table

from ..oracle import connect, norm
from .test_llm import FOLDER, ODD, WORDS, documents


def test_scores_by_brute_force(spark):
    """A document's score from the weights: words, their whole and their beginnings of three to seven letters."""
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    weights, intercept = toxicity.trained(docs, labels)
    assert len(weights) > 5
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: r.score for r in toxicity.op5_toxicity(docs, labels).collect()}
    for i, text in rows:
        words = {w for w in re.findall(r"\w+", re.sub(r"[\d_]", " ", (text or "").lower()))}
        n = collections.Counter(f for w in words for f in ["=" + w, *[w[:k] for k in range(3, 8) if len(w) >= k]])
        z = intercept + sum(weights[f] * math.log(1 + k) for f, k in n.items() if f in weights)
        assert got[i] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_scores_of_odd_and_repeated_rows(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    rows = [(i, "filthy trash people " * 3 if i % 2 else "a calm day by the sea " * 3) for i in range(40)]
    rows += [(100, "filthy trash"), (100, "filthy trash"), (101, "filthy trash"), (102, ""), (103, None), (104, "filthy trash " * 20_000), (None, "filthy trash")]
    out = toxicity.op5_toxicity(documents(spark, rows), labels).collect()
    assert len(out) == len(rows)
    by = collections.defaultdict(set)
    for r in out:
        by[r.doc_id].add(r.score)
    assert len(by[100]) == 1 and by[100] == by[101] == by[104] == by[None] and by[102] == by[103]
    assert min(by[100]) > max(by[102])


def test_draw_by_brute_force(spark):
    """Every source's words by whole passes, an equal share of each length and the best sum for the rest; documents by the
    order of their seeded hash."""
    import random

    rng = random.Random(21)
    rows = [(i, "w " * rng.choice([0, 1, 3, 5, 8, 13]), rng.choice("abc")) for i in range(150)] + [(i, "w " * 50, "d") for i in range(200, 203)]
    docs = documents(spark, rows)
    hashed = {r.doc_id: r.h_ for r in docs.select("doc_id", F.xxhash64(F.lit(7), "doc_id").alias("h_")).collect()}
    out = {r.doc_id: r for r in mixing.op4_mixing_weights(docs).collect()}
    size = {i: len(WORDS(t)) for i, t, _ in rows}
    for source in "abcd":
        ids = [i for i, _, s in rows if s == source]
        total, target = sum(size[i] for i in ids), out[ids[0]].target
        want = round(target)
        passes = min(3, want // total)
        rest = want - passes * total if passes < 3 else 0
        by = collections.defaultdict(list)
        for i in sorted(ids, key=lambda i: (hashed[i] % 2**64, i)):
            by[size[i]].append(i)
        take = {n: len(x) * rest // total if n else 0 for n, x in by.items()}
        left = rest - sum(n * k for n, k in take.items())
        spare = [range(len(x) - take[n] + 1) if n else range(1) for n, x in by.items()]
        sums = {0}
        for n, ks in zip(by, spare):
            sums = {s + n * k for s in sums for k in itertools.takewhile(lambda k: n * k <= left, ks)}
        best = max(s for s in sums if s <= left)
        taken = sum(out[i].taken for i in ids)
        assert taken == want - left + best
        for n, x in by.items():
            copies = [out[i].taken // n - passes for i in x] if n else []
            assert copies == sorted(copies, reverse=True) and set(copies) <= {0, 1} and sum(copies) >= take[n] * (n > 0)


@pytest.mark.parametrize(("folder", "limit"), [("/root/testdata/sf0.01", 100_000), ("/root/testdata/sf0.1", 400_000)])
def test_shards_that_split_match_sql(spark, folder, limit):
    got = sharding.op8_sharding(table(spark, folder, "documents"), limit)
    cols = sorted(got.columns)
    found = connect(folder).execute(sharding.ORACLE.replace(str(sharding.SHARD_BYTES), str(limit)))
    names = [x[0] for x in found.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in found.fetchall())
    rows = got.collect()
    assert sorted(tuple(norm(r[c]) for c in cols) for r in rows) == want and min(r.depth for r in rows) > 2


CLASHES = ["a.b", "tox_score__", "score", "copies", "id", "copy", "key", "spans", "blob", "found", "d", "k", "`x`"]


def test_clashing_columns_in_every_filtering_stage(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(i, t, "en", "s", *range(len(CLASHES))) for i, t, *_ in [*ODD, (9, "trash token=abcdefgh " + "w x y z " * 9)]]
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", "lang string", "source string", *[f"`{c.replace('`', '``')}` int" for c in CLASHES]]))
    folder = FOLDER
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "sentencepiece":
            assert out.count() == len(rows)
        else:
            assert out.columns == docs.columns and out.count() > 0
            assert all(r["a.b"] == 0 and r["tox_score__"] == 1 for r in out.collect())
        assert stage(spark, docs.limit(0), folder).count() == 0


def test_thinned_texts_keep_all_that_are_wanted(spark):
    from synchrony.llm import njoin

    docs = spark.range(20_000).select(F.col("id").cast("int").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(None, "no id")], "doc_id int, text string"))
    wanted = {r.doc_id for r in docs.where("doc_id % 97 = 5").collect()}
    kept = {r.doc_id for r in njoin.thinned(docs, docs.where("doc_id % 97 = 5").select(F.col("doc_id").cast("long").alias("id"))).collect()}
    assert wanted <= kept and len(kept) < 3 * len(wanted)
    assert njoin.thinned(docs, docs.where("false").select(F.col("doc_id").cast("long").alias("id"))).count() == 0


def test_bitmaps_grow_with_what_they_hold(spark):
    import numpy as np

    from synchrony.llm import common

    few, many = (spark.range(n).select(F.xxhash64("id").alias("h")) for n in (100, 60_000))
    assert len(common.bitmap(few)) * 8 == common.LEAST_BITS and len(common.bitmap(many)) * 8 >= 32 * 60_000
    held = np.array([r.h for r in many.collect()], np.int64)
    assert common.may_hold(common.bitmap(many), held).all() and common.may_hold(common.bitmap(many, 1 << 16), held).all()
    assert common.may_hold(common.bitmap(many), held + 12345).mean() < 0.05
