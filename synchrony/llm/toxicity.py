"""Toxicity: a linear classifier with a counterfactual penalty on identity terms.

A text's evidence is the sum over features of weight times log(1 + number of its distinct words that have the feature);
features are words and their beginnings. The weights are a logistic regression fitted on a bounded, class-balanced sample
of labelled rows. In every labelled sentence that names an identity term the term is swapped for the others of its
category and for nothing at all, and the squared change of the sentence's evidence, by the same function that scores
documents, is penalised, so that the mere mention of a group carries no evidence.

Features are counted map-side and chosen by aggregation; only chosen features of sampled rows and distinct swaps reach the
task that fits the weights.

Defined cases: null and empty texts score by the intercept alone; labels that are null, or differ for one id, are not
used; with one class or no label left, every score is the same, by the share of label 1 among them; repeated rows score
alike; labels, lang, source and doc_id never enter a score; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, text_or_empty, unused, written

#: At most so many labelled rows of each class are fitted, those with the smallest seeded hash.
SAMPLE = 4000
#: Score from which a document counts as toxic.
THRESHOLD = 0.7
#: Lengths of word beginnings that are features.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Features kept, by strength; documents of either class that a feature needs.
FEATURES, LEAST_DOCS = 4000, 4
#: Least z-score of the difference between a feature's shares of documents of the two classes.
STRENGTH = 4.0
#: Weights of the ridge and of the counterfactual penalty.
RIDGE, COUNTERFACTUAL = 0.1, 50.0
#: Words (of at most LONGEST characters) whose features a Python worker remembers, for one model at a time: about 20 MB.
REMEMBERED, LONGEST = 100_000, 40
WORDS = re.compile(r"[^\W\d_]+").findall
SENTENCES = re.compile(r"[.!?\n]+").split

# Identity terms by category; a swap stays inside its category.
IDENTITY = {
    "gender": "woman women man men girl girls boy boys female male transgender nonbinary frau frauen mann männer femme femmes homme hommes mujer mujeres hombre hombres".split(),
    "orientation": "gay gays lesbian lesbians straight bisexual queer homosexual heterosexual schwul lesbisch homosexuel lesbienne homosexuales lesbiana".split(),
    "religion": "muslim muslims christian christians jew jews jewish hindu hindus buddhist buddhists atheist atheists sikh sikhs catholic protestant christen muslime juden chrétiens musulmans juifs cristianos musulmanes judíos".split(),
    "origin": "black white asian african european american arab latino hispanic indian chinese mexican turkish immigrant immigrants refugee refugees foreigner foreigners schwarze weiße ausländer flüchtlinge noirs blancs étrangers réfugiés negros blancos extranjeros refugiados".split(),
    "body": "old young elderly disabled deaf blind autistic behindert blinde handicapé aveugle discapacitado ciego".split(),
}
CATEGORY = {w: c for c, words in IDENTITY.items() for w in words}


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_ids(labels: DataFrame, size: int, seed: int) -> DataFrame:
    """doc_id, toxic of at most ``size`` rows of each class."""
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    usable = usable.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("top")).where("toxic = top").drop("top")
    order = F.xxhash64(F.lit(seed), "doc_id"), F.col("doc_id")
    picked = [usable.where(F.col("toxic") == y).orderBy(*order).limit(size) for y in (0, 1)]
    return picked[0].unionByName(picked[1])


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:n] for n in BEGINNINGS if len(word) >= n)]


def seen_in(text: str) -> Counter:
    """Features of a text, with the number of its distinct words that have each."""
    seen: Counter = Counter()
    for w in set(WORDS(text.lower())):
        seen.update(features(w))
    return seen


def swaps_in(sentence: str, index: dict[str, int]) -> Iterator[dict[int, float]]:
    """How the values of chosen features change in a sentence whose identity term is swapped: one change per term and
    other term of its category, and one for the term left out; changes that no chosen feature shows are left out."""
    words = set(WORDS(sentence.lower()))
    terms = sorted(words & CATEGORY.keys())
    if not terms:
        return
    seen = seen_in(sentence)
    for t in terms:
        for other in ("", *(w for w in IDENTITY[CATEGORY[t]] if w != t)):
            change = Counter(features(other)) if other and other not in words else Counter()
            change.subtract(features(t))
            delta = {index[f]: math.log1p(seen[f] + n) - math.log1p(seen[f]) for f, n in change.items() if n and f in index}
            if delta:
                yield delta


COUNTS = "feature string, n0 long, n1 long"


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents of either class that have each feature, added up per batch of rows."""
    for pdf in batches:
        n = Counter(), Counter()
        for text, toxic in zip(pdf["text"], pdf["toxic"]):
            n[toxic].update(seen_in(text or "").keys())
        names = sorted({*n[0], *n[1]})
        yield pd.DataFrame({"feature": names, "n0": [n[0][f] for f in names], "n1": [n[1][f] for f in names]})


def chosen_features(sample: DataFrame, totals: tuple[int, int]) -> list[str]:
    """The FEATURES strongest features; strong ones are frequent in one class only."""
    counts = sample.mapInPandas(counted, COUNTS).groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    share = (F.col("n0") + F.col("n1")) / sum(totals)
    spread = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / totals[0] + 1 / totals[1]))
    z = F.abs(F.col("n1") / totals[1] - F.col("n0") / totals[0]) / spread
    strong = counts.where(F.col("n0") + F.col("n1") >= LEAST_DOCS).withColumn("z", z).where(F.col("z") > STRENGTH)
    return [r["feature"] for r in strong.orderBy(F.col("z").desc(), "feature").limit(FEATURES).collect()]


#: What the fit works on: documents (label 0 or 1) and swaps (label -1), by positions and values of chosen features, each
#: with how often it occurs.
ROWS = "at array<int>, value array<double>, label int, weight double"


def bare_terms(index: dict[str, int]) -> list[tuple]:
    """Every identity term alone, against no words at all."""
    alone = [sorted((index[f], math.log1p(n)) for f, n in seen_in(t).items() if f in index) for t in CATEGORY]
    return [([i for i, _ in x], [v for _, v in x], 1.0) for x in alone if x]


def rows_for_fit(index: dict[str, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            swaps: Counter = Counter()
            for text, toxic in zip(pdf["text"], pdf["toxic"]):
                seen = sorted((index[f], math.log1p(n)) for f, n in seen_in(text or "").items() if f in index)
                out.append(([i for i, _ in seen], [v for _, v in seen], toxic, 1.0))
                for sentence in SENTENCES(text or ""):
                    swaps.update(tuple(sorted(d.items())) for d in swaps_in(sentence, index))
            out += [([i for i, _ in d], [v for _, v in d], -1, float(n)) for d, n in swaps.items()]
            yield pd.DataFrame(out, columns=["at", "value", "label", "weight"])

    return run


def minimised(docs: list[tuple], labels: list[int], swaps: list[tuple], k: int) -> tuple[np.ndarray, float]:
    """Weights w and intercept with the least mean log loss + RIDGE |w|^2 / 2m + COUNTERFACTUAL * mean squared change / 2,
    m the number of documents. Documents and swaps: (positions, values, how many)."""

    def flat(rows: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        lengths = [len(r[0]) for r in rows]
        at = np.concatenate([np.zeros(0, int), *[np.asarray(r[0], int) for r in rows]])
        return np.repeat(np.arange(len(rows)), lengths), at, np.concatenate([np.zeros(0), *[np.asarray(r[1], float) for r in rows]])

    y, n, s = np.array(labels, float), len(docs), len(swaps)
    r, c, v = flat(docs)
    sr, sc, sv = flat(swaps)
    many, share = np.array([x[2] for x in docs], float), np.array([x[2] for x in swaps], float)
    m, share = many.sum(), share / share.sum() if s else share
    many /= m
    theta, b = np.zeros(k), 0.0
    momentum, mb, scale, sb = np.zeros(k), 0.0, np.full(k, 1e-8), 1e-8
    for step in range(1, 401):
        z = np.bincount(r, v * theta[c], n) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * many
        grad = np.bincount(c, v * g[r], k) + RIDGE * theta / m
        if s:
            d = np.bincount(sr, sv * theta[sc], s) * share
            grad += COUNTERFACTUAL * np.bincount(sc, sv * d[sr], k)
        gb = g.sum()
        momentum, mb = 0.9 * momentum + 0.1 * grad, 0.9 * mb + 0.1 * gb
        scale, sb = 0.99 * scale + 0.01 * grad**2, 0.99 * sb + 0.01 * gb**2
        rate = 0.1 / math.sqrt(1 + step / 50)
        theta -= rate * (momentum / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-4)
        b -= rate * (mb / (1 - 0.9**step)) / (math.sqrt(sb / (1 - 0.99**step)) + 1e-4)
    return theta, float(b)


def trained(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, seed: int = 11) -> tuple[dict[str, float], float]:
    """Weights by feature (at most FEATURES) and the intercept, fitted on the bounded sample."""
    ids = sample_ids(labels.select("doc_id", "toxic"), size, seed).withColumnRenamed("doc_id", "id_")
    text = docs.select("doc_id", "text").join(F.broadcast(ids), F.col("doc_id") == F.col("id_"))  # at most 2 * size ids
    sample = written(text.select("text", F.col("toxic").cast("int").alias("toxic")), "toxicity-sample")
    found = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    totals = found.get(0, 0), found.get(1, 0)
    if not all(totals):
        return {}, math.log((totals[1] + 0.5) / (totals[0] + 0.5))
    names = chosen_features(sample, totals)
    index = {f: i for i, f in enumerate(names)}

    def train(group: pd.DataFrame) -> pd.DataFrame:
        # sorted: any order of arrival gives the same fit
        rows = sorted((list(a), list(v), y, w) for a, v, y, w in zip(group["at"], group["value"], group["label"], group["weight"]))
        cases, swaps = [x for x in rows if x[2] >= 0], [(a, v, w) for a, v, y, w in rows if y < 0]
        # the rarer class weighs more, by the root of the shares: half way to equal classes
        each = [math.sqrt(sum(totals) / (2 * n)) for n in totals]
        theta, b = minimised([(a, v, w * each[y]) for a, v, y, w in cases], [y for _, _, y, _ in cases], swaps + bare_terms(index), len(index))
        return pd.DataFrame({"position": [-1, *range(len(theta))], "weight": [b, *theta]})

    rows = sample.mapInPandas(rows_for_fit(index), ROWS).groupBy("at", "value", "label").agg(F.sum("weight").alias("weight"))
    fitted = rows.groupBy(F.lit(0).alias("all")).applyInPandas(train, "position int, weight double")
    weights = {r["position"]: r["weight"] for r in written(fitted, "toxicity-model").collect()}  # at most FEATURES + 1 rows
    return {f: weights[i] for f, i in index.items() if abs(weights[i]) > 1e-4}, weights[-1]


_REMEMBERED: dict[str, dict[str, tuple[str, ...]]] = {}


def remembered(model: str) -> dict[str, tuple[str, ...]]:
    """This worker's memory of words' features, emptied when another model comes or it is full."""
    if model not in _REMEMBERED or len(_REMEMBERED[model]) >= REMEMBERED:
        _REMEMBERED.clear()
        _REMEMBERED[model] = {}
    return _REMEMBERED[model]


def evidence(text: str, theta: dict[str, float], memory: dict[str, tuple[str, ...]]) -> float:
    seen: Counter = Counter()
    for w in set(WORDS(text.lower())):
        found = memory.get(w)
        if found is None:
            found = tuple(f for f in features(w) if f in theta)
            if len(w) <= LONGEST and len(memory) < REMEMBERED:
                memory[w] = found
        if found:
            seen.update(found)
    return sum(theta[f] * math.log1p(n) for f, n in sorted(seen.items()))


def scored(docs: DataFrame, labels: DataFrame, name: str, **options) -> DataFrame:
    """The documents with their score as one more column."""
    model, intercept = trained(docs, labels, **options)
    digest = hashlib.sha256(repr((sorted(model.items()), intercept)).encode()).hexdigest()
    weights = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        memory = remembered(digest)
        z = [intercept + evidence(t, weights.value, memory) for t in texts]
        return pd.Series([1 / (1 + math.exp(-min(max(x, -500), 500))) for x in z], dtype=float)

    return docs.withColumn(name, score(text_or_empty()))


def op5_toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    found = scored(docs.select("doc_id", "text"), labels, "score", **options)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents whose score is below the threshold, with the columns that they came with, whatever these are called."""
    (name,) = unused(docs, "tox_score__")
    return scored(docs, labels, name, **options).where(F.col(name) < THRESHOLD).select(*columns_of(docs))
