"""Phrase collocation mining by Rabin-Karp fingerprints.

Per language, the words of every piece of text are numbered and hashed, and prefix polynomials over these hashes give the
fingerprint of every run of n words in one subtraction. A task counts its fingerprints, and one shuffle adds up the counts:
first of words, then of pairs of frequent words, then of longer runs all of whose pairs are frequent. What is frequent comes
back as a bitmap of 32 bits for each fingerprint, which lets some others through and loses none. The next reading of the
texts verifies: every occurrence of a frequent fingerprint is held against the words at the first place that the task
has for it (its pointer), a run that differs is counted as what it is, and only these phrases are written out as text.
The final counts are those of phrases as text, so fingerprints that meet by chance decide nothing; pointers do not leave
their task.

A bitmap has at most 64 MB; with more than 16 million frequent runs in one it lets more others through,
which costs shuffle and changes no result. Counts leave a task pre-added, so a common phrase is one row per task and flush.

Defined cases: null texts equal empty ones; a null lang is ``und`` and joins that language; rows that repeat a text or a
doc_id all count; texts are read whole; a text without words adds nothing; an empty table gives no rows; other columns
are ignored, whatever their names; ties end by the phrase in UTF-8 byte order, so the order is total.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bitmap, may_hold, written
from .substrings import K1, mixed

#: Words of the longest candidate, occurrences of the rarest, phrases told per language, per cent of the occurrences of a
#: candidate that a longer one must have to take its place.
LONGEST, LEAST, TOP, COVERED = 5, 100, 2000, 100
#: Fingerprints and phrases that a task keeps before it hands on their counts.
KEPT_RUNS, KEPT_PHRASES = 4_000_000, 200_000
#: Bytes of text that are numbered together.
TOGETHER = 4_000_000
#: Upper case to lower, and everything that ends a piece to a full stop.
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + b"." * 9)
COUNTS = "fp long, lang string, phrase string, n long"


class Runs:
    """The words of some texts as numbers, with what tells their runs: hashes, languages, and the room up to the end of
    the piece."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        from xxhash import xxh3_64_intdigest

        tokens: list[bytes] = []
        edges = [0]
        for text in texts:
            tokens += text.translate(FOLD).replace(b".", b" . ").split()
            tokens.append(b".")
            edges.append(len(tokens))
        coded = pa.array(tokens, pa.binary()).dictionary_encode()
        self.words: list[bytes] = coded.dictionary.to_pylist()
        self.ids = coded.indices.to_numpy()
        known = np.fromiter(map(xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        self.langs = sorted(set(langs))
        code = {x: i for i, x in enumerate(self.langs)}
        self.lang = np.repeat(np.array([code[x] for x in langs], np.int32), np.diff(edges))
        self.salt = np.fromiter((xxh3_64_intdigest(x.encode("utf-8", "surrogatepass"), seed=7) for x in self.langs), np.uint64, len(self.langs))
        at = np.arange(len(tokens))
        stops = np.flatnonzero(self.ids == (self.words.index(b".") if tokens else -1))
        self.room = stops[np.searchsorted(stops, at)] - at if len(stops) else at
        # prefix polynomials: sums of hash times power; the powers are odd, so a run's sum is brought to its start by a division
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(tokens), np.uint64(K1))]).astype(np.uint64))
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(tokens), np.uint64(pow(K1, -1, 1 << 64)))]).astype(np.uint64))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(known[self.ids] * self.up[:-1], dtype=np.uint64)])

    def at(self, n: int) -> np.ndarray:
        """Where runs of n words start."""
        return np.flatnonzero(self.room >= n)

    def prints(self, at: np.ndarray, n: int) -> np.ndarray:
        """Fingerprints of the runs of n words at these places, by language."""
        return mixed((self.sums[at + n] - self.sums[at]) * self.down[at] + self.salt[self.lang[at]] * np.uint64(n))

    def phrase(self, at: int, n: int) -> str:
        return b" ".join([self.words[i] for i in self.ids[at : at + n]]).decode("utf-8", "replace")

    def verified(self, at: np.ndarray, prints: np.ndarray, n: int) -> Counter:
        """Occurrences of each phrase: those of a fingerprint are held against the words at its first place; where they
        are others, the place is counted by its own words."""
        _, first, which, counts = np.unique(prints, return_index=True, return_inverse=True, return_counts=True)
        pointer = at[first][which]
        same = self.lang[at] == self.lang[pointer]
        for k in range(n):
            same &= self.ids[at + k] == self.ids[pointer + k]
        counts = counts - np.bincount(which[~same], minlength=len(first))
        out: Counter = Counter()
        for place, many in zip(at[first].tolist(), counts.tolist()):
            out[self.langs[self.lang[place]], self.phrase(place, n)] += many
        for place in at[~same].tolist():
            out[self.langs[self.lang[place]], self.phrase(place, n)] += 1
        return out


def rows(prints: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(prints), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(prints.view(np.int64)), none, none, pa.array(counts.astype(np.int64))], ["fp", "lang", "phrase", "n"])


def named(counts: Counter) -> pa.RecordBatch:
    """Phrases, or whole languages, with their counts."""
    langs, phrases = ([k[i] for k in counts] for i in range(2))
    return pa.RecordBatch.from_arrays([pa.nulls(len(counts), pa.int64()), pa.array(langs, pa.string()), pa.array(phrases, pa.string()), pa.array(list(counts.values()), pa.int64())], ["fp", "lang", "phrase", "n"])


def together(batches: Iterator[pa.RecordBatch]) -> Iterator[Runs]:
    """Texts in portions of a few million bytes; a longer text is a portion of its own."""
    texts, langs, size = [], [], 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
            if size + len(text) > TOGETHER and texts:
                yield Runs(texts, langs)
                texts, langs, size = [], [], 0
            texts.append(text), langs.append(lang)
            size += len(text)
    if texts:
        yield Runs(texts, langs)


class Pass:
    """What one reading of the texts counts. ``chain``: a level and the bitmap of its frequent runs; only runs all of whose
    runs of that level may be frequent are looked at. ``fresh``: levels counted by fingerprint. ``proven``: levels whose
    phrases are counted, where the bitmap (of the chain, or another) holds their fingerprint."""

    def __init__(self, fresh: list[int], proven: list[int] = [], chain=None, bits=None):
        self.fresh, self.proven, self.chain, self.bits = fresh, proven, chain, bits

    def starts(self, runs: Runs):
        """Where runs of n words start, as a function of n."""
        if self.chain is None:
            return runs.at
        m, bits = self.chain
        at = runs.at(m)
        at = at[may_hold(bits.value, runs.prints(at, m))]
        good = np.zeros(len(runs.room) + LONGEST * 8, bool)
        good[at] = True

        def of(n: int) -> np.ndarray:
            out = at
            for k in range(1, n - m + 1):
                out = out[good[out + k]]
            return out[runs.room[out] >= n]

        return of

    def count(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []
        size, phrases = 0, Counter()
        for runs in together(batches):
            starts = self.starts(runs)
            if self.chain is None:
                for lang, words in enumerate(np.bincount(runs.lang[runs.room > 0], minlength=len(runs.langs)).tolist()):
                    phrases[runs.langs[lang], None] += words
            for n in self.proven:
                at = starts(n)
                prints = runs.prints(at, n)
                if self.bits is not None:
                    good = may_hold(self.bits.value, prints)
                    at, prints = at[good], prints[good]
                phrases.update(runs.verified(at, prints, n))
            if len(phrases) >= KEPT_PHRASES:
                yield named(phrases)
                phrases = Counter()
            for n in self.fresh:
                waiting.append(runs.prints(starts(n), n))
                size += len(waiting[-1])
            if size >= KEPT_RUNS:
                yield rows(*np.unique(np.concatenate(waiting), return_counts=True))
                waiting, size = [], 0
        if phrases:
            yield named(phrases)
        if size:
            yield rows(*np.unique(np.concatenate(waiting), return_counts=True))


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """lang, phrase, f of all phrases of up to ``longest`` words with ``least`` occurrences, and lang, n of all languages. The
    texts are read four times: words; pairs of frequent words; longer runs of frequent pairs; the phrases of those."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    context, results = docs.sparkSession.sparkContext, []

    def read(what: Pass):
        """Counts of one reading; the bitmap of the frequent ones among its fingerprints."""
        found = texts.mapInArrow(what.count, COUNTS).repartition("fp", "lang", "phrase").groupBy("fp", "lang", "phrase").agg(F.sum("n").alias("n"))
        kept = written(found.where((F.col("n") >= least) | (F.col("fp").isNull() & F.col("phrase").isNull())), "phrases")
        results.append(kept.where("fp is null").select("lang", "phrase", "n"))
        if what.fresh:
            return context.broadcast(bitmap(kept.where("fp is not null").select("fp")))

    words = read(Pass([1]))
    pairs = read(Pass([2] if longest > 1 else [], [1], (1, words)))
    if longest > 1:
        more = list(range(3, longest + 1))
        runs = read(Pass(more, [2], (2, pairs)))
        if more:
            read(Pass([], more, (2, pairs), runs))
    phrases = reduce(DataFrame.unionByName, results[1:]).withColumnRenamed("n", "f")
    return phrases, results[0].select("lang", "n")


def exact(column: str, digits: int) -> Column:
    return F.col(column).cast(f"decimal({digits},0)")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, covered: int = COVERED) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score. Products are decimals of 38 digits."""
    phrases, totals = frequent_phrases(docs, longest, least)
    words = phrases.withColumn("words", F.split("phrase", " ", -1)).withColumn("size", F.size("words"))
    candidates = words.where(F.col("size") > 1)
    joined = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", F.col("f").alias("a"), "k", joined(F.lit(1), F.col("k")).alias("head"), joined(F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    left = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    cuts = cuts.join(left, ["lang", "head"]).join(right, ["lang", "tail"]).join(totals, "lang")
    # 1000 a n has at most 4 + 16 + 18 digits
    up, down = F.lit(1000).cast("decimal(4,0)") * (exact("a", 16) * exact("n", 18)), exact("l", 18) * exact("r", 18)
    cuts = cuts.withColumn("up", up).withColumn("down", down).withColumn("score", F.expr("up div down"))
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every run of two words or more inside a candidate, with the most occurrences of what it is inside of
    parts = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: F.array_join(F.slice("words", i, n), " "))))
    inside = candidates.where(F.col("size") > 2).select("lang", "f", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    best = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < covered * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    out = best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrase_mining(docs: DataFrame) -> DataFrame:
    return collocations(docs)


#: Words as lists; runs of up to five by position.
ORACLE = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT lang, k, array_to_string(w[p:p + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, c.a, c.cut, l.f AS l, r.f AS r, n.n, CAST((1000 * CAST(c.a AS HUGEINT) * n.n) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score FROM c JOIN n USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[cut + 1:c.k], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT DISTINCT b.lang, b.phrase FROM b JOIN f ON f.lang = b.lang AND f.k > b.k AND 100 * f.f >= 100 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM b ANTI JOIN i USING (lang, phrase))
SELECT lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, n, score FROM t WHERE rank <= 2000
"""
