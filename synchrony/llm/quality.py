"""Quality rules: word and line statistics, and robust multivariate outliers per language and source.

The statistics are built-in array functions inside one row. The verdict rests on a minimum-covariance-determinant estimate
per (lang, source): from several starts, concentration steps fit mean and covariance again to the three quarters of the
rows with the smallest Mahalanobis distances, until nothing moves, and the start that ends with the least determinant
counts. Documents whose transformed statistics lie beyond a chi-square quantile of that estimate are rejected.

Vectors are held as integers, so rows of one group with the same vector are counted before anything else happens; each
step is one aggregation over distinct vectors, its sums are exact, and no result depends on partitioning.

Groups of fewer than ``MIN_GROUP`` passing rows are pooled by language, and languages that are still smaller in one last
group. Most texts have no symbols and no repetition at all, so two of the three statistics can be constant in the rows
that an estimate rests on; as in regularised estimates of this kind, the variance that a single symbol, repeated word or
letter makes in a text of the group's (geometric) mean length is added to each.

Defined cases: a null text has no words (``base_failed``); null languages and sources are groups of their own; a last
group of fewer than ``LEAST`` rows judges none; copies and ties never make a matrix singular; rows that repeat are judged
alike; an empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, let, text_or_empty, written

#: Words of a window that may repeat.
WINDOW = 5
#: Groups smaller than this are pooled; a pool smaller than LEAST has no estimate.
MIN_GROUP, LEAST = 20, 8
#: Share of the rows that the estimate rests on, and what covariances of that share are multiplied by to be consistent
#: for three normal dimensions: share / P(chi-square with five degrees of freedom < its quantile with three).
SUPPORT, CONSISTENCY = 0.75, 1.61
#: Random starts of four vectors each, besides the medians and all rows; most steps of any start.
STARTS, STEPS = 3, 20
#: Share of ordinary documents that the cutoff may reject, were they normal.
TAIL = 1e-9
#: Units of the integer vectors, and their bound.
SCALE, BOUND = 4096, 16 * 4096
#: Mean word length of so many words is taken as ordinary before a text has any, so that short texts vary no more than long ones.
PRIOR_WORDS, PRIOR_CHARS = 50, 5
DIMS = ("x0", "x1", "x2")
PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
SUMS = ["w", *[f"s{i}" for i in range(3)], *[f"q{i}{j}" for i, j in PAIRS]]
FLOORS = [f"f{i}" for i in range(3)]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def repeat_words(words: Column) -> Column:
    """Number of words inside five-word windows that occur twice or more.

    Windows are compared by a 64-bit hash of their words; only texts with a repeated hash are sorted."""

    def from_hashes(hashes: Column) -> Column:
        def from_sorted(s: Column) -> Column:
            last = F.size(s)
            at = F.filter(
                F.sequence(F.lit(1), last),
                lambda i: ((i > 1) & (F.element_at(s, F.greatest(i - 1, F.lit(1)))["h"] == F.element_at(s, i)["h"]))
                | ((i < last) & (F.element_at(s, F.least(i + 1, last))["h"] == F.element_at(s, i)["h"])),
            )
            starts = F.array_sort(F.transform(at, lambda i: F.element_at(s, i)["p"]))
            # each start covers as far as the next start, at most a window
            state = F.struct(F.lit(-WINDOW).alias("end"), F.lit(0).alias("n"))
            folded = F.aggregate(
                starts,
                state,
                lambda acc, p: F.struct((p + WINDOW).cast("int").alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).cast("int").alias("n")),
            )
            return folded["n"]

        pairs = F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p")))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(F.array_sort(pairs), from_sorted))

    windows = F.transform(F.sequence(F.lit(1), F.size(words) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(let(windows, from_hashes)).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words: one pass, no shuffle."""
    text = text_or_empty()
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    measured = let(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("long"), lambda n, x: n + F.char_length(x)).alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    return docs.select(
        "doc_id",
        "lang",
        "source",
        measured.alias("m"),
        F.regexp_count(text, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
    ).select("doc_id", "lang", "source", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words")


def vectors(stats: DataFrame) -> DataFrame:
    """The transformed statistic vector, in units of 1 / SCALE: log of the smoothed mean word length, and roots of the shares
    of symbols and of repetition."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    x = (
        F.log1p((F.col("word_chars") + PRIOR_WORDS * PRIOR_CHARS) / (F.col("n_words") + PRIOR_WORDS)),
        F.sqrt(F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        F.sqrt((F.col("n_repeat_words") + F.col("n_dup_lines")) / n),
    )
    return stats.withColumns({d: F.least(F.round(c * SCALE), F.lit(BOUND)).cast("long") for d, c in zip(DIMS, x)})


def pooled_groups(passing: DataFrame) -> DataFrame:
    """lang, source -> g: the group whose estimate judges them."""
    sizes = written(passing.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n")), "quality-groups")
    small = sizes.where(F.col("n") < MIN_GROUP).groupBy(F.col("lang").alias("l_")).agg(F.sum("n").alias("pool"))
    named = sizes.join(small, F.col("lang").eqNullSafe(F.col("l_")), "left")
    by_source, by_lang = F.to_json(F.struct("lang", "source")), F.to_json(F.struct("lang"))  # null fields are left out
    g = F.when(F.col("n") >= MIN_GROUP, F.concat(F.lit("source "), by_source)).when(F.col("pool") >= MIN_GROUP, F.concat(F.lit("lang "), by_lang)).otherwise(F.lit("rest"))
    return written(named.select(F.col("lang").alias("lang_"), F.col("source").alias("source_"), g.alias("g")), "quality-pools")


def with_group(rows: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    return rows.join(groups, F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_")), how).drop("lang_", "source_")


def floors(rows: DataFrame) -> DataFrame:
    """g -> f0..f2: squared change, in units, that one letter, one symbol and one repeated word make in a text of mean length."""
    log = lambda c: F.sum(F.round(F.log(F.greatest(F.col(c), F.lit(1))) * 65536).cast("long")) / F.count(F.lit(1)) / 65536
    mean = rows.groupBy("g").agg(F.exp(log("word_chars")).alias("chars"), F.exp(log("n_words")).alias("words"), F.count(F.lit(1)).alias("n"))
    unit = float(SCALE) ** 2
    return mean.where(F.col("n") >= LEAST).select("g", (unit / F.pow("chars", 2)).alias("f0"), (unit / F.col("chars")).alias("f1"), (unit / F.col("words")).alias("f2"))


def middle(values: DataFrame) -> DataFrame:
    """g, dim, x, n -> g, dim, m: the exact (lower) median of integers that come with counts."""
    counts = values.groupBy("g", "dim", "x").agg(F.sum("n").alias("n"))
    here = Window.partitionBy("g", "dim")
    run = counts.withColumn("upto", F.sum("n").over(here.orderBy("x"))).withColumn("total", F.sum("n").over(here))
    return run.where(2 * F.col("upto") >= F.col("total")).groupBy("g", "dim").agg(F.min("x").alias("m"))


def wide(table: DataFrame, value: str, prefix: str) -> DataFrame:
    return table.groupBy("g").agg(*[F.max(F.when(F.col("dim") == i, F.col(value))).alias(f"{prefix}{i}") for i in range(3)])


def with_covariance(sums: DataFrame) -> DataFrame:
    """Adds m0..m2, c00..c22 (with the floors) and det to exact sums."""
    mean = {f"m{i}": F.col(f"s{i}") / F.col("w") for i in range(3)}
    cov = {f"c{i}{j}": F.col(f"q{i}{j}") / F.col("w") - F.col(f"m{i}") * F.col(f"m{j}") + (F.col(f"f{i}") if i == j else 0) for i, j in PAIRS}
    return sums.withColumns({k: c.cast("double") for k, c in mean.items()}).withColumns({k: c.cast("double") for k, c in cov.items()}).withColumn("det", determinant())


def starts(points: DataFrame, floor: DataFrame) -> DataFrame:
    """g, start, m0..m2, c00..c22: medians and median deviations, all rows, and seeded picks of four vectors."""
    long = points.select("g", "n", F.posexplode(F.array(*DIMS)).alias("dim", "x"))
    mid = written(middle(long), "quality-medians")
    near = long.join(mid.withColumnsRenamed({"g": "g_", "dim": "d_"}), (F.col("g") == F.col("g_")) & (F.col("dim") == F.col("d_")))
    mad = middle(near.select("g", "dim", "n", F.abs(F.col("x") - F.col("m")).alias("x")))
    both = wide(mid, "m", "m").join(wide(mad, "m", "d"), "g").join(floor, "g")
    zero = [F.lit(0.0).alias(f"c{i}{j}") for i, j in PAIRS if i != j]
    first = both.select("g", F.lit(0).alias("start"), *[F.col(f"m{i}").cast("double").alias(f"m{i}") for i in range(3)], *[(F.pow(1.4826 * F.col(f"d{i}"), 2) + F.col(f"f{i}")).alias(f"c{i}{i}") for i in range(3)], *zero)
    whole = points.groupBy("g").agg(*totals(F.col("n")))
    picks = [F.min_by(F.struct(*DIMS), F.struct(F.xxhash64(F.lit(4 * k + j), *DIMS), *DIMS)).alias(f"p{k}{j}") for k in range(STARTS) for j in range(4)]
    picked = points.groupBy("g").agg(*picks)
    parts = [whole.withColumn("start", F.lit(1))]
    for k in range(STARTS):
        four = [F.col(f"p{k}{j}") for j in range(4)]
        s = [sum((v[d] for v in four), F.lit(0)).alias(f"s{i}") for i, d in enumerate(DIMS)]
        q = [sum((v[DIMS[i]] * v[DIMS[j]] for v in four), F.lit(0)).alias(f"q{i}{j}") for i, j in PAIRS]
        parts.append(picked.select("g", F.lit(4).alias("w"), *s, *q, F.lit(2 + k).alias("start")))
    sums = reduce(DataFrame.unionByName, [p.select("g", "start", *[F.col(c).cast("decimal(38,0)").alias(c) for c in SUMS]) for p in parts])
    fitted = with_covariance(sums.join(floor, "g"))
    names = ["g", "start", *[f"m{i}" for i in range(3)], *[f"c{i}{j}" for i, j in PAIRS]]
    return first.select(*names).unionByName(fitted.select(*names))


def totals(n: Column) -> list[Column]:
    """Exact weighted sums of counts, values and products."""
    x = [F.col(d) for d in DIMS]
    cols = [n, *[n * v for v in x], *[n * x[i] * x[j] for i, j in PAIRS]]
    return [F.sum(c.cast("decimal(28,0)")).alias(name) for c, name in zip(cols, SUMS)]


def determinant() -> Column:
    a, b, c, d, e, f = (F.col(k) for k in ("c00", "c01", "c02", "c11", "c12", "c22"))
    return a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)


def distance() -> Column:
    """Squared Mahalanobis distance of x0..x2 from m0..m2 under c00..c22: the closed inverse of a 3 x 3 matrix."""
    a, b, c, d, e, f = (F.col(k) for k in ("c00", "c01", "c02", "c11", "c12", "c22"))
    u, v, w = (F.col(x) - F.col(m) for x, m in zip(DIMS, ("m0", "m1", "m2")))
    form = u * u * (d * f - e * e) + v * v * (a * f - c * c) + w * w * (a * d - b * b)
    form = form + 2 * (u * v * (c * e - b * f) + u * w * (b * e - c * d) + v * w * (b * c - a * e))
    return F.when(form.isNotNull(), F.greatest(form / determinant(), F.lit(0.0)))


def concentrated(points: DataFrame, now: DataFrame, floor: DataFrame) -> DataFrame:
    """One step of every start: fits again to the vectors in the lowest bins of distance that hold SUPPORT of the rows.
    Bins are fine (two in a thousand), so sums per bin and a running count over bins give it in one pass."""
    right = now.withColumnRenamed("g", "g_")
    bins = points.join(right, F.col("g") == F.col("g_")).withColumn("bin", F.floor(512 * F.log1p(distance())))
    bins = bins.groupBy("g", "start", "bin").agg(*totals(F.col("n")))
    here = Window.partitionBy("g", "start")
    before = F.coalesce(F.sum("w").over(here.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    near = bins.withColumn("before", before).withColumn("all", F.sum("w").over(here)).where(F.col("before") < F.ceil(F.col("all") * SUPPORT))
    sums = near.groupBy("g", "start").agg(*[F.sum(c).cast("decimal(38,0)").alias(c) for c in SUMS])
    return with_covariance(sums.join(floor, "g"))


def estimates(rows: DataFrame) -> DataFrame:
    """rows: g, n_words, word_chars, x0..x2 -> g, m0..m2, c00..c22, det, start, steps of the best start."""
    points = written(rows.groupBy("g", *DIMS).agg(F.count(F.lit(1)).alias("n")), "quality-points")
    floor = written(floors(rows), "quality-floors")
    now = written(starts(points, floor), "quality-starts")
    before = None
    for step in range(STEPS):
        now = written(concentrated(points, now, floor), f"quality-step-{step}")
        if before is not None and now.select("g", "start", *SUMS).exceptAll(before.select("g", "start", *SUMS)).isEmpty():
            break
        before = now
    keep = ["start", "det", *[f"m{i}" for i in range(3)], *[f"c{i}{j}" for i, j in PAIRS]]
    best = now.groupBy("g").agg(F.min_by(F.struct(*keep), F.struct("det", "start")).alias("b"))
    return written(best.select("g", "b.*"), "quality-estimates")


def chi_square_cutoff(tail: float = TAIL) -> float:
    """The point that a chi-square variable with three degrees of freedom exceeds with the given probability."""
    low, high = 0.0, 1000.0
    for _ in range(200):
        x = (low + high) / 2
        above = math.erfc(math.sqrt(x / 2)) + math.sqrt(2 * x / math.pi) * math.exp(-x / 2)
        low, high = (x, high) if above > tail else (low, x)
    return low


def judged(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The statistics with base_failed, g, d2 (squared distance) and kept."""
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = written(vectors(statistics(docs)).withColumn("base_failed", failed), "quality-stats")
    passing = stats.where(~F.col("base_failed"))
    groups = pooled_groups(passing.select("lang", "source"))
    best = estimates(with_group(passing, groups, "inner").select("g", "n_words", "word_chars", *DIMS))
    known = groups.join(best.withColumnRenamed("g", "g_"), F.col("g") == F.col("g_"), "left").drop("g_")
    out = with_group(stats, known, "left").withColumn("d2", distance() / CONSISTENCY)
    return out.withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("d2") <= chi_square_cutoff(tail), F.lit(True)))


def op7_quality_rules(docs: DataFrame, **options) -> DataFrame:
    return judged(docs, **options).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "d2")
