"""Agreement of ratings: ranks, correlations, kappas, intraclass correlation, and comparisons of tiers and recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..sources.shared import large


def value_ranks(cells: DataFrame, column: str, keys: list[str], name: str) -> DataFrame:
    """keys, column, name: the average rank of each distinct value inside its group, less the mean rank, from a table of
    counts (n). Values are put in order, not rows."""
    per = cells.groupBy(*keys, column).agg(F.sum("n").alias("n_"))
    below = Window.partitionBy(*keys).orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    rank = F.sum("n_").over(below) - (F.col("n_") - 1) / 2 - (F.sum("n_").over(Window.partitionBy(*keys)) + 1) / 2
    return per.select(*keys, column, rank.alias(name))


def rating_pairs(ratings: DataFrame) -> DataFrame:
    """All pairs of tiers of each recording on the same segment. There are a handful of tiers, so each row meets a few."""
    a = ratings.select("video_id", "segment_id", F.col("tier").alias("tier_a"), F.col("importance").alias("a"))
    b = ratings.select("video_id", "segment_id", F.col("tier").alias("tier_b"), F.col("importance").alias("b"))
    return a.join(b, ["video_id", "segment_id"]).where("tier_a < tier_b")


def spearman(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman's correlation of a and b inside each group, with average ranks; pairs with a null do not take part. Rows
    are counted by their values first, so a group costs as many cells as it has value pairs; null where one side does not
    vary."""
    cells = pairs.where(F.col("a").isNotNull() & F.col("b").isNotNull()).groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    rows = cells.join(large(value_ranks(cells, "a", keys, "ra")), [*keys, "a"]).join(large(value_ranks(cells, "b", keys, "rb")), [*keys, "b"])
    s = lambda x, y: F.sum(F.col("n") * F.col(x) * F.col(y))
    per = rows.groupBy(*keys).agg(s("ra", "rb").alias("ab_"), s("ra", "ra").alias("aa_"), s("rb", "rb").alias("bb_"), F.sum("n").alias("n"))
    return per.select(*keys, F.try_divide(F.col("ab_"), F.sqrt(F.col("aa_")) * F.sqrt(F.col("bb_"))).alias("spearman"), "n")


def srocc_by_strata(pairs: DataFrame, strata: list[str]) -> DataFrame:
    """Spearman correlation inside every value of every stratum, in one pass: a pair counts once per stratum."""
    each = F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(s).cast("string").alias("value")) for s in strata])
    rows = pairs.select("a", "b", F.explode(each).alias("s")).select("a", "b", "s.*")
    return spearman(rows, ["stratum", "value"])


def kendall_tau_b(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Kendall's tau-b from the table of counts of value pairs: ratings have five values, so cells are few however many
    rows there are."""
    cells = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    x, y = cells.select(*keys, "a", "b", "n"), cells.select(*keys, F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("n").alias("n2"))
    met = x.join(y, keys)
    sign = F.signum(F.col("a") - F.col("a2")) * F.signum(F.col("b") - F.col("b2"))
    pairs_of = F.col("n") * F.col("n2")
    s = met.groupBy(*keys).agg(F.sum(sign * pairs_of).alias("s"), F.sum(F.when(F.col("a") != F.col("a2"), pairs_of).otherwise(0)).alias("ta"), F.sum(F.when(F.col("b") != F.col("b2"), pairs_of).otherwise(0)).alias("tb"))
    return s.select(*keys, F.try_divide(F.col("s"), F.sqrt(F.col("ta").cast("double") * F.col("tb"))).alias("tau_b"))


def exact_and_near(pairs: DataFrame, keys: list[str]) -> DataFrame:
    d = F.abs(F.col("a") - F.col("b"))
    return pairs.groupBy(*keys).agg((100 * F.avg((d == 0).cast("double"))).alias("exact"), (100 * F.avg((d <= 1).cast("double"))).alias("within_one"), F.count(F.lit(1)).alias("n"))


def tier_score_table(scores: DataFrame, tiers: list[str]) -> DataFrame:
    """video_id, tier, score -> one row per recording with each tier's score, their mean and deviation, and whether the
    tiers agree on the grade."""
    wide = scores.groupBy("video_id").pivot("tier", tiers).agg(F.first("score"))
    stats = scores.withColumn("g_", S.grade(F.col("score"))).groupBy("video_id").agg(F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), (F.count_distinct("g_") == 1).alias("same_grade"))
    return wide.join(stats, "video_id")


def rating_distribution(ratings: DataFrame) -> DataFrame:
    wide = ratings.groupBy("video_id", "tier").pivot("importance", [1, 2, 3, 4, 5]).count().fillna(0)
    return wide.withColumnsRenamed({str(i): f"n_{i}" for i in range(1, 6)})


def largest_disagreements(pairs: DataFrame, least: int = 2, top: int = 20) -> DataFrame:
    rows = pairs.withColumn("gap", F.abs(F.col("a") - F.col("b"))).where(F.col("gap") >= least)
    return rows.orderBy(F.col("gap").desc(), "video_id", "segment_id", "tier_a", "tier_b").limit(top)


def series_monotonic(scores: DataFrame) -> DataFrame:
    """set_name, delay_level, video_id, score: whether the score falls with the delay, the spread, the ranking."""
    w = Window.partitionBy("set_name").orderBy("delay_level")
    rows = scores.withColumn("falls_", F.coalesce(F.col("score") <= F.lag("score").over(w), F.lit(True)))
    ranked = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "video_id"))), lambda x: x["video_id"]), " > ")
    return rows.groupBy("set_name").agg(F.bool_and("falls_").alias("monotonic"), (F.max("score") - F.min("score")).alias("spread"), ranked.alias("ranking"))


def version_compare(old: DataFrame, new: DataFrame) -> DataFrame:
    """video_id, score, coverage of two versions."""
    a, b = old.select("video_id", F.col("score").alias("old_score"), F.col("coverage").alias("old_coverage")), new.select("video_id", F.col("score").alias("new_score"), F.col("coverage").alias("new_coverage"))
    return a.join(b, "video_id").select("video_id", "old_score", "new_score", (F.col("new_score") - F.col("old_score")).alias("score_delta"), (F.col("new_coverage") - F.col("old_coverage")).alias("coverage_delta"))


def insights(videos: DataFrame) -> DataFrame:
    """Findings over recordings: video_id, overall_score, coverage_pct, case_a_pct, late_pct, mismatch_pct, median_lead,
    segment_pct. One aggregation finds the extremes; each rule that holds gives a row."""
    top = lambda c: F.max_by(F.struct("video_id", c), F.struct(c, F.col("video_id")))
    low = lambda c: F.min_by(F.struct("video_id", c), F.struct(c, F.col("video_id")))
    cols = ("overall_score", "coverage_pct", "late_pct", "segment_pct")
    one = videos.agg(
        *[top(c).alias(f"hi_{c}") for c in cols], *[low(c).alias(f"lo_{c}") for c in cols],
        F.count_if(F.col("case_a_pct") > 60).alias("n_high_a"), F.count_if(F.col("case_a_pct") < 40).alias("n_low_a"), F.avg("mismatch_pct").alias("mismatch"), F.count_if(F.col("median_lead") > 5).alias("n_far"), F.count_if(F.col("median_lead") < 2).alias("n_near"),
    )
    spread = lambda c: F.col(f"hi_{c}.{c}") - F.col(f"lo_{c}.{c}")
    kind = F.when(spread("overall_score") < 5, "similar_scores").when(spread("overall_score") > 20, "wide_score_spread").otherwise("score_spread")
    none = F.lit(None).cast("string")
    row = lambda name, test, value, video: F.when(test, F.struct(name.alias("finding"), value.cast("double").alias("value"), video.alias("video_id")))
    rules = [
        row(kind, F.lit(True), spread("overall_score"), F.col("hi_overall_score.video_id")),
        row(F.lit("coverage_varies"), spread("coverage_pct") > 10, spread("coverage_pct"), F.col("hi_coverage_pct.video_id")),
        row(F.lit("case_a_dominant"), F.col("n_high_a") > 0, F.col("n_high_a"), none),
        row(F.lit("case_a_rare"), F.col("n_low_a") > 0, F.col("n_low_a"), none),
        row(F.when(F.col("hi_late_pct.late_pct") > 20, "late_visuals").otherwise("few_late_visuals"), F.lit(True), F.col("hi_late_pct.late_pct"), F.col("hi_late_pct.video_id")),
        row(F.lit("vocabulary_mismatch"), F.col("mismatch") > 60, F.col("mismatch"), none),
        row(F.lit("pacing_differs"), (F.col("n_far") > 0) & (F.col("n_near") > 0), F.col("n_far"), none),
        row(F.lit("segment_coverage_gap"), spread("segment_pct") > 15, spread("segment_pct"), F.col("lo_segment_pct.video_id")),
    ]
    return one.select(F.explode(F.array_compact(F.array(*rules))).alias("x")).select("x.*")


def recommendations(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """Advice per recording: important segments without any match, late and slightly late visuals, keywords with nothing
    on screen or other words, and visuals that stand long before. rows: scored keywords; segments: their roll-up."""
    a = segments.where("match_rate = 0 and importance >= 4").select("video_id", F.lit("important_unsupported").alias("rule"), F.col("segment_id").alias("subject"), F.col("n_keywords").cast("double").alias("value"))
    late = rows.where(F.col("match_case").isin("B", "C"))
    gap = late.select("video_id", F.when(F.col("delta_t") > 3, "late_visual").when(F.col("delta_t") > 1, "minor_lag").alias("rule"), F.col("keyword_id").alias("subject"), F.col("delta_t").alias("value")).where("rule is not null")
    none = F.lit(None).cast("long").alias("subject")
    reason = rows.where("match_case = 'F'").groupBy("video_id", "match_method").agg(F.count(F.lit(1)).cast("double").alias("value"))
    words = F.when(F.col("match_method") == "no_ocr_nearby", "visual_coverage").when(F.col("match_method") == "ocr_vocabulary_mismatch", "vocabulary_mismatch")
    some = reason.select("video_id", words.alias("rule"), none, "value").where("rule is not null")
    lead = rows.where(F.col("match_case").isin("A", "D")).groupBy("video_id").agg((100 * F.avg((-F.col("delta_t") > 10).cast("double"))).alias("value")).where("value > 20").select("video_id", F.lit("pacing").alias("rule"), none, "value")
    return a.unionByName(gap).unionByName(some).unionByName(lead)


# --- rater study ------------------------------------------------------------------------------------------------------


def rater_stringency(ratings: DataFrame, low: int = 0, high: int = 5) -> DataFrame:
    """rater, delay_level, rating: mean at both ends and their difference."""
    wide = ratings.where(F.col("delay_level").isin(low, high)).groupBy("rater").agg(F.avg(F.when(F.col("delay_level") == low, F.col("rating"))).alias("mean_low"), F.avg(F.when(F.col("delay_level") == high, F.col("rating"))).alias("mean_high"))
    return wide.withColumn("drop", F.col("mean_low") - F.col("mean_high"))


def fleiss_kappa(ratings: DataFrame) -> DataFrame:
    """Items with the same number of raters; of other items none is dropped: shares are taken by item."""
    n = ratings.groupBy("item", "rating").agg(F.count(F.lit(1)).alias("n"))
    item = n.groupBy("item").agg(F.sum("n").alias("r"), F.sum(F.col("n") * F.col("n")).alias("q")).where("r > 1")
    p = item.agg(F.avg((F.col("q") - F.col("r")) / (F.col("r") * (F.col("r") - 1))).alias("p"))
    total = ratings.agg(F.count(F.lit(1)).alias("t"))
    share = ratings.groupBy("rating").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.lit(0)).join(F.broadcast(total.withColumn("k", F.lit(0))), "k").agg(F.sum(F.pow(F.col("n") / F.col("t"), 2)).alias("e"))
    both = p.withColumn("k", F.lit(0)).join(F.broadcast(share.withColumn("k", F.lit(0))), "k")
    return both.select(((F.col("p") - F.col("e")) / (1 - F.col("e"))).alias("kappa"))


def icc_2k(ratings: DataFrame) -> DataFrame:
    """Two-way random effects, average of k raters, absolute agreement; from sums of squares of a complete table."""
    item = ratings.groupBy("item").agg(F.sum("rating").alias("s"))
    rater = ratings.groupBy("rater").agg(F.sum("rating").alias("s"))
    one = lambda df: df.withColumn("k_", F.lit(0))
    t = ratings.agg(F.count(F.lit(1)).alias("nk"), F.sum("rating").alias("total"), F.sum(F.col("rating") * F.col("rating")).alias("sq"))
    i = item.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s") * F.col("s")).alias("i2"))
    r = rater.agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("s") * F.col("s")).alias("r2"))
    x = one(t).join(one(i), "k_").join(one(r), "k_")
    c = F.col("total") * F.col("total") / F.col("nk")
    ssr, ssc = F.col("i2") / F.col("k") - c, F.col("r2") / F.col("n") - c
    sse = F.col("sq") - c - ssr - ssc
    msr, msc, mse = ssr / (F.col("n") - 1), ssc / (F.col("k") - 1), sse / ((F.col("n") - 1) * (F.col("k") - 1))
    return x.select((F.col("n")).alias("n_items"), F.col("k").alias("n_raters"), F.try_divide(msr - mse, msr + (msc - mse) / F.col("n")).alias("icc_2k"))


def cohen_kappa(pairs: DataFrame, keys: list[str], weighted: bool = False) -> DataFrame:
    """pairs: keys, a, b. Weighted: disagreement grows with the square of the distance."""
    cells = pairs.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    cells = cells.withColumn("t", F.sum("n").over(w))
    a = cells.groupBy(*keys, "a").agg((F.sum("n") / F.max("t")).alias("pa"))
    b = cells.groupBy(*keys, "b").agg((F.sum("n") / F.max("t")).alias("pb"))
    cost = lambda x, y: F.pow(x - y, 2).cast("double") if weighted else (x != y).cast("double")
    seen = cells.groupBy(*keys).agg(F.sum(F.col("n") / F.col("t") * cost(F.col("a"), F.col("b"))).alias("seen"))
    chance = a.join(b, keys).groupBy(*keys).agg(F.sum(F.col("pa") * F.col("pb") * cost(F.col("a"), F.col("b"))).alias("chance"))
    return seen.join(chance, keys).select(*keys, (1 - F.try_divide("seen", "chance")).alias("kappa"))


def curation_robustness(ratings: DataFrame, excluded: DataFrame) -> DataFrame:
    """Mean rating of all items, of those kept and of those excluded."""
    flag = excluded.select("item").distinct().withColumn("out_", F.lit(True))
    rows = ratings.join(flag, "item", "left")
    return rows.agg(F.avg("rating").alias("mean_all"), F.avg(F.when(F.col("out_").isNull(), F.col("rating"))).alias("mean_kept"), F.avg(F.when(F.col("out_"), F.col("rating"))).alias("mean_excluded"), F.count_if("out_").alias("n_excluded"))


def principle_concordance(rows: DataFrame) -> DataFrame:
    """item, rater, principles (joined by ;): how many raters named each principle for an item, and their share."""
    n = rows.groupBy("item").agg(F.count_distinct("rater").alias("n_raters"))
    named = rows.select("item", "rater", F.explode(F.split("principles", r"\s*;\s*")).alias("principle")).where("principle <> ''")
    per = named.groupBy("item", "principle").agg(F.count_distinct("rater").alias("n"))
    return per.join(n, "item").select("item", "principle", "n", (F.col("n") / F.col("n_raters")).alias("share"))
