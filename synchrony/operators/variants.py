"""Comparing variants of one recording: delay levels, dips, scene fingerprints and content groups."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.tokens import jaccard
from ..sources.shared import large, settled
from .timejoin import bucketed_range_join


def plan_pairs(variants: DataFrame) -> DataFrame:
    """Pairs of delay levels to compare: 1v3 and 1v5 where both exist, 3v5 only without level 1, and each level against
    the baseline 0."""
    a, b = variants.select("set_name", F.col("delay_level").alias("a"), F.col("video_id").alias("video_a")), variants.select("set_name", F.col("delay_level").alias("b"), F.col("video_id").alias("video_b"))
    has = variants.groupBy("set_name").agg(F.max(F.col("delay_level") == 1).alias("has1"))
    pairs = a.join(b, "set_name").join(has, "set_name").where("a < b")
    kind = F.when(F.col("a") == 0, "baseline").otherwise("inter")
    keep = (F.col("a").isin(0, 1)) | ((F.col("a") == 3) & ~F.col("has1"))
    return pairs.where(keep).select("set_name", F.concat_ws("v", F.col("a").cast("string"), F.col("b").cast("string")).alias("pair"), "video_a", "video_b", kind.alias("kind"), (F.col("b") - F.col("a")).cast("double").alias("expected_delay"))


def cluster_dips(dips: DataFrame, gap: float = 3.0) -> DataFrame:
    """dips: set_name, pair, kind, center, duration. Centres of all pairs of a set, chained while close, with the pairs that
    show the point, the numbers of dips between variants and against the baseline, the confidence they give, and the delay
    that each level has there (``delays``: level to seconds).

    Delays come from dips between variants only, of each pair the last one in the cluster. They are laid over each other
    in the order 1v3, 1v5, 3v5, so a later pair's word on a level stands; half steps round to even."""
    w = Window.partitionBy("set_name").orderBy("center", "pair", "duration")
    rows = dips.withColumn("new_", F.coalesce(F.col("center") - F.lag("center").over(w) > gap, F.lit(True)).cast("long"))
    rows = rows.withColumn("cluster", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inter = F.col("kind") == "inter"
    last = lambda pair: F.max_by("duration", F.when(inter & (F.col("pair") == pair), F.struct("center", "duration")))
    per = rows.groupBy("set_name", "cluster").agg(
        F.avg("center").alias("t"),
        F.array_join(F.array_sort(F.collect_set("pair")), ",").alias("evidence"),
        F.count_if(inter).alias("n_inter"),
        F.count_if(F.col("kind") == "baseline").alias("n_baseline"),
        last("1v3").alias("d13"),
        last("1v5").alias("d15"),
        last("3v5").alias("d35"),
    )
    level = F.when(F.col("n_inter") >= 2, "high").when(F.col("n_inter") == 1, "medium").otherwise("low")
    # later pairs first: what they say of a level stands
    told = {1: [F.col("d15") / 4, F.col("d13") / 2], 3: [F.col("d35") / 2 * 3, F.col("d13") / 2 * 3], 5: [F.col("d35") / 2 * 5, F.col("d15") / 4 * 5]}
    entries = F.array(*[F.struct(F.lit(k).alias("key"), F.bround(F.coalesce(*x), 1).alias("value")) for k, x in told.items()])
    delays = F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))
    return per.withColumns({"confidence": level, "delays": delays}).drop("d13", "d15", "d35")


def delay_summary(clusters: DataFrame) -> DataFrame:
    times = F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: F.format_string("%.1f", t + 1e-9)), ", ")
    return clusters.groupBy("set_name").agg(F.count(F.lit(1)).alias("n_delays"), times.alias("times"), F.bool_and(F.col("confidence") == "high").alias("all_high"))


#: A pair of scenes needs more than this score.
LEAST_SCORE = 0.05


def fingerprint_pairs(a: DataFrame, b: DataFrame, gap: float = 20.0) -> DataFrame:
    """Scenes of two recordings (set_name, scene_id, t, words; those of b may carry a label) with their match score:
    similarity of words times nearness; scenes without words match within 5 s by nearness alone, at half weight. Nearness
    is a bell of half the gap; beyond the time at which a perfect match falls to the least score no pair can count."""
    reach = gap / 2 * math.sqrt(2 * math.log(1 / LEAST_SCORE)) + 1e-6
    label = ["label"] if "label" in b.columns else []
    left = a.select("set_name", F.col("scene_id").alias("a_id"), F.col("t").alias("a_t"), F.col("words").alias("a_w"))
    right = b.select("set_name", *label, F.col("scene_id").alias("b_id"), F.col("t").alias("b_t"), F.col("words").alias("b_w"))
    met = bucketed_range_join(left, right, F.col("a_t") - reach, F.col("a_t") + reach, "b_t", reach, ("set_name",))
    sim, near = jaccard(F.col("a_w"), F.col("b_w")), S.bell(F.col("b_t") - F.col("a_t"), gap / 2)
    empty = (F.size("a_w") == 0) & (F.size("b_w") == 0)
    score = F.when(empty, F.when(F.abs(F.col("b_t") - F.col("a_t")) <= 5, 0.5 * near).otherwise(0.0)).when(sim < 0.1, 0.0).otherwise(sim * near)
    return met.withColumn("score", F.round(score, 12)).where(F.col("score") > LEAST_SCORE).select("set_name", *label, "a_id", "b_id", "a_t", "b_t", "score")


#: Rounds of mutually best pairs before the rest is finished island by island.
ROUNDS = 6


def greedy(pairs: DataFrame, keys: tuple[str, ...], order: list[Column], rounds: int = ROUNDS) -> DataFrame:
    """One-to-one matching of a_id and b_id inside the keys, pairs taken one by one in the order given, which must be total.

    Pairs that are first for both their ends are what that walk takes too: they are taken, their ends leave, and so on for
    a bounded number of rounds. A chain of pairs, each waiting for the one before it, would need a round per link; what
    the rounds leave is cut into islands, stretches of time that no remaining pair spans, and each island is walked in
    order from sorted partitions, holding the ends it has used."""
    taken: list[DataFrame] = []
    rest, end = pairs, lambda side: Window.partitionBy(*keys, side).orderBy(*order)
    for _ in range(rounds):
        ranked = rest.withColumn("ra_", F.row_number().over(end("a_id"))).withColumn("rb_", F.row_number().over(end("b_id")))
        ranked = settled(ranked.withColumn("now_", (F.col("ra_") == 1) & (F.col("rb_") == 1)).drop("ra_", "rb_"), "greedy-round")
        now = ranked.where("now_").drop("now_")
        if now.isEmpty():
            return reduce(DataFrame.unionByName, taken) if taken else now
        taken.append(now)
        used = lambda side: now.select(*keys, side)
        rest = ranked.where("not now_").drop("now_").join(large(used("a_id")), [*keys, "a_id"], "left_anti").join(large(used("b_id")), [*keys, "b_id"], "left_anti")
    return reduce(DataFrame.unionByName, [*taken, walked(settled(rest, "greedy-rest"), keys, order)])


def walked(pairs: DataFrame, keys: tuple[str, ...], order: list[Column]) -> DataFrame:
    low, high = F.least("a_t", "b_t"), F.greatest("a_t", "b_t")
    w = Window.partitionBy(*keys).orderBy(low, high)
    rows = pairs.withColumn("new_", F.coalesce(low > F.max(high).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(True)).cast("long"))
    rows = rows.withColumn("island_", F.sum("new_").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new_")
    names, groups = pairs.columns, [*keys, "island_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, a_used, b_used = None, set(), set()
        for batch in batches:
            good = []
            for key, a, b in zip(zip(*(batch.column(c).to_pylist() for c in groups)), batch.column("a_id").to_pylist(), batch.column("b_id").to_pylist()):
                if key != group:
                    group, a_used, b_used = key, set(), set()
                good.append(a not in a_used and b not in b_used)
                if good[-1]:
                    a_used.add(a), b_used.add(b)
            yield batch.filter(pa.array(good, pa.bool_())).select(names)

    return rows.repartition(*groups).sortWithinPartitions(*groups, *order).mapInArrow(run, pairs.schema)


def scene_matches(reference: DataFrame, others: DataFrame, gap: float = 20.0) -> DataFrame:
    """Scenes of a reference (set_name, scene_id, t, words) against those of several recordings (and label): each reference
    scene takes at most one scene of every recording, each scene of a recording goes to one reference scene, best
    scores first. -> set_name, label, a_id, b_id, a_t, b_t, score."""
    return greedy(fingerprint_pairs(reference, others, gap), ("set_name", "label"), [F.col("score").desc(), F.col("a_id").asc(), F.col("b_id").asc()])


def group_leftovers(scenes: DataFrame, labels: list[str], gap: float = 20.0) -> DataFrame:
    """Scenes (set_name, label, scene_id, t, words) that no reference scene took, grouped among the recordings in the order
    of ``labels``: each scene that is not yet in a group heads one, in the order of its recording, and takes from every
    later recording its best scene that is still free. So a group holds at most one scene of a recording.
    -> set_name, head_label, head_id, label, scene_id.

    Heads of one recording choose one after another; for each later recording that is a matching in the order of heads,
    then scores, so the recordings of a set are gone through in turn (as many passes as labels) and not the scenes."""
    free, groups = settled(scenes, "leftovers"), []
    for i, label in enumerate(labels):
        heads, rest = free.where(F.col("label") == label), free.where(F.col("label").isin(labels[i + 1 :]))
        groups.append(heads.select("set_name", F.col("label").alias("head_label"), F.col("scene_id").alias("head_id"), "label", "scene_id"))
        if i == len(labels) - 1:
            break
        taken = greedy(fingerprint_pairs(heads.drop("label"), rest, gap), ("set_name", "label"), [F.col("a_id").asc(), F.col("score").desc(), F.col("b_id").asc()])
        taken = settled(taken.select("set_name", F.lit(label).alias("head_label"), F.col("a_id").alias("head_id"), "label", F.col("b_id").alias("scene_id")), "leftover-groups")
        groups.append(taken)
        free = settled(rest.join(large(taken.select("set_name", "label", "scene_id")), ["set_name", "label", "scene_id"], "left_anti"), "leftovers")
    return reduce(DataFrame.unionByName, groups)


def content_groups(reference: DataFrame, others: DataFrame, labels: list[str], name: str = "ref", gap: float = 20.0) -> DataFrame:
    """All content groups of a set: every reference scene heads one, alone if nothing matches it, and the leftovers of the
    other recordings (in the order of ``labels``) have their own. -> set_name, head_label, head_id, label, scene_id, t, words."""
    matched = settled(scene_matches(reference, others, gap), "scene-matches")
    left = others.join(large(matched.select("set_name", "label", F.col("b_id").alias("scene_id"))), ["set_name", "label", "scene_id"], "left_anti")
    own = reference.select("set_name", F.lit(name).alias("label"), "scene_id", "t", "words")
    heads = own.select("set_name", F.col("label").alias("head_label"), F.col("scene_id").alias("head_id"), "label", "scene_id")
    taken = matched.select("set_name", F.lit(name).alias("head_label"), F.col("a_id").alias("head_id"), "label", F.col("b_id").alias("scene_id"))
    groups = heads.unionByName(taken).unionByName(group_leftovers(left, labels, gap))
    return groups.join(large(own.unionByName(others.select(*own.columns))), ["set_name", "label", "scene_id"]).select("set_name", "head_label", "head_id", "label", "scene_id", "t", "words")


GROUP = ["set_name", "head_label", "head_id"]


def comparison_table(groups: DataFrame, align: DataFrame, labels: list[str], n_words: int = 8) -> DataFrame:
    """groups: as ``content_groups`` gives them; align: set_name, label, scene_id, event_id, delta_t, match_track, of which a
    scene's first event counts. One row per content group: its first words, each recording's scene, time, gap and track
    ("missing" without a scene, "?" without an event), how far times and gaps are apart, and in how many recordings it is."""
    first = align.groupBy("set_name", "label", "scene_id").agg(F.min_by(F.struct("delta_t", F.coalesce("match_track", F.lit("?")).alias("track")), "event_id").alias("e"))
    rows = groups.join(large(first), ["set_name", "label", "scene_id"], "left").select(*GROUP, "label", "scene_id", "t", "words", "e.delta_t", F.coalesce("e.track", F.lit("?")).alias("track"))
    rows = settled(rows, "comparison-rows")
    wide = rows.groupBy(*GROUP).pivot("label", labels).agg(F.min("scene_id").alias("sid"), F.round(F.min("t"), 2).alias("tvis"), F.round(F.min("delta_t"), 2).alias("dt"), F.coalesce(F.min("track"), F.lit("missing")).alias("track"))
    wide = wide.withColumns({f"{x}_track": F.coalesce(f"{x}_track", F.lit("missing")) for x in labels})
    spread = lambda c: F.round(F.coalesce(F.max(c) - F.min(c), F.lit(0.0)), 2)
    # words of a group: at most one scene of each recording
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_list("words"))))
    stats = rows.groupBy(*GROUP).agg(words.alias("w_"), spread("t").alias("tvis_shift"), spread("delta_t").alias("dt_spread"), F.count_distinct("label").alias("n_videos"))
    stats = stats.withColumn("content_words", F.when(F.size("w_") > 0, F.array_join(F.slice("w_", 1, n_words), " ")).otherwise("(no text)")).drop("w_")
    return wide.join(large(stats), GROUP)


def with_visual_spread(table: DataFrame, delays: DataFrame) -> DataFrame:
    """+ visual_delay_spread: how far the delays of a group's pictures are apart over the compared recordings. delays:
    set_name, head_label, head_id, label, visual_delay (null where no picture was found)."""
    per = delays.groupBy(*GROUP).agg((F.max("visual_delay") - F.min("visual_delay")).alias("visual_delay_spread"))
    return table.join(large(per), GROUP, "left")


def delay_points(table: DataFrame, shift: float = 0.5, visual: float = 0.5, top: int = 10) -> DataFrame:
    """Of every set the groups whose scenes begin further apart than ``shift``, or whose pictures come further apart than
    ``visual`` where the table has that spread; the ``top`` largest by visual spread, else by shift."""
    seen = "visual_delay_spread" in table.columns
    flag = F.col("tvis_shift") > shift
    if seen:
        flag = flag | F.coalesce(F.col("visual_delay_spread") > visual, F.lit(False))
    order = F.col("visual_delay_spread" if seen else "tvis_shift").desc_nulls_last()
    w = Window.partitionBy("set_name").orderBy(order, "head_label", "head_id")
    return table.where(flag).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def variant_diff(a: DataFrame, b: DataFrame, keys: tuple[str, ...] = ("keyword_id",)) -> DataFrame:
    """Full outer join of two variants' keyword gaps with the side that has each; with more keys, of many pairs at once."""
    left = a.select(*keys, F.col("delta_t").alias("dt_a"), F.lit(True).alias("in_a"))
    right = b.select(*keys, F.col("delta_t").alias("dt_b"), F.lit(True).alias("in_b"))
    rows = left.join(right, list(keys), "full_outer")
    side = F.when(F.col("in_a").isNull(), "b").when(F.col("in_b").isNull(), "a").otherwise("both")
    return rows.select(*keys, "dt_a", "dt_b", (F.col("dt_b") - F.col("dt_a")).alias("shift"), side.alias("side"))
