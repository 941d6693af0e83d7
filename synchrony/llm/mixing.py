"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length; per source, whole passes and a proportional share of every length
are taken first, a bounded-knapsack dynamic programme over the length counts spends what is left of the budget, and
documents are then drawn by seeded order until every length has its count.

Defined cases: a null text has length 0 and is never taken; a null source is one source, last in order; an empty
table gives an empty result; repeated rows are separate documents; sources whose size is 0 have target 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, columns_of, unused, written

#: A source is taken at most so many times.
MAX_PASSES = 3
#: The dynamic programme runs over at most so many words; a longer rest is first cut down, longest documents first.
DP_WORDS = 1 << 16
#: Each (source, length) group is dealt into so many hash ranges before documents are ranked.
RANGES = 4096


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size: number of words of each document."""
    return docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """source, source_size, target: weights repeat over the sources in code-point order; what a capped source cannot
    take is shared again by weight. One row per source, so the running sums work on the aggregate only."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    index = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (index + 1).cast("int")).cast("double"))
    cap = F.lit(float(MAX_PASSES)) * F.col("source_size")
    up = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("w"))
    per = (
        per.withColumn("total", F.sum("source_size").over(every))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        # the level if all smaller ratios are capped and the rest shares by weight
        .withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("w_left"))
        .withColumn("open_level", F.when(F.col("ratio") >= F.col("level"), F.col("level")))
        .withColumn("lam", F.first("open_level", ignorenulls=True).over(Window.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    )
    return per.select("source", "source_size", F.when(F.col("ratio") <= F.coalesce("lam", "ratio"), F.col("cap")).otherwise(F.col("lam") * F.col("w")).alias("target"))


def subset_sum(budget: int, items: list[tuple[int, int]]) -> dict[int, int]:
    """How many of each length sum up closest to the budget without going over it; items: (length, count)."""
    reach, mask, steps = 1, (1 << (budget + 1)) - 1, []
    for length, count in items:
        part = 1
        while count > 0 and not reach >> budget & 1:
            n = min(part, count)
            if n * length > budget:
                break
            steps.append((length, n, reach))
            reach |= reach << (n * length) & mask
            count -= n
            part *= 2
    at, chosen = reach.bit_length() - 1, {}
    for length, n, earlier in reversed(steps):
        if not earlier >> at & 1:
            chosen[length] = chosen.get(length, 0) + n
            at -= n * length
    return chosen


def fit_source(group: pd.DataFrame) -> pd.DataFrame:
    """One source's length counts (distinct lengths only: at most the root of twice its words) -> how many to take."""
    total, target = int(group["source_size"].iloc[0]), float(group["target"].iloc[0])
    group = group.sort_values("size", ascending=False, kind="stable")
    want = round(target)
    passes = min(MAX_PASSES, want // total) if total else 0
    rest = want - passes * total if passes < MAX_PASSES else 0
    lengths, counts = group["size"].tolist(), group["n"].tolist()
    take = [n * rest // total if total and size else 0 for size, n in zip(lengths, counts)]
    rest -= sum(size * k for size, k in zip(lengths, take))
    for i, size in enumerate(lengths):
        if rest > DP_WORDS and size:
            k = min(counts[i] - take[i], -(-(rest - DP_WORDS) // size), rest // size)
            take[i] += k
            rest -= k * size
    if 0 < rest <= DP_WORDS:
        chosen = subset_sum(rest, [(size, n - k) for size, n, k in zip(lengths, counts, take) if 0 < size <= rest and n > k])
        take = [k + chosen.get(size, 0) for size, k in zip(lengths, take)]
    return pd.DataFrame({"source": group["source"].to_numpy(), "size": lengths, "passes": passes, "take": take, "source_size": total, "target": target})


FIT = "source string, size long, passes long, take long, source_size long, target double"


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, source, size, source_size, target, copies: how often the mix takes each document."""
    sizes = written(sized(docs), "mix-sizes")
    counts = sizes.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = source_targets(sizes, weights)
    plan = counts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").groupBy("source").applyInPandas(fit_source, FIT)
    plan = written(plan, "mix-plan")
    drawn = sizes.withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("r", F.shiftrightunsigned("h", 64 - RANGES.bit_length() + 1))
    cells = drawn.groupBy("source", "size", "r").agg(F.count(F.lit(1)).alias("in_cell"))
    earlier = Window.partitionBy("source", "size").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("before", F.coalesce(F.sum("in_cell").over(earlier), F.lit(0))).drop("in_cell")

    def keyed(df: DataFrame, *keys: str) -> DataFrame:
        return df.withColumnsRenamed({k: f"{k}_" for k in keys})

    def on(*keys: str):
        match = F.lit(True)
        for k in keys:
            match = match & F.col(k).eqNullSafe(F.col(f"{k}_"))
        return match

    cells = cells.join(keyed(plan, "source", "size"), on("source", "size")).select("source", "size", "r", "before", "passes", "take", "source_size", "target")
    ranked = drawn.withColumn("rank", F.row_number().over(Window.partitionBy("source", "size", "r").orderBy("h", "doc_id")))
    found = ranked.join(keyed(cells, "source", "size", "r"), on("source", "size", "r"))
    chosen = (F.col("rank") + F.col("before") <= F.col("take")).cast("long")
    return found.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, F.col("passes") + chosen).otherwise(F.lit(0)).cast("long").alias("copies"))


def op4_mixing_weights(docs: DataFrame, **options) -> DataFrame:
    mixed = mix(docs, **options)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix themselves: a document taken twice stands twice. Rows that repeat a doc_id are drawn
    together: each of them stands as often as the most taken one."""
    n, i, each = unused(docs, "copies", "id", "copy")
    copies = mix(docs, **options).groupBy("doc_id").agg(F.max("copies").alias(n)).where(F.col(n) > 0).withColumnRenamed("doc_id", i)
    joined = docs.join(copies, F.col("doc_id").eqNullSafe(F.col(i)))
    return joined.withColumn(each, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*columns_of(docs))
