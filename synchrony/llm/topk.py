"""Exact top-k search by inner product, in three phases with a uniform threshold.

A vector's score is the sum of its partial scores on a few blocks of dimensions, each a score list of its own. Phase one
gathers the top of every local list: in each block of candidates the k best of each list, with their totals; the k-th best
of all these totals is a safe cutoff, as they are totals of candidates. Phase two hands the cutoff to all blocks and
collects what can reach it: a pair goes on while some list holds or can hold its equal share of the cutoff, and while its
lists so far and the most that its norms allow on the others add up to it. Phase three resolves the pairs that are left
exactly, on their own rows only. The k-th best of what a block has resolved raises the cutoff for the rest of it.

Queries and candidates are dealt into blocks, so a task holds one block of each; nothing is broadcast.

Defined cases: vectors that are null or hold null or non-finite components take no part; shorter vectors count as ending
in zeros; ties go to the smaller vec_id; rows that repeat a vec_id and vector count once; an id with several vectors is a
candidate with each of them, and as a query takes the best of all its vectors' pairs, so an id can stand at two ranks;
rows of a query's own id are never its candidates; fewer candidates than k give fewer rows; empty tables give no rows;
sums beyond 64 bits are held at the limits of a long; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows of a block of candidates and of queries; rows of each that are multiplied at a time.
CANDIDATES, QUERIES, TILE = 4096, 4096, (128, 1024)
#: Score lists: blocks of dimensions.
LISTS = 8
#: Share of pairs still open under which only these are carried on.
SPARSE = 0.2
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "query_id long, vec_id long, score long"


def quantised(embedding: Column) -> Column:
    """floor(256 x) of every component; null if the vector takes no part."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(good, F.transform(embedding, lambda x: F.floor(x.cast("double") * 256).cast("long")))


def matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


class Lists:
    """Rows of vectors as exact numbers, cut into score lists, with the norms of every list and of all lists from it on."""

    def __init__(self, rows: np.ndarray, cuts: list[slice]):
        self.parts = [rows[:, x] for x in cuts]
        squares = np.array([(p.astype(float) ** 2).sum(axis=1) for p in self.parts])
        self.norms = np.sqrt(squares)
        self.rest = np.sqrt(np.cumsum(squares[::-1], axis=0)[::-1])

    def rows(self, at) -> Lists:
        new = Lists.__new__(Lists)
        new.parts, new.norms, new.rest = [p[at] for p in self.parts], self.norms[:, at], self.rest[:, at]
        return new


def kind_of(*tables: np.ndarray) -> type:
    """Doubles where products add up without rounding, else integers of any size."""
    top = [max(abs(int(m.min(initial=0))), abs(int(m.max(initial=0)))) for m in tables]
    return np.float64 if top[0] * top[1] * max(1, tables[0].shape[1]) < 1 << 53 else object


def kind_of_parts(*sides: Lists) -> type:
    return next((p.dtype for side in sides for p in side.parts), np.dtype(float))


def cuts_of(width: int, lists: int) -> list[slice]:
    """Equal blocks of dimensions; the first half of them is looked at in one go, as little can be told before."""
    edges = np.linspace(0, width, min(lists, max(width, 1)) + 1).astype(int)
    edges = np.append(0, edges[len(edges) // 2 :])
    return [slice(a, b) for a, b in zip(edges, edges[1:])]


def reaching(q: Lists, c: Lists, cutoff: np.ndarray, tally: Counter | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and exact totals of the pairs whose total reaches the query's cutoff."""
    m = len(q.parts)
    shape = len(cutoff), c.parts[0].shape[0]
    low = cutoff.astype(float)
    # a total that reaches the cutoff reaches a share of it, by the number of dimensions, on some list
    size = np.array([p.shape[1] for p in q.parts], float)
    share = np.multiply.outer(size / (size.sum() or 1), low) - 1e-9 * np.abs(low) - 1e-3  # less what rounding may add
    total, pairs = np.zeros(shape, kind_of_parts(q, c)), None
    hit = np.zeros(shape, bool)
    # the lists from one on that can still hold their share
    later = [np.zeros(shape, bool)]
    for k in range(m - 1, 0, -1):
        later.append(later[-1] | (np.multiply.outer(q.norms[k], c.norms[k]) * (1 + 1e-9) + 1e-3 >= share[k][:, None]))
    later = later[::-1]
    for k in range(m):
        if pairs is None:
            part = q.parts[k] @ c.parts[k].T
            total = total + part
            hit |= part.astype(float) >= share[k][:, None]
            if total.dtype == object or k == m - 1:
                continue
            alive = (total >= low[:, None] - np.multiply.outer(q.rest[k + 1], c.rest[k + 1]) * (1 + 1e-9) - 1e-3) & (hit | later[k])
            if np.count_nonzero(alive) >= SPARSE * alive.size:
                continue
            i, j = pairs = np.nonzero(alive)
            total, hit = total[pairs], hit[pairs]
            continue
        part = np.einsum("ij,ij->i", q.parts[k][i], c.parts[k][j])
        total = total + part
        if k == m - 1:
            continue
        hit = hit | (part >= share[k, i])
        alive = (total >= low[i] - q.rest[k + 1][i] * c.rest[k + 1][j] * (1 + 1e-9) - 1e-3) & (hit | later[k][i, j])
        i, j = pairs = i[alive], j[alive]
        total, hit = total[alive], hit[alive]
    if tally is not None:
        tally["pairs"] += shape[0] * shape[1]
        tally["resolved"] += shape[0] * shape[1] if pairs is None else len(total)
    if pairs is None:
        i, j = np.indices(shape).reshape(2, -1)
        total = total.reshape(-1)
    else:
        i, j = pairs
    if total.dtype == object:
        total = np.array([min(max(int(x), LEAST), MOST) for x in total], dtype=np.int64)
    else:
        total = total.astype(np.int64)
    good = total >= cutoff[i]
    return i[good], j[good], total[good]


def best_of(i: np.ndarray, ids: np.ndarray, totals: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of every i: largest total first, then smallest id."""
    order = np.lexsort((ids, ~totals, i))  # ~x falls as x grows, without leaving 64 bits
    heads = np.flatnonzero(np.append(True, i[order][1:] != i[order][:-1])) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order[rank < k]


def cell(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, lists: int, tally: Counter | None = None) -> pd.DataFrame:
    """The at most k best candidates of every query (vec_id, v, cutoff) that reach its cutoff."""
    out: tuple[list, list, list] = ([], [], [])
    if len(queries) and len(candidates):
        width = max(max(map(len, queries["v"])), max(map(len, candidates["v"])), 1)
        qs, cs = matrix(queries["v"], width), matrix(candidates["v"], width)
        kind, cuts = kind_of(qs, cs), cuts_of(width, lists)
        q_all, c_all = Lists(qs.astype(kind), cuts), Lists(cs.astype(kind), cuts)
        q_ids, c_ids, cutoffs = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy(), queries["cutoff"].to_numpy(np.int64)
        for at in range(0, len(q_ids), TILE[0]):
            here = slice(at, at + TILE[0])
            ids, cut, q = q_ids[here], cutoffs[here].copy(), q_all.rows(slice(at, at + TILE[0]))
            kept = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
            for to in range(0, len(c_ids), TILE[1]):
                i, j, total = reaching(q, c_all.rows(slice(to, to + TILE[1])), cut, tally)
                found = c_ids[to + j]
                other = found != ids[i]
                kept = tuple(np.concatenate([x, y[other]]) for x, y in zip(kept, (i, found, total)))
                best = best_of(*kept, k)
                kept = tuple(x[best] for x in kept)
                full = np.bincount(kept[0], minlength=len(ids)) >= k
                worst = np.full(len(ids), MOST)
                np.minimum.at(worst, kept[0], kept[2])
                cut[full] = np.maximum(cut[full], worst[full])
            out[0].append(ids[kept[0]]), out[1].append(kept[1]), out[2].append(kept[2])
    empty = [np.zeros(0, np.int64)]
    return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), (np.concatenate(empty + x) for x in out))))


LISTED = "query_id long, total long"


def listed(queries: pd.DataFrame, candidates: pd.DataFrame, k: int, lists: int) -> pd.DataFrame:
    """Per query the at most k best totals of the candidates that stand in the top k of some list of this block."""
    ids, best = [], []
    if len(queries) and len(candidates):
        width = max(max(map(len, queries["v"])), max(map(len, candidates["v"])), 1)
        qs, cs = matrix(queries["v"], width), matrix(candidates["v"], width)
        kind = kind_of(qs, cs)
        qs, cs = qs.astype(kind), cs.astype(kind)
        edges = np.linspace(0, width, min(lists, width) + 1).astype(int)
        q_ids, c_ids = queries["vec_id"].to_numpy(), candidates["vec_id"].to_numpy()
        for at in range(0, len(q_ids), TILE[0]):
            q, own = qs[at : at + TILE[0]], q_ids[at : at + TILE[0], None] == c_ids[None, :]
            tops = []
            for a, b in zip(edges, edges[1:]):
                part = (q[:, a:b] @ cs[:, a:b].T).astype(float)
                part[own] = -np.inf
                tops.append(np.argpartition(-part, min(k, len(c_ids)) - 1, axis=1)[:, :k])
            for row, some in enumerate(np.hstack(tops)):
                some = np.unique(some)
                some = some[~own[row, some]]
                totals = sorted((min(max(int(x), LEAST), MOST) for x in cs[some] @ q[row]), reverse=True)[:k]
                ids += [q_ids[at + row]] * len(totals)
                best += totals
    return pd.DataFrame({"query_id": np.array(ids, np.int64), "total": np.array(best, np.int64)})


def top_k(vectors: DataFrame, queries: DataFrame, k: int, lists: int = LISTS) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables: vec_id, v (array of long)."""
    vectors, queries = written(vectors.distinct(), "topk-vectors"), queries.distinct()
    n, m = vectors.count(), queries.count()
    rows, cols = max(1, -(-m // QUERIES)), max(1, -(-n // CANDIDATES))
    left = queries.withColumn("qb", F.pmod(F.xxhash64("vec_id"), F.lit(rows)).cast("int"))
    right = vectors.withColumn("cb", F.pmod(F.xxhash64("vec_id"), F.lit(cols)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(rows - 1))))

    def cells(asked: DataFrame):
        spread = asked.withColumn("cb", F.explode(F.sequence(F.lit(0), F.lit(cols - 1))))
        return spread.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb"))

    tops = cells(left).applyInPandas(lambda a, b: listed(a, b, k, lists), LISTED)
    place = Window.partitionBy("query_id").orderBy(F.col("total").desc())
    cutoffs = tops.withColumn("place", F.row_number().over(place)).where(F.col("place") == k).select(F.col("query_id").alias("q_"), F.col("total").alias("cut_"))
    asked = left.join(cutoffs, F.col("vec_id") == F.col("q_"), "left").select("vec_id", "v", "qb", F.coalesce("cut_", F.lit(LEAST)).alias("cutoff"))
    found = cells(written(asked, "topk-queries")).applyInPandas(lambda a, b: cell(a, b, k, lists), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op1_topk_search(embeddings: DataFrame, k: int = 5, every: int = 50, lists: int = LISTS) -> DataFrame:
    vectors = embeddings.select("vec_id", quantised(F.col("embedding")).alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    return top_k(vectors, vectors.where(F.col("vec_id") % every == 0), k, lists)


ORACLE = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
