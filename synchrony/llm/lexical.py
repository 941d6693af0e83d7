"""Ranked lexical search by bag de-duplication.

Documents are restricted to the vocabulary of the items: each becomes its term counts over that vocabulary. Documents
with the same counts and the same length norm m have the same score for every item, so they are one class: they are dealt
by a hash of counts and m, and grouped by these themselves, which verifies the hash. Every class is scored once, by the
postings of its terms, and the best classes of each item are expanded to their members by ascending doc_id. The k best
documents of an item lie in its k best classes, ordered by score and smallest member, and in the k smallest members of each.

Texts are read once per block of items; they never move. What a task gets of the items is a block of at most
``BLOCK`` (item, term) rows, counted before it is sent; more items are more blocks. Memory in a task is bounded by
``CELLS`` scores.

Defined cases: null texts have no terms, and documents without terms do not count as documents; every row of documents is
a document of its own, also when it repeats a doc_id; a null doc_id comes last among equal scores; rows of items that
repeat item and text count once, several texts of one item are taken together, a null item_id is an item; items without
terms, and items that no document meets, give no rows; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Rows (item, term) of a block of items, scores that a task holds at a time, results per item.
BLOCK, CELLS, TOP = 200_000, 2_000_000, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
APART = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: The same for bytes of UTF-8: what is in no term becomes a space.
FOLD = bytes((c + 32 if 65 <= c <= 90 else c) if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
VECTORS = "doc_id long, n long, bag binary"


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term, many."""
    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    terms = texts.select("item_id", F.explode(F.split(F.translate("text", UPPER, LOWER), APART, -1)).alias("term")).where("term <> ''")
    return terms.groupBy("item_id", "term").agg(F.count(F.lit(1)).alias("many"))


def in_blocks(terms: DataFrame, most: int) -> list[DataFrame]:
    """Whole items in blocks of at most ``most`` rows each, or of one item. A single item can be no larger than its text."""
    sizes = written(terms.groupBy("item_id").agg(F.count(F.lit(1)).alias("size")), "lexical-items")
    total, blocks = sizes.agg(F.sum("size")).first()[0] or 0, 1
    if total <= most:
        return [terms] if total else []
    blocks = -(-total // most)
    block = lambda: F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    while sizes.groupBy(block().alias("b")).agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("items")).where((F.col("size") > most) & (F.col("items") > 1)).limit(1).count():
        blocks *= 2
    return [terms.where(block() == b) for b in range(blocks)]


class Items:
    """A block of items: the numbers of its terms, and per term the items that hold it."""

    def __init__(self, rows: list):
        self.ids = sorted({r["item_id"] for r in rows}, key=lambda x: (x is None, x))
        place = {x: i for i, x in enumerate(self.ids)}
        rows = sorted(rows, key=lambda r: (r["term"].encode(), place[r["item_id"]]))
        names = [r["term"].encode() for r in rows]
        self.terms = {t: i for i, t in enumerate(sorted(set(names)))}
        codes = np.array([self.terms[t] for t in names], np.int64)
        self.starts = np.searchsorted(codes, np.arange(len(self.terms) + 1))
        self.items = np.array([place[r["item_id"]] for r in rows], np.int64)
        self.many = np.array([r["many"] for r in rows], np.int64)


def bags(items):
    """Per document with a term: how many terms it has, and numbers and counts of those in the vocabulary, as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = items.value.terms
        for batch in batches:
            ids, sizes, out = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                found = (text or b"").translate(FOLD).split()
                if found:
                    counts = Counter(map(terms.get, found))
                    counts.pop(None, None)
                    ids.append(doc_id), sizes.append(len(found))
                    out.append(np.array(sorted(counts.items()), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], ["doc_id", "n", "bag"])

    return run


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per term, of the whole task."""
    counts: Counter = Counter()
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column("bag").to_pylist()), np.int32).reshape(-1, 2)
        for t, n in zip(*(x.tolist() for x in np.unique(flat[:, 0], return_counts=True))):
            counts[t] += n
    yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int32()), pa.array(list(counts.values()), pa.int64())], ["t", "df"])


BEST = "item int, score long, first long, h long, m long, bag binary"


def best_rows(item: np.ndarray, score: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of every item: highest score, then smallest first."""
    order = np.lexsort((first, -score, item))
    new = np.append(True, item[order][1:] != item[order][:-1])[: len(order)]
    heads = np.flatnonzero(new)
    rank = np.arange(len(order)) - np.repeat(heads, np.diff(np.append(heads, len(order))))
    return order[rank < k]


def scored(items, weights, k: int):
    """Classes (h, m, bag, first) -> the k best of every item that the task has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, w = items.value, np.asarray(weights.value, np.int64)
        n, step = len(own.ids), max(1, CELLS // len(own.ids))
        kept = [np.zeros(0, np.int64) for _ in range(5)]  # item, score, first, h, m
        kept_bags = np.zeros(0, object)
        floor = np.ones(n, np.int64)
        for batch in batches:
            for part in (batch.slice(i, step) for i in range(0, batch.num_rows, step)):
                h, m = (part.column(c).to_numpy() for c in ("h", "m"))
                first = part.column("first").fill_null(np.iinfo(np.int64).max).to_numpy()
                packed = part.column("bag").to_pylist()
                flat = np.frombuffer(b"".join(packed), np.int32).reshape(-1, 2).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), [len(b) // 8 for b in packed])
                order = np.argsort(flat[:, 0], kind="stable")
                t, tf, row = flat[order, 0], flat[order, 1], row[order]
                gain = (1_000_000_000 * tf) // (1000 * tf + 8 * m[row])
                scores = np.zeros((part.num_rows, n), np.int64)
                heads = np.flatnonzero(np.append(True, t[1:] != t[:-1])[: len(t)])
                for a, b in zip(heads, np.append(heads[1:], len(t))):
                    here = slice(own.starts[t[a]], own.starts[t[a] + 1])
                    scores[row[a:b, None], own.items[here]] += gain[a:b, None] * (w[t[a]] * own.many[here])
                at, item = np.nonzero(scores >= floor)
                new = (item, scores[at, item], first[at], h[at], m[at])
                kept = [np.concatenate(x) for x in zip(kept, new)]
                kept_bags = np.concatenate([kept_bags, np.array([packed[i] for i in at] + [None], object)[:-1]])
                best = best_rows(*kept[:3], k)
                kept, kept_bags = [x[best] for x in kept], kept_bags[best]
                full = np.bincount(kept[0], minlength=n) >= k
                worst = np.full(n, np.iinfo(np.int64).max)
                np.minimum.at(worst, kept[0], kept[1])
                floor[full] = worst[full]
        yield pa.RecordBatch.from_arrays([pa.array(kept[0].astype(np.int32)), *map(pa.array, kept[1:]), pa.array(kept_bags.tolist(), pa.binary())], [x.split()[0] for x in BEST.split(", ")])

    return run


def block_results(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    context = docs.sparkSession.sparkContext
    items = Items(terms.collect())
    shared = context.broadcast(items)
    rows = written(docs.select("doc_id", "text").mapInArrow(bags(shared), VECTORS), "lexical-bags")
    n_docs, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    holding = {r["t"]: r["df"] for r in rows.select("bag").mapInArrow(term_counts, "t int, df long").groupBy("t").agg(F.sum("df").alias("df")).collect()}
    weights = context.broadcast([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * holding[t] + 1))) if t in holding else 0 for t in range(len(items.terms))])
    # exact for products of up to 38 digits
    norm = (F.expr(f"cast(75 * cast(n as decimal(18,0)) * cast({n_docs} as decimal(18,0)) as decimal(38,0)) div cast({max(length, 1)} as decimal(18,0))") + 25).alias("m")
    members = rows.where(F.length("bag") > 0).select("doc_id", norm, "bag").select("doc_id", F.xxhash64("m", "bag").alias("h"), "m", "bag")
    classes = members.groupBy("h", "m", "bag").agg(F.min("doc_id").alias("first"))
    best = classes.mapInArrow(scored(shared, weights, k), BEST)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), "first")
    best = written(best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).select("item", "score", "h", "m", "bag"), "lexical-best")
    keys = best.select(*[F.col(c).alias(f"{c}_") for c in ("h", "m", "bag")]).distinct()
    same = reduce(lambda x, c: x & (F.col(c) == F.col(f"{c}_")), ("h", "m", "bag"), F.lit(True))
    smallest = Window.partitionBy("h", "m", "bag").orderBy(F.col("doc_id").asc_nulls_last())
    chosen = members.join(keys, same, "left_semi").withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k).select("doc_id", *[F.col(c).alias(f"{c}_") for c in ("h", "m", "bag")])
    rank = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    out = best.join(chosen, same).withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
    names = docs.sparkSession.createDataFrame([(i, x) for i, x in enumerate(items.ids)], f"item int, item_id {dict(terms.dtypes)['item_id']}")
    return out.join(names, "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    terms = written(item_terms(items), "lexical-terms")
    results = [block_results(docs, x, k) for x in in_blocks(terms, block)]
    empty = docs.sparkSession.createDataFrame([], f"item_id {dict(terms.dtypes)['item_id']}, rank int, doc_id long, score long")
    return reduce(DataFrame.unionByName, results) if results else empty


def op12_lexical_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    return ranked(docs, items)


ORACLE = """
WITH t AS (SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM documents),
c AS (SELECT row, doc_id, term, count(*) AS tf FROM t GROUP BY row, doc_id, term),
z AS (SELECT row, CAST(sum(tf) AS BIGINT) AS n FROM c GROUP BY row),
g AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM z),
i AS (SELECT item_id, term, count(*) AS many FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM (SELECT DISTINCT item_id, text FROM benchmark)) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM c, g GROUP BY term, docs),
m AS (SELECT row, 25 + (75 * n * docs) // len AS m FROM z, g),
s AS (SELECT item_id, row, doc_id, CAST(sum(many * w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score FROM i JOIN c USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY item_id, row, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""
