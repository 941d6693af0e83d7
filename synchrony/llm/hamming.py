"""Approximate nearest neighbours by multi-index hashing.

Nearness is the inner product. Vectors get one more component that makes their norms equal, which turns the largest inner
product into the least angle. A rotation learned on a bounded sample (principal directions, then iterative quantisation)
gives a code of 64 signs. Codes are split into four substrings of 16 bits. The index has a row per shard of vectors: ids,
codes, the vectors, and for every substring the postings of its 65,536 values. It indexes every row, is written to a folder
and can be opened again.

A query retrieves every code within a Hamming radius: by the pigeonhole principle such a code is within r // 4 bits of the
query's on some substring (one bit less on the last ones), so the values within these bits are probed in the postings,
the codes found are compared in full, and what is within the radius is ranked by the exact inner product of the original
vectors. The radius is measured: bounded calibration queries are compared with every row, and the radius is the least that
holds ``RECALL`` of their true neighbours. A query that finds fewer than k is asked again with twice the radius, up to all 64 bits,
at which every row is retrieved; so nothing is cut off.

Queries in blocks meet every shard: a shard is sent once per block of queries. On vectors without structure, as in the
test tables, a radius of 29 of 64 bits holds 0.97 of the neighbours and a quarter of all rows; the index then spares three
quarters of the exact products, and work stays proportional to queries times rows.

Defined cases: vectors null, zero, or with null or non-finite components take no part; shorter vectors count as ending in
zeros; rows that repeat vec_id and vector count once; an id with several vectors is a candidate with each of them, and as a
query takes the best of all its vectors' pairs; rows of a query's own id are never its candidates; fewer candidates than k
give fewer rows; ties go to the smaller vec_id; scores are correctly rounded sums of products; empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_dir, written

BITS, PARTS = 64, 4
#: Rows that the rotation is learned on, calibration queries, and the share of their neighbours that the radius must hold.
SAMPLE, CALIBRATION, RECALL = 8192, 128, 0.97
#: Rows of a shard, fewer if vectors are long: components of a shard; queries of a block.
SHARD, COMPONENTS, QUERIES = 16_384, 1 << 21, 2_048
FOUND = "query_id long, vec_id long, score double"
SHARDS = "shard int, ids array<long>, codes array<long>, flat array<double>, postings array<int>, starts array<int>"


def usable(embedding: Column) -> Column:
    """The vector as doubles; null if it takes no part."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(embedding, lambda x: x != 0)
    return F.when(good, F.transform(embedding, lambda x: x.cast("double")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of doubles as rows of one width, zeros at their ends."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, edges = column.flatten().to_numpy(), column.offsets.to_numpy()
    edges = edges - edges[0] if len(edges) else np.zeros(1, int)
    sizes = np.diff(edges)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - edges[row]] = flat
    return out


class Coder:
    """Signs of a learned rotation."""

    def __init__(self, width: int, norm: float, rotation: np.ndarray):
        self.width, self.norm, self.rotation = width, norm, rotation

    @staticmethod
    def lifted(rows: np.ndarray, norm: float) -> np.ndarray:
        """Rows over the greatest norm, and the component that brings them to norm 1."""
        rows = rows / norm
        return np.hstack([rows, np.sqrt(np.maximum(0, 1 - (rows * rows).sum(axis=1)))[:, None]])

    @classmethod
    def fitted(cls, sample: np.ndarray, norm: float, rounds: int = 40) -> Coder:
        width = sample.shape[1]
        rows = cls.lifted(sample, norm)
        rows = np.hstack([rows, np.zeros((len(rows), max(0, BITS - rows.shape[1])))])
        directions = np.linalg.svd(rows.T @ rows)[0][:, :BITS]
        turned, turn = rows @ directions, np.linalg.qr(np.random.default_rng(11).normal(size=(BITS, BITS)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.sign(turned @ turn).T @ turned)
            turn = (u @ v).T
        return cls(width, norm, (directions @ turn)[: width + 1])

    def codes(self, rows: np.ndarray, query: bool) -> np.ndarray:
        lifted = np.hstack([rows, np.zeros((len(rows), 1))]) if query else self.lifted(rows, self.norm)
        return np.packbits(lifted @ self.rotation > 0, axis=1, bitorder="little").view(np.uint64).reshape(-1)


def substrings(codes: np.ndarray) -> np.ndarray:
    """PARTS x rows values of 16 bits."""
    return np.ascontiguousarray(codes).view(np.uint16).reshape(-1, PARTS).T


def posted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every substring: positions in the order of its values, and where each value starts."""
    subs = substrings(codes)
    order = np.argsort(subs, axis=1, kind="stable")
    starts = np.array([np.searchsorted(s[o], np.arange((1 << 16) + 1)) for s, o in zip(subs, order)])
    return order.astype(np.int32), starts.astype(np.int32)


FLIPS = np.argsort(np.bitwise_count(np.arange(1 << 16, dtype=np.uint16)), kind="stable").astype(np.uint16)
WITHIN = np.cumsum([math.comb(16, i) for i in range(17)])


def summed(row: np.ndarray, query: np.ndarray) -> float:
    """The inner product, correctly rounded; beyond the range of doubles infinite, and 0 where infinities cancel."""
    with np.errstate(all="ignore"):
        products = (row * query).tolist()
    try:
        return math.fsum(products) + 0.0
    except (OverflowError, ValueError):
        return float(np.nan_to_num(np.sum(np.asarray(products)), nan=0.0, posinf=np.inf, neginf=-np.inf))


class Shard:
    def __init__(self, ids, codes, vectors, postings, starts):
        self.ids, self.codes, self.vectors, self.postings, self.starts = ids, codes, vectors, postings, starts
        self.values = [np.flatnonzero(np.diff(s)).astype(np.uint16) for s in starts]
        with np.errstate(all="ignore"):
            self.top = 0.0 if vectors is None else np.sqrt((vectors * vectors).sum(axis=1).max(initial=0))

    def within(self, code: np.uint64, radius: int) -> np.ndarray:
        """Positions of every code within the radius."""
        if radius >= BITS:
            return np.arange(len(self.ids))
        mark = np.zeros(len(self.ids), bool)
        for part in range(PARTS):
            near = radius // PARTS - (part > radius % PARTS)
            if near < 0:
                continue
            own = np.uint16((int(code) >> (16 * part)) & 0xFFFF)
            values = self.values[part]
            if near >= 16 or WITHIN[near] > len(values):  # fewer values are in use than could be probed
                values = values[np.bitwise_count(values ^ own) <= near]
            else:
                values = FLIPS[: WITHIN[near]] ^ own
            at, to = self.starts[part][values], self.starts[part][values.astype(np.int64) + 1]
            size = to - at
            ends = np.cumsum(size)
            mark[self.postings[part][np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + size, size)]] = True
        found = np.flatnonzero(mark)
        return found[np.bitwise_count(self.codes[found] ^ code) <= radius]

    def nearest(self, at: np.ndarray, query_id: int, query: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k best (score, id) at these positions: rows that can be among them by their rounded score are summed exactly."""
        at = at[self.ids[at] != query_id]
        if len(at) > k:
            with np.errstate(all="ignore"):
                rough = np.nan_to_num(self.vectors[at] @ query, nan=0.0, posinf=np.inf, neginf=-np.inf)
                slack = 1e-9 * np.sqrt((query * query).sum()) * self.top
            if np.isfinite(slack):
                at = at[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - slack]
        scores = [(summed(self.vectors[i], query), int(self.ids[i])) for i in at]
        return sorted(scores, key=lambda x: (-x[0], x[1]))[:k]


class HammingIndex:
    """An index in a folder: shards with postings, and the rotation."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        meta = spark.read.parquet(f"{path}/coder").first()
        self.coder = Coder(meta["width"], meta["norm"], np.array(meta["rotation"]).reshape(-1, BITS)) if meta["width"] else None
        self.count, self.n_shards = meta["count"], meta["shards"]
        self.shards = spark.read.schema(SHARDS).parquet(f"{path}/shards")

    @classmethod
    def build(cls, vectors: DataFrame, path: str, sample: int = SAMPLE, shard: int = SHARD) -> HammingIndex:
        """vectors: vec_id, v (doubles), each row once."""
        spark = vectors.sparkSession
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        count, width, norm = vectors.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(norm), F.lit(0.0))).first()
        rotation: list[float] = []
        n = max(1, -(-count // max(256, min(shard, COMPONENTS // max(width, 1)))))
        if count:
            rows = [r["v"] for r in vectors.orderBy(F.xxhash64(F.lit(17), "vec_id", "v"), "vec_id").limit(sample).collect()]
            coder = Coder.fitted(matrix(pa.array(rows, pa.list_(pa.float64())), width), norm)
            rotation = coder.rotation.reshape(-1).tolist()
            shared = spark.sparkContext.broadcast(coder)

            def pack(table: pa.Table) -> pa.Table:
                v = matrix(table.column("v"), width)
                codes = shared.value.codes(v, query=False)
                order, starts = posted(codes)
                one = lambda x, kind: pa.array([x], pa.list_(kind))
                columns = [pa.array([table.column("shard")[0].as_py()], pa.int32()), one(table.column("vec_id").to_numpy(), pa.int64()), one(codes.view(np.int64), pa.int64()), one(v.reshape(-1), pa.float64()), one(order.reshape(-1), pa.int32()), one(starts.reshape(-1), pa.int32())]
                return pa.Table.from_arrays(columns, [x.split()[0] for x in SHARDS.split(", ")])

            dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int"))
            dealt.groupBy("shard").applyInArrow(pack, SHARDS).write.parquet(f"{path}/shards")
        else:
            spark.createDataFrame([], SHARDS).write.parquet(f"{path}/shards")
        meta = [(int(width), float(norm), int(count), n, rotation)]
        spark.createDataFrame(meta, "width int, norm double, count long, shards int, rotation array<double>").coalesce(1).write.parquet(f"{path}/coder")
        return cls(spark, path)

    def radius_for(self, queries: DataFrame, k: int, recall: float = RECALL, calibration: int = CALIBRATION) -> int:
        """The least radius that holds this share of the true neighbours of bounded calibration queries, over all rows."""
        rows = queries.orderBy(F.xxhash64(F.lit(23), "vec_id", "v"), "vec_id").limit(calibration).collect()
        width, shared = self.coder.width, self.spark.sparkContext.broadcast((self.coder, [(r["vec_id"], r["v"]) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            coder, known = shared.value
            q = matrix(pa.array([v[:width] for _, v in known], pa.list_(pa.float64())), width)
            q_ids, q_codes = np.array([i for i, _ in known]), coder.codes(q, query=True)
            for batch in batches:
                for ids, codes, flat in zip(*(batch.column(c) for c in ("ids", "codes", "flat"))):
                    ids, codes, v = ids.values.to_numpy(), codes.values.to_numpy().view(np.uint64), flat.values.to_numpy().reshape(-1, width)
                    with np.errstate(all="ignore"):
                        scores = np.nan_to_num(q @ v.T, nan=0.0)
                    scores[q_ids[:, None] == ids[None, :]] = -np.inf
                    best = np.argpartition(-scores, min(k, len(ids)) - 1, axis=1)[:, :k]
                    row = np.repeat(np.arange(len(q)), best.shape[1])
                    best = best.reshape(-1)
                    good = q_ids[row] != ids[best]
                    row, best = row[good], best[good]
                    yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(scores[row, best]), pa.array(np.bitwise_count(q_codes[row] ^ codes[best]).astype(np.int32))], ["q", "score", "bits"])

        order = Window.partitionBy("q").orderBy(F.col("score").desc(), "bits")
        found = self.shards.mapInArrow(run, "q int, score double, bits int").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k)
        counts = dict(found.groupBy("bits").count().collect())
        need, seen = recall * sum(counts.values()), 0
        for bits in sorted(counts):
            seen += counts[bits]
            if seen >= need:
                return bits
        return BITS

    def search(self, queries: DataFrame, k: int, radius: int) -> DataFrame:
        """query_id, vec_id, score: per query and shard the k nearest of all codes within the radius. queries: vec_id, v."""
        blocks = max(1, -(-queries.count() // QUERIES))
        width, coder = self.coder.width, self.spark.sparkContext.broadcast(self.coder)
        asked = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(self.n_shards - 1))))
        sent = self.shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

        def cell(questions: pa.Table, rows: pa.Table) -> pa.Table:
            out: tuple[list, list, list] = ([], [], [])
            if questions.num_rows and rows.num_rows:
                ids, codes, flat, postings, starts = (rows.column(c)[0].values.to_numpy() for c in ("ids", "codes", "flat", "postings", "starts"))
                shard = Shard(ids, codes.view(np.uint64), flat.reshape(-1, width), postings.reshape(PARTS, -1), starts.reshape(PARTS, -1))
                v = pa.array([x[:width] for x in questions.column("v").to_pylist()], pa.list_(pa.float64()))
                q = matrix(v, width)
                for query_id, code, query in zip(questions.column("vec_id").to_pylist(), coder.value.codes(q, query=True), q):
                    at = shard.within(code, radius)
                    for score, vec_id in shard.nearest(at, query_id, query, k):
                        out[0].append(query_id), out[1].append(vec_id), out[2].append(score)
            return pa.Table.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

        return asked.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(cell, FOUND)

    def nearest(self, queries: DataFrame, k: int, recall: float = RECALL) -> DataFrame:
        """query_id, rank, vec_id, score: the k nearest found of every query. Queries with fewer than k are asked again with
        twice the radius, until it holds every row: at most seven rounds."""
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
        best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        if self.coder is None or queries.isEmpty():
            return best(self.spark.createDataFrame([], FOUND)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
        radius, results = self.radius_for(queries, k, recall), []
        while True:
            found = written(best(self.search(queries, k, radius)), "hamming-found")
            if radius >= BITS:
                results.append(found)
                break
            full = found.where(F.col("rank") == k).select("query_id")
            results.append(found.join(full, "query_id", "left_semi"))
            queries = written(queries.join(full, F.col("vec_id") == F.col("query_id"), "left_anti"), "hamming-short")
            if queries.isEmpty():
                break
            radius = min(BITS, max(1, 2 * radius))
        out = results[0]
        for more in results[1:]:
            out = out.unionByName(more)
        return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op11_hamming_search(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    vectors = embeddings.select("vec_id", usable(F.col("embedding")).alias("v")).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    vectors = written(vectors.distinct(), "hamming-vectors")
    spark = embeddings.sparkSession
    index = HammingIndex.build(vectors, written_path(spark))
    return index.nearest(vectors.where(F.col("vec_id") % every == 0), k)


def written_path(spark: SparkSession) -> str:
    import uuid

    return f"{shared_dir(spark)}/hamming-index-{uuid.uuid4().hex}"
