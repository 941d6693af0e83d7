"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a hash of the document id. Every document starts in the bucket of the
empty prefix; only a bucket above the byte limit is split on another bit, so small regions keep short prefixes.
A round looks ahead some bits: bytes are summed by cell, and by every prefix of a cell, with partial sums on the map side.
Prefixes above the limit are the inner nodes; their children that fit are the buckets, and the directory names the bucket
of every cell. Only rows of cells that are still too large take part in the next round.

Defined cases: a null text has 0 bytes; a null id is hashed as an empty string; a document above the limit, or rows
that repeat one id and together are above it, cannot be split: they end in a bucket of the longest prefix, flagged
``over_limit``; extra columns are ignored, or written with their shard; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused, written

#: Bits of the hash that can be used.
MAX_BITS = 56
#: Bits by which one round looks ahead.
STEP = 14


def hash_bits(key: Column) -> Column:
    """The first 56 bits of the MD5 of the key's text, as a number."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 14), 16, 10).cast("long")


def prefix(bits: Column, depth: int) -> Column:
    """The first ``depth`` bits."""
    return F.shiftright(bits, MAX_BITS - depth)


def bucket_sums(rows: DataFrame, base: int, top: int) -> DataFrame:
    """depth, bucket, bytes of all prefixes of ``base`` to ``top`` bits that hold rows."""
    cells = rows.groupBy(prefix(F.col("h"), top).alias("cell")).agg(F.sum("bytes").alias("bytes"))
    nodes = cells.select("bytes", "cell", F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")).select("depth", F.expr(f"shiftright(cell, {top} - depth)").alias("bucket"), "bytes")
    return nodes.groupBy("depth", "bucket").agg(F.sum("bytes").alias("bytes"))


def buckets(sums: DataFrame, limit: int, base: int, top: int) -> DataFrame:
    """depth, bucket, shard_bytes, fits: prefixes that are within the limit (or at ``top`` bits) below ones that are not."""
    above = F.col("bytes") > limit
    inner = sums.where(above & (F.col("depth") < top)).select((F.col("depth") + 1).alias("d_"), F.explode(F.array(F.col("bucket") * 2, F.col("bucket") * 2 + 1)).alias("b_"))
    kept = sums.where(~above | (F.col("depth") == top))
    below = kept.join(inner, (F.col("depth") == F.col("d_")) & (F.col("bucket") == F.col("b_")), "left_semi")
    return kept.where(F.col("depth") == base).unionByName(below).distinct().select("depth", "bucket", F.col("bytes").alias("shard_bytes"), (F.col("bytes") <= limit).alias("fits"))


def by_cell(found: DataFrame, top: int) -> DataFrame:
    """The directory itself: every cell of ``top`` bits with its bucket."""
    spread = F.expr(f"shiftleft(1L, {top} - depth)")
    first = F.expr(f"shiftleft(bucket, {top} - depth)")
    return found.withColumn("cell", F.explode(F.sequence(first, first + spread - 1)))


def bits_of(bucket: str, depth: str) -> Column:
    return F.when(F.col(depth) > 0, F.lpad(F.bin(bucket), F.col(depth).cast("int"), F.lit("0"))).otherwise(F.lit(""))


def shards(docs: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """doc_id, bytes, shard (its prefix in bits), depth, shard_bytes, over_limit."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = written(docs.select("doc_id", hash_bits(F.col(key)).alias("h"), size.alias("bytes")), "shard-rows")
    done, base = None, 0
    while True:
        top = min(base + STEP, MAX_BITS)
        sums = written(bucket_sums(rows, base, top), "shard-sums")
        found = by_cell(written(buckets(sums, limit, base, top), "shard-buckets"), top)
        placed = rows.withColumn("c_", prefix(F.col("h"), top)).join(found, F.col("c_") == F.col("cell")).drop("cell", "c_")
        if top < MAX_BITS:
            placed = written(placed, "shard-round")
            closed, still = placed.where("fits"), placed.where("not fits").select("doc_id", "h", "bytes")
        else:
            closed, still = placed, None
        done = closed if done is None else done.unionByName(closed)
        if still is None or still.isEmpty():
            break
        rows, base = still, top
    return done.select("doc_id", "bytes", bits_of("bucket", "depth").alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", (~F.col("fits")).alias("over_limit"))


def directory(assigned: DataFrame) -> DataFrame:
    """shard, depth, shard_bytes, over_limit, n_docs: the buckets of an assignment."""
    return assigned.groupBy("shard", "depth").agg(F.max("shard_bytes").alias("shard_bytes"), F.max("over_limit").alias("over_limit"), F.count(F.lit(1)).alias("n_docs"))


def write_shards(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """Writes the documents in a folder per shard (``shard=0b`` and its prefix) and the directory beside them; returns the
    directory. A shard is at most the limit (but for what cannot be split), so it is one task."""
    known = written(shards(docs.select("doc_id", "text"), limit), "shard-assignment")
    i, shard = unused(docs, "id", "shard")
    one = known.select(F.col("doc_id").alias(i), F.concat(F.lit("0b"), "shard").alias(shard)).distinct()
    placed = docs.join(one, F.col("doc_id").eqNullSafe(F.col(i))).drop(i)
    placed.repartition(shard).write.partitionBy(shard).parquet(f"{path}/documents")
    directory(known).write.parquet(f"{path}/directory")
    return docs.sparkSession.read.parquet(f"{path}/directory")


#: Bytes of text per shard in the registered query.
SHARD_BYTES = 128_000_000


def op8_sharding(docs: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    return shards(docs, limit)


ORACLE = f"""
WITH r AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 14) AS BIGINT) AS h, coalesce(octet_length(encode(text)), 0) AS bytes FROM documents),
n AS (SELECT doc_id, h, bytes, d.depth, h >> CAST({MAX_BITS} - d.depth AS BIGINT) AS bucket FROM r CROSS JOIN (SELECT unnest(range(0, {STEP + 1})) AS depth) d),
s AS (SELECT depth, bucket, sum(bytes) AS shard_bytes FROM n GROUP BY ALL),
f AS (SELECT n.doc_id, n.bytes, n.depth, n.bucket, s.shard_bytes, row_number() OVER (PARTITION BY n.doc_id ORDER BY n.depth) AS rn
      FROM n JOIN s USING (depth, bucket) WHERE s.shard_bytes <= {SHARD_BYTES})
SELECT doc_id, CAST(bytes AS BIGINT) AS bytes, CASE WHEN depth = 0 THEN '' ELSE right(repeat('0', 56) || bin(bucket), CAST(depth AS BIGINT)) END AS shard,
  CAST(depth AS INT) AS depth, CAST(shard_bytes AS BIGINT) AS shard_bytes, shard_bytes > {SHARD_BYTES} AS over_limit FROM f WHERE rn = 1
"""
