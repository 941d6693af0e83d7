"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles. Texts that are equal count once. Each gets 128 MinHash values of a byte; texts that
agree on four neighbouring values meet in a bucket. Inside a bucket a pair's values are compared sixteen at a time, and
the pair is dropped as soon as the posterior probability of reaching the threshold, given the agreements so far, falls
below the tolerance. What survives is verified exactly on the whole shingle sets. A pair is looked at only in the first
bucket that its texts share; large buckets are cut into blocks that meet two by two. Surviving pairs are packed into arrays, one row per
pair of blocks, so rows are few but pairs stay quadratic in a group of different near copies. Verification returns, per
text, the number of its links and the root of its group inside the task; star contraction joins those to classes.

Defined cases: null texts equal empty ones; texts without words have no links, but copies of them are one class; texts of
fewer than five words are one shingle; rows that repeat a doc_id are one document (of several texts under one id the
one with the smallest hash counts); a null doc_id stays alone; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bitmap, may_hold, text_or_empty, unused, written
from .substrings import K1, mixed, split_words, word_hashes

SHINGLE, THRESHOLD = 5, 0.8
HASHES, ROWS = 128, 4
BANDS = HASHES // ROWS
#: Values compared at a time, and the posterior probability under which a pair is dropped.
CHUNK, TOLERANCE = 16, 1e-6
#: Texts of a block of a large bucket, and of a block that is verified together.
BUCKET, BLOCK = 512, 256
#: Pairs compared in one go.
PAIRS = 200_000


def shingles(words: list[bytes]) -> np.ndarray:
    """Distinct 64-bit hashes of all runs of five words; of the whole text if it has fewer."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    n = min(SHINGLE, len(words))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = out * np.uint64(K1) + h[j : j + len(out)]
    return np.unique(mixed(out + np.uint64(n)))


def hash_family() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(5)
    return rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)


def minhash(sh: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """128 bytes as 32 integers."""
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    top = (sh >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(top), 1024):
        np.minimum(low, (top[at : at + 1024, None] * a + b).min(axis=0), out=low)
    low = (low ^ (low >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return (low >> np.uint32(24)).astype(np.uint8).view(np.int32)


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """After each chunk, the fewest agreements for which the similarity may still reach the threshold: the posterior
    under a uniform prior, where a byte agrees with probability s + (1 - s) / 256."""
    s = np.linspace(0, 1, 4001)[1:-1]
    p = s + (1 - s) / 256
    need = []
    for k in range(CHUNK, HASHES + 1, CHUNK):
        for m in range(k + 1):
            like = m * np.log(p) + (k - m) * np.log1p(-p)
            w = np.exp(like - like.max())
            if w[s >= threshold].sum() / w.sum() >= tolerance:
                need.append(m)
                break
    return need


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = hash_family()
    for batch in batches:
        keys, flat, lengths = [], [], []
        for text in batch.column("text").to_pylist():
            raw, words = split_words(text)
            keys.append(md5(raw).hexdigest())
            if words:
                flat.append(minhash(shingles(words), a, b))
            lengths.append(BANDS if words else 0)
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
        sig = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *flat])))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.string()), sig], ["doc_id", "key", "sig"])


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, out of batches that are sorted by them; a batch's last run waits for the next.
    Yields tables that hold whole runs only."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        if not table.num_rows:
            continue
        cols = [table.column(k).combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        same = np.ones(table.num_rows, bool)
        for c in cols:
            same &= c == c[-1]
        cut = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def bounds(table: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in keys:
        c = table.column(k).combine_chunks().to_numpy(zero_copy_only=False)
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), table.num_rows)


CELL = ("band", "value", "i", "j")
#: Either a pair of blocks with the surviving pairs of their texts, or (with null blocks) a text that has a survivor.
CANDIDATES = "lo long, hi long, id long, firsts array<long>, seconds array<long>"
FIELDS = ["lo", "hi", "id", "firsts", "seconds"]


def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of buckets, sorted by bucket -> a row per pair of blocks with all surviving pairs, and a row per text that has
    one."""
    need = least_matches()
    for table in groups_of(batches, CELL):
        table = table.combine_chunks()
        edges = bounds(table, CELL)
        band = table.column("band").to_numpy()
        cross = table.column("i").to_numpy() != table.column("j").to_numpy()
        side, rep, block = (table.column(c).to_numpy() for c in ("side", "rep", "block"))
        sig = table.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        octets = np.ascontiguousarray(sig).view(np.uint8).reshape(-1, HASHES)
        firsts: list[np.ndarray] = []
        seconds: list[np.ndarray] = []
        waiting = 0
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def flush():
            nonlocal waiting
            if not waiting:
                return
            x, y = np.concatenate(firsts), np.concatenate(seconds)
            firsts.clear(), seconds.clear()
            waiting = 0
            ok = ~cross[x] | (side[x] != side[y])
            x, y = x[ok], y[ok]
            ok = (sig[x] == sig[y]).argmax(axis=1) == band[x]  # another bucket has this pair before
            x, y = x[ok], y[ok]
            seen = np.zeros(len(x), np.int32)
            for c, least in enumerate(need):
                at = slice(c * CHUNK, (c + 1) * CHUNK)
                seen = seen + (octets[x, at] == octets[y, at]).sum(axis=1)
                alive = seen >= least
                x, y, seen = x[alive], y[alive], seen[alive]
            if len(x):
                kept.append((x, y))

        for start, stop in zip(edges, edges[1:]):
            for row in range(start, stop - 1):
                firsts.append(np.full(stop - row - 1, row))
                seconds.append(np.arange(row + 1, stop))
                waiting += stop - row - 1
                if waiting >= PAIRS:
                    flush()
        flush()
        if kept:
            x, y = (np.concatenate(z) for z in zip(*kept))
            lo, hi = np.minimum(block[x], block[y]), np.maximum(block[x], block[y])
            order = np.lexsort((hi, lo))
            lo, hi, a, b = lo[order], hi[order], rep[x][order], rep[y][order]
            new = np.ones(len(lo), bool)
            new[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
            heads = np.flatnonzero(new)
            offsets = pa.array(np.append(heads, len(lo)).astype(np.int32))
            texts = np.unique(np.concatenate([a, b]))
            n, m = len(heads), len(texts)
            none = pa.ListArray.from_arrays(pa.array(np.zeros(m + 1, np.int32)), pa.array(np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(lo[heads]), pa.array(hi[heads]), pa.nulls(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(a)), pa.ListArray.from_arrays(offsets, pa.array(b))], FIELDS)
            yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(texts), none, none], FIELDS)


def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts and pairs of blocks, sorted by block pair -> id, links, root inside the block pair."""
    keys = ("lo", "hi")
    for table in groups_of(batches, keys):
        edges = bounds(table, keys)
        ids, texts, firsts, seconds = (table.column(c).to_pylist() for c in ("id", "text", "firsts", "seconds"))
        out: tuple[list, list, list] = ([], [], [])
        for start, stop in zip(edges, edges[1:]):
            chosen: dict[int, str] = {}
            pairs: set[tuple[int, int]] = set()
            for r in range(start, stop):
                if ids[r] is None:
                    pairs.update(zip(firsts[r], seconds[r]))
                else:
                    text = texts[r] or ""
                    other = chosen.get(ids[r])
                    if other is None or md5(text.encode("utf-8", "surrogatepass")).digest() < md5(other.encode("utf-8", "surrogatepass")).digest():
                        chosen[ids[r]] = text
            sets = {i: shingles(split_words(t)[1]) for i, t in chosen.items()}
            links, root = dict.fromkeys(sets, 0), {i: i for i in sets}

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for a, b in pairs:
                n, m = len(sets[a]), len(sets[b])
                if min(n, m) < THRESHOLD * max(n, m):
                    continue
                both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
                if both >= THRESHOLD * (n + m - both):
                    links[a] += 1
                    links[b] += 1
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
            for i, n in links.items():
                if n:
                    out[0].append(i), out[1].append(n), out[2].append(find(i))
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], ["id", "links", "root"])


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v -> node, root (the smallest node of its component), for nodes that have an edge. Alternating large
    and small stars; every round is written to the shared folder, and the number of rounds is logarithmic."""
    state, before = edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).where("hi > lo").distinct(), None
    for step in count():
        both = state.unionByName(state.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        low = both.groupBy(F.col("hi").alias("x")).agg(F.least(F.min("lo"), F.first("hi")).alias("m"))
        large = both.join(low, both["hi"] == low["x"]).where("lo > x").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy(F.col("hi").alias("x")).agg(F.min("lo").alias("m"))
        small = large.join(least, large["hi"] == least["x"]).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi > lo")
        state = written(small.unionByName(least.select(F.col("x").alias("hi"), F.col("m").alias("lo"))).distinct(), f"stars-{step}")
        now = tuple(state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if now == before:
            return state.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        before = now


def thinned(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents (doc_id, text) whose id may be among the ids, by a bitmap of these; no id among them is lost."""
    hashed = lambda df, c: df.select(F.xxhash64(F.col(c).cast("long")).alias("h"), *([] if c == "id" else [F.col("doc_id").cast("long").alias("doc_id"), "text"]))
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(hashed(ids, "id")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(bits.value, batch.column("h").to_numpy(zero_copy_only=False).astype(np.int64)))).select(["doc_id", "text"])

    return hashed(docs, "doc_id").mapInArrow(keep, "doc_id long, text string")


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), text_id (of equal texts, the smallest doc_id), n_links:
    number of other texts with a similarity of at least the threshold, key (MD5 of the text that counts)."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    info = narrow.where(F.col("doc_id").isNotNull()).mapInArrow(signatures, "doc_id long, key string, sig array<int>")
    info = written(info.groupBy("doc_id").agg(F.min(F.struct("key", "sig")).alias("s")).select("doc_id", "s.*"), "njoin-signatures")
    reps = info.groupBy("key").agg(F.min(F.struct(F.col("doc_id").alias("rep"), "sig")).alias("r")).select("key", "r.*")
    reps = written(reps, "njoin-texts")
    banded = reps.where(F.size("sig") > 0).select("rep", F.posexplode("sig").alias("band", "value"))
    shared = banded.groupBy("band", "value").agg(F.count(F.lit(1)).alias("n"), F.min("rep").alias("leader")).where("n > 1")
    shared = shared.withColumnsRenamed({"band": "b_", "value": "v_"})
    met = banded.join(shared, (F.col("band") == F.col("b_")) & (F.col("value") == F.col("v_"))).select("rep", "band", "value", "n", "leader")
    # a text's buckets (at most one per band) and its leader, the smallest text that it meets
    per = written(met.groupBy("rep").agg(F.collect_list(F.struct("band", "value", "n")).alias("buckets"), F.min("leader").alias("leader")), "njoin-buckets")
    led = per.groupBy(F.col("leader").alias("l_")).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    placed = per.join(led, F.col("leader") == F.col("l_")).select("rep", "buckets", F.xxhash64("leader", F.pmod(F.xxhash64("rep"), F.col("blocks"))).alias("block"))
    rows = placed.join(reps.select(F.col("rep").alias("r_"), "sig"), F.col("rep") == F.col("r_")).select("rep", "block", "sig", F.explode("buckets").alias("u")).select("rep", "block", "sig", "u.*")
    parts = F.ceil(F.col("n") / BUCKET).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(1)), F.col("parts")).cast("int")).withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("band", "value", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), (F.col("own") > F.col("to")).cast("int").alias("side"), "rep", "block", "sig")
    survivors = written(rows.repartition(*CELL).sortWithinPartitions(*CELL).mapInArrow(prune, CANDIDATES), "njoin-survivors")
    pairs = survivors.where("lo is not null").select("lo", "hi", F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("text"), "firsts", "seconds")
    # the texts of a pair of blocks are those members of either that have a survivor
    members = placed.select("rep", "block").join(survivors.where("id is not null").select(F.col("id").alias("rep")).distinct(), "rep", "left_semi")
    sides = pairs.select("lo", "hi").distinct().withColumn("block", F.explode(F.array_distinct(F.array("lo", "hi"))))
    wanted = members.join(sides, "block").select("lo", "hi", F.col("rep").alias("id"))
    wanted = written(wanted, "njoin-wanted")
    # text is dealt by doc_id at every size, so the plan stays the same as tables grow; texts without a survivor stay where they are
    texts = thinned(narrow, wanted.select("id").distinct()).join(wanted.hint("merge"), F.col("doc_id") == F.col("id"))
    empty = F.array().cast("array<long>")
    texts = texts.select("lo", "hi", "id", "text", empty.alias("firsts"), empty.alias("seconds"))
    cells = texts.unionByName(pairs).repartition("lo", "hi").sortWithinPartitions("lo", "hi")
    linked = written(cells.mapInArrow(verify, "id long, links long, root long"), "njoin-links")
    links = linked.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(linked.select(F.col("id").alias("u"), F.col("root").alias("v")))
    known = reps.select(F.col("key").alias("k_"), F.col("rep").alias("text_id"))
    known = known.join(links, F.col("text_id") == F.col("id"), "left").join(roots, F.col("text_id") == F.col("node"), "left")
    known = known.select("k_", "text_id", F.coalesce("root", "text_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))
    return info.select("doc_id", "key").join(known, F.col("key") == F.col("k_")).select("doc_id", "class_id", "text_id", "n_links", "key")


def op9_ngram_jaccard_join(docs: DataFrame) -> DataFrame:
    found = jaccard_classes(docs).drop("key")
    alone = docs.where(F.col("doc_id").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("text_id"), F.lit(0).cast("long").alias("n_links"))
    return found.unionByName(alone)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents, one of each class: that with the smallest doc_id; of several texts under that id the one that was
    compared. A null doc_id stays."""
    d, k, key = unused(docs, "d", "k", "key")
    first = jaccard_classes(docs).where("doc_id = class_id").select(F.col("doc_id").alias(d), F.col("key").alias(k))
    named = docs.where(F.col("doc_id").isNotNull()).withColumn(key, F.md5(F.encode(text_or_empty(), "UTF-8")))
    kept = named.join(first, (F.col("doc_id") == F.col(d)) & (F.col(key) == F.col(k)), "left_semi").dropDuplicates(["doc_id", key])
    return kept.drop(key).unionByName(docs.where(F.col("doc_id").isNull()))
