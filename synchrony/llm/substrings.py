"""Incremental substring de-duplication over a log-structured fingerprint index.

A window is 50 consecutive words of a document, and its hash has two parts: its anchor, the least hash of the 20-word runs
inside it, and a tail, 48 bits of the hash of all its words. About sixteen neighbouring windows share an anchor, so a run
of the index keeps one row for them: the anchor, their tails, the document. Every window of every document is in the index.

``FingerprintIndex`` is a folder of sorted immutable runs and a manifest of those that count, and can be opened again. A new
batch becomes a run, sorted by anchor where it was read; the anchors of the batch are merge-joined with those of the
history, and the windows under anchors that stand in several documents are met by their hash, with the first place of each.
Only texts of the batch are read for that: the history gives its hashes. Runs are compacted into one, equal rows once.

Neighbouring windows with one source become a range, and every range is verified: the SHA-256 of its words and that of the
source's words must agree, else its windows stay. Of earlier texts, only those that are sources are looked at.

First places are counted map-side and written; the join that brings them back has two plain sides, so that a hot window is
split by AQE's skew join. Which anchors are shared reaches the tasks as a bitmap sized by their number (32 bits for each, up
to 64 MB); it only spares work, as windows that it lets through by chance find no partner.

Defined cases: null and empty texts have no words; texts under 50 words keep all of them; copies of an earlier document
lose every word; windows are judged on the input; rows that repeat a doc_id do not count as earlier than each other; a
null doc_id keeps its words; an empty table gives no rows. Documents of an earlier batch are earlier than those of a later
one, inside a batch the smaller doc_id is; a source whose text is not given proves nothing, so the words stay.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap, may_hold, shared_dir, text_or_empty, written

WINDOW, RUN = 50, 20
K1 = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolled(h: np.ndarray, n: int, k: int) -> np.ndarray:
    """Hashes of all runs of n words, from the hashes of words: doubling, then mixing."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    size = len(h) - n + 1
    out, done, power = None, 0, 1
    part = h
    while power <= n:
        if n & power:
            piece = part[done : done + size]
            out = piece.copy() if out is None else out * np.uint64(pow(k, power, 1 << 64)) + piece
            done += power
        if power * 2 <= n:
            part = part[: len(part) - power] * np.uint64(pow(k, power, 1 << 64)) + part[power:]
        power *= 2
    return mixed(out)


def least(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours."""
    if len(x) < n:
        return x[:0]
    part, power = x, 1
    while power * 2 <= n:
        part = np.minimum(part[: len(part) - power], part[power:])
        power *= 2
    return np.minimum(part[: len(x) - n + 1], part[n - power : n - power + len(x) - n + 1])


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def anchors(h: np.ndarray) -> np.ndarray:
    """The anchor of every window."""
    return least(rolled(h, RUN, K1), WINDOW - RUN + 1)


def split_words(text: str | None) -> tuple[bytes, list[bytes]]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw, raw.split()


#: Bytes of a tail; windows in one row, and words of texts in one batch of rows, at most.
TAIL, ROW, AT_ONCE = 6, 4096, 1 << 18
K2 = 0xD6E8FEB86659FD93


def named(anchor: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The hash of windows, from both parts."""
    return mixed(anchor ^ (tail * np.uint64(K2))).view(np.int64)


def window_hashes(words: list[bytes]) -> np.ndarray:
    h = word_hashes(words)
    return named(anchors(h), rolled(h, WINDOW, K1) & np.uint64((1 << 8 * TAIL) - 1))


#: Rows of a run, of kind "windows": the tails of neighbouring windows with one anchor, the first of them at word ``at``. A
#: fresh run has one row per text besides, of kind "texts": its mark (CRC), number of words and the digest of all its words.
RUN_ROW = "anchor long, tails binary, doc_id long"
FRESH = RUN_ROW + ", mark long, at int, n_words long, whole_sha256 string"


def fingerprinted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in FRESH.split(", ")]

    def rows(ids, marks, counts, shas, found) -> Iterator[pa.RecordBatch]:
        none = [None] * len(ids)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((none, none, ids, marks, none, counts, shas), kinds)], names)
        if found:
            anchor, at, sizes, doc, mark = (np.concatenate([f[k] for f in found]) for k in range(5))
            tails = np.concatenate([f[5] for f in found])
            edges = np.concatenate([[0], np.cumsum(sizes) * TAIL]).astype(np.int32)
            packed = pa.BinaryArray.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(tails)])
            cols = [anchor, packed, doc, mark, at, pa.nulls(len(at)), pa.nulls(len(at))]
            yield pa.RecordBatch.from_arrays([c.cast(k) if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(cols, kinds)], names)

    for batch in batches:
        pending: tuple[list, ...] = ([], [], [], [], [])
        held = 0
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
            raw, words = split_words(text.as_py())
            mark = zlib.crc32(raw)
            for col, x in zip(pending, (doc_id, mark, len(words), hashlib.sha256(b" ".join(words)).hexdigest())):
                col.append(x)
            if doc_id is not None and len(words) >= WINDOW:
                h = word_hashes(words)
                a, t = anchors(h), rolled(h, WINDOW, K1)
                new = np.arange(len(a)) % ROW == 0
                new[1:] |= a[1:] != a[:-1]
                at = np.flatnonzero(new)
                tails = np.ascontiguousarray(t.view(np.uint8).reshape(-1, 8)[:, :TAIL]).ravel()
                pending[4].append((a[at].view(np.int64), at, np.diff(np.append(at, len(a))), np.full(len(at), doc_id, np.int64), np.full(len(at), mark, np.int64), tails))
            held += len(words)
            if held > AT_ONCE:
                yield from rows(*pending)
                pending, held = ([], [], [], [], []), 0
        if pending[0]:
            yield from rows(*pending)


def windows_of(shared, places: bool):
    """Rows of a run whose anchor may be shared, taken apart into windows: h, doc_id and, if asked for, tp (mark and
    position)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = batch.filter(pa.array(may_hold(shared.value, batch.column("anchor").to_numpy())))
            if not batch.num_rows:
                continue
            tails = batch.column("tails")
            edges = np.frombuffer(tails.buffers()[1], np.int32)[tails.offset : tails.offset + len(tails) + 1]
            wide = np.zeros(((edges[-1] - edges[0]) // TAIL, 8), np.uint8)
            wide[:, :TAIL] = np.frombuffer(tails.buffers()[2], np.uint8)[edges[0] : edges[-1]].reshape(-1, TAIL)
            sizes = np.diff(edges) // TAIL
            many = lambda c: np.repeat(batch.column(c).to_numpy(), sizes)
            cols = [named(many("anchor").view(np.uint64), wide.view("<u8").ravel()), many("doc_id")]
            if places:
                inside = np.arange(len(wide)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                cols.append(many("at").astype(np.int64) + inside + (many("mark") << 31))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "doc_id", "tp"][: len(cols)])

    return run


#: A range of windows of a text: its source, and the hash of its first window, by which the source finds the place.
RANGES = "doc_id long, mark long, at int, n int, src long, h long"
PLACES = [x.split()[0] for x in RANGES.split(", ")]


def ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of a document (at, src, h) -> ranges of neighbouring windows with one source, none of them twice in a range."""
    for batch in batches:
        out: list[list] = [[] for _ in PLACES]
        ids, marks = batch.column("doc_id").to_numpy(), batch.column("mark").to_numpy()
        lists = batch.column("hits")
        edges, flat = lists.offsets.to_numpy(), lists.flatten()
        edges = edges - edges[0] if len(edges) else edges
        at, src, h = (flat.field(i).to_numpy() for i in range(3))
        for row, (start, stop) in enumerate(zip(edges, edges[1:])):
            order = start + np.unique(at[start:stop], return_index=True)[1]  # rows that repeat a document repeat its hits
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(at[order]) != 1) | (np.diff(src[order]) != 0)
            if len(np.unique(h[order])) < len(order):  # words that go round: their source may go round less often
                seen: set = set()
                for k, x in enumerate(h[order].tolist()):
                    if new[k] or x in seen:
                        new[k] = True
                        seen.clear()
                    seen.add(x)
            heads = np.flatnonzero(new)
            first = order[heads]
            for col, x in zip(out, (np.full(len(heads), ids[row]), np.full(len(heads), marks[row]), at[first], np.diff(np.append(heads, len(new))), src[first], h[first])):
                col.append(x)
        kinds = (np.int64, np.int64, np.int32, np.int32, np.int64, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c]).astype(k)) for c, k in zip(out, kinds)], PLACES)


def passage(words: list[bytes], at: int, n: int) -> str:
    """SHA-256 of the words that n neighbouring windows cover."""
    return hashlib.sha256(b" ".join(words[at : at + n + WINDOW - 1])).hexdigest()


def without(words: list[bytes], spans: list[tuple[int, int]]) -> list[bytes]:
    """The words outside the windows that start in the spans."""
    cover = np.zeros(len(words) + 1, np.int64)
    for at, n in spans:
        cover[at] += 1
        cover[at + n + WINDOW - 1] -= 1
    return [w for w, n in zip(words, np.cumsum(cover)) if n == 0]


#: What a text answers to its requests: what it keeps (kind 0), the words of its own ranges (1) and of ranges that others
#: took from it (2).
ANSWERS = "kind int, doc_id long, mark long, at int, n int, src long, h long, digest string, n_words long, n_removed long, kept_text string"


def answered(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = [x.split()[0] for x in ANSWERS.split(", ")]
        for batch in batches:
            rows = []
            cols = [batch.column(c) for c in ("doc_id", "mark", "text", "own", "lent")]
            for k in range(batch.num_rows):
                i, mark, text, own, lent = (c[k].as_py() for c in cols)
                _, words = split_words(text)
                if own is not None:
                    kept = without(words, [(x["at"], x["n"]) for x in own])
                    joined = b" ".join(kept)
                    rows.append((0, i, mark, None, None, None, None, hashlib.sha256(joined).hexdigest(), len(words), len(words) - len(kept), joined.decode("utf-8", "replace") if with_text else None))
                    rows += [(1, i, mark, x["at"], x["n"], x["src"], x["h"], passage(words, x["at"], x["n"]), None, None, None) for x in own]
                if lent is not None:
                    hashes = window_hashes(words)
                    place = dict(zip(hashes[::-1].tolist(), range(len(hashes) - 1, -1, -1)))  # the first place of every window
                    for x in lent:
                        at = place.get(x["h"])
                        if at is not None and at + x["n"] <= len(hashes):
                            rows.append((2, None, None, None, x["n"], i, x["h"], passage(words, at, x["n"]), None, None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names)

    return run


KEPT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string"


def emptied(spark: SparkSession, path: str, schema: str) -> None:
    """Remove the rows of a table that nothing reads any more."""
    spark.createDataFrame([], schema).coalesce(1).write.mode("overwrite").parquet(path)


class FingerprintIndex:
    """Sorted immutable runs of window hashes under ``path``, and a manifest: one row per run that counts, with the runs that
    it replaces. A run without such a row is of a job that did not finish and is not read. When ``fan`` runs count, they
    are compacted before the next batch comes, and the windows of the runs replaced are removed. One job writes at a time."""

    MANIFEST = "run string, replaces array<string>"

    def __init__(self, spark: SparkSession, path: str, fan: int = 4):
        self.spark, self.path, self.fan = spark, path.rstrip("/"), fan

    def runs(self) -> list[str]:
        try:
            log = self.spark.read.schema(self.MANIFEST).parquet(f"{self.path}/manifest").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        return sorted({r.run for r in log} - {x for r in log for x in r.replaces})

    def rows(self, run: str, schema: str, kind: str) -> DataFrame:
        found = self.spark.read.schema(schema + ", kind string").parquet(f"{self.path}/{run}")
        return found.where(F.col("kind") == kind).drop("kind")

    def read(self) -> DataFrame | None:
        """The hashes of all batches so far: anchor, tails, doc_id."""
        found = [self.rows(x, RUN_ROW, "windows") for x in self.runs()]
        return reduce(DataFrame.unionByName, found) if found else None

    def write(self, rows: DataFrame, run: str) -> None:
        """Each task sorts the rows that it has."""
        kind = F.when(F.col("anchor").isNull(), "texts").otherwise("windows")
        rows.withColumn("kind", kind).sortWithinPartitions("kind", "anchor").write.partitionBy("kind").parquet(f"{self.path}/{run}")

    def record(self, run: str, replaces: list[str]) -> None:
        self.spark.createDataFrame([(run, replaces)], self.MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def compact(self) -> None:
        """All runs into one: equal rows once, with their least doc_id."""
        old, run = self.runs(), f"run-{uuid.uuid4().hex}"
        if len(old) > 1:
            rows = self.read().groupBy("anchor", "tails").agg(F.min("doc_id").alias("doc_id"))
            self.write(rows, run)
            self.record(run, old)
            for x in old:
                emptied(self.spark, f"{self.path}/{x}/kind=windows", RUN_ROW)

    def shared(self, fresh: DataFrame, old: DataFrame | None) -> DataFrame:
        """Anchors of a batch that stand in several documents: in two of its own, or in the history."""
        mine = fresh.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
        if old is None:
            return mine.where("first < last").select("anchor")
        there = old.select(F.col("anchor").alias("there")).distinct().hint("merge")
        return mine.join(there, F.col("anchor") == F.col("there"), "left").where("first < last or there is not null").select("anchor")

    def add(self, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        """batch: doc_id, text. Returns what is known of its texts (doc_id, mark, n_words, whole_sha256) and the ranges of
        windows that are also in an earlier document (doc_id, mark, at, n, src, h)."""
        if len(self.runs()) >= self.fan:
            self.compact()
        old, run = self.read(), f"run-{uuid.uuid4().hex}"
        self.write(batch.select("doc_id", "text").mapInArrow(fingerprinted, FRESH), run)
        fresh = self.rows(run, FRESH, "windows").select("anchor", "tails", "doc_id", "mark", "at")
        bits = self.spark.sparkContext.broadcast(bitmap(written(self.shared(fresh, old), "substring-shared")))
        found = fresh.mapInArrow(windows_of(bits, True), "h long, doc_id long, tp long")
        none = F.lit(None).cast("long")
        met = found.select("h", "doc_id", none.alias("known"))
        if old is not None:
            met = met.unionByName(old.mapInArrow(windows_of(bits, False), "h long, doc_id long").select("h", none.alias("doc_id"), F.col("doc_id").alias("known")))
        firsts = met.groupBy("h").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min("known").alias("known"))
        firsts = firsts.where("first is not null and (first < last or known is not null)").select(F.col("h").alias("h_"), F.coalesce("known", "first").alias("src"), F.col("known").isNotNull().alias("old"))
        path = f"{shared_dir(self.spark)}/substring-firsts-{run}"
        firsts.write.parquet(path)
        firsts = self.spark.read.schema(firsts.schema).parquet(path)
        again = found.join(firsts.hint("merge"), F.col("h") == F.col("h_")).where("src < doc_id or (old and src > doc_id)")
        hit = F.struct(F.col("tp").bitwiseAND((1 << 31) - 1).cast("int").alias("at"), "src", "h")
        hits = again.groupBy("doc_id", F.shiftright("tp", 31).alias("mark")).agg(F.collect_list(hit).alias("hits"))
        ranges = written(hits.mapInArrow(ranges_of, RANGES), "substring-ranges")
        emptied(self.spark, path, "h_ long")
        bits.unpersist()
        self.record(run, [])
        return self.rows(run, FRESH, "texts").select("doc_id", "mark", "n_words", "whole_sha256"), ranges


def asked(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The texts that have ranges or lent some, with both lists: doc_id, mark, text, own, lent. docs: doc_id, text, fresh;
    only fresh ones have ranges."""
    own = ranges.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("at", "n", "src", "h")).alias("own")).withColumnsRenamed({"doc_id": "d_", "mark": "m_"})
    lent = ranges.select("src", "h", "n").distinct().groupBy("src").agg(F.collect_list(F.struct("h", "n")).alias("lent"))
    crc = F.crc32(F.encode(text_or_empty(), "UTF-8"))
    texts = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text", "fresh", crc.alias("mark"))
    # one list of requests by document, so that texts are dealt once
    both = own.groupBy("d_").agg(F.map_from_entries(F.collect_list(F.struct("m_", "own"))).alias("owns")).join(lent, F.col("d_") == F.col("src"), "full")
    # written, so that the planner knows its size: few requests meet the texts without a shuffle of those
    both = written(both.select(F.coalesce("d_", "src").alias("d_"), "owns", "lent"), "substring-requests")
    met = texts.join(both, F.col("doc_id") == F.col("d_")).select("doc_id", "mark", "text", F.when(F.col("fresh"), F.col("owns")[F.col("mark")]).alias("own"), "lent")
    return met.where("own is not null or lent is not null")


def verified(docs: DataFrame, ranges: DataFrame, with_text: bool) -> tuple[DataFrame, DataFrame]:
    """What the texts keep, and the ranges whose words are not those of their source. Equal ranges with equal words are
    compared once."""
    answers = written(asked(docs, ranges).mapInArrow(answered(with_text), ANSWERS), "substring-answers")
    place = ["src", "h", "n", "digest"]
    there = answers.where("kind = 2").select(*[F.col(c).alias(f"{c}_") for c in place]).distinct()
    same = reduce(lambda x, c: x & (F.col(c) == F.col(f"{c}_")), place, F.lit(True))
    false = written(answers.where("kind = 1").select(*place).distinct().join(there, same, "left_anti"), "substring-unverified")
    keys = false.select(*[F.col(c).alias(f"{c}_") for c in place])
    return answers.where("kind = 0"), answers.where("kind = 1").join(keys, same, "left_semi").select(*PLACES).distinct()


def windows_in(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges taken apart into their windows, each with its hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, mark, text, own in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "mark", "text", "own"))):
                h = window_hashes(split_words(text)[1]) if own else []
                rows += [(i, mark, at, 1, x["src"], int(h[at])) for x in own or [] for at in range(x["at"], x["at"] + x["n"])]
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 6, kinds)], PLACES)

    return asked(docs, ranges).mapInArrow(run, RANGES).distinct()


def deduplicated(docs: DataFrame, with_text: bool = True, batches: int = 3, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, kept_text of every document. They come to an empty index in batches, by
    ascending doc_id; where these are cut has no bearing on the result."""
    spark = docs.sparkSession
    index = index or FingerprintIndex(spark, f"{shared_dir(spark)}/fingerprints-{uuid.uuid4().hex}", fan=2)
    narrow = docs.select("doc_id", "text")
    cuts = narrow.select(F.col("doc_id").cast("double").alias("id")).approxQuantile("id", [k / batches for k in range(1, batches)], 0.01)
    part = reduce(lambda n, c: n + F.when(F.col("doc_id") > c, 1).otherwise(0), sorted(set(cuts)), F.lit(0))
    known = [index.add(narrow.where(part == b)) for b in range(len(set(cuts)) + 1)]
    info, ranges = (reduce(DataFrame.unionByName, x) for x in zip(*known))
    return resolved(narrow, narrow.withColumn("fresh", F.lit(True)), info, ranges, with_text)


def deduplicated_batch(index: FingerprintIndex, batch: DataFrame, earlier: DataFrame, with_text: bool = True) -> DataFrame:
    """The same for a new batch alone, which is added to the index. earlier: doc_id, text of the documents before it; their
    hashes come from the index, and only texts that the batch repeats are looked at, to verify."""
    narrow = batch.select("doc_id", "text")
    info, ranges = index.add(narrow)
    both = narrow.withColumn("fresh", F.lit(True)).unionByName(earlier.select("doc_id", "text", F.lit(False).alias("fresh")))
    return resolved(narrow, both, info, ranges, with_text)


def resolved(narrow: DataFrame, texts: DataFrame, info: DataFrame, ranges: DataFrame, with_text: bool) -> DataFrame:
    """Ranges verified and cut out of the texts of a batch."""
    cut, wrong = verified(texts, ranges, with_text)
    if not wrong.isEmpty():
        # hashes that met by chance, or a source with gaps: such ranges are verified window by window, by the texts' own hashes
        singles = written(windows_in(texts, wrong), "substring-single")
        _, false = verified(texts, singles, False)
        bad = wrong.select(F.col("doc_id").alias("d_"), F.col("mark").alias("m_")).distinct()
        on = (F.col("doc_id") == F.col("d_")) & (F.col("mark") == F.col("m_"))
        true = written(ranges.join(bad, on, "left_semi").exceptAll(wrong).unionByName(singles.exceptAll(false)), "substring-true")
        again, _ = verified(texts, true, with_text)
        cut = cut.join(bad, on, "left_anti").unionByName(again)
    cut = cut.select("doc_id", "mark", "n_words", "n_removed", F.col("digest").alias("kept_sha256"), "kept_text")
    keys = cut.select(F.col("doc_id").alias("d_"), F.col("mark").alias("m_")).distinct()
    on = (F.col("doc_id") == F.col("d_")) & (F.col("mark") == F.col("m_"))
    rest = info.join(keys, on, "left_anti")
    if with_text:
        marked = narrow.withColumn("mark", F.crc32(F.encode(text_or_empty(), "UTF-8")))
        return cut.drop("mark").unionByName(marked.join(keys, on, "left_anti").mapInArrow(untouched, KEPT))
    whole = rest.select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"))
    return cut.drop("mark", "kept_text").unionByName(whole)


def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [split_words(t)[1] for t in batch.column("text").to_pylist()]
        joined = [b" ".join(w) for w in words]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array([0] * len(words), pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in joined], pa.string()), pa.array([x.decode("utf-8", "replace") for x in joined], pa.string())],
            ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
        )


def op3_substring_dedup(docs: DataFrame) -> DataFrame:
    return deduplicated(docs, with_text=False)


#: Words and windows as lists; positions from 1.
ORACLE = """
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
c AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS i FROM g JOIN f USING (h) WHERE first < doc_id),
k AS (SELECT doc_id, i, w FROM (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS w FROM d) ANTI JOIN c USING (doc_id, i)),
j AS (SELECT doc_id, count(*) AS n, string_agg(w, ' ' ORDER BY i) AS t FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(j.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(j.t, '')) AS kept_sha256 FROM d LEFT JOIN j USING (doc_id)
"""
