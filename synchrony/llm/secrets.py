"""Secret scans over an incremental blob ledger.

Every version of a text is addressed by the SHA-256 of its bytes. The ledger is a table of what each rule version has
already found in each blob; only (blob, rule version) pairs that it lacks are scanned, whatever path they stand under,
and the findings are joined back to every path. All of it is built-in functions; spans are code points, end exclusive.

Defined cases: a null text is empty; texts that repeat are one blob and get the same spans under every id; an empty
table or a text without a secret gives empty spans; matches that fail a rule's length are dropped after matching.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, let, shared_dir, text_or_empty, unused


@dataclass(frozen=True)
class Rule:
    """A named pattern. ``group`` is the capture whose length must reach ``least``."""

    kind: str
    pattern: str
    least: int
    group: int = 0
    version: int = 1


#: Kinds in the order in which spans that start together are listed.
RULES = (
    Rule("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    # the shortest length stands in the pattern: a run that is too short holds no longer one
    Rule("access", r"AKIA[A-Z0-9]{16,}", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
)
SPANS = "array<struct<start:int,k:int,stop:int,kind:string>>"


def no_spans() -> Column:
    return F.array().cast(SPANS)


def spans_of(text: Column, rule: Rule, k: int) -> Column:
    """Spans of one rule: the texts between matches and the matches themselves add up to the positions."""
    pattern = F.lit(rule.pattern)

    def placed(between: Column, found: Column, tested: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))

        def step(acc: Column, i: Column) -> Column:
            begin = acc["at"] + F.char_length(F.element_at(between, i))
            end = begin + F.char_length(F.element_at(found, i))
            span = F.struct(begin.alias("start"), F.lit(k).alias("k"), end.alias("stop"), F.lit(rule.kind).alias("kind"))
            kept = F.when(F.char_length(F.element_at(tested, i)) >= rule.least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            return F.struct(end.alias("at"), kept.alias("out"))

        return F.aggregate(F.sequence(F.lit(1), F.size(found)), start, step)["out"]

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else None
    body = let(
        F.struct(F.split(text, rule.pattern, -1).alias("between"), found.alias("found"), *([tested.alias("tested")] if rule.group else [])),
        lambda s: placed(s["between"], s["found"], s["tested"] if rule.group else s["found"]),
    )
    return F.when(text.rlike(rule.pattern), body).otherwise(no_spans())


class BlobLedger:
    """Findings by (blob, kind, version) under ``path``: one folder of Parquet files per batch, which counts once Spark has
    marked it as complete. What the ledger has seen is read from there, so it can be opened again, and a job that failed
    or runs twice neither loses nor doubles anything."""

    SCHEMA = f"blob string, kind string, version int, spans {SPANS}"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def batches(self) -> list[str]:
        """Folders of complete batches."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path
        root = hadoop(self.path)
        fs = root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())
        found = [x.getPath() for x in fs.listStatus(root)] if fs.exists(root) else []
        return sorted(p.toString() for p in found if p.getName().startswith("batch-") and fs.exists(hadoop(p, "_SUCCESS")))

    def read(self) -> DataFrame:
        found = self.batches()
        if not found:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(*found)

    def scan(self, versions: DataFrame, rules: tuple[Rule, ...] = RULES) -> None:
        """versions: text. Scans the blobs that some rule version has not seen, and adds what it found."""
        blobs = versions.select(text_or_empty().alias("text")).withColumn("blob", F.sha2("text", 256))
        blobs = blobs.groupBy("blob").agg(F.any_value("text").alias("text"))
        if self.batches():
            pairs = F.array(*[F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version")) for r in rules])
            seen = self.read().select("blob", F.struct("kind", "version").alias("pair")).groupBy("blob").agg(F.collect_set("pair").alias("seen"))
            blobs = blobs.join(seen, "blob", "left").where(F.size(F.array_except(pairs, F.coalesce("seen", F.array().cast("array<struct<kind:string,version:int>>")))) > 0)
        else:
            blobs = blobs.withColumn("seen", F.lit(None).cast("array<struct<kind:string,version:int>>"))

        def unseen(rule: Rule) -> Column:
            pair = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))
            return ~F.coalesce(F.array_contains("seen", pair), F.lit(False))

        entries = F.array(*[F.when(unseen(r), F.struct(F.lit(r.kind).alias("kind"), F.lit(r.version).alias("version"), spans_of(F.col("text"), r, k).alias("spans"))) for k, r in enumerate(rules)])
        found = blobs.select("blob", F.explode(F.array_compact(entries)).alias("e")).select("blob", "e.*")
        found.write.parquet(f"{self.path}/batch-{uuid.uuid4().hex}")

    def findings(self, rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, spans: what the given rule versions found, for blobs with any finding."""
        wanted = F.lit(False)
        for r in rules:
            wanted = wanted | ((F.col("kind") == r.kind) & (F.col("version") == r.version))
        hits = self.read().where(wanted & (F.size("spans") > 0)).dropDuplicates(["blob", "kind", "version"])
        return hits.groupBy("blob").agg(F.sort_array(F.flatten(F.collect_list("spans"))).alias("spans"))


def scan_documents(docs: DataFrame, name: str, rules: tuple[Rule, ...] = RULES, ledger: BlobLedger | None = None, batches: int = 2) -> DataFrame:
    """The documents with their spans (sorted by start, then kind) in a column of the given name. They come in batches,
    dealt by doc_id, each of which scans what the ledger has not seen."""
    spark = docs.sparkSession
    ledger = ledger or BlobLedger(spark, f"{shared_dir(spark)}/blob-ledger-{uuid.uuid4().hex}")
    part = F.pmod(F.xxhash64("doc_id"), F.lit(batches))
    for b in range(batches):
        ledger.scan(docs.where(part == b), rules)
    path, blob, spans = unused(docs, "path", "blob", "spans")
    found = ledger.findings(rules).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    joined = docs.withColumn(path, F.sha2(text_or_empty(), 256)).join(found, F.col(path) == F.col(blob), "left")
    return joined.select(*columns_of(docs), F.coalesce(spans, no_spans()).alias(name))


def op2_secret_scans(docs: DataFrame) -> DataFrame:
    found = scan_documents(docs.select("doc_id", "text"), "s")
    joined = F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in RULES]
    return found.select("doc_id", *counts, F.sha2(joined, 256).alias("base_sha256"), joined.alias("spans"))


def redacted(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every span of their text replaced by a mark; overlapping spans become one mark."""
    (name,) = unused(docs, "found")
    found = scan_documents(docs, name)

    def apply(text: Column, spans: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

        def step(acc: Column, x: Column) -> Column:
            part = F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], x["stop"]).alias("at"), part.alias("out"))

        return let(F.aggregate(spans, start, step), lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))

    text = F.when(F.size(name) > 0, apply(F.col("text"), F.col(name))).otherwise(F.col("text"))
    return found.withColumn("text", text).select(*columns_of(docs))


def _kind(k: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    test = f"regexp_extract_all(t, '{pattern}', {rule.group})"
    return f"""SELECT doc_id, {k} AS k, '{rule.kind}' AS kind, CAST(list_sum(lens[:i]) + list_sum([0] || gaps[:i]) - lens[i] AS BIGINT) AS b, CAST(list_sum(lens[:i]) + list_sum(gaps[:i]) AS BIGINT) AS e
      FROM (SELECT doc_id, unnest(range(1, len(m) + 1)) AS i, list_transform(m, lambda x: length(x)) AS lens, list_transform(g, lambda x: length(x)) AS gaps, q
            FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}', 0) AS m, string_split_regex(t, '{pattern}') AS g, {test} AS q FROM d)) WHERE length(q[i]) >= {rule.least}"""


ORACLE = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ("
    + " UNION ALL ".join(_kind(k, r) for k, r in enumerate(RULES))
    + """), a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
      string_agg(kind || ':' || b || ':' || e, ',' ORDER BY b, k) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)"""
)
