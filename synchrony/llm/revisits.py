"""Not-modified revisits: an as-of join to the latest earlier full response of the same canonical URL.

A revisit record (HTTP 304) has no body. It is resolved to the latest full response captured strictly before it under
the same canonical URL, if the validators agree: equal ETags (weak comparison) where both sides have one, else equal
Last-Modified where both have one. The header fields that a 304 may carry replace the stored ones; all others stay.

The time line of one URL is cut into spans: the last response of each span is carried forward over spans, and only
records of one span meet in a window, so a URL that holds a large share of the rows is spread over many tasks.

Defined cases: a null or empty URL and a null moment match nothing; two responses of one moment count as one, that of the
larger id; a revisit without validators, or with others than the response's, stays unresolved with its reason; null headers
count as none; rows that repeat are resolved alike; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Header fields that a 304 response updates (HTTP semantics, section on 304 Not Modified).
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Length of a span of the time line.
SPAN = 1 << 12


def canonical(url: Column) -> Column:
    """Lower-case host without ``www.``/``m.`` and default port, path without trailing slash or ``.html``, query without
    tracking parameters; no scheme, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.lower(F.regexp_extract(bare, "^[^/?]*", 0))
    host = F.regexp_replace(F.regexp_replace(host, ":(80|443)$", ""), r"^(www|m)\.", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), r"(\.html?|/)$", "")
    query = F.regexp_extract(bare, r"^[^?]*\?(.*)$", 1)
    query = F.regexp_replace(F.regexp_replace(query, "(^|&)(utm_[a-z]+|ref)=[^&]*", ""), "^&", "")
    return F.nullif(F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))), F.lit(""))


def resolve(records: DataFrame, span: int = SPAN) -> DataFrame:
    """records: record_id long, url string, ts long, kind ('response' or 'revisit'), etag, last_modified, digest string,
    headers map<string,string> -> one row per revisit: record_id, url_key, response_id, status, headers, digest."""
    headers = F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers")
    rows = records.select("record_id", "url", "ts", "kind", "etag", "last_modified", "digest", headers)
    rows = rows.withColumn("url_key", canonical(F.col("url"))).withColumn("span", F.floor(F.col("ts") / span))
    full = F.when((F.col("kind") == "response") & F.col("ts").isNotNull(), F.struct("ts", F.col("record_id").alias("id"), "etag", "last_modified", "digest", F.map_entries("headers").alias("h")))
    # the last response of every span, carried forward to the next ones
    spans = rows.where(F.col("url_key").isNotNull()).groupBy("url_key", "span").agg(F.max(full).alias("last"))
    back = Window.partitionBy("url_key").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = spans.select(F.col("url_key").alias("k_"), F.col("span").alias("s_"), F.max("last").over(back).alias("carried"))
    inside = Window.partitionBy("url_key", "span").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = rows.withColumn("near", F.max(full).over(inside)).where(F.col("kind") == "revisit")
    met = near.join(carried, (F.col("url_key") == F.col("k_")) & (F.col("span") == F.col("s_")), "left")
    met = met.withColumn("r", F.when(F.col("url_key").isNotNull() & F.col("ts").isNotNull(), F.coalesce("near", "carried")))

    def strong(tag: Column) -> Column:
        return F.regexp_replace(tag, "^W/", "")

    both_tags = F.col("etag").isNotNull() & F.col("r.etag").isNotNull()
    both_dates = F.col("last_modified").isNotNull() & F.col("r.last_modified").isNotNull()
    agree = F.when(both_tags, strong(F.col("etag")) == strong(F.col("r.etag"))).when(both_dates, F.col("last_modified") == F.col("r.last_modified"))
    status = F.when(F.col("r").isNull(), "no-response").when(agree.isNull(), "no-validator").when(agree, "resolved").otherwise("validator-mismatch")
    fresh = F.map_filter("headers", lambda k, v: F.lower(k).isin(*PERMITTED))
    names = F.transform(F.map_keys(fresh), lambda k: F.lower(k))
    stored = F.filter("r.h", lambda e: ~F.array_contains(names, F.lower(e["key"])))
    merged = F.map_from_entries(F.array_sort(F.concat(stored, F.map_entries(fresh))))
    good = F.col("status") == "resolved"
    return met.withColumn("status", status).select(
        "record_id",
        "url_key",
        F.when(good, F.col("r.id")).alias("response_id"),
        "status",
        F.when(good, merged).alias("headers"),
        F.when(good, F.col("r.digest")).alias("digest"),
    )


def records_of(pages: DataFrame, later: int) -> DataFrame:
    """Captures derived from raw pages. A page is a full response at the moment of its id, and is asked for again ``later``
    moments afterwards. By the length of its content, a server sends an ETag, a Last-Modified, both or neither, and some
    responses were never stored, so that only their revisits are there."""
    html = F.coalesce(F.col("html"), F.lit(""))
    n = F.octet_length(html)
    etag = F.when(n % 3 != 0, F.md5(html.cast("binary")))
    modified = F.when(n % 4 != 0, F.concat(F.lit("day "), F.floor(n / 1000).cast("string")))
    entry = lambda k, v: F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")))
    fields = lambda *x: F.map_from_entries(F.array_compact(F.array(*x)))
    again = F.col("page_id") + later
    response = F.when(
        n % 11 != 0,
        F.struct(
            F.col("page_id").alias("ts"),
            F.lit("response").alias("kind"),
            fields(entry("content-length", n), entry("content-type", F.lit("text/html")), entry("date", F.col("page_id")), entry("etag", etag), entry("last-modified", modified)).alias("headers"),
        ),
    )
    revisit = F.struct(
        again.alias("ts"),
        F.lit("revisit").alias("kind"),
        fields(entry("content-length", F.lit(0)), entry("date", again), entry("etag", etag), entry("expires", again + 100), entry("last-modified", modified)).alias("headers"),
    )
    narrow = pages.select("page_id", "url", etag.alias("etag"), modified.alias("last_modified"), F.md5(html.cast("binary")).alias("digest"), F.array_compact(F.array(response, revisit)).alias("both"))
    one = narrow.withColumn("c", F.explode("both"))
    return one.select(F.col("page_id").alias("record_id"), "url", "c.ts", "c.kind", "etag", "last_modified", "digest", "c.headers")


#: Moments after which the registered query asks for a page again.
LATER = 1500


def op10_warc_revisits(pages: DataFrame, later: int = LATER) -> DataFrame:
    found = resolve(records_of(pages, later))
    headers = F.array_join(F.transform(F.map_entries("headers"), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return found.select(F.col("record_id").alias("page_id"), "url_key", "response_id", "status", headers.alias("headers"), "digest")


ORACLE = rf"""
WITH b AS (SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS bare, md5(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
q AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[^/?]*', 0)), ':(80|443)$', ''), '^(www|m)\.', '') AS host,
  regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '(\.html?|/)$', '') AS path,
  regexp_replace(regexp_replace(regexp_extract(bare, '^[^?]*\?(.*)$', 1), '(^|&)(utm_[a-z]+|ref)=[^&]*', '', 'g'), '^&', '') AS query FROM b),
k AS (SELECT page_id, digest, n, CASE WHEN n % 3 <> 0 THEN digest END AS etag, CASE WHEN n % 4 <> 0 THEN 'day ' || CAST(floor(n / 1000) AS BIGINT) END AS modified, nullif(host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END, '') AS url_key FROM q),
v AS (SELECT *, page_id + {LATER} AS ts FROM k),
m AS (SELECT v.*, r.page_id AS rid, r.etag AS retag, r.modified AS rmodified, r.digest AS rdigest, r.n AS rn FROM v ASOF LEFT JOIN (SELECT * FROM k WHERE n % 11 <> 0) r ON v.url_key = r.url_key AND v.ts > r.page_id),
s AS (SELECT *, CASE WHEN rid IS NULL THEN 'no-response' WHEN etag IS NOT NULL AND retag IS NOT NULL THEN CASE WHEN etag = retag THEN 'resolved' ELSE 'validator-mismatch' END
  WHEN modified IS NOT NULL AND rmodified IS NOT NULL THEN CASE WHEN modified = rmodified THEN 'resolved' ELSE 'validator-mismatch' END ELSE 'no-validator' END AS status FROM m)
SELECT page_id, url_key, CASE WHEN status = 'resolved' THEN rid END AS response_id, status,
  CASE WHEN status = 'resolved' THEN concat_ws(';', 'content-length=' || rn, 'content-type=text/html', 'date=' || ts, 'etag=' || coalesce(etag, retag), 'expires=' || (ts + 100), 'last-modified=' || coalesce(modified, rmodified)) END AS headers,
  CASE WHEN status = 'resolved' THEN rdigest END AS digest FROM s
"""
