"""WARC: not-modified revisits resolved to the full response that they confirm."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import column, map_batches, read

#: Header fields that describe the body sent; a not-modified answer has none, so its own
#: values must not replace those of the stored response (fixed values).
BODY_HEADERS = ["content-encoding", "content-length", "content-md5", "content-range", "content-type", "trailer", "transfer-encoding"]
#: Query parameters that don't choose the content (fixed values).
TRACKING = "utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid"
#: Seconds of a time bucket. A URL's captures are joined within buckets, and only one row a
#: bucket is carried over buckets, so a URL with very many captures is split.
BUCKET_S = 86_400


def canonical_url(url: Column) -> Column:
    """Host and path without scheme, www, port, fragment, tracking, index page or last slash."""
    u = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    u = F.regexp_replace(u, "^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(u, "^[^/?]*", 0)), "^www[.]", ""), ":[0-9]+$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(u, "^[^/?]*([^?]*)", 1), "(/index)?[.]html?$", ""), "/+$", "")
    query = F.regexp_replace(F.regexp_extract(u, "[?](.*)$", 1), f"(^|&)({TRACKING})=[^&]*", "")
    query = F.regexp_replace(query, "^&+", "")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def _header(headers: Column, name: str) -> Column:
    return F.try_element_at(headers, F.lit(name))


def _strong(tag: Column) -> Column:
    """An entity tag without its weakness mark: a not-modified answer compares weakly."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame, bucket_s: int = BUCKET_S) -> DataFrame:
    """Each revisit with the response that it stands for.

    records: record_id, warc_type (response or revisit), uri, at (seconds), headers (a map
    with lower-case names), and any payload_digest. A revisit is joined as of its time to the
    latest earlier response (not at the same second; ties by record_id) of its canonical URL.
    It is `resolved` if an entity tag of the revisit equals (weakly) the response's, or, if it
    sends no tag, its Last-Modified does; `mismatch` if these differ, `unchecked` if it sends
    neither or the response lacks it, `orphan` if no earlier response is there. Headers are
    the response's, replaced by the revisit's but for those that describe a body. Null times
    and URIs: a null time is never earlier nor later than another (orphan); null URIs are
    the URL "". Returns record_id, url, status, refers_to, payload_digest, headers.
    """
    digest = F.col("payload_digest") if "payload_digest" in records.columns else F.lit(None).cast("string").alias("payload_digest")
    rows = records.where(F.col("warc_type").isin("response", "revisit")).select(
        "record_id", (F.col("warc_type") == "revisit").alias("again"), canonical_url(F.col("uri")).alias("url"), "at",
        F.floor(F.col("at") / bucket_s).alias("bucket"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), digest.alias("payload_digest"),
    )
    full = F.when(~F.col("again") & F.col("at").isNotNull(), F.struct("at", "record_id", "payload_digest", "headers"))
    rows = rows.withColumn("full", full)
    inside = Window.partitionBy("url", "bucket").orderBy("at", F.col("again").desc(), "record_id").rowsBetween(Window.unboundedPreceding, 0)
    near = rows.withColumn("near", F.last("full", ignorenulls=True).over(inside))
    carried = rows.groupBy("url", "bucket").agg(F.max_by("full", F.when(F.col("full").isNotNull(), F.struct("at", "record_id"))).alias("end"))
    before = Window.partitionBy("url").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = carried.select("url", F.col("bucket").alias("b"), F.last("end", ignorenulls=True).over(before).alias("far"))
    found = near.where("again").join(carried.withColumnRenamed("url", "u"), (F.col("url") == F.col("u")) & F.col("bucket").eqNullSafe(F.col("b")), "left")
    met = F.when(F.col("at").isNotNull(), F.coalesce("near", "far"))
    found = found.withColumn("met", met)
    tag, tag_full = _header(F.col("headers"), "etag"), _header(F.col("met.headers"), "etag")
    since, since_full = _header(F.col("headers"), "last-modified"), _header(F.col("met.headers"), "last-modified")
    same = F.when(tag.isNotNull(), _strong(tag) == _strong(tag_full)).otherwise(since == since_full)
    status = (
        F.when(F.col("met").isNull(), "orphan").when(same, "resolved").when(~same, "mismatch").otherwise("unchecked")
    )
    sent = F.map_filter("headers", lambda k, _: ~k.isin(BODY_HEADERS))
    kept = F.map_filter("met.headers", lambda k, _: ~F.map_contains_key(sent, k))
    return found.select(
        "record_id", "url", status.alias("status"), F.when(same, F.col("met.record_id")).alias("refers_to"),
        F.when(same, F.col("met.payload_digest")).alias("payload_digest"),
        F.when(same, F.map_concat(kept, sent)).alias("headers"),
    )


def records_of(content: bytes) -> Iterator[dict]:
    """The records of a WARC file, plain or with gzip members; broken tails are left out."""
    if content[:2] == b"\x1f\x8b":
        parts, rest = [], content
        while rest[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            try:
                parts.append(member.decompress(rest))
            except zlib.error:
                break
            rest = member.unused_data
        content = b"".join(parts)
    at = 0
    while (at := content.find(b"WARC/", at)) >= 0:
        end = content.find(b"\r\n\r\n", at)
        if end < 0:
            return
        fields = _fields(content[at:end])
        size = fields.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(content):
            return
        block = content[end + 4 : end + 4 + int(size)]
        head, _, payload = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
        line = head.split(b"\r\n", 1)[0].split()
        yield {
            "record_id": fields.get("warc-record-id"), "warc_type": fields.get("warc-type"), "uri": fields.get("warc-target-uri", "").strip("<>") or None,
            "date": fields.get("warc-date"), "status": int(line[1]) if len(line) > 1 and line[1].isdigit() else None, "headers": _fields(head), "payload": payload,
        }
        at = end + 4 + int(size)


def _fields(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files (a path or glob that Spark can read), a file a row of work."""
    schema = "record_id string, warc_type string, uri string, date string, status int, headers map<string,string>, payload binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def make():
        def step(batch: pa.RecordBatch) -> dict | None:
            found = [r for content in column(batch, "content") for r in records_of(content)]
            return {n: [list(r[n].items()) if n == "headers" else r[n] for r in found] for n in names} if found else None

        return step

    files = spark.read.format("binaryFile").load(path).select("content")
    return map_batches(files, schema, make).select("record_id", "warc_type", "uri", F.unix_timestamp(F.try_to_timestamp("date")).alias("at"), "status", "headers", "payload", F.sha2("payload", 256).alias("payload_digest"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log of the pages: each fetched in full at second 600 * page_id, and asked
    for again 4,000,500 seconds later.

    The answer is a not-modified one with the page's tag; every third page's has only its
    date, every seventh's a tag of another version, and every eleventh's neither.
    """
    digest = F.md5(F.coalesce(F.col("html"), F.lit("")))
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("uri"), digest.alias("digest"))
    at, day = F.col("page_id") * 600, F.col("page_id").cast("string")
    full = own.select(
        F.concat(F.lit("f"), "page_id").alias("record_id"), F.lit("response").alias("warc_type"), "uri", at.alias("at"),
        F.create_map(F.lit("etag"), F.col("digest"), F.lit("last-modified"), day, F.lit("content-type"), F.lit("text/html"), F.lit("cache-control"), F.lit("no-cache")).alias("headers"),
        F.col("digest").alias("payload_digest"),
    )
    tag = F.when(F.col("page_id") % 7 == 0, F.lit("old")).otherwise(F.concat(F.lit("W/"), "digest"))
    none = F.col("page_id") % 11 == 0
    sent = F.map_from_arrays(
        F.when(none, F.array(F.lit("date"))).when(F.col("page_id") % 3 == 0, F.array(F.lit("date"), F.lit("last-modified"), F.lit("content-length"))).otherwise(F.array(F.lit("date"), F.lit("etag"), F.lit("cache-control"))),
        F.when(none, F.array(day)).when(F.col("page_id") % 3 == 0, F.array(day, day, F.lit("0"))).otherwise(F.array(day, tag, F.lit("max-age=60"))),
    )
    again = own.select(
        F.concat(F.lit("r"), "page_id").alias("record_id"), F.lit("revisit").alias("warc_type"), "uri", (at + 4_000_500).alias("at"),
        sent.alias("headers"), F.lit(None).cast("string").alias("payload_digest"),
    )
    return full.unionByName(again)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resolve(captures(read(spark, sf_dir, "pages")))
    text = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return found.select("record_id", "url", "status", "refers_to", "payload_digest", text.alias("headers"))


_CANONICAL = """
  lower(regexp_extract(u, '^[^/?]*')) AS host0, regexp_extract(u, '^[^/?]*([^?]*)', 1) AS path0,
  regexp_replace(regexp_replace(regexp_extract(u, '[?](.*)$', 1), '(^|&)(utm_[a-z]+|ref|fbclid|gclid|sessionid|phpsessid)=[^&]*', '', 'g'), '^&+', '') AS q
"""
OP4_SQL = f"""
WITH s AS (
  SELECT page_id, md5(coalesce(html, '')) AS digest,
    regexp_replace(regexp_replace(trim(coalesce(url, '')), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS u
  FROM pages),
t AS (SELECT page_id, digest, {_CANONICAL} FROM s),
p AS (
  SELECT page_id, digest,
    regexp_replace(regexp_replace(host0, '^www[.]', ''), ':[0-9]+$', '')
      || regexp_replace(regexp_replace(path0, '(/index)?[.]html?$', ''), '/+$', '')
      || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url
  FROM t),
r AS (
  SELECT page_id, url, page_id * 600 + 4000500 AS at, CAST(page_id AS VARCHAR) AS day,
    CASE WHEN page_id % 11 = 0 OR page_id % 3 = 0 THEN NULL WHEN page_id % 7 = 0 THEN 'old' ELSE digest END AS tag,
    CASE WHEN page_id % 11 <> 0 AND page_id % 3 = 0 THEN CAST(page_id AS VARCHAR) END AS since
  FROM p),
m AS (
  SELECT r.*, f.page_id AS full_id, f.digest AS full_digest
  FROM r ASOF LEFT JOIN (SELECT page_id, url, page_id * 600 AS at, digest FROM p) f ON r.url = f.url AND r.at > f.at),
c AS (
  SELECT *, CASE WHEN tag IS NOT NULL THEN tag = full_digest ELSE since = CAST(full_id AS VARCHAR) END AS same FROM m)
SELECT 'r' || page_id AS record_id, url,
  CASE WHEN full_id IS NULL THEN 'orphan' WHEN same THEN 'resolved' WHEN NOT same THEN 'mismatch' ELSE 'unchecked' END AS status,
  CASE WHEN same THEN 'f' || full_id END AS refers_to,
  CASE WHEN same THEN full_digest END AS payload_digest,
  CASE WHEN same AND tag IS NOT NULL
    THEN 'cache-control=max-age=60;content-type=text/html;date=' || day || ';etag=W/' || tag || ';last-modified=' || full_id
    WHEN same THEN 'cache-control=no-cache;content-type=text/html;date=' || day || ';etag=' || full_digest || ';last-modified=' || day
  END AS headers
FROM c
"""
