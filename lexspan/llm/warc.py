"""WARC revisits that say "not modified": each is resolved by an as-of join, on the canonical URL, to the latest earlier full
response; the validators must agree; the permitted headers of the revisit then update those of the response.

The as-of join has no group that grows with a URL's captures: they are cut into spans of time, each span's last response is
one row, these are carried forward from span to span, and inside a span a window looks back. Bodies don't take part; only
the response's id, validators and headers do.

Defined results. A capture at the same time as a response isn't after it; among responses of one time the greatest id is the
latest. A null or empty URL has a canonical URL of its own, '', and is never resolved. A null time can't be placed: such a
revisit isn't resolved and such a response isn't found. Repeated records each give a row. A revisit whose validators can't be
compared (neither an ETag nor a date on both sides) is 'no_validator'. No records: no rows. Only the named columns are read.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexspan.llm.common import materialize, table

# Header fields of a 304 response that update a stored one (RFC 9110, 15.4.5), and query keys that only track.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "gclid", "fbclid", "ref")

RECORDS = "record_id long, url string, at long, type string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www and a default port, http for https, no fragment, no trailing slash; query keys that only
    track are dropped and the others sorted."""
    u = F.coalesce(F.trim(url), F.lit(""))
    host = F.regexp_replace(F.lower(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(u, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), r"/+$", "")
    query = F.split(F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1), "&")
    kept = F.array_sort(F.filter(query, lambda p: (p != "") & ~F.substring_index(p, "=", 1).isin(*TRACKING)))
    return F.when(host == "", u).otherwise(F.concat(F.lit("http://"), host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def _lowered(headers: Column) -> Column:
    """Header names in lower case; of names that differ in case only, the smallest spelling's value."""
    e = F.array_sort(F.map_entries(F.coalesce(headers, F.create_map().cast("map<string,string>"))))
    names = F.array_distinct(F.transform(e, lambda x: F.lower(x["key"])))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(e, lambda x: F.lower(x["key"]) == n), 1)["value"]))


def _strong(etag: Column) -> Column:
    """What a weak comparison looks at."""
    return F.regexp_replace(F.trim(etag), "^W/", "")


def resolve_revisits(records: DataFrame, *, span: int = 10_000) -> DataFrame:
    """record_id, canonical, type, status, source_id and headers of each record (RECORDS).

    status: full, resolved, no_earlier_response, validator_mismatch or no_validator. source_id is the response that a revisit
    was compared with. headers: a response's own, a resolved revisit's merged ones, and null otherwise. span: units of
    `at` in a cut of time.
    """
    slim = records.select("record_id", canonical_url("url").alias("canonical"), "at", "type", _lowered(F.col("headers")).alias("headers"))
    slim = slim.withColumn("cut", F.floor(F.col("at") / span)).withColumn(
        "full", F.when((F.col("type") == "response") & F.col("at").isNotNull() & (F.col("canonical") != ""), F.struct("at", "record_id", "headers"))
    )
    last = slim.where("full is not null").groupBy("canonical", "cut").agg(F.max_by("full", F.struct("at", "record_id")).alias("full"))
    cuts = slim.select("canonical", "cut").distinct().join(last, ["canonical", "cut"], "left")
    before = Window.partitionBy("canonical").orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)
    carried = cuts.withColumn("carried", F.last("full", ignorenulls=True).over(before)).select("canonical", "cut", "carried")
    joined = slim.join(carried, ["canonical", "cut"], "left")
    # rows of one time don't see each other: a range that ends before the current time
    inside = Window.partitionBy("canonical", "cut").orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    near = F.max_by("full", F.when(F.col("full").isNotNull(), F.struct(F.col("full.at"), F.col("full.record_id")))).over(inside)
    found = joined.withColumn("near", near).withColumn("source", F.when((F.col("type") == "revisit") & F.col("at").isNotNull(), F.coalesce("near", "carried")))
    tag, own_tag = _strong(F.col("source.headers")["etag"]), _strong(F.col("headers")["etag"])
    day, own_day = F.trim(F.col("source.headers")["last-modified"]), F.trim(F.col("headers")["last-modified"])
    same = F.when(tag.isNotNull() & own_tag.isNotNull(), tag == own_tag).otherwise(day == own_day)
    status = (
        F.when(F.col("type") == "response", "full").when(F.col("source").isNull(), "no_earlier_response")
        .when(same.isNull(), "no_validator").when(same, "resolved").otherwise("validator_mismatch")
    )
    news = F.map_filter("headers", lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    merged = F.map_concat(F.map_filter(F.col("source.headers"), lambda k, _: ~F.array_contains(F.map_keys(news), k)), news)
    out = found.withColumn("status", status)
    headers = F.when(F.col("status") == "full", F.col("headers")).when(F.col("status") == "resolved", merged)
    return out.select("record_id", "canonical", "type", "status", F.col("source.record_id").alias("source_id"), headers.alias("headers"))


def header_text(headers: Column) -> Column:
    """Header lines, sorted by name."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(headers)), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")


def records_of(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], dict[str, str], int, bytes]]:
    """(WARC headers, HTTP headers, HTTP status, body) of each record of an uncompressed WARC stream. A cut record ends it."""

    def fields(lines: list[bytes]) -> dict[str, str]:
        return {k.strip().decode("latin-1").lower(): v.strip().decode("latin-1") for k, _, v in (x.partition(b":") for x in lines if b":" in x)}

    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        head = []
        while (line := stream.readline()).strip():
            head.append(line)
        own = fields(head)
        size = int(own.get("content-length", "0"))
        block = stream.read(size)
        if len(block) < size:
            return
        http, status = {}, 0
        if block.startswith(b"HTTP/"):
            top, _, block = block.partition(b"\r\n\r\n")
            first, *rest = top.split(b"\r\n")
            http, status = fields(rest), int(first.split()[1]) if len(first.split()) > 1 and first.split()[1].isdigit() else 0
        yield own, http, status, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Records of WARC files, plain or gzipped: record_uri, url, date, type, status, headers and body. A file is one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([("record_uri", pa.string()), ("url", pa.string()), ("date", pa.string()), ("type", pa.string()), ("status", pa.int32()), ("headers", pa.map_(pa.string(), pa.string())), ("body", pa.binary())])
        for b in batches:
            for raw in b["content"]:
                data = io.BytesIO(raw.as_py())
                for own, http, status, body in records_of(gzip.GzipFile(fileobj=data) if raw.as_py()[:2] == b"\x1f\x8b" else data):
                    row = [own.get("warc-record-id"), own.get("warc-target-uri"), own.get("warc-date"), own.get("warc-type"), status, list(http.items()), body]
                    yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, kind, strict=True)], schema=kind)

    schema = "record_uri string, url string, date string, type string, status int, headers map<string,string>, body binary"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def captures(pages: DataFrame, *, epoch: int = 4000) -> DataFrame:
    """The pages table as a crawl, for a table that has no captures: a page's id is its time; a page whose id has a hash that 3
    divides was asked for again and not modified. The site's version is the id's epoch, by which ETags change."""
    body = F.md5(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    again = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 8), 16, 10).cast("long") % 3 == 0
    version = F.concat(F.lit('"v'), F.floor(F.col("page_id") / epoch).cast("string"), F.lit('"'))
    date = F.concat(F.lit("t"), F.col("page_id").cast("string"))
    headers = F.when(again, F.create_map(F.lit("ETag"), F.concat(F.lit("W/"), version), F.lit("Date"), date, F.lit("Content-Length"), F.lit("0"))).otherwise(
        F.create_map(F.lit("ETag"), version, F.lit("Date"), date, F.lit("Content-Length"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("string"), F.lit("Digest"), body)
    )
    return pages.select(F.col("page_id").alias("record_id"), "url", F.col("page_id").alias("at"), F.when(again, "revisit").otherwise("response").alias("type"), headers.alias("headers"))


def op7_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = materialize(captures(table(spark, sf_dir, "pages")), "warc-captures")  # a digest of each body, made once
    found = resolve_revisits(records)
    return found.select(F.col("record_id").alias("page_id"), "canonical", "type", "status", "source_id", header_text(F.col("headers")).alias("headers"))


#: DuckDB SQL for op7_warc_revisits.
ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(trim(url), '') AS u, coalesce(html, '') AS html,
                  ('0x' || substr(md5(page_id::VARCHAR), 1, 8))::BIGINT % 3 = 0 AS again, '"v' || (page_id // 4000) || '"' AS version FROM pages),
     q AS (SELECT *, regexp_replace(lower(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)', 1)), '^www\\.|:(80|443)$', '', 'g') AS host,
                  regexp_replace(regexp_extract(u, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path,
                  list_sort(list_filter(string_split(regexp_extract(u, '^[^?#]*\\?([^#]*)', 1), '&'), lambda x: x <> '' AND string_split(x, '=')[1] NOT IN
                    ('utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'gclid', 'fbclid', 'ref'))) AS query FROM p),
     c AS (SELECT *, CASE WHEN host = '' THEN u ELSE 'http://' || host || path || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canonical FROM q),
     w AS (SELECT *, max(CASE WHEN NOT again AND canonical <> '' THEN page_id END) OVER (PARTITION BY canonical ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS src FROM c),
     j AS (SELECT w.page_id, w.canonical, w.again, w.version, w.html, s.page_id AS sid, s.version AS sver, s.html AS shtml
           FROM w LEFT JOIN p s ON w.again AND s.page_id = w.src)
SELECT page_id, canonical, CASE WHEN again THEN 'revisit' ELSE 'response' END AS type,
       CASE WHEN NOT again THEN 'full' WHEN sid IS NULL THEN 'no_earlier_response' WHEN version = sver THEN 'resolved' ELSE 'validator_mismatch' END AS status, sid AS source_id,
       CASE WHEN NOT again THEN 'content-length: ' || octet_length(encode(html)) || chr(10) || 'date: t' || page_id || chr(10) || 'digest: ' || md5(html) || chr(10) || 'etag: ' || version
            WHEN version = sver THEN 'content-length: ' || octet_length(encode(shtml)) || chr(10) || 'date: t' || page_id || chr(10) || 'digest: ' || md5(shtml) || chr(10) || 'etag: W/' || version END AS headers
FROM j
"""
