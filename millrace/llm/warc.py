"""WARC records: writing, parsing, and resolving not-modified revisits to the response that they stand for.

A revisit (WARC-Type revisit, profile server-not-modified, status 304) takes its body from the latest earlier full
response of the same canonical URL, if its validators agree. That as-of join is done in ranges of (url, date): within a
range by a running last value, across ranges through one row a range and URL, so no URL's records need meet in a task.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from datetime import datetime, timezone

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Query parameters that name a visit, not a page.
TRACKING = ("ref", "fbclid", "gclid", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "sessionid")
#: Headers that a 304 may update in the stored response (RFC 9111, 3.2); those of the body and the connection may not.
_FIXED = ("content-length", "content-encoding", "content-type", "content-range", "transfer-encoding", "connection", "keep-alive", "proxy-connection", "te", "trailer", "upgrade", "etag")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/server-not-modified"
RECORD = "record_id string, type string, url string, date string, status int, headers map<string,string>, body binary"


def canonical_url(url: Column) -> Column:
    """Lower-case host without www., no scheme, default port, fragment, tracking parameters or closing slash; sorted query.

    A null URL stays null, and a string that is no URL is kept as it is, trimmed.
    """
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    part = lambda i: F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?@]*@)?([^/?:]*)(?::(\d+))?([^?]*)(?:\?(.*))?$", i)
    host = F.regexp_replace(F.lower(part(2)), r"^www\d?\.|\.$", "")
    usual = F.concat_ws(":", F.lower(part(1)), part(3)).isin("http:80", "https:443")
    port = F.when((part(3) == "") | usual, "").otherwise(F.concat(F.lit(":"), part(3)))
    path = F.regexp_replace(F.regexp_replace(part(4), "/+", "/"), "/$", "")
    asked = F.array_sort(F.filter(F.split(part(5), "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING)))
    query = F.when(F.size(asked) > 0, F.concat(F.lit("?"), F.array_join(asked, "&"))).otherwise("")
    return F.when(host != "", F.concat(host, port, path, query)).otherwise(bare)


def record_bytes(record_id: str, kind: str, url: str, date: str, status: int, headers: dict[str, str], body: bytes, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record around an HTTP response."""
    reason = {200: "OK", 304: "Not Modified"}.get(status, "Status")
    http = f"HTTP/1.1 {status} {reason}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers.items()) + b"\r\n" + body
    own = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Target-URI": url, "WARC-Date": date, "Content-Type": "application/http; msgtype=response"}
    own |= {"WARC-Profile": PROFILE} if kind == "revisit" else {"WARC-Payload-Digest": "sha1:" + hashlib.sha1(body).hexdigest()}
    own |= {"WARC-Refers-To-Target-URI": refers_to} if refers_to else {}
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in {**own, "Content-Length": len(http)}.items()).encode() + b"\r\n" + http + b"\r\n\r\n"


def _headers(block: bytes) -> dict[str, str]:
    found: dict[str, str] = {}
    for line in re.split(rb"\r?\n", block):
        name, colon, value = line.partition(b":")
        if colon:
            key, text = name.strip().decode("utf-8", "replace").lower(), value.strip().decode("utf-8", "replace")
            found[key] = f"{found[key]}, {text}" if key in found and key != "content-length" else text
    return found


def _members(data: bytes):
    """The contents of each gzip member, one after another; what a member that is cut short still gives comes last."""
    view, at = memoryview(data), 0
    while data[at : at + 2] == b"\x1f\x8b":
        one, parts = zlib.decompressobj(31), []
        while not one.eof and at < len(data):
            given = view[at : at + (1 << 16)]
            try:
                parts.append(one.decompress(given))
            except zlib.error:
                yield b"".join(parts)
                return
            at += len(given) - len(one.unused_data)
        yield b"".join(parts)


def parse(data: bytes):
    """(record_id, type, url, date, status, headers, body) of each record; one that is cut short ends the file or, in a
    compressed file, its member."""
    if data[:2] == b"\x1f\x8b":
        for member in _members(data):
            yield from parse(member)
        return
    at = 0
    while (at := data.find(b"WARC/1.", at)) >= 0:
        end = data.find(b"\r\n\r\n", at)
        if end < 0:
            return
        own = _headers(data[at:end])
        size = own.get("content-length", "")
        if not size.isdigit() or end + 4 + int(size) > len(data):
            return
        block = data[end + 4 : end + 4 + int(size)]
        at = end + 4 + int(size)
        head, _, body = block.partition(b"\r\n\r\n")
        m = re.match(rb"HTTP/\d\S* (\d{3})", head)
        http = _headers(head) if m else {}
        yield own.get("warc-record-id", "").strip("<>"), own.get("warc-type", ""), own.get("warc-target-uri"), own.get("warc-date"), int(m[1]) if m else None, http, body if m else block


def read_records(files: DataFrame) -> DataFrame:
    """The RECORD rows of a column `content` of whole WARC files, plain or gzip; null and empty files have none."""

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows = [*parse(content.as_py() or b"")]
                cols = [*zip(*rows)] if rows else [()] * 7
                kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.binary()]
                values = [[*map(lambda h: [*h.items()], c)] if i == 5 else [*c] for i, c in enumerate(cols)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["record_id", "type", "url", "date", "status", "headers", "body"])

    return files.select("content").mapInArrow(run, RECORD)


def _same(a: str, b: str) -> Column:
    return F.regexp_replace(F.col(a), "^W/", "") == F.regexp_replace(F.col(b), "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Each revisit with its outcome: record_id, canonical, outcome, response_id, status, headers, body_length, body_sha256.

    outcome is resolved; mismatch, if both records have an entity tag, or else both a date of modification, and they
    differ; or missing, if no earlier full response (status 200) of the canonical URL is there. Dates are compared as points
    in time. Of records with one date the one with the smaller record_id counts as earlier; dates that are null or can't be
    read come first. A resolved revisit has the response's
    status and headers, updated by its own where a 304 may do so. A revisit with a null URL is missing. Repeated rows each
    give a row; an empty table gives an empty result. Bodies stay where they are: only their length and digest travel.
    """
    own = records.select(
        "record_id", "type", canonical_url(F.col("url")).alias("canonical"), F.col("date").try_cast("timestamp").alias("date"), "status", "headers", F.length("body").alias("body_length"), F.sha2("body", 256).alias("body_sha256"),
        ((F.col("type") == "response") & (F.col("status") == 200)).alias("full"), (F.col("type") == "revisit").alias("revisit"),
    )
    # written before it is dealt by range, which would read the files once more for a sample
    own = materialize(own.filter("full or revisit"), "records")
    lost, own = own.filter("revisit and canonical is null"), own.filter("canonical is not null")
    parts = max(1, int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["canonical", "date", "record_id"]
    dealt = materialize(own.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()), "captures")
    kept = ["record_id", "status", "headers", "body_length", "body_sha256"]
    value = F.when(F.col("full"), F.struct("date", *kept))
    ends = dealt.filter("full").groupBy("canonical", "range").agg(F.max_by(F.struct("date", *kept), F.struct("date", "record_id")).alias("end"))
    # One row a range and URL: what the ranges before hand on.
    before = Window.partitionBy("canonical").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    marks = dealt.select("canonical", "range").distinct().join(ends, ["canonical", "range"], "left").withColumn("handed", F.last("end", True).over(before)).select("canonical", "range", "handed")
    within = Window.partitionBy("canonical", "range").orderBy("date", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = dealt.withColumn("local", F.last(value, True).over(within)).filter("revisit").join(marks, ["canonical", "range"])
    rows = rows.withColumn("r", F.coalesce("local", "handed"))
    get = lambda m, k: F.get(F.map_values(F.map_filter(m, lambda key, _: key == k)), F.lit(0))
    rows = rows.withColumns({"tag": get("headers", "etag"), "old_tag": get("r.headers", "etag"), "since": get("headers", "last-modified"), "old_since": get("r.headers", "last-modified")})
    agree = F.when(F.col("tag").isNotNull() & F.col("old_tag").isNotNull(), _same("tag", "old_tag")).when(F.col("since").isNotNull() & F.col("old_since").isNotNull(), F.col("since") == F.col("old_since")).otherwise(True)
    outcome = F.when(F.col("r").isNull(), "missing").when(agree, "resolved").otherwise("mismatch")
    may = F.map_filter("headers", lambda k, _: ~k.isin(*_FIXED))
    merged = F.map_concat(F.map_filter("r.headers", lambda k, _: ~F.coalesce(F.array_contains(F.map_keys(may), k), F.lit(False))), may)
    rows = rows.withColumn("outcome", outcome)
    done = F.col("outcome") == "resolved"
    cols = {"response_id": F.col("r.record_id"), "status": F.col("r.status"), "headers": merged, "body_length": F.col("r.body_length"), "body_sha256": F.col("r.body_sha256")}
    found = rows.select("record_id", "canonical", "outcome", *[F.when(done, c).alias(k) for k, c in cols.items()])
    none = [F.lit(None).cast(found.schema[k].dataType).alias(k) for k in cols]
    return found.union(lost.select("record_id", "canonical", F.lit("missing"), *none))


def captures(pages: DataFrame) -> DataFrame:
    """(page_id, content): for each page a WARC file of its response and of a revisit, made from the page alone.

    Pages hold no headers, so validators come from the page: its entity tag from its html, its dates from page_id. The
    revisit is of the page's URL under another scheme, with a fragment; every fifth one comes before the response, and
    every seventh one reports another entity tag than that of the html.
    """

    def run(batches):
        for batch in batches:
            out = []
            for page_id, url, html in zip(*(batch.column(i).to_pylist() for i in range(3))):
                body, n = (html or "").encode(), page_id or 0
                tag = f'"{hashlib.md5(body).hexdigest()}"'
                at = 1_600_000_000 + n * 7919 % 1_000_000
                when, later = (datetime.fromtimestamp(x, timezone.utc) for x in (at, at + (n % 5 - 1) * 50_000 + 1))
                seen = f'W/"{hashlib.md5(body + b"changed").hexdigest()}"' if n % 7 == 3 else f"W/{tag}"
                http = {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(len(body)), "ETag": tag, "Last-Modified": when.strftime("%a, %d %b %Y %H:%M:%S GMT"), "Cache-Control": "max-age=60"}
                again = {"ETag": seen, "Cache-Control": "max-age=3600", "Date": later.strftime("%a, %d %b %Y %H:%M:%S GMT")}
                url = url or ""
                other = "http" + url[5:] if url.startswith("https:") else "https" + url[4:] if url.startswith("http:") else url
                stamp = "%Y-%m-%dT%H:%M:%SZ"
                out.append(record_bytes(f"urn:page:{page_id}:response", "response", url, when.strftime(stamp), 200, http, body) + record_bytes(f"urn:page:{page_id}:revisit", "revisit", other.split("#")[0] + "#again", later.strftime(stamp), 304, again, b"", url))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["page_id", "content"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, content binary")
