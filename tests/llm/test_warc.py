"""WARC records: parsing, canonical URLs, and revisits against a plain as-of search."""

import gzip

import duckdb
from pyspark.sql import functions as F

from millrace.llm.queries import op7_warc_revisits, oracle_sql
from millrace.llm.warc import RECORD, canonical_url, parse, read_records, record_bytes, resolve


def test_parse_round_trip():
    a = record_bytes("urn:a", "response", "http://x.org/", "2020-01-01T00:00:00Z", 200, {"ETag": '"1"', "Content-Type": "text/html"}, b"<p>\r\n\r\nWARC/1.1\r\n")
    b = record_bytes("urn:b", "revisit", "http://x.org/", "2020-01-02T00:00:00Z", 304, {"ETag": '"1"'}, b"")
    got = [*parse(a + b)]
    assert [r[0] for r in got] == ["urn:a", "urn:b"] and got[0][6] == b"<p>\r\n\r\nWARC/1.1\r\n" and got[1][4] == 304
    assert got[0][5] == {"etag": '"1"', "content-type": "text/html"}
    assert [*parse(b"")] == [] and [*parse(a[:-40])] == [] and [*parse(b"junk" + b)][0][0] == "urn:b"


def test_canonical_urls(spark):
    cases = {
        "http://WWW.Example.org:80/a//b/?b=2&a=1&utm_source=x#top": "example.org/a/b?a=1&b=2", "https://example.org/a/b?a=1&b=2": "example.org/a/b?a=1&b=2", "https://example.org:8443/": "example.org:8443",
        "http://h.org:443/": "h.org:443", "https://h.org:443/a": "h.org/a", "https://h.org:80": "h.org:80", "http://user:pw@h.org/x/": "h.org/x", "http://h.org?ref=1": "h.org", "no url": "no url", "": "",
    }
    df = spark.createDataFrame([(u,) for u in [*cases, None]], "url string")
    assert {r.url: r.c for r in df.select("url", canonical_url(F.col("url")).alias("c")).collect()} == cases | {None: None}


def test_resolution_is_as_of(spark):
    full = lambda i, u, d, h=None, s=200: (i, "response", u, d, s, h or {}, f"body {i}".encode())
    again = lambda i, u, d, h=None: (i, "revisit", u, d, 304, h or {}, b"")
    rows = [
        full("r1", "http://x.org/", "2020-01-01", {"etag": '"1"', "content-type": "t", "x": "old"}), full("r2", "https://www.x.org", "2020-01-03", {"etag": '"2"'}), full("r3", "http://x.org", "2020-01-04", {}, 404), full("r4", "http://y.org/", "2020-01-05"),
        again("v1", "http://x.org/#a", "2020-01-02", {"etag": 'W/"1"', "x": "new", "content-type": "never", "date": "d"}), again("v2", "http://x.org/", "2020-01-04", {"etag": '"1"'}), again("v3", "http://x.org/", "2019-01-01"), again("v4", "http://z.org/", "2021-01-01"),
        full("r5", "http://f.org", "2021-01-01T00:00:00Z"), again("v8", "http://f.org", "2021-01-01T00:00:00.500Z"), again("v9", "http://f.org", "2020-12-31T23:59:59.999Z"),
        again("v5", "http://y.org", "2020-01-05"), again("r0", "http://y.org", "2020-01-05"), again("v6", None, "2020-01-05"), again("v7", "http://x.org", None), again("v1", "http://x.org/", "2020-01-02", {"last-modified": "any"}),
    ]
    df = spark.createDataFrame(rows, RECORD).withColumn("range", F.lit(1))
    got = sorted((r.record_id, r.outcome, r.response_id, tuple(sorted((r.headers or {}).items()))) for r in resolve(df).collect())
    old = ("content-type", "t"), ("etag", '"1"')
    assert got == sorted([
        ("v1", "resolved", "r1", (old[0], ("date", "d"), old[1], ("x", "new"))), ("v1", "resolved", "r1", (old[0], old[1], ("last-modified", "any"), ("x", "old"))), ("v2", "mismatch", None, ()), ("v3", "missing", None, ()),
        ("v4", "missing", None, ()), ("v5", "resolved", "r4", ()), ("r0", "missing", None, ()), ("v7", "missing", None, ()), ("v6", "missing", None, ()), ("v8", "resolved", "r5", ()), ("v9", "missing", None, ()),
    ])
    assert resolve(df.limit(0)).count() == 0


def test_hot_url_over_many_ranges(spark):
    rows = [(f"{i:04d}", "response" if i % 10 == 0 else "revisit", "http://hot.org/", f"2020-01-01T00:{i // 60:02d}:{i % 60:02d}Z", 200 if i % 10 == 0 else 304, {}, b"") for i in range(500)]
    got = {r.record_id: r.response_id for r in resolve(spark.createDataFrame(rows, RECORD).repartition(8)).collect()}
    assert got == {f"{i:04d}": f"{i - i % 10:04d}" for i in range(500) if i % 10}


def test_files_and_query(spark, small):
    assert read_records(spark.createDataFrame([(None,), (b"",)], "content binary")).count() == 0
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{small}/pages.parquet'")
    found = con.execute(oracle_sql()["op7_warc_revisits"])
    names = [c[0] for c in found.description]
    got = op7_warc_revisits(spark, small)
    assert sorted(names) == sorted(got.columns)
    rows = got.select(*names).collect()
    assert sorted(map(tuple, rows)) == sorted(found.fetchall())
    assert {r.outcome for r in rows} == {"resolved", "mismatch", "missing"}


def test_compressed_files():
    records = [record_bytes(f"urn:{i}", "response", "http://x.org/", "2020-01-01T00:00:00Z", 200, {}, bytes(range(256)) * 1000) for i in range(5)]
    packed = b"".join(map(gzip.compress, records))
    assert [*parse(packed)] == [*parse(b"".join(records))] == [*parse(gzip.compress(b"".join(records)))]
    assert len([*parse(packed[:-30])]) == 4 and len([*parse(packed + b"rest")]) == 5
