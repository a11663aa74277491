"""Zone maps, text tables, operators and dialect rewrites on their own."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import compat
from millrace.operators import relational as rel
from millrace.plans import dialect, render
from millrace.plans.zones import All, Any_, Compare, flip, may_match, order_stats, partition_stats
from millrace.sources.readers import read_fixed_records, read_sequence, read_text_table, text_lines
from millrace.sources.sinks import write_buckets, write_directory, write_sequence


@pytest.mark.parametrize("low,high,inside,below,above", [(5, 9, 7, 1, 12), (0.2, 0.5, 0.3, 0.1, 0.7), ("b", "d", "c", "a", "e"), (False, False, False, None, True), (datetime.datetime(2001, 1, 1), datetime.datetime(2002, 1, 1), datetime.datetime(2001, 5, 1), datetime.datetime(2000, 1, 1), datetime.datetime(2003, 1, 1))])
def test_zone_pruning(low, high, inside, below, above):
    s = {"rows": 4, "min_c": low, "max_c": high, "nulls_c": 1}
    assert may_match(s, Compare("c", "=", inside)) and not may_match(s, Compare("c", "=", above)) and not may_match(s, Compare("c", ">", above)) and may_match(s, Compare("c", "<", above))
    if below is not None:
        assert not may_match(s, Compare("c", "=", below)) and not may_match(s, Compare("c", "<=", below)) and may_match(s, Compare("c", ">=", below))
    assert not may_match(s, Compare("c", ">", high)) and may_match(s, Compare("c", ">=", high)) and not may_match(s, Compare("c", "<", low)) and may_match(s, Compare("c", "<=", low))


def test_zone_logic():
    s = {"rows": 3, "min_c": 5, "max_c": 5, "nulls_c": 0}
    yes, no = Compare("c", "=", 5), Compare("c", ">", 5)
    assert may_match(s, Any_((yes, no))) and not may_match(s, All((yes, no))) and may_match(s, All((yes, "unknown"))) and may_match(s, Compare("other", "=", 1))
    assert not may_match(s, Compare("c", "!=", 5)) and may_match(s, Compare("c", "=", "text")) and not may_match({**s, "rows": 0}, yes) and not may_match({**s, "nulls_c": 3, "min_c": None, "max_c": None}, yes)
    assert not may_match({"rows": 2, "min_c": 0.0, "max_c": 0.5, "nulls_c": 0}, Compare("c", ">", 0.5)) and may_match({"rows": 2, "min_c": 0.0, "max_c": 0.5, "nulls_c": 0}, Compare("c", ">", 0.2))
    assert [flip(o) for o in ("<", ">=", "=")] == [">", "<=", "="]


def test_partition_stats(spark):
    df = spark.createDataFrame([(i, None if i % 2 else f"s{i}") for i in range(20)], "k int, s string").repartitionByRange(4, "k")
    stats = [r for r in partition_stats(df).collect()]
    assert sum(r.rows for r in stats) == 20 and sum(r.nulls_s for r in stats) == 10
    spans = sorted((r.min_k, r.max_k) for r in stats)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    order = order_stats(spark.createDataFrame([(1, 1), (2, 4), (3, 9)], "i int, v int").coalesce(1), "v", "i").first()
    assert (order.ascending, order.descending, order.max_step) == (True, False, 5)


def test_text_tables(spark, tmp_path):
    (tmp_path / "t").write_text("1\x01a\n\\N\x01\\N\nbad\x01b\x01surplus\n3\n\n")
    got = [tuple(r) for r in read_text_table(spark, f"file://{tmp_path}/t", "k int, v string").collect()]
    assert got == [(1, "a"), (None, None), (None, "b"), (3, None), (None, None)]
    (tmp_path / "n").write_text("x\x01p\x02q\x01k\x03v\x02m\x03\\N\x01d\x03e\x04f\ny\x01\x01\\N\n")
    rows = read_text_table(spark, f"file://{tmp_path}/n", "a string, b array<string>, c map<string,string>, d map<string,array<string>>").collect()
    assert rows[0].b == ["p", "q"] and rows[0].c == {"k": "v", "m": None} and rows[0].d == {"d": ["e", "f"]}
    assert rows[1].b == [] and rows[1].c is None and rows[1].d is None


def test_text_round_trip_of_types(spark, tmp_path):
    df = spark.sql("SELECT 1Y a, 2S b, 3 c, 4L d, 1.5F e, 2.5D f, true g, 'x' h, cast(null as int) i, timestamp'2001-02-03 04:05:06' j, array(1, null, 3) k, struct(1 as p, 'q' as q) l")
    write_directory(df, f"file://{tmp_path}/o")
    assert read_text_table(spark, f"file://{tmp_path}/o", df.schema).collect() == df.collect()
    assert text_lines(df.select("c", "h", "i")).first().value == "3\x01x\x01\\N"


def test_sequence_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", [1, 2]), (None, None, []), (3, "", None)], "k int, v string, a array<int>")
    write_sequence(df.repartition(2), f"file://{tmp_path}/seq")
    assert sorted(read_sequence(spark, f"file://{tmp_path}/seq", df.schema).collect(), key=str) == sorted(df.collect(), key=str)
    write_sequence(df.limit(0), f"file://{tmp_path}/none")
    assert not read_sequence(spark, f"file://{tmp_path}/none", df.schema).collect()


def test_bucketed_join_has_no_shuffle(spark, tmp_path):
    sides = []
    for name, key in (("l", "a"), ("r", "b")):
        write_buckets(spark.range(2000).withColumnRenamed("id", key), f"bucketed_{name}", f"file://{tmp_path}/{name}", key, 4)
        sides.append(spark.table(f"bucketed_{name}"))
    joined = sides[0].join(sides[1].hint("merge"), F.col("a") == F.col("b"))
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString() and joined.count() == 2000


def test_salted_join(spark):
    left = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 WHEN id % 50 = 1 THEN NULL ELSE id END AS k", "id AS v")
    right = spark.createDataFrame([(7, "x"), (7, "y"), (8, "z"), (None, "n"), (10**6, "far")], "k bigint, w string")
    for share in (0.001, 0.2, 1.0):
        got = sorted(map(tuple, rel.join_salted(left, right, "k", 4, share).collect()))
        assert got == sorted(map(tuple, left.join(right, "k").collect()))
    assert not rel.join_salted(left.limit(0), right, "k").collect()


def test_fixed_records(spark, tmp_path):
    (tmp_path / "r").write_bytes(bytes(range(250)) * 10)
    got = sorted((r.number, bytes(r.record)) for r in read_fixed_records(spark, f"file://{tmp_path}/r", 1000).collect())
    assert [len(b) for _, b in got] == [1000, 1000, 500] and b"".join(b for _, b in got) == bytes(range(250)) * 10


@pytest.mark.parametrize("k", range(6))
def test_top_k_over_many_partitions(spark, k):
    random.seed(k)
    keys = [random.randrange(1000) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in keys], "k int").repartition(50)
    assert [r.k for r in rel.top_k(df, k, "k").collect()] == sorted(keys)[:k]
    per = rel.top_k_by_partition(df.withColumn("p", F.spark_partition_id()), k, "k").groupBy("p").count().collect()
    assert all(r["count"] <= k for r in per)


def test_hashes(spark):
    def java(b):
        h = 0
        for x in b:
            h = (31 * h + (x - 256 if x > 127 else x)) & 0xFFFFFFFF
        return h - (1 << 32) if h >> 31 else h

    words = ["", "a", "hello world", "é的😀", None, "x" * 300]
    df = spark.createDataFrame([(w, i * 3_000_000_007) for i, w in enumerate(words)], "s string, n long")
    for r in df.select("s", "n", compat.string_hash(F.col("s")).alias("h"), compat.hive_hash(df, "s", "n").alias("row"), compat.integer_hash(F.col("n")).alias("i")).collect():
        want = java((r.s or "").encode())
        i = ((r.n >> 32) ^ r.n) & 0xFFFFFFFF
        i = i - (1 << 32) if i >> 31 else i
        both = (31 * want + i) & 0xFFFFFFFF
        assert r.h == want and r.i == i and r.row == (both - (1 << 32) if both >> 31 else both)


def test_rewrites():
    assert dialect.statements("a; 'b;c' ; -- d;\n e /* f; */;") == ["a", "'b;c'", "e /* f; */"]
    assert dialect.translate("SELECT field(x, 'a,b', ')'), 'field(y)'") == "SELECT (CASE x WHEN 'a,b' THEN 1 WHEN ')' THEN 2 ELSE 0 END), 'field(y)'"
    assert dialect.functions("select stddev(a), stddev_samp(b), variance(c + std(d))") == "select stddev_pop(a), stddev_samp(b), var_pop(c + stddev_pop(d))"
    assert dialect.substitute("${a} ${hiveconf:b} ${c}", {"a": "1", "b": "2"}) == "1 2 ${c}"
    assert "pmod" in dialect.bucket_samples("SELECT * FROM t TABLESAMPLE(BUCKET 1 OUT OF 2 ON k) s WHERE x = 1")


def test_rendering():
    assert render.line((1, None, True, 2.5, "x", [1, None], {"b": 1, "a": "q"}, datetime.date(2001, 2, 3), datetime.datetime(2001, 2, 3, 4, 5, 6), b"raw", float("nan"))) == '1\tNULL\ttrue\t2.5\tx\t[1,null]\t{"a":"q","b":1}\t2001-02-03\t2001-02-03 04:05:06\traw\tNaN'


def test_functions_register(spark):
    compat.register(spark)
    assert spark.sql("SELECT field3('b', 'a', 'b', 'c'), field_of('z', array('a')), url_part('http://h/p', 'HOST')").first()[:] == (2, 0, "h")


def test_order_by_nulls_first(spark, small):
    from millrace.operators.queries import QUERIES

    rows = [(r.k, r.o_orderkey) for r in QUERIES["order_by_nulls"](spark, small).collect()]
    assert rows == sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, -r[1])) and rows[0][0] is None and rows[-1][0] == 3
