"""The session on fixtures of its own: goldens of the dialect, cached tables, inserts, errors, text results."""

import io

import pytest

from millrace.cli import run
from millrace.plans.cache import CachedTables, CacheMode, InvalidCacheMode, mode_of, parse_ctas, parse_inserts, storage_level
from millrace.plans.session import QueryExecutionError, Warehouse


@pytest.fixture(scope="module")
def w(spark):
    """500 rows, keys 0 to 498, 309 of them distinct: 0 three times, 484 and 497 once, 98 and 100 twice."""
    keys = [0, 0, 0, 98, 98, 100, 100, 484, 497, 498]
    rest = [k for k in range(1, 497) if k not in (98, 100, 484)][:303]
    keys += rest + rest[:187]
    assert len(keys) == 500 and len(set(keys)) == 309
    old = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", "false")
    for t in ("test", "clicks", "users", "nulls", "nested"):
        spark.sql(f"DROP TABLE IF EXISTS {t}")
    spark.createDataFrame([(k, f"val_{k}") for k in keys], "key int, val string").write.saveAsTable("test")
    spark.createDataFrame([(1, 0), (2, 0), (1, 1), (2, 0), (1, 1), (None, None)], "id int, click int").write.saveAsTable("clicks")
    spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "id int, name string").write.saveAsTable("users")
    spark.createDataFrame([(None, "x")] * 10 + [(i, "y") for i in range(15)], "key int, val string").write.saveAsTable("nulls")
    spark.createDataFrame([("oak", ["leaf", "bark"], [{"height": "tall", "age": "old"}, {"height": None, "age": "young"}], {"north": ["fir", "elm"], "south": ["fig", "yew"]}), ("ash", [], None, None)], "a string, b array<string>, c array<map<string,string>>, d map<string,array<string>>").write.saveAsTable("nested")
    session = Warehouse(spark)
    for t in ("test", "clicks", "users", "nulls", "nested"):
        session.sql(f"CREATE TABLE {t}_cached AS SELECT * FROM {t}")
    yield session
    for t in ("test", "clicks", "users", "nulls", "nested"):
        session.sql(f"DROP TABLE {t}_cached")
        session.sql(f"DROP TABLE {t}")
    spark.conf.set("spark.sql.ansi.enabled", old)


GOLDENS = [
    ("SELECT count(*) FROM {test}", ["500"]), ("SELECT * FROM {test} WHERE key = 100 OR key = 497", ["100\tval_100", "100\tval_100", "497\tval_497"]), ("SELECT count(DISTINCT key) FROM {test}", ["309"]),
    ("SELECT val, count(*) FROM {test} WHERE key = 484 GROUP BY val", ["val_484\t1"]), ("SELECT count(*) FROM {test} WHERE key > -1", ["500"]), ("SELECT key, count(*) FROM {test} GROUP BY key ORDER BY key LIMIT 1", ["0\t3"]),
    ("SELECT val, sum(key) FROM {test} WHERE key = 98 GROUP BY val ORDER BY val DESC LIMIT 1", ["val_98\t196"]), ("SELECT count(*) FROM {clicks} c JOIN {users} u ON c.id = u.id", ["5"]),
    ("SELECT name, count(*) FROM {clicks} c JOIN {users} u ON c.id = u.id GROUP BY name HAVING name = 'A'", ["A\t3"]), ("SELECT count(*) FROM {nulls} WHERE key IS NULL", ["10"]),
    ("SELECT b FROM {nested} WHERE a = 'oak'", ['["leaf","bark"]']), ("SELECT c FROM {nested} WHERE a = 'oak'", ['[{"age":"old","height":"tall"},{"age":"young","height":null}]']),
    ("SELECT d FROM {nested} WHERE a = 'oak'", ['{"north":["fir","elm"],"south":["fig","yew"]}']), ("SELECT a, b, c FROM {nested} WHERE a = 'ash'", ["ash\t[]\tNULL"]),
    ("SELECT 1 / 0, cast('x' AS int), array(1)[3]", ["NULL\tNULL\tNULL"]), ("SELECT round(stddev(key), 3) = round(stddev_pop(key), 3), round(variance(key), 2) = round(var_pop(key), 2) FROM {test}", ["true\ttrue"]),
    ("SELECT field('b', 'a', 'b'), create_union(1, 5, 'five')", ['2\t{"tag":1,"v0":null,"v1":"five"}']), ("SELECT h, q FROM {users} LATERAL VIEW parse_url_tuple('http://e.org/p?k=1', 'HOST', 'QUERY:k') t AS h, q LIMIT 1", ["e.org\t1"]),
    ("SELECT to_date('2001-02-03 04:05:06'), date_add('2001-02-03', 2)", ["2001-02-03\t2001-02-05"]),
]


@pytest.mark.parametrize("suffix", ["", "_cached"])
@pytest.mark.parametrize("sql,want", GOLDENS)
def test_goldens(w, sql, want, suffix):
    names = {t: t + suffix for t in ("test", "clicks", "users", "nulls", "nested")}
    assert sorted(w.sql(sql.format(**names))) == sorted(want)


def test_sizes(w):
    assert len(w.sql("SELECT * FROM test")) == 500 and len(w.sql("SELECT * FROM test", 100)) == 100
    assert w.sql_to_df("SELECT * FROM users").union(w.sql_to_df("SELECT * FROM users")).select("name").distinct().count() == 2


def test_inserts(w):
    w.sql("CREATE TABLE more_cached AS SELECT * FROM test")
    w.sql("INSERT INTO TABLE more_cached SELECT * FROM test LIMIT 499")
    assert w.sql("SELECT count(*) FROM more_cached") == ["999"] and w.spark.catalog.isCached("more_cached")
    w.sql("INSERT OVERWRITE TABLE more_cached SELECT * FROM test LIMIT 499")
    assert w.sql("SELECT count(*) FROM more_cached") == ["499"]
    w.sql("INSERT OVERWRITE TABLE more_cached SELECT * FROM more_cached WHERE key < 0")
    assert w.sql("SELECT count(*) FROM more_cached") == ["0"]
    with pytest.raises(QueryExecutionError):
        w.sql("FROM test INSERT INTO TABLE more_cached SELECT * INSERT INTO TABLE test SELECT *")
    w.sql("DROP TABLE more_cached")
    assert "more_cached" not in w.cached


def test_what_is_cached(w):
    w.sql("CREATE TABLE by_property TBLPROPERTIES ('cache' = 'true', 'cache.storageLevel' = 'MEMORY_ONLY') AS SELECT * FROM users")
    w.sql("CREATE TABLE Mixed_Cached AS SELECT * FROM users")
    w.sql("CREATE TABLE plainly AS SELECT * FROM users")
    w.sql("CREATE TABLE off_cached TBLPROPERTIES ('any.cache' = 'false') AS SELECT * FROM users")
    w.sql("CREATE TABLE big_tachyon AS SELECT * FROM users")
    assert {"by_property", "MIXED_cached", "big_tachyon"} <= {t for t in ("by_property", "MIXED_cached", "big_tachyon") if t in w.cached}
    assert "plainly" not in w.cached and "off_cached" not in w.cached
    again = CachedTables(w.spark)
    assert {"by_property", "mixed_cached", "big_tachyon"} <= set(again.recover())
    assert "by_property TBLPROPERTIES" in again.definition("by_property")
    stats = w.cached.stats("by_property").collect()
    assert sum(r.rows for r in stats) == 3 and min(r.min_id for r in stats if r.rows) == 1
    for t in ("by_property", "Mixed_Cached", "plainly", "off_cached", "big_tachyon"):
        w.sql(f"DROP TABLE {t}")


def test_name_rule_can_be_off(spark):
    assert mode_of("a_cached", {}) is CacheMode.HEAP and mode_of("db.a_TACHYON", {}) is CacheMode.TACHYON
    assert mode_of("a_cached", {}, by_name=False) is CacheMode.NONE and mode_of("x", {"Any.Cache": "HEAP"}) is CacheMode.HEAP
    with pytest.raises(InvalidCacheMode):
        CacheMode.of("sometimes")
    with pytest.raises(ValueError):
        storage_level("NOWHERE")
    assert storage_level("memory_only_ser2") == storage_level("MEMORY_ONLY_2")


def test_parsing():
    assert parse_ctas("create table if not exists a.b TBLPROPERTIES ('cache'='true') as select 1") == ("a.b", {"cache": "true"}, "select 1", "", True)
    assert parse_ctas("CREATE TABLE t (a int)") is None
    assert parse_inserts("FROM x INSERT OVERWRITE TABLE a SELECT 1 INSERT INTO b SELECT 2 INSERT OVERWRITE LOCAL DIRECTORY '/q' SELECT 3") == [("a", True), ("b", False)]


def test_errors_and_variables(w):
    for bad in ("SELECT FROM WHERE", "SELECT nothing FROM test", "SELECT * FROM no_such_table"):
        with pytest.raises(QueryExecutionError):
            w.sql(bad)
    w.sql("SET hiveconf:lowest=497")
    assert w.sql("SELECT count(*) FROM test WHERE key >= ${hiveconf:lowest}") == ["2"]


def test_bucket_sample(w):
    parts = [w.sql(f"SELECT key FROM test TABLESAMPLE (BUCKET {i} OUT OF 4 ON key) s ORDER BY key") for i in range(1, 5)]
    assert sum(map(len, parts)) == 500 and all(int(k) % 4 == i for i, p in enumerate(parts) for k in p)


def test_bucket_sample_on_strings(w):
    parts = [w.sql(f"SELECT val FROM test TABLESAMPLE (BUCKET {i} OUT OF 3 ON val)") for i in (1, 2, 3)]
    assert sum(map(len, parts)) == 500 and all(100 < len(p) < 250 for p in parts)


def test_hash(w):
    one = lambda x: w.sql(f"SELECT hash({x})")
    assert one("'a', 1") == [str(31 * 97 + 1)] and one("cast(null as string)") == ["0"] and one("''") == ["0"] and one("true, false") == ["31"]
    assert one("-1") == ["-1"] and one("cast(-1 as bigint)") == ["0"] and one("'é'") == [str(-61 * 31 - 87)]
    long = "the quick brown fox jumps over it"
    want = 0
    for b in long.encode():
        want = (want * 31 + b + 2**31) % 2**32 - 2**31
    assert one(f"'{long}'") == [str(want)]
    with pytest.raises(QueryExecutionError):
        w.sql("SELECT hash(1.5D)")


def test_ngrams(w):
    text = "array(array('a', 'b', 'a', 'b', 'c'), array('x', 'a', 'b'))"
    assert w.sql(f"SELECT ngrams({text}, 2, 2) FROM users WHERE id = 2") == ['[{"ngram":["a","b"],"estfrequency":3.0},{"ngram":["b","a"],"estfrequency":1.0}]']
    found = w.sql_to_df(f"SELECT explode(context_ngrams({text}, array('a', null), 5)) AS x FROM users WHERE id = 2").collect()
    assert [(r.x.ngram, r.x.estfrequency) for r in found] == [(["b"], 3.0)]


def test_delimited_tables(w, tmp_path):
    (tmp_path / "rows.txt").write_text("1,p;q,k:v;m:\\N\n2,,\nbad,z,k:w\n")
    w.sql("CREATE TABLE loaded (id int, parts array<string>, of map<string,string>) ROW FORMAT DELIMITED FIELDS TERMINATED BY ',' COLLECTION ITEMS TERMINATED BY '\\073' MAP KEYS TERMINATED BY ':' STORED AS TEXTFILE")
    w.sql(f"LOAD DATA LOCAL INPATH '{tmp_path}/rows.txt' INTO TABLE loaded")
    w.sql(f"LOAD DATA LOCAL INPATH '{tmp_path}/rows.txt' OVERWRITE INTO TABLE loaded")
    rows = {r.id: (r.parts, r["of"]) for r in w.sql_to_df("SELECT * FROM loaded").collect()}
    assert rows == {1: (["p", "q"], {"k": "v", "m": None}), 2: ([], {}), None: (["z"], {"k": "w"})}
    with pytest.raises(QueryExecutionError):
        w.sql("CREATE EXTERNAL TABLE outside (a int) ROW FORMAT DELIMITED FIELDS TERMINATED BY ',' LOCATION '/tmp/x'")
    w.sql("DROP TABLE loaded")


def test_create_as_keeps_its_clauses(w, tmp_path):
    w.sql(f"CREATE TABLE made USING orc PARTITIONED BY (val) LOCATION '{tmp_path}/made' TBLPROPERTIES ('a'='b') AS SELECT key, val FROM test WHERE key < 3")
    said = {r.col_name: r.data_type for r in w.spark.sql("DESCRIBE FORMATTED made").collect()}
    assert said["Provider"] == "orc" and said["Location"].endswith("/made") and "a=b" in said["Table Properties"]
    assert len(w.spark.sql("SHOW PARTITIONS made").collect()) == 3
    w.sql("CREATE TABLE made_too STORED AS ORC AS SELECT 1 AS x")
    assert {r.col_name: r.data_type for r in w.spark.sql("DESCRIBE FORMATTED made_too").collect()}["Provider"] == "orc"
    with pytest.raises(QueryExecutionError):
        w.sql("CREATE TABLE made_cached PARTITIONED BY (val) AS SELECT key, val FROM test")
    w.sql("DROP TABLE made")
    w.sql("DROP TABLE made_too")


def test_console(w, tmp_path):
    out, err = io.StringIO(), io.StringIO()
    script = tmp_path / "s.sql"
    script.write_text("SELECT 'a;b' AS x; -- note; here\nSELECT count(*) FROM users;")
    assert run(w, f"source {script}; SELECT name FROM users WHERE id = 2", header=True, out=out, err=err) == 0
    assert out.getvalue().splitlines()[:2] == ["x", "a;b"] and out.getvalue().splitlines()[-1] == "B"
    assert "Time taken" in err.getvalue()
    assert run(w, "SELECT nope FROM users", out=out, err=err) == 1 and "FAILED" in err.getvalue()
