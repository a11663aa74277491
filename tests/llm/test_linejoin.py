"""Line dedup against a plain version."""

import random
import re

import duckdb
import pytest

import corpus_pipeline
from millrace.llm import linejoin
from millrace.llm import queries as llm
from millrace.llm.linejoin import dedup_lines, line_report

WS = r"[\x20\x09-\x0D]+"


def plain(rows):
    """{(doc_id, line)} that an earlier line is similar to; rows in order, null doc_ids last."""
    lines = []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for i, line in enumerate(text.split("\n") if text is not None else ()):
            words = {w for w in re.split(WS, line.lower()) if w}
            if words:
                lines.append((doc_id, i, words))
    out = set()
    for k, (doc_id, i, words) in enumerate(lines):
        for _, _, other in lines[:k]:
            common = len(words & other)
            if common * 1000 >= 800 * (len(words) + len(other) - common):
                out.add((doc_id, i))
                break
    return out


BASE = [f"t{i}" for i in range(40)]
ROWS = [
    (1, "The quick brown fox\nTHE  quick\tbrown fox\nshort line\nshort line"), (2, "the quick brown fox jumps\nquick brown fox the"), (3, None), (4, ""), (5, "\n\n"),
    (6, " ".join(BASE)), (7, " ".join(BASE[1:] + ["new"])), (8, " ".join(BASE[4:])), (9, " ".join(BASE[9:])), (10, " ".join(BASE[3:] + [f"u{i}" for i in range(3)])), (11, " ".join(BASE[::-1])),
    (-7, "zero\nminus seven comes before all\nnow the second line of it"), (-6, "x\nminus seven comes before all\nnow the second line of this"), (20, "minus seven comes before all others"),
    (None, "the quick brown fox\nonly here are such words"), (12, "a b c d e\r\na b c d e f\x0b"), (13, " ".join(f"v{i}" for i in range(3000))), (14, " ".join(f"v{i}" for i in range(200, 3000))), (15, "x " * 9000 + "y z w q"),
]


def test_same_as_plain(spark):
    df = spark.createDataFrame([(i, t, "c", 5) for i, t in ROWS], "doc_id long, text string, cls string, line int")
    report = line_report(df).collect()
    assert {(r.doc_id, i) for r in report for i in r.removed} == plain(ROWS)
    assert {(r.doc_id, r.n_lines) for r in report} == {(i, 0 if t is None else len(t.split("\n"))) for i, t in ROWS}
    assert all(r.n_removed == len(r.removed) for r in report)


def test_whole_table(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in df.collect()]
    assert {(r.doc_id, i) for r in line_report(df).collect() for i in r.removed} == plain(rows)


def test_same_as_sql(small):
    """The SQL gives the rows that the plain version gives."""
    con, columns = duckdb.connect(), "unnest($ids) as doc_id, unnest($texts) as text"
    tables = [[(r[0], r[1]) for r in con.execute(f"select doc_id, text from '{small}/documents.parquet'").fetchall()], ROWS, []]
    for rows in tables:
        con.execute("create or replace table documents (doc_id bigint, text varchar)")
        con.execute(f"insert into documents select {columns}", {"ids": [i for i, _ in rows], "texts": [t for _, t in rows]})
        found = con.execute(llm.oracle_sql()["op9_line_dedup"]).fetchall()
        assert {(i, k) for i, _, _, removed in found for k in removed} == plain(rows)
        assert sorted(((i is None, i, n) for i, n, _, _ in found), key=str) == sorted(((i is None, i, 0 if t is None else len(t.split("\n"))) for i, t in rows), key=str)
        assert all(n == len(removed) for _, _, n, removed in found)


def test_texts(spark):
    df = spark.createDataFrame([(i, t, len(t or "")) for i, t in ROWS], "doc_id long, text string, n_chars long")
    gone = plain(ROWS)
    want = {}
    for i, t in ROWS:
        kept = None if t is None else [line for k, line in enumerate(t.split("\n")) if (i, k) not in gone]
        if kept is None or kept:
            want[i] = t if t is None else "\n".join(kept)
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text or "") for r in got.values())


def variants():
    """Lines of 4 to 300 words, each with many copies from which some words are changed, left out or added."""
    rng, rows = random.Random(5), []
    for n in (4, 5, 9, 20, 47, 48, 49, 60, 75, 89, 91, 100, 112, 130, 200, 300):
        words = [f"w{rng.randrange(400)}" if rng.random() < 0.5 else f"r{rng.randrange(10**6)}" for _ in range(n)]
        for _ in range(25):
            share = rng.choice((0.01, 0.05, 0.1, 0.12, 0.2))
            other = [w if rng.random() > share else rng.choice(("", f"x{rng.randrange(10**6)}", f"w{rng.randrange(400)} y{rng.randrange(9)}")) for w in words]
            rows.append(" ".join(rng.sample(other, len(other))))
    rng.shuffle(rows)
    return [(i, "\n".join(rows[3 * i : 3 * i + 3])) for i in range(len(rows) // 3 + 1)]


@pytest.mark.parametrize("hot", [3, 10**9])
def test_variants(spark, monkeypatch, hot):
    monkeypatch.setattr(linejoin, "_HOT", hot)
    monkeypatch.setattr(linejoin, "_LEADS", 2)
    rows = variants()
    want = plain(rows)
    assert 100 < len(want) < 350
    assert {(r.doc_id, i) for r in line_report(spark.createDataFrame(rows, "doc_id long, text string")).collect() for i in r.removed} == want


def test_columns_of_any_name(spark):
    names = ["_doc", "_sub", "_copy", "_hash", "_rows", "_gone", "_kept", "_rest", "line", "cls", "a.b", "a`b"]
    row = (1, "one two three four\nfive", *range(len(names)))
    docs = spark.createDataFrame([row, (2, "four three two one\nsix", *range(1, len(names) + 1))], ["doc_id", "text", *names])
    found = dedup_lines(docs)
    assert found.columns == docs.columns
    assert sorted(map(tuple, found.collect())) == [row, (2, "six", *range(1, len(names) + 1))]


def test_repeated_rows_and_empty_table(spark):
    twice = [(1, "one two three four"), (1, "one two three four"), (1, "five six seven eight"), (2, "five six seven eight nine")]
    report = line_report(spark.createDataFrame(twice, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, tuple(r.removed)) for r in report) == [(1, ()), (1, ()), (1, (0,)), (2, (0,))]
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert line_report(empty).count() == 0 and dedup_lines(empty).columns == empty.columns


def test_lines_of_few_words(spark, tmp_path):
    rows = [*ROWS, (30, "}\nend\n\nEND\nb a\n你好世界再见\nno no no no no"), (31, "a  b\n你好世界再见\n}\n\nno\na b c"), (32, "a b c d\na b c"), (33, "c b a\na b c d e\na b c d f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    want, found = plain(rows), llm.op9_line_dedup(spark, str(tmp_path)).collect()
    assert {(30, 3), (31, 0), (31, 1), (31, 2), (31, 4), (32, 1), (33, 0), (33, 1)} <= want and not {(31, 3), (30, 2)} & want
    assert {(r.doc_id, i) for r in found for i in r.removed} == want
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, df, str(tmp_path)).collect()}
    assert left[31] == "\n".join(line for i, line in enumerate(rows[-3][1].split("\n")) if (31, i) not in want)


def test_rows_that_share_a_doc_id(spark):
    a, b = "one two three four\nonly in the first row", "one two three four\nmet in no other row"
    rows = [(None, a), (None, b), (None, "its very own first line"), (7, "seven has a line here"), (7, "seven has another one there"), (7, "one two three four"), (9, "\ntwice the same row here"), (9, "\ntwice the same row here"), (None, None), (None, None), (-3, "seven has a line here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted((r.doc_id or 0, r.n_lines, tuple(r.removed)) for r in line_report(docs).collect())
    assert found == sorted([(0, 2, (0,)), (0, 2, (0,)), (0, 1, ()), (7, 1, (0,)), (7, 1, ()), (7, 1, ()), (9, 2, ()), (9, 2, (1,)), (0, 0, ()), (0, 0, ()), (-3, 1, ())])
    left = sorted((r.doc_id or 0, r.text or "") for r in dedup_lines(docs).collect())
    assert left == sorted([(0, "only in the first row"), (0, "met in no other row"), (0, "its very own first line"), (7, "seven has another one there"), (7, "one two three four"), (9, rows[6][1]), (9, ""), (0, ""), (0, ""), (-3, "seven has a line here")])


def test_each_pass_shuffles_its_prefixes_once(spark, monkeypatch):
    plans, write = [], linejoin.materialize

    def watched(df, name, *args):
        if name == "line-candidates":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return write(df, name, *args)

    monkeypatch.setattr(linejoin, "materialize", watched)
    rows = [(i, f"a b c d e f g h i w{i % 7}\nof its own v{i} u{i} t{i}") for i in range(30)]
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")  # as on large tables
    try:
        found = linejoin.line_report(spark.createDataFrame(rows, "doc_id long, text string"))
        assert sum(r.n_removed for r in found.collect()) == 29
    finally:
        spark.conf.set(limit, before)
    plans = [x for x in plans if "EmptyRelation" not in x]  # a pass may have no pairs
    assert plans
    for plan in plans:
        assert len(re.findall(r"- Exchange hashpartitioning\((?:[xy]_)?token", plan)) == 1 and plan.count("ReusedExchange") == 1


@pytest.mark.parametrize("percent", [50, 80, 95, 100])
def test_words_meet_in_sizes_that_can_be_similar(spark, percent):
    """A smaller set's word and a larger one's meet once if sets of such sizes can be similar with this first shared word."""
    sizes, t = [*range(4, 60), 99, 100, 124, 125, 126, 400, 500], percent / 100
    need = lambda n, m: -(-(n + m) * percent // (100 + percent))
    rows = [(n, p, n - need(n, n) + 1) for n in sizes for p in range(n - -(-n * percent // 100) + 1)]
    posts = spark.createDataFrame(rows, "n int, pos int, short int").selectExpr("*", "7L token", "n * 1000L + pos cls", "0L doc", "0L at", "0L b0", "0L b1", "true open")
    found = linejoin._banded(posts.withColumn("own", linejoin._band(posts.n)), t).collect()
    leads, homes = {}, {}
    for r in found:
        assert r.marks >> 3 == r.cls % 1000 and r.marks & 1
        for mark, side in ((4, leads), (2, homes)):
            if r.marks & mark:
                side.setdefault(r.token, []).append((r.n, r.marks >> 3))
    met = [(x, y) for k in leads for x in leads[k] for y in homes.get(k, ())]
    assert len(met) == len(set(met))
    able = {((n, p), (m, q)) for n, p, short in rows for m, q, _ in rows if p < short and n <= m and n * 100 >= m * percent and min(n - p, m - q) >= need(n, m)}
    assert able <= set(met)
    assert all(m <= n / t * linejoin._BAND and n <= m * linejoin._BAND for (n, _), (m, _) in met)
