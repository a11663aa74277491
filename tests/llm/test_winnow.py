"""Benchmark decontamination against a plain version."""

import hashlib
import re

import pytest

from millrace.llm.winnow import contamination, decontaminate

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
P = [f"w{i}" for i in range(60)]


def plain(docs, items):
    words = lambda t: WORD.findall((t or "").translate(UP))
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if w else ():
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = set()
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= own
        out.add((doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)))
    return out


ITEMS = [(1, " ".join(P[:30])), (2, " ".join(P[10:40])), (3, "only three words"), (4, None), (5, "!!"), (6, "one"), (10, " ".join(P[:30])), (7, "a b a b a b a b a b a b a b a b"), (8, "É é " + " ".join(P[:12])), (1, " ".join(P[:30]))]
DOCS = [
    (1, "x " * 40 + " ".join(P[5:20]) + " y" * 9), (2, " ".join(P[5:17])), (3, "ONLY, Three-words! and one more"), (4, None), (5, ""), (6, " \n\t"), (7, "a b " * 40), (8, " ".join(P) * 3), (9, "é é " + " ".join(P[:12])),
    (10, "É é " + " ".join(P[:12])), (11, "far " * 300 + " ".join(P[:13])), (12, "word"), (12, "word"), (13, " ".join(P[::-1])), (None, " ".join(P[:20])), (14, "ǅ one İ"), (15, "z " * 5000 + "one"),
]


@pytest.mark.parametrize("bound", [10**6, 0])
def test_same_as_plain(spark, bound):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in DOCS], "doc_id long, text string, w string, fp int, n_words int")
    items = spark.createDataFrame([(i, t, 9) for i, t in ITEMS], "item_id long, text string, window int")
    got = [tuple(r)[:1] + tuple(r)[2:] for r in contamination(docs, items, broadcast_grams=bound, broadcast_windows=bound).collect()]
    assert set(got) == plain(DOCS, ITEMS)
    assert sorted(str(r[0]) for r in got) == sorted(str(i) for i, _ in DOCS)  # repeated rows each give one


def test_whole_table(spark, small):
    read = lambda t: spark.read.parquet(f"{small}/{t}.parquet")
    docs, items = read("documents").select("doc_id", "text"), read("benchmark")
    got = {tuple(r)[:1] + tuple(r)[2:] for r in contamination(docs, items).collect()}
    assert got == plain([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])


def test_stage_keeps_clean_rows_and_all_columns(spark):
    docs = spark.createDataFrame([(i, t, "c", 1, 2) for i, t in DOCS], "doc_id long, text string, items string, _bad_id long, text_hash long")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    bad = {r[0] for r in plain(DOCS, ITEMS) if r[2] > 0}
    kept = decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in DOCS if i not in bad)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(docs, items).count() == 0
    none = contamination(spark.createDataFrame(DOCS, docs.schema), items.limit(0)).collect()
    assert not any(r.contaminated or r.n_items for r in none) and len(none) == len(DOCS)
