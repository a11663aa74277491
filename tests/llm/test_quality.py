"""The quality classifier: held-out accuracy, edges, and what it may look at."""

import math
import re
import zlib

import numpy as np

from millrace.llm.quality import fit, keep_good, quality_scores


def read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    scores = {r.doc_id: r for r in quality_scores(read(spark, d, "documents"), read(spark, d, "labels")).collect()}
    held = [(r.quality, scores[r.doc_id]) for r in read(spark, d, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert held and all(s.held_out for _, s in held)
    y, s = np.array([q for q, _ in held]), np.array([r.score for _, r in held])
    assert np.mean([(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]) > 0.97
    assert np.mean([(r.predicted == 1) == (q == 1) for q, r in held]) > 0.93
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scores.values())


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, "plain words here"), (3, "plain words here"), (None, "x"), (4, "é " * 60000)]
    docs = spark.createDataFrame([(i, t, "en", 1.0, "z") for i, t in rows], "doc_id long, text string, lang string, score double, words string")
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (1, None, 0), (1, 7, 0)], "doc_id long, quality int, toxic int")
    got = quality_scores(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality_scores(docs, labels.limit(0)).collect()} == {0.5}
    assert quality_scores(docs.limit(0), labels).count() == 0
    kept = keep_good(docs, labels.limit(0))
    assert kept.columns == docs.columns and kept.count() == len(rows)


def test_learning_ignores_held_out_labels(spark):
    docs = spark.createDataFrame([(i, ("good words " if i % 2 else "### !!! ") * (5 + i % 7)) for i in range(60)], "doc_id long, text string")
    label = lambda i: i % 2
    first = [(i, label(i)) for i in range(60)]
    turned = [(i, 1 - label(i) if zlib.crc32(str(i).encode()) % 5 == 0 else label(i)) for i in range(60)]
    a, b = (sorted(map(tuple, quality_scores(docs, spark.createDataFrame(x, "doc_id long, quality int")).collect())) for x in (first, turned))
    assert a == b


def test_one_class_and_constant_features():
    x = np.ones((3, 2))
    model = fit({1: (3, x.sum(0), x.T @ x)})
    assert np.isfinite(model.score(x)).all()


def plain_statistics(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x]
    n, w, k = max(len(text), 1), max(len(words), 1), max(len(lines), 1)
    patterns = ("[A-Z]", r"[#*$%&<>@=+~^_{}\\\[\]]", "[!?]", "[|]", "[0-9]", "[.,;:]", r"[\x20\x09-\x0D]", "[^\x00-\x7f]")
    shares = [math.sqrt(len(re.findall(p, text)) / n) for p in patterns]
    return [*shares, math.log1p(len(words)), math.log1p(len(text) / w), math.sqrt(len(set(words)) / w), math.sqrt(1 - len(set(lines)) / k), math.log1p(len(words) / k)]


def test_scores_are_those_of_plain_densities(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality for r in labels.collect()}
    x = {r.doc_id: np.array(plain_statistics(r.text)) for r in docs.collect()}
    train = [(x[i], q) for i, q in known.items() if i in x and zlib.crc32(str(i).encode()) % 5]
    every = np.array([v for v, _ in train])
    scale = np.sqrt(np.maximum(every.var(0), 1e-6))
    z = lambda v: (v - every.mean(0)) / scale
    pooled = np.cov(z(every).T, bias=True)
    parts = []
    for c in (0, 1):
        own = z(np.array([v for v, q in train if q == c]))
        cov = 0.9 * (np.cov(own.T, bias=True) if len(own) > every.shape[1] else pooled) + 0.1 * pooled
        cov = 0.98 * cov + 0.02 * np.trace(cov) / len(cov) * np.eye(len(cov))
        parts.append((own.mean(0), np.linalg.inv(cov), np.log(len(own) / len(train)) - 0.5 * np.linalg.slogdet(cov)[1]))
    for r in quality_scores(docs, labels).collect():
        d = [o - 0.5 * (z(x[r.doc_id]) - m) @ inv @ (z(x[r.doc_id]) - m) for m, inv, o in parts]
        want = 1 / (1 + math.exp(min(500, max(-500, d[0] - d[1]))))
        assert abs(r.score - want) < 1e-6 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3)
