"""SimHash fingerprints, links and components against plain versions."""

import random

import xxhash
from millrace.llm.simhash import components, fingerprint, keep_one, links, near_duplicates


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def plain_components(rows, distance=3):
    """{doc_id: smallest reachable} by comparing all fingerprints."""
    fps = {i: plain_fingerprint(t) for i, t in rows}
    ids, root = sorted(fps), {i: i for i in fps}
    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= distance:
                ra, rb = root[a], root[b]
                for k in ids:
                    if root[k] in (ra, rb):
                        root[k] = min(ra, rb)
    return root


TEXTS = ["", None, " \t\x0b", "one", "ONE two", "a b c", "A B C", "Ä ä Ö", "x " * 500, "the cat sat on the mat " * 30, "word\x00word \x1c x y"]


def test_fingerprints():
    for t in [*TEXTS, " ".join(map(str, range(70000)))[:400000]]:
        assert fingerprint(t) == plain_fingerprint(t)


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in near_duplicates(docs).collect()}
    want = plain_components(rows)
    assert got == {i: (plain_fingerprint(t), want[i]) for i, t in rows}


def test_links_find_all_pairs(spark):
    random.seed(5)
    base = [random.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for d in range(6):
            fps.add(b ^ sum(1 << i for i in random.sample(range(64), d)))
    fps |= {0, 1, 3, 2**64 - 1, 2**63, 0xFFFFFFFF, 0xFFFFFFFE00000001}
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    for segments in (2, 3, 4):
        got = {frozenset(r) for r in links(df, 3, segments).collect()}
        want = {frozenset((a, b)) for a in signed for b in signed if a < b and bin((a ^ b) % (1 << 64)).count("1") <= 3}
        assert got == want


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (-5, -4), (-4, -3)]
    df = spark.createDataFrame([(min(e), max(e)) for e in edges], "a long, b long")
    got = {r.node: r.root for r in components(df).collect()}
    assert got == {i: 0 for i in [*range(41), 100]} | {-5: -5, -4: -5, -3: -5}


def test_edges_and_stage(spark):
    rows = [(i, t, "k") for i, t in enumerate(TEXTS)] + [(3, "one", "k"), (None, "a b c", "k"), (None, "lonely text of its own here", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    found = near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.component_id for r in found if r.doc_id in (0, 1, 2)} == {0}  # no words: fingerprint zero, one group
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    want = {c.component_id for c in found if c.component_id is not None}
    assert got == sorted([(False, i) for i in want] + [(True, 0)])
    assert near_duplicates(docs.limit(0)).count() == 0 and keep_one(docs.limit(0)).count() == 0
