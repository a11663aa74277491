"""Quality rules: counts against a plain version, exact bounds, and the guarantee on labels that were not used."""

import math
import random
import re
import zlib
from collections import Counter

import pytest

from millrace.llm.rules import RULES, apply_rules, binomial_at_most, choose_cutoff, cutoffs, rule_statistics


def plain(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    repeated = {p for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, r = len(words), len(repeated)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), r, n < 50 or 100 * r > 50 * n


ROWS = [
    (1, None), (2, ""), (3, " \n\t\n"), (4, "a b c"), (5, "a b c a b c a b"), (6, "x\nx\n y\n y\nx\n\n"), (7, "é# |* 😀 <b> " * 30), (8, " ".join(map(str, range(60)))), (8, " ".join(map(str, range(60)))),
    (9, "a " * 5000), (10, "w " * 20 + " ".join(map(str, range(40)))), (None, "p q r s " * 20),
]


def test_counts(spark):
    df = spark.createDataFrame([(i, t, None, 3, "x") for i, t in ROWS], "doc_id long, text string, lang string, n_words int, lines string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (None, 1), (2, None)], "doc_id long, quality int")
    got = apply_rules(df, labels).collect()
    rows = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert rows == sorted((str(i), *plain(t)) for i, t in ROWS)
    assert all(r.kept == (not r.base_failed) for r in got)  # too few labels for any bound
    assert apply_rules(df.limit(0), labels.limit(0)).count() == 0


def test_whole_table(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in apply_rules(docs, spark.read.parquet(f"{small}/labels.parquet")).collect()}
    assert got == want


@pytest.mark.parametrize("k,n,p", [(0, 10, 0.1), (3, 50, 0.1), (0, 1, 0.01), (40, 5000, 0.01), (5, 5, 0.5)])
def test_binomial(k, n, p):
    want = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert math.isclose(binomial_at_most(k, n, p), want, rel_tol=1e-9)


def test_binomial_of_large_samples():
    assert 0 < binomial_at_most(9_900_000, 10**9, 0.01) < 1e-20


def test_cutoffs_are_the_strictest_certified():
    good = {0: 950, 10: 30, 50: 15, 99: 5}
    c = choose_cutoff(good, 1000, 0.05, 0.01)
    over = lambda x: sum(v for b, v in good.items() if b >= x)
    assert binomial_at_most(over(c), 1000, 0.05) <= 0.01
    assert over(c - 1) > 50 or binomial_at_most(over(c - 1), 1000, 0.05) > 0.01
    assert choose_cutoff({}, 0, 0.05, 0.01) is None and choose_cutoff({0: 20}, 20, 0.01, 0.01) is None


def plain_shares(text):
    n, word_chars, symbols, dup, repeat, _ = plain(text)
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    count = lambda pattern: len(re.findall(pattern, text or ""))
    pairs = {"symbols": (symbols, word_chars), "same_lines": (dup, len(lines)), "repeats": (repeat, n), "capitals": (count("[A-Z]"), word_chars), "shouts": (count("!"), word_chars), "bars": (count("[|]"), word_chars)}
    return {r: math.floor(min(1.0, a / b if b else 0.0) * 100) for r, (a, b) in pairs.items()}


def plain_kept(rows, good, limit=0.05, error=0.05):
    """kept of each (doc_id, text, lang), by testing every cutoff of every stratum and rule one after another."""
    known = [(plain_shares(t), lang) for i, t, lang in rows if i in good and zlib.crc32(str(i).encode()) % 5]
    count = Counter(lang for _, lang in known)
    own = [x for x in count if x not in (None, "other") and (1 - limit / 6) ** count[x] <= error / 6]
    stratum = lambda lang: lang if lang in own else "other"
    chosen = {}
    for s in {*own, "other"}:
        here = [x for x, lang in known if stratum(lang) == s]
        for r in RULES:
            for c in range(99, 0, -1):
                lost = sum(x[r] >= c for x in here)
                # the exact tail, in whole numbers as far as it goes
                tail = sum(math.comb(len(here), k) * (limit / 6) ** k * (1 - limit / 6) ** (len(here) - k) for k in range(lost + 1))
                if not here or lost > len(here) * limit / 6 or tail > error / (6 * (len(own) + 1)):
                    break
                chosen[s, r] = c
    out = {}
    for i, t, lang in rows:
        shares = plain_shares(t)
        out[i] = not plain(t)[5] and not any(shares[r] >= chosen.get((stratum(lang), r), 101) for r in RULES)
    return out


def test_kept_is_what_plain_tests_give(spark):
    rng, rows, good = random.Random(3), [], set()
    for i in range(3000):
        bad = rng.random() < 0.3
        words = [rng.choice(("Some", "small", "words", f"w{rng.randrange(900)}", "##" if bad and rng.random() < 0.5 else "of", "A!" if bad else "it")) for _ in range(rng.choice((20, 60, 90)))]
        if not i % 40:  # shares of exactly 0.29, 0.57 and 0.58: floor and division differ in doubles
            caps = (29, 57, 58)[i // 40 % 3]
            letters = "c" * (100 - caps) + "C" * caps
            words = [letters[k:] + letters[:k] for k in range(60)]
        rows.append((i, " ".join(words), "en" if i % 3 else rng.choice(("other", "zz", None))))
        if not bad:
            good.add(i)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i in good)) for i, _, _ in rows], "doc_id long, quality int")
    want = plain_kept(rows, good)
    assert {r.doc_id: r.kept for r in apply_rules(docs, labels).collect()} == want
    assert sum(not k for i, k in want.items() if not plain(rows[i][1])[5]) > 100


def test_guarantee_on_unused_labels(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    chosen = cutoffs(rule_statistics(docs), labels)
    assert any(c for own in chosen.values() for c in own.values()) and set(chosen["en"]) == set(RULES)
    kept = {r.doc_id: r for r in apply_rules(docs, labels).collect()}
    unused = [r for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good = [kept[r.doc_id] for r in unused if r.quality == 1 and not kept[r.doc_id].base_failed]
    bad = [kept[r.doc_id] for r in unused if r.quality == 0 and not kept[r.doc_id].base_failed]
    assert sum(not r.kept for r in good) <= 0.05 * len(good)
    assert sum(not r.kept for r in bad) >= 0.3 * len(bad)
