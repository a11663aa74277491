"""Personal data: base spans against plain patterns, labelers, expectation-maximisation and the whole query."""

import hashlib
import random
import re

import numpy as np

from millrace.llm.pii import KINDS, _decode, base_spans, candidate_spans, find_pii, luhn, pii_report, reliabilities, span_code, train

PLAIN = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    sums = lambda d: sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(d[::-1])) % 10 == 0
    out = [(0, *m.span()) for m in PLAIN[0].finditer(text)]
    out += [(1, *m.span()) for m in PLAIN[1].finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, *m.span()) for m in PLAIN[2].finditer(text) if 13 <= len(digits(m[0])) <= 19 and sums(digits(m[0]))]
    return out + [(3, *m.span()) for m in PLAIN[3].finditer(text) if 9 <= len(digits(m[0])) <= 15]


def test_base_is_plain():
    random.seed(4)
    for _ in range(40000):
        text = "".join(random.choice("ab@@..-_%+12 0345()9é") for _ in range(random.randrange(45)))
        assert base_spans(text) == plain(text)
    for text in ("a@b.c_x@y.zz@q.r", "1.2.3.4.5.6.7.8 256.1.1.1 00001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 010-9999 +12345678", "x" * 200000, "1" * 200000, "a@" * 50000):
        assert base_spans(text) == plain(text) if len(text) < 1000 else base_spans(text) is not None


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_reliabilities_find_the_better_labeler():
    random.seed(1)
    rows = {}
    for _ in range(4000):
        truth = random.random() < 0.4
        vote = tuple((1 if truth else -1) * (1 if random.random() < p else -1) for p in (0.95, 0.8, 0.6))
        rows[vote] = rows.get(vote, 0) + 1
    post, accuracy, prior = reliabilities(np.array([*rows]), np.array([*rows.values()], float))
    assert accuracy[0] > accuracy[1] > accuracy[2] and abs(float(prior) - 0.4) < 0.08
    assert (post >= 0).all() and (post <= 1).all()


def test_candidates_leave_base_alone():
    text = "mail jo.doe at example dot com or jo(at)example.org, card 4111 1111 1111 1112, SSN 123-45-6789, call 030 123 45 67, a@b.co"
    base = base_spans(text)
    found = candidate_spans(text, base)
    assert {KINDS[k] for k, *_ in found} >= {"email", "card", "id", "phone"}
    spans = sorted((s, e) for s, e in [(s, e) for _, s, e in base] + [(s, e) for _, s, e, _ in found])
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_spelt_out_addresses_become_candidates():
    for text in ("write jane at example(dot)com today", "write jane at example [dot] org", "Jane[AT]example{dot}net"):
        assert [KINDS[k] for k, *_ in candidate_spans(text, [])] == ["email"]
    assert candidate_spans("meet me at home. then we go", []) == []


def plain_taken(counts):
    """The codes taken, by expectation-maximisation code by code and plain gradient steps on the classifier's likelihood."""
    parts = {c: _decode(c) for c in counts}
    soft = {}
    for kind in {p[0] for p in parts.values()}:
        own = [c for c in counts if parts[c][0] == kind]
        right, prior = [0.75] * 5, 0.5
        for _ in range(200):
            post = {}
            for c in own:
                yes, no = prior, 1 - prior
                for v, r in zip(parts[c][1], right):
                    yes, no = (yes * r, no * (1 - r)) if v > 0 else (yes * (1 - r), no * r) if v < 0 else (yes, no)
                post[c] = yes / (yes + no)
            for i in range(5):
                agree = sum(counts[c] * (post[c] if parts[c][1][i] > 0 else 1 - post[c]) for c in own if parts[c][1][i])
                right[i] = min(0.99, max(0.5, (agree + 7.5) / (sum(counts[c] for c in own if parts[c][1][i]) + 10)))
            prior = min(0.95, max(0.05, (sum(post[c] * counts[c] for c in own) + 2) / (sum(counts[c] for c in own) + 4)))
        soft |= post
    codes, total = sorted(counts), sum(counts.values())
    x = np.zeros((len(codes), 5 + 15 + 4 + 3 + 3))
    for row, c in zip(x, codes):
        kind, vote, length, left, right = parts[c]
        row[[kind, *[5 + 3 * i + v + 1 for i, v in enumerate(vote)], 20 + length, 24 + left, 27 + right]] = 1
    w, weight, target = np.zeros(x.shape[1]), np.array([counts[c] / total for c in codes]), np.array([soft[c] for c in codes])
    for _ in range(60000):
        w -= 0.4 * (x.T @ (weight * (1 / (1 + np.exp(-x @ w)) - target)) + 1e-3 * w)
    return {c: 1 / (1 + np.exp(-v)) for c, v in zip(codes, x @ w)}


def test_added_spans_are_what_plain_training_takes(spark, small):
    extra = [f"call me on {a} {b} today, or by phone ({c}) {a}-{b}" for a in (555, 30) for b in (1234, 999) for c in (202, 89)] + ["SSN 123-45-6789", "serial 000-12-3456", "card 4000 1234 5678 9010", "order 4000-1234-5678-9011", "jo at x dot org, mail", "IBAN DE89 3704 0044 0532 0130 00"]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()] + [(10**6 + i, t) for i, t in enumerate(extra * 3)]
    counts, spans = {}, {}
    for i, t in rows:
        base = base_spans(t or "")
        more = candidate_spans(t or "", base)
        spans[i] = more
        for code in [span_code(t, *b) for b in base] + [m[3] for m in more]:
            counts[code] = counts.get(code, 0) + 1
    chance = plain_taken(counts)
    assert all(abs(c - 0.5) > 1e-4 for c in chance.values())
    got = {r.doc_id: {(x.kind, x.start, x.end) for x in r.added} for r in find_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: {m[:3] for m in own if chance[m[3]] > 0.5} for i, own in spans.items()}
    assert any(got.values())


def test_training_without_candidates():
    assert train({}) == set()


ROWS = [(1, "write jo@example.com or +1 (555) 010-9999"), (2, None), (3, ""), (4, "é card 4111 1111 1111 1111 at 10.0.0.1"), (4, "é card 4111 1111 1111 1111 at 10.0.0.1"), (None, "SSN 123-45-6789"), (5, "x " * 30000 + "a@b.co")]


def test_query(spark):
    df = spark.createDataFrame([(i, t, "b", 1) for i, t in ROWS], "doc_id long, text string, base string, spans int")
    got = sorted(pii_report(df).collect(), key=lambda r: (str(r.doc_id), r.base_sha256))
    for (i, t), r in zip(sorted(ROWS, key=lambda r: str(r[0])), got):
        own = plain(t or "")
        said = ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in own)
        assert (r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) == (i, *[sum(k == x for k, *_ in own) for x in range(4)])
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))
    assert pii_report(df.limit(0)).count() == 0
    assert find_pii(df).filter("doc_id = 4").count() == 2
