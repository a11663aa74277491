"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, and a classifier is trained.

Base spans come from fixed patterns and always stay. Further candidates come from loose patterns; five labelers (format,
checksum, gazetteer, context, shape) vote for, against or not at all, on base spans too. Their reliabilities are estimated
without labels from how often each combination of votes occurs among all these spans of the whole corpus, and the
posteriors that follow train a logistic classifier on votes, length and surroundings, which decides each candidate. All that the driver sees is a count for
each combination, of which there are at most len(KINDS) * 3 ** 5 * 4 * 3 * 3.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone", "id")
_LOCAL = "A-Za-z0-9._%+-"
_TAIL = r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_EMAIL_AT, _EMAIL = re.compile(f"[{_LOCAL}]++{_TAIL}"), re.compile(f"(?<![{_LOCAL}])[{_LOCAL}]++{_TAIL}")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Loose patterns for further candidates, in the order in which they claim text.
_LOOSE = (
    ("email", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63} ?(?:\(at\)|\[at\]|\{at\}| at |＠) ?[A-Za-z0-9-]{1,63}(?: ?(?:\(dot\)|\[dot\]|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,24}){1,4}(?![A-Za-z0-9])", re.I)),
    ("ip", re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")),
    ("card", re.compile(r"(?<![0-9A-Za-z])[0-9]{4}(?:[ .-]?[0-9]{4}){2}[ .-]?[0-9]{3,4}(?![0-9A-Za-z])")),
    ("id", re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")),
    ("id", re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")),
    ("phone", re.compile(r"(?<![0-9A-Za-z.+-])(?:00[1-9][0-9]{0,2}[ .-]?)?(?:\([0-9]{2,5}\) ?|[0-9]{2,5}[ ./-])[0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9A-Za-z])")),
)
#: What a spelt-out address has one of.
_SPELT = (" dot ", "dot)", "dot]", "dot}", "at)", "at]", "at}", "＠")
# Gazetteers and context words.
_DOMAINS = frozenset("com org net edu gov de fr es uk eu io info biz ch at it nl".split())
_ISSUERS = ("34", "37", "4", "51", "52", "53", "54", "55", "2221", "2720", "6011", "65", "35", "36", "38", "62")
_COUNTRIES = frozenset("AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IT LI LT LU LV MT NL NO PL PT RO SE SI SK".split())
_FOR = {
    "email": ("mail", "contact", "correo", "courriel", "kontakt", "write to", "reach"), "ip": ("ip", "server", "host", "address", "addr", "login", "from"),
    "card": ("card", "visa", "credit", "debit", "mastercard", "amex", "karte", "tarjeta", "carte", "payment"), "phone": ("phone", "tel", "call", "mobile", "fax", "cell", "telefon", "téléphone", "teléfono", "handy", "sms"),
    "id": ("ssn", "social security", "iban", "account", "konto", "cuenta", "compte", "passport", "bank"),
}
_AGAINST = ("version", "isbn", "issn", "order", "invoice", "rfc", "serial", "sku", "doi", "token", "sha", "hash", "commit", "build", "page", "chapter")


def luhn(digits: str) -> bool:
    """Whether the check digit holds."""
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) by kind, then start: leftmost matches of the fixed patterns; failing ones are dropped."""
    out = []
    if "@" in text:
        at = 0
        while m := (_EMAIL_AT.match(text, at) if at else None) or _EMAIL.search(text, at):
            out.append((0, m.start(), m.end()))
            at = m.end()
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]
    return out


def _iban(s: str) -> bool:
    turned = s[4:] + s[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def votes(kind: str, span: str, before: str, after: str) -> tuple[int, ...]:
    """Each labeler's vote: 1 personal data of this kind, -1 not, 0 no opinion."""
    digits = re.sub("[^0-9]", "", span)
    bare = re.sub("[^0-9A-Za-z]", "", span)
    low = before.lower()
    if kind == "email":
        fmt = 1 if re.search(r"[(\[{]", span) else 0
        check = 0
        gazetteer = 1 if re.split(r"[^A-Za-z]+", span.lower())[-1] in _DOMAINS else -1
        shape = 1 if re.search("[0-9._]", span.split(" ")[0]) else 0
    elif kind == "ip":
        fmt, check, gazetteer, shape = 1, 0, -1 if digits.strip("0") == "" else 0, 1 if re.search("[a-fA-F]", span) else 0
    elif kind == "card":
        fmt = 1 if len(digits) == 16 else 0
        check = 1 if luhn(digits) else -1
        gazetteer = 1 if digits.startswith(_ISSUERS) else -1
        shape = -1 if len(set(digits)) < 4 else 1 if re.fullmatch(r"[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}", span) else 0
    elif kind == "phone":
        fmt = 1 if 9 <= len(digits) <= 13 else -1
        check, gazetteer = 0, 1 if span[0] in "0(" else 0
        shape = -1 if len(set(digits)) < 3 else 1 if re.fullmatch(r"\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", span) else 0
    else:
        number = bare.isdigit()
        fmt = 1
        check = (-1 if bare[:3] in ("000", "666") or bare[0] == "9" or bare[3:5] == "00" or bare[5:] == "0000" else 0) if number else 1 if _iban(bare) else -1
        gazetteer = 0 if number else 1 if bare[:2] in _COUNTRIES else -1
        shape = -1 if len(set(digits)) < 3 else 0
    context = 1 if any(w in low for w in _FOR[kind]) else -1 if any(w in low for w in _AGAINST) else 0
    return fmt, check, gazetteer, context, shape


def _code(kind: int, vote: tuple[int, ...], length: int, left: str, right: str) -> int:
    side = lambda c: 0 if not c or c.isspace() else 1 if c in ",.;:!?()[]\"'<>|" else 2
    code = kind
    for v in vote:
        code = code * 3 + v + 1
    return ((code * 4 + min(3, length // 8)) * 3 + side(left)) * 3 + side(right)


def _decode(code: int) -> tuple[int, list[int], int, int, int]:
    code, right = divmod(code, 3)
    code, left = divmod(code, 3)
    code, length = divmod(code, 4)
    vote = []
    for _ in range(5):
        code, v = divmod(code, 3)
        vote.append(v - 1)
    return code, vote[::-1], length, left, right


def span_code(text: str, kind: int, start: int, end: int) -> int:
    """The number of a span's votes, length and neighbours."""
    vote = votes(KINDS[kind], text[start:end], text[max(0, start - 40) : start], text[end : end + 10])
    return _code(kind, vote, end - start, text[start - 1 : start] if start else "", text[end : end + 1])


def candidate_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(kind number, start, end, code) of loose matches that overlap no base span and no earlier candidate, by start."""
    if not any(c in text for c in "0123456789[({＠") and " at " not in text:
        return []
    found, taken = [], sorted((s, e) for _, s, e in base)
    claims = []
    low = text.lower()
    for kind, pattern in _LOOSE:
        if kind == "email" and not any(x in low for x in _SPELT):  # prose with " at " and a full stop is no address
            continue
        for m in pattern.finditer(text):
            claims.append((m.start(), m.end(), KINDS.index(kind)))
    if not claims:
        return []
    order = {k: i for i, (k, _) in reversed([*enumerate(_LOOSE)])}
    claims.sort(key=lambda c: (c[0], order[KINDS[c[2]]], c[1]))
    at, last = 0, -1
    for s, e, k in claims:
        while at < len(taken) and taken[at][1] <= s:
            at += 1
        if s < last or at < len(taken) and taken[at][0] < e:
            continue
        last = e
        found.append((k, s, e, span_code(text, k, s, e)))
    return found


def reliabilities(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posteriors, accuracies, prior) by expectation-maximisation over vote patterns of one kind.

    Each labeler that votes is right with its own probability, whatever the truth; those start at 0.75, are smoothed by
    a few pseudo-votes and stay at 0.5 or more, so that the labels can't change sides.
    """
    accuracy, prior = np.full(patterns.shape[1], 0.75), 0.5
    voted = patterns != 0
    post = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        log = np.where(voted, np.log(accuracy / (1 - accuracy)) * patterns, 0).sum(1) + np.log(prior / (1 - prior))
        new = 1 / (1 + np.exp(-log))
        right = np.where(patterns > 0, new[:, None], np.where(patterns < 0, 1 - new[:, None], 0))
        accuracy = np.clip(((right * counts[:, None]).sum(0) + 7.5) / ((voted * counts[:, None]).sum(0) + 10), 0.5, 0.99)
        prior = float(np.clip(((new * counts).sum() + 2) / (counts.sum() + 4), 0.05, 0.95))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return new, accuracy, np.array(prior)


def train(counts: dict[int, int], threshold: float = 0.5) -> set[int]:
    """The codes that the span classifier takes for personal data."""
    if not counts:
        return set()
    codes = sorted(counts)
    parts = [_decode(c) for c in codes]
    kind, weight = np.array([p[0] for p in parts]), np.array([counts[c] for c in codes], float)
    vote = np.array([p[1] for p in parts])
    soft = np.zeros(len(codes))
    for k in np.unique(kind):
        own = kind == k
        soft[own] = reliabilities(vote[own], weight[own])[0]
    hot = lambda x, n: np.eye(n)[x]
    x = np.hstack([hot(kind, len(KINDS)), *[hot(vote[:, i] + 1, 3) for i in range(5)], hot(np.array([p[2] for p in parts]), 4), hot(np.array([p[3] for p in parts]), 3), hot(np.array([p[4] for p in parts]), 3)])
    w, weight = np.zeros(x.shape[1]), weight / weight.sum()
    for _ in range(50):  # Newton steps on the penalised likelihood
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - soft)) + 1e-3 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w)), grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return {c for c, s in zip(codes, x @ w) if 1 / (1 + np.exp(-s)) > threshold}


_SPAN = "array<struct<kind:int,start:int,end:int,code:int>>"


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) for each row of `docs`: arrays of struct(kind, start, end, code), kinds numbered as KINDS.

    Offsets count code points, ends exclusive. Null texts count as empty. Repeated rows each give a row and count in the
    statistics; an empty table gives an empty result. doc_id counts as a long. Texts of any length are taken whole. Other
    columns are not read. The text is read once; later steps read the spans.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32())]))
        for batch in batches:
            base, more = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                own = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e, "code": span_code(text, k, s, e)} for k, s, e in own])
                more.append([{"kind": k, "start": s, "end": e, "code": c} for k, s, e, c in candidate_spans(text, own)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(more, kind)], ["doc_id", "base", "candidates"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base {_SPAN}, candidates {_SPAN}")
    rows = materialize(rows, "pii")
    counts = {r.code: r["count"] for r in rows.select(F.explode(F.concat("base.code", "candidates.code")).alias("code")).groupBy("code").count().collect()}
    taken = sorted(train(counts))
    added = F.filter("candidates", lambda c: c["code"].isin(taken)) if taken else F.array().cast(_SPAN)
    return rows.select("doc_id", "base", added.alias("added"))


def pii_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of find_pii(), spans by kind, then start."""

    def run(batches):
        for batch in batches:
            ids, base, added = (batch.column(i).to_pylist() for i in range(3))
            said = lambda spans: ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted((x["kind"], x["start"], x["end"]) for x in spans))
            cols = [[sum(x["kind"] == k for x in own) for own in base] for k in range(4)]
            cols += [[hashlib.sha256(said(own).encode()).hexdigest() for own in base], [said(a + b) for a, b in zip(base, added)]]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *[pa.array(c, pa.int64()) for c in cols[:4]], *[pa.array(c, pa.string()) for c in cols[4:]]], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return find_pii(docs).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
