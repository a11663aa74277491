"""Secret scans through a trigram inverted index, in DataFrame functions only.

From each rule's regular expression a Boolean query over trigrams is derived that every match's text satisfies. The
index has postings (trigram, document) for the trigrams of these queries; intersecting postings leaves candidate
documents, in which the expression itself is run. A rule without mandatory trigrams scans all documents.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

#: Candidates (two longs and a number each) that may be broadcast; more are joined by a shuffle.
BROADCAST_CANDIDATES = 1_000_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret; `least` characters are needed in `group` of a match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    #: The same matches that reach `least`, quicker to search for; used where failing matches can't hide others.
    search: str | None = None


_KEYWORD = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
BASE = (
    Rule("assign", _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "[0-9a-f]+", 0, 32, "[0-9a-f]{32,}"),  # runs are maximal either way
)
ADDED = (
    Rule("code_host", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", "xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("payment", "[rs]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN( [A-Z]+)* PRIVATE KEY-----"),
    Rule("url_login", r"://[A-Za-z0-9._%+-]+:[^\x20\x09-\x0D/@:]{6,}@"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/=-]{20,}"),
)

ANY = ("any",)


def _both(a, b):
    return b if a == ANY else a if b == ANY or a == b else ("and", a, b)


def _either(a, b):
    return ANY if ANY in (a, b) else a if a == b else ("or", a, b)


def _holds(strings: set[str]):
    """What a text holds that has one of `strings`, in trigrams of its lower-cased form."""
    grams = [[s[i : i + 3] for i in range(len(s) - 2)] for s in sorted(strings)]
    return reduce(_either, [reduce(_both, [("has", g) for g in own], ANY) for own in grams]) if grams else ANY


def trigram_query(pattern: str, most: int = 64):
    """A tree of and, or, has and any that every text with a match of `pattern` satisfies once lower-cased."""

    def walk(nodes):
        """The set of strings, if small, that `nodes` match, and a query."""
        exact, query = {""}, ANY
        for op, arg in nodes:
            own, asks = one(op, arg)
            if own is not None and len(exact) * len(own) <= most:
                exact = {a + b for a in exact for b in own}
            else:
                query = _both(query, _holds(exact))
                exact = own if own is not None else {""}
            query = _both(query, asks)
            broken.append(own is None)
        return exact, query

    broken: list[bool] = []

    def whole(nodes):
        mark = len(broken)
        exact, query = walk(nodes)
        inner = any(broken[mark:])
        del broken[mark:]
        return (None, _both(query, _holds(exact))) if inner else (exact, query)

    def one(op, arg):
        if op is C.LITERAL:
            return {chr(arg).lower()}, ANY
        if op is C.IN:
            found = set()
            for kind, x in arg:
                if kind is C.LITERAL:
                    found.add(chr(x).lower())
                elif kind is C.RANGE and x[1] - x[0] < 8:
                    found |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
                else:
                    return None, ANY
                if len(found) > 8:
                    return None, ANY
            return found, ANY
        if op is C.SUBPATTERN:
            return whole(arg[3])
        if op is C.BRANCH:
            parts = [whole(x) for x in arg[1]]
            if all(p[0] is not None for p in parts) and sum(len(p[0]) for p in parts) <= most:
                return set().union(*(p[0] for p in parts)), ANY
            return None, reduce(_either, [_both(q, _holds(e)) if e is not None else q for e, q in parts])
        if op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            low, high, inner = arg
            exact, query = whole(inner)
            if exact is not None and high == 1:
                return exact | {""}, ANY
            if exact is not None and low == high and len(exact) ** low <= most:
                return reduce(lambda a, _: {x + y for x in a for y in exact}, range(low), {""}), ANY
            return None, ANY if low == 0 else _both(query, _holds(exact)) if exact is not None else query
        return None, ANY

    exact, query = whole(parser.parse(pattern))
    return _both(query, _holds(exact)) if exact is not None else query


def _leaves(query) -> set[str]:
    return set() if query == ANY else {query[1]} if query[0] == "has" else _leaves(query[1]) | _leaves(query[2])


def _asked(query, bit: dict[str, Column]) -> Column:
    if query[0] == "has":
        return bit[query[1]]
    a, b = _asked(query[1], bit), _asked(query[2], bit)
    return a & b if query[0] == "and" else a | b


def trigram_index(docs: DataFrame, grams: list[str]) -> DataFrame:
    """Postings (gram, doc_id, text_hash): gram is the number in `grams` of a trigram in the lower-cased text."""
    low = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(i)) for i, g in enumerate(grams)]))
    return low.select("doc_id", "text_hash", F.explode_outer(held).alias("gram")).filter("gram is not null")


def candidates(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """(doc_id, text_hash, asked): the documents whose postings satisfy rules' queries, one bit a rule."""
    asks = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern)) != ANY}
    grams = sorted(set().union(*map(_leaves, asks.values())))
    index = materialize(trigram_index(docs, grams), "trigrams")
    words = range((len(grams) + 61) // 62)
    met = index.groupBy("doc_id", "text_hash").agg(*[F.bit_or(F.when(F.floor(F.col("gram") / 62) == k, F.call_function("shiftleft", F.lit(1).cast("long"), F.col("gram") % 62)).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in words])
    bit = {g: F.col(f"m{i // 62}").bitwiseAND(F.lit(1 << i % 62)) != 0 for i, g in enumerate(grams)}
    asked = reduce(lambda a, b: a.bitwiseOR(b), [F.when(_asked(q, bit), F.lit(1 << i)).otherwise(F.lit(0)) for i, q in asks.items()])
    return met.select("doc_id", "text_hash", asked.alias("asked")).filter("asked != 0")


def _spans(rule: Rule, order: int) -> Column:
    """array of struct(start, ord, kind, end) of the rule's matches in `text`, in code points; failing ones dropped."""
    search = rule.search or rule.pattern
    texts, gaps = F.regexp_extract_all("text", F.lit(search), F.lit(0)), F.split("text", search, -1)

    def step(acc, x):
        start = acc["at"] + x["gap"]
        return F.struct((start + x["size"]).alias("at"), F.when(x["ok"], F.array_append(acc["found"], F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(rule.kind).alias("kind"), (start + x["size"]).alias("end")))).otherwise(acc["found"]).alias("found"))

    def sized(m, g):
        ok = (F.length(F.regexp_extract(m, search, rule.group)) if rule.group else F.length(m)) >= rule.least
        return F.struct(F.length(g).alias("gap"), F.length(m).alias("size"), F.coalesce(ok, F.lit(False)).alias("ok"))

    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    each = F.zip_with(texts, F.slice(gaps, F.lit(1), F.size(texts)), sized)
    return F.aggregate(each, F.struct(F.lit(0).alias("at"), none.alias("found")), step, lambda a: a["found"])


def scan(docs: DataFrame, base: tuple[Rule, ...] = BASE, added: tuple[Rule, ...] = ADDED, most_broadcast: int = BROADCAST_CANDIDATES) -> DataFrame:
    """(doc_id, spans, base_spans) for each row of `docs`: arrays of struct(start, ord, kind, end) by start, then rule.

    Null texts count as empty: no spans. Added spans may overlap base ones; a base span never changes. Rows that repeat
    a doc_id are scanned each for itself. Other columns are not read.
    """
    rules = [*base, *added]
    found = materialize(candidates(docs, rules).select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "asked"), "secret-candidates")
    side = F.broadcast(found) if found.count() <= most_broadcast else found
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    rows = own.join(side, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    each = []
    for i, r in enumerate(rules):
        scans_all = trigram_query(r.pattern) == ANY
        runs = F.col("text").rlike(r.search or r.pattern) if scans_all else F.coalesce(F.col("asked").bitwiseAND(F.lit(1 << i)) != 0, F.lit(False))
        each.append(F.when(runs, _spans(r, i)).otherwise(none))
    spans = rows.select("doc_id", F.array_sort(F.concat(*each)).alias("spans"))
    return spans.select("doc_id", "spans", F.filter("spans", lambda x: x["ord"] < len(base)).alias("base_spans"))


def joined(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
