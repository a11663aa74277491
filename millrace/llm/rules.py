"""Quality rules whose cutoffs come from labelled holdouts with exact binomial bounds, in DataFrame functions only.

Each rule rejects a document if one statistic, a share between 0 and 1 counted in hundredths, reaches a cutoff. Cutoffs
are chosen for each stratum (language) and rule: going from the laxest to stricter ones, a cutoff is taken while an exact
binomial test on the stratum's good labelled documents rules out a false-rejection rate over limit / rules at level
error / (strata * rules). Testing in that fixed order needs no correction over the grid; the two divisions correct for
the rules and strata. So with confidence 1 - error no stratum loses more than `limit` of its good documents to rules.
"""

from __future__ import annotations

from functools import reduce
from math import exp, lgamma, log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

_WS = r"[\x20\x09-\x0D]+"
#: The stratum of all languages without one of their own.
OTHER = "other"
RULES = ("symbols", "same_lines", "repeats", "capitals", "shouts", "bars")
_GRID = 100


def let(value: Column, body) -> Column:
    """body(value) with `value` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """The number of words within three-word windows that occur twice or more among `words`."""
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))

    def covered(at: Column) -> Column:  # window starts in order, each with three words
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")), lambda a, p: F.struct((a["n"] + p + 3 - F.greatest(p, a["end"])).alias("n"), (p + 3).alias("end")), lambda a: a["n"])

    def twice(s: Column) -> Column:  # (hash, start) in order
        near = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return covered(F.sort_array(F.transform(near, lambda x: x["p"])))

    def count(g: Column) -> Column:
        pairs = F.sort_array(F.transform(g, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
        return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(pairs, twice))

    return F.when(F.size(words) < 3, F.lit(0)).otherwise(let(windows, count))


def rule_statistics(docs: DataFrame) -> DataFrame:
    """For each row: doc_id, lang (null: no such column), text_hash, the five base counts and the rules' shares."""
    t = F.coalesce("text", F.lit(""))
    chars = lambda part: F.length(F.regexp_replace(t, f"[^{part}]+", "")).cast("long")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), lang.cast("string").alias("lang"), F.xxhash64(t).alias("text_hash"),
        F.filter(F.split(t, _WS), lambda w: w != "").alias("w"), F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"), F.length(t).cast("long").alias("n_chars"),
        F.length(F.regexp_replace(t, _WS, "")).cast("long").alias("word_chars"), chars("#*$%&|<>").alias("n_symbols"), chars("A-Z").alias("caps"), chars("!").alias("bangs"), chars("|").alias("pipes"),
    )
    rows = rows.select(
        "doc_id", "lang", "text_hash", F.size("w").cast("long").alias("n_words"), "word_chars", "n_symbols", F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), _repeat_words(F.col("w")).cast("long").alias("n_repeat_words"), "caps", "bangs", "pipes",
    )
    by = lambda n, d: F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(n), F.col(d)), F.lit(0.0)))
    share = {"symbols": by("n_symbols", "word_chars"), "same_lines": by("n_dup_lines", "n_lines"), "repeats": by("n_repeat_words", "n_words"), "capitals": by("caps", "word_chars"), "shouts": by("bangs", "word_chars"), "bars": by("pipes", "word_chars")}
    return rows.select("doc_id", "lang", "text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", *[share[r].alias(r) for r in RULES])


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed downwards from k until terms vanish: exact to rounding, for k below n * p."""
    total, i = 0.0, k
    term = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p))
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p if i else 0.0
        i -= 1
    return min(1.0, total)


def choose_cutoff(good: dict[int, int], n: int, limit: float, level: float, grid: int = _GRID) -> int | None:
    """The strictest certified cutoff c: good[b] of n good documents are in bin b, floor(share * grid), and those of bins c
    and above are rejected. None: no cutoff."""
    taken, over = None, good.get(grid, 0)
    for c in range(grid - 1, 0, -1):
        over += good.get(c, 0)
        if over > n * limit or n == 0 or binomial_at_most(over, n, limit) > level:
            return taken
        taken = c
    return taken


def _bin(rule: str) -> Column:
    return F.floor(F.col(rule) * _GRID).cast("int")


def cutoffs(stats: DataFrame, labels: DataFrame, limit: float = 0.05, error: float = 0.05) -> dict[str, dict[str, int | None]]:
    """The cutoff of each stratum and rule from labelled rows with crc32(doc_id) mod 5 other than 0; the rest stay for tests.

    A language is a stratum if its labelled good documents could certify a cutoff by themselves, none of them rejected;
    all others are one more stratum. So there are at most n / 570 of n such documents, and their histogram, all that the
    driver sees, has 101 rows at most a stratum and rule. Null labels and doc_ids are left out.
    """
    good = labels.filter("doc_id is not null and quality = 1").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    held = stats.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0).join(good, "doc_id")
    share = limit / len(RULES)
    least = log(error / len(RULES)) / log1p(-share)
    own = sorted(r.lang for r in held.filter(F.col("lang") != OTHER).groupBy("lang").count().filter(F.col("count") >= least).collect())
    named = F.when(F.col("lang").isin(*own), F.col("lang")).otherwise(F.lit(OTHER)) if own else F.lit(OTHER)
    bins = held.select(named.alias("stratum"), F.explode(F.create_map(*[x for r in RULES for x in (F.lit(r), _bin(r))])).alias("rule", "bin"))
    seen: dict[tuple[str, str], dict[int, int]] = {}
    for r in bins.groupBy("stratum", "rule", "bin").count().collect():
        seen.setdefault((r.stratum, r.rule), {})[r.bin] = r["count"]
    strata = sorted({*own, OTHER})
    level = error / (len(strata) * len(RULES))
    return {s: {r: choose_cutoff(g := seen.get((s, r), {}), sum(g.values()), share, level) for r in RULES} for s in strata}


def apply_rules(docs: DataFrame, labels: DataFrame, limit: float = 0.05, error: float = 0.05) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, text_hash) for each row.

    Null and empty texts have no words and fail the base. A stratum with too few labels for any bound gets no rules of
    its own, so only the base decides; an empty table of labels leaves the base alone, an empty one of documents gives an
    empty result. Repeated rows each give a row. doc_id counts as a long. Only doc_id, text and lang are read, texts of
    any length whole.
    """
    stats = materialize(rule_statistics(docs), "rule-stats")
    chosen = cutoffs(stats, labels, limit, error)
    own = [s for s in chosen if s != OTHER]
    rejected = F.lit(False)
    for s, by_rule in chosen.items():
        here = F.col("lang") == s if s in own else ~F.coalesce(F.col("lang").isin(*own), F.lit(False)) if own else F.lit(True)
        over = [_bin(r) >= c for r, c in by_rule.items() if c is not None]
        if over:
            rejected = rejected | F.coalesce(here & reduce(lambda a, b: a | b, over), F.lit(False))
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & ~rejected).alias("kept"), "text_hash")
