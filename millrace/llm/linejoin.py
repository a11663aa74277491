"""Line dedup by an exact set-similarity join, in DataFrame functions only.

A line is the set of its lower-cased words. Words are ordered by rarity over the whole corpus; two sets of Jaccard
similarity t or more then share a word within their prefixes. Prefix, positional and length filters and a bitmap of
each set leave few pairs, whose words are fetched and compared. A line goes if an earlier line (by doc_id, then line
number) is similar to it, whether or not that earlier line stays. Rows of one doc_id, or of none, come by their texts'
hashes; of equal rows one comes before the others.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import broadcast_if_small, drop, materialize, packed

#: Buckets of the rarity table: its size is fixed, whatever the corpus.
_BUCKETS = 1 << 16
#: Rows of a few longs that may be broadcast; more are joined by shuffles.
_BROADCAST_ROWS = 1_000_000
_LAST = (1 << 63) - 1
#: Words beyond which a set's bitmap has 128 bits, not 64.
_WIDE = 90
#: Sizes of sets are dealt into bands, each so many times as wide as the one before.
_BAND = 1.25
#: Parts of the word space that are joined one by one, so that only one part's prefixes lie in shuffle files at a time.
_PASSES = 2
#: Sets of a band that share a word of their prefixes, from which on round 1 takes the word, and how many of them lead there.
_HOT, _LEADS = 256, 16
#: `at` numbers the lines of a doc_id: sub * 2 ** 31 + line, sub numbering the texts of the doc_id.
_SUB, _LINE = 31, (1 << 31) - 1


def _plain(text: Column) -> Column:
    """Lower-cased text in which all white space but line feeds is a space."""
    odd = reduce(lambda a, b: a | b, [F.contains(text, F.lit(c)) for c in "\t\x0b\x0c\r"])
    return F.lower(F.when(odd, F.regexp_replace(text, r"[\t\x0B\f\r]", " ")).otherwise(text))


def rarity(docs: DataFrame) -> Column:
    """A literal array: for each hash bucket of words, its order of frequency over all of `docs` (0: rarest)."""
    text = docs.select(F.replace(F.lower("text"), F.lit("\n"), F.lit(" ")).alias("t"))  # rarer white space matters little here
    word = text.select(F.explode(F.split("t", " ")).alias("w"))
    counts = word.groupBy(F.xxhash64("w").bitwiseAND(_BUCKETS - 1).alias("b")).count()
    level = {}
    for r in counts.collect():  # one row a bucket
        bits = r["count"].bit_length()
        level[r.b] = min(127, 2 * bits + (r["count"] >> max(0, bits - 2) & 1))
    return F.split(F.lit(",".join(str(level.get(b, 0)) for b in range(_BUCKETS))), ",").cast("array<bigint>")


def _hashes(line: Column) -> Column:
    """64-bit hashes of a plain line's distinct words."""
    return F.array_remove(F.array_distinct(F.transform(F.split(line, " "), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))


def _tokens(hashes: str, levels: Column) -> Column:
    """Distinct words, given as _hashes(), as numbers, rarest first: 7 bits of the frequency of the word's bucket, 56 of hash."""
    # never null, and said so: sorting is then by plain numbers
    level = lambda h: F.coalesce(F.get(levels, h.bitwiseAND(_BUCKETS - 1).cast("int")), F.lit(0).cast("long"))
    return F.sort_array(F.transform(hashes, lambda h: F.shiftleft(level(h), 56).bitwiseOR(h.bitwiseAND((1 << 56) - 1))))


def _bitmaps(tokens: str, n: Column) -> list[Column]:
    """b0, b1: a bit for each hash, set if an odd number of words have it: 64 bits of all words in b0, and those of about half
    of a large set's words in b1, so that b1 and b0 ^ b1 are 128 bits. No more bits differ between two sets than words."""
    none = F.lit(0).cast("long")
    one = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    fold = lambda a: F.aggregate(a, none, lambda acc, x: acc.bitwiseXOR(one(x)))
    half = fold(F.filter(tokens, lambda x: x.bitwiseAND(64) != none))
    return [fold(tokens).alias("b0"), F.when(n > _WIDE, half).otherwise(none).alias("b1")]


def _need(n: Column, m: Column, t: float) -> Column:
    """The least overlap of sets of n and m words at similarity t; scaled to whole numbers against rounding."""
    s = round(t * 1000)
    return F.ceil((n + m) * F.lit(s) / F.lit(1000 + s) - 1e-9)


def _room(n: Column, t: float) -> tuple[Column, Column]:
    """How many words a set of n must share with any similar one, and with one that isn't smaller."""
    s = round(t * 1000)
    return F.ceil(n * F.lit(s) / 1000 - 1e-9).cast("int"), F.ceil(n * F.lit(2 * s) / F.lit(1000 + s) - 1e-9).cast("int")


def _band(n: Column) -> Column:
    """The band of a size; a larger size never has a lower band."""
    return F.floor(F.log(n) / math.log(_BAND)).cast("int")


def _banded(posts: DataFrame, t: float) -> DataFrame:
    """`posts`, a row for each word of a prefix, once for each band in which a similar set can share the word: the set's
    own, where it meets smaller ones, and for words of the shorter prefix those of the larger sets that can be similar
    if the word at this place is the first shared one. token becomes a hash of word and band, and `marks` has the place
    (times 8), 4 if the word is in the shorter prefix, 2 in the own band, 1 if the set is open."""
    s, n, pos, own, band = round(t * 1000), *map(F.col, ("n", "pos", "own", "band"))
    most = F.floor((n - pos) * F.lit(1000 + s) / F.lit(s) - n + 1e-6)  # by the overlap that the join asks for
    shorter = pos < F.col("short")
    marks = F.shiftleft(pos, 3) + F.when(shorter, 4).otherwise(0) + F.when(band == own, 2).otherwise(0) + F.when(F.col("open"), 1).otherwise(0)
    dealt = posts.select("*", F.explode(F.sequence(own, F.when(shorter, F.greatest(own, _band(most))).otherwise(own))).alias("band"))
    return dealt.select(F.xxhash64("token", "band").alias("token"), "cls", "doc", "at", "n", "b0", "b1", marks.alias("marks"))


def _close(t: float, a: str, b: str) -> Column:
    """What the sizes and bitmaps of two sets, a the smaller one, allow."""
    c = lambda side, name: F.col(f"{side}{name}")
    na, nb = c(a, "n"), c(b, "n")
    all_, half = [c(a, x).bitwiseXOR(c(b, x)) for x in ("b0", "b1")]
    apart = F.when((na > _WIDE) & (nb > _WIDE), F.bit_count(half) + F.bit_count(all_.bitwiseXOR(half))).otherwise(F.bit_count(all_))
    return (na * 1000 >= nb * round(t * 1000)) & (apart <= na + nb - 2 * _need(na, nb, t))


def identified(docs: DataFrame) -> DataFrame:
    """`docs` with _doc and _sub, which equal rows alone share, and _copy: 0 for one of equal rows, more for the others.

    _doc is doc_id, the last number for null; _sub is 0 unless rows of other texts have the same _doc. Texts are known by
    64-bit hashes.
    """
    own = docs.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)))
    keys = own.select("_doc", F.xxhash64("text").alias("_hash"))
    shared = materialize(keys.groupBy("_doc").agg(F.count("*").alias("rows")).filter("rows > 1").select("_doc"), "line-shared-ids")
    n_shared = shared.count()
    if not n_shared:
        return own.withColumn("_sub", F.lit(0).cast("long")).withColumn("_copy", F.lit(0))
    # Numbers in the order of (_doc, _hash) over all texts of such doc_ids: sorted ranges, each after the rows before it.
    texts = keys.join(broadcast_if_small(shared, n_shared, _BROADCAST_ROWS), "_doc").groupBy("_doc", "_hash").agg(F.count("*").alias("_rows"))
    texts = texts.repartitionByRange("_doc", "_hash").sortWithinPartitions("_doc", "_hash").withColumn("_id", F.monotonically_increasing_id())
    texts = materialize(texts, "line-shared-texts")
    part = F.shiftright("_id", 33)
    before, starts = 0, []
    for r in texts.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a range
        starts += [F.lit(r.part), F.lit(before)]
        before += r["count"]
    sub = (F.element_at(F.create_map(*starts), part) + F.col("_id").bitwiseAND((1 << 33) - 1)).cast("long")
    named = broadcast_if_small(texts.select("_doc", "_hash", "_rows", sub.alias("_sub")), before, _BROADCAST_ROWS)
    own = own.withColumn("_hash", F.xxhash64("text")).join(named, ["_doc", "_hash"], "left").withColumn("_sub", F.coalesce("_sub", F.lit(0).cast("long")))
    repeated = F.coalesce(F.col("_rows") > 1, F.lit(False))
    order = Window.partitionBy("_doc", "_sub").orderBy(F.xxhash64(F.to_json(F.struct(*docs.columns))))
    once = own.filter(~repeated).withColumn("_copy", F.lit(0))
    again = own.filter(repeated).withColumn("_copy", F.row_number().over(order) - 1)
    return once.union(again).drop("_hash", "_rows")


def _wordy() -> Column:
    """The numbers of the lines with a word; all of them go from a row that an equal one comes before."""
    words = lambda x: F.size(F.array_remove(F.array_distinct(F.split(x, " ")), ""))
    taking = F.transform(F.split(_plain(F.col("text")), "\n"), lambda x, i: F.when(words(x) > 0, i))
    return F.filter(taking, lambda i: i.isNotNull())


def removed_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(_doc, _sub, removed): the lines, counted from 0, that an earlier line is similar to; `docs` as identified() gives
    them. Texts of which no line goes don't appear.

    Rows that are equal count once. Lines without a word are never removed and remove nothing. Null texts have no lines;
    null doc_ids come last in the order. A set is known by a 64-bit hash of its words, so among n different lines two are
    taken for one with a chance of n * n / 3.7e19.
    """
    # Every line, once: its set's hash, size, prefix and bitmap. Lines without words are filtered after the write, as a
    # filter before it would make the tokens twice.
    docs = docs.filter("_copy = 0")
    levels = rarity(docs)
    rows = docs.select(F.col("_doc").alias("doc"), F.col("_sub").alias("sub"), F.posexplode(F.split(_plain(F.col("text")), "\n")).alias("line", "raw"))
    rows = rows.select("doc", F.shiftleft("sub", _SUB).bitwiseOR(F.col("line")).alias("at"), _hashes(F.col("raw")).alias("hashes"))
    # Spark compiles what makes the hashes only as a step of its own, which it stays as two columns read it.
    rows = rows.select("doc", "at", F.size("hashes").alias("n"), _tokens("hashes", levels).alias("tokens"))
    n = F.col("n")
    # Sets of so few words that one word more is too many are similar to themselves alone: cls settles them.
    prefix = F.when(n * 1000 >= (n + 1) * round(similarity * 1000), F.slice("tokens", F.lit(1), n - _room(n, similarity)[0] + 1))
    wide = materialize(rows.select("doc", "at", F.xxhash64("tokens").alias("cls"), "n", prefix.alias("prefix"), *_bitmaps("tokens", n)), "lines-wide").filter("n > 0")
    same = ("n", "prefix", "b0", "b1")
    classes = wide.groupBy("cls").agg(F.min(F.struct("doc", "at")).alias("first"), F.count("*").alias("lines"), *[F.first(c).alias(c) for c in same])
    classes = materialize(classes.select("cls", "first.doc", "first.at", "lines", *same), "line-classes")
    lines = wide.select("doc", "at", "cls")

    first = F.slice("prefix", F.lit(1), F.col("n") - _room(F.col("n"), similarity)[1] + 1)
    posts = classes.select("cls", "doc", "at", "n", "b0", "b1", _band(F.col("n")).alias("own"), F.explode(first).alias("token")).withColumn("token", F.xxhash64("token", "own")).drop("own")
    hot = materialize(posts.groupBy("token").count().filter(F.col("count") >= _HOT).select("token"), "line-words")
    settled, n_hot = None, hot.count()
    if n_hot:
        # Round 1: the many variants of a passage share words. Of each word's sets of a band the earliest of each of _LEADS parts
        # leads; every set is compared with the leads before it, which settles most variants by a few comparisons.
        members = materialize(posts.join(broadcast_if_small(hot, n_hot, _BROADCAST_ROWS), "token"), "line-members")
        lead = F.min(F.struct("doc", "at", "cls", "n", "b0", "b1")).alias("lead")
        leads = materialize(members.groupBy("token", F.pmod("cls", F.lit(_LEADS)).alias("part")).agg(lead), "line-leads")
        side = broadcast_if_small(leads.select("token", *[F.col(f"lead.{c}").alias(f"l_{c}") for c in ("doc", "at", "cls", "n", "b0", "b1")]), leads.count(), _BROADCAST_ROWS // 8)
        before = (F.col("l_doc") < F.col("doc")) | ((F.col("l_doc") == F.col("doc")) & (F.col("l_at") < F.col("at")))
        smaller = F.col("n") <= F.col("l_n")
        near = (smaller & _close(similarity, "", "l_")) | (~smaller & _close(similarity, "l_", ""))
        met = members.join(side, "token").filter(before & near).select(F.col("cls").alias("a"), F.col("l_cls").alias("b")).distinct()
        settled = materialize(_verified(docs, classes, met, levels, similarity).select(F.col("a").alias("cls")).distinct(), "line-settled")
        drop(members)
    # Round 2: every set that is still open against all earlier ones. The smaller one of a pair has the shorter prefix.
    # The first word that two similar sets share has so many words after it in both as the sets must have in common.
    flagged = classes.withColumn("open", F.lit(True))
    if settled is not None:
        side = broadcast_if_small(settled.withColumn("settled", F.lit(True)), settled.count(), _BROADCAST_ROWS)
        flagged = materialize(classes.join(side, "cls", "left").withColumn("open", F.col("settled").isNull()).drop("settled"), "line-open")
    sized = flagged.select("cls", "doc", "at", "n", "b0", "b1", "open", "prefix", _band(F.col("n")).alias("own"), (F.col("n") - _room(F.col("n"), similarity)[1] + 1).alias("short"))
    posts = sized.select(*[c for c in sized.columns if c != "prefix"], F.posexplode("prefix").alias("pos", "token"))
    found = []
    for i in range(_PASSES):
        each = _banded(posts.filter(F.pmod("token", F.lit(_PASSES)) == i), similarity)
        # What holds for x alone stands in one condition with what holds for both: a filter of x would need a shuffle of its own.
        x, y = each.alias("x"), each.alias("y")
        left = lambda side: F.col(f"{side}n") - F.shiftright(f"{side}marks", 3)
        has = lambda side, mark: F.col(f"{side}marks").bitwiseAND(mark)
        once = (F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cls") < F.col("y.cls")))
        room = F.least(left("x."), left("y.")) >= _need(F.col("x.n"), F.col("y.n"), similarity)
        late = (F.col("x.doc") > F.col("y.doc")) | ((F.col("x.doc") == F.col("y.doc")) & (F.col("x.at") > F.col("y.at")))
        asks = F.when(late, has("x.", 1)).otherwise(has("y.", 1)) > 0
        meets = has("x.", 4) + has("y.", 2) == 6
        met = x.join(y, (F.col("x.token") == F.col("y.token")) & meets & once & _close(similarity, "x.", "y.") & room & asks)
        pair = met.select(F.when(late, F.col("x.cls")).otherwise(F.col("y.cls")).alias("a"), F.when(late, F.col("y.cls")).otherwise(F.col("x.cls")).alias("b"))
        found.append(materialize(pair.distinct(), "line-candidates"))
    later = _verified(docs, classes, reduce(DataFrame.union, found).distinct(), levels, similarity).select(F.col("a").alias("cls"))
    later = materialize((later if settled is None else later.union(settled)).distinct(), "line-later")
    # A class with a similar earlier one goes wholly; of any other its first line stays.
    if settled is not None:
        drop(flagged)
    side = broadcast_if_small(later.withColumn("later", F.lit(True)), later.count(), _BROADCAST_ROWS)
    fate = classes.select("cls", F.struct("doc", "at").alias("first"), "lines").join(side, "cls", "left").filter("later or lines > 1").select("cls", "first", F.coalesce("later", F.lit(False)).alias("later"))
    fate = materialize(fate, "line-fate")
    gone = lines.join(broadcast_if_small(fate, fate.count(), _BROADCAST_ROWS), "cls").filter(F.col("later") | (F.struct("doc", "at") > F.col("first")))
    line = F.col("at").bitwiseAND(_LINE).cast("int")
    gone = gone.groupBy(F.col("doc").alias("_doc"), F.shiftright("at", _SUB).alias("_sub")).agg(F.array_sort(F.collect_set(line)).alias("removed"))
    gone = materialize(gone, "lines-gone")
    drop(classes, wide, hot, later, fate, *found)
    return gone


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, levels: Column, similarity: float) -> DataFrame:
    """The pairs of classes whose words, fetched from the first line of each, are similar; words are known by 64-bit hashes."""
    pairs = materialize(pairs, "line-pairs")
    n_pairs = pairs.count()
    asked = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b"))).distinct()
    where = classes.select("cls", "doc", "at").join(broadcast_if_small(asked, 2 * n_pairs, _BROADCAST_ROWS), "cls")
    spot = F.struct(F.col("at").bitwiseAND(_LINE).cast("int").alias("line"), "cls")
    wanted = materialize(where.groupBy("doc", F.shiftright("at", _SUB).alias("sub")).agg(F.collect_list(spot).alias("at")), "line-places")
    rows = wanted.select(F.sum(F.size("at"))).first()[0] or 0
    own = docs.select(F.col("_doc").alias("doc"), F.col("_sub").alias("sub"), "text")
    found = own.join(broadcast_if_small(wanted, rows, _BROADCAST_ROWS), ["doc", "sub"]).select("at", F.split("text", "\n").alias("lines"))
    found = found.select(F.explode(F.transform("at", lambda x: F.struct(x["cls"].alias("cls"), F.get("lines", x["line"]).alias("raw")))).alias("x")).select("x.cls", "x.raw")
    words = materialize(found.select("cls", _hashes(_plain(F.col("raw"))).alias("words")), "line-words")
    both = pairs.join(words.select(F.col("cls").alias("a"), F.col("words").alias("aw")), "a").join(words.select(F.col("cls").alias("b"), F.col("words").alias("bw")), "b")
    return both.filter(F.size(F.array_intersect("aw", "bw")) >= _need(F.size("aw"), F.size("bw"), similarity)).select("a", "b")


def line_report(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed array<int>) for each row of `docs`; a null text has no lines.

    Each row has its own list, rows with a repeated or null doc_id too. doc_id counts as a long. An empty table gives an
    empty result. Texts and lines of any length are taken whole. Other columns are not read.
    """
    docs = identified(docs.select("doc_id", "text"))
    gone = removed_lines(docs, similarity)
    rows = gone.select(F.sum(F.size("removed"))).first()[0] or 0
    n_lines = F.greatest(F.coalesce(F.size(F.split("text", "\n")), F.lit(0)), F.lit(0))
    own = docs.select("_doc", "_sub", F.col("doc_id").cast("long").alias("doc_id"), n_lines.cast("long").alias("n_lines"), F.when(F.col("_copy") > 0, _wordy()).alias("all"))
    removed = F.coalesce("all", "removed", F.array().cast("array<int>"))
    joined = own.join(broadcast_if_small(gone, rows, _BROADCAST_ROWS), ["_doc", "_sub"], "left")
    return joined.select("doc_id", "n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def dedup_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """`docs` with the removed lines taken out of text, and n_chars, if there, counted anew.

    Documents of which no line stays are dropped; null texts stay. All columns of `docs` are returned, whatever their
    names. Rows, texts and doc_ids are met as in line_report().
    """
    named, back = packed(docs, "doc_id", "text", "n_chars")
    own = identified(named)
    gone = removed_lines(own, similarity).withColumnRenamed("removed", "_gone")
    rows = gone.select(F.sum(F.size("_gone"))).first()[0] or 0
    out = own.join(broadcast_if_small(gone, rows, _BROADCAST_ROWS), ["_doc", "_sub"], "left")
    out = out.withColumn("_gone", F.when(F.col("_copy") > 0, _wordy()).otherwise(F.col("_gone")))
    kept = F.filter(F.split("text", "\n"), lambda _, i: ~F.array_contains("_gone", i))
    out = out.withColumn("_kept", F.when(F.col("_gone").isNotNull() & F.col("text").isNotNull(), kept))
    out = out.filter("_kept is null or size(_kept) > 0").withColumn("text", F.when(F.col("_kept").isNull(), F.col("text")).otherwise(F.array_join("_kept", "\n")))
    if "n_chars" in named.columns:
        out = out.withColumn("n_chars", F.when(F.col("_kept").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(named.schema["n_chars"].dataType)))
    return back(out)
