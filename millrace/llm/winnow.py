"""Benchmark decontamination by winnowing, in DataFrame functions only.

Of every `window - gram + 1` consecutive grams of `gram` words the one with the smallest hash is kept, on both sides by
the same rule, so each span of `window` shared words shares a kept gram. Kept grams of documents and items are joined,
and each hit is extended to all windows around it, whose words are compared in full. Items shorter than `window` are
one window of their own length; of those lengths every gram is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import LOWER, UPPER, broadcast_if_small, materialize, packed

#: Distinct benchmark grams or windows that may be broadcast: 16 bytes a gram, about 100 a window.
BROADCAST_GRAMS, BROADCAST_WINDOWS = 1_000_000, 300_000
_EVERY = "0"  # the gram that each document has, so that none is lost in the join


def words_of(text: Column) -> Column:
    """Words of A-Z-lower-cased text: runs of a-z, 0-9 and all characters beyond ASCII."""
    odd = text.rlike(r"[\x{80}-\x{10FFFF}&&[^\p{Ll}\p{Lo}\p{M}\p{P}]]")  # letters that lower() might change as well
    low = F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))
    return F.filter(F.split(F.coalesce(low, F.lit("")), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def _grams(words: Column, n: int) -> Column:
    """The hash of each run of n words; an empty array if there are fewer."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    return F.when(F.size(words) >= n, F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(n)]))).otherwise(F.array().cast("array<bigint>"))


def _kept(grams: Column, width: int) -> Column:
    """struct(p, fp, n) of the leftmost smallest hash of each `width` consecutive grams."""
    def least(j):
        part = F.slice(grams, j + 1, width)
        return j + F.array_position(part, F.array_min(part)).cast("int") - 1

    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(grams) - width), least))
    kept = F.transform(at, lambda p: F.struct(p.alias("p"), F.get(grams, p).alias("fp"), F.lit(0).alias("n")))
    return F.when(F.size(grams) >= width, kept).otherwise(F.array().cast("array<struct<p:int,fp:bigint,n:int>>"))


def _every(words: Column, n: int) -> Column:
    """struct(p, fp, n) of each run of n words, for items of that length."""
    at = F.sequence(F.lit(0), F.size(words) - n)
    each = F.transform(at, lambda i: F.struct(i.alias("p"), F.xxhash64(F.lit(n), *[F.get(words, i + j) for j in range(n)]).alias("fp"), F.lit(n).alias("n")))
    return F.when(F.size(words) >= n, each).otherwise(F.array().cast("array<struct<p:int,fp:bigint,n:int>>"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, gram: int = 6, broadcast_grams: int = BROADCAST_GRAMS, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated) for each row of `docs`.

    A null or empty text has no words and no hits; an item without words has no windows. Repeated item rows count once
    an item_id; repeated documents each give a row. doc_id counts as a long. An empty table of documents gives an empty
    result, one of items no hits. Texts of any length are taken whole. Extra columns are not read. Past the broadcast bounds, the joins shuffle, and words are fetched again
    for documents with hits instead of travelling with every gram.
    """
    item = benchmark.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("w")).filter("size(w) > 0")
    long, short = item.filter(F.size("w") >= window), item.filter(F.size("w") < window)
    lengths = sorted(r.n for r in short.select(F.size("w").alias("n")).distinct().collect())  # under `window` values
    whole = F.transform(F.sequence(F.lit(0), F.size("w") - window), lambda i: F.array_join(F.slice("w", i + 1, window), " "))
    pairs = long.select("item_id", F.explode(whole).alias("window")).union(short.select("item_id", F.array_join("w", " "))).distinct()
    sets = materialize(pairs.groupBy("window").agg(F.array_sort(F.collect_set("item_id")).alias("items")), "windows")
    windows = sets.select("window", F.xxhash64("items").alias("set_id"))
    members = sets.select(F.xxhash64("items").alias("set_id"), "items").dropDuplicates(["set_id"]).select("set_id", F.explode("items").alias("item_id"))

    def prints(df: DataFrame) -> DataFrame:
        df = df.withColumn("g", _grams(F.col("w"), gram))
        return df.withColumn("prints", F.concat(_kept(F.col("g"), window - gram + 1), *[_every(F.col("w"), n) for n in lengths])).drop("g")

    test = long.select(F.explode(_kept(_grams(F.col("w"), gram), window - gram + 1)).alias("x")).select("x.fp")
    for n in lengths:
        test = test.union(short.filter(F.size("w") == n).select(F.xxhash64(F.lit(n), *[F.get("w", F.lit(j)) for j in range(n)])))
    test = materialize(test.union(docs.sparkSession.sql(f"select cast({_EVERY} as bigint)")).distinct(), "grams")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), words_of(F.col("text")).alias("w")).withColumn("n_words", F.size("w").cast("long"))
    row = F.struct(F.lit(-1).alias("p"), F.expr(f"cast({_EVERY} as bigint)").alias("fp"), F.lit(0).alias("n"))
    given = prints(own).withColumn("prints", F.concat("prints", F.array(row)))
    if test.count() <= broadcast_grams:
        cast = given.select("doc_id", "text_hash", "n_words", "w", F.explode_outer("prints").alias("x")).withColumn("fp", F.col("x.fp"))
        hits = cast.join(F.broadcast(test), "fp").select("doc_id", "text_hash", "n_words", "w", "x.p", "x.n")
    else:
        cast = given.select("doc_id", "text_hash", F.explode_outer("prints").alias("x")).select("doc_id", "text_hash", "x.*")
        met = cast.join(test.hint("merge"), "fp").groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("p", "n")).alias("at")).withColumnRenamed("doc_id", "d").withColumnRenamed("text_hash", "h")
        hits = own.join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h"))).select("doc_id", "text_hash", "n_words", "w", F.explode("at").alias("x")).select("doc_id", "text_hash", "n_words", "w", "x.*")
    back = window - gram
    first, last = F.greatest(F.col("p") - back, F.lit(0)), F.least(F.col("p"), F.size("w") - window)
    around = F.transform(F.sequence(first, last), lambda s: F.struct(s.alias("s"), F.array_join(F.slice("w", s + 1, window), " ").alias("window")))
    alone = F.array(F.struct(F.col("p").alias("s"), F.array_join(F.slice("w", F.col("p") + 1, F.col("n")), " ").alias("window")))
    near = F.when(F.col("p") < 0, None).when(F.col("n") > 0, alone).otherwise(around)
    spans = hits.select("doc_id", "text_hash", "n_words", F.when(F.col("n") > 0, F.col("n")).otherwise(F.lit(window)).alias("n"), F.explode_outer(near).alias("x")).select("doc_id", "text_hash", "n_words", "n", "x.*")
    side = F.broadcast(windows) if windows.count() <= broadcast_windows else windows
    found = spans.join(side, "window", "left").filter("s is null or set_id is not null")
    found = materialize(found.select("doc_id", "text_hash", "n_words", "s", (F.col("s") + F.col("n")).alias("e"), "set_id"), "spans")
    cover = F.aggregate(
        F.array_sort("at"), F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["sum"] + F.greatest(F.lit(0), x["e"] - F.greatest(x["s"], a["end"]))).alias("sum"), F.greatest(a["end"], x["e"]).alias("end")),
        lambda a: a["sum"].cast("long"),
    )
    spot = F.when(F.col("s").isNotNull(), F.struct("s", "e"))
    counted = found.groupBy("doc_id", "text_hash").agg(F.max("n_words").alias("n_words"), F.count_if(F.col("s").isNull()).alias("rows"), F.collect_set(spot).alias("at"))
    counted = counted.select("doc_id", "text_hash", "n_words", "rows", cover.alias("n_hit"))
    named = found.filter("set_id is not null").select("doc_id", "text_hash", "set_id").distinct().join(members, "set_id")
    named = named.groupBy(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")).agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    out = counted.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    out = out.select(
        "doc_id", "text_hash", "n_words", "n_hit", F.size(items).cast("long").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"), "rows",
    )
    out = materialize(out, "contamination")
    many = out.filter("rows > 1").withColumnsRenamed({"doc_id": "d", "text_hash": "h"})
    n_many = many.count()
    if not n_many:
        return out.drop("rows")
    names = own.select("doc_id", "text_hash").join(broadcast_if_small(many, n_many, broadcast_windows), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")))
    return out.filter("rows = 1").drop("rows").union(names.drop("d", "h", "rows"))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """`docs` without the rows that hold any window of an item, all columns as they were, whatever their names.

    Rows with null doc_id or text stay if clean. Empty tables, repeated rows and long texts are met as in contamination().
    """
    docs, back = packed(docs, "doc_id", "text")
    bad = contamination(docs, benchmark).filter("n_hit > 0").select(F.col("doc_id").alias("_bad_id"), F.col("text_hash").alias("_bad_hash")).distinct()
    bad = materialize(bad, "contaminated")
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_bad_id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("_bad_hash"))
    return back(docs.join(broadcast_if_small(bad, bad.count(), BROADCAST_GRAMS), same, "left_anti"))
