"""SimHash near-duplicate groups by multi-index hashing.

A text's fingerprint has bit i set if bit i is set in over half of its shingles' XXH64 values. Two fingerprints that
differ in at most `distance` bits must differ in at most distance // segments bits within one of the segments, so each
fingerprint looks up the Hamming ball of that radius around each of its segments in a table of exact segments, and
complete distances verify what the tables return. Groups are the connected components of the verified links.
"""

from __future__ import annotations

import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, packed

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Shingles whose bits are counted at once: 64 bytes each.
_CHUNK = 1 << 16


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint. No words, empty and null texts: 0; under `shingle` words: one shingle of all."""
    words = (text or "").encode().lower().split()  # on bytes: A-Z alone, and \\x20 \\x09-\\x0D alone
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    n, counts, digest = len(words) - k + 1, np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, _CHUNK):
        to = min(n, at + _CHUNK)
        values = np.array([digest(joined[a:b], seed) for a, b in zip(starts[at:to].tolist(), ends[at + k - 1 : to + k - 1].tolist())], np.uint64)
        counts += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fp long, text_hash long) for each row of `docs`; fp holds the 64 bits as a signed number."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle, seed) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps), batch.column(2)], ["doc_id", "fp", "text_hash"])

    cols = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))
    return cols.mapInArrow(run, "doc_id long, fp long, text_hash long")


def links(fps: DataFrame, distance: int = 3, segments: int = 2) -> DataFrame:
    """(a, b), a < b: every pair of values in the distinct column `fp` that differ in 1 to `distance` bits.

    With two segments of 32 bits a table's bucket holds about n / 2**32 of n spread fingerprints, so candidates stay
    near the true links at any corpus size. A ball is listed upwards only (key ^ mask >= key): of two different
    segments just one lists the other. A bucket that is hot by itself is left to the skew join of adaptive execution.
    """
    edges = [64 * i // segments for i in range(segments + 1)]
    radius = distance // segments

    def segment(i):
        width = edges[i + 1] - edges[i]
        return F.shiftrightunsigned("fp", edges[i]).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))

    balls = [
        [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(edges[i + 1] - edges[i]), r)]
        for i in range(segments)
    ]
    keyed = fps.select("fp", F.posexplode_outer(F.array(*map(segment, range(segments)))).alias("seg", "key"))
    masks = F.element_at(F.array(*[F.array(*[F.lit(m).cast("long") for m in ball]) for ball in balls]), F.col("seg") + 1)
    asked = keyed.select(F.col("fp").alias("a"), "seg", F.explode_outer(F.filter(F.transform(masks, lambda m: F.col("key").bitwiseXOR(m)), lambda k: k >= F.col("key"))).alias("key"), F.col("key").alias("own"))
    found = asked.join(keyed.withColumnRenamed("fp", "b"), ["seg", "key"])
    near = found.filter((F.col("a") != F.col("b")) & ((F.col("key") != F.col("own")) | (F.col("a") < F.col("b"))) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node that each node of `edges` (a, b) reaches; nodes without edges don't appear.

    Alternating large-star and small-star rounds; their number grows with the logarithm of the longest path. Each round
    is written to the shared folder, so plans stay short and a lost executor costs one round at most.
    """
    now, before = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = state
        both = now.union(now.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
        now = materialize(small.distinct(), "edges")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(doc_id, fingerprint hex, component_id, text_hash) for each row of `docs`.

    component_id is the smallest doc_id whose text's fingerprint is reached over links of at most `distance` bits,
    the row's own included. Exact copies share a fingerprint and never become pairs. Rows with a repeated doc_id each
    give a row. A null doc_id is never the smallest unless all of its component are null. Extra columns are not read.
    An empty table gives an empty result.
    """
    fps = materialize(fingerprints(docs, shingle, seed), "fps")
    classes = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = components(links(classes.select("fp"), distance))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    out = fps.join(named, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_hash")


def keep_one(docs: DataFrame, distance: int = 3, shingle: int = 3) -> DataFrame:
    """`docs` with one row of each component, as keep_first() chooses it."""
    return keep_first(docs, near_duplicates(docs, distance, shingle))


def keep_first(docs: DataFrame, found: DataFrame) -> DataFrame:
    """`docs` with one row of each component in `found` (doc_id, component_id, text_hash): that of its smallest doc_id,
    and of that doc_id's smallest text hash; all columns as they were, whatever their names.

    Components in which no row has a doc_id keep all their rows. An empty table gives an empty result.
    """
    docs, back = packed(docs, "doc_id", "text")
    first = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("_keep_id")).agg(F.min("text_hash").alias("_keep_hash"))
    hashed = docs.withColumn("_row_hash", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_key", F.col("doc_id").cast("long"))
    kept = hashed.join(first, (F.col("_key") == F.col("_keep_id")) & (F.col("_row_hash") == F.col("_keep_hash"))).dropDuplicates(["_key"])
    alone = found.filter("component_id is null").select(F.col("text_hash").alias("_keep_hash")).distinct()
    loose = hashed.filter("_key is null").join(alone, F.col("_row_hash") == F.col("_keep_hash"), "left_semi")
    return back(kept.select(*docs.columns).union(loose.select(*docs.columns)))
