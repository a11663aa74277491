"""Token ids as word-aligned binary files: Simple-8b blocks that decode by whole arrays.

A word of 64 bits holds a selector in its top 4 bits and equally wide ids in the rest; selector 0 is an escape: the next
word is one number as it stands. Ids are cut into blocks of BLOCK, each starting a new word; a frame's offsets give each
block's first word. A file is Parquet with one frame a row, (shard, frame, start, doc_ids, counts, offsets, words), as
Spark's writers commit such files whole on any store and survive lost executors. Files and frames follow doc_id.
"""

from __future__ import annotations

import re
import sys
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from millrace.sources.scratch import fresh_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BLOCK = 256
#: Ids from which a frame is closed.
FRAME = 1 << 20
#: Ids in a word and bits of each, by selector from 1.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
#: Bytes of text that are encoded at once.
_BYTES = 1 << 22
#: Distinct words whose ids are kept from one run of texts to the next; beyond it those go that only one run had.
_KEPT = 400_000
#: Bytes of input for which a further token file is written.
_SHARD = 64 << 20


def pack(values: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, offsets): `values` as unsigned 64-bit words, and the first word of each block of `block` values.

    For every place the selector that takes the most values is found by running maxima; then all blocks step from word
    to word at once.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    exact = np.float32 if values.max() < 1 << 24 else np.float64
    bits = np.maximum(np.frexp(values.astype(exact))[1], 1).astype(np.int8)
    if exact is np.float64:  # which is so only below 2 ** 53
        high = values >> np.uint64(32)
        wide = np.flatnonzero(high)
        bits[wide] = 32 + np.frexp(high[wide].astype(np.float64))[1]
    room = np.tile(np.arange(block, 0, -1, dtype=np.int16), -(-n // block))[:n]
    if n % block:
        room[n - n % block :] = np.arange(n % block, 0, -1)
    best, most, before = np.zeros(n, np.int8), bits, 1
    for s in range(len(COUNTS) - 1, 0, -1):  # from one value a word up; most[i] is the widest of values i to i + count - 1
        count = int(COUNTS[s])
        if count > n:
            break
        if count > 1:
            most, before = np.maximum(most[: n - count + 1], most[count - before :][: n - count + 1]), count
        np.copyto(best[: n - count + 1], s, where=(most <= WIDTHS[s]) & (room[: n - count + 1] >= count))
    at, end, seen = np.arange(0, n, block), np.minimum(np.arange(block, n + block, block), n), []
    while len(at):
        seen.append(at)
        at = at + COUNTS[best[at]]
        live = at < end
        at, end = at[live], end[live]
    first = np.sort(np.concatenate(seen))
    selector = best[first]
    where = np.cumsum(1 + (selector == 0)) - (1 + (selector == 0))
    words = np.zeros(len(first) + int((selector == 0).sum()), np.uint64)
    for s in np.unique(selector):
        own = selector == s
        if s == 0:
            words[where[own] + 1] = values[first[own]]
            continue
        ids = values[first[own][:, None] + np.arange(COUNTS[s])] << (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
        words[where[own]] = (np.uint64(s) << np.uint64(60)) | np.bitwise_or.reduce(ids, axis=1)
    return words, where[first % block == 0].astype(np.uint32)


def unpack(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The `n` values that pack() gave. All blocks step from word to word at once, each from its own offset."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int8)
    at, place = np.asarray(offsets, np.int64), np.arange(0, n, block)
    end, seen = np.minimum(place + block, n), []
    while len(at):
        seen.append((at, place))
        own = selector[at]
        at, place = at + 1 + (own == 0), place + COUNTS[own]  # an escape takes the next word as well
        live = place < end
        at, place, end = at[live], place[live], end[live]
    out = np.zeros(n, np.uint64)
    if not seen:
        return out
    at, place = (np.concatenate(x) for x in zip(*seen))
    own = selector[at]
    for s in np.unique(own):
        here = own == s
        if s == 0:
            out[place[here]] = words[at[here] + 1]
            continue
        shifts = (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64)
        out[place[here][:, None] + np.arange(COUNTS[s])] = (words[at[here]][:, None] >> shifts) & np.uint64((1 << int(WIDTHS[s])) - 1)
    return out


def unpack_block(words: np.ndarray, offsets: np.ndarray, n: int, which: int, block: int = BLOCK) -> np.ndarray:
    """The values of one block, of which alone the words are read."""
    to = offsets[which + 1] if which + 1 < len(offsets) else len(words)
    return unpack(words[offsets[which] : to], np.zeros(1, np.int64), min(block, n - which * block), block)


def _lists(flat: np.ndarray, counts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of lists that stand one after another in `flat`: the lists `which`, one after another, and where each ends."""
    starts = (np.cumsum(counts) - counts)[which]
    sizes = counts[which]
    ends = np.cumsum(sizes)
    return flat[np.arange(int(sizes.sum())) + np.repeat(starts - (ends - sizes), sizes)], ends


class WordEncoder:
    """Ids by distinct words between spaces and line feeds, and those of visible ASCII by their distinct parts.

    Holds for tokenizers that turn white space into one space and drop it, ignore case, cut ASCII as _PARTS does and
    take a part's bytes as they stand; a few texts check that at the start. Splitting, lower-casing, and finding distinct
    and known words are Arrow's.
    """

    _PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")  # fixed values: the tokenizer's own cuts
    _PLAIN = re.compile(r"[!-~]+")
    #: A word of letters, and one with a closing sign, which is no apostrophe.
    _LETTERS, _CLOSED = "^[a-z]+$", "^[a-z]+[!-&(-/:-@\\[-`{-~]$"

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self._reset()
        probe = ["A b\n c", "It's don't I'LL x''s y!'s 12ab3", "", "(re)'re-'ve,''d.'m \u00c9T\u00c9", "one, two. ~ `a` [b] \\ c^", "<|EndOfText|> x<|startoftext|>y"]
        if self.encode(pa.array(probe), 0)[0].tolist() != [i for x in self._ids(probe) for i in [*x, 0]]:
            raise ValueError("this tokenizer's ids depend on white space, case or other cuts of ASCII")

    def _reset(self) -> None:
        self.words, self.uses = pa.array([], pa.string()), np.zeros(0, np.int64)
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Drop words that one run of texts had, or all if too many others are left; this changes no result."""
        often = np.flatnonzero(self.uses > 1)
        if len(often) > _KEPT // 2:
            return self._reset()
        self.ids, _ = _lists(self.ids, self.counts, often)
        self.words, self.counts, self.uses = self.words.take(pa.array(often)), self.counts[often], self.uses[often] // 2

    def _ids(self, texts: list[str]) -> list[list[int]]:
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [e.ids for e in run(texts, add_special_tokens=False)]

    def _of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all `words`, which are not known yet, and their number by word."""
        simple, closed = (pc.match_substring_regex(words, x) for x in (self._LETTERS, self._CLOSED))
        ended = words.filter(closed)
        heads, signs = pc.utf8_slice_codeunits(ended, 0, -1), pc.utf8_slice_codeunits(ended, -1)
        cut, odd = [], {}  # odd words count from -1 down
        for w in words.filter(pc.invert(pc.or_(simple, closed))).to_pylist():
            if self._PLAIN.fullmatch(w) and "<|" not in w:
                cut.append(self._PARTS.findall(w.lower()))
            else:
                cut.append([odd.setdefault(w, -1 - len(odd))] if w else [])
        others = [p for own in cut for p in own]
        plain = pa.array([p for p in others if isinstance(p, str)], pa.string())
        alone = words.filter(simple)
        parts = pc.unique(pa.concat_arrays([alone, heads, signs, plain]))
        # a part is a word by itself, so its ids may be known
        number = pc.fill_null(pc.index_in(parts, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh, model = parts.filter(pa.array(number < 0)).to_pylist(), self.tokenizer.model.tokenize
        found = [[t.id for t in model(p)] for p in fresh] + self._ids([*odd])
        number[number < 0] = len(self.words) + np.arange(len(fresh))
        flat = np.concatenate((self.ids, np.array([i for x in found for i in x], np.int32)))
        sizes = np.concatenate((self.counts, np.fromiter(map(len, found), np.int64, len(found))))
        of = lambda x: number[pc.index_in(x, value_set=parts).to_numpy(zero_copy_only=False)] if len(x) else np.zeros(0, np.int64)
        first, second = simple.to_numpy(zero_copy_only=False), closed.to_numpy(zero_copy_only=False)
        n_parts = np.where(first, 1, 2)
        n_parts[~(first | second)] = [len(own) for own in cut]
        starts = np.cumsum(n_parts) - n_parts
        which = np.zeros(int(n_parts.sum()), np.int64)
        which[starts[first]] = of(alone)
        which[starts[second]], which[starts[second] + 1] = of(heads), of(signs)
        named = np.array([p if isinstance(p, int) else 0 for p in others], np.int64)
        named[named < 0] = len(self.words) + len(fresh) - 1 - named[named < 0]
        named[[i for i, p in enumerate(others) if isinstance(p, str)]] = of(plain)
        inner = np.repeat(~(first | second), n_parts)
        which[inner] = named
        ids, ends = _lists(flat, sizes, which)
        ends = np.concatenate(([0], ends))
        return ids, ends[starts + n_parts] - ends[starts]

    def encode(self, texts: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by `end`, and their number by text. Null texts count as empty."""
        texts = pc.fill_null(texts, "")
        # lower-casing first is no different only where no combining mark could join a small letter alone, and where no
        # special token, which the library finds before it lower-cases, could be written in capitals
        kept = pc.or_(pc.match_substring_regex(texts, r"\pM"), pc.match_substring(texts, "<|"))
        cut = pc.split_pattern(pc.replace_substring(pc.if_else(kept, texts, pc.ascii_lower(texts)), "\n", " "), " ")
        coded = pc.list_flatten(cut).dictionary_encode()
        if len(self.words) > _KEPT:
            self._forget()
        known = pc.index_in(coded.dictionary, value_set=self.words)
        number = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        new = coded.dictionary.filter(pc.is_null(known))
        if len(new):
            ids, counts = self._of_words(new)
            number[number < 0] = len(self.words) + np.arange(len(new))
            self.words, self.uses = pa.concat_arrays([self.words, new]), np.concatenate((self.uses, np.zeros(len(new), np.int64)))
            self.ids, self.counts = np.concatenate((self.ids, ids.astype(np.int32))), np.concatenate((self.counts, counts))
        self.uses[number] += 1
        # the end is one more word after each text's
        n_words = np.cumsum(pc.list_value_length(cut).to_numpy())
        which = np.insert(number[coded.indices.to_numpy()], n_words, len(self.words))
        flat, ends = _lists(np.append(self.ids, np.int32(end)), np.append(self.counts, 1), which)
        counts = np.diff(np.concatenate(([0], ends[n_words + np.arange(len(texts))])))
        return flat.astype(np.uint32, copy=False), counts


_FRAMES = "shard int, frame int, start long, doc_ids array<long>, counts array<long>, offsets binary, words binary"


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str, end: int = 1) -> None:
    """Write every row's ids, with `end` after each, to the token files at `path`, in ascending doc_id order.

    Null texts count as empty: one id, the end. Null doc_ids come first; rows with one doc_id are ordered by a checksum
    of their texts, by which the rows of a doc_id with many rows are dealt as well. Texts are dealt by range, not ids:
    dealing by range reads its input twice, once for a sample, and encoding is the dear step.
    """
    spark = docs.sparkSession
    size = int(str(docs.select("text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # larger shards have fewer distinct words; where Spark can't tell the size it says the largest of all
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // 2, size // _SHARD if size < 1 << 60 else 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.crc32("text"))

    def frames(batches):
        import os

        import tokenizers
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # one encoder a worker process, kept with the library: each loads a large vocabulary
        loaded = tokenizers.__dict__.setdefault("_millrace_encoders", {})
        if tokenizer_path not in loaded:
            loaded[tokenizer_path] = WordEncoder(tokenizer_path)
        encoder = loaded[tokenizer_path]
        shard, number, start = TaskContext.get().partitionId(), 0, 0
        names, counts, parts, size = [], [], [], 0
        schema = pa.schema([("shard", pa.int32()), ("frame", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("offsets", pa.binary()), ("words", pa.binary())])

        def close():
            nonlocal number, start, names, counts, parts, size
            words, offsets = pack(np.concatenate(parts))
            row = {"shard": [shard], "frame": [number], "start": [start], "doc_ids": [names], "counts": [counts], "offsets": [offsets.astype("<u4").tobytes()], "words": [words.astype("<u8").tobytes()]}
            number, start = number + 1, start + size
            names, counts, parts, size = [], [], [], 0
            return pa.RecordBatch.from_pydict(row, schema)

        for batch in batches:
            ids, at, ends = batch.column(0).to_pylist(), 0, np.cumsum(pc.binary_length(batch.column(1)).to_numpy())
            while at < len(ids):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _BYTES, "right")))
                flat, own = encoder.encode(batch.column(1).slice(at, to - at), end)
                names += ids[at:to]
                counts += own.tolist()
                parts.append(flat)
                size += len(flat)
                at = to
                if size >= FRAME:
                    yield close()
        if names:
            yield close()

    rows.repartitionByRange(shards, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text").mapInArrow(frames, _FRAMES).write.mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) and, if asked for, ids, of each document in the token files at `path`.

    start counts the ids of all documents before. Only the shards' totals, a number a file, go through the driver.
    """
    frames = spark.read.schema(_FRAMES).parquet(path)
    sizes = frames.select("shard", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("shard").agg(F.sum("n").alias("n")).collect()
    before, total = {}, 0
    for r in sorted(sizes, key=lambda r: r.shard):
        before[r.shard], total = total, total + r.n

    def run(batches):
        for batch in batches:
            for shard, start, names, counts, offsets, words in zip(*(batch.column(i).to_pylist() for i in range(6))):
                counts = np.array(counts, np.int64)
                ids = unpack(np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4"), int(counts.sum())).astype("<u4")
                ends = np.cumsum(counts)
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for c, e in zip(counts.tolist(), ends.tolist())]
                cols = [pa.array(names, pa.int64()), pa.array(before[shard] + start + ends - counts), pa.array(counts), pa.array(crc, pa.int64())]
                if keep_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return frames.select("shard", "start", "doc_ids", "counts", "offsets", "words").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * keep_ids)


def token_report(docs: DataFrame, tokenizer_path: str, end: int = 1) -> DataFrame:
    """What read_tokens() gives of files just written to the shared folder; an empty table gives an empty result."""
    path = fresh_path(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer_path, end)
    return read_tokens(docs.sparkSession, path)
