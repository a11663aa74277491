"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

Texts are cut where no piece of the vocabulary can reach across, each distinct cut is encoded once, and all distinct
cuts of a batch merge together: flat symbol arrays, the smallest pair rank of each word by a segmented minimum, all
leftmost merges of that rank at once, compaction, until no pair is left.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import release_memory

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_SPACE = "▁"
_NONE = np.int32(2**31 - 1)
#: Characters and texts handled at once, and distinct words kept between chunks.
_CHARS, _ROWS, _WORDS = 1 << 20, 500, 300_000


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lengths[0] numbers, then the same for each next start."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


class Pieces:
    """The tables of one BPE model with byte fallback, an identity normaliser and a dummy prefix."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        normal = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        own = {self.names[i]: i for i in normal}
        self.bytes_of = {int(self.names[i][3:-1], 16): i for i in range(n) if model.is_byte(i)}
        self.end, self.unknown, self.size = model.eos_id(), model.unk_id(), n
        order = sorted((i for i in normal if len(self.names[i]) > 1), key=lambda i: (-model.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        if len({model.get_score(i) for i in order if model.get_score(i) > -1e8}) < sum(model.get_score(i) > -1e8 for i in order):
            raise ValueError("pieces of equal score: merge order isn't defined by rank alone")
        pairs = {}
        for i in order:
            for cut in range(1, len(self.names[i])):
                a, b = own.get(self.names[i][:cut]), own.get(self.names[i][cut:])
                if a is not None and b is not None:
                    pairs[a * n + b] = (rank[i], i)
        self._build(np.fromiter(pairs, np.int64, len(pairs)), np.array([p[0] for p in pairs.values()], np.int32))
        self.merged = np.array(order, np.int32)  # by rank
        self.symbol = np.full(0x110000, -1, np.int32)
        for i in normal:
            if len(self.names[i]) == 1:
                self.symbol[ord(self.names[i])] = i
        inner = [p for p in own if _SPACE in p.lstrip(_SPACE)]
        lines = [p for p in own if "\n" in p]
        self.cut = re.compile(rf"{'' if lines else chr(10) + '|'}{_SPACE}*[^{_SPACE}{'' if lines else chr(10)}]+|{_SPACE}+") if not inner else None
        surface = [b""] * n
        for i in normal:
            surface[i] = self.names[i].replace(_SPACE, " ").encode()
        for b, i in self.bytes_of.items():
            surface[i] = bytes([b])
        surface[self.unknown] = " ⁇ ".encode()
        self.surface, self.lengths = np.frombuffer(b"".join(surface), np.uint8), np.array([len(s) for s in surface])
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.leads = np.array([x.startswith(_SPACE) for x in self.names])
        self.is_byte = np.zeros(n, bool)
        self.is_byte[list(self.bytes_of.values())] = True
        self.is_control = np.array([model.is_control(i) for i in range(n)])

    def _build(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """An open-addressed table of pair ranks: two gathers answer nearly all lookups."""
        self.bits = max(10, int(np.ceil(np.log2(len(keys) * 4 + 1))))
        self.keys, self.ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, _NONE, np.int32)
        at, left = self._slot(keys), np.arange(len(keys))
        self.probes = 0
        while len(left):
            self.probes += 1
            free = left[self.keys[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.keys[at[placed]], self.ranks[at[placed]] = keys[placed], ranks[placed]
            left = np.setdiff1d(left, placed)
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols; _NONE where they don't merge."""
        keys = a.astype(np.int64) * self.size + b
        at, out = self._slot(keys), np.full(len(keys), _NONE, np.int32)
        ok = np.flatnonzero((a >= 0) & (b >= 0))
        keys, at = keys[ok], at[ok]
        for _ in range(self.probes):
            seen = self.keys[at]
            hit = seen == keys
            out[ok[hit]] = self.ranks[at[hit]]
            go = ~hit & (seen >= 0)
            if not go.any():
                break
            ok, keys, at = ok[go], keys[go], (at[go] + 1) & ((1 << self.bits) - 1)
        return out

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all `words` one after another, and how many each has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.symbol[points]
        sym = np.where(sym >= 0, sym, -1 - points.astype(np.int32))
        word = np.repeat(np.arange(len(words)), sizes)
        rank = np.full(len(sym), _NONE, np.int32)
        if len(sym) > 1:
            same = np.flatnonzero(word[1:] == word[:-1])
            rank[same] = self.rank(sym[same], sym[same + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
            least = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(sym))))
            live = least != _NONE
            if not live.all():
                done.append((sym[~live], word[~live]))
                sym, word, rank, least = sym[live], word[live], rank[live], least[live]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == least)
            fresh = np.concatenate(([True], at[1:] != at[:-1] + 1))
            at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            at = self._safe(at, sym, word, least)
            sym[at] = self.merged[least[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            touched = np.zeros(len(sym), bool)
            touched[at] = True
            sym, word, rank, touched = sym[keep], word[keep], rank[keep], touched[keep]
            touched[:-1] |= touched[1:]
            new = np.flatnonzero(touched)
            last = np.append(word[1:] != word[:-1], True)
            rank[new[last[new]]] = _NONE
            new = new[~last[new]]
            rank[new] = self.rank(sym[new], sym[new + 1])
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        sym, word = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
        order = np.argsort(word, kind="stable")
        sym, word = sym[order], word[order]
        if (sym < 0).any():
            sym, word = self._fall_back(sym, word)
        return sym, np.bincount(word, minlength=len(words))

    def _safe(self, at, sym, word, least):
        """Of words with several merges at once, only the leftmost where a merge makes a pair of a smaller rank."""
        several = np.concatenate(([False], word[at[1:]] == word[at[:-1]]))
        if not several.any():
            return at
        own = word[at]
        many = np.isin(own, own[several])
        x = at[many]
        new = self.merged[least[x]]
        before, after = np.maximum(x - 1, 0), np.minimum(x + 2, len(sym) - 1)
        worse = (self.rank(new, new) < least[x]) | ((word[before] == word[x]) & (before < x) & (self.rank(sym[before], new) < least[x])) | ((word[after] == word[x]) & (after == x + 2) & (self.rank(new, sym[after]) < least[x]))
        if not worse.any():
            return at
        return at[~(several & np.isin(own, word[x[worse]]))]

    def _fall_back(self, sym, word):
        out_s, out_w = [], []
        for s, w in zip(sym.tolist(), word.tolist()):
            ids = [s] if s >= 0 else [self.bytes_of.get(b, self.unknown) for b in chr(-1 - s).encode()]
            out_s += ids
            out_w += [w] * len(ids)
        return np.array(out_s, np.int32), np.array(out_w, np.int64)

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        text = _SPACE + text.replace(" ", _SPACE)
        return self.cut.findall(text) if self.cut else [text]

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The UTF-8 text of each run of counts[i] ids, one after another in `ids`."""
        ids = np.asarray(ids)
        lengths = self.lengths[ids]
        flat = self.surface[_ranges(self.offsets[ids], lengths)].tobytes()
        ends = np.concatenate(([0], np.cumsum(lengths)))
        at = np.concatenate(([0], np.cumsum(counts)))
        out, control = [], bool(self.is_control[ids].any())
        for i in range(len(counts)):
            own = ids[at[i] : at[i + 1]]
            if control and self.is_control[own].any():  # ends a run of bytes
                out.append(self._repaired(own))
                continue
            raw = flat[ends[at[i]] : ends[at[i + 1]]]
            if len(own) and self.leads[own[0]]:
                raw = raw[1:]
            try:
                raw.decode()
            except UnicodeDecodeError:
                raw = self._repaired(own)
            out.append(raw)
        return out

    def _repaired(self, ids) -> bytes:
        """Byte pieces that are no UTF-8 become U+FFFD, one each."""
        out, run, first = [], b"", True
        for i in [*ids.tolist(), None]:
            if i is not None and self.is_byte[i]:
                run += self.surface[self.offsets[i] : self.offsets[i] + 1].tobytes()
                continue
            while run:
                for k in (4, 3, 2, 1):
                    try:
                        char = run[:k].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(char) == 1:
                        break
                else:
                    char, k = "�", 1
                out.append(char.encode())
                run, first = run[k:], False
            if i is not None and not self.is_control[i]:
                piece = self.surface[self.offsets[i] : self.offsets[i] + self.lengths[i]].tobytes()
                out.append(piece[1:] if first and self.leads[i] else piece)
                first = False
        return b"".join(out)


class Encoder:
    """Encodes texts, keeping the distinct words seen so far up to a bound that changes no result."""

    def __init__(self, pieces: Pieces, keep: int = _WORDS):
        self.pieces, self.keep = pieces, keep
        self._reset()

    def _reset(self):
        self.index: dict[str, int] = {}
        self.ids, self.counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.texts: list[str] = []

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Flat ids without end ids, their number by text, and each text's ids in decimal."""
        if len(self.index) > self.keep:
            self._reset()
        cut = [self.pieces.words(t) for t in texts]
        index, new = self.index, []
        for words in cut:
            for w in words:
                if w not in index:
                    index[w] = len(index)
                    new.append(w)
        if new:
            ids, counts = self.pieces.merge(new)
            self.ids, self.counts = np.concatenate((self.ids, ids)), np.concatenate((self.counts, counts))
            decimal, ends = list(map(str, ids.tolist())), np.cumsum(counts).tolist()
            self.texts += [" ".join(decimal[a:b]) for a, b in zip([0, *ends[:-1]], ends)]
        sizes = np.fromiter(map(len, cut), np.int64, len(cut))
        used = np.fromiter((index[w] for words in cut for w in words), np.int64, int(sizes.sum()))
        lengths, starts = self.counts[used], (np.cumsum(self.counts) - self.counts)[used]
        flat = self.ids[_ranges(starts, lengths)]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        at = np.concatenate(([0], np.cumsum(sizes)))
        said, used = self.texts, used.tolist()
        return flat, np.diff(sums[at]), [" ".join([said[k] for k in used[a:b]]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def chunks(texts: list[str], most: int = _CHARS):
    """Runs of texts of about `most` characters; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False, keep_text: bool = False) -> DataFrame:
    """Each row's ids with the end id, and what they decode to, as digests and, if asked for, in full.

    Returns doc_id, n_tokens, ids_sha256, decoded_sha256, then ids array<int> and decoded string as asked. Null texts
    count as empty: one id, the end. Every row of `docs` gives one row; other columns are not read.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids + ", decoded string" * keep_text

    def run(batches):
        encoder, sha = Encoder(Pieces(model_path)), hashlib.sha256
        for batch in batches:
            for first in range(0, batch.num_rows, _ROWS):
                own, at = batch.slice(first, _ROWS), 0
                for part in chunks([t or "" for t in own.column(1).to_pylist()]):
                    flat, counts, said = encoder.encode(part)
                    end = encoder.pieces.end
                    decoded = encoder.pieces.decode(flat, counts)
                    n = len(part)
                    cols = [
                        own.column(0).slice(at, n), pa.array(counts + 1),
                        pa.array([sha(f"{s} {end}".encode() if s else str(end).encode()).hexdigest() for s in said]),
                        pa.array([sha(d).hexdigest() for d in decoded]),
                    ]
                    if keep_ids:
                        ends = np.cumsum(counts)
                        cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends + np.arange(1, n + 1))), pa.int32()), pa.array(np.insert(flat, ends, end), pa.int32())))
                    if keep_text:
                        cols.append(pa.array([d.decode() for d in decoded]))
                    at += n
                    yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in schema.split(", ")])
                flat = said = decoded = cols = None
            release_memory()  # workers are kept, and so would be what they held
        encoder = None
        release_memory()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
