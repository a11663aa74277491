"""Simple-8b words, word-wise encoding against the tokenizers library, and token files read back."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from millrace.llm import tokens
from millrace.llm.tokens import WordEncoder, pack, token_report, unpack, unpack_block

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = ["", " ", "Hello, WORLD's 42nd\tline\n\nit's", "ΑΣ ΑΣΑ", "J̌ ǰ É", "<|endoftext|> <|startoftext|>x", "a\x0bb\x1cc d", "''s'' 'RE don'T", "naïve ǅ İ ﬁ", "x" * 5000, "<|ENDOFTEXT|>", "Say x<|StartOfText|>y, No", "<|Endoftext|>, A", "a, b. c! d~ e' f\\ g` h^", "的人 梦", "###%%% &&&", "12345 6"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 70000), st.integers(0, 3), st.integers(0, 2**64 - 1)), max_size=700), st.sampled_from([1, 7, 128, 256]))
def test_round_trip(values, block):
    words, offsets = pack(np.array(values, np.uint64), block)
    assert unpack(words, offsets, len(values), block).tolist() == values
    for k, at in enumerate(offsets.tolist()):  # each block decodes on its own
        own = values[k * block : (k + 1) * block]
        end = offsets[k + 1] if k + 1 < len(offsets) else len(words)
        hidden = np.zeros_like(words)
        hidden[at:end] = words[at:end]
        assert unpack_block(hidden, offsets, len(values), k, block).tolist() == own


def test_density():
    assert len(pack(np.ones(600, np.uint64), 600)[0]) == 10
    assert len(pack(np.full(300, 49407, np.uint64), 300)[0]) == 100


def same(texts):
    library = Tokenizer.from_file(PATH)
    flat, counts = WordEncoder(PATH).encode(pa.array(texts, pa.string()), 1)
    want = [[*e.ids, 1] for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]


def test_same_as_library():
    same([*TEXTS, None])


def test_forgotten_words_change_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "_KEPT", 12)
    library, encoder = Tokenizer.from_file(PATH), WordEncoder(PATH)
    for i in range(40):
        texts = [f"the same words, always; w{i % 7} and new{i} é{i % 3}", "the end."] + TEXTS[i % 5 :: 5]
        flat, _ = encoder.encode(pa.array(texts), 1)
        assert flat.tolist() == [x for e in library.encode_batch(texts, add_special_tokens=False) for x in [*e.ids, 1]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from("abcTHE'st 12\n<|>.,!́")), max_size=50), max_size=4))
def test_any_text_same_as_library(texts):
    same(texts)


def test_files(spark):
    library = Tokenizer.from_file(PATH)
    rows = [(i, t) for i, t in enumerate([*TEXTS, None])][::-1] + [(3, TEXTS[3]), (None, "no id"), (-7, "first after null")]
    df = spark.createDataFrame([(i, t, 0, "s") for i, t in rows], "doc_id long, text string, n int, shard string").repartition(3)
    got = sorted(token_report(df, PATH).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    text, start = {i: t for i, t in rows}, 0
    for r in got:
        ids = [*library.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert token_report(df.limit(0), PATH).count() == 0
